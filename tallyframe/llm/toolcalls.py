"""Tool calls of conversations: results linked, calls ordered, arguments validated, canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql import types as T

from tallyframe.common import cut_lineage, exceeds, spread_join

TYPES = ("string", "integer", "number", "boolean", "object", "array")
#: A string of JSON, kept as it is, or the part of a number before a fraction of zero.
_WHOLE = r'("(?:[^"\\]++|\\.)*+")|(-?[0-9]++)\.0(?=[,\]}E]|$)'


def json_text(value: Column) -> Column:
    """A JSON string literal."""
    quoted = F.to_json(F.struct(value.alias("v")))
    return F.when(value.isNull(), F.lit("null")).otherwise(F.substr(quoted, F.lit(6), F.length(quoted) - 6))


def canonical_object(entries: Column) -> Column:
    """JSON of an array of (key, literal) structs: keys in order, no blanks."""
    return F.concat(F.lit("{"), F.concat_ws(",", F.transform(F.array_sort(entries), lambda e: F.concat(json_text(e["key"]), F.lit(":"), e["literal"]))), F.lit("}"))


def canonical_value(value: Column) -> Column:
    """JSON of a variant: keys in order at every level, no blanks, numbers without trailing zeros."""
    return F.regexp_replace(F.to_json(value), F.lit(_WHOLE), F.lit("$1$2"))


def _is_json(frame: DataFrame) -> bool:
    return isinstance(frame.schema["arguments"].dataType, T.StringType)


def canonical_arguments(arguments: Column, is_json: bool = False) -> Column:
    """JSON of a map from names to texts; NULL values are null, a NULL map is {}. Or of a JSON text
    (``is_json``), whose values keep their types; a text that isn't JSON becomes a string."""
    if is_json:
        return F.coalesce(canonical_value(F.try_parse_json(F.coalesce(arguments, F.lit("{}")))), json_text(arguments))
    entries = F.map_entries(F.coalesce(arguments, F.create_map().cast("map<string,string>")))
    return canonical_object(F.transform(entries, lambda e: F.struct(e["key"].alias("key"), json_text(e["value"]).alias("literal"))))


def fits_type(value: Column, kind: Column) -> Column:
    """Whether a text is a value of a schema type; NULL for a type that isn't one of TYPES. Without a
    type (NULL), any value fits."""
    parsed = F.coalesce(F.schema_of_variant(F.try_parse_json(value)), F.lit(""))
    return (F.when(kind.isNull() | (kind == "string"), F.lit(True)).when(kind == "integer", value.rlike(r"^-?(0|[1-9][0-9]*)$"))
            .when(kind == "boolean", value.isin("true", "false")).when(kind == "number", value.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"))
            .when(kind == "object", parsed.startswith("OBJECT")).when(kind == "array", parsed.startswith("ARRAY")))


def fits_json_type(value: Column, kind: Column) -> Column:
    """The same for a variant. A number without a fraction is an integer, however it is written."""
    found, text = F.schema_of_variant(value), canonical_value(value)
    number = found.rlike("^(BIGINT|DECIMAL|DOUBLE)")
    real = text.try_cast("double")
    return (F.when(kind.isNull(), F.lit(True)).when(kind == "string", found == "STRING").when(kind == "boolean", found == "BOOLEAN").when(kind == "number", number)
            .when(kind == "integer", number & (text.rlike("^-?[0-9]+$") | (text.contains("E") & F.coalesce(F.floor(real).cast("double") == real, F.abs(real) > 1e15))))
            .when(kind == "object", found.startswith("OBJECT")).when(kind == "array", found.startswith("ARRAY")))


def call_levels(calls: DataFrame) -> DataFrame:
    """(call_id, level): 0 for calls without a known parent, else one more than the parent's level; NULL
    on a cycle and behind one.

    Every call points to an ancestor and knows how far it is; each round replaces the pointer by the
    ancestor's own, so that a chain of n calls takes log2(n) rounds however long a conversation is.
    """
    known = calls.select(F.col("call_id").alias("p"))
    # Ids are unique here: see link_tool_calls.
    state = calls.select("call_id", "parent_id").join(known, F.col("parent_id") == F.col("p"), "left").select(
        "call_id", F.col("p").alias("up"), F.when(F.col("p").isNull(), 0).otherwise(1).cast("long").alias("level"))
    state = cut_lineage(state, "levels")
    longest = state.count()
    rounds = 0
    while not state.where("up IS NOT NULL").isEmpty():
        if 2 ** rounds > longest:
            state = state.withColumn("level", F.when(F.col("up").isNull(), F.col("level")))
            break
        above = state.select(F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("level").alias("more"))
        state = cut_lineage(state.join(above, "up", "left").select(
            "call_id", F.col("next").alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")), "levels")
        rounds += 1
    return state.select("call_id", "level")


def argument_errors(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """(call_id, errors): sorted messages on unknown tools, missing, unknown and ill-typed arguments.

    schemas has a row per argument: tool, argument, type (one of TYPES, NULL for any), required, values
    (allowed texts or NULL; canonical JSON for values that aren't strings). A type of another name is
    reported with its argument. Arguments that aren't a JSON object are reported as ``json``. A
    tool's arguments are gathered into one row, which is joined to its calls.
    """
    tools = schemas.where("tool IS NOT NULL").groupBy("tool").agg(F.array_sort(F.collect_list(F.struct(
        "argument", "type", F.coalesce("required", F.lit(False)).alias("required"), "values"))).alias("rules"))
    if exceeds(tools):
        joined = spread_join(calls.select("call_id", "tool", "arguments"), tools, ["tool"], "left")
    else:
        joined = calls.select("call_id", "tool", "arguments").join(F.broadcast(tools), "tool", "left")
    is_json = _is_json(calls)
    if is_json:
        parsed = F.try_parse_json(F.coalesce("arguments", F.lit("{}")))
        joined = joined.withColumn("__parsed", parsed).withColumn("__object", F.coalesce(F.schema_of_variant("__parsed").startswith("OBJECT"), F.lit(False)))
        joined = joined.withColumn("__given", F.when(F.col("__object"), F.try_variant_get("__parsed", "$", "map<string,variant>")))
        given = F.coalesce("__given", F.create_map().cast("map<string,variant>"))
        fits, absent = fits_json_type, lambda v: v.isNull() | (F.schema_of_variant(v) == "VOID")
        text = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(canonical_value(v))
    else:
        given = F.coalesce("arguments", F.create_map().cast("map<string,string>"))
        fits, absent, text = fits_type, lambda v: v.isNull(), lambda v: v
    value = lambda r: F.element_at(given, r["argument"])
    per_rule = F.transform("rules", lambda r: F.when(r["type"].isNotNull() & ~r["type"].isin(*TYPES), F.concat(F.lit("schema:"), r["argument"]))
        .when(absent(value(r)), F.when(r["required"], F.concat(F.lit("missing:"), r["argument"])))
        .when(~fits(value(r), r["type"]), F.concat(F.lit("type:"), r["argument"]))
        .when(r["values"].isNotNull() & ~F.array_contains(r["values"], text(value(r))), F.concat(F.lit("value:"), r["argument"])))
    unknown = F.transform(F.array_except(F.map_keys(given), F.transform("rules", lambda r: r["argument"])), lambda k: F.concat(F.lit("unknown:"), k))
    errors = F.when(F.col("rules").isNull(), F.array(F.lit("tool"))).otherwise(F.array_sort(F.concat(
        F.filter(per_rule, lambda e: e.isNotNull()), unknown)))
    if is_json:
        errors = F.when(F.col("rules").isNotNull() & ~F.col("__object"), F.array(F.lit("json"))).otherwise(errors)
    return joined.select("call_id", errors.alias("errors"))


def _positions(rows: DataFrame) -> DataFrame:
    """Add ``position``: the rank in the conversation by (level, turn, call_id), from 0.

    Rows are sorted by range over the whole table, so that a long conversation spans several
    partitions; ranks within a partition start from the conversation's rows in those before it.
    """
    order = ["conv_id", F.col("level").asc_nulls_last(), "turn", "call_id"]
    ranged = cut_lineage(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ordered")
    sizes = ranged.groupBy("conv_id", "__part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("conv_id", "__part", F.coalesce(F.sum("n").over(
        Window.partitionBy("conv_id").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("conv_id", "__part").orderBy(*order[1:]))
    right = before.withColumnsRenamed({"conv_id": "__c", "__part": "__p"})
    return ranged.withColumn("position", rank - 1).join(right, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("__part") == F.col("__p"))).withColumn(
        "position", (F.col("position") + F.col("__before")).cast("long")).drop("__c", "__p", "__part", "__before")


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """Join calls with their results by identifier, order them, validate and serialise them.

    calls: conv_id, turn, call_id, parent_id (the call whose result this one needs, or NULL), tool,
    arguments (JSON text, whose values keep their types and nesting, or a map of texts, which are
    written as strings). results: call_id, turn, content. schemas: see ``argument_errors``.
    Further columns are ignored.

    One row per identifier: conv_id, call_id, turn, level and position (topological order within the
    conversation: a call comes after its parent; ties by turn, then identifier), status, errors, json.
    status is ok, invalid (errors in the arguments), cycle (no topological order), no_result, or
    orphan (a result without a call). A repeated identifier counts once: the call of the smallest
    turn and the result of the smallest turn stand (then the smaller text), and errors has
    ``repeated_call`` or ``repeated_result``. Calls and results without an identifier are left as
    they are, unlinked: a call becomes no_result, a result orphan; their level is 0.
    json has the keys arguments, call_id, result and tool, in this order, without blanks.
    """
    c = calls.select("conv_id", "turn", "call_id", "parent_id", "tool", "arguments")
    r = results.select("call_id", F.col("turn").alias("result_turn"), "content")
    is_json = _is_json(c)
    named_c, named_r = c.where("call_id IS NOT NULL"), r.where("call_id IS NOT NULL")
    first = F.struct("turn", "conv_id", "tool", canonical_arguments(F.col("arguments"), is_json).alias("text"), "parent_id")
    call_rows = F.struct("conv_id", "turn", "parent_id", "tool", "arguments")
    one_call = named_c.groupBy("call_id").agg(F.min_by(call_rows, first).alias("c"), F.count(F.lit(1)).alias("calls")).select("call_id", "c.*", "calls")
    one_result = named_r.groupBy("call_id").agg(F.min(F.struct("result_turn", "content")).alias("r"), F.count(F.lit(1)).alias("results")).select(
        "call_id", F.col("r.content").alias("content"), "results")
    one_call = cut_lineage(one_call, "calls")
    levels = call_levels(one_call)
    checked = argument_errors(one_call, schemas)
    linked = (one_call.join(one_result, "call_id", "full_outer").join(levels, "call_id", "left").join(checked, "call_id", "left"))
    loose_c = c.where("call_id IS NULL").select("call_id", "conv_id", "turn", "parent_id", "tool", "arguments", F.lit(1).cast("long").alias("calls"),
                                                F.lit(None).cast("string").alias("content"), F.lit(None).cast("long").alias("results"),
                                                F.lit(0).cast("long").alias("level"), F.array().cast("array<string>").alias("errors"))
    loose_r = r.where("call_id IS NULL").select("call_id", "content", F.lit(1).cast("long").alias("results"), F.lit(0).cast("long").alias("level"),
                                                F.array().cast("array<string>").alias("errors"))
    every = linked.unionByName(loose_c).unionByName(loose_r, allowMissingColumns=True)
    more = F.concat(F.coalesce("errors", F.array().cast("array<string>")),
                    F.when(F.col("calls") > 1, F.array(F.lit("repeated_call"))).otherwise(F.array().cast("array<string>")),
                    F.when(F.col("results") > 1, F.array(F.lit("repeated_result"))).otherwise(F.array().cast("array<string>")))
    status = (F.when(F.col("calls").isNull(), "orphan").when(F.col("level").isNull(), "cycle").when(F.col("results").isNull(), "no_result")
              .when(F.size("errors") > 0, "invalid").otherwise("ok"))
    text = F.concat(F.lit('{"arguments":'), canonical_arguments(F.col("arguments"), is_json), F.lit(',"call_id":'), json_text(F.col("call_id")),
                    F.lit(',"result":'), json_text(F.col("content")), F.lit(',"tool":'), json_text(F.col("tool")), F.lit("}"))
    out = every.select("conv_id", "call_id", "turn", "level", status.alias("status"), F.array_sort(more).alias("errors"), text.alias("json"))
    return _positions(out).select("conv_id", "call_id", "turn", "level", "position", "status", "errors", "json")


def calls_of_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results read from turns (conv_id, turn, role, text): every turn of a user or the system
    is a call that needs the one two turns before, every turn of the assistant the result of the
    call one turn before."""
    name = lambda t: F.concat_ws(":", F.col("conv_id").cast("string"), t.cast("string"))
    call_id = F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), name(F.col("turn")))
    calls = turns.where("role IN ('user', 'system')").select(
        "conv_id", "turn", call_id.alias("call_id"), F.when(F.col("turn") >= 2, name(F.col("turn") - 2)).alias("parent_id"),
        F.when(F.col("role") == "system", "set_rules").otherwise("answer").alias("tool"),
        F.create_map(F.lit("prompt"), F.col("text"), F.lit("n_chars"), F.length("text").cast("string"),
                     F.lit("first"), (F.col("turn") <= 1).cast("string")).alias("arguments"))
    results = turns.where("role = 'assistant'").select(
        F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), name(F.col("turn") - 1)).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def conversation_schemas(turns: DataFrame) -> DataFrame:
    """Fixed schemas of the two tools above."""
    return turns.sparkSession.sql("""SELECT * FROM VALUES
      ('answer', 'prompt', 'string', true, NULL), ('answer', 'n_chars', 'integer', true, NULL), ('answer', 'first', 'boolean', false, NULL),
      ('set_rules', 'prompt', 'string', true, NULL), ('set_rules', 'n_chars', 'integer', true, NULL), ('set_rules', 'first', 'boolean', true, array('true'))
      AS s(tool, argument, type, required, values)""").withColumn("values", F.col("values").cast("array<string>"))


def conversation_calls(turns: DataFrame) -> DataFrame:
    calls, results = calls_of_conversations(turns)
    return link_tool_calls(calls, results, conversation_schemas(turns)).withColumn("errors", F.concat_ws(",", "errors"))
