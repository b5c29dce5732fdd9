"""Schema comparison, evolution, inventories and search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ON = ("table_name", "column_name")

# ---- Fixed values: declared types and the actual types they accept ----
COMPATIBLE = {
    "string": ("string", "varchar", "char", "text"),
    "varchar": ("string", "varchar", "char", "text"),
    "int": ("int", "integer", "bigint", "smallint", "tinyint"),
    "integer": ("int", "integer", "bigint", "smallint", "tinyint"),
    "bigint": ("int", "integer", "bigint", "long"),
    "long": ("bigint", "long"),
    "double": ("double", "float", "decimal", "numeric"),
    "float": ("double", "float", "decimal", "numeric"),
    "decimal": ("double", "float", "decimal", "numeric"),
    "boolean": ("boolean", "bool"),
    "date": ("date",),
    "timestamp": ("timestamp", "datetime"),
}


def inventory_of(df: DataFrame, table: str) -> DataFrame:
    """Columns of a frame as inventory rows."""
    rows = [(table, f.name, f.dataType.simpleString(), f.nullable, i + 1) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "table_name string, column_name string, data_type string, is_nullable boolean, ordinal_position int")


def schema_diff(a: DataFrame, b: DataFrame, on: Sequence[str] = ON) -> DataFrame:
    """Columns added, removed, or changed in type or nullability between two inventories (b against a)."""
    x = a.select(*on, F.col("data_type").alias("source_type"), F.col("is_nullable").alias("source_nullable"))
    y = b.select(*on, F.col("data_type").alias("dest_type"), F.col("is_nullable").alias("dest_nullable"))
    change = (F.when(F.col("source_type").isNull(), "added").when(F.col("dest_type").isNull(), "removed")
              .when(F.col("source_type") != F.col("dest_type"), "type_changed")
              .when(F.col("source_nullable") != F.col("dest_nullable"), "nullability_changed"))
    return x.join(y, list(on), "full_outer").withColumn("change", change).where("change IS NOT NULL")


def drift_report(diff: DataFrame) -> DataFrame:
    """Number of changes of each kind per table."""
    kinds = ("added", "removed", "type_changed", "nullability_changed")
    return diff.groupBy("table_name").agg(*[F.count_if(F.col("change") == k).alias(k) for k in kinds], F.count(F.lit(1)).alias("total_changes"))


def compatible_tables(diff: DataFrame) -> DataFrame:
    """Whether the evolution of every table only adds nullable columns."""
    ok = (F.col("change") == "added") & F.col("dest_nullable")
    return diff.groupBy("table_name").agg(F.bool_and(ok).alias("compatible"))


def evolve(df: DataFrame, target: T.StructType, drop_removed: bool = False, change_types: bool = True) -> DataFrame:
    """The frame in the shape of a target schema: new columns as NULL, types cast (a value that
    cannot be cast becomes NULL), columns unknown to the target dropped only if asked."""
    want = {f.name: f for f in target.fields}
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name not in want:
            if not drop_removed:
                out.append(c)
        elif change_types and want[f.name].dataType != f.dataType:
            out.append(c.try_cast(want[f.name].dataType).alias(f.name))
        else:
            out.append(c)
    have = set(df.columns)
    out += [F.lit(None).cast(f.dataType).alias(f.name) for f in target.fields if f.name not in have]
    return df.select(*out)


def types_compatible(declared, actual):
    """Loose type check as a column: the base names are equal or listed as compatible."""
    base = lambda c: F.trim(F.substring_index(F.lower(c), "(", 1))
    d, a = base(declared), base(actual)
    table = F.create_map(*[x for k, v in COMPATIBLE.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))])
    return (d == a) | F.coalesce(F.array_contains(F.try_element_at(table, d), a), F.lit(False))


def search(inventory: DataFrame, pattern: str, in_columns: bool = True) -> DataFrame:
    """Inventory rows whose table (or column) name matches a pattern, ignoring case."""
    p = f"(?i){pattern}"
    hit = F.col("table_name").rlike(p)
    if in_columns:
        hit = hit | F.col("column_name").rlike(p)
    return inventory.where(hit).withColumn("matched", F.when(F.col("table_name").rlike(p), "table").otherwise("column"))


def schema_summary(inventory: DataFrame) -> DataFrame:
    """Tables, columns and columns of personal-looking names per schema."""
    from tallyframe.functions.pii import type_of_name

    return inventory.groupBy("table_schema").agg(
        F.count_distinct("table_name").alias("n_tables"), F.count(F.lit(1)).alias("n_columns"),
        F.count_distinct(F.when(type_of_name(F.col("column_name")).isNotNull(), F.col("column_name"))).alias("n_pii_like"))
