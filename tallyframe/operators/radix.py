"""Exact order statistics of whole-number and decimal columns by counting digits, without a sort or a double."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of a digit: a scan counts at most 2**BITS digits per column and wanted rank.
BITS = 20
RESULT = "column_name string, prob double, n_values long, low decimal(38,10), high decimal(38,10), value decimal(38,10)"


def _scale(f: T.StructField) -> int:
    if isinstance(f.dataType, T.IntegralType):
        return 0
    if isinstance(f.dataType, T.DecimalType) and f.dataType.scale <= 10:
        return f.dataType.scale
    raise TypeError(f"column {f.name}: whole numbers and decimals of at most ten places, not {f.dataType.simpleString()}")


def _units(name: str, v: Column, lo: Decimal, hi: Decimal, scale: int) -> Column:
    """Distance of a decimal from the minimum in units of its last place. Whole part and places are taken apart and every
    type is as narrow as the values allow, so that no product is rounded."""
    whole = len(str(int(max(abs(lo), abs(hi)))))
    if whole + scale > 35:
        raise ValueError(f"column {name}: values of {whole + scale} digits, at most 35 are handled")
    narrow = f"decimal({whole + scale},{scale})"
    apart = v.cast(narrow) - F.lit(lo).cast(narrow)
    full = F.floor(apart).cast(f"decimal({whole + 1},0)")
    places = (apart - full).cast(f"decimal({scale + 1},{scale})")
    ten = F.lit(Decimal(10 ** scale))
    return full * ten + (places * ten).cast(f"decimal({scale + 1},0)")


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[str | float]) -> DataFrame:
    """Quantiles of many columns in the same scans: per column and probability the number of values, the two
    order statistics around the wanted rank and the value interpolated between them, cut to ten places.

    The first scan takes counts and ranges. Every further scan counts, per column, the next digit of 20 bits of the
    distance from the minimum, for values that share the digits found so far; the running count tells the digit of each
    wanted rank. Ranges below 2**60 units (a unit is the last decimal place) take four scans or fewer, each
    further 20 bits one more. Counts are combined before the shuffle, at most 2**20 per rank and column are summed up in a
    task, and only the digits found come to the driver: a few per column and probability.

    NULLs are left out; a column without values gives no rows. Decimal values of more than 35 digits are
    refused. A probability is read as its decimal text, so 0.1 is a tenth."""
    fields = {f.name: f for f in df.schema.fields}
    scales = {c: _scale(fields[c]) for c in columns}
    shares = {str(p): Fraction(str(p)) for p in probs}
    if any(not 0 <= p <= 1 for p in shares.values()):
        raise ValueError("probabilities lie between 0 and 1")
    spark = df.sparkSession
    first = df.agg(*[a for i, c in enumerate(columns) for v in [F.col(f"`{c}`")] for a in (
        F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"))]).first()

    keys: dict[int, Column] = {}
    digits: dict[int, int] = {}
    # What is known of each wanted rank of each column: distance of its interval from the minimum, and rank within it.
    state: dict[tuple[int, int], tuple[int, int]] = {}
    for i, c in enumerate(columns):
        n, lo, hi = first[f"n{i}"], first[f"lo{i}"], first[f"hi{i}"]
        if not n:
            continue
        span = int(Fraction(hi - lo) * 10 ** scales[c])
        digits[i] = max(1, -(-span.bit_length() // BITS))
        v = F.col(f"`{c}`")
        if isinstance(fields[c].dataType, T.IntegralType):
            # Whole numbers from end to end of long are further apart than a long can tell.
            keys[i] = v.cast("long") - F.lit(lo).cast("long") if span < 2**62 else v.cast("decimal(38,0)") - F.lit(Decimal(lo))
        else:
            apart = _units(c, v, lo, hi, scales[c])
            keys[i] = apart.cast("long") if span < 2**62 else apart.cast("decimal(38,0)")
        for p in shares.values():
            at = p * (n - 1)
            for rank in {at.__floor__(), at.__ceil__()}:
                state[i, rank] = (0, rank)
    wide = {i: int(Fraction(first[f"hi{i}"] - first[f"lo{i}"]) * 10 ** scales[columns[i]]) >= 2**62 for i in digits}

    for place in range(max(digits.values(), default=0) - 1, -1, -1):
        unit, size = 2 ** (BITS * place), 2 ** (BITS * (place + 1))
        active = {k: s for k, s in state.items() if digits[k[0]] > place}
        items = []
        for i, base in sorted({(k[0], s[0]) for k, s in active.items()}):
            start = F.lit(Decimal(base)) if wide[i] else F.lit(base).cast("long")
            last = F.lit(Decimal(base + size - 1)) if wide[i] else F.lit(min(base + size - 1, 2**63 - 1)).cast("long")
            rest = keys[i] - start
            digit = F.call_function("div", rest, F.lit(Decimal(unit)) if wide[i] else F.lit(unit).cast("long"))
            items.append(F.when(keys[i].between(start, last), F.struct(
                F.lit(i).alias("i"), F.lit(str(base)).alias("base"), digit.cast("int").alias("digit"))))
        counts = df.select(F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("x")).select("x.*").groupBy("i", "base", "digit").agg(
            F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy("i", "base").orderBy("digit"))
        wanted = spark.createDataFrame([(i, str(s[0]), rank, s[1]) for (i, rank), s in active.items()], "i int, base string, rank long, within long")
        found = counts.withColumn("upto", upto).join(F.broadcast(wanted), ["i", "base"]).where(
            (F.col("within") < F.col("upto")) & (F.col("within") >= F.col("upto") - F.col("n")))
        for r in found.select("i", "rank", "base", "digit", (F.col("within") - F.col("upto") + F.col("n")).alias("left")).collect():
            state[r.i, r.rank] = (int(r.base) + r.digit * unit, r.left)

    rows = []
    places = Decimal(1).scaleb(-10)
    for i in digits:
        c, n = columns[i], first[f"n{i}"]
        value = {rank: Fraction(first[f"lo{i}"]) + Fraction(s[0], 10 ** scales[c]) for (j, rank), s in state.items() if j == i}
        for p in shares.values():
            at = p * (n - 1)
            low, high = value[at.__floor__()], value[at.__ceil__()]
            middle = low + (high - low) * (at - at.__floor__())
            rows.append((c, float(p), n, *[Decimal((x * 10**10).__trunc__()) * places for x in (low, high, middle)]))
    return spark.createDataFrame(rows, RESULT)
