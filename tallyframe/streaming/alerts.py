"""Streaming metric collection with z-score alerts against a baseline kept as keyed state."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyframe.operators.anomaly import BASELINE, CRITICAL, MIN_POINTS, WARNING
from tallyframe.streaming.clock import closed
from tallyframe.streaming.common import batch_path, read_batches, run_available

#: Keyed state of single values needs this store.
STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession):
    """The store for keyed state while a query starts; the session's own setting comes back afterwards."""
    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        yield
    finally:
        spark.conf.unset(STORE[0]) if before is None else spark.conf.set(STORE[0], before)


SCORES = T.StructType([
    T.StructField("baseline_mean", T.DoubleType()), T.StructField("baseline_stddev", T.DoubleType()), T.StructField("n_points", T.LongType()),
    T.StructField("z_score", T.DoubleType()), T.StructField("is_anomaly", T.BooleanType()), T.StructField("severity", T.StringType())])


def trailing_baseline(columns: Sequence[str], size: int, warning: float, critical: float) -> StatefulProcessor:
    """The processor that scores windows; nested, so that it travels to the workers."""
    names = SCORES.names

    def score(value: float | None, before: Sequence[float | None]) -> tuple:
        """Mean, stddev, points, z-score, whether it is an anomaly, and the severity of one value against those before it."""
        known = [x for x in before if x is not None]
        n, mean, spread, z = len(known), value, 0.0, 0.0
        if n >= MIN_POINTS:
            mean = math.fsum(known) / n
            spread = math.sqrt(math.fsum((x - mean) ** 2 for x in known) / n)
            # A spread that is only rounding noise of equal values counts as none.
            if spread > abs(mean) * 1e-12:
                z = None if value is None else abs(value - mean) / spread
        level = "normal" if z is None or z <= warning else "warning" if z <= critical else "critical"
        return mean, spread, n, z, None if z is None else z > warning, level

    class TrailingBaseline(StatefulProcessor):
        """Scores the closed windows of a key in order. State: the last ``size`` values of the key, and no more."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.ring = handle.getValueState("ring", T.StructType([T.StructField("values", T.ArrayType(T.DoubleType()))]))

        def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
            known = list(self.ring.get()[0]) if self.ring.exists() else []
            new = pd.concat(list(rows)).sort_values("measured_at")
            scores = []
            for value in new["value"].tolist():
                value = None if pd.isna(value) else float(value)
                scores.append(score(value, known))
                known = [*known, value][-size:]
            self.ring.update((known,))
            yield pd.concat([new[list(columns)].reset_index(drop=True), pd.DataFrame(scores, columns=names)], axis=1)

        def close(self) -> None:
            pass

    return TrailingBaseline()


def collect_metrics(stream: DataFrame, keys: Sequence[str], at: str, window: str, watermark: str, aggs: Sequence[Column], out: str, checkpoint: str,
                    clock: str | None = None, baseline: int = BASELINE, warning: float = WARNING, critical: float = CRITICAL):
    """Metrics per key and tumbling window, each scored once, when its window closes, against the ``baseline``
    values of the key before it.

    Windows close in order of time, so a key's values come in order over all batches. A batch reads its
    own rows and the state of the keys it closes windows of; it reads no earlier batch. State per key and metric is
    a list of ``baseline`` numbers. Rows behind the watermark are dropped, as their windows are scored already."""
    counted = closed(stream, at, window, watermark, keys, aggs, clock)
    names = [c for c in counted.columns if c not in (*keys, "window")]
    values = F.array(*[F.struct(F.lit(n).alias("metric_name"), F.col(n).cast("double").alias("value")) for n in names])
    rows = counted.select(F.col("window.start").alias("measured_at"), *keys, F.inline(values))
    schema = T.StructType([*rows.schema.fields, *SCORES.fields])
    scored = rows.groupBy(*keys, "metric_name").transformWithStateInPandas(
        trailing_baseline(rows.columns, baseline, warning, critical), schema, "Append", "None")

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(batch_path(f"{out}/metrics", batch_id))

    with keyed_state(stream.sparkSession):
        return run_available(scored, write, checkpoint)


def scored_metrics(spark: SparkSession, out: str) -> DataFrame:
    """Every metric of every closed window with its score, as written when the window closed."""
    return read_batches(spark, f"{out}/metrics").drop("batch")


def current_alerts(spark: SparkSession, out: str) -> DataFrame:
    return scored_metrics(spark, out).where("is_anomaly")
