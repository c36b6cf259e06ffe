"""Structured Streaming over append-only logs: windowed counts with a watermark, stream-static joins, running state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarrymint.session import scratch_path


def stream_table(spark: SparkSession, path: str) -> DataFrame:
    """A stream over the Parquet files of a table, a single file or a folder."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{path}*")


def window_counts(events: DataFrame, time: str, keys: list[str], value: str, width: str = "1 hour", late: str = "30 days") -> DataFrame:
    """Counts and sums of each window and key; rows later than ``late`` behind the newest are dropped."""
    at = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return at.groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))


def running_totals(events: DataFrame, key: str, value: str) -> DataFrame:
    """Per key the rows seen so far and the sum, kept in state; each batch emits the keys it changed."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for part in parts:
            n += len(part)
            total += float(part[value].fillna(0.0).sum())
        state.update((n, total))
        yield pd.DataFrame({key: [k[0]], "n": [n], "total": [total]})

    kind = events.schema[key].dataType.simpleString()
    return events.select(key, value).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Process what is there, then stop; returns the result as a table. In update mode later batches replace the ``keys``
    of earlier ones."""
    spark = stream.sparkSession
    out, check = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-check")

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", check).trigger(availableNow=True).foreachBatch(save).start()
    query.awaitTermination()
    rows = spark.read.parquet(out)
    if mode == "update" and keys:
        latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), "__batch").alias("r"))
        return latest.select(*keys, "r.*").drop("__batch")
    return rows.drop("__batch")
