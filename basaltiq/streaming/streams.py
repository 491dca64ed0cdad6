"""Structured Streaming over events and journals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def windowed(events: DataFrame, ts: str, length: str, late: str, *keys: str) -> DataFrame:
    """Counts and sums of value in tumbling windows; state beyond the watermark is dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, length), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def idle(events: DataFrame, ts: str, gap: str, key: str, late: str) -> DataFrame:
    """Sessions of an entity that end after `gap` without events: passivation by idle time."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("touches"))


def latest_state(journal: DataFrame, sink: str) -> object:
    """Folds each micro-batch of a journal into a Parquet folder of current states, one subfolder a batch."""
    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{sink}/{number - 1}") if number else None
        every = batch if old is None else old.unionByName(batch)
        last = every.groupBy("entity").agg(F.max_by(F.struct(*[c for c in every.columns if c != "entity"]), "seq").alias("r")).select("entity", "r.*")
        last.select(*batch.columns).write.mode("overwrite").parquet(f"{sink}/{number}")

    return journal.writeStream.foreachBatch(fold)
