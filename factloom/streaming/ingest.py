"""Facts from a growing folder of text files into a store, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.operators.represent import normalize
from factloom.sources.files import parse_fact_lines
from factloom.sources.store import FactStore


def stream_facts(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of normalised facts of the lines of all files that appear in a folder."""
    lines = spark.readStream.text(folder).select(F.lit(0).cast("long").alias("line_no"), "value")
    return normalize(parse_fact_lines(lines).drop("line_no"))


def ingest(spark: SparkSession, folder: str, store: FactStore, checkpoint: str, source: str = "original") -> StreamingQuery:
    """Upsert every micro-batch; the upsert is idempotent, so a batch that is run again after a failure changes nothing.

    Batches number their facts after the batch number, so later batches win.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("row_id", F.lit(number) * F.lit(1 << 40) + F.monotonically_increasing_id()).withColumn("source", F.lit(source)).drop("nth")
        if not rows.isEmpty():
            store.upsert(rows)

    return stream_facts(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events per window and kind; works on a stream with late data up to ``late`` and on a table alike."""
    timed = events.withColumn("__t", F.col(time).cast("timestamp"))
    return timed.withWatermark("__t", late).groupBy(F.window("__t", width), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), kind, "n")
