"""The window statistics as Structured Streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """A stream of the Parquet files called ``name`` in a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def tumbling(events: DataFrame, ts: str, key: str, value: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Statistics of fixed windows; readings later than ``late`` are left out, so state stays bounded."""
    w = events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key)
    return w.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("largest")).select(F.col("w.start").alias("start"), key, "n", "mean", "least", "largest")


def unfinished(events: DataFrame, ts: str, key: str, value: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """The windows that ``tumbling`` hasn't written when its stream ends, from the stream's source as a table.

    They end after the latest reading less the allowed lateness; only rows that such a window can hold are read.
    """
    mark = events.agg((F.max(ts) - F.expr(f"interval {late}")).alias("mark"))
    rows = events.withColumn("w", F.window(ts, width)).join(F.broadcast(mark), F.col("w.end") > F.col("mark")).groupBy("w", key)
    return rows.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("largest")).select(F.col("w.start").alias("start"), key, "n", "mean", "least", "largest")


def windows_before(anchors: DataFrame, readings: DataFrame, on: str, anchor_ts: str, ts: str, seconds: int, late: str = "10 minutes") -> DataFrame:
    """Anchors with each reading of their key in the ``seconds`` before them: a stream-stream interval join.

    Watermarks on both sides bound what is kept; anchors without a reading come out (with nulls) once none can follow.
    """
    a = anchors.withWatermark(anchor_ts, late).alias("a")
    r = readings.withWatermark(ts, late).alias("r")
    near = (F.col(f"r.{ts}") <= F.col(f"a.{anchor_ts}")) & (F.col(f"r.{ts}") >= F.col(f"a.{anchor_ts}") - F.expr(f"interval {seconds} seconds"))
    return a.join(r, (F.col(f"a.{on}") == F.col(f"r.{on}")) & near, "left_outer")


def drain(stream: DataFrame, path: str) -> DataFrame:
    """Run a stream over what is there into Parquet files, and read these.

    Append mode: a window is written once, when the watermark has passed its end, and its state is dropped.  So windows
    that end after the latest reading less the allowed lateness aren't there yet; they follow with later data, or from
    ``unfinished``.
    """
    writer = stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
    q = writer.option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
