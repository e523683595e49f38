"""Event-time windows over a stream: sessions of a user, with a watermark and a rule for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SESSION = "user_id BIGINT, start TIMESTAMP, end TIMESTAMP, n BIGINT, total DOUBLE"


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user_id, start, end, n, total) of events(user_id, ts, value): rows of a user closer than `gap` are one session, which ends a gap after its last row.

    In a stream, a row older than the largest time seen less `late` is dropped, and a session is given out once no such row can reach it; in a batch
    all rows count. Rows with a null time take no part; a null user is a user of its own; null values count as rows and add 0."""
    timed = events.where(F.col("ts").isNotNull()).withWatermark("ts", late)
    found = timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("value", F.lit(0.0))).alias("total"))
    return found.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def run_sessions(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, *, gap: str = "30 minutes", late: str = "2 hours", files_per_trigger: int | None = None) -> None:
    """Take in the files of `folder` that are new since the checkpoint and append the sessions that ended to `out`; each is written once,
    also when the run is started again after a failure."""
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader
    found = sessions(reader.parquet(folder).where("user_id is not null or ts is not null"), gap, late)
    query = found.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)
    query.awaitTermination()


def close_sessions(spark: SparkSession, folder: str, schema: str, last) -> None:
    """Add a marker row at the time `last` to the stream's folder: it moves the watermark on, so that a further run gives out what was open. Its own
    session, of a null user, stays open."""
    row = spark.createDataFrame([(last,)], "ts timestamp")
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    kinds = dict(c.strip().split(" ", 1) for c in schema.split(","))
    row.select(*(F.col("ts") if c == "ts" else F.lit(None).cast(kinds[c]).alias(c) for c in names)).coalesce(1).write.mode("append").parquet(folder)
