"""Online training of the bandit model from a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkscribe.operators.bandit import LinUCB, gram, moments
from sparkscribe.sources import schemas

STATE = "batch_id BIGINT, " + schemas.LINUCB


def load_state(spark: SparkSession, path: str) -> tuple[int, LinUCB | None]:
    """The last batch taken in and its model; (-1, None) before the first."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return -1, None
    row = spark.read.schema(STATE).json(path).orderBy(F.desc("batch_id")).first()
    return (row["batch_id"], LinUCB(row["dim"], row["alpha"], row["l2_lambda"], row["A"], row["b"])) if row else (-1, None)


def train_stream(events: DataFrame, state_path: str, checkpoint: str, *, alpha: float = 1.0, l2: float = 1.0, dim: int = 5):
    """Start training on a stream of events. Each micro-batch adds its sums to the stored model.

    The state holds the batch's number: a batch that is replayed after a failure has been taken in already and is passed over, and
    the stream's checkpoint keeps a second run from counting the log twice. One small file per batch.
    """

    def take(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last, model = load_state(spark, state_path)
        if batch_id <= last:
            return
        model = model or LinUCB(dim, alpha, l2)
        a, b, n = gram(moments(batch.select(F.col("chosen_arm.feature").alias("x"), F.col("reward").alias("r")), dim=dim).first(), dim)
        if n or last < 0:
            new = LinUCB(dim, model.alpha, model.l2, model.A + a, model.b + b)
            spark.createDataFrame([(batch_id, *new.to_row())], STATE).coalesce(1).write.mode("append").json(state_path)

    return events.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schemas.EVENT)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).json(folder)
