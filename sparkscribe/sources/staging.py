"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


#: Bytes of a batch that goes to a Python worker: bounds a worker's memory where rows are long.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's limit on the bytes of an Arrow batch; a smaller one stays."""
    if int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local folder only where that is unset and the master is local (tests)."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(root or tempfile.mkdtemp(prefix="sparkscribe-"))
    return jsc.getCheckpointDir().get()


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there is deleted at exit."""
    path = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clear)
    _written.append((spark, path))
    return path


def staged(df: DataFrame, path: str | None = None) -> DataFrame:
    """df, written once as Parquet (to `path`, else to a new one) and read back: what is used several times is computed once and outlives executors. Deleted at exit."""
    path = path or scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a staged table that nothing reads any more: all that was made from it has been written or checkpointed."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clear() -> None:
    for spark, path in _written:
        try:
            discard(spark, path)
        except Exception:  # the session may be gone at exit
            return
