"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word for the operators that split on ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of a batch that goes to a Python worker: bounds a worker's memory where texts are long.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> SparkSession:
    """Lower the session's limit on the bytes of an Arrow batch; a smaller one stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one only where that is unset (tests)."""
    bound_batches(spark)
    jsc = spark.sparkContext._jsc.sc()
    root = spark.conf.get("spark.checkpoint.dir", None)
    if jsc.getCheckpointDir().isEmpty():
        if not root and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(root or tempfile.mkdtemp(prefix="sparkscribe-"))
    return jsc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a narrow table with a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the corpus: it is sorted and merged, so AQE does not turn the join into a broadcast, which is built whole on the driver."""
    return df.hint("merge")


_trimmed = 0.0


def trim(least: float = 2.0) -> None:
    """Give freed memory back: workers are reused, and what one operator needed would stay with them. Walking the heap takes time, so it is
    done once in `least` seconds of a process at most."""
    import ctypes
    import time

    import pyarrow as pa

    global _trimmed
    if time.monotonic() - _trimmed < least:
        return
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
    _trimmed = time.monotonic()


def frugal(scan):
    """An Arrow batch function that gives memory back at its end."""

    def run(batches):
        try:
            yield from scan(batches)
        finally:
            trim()

    return run


def frugal_group(solve):
    """The same for a function of a key and its rows."""

    def run(key, rows):
        try:
            return solve(key, rows)
        finally:
            trim()

    return run


_written: list[str] = []


def stage_table(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: columnar, compressed, safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_remove, spark)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def drop_tables(*tables: DataFrame) -> None:
    """Delete stage_table() tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_staged", None)
        if path in _written:
            _delete(df.sparkSession, path)
            _written.remove(path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _remove(spark: SparkSession) -> None:
    try:
        for path in _written:
            _delete(spark, path)
    except Exception:  # the session may be gone at exit
        pass


def numbered(docs: DataFrame, id_col: str) -> tuple[DataFrame, Column]:
    """docs and a long in the order of the ids, null for null. Integers stand for themselves; other ids are sorted over ranges and numbered, and
    the number is a further column."""
    kind = docs.schema[id_col].dataType
    if isinstance(kind, T.IntegralType):
        return docs, F.col(id_col).cast("long")
    spark, parts = docs.sparkSession, docs.rdd.getNumPartitions()
    ids = docs.select(F.col(id_col).alias("_order_id")).where(F.col("_order_id").isNotNull()).distinct()
    ordered = ids.repartitionByRange(parts, "_order_id").sortWithinPartitions("_order_id").select("_order_id", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("i"))
    ordered = stage_table(ordered)
    sizes = {r.p: r.n for r in ordered.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each partition
    starts, at = [], 0
    for p in sorted(sizes):
        starts.append((p, at))
        at += sizes[p]
    numbers = ordered.join(F.broadcast(spark.createDataFrame(starts, "p int, start long")), "p").select("_order_id", (F.col("start") + F.col("i")).alias("_order_number"))
    return docs.join(numbers, docs[id_col] == numbers["_order_id"], "left").drop("_order_id"), F.col("_order_number")


def crc_fold(col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; null for a null id."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % mod
