"""A versioned Parquet store for chunk embeddings: snapshot, change detection, upsert, index, bridge tables, manifests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkscribe.functions.text import content_hash
from sparkscribe.functions.vector import hash_embedding, norm
from sparkscribe.sources import schemas
from sparkscribe.sources.files import assert_unique

_TABLE = [x.strip().split(" ")[0] for x in schemas.EMBEDDING.replace("ARRAY<FLOAT>", "A").split(",")]


def embedder(backend: str, dim: int = 384, model: Callable[[list[str]], list[list[float]]] | None = None) -> Callable[[Column], Column]:
    """A column function by backend name: 'hash' is native; 'model' wraps a local or remote encoder in a Pandas function."""
    if backend == "hash":
        return lambda text: hash_embedding(text, dim)
    if backend == "model" and model:

        @F.pandas_udf("array<float>")
        def encode(texts):
            import numpy as np
            import pandas as pd

            rows = np.asarray(model(texts.tolist()), dtype=np.float32)
            size = np.linalg.norm(rows, axis=1, keepdims=True)
            return pd.Series(list(rows / np.where(size == 0, 1, size)))

        return encode
    raise ValueError(f"unknown embedding backend {backend!r}")


def detect_changes(chunks: DataFrame, existing: DataFrame, model: str, dim: int, force: bool = False) -> DataFrame:
    """chunks with content_hash and status: unchanged, changed or new. Unchanged: same hash, model and dimension."""
    old = existing.select("chunk_id", F.col("content_hash").alias("_hash"), F.col("embedding_model").alias("_model"), F.col("embedding_dim").alias("_dim"))
    same = (F.col("_hash") == F.col("content_hash")) & (F.col("_model") == model) & (F.col("_dim") == dim) & F.lit(not force)
    joined = chunks.withColumn("content_hash", content_hash(F.col("chunk_text"))).join(old, "chunk_id", "left")
    return joined.withColumn("status", F.when(same, "unchanged").when(F.col("_hash").isNotNull(), "changed").otherwise("new")).drop("_hash", "_model", "_dim")


def embed(changes: DataFrame, encode: Callable[[Column], Column], model: str, dim: int, now: Column) -> DataFrame:
    """Store rows of what is new or changed; a vector of another length ends the run."""
    vector = encode(F.col("chunk_text"))
    checked = F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(F.raise_error("embedding of unexpected length").cast("array<float>"))
    rows = changes.where("status <> 'unchanged'").drop("status").withColumns({"embedding": vector, "embedding_model": F.lit(model), "embedding_dim": F.lit(dim), "updated_at": now})
    return rows.withColumn("embedding", checked).select(*_TABLE)


def upsert(existing: DataFrame, rows: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows replace those of the same key."""
    return existing.join(rows.select(key), key, "left_anti").unionByName(rows)


class Store:
    """Versions under one folder; the current one is the largest whose write was completed. No version is written while it is read, and a write
    that fails leaves the one before in place."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _versions(self) -> list[int]:
        """Completed versions, ascending: those with the marker that a finished write leaves last."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        root = hadoop.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(root)]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(hadoop.Path(f"{self.path}/{n}/_SUCCESS")))

    def version(self) -> int:
        return max(self._versions(), default=0)

    def read(self) -> DataFrame:
        v = self.version()
        return self.spark.read.parquet(f"{self.path}/v{v}") if v else self.spark.createDataFrame([], schemas.EMBEDDING)

    def write(self, df: DataFrame) -> int:
        v = self.version() + 1
        df.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{self.path}/v{v}")  # no one reads an incomplete version
        return v

    def remove_old(self, keep: int = 2) -> int:
        """Delete all but the last `keep` versions; returns how many went. Readers of older ones must be done."""
        hadoop, old = self.spark._jvm.org.apache.hadoop.fs, self._versions()[: -max(1, keep)]
        for v in old:
            p = hadoop.Path(f"{self.path}/v{v}")
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        return len(old)

    def refresh(self, chunks: DataFrame, *, backend: str = "hash", model: str = "hash-v1", dim: int = 384, force: bool = False, encode: Callable | None = None, metadata: bool = False) -> dict:
        """One incremental run: only new and changed chunks are encoded. metadata: also take page ranges and counts of unchanged ones.
        Returns the manifest. Repeated chunk ids are refused."""
        assert_unique(chunks, "chunk_id")
        changes, old = detect_changes(chunks, self.read(), model, dim, force), self.read()
        rows = embed(changes, encode or embedder(backend, dim), model, dim, F.date_trunc("second", F.current_timestamp()))
        if metadata:
            kept = old.drop("source_name", "page_start", "page_end", "char_count", "token_estimate").join(changes.where("status = 'unchanged'").select("chunk_id", "source_name", "page_start", "page_end", "char_count", "token_estimate"), "chunk_id")
            rows = rows.unionByName(kept.select(*_TABLE))
        counts = {r.status: r["count"] for r in changes.groupBy("status").count().collect()}
        self.write(upsert(old, rows))
        return manifest(sum(counts.values()), counts, backend, model, dim)


def manifest(total: int, counts: dict[str, int], backend: str, model: str, dim: int) -> dict:
    return {"chunks_total": total, "skipped": counts.get("unchanged", 0), "recomputed": counts.get("new", 0) + counts.get("changed", 0), "backend": backend, "embedding_model": model, "embedding_dim": dim}


def build_index(chunks: DataFrame, store: DataFrame, model: str, dim: int, order: str = "chunk_no") -> DataFrame:
    """(vector_row_index, chunk_id, embedding, vector_norm) in the order of the chunks; a chunk without a fitting stored row ends the run.

    Row numbers come from counts of range partitions, so no task sees all rows.
    """
    rows = chunks.select("chunk_id", order).join(store.select("chunk_id", "embedding", "embedding_model", "embedding_dim"), "chunk_id", "left")
    fits = (F.col("embedding_model") == model) & (F.col("embedding_dim") == dim) & (F.size("embedding") == dim)
    checked = rows.withColumn("embedding", F.when(fits, F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit("no fitting embedding for "), "chunk_id")).cast("array<float>")))
    return number_rows(checked, order).select(F.col("n").alias("vector_row_index"), "chunk_id", "embedding", norm(F.col("embedding")).alias("vector_norm"))


def number_rows(df: DataFrame, *order: str, ranges: int = 64) -> DataFrame:
    """Add n, from 0 in the given order: the position inside a value range plus the rows of the ranges before it."""
    first = order[0]
    if dict(df.dtypes)[first] not in ("int", "bigint", "smallint", "tinyint", "double", "float"):
        raise ValueError("rows are numbered by a numeric column")
    # cut points are quantiles, so ranges hold like numbers of rows however the values lie; any cut points give the same numbers
    edges = sorted(set(df.approxQuantile(first, [i / ranges for i in range(1, ranges)], 0.2 / ranges))) if ranges > 1 else []
    ranged = df.withColumn("_range", _range(F.col(first), edges))
    before = ranged.groupBy("_range").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranged.withColumn("_in", inside).join(F.broadcast(before), "_range").withColumn("n", F.col("_before") + F.col("_in")).drop("_range", "_in", "_before")  # `ranges` rows


def _range(value: Column, edges: list[float]) -> Column:
    """How many edges are at or below the value, by bisection."""
    if not edges:
        return F.lit(0)
    mid = len(edges) // 2
    low, high = _range(value, edges[:mid]), _range(value, edges[mid + 1 :])
    return F.when(value < F.lit(edges[mid]), low).otherwise(high + F.lit(mid + 1))


def index_map(index: DataFrame, model: str, dim: int, name: str, now: Column) -> DataFrame:
    return index.select("vector_row_index", "chunk_id", F.lit(model).alias("embedding_model"), F.lit(dim).alias("embedding_dim"), F.lit(name).alias("index_name"), now.alias("indexed_at"))


def chunk_concept_map(concepts: DataFrame) -> DataFrame:
    return concepts.select(F.explode("mention_chunk_ids").alias("chunk_id"), "concept_id").distinct()
