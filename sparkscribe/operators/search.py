"""Exact cosine top-k over an index, for one query or many, and what is joined to the hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkscribe.functions.text import preview
from sparkscribe.operators.pruned import pruned_top_k

#: Queries that are broadcast at most; scores that a task holds at once.
QUERY_BLOCK, SCORES = 4096, 1 << 20


def top_k(index: DataFrame, queries: DataFrame, k: int, *, id_col: str = "chunk_id", order: str = "vector_row_index", exclude_self: bool = False) -> DataFrame:
    """(query_id, rank, id, score) from index(id, embedding, order) and queries(query_id, embedding).

    Up to QUERY_BLOCK queries, their number being checked first, are broadcast as a matrix; each Arrow batch of the index is multiplied with
    it, SCORES scores at a time, and each task keeps its k best of a query before the shuffle. More queries go through pruned_top_k(), whose plan does not grow
    with their number. Scores are rounded to 12 places, so equal vectors tie; ties go to the smaller `order`. A zero vector
    scores 0; rows and queries without a vector take no part; another length than the query's ends the run; k < 1 is refused.
    """
    if k < 1:
        raise ValueError("k must be positive")
    if queries.limit(QUERY_BLOCK + 1).count() > QUERY_BLOCK:
        return pruned_top_k(index, queries, k, id_col=id_col, order=order, exclude_self=exclude_self).drop("scored")
    rows = index.select(F.col(id_col).alias("_id"), F.col(order).cast("double").alias("_order"), F.col("embedding").cast("array<double>").alias("_e"))
    asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("_q")).where("_q is not null")
    kinds = dict(rows.dtypes)["_id"], dict(asked.dtypes)["query_id"]
    held = asked.collect()  # QUERY_BLOCK rows at most
    found = rows.mapInArrow(_scan(asked.sparkSession, [r["_q"] for r in held], k + 1 if exclude_self else k), f"_qi int, _id {kinds[0]}, _order double, score double")
    names = asked.sparkSession.createDataFrame([(n, r["query_id"]) for n, r in enumerate(held)], f"_qi int, query_id {kinds[1]}")
    named = found.join(F.broadcast(names), "_qi")  # a block of queries
    if exclude_self:
        named = named.where(F.col("_id") != F.col("query_id"))
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("_qi").orderBy(F.desc("score"), "_order"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("_id").alias(id_col), "score")


def _scan(spark: SparkSession, vectors: list[list[float]], k: int):
    import numpy as np

    if len({len(v) for v in vectors}) > 1:
        raise ValueError("queries differ in length")
    matrix = np.array(vectors, float).reshape(len(vectors), -1)
    size = np.sqrt((matrix**2).sum(1, keepdims=True))
    shared = spark.sparkContext.broadcast((matrix / np.where(size == 0, 1, size)).T)

    def scan(batches):
        import pyarrow as pa

        q = shared.value
        ids, held = None, (np.empty(0, np.int64), np.empty(0), np.empty(0))  # query, order, score of the best so far; their ids beside
        floor, step = np.full(q.shape[1], -np.inf), max(1, SCORES // max(1, q.shape[1]))  # floor: the k-th score so far
        for batch in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
            if batch.column(2).null_count:
                batch = batch.filter(batch.column(2).is_valid())
            lists = batch.column(2)
            n = len(lists)
            if not n or not q.shape[1]:
                continue
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            if len(flat) != n * q.shape[0] or (np.diff(lists.offsets.to_numpy()) != q.shape[0]).any():
                raise ValueError("query and index differ in length")
            e = flat.reshape(n, -1)
            size = np.sqrt((e**2).sum(1, keepdims=True))
            scores = np.round((e / np.where(size == 0, 1, size)) @ q, 12) + 0.0
            least = np.partition(scores, n - k, axis=0)[n - k] if n > k else np.full(q.shape[1], -np.inf)
            row, query = np.nonzero(scores >= np.maximum(least, floor))
            if not len(row):
                continue
            mine = (query, batch.column(1).to_numpy()[row], scores[row, query])
            new = batch.column(0).take(pa.array(row))
            all_ids = pa.concat_arrays([ids, new]) if ids is not None else new
            every = [np.concatenate(x) for x in zip(held, mine)]
            by = np.lexsort((every[1], -every[2], every[0]))
            start = np.searchsorted(every[0][by], every[0][by])
            by = by[np.arange(len(by)) - start < k]
            held, ids = tuple(x[by] for x in every), all_ids.take(pa.array(by))
            n_held = np.bincount(held[0], minlength=len(floor))
            full = n_held >= k
            floor[full] = held[2][np.cumsum(n_held)[full] - 1]
        if ids is not None:
            yield pa.RecordBatch.from_arrays([pa.array(held[0], pa.int32()), ids, pa.array(held[1]), pa.array(held[2])], ["_qi", "_id", "_order", "score"])

    return scan


def with_metadata(hits: DataFrame, store: DataFrame, *, id_col: str = "chunk_id", strict: bool = False) -> DataFrame:
    """Hits with their stored columns and a preview; a hit without a stored row stays, or with `strict` ends the run."""
    meta = store.withColumn("chunk_preview", preview(F.col("chunk_text"))).drop("chunk_text").withColumn("_known", F.lit(True))
    joined = hits.join(meta, id_col, "left")
    if strict:
        joined = joined.withColumn("rank", F.when(F.col("_known"), F.col("rank")).otherwise(F.raise_error(F.concat(F.lit("no metadata for "), F.col(id_col).cast("string"))).cast("int")))
    return joined.drop("_known")
