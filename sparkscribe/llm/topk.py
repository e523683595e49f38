"""Exact top-k inner products by a bit-sliced index."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Rows of an index block, queries of a query block, leading bits of each attribute that are sliced.
BLOCK, QUERIES, BITS = 16384, 2048, 6


def _words(bits: np.ndarray) -> np.ndarray:
    """Pack booleans (..., n) to 64-bit words."""
    packed = np.packbits(bits, axis=-1, bitorder="little")
    pad = -packed.shape[-1] % 8
    return np.ascontiguousarray(np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, pad)])).view(np.uint64)


def _digits(q: int) -> list[tuple[int, int]]:
    """Non-adjacent signed binary digits: (position, sign)."""
    out, at, n = [], 0, abs(q)
    while n:
        if n & 1:
            d = 2 - (n & 3)
            out.append((at, d if q > 0 else -d))
            n -= d
        n >>= 1
        at += 1
    return out


class BitSlicedIndex:
    """Each attribute less its minimum, cut to BITS leading bits; bit j of attribute d of all rows is one bitmap."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, bits: int = BITS):
        self.ids, self.values = ids, values
        n, self.dim = values.shape
        offset = values - values.min(0)
        self.shift = max(0, int(offset.max(initial=0)).bit_length() - bits)
        coarse = offset >> self.shift
        self.width = max(1, int(coarse.max(initial=0)).bit_length())
        rest = (offset - (coarse << self.shift)).astype(np.float64) - ((1 << self.shift) - 1) / 2
        self.spread = float(np.sqrt((rest**2).sum(1).max(initial=0)))
        self.all = _words(np.ones(n, bool))
        slices = [_words((coarse.T >> j) & 1 == 1) for j in range(self.width)]  # each dim x words
        self.slices = np.stack(slices, 1).reshape(self.dim * self.width, -1)
        self.both = np.concatenate([self.slices, ~self.slices & self.all])  # a negative digit adds the complement

    def add(self, query: np.ndarray) -> list[np.ndarray]:
        """The slices, least significant first, of a weighted sum of all attributes, up to a constant: carry-save addition."""
        levels: dict[int, list[int]] = {}
        for d, q in enumerate(query.tolist()):
            for at, sign in _digits(q):
                for j in range(self.width):
                    levels.setdefault(at + j, []).append(d * self.width + j + (len(self.slices) if sign < 0 else 0))
        out, carried, level, last = [], [], 0, max(levels, default=-1)
        while level <= last or carried:
            stack = [self.both[levels[level]]] if level in levels else []
            rows = np.concatenate(stack + carried) if stack or carried else np.zeros((0, len(self.all)), np.uint64)
            carried = []
            while len(rows) > 1:
                third = len(rows) // 3
                if third:
                    a, b, c, left = rows[:third], rows[third : 2 * third], rows[2 * third : 3 * third], rows[3 * third :]
                    half = a ^ b
                    carried.append((a & b) | (c & half))
                    rows = np.concatenate([half ^ c, left])
                else:
                    carried.append(rows[:1] & rows[1:])
                    rows = rows[:1] ^ rows[1:]
            out.append(rows[0] if len(rows) else np.zeros_like(self.all))
            level += 1
        return out

    def top(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows other than `own`, ties to the smaller id."""
        eligible = self.all.copy()
        for row in np.flatnonzero(self.ids == own):
            eligible[row >> 6] &= ~(np.uint64(1) << np.uint64(row & 63))
        if int(np.bitwise_count(eligible).sum()) > k:
            sums = self.add(query)
            value, left, within = 0, k, eligible
            for i in range(len(sums) - 1, -1, -1):  # the k-th largest coarse sum, from the most significant slice downward
                some = within & sums[i]
                n = int(np.bitwise_count(some).sum())
                if n >= left:
                    within, value = some, value | 1 << i
                else:
                    left, within = left - n, within & ~sums[i]
            step = (1 << self.shift) - 1
            slack = min(step * float(np.abs(query).sum()), 2 * self.spread * float(np.sqrt((query.astype(np.float64) ** 2).sum())))
            bound = value - int(slack * (1 + 1e-9)) // (1 << self.shift) - 1
            if bound > 0:  # rows whose coarse sum is at least the bound may still be among the best
                above, equal = np.zeros_like(eligible), eligible
                for i in range(len(sums) - 1, -1, -1):
                    if bound >> i & 1:
                        equal = equal & sums[i]
                    else:
                        above |= equal & sums[i]
                        equal = equal & ~sums[i]
                eligible = above | equal
        rows = np.flatnonzero(np.unpackbits(eligible.view(np.uint8), bitorder="little", count=len(self.ids)))
        scores = self.values[rows] @ query
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows[best]], scores[best]


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.chunk(0) if hasattr(flat, "chunk") else flat
    values = flat.values
    n = len(flat)
    start, stop = flat.offsets[0].as_py(), flat.offsets[n].as_py()
    return np.floor(256 * values.slice(start, stop - start).to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64).reshape(n, -1)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, *, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row the k rows of the largest inner product of floor(256 x).

    Rows are dealt over index blocks of about `block` and queries over blocks of about `queries`; each pair of blocks is one
    group of bounded size. A block's index gives bounds from coarse bit slices; all rows within the bound are
    scored exactly, so nothing is lost. Vectors that are null, empty, or hold null or non-finite components, and rows with a null id,
    take no part, nor do those whose whole components have a sum of squares of 2 ** 62 or more: their products could leave 64 bits, and no
    product of the others does (Cauchy-Schwarz). Vectors of another length than the query's are no candidates. Ties go to the smaller id. A query's
    own id is no candidate; repeated rows count separately as candidates, identical queries once. Fewer candidates than k give
    fewer rows; an empty table none.
    """
    ok = F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ok &= F.aggregate("v", F.lit(0.0), lambda s, x: s + F.pow(F.floor(F.lit(256.0) * x.cast("double")).cast("double"), 2)) < float(1 << 62)
    # forall is null, hence not kept, for a null vector
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where(ok).withColumn("dim", F.size("v"))
    n = rows.agg(F.count(F.lit(1)), F.count_if("q")).first()
    blocks, parts = max(1, -(-n[0] // block)), max(1, -(-n[1] // queries))
    # the position in the scan keeps rows that repeat one id apart
    base = rows.select("dim", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "id", "v")
    asked = rows.where("q").select("dim", "id", "v").distinct().select("dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), "id", "v", F.xxhash64("v").alias("copy"))

    def search(key, left, right):
        import pyarrow as pa

        out = {"query_id": [], "copy": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            index = BitSlicedIndex(left["id"].to_numpy(), _matrix(left["v"]))
            copies = right["copy"].to_pylist()
            for i, (own, query) in enumerate(zip(right["id"].to_pylist(), _matrix(right["v"]))):
                ids, scores = index.top(own, query, k)
                out["query_id"] += [own] * len(ids)
                out["copy"] += [copies[i]] * len(ids)
                out["vec_id"] += ids.tolist()
                out["score"] += scores.tolist()
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    keys = ["dim", "block", "part"]
    found = base.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(search, "query_id long, copy long, vec_id long, score long")
    order = Window.partitionBy("query_id", "copy").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: TRY_CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND list_sum(list_transform(embedding, lambda x: pow(floor(256 * x::DOUBLE), 2))) < 4611686018427387904),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
