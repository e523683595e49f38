"""Exact cosine top-k over inverted lists of a coarse quantiser; lists that cannot hold a better row are skipped.

Each row goes to the list of its nearest centre; a list knows its rows' number and the largest angle between a row and the centre. A row of a list
is at least (angle of query and centre) - (that angle) away from the query, which bounds its score. A query first searches the nearest lists
that hold k rows; the k-th score found there is its threshold, and only lists whose bound reaches it are searched after.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkscribe.sources.staging import staged

#: Centres at most, and rows of the sample they are fitted on.
CENTRES, SAMPLE = 256, 32_768
#: Rows of a list, and queries, that one task holds.
LIST_ROWS, QUERY_ROWS = 16_384, 2_048


def _matrix(column) -> np.ndarray:
    """A list column without nulls, all of one length, as doubles."""
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors differ in length")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(sizes), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x**2).sum(1, keepdims=True))
    return x / np.where(size == 0, 1, size)


def fit_centres(sample: np.ndarray, centres: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means: unit centres of unit vectors, the same for the same sample."""
    if not len(sample):
        return np.zeros((0, 0))
    middle = sample[np.unique(np.linspace(0, len(sample) - 1, min(centres, len(sample))).astype(int))]
    for _ in range(rounds):
        near = (sample @ middle.T).argmax(1)
        total = np.zeros_like(middle)
        np.add.at(total, near, sample)
        size = np.sqrt((total**2).sum(1, keepdims=True))
        middle = np.where(size > 0, total / np.where(size > 0, size, 1), middle)
    return middle


def _drawn(rows: DataFrame, sample: int) -> tuple[np.ndarray, int]:
    """Unit vectors of at most `sample` rows, by a hash of the row's order, and the number of all rows."""
    n = rows.count()
    h = F.pmod(F.xxhash64("_order"), F.lit(1 << 30))
    some = rows.where(h <= int(min(1.0, 1.1 * sample / max(1, n)) * (1 << 30))) if n > sample else rows
    found = some.select(h.alias("h"), "_order", "_e").orderBy("h", "_order").limit(sample).toArrow()  # bounded by `sample`
    e = _unit(_matrix(found["_e"].combine_chunks())) if found.num_rows else np.zeros((0, 0))
    return e[(e != 0).any(1)] if len(e) else e, n


def pruned_top_k(index: DataFrame, queries: DataFrame, k: int, *, id_col: str = "chunk_id", order: str = "vector_row_index", exclude_self: bool = False, centres: int = CENTRES, sample: int = SAMPLE, list_rows: int = LIST_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, id, score, scored) from index(id, embedding, order) and queries(query_id, embedding): the same rows as an exhaustive
    search, and how many rows were scored for the query.

    Scores are rounded to 12 places; ties go to the smaller `order`. A zero vector scores 0 and stands in a list of its own; rows and queries
    without a vector take no part; vectors of different lengths end the run; k < 1 is refused; an empty index gives no rows. With exclude_self a row
    whose id equals the query's takes no part. The centres are fitted on `sample` rows at most (all rows are searched).
    A list of many rows, as copies make it, is dealt over blocks of about `list_rows`, queries over parts of about `query_rows`:
    the plan is the same for any number of either.
    """
    if k < 1:
        raise ValueError("k must be positive")
    spark = index.sparkSession
    rows = index.select(F.col(id_col).alias("_id"), F.col(order).cast("double").alias("_order"), F.col("embedding").alias("_e")).where("_e is not null and size(_e) > 0")
    rows = staged(rows)
    middle, _ = _drawn(rows, sample)
    middle = fit_centres(middle, min(centres, max(1, int(np.sqrt(len(middle))))))
    shared = spark.sparkContext.broadcast(middle)  # `centres` rows

    def place(batches):
        import pyarrow as pa

        c = shared.value
        for batch in batches:
            if not len(batch):
                continue
            e = _unit(_matrix(batch.column(2)))
            zero = ~(e != 0).any(1)
            if len(c) and c.shape[1] != e.shape[1]:
                raise ValueError("vectors differ in length")
            near = e @ c.T if len(c) else np.zeros((len(e), 1))
            at = np.where(zero, len(c), near.argmax(1))
            angle = np.where(zero, 0.0, np.arccos(np.clip(near.max(1), -1, 1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32()), pa.array(angle)], ["_id", "_order", "_e", "list", "angle"])

    kind = dict(rows.dtypes)
    placed = staged(rows.mapInArrow(place, f"_id {kind['_id']}, _order double, _e {kind['_e']}, list int, angle double").withColumn("salt", F.pmod(F.xxhash64("_order"), F.lit(1 << 20)).cast("int")))
    stats = {r["list"]: (r["n"], r["widest"]) for r in placed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("widest")).collect()}  # a row a list
    lists = np.array(sorted(stats), int)
    size = np.array([stats[i][0] for i in lists], int)
    widest = np.array([stats[i][1] for i in lists])
    blocks = dict(zip(lists.tolist(), (-(-size // list_rows)).tolist()))
    spread = spark.createDataFrame(list(blocks.items()), "list int, blocks int")

    asked = queries.select("query_id", F.col("embedding").alias("_q")).where("_q is not null and size(_q) > 0").withColumn("_qi", F.monotonically_increasing_id())
    asked = staged(asked)
    parts = max(1, -(-asked.count() // query_rows))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("_qi"), F.lit(parts)).cast("int"))
    facts = spark.sparkContext.broadcast((lists, size, widest))
    wanted = k + 1 if exclude_self else k

    def bounds(q: np.ndarray) -> np.ndarray:
        """Largest possible score of each query (row) in each list (column)."""
        c, (names, _, widest) = shared.value, facts.value
        if len(c) and c.shape[1] != q.shape[1]:
            raise ValueError("query and index differ in length")
        zero = names == len(c)
        near = np.zeros((len(q), len(names)))
        near[:, ~zero] = np.cos(np.maximum(np.arccos(np.clip(q @ c[names[~zero]].T, -1, 1)) - widest[~zero] - 1e-7, 0)) + 1e-9 if len(c) else 0
        near[~(q != 0).any(1)] = 0
        return near

    def plan(batches):
        """The lists each query visits: with a threshold those that reach it and were not searched before, else the nearest that hold k rows."""
        import pyarrow as pa

        names, size, _ = facts.value
        for batch in batches:
            if not len(batch):
                continue
            best = bounds(_unit(_matrix(batch.column(1))))
            by = np.argsort(-best, axis=1, kind="stable")
            before = np.cumsum(size[by], axis=1) - size[by]
            near = np.zeros(best.shape, bool)
            np.put_along_axis(near, by, before < wanted, 1)
            least = batch.column(2).to_numpy(zero_copy_only=False)
            visit = np.where(np.isnan(least)[:, None], near, ~near & (best >= least[:, None] - 1e-9))
            q, at = np.nonzero(visit)
            total = (visit * size).sum(1) + np.where(np.isnan(least), 0, (near * size).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(q)), batch.column(1).take(pa.array(q)), pa.array(names[at], pa.int32()), batch.column(3).take(pa.array(q)), pa.array(total[q], pa.int64())], ["_qi", "_q", "list", "part", "scored"])

    qkind = dict(asked.dtypes)["_q"]

    def search(key, left, right):
        import pyarrow as pa

        out = pa.schema([("_qi", pa.int64()), ("_id", left.schema.field("_id").type), ("_order", pa.float64()), ("score", pa.float64()), ("scored", pa.int64())])
        if not len(left) or not len(right):
            return out.empty_table()
        e, q = _unit(_matrix(left["_e"].combine_chunks())), _unit(_matrix(right["_q"].combine_chunks()))
        scores = np.round(e @ q.T, 12) + 0.0
        place = left["_order"].to_numpy()
        n = len(e)
        least = np.partition(scores, n - wanted, axis=0)[n - wanted] if n > wanted else np.full(len(q), -np.inf)
        query, row = np.nonzero((scores >= least).T)
        by = np.lexsort((place[row], -scores[row, query], query))
        query, row = query[by], row[by]
        first = np.arange(len(query)) - np.searchsorted(query, query) < wanted
        query, row = query[first], row[first]
        return pa.table([right["_qi"].take(pa.array(query)), left["_id"].take(pa.array(row)), pa.array(place[row]), pa.array(scores[row, query]), right["scored"].take(pa.array(query))], schema=out)

    def visited(with_threshold: DataFrame) -> DataFrame:
        pairs = staged(with_threshold.select("_qi", "_q", "least", "part").mapInArrow(plan, f"_qi long, _q {qkind}, list int, part int, scored long"))
        pairs = pairs.join(F.broadcast(spread), "list")  # a row a list
        needed = pairs.select("list", "part", "blocks").distinct()  # lists x parts at most
        left = placed.join(needed, "list").select(F.col("list").alias("_list"), F.pmod("salt", "blocks").alias("_block"), F.col("part").alias("_part"), "_id", "_order", "_e")
        right = pairs.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("list", "block", "part", "_qi", "_q", "scored")
        found = left.groupBy("_list", "_block", "_part").cogroup(right.groupBy("list", "block", "part")).applyInArrow(search, f"_qi long, _id {kind['_id']}, _order double, score double, scored long")
        if exclude_self:
            found = found.join(asked.select("_qi", "query_id"), "_qi").where(~F.col("_id").eqNullSafe(F.col("query_id"))).drop("query_id")
        by = Window.partitionBy("_qi").orderBy(F.desc("score"), "_order")
        return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)

    near = staged(visited(asked.withColumn("least", F.lit(float("nan")))))
    floor = near.groupBy("_qi").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("least"))
    # a query whose nearest lists hold only itself has no floor yet
    far = visited(asked.join(floor, "_qi", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf")))))
    by = Window.partitionBy("_qi").orderBy(F.desc("score"), "_order")
    best = near.unionByName(far).withColumns({"rank": F.row_number().over(by), "scored": F.max("scored").over(Window.partitionBy("_qi"))}).where(F.col("rank") <= k)
    return best.join(asked.select("_qi", "query_id"), "_qi").select("query_id", "rank", F.col("_id").alias(id_col), "score", "scored")
