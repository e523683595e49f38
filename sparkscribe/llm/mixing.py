"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, table

#: Ranges of the random key in each source; a running sum is taken within each and over their sums.
BUCKETS = 1024


def mix_targets(sources: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """Add `target` to (skey, source, source_size): the water level at which capped shares add up to all sizes.

    One row per source, so the unpartitioned windows see as many rows as there are sources.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("w", weight.cast("double")).withColumn("cap", (F.col("source_size") * cap).cast("double"))
    ranked = ranked.withColumn("ratio", F.col("cap") / F.col("w"))
    by = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing))
    every = Window.partitionBy(F.lit(0))
    level = F.max((F.sum(F.col("source_size").cast("double")).over(every) - F.col("before")) / F.col("after")).over(every)
    return ranked.withColumns({"before": before, "after": after}).withColumn("level", level).select("skey", "source_size", F.least("cap", F.col("w") * F.col("level")).alias("target"))


def mix_sources(docs: DataFrame, *, weights: Sequence[int] = (5, 2, 1), cap: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """How much of each document a mix takes: doc_id, source, size, source_size, target, taken.

    Sources by code point, null last, carry the weights in turn and share the sum of all sizes; a target stops at
    `cap` times its source's size. Within a source, documents stand in the order of a hash of id and text; the mix takes
    whole epochs, then documents in that order up to the exact budget, the one at the cut in part. taken counts
    words, repeats included, and is at most cap times the document's size.

    The key's leading digits deal each source over `buckets` ranges, so no source is sorted in one task: a running
    sum inside each range is shifted by the prefix sum of the ranges before it. Null text or no words: size 0, taken 0.
    A null source is a source of its own; a null id hashes as empty, so rows without ids are told apart by their texts; repeated rows are separate documents; an empty
    table gives no rows. Other columns are ignored.
    """
    words = F.expr(size) if size else F.coalesce(F.size(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0))), F.lit(0))
    own = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(own)).cast("binary"))
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")).alias("skey"),
        F.when(F.col(text_col).isNull(), 0).otherwise(words).cast("long").alias("size"),
        key.alias("key"),
    )
    sized = cut(sized.withColumn("range", F.expr(f"cast(cast(conv(substring(key, 1, 8), 16, 10) as bigint) * {buckets} / 4294967296 as int)")))

    ranges = sized.groupBy("skey", "range").agg(F.first("source").alias("source"), F.sum("size").alias("range_size"))
    sources = ranges.groupBy("skey").agg(F.first("source").alias("source"), F.sum("range_size").alias("source_size"))
    prior = F.coalesce(F.sum("range_size").over(Window.partitionBy("skey").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    budget = F.floor("target").cast("long")
    plan = (
        ranges.withColumn("prior", prior)
        .join(mix_targets(sources, weights, cap), "skey")
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(0))
        .select("skey", "range", "source_size", "target", "epochs", (budget - F.col("epochs") * F.col("source_size") - F.col("prior")).alias("left"))
    )
    inside = Window.partitionBy("skey", "range").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = sized.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("start")))
    return rows.join(plan, ["skey", "range"]).select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         md5('42|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS key FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
wtd AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w,
        (3 * source_size)::DOUBLE AS cap FROM src),
lev AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_,
        sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after_ FROM wtd),
tgt AS (SELECT source, source_size, least(cap, w * (SELECT max(((SELECT sum(source_size) FROM src)::DOUBLE - before_) / after_) FROM lev)) AS target FROM lev),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM tgt),
run AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_ FROM sized)
SELECT r.doc_id, r.size, b.source_size, b.target,
       (b.epochs * r.size + greatest(0, least(r.size, floor(b.target)::BIGINT - b.epochs * b.source_size - r.start_)))::BIGINT AS taken
FROM run r JOIN b ON r.source IS NOT DISTINCT FROM b.source
"""
