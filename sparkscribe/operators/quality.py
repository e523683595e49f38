"""Additions to the engine: corpus metrics and outliers, BM25, ranking metrics, rank fusion, source roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunk_metrics(chunks: DataFrame, low: int = 600, high: int = 1800, under: int = 300, over: int = 2200) -> DataFrame:
    """Per source: chunks, mean characters, share in the preferred range, outliers."""
    n = F.col("char_count")
    return chunks.groupBy("source_name").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.avg(n).alias("avg_chars"), (F.count_if(n.between(low, high)) / F.count(F.lit(1))).alias("pct_in_range"), F.count_if((n < under) | (n > over)).alias("n_outliers")
    )


#: Pairs of a query and a term that are broadcast at most; more are joined by shuffles. Pairs of a query and a document of one task.
ASKED, PAIRS = 1_000_000, 1_000_000


def words(text: str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, *, id_col: str, text_col: str, query_id: str, query_text: str, k1: float = 1.2, b: float = 0.75, asked_bound: int = ASKED, pairs_bound: int = PAIRS) -> DataFrame:
    """(query_id, rank, id, score) for documents that share a term; idf = ln(1 + (n - df + 0.5) / (df + 0.5)). Ids are unique.

    Documents are read once and cut to the queries' terms, then one shuffle by document holds all postings. Where the queries' terms
    are few enough to broadcast, scores are summed in place and each task keeps its k best of a query, so no pair is shuffled. Documents
    are dealt over as many tasks as it takes for each to hold `pairs_bound` pairs at most, however many documents and queries there are.
    An empty term in every document counts documents and words, also of those without a term of a query.
    """
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(words(query_text))).alias("term"))
    sizes = asked.agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("query_id").alias("queries")).first()
    small = F.broadcast if sizes.pairs <= asked_bound else lambda df: df
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-docs.count() * sizes.queries // pairs_bound))
    wanted = asked.select("term").unionByName(docs.sparkSession.createDataFrame([("",)], "term string")).distinct()
    listed = docs.select(F.col(id_col).alias("id"), words(text_col).alias("w"))
    found = listed.select("id", F.size("w").alias("dl"), F.explode(F.array_append("w", F.lit(""))).alias("term")).join(small(wanted), "term", "left_semi")
    posting = found.repartition(parts, "id").groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    counts = posting.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("n"), (F.sum(F.col("dl") * F.col("tf")) / F.sum("tf")).alias("avgdl"))
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    every = lambda c: F.max(F.when(F.col("term") == "", F.col(c))).alias(c)  # noqa: E731, a filter would be pushed to a scan of its own
    totals = counts.agg(every("n"), every("avgdl"))  # one row
    terms = asked.join(counts.select("term", "df"), "term").crossJoin(F.broadcast(totals)).select("query_id", "term", idf.alias("idf"), "avgdl")
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    pairs = posting.join(small(terms), "term").groupBy("query_id", "id").agg(F.sum(weight).alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return pairs.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def ranking_metrics(hits: DataFrame, k: int) -> DataFrame:
    """One row from (query_id, rank, relevant, total_relevant): precision, recall and mean reciprocal rank at k."""
    per = hits.where(F.col("rank") <= k).groupBy("query_id").agg(F.count_if("relevant").alias("found"), F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"), F.max("total_relevant").alias("total"))
    return per.agg(F.lit(k).alias("k"), F.avg(F.col("found") / k).alias("precision"), F.avg(F.col("found") / F.greatest(F.lit(1), "total")).alias("recall"), F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"))


def fuse(a: DataFrame, b: DataFrame, k: int = 10, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two rankings (query_id, id, rank)."""
    both = a.select("query_id", "id", "rank").unionByName(b.select("query_id", "id", "rank"))
    scored = both.groupBy("query_id", "id").agg(F.sum(1.0 / (constant + F.col("rank"))).alias("rrf"))
    by = Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf", 12)), "id")
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def source_rollup(hits: DataFrame, sources: DataFrame) -> DataFrame:
    """(query_id, source, best, total) of hits (query_id, id, score) by the source of their ids."""
    return hits.join(sources, "id").groupBy("query_id", "source").agg(F.max("score").alias("best"), F.sum("score").alias("total"))


def _edges(pages: DataFrame, depth: int) -> DataFrame:
    """(source_name, page_num, place, line): the first and the last `depth` lines of a page that are not blank, trimmed; place counts all lines from 0."""
    lines = F.transform(F.split(F.coalesce("raw_text", F.lit("")), "\n"), lambda x, i: F.struct(i.alias("place"), F.trim(x).alias("line")))
    full = F.filter(lines, lambda x: x["line"] != "")
    ends = F.array_distinct(F.concat(F.slice("full", 1, depth), F.slice("full", F.greatest(F.lit(1), F.size("full") - depth + 1), depth)))
    return pages.select("source_name", "page_num", full.alias("full")).select("source_name", "page_num", F.inline(ends))


def edge_lines(pages: DataFrame, least: int = 3, depth: int = 1) -> DataFrame:
    """(source_name, line, n_pages): first or last lines that stand on `least` or more pages of a source: running headers and footers.

    Two passes. The first counts hashes only, with partial counts in each task; the second counts the texts of the lines whose hash is frequent, so a
    shared hash cannot make a line frequent. A line counts once a page. A null source is a source of its own; null texts have no lines."""
    ends = _edges(pages, depth).select("source_name", "page_num", "line").distinct()
    ends = ends.withColumn("h", F.xxhash64("source_name", "line"))
    often = ends.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("h")
    exact = ends.join(often, "h", "left_semi").groupBy("source_name", "line").agg(F.count(F.lit(1)).alias("n_pages"))
    return exact.where(F.col("n_pages") >= least)


def page_flags(pages: DataFrame, least: int = 3, depth: int = 1) -> DataFrame:
    """(source_name, page_num, body, removed, symbol_ratio, numeric_only) of pages whose (source_name, page_num) is unique: the text without its running
    headers and footers (edge_lines), how many lines went, the share of characters of the rest that are neither letters, digits nor white space, and
    whether it has digits but no letter. Null and empty texts: empty body, ratio 0, false. Pages of a null source are handled like any other."""
    marked = _edges(pages, depth).withColumn("h", F.xxhash64("source_name", "line"))
    often = edge_lines(pages, least, depth).select(F.col("source_name").alias("_s"), F.col("line").alias("_l"))
    gone = marked.join(often, F.col("source_name").eqNullSafe(F.col("_s")) & (F.col("line") == F.col("_l")), "left_semi")
    gone = gone.groupBy(F.col("source_name").alias("_s"), F.col("page_num").alias("_p")).agg(F.collect_set("place").alias("gone"))  # 2 * depth at most
    joined = pages.join(gone, F.col("source_name").eqNullSafe(F.col("_s")) & (F.col("page_num") == F.col("_p")), "left")
    lines = F.split(F.coalesce("raw_text", F.lit("")), "\n")
    kept = F.filter(lines, lambda x, i: F.col("gone").isNull() | ~F.array_contains("gone", i))
    body = joined.withColumns({"body": F.array_join(kept, "\n"), "removed": F.size("gone")})
    marks = F.length(F.regexp_replace("body", r"[\p{L}\p{N}\s]+", ""))
    ratio = F.when(F.length("body") > 0, marks / F.length("body")).otherwise(0.0)
    return body.select("source_name", "page_num", "body", F.when(F.col("gone").isNull(), 0).otherwise(F.col("removed")).alias("removed"), ratio.alias("symbol_ratio"), (F.col("body").rlike(r"\p{N}") & ~F.col("body").rlike(r"\p{L}")).alias("numeric_only"))


def corpus_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(level, source, lang, toxic, n_docs, chars, longest): one pass over documents with their labels, aggregated by every subset of source,
    language and label. level tells the subset as Spark's grouping_id does: a bit is 1 where its column was summed over; a null in a column
    of the subset is the value null. labels has one row a doc_id at most."""
    rows = docs.join(labels.select("doc_id", "toxic"), "doc_id", "left").select("source", "lang", "toxic", F.length("text").alias("size"))
    sizes = F.coalesce(F.col("size"), F.lit(0)).cast("long")
    return rows.cube("source", "lang", "toxic").agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n_docs"), F.sum(sizes).alias("chars"), F.max(sizes).alias("longest")).select("level", "source", "lang", "toxic", "n_docs", "chars", "longest")
