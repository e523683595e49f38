"""The driver's tables as the engine's entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkscribe.functions.text import estimate_tokens
from sparkscribe.functions.vector import hash_embedding
from sparkscribe.operators import bandit, concepts, graph, search
from sparkscribe.sources.staging import staged
from sparkscribe.sources.store import number_rows

DIM, TOP, ROUNDS, EPSILON, SEED = 32, 10, 200, 0.2, 42
#: A lexicon of strings that occur in the test documents.
TEST_LEXICON = (("the", "concept", "The"), ("tion", "method", "Tion"), ("eau", "modality", "Eau"), ("ung", "signal", "Ung"), ("ción", "modality", "Ción"))

#: Place of a concept in a reply and the word that names it; place of a relation and the words it joins.
REPLY_CONCEPTS = ((0, 0), (1, 2), (2, 4), (3, 6), (4, 0))
REPLY_RELATIONS = ((0, 0, 2), (1, 2, 4), (2, 4, 6), (3, 0, 2))
#: Concepts and cues made of words that occur in the test documents.
TEST_PHRASES = (("the", "The"), ("le", "Le"), ("der", "Der"), ("el", "El"), ("in", "In"), ("en", "En"), ("the in", "The In"), ("ch", "Ch"), ("sch", "Sch"))
TEST_CUES = (("and", "part_of"), ("of", "is_a"), ("que", "depends_on"), ("und", "compares_with"), ("de", "used_for"), ("for", "used_for"), ("and the", "measures"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("source_name"), F.col("doc_id").alias("page_num"), F.col("text").alias("raw_text"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one chunk, linked to the next id."""
    d = table(spark, sf_dir, "documents")
    named = lambda c: F.format_string("doc_%07d", c)
    return d.select(
        named(F.col("doc_id")).alias("chunk_id"), F.col("source").alias("source_name"), F.col("doc_id").cast("int").alias("page_start"), F.col("doc_id").cast("int").alias("page_end"),
        F.col("text").alias("chunk_text"), F.length("text").alias("char_count"), estimate_tokens(F.col("text")).alias("token_estimate"), F.lit(None).cast("string").alias("prev_chunk_id"), named(F.col("doc_id") + 1).alias("next_chunk_id"), "doc_id",
    )


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concepts.extract_by_lexicon(chunks(spark, sf_dir), TEST_LEXICON)


def concept_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Concepts without lists, relations, and mention rows; texts are read and extracted once."""
    raw = staged(extracted(spark, sf_dir).select("chunk_id", "source_name", "page_start", "page_end", "concepts", "relations", "error"))
    named = staged(concepts.mentions(raw))
    return concepts.aggregate_concepts(named, lists=False), concepts.dedup_relations(concepts.relation_rows(raw, named)), concepts.mention_edges(named)


def knowledge(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    ideas, relations, mentions = concept_tables(spark, sf_dir)
    return graph.build_graph(chunks(spark, sf_dir), ideas, relations, mentions, unique=False)


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with concepts and relations parsed from a reply for each document, made of its own words: names in several cases, one
    name under two types, aliases, confidences that compete, relations that repeat in a chunk and over chunks."""
    c = chunks(spark, sf_dir).withColumn("w", F.filter(F.regexp_extract_all("chunk_text", F.lit("[A-Za-z]+"), F.lit(0)), lambda x: F.length(x) >= 2))
    word = lambda i: F.get("w", F.lit(i))
    sure = lambda n, i: F.pmod(F.col("doc_id") * 7 + i * 13 + F.length(word(n)), F.lit(50)) / 100.0 + 0.5
    kind = lambda n: F.element_at(F.array(F.lit("Method"), F.lit(" concept "), F.lit("signal")), F.length(word(n)) % 3 + 1)
    about = lambda n: F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("About "), word(n + 1)))
    concept = lambda i, n: F.struct(word(n).alias("name"), (F.lit("task") if i == 4 else kind(n)).alias("type"), F.array(F.lower(word(n)), word(n + 1), F.lit(" ")).alias("aliases"), about(n).alias("description"), sure(n, i).alias("confidence"))
    named = F.element_at(F.array(*map(F.lit, ("depends_on", "part_of", "DEPENDS_ON", "likes"))), (F.col("doc_id") % 4 + 1).cast("int"))
    relation = lambda i, n, m: F.struct(F.upper(word(n)).alias("source"), named.alias("relation"), word(m).alias("target"), F.concat_ws(" ", word(n), word(m), F.lit(str(i))).alias("evidence"), sure(n, i).alias("confidence"))
    reply = F.to_json(F.struct(F.array(*(concept(i, n) for i, n in REPLY_CONCEPTS)).alias("concepts"), F.array(*(relation(i, n, m) for i, n, m in REPLY_RELATIONS)).alias("relations")))
    return concepts.parse_replies(c.withColumn("reply", reply).drop("w"))


def reply_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Concepts, relations and mention rows of replies(), each computed once."""
    raw = staged(replies(spark, sf_dir).select("chunk_id", "source_name", "page_start", "page_end", "concepts", "relations", "error"))
    named = staged(concepts.mentions(raw))
    return concepts.aggregate_concepts(named, lists=False), concepts.dedup_relations(concepts.relation_rows(raw, named)), concepts.mention_edges(named)


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("query"))
    return number_rows(b, "item_id").select(F.col("n").cast("int").alias("query_no"), "query")


def hits(spark: SparkSession, sf_dir: str, k: int = TOP) -> DataFrame:
    """(query_id, rank, chunk_id, score): benchmark texts against documents by hash embedding."""
    index = chunks(spark, sf_dir).select("chunk_id", F.col("doc_id").alias("vector_row_index"), hash_embedding(F.col("chunk_text"), DIM).alias("embedding"))
    asked = queries(spark, sf_dir).select(F.col("query_no").alias("query_id"), hash_embedding(F.col("query"), DIM).alias("embedding"))
    return search.top_k(index, asked, k)


def arms(spark: SparkSession, sf_dir: str, prefix: int | None = bandit.FEATURE_PREFIX) -> DataFrame:
    """(query_no, query, rank, chunk_id, retrieval_score, feature, text)"""
    meta = chunks(spark, sf_dir).select("chunk_id", "chunk_text", "char_count", "token_estimate")
    joined = hits(spark, sf_dir).join(queries(spark, sf_dir).withColumnRenamed("query_no", "query_id"), "query_id").join(meta, "chunk_id")
    x = bandit.features(F.col("query"), F.col("chunk_text"), F.col("score"), F.col("rank"), F.col("char_count"), F.col("token_estimate"), prefix=prefix)
    return joined.select(F.col("query_id").alias("query_no"), "query", "rank", "chunk_id", F.col("score").alias("retrieval_score"), x.alias("feature"), F.col("chunk_text").alias("text"))


def arm_lists(spark: SparkSession, sf_dir: str, prefix: int | None = bandit.FEATURE_PREFIX) -> DataFrame:
    """One row per query: its arms, best first; TOP of them."""
    s = F.struct("rank", "chunk_id", "retrieval_score", "feature", "text")
    return arms(spark, sf_dir, prefix).groupBy("query_no", "query").agg(F.array_sort(F.collect_list(s)).alias("arms"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(bandit.replay(arm_lists(spark, sf_dir), ROUNDS, EPSILON, SEED, table(spark, sf_dir, "benchmark").count()))


def whole_text_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with features and rewards from whole texts."""
    return staged(bandit.replay(arm_lists(spark, sf_dir, None), ROUNDS, EPSILON, SEED, table(spark, sf_dir, "benchmark").count(), prefix=None))
