"""The registered queries: one per operator or group of operators, flat results, doubles rounded to 6 places."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkscribe.functions import text as tx
from sparkscribe.functions.vector import hash_embedding, l2_normalize
from sparkscribe.operators import bandit, chunking, concepts, graph, patterns, quality, ranking, search, sketches
from sparkscribe.operators.asof import as_of
from sparkscribe.operators.pruned import pruned_top_k
from sparkscribe.operators.tfidf import tfidf_top_k
from sparkscribe.plans import inputs as on
from sparkscribe.sources import files, schemas, store
from sparkscribe.sources.staging import scratch
from sparkscribe.streaming import policies, windows

QUERIES: dict = {}
#: Reward weights of the estimator queries that compare with SQL.
WEIGHTS = (0.1, 0.2, 0.05, 0.05, 0.5)


def query(f):
    QUERIES[f.__name__] = f
    return f


def r6(c, name: str):
    return F.round(c, 6).alias(name)


@query
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = on.table(spark, sf_dir, "embeddings")
    hits = search.top_k(e, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10, id_col="vec_id", order="vec_id")
    return hits.select(F.col("query_id").alias("qid"), F.col("rank").alias("rk"), F.col("vec_id").alias("vid"), r6("score", "score"))


@query
def vector_topk_metadata(spark, sf_dir):
    e = on.table(spark, sf_dir, "embeddings")
    hits = search.top_k(e, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 5, id_col="vec_id", order="vec_id")
    meta = e.select("vec_id", "label").join(on.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("chunk_text")), "vec_id")
    return search.with_metadata(hits, meta, id_col="vec_id").select(F.col("query_id").alias("qid"), F.col("rank").alias("rk"), F.col("vec_id").alias("vid"), "label", F.col("chunk_preview").alias("preview"))


@query
def l2_normalized(spark, sf_dir):
    e = on.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(l2_normalize(F.transform("embedding", lambda x: x.cast("double") * 3))).alias("pos", "v"))
    return e.select("vec_id", "pos", r6("v", "value"))


@query
def hash_embeddings(spark, sf_dir):
    b = on.table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(hash_embedding(F.col("text"), 32)).alias("pos", "v"))
    return b.select("item_id", "pos", F.round(F.col("v").cast("double"), 6).alias("value"))


@query
def content_hashes(spark, sf_dir):
    return on.table(spark, sf_dir, "documents").select("doc_id", tx.content_hash(F.col("text")).alias("hash"))


@query
def slug_ids(spark, sf_dir):
    d = on.table(spark, sf_dir, "documents")
    return d.select("doc_id", tx.concept_id(F.col("text"), F.concat_ws(" ", "source", "lang")).alias("concept_id"))


@query
def token_sets(spark, sf_dir):
    return on.table(spark, sf_dir, "documents").select("doc_id", tx.tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("n_tokens"), F.sha2(F.array_join(F.array_sort("t"), " "), 256).alias("tokens_sha"))


@query
def json_recovery(spark, sf_dir):
    e = on.table(spark, sf_dir, "events").withColumn("reply", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Here: "), "props", F.lit(" done."))).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise("no object"))
    return e.select("event_id", tx.recover_json(F.col("reply"), "k BIGINT")["k"].alias("k"))


@query
def clean_pages(spark, sf_dir):
    return chunking.clean_pages(on.pages(spark, sf_dir), 5).select("page_num", "clean_text", "char_count")


@query
def page_filter(spark, sf_dir):
    cleaned = chunking.clean_pages(on.pages(spark, sf_dir), 0)
    kept = chunking.kept_pages(cleaned).select("page_num", F.lit(True).alias("keep"))
    return cleaned.join(kept, "page_num", "left").select("page_num", F.coalesce("keep", F.lit(False)).alias("keep"), tx.is_title(F.col("clean_text")).alias("is_title"))


def _paragraph_pages(spark, sf_dir):
    """Documents with each line as a paragraph of its own."""
    return chunking.clean_pages(on.pages(spark, sf_dir).withColumn("raw_text", F.replace("raw_text", F.lit("\n"), F.lit("\n\n"))), 0)


@query
def paragraphs(spark, sf_dir):
    p = chunking.page_paragraphs(_paragraph_pages(spark, sf_dir))
    return p.select("page_num", "para_no", F.length("para").alias("size"), tx.estimate_tokens(F.col("para")).alias("tokens"))


def _chunks(spark, sf_dir):
    return chunking.build_chunks(chunking.kept_pages(_paragraph_pages(spark, sf_dir)))


@query
def chunks(spark, sf_dir):
    return _chunks(spark, sf_dir).select("source_name", "chunk_id", "page_start", "page_end", "char_count", "token_estimate", F.sha2("chunk_text", 256).alias("text_sha"))


@query
def chunks_repeated_pages(spark, sf_dir):
    """Sources whose page numbers repeat or are missing, and a source without a name."""
    pages = on.pages(spark, sf_dir).withColumns({"page_num": F.when(F.col("page_num") % 9 != 0, F.col("page_num") % 50), "source_name": F.when(F.col("page_num") % 5 != 0, F.col("source_name"))})
    pages = pages.withColumn("raw_text", F.replace("raw_text", F.lit("\n"), F.lit("\n\n")))
    chunks = chunking.build_chunks(chunking.kept_pages(chunking.clean_pages(pages, 0)))
    return chunks.select("source_name", "chunk_id", "page_start", "page_end", "next_chunk_id", F.sha2("chunk_text", 256).alias("text_sha"))


@query
def chunk_links(spark, sf_dir):
    return _chunks(spark, sf_dir).select("source_name", "chunk_id", "prev_chunk_id", "next_chunk_id")


def _versions(spark, sf_dir):
    """The store as of a first run over most documents, and the chunks of a second run with some texts edited."""
    c = on.chunks(spark, sf_dir)
    first = c.where("doc_id % 7 <> 0").select("chunk_id", tx.content_hash(F.col("chunk_text")).alias("content_hash"), F.lit("hash-v1").alias("embedding_model"), F.lit(384).alias("embedding_dim"), F.lit(1).alias("version"))
    second = c.where("doc_id % 13 <> 0").withColumn("chunk_text", F.when(F.col("doc_id") % 11 == 0, F.concat("chunk_text", F.lit(" edited"))).when(F.col("doc_id") % 5 == 0, F.concat(F.lit("  "), F.replace("chunk_text", F.lit(" "), F.lit("   ")))).otherwise(F.col("chunk_text")))
    return first, second


@query
def change_detection(spark, sf_dir):
    first, second = _versions(spark, sf_dir)
    return store.detect_changes(second, first, "hash-v1", 384).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query
def upsert_result(spark, sf_dir):
    first, second = _versions(spark, sf_dir)
    rows = store.detect_changes(second, first, "hash-v1", 384).where("status <> 'unchanged'").select("chunk_id", "content_hash", F.lit("hash-v1").alias("embedding_model"), F.lit(384).alias("embedding_dim"), F.lit(2).alias("version"))
    return store.upsert(first, rows).select("chunk_id", "content_hash", "version")


@query
def index_map(spark, sf_dir):
    e = on.table(spark, sf_dir, "embeddings")
    return store.number_rows(e.select("vec_id"), "vec_id").select(F.col("n").cast("long").alias("row_index"), "vec_id")


def _index(spark, sf_dir):
    """The index over a store that holds all documents."""
    c = on.chunks(spark, sf_dir)
    nothing = spark.createDataFrame([], schemas.EMBEDDING)
    rows = store.embed(store.detect_changes(c, nothing, "hash-v1", on.DIM), store.embedder("hash", on.DIM), "hash-v1", on.DIM, F.current_timestamp())
    return store.build_index(c.withColumn("chunk_no", F.col("doc_id")), rows, "hash-v1", on.DIM)


@query
def index_build(spark, sf_dir):
    return _index(spark, sf_dir).select(F.col("vector_row_index").cast("long").alias("row_index"), "chunk_id", r6("vector_norm", "vector_norm"))


@query
def index_map_rows(spark, sf_dir):
    rows = store.index_map(_index(spark, sf_dir), "hash-v1", on.DIM, "main", F.current_timestamp())
    return rows.select(F.col("vector_row_index").cast("long").alias("row_index"), "chunk_id", "embedding_model", "embedding_dim", "index_name")


@query
def vector_manifest(spark, sf_dir):
    first, second = _versions(spark, sf_dir)
    n = {r.status: r["count"] for r in store.detect_changes(second, first, "hash-v1", 384).groupBy("status").count().collect()}
    m = store.manifest(sum(n.values()), n, "hash", "hash-v1", 384)
    return spark.createDataFrame([(m["chunks_total"], m["skipped"], m["recomputed"], m["embedding_model"])], "chunks_total long, skipped long, recomputed long, embedding_model string")


@query
def graph_manifest(spark, sf_dir):
    raw = on.extracted(spark, sf_dir)
    ideas, relations, _ = on.concept_tables(spark, sf_dir)
    return concepts.graph_manifest(concepts.extraction_log(raw, F.current_timestamp()), ideas, relations).drop("llm_model")


@query
def linked_count(spark, sf_dir):
    index = _index(spark, sf_dir)
    return graph.linked_count(graph.bind_index(on.chunks(spark, sf_dir), index, "main", "hash-v1", on.DIM, F.current_timestamp())["edges"], "main")


@query
def concept_mentions(spark, sf_dir):
    m = concepts.mentions(on.extracted(spark, sf_dir))
    return m.select("chunk_id", "concept_id", "name", "type", F.array_join("aliases", ";").alias("aliases"), "description", "confidence")


@query
def concept_aggregate(spark, sf_dir):
    ideas = on.concept_tables(spark, sf_dir)[0]
    return ideas.select("concept_id", "name", "type", F.array_join("aliases", ";").alias("aliases"), "description", "max_confidence", F.col("n_mentions").cast("int").alias("n_mentions"), "first_chunk")


@query
def relation_dedup(spark, sf_dir):
    relations = on.concept_tables(spark, sf_dir)[1]
    return relations.select("relation_id", "source_concept_id", "relation", "target_concept_id", "confidence", "evidence", "chunk_id")


@query
def chunk_concept_map(spark, sf_dir):
    return on.concept_tables(spark, sf_dir)[2]


@query
def extraction_log(spark, sf_dir):
    c = on.chunks(spark, sf_dir)
    good = F.concat(F.lit('{"concepts":[{"name":"'), "source_name", F.lit('","type":"Method","confidence":0.9},{"name":" Goal ","type":"odd","confidence":0.7},{"name":"low","confidence":0.1}],"relations":[{"source":"goal","relation":"USED_FOR","target":"'), "source_name", F.lit('","confidence":0.8},{"source":"goal","relation":"likes","target":"low","confidence":0.8}]}'))
    reply = F.when(F.col("doc_id") % 10 == 3, "{broken").when(F.col("doc_id") % 10 == 5, '{"concepts":[{"name":"a","confidence":"high"}]}').when(F.col("doc_id") % 10 == 6, F.concat(F.lit("Sure! "), good, F.lit(" Bye.")))
    reply = reply.when(F.col("doc_id") % 10 == 7, '{"concepts":"oops"}').when(F.col("doc_id") % 10 == 8, '{"concepts":[1]}').when(F.col("doc_id") % 10 == 9, '["a"]').otherwise(good)
    log = concepts.extraction_log(concepts.parse_replies(c.withColumn("reply", reply)), F.lit("2024-01-01"))
    return log.groupBy("status", "error").agg(F.count(F.lit(1)).alias("n"), F.sum("concept_count").alias("concepts"), F.sum("relation_count").alias("relations"))


@query
def graph_stats(spark, sf_dir):
    return graph.statistics(on.knowledge(spark, sf_dir))


@query
def graph_expand(spark, sf_dir):
    return graph.expand(on.chunks(spark, sf_dir).select("chunk_id"), on.knowledge(spark, sf_dir), 8).select("chunk_id", "edge_no", "source_concept_id", "source_name", "relation", "target_concept_id", "target_name", "confidence")


@query
def index_binding(spark, sf_dir):
    c = on.chunks(spark, sf_dir)
    rows = store.number_rows(c.select("chunk_id", "doc_id"), "doc_id").select("chunk_id", F.col("n").alias("vector_row_index"))
    bound = graph.bind_index(c, rows, "main", "hash-v1", 384, F.lit("2024-01-01"))
    return bound["chunks"].select("chunk_id", "index_name", F.col("vector_row_index").cast("long").alias("row_index"), "embedding_dim")


@query
def hybrid_retrieve(spark, sf_dir):
    found = search.with_metadata(on.hits(spark, sf_dir, 5), on.chunks(spark, sf_dir).select("chunk_id", "source_name", "page_start", "chunk_text"))
    rich = graph.with_context(found, on.knowledge(spark, sf_dir))
    return rich.select("query_id", "rank", "chunk_id", r6("score", "score"), "source_name", "page_start", "chunk_preview", F.array_join(F.transform("graph.mentions", lambda m: F.concat_ws("/", m["concept_id"], m["name"], m["type"])), ";").alias("mentions"), F.array_join(F.transform("graph.related", lambda e: F.concat_ws("/", e["source_concept_id"], e["source_name"], e["relation"], e["target_concept_id"], e["target_name"])), ";").alias("related"))


@query
def arm_features(spark, sf_dir):
    a = on.arms(spark, sf_dir)
    return a.select("query_no", "rank", "chunk_id", *(r6(F.get("feature", F.lit(i)), f"f{i + 1}") for i in range(5)))


@query
def greedy_choice(spark, sf_dir):
    by = F.transform("arms", lambda a: F.get(a["feature"], F.lit(4)))
    return on.arm_lists(spark, sf_dir).select("query_no", bandit.first_best(F.transform("arms", lambda a: a["retrieval_score"])).alias("by_score"), bandit.first_best(by).alias("by_overlap"))


@query
def replay_log(spark, sf_dir):
    return on.events(spark, sf_dir).select("event_id", "round", "query_no", "chosen_arm.chunk_id", "chosen_arm.arm_index", r6("chosen_arm.propensity", "propensity"), r6("reward", "reward"))


@query
def gram_matrix(spark, sf_dir):
    e = on.events(spark, sf_dir).select(F.col("chosen_arm.feature").alias("x"), F.col("reward").alias("r"))
    row = bandit.moments(e)
    names = [c for c in row.columns if c[:2] in ("a_", "b_")]
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("entry"), r6(c, "value")) for c in names))).alias("x")).select("x.entry", "x.value")


@query
def ridge_weights(spark, sf_dir):
    events = on.events(spark, sf_dir).select(F.col("chosen_arm.feature").alias("x"), F.col("reward").alias("r"))
    return spark.createDataFrame([(f"w_{i}", round(float(v), 6)) for i, v in enumerate(bandit.ridge(events))], "entry string, value double")


@query
def linucb_training(spark, sf_dir):
    model, info = bandit.train(on.events(spark, sf_dir))
    row = (info["seen"], info["trained"], info["skipped"], round(info["mean_reward"], 6), *(round(float(x), 6) for x in model.theta()))
    return spark.createDataFrame([row], "seen long, trained long, skipped long, mean_reward double, " + ", ".join(f"theta_{i} double" for i in range(bandit.FEATURES)))


@query
def ucb_scores(spark, sf_dir):
    model, _ = bandit.train(on.events(spark, sf_dir))
    return on.arms(spark, sf_dir).select("query_no", "rank", r6(model.score(F.col("feature")), "ucb"))


@query
def ope_ips_snips(spark, sf_dir):
    terms = _terms(spark, sf_dir)
    return bandit.estimates(terms).select("policy", r6("ips", "ips"), r6("snips", "snips"), "n_events")


def _terms(spark, sf_dir):
    events = on.events(spark, sf_dir)
    return bandit.event_terms(events, "retrieval", WEIGHTS).unionByName(bandit.event_terms(events, "random", WEIGHTS))


@query
def ope_dm_dr(spark, sf_dir):
    return bandit.estimates(_terms(spark, sf_dir)).select("policy", r6("dm", "dm"), r6("dr", "dr"))


@query
def ope_bootstrap(spark, sf_dir):
    return bandit.bootstrap(_terms(spark, sf_dir)).select("policy", r6("lo", "lo"), r6("hi", "hi"))


@query
def ope_report(spark, sf_dir):
    events = on.whole_text_events(spark, sf_dir)
    model, _ = bandit.train(events)
    return bandit.evaluate(events, model).select("policy", *(r6(c, c) for c in ("ips", "snips", "dm", "dr", "lo", "hi")), "n_events")


@query
def replay_linucb(spark, sf_dir):
    n = on.table(spark, sf_dir, "benchmark").count()
    return bandit.replay_linucb(on.arm_lists(spark, sf_dir), on.ROUNDS, on.EPSILON, n=n).select("round", "query_no", "arm_index", r6("propensity", "propensity"), r6("reward", "reward"))


@query
def chunk_quality(spark, sf_dir):
    m = quality.chunk_metrics(on.table(spark, sf_dir, "documents").select(F.col("source").alias("source_name"), F.length("text").alias("char_count")))
    return m.select("source_name", "n_chunks", r6("avg_chars", "avg_chars"), r6("pct_in_range", "pct_in_range"), "n_outliers")


def _bm25(spark, sf_dir):
    return quality.bm25(on.table(spark, sf_dir, "documents"), on.table(spark, sf_dir, "benchmark"), 10, id_col="doc_id", text_col="text", query_id="item_id", query_text="text")


@query
def bm25_topk(spark, sf_dir):
    return _bm25(spark, sf_dir).select("query_id", "rank", F.col("id").alias("doc_id"), r6("score", "score"))


@query
def retrieval_metrics(spark, sf_dir):
    e = on.table(spark, sf_dir, "embeddings")
    hits = search.top_k(e, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10, id_col="vec_id", order="vec_id", exclude_self=True)
    labels = e.select("vec_id", "label")
    total = labels.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("total_relevant"))
    own = labels.join(total, "label").select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"), "total_relevant")
    judged = hits.join(labels, "vec_id").join(own, "query_id").select("query_id", "rank", (F.col("label") == F.col("own")).alias("relevant"), "total_relevant")
    m = quality.ranking_metrics(judged, 10)
    return m.select("k", r6("precision", "precision"), r6("recall", "recall"), r6("mrr", "mrr"))


@query
def rank_fusion(spark, sf_dir):
    a = _bm25(spark, sf_dir).select("query_id", "id", "rank")
    b = on.hits(spark, sf_dir).select(F.col("query_id").cast("long").alias("query_id"), F.expr("substring(chunk_id, 5)").cast("long").alias("id"), "rank")
    return quality.fuse(a, b, 10).select("query_id", "rank", F.col("id").alias("doc_id"), r6("rrf", "rrf"))


@query
def source_rollup(spark, sf_dir):
    s = on.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    return quality.source_rollup(_bm25(spark, sf_dir).select("query_id", "id", "score"), s).select("query_id", "source", r6("best", "best"), r6("total", "total"))


@query
def vector_topk_pruned(spark, sf_dir):
    e = on.table(spark, sf_dir, "embeddings")
    hits = pruned_top_k(e, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10, id_col="vec_id", order="vec_id")
    return hits.select(F.col("query_id").alias("qid"), F.col("rank").alias("rk"), F.col("vec_id").alias("vid"), r6("score", "score"))


@query
def tfidf_topk(spark, sf_dir):
    hits = tfidf_top_k(on.table(spark, sf_dir, "documents"), on.table(spark, sf_dir, "benchmark"), 10, id_col="doc_id", text_col="text", query_id="item_id", query_text="text")
    return hits.select("query_id", "rank", F.col("id").alias("doc_id"), r6("score", "score"))


@query
def reply_concepts(spark, sf_dir):
    ideas = on.reply_tables(spark, sf_dir)[0]
    return ideas.select("concept_id", "name", "type", F.array_join("aliases", ";").alias("aliases"), "description", r6("max_confidence", "max_confidence"), F.col("n_mentions").cast("int").alias("n_mentions"), "first_chunk")


@query
def reply_relations(spark, sf_dir):
    relations = on.reply_tables(spark, sf_dir)[1]
    return relations.select("relation_id", "source_concept_id", "relation", "target_concept_id", r6("confidence", "confidence"), "evidence", "chunk_id")


def _reply_graph(spark, sf_dir):
    ideas, relations, mentions = on.reply_tables(spark, sf_dir)
    return graph.build_graph(on.chunks(spark, sf_dir), ideas, relations, mentions, unique=False)


@query
def reply_graph_stats(spark, sf_dir):
    return graph.statistics(_reply_graph(spark, sf_dir))


@query
def reply_expand(spark, sf_dir):
    return graph.expand(on.chunks(spark, sf_dir).select("chunk_id"), _reply_graph(spark, sf_dir), 8).select("chunk_id", "edge_no", "source_concept_id", "source_name", "relation", "target_concept_id", "target_name", r6("confidence", "confidence"))


@query
def learning_path(spark, sf_dir):
    """From each concept that at least two chunks name as the source of a dependency, three edges deep."""
    relations = on.staged(on.reply_tables(spark, sf_dir)[1])
    starts = relations.where("relation = 'depends_on'").groupBy("source_concept_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select(F.col("source_concept_id").alias("concept_id"))
    return graph.learning_path(relations, starts, most=3)


@query
def pattern_relations(spark, sf_dir):
    named = spark.createDataFrame([(p, n) for p, n in on.TEST_PHRASES], "phrase string, name string").select("phrase", tx.concept_id(F.col("name"), F.lit("concept")).alias("concept_id"))
    return patterns.pattern_relations(on.chunks(spark, sf_dir), named, on.TEST_CUES).withColumnRenamed("at", "word_no")


@query
def page_flags(spark, sf_dir):
    flags = quality.page_flags(on.pages(spark, sf_dir), depth=2)
    return flags.select("page_num", F.sha2("body", 256).alias("body_sha"), F.col("removed").cast("int").alias("removed"), r6("symbol_ratio", "symbol_ratio"), "numeric_only")


@query
def running_lines(spark, sf_dir):
    return quality.edge_lines(on.pages(spark, sf_dir), depth=2)


@query
def corpus_report(spark, sf_dir):
    return quality.corpus_report(on.table(spark, sf_dir, "documents"), on.table(spark, sf_dir, "labels"))


@query
def as_of_events(spark, sf_dir):
    """Each event with its user's last click at or before it, at most six hours old."""
    e = on.table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    joined = as_of(e, e.where("event_type = 'click'"), "user_id", "ts", tie="event_id", within="6 HOURS")
    return joined.select("event_id", F.col("found.event_id").alias("click_id"), r6("found.value", "click_value"))


@query
def learned_ranking(spark, sf_dir):
    """The first 20 of each vector query re-ranked by models of other queries, beside their order by cosine."""
    e = on.table(spark, sf_dir, "embeddings")
    hits = search.top_k(e, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 20, id_col="vec_id", order="vec_id", exclude_self=True)
    labels = e.select("vec_id", "label")
    own = labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")).join(labels.groupBy(F.col("label").alias("own")).agg((F.count(F.lit(1)) - 1).alias("total_relevant")), "own")
    best = F.max("score").over(ranking.Window.partitionBy("query_id"))
    x = F.array(F.col("score"), 1.0 / F.col("rank"), F.col("score") - best)
    judged = hits.join(labels, "vec_id").join(own, "query_id").select("query_id", F.col("vec_id").alias("id"), "rank", x.alias("x"), (F.col("label") == F.col("own")).alias("relevant"), "total_relevant")
    judged = on.staged(judged)
    learned, _ = ranking.cross_ranked(judged.drop("rank"), 3)
    m = ranking.compare({"cosine": judged, "learned": learned}, 10)
    return m.select("ranker", "k", r6("precision", "precision"), r6("recall", "recall"), r6("mrr", "mrr"))


@query
def sketch_report(spark, sf_dir):
    """Users and values of each event type from merged daily states, beside the exact numbers."""
    e = on.table(spark, sf_dir, "events")
    daily = on.staged(sketches.states(e.withColumn("day", F.to_date("ts")), ["event_type", "day"], "user_id", "value"))
    told = sketches.estimates(sketches.merged(daily, ["event_type"]))
    exact = e.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count(F.lit(1)).alias("rows"))
    below = e.join(told.select("event_type", "q50", "q90"), "event_type").groupBy("event_type").agg(*(F.avg((F.col("value") <= F.col(q)).cast("int")).alias(f"r{q}") for q in ("q50", "q90")))
    near = lambda q, r: (F.col(f"r{q}") - r >= -sketches.RANK_ERROR)
    joined = told.join(exact, "event_type").join(below, "event_type")
    close = F.abs(F.col("n_items") - F.col("users")) <= sketches.DISTINCT_ERROR * F.col("users")
    return joined.select("event_type", "users", F.col("n").alias("n_rows"), close.alias("users_near"), (near("q50", 0.5) & near("q90", 0.9)).alias("quantiles_near"))


@query
def session_windows(spark, sf_dir):
    """Sessions of the events from a stream of files in the order of a hash, restarted once to close what was open."""
    schema = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, value DOUBLE"
    e = on.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
    folder, out, checkpoint = (scratch(spark) for _ in range(3))
    e.repartition(4, F.xxhash64("event_id")).write.parquet(folder)
    last = e.agg(F.max("ts")).first()[0]
    late = "3650 days"  # files come in any order here
    windows.run_sessions(spark, folder, schema, out, checkpoint, late=late, files_per_trigger=2)
    if last is not None:
        windows.close_sessions(spark, folder, schema, last + timedelta(days=2 * 3650))
        windows.run_sessions(spark, folder, schema, out, checkpoint, late=late)
    done = spark.read.schema(windows.SESSION).parquet(out)
    told = lambda c, name: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name)
    return done.select("user_id", told("start", "opened"), told("end", "closed"), "n", r6("total", "total"))


@query
def policy_models(spark, sf_dir):
    """Sums of a LinUCB model of each event type, from a stream of files in the order of a hash, broken off after a part of the files and started again."""
    schema = "event_id BIGINT, ts TIMESTAMP, policy STRING, x ARRAY<DOUBLE>, r DOUBLE"
    e = on.table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    x = F.array(F.lit(1.0), F.col("value") / 100, F.col("k") / 100, F.hour("ts") / 24.0, F.pmod("user_id", F.lit(7)) / 7.0)
    rows = e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("policy"), x.alias("x"), (F.col("value") / (F.col("value") + 50)).alias("r"))
    folder, out, checkpoint = (scratch(spark) for _ in range(3))
    late, closing = "3650 days", timedelta(days=2 * 3650)  # files come in any order here
    for part in (0, 1):
        half = rows.where(F.pmod(F.xxhash64("event_id"), F.lit(2)) == part)
        half.repartition(2, F.xxhash64("event_id")).write.mode("append").parquet(folder)
        policies.run_policies(spark, folder, schema, out, checkpoint, late=late, files_per_trigger=1)
    last = e.agg(F.max("ts")).first()[0]
    if last is not None:
        windows.close_sessions(spark, folder, schema, last + closing)
        policies.run_policies(spark, folder, schema, out, checkpoint, late=late)
    sums = policies.policy_sums(spark.read.schema(policies.PART).parquet(out))
    return sums.select("policy", "n", F.posexplode("sums").alias("place", "value")).select("policy", "n", "place", r6("value", "value"))


@query
def bad_json_lines(spark, sf_dir):
    """The events' props as JSON lines, some of them cut short, in files of a thousand ids each: where the unreadable ones are."""
    e = on.table(spark, sf_dir, "events").withColumn("block", F.floor(F.col("event_id") / 1000))
    line = F.when(F.col("event_id") % 97 == 0, F.substring("props", 1, 4)).when(F.col("event_id") % 89 == 0, F.lit(" ")).otherwise(F.col("props"))
    folder = scratch(spark)
    e.select("block", "event_id", line.alias("value")).repartition("block").sortWithinPartitions("block", "event_id", "value").drop("event_id").write.partitionBy("block").text(folder)
    return files.bad_lines(spark, folder, "k BIGINT").select(F.regexp_extract("file", "block=([0-9]+)", 1).cast("long").alias("block"), "line_no", "line")
