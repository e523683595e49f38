"""The engine end to end: each function reads and writes tables under one workspace folder.

workspace/pages, chunks            cleaned pages and chunks (JSON lines)
workspace/vector                   the versioned store, index, index map and manifest
workspace/graph                    concepts, relations, extraction log, manifest; nodes and edges
workspace/bandit                   events, model, report
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkscribe.functions.text import preview
from sparkscribe.functions.vector import hash_embedding
from sparkscribe.operators import bandit, chunking, concepts, graph, search
from sparkscribe.sources import files, schemas, store


def now():
    return F.date_trunc("second", F.current_timestamp())


def write_document(spark: SparkSession, value: dict, path: str) -> None:
    """One JSON object as a one-row text table; nulls are kept."""
    spark.createDataFrame([(json.dumps(value, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])


def process_pages(pages: DataFrame, workspace: str, *, start_page: int = 11, prefix: str = "chunk", **sizes) -> dict:
    """Raw pages to cleaned pages and chunks. Chunk ids carry the source's name when there are several."""
    spark = pages.sparkSession
    cleaned = chunking.clean_pages(pages, start_page)
    files.write_jsonl(cleaned, f"{workspace}/pages")
    cleaned = files.read_jsonl(spark, f"{workspace}/pages", cleaned.schema.simpleString()[7:-1].replace(":", " "))
    chunks = chunking.build_chunks(chunking.kept_pages(cleaned), prefix, **sizes)
    several = cleaned.select("source_name").distinct().limit(2).count() > 1
    if several:
        tag = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws("_", "source_name", c)).alias(c)
        chunks = chunks.select(*(tag(c) if c.endswith("chunk_id") else F.col(c) for c in chunks.columns))
    files.write_jsonl(chunks, f"{workspace}/chunks")
    written = read_chunks(spark, workspace)
    return {"pages": cleaned.count(), "chunks": written.count()}


def read_chunks(spark: SparkSession, workspace: str) -> DataFrame:
    return files.read_jsonl(spark, f"{workspace}/chunks", schemas.CHUNK + ", chunk_no INT")


def build_vector_store(spark: SparkSession, workspace: str, *, backend: str = "hash", model: str = "hash-v1", dim: int = 384, force: bool = False, encode: Callable | None = None) -> dict:
    """Embed what is new or changed, then rebuild the index in the order of source and chunk number."""
    chunks = read_chunks(spark, workspace)
    s = store.Store(spark, f"{workspace}/vector/store")
    manifest = s.refresh(files.chunks_for_embedding(chunks), backend=backend, model=model, dim=dim, force=force, encode=encode)
    order = F.dense_rank().over(_sources_window())
    ranked = chunks.join(chunks.select("source_name").distinct().withColumn("source_no", order), "source_name")
    ordered = ranked.select("chunk_id", (F.col("source_no").cast("double") * 1e9 + F.col("chunk_no")).alias("chunk_no"))
    index = store.build_index(ordered, s.read(), model, dim)
    index.write.mode("overwrite").parquet(f"{workspace}/vector/index")
    manifest |= {"index_size": spark.read.parquet(f"{workspace}/vector/index").count(), "index_path": f"{workspace}/vector/index", "store_version": s.version()}
    write_document(spark, manifest, f"{workspace}/vector/manifest")
    return manifest


def _sources_window():
    from pyspark.sql import Window

    return Window.orderBy("source_name")  # one row per source


def load_index(spark: SparkSession, workspace: str) -> tuple[DataFrame, dict]:
    """The index and its manifest; rows that do not match the manifest's number end the load."""
    index, manifest = spark.read.parquet(f"{workspace}/vector/index"), read_document(spark, f"{workspace}/vector/manifest")
    if index.count() != manifest["index_size"]:
        raise ValueError("the index and its manifest differ in size")
    return index, manifest


def extract_concepts(spark: SparkSession, workspace: str, *, backend: str = "heuristic", reply: Callable[[list[str]], list[str]] | None = None, lexicon: Sequence = concepts.LEXICON, least: float = 0.6, max_chars: int = 4000) -> dict:
    chunks = files.chunks_for_concepts(read_chunks(spark, workspace), max_chars)
    if backend not in ("heuristic", "model"):
        raise ValueError(f"unknown extraction backend {backend!r}")
    raw = concepts.extract_by_lexicon(chunks, lexicon) if backend == "heuristic" else concepts.extract_by_model(chunks, reply)
    raw.write.mode("overwrite").parquet(f"{workspace}/graph/raw")  # a model is asked once
    raw = spark.read.parquet(f"{workspace}/graph/raw")
    named = concepts.mentions(raw, least)
    files.write_jsonl(concepts.aggregate_concepts(named).drop("n_mentions", "first_chunk"), f"{workspace}/graph/concepts")
    files.write_jsonl(concepts.dedup_relations(concepts.relation_rows(raw, named, least)).drop("ord"), f"{workspace}/graph/relations")
    log = concepts.extraction_log(raw, F.date_format(now(), "yyyy-MM-dd'T'HH:mm:ssXXX"), least)
    files.write_jsonl(log, f"{workspace}/graph/log")
    total = concepts.graph_manifest(log, *read_knowledge(spark, workspace), backend).first().asDict()
    write_document(spark, total, f"{workspace}/graph/manifest")
    return total


def read_knowledge(spark: SparkSession, workspace: str) -> tuple[DataFrame, DataFrame]:
    return files.read_jsonl(spark, f"{workspace}/graph/concepts", schemas.CONCEPT), files.read_jsonl(spark, f"{workspace}/graph/relations", schemas.RELATION)


def ingest_graph(spark: SparkSession, workspace: str) -> dict:
    """Node and edge tables; ingesting again replaces them, so it changes nothing. Returns the counts."""
    g = graph.build_graph(read_chunks(spark, workspace), *read_knowledge(spark, workspace))
    for name, df in g.items():
        df.write.mode("overwrite").parquet(f"{workspace}/graph/tables/{name}")
    return graph.statistics(read_graph(spark, workspace)).first().asDict()


def read_graph(spark: SparkSession, workspace: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{workspace}/graph/tables/{n}") for n in ("chunks", "concepts", "mentions", "next", "relations")}


def link_vector_graph(spark: SparkSession, workspace: str, *, name: str = "main") -> dict:
    """Index map, chunk-concept map and the index node with its edges; all are rewritten whole."""
    index, manifest = load_index(spark, workspace)
    model, dim = manifest["embedding_model"], manifest["embedding_dim"]
    rows = store.index_map(index, model, dim, name, now())
    rows.write.mode("overwrite").parquet(f"{workspace}/vector/index_map")
    store.chunk_concept_map(read_knowledge(spark, workspace)[0]).write.mode("overwrite").parquet(f"{workspace}/vector/chunk_concept_map")
    bound = graph.bind_index(read_graph(spark, workspace)["chunks"], index, name, model, dim, now())
    for part, df in bound.items():
        df.write.mode("overwrite").parquet(f"{workspace}/graph/bound/{part}")
    return graph.linked_count(spark.read.parquet(f"{workspace}/graph/bound/edges"), name).first().asDict()


def retrieve(spark: SparkSession, workspace: str, queries: Sequence[str], *, k: int = 5, with_graph: bool = True, max_edges: int = 8, encode: Callable | None = None) -> DataFrame:
    """Ranked hits of each query with metadata, a preview and one-hop graph context."""
    index, manifest = load_index(spark, workspace)
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    vector = encode(F.col("query")) if encode else hash_embedding(F.col("query"), manifest["embedding_dim"])
    hits = search.top_k(index, asked.select("query_id", vector.alias("embedding")), k)
    meta = store.Store(spark, f"{workspace}/vector/store").read().select("chunk_id", "source_name", "page_start", "page_end", "char_count", "token_estimate", "chunk_text")
    found = search.with_metadata(hits.join(index.select("chunk_id", "vector_row_index"), "chunk_id"), meta).join(asked, "query_id")
    return graph.with_context(found, read_graph(spark, workspace), max_edges) if with_graph else found


def payload(hits: DataFrame, path: str | None = None) -> list[dict]:
    """The hits as JSON objects in order of query and rank; also written if a path is given. For a bounded number of queries."""
    if path:
        files.write_jsonl(hits, path)
    return [json.loads(r.j) for r in hits.orderBy("query_id", "rank").select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).collect()]


def build_arms(spark: SparkSession, workspace: str, queries: Sequence[str], k: int = 10) -> DataFrame:
    hits = retrieve(spark, workspace, queries, k=k, with_graph=False)
    texts = store.Store(spark, f"{workspace}/vector/store").read().select("chunk_id", "chunk_text")
    joined = hits.join(texts, "chunk_id")
    x = bandit.features(F.col("query"), F.col("chunk_text"), F.col("score"), F.col("rank"), F.col("char_count"), F.col("token_estimate"))
    arm = F.struct("rank", "chunk_id", F.col("score").alias("retrieval_score"), x.alias("feature"), preview(F.col("chunk_text"), bandit.REWARD_PREFIX).alias("text"))
    return joined.groupBy(F.col("query_id").alias("query_no"), "query").agg(F.array_sort(F.collect_list(arm)).alias("arms"))


def simulate(spark: SparkSession, workspace: str, *, queries: Sequence[str] = files.DEFAULT_QUERIES, policy: str = "retrieval_epsilon", rounds: int = 200, k: int = 10, epsilon: float = 0.1, alpha: float = 1.0, seed: int = 42) -> dict:
    """Write an event log of `rounds` rounds."""
    if not queries:
        raise ValueError("no queries")
    arms = build_arms(spark, workspace, queries, k)
    if policy == "retrieval_epsilon":
        events = bandit.replay(arms, rounds, epsilon, seed, len(queries))
    elif policy == "linucb_epsilon":
        chosen = bandit.replay_linucb(arms, rounds, epsilon, alpha, seed, len(queries))
        events = chosen.join(arms, "query_no").withColumn("arm", F.get("arms", "arm_index")).select(*bandit._event_columns(policy, epsilon, seed))
    else:
        raise ValueError(f"unknown policy {policy!r}")
    files.write_jsonl(events.withColumn("ts", F.date_format(now(), "yyyy-MM-dd'T'HH:mm:ssXXX")).drop("query_no"), f"{workspace}/bandit/events")
    return read_events(spark, workspace).agg(F.count(F.lit(1)).alias("events"), F.avg("reward").alias("mean_reward")).first().asDict()


def read_events(spark: SparkSession, workspace: str) -> DataFrame:
    return files.read_jsonl(spark, f"{workspace}/bandit/events", schemas.EVENT)


def train(spark: SparkSession, workspace: str, *, alpha: float = 1.0, l2: float = 1.0, reset: bool = False) -> dict:
    """Train on the event log, on top of a stored model unless `reset`."""
    path, model = f"{workspace}/bandit/model", None
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not reset and p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        model = bandit.LinUCB.load(spark, path)
    model, info = bandit.train(read_events(spark, workspace), model, alpha, l2)
    model.save(spark, path)
    return info


def evaluate(spark: SparkSession, workspace: str, *, epsilon: float = 0.05, reg: float = 1.0, seed: int = 42, use_model: bool = True) -> dict:
    model = bandit.LinUCB.load(spark, f"{workspace}/bandit/model") if use_model else None
    rows = bandit.evaluate(read_events(spark, workspace), model, epsilon=epsilon, reg=reg, seed=seed).collect()  # a row per policy
    report = {"target_epsilon": epsilon, "reward_model_reg": reg, "policies": {r.policy: {"IPS": r.ips, "SNIPS": r.snips, "DR": r.dr, "DM": r.dm, "n_events": r.n_events, "DR_95CI": [r.lo, r.hi]} for r in rows}}
    write_document(spark, report, f"{workspace}/bandit/report")
    return report
