"""Every registered query against its SQL, and the rules of the engine on small inputs."""

import math
import glob
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkscribe.functions import text as tx
from sparkscribe.functions.vector import hash_embedding
from sparkscribe.operators import bandit, chunking, concepts, graph, quality, search
from sparkscribe.plans.oracles import ORACLES
from sparkscribe.plans.queries import QUERIES
from sparkscribe.sources import files, schemas, store
from sparkscribe.streaming import online

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(rows):
    return sorted(tuple("null" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert plain(got.select(*columns).collect()) == plain(duck.sql(f"select {', '.join(columns)} from ({ORACLES[name]})").fetchall())
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
    spark.catalog.clearCache()


def test_metrics_of_copies(spark, tmp_path):
    # vector 20 is a copy of vector 0, so 0 stands before 20 itself among the hits of 20; queries are the ids divisible by 20
    rows = [(0, [1.0, 0.0], 0), (20, [1.0, 0.0], 0), (40, [0.0, 1.0], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["retrieval_metrics"](spark, str(tmp_path)).first()
    assert (got.k, got.precision, got.recall, got.mrr) == (10, round(2 / 30, 6), round(2 / 3, 6), round(2 / 3, 6))


def test_fusion_of_long_ids(spark, tmp_path):
    texts = ["alpha beta", "beta gamma", "gamma delta"]
    spark.createDataFrame([(12345670 + i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "beta"), (1, "delta alpha")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    got = QUERIES["rank_fusion"](spark, str(tmp_path)).select("query_id", "rank", "doc_id", "rrf").collect()
    assert {r.doc_id for r in got} == {12345670, 12345671, 12345672}
    assert plain(got) == plain(con.sql(f"select query_id, rank, doc_id, rrf from ({ORACLES['rank_fusion']})").fetchall())


def one(spark, expression, *values, kinds="string"):
    row = spark.createDataFrame([values], ", ".join(f"c{i} {k}" for i, k in enumerate(kinds.split())))
    return row.select(expression(*(F.col(f"c{i}") for i in range(len(values)))).alias("x")).first()["x"]


def test_titles_at_their_limits(spark):
    title = lambda t: one(spark, tx.is_title, t)
    assert title("a" * 79) and not title("a" * 80)
    assert title("one two three four five six seven eight") and not title("one two three four five six seven eight nine")
    assert not any(title(f"Short{c}") for c in ".!?;:")
    assert title("x" * 500 + " Convolution.") and not title("")


def test_cleaning(spark):
    clean = lambda t: one(spark, tx.clean_text, t)
    assert clean("a\r\nb\rc") == "a b c"
    assert clean("oﬃce ofﬂine") == "office offline"
    assert clean("state-of-the-\nart and well-\n known") == "state-of-the-art and well- known"
    assert clean("end of\n 12 \npage\n\n\nnext") == "end of page\n\nnext"
    assert clean(" a\t\tb \u001c") == "a b"
    assert clean(None) == ""


def test_identifiers(spark):
    assert one(spark, tx.slugify, "  X-Ray / CT!  ") == "x_ray_ct"
    assert one(spark, tx.slugify, "???") == "unknown"
    assert one(spark, tx.normalize_text, " A\t b \nC ") == "a b c"
    assert one(spark, lambda c: tx.recover_json(c, "k int")["k"], 'ok {"k": 3} end') == 3
    assert one(spark, lambda c: tx.recover_json(c, "k int"), "nothing") is None


def fold(paras, target=1200, least=600, most=1800):
    out, number, length, fresh = [], 0, 0, True
    for size, is_title, final in paras:
        if fresh or (is_title and length >= least) or (length + 2 + size > most and length >= least):
            number, length, fresh = number + 1, size, False
        else:
            length += 2 + size
            fresh = length >= target and final
        out.append(number)
    return out


@pytest.mark.parametrize("parts", [None, 1, 7, 40])
def test_chunks_by_the_rule(spark, parts):
    """A source of most pages, spread over many ranges; repeated pages, pages without number or source, single-page sources."""
    rng = random.Random(4)
    rows, want = [], {}
    for s in ["hot"] * 5 + [None, "b", *(f"s{i}" for i in range(5))]:
        for i in range(1 if s and s[0] == "s" else 15):
            paras = ["w" * (rng.choice([5, 70, 90, 300, 599, 600, 601, 1198, 1199, 1200, 1801, 2500]) - 1) + rng.choice(".:a") for _ in range(rng.randint(1, 6))]
            rows += [(s, rng.choice([i, i, None, 3]), "\n\n".join(paras))] * rng.choice([1, 1, 1, 2])
    for s in {r[0] for r in rows}:
        told = sorted((n or 0, t) for source, n, t in rows if source == s)
        paras = [(n, p) for n, t in told for p in t.split("\n\n")]
        numbers = fold([(len(p), len(p) < 80 and p[-1] == "a", p[-1] == ".") for _, p in paras])
        for no in range(1, numbers[-1] + 1):
            own = [p for p, n in zip(paras, numbers) if n == no]
            want[s, no] = (own[0][0], own[-1][0], "\n\n".join(p for _, p in own), no < numbers[-1])
    rng.shuffle(rows)
    pages = spark.createDataFrame(rows, "source_name string, page_num int, clean_text string")
    got = chunking.build_chunks(pages, parts=parts).collect()
    assert {(r.source_name, r.chunk_no): (r.page_start, r.page_end, r.chunk_text, r.next_chunk_id is not None) for r in got} == want
    assert len(got) == len(want) and all(r.char_count == len(r.chunk_text) for r in got)
    assert chunking.build_chunks(pages.limit(0), parts=parts).collect() == []


def test_chunks_link_and_keep_text(spark):
    pages = spark.createDataFrame([("a", 1, "x" * 700), ("a", 2, "y" * 1500 + "."), ("a", 3, "z" * 900), ("b", 1, "only one page here. " * 9)], "source_name string, page_num int, raw_text string")
    chunks = chunking.build_chunks(chunking.kept_pages(chunking.clean_pages(pages, 1))).orderBy("source_name", "chunk_no").collect()
    assert [(c.source_name, c.chunk_no, c.prev_chunk_id is None, c.next_chunk_id is None) for c in chunks] == [("a", 1, True, False), ("a", 2, False, False), ("a", 3, False, True), ("b", 1, True, True)]


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    row = lambda i, t, page=1: (f"c{i}", "s", page, page, t)
    frame = lambda rows: files.chunks_for_embedding(spark.createDataFrame(rows, "chunk_id string, source_name string, page_start int, page_end int, chunk_text string"))
    assert s.refresh(frame([row(1, "One"), row(2, "two")]), dim=16)["recomputed"] == 2
    second = s.refresh(frame([row(1, " one "), row(2, "two!"), row(3, "three")]), dim=16)
    assert (second["skipped"], second["recomputed"]) == (1, 2)
    assert {r.chunk_id: r.chunk_text for r in s.read().collect()} == {"c1": "One", "c2": "two!", "c3": "three"}
    assert s.refresh(frame([row(1, "One")]), dim=16, force=True)["recomputed"] == 1
    numbered = frame([row(1, "One"), row(3, "three")]).withColumn("chunk_no", F.when(F.col("chunk_id") == "c3", 1).otherwise(2))
    index = store.build_index(numbered, s.read(), "hash-v1", 16)
    assert [(r.vector_row_index, r.chunk_id) for r in index.orderBy("vector_row_index").collect()] == [(0, "c3"), (1, "c1")]
    with pytest.raises(ValueError):
        s.refresh(frame([row(1, "a"), row(1, "b")]), dim=16)
    with pytest.raises(Exception):
        store.build_index(frame([row(9, "x")]).withColumn("chunk_no", F.lit(1)), s.read(), "hash-v1", 16).collect()


def test_search_edges(spark):
    index = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "b", [1.0, 0.0]), (2, "z", [0.0, 0.0])], "vector_row_index int, chunk_id string, embedding array<float>")
    q = spark.createDataFrame([(7, [2.0, 0.0])], "query_id int, embedding array<float>")
    assert [(r.rank, r.chunk_id, r.score) for r in search.top_k(index, q, 5).orderBy("rank").collect()] == [(1, "a", 1.0), (2, "b", 1.0), (3, "z", 0.0)]
    assert search.top_k(index.limit(0), q, 3).count() == 0
    with pytest.raises(ValueError):
        search.top_k(index, q, 0)
    with pytest.raises(Exception):
        search.top_k(index, spark.createDataFrame([(1, [1.0])], "query_id int, embedding array<float>"), 1).collect()
    with pytest.raises(Exception):
        search.with_metadata(search.top_k(index, q, 1), index.select("chunk_id", F.lit("t").alias("chunk_text")).where("chunk_id = 'b'"), strict=True).collect()


def test_lexicon(spark):
    chunks = spark.createDataFrame([("c1", "s", 1, 1, "An October scan with CT and filters"), ("c2", "s", 2, 2, "nothing")], "chunk_id string, source_name string, page_start int, page_end int, chunk_text string")
    raw = concepts.extract_by_lexicon(chunks)
    named = concepts.mentions(raw)
    assert {r.concept_id for r in named.collect()} == {"modality::ct", "modality::oct", "method::filter", "concept::medical_imaging"}
    relations = concepts.dedup_relations(concepts.relation_rows(raw, named))
    assert {r.relation_id for r in relations.collect()} == {"modality::ct|used_for|concept::medical_imaging|c1", "modality::oct|used_for|concept::medical_imaging|c1"}
    assert {r.concept_id for r in concepts.mentions(raw, 0.75).collect()} == {"concept::medical_imaging"}
    ideas = concepts.aggregate_concepts(named)
    g = graph.build_graph(chunks.withColumn("next_chunk_id", F.when(F.col("chunk_id") == "c1", "c2").otherwise("c9")), ideas, relations)
    assert graph.statistics(g).first().asDict() == {"chunks": 2, "concepts": 4, "mentions": 4, "relations": 2, "next_edges": 1}
    assert concepts.graph_manifest(concepts.extraction_log(raw, F.lit("t")), ideas, relations).first()["relations_total"] == 2


def test_bandit_rules(spark):
    assert one(spark, lambda c: bandit.first_best(c), [1.0, 3.0, 3.0], kinds="array<double>") == 1
    prob = lambda b, c, k, e: one(spark, lambda x, y, z: bandit.action_probability(x, y, z, e), b, c, k, kinds="int int int")
    assert prob(0, 0, 4, 0.2) == pytest.approx(0.85) and prob(0, 1, 4, 0.2) == pytest.approx(0.05)
    model = bandit.LinUCB(dim=2, alpha=0.7)
    for x, r in (([1.0, 0.5], 0.3), ([0.2, 0.9], 0.8)):
        model.update(x, r)
    x = [0.4, 0.6]
    want = model.theta() @ x + 0.7 * np.sqrt(np.array(x) @ np.linalg.inv(model.A) @ x)
    assert one(spark, model.score, x, kinds="array<double>") == pytest.approx(want)
    assert model.scores(np.array([x]))[0] == pytest.approx(want)


def small_events(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        arms = [(f"c{k}", float(1 - k / 10), k + 1, rng.random(5).tolist()) for k in range(4)]
        k = int(rng.integers(4))
        rows.append((f"e{i}", "t", i, "q", "p", 0.5, arms, (arms[k][0], k, arms[k][3], 0.25), float(rng.random())))
    return spark.createDataFrame(rows, schemas.EVENT)


def test_training_batch_and_stream_agree(spark, tmp_path):
    events = small_events(spark)
    model, info = bandit.train(events)
    by_hand = bandit.LinUCB()
    for r in events.collect():
        by_hand.update(r.chosen_arm.feature, r.reward)
    assert np.allclose(model.A, by_hand.A) and np.allclose(model.b, by_hand.b) and info["trained"] == 60
    files.write_jsonl(events.repartition(3), str(tmp_path / "events"))
    for _ in range(2):  # the second run finds nothing new
        q = online.train_stream(online.event_stream(spark, str(tmp_path / "events"), 1), str(tmp_path / "state"), str(tmp_path / "cp"))
        q.awaitTermination(120)
    last, streamed = online.load_state(spark, str(tmp_path / "state"))
    assert last == 2 and np.allclose(streamed.A, model.A) and np.allclose(streamed.b, model.b)
    model.save(spark, str(tmp_path / "model"))
    assert np.allclose(bandit.LinUCB.load(spark, str(tmp_path / "model")).A, model.A)


def test_estimators(spark):
    events = small_events(spark)
    w = bandit.ridge(events.select(F.col("chosen_arm.feature").alias("x"), F.col("reward").alias("r")))
    rows = events.collect()
    x, y = np.array([r.chosen_arm.feature for r in rows]), np.array([r.reward for r in rows])
    assert np.allclose(w, np.linalg.solve(x.T @ x + np.eye(5), x.T @ y))
    got = bandit.estimates(bandit.event_terms(events, "retrieval", w, 0.05)).first()
    ips = dr = dm = ws = 0.0
    for r in rows:
        p = (0.95 if r.chosen_arm.arm_index == 0 else 0) + 0.05 / 4
        q = np.array([a.feature for a in r.candidate_arms]) @ w
        v = 0.95 * q[0] + 0.05 * q.mean()
        weight = p / 0.25
        ips, ws, dm, dr = ips + weight * r.reward, ws + weight, dm + v, dr + v + weight * (r.reward - q[r.chosen_arm.arm_index])
    assert np.allclose([got.ips, got.snips, got.dm, got.dr], [ips / 60, ips / ws, dm / 60, dr / 60])
    report = bandit.evaluate(events, bandit.train(events)[0])
    assert {r.policy for r in report.where("lo <= hi").collect()} == {"retrieval", "random", "linucb"}


def test_store_survives_a_broken_write(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    frame = files.chunks_for_embedding(spark.createDataFrame([("c1", "s", 1, 1, "one")], "chunk_id string, source_name string, page_start int, page_end int, chunk_text string"))
    assert s.version() == 0 and s.refresh(frame, dim=16)["recomputed"] == 1
    (tmp_path / "store" / "v2").mkdir()  # a write that did not finish
    (tmp_path / "store" / "v2" / "part-0.parquet").write_bytes(b"half")
    assert s.version() == 1 and s.read().count() == 1
    assert s.refresh(frame, dim=16)["skipped"] == 1 and s.version() == 2
    s.refresh(frame, dim=16)
    assert s.remove_old(1) == 2 and s.version() == 3 and s.read().count() == 1


def test_numbers_of_uneven_values(spark):
    rows = [(i + (10**12 if i % 3 else 0), i) for i in range(500)] + [(7, 1000 + i) for i in range(50)]
    got = store.number_rows(spark.createDataFrame(rows, "x long, y int"), "x", "y", ranges=8).orderBy("n").collect()
    assert [(r.x, r.y) for r in got] == sorted(rows) and [r.n for r in got] == list(range(550))


def test_missing_metadata_and_unbound_chunks(spark):
    hits = spark.createDataFrame([(0, 1, "a", 1.0), (0, 2, "b", 0.5)], "query_id int, rank int, chunk_id string, score double")
    found = search.with_metadata(hits, spark.createDataFrame([("a", "text")], "chunk_id string, chunk_text string"))
    assert {r.chunk_id: r.chunk_preview for r in found.collect()} == {"a": "text", "b": None}
    bound = graph.bind_index(hits.select("chunk_id"), spark.createDataFrame([("a", 0)], "chunk_id string, vector_row_index int"), "main", "m", 8, F.lit("t"))["chunks"]
    assert {r.chunk_id: (r.index_name, r.embedding_dim) for r in bound.collect()} == {"a": ("main", 8), "b": (None, None)}


def test_replies_of_wrong_types(spark):
    replies = ['{"concepts":"oops"}', '{"concepts":[],"relations":{}}', '{"concepts":[1]}', "[1]", '{"concepts":null}', "{}", 'so: {"concepts":[]} end', '{"concepts":[{"name":"a","confidence":"x"}]}']
    chunks = spark.createDataFrame([(f"c{i}", "s", 1, 1, r) for i, r in enumerate(replies)], "chunk_id string, source_name string, page_start int, page_end int, reply string")
    got = {r.chunk_id: r.error for r in concepts.parse_replies(chunks).collect()}
    lists = "concepts and relations must be lists"
    assert [got[f"c{i}"] for i in range(8)] == [lists, lists, "entries must be objects", "unreadable reply", lists, None, None, "unreadable confidence"]


def test_sources(spark, tmp_path):
    (tmp_path / "q.txt").write_text("\n  first \n\nsecond\n")
    assert [r.query for r in files.read_queries(spark, str(tmp_path / "q.txt")).orderBy("query_no").collect()] == ["first", "second"]
    assert files.read_queries(spark).count() == 5
    (tmp_path / "bad.jsonl").write_text('{"chunk_id": "a"}\n\n{oops\n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), schemas.CHUNK).collect()
    (tmp_path / "doc.bin").write_bytes(b"one\x0ctwo")
    pages = files.read_pages(spark, str(tmp_path / "doc.bin"), lambda b: b.decode().split("\x0c"))
    assert [(r.source_name, r.page_num, r.raw_text) for r in pages.collect()] == [("doc.bin", 1, "one"), ("doc.bin", 2, "two")]
    with pytest.raises(Exception):
        files.require(spark.createDataFrame([("a", None)], "a string, b string"), ("a", "b")).collect()
    assert one(spark, lambda c: F.size(hash_embedding(c, 20)), "x") == 20
    walk = quality.edge_lines(spark.createDataFrame([("s", i, f"Head\nbody {i}\n{i}") for i in range(4)], "source_name string, page_num int, raw_text string"))
    assert [r.line for r in walk.collect()] == ["Head"]


def test_bm25_with_and_without_broadcast(spark):
    docs = [(1, "A b b c"), (2, "b"), (3, None), (4, ""), (5, "x y z"), (6, "a a c c d")]
    asked = [(1, "b a b"), (2, "C d"), (3, None), (4, "nowhere")]
    held = {i: (t or "").lower().split() for i, t in docs}
    mean = sum(map(len, held.values())) / len(held)
    want = []
    for q, text in asked:
        scores = {}
        for term in set((text or "").lower().split()):
            df = sum(term in w for w in held.values())
            for i, w in held.items():
                if term in w:
                    tf = w.count(term)
                    scores[i] = scores.get(i, 0) + math.log(1 + (len(held) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
        want += [(q, n, i, round(s, 9)) for n, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:2], 1)]
    d, a = spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(asked, "q long, text string")
    for bound in (quality.ASKED, 0):
        got = quality.bm25(d, a, 2, id_col="id", text_col="text", query_id="q", query_text="text", asked_bound=bound)
        assert sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in got.collect()) == sorted(want)
    assert quality.bm25(d.limit(0), a, 2, id_col="id", text_col="text", query_id="q", query_text="text").count() == 0
    assert quality.bm25(d, a.limit(0), 2, id_col="id", text_col="text", query_id="q", query_text="text").count() == 0
