"""Searches, graph walks, page rules, joins, sketches and streams against brute force on small inputs."""

import datetime as dt
import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkscribe.operators import bandit, chunking, graph, patterns, pruned, quality, ranking, search, sketches, tfidf
from sparkscribe.operators.asof import as_of
from sparkscribe.plans.queries import QUERIES
from sparkscribe.sources import files
from sparkscribe.sources.staging import scratch
from sparkscribe.streaming import policies, windows

# pruned vector search


def cosine_top(rows, queries, k, exclude_self=False):
    unit = lambda v: np.array(v, float) / (np.linalg.norm(v) or 1)
    out = []
    for qi, (q, qv) in enumerate(queries):
        s = sorted((-(round(float(unit(v) @ unit(qv)), 12) + 0.0), o, i) for i, o, v in rows if not (exclude_self and i == q))[:k]
        out += [(q, r + 1, i, -x) for r, (x, _, i) in enumerate(s)]
    return out


def clustered(seed, n=600, dim=6):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(8, dim)) * 5
    rows = [(i, i, (middle[i % 8] + rng.normal(size=dim) * 0.1).round(3).tolist()) for i in range(n)]
    rows += [(n + i, n + i, middle[0].round(2).tolist()) for i in range(300)]  # copies
    return rows + [(2000 + i, 2000 + i, [0.0] * dim) for i in range(5)]


@pytest.mark.parametrize("self_out", [False, True])
def test_pruned_top_k(spark, self_out):
    rows = clustered(1)
    queries = [(i, v) for i, _, v in rows if i % 20 == 0] + [(5000, [0.0] * 6), (5001, [-1.0, 2.0, 3.0, 4.0, -5.0, 6.0]), (5002, None)]
    index = spark.createDataFrame(rows + [(9000, 9000, None)], "id long, o long, embedding array<double>").repartition(3)
    asked = spark.createDataFrame(queries, "query_id long, embedding array<double>")
    got = pruned.pruned_top_k(index, asked, 7, id_col="id", order="o", exclude_self=self_out, list_rows=50, query_rows=9).collect()
    want = cosine_top(rows, [q for q in queries if q[1] is not None], 7, self_out)
    assert sorted((r.query_id, r["rank"], r.id) for r in got) == sorted(w[:3] for w in want)
    assert all(abs(a - b) < 1e-9 for a, b in zip([r.score for r in sorted(got, key=lambda r: (r.query_id, r["rank"]))], [w[3] for w in sorted(want)]))
    scored = {r.query_id: r.scored for r in got if r.query_id not in (5000, 5001)}
    assert sum(scored.values()) < 0.5 * len(rows) * len(scored)


def test_pruned_edges(spark, monkeypatch):
    index = spark.createDataFrame([(i, i, [float(i), 1.0]) for i in range(4)], "id long, o long, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 1.0]), (2, [0.0, -1.0])], "query_id long, embedding array<double>")
    assert len(pruned.pruned_top_k(index, asked, 9, id_col="id", order="o").collect()) == 8
    assert pruned.pruned_top_k(index.limit(0), asked, 9, id_col="id", order="o").collect() == []
    assert pruned.pruned_top_k(index, asked.limit(0), 9, id_col="id", order="o").collect() == []
    with pytest.raises(ValueError):
        pruned.pruned_top_k(index, asked, 0, id_col="id", order="o")
    few = search.top_k(index, asked, 3, id_col="id", order="o").collect()
    monkeypatch.setattr(search, "QUERY_BLOCK", 1)  # more queries than are broadcast
    assert sorted(map(tuple, search.top_k(index, asked, 3, id_col="id", order="o").collect())) == sorted(map(tuple, few))


# Chunks


def test_pages_are_cleaned_once(spark):
    """A page's text is cleaned before the filter on it, not in the filter too."""
    pages = chunking.clean_pages(spark.createDataFrame([("s", 1, "A page\r\nof  text.")], "source_name string, page_num int, raw_text string"), 0)
    lines = chunking.kept_pages(pages).select("clean_text")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert sum("-\\n(?=" in x for x in lines) == 1 and not any("Filter" in x and "regexp_replace" in x for x in lines)
    assert [r[0] for r in chunking.kept_pages(pages.withColumn("char_count", F.lit(80))).select("clean_text").collect()] == ["A page of text."]


def test_streams_of_sources_stay_apart(spark):
    """Small as lengths and flags are, sources are not joined into one task."""
    rows = spark.createDataFrame([(f"s{i}", 0, i, [40, 41, 43]) for i in range(60)], "source_name string, part int, page long, marks array<int>")
    used = chunking._states(rows).rdd.getNumPartitions()
    assert used >= chunking.STREAMS


def test_strip_takes_white_space_of_unicode(spark):
    from sparkscribe.functions import text as tx

    c = F.col("c")
    rows = [(chr(i), f"{chr(i)}a{chr(i)} b{chr(i)}\n") for i in range(1, 0x3100)]
    df = spark.createDataFrame(rows, "x string, c string")
    assert df.where(tx.strip(c) != F.regexp_replace(c, rf"(?U)^{tx.SPACE}+|{tx.SPACE}+$", "")).collect() == []
    assert df.where(tx.strip(F.col("x")) == "").count() == len(tx.SPACES)


# TF-IDF


@pytest.mark.parametrize("shard,block", [(1 << 20, 128), (200, 2)])
def test_tfidf(spark, shard, block):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    text = lambda: " ".join(rng.choices(words, [1 / (i + 1) for i in range(40)], k=rng.randint(0, 30)))
    docs = [(i, text()) for i in range(200)] + [(900, None), (901, "W1 w1, w1"), (902, "w1 w1 w1")]
    queries = [(i, text()) for i in range(12)] + [(50, None), (51, "unknown words"), (52, "w1"), (53, "w39 w0 unknown")]
    tok = lambda t: Counter(re.findall(r"[a-z0-9]+", (t or "").lower()))
    df = Counter(t for _, x in docs for t in tok(x))
    weigh = lambda c: {t: n * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t, n in c.items()}
    unit = lambda w: {t: x / math.sqrt(sum(v * v for v in w.values())) for t, x in w.items()}
    vectors = {i: unit(weigh(tok(x))) for i, x in docs}
    want = []
    for q, x in queries:
        w = unit(weigh(tok(x)))
        s = sorted((-round(sum(w[t] * v[t] for t in w if t in v), 9), i) for i, v in vectors.items() if set(w) & set(v))[:5]
        want += [(q, r + 1, i) for r, (_, i) in enumerate(s)]
    kind = "{} long, text string, term string, key long"
    d, a = (spark.createDataFrame([(i, t, "x", 1) for i, t in rows], kind.format(n)) for rows, n in ((docs, "doc_id"), (queries, "item_id")))
    got = tfidf.tfidf_top_k(d.repartition(3), a, 5, id_col="doc_id", text_col="text", query_id="item_id", query_text="text", shard=shard, part=20 if shard == 200 else 1 << 17, block=block).collect()
    assert sorted((r.query_id, r["rank"], r.id) for r in got) == sorted(want)
    assert all(0 < r.scored <= r.postings for r in got)
    assert tfidf.tfidf_top_k(d.limit(0), a, 5, id_col="doc_id", text_col="text", query_id="item_id", query_text="text").collect() == []


def _shuffled(spark) -> int:
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def test_tfidf_shuffles_few_postings(spark):
    """200 documents with 300 words of their own draw from 2,000, and one word asked for: only that word's postings and rare ones move."""
    rng = random.Random(5)
    docs = [(i, " ".join(f"x{rng.randrange(2000)}" for _ in range(300)) + " asked" * (i % 3)) for i in range(200)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    before = _shuffled(spark)
    got = tfidf.tfidf_top_k(d, spark.createDataFrame([(1, "asked")], "item_id long, text string"), 3, id_col="doc_id", text_col="text", query_id="item_id", query_text="text").collect()
    assert len(got) == 3 and all(r.id % 3 == 2 for r in got)
    assert _shuffled(spark) - before < 500_000  # 264 KB here, with the draw of d; 774 KB when all postings moved


def test_tfidf_repeated_ids(spark):
    """Rows of one id are one document; those without an id count as one and are not found."""
    d = spark.createDataFrame([(1, "a b"), (1, "b c"), (None, "a"), (None, "b"), (2, "b"), (3, "c c d")], "doc_id long, text string")
    ask = lambda x: tfidf.tfidf_top_k(x, spark.createDataFrame([(1, "b c")], "item_id long, text string"), 5, id_col="doc_id", text_col="text", query_id="item_id", query_text="text").collect()
    n, df = 6, {"a": 2, "b": 3, "c": 2, "d": 1}
    unit = lambda c: {t: w / math.sqrt(sum(v * v for v in x.values())) for x in [{t: m * (math.log((1 + n) / (1 + df[t])) + 1) for t, m in c.items()}] for t, w in x.items()}
    q, vectors = unit({"b": 1, "c": 1}), {1: unit({"a": 1, "b": 2, "c": 1}), 2: unit({"b": 1}), 3: unit({"c": 2, "d": 1})}
    want = {i: round(sum(q[t] * v.get(t, 0) for t in q), 9) for i, v in vectors.items()}
    assert {r.id: round(r.score, 9) for r in ask(d)} == want


def test_early_stop_scores_fewer_postings():
    rng = np.random.default_rng(0)
    n = 20_000
    rare, common = np.arange(0, n, 400), np.arange(n)
    lists = tfidf.Postings(np.repeat([0, 1], [len(rare), n]), np.concatenate((rare, common)), np.concatenate((np.full(len(rare), 0.9), rng.uniform(0, 0.1, n))))
    docs, scores, scored = lists.search(np.array([0, 1, 7]), np.array([0.8, 0.3, 0.1]), 5, n)
    exact = np.zeros(n)
    exact[rare] += 0.8 * 0.9
    exact += 0.3 * lists.weight[lists.start[1] : lists.stop[1]]
    best = np.argsort(-exact)[:5]
    assert set(best) <= set(docs.tolist()) and np.allclose(exact[docs], scores) and scored < 200


def test_bm25_deals_pairs(spark):
    """40 documents and 5 queries are 200 pairs; at 10 a task, 20 tasks."""
    docs = spark.range(40).selectExpr("id", "concat('a b w', id % 7) AS text")
    asked = spark.range(5).selectExpr("id AS q", "concat('b w', id) AS text")
    run = lambda **bound: quality.bm25(docs, asked, 3, id_col="id", text_col="text", query_id="q", query_text="text", **bound)
    few = run(pairs_bound=10)
    assert re.search(r"hashpartitioning\(id#\d+L?, 20\)", few._jdf.queryExecution().executedPlan().toString())
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, run().collect()))


def test_scan_holds_few_scores(spark):
    """20,000 rows in one batch against 400 queries: 64 MB of scores if they were made at once."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    e, q, k = rng.normal(size=(20_000, 4)), rng.normal(size=(400, 4)), 5
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(e))), pa.array(np.arange(len(e), dtype=float)), pa.array(list(e))], ["_id", "_order", "_e"])
    scan = search._scan(spark, q.tolist(), k)
    tracemalloc.start()
    (got,) = scan([batch])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 50 << 20
    cosine = np.round((q / np.linalg.norm(q, axis=1, keepdims=True)) @ (e / np.linalg.norm(e, axis=1, keepdims=True)).T, 12)
    want = {(i, int(j)) for i in range(len(q)) for j in np.argsort(-cosine[i], kind="stable")[:k]}
    assert set(zip(got["_qi"].to_pylist(), got["_id"].to_pylist())) == want and got.num_rows == len(want)


def test_chunks_bound_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, str(1 << 30))
    chunking.build_chunks(spark.createDataFrame([("s", 1, "A page.")], "source_name string, page_num int, clean_text string"))
    assert int(spark.conf.get(key)) <= 8 << 20


# graph and patterns


def test_learning_path(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("x", "x"), ("a", None)]
    rows = [(s, "depends_on", t) for s, t in edges + edges[:2]] + [("a", "part_of", "z")]
    r = spark.createDataFrame(rows, "source_concept_id string, relation string, target_concept_id string")
    starts = spark.createDataFrame([("a",), ("a",), ("x",), ("q",), (None,)], "concept_id string")
    got = {tuple(x) for x in graph.learning_path(r, starts, most=3).collect()}
    assert got == {("a", "e", 3, 1), ("a", "d", 2, 2), ("a", "b", 1, 3), ("a", "c", 1, 4), ("a", "a", 0, 5), ("x", "x", 0, 1), ("q", "q", 0, 1)}
    assert graph.learning_path(r.limit(0), starts.limit(0)).collect() == []


def test_learning_path_holds_no_paths(spark):
    """Three full layers of 110: 1.3 million paths of a start, 331 rows."""
    r = spark.range(3 * 110 * 110).selectExpr("id div 12100 AS l", "id div 110 % 110 AS i", "id % 110 AS j")
    r = r.selectExpr("if(l = 0 and i > 0, 'a', concat(l, '-', i)) AS source_concept_id", "'depends_on' AS relation", "concat(l + 1, '-', j) AS target_concept_id").replace("0-0", "a", "source_concept_id")
    got = graph.learning_path(r, spark.createDataFrame([("a",)], "concept_id string"), most=3).groupBy("depth").count().collect()
    assert {tuple(x) for x in got} == {(0, 1), (1, 110), (2, 110), (3, 110)}


def test_learning_path_holds_no_pairs(spark, monkeypatch):
    """300 concepts of two edges each and six levels: 8,100 pairs, and no table between has more rows than there are edges."""
    rng, n, most, held = random.Random(4), 300, 6, []
    name = [f"c{x}" for x in rng.sample(range(1000), n)]
    to = {i: [(i + 1) % n, (i + 7) % n] for i in range(n)}
    keep = graph.staged
    monkeypatch.setattr(graph, "staged", lambda df: held.append(keep(df)) or held[-1])
    r = spark.createDataFrame([(name[i], "depends_on", name[j]) for i in to for j in to[i]], "source_concept_id string, relation string, target_concept_id string")
    got = {tuple(x) for x in graph.learning_path(r, r.selectExpr("source_concept_id AS concept_id"), most=most).collect()}
    want = set()
    for i in range(n):
        depth, level = {i: 0}, [i]
        for d in range(1, most + 1):
            level = sorted({j for x in level for j in to[x]} - set(depth))
            depth |= dict.fromkeys(level, d)
        want |= {(name[i], name[j], depth[j], k + 1) for k, j in enumerate(sorted(depth, key=lambda j: (-depth[j], name[j])))}
    assert got == want and len(want) > 8000
    assert max(x.count() for x in held) <= 2 * n


def test_expand_takes_the_first_edges_of_a_hub(spark):
    """A hub of 300 edges in 50 chunks: no join makes a row for each chunk and edge."""
    ideas = spark.range(300).selectExpr("format_string('c%03d', id) AS concept_id", "format_string('n%03d', id) AS name")
    r = ideas.selectExpr("'c000' AS source_concept_id", "'part_of' AS relation", "concept_id AS target_concept_id", "0.9D AS confidence")
    hits = spark.range(50).selectExpr("concat('d', id) AS chunk_id")
    got = graph.expand(hits, {"concepts": ideas, "relations": r, "mentions": hits.selectExpr("chunk_id", "'c000' AS concept_id")}, 8)
    rows = got.collect()
    assert len(rows) == 400 and {(x.edge_no, x.target_name) for x in rows} == {(i + 1, f"n{i:03}") for i in range(8)}
    metrics = re.findall(r"Join.*?numOutputRows=(\d+)", _metrics(got))
    assert metrics and max(map(int, metrics)) <= 400


def _metrics(df) -> str:
    """Each node of the plan that ran, with its rows."""
    plan, out = df._jdf.queryExecution().executedPlan(), []
    stack = [plan.executedPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan]
    while stack:
        p = stack.pop()
        if "QueryStage" in p.nodeName():
            stack.append(p.plan())
        rows = p.metrics().get("numOutputRows")
        out.append(f"{p.nodeName()} numOutputRows={rows.get().value() if rows.isDefined() else 0}")
        stack += [p.children().apply(i) for i in range(p.children().size())]
    return "\n".join(out)


def test_merge_nodes_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "concept_id string, n int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "concept_id string, n int")
    once = graph.merge_nodes(old, new, "concept_id")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, graph.merge_nodes(once, new, "concept_id").collect())) == [("a", 1), ("b", 3), ("c", 4)]


def test_pattern_relations(spark):
    text = "An MRI scanner is a Camera. The camera requires light; light and magnetic resonance imaging is used for diagnosis!\nCamera is a camera. is a camera. A camera is a"
    chunks = spark.createDataFrame([("c1", text), ("c2", None), ("c3", ""), ("c4", "light depends on camera " * 300)], "chunk_id string, chunk_text string")
    ideas = spark.createDataFrame([("MRI scanner", "m"), ("mri", "m0"), ("scanner", "s"), ("camera", "c"), ("light", "l"), ("Magnetic Resonance-Imaging", "r"), ("imaging", "i"), ("diagnosis", "d"), ("", "e"), ("x", None), ("camera", "c")], "phrase string, concept_id string")
    got = [tuple(r) for r in patterns.pattern_relations(chunks, ideas).orderBy("chunk_id", "sentence", "at").collect()]
    assert [g for g in got if g[0] == "c1"] == [
        ("c1", 0, 3, "m", "is_a", "c", "mri scanner is a camera"),
        ("c1", 1, 2, "c", "depends_on", "l", "camera requires light"),
        ("c1", 1, 9, "r", "used_for", "d", "magnetic resonance imaging is used for diagnosis"),
    ]
    assert len([g for g in got if g[0] == "c4"]) == 300 and {g[3:6] for g in got if g[0] == "c4"} == {("l", "depends_on", "c")}
    assert patterns.pattern_relations(chunks, ideas.limit(0)).collect() == [] and patterns.pattern_relations(chunks.limit(0), ideas).collect() == []
    # phrases are looked up in place: what is shuffled are the hits and the sentences, each once
    df = patterns.pattern_relations(chunks, ideas)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "BroadcastHashJoin [phrase" in plan and plan.count("hashpartitioning(chunk_id") == 2


# pages and reports


def test_page_flags(spark):
    pages = [("s", i, f"Head\n\nbody {i}\n  {i}  \nFoot") for i in range(3)] + [("s", 10, None), ("s", 11, ""), ("s", 12, "Head"), ("s", 13, "12 34"), ("s", 14, "!?? a"), ("t", 0, "Head\nx"), (None, 1, "N\na"), (None, 2, "N\nb"), (None, 3, "N\nc")]
    df = spark.createDataFrame([(*p, "z") for p in pages], "source_name string, page_num int, raw_text string, line string")
    lines = {tuple(r) for r in quality.edge_lines(df).collect()}
    assert lines == {("s", "Head", 4), ("s", "Foot", 3), (None, "N", 3)}
    got = {(r.source_name, r.page_num): (r.body, r.removed, round(r.symbol_ratio, 6), r.numeric_only) for r in quality.page_flags(df).collect()}
    assert len(got) == len(pages)
    assert got["s", 1] == ("\nbody 1\n  1  ", 2, 0, False) and got["s", 10] == got["s", 11] == ("", 0, 0, False) and got["s", 12] == ("", 1, 0, False)
    assert got["s", 13] == ("12 34", 0, 0, True) and got["s", 14] == ("!?? a", 0, 0.6, False) and got["t", 0] == ("Head\nx", 0, 0, False) and got[None, 2] == ("b", 1, 0, False)
    assert quality.page_flags(df.limit(0)).collect() == [] and quality.edge_lines(df.limit(0)).collect() == []


def test_corpus_report(spark):
    docs = spark.createDataFrame([(1, "abc", "en", "a"), (2, None, None, "a"), (3, "x", "en", None)], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int")
    got = {tuple(r)[:4]: tuple(r)[4:] for r in quality.corpus_report(docs, labels).collect()}
    assert got[7, None, None, None] == (3, 4, 3) and got[3, "a", None, None] == (2, 3, 3) and got[3, None, None, None] == (1, 1, 1) and got[0, "a", None, None] == (1, 0, 0)
    assert quality.corpus_report(docs.limit(0), labels).collect() == []


# as-of join


@pytest.mark.parametrize("ranges", [1, 3, 25])
def test_as_of(spark, ranges):
    rng = random.Random(ranges)
    day = dt.datetime(2024, 1, 1)
    at = lambda m: day + dt.timedelta(minutes=m)
    left = [(i, rng.choice(["hot", "hot", "a", "b", None]), at(rng.randint(0, 300)) if rng.random() < 0.95 else None) for i in range(300)]
    right = [(i, rng.choice(["hot", "hot", "hot", "b", "c", None]), at(rng.randint(0, 300)) if rng.random() < 0.9 else None) for i in range(200)]
    a, b = (spark.createDataFrame(x, "id int, k string, t timestamp") for x in (left + left[:5], right))
    for within, most in ((None, 10**9), ("20 MINUTES", 20)):
        got = as_of(a.repartition(3), b, "k", "t", tie="id", ranges=ranges, within=within).collect()
        want = []
        for i, k, t in left + left[:5]:
            fit = [(u, j) for j, m, u in right if k is not None and t is not None and m == k and u is not None and u <= t]
            best = max(fit, default=None)
            want.append((i, best[1] if best and (t - best[0]).total_seconds() <= most * 60 else None))
        assert Counter((r.id, r.found and r.found.id) for r in got) == Counter(want)
    assert as_of(a.limit(0), b, "k", "t", tie="id").collect() == [] and all(r.found is None for r in as_of(a, b.limit(0), "k", "t", tie="id").collect())


# learned ranking


def test_learned_ranking(spark):
    rng = np.random.default_rng(4)
    rows = []
    for q in range(40):
        for i in range(12):
            x = rng.normal(size=3)
            rows.append((q, i, x.tolist(), bool(x @ [2.0, -1.0, 0.0] + rng.normal() * 0.5 > 0), 6, i + 1))
    rows += [(None, 1, [1.0, 1.0, 1.0], True, 1, 1), (3, 99, None, True, 1, 1), (4, 99, [0.0, 0.0, 0.0], None, 1, 1)]
    df = spark.createDataFrame(rows, "query_id long, id long, x array<double>, relevant boolean, total_relevant long, place int")
    ranked, weights = ranking.cross_ranked(df, 3, 4)
    got = ranked.collect()
    assert len(got) == 480
    fold = {r.query_id: r.f for r in spark.range(40).select(F.col("id").alias("query_id")).withColumn("f", ranking.fold_of(4)).collect()}
    for f, w in enumerate(weights):  # the gradient of the training folds vanishes there
        d = np.array([np.subtract(a[2], b[2]) for a in rows for b in rows if a[0] is not None and a[0] == b[0] and fold[a[0]] != f and a[3] and b[3] is False and a[2] and b[2]])
        assert np.abs(w - d.T @ (1 / (1 + np.exp(d @ w)))).max() < 1e-6
    for r in got:
        assert r.score == pytest.approx(float(np.dot(r.x, weights[fold[r.query_id]])))
    m = {r.ranker: r for r in ranking.compare({"plain": df.where("x is not null and relevant is not null and query_id is not null").withColumn("rank", F.col("place")), "learned": ranked}, 5).collect()}
    assert m["learned"].precision > m["plain"].precision + 0.2
    assert ranking.cross_ranked(df.limit(0), 3)[0].collect() == []


# sketches and streams


def test_sketches(spark):
    rows = [(i % 3, i % 7, i % 1000, float(i)) for i in range(30_000)] + [(None, 1, None, None), (9, 1, None, None)]
    df = spark.createDataFrame(rows, "kind int, day int, item int, value double")
    stored = sketches.states(df, ["kind", "day"], "item", "value")
    got = {r.kind: r for r in sketches.estimates(sketches.merged(stored, ["kind"])).collect()}
    for kind in range(3):
        assert got[kind].n == 10_000 and abs(got[kind].n_items - 1000) <= sketches.DISTINCT_ERROR * 1000
        values = np.array([v for k, _, _, v in rows if k == kind])
        assert abs((values <= got[kind].q50).mean() - 0.5) <= sketches.RANK_ERROR and abs((values <= got[kind].q90).mean() - 0.9) <= sketches.RANK_ERROR
    assert (got[None].n, got[None].n_items, got[None].q50) == (1, 0, None) and got[9].q90 is None
    assert sketches.estimates(sketches.states(df.limit(0), ["kind"], "item", "value")).collect() == []


def test_sessions_over_a_restart(spark):
    rng = random.Random(6)
    day = dt.datetime(2024, 1, 1)
    rows = [(i, day + dt.timedelta(seconds=rng.randint(0, 86_400)), rng.choice([1, 2, 3, None]), rng.choice([1.5, None])) for i in range(300)] + [(999, None, 1, 1.0)]
    schema = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, value DOUBLE"
    folder, out, checkpoint = (scratch(spark) for _ in range(3))
    files = [rows[i::5] for i in range(5)]  # times overlap: out of order
    for part in files[:3]:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    windows.run_sessions(spark, folder, schema, out, checkpoint, late="2 days", files_per_trigger=1)
    for part in files[3:]:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    windows.run_sessions(spark, folder, schema, out, checkpoint, late="2 days", files_per_trigger=1)  # started again
    windows.close_sessions(spark, folder, schema, day + dt.timedelta(days=9))
    windows.run_sessions(spark, folder, schema, out, checkpoint, late="2 days")
    late = [(1000, day, 2, 5.0)]  # older than the watermark: dropped
    spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(folder)
    windows.run_sessions(spark, folder, schema, out, checkpoint, late="2 days")
    got = sorted(map(str, spark.read.parquet(out).collect()))
    want = sorted(map(str, windows.sessions(spark.createDataFrame(rows, schema)).collect()))
    assert got == want and len(want) > 20


def test_policies_over_a_restart(spark):
    rng = random.Random(8)
    start = dt.datetime(2024, 1, 1)
    schema = "event_id BIGINT, ts TIMESTAMP, policy STRING, x ARRAY<DOUBLE>, r DOUBLE"
    row = lambda i, day, policy: (i, start + dt.timedelta(days=day, seconds=rng.randint(0, 80_000)), policy, [1.0, rng.random(), rng.random()], rng.random())
    early = [row(i, 0, rng.choice(["hot", "hot", "hot", "b", None])) for i in range(300)]
    early += [(900, start, "hot", None, 1.0), (901, start, "hot", [1.0, None, 1.0], 1.0), (902, start, "hot", [1.0, 1.0], 1.0), (903, start, "b", [1.0, float("nan"), 1.0], 1.0), (904, None, "b", [1.0, 1.0, 1.0], 1.0), (905, start, "only bad", [1.0, 1.0, 1.0], None)]
    mover = [row(999, 9, "b")]  # its time runs out the timers of the first day
    again = [row(i, 9, "hot") for i in range(1000, 1050)]  # a new part
    folder, out, checkpoint = (scratch(spark) for _ in range(3))
    options = {"dim": 3, "shards": 4, "late": "2 days"}
    rng.shuffle(early)
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    run = lambda: policies.run_policies(spark, folder, schema, out, checkpoint, files_per_trigger=1, **options)
    write(early[:200])
    run()
    write(early[200:])
    run()  # started again in mid-stream
    assert spark.read.schema(policies.PART).parquet(out).count() == 0  # no timer has run out
    write(mover)
    run()
    assert spark.read.schema(policies.PART).parquet(out).where("policy = 'hot'").count() == 4
    write(again)
    run()
    windows.close_sessions(spark, folder, schema, start + dt.timedelta(days=30))
    run()
    parts = spark.read.schema(policies.PART).parquet(out)
    assert parts.where("policy = 'hot'").groupBy("shard").count().where("count = 2").count() == 4  # two parts a shard
    got = policies.models(parts, dim=3)
    good = [r for r in early + mover + again if r[0] < 900 or r[0] >= 999]
    assert set(got) == {"hot", "b", None}
    assert {r.policy: r.n for r in policies.policy_sums(parts, 3).collect()} == {p: sum(r[2] == p for r in good) for p in got}
    for p, model in got.items():
        want = bandit.LinUCB(3)
        for r in good:
            if r[2] == p:
                want.update(r[3], r[4])
        assert np.allclose(model.A, want.A) and np.allclose(model.b, want.b)


def test_bad_lines(spark, tmp_path):
    lines = [f'{{"k": {i}}}' for i in range(4000)]
    for i, text in {5: "", 6: "{oops", 2999: "[", 3999: '{"k": "x"}'}.items():
        lines[i] = text
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.jsonl").write_text('\n \n{"k": null}\n{}\nnull\n7')
    (tmp_path / "c.jsonl").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # many blocks a file
    try:
        got = files.bad_lines(spark, str(tmp_path), "k BIGINT").collect()
        with pytest.raises(ValueError, match="a.jsonl, line 7"):
            files.checked_jsonl(spark, str(tmp_path), "k BIGINT")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.file[-7:], r.line_no, r.line) for r in got) == [("a.jsonl", 7, "{oops"), ("a.jsonl", 3000, "["), ("a.jsonl", 4000, '{"k": "x"}'), ("b.jsonl", 5, "null"), ("b.jsonl", 6, "7")]
    assert files.checked_jsonl(spark, str(tmp_path / "c.jsonl"), "k BIGINT").collect() == []


def test_report_reads_whole_texts(spark, tmp_path):
    """The query's words stand after 2,000 characters of others: each reward is 1 and a little noise."""
    rows = [(i, "zzz " * 500 + f"alpha beta gamma {i}", "en", "s") for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.policy: r.snips for r in QUERIES["ope_report"](spark, str(tmp_path)).collect()}
    assert set(got) == {"retrieval", "random", "linucb"} and min(got.values()) > 0.9
    assert QUERIES["replay_log"](spark, str(tmp_path)).agg(F.max("reward")).first()[0] < 0.3  # as its SQL has it: the first 1,500
