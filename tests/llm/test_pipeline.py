"""The pipeline's stages against brute force, each on the rows its predecessor kept."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from sparkscribe.llm.decontaminate import words_of  # noqa: E402
from tests.llm.test_operators import expected_targets, slow_components, slow_fingerprint  # noqa: E402
from tests.llm.test_repeats import brute_bytes  # noqa: E402


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    vocab = ["".join(rng.choices("abcdeé", k=rng.randint(2, 6))) for _ in range(400)]
    say = lambda n: " ".join(rng.choices(vocab, k=n))
    rows, passage, item = [], say(60), " ".join(rng.choices([w for w in vocab if w.isascii()], k=14))
    for i in range(80):
        t = say(rng.randint(1, 200))
        if i % 5 == 0:
            t += " " + passage
        if i % 7 == 0:
            t += " " + item.upper() + " " + say(10)
        rows.append((i, t, "xx", rng.choice(["a", "b", None]), len(t)))
    rows += [(80, None, "xx", "a", None), (81, "", "xx", "a", 0), (82, "123 456", "xx", "b", 7), (83, rows[10][1], "xx", "b", 0), (84, rows[11][1] + " more", None, "b", 0), (10, rows[10][1], "xx", "a", 5)]
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, corpus, tmp_path):
    docs, kept = spark.read.parquet(f"{corpus}/documents.parquet"), []
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, corpus).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs.collect(), spark.read.parquet(f"{tmp_path}/{k}")
        after = docs.collect()
        if k < 4:
            assert sorted(docs.columns) == sorted(columns)
        kept.append((before, after))
    before, after = kept[0]
    assert sorted(str(r.doc_id) for r in after) == sorted(str(r.doc_id) for r in before if r.doc_id not in (80, 81, 82))
    before, after = kept[1]
    root = slow_components(slow_fingerprint(r.text) for r in before)
    groups = {}
    for r in before:
        groups.setdefault(root[slow_fingerprint(r.text)], []).append(r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(min(g) for g in groups.values())
    before, after = kept[2]
    cov = brute_bytes([(r.doc_id, r.text) for r in before])
    want = {r.doc_id: bytes(b for b, c in zip(r.text.encode(), cov[r.doc_id, r.text.encode()]) if not c).decode("utf-8", "ignore") for r in before}
    assert {r.doc_id: r.text for r in after} == want and all(r.n_chars == len(r.text) for r in after)
    assert any(len(want[r.doc_id]) < len(r.text) for r in before)
    before, after = kept[3]
    item = words_of(spark.read.parquet(f"{corpus}/benchmark.parquet").first().text.encode())
    found = lambda t: any(words_of(t.encode())[i : i + 10] == item[j : j + 10] for i in range(len(words_of(t.encode())) - 9) for j in range(len(item) - 9))
    assert any(found(r.text) for r in before) and len(after) == len(before)
    texts = {r.doc_id: r.text for r in after}
    for r in before:
        assert texts[r.doc_id] == r.text if not found(r.text) else len(texts[r.doc_id]) < len(r.text)
    before, after = kept[4]
    sizes = {}
    for r in before:
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    want = expected_targets(sizes)
    assert all(r.target == pytest.approx(want[r.source]) and r.taken <= 3 * r.size for r in after) and len(after) == len(before)


def test_run(spark, corpus):
    assert corpus_pipeline.run(spark, corpus).count() > 0
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (None, None, None, None, None)], [(1, "", "xx", "a", 0), (1, "", "xx", "a", 0), (None, "x", None, None, 1), (2, "12", "xx", "b", 2)]])
def test_stages_on_small_tables(spark, tmp_path, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path))
        kept = got.collect()
        assert len(kept) <= len(rows)
        if name not in ("language ID", "SimHash near-dedup"):
            assert len(kept) == len(rows)
        if name != "mixing to target weights":
            assert sorted(got.columns) == sorted(docs.columns)
    corpus_pipeline.run(spark, str(tmp_path)).count()
