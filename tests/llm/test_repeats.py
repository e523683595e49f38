"""The exact dedup operators against brute force, with the paths for frequent anchors and split blocks forced."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sparkscribe.llm import repeats
from sparkscribe.llm.substring_dedup import remove_substrings
from sparkscribe.llm.suffix_dedup import remove_repeats

SCHEMA = "doc_id long, text string, extra string, th string"


def corpus(seed: int, n: int = 60) -> list:
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(300)]
    words = lambda k: " ".join(rng.choices(vocab, k=k))
    shared, line = words(90), words(30)
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.2 and rows:
            t = rng.choice(rows)[1] or ""
        elif kind < 0.5 and rows:
            w = (rng.choice(rows)[1] or "").split()
            for _ in range(2):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocab)
            t = "  ".join(w)
        else:
            t = words(rng.randint(0, 250))
        if rng.random() < 0.5:
            t = f"{t}\n{line} {words(rng.randint(0, 60))}"
        if rng.random() < 0.4:
            t = f"{words(5)} {shared}\t{t}"
        rows.append((i, t, "x", "y"))
    rows += [(n, None, None, None), (n + 1, "", "", ""), (n + 2, "ab" * 300, "", ""), (None, shared, "", ""), (None, shared, "", ""), (3, rows[3][1], "x", "y")]
    rng.shuffle(rows)
    return rows


def spans(covered: list[bool]) -> int:
    return sum(b and not a for a, b in zip([False, *covered], covered))


def order_key(i):
    return (1 << 63) - 1 if i is None else i


def brute_bytes(rows, window=100):
    docs = {(order_key(i), (t or "").encode()) for i, t, *_ in rows}
    first, out = {}, {}
    for i, b in sorted(docs):
        for s in range(len(b) - window + 1):
            first.setdefault(b[s : s + window], (i, b, s))
    for i, b in docs:
        cov = [False] * len(b)
        for s in range(len(b) - window + 1):
            fi, fb, fs = first[b[s : s + window]]
            if fi < i or (fi == i and fb == b and fs < s):
                cov[s : s + window] = [True] * window
            elif fi == i and fb != b:
                cov = None
                break
        out[i, b] = cov
    return out


#: Thresholds of listed anchors, bytes of a shard, bytes of shards merged at once, elements of a piece, and whether all text is routed to one group.
SETTINGS = [(8192, 1 << 20, 1 << 18, 1 << 16, False), (3, 3000, 1 << 18, 1 << 16, False), (3, 2000, 500, 300, False), (8192, 1 << 24, 1 << 18, 1 << 16, True), (8192, 4000, 3000, 1 << 16, True)]


def settings(monkeypatch, hot, shard, merge, piece, one):
    for name, value in (("HOT", hot), ("SHARD_BYTES", shard), ("MERGE_BYTES", merge), ("PIECE", piece)):
        monkeypatch.setattr(repeats, name, value)
    if one:
        monkeypatch.setattr(repeats, "_shards", lambda regions, *rest, real=repeats._shards: real(regions.withColumn("m", F.lit(7).cast("long")), *rest))


@pytest.mark.parametrize("hot,shard,merge,piece,one", SETTINGS)
def test_bytes(spark, monkeypatch, hot, shard, merge, piece, one):
    settings(monkeypatch, hot, shard, merge, piece, one)
    rows = corpus(1)
    want = brute_bytes(rows)
    got = remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(5), texts=True, keep=("extra",)).collect()
    assert len(got) == len(rows)
    for r in got:
        texts = [t for i, t, *_ in rows if i == r.doc_id and len((t or "").encode()) == r.n_bytes]
        ok = False
        for t in texts:
            b = (t or "").encode()
            cov = want[order_key(r.doc_id), b]
            kept = bytes(x for x, c in zip(b, cov) if not c)
            ok |= (r.n_removed, r.n_spans, r.kept_sha256) == (sum(cov), spans(cov), hashlib.sha256(kept).hexdigest())
        assert ok, r


@pytest.mark.parametrize("hot,shard,merge,piece,one", SETTINGS)
def test_words(spark, monkeypatch, hot, shard, merge, piece, one):
    settings(monkeypatch, hot, shard, merge, piece, one)
    rows = corpus(2)
    words = {(order_key(i), t): (t or "").encode().split() for i, t, *_ in rows}
    first = {}
    for (i, t), w in sorted(words.items(), key=lambda x: x[0][0]):
        for s in range(len(w) - 49):
            first.setdefault(tuple(w[s : s + 50]), i)
    want = []
    for i, t, *_ in rows:
        w = words[order_key(i), t]
        cov = [False] * len(w)
        for s in range(len(w) - 49):
            if first[tuple(w[s : s + 50])] < order_key(i):
                cov[s : s + 50] = [True] * 50
        want.append((i, len(w), sum(cov), hashlib.sha256(b" ".join(x for x, c in zip(w, cov) if not c)).hexdigest()))
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in remove_substrings(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert sum(w[2] for w in want) > 500


def test_frequent_phrase(spark, monkeypatch):
    """A phrase shorter than a window between words of a small vocabulary: its group shrinks little, so it is dealt by rare grams."""
    settings(monkeypatch, 8192, 4000, 6000, 1 << 16, True)
    asked = []
    real = repeats.seen_more
    monkeypatch.setattr(repeats, "seen_more", lambda packed, parts, slots, least=2: asked.append(least) or real(packed, parts, slots, least))
    draw = random.Random(5)
    vocabulary = ["".join(draw.choices("abcdefgh", k=7)) for _ in range(12)]
    phrase = "all of these words stand in the very same order in each text here, " + "x" * 20
    rows = [(i, " ".join([*draw.choices(vocabulary, k=9), phrase, *draw.choices(vocabulary, k=9)]), "", "") for i in range(500)]
    got = remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    want = brute_bytes(rows)
    assert {r.doc_id: r.n_removed for r in got} == {i: sum(want[i, t.encode()]) for i, t, *_ in rows}
    assert sum(r.n_removed for r in got) > 5000
    assert 30 in asked


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert remove_repeats(empty).count() == 0
    assert remove_substrings(empty).count() == 0
    short = spark.createDataFrame([(1, "a b", "", ""), (2, None, "", "")], SCHEMA)
    assert {(r.doc_id, r.n_bytes, r.n_removed) for r in remove_repeats(short).collect()} == {(1, 3, 0), (2, 0, 0)}
