"""URL filters, phrase collocations and whitening against brute force, with their edge cases."""

import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from sparkscribe.llm import phrases, url_filters, whitening

# URL filters


def judged(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url is not None and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else default


URLS = [
    None, "", "no scheme", "http://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/x?q=/fr/#y", "http://example.com/en/", "http://a.b.example.com/en/z", "http://notexample.com/en/",
    "http://net/es/", "http://x.net/es", "http://x.net/fr/?a", "http://x.net#/fr/", "http://example.com.", "http://.com/", "http://a..com/", "x://y://com/", "http://éx.com/en/ü\n/x", "http://user@Example.com:80/en/",
    "http://" + "a." * 3000 + "com/" + "p" * 20000, "http://x.net/es/" + "é" * 5000,
]
RULE = "host string, path string, verdict string"


@pytest.mark.parametrize("ranges", [1, 5, 40])
def test_url_filters(spark, ranges):
    rng = random.Random(ranges)
    rules = list(url_filters.RULES) + [("b.com", "", "block"), ("com", "/x", "block"), ("com", "/x/y/z/long/path", "allow"), ("", "/", "block"), ("a.b.com", "/x/", "allow"), ("org", "/é", "block")]
    urls = URLS + ["http://" + ".".join(rng.choice(["a", "b", "example", "www"]) for _ in range(rng.randint(0, 3))) + rng.choice([".com", ".net", "com", ".org", ""]) + rng.choice(["", "/", "/x", "/x/y", "/x/y/z/long/path/q", "/en/", "/es/a", "/é/", "/é"]) for _ in range(400)]
    urls += ["http://www.b.com/x/y"] * 300
    rows = [(i % 350 or None, u, "clash", "clash", 1, 2) for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string, row int, range int")
    got = url_filters.judge(pages.repartition(3), spark.createDataFrame(rules + rules[:2] + [(None, "/", "block"), ("net", None, "block")], RULE), ranges=ranges)
    want = [(r[0], *judged(r[1], rules)) for r in rows]
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_url_filters_default_and_empty(spark):
    pages = spark.createDataFrame([(1, "http://x.org/a"), (2, None)], "page_id long, url string")
    none = spark.createDataFrame([], RULE)
    assert sorted(map(tuple, url_filters.judge(pages, none, default="block").collect())) == [(1, "x.org", "/a", None, "block"), (2, "", "", None, "block")]
    assert sorted(map(tuple, url_filters.judge(pages, url_filters.rule_table(spark), default="block").collect())) == [(1, "x.org", "/a", None, "block"), (2, "", "", None, "block")]
    assert url_filters.judge(pages.limit(0), url_filters.rule_table(spark)).collect() == []
    both = spark.createDataFrame([("org", "/", "allow"), ("ORG", "/", "block")], RULE)
    assert {(r.page_id, r.rule, r.verdict) for r in url_filters.judge(pages, both).collect()} == {(1, "org/", "block"), (2, None, "allow")}


def test_url_filters_are_native(spark):
    plan = url_filters.judge(spark.createDataFrame([(1, "http://x.org/a")], "page_id long, url string"), url_filters.rule_table(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


# phrases


def lists_of(rows, least, longest):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, longest + 1):
                for i in range(len(w) - size + 1):
                    f[lang, tuple(w[i : i + size])] += 1
    return {k: v for k, v in f.items() if v >= least}, n


def collocated(rows, least=30, longest=4, first=2000):
    f, n = lists_of(rows, least, longest)
    out = []
    inner = {}
    for (lang, p), a in f.items():
        for size in range(2, len(p)):
            for i in range(len(p) - size + 1):
                key = lang, p[i : i + size]
                inner[key] = max(inner.get(key, 0), a)
    for (lang, p), a in f.items():
        if len(p) < 2 or 100 * inner.get((lang, p), -1) >= 80 * a:
            continue
        score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(r[0], i + 1, *r[1:]) for i, r in enumerate(own[:first])]
    return ranked


def texts(seed, n=60):
    rng = random.Random(seed)
    words = ["the", "The", "of", "ab", "über", "x", "New", "york", "city", "a-b", "日本"]
    gap = [" ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " \t "]
    rows = [("".join(rng.choice(words) + rng.choice(gap) for _ in range(rng.randint(0, 80))), rng.choice(["en", "en", "fr", None, "und"])) for _ in range(n)]
    rows += [("new york city hall  .  ", "en")] * 40 + [("one two\tthree four five", "fr")] * 35
    return rows + [(None, "en"), ("", None), ("...", "fr"), (" \t ", "en"), ("word " * 300, "en"), ("w" * 5000, "en"), ("q r s t. " * 90, None)]


@pytest.mark.parametrize("block", [5, 64, 1 << 20])
def test_phrases(spark, block):
    rows = texts(block)
    docs = spark.createDataFrame([(t, l, 1, "p", 2) for t, l in rows], "text string, lang string, f int, phrase string, size int")
    found = phrases.frequent_phrases(docs.repartition(3), block=block)
    want, n = lists_of(rows, 30, 4)
    got = {(r.lang, r.phrase, r["size"]): r.f for r in found.collect()}
    assert got == {(l, " ".join(p), len(p)): c for (l, p), c in want.items()} | {(l, None, 0): c for l, c in n.items() if c}
    for first in (3, 2000):
        assert sorted(tuple(r) for r in phrases.collocations(found, first=first).collect()) == sorted(collocated(rows, first=first))


def test_phrases_empty_and_rare(spark):
    kind = "text string, lang string"
    for rows in ([], [(None, None)], [("a b c", "en")] * 29):
        assert phrases.collocations(phrases.frequent_phrases(spark.createDataFrame(rows, kind))).collect() == []


def test_scores_beyond_64_bits(spark):
    big = 1 << 61
    f = spark.createDataFrame([("en", None, 0, big), ("en", "a", 1, big), ("en", "b", 1, big - 1), ("en", "a b", 2, big - 3)], "lang string, phrase string, size int, f long")
    assert [tuple(r) for r in phrases.collocations(f).collect()] == [("en", 1, "a b", big - 3, big, big - 1, big, 2_000_000 * (big - 3) // (2 * big - 1))]


def test_full_bitmap_changes_nothing(spark, monkeypatch):
    rows = texts(5)
    docs = spark.createDataFrame(rows, "text string, lang string")
    want = sorted(tuple(r) for r in phrases.collocations(phrases.frequent_phrases(docs)).collect())
    monkeypatch.setattr(phrases, "MOST_BITS", 64)
    assert sorted(tuple(r) for r in phrases.collocations(phrases.frequent_phrases(docs)).collect()) == want


# whitening


def whitened(x, k=4):
    """n, sums, values, components, trace in rational arithmetic up to the eigen-solve."""
    fit = sorted(set(map(tuple, x)))
    n, dim = len(fit), len(fit[0])
    sums = [sum(r[i] for r in fit) for i in range(dim)]
    d = [[n * r[i] - sums[i] for i in range(dim)] for r in fit]
    v = [[Fraction(sum(r[i] * r[j] for r in d), n**3) for j in range(dim)] for i in range(dim)]
    values, vectors = np.linalg.eigh(np.array([[float(c) for c in row] for row in v]))
    return n, sums, values[::-1][:k], vectors[:, ::-1][:, :k], float(sum(v[i][i] for i in range(dim)))


VECTOR = "vec_id long, embedding array<float>, x int, n string"


@pytest.mark.parametrize("scale", [0.3, 50.0])
def test_whitening(spark, scale):
    rng = np.random.default_rng(3)
    base = (rng.normal(size=(300, 9)) * np.linspace(3, 0.5, 9) * scale + scale).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(1000 + i, base[7].tolist()) for i in range(200)]
    bad = [(2000, None), (2001, []), (2002, [1.0] * 8 + [None]), (2003, [1.0] * 8 + [float("nan")]), (2004, [float("-inf")] + [1.0] * 8), (2005, [3e38] * 9)]
    rows += [(None, base[8].tolist())]
    df = spark.createDataFrame([(i, v, 1, "z") for i, v in rows + bad], VECTOR)
    got = whitening.whiten(df.repartition(5)).collect()
    x = {i: [int(np.floor(256.0 * float(c))) for c in v] for i, v in rows}
    n, sums, values, vectors, trace = whitened(list(x.values()))
    assert n == 300 and len(got) == 4 * len(rows)
    sign = {}
    for r in got:
        d = [n * c - s for c, s in zip(x[r.vec_id], sums)]
        assert r.n == n and r.deviation == sum(c * c for c in d)
        c = r.component - 1
        want = float(np.dot(np.array([float(Fraction(v, n)) for v in d]), vectors[:, c]) / np.sqrt(values[c]))
        sign.setdefault(c, 1 if want * r.whitened >= 0 or abs(want) < 1e-9 else -1)
        assert r.whitened * sign[c] == pytest.approx(want, abs=1e-9)
        assert r.explained == pytest.approx(values[c] / trace, rel=1e-9) and r.identity_error < 1e-10


def test_whitening_degenerate(spark):
    def run(vectors):
        return whitening.whiten(spark.createDataFrame([(i, v, 1, "z") for i, v in enumerate(vectors)], VECTOR)).orderBy("vec_id", "component").collect()

    assert run([]) == [] and run([None, []]) == []
    one = run([[1.0, 2.0]] * 3)
    assert len(one) == 6 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained == 0 and r.identity_error is None for r in one)
    line = run([[float(i), 0.0, 0.0] for i in range(5)])
    assert {r.component for r in line} == {1, 2, 3} and all((r.whitened is None) == (r.component > 1) for r in line) and line[0].explained == pytest.approx(1)
    mixed = run([[1.0], [2.0], [4.0], [1.0, 2.0], [5.0, 3.0], [0.0, 0.0]])
    assert [r.component for r in mixed] == [1, 1, 1, 1, 2, 1, 2, 1, 2] and all(r.n == 3 for r in mixed)
    with pytest.raises(Exception, match="leaves 64 bits"):
        run([[1e14, 0.0], [-1e14, 1.0], [5.0, 2.0]])


def test_outer_sums_are_exact():
    rng = np.random.default_rng(1)
    for bits in (3, 20, 21, 40, 61):
        d = rng.integers(-(1 << bits), 1 << bits, (3000, 4), dtype=np.int64)
        high, low = whitening.outer_sums(d)
        for i in range(4):
            for j in range(4):
                exact = sum(int(a) * int(b) for a, b in zip(d[:, i], d[:, j]))
                assert abs(Fraction(high[i, j]) + Fraction(low[i, j]) - exact) <= Fraction(abs(exact), 1 << 98) + Fraction(1 << 2 * bits, 1 << 80)


def test_double_double_parts_merge(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(400, 6)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 1, "z") for i, v in enumerate(base)], VECTOR)
    models = [whitening.fit_whitening(whitening.whole_vectors(df.repartition(p), "vec_id", "embedding").select("x").distinct().repartition(p)) for p in (1, 7)]
    assert np.allclose(models[0][6].values, models[1][6].values, rtol=1e-14) and models[0][6].identity_error < 1e-12
