"""The corpus operators against brute force, round trips and held-out rows, with their edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkscribe.llm import components, decontaminate, html_text, language, mixing, queries, simhash, token_counts, topk, toxicity

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, key string, size long, th string, _text string"


def docs(spark, rows):
    """(doc_id, text, source) rows with columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, "en", s, 1, "k", 5, "x", "y") for i, t, s in rows], DOC)


EDGE = [(1, None, "b"), (2, "", "b"), (3, "a b c", None), (3, "a b c", None), (None, "x", "a"), (5, "word " * 5000, "a"), (6, "w1 w2", "ä"), (7, "\t\n", "a"), (8, "one two three four", "c")]


# mixing


def expected_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), sum(sizes.values())
    while free:
        total = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total > cap * sizes[s]]
        if not over:
            return target | {s: left * w[s] / total for s in free}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
            free.discard(s)
    return target


@pytest.mark.parametrize("seed", [0, 1])
def test_mixing(spark, seed):
    rng = random.Random(seed)
    rows = EDGE + [(100 + i, "w " * rng.randint(0, 60), rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(300)]
    got = mixing.mix_sources(docs(spark, rows), buckets=16).collect()
    again = mixing.mix_sources(docs(spark, rows).repartition(3), buckets=16).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, again))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = expected_targets(sizes)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in taken.items():
        assert abs(t - want[s]) < 1
    assert mixing.mix_sources(docs(spark, [])).count() == 0
    assert {r.taken for r in mixing.mix_sources(docs(spark, [(1, None, "a"), (2, "", "b")])).collect()} == {0}


# SimHash


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    keys = sorted(set(prints))
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    return {k: find(k) for k in keys}


@pytest.mark.parametrize("bucket", [64, 1])
def test_links(spark, bucket):
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(40)} | {0}
    for _ in range(200):
        p = rng.choice(sorted(prints))
        for _ in range(rng.randint(1, 4)):
            p ^= 1 << rng.randrange(64)
        prints.add(p)
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    found = components.components(simhash.links(spark.createDataFrame([(s,) for s in signed.values()], "fp long"), bucket)).collect()
    roots = {r.node: r.root for r in found}
    want, groups = slow_components(prints), {}
    for p in prints:
        groups.setdefault(want[p], set()).add(signed[p])
    for members in groups.values():
        assert len({roots.get(m, m) for m in members}) == 1
    assert len({roots.get(s, s) for s in signed.values()}) == len(groups)


def test_near_duplicates(spark):
    rng = random.Random(6)
    base = [" ".join(rng.choices(["Alpha", "beta", "gÄmma", "delta", "eps", "zeta"], k=rng.randint(1, 400))) for _ in range(30)]
    rows = EDGE + [(20 + i, t, "a") for i, t in enumerate(base)] + [(60 + i, t.replace("eps", "EPS", 1) + " tail", "a") for i, t in enumerate(base)] + [(100 + i, base[0], "a") for i in range(5)]
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    want = {t: slow_fingerprint(t) for _, t, _ in rows}
    root = slow_components(want.values())
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[root[want[t]]] = min(i, first.get(root[want[t]], i))
    expect = sorted((str(i), f"{want[t]:016x}", str(first.get(root[want[t]]))) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == expect
    kept = simhash.keep_one(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    kept = kept.collect()
    assert len(kept) == len(set(root[want[t]] for _, t, _ in rows)) and {root[want[r.text]] for r in kept} == {root[want[t]] for _, t, _ in rows}
    assert {r.doc_id for r in kept if r.doc_id} == {i for i in first.values()} - {None}
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


# top-k


def test_top_k(spark):
    rng = np.random.default_rng(7)
    vectors = rng.normal(0, 0.2, (400, 12)).astype(np.float32)
    vectors[50:120] = vectors[3]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(1000, None), (1001, [None] * 12), (1002, [float("nan")] * 12), (1003, [float("inf")] + [0.0] * 11), (1050, [0.5] * 7), (None, [0.1] * 12), (40, vectors[40].tolist())]
    frame = spark.createDataFrame([(*r, "x", 3) for r in rows], "vec_id long, embedding array<float>, block string, dim int")
    got = topk.top_k(frame, F.col("vec_id") % 50 == 0, block=100, queries=3).collect()
    ints = {i: np.floor(256 * v.astype(float)).astype(int) for i, v in enumerate(vectors)}
    pool = [(i, x) for i, x in ints.items()] + [(40, ints[40])]
    want = []
    for q in range(0, 400, 50):
        best = sorted((-int(x @ ints[q]), i) for i, x in pool if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


# decontamination


def slow_hits(text, items):
    words = lambda t: decontaminate.words_of((t or "").encode())
    w, hit, found = words(text), set(), set()
    for name, t in items:
        v = words(t)
        for i in range(max(1, len(v) - 9) if v else 0):
            window = v[i : i + 10]
            for j in range(len(w) - len(window) + 1):
                if w[j : j + len(window)] == window:
                    hit.update(range(j, j + len(window)))
                    found.add(name)
    names = sorted(str(n) for n in found if n is not None)
    return len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("most", [32 << 20, 300])
def test_decontamination(spark, most):
    rng = random.Random(8)
    vocab = ["ant", "Bee", "cé", "d4", "e", "fox", "gnu"]
    say = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [(i, say(rng.choice([0, 1, 3, 10, 12, 25]))) for i in range(12)] + [(3, say(14)), (None, say(11)), (20, None), (21, "zz yy xx"), (10, say(10))]
    rows = EDGE + [(50 + i, f"{say(30)}, {rng.choice(items)[1] or ''}--{say(20)}; {(rng.choice(items)[1] or '').upper()}", "a") for i in range(40)] + [(99, "zz, YY\nxx. then zz yy", "a")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(docs(spark, rows), bench, most=most, clean=True, keep=("source", "_text")).collect()
    want = sorted((str(i), *slow_hits(t, items)) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
    by = {r.doc_id: r for r in got}
    only = spark.createDataFrame([(21, "zz yy xx")], "item_id long, text string")
    clean = {r.doc_id: r.text for r in decontaminate.cleaned(docs(spark, rows), only).collect()}
    assert clean[99] == ". then zz yy" and clean[1] is None and clean[8] == "one two three four"
    assert by[5].n_words == 5000
    assert decontaminate.decontaminate(docs(spark, rows), bench.limit(0)).where("contaminated").count() == 0


def test_fm_index():
    rng = np.random.default_rng(9)
    for _ in range(20):
        text = np.concatenate([np.append(rng.integers(1, 4, rng.integers(1, 30)), 0) for _ in range(5)])
        index = decontaminate.FMIndex(text, 3, sample=3)
        for n in (1, 2, 4):
            rows = np.zeros((9, 4), np.int64)
            rows[:, :n] = rng.integers(1, 4, (9, n))
            low, high = index.search(rows, np.full(9, n))
            for r, a, b in zip(rows, low, high):
                at = [i for i in range(len(text) - n + 1) if (text[i : i + n] == r[:n]).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == at


# toxicity


def test_folding():
    assert toxicity.fold("1d10t, ѕсum tr@sh### 2024") == " idiot scum trash "
    assert toxicity.fold("") == "  " and toxicity.fold("Réeux") == " réeux "


def test_lexicon_and_exceptions():
    rng = random.Random(10)
    say = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    rows = [(f"{say(20)} {rng.choice(['vilest', 'vilely', 'v1ler', 'm0ron'])} {say(5)}", 1) for _ in range(160)] + [(f"{say(25)} {'moron bay' if i % 20 == 0 else ''} {say(3)}", 0) for i in range(400)]
    model = toxicity.fit_lexicon(rows)
    assert "moron bay" in model.exceptions
    assert model.score(say(10) + " vilеst") > 0.5 > model.score(say(10))
    assert model.score("at moron bay " + say(10)) < 0.5 < model.score("you moron")
    assert toxicity.fit_lexicon([]).score("x") == 0.5 and toxicity.Lexicon({}).score(None) < 0.5


def test_toxicity_held_out(spark):
    rows = queries.queries()["op6_toxicity"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    assert rows and np.mean([r.predicted == r.toxic for r in rows]) > 0.9
    model = toxicity.fit_lexicon([("vilest words here", 1)] * 5 + [("mild words", 0)] * 5)
    got = toxicity.toxicity(docs(spark, EDGE), model).collect()
    assert len(got) == len(EDGE) and all(0 <= r.score <= 1 for r in got)


# language


def test_language_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = queries.queries()["op9_language_id"](spark, "/root/testdata/sf0.01").join(d, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97


def test_language_edges(spark):
    model = language.fit_filters([("aa", "bana banala banana " * 30), ("bb", "kirik kiriko kirikiri " * 30)])
    got = {r.doc_id: r for r in language.identify(docs(spark, [(1, None, ""), (2, "", ""), (3, "12 !?", ""), (4, "BANANA banala", ""), (5, "kiriko " * 4000, ""), (None, "kirik", "")]), model, keep=("key",)).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5, None)] == ["und", "und", "und", "aa", "bb", "bb"]
    assert got[1].score == 0 and 0.9 < got[5].score <= 1 and got[4].key == "k"
    kept = language.accepted(docs(spark, [(1, None, ""), (2, "123", ""), (3, "banana", ""), (4, "xyz wvu qpo " * 20, "")]), model)
    assert [r.doc_id for r in kept.collect()] == [3] and kept.columns == docs(spark, []).columns
    assert language.identify(docs(spark, []), model).count() == 0
    assert language.identify(docs(spark, [(1, "a", "")]), language.fit_filters([])).first().lang_pred == "und"


def test_many_languages(spark):
    names = [f"l{i:03}" for i in range(150)]
    say = lambda i: "".join(chr(97 + i // 26 + 5 * k) + chr(97 + i % 26) + "q" for k in range(4))
    model = language.fit_filters([(n, f"{say(i)} " * 30) for i, n in enumerate(names)], slot_bits=16)
    assert model.languages == names
    got = language.identify(docs(spark, [(i, f"{say(i)} " * 5, "") for i in range(150)]), model).collect()
    assert [r.lang_pred for r in sorted(got, key=lambda r: r.doc_id)] == names
    rows = spark.createDataFrame([(i, "word " * 20, f"l{i % 150:03}") for i in range(450)], "doc_id long, text string, lang string")
    drawn = language.training_rows(rows, F.lit(True), per_language=2)
    assert len(drawn) == 300 and len({x for x, _ in drawn}) == 150


# tokens


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_tokens(spark, name):
    texts = ["<|startoftext|> hi <|endoftext|>x", "it's  a\n b ' c 's", "naïve café é", "한국 어 テスト", " lead and trail ", "a1 2b 3.5 $x", "İ ΣΑΣ", "x" * 5000, "one two " * 3000, None, ""]
    rows = [(i, t, "") for i, t in enumerate(texts)] + [(r.doc_id + 100, r.text, "") for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    path = token_counts.default_path(name)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    else:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        count = lambda t: len(model.encode(t, add_special_tokens=False).ids)
    got = {r.doc_id: r for r in token_counts.token_counts(docs(spark, rows), name, batch_bytes=2000).collect()}
    for i, t, _ in rows:
        assert (got[i].n_tokens, got[i].n_bytes) == (count(t or ""), len((t or "").encode())), (i, t)
        assert got[i].over_limit == (got[i].n_tokens > 2048)
    assert token_counts.token_counts(docs(spark, []), name).count() == 0


# HTML


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p>";</script></head><body>
<header class="site-header"><div>Site name</div></header><nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav>
<div class="cookie-banner"><p>We use cookies here.</p><button>OK</button></div>
<article><h1>Big &amp; bold title</h1><p>First   paragraph of the&nbsp;story,<br>with a break and a <a href="x">link</a>.<p>Second paragraph, never closed; it goes on for a while.
<div class="ad">Buy now, it is cheap.</div><blockquote><p>A quoted line of some length.</p></blockquote><!-- hidden --></article>
<aside class="sidebar"><h3>Related</h3><ul><li><a href="/c">Other story</a></li></ul></aside>
<section class="comments"><div class="comment"><p>I liked it very much.</p></div></section><form><label>Mail</label><input><button>Send</button></form>
<footer>&copy; 2020 Site</footer></body></html>"""


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, "v", None, ""), (3, "w", "", ""), (4, "x", "<nav><a href=a>a</a></nav>", ""), (None, "y", "<p>" + "A plain sentence. " * 9, ""), (6, "z", "<p>unclosed <b <<>", "")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_text.extract(pages, html_text.trained()).collect()}
    assert got[1].text == "Big & bold title First paragraph of the story, with a break and a link. Second paragraph, never closed; it goes on for a while. A quoted line of some length."
    assert all(r.n_chars == len(r.text) for r in got.values()) and got[2].text == got[3].text == got[4].text == ""
    assert html_text.extract(pages.limit(0), html_text.trained()).count() == 0
    rng = np.random.default_rng(123)
    right = total = 0
    for _ in range(100):
        page, y = html_text._training_page(rng)
        p = html_text.label(html_text.trained(), [html_text.blocks(page)])[0]
        right, total = right + ((p >= 0.5) == np.array(y)).sum(), total + len(y)
    assert right / total > 0.98
    model = html_text.Labeller(3)
    x, y = np.random.default_rng(1).normal(size=(4, 2, html_text.PATHS + html_text.WORDS + html_text.PLAIN)).astype(np.float64), np.ones((4, 2))
    mask = np.array([[1, 1], [1, 1], [1, 0], [1, 0]], bool)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    _, g = model.gradient(x, mask, y)
    for k in ("hf", "xb", "ob"[0], "cf"):
        at = tuple(np.random.default_rng(2).integers(s) for s in model.p[k].shape)
        model.p[k][at] += 1e-3
        up, _ = model.gradient(x, mask, y)
        model.p[k][at] -= 2e-3
        down, _ = model.gradient(x, mask, y)
        model.p[k][at] += 1e-3
        assert g[k][at] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=1e-4)


def test_html_whole():
    texts = lambda page: [t for _, t, _ in html_text.blocks(page)]
    assert texts('<article><p>One <svg class="i"/> two</p><p>three</p></article>') == ["One two", "three"]
    assert texts("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be; <math/> so</p></article>") == ["Let x=2 be; so"]
    assert texts("<p>One</p><svg><p>two</p><svg><text>no</text></svg><p>three</p>") == ["One", "two", "three"]
    assert texts("<p>One</p><svg><svg><text>no</text></svg><text>no</text></svg><object>no</object><p>two</p>") == ["One", "two"]
    assert texts("<p>One</p><script>var a = 1;<p>two</p><script>b") == ["One", "two"]
    utilities = " ".join(f"u{chr(97 + i)}x" for i in range(14))
    a, b = (html_text.features(html_text.blocks(f'<div class="{utilities} {name}"><p>A text.</p></div>')) for name in ("comments", "article"))
    assert (a != b).any()
    words = [f"w{i}" for i in range(200)]
    one = html_text.features(html_text.blocks(f"<p>{' '.join(words)}</p>"))
    for i in (1, 50, 198):
        other = html_text.features(html_text.blocks(f"<p>{' '.join([*words[:i], 'another', *words[i + 1 :]])}</p>"))
        assert html_text._bucket("another", html_text.WORDS) == html_text._bucket(words[i], html_text.WORDS) or (one != other).any()


# brute force and hostile inputs


def slow_fold(text):
    letters = [c.isalnum() and not c.isdecimal() and c != "_" for c in text]
    out = []
    for i, c in enumerate(text):
        j = i
        while j < len(text) and text[j] in toxicity.DIGITS:
            j += 1
        out.append(toxicity.DIGITS[c] if c in toxicity.DIGITS and j < len(text) and letters[j] else c)
    words, word = [], ""
    for c in [*out, " "]:
        c = toxicity.HOMOGLYPHS.get(c, c)
        if c.isalpha():
            word += c.lower()
        elif word:
            words.append(word)
            word = ""
    return f" {' '.join(words)} "


def slow_score(model, folded):
    spans = lambda p: [(i, i + len(p)) for i in range(len(folded) - len(p) + 1) if folded[i : i + len(p)] == p]
    spared = [s for p in model.exceptions for s in spans(f" {p} ")]
    total = 0.0
    for p, w in model.entries.items():
        n = sum(not any(a <= s and e <= b for a, b in spared) for s, e in spans(p))
        total += w * (1 + np.log(n)) / (1 + np.log2(1 + max(0, folded.count(" ") - 1)) / 8) if n else 0.0
    return 1 / (1 + np.exp(-np.clip(model.bias + total, -60, 60)))


def test_toxicity_against_brute_force(spark):
    rng = random.Random(21)
    pieces = ["vile", "v1le", "$cum", "scum", "moron", "moron bay", "bay", "аss", "4ss", "tr@sh", "2024", "x", "1", "_", ",", "m0r0n ", "Évil"]
    model = toxicity.Lexicon({" vile": 1.5, " scum ": 2.0, " moron ": 1.0, "ass": 0.7, " tr": -0.4}, ["moron bay", "old scum"], -1.0)
    texts = ["".join(rng.choice(pieces) + rng.choice([" ", "", "-", "\n"]) for _ in range(rng.randint(0, 40))) for _ in range(200)] + ["", "vile " * 3000, "1" * 200_000, "moron bay " * 20_000]
    rows = [(i, t, "") for i, t in enumerate(texts)] + [(3, texts[3], ""), (None, texts[4], "")]
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs(spark, rows), model).collect()}
    for i, t in enumerate(texts[:-2]):
        folded = slow_fold(t) if len(t) < 5000 else toxicity.fold(t)
        assert toxicity.fold(t) == folded
        if len(t) < 5000:
            assert got[i] == pytest.approx(slow_score(model, folded))
    assert got[None] == got[4] and len(got) == len(texts) + 1
    assert toxicity.fold("1" * 3_000_000) == "  "


def test_language_against_sets():
    import pyarrow as pa

    rng = random.Random(22)
    say = lambda letters, n: " ".join("".join(rng.choices(letters, k=rng.randint(1, 6))) for _ in range(n))
    rows = [("aa", say("abcde", 200)), ("bb", say("defgh", 200)), ("cc", say("abxyz", 200))]
    model = language.fit_filters(rows, slot_bits=10)
    from sparkscribe.llm.language import _grams

    texts = [say("abcdefgh", 20), say("xyz", 5), "", "a", "ABC! abc"]
    hashes, offsets = _grams(pa.array(texts), model.gram)
    shares = model.shares(pa.array(texts))
    for i in range(3):
        slots = {s for s in range(model.masks.shape[1]) if int(model.masks[0][s]) >> i & 1}
        false = (len(slots) / model.masks.shape[1]) ** model.lookups
        for t in range(len(texts)):
            own = hashes[offsets[t] : offsets[t + 1]]
            hit = sum(all(int(model._slots(own[k : k + 1], j)[0]) in slots for j in range(model.lookups)) for k in range(len(own))) / max(1, len(own))
            assert shares[t, i] == pytest.approx(min(1, max(0, (hit - false) / (1 - false))))


def test_language_draw_repeats(spark):
    rows = [(i % 5, f"text number {i % 7} here", "aa" if i % 2 else "bb") for i in range(200)] + [(None, "no id", "aa")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    drawn = language.training_rows(frame, F.col("doc_id").isNotNull())
    assert sorted(drawn) == sorted({(lang, t, i) for i, t, lang in rows if i is not None} and [(lang, t) for i, t, lang in {(i, t, lang) for i, t, lang in rows if i is not None}])
    assert language.training_rows(frame.repartition(7), F.col("doc_id").isNotNull()) == drawn


def slow_blocks(page):
    """The texts of the blocks of a well-formed page, character by character."""
    out, text, i = [], "", 0
    inline = {"a", "b", "em", "span"}
    while i < len(page):
        if page[i] == "<":
            j = page.index(">", i)
            name = page[i + 1 : j].strip("/").split()[0].lower()
            i = j + 1
            if name == "script" and page[j - 1] != "/":
                i = page.index("</script>", i) + len("</script>")
            elif name == "br":
                text += " "
            elif name not in inline:
                out.append(" ".join(text.split()))
                text = ""
        else:
            text += page[i]
            i += 1
    return [t for t in [*out, " ".join(text.split())] if t]


def slow_chances(model, x):
    u, p = model.units, model.p
    sig = lambda z: 1 / (1 + np.exp(-z))
    states = {}
    for side, rows in (("f", range(len(x))), ("b", range(len(x) - 1, -1, -1))):
        h, c = np.zeros(u), np.zeros(u)
        for t in rows:
            z = x[t] @ p[f"x{side}"] + h @ p[f"h{side}"] + p[f"c{side}"]
            c = sig(z[u : 2 * u]) * c + sig(z[:u]) * np.tanh(z[3 * u :])
            h = sig(z[2 * u : 3 * u]) * np.tanh(c)
            states[side, t] = h
    return [sig(states["f", t] @ p["o"][:u] + states["b", t] @ p["o"][u:] + x[t] @ p["d"] + p["b"][0]) for t in range(len(x))]


def test_html_against_brute_force():
    rng = random.Random(23)

    def node(depth):
        kind = rng.random()
        if depth > 4 or kind < 0.4:
            return rng.choice(["some words", "A sentence.", " x ", "more<br>lines", "<script>var a = '<p>';</script>", "<b>bold</b> text", "<a href='x'>link</a>"])
        tag = rng.choice(["div", "p", "section", "ul", "span"]) if kind < 0.9 else "em"
        inner = "".join(node(depth + 1) for _ in range(rng.randint(0, 4))) if tag != "p" else "plain <em>words</em>"
        return f'<{tag} class="c{depth}">{inner}</{tag}>'

    model = html_text.trained()
    for _ in range(60):
        page = "".join(node(0) for _ in range(rng.randint(0, 6)))
        found = html_text.blocks(page)
        assert [t for _, t, _ in found] == slow_blocks(page)
        if found:
            want = slow_chances(model, html_text.features(found).astype(float))
            assert np.allclose(html_text.label(model, [found])[0], want, atol=1e-4)
            assert np.allclose(html_text.label(model, [found], most=0)[0], want, atol=1e-4)


@pytest.mark.parametrize("page", ["<a b" * 300_000, "<div>" * 200_000, "<svg " * 200_000, '<a "x>' * 200_000, "<a '" * 200_000, "<div>" * 60_000 + "</p>" * 200_000, "<!" * 300_000])
def test_html_hostile_pages(page):
    assert len(html_text.blocks(page + "<p>The end.</p>")) <= 2
    assert html_text.blocks("<p>First.</p>" + page)[0][1] == "First."


def test_fingerprint_of_long_texts():
    rng = random.Random(24)
    text = rng.choice(["", " "]) + "  ".join(rng.choices(["Alpha", "beta", "gÄmma\n", "\tdelta"], k=150_000))
    assert int.from_bytes(simhash.fingerprint(text.encode()), "big") == slow_fingerprint(text)


def test_text_ids(spark):
    rows = [("b", "one two three four five"), ("a", "one two three four five"), (None, "one two three four five"), ("c", "something else here")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted(r.doc_id for r in kept) == ["a", "c"]


def test_long_benchmark_items(spark):
    words = " ".join(f"w{i}" for i in range(4000))
    rows = [(1, " ".join(f"w{i}" for i in range(1990, 2010))), (2, "nothing of it"), (1, " ".join(f"w{i}" for i in range(1990, 2010)))]
    got = decontaminate.decontaminate(docs(spark, [(i, t, "") for i, t in rows]), spark.createDataFrame([(7, words)], "item_id long, text string"), most=2000).collect()
    assert sorted((r.doc_id, r.n_hit, r.n_items) for r in got) == [(1, 20, 1), (1, 20, 1), (2, 0, 0)]
