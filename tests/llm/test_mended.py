"""Cases in which earlier versions were wrong: token boundaries, ends of comments, huge components."""

import random

import pytest

from sparkscribe.llm import html_text, token_counts, topk

ALPHABET = ["İ", "I", "i", "a", "B", "é", "é", "ß", "Σ", "я", "中", "の", "한", "1", "²", "٣", ",", ";", "!", "?", "，", "。", "！", " ", "  ", "\t", "\n", "'s", "'", "-", "_", "̇", "‍", "<|endoftext|>", "<|", "|>", "\U00031350", "Ᲊ", "\U0001f600", "ǅ", "ª", "ʰ", "×"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("long", [0, 1 << 14])
def test_pieces_add_up(name, long, monkeypatch):
    monkeypatch.setattr(token_counts, "LONG", long)
    encode = token_counts._load(token_counts.default_path(name))
    rng = random.Random(long)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 25))) for _ in range(8000)]
    texts += [x * 6000 for x in ("İ,a", "a,b", "İ,a", "中，文", "é!x", "1,2", "ab'll,", "<|endoftext|>,a")]
    whole = encode(texts)
    cut = [list(token_counts.pieces(t)) for t in texts]
    assert all("".join(c) == t for c, t in zip(cut, texts))
    flat = iter(encode([p for c in cut for p in c]))
    assert [sum(next(flat) for _ in c) for c in cut] == whole


def test_a_run_without_boundaries_is_one_piece():
    assert list(token_counts.pieces("7" * 100_000)) == ["7" * 100_000]


ARTICLE = "<article><h1>A headline of the day</h1><p>The first long paragraph of the story goes on for a while.</p></article>"


@pytest.mark.parametrize("comment", ["<!-->", "<!--->", "<!---->", "<!-- a -->", "<!-- a --!>", "<!----!>", "<!-- > -- ->-->", "<!-- never closed "])
def test_comments_keep_the_article(comment):
    text = [t for _, t, _ in html_text.blocks(f"<body>{comment}{ARTICLE}<!-- x --><footer>f</footer>" if "never" not in comment else f"<body>{ARTICLE}{comment}{ARTICLE}")]
    assert "The first long paragraph of the story goes on for a while." in text and not any("x" == t for t in text)
    if "never" not in comment:
        assert "f" in text


def test_unclosed_comments_take_linear_time():
    assert len(html_text.blocks("<!-- <p>a</p>" * 50_000)) >= 50_000


def test_huge_components_take_no_part(spark):
    rows = [(1, [1.0, 2.0]), (2, [1e30, 1.0]), (3, [3.0, 1.0]), (4, [1e7, 0.0]), (5, [-1e38, 1e38]), (6, [8388608.0, 0.0]), (7, [5.9e6, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(df, df.vec_id > 0, 9).collect()
    whole = {i: [int(256 * c) for c in v] for i, v in rows}
    part = [i for i, v in whole.items() if sum(c * c for c in v) < 1 << 62]
    want = [(q, r + 1, -i, s) for q in part for r, (s, i) in enumerate(sorted(((sum(a * b for a, b in zip(whole[q], whole[i])), -i) for i in part if i != q), reverse=True))]
    assert part == [1, 3, 7]
    assert sorted(map(tuple, got)) == sorted(want) and all(abs(r.score) < 1 << 62 for r in got)


def test_near_duplicates_broadcast_nothing(spark):
    """Every join grows with the corpus; a broadcast of small statistics would be built on the driver."""
    from sparkscribe.llm import simhash

    docs = spark.range(200).selectExpr("id AS doc_id", "concat('some words of text number ', id % 20) AS text")
    for df in (simhash.near_duplicates(docs), simhash.keep_one(docs), simhash.links(simhash.fingerprints(docs).select("fp").distinct())):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_spans_are_never_broadcast(spark, monkeypatch):
    """Their lists are packed in Parquet, so a table that Spark takes for small may be large once it is built on the driver."""
    import random

    from sparkscribe.llm import decontaminate, repeats, substring_dedup, suffix_dedup

    def plan(df):
        df.collect()
        return df._jdf.queryExecution().executedPlan().toString()

    rng, plans, real = random.Random(2), [], repeats._regions
    words = lambda n: " ".join("".join(rng.choices("abcdef", k=5)) for _ in range(n))
    passage = words(60)
    docs = spark.createDataFrame([(i, f"{words(20)} {passage} {words(i)}") for i in range(1, 5)], "doc_id long, text string")
    monkeypatch.setattr(repeats, "_regions", lambda *args: (df := real(*args), plans.append(plan(df)))[0])
    plans += [plan(dedup(docs)) for dedup in (suffix_dedup.without_repeats, substring_dedup.remove_substrings)]
    items = spark.createDataFrame([(1, passage), (2, words(12))], "item_id long, text string")
    plans.append(plan(decontaminate.decontaminate(docs, items, most=100)))
    assert len(plans) == 5 and all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in plans)


def test_whole_copies_are_not_compared(spark, monkeypatch):
    """Copies of a smaller id are covered as they are; of the others only two documents that share a passage go to the shards."""
    import random

    from sparkscribe.llm import repeats, suffix_dedup

    rng, seen, real = random.Random(1), [], repeats._regions
    made = lambda n: "".join(rng.choices("abcdefghijklmnop", k=n))
    a, b, c, passage = made(400), made(300), made(250), made(150)
    rows = [(1, a), (2, b), (5, a), (6, a), (7, c), (7, c), (8, c), (None, b), (9, "short"), (10, "short"), (11, made(200) + passage), (12, made(90) + passage), (13, None)]
    monkeypatch.setattr(repeats, "_regions", lambda rows, need, unit: (seen.append(need.count()), real(rows, need, unit))[1])
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    removed = {(5, 400, 1), (6, 400, 1), (8, 250, 1), (None, 300, 1), (12, 150, 1)}
    assert {(r.doc_id, r.n_removed, r.n_spans) for r in got if r.n_removed} == removed and len(got) == len(rows)
    assert seen == [2]
