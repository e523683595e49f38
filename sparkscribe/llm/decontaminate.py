"""Benchmark decontamination: an FM-index per training shard, searched for all benchmark windows at once."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, spread, stage_table, table
from .rolling import sums

#: Words of a window; words of a shard; every so many suffix positions of a run are sampled.
WINDOW, SHARD_WORDS, SAMPLE = 10, 1 << 18, 8

_FOLD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(data: bytes) -> list[bytes]:
    return data.translate(_FOLD).split()


@dataclass
class Phrases:
    """Distinct windows as rows of word numbers (from 1, right-padded with 0), and the items each occurs in."""

    vocabulary: dict[bytes, int]
    rows: np.ndarray
    lengths: np.ndarray
    first_item: np.ndarray  # window w occurs in items[first_item[w] : first_item[w + 1]]
    items: np.ndarray
    names: list[str | None]


def phrases_of(items: list[tuple[str | None, bytes]], window: int = WINDOW) -> Phrases:
    """Windows are held as rows of numbers, about 60 bytes for each benchmark word."""
    vocabulary: dict[bytes, int] = {}
    names: dict = {}
    rows, lengths, owners = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for name, data in items:
        ids = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(data)], np.int32)
        own = names.setdefault(name, len(names))
        if not len(ids):
            continue
        short = min(window, len(ids))
        found = np.zeros((len(ids) - short + 1, window), np.int32)
        found[:, :short] = np.lib.stride_tricks.sliding_window_view(ids, short)
        rows.append(found)
        lengths.append(np.full(len(found), short))
        owners.append(np.full(len(found), own))
    every, own = np.concatenate(rows), np.concatenate(owners)
    order = np.lexsort((own, *every.T))
    every, own, length = every[order], own[order], np.concatenate(lengths)[order]
    fresh = np.ones(len(every), bool)
    fresh[1:] = (every[1:] != every[:-1]).any(1)
    pair = fresh.copy()
    pair[1:] |= own[1:] != own[:-1]
    heads = np.flatnonzero(fresh)
    first = np.concatenate(([0], np.cumsum(pair)))[np.append(heads, len(every))]
    return Phrases(vocabulary, every[heads].astype(np.int64), length[heads], first, own[pair], list(names))


class FMIndex:
    """Of a text of word numbers in which 0 ends each run; a suffix ends with its run, so runs sort independently."""

    def __init__(self, text: np.ndarray, top: int, sample: int = SAMPLE):
        n = len(text)
        order = np.where(text == 0, np.arange(n) - n, text)  # each end is a symbol of its own, below all words
        _, rank = np.unique(order, return_inverse=True)
        rank, step = rank.astype(np.int64), 1
        while True:
            key = rank * (n + 1)
            key[: n - step] += rank[step:] + 1
            suffixes = np.argsort(key, kind="stable")
            ordered = key[suffixes]
            fresh = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
            rank[suffixes] = fresh
            if n == 0 or fresh[-1] == n - 1:
                break
            step *= 2
        self.bwt = text[suffixes - 1]  # the word before the first suffix is never asked for: it starts a run
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=top + 1))))
        starts = np.flatnonzero(np.concatenate(([True], text[:-1] == 0)))
        length = np.diff(np.concatenate((starts, [n])))
        within = np.arange(n) - np.repeat(starts, length)
        self.at = np.where(within % sample == 0, np.arange(n), -1)[suffixes]  # sampled suffix positions, run starts among them
        # wavelet matrix of the transform: at each level the words' bits, most significant first, and how many are set before each place
        self.levels, level = [], self.bwt
        for bit in range(max(1, int(top).bit_length()) - 1, -1, -1):
            ones = (level >> bit) & 1
            self.levels.append((bit, np.concatenate(([0], np.cumsum(ones))), n - int(ones.sum())))
            level = np.concatenate((level[ones == 0], level[ones == 1]))
        self.zero = self._descend(np.arange(top + 1), np.zeros(top + 1, np.int64))

    def _descend(self, word: np.ndarray, place: np.ndarray) -> np.ndarray:
        for bit, ones, zeros in self.levels:
            set_before = ones[place]
            place = np.where((word >> bit) & 1, zeros + set_before, place - set_before)
        return place

    def rank(self, word: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each word occurs in the transform before each place."""
        return self._descend(word, place) - self.zero[word]

    def search(self, rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals [low, high) of all phrases, from their last word backward."""
        low, high = np.zeros(len(rows), np.int64), np.full(len(rows), len(self.bwt))
        for j in range(rows.shape[1] - 1, -1, -1):
            live = np.flatnonzero((lengths > j) & (low < high))
            word = rows[live, j]
            low[live] = self.before[word] + self.rank(word, low[live])
            high[live] = self.before[word] + self.rank(word, high[live])
        return low, high

    def locate(self, places: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: steps backward to a sampled one."""
        out, steps, open_ = np.empty(len(places), np.int64), 0, np.arange(len(places))
        places = places.copy()
        while len(open_):
            at = self.at[places]
            done = at >= 0
            out[open_[done]] = at[done] + steps
            open_, places = open_[~done], places[~done]
            word = self.bwt[places]
            places = self.before[word] + self.rank(word, places)
            steps += 1
        return out


def _search(text: np.ndarray, offsets: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, dict[int, set[int]]]:
    """text: word numbers of a shard's documents, each ended by 0. Which words are hit, and the windows found in each document."""
    hit = np.zeros(len(text) + 1, np.int64)
    found: dict[int, set[int]] = {}
    if not len(phrases.rows):
        return hit[:-1] > 0, found
    # the index leaves out runs of benchmark words shorter than any window
    edge = np.diff(np.concatenate(([0], (text > 0).astype(np.int8), [0])))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = stops - starts >= phrases.lengths.min()
    starts, stops = starts[long], stops[long]
    if not len(starts):
        return hit[:-1] > 0, found
    size = stops - starts + 1  # a run's end goes along
    where = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts, size)
    index = FMIndex(text[where], len(phrases.vocabulary))
    low, high = index.search(phrases.rows, phrases.lengths)
    windows = np.flatnonzero(low < high)
    for part in np.array_split(windows, max(1, int((high - low)[windows].sum()) >> 20)):
        n = (high - low)[part]
        places = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[part], n)
        at, window = where[index.locate(places)], np.repeat(part, n)
        np.add.at(hit, at, 1)
        np.add.at(hit, at + phrases.lengths[window], -1)
        docs = np.searchsorted(offsets, at, "right") - 1
        for d, w in np.unique(np.stack((docs, window), 1), axis=0).tolist():
            found.setdefault(d, set()).add(w)
    return np.cumsum(hit[:-1]) > 0, found


def _cleaned(data: bytes, hit: np.ndarray) -> bytes:
    """The text without its hit words and what stands between them in one span."""
    out, at, spans = [], 0, [m.span() for m in _WORD.finditer(data.translate(_FOLD))]
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
        out.append(data[at : spans[a][0]])
        at = spans[b - 1][1]
    return b"".join([*out, data[at:]])


def _pieces(benchmark: DataFrame, item_col: str, text_col: str, window: int, most: int) -> tuple[DataFrame, int]:
    """(name, data) of the items and the benchmark's bytes; an item over a quarter of `most` is cut into parts that overlap by a window less a word."""
    items = benchmark.select(F.col(item_col).cast("string").alias("name"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"))
    total, longest = items.agg(F.sum(F.octet_length("data")), F.max(F.octet_length("data"))).first()
    if (longest or 0) <= most // 4:
        return items, total or 0
    step = max(window, most // 64)  # words

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            names, parts = [], []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(data)
                for at in range(0, max(1, len(words) - window + 1), step):
                    names.append(name)
                    parts.append(b" ".join(words[at : at + step + window - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(parts, pa.binary())], ["name", "data"])

    return items.mapInArrow(frugal(cut), "name string, data binary"), total or 0


def _shards(batch, column: int):
    """Slices of whole documents of a record batch, of about SHARD_WORDS words."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // (6 * SHARD_WORDS))) + 1
    edges = [0, *cuts.tolist(), batch.num_rows]
    return (batch.slice(a, b - a) for a, b in zip(edges, edges[1:]) if b > a)


def _texts(column) -> list[bytes]:
    return [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in column]


def search_shard(texts: list[bytes], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, list[set]]:
    """Of a shard's texts: offsets of their words (one more place each), which words are hit, and the names of the items found in each."""
    words = [words_of(t) for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(w) + 1 for w in words]))).astype(np.int64)
    text, number = np.zeros(offsets[-1], np.int64), phrases.vocabulary.get
    for w, a in zip(words, offsets.tolist()):
        text[a : a + len(w)] = np.fromiter(map(number, w, repeat(0)), np.int64, len(w))
    hit, found = _search(text, offsets, phrases)
    names: list[set] = [set() for _ in texts]
    for d, windows in found.items():
        for w in windows:
            names[d].update(phrases.names[i] for i in phrases.items[phrases.first_item[w] : phrases.first_item[w + 1]])
    return offsets, hit, names


def _spans(hit: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()


def _hits(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", clean: bool = False, keep: tuple[str, ...] = (), most: int = 8 << 20) -> DataFrame:
    spark = docs.sparkSession
    items, total = _pieces(benchmark, item_col, item_text, window, most)
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *(F.col(c).alias(f"k_{c}") for c in keep))
    kind = source.schema["_id"].dataType.simpleString()
    kept = source.drop("_id", "_text").schema
    schema = f"_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean" + ", _clean string" * clean + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in kept)
    names_out = ["_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", *["_clean"] * clean, *kept.names]

    def phrases_in(block: DataFrame):
        """The windows of a block of about `most` bytes, for all workers."""
        return spark.sparkContext.broadcast(phrases_of([(r["name"], bytes(r["data"])) for r in block.collect()], window))

    def digest(ids, texts, valid, offsets, hit, names, others):
        import pyarrow as pa

        n_words, n_hit = np.diff(offsets) - 1, sums(hit, offsets)
        names = [sorted(x for x in n if x is not None) for n in names]
        columns = [
            ids,
            pa.array(n_words, pa.int64()),
            pa.array(n_hit, pa.int64()),
            pa.array([len(n) for n in names], pa.int64()),
            pa.array([hashlib.sha256(",".join(n).encode()).hexdigest() for n in names], pa.string()),
            pa.array(n_hit > 0),
        ]
        if clean:
            left = (_cleaned(t, hit[a : a + w]) if n else t for t, w, a, n in zip(texts, n_words.tolist(), offsets.tolist(), n_hit))
            columns.append(pa.array([t.decode("utf-8", "replace") if v else None for t, v in zip(left, valid)], pa.string()))
        return pa.RecordBatch.from_arrays([*columns, *others], names_out)

    if total <= most:
        shared = phrases_in(items)

        def scan(batches):
            for batch in batches:
                for part in _shards(batch, 1):
                    texts = _texts(part.column(1))
                    yield digest(part.column(0), texts, part.column(1).is_valid().to_pylist(), *search_shard(texts, shared.value), part.columns[2:])

        return source.mapInArrow(frugal(scan), schema)

    # a large benchmark: one block of it a pass, whose hits are written by the text's SHA-256, which no two texts share; then they are joined to the documents
    blocks = 1 + 2 * total // most
    dealt = stage_table(items.withColumn("block", F.pmod(F.xxhash64("name", "data"), F.lit(blocks)).cast("int")))
    keyed = source.withColumn("_th", F.unhex(F.sha2("_text", 256)))
    every = None
    for i in range(blocks):
        shared = phrases_in(dealt.where(F.col("block") == i))

        def find(batches, shared=shared):
            import pyarrow as pa

            for batch in batches:
                for part in _shards(batch, 0):
                    offsets, hit, names = search_shard(_texts(part.column(0)), shared.value)
                    own = np.flatnonzero(sums(hit, offsets) > 0).tolist()
                    if own:
                        spans = [_spans(hit[offsets[d] : offsets[d + 1] - 1]) for d in own]
                        lists = pa.list_(pa.int64())
                        columns = [pa.array([x[k] for x in spans], lists) for k in (0, 1)]
                        columns.append(pa.array([sorted(x or "" for x in names[d] if x is not None) for d in own], pa.list_(pa.string())))
                        yield pa.RecordBatch.from_arrays([part.column(1).take(pa.array(own)), *columns], ["_th", "lo", "hi", "names"])

        found = stage_table(keyed.select("_text", "_th").mapInArrow(frugal(find), "_th binary, lo array<long>, hi array<long>, names array<string>").distinct())
        shared.destroy()
        every = found if every is None else every.unionByName(found)
    merged = every.groupBy("_th").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("lo", "hi", "names")))  # as many rows of a text as blocks
    joined = keyed.join(spread(merged), "_th", "left").select("_id", "_text", "lo", "hi", "names", *kept.names)

    def finish(batches):
        for batch in batches:
            for part in _shards(batch, 1):
                texts = _texts(part.column(1))
                offsets = np.concatenate(([0], np.cumsum([len(words_of(t)) + 1 for t in texts]))).astype(np.int64)
                hit = np.zeros(offsets[-1], bool)
                for at, lo, hi in zip(offsets.tolist(), part.column(2).to_pylist(), part.column(3).to_pylist()):
                    for a, b in zip(lo or (), hi or ()):
                        hit[at + a : at + b] = True
                names = [set(n or ()) for n in part.column(4).to_pylist()]
                yield digest(part.column(0), texts, part.column(1).is_valid().to_pylist(), offsets, hit, names, part.columns[5:])

    return joined.mapInArrow(frugal(finish), schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", keep: tuple[str, ...] = (), clean: bool = False, **options) -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items_sha256, contaminated, kept columns, and with `clean` clean_text, the text less its hit spans.

    A benchmark over `most` bytes (its size is checked first) is dealt into blocks of about that size, long items in parts that overlap; each
    block is one pass over the documents, so the driver and the workers hold one block at a time, and the hits are merged by text.
    Null texts have no words (n_words 0, the hash of nothing), null items and items without words no windows; an item
    with null id hits but is not named; items that repeat an id count once. Null document ids and repeated rows
    pass through; an empty table gives no rows, an empty benchmark no hits. Columns not kept are ignored.
    """
    out = _hits(docs, benchmark, id_col=id_col, keep=keep, clean=clean, **options)
    return out.withColumnsRenamed({"_id": id_col, "_clean": "clean_text"} | {f"k_{c}": c for c in keep})


def cleaned(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """docs, all rows and columns, with each text less its hit spans."""
    others = tuple(c for c in docs.columns if c != text_col)
    out = _hits(docs, benchmark, text_col=text_col, keep=others, clean=True, **options)
    return out.select(*(F.col("_clean" if c == text_col else f"k_{c}").alias(c) for c in docs.columns))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + 9], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
hits AS (SELECT p.doc_id, p.i, l.n, win.item_id FROM pos p JOIN lens l ON p.i + l.n - 1 <= len(p.w) JOIN win ON win.n = l.n AND win.s = array_to_string(p.w[p.i:p.i + l.n - 1], ' ')),
cov AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(t.names, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov c USING (doc_id) LEFT JOIN its t USING (doc_id)
"""
