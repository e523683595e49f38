"""Phrase collocations by vertical positional inverted lists.

Each block of text is held as inverted lists: for a word, the positions it occurs at; for a phrase, those it begins at. Lists grow level by
level: the list of a frequent phrase is merge-joined with the list of frequent phrases one position on and with the postings of the word
that follows, and what both have in common is the list of the longer phrase. The length of a list is the phrase's exact frequency in
the block; Spark adds the lengths of all blocks and keeps the frequent phrases of a level, whose bitmap prunes the next.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import frugal, stage_table, table
from .rolling import mix

#: Bytes of text whose lists are held at once.
BLOCK = 4 << 20
#: Bits of a level's bitmap for each frequent phrase, and at most: 16 MB. A bit set by another phrase only lets a longer one be counted in vain.
BITS_EACH, MOST_BITS = 32, 1 << 27
#: Groups a language is dealt over before its first phrases are ranked.
SALTS = 32

_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 2


@dataclass
class Lists:
    """Occurrences in the order of their positions, and a hash of language and phrase at each; equal phrases have equal hashes, and those
    that share one are told apart when they are counted."""

    at: np.ndarray
    key: np.ndarray

    def where(self, bitmap: np.ndarray) -> Lists:
        """The occurrences whose phrase may be frequent."""
        bit = self.key & np.uint64(len(bitmap) * 64 - 1)  # a power of two: the same as a modulus
        own = (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
        return Lists(self.at[own], self.key[own])

    def find(self, at: np.ndarray) -> np.ndarray:
        """Merge-join with sorted positions: which of them stand in this list."""
        i = np.searchsorted(self.at, at)
        i[i == len(self.at)] = 0
        return self.at[i] == at if len(self.at) else np.zeros(len(at), bool)


def _hashes(words: list[str]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(w) for w in words), np.uint64, len(words))


def _follow(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase and one more word."""
    return mix(key * np.uint64(0x9E3779B97F4A7C15) + word)


class Block:
    """The words of a stretch of texts end to end. Phrases are counted if they begin before word `own`."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, own: int, langs: np.ndarray):
        """data: bytes; ends: n + 1 offsets of the texts; own: bytes whose words count; langs: a number for each text."""
        import pyarrow as pa

        kind = _KIND[data]
        word = kind == 0
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        edge = ends[(ends > 0) & (ends < len(data))]
        first[edge] = word[edge]
        last[edge - 1] = word[edge - 1]
        starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
        offsets = np.zeros(len(starts) + 1, np.int32)
        np.cumsum(stops - starts, out=offsets[1:])
        column = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[word].tobytes()))
        coded = column.dictionary_encode()
        self.spelling = coded.dictionary
        self.word = coded.indices.to_numpy().astype(np.int64)
        text = np.searchsorted(ends, starts, "right") - 1
        self.lang = langs[text] if len(text) else np.empty(0, np.int64)
        broken = np.cumsum(kind == 2, dtype=np.int32)[starts] if len(data) else np.empty(0, np.int32)
        self.linked = (text[1:] == text[:-1]) & (broken[1:] == broken[:-1])  # a word and the next stand in one piece
        self.own = int(np.searchsorted(starts, own))

    def words(self, seeds: np.ndarray) -> Lists:
        """Postings of all words. seeds: a hash for each language."""
        self.hash = _hashes(self.spelling.to_pylist())[self.word]
        return Lists(np.arange(len(self.word)), _follow(seeds[self.lang], self.hash))

    def extend(self, lists: Lists, postings: Lists, size: int) -> Lists:
        """The lists of phrases of `size` words from those of one word less: an occurrence at p needs one at p + 1 and a posting of the
        last word at p + size - 1, in one piece."""
        joined = np.append(lists.at[1:] == lists.at[:-1] + 1, False)[: len(lists.at)]  # sorted: only the next can stand there
        if size == 2:
            joined &= np.append(self.linked, False)[lists.at]
        at, key = lists.at[joined], lists.key[joined]
        joined = postings.find(at + size - 1)
        at, key = at[joined], key[joined]
        return Lists(at, _follow(key, self.hash[at + size - 1]))

    def counted(self, lists: Lists, size: int):
        """Of each phrase that begins among the block's own words: text, language number, length of its list."""
        import pyarrow as pa
        import pyarrow.compute as pc

        at = lists.at[lists.at < self.own]
        phrase, spread = self.lang[at], len(self.spelling)
        for i in range(size):  # numbered word by word: no hash decides what is one phrase
            phrase = _numbered(phrase * spread + self.word[at + i])
        n = np.bincount(phrase)
        head = np.zeros(len(n), np.int64)
        head[phrase] = at
        parts = [self.spelling.take(pa.array(self.word[head + i])) for i in range(size)]
        return pc.binary_join_element_wise(*parts, " ") if size > 1 else parts[0], self.lang[head], n


def _numbered(x: np.ndarray) -> np.ndarray:
    """Equal values to equal numbers from 0."""
    top = int(x.max(initial=-1)) + 1
    if top <= 4 * len(x):
        seen = np.zeros(top, np.int64)
        seen[x] = 1
        return (np.cumsum(seen) - 1)[x]
    return np.unique(x, return_inverse=True)[1]


def text_blocks(texts, langs: np.ndarray, size: int, ahead: int) -> Iterator[Block]:
    """Blocks of about `size` bytes of a string array without nulls; each ends with a word and is followed by `ahead` more words that
    only complete its phrases. A long text is cut between words like any other."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    ends = offsets - offsets[0]

    def after(at: int, words: int) -> int:
        """The end of the word that spans `at`, and of `words` more."""
        span = 1 << 10
        while at < len(data):
            stop = min(len(data), at + span)
            word = _KIND[data[at - 1 : stop]] == 0
            closed = word[:-1] & ~word[1:]
            inner = ends[(ends > at) & (ends < stop)] - at
            closed[inner] |= word[inner]
            if word[0] and at in ends:  # a text ends here
                closed[0] = True
            stops = np.flatnonzero(closed)
            need = words + bool(word[0])
            if need == 0:
                return at
            if len(stops) >= need:
                return at + int(stops[need - 1])
            if stop == len(data):
                return stop
            span *= 4
        return len(data)

    at = 0
    while at < len(data):
        own = after(at + size, 0) if at + size < len(data) else len(data)
        stop = after(own, ahead) if own < len(data) else own
        low, high = np.searchsorted(ends, at, "right") - 1, np.searchsorted(ends, stop, "left")
        yield Block(data[at:stop], np.clip(ends[low : high + 1], at, stop) - at, own - at, langs[low:high])
        at = own


def _bitmap(frequent: DataFrame, size: int) -> np.ndarray:
    """A bit for each frequent (lang, phrase) of `size` words, by hash; its size is bounded whatever their number."""
    n = frequent.count()
    bits = min(MOST_BITS, 1 << max(16, (BITS_EACH * n).bit_length()))

    def place(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            key = _hashes(batch.column(0).to_pylist())
            words = pc.list_flatten(pc.split_pattern(batch.column(1), " "))
            hashes = _hashes(words.to_pylist()).reshape(len(batch), size)
            for i in range(size):
                key = _follow(key, hashes[:, i])
            at = key & np.uint64(bits - 1)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["word", "bit"])

    rows = frequent.select("lang", "phrase").mapInArrow(frugal(place), "word long, bit long")
    found = rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # MOST_BITS / 64 rows at most
    out = np.zeros(bits // 64, np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint64)


def _counted(docs: DataFrame, size: int, bitmaps: list[np.ndarray], block: int) -> DataFrame:
    """(lang, phrase, f): frequencies of the phrases of `size` words all of whose shorter phrases pass the bitmaps; at size 1 also the number of
    all words, with a null phrase."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmaps)  # MOST_BITS bits each

    def count(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            coded = pc.fill_null(batch.column(0), "und").dictionary_encode()
            names = coded.dictionary
            seeds = _hashes(names.to_pylist())
            texts = pc.ascii_lower(pc.fill_null(batch.column(1), ""))
            for b in text_blocks(texts, coded.indices.to_numpy().astype(np.int64), block, size - 1):
                lists = postings = b.words(seeds)
                for level in range(1, size):
                    lists = lists.where(shared.value[level - 1])
                    if level == 1:
                        postings = lists
                    lists = b.extend(lists, postings, level + 1)
                text, lang, n = b.counted(lists, size)
                if not len(text):
                    continue
                yield pa.RecordBatch.from_arrays([names.take(pa.array(lang)), text, pa.array(n, pa.int64())], ["lang", "phrase", "f"])
                if size == 1:
                    total = np.bincount(lang, weights=n, minlength=len(names)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([names, pa.nulls(len(names), pa.string()), pa.array(total, pa.int64())], ["lang", "phrase", "f"])

    return docs.mapInArrow(frugal(count), "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def frequent_phrases(docs: DataFrame, *, least: int = 30, longest: int = 4, lang_col: str = "lang", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """lang, phrase, size, f: each phrase of 1 to `longest` words that occurs `least` times or more in a language, with its exact
    frequency, and for each language a row of size 0 with the number of all its words.

    Texts are lower-cased (A-Z), split at . , ; : ! ? and line breaks into pieces and those at blanks and tabs into words; a phrase is
    contiguous within a piece. Every sub-phrase of a frequent phrase is frequent, which is what the bitmaps prune by. Null texts are empty,
    a null language is `und`; repeated rows count each; texts of any length are handled in blocks; an empty table gives no rows.
    Other columns are ignored, whatever their names."""
    docs = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    bitmaps: list[np.ndarray] = []
    levels = []
    for size in range(1, longest + 1):
        found = _counted(docs, size, bitmaps, block)
        kept = stage_table(found.where((F.col("f") >= least) | F.col("phrase").isNull()))
        levels.append(kept.select("lang", "phrase", F.when(F.col("phrase").isNull(), 0).otherwise(size).alias("size"), "f"))
        if size < longest:
            bitmaps.append(_bitmap(kept.where(F.col("phrase").isNotNull()), size))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def _wide(c: str | Column) -> Column:
    return F.col(c).cast("decimal(20,0)") if isinstance(c, str) else c.cast("decimal(20,0)")


def collocations(frequent: DataFrame, *, first: int = 2000, scale: int = 2_000_000, share: int = 80) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `first` phrases of each language by score, a, phrase (bytes).

    A phrase of a occurrences cut after k words has l, those of its first part, r, those of the rest, and floor(scale * a / (l + r)); its lowest
    cut counts, the smallest k on a tie. Phrases inside a longer frequent one with 100 * f(longer) >= share * a are dropped. All in
    whole numbers of up to 38 digits. A language without frequent phrases has no rows."""
    parts = frequent.where("size > 0").select("lang", "phrase", "f")
    whole = frequent.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"))

    words = F.split("phrase", " ")
    spans = F.expr("flatten(transform(sequence(2, size - 1), w -> transform(sequence(1, size - w + 1), i -> array_join(slice(words, i, w), ' '))))")
    inner = whole.where("size > 2").withColumn("words", words).select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "a")
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    held = whole.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (_wide("longer") * 100 < _wide("a") * share)).drop("longer")

    cuts = held.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).withColumn("head", F.expr("substring_index(phrase, ' ', k)"))
    cuts = cuts.withColumn("tail", F.expr("substring(phrase, length(head) + 2)"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(parts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    cuts = cuts.withColumn("wide", _wide("a") * scale).withColumn("both", _wide("l") + _wide("r")).withColumn("score", F.expr("wide div both"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))

    order = [F.desc("c.score"), F.desc("a"), F.asc("phrase")]
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    ahead = scored.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= first)  # SALTS * first rows a language at most
    ranked = ahead.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)
    totals = frequent.where("size = 0").select("lang", F.col("f").alias("n"))
    out = ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "c.l", "c.r", "n", "c.score")
    return out.select(*(F.col(c).cast("long").alias(c) if c not in ("lang", "phrase") else c for c in out.columns))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(frequent_phrases(table(spark, sf_dir, "documents")))


OP12_SQL = r"""
WITH w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws
           FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3), (4)) t(k) WHERE len(ws) >= k),
tot AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang),
f AS (SELECT lang, phrase, k AS size, count(*)::HUGEINT AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE size > 1),
sub AS (SELECT lang, phrase, max(f) AS longer FROM (SELECT lang, f, unnest(flatten(list_transform(range(2, size), lambda m: list_transform(range(1, size - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))))) AS phrase FROM c WHERE size > 2) GROUP BY ALL),
h AS (SELECT c.* FROM c LEFT JOIN sub USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * f),
cut AS (SELECT h.lang, h.phrase, h.f AS a, t.k, array_to_string(ws[1:t.k], ' ') AS head, array_to_string(ws[t.k + 1:], ' ') AS tail FROM h, (VALUES (1), (2), (3)) t(k) WHERE t.k < size),
s AS (SELECT cut.*, x.f AS l, y.f AS r, 2000000 * a // (x.f + y.f) AS score FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = head JOIN f y ON y.lang = cut.lang AND y.phrase = tail),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM o JOIN tot USING (lang) WHERE rank <= 2000
"""
