"""Language ID by language-bitmask n-gram filters: bit-sliced Bloom filters looked up once for all languages."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_fold, cut, frugal, table, trim
from .rolling import BYTE, arrow_bytes, mix, runs, slices, sums

#: Bytes of an n-gram, log2 of the filter's slots, look-ups for each n-gram.
GRAM, SLOT_BITS, LOOKUPS = 4, 22, 2
#: Languages of one filter word.
WORD = 64

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)


def _grams(texts, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's n-grams, end to end, and offsets. Letters in lower case, all else one space; one space at both ends."""
    import pyarrow.compute as pc

    raw, ends = arrow_bytes(pc.utf8_lower(texts))
    n = len(ends) - 1
    data = np.full(len(raw) + 2 * n, 32, np.uint8)  # two spaces between documents
    doc = np.repeat(np.arange(n), np.diff(ends))
    data[np.arange(len(raw)) + 2 * doc + 1] = _FOLD[raw]
    edges = ends + 2 * np.arange(n + 1)
    blank = data == 32
    keep = np.ones(len(data), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[edges[:-1]] = True
    offsets = np.concatenate(([0], np.cumsum(keep)))[edges]
    hashes = mix(runs(BYTE[data[keep]], gram))
    starts = offsets[:-1]
    stops = np.maximum(offsets[1:] - gram + 1, starts)
    inside = np.zeros(offsets[-1] + 1, np.int64)
    np.add.at(inside, starts, 1)
    np.add.at(inside, stops, -1)
    valid = np.cumsum(inside)[: len(hashes)] > 0
    return hashes[valid], np.concatenate(([0], np.cumsum(stops - starts)))


def _bit(words: np.ndarray, language: int) -> np.ndarray:
    return (words >> words.dtype.type(language % WORD)) & words.dtype.type(1)


@dataclass
class LanguageFilters:
    languages: list[str]
    masks: np.ndarray  # words x slots: bit l % 64 of a slot's word l // 64 is set if an n-gram of language l falls there
    gram: int
    lookups: int
    rate: np.ndarray | None = None

    def _slots(self, hashes: np.ndarray, i: int) -> np.ndarray:
        bits = self.masks.shape[1].bit_length() - 1
        return ((mix(hashes + np.uint64(i)) if i else hashes) >> np.uint64(64 - bits)).astype(np.int64)

    def false_rate(self) -> np.ndarray:
        """For each language the chance that an n-gram it has never seen passes all look-ups."""
        return np.array([np.mean(_bit(self.masks[i // WORD], i)) ** self.lookups for i in range(len(self.languages))])

    def add(self, language: int, hashes: np.ndarray) -> None:
        for i in range(self.lookups):
            self.masks[language // WORD][self._slots(hashes, i)] |= self.masks.dtype.type(1 << language % WORD)

    def shares(self, texts) -> np.ndarray:
        """Documents x languages: the share of n-grams that a language contains, corrected for false positives."""
        hashes, offsets = _grams(texts, self.gram)
        slots = [self._slots(hashes, i) for i in range(self.lookups)]
        total = np.maximum(np.diff(offsets), 1)
        if self.rate is None:
            self.rate = self.false_rate()
        false = self.rate
        out = np.empty((len(offsets) - 1, len(self.languages)))
        for i in range(len(self.languages)):
            if i % WORD == 0:
                word = self.masks[i // WORD]
                found = word[slots[0]]
                for other in slots[1:]:
                    found &= word[other]
            hit = sums(_bit(found, i), offsets) / total
            out[:, i] = np.clip((hit - false[i]) / max(1e-9, 1 - false[i]), 0, 1)
        return out


def fit_filters(rows: list[tuple[str, str]], *, gram: int = GRAM, slot_bits: int = SLOT_BITS, lookups: int = LOOKUPS, least: int = 2) -> LanguageFilters:
    """Filters from (language, text) rows. An n-gram enters a language's filter if it occurs `least` times there, and at
    a rate of a tenth or more of its rate in any other language, so that foreign passages do not fill the filter."""
    import pyarrow as pa

    own: dict[str, list[str]] = {}
    for lang, text in rows:
        own.setdefault(lang, []).append(text)
    languages = sorted(own)
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if min(len(languages), WORD) <= 8 * np.dtype(t).itemsize)
    model = LanguageFilters(languages, np.zeros((max(1, -(-len(languages) // WORD)), 1 << slot_bits), kind), gram, lookups)
    seen = []
    for lang in languages:
        texts = pa.array(own[lang], pa.large_string())
        hashes = np.sort(np.concatenate([np.empty(0, np.uint64), *(_grams(texts.slice(a, n), gram)[0] for a, n in slices(texts))]))
        heads = np.flatnonzero(np.diff(hashes, prepend=hashes[:1] + np.uint64(1)))
        seen.append((hashes[heads], np.diff(np.append(heads, len(hashes))), max(1, len(hashes))))
    every = np.concatenate([np.empty(0, np.uint64), *(keys for keys, _, _ in seen)])
    least_rate = np.concatenate([np.empty(0), *(0.1 * counts / total for _, counts, total in seen)])
    order = np.argsort(every)
    heads = np.flatnonzero(np.diff(every[order], prepend=every[order][:1] + np.uint64(1)))
    every, least_rate = every[order][heads], np.maximum.reduceat(least_rate[order], heads) if len(heads) else least_rate
    for i, (keys, counts, total) in enumerate(seen):
        model.add(i, keys[(counts >= least) & (counts / total >= least_rate[np.searchsorted(every, keys)])])
    del seen, every, least_rate, order, heads
    trim()
    return model


def training_rows(docs: DataFrame, train, *, per_language: int = 1000, max_bytes: int = 8 << 20) -> list[tuple[str, str]]:
    """A bounded sample of labelled rows: per language, up to per_language documents in the order of a hash of id and text, up to max_bytes
    over all languages, of which each has an equal share, a sixty-fourth at least however many there are; a document over a sixty-fourth
    is not drawn. Whole texts. Rows that repeat id, language and text are one; an id with several languages or texts is several rows. Reruns
    draw the same rows."""
    usable = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= max_bytes // 64))
    key = ["lang", "doc_id", "th"]
    known = usable.select("lang", "doc_id", F.xxhash64("text").alias("th"), F.octet_length("text").alias("n")).groupBy(*key).agg(F.max("n").alias("n"))
    known = cut(known.withColumn("h", F.xxhash64("doc_id", "th")))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("total"))
    # the hash thins each language to about one and a half times what is drawn, so the window sees a bounded number of rows
    thin = known.join(counts, "lang").where(F.pmod("h", F.lit(1 << 40)) <= (1 << 40) * 1.5 * per_language / F.col("total"))
    by = Window.partitionBy("lang").orderBy("h", "doc_id", "th")
    drawn = thin.withColumn("r", F.row_number().over(by)).where(F.col("r") <= per_language)
    n_langs = max(1, drawn.select("lang").distinct().count())
    drawn = drawn.withColumn("b", F.sum("n").over(by)).where(F.col("b") <= max_bytes // min(n_langs, 64)).select(*key)
    # at most per_language rows a language, each once
    chosen = usable.select("lang", "doc_id", F.xxhash64("text").alias("th"), "text").join(F.broadcast(drawn), key).groupBy(*key).agg(F.first("text").alias("text"))
    return [(r.lang, r.text) for r in chosen.orderBy(*key).select("lang", "text").collect()]


def identify(docs: DataFrame, model: LanguageFilters, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, kept columns, lang_pred, score. The language with the largest corrected share of the text's n-grams wins, the
    first by name on a tie; score is that share. `und`, score 0, if text is null or has no letter, or if no
    language was learned. Null ids and repeated rows pass through; an empty table gives no rows.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), *keep)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # 2 ** slot_bits words, whatever the data
    schema = source.drop("_text").schema.add("lang_pred", "string").add("score", "double")

    def predict(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        filters = shared.value
        names = np.array([*filters.languages, "und"], dtype=object)
        for batch in batches:
            for at, n in slices(batch.column(1)):
                part = batch.slice(at, n)
                text = part.column(1)
                letters = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                if filters.languages:
                    shares = filters.shares(text)
                    best = shares.argmax(1)
                    score = shares[np.arange(len(best)), best]
                else:
                    letters, best, score = np.zeros(len(text), bool), np.zeros(len(text), int), np.zeros(len(text))
                pred = names[np.where(letters, best, len(names) - 1)]
                columns = [c for i, c in enumerate(part.columns) if i != 1]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(pred, pa.string()), pa.array(np.where(letters, score, 0.0))], [*(n for n in part.schema.names if n != "_text"), "lang_pred", "score"])

    return source.mapInArrow(frugal(predict), schema)


def accepted(docs: DataFrame, model: LanguageFilters, *, least: float = 0.2, short: int = 50, text_col: str = "text") -> DataFrame:
    """The rows, unchanged, whose text has a letter and, from `short` characters on, a language that holds at least `least` of
    its n-grams. Null texts go; an empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    at = docs.columns.index(text_col)

    def keep(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        filters = shared.value
        for batch in batches:
            for start, n in slices(batch.column(at)):
                part = batch.slice(start, n)
                text = part.column(at)
                letters = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                best = filters.shares(text).max(1) if filters.languages else np.ones(n)
                own = letters & ((best >= least) | (pc.fill_null(pc.utf8_length(text), 0).to_numpy() < short))
                if own.any():
                    yield part if own.all() else part.filter(pa.array(own))

    return docs.mapInArrow(frugal(keep), docs.schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_filters(training_rows(docs, F.coalesce(crc_fold("doc_id", 4) != 2, F.lit(False))))
    return identify(docs, model).select("doc_id", F.coalesce(crc_fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
