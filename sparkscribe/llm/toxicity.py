"""Toxicity by a weighted lexicon: Aho-Corasick over folded text, exception phrases, length normalisation."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_fold, frugal, table, trim

#: Letters that look like Latin ones (Cyrillic, then Greek), and digits or signs read as letters.
HOMOGLYPHS = dict(zip("аеіјорсухѕԁһӏвкмнтАЕІЈОРСУХЅВКМНТ", "aeijopcyxsdhlbkmhtaeijopcyxsbkmht")) | dict(zip("αεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeiknoptuxabezhikmnoptyx"))
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}

#: Runs of digits and signs; one counts as letters where a letter follows. A run is taken whole, so each is looked at once.
_LEET = re.compile(r"[0134578@$]++")
_AS_LETTERS = str.maketrans(DIGITS)
_LETTER = re.compile(r"[^\W\d_]")
_ZERO_WIDTH = re.compile("[­​-‍⁠﻿]")


class _Fold(dict):
    def __missing__(self, code: int):
        ch = chr(code)
        self[code] = HOMOGLYPHS.get(ch, ch) if ch.isalpha() or "̀" <= ch <= "ͯ" else " "
        return self[code]


_FOLD = _Fold()


def fold(text: str) -> str:
    """Lower case, look-alikes and digit substitutions replaced, words parted and enclosed by one space."""
    text = _LEET.sub(lambda m: m[0].translate(_AS_LETTERS) if _LETTER.match(text, m.end()) else m[0], text)
    if not text.isascii():
        text = _ZERO_WIDTH.sub("", text)
    return f" {' '.join(text.translate(_FOLD).lower().split())} "


@dataclass
class Lexicon:
    """entries: a pattern with a leading space matches at the start of a word, with a trailing one also to its end."""

    entries: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    bias: float = -3.0
    _automaton: object = None

    def __getstate__(self):
        return {"entries": self.entries, "exceptions": self.exceptions, "bias": self.bias, "_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            found = ahocorasick.Automaton()
            for p, w in self.entries.items():
                found.add_word(p, (len(p), w))
            for p in self.exceptions:
                found.add_word(f" {p} ", (len(p) + 2, None))
            if len(found):
                found.make_automaton()
            self._automaton = found
        return self._automaton

    def hits(self, folded: str) -> Iterator[tuple[int, int, float]]:
        """(start, end, weight) of the entries that occur outside exception phrases."""
        if not len(self.automaton()):
            return
        matches = [(end + 1 - n, end + 1, w) for end, (n, w) in self.automaton().iter(folded)]
        spared = sorted((s, e) for s, e, w in matches if w is None)
        starts = [s for s, _ in spared]
        reach = list(accumulate((e for _, e in spared), max))  # the furthest end of the phrases that start up to here
        for s, e, w in matches:
            if w is not None:
                at = bisect_right(starts, s)
                if not at or reach[at - 1] < e:
                    yield s, e, w

    def amounts(self, folded: str) -> dict[str, float]:
        """For each entry found one plus the logarithm of its hits, over the text's norm: repeats count less and less."""
        times = Counter(folded[s:e] for s, e, _ in self.hits(folded))
        words = norm(folded.count(" ") - 1)
        return {f: (1 + math.log(n)) / words for f, n in times.items()}

    def score(self, text: str | None) -> float:
        folded = fold(text or "")
        total = sum(self.entries[f] * n for f, n in self.amounts(folded).items())
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.bias + total))))


def norm(words: int) -> float:
    return 1 + math.log2(1 + max(0, words)) / 8


def _features(folded: str) -> set[str]:
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        out.update(f" {w[:n]}" for n in range(4, min(8, len(w) + 1)))
    return out


def fit_lexicon(rows: list[tuple[str, int]], *, share: float | None = None, entries: int = 300, least: int = 4, lift: float = 4.0, exceptions: list[str] | None = None, rounds: int = 250) -> Lexicon:
    """Learn entries, weights and exception phrases from (text, label) rows.

    Candidates are words and word beginnings in `least` or more different toxic texts that are `lift` times as frequent among toxic texts as
    among others; copies count once, and of beginnings with equal counts the longest stays. A logistic regression on
    length-normalised hits gives the weights; `share` is the labels' true share of toxic rows where the rows were drawn by label.
    """
    seen: dict[str, int] = {}
    for text, label in rows:
        seen.setdefault(fold(text or ""), label)
    texts, labels = list(seen), np.array([*seen.values()], np.float32)
    if not len(texts) or labels.min() == labels.max():
        return Lexicon({}, exceptions or [], 0.0 if not len(texts) else (3.0 if labels[0] else -3.0))
    toxic = Counter()
    for t, y in zip(texts, labels):
        if y:
            toxic.update(_features(t))
    toxic = {f: n for f, n in toxic.items() if n >= least}
    clean = Counter()
    for t, y in zip(texts, labels):
        if not y:
            clean.update(f for f in _features(t) if f in toxic)
    n_toxic, n_clean = float(labels.sum()), float((1 - labels).sum())
    odds = {f: (toxic[f] / n_toxic) / ((clean[f] + 0.5) / n_clean) for f in toxic}
    ranked = sorted((f for f in toxic if odds[f] >= lift), key=lambda f: (-toxic[f] * math.log(odds[f]), -len(f), f))
    chosen: list[str] = []
    longer: set[tuple[str, int, int]] = set()  # beginnings of a chosen entry with its counts
    for f in ranked:
        if (f, toxic[f], clean[f]) not in longer and len(chosen) < entries:
            chosen.append(f)
            longer.update((f[:n], toxic[f], clean[f]) for n in range(5, len(f)))
    lexicon = Lexicon(dict.fromkeys(chosen, 1.0), list(exceptions or []))
    phrases: dict[str, list[int]] = {}
    for t, y in zip(texts, labels):
        for s, e, _ in lexicon.hits(t):
            end = e if t[e - 1] == " " else t.index(" ", e - 1) + 1
            before, after = t.rfind(" ", 0, s), t.find(" ", end)
            for phrase in {t[before + 1 : end].strip() if before >= 0 else "", t[s:after].strip() if after > 0 else ""}:
                if " " in phrase:
                    phrases.setdefault(phrase, [0, 0])[int(y)] += 1
    lexicon = Lexicon(lexicon.entries, sorted({*lexicon.exceptions, *(p for p, n in phrases.items() if n[0] >= 5 and n[0] >= 9 * n[1])}))
    at = {f: i for i, f in enumerate(chosen)}
    x = np.zeros((len(texts), len(chosen)), np.float32)
    for row, t in enumerate(texts):
        for f, n in lexicon.amounts(t).items():
            x[row, at[f]] = n
    w, b, m, v, mb, vb = np.zeros(len(chosen), np.float32), -2.0, 0.0, 0.0, 0.0, 0.0
    rate = n_toxic / len(texts)
    share = rate if share is None else min(0.99, max(0.001, share))
    weight = np.where(labels > 0, share / rate, (1 - share) / (1 - rate)).astype(np.float32)
    for k in range(1, rounds + 1):  # full-batch Adam
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        error = (p - labels) * weight
        g, gb = x.T @ error / len(texts) + 1e-5 * w, float(np.mean(error))
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w = w - 0.2 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        b -= 0.1 * (mb / (1 - 0.9**k)) / (math.sqrt(vb / (1 - 0.99**k)) + 1e-8)
    lexicon.entries = {f: float(a) for f, a in zip(chosen, w)}
    lexicon.bias = float(b)
    lexicon._automaton = None
    del x, toxic, clean
    trim()
    return lexicon


def training_rows(docs: DataFrame, labels: DataFrame, *, per_label: int = 3000, max_bytes: int = 20 << 20) -> tuple[list[tuple[str, int]], float | None]:
    """(text, label) of a bounded sample, and the share of toxic rows among all training labels. For each label, up to per_label
    labelled training rows in the order of a hash of the id, up to half of max_bytes each; a document over a 64th of max_bytes is
    not drawn. Whole texts."""
    train = F.coalesce(crc_fold("doc_id", 5) != 0, F.lit(False))
    by = Window.partitionBy("label").orderBy("h", "doc_id")
    known = labels.where(train & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    counts = known.groupBy("label").agg(F.count(F.lit(1)).alias("total"))
    known = known.withColumn("h", F.xxhash64("doc_id")).join(F.broadcast(counts), "label")  # two rows
    # the hash thins each label to about one and a half times what is drawn, so the window sees a bounded number of rows
    known = known.where(F.pmod("h", F.lit(1 << 40)) <= (1 << 40) * 1.5 * per_label / F.col("total"))
    drawn = known.withColumn("r", F.row_number().over(by)).where(F.col("r") <= per_label)
    # at most 2 * per_label rows of an id, a label and a hash
    short = docs.where(F.col("text").isNotNull()).select("doc_id", "text", F.octet_length("text").alias("n")).where(F.col("n") <= max_bytes // 64)
    rows = short.join(F.broadcast(drawn.limit(2 * per_label)), "doc_id").withColumn("b", F.sum("n").over(by)).where(F.col("b") <= max_bytes // 2)
    totals = {r.label: r.total for r in counts.collect()}
    share = totals.get(1, 0) / max(1, sum(totals.values())) if totals else None
    return [(r.text, r.label) for r in rows.select("text", "label").collect()], share


def toxicity(docs: DataFrame, lexicon: Lexicon, *, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, score, predicted.

    The score is the logistic of a bias plus, for each entry found, its weight times 1 + ln(hits), over 1 + log2(1 + words) / 8. Null and empty texts
    have no hits; null ids, ties and repeated rows give rows like any others; an empty table gives none; other
    columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # a bounded number of entries

    def rate(batches):
        import pyarrow as pa

        model = shared.value
        for batch in batches:
            scores = [model.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], ["id", "score", "predicted"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(frugal(rate), f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows, share = training_rows(docs, table(spark, sf_dir, "labels"))
    lexicon = fit_lexicon(rows, share=share)
    return toxicity(docs, lexicon).select("doc_id", F.coalesce(crc_fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
