"""Substring dedup by relative Lempel-Ziv parsing."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import table
from .repeats import Owners, Unit, apply_spans, keyed, repeated_spans
from .suffixes import common_prefixes, longest_before, suffix_array


def factors(longest: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the factors of all texts of a shard, parsed greedily side by side, from the longest match at each place.

    A factor is the longest match of the reference at its place; the next one starts at its end, a word that does not match is passed
    over. At each boundary the places inside the factor are checked: where a match of a window or more starts
    there and reaches over the boundary, the parse goes on from the first such place.
    """
    n = len(longest)
    long = np.where(longest >= window, np.arange(n), n)
    following = np.append(np.minimum.accumulate(long[::-1])[::-1], n)  # the next place with a match of a window or more
    size = np.diff(offsets)
    place, stop = offsets[:-1][size >= window], offsets[1:][size >= window]
    starts, lengths = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while len(place):
        length = longest[place]
        starts.append(place)
        lengths.append(length)
        end = place + np.maximum(1, length)
        inside = following[np.maximum(place + 1, end - window + 1)]  # an earlier window ends inside the factor
        place = np.minimum(end, inside)
        on = place + window <= stop
        place, stop = place[on], stop[on]
    return np.concatenate(starts), np.concatenate(lengths)


def parse(symbols: np.ndarray, offsets: np.ndarray, owners: Owners, window: int) -> np.ndarray:
    """Relative Lempel-Ziv: for each place whether a window starts there that a text of a smaller id in the shard has.

    The shard is indexed once, by a suffix array of its words with common prefixes. The reference of a text is all text of smaller ids;
    each text is cut into factors against it, and the windows inside a factor are those found.
    """
    place_owner = np.repeat(owners.ids, np.diff(offsets))
    sa = suffix_array(symbols, offsets)
    longest, _ = longest_before(sa, common_prefixes(symbols, offsets, sa), place_owner)
    start, length = factors(longest, offsets, window)
    some = length >= window
    depth = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(depth, start[some], 1)
    np.add.at(depth, (start + length)[some] - window + 1, -1)
    return np.cumsum(depth[:-1]) > 0


def remove_substrings(docs: DataFrame, *, window: int = 50, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), texts: bool = False) -> DataFrame:
    """id, n_words, n_removed, kept_sha256, kept columns, and with `texts` the kept words joined by a space.

    Removes each word covered by a window of `window` words that also starts in a document with a smaller id, judged on the input. Null text
    has no words; null ids come after all others and not before each other; rows that repeat an id do not cover each
    other. An empty table gives no rows.
    """
    unit = Unit(window, min(8, window), True, False)
    rows = keyed(docs, id_col, text_col, (id_col, *(c for c in keep if c != id_col)))
    spans = repeated_spans(rows, unit, parse)

    def finish(data, lo, hi):
        words = (data or b"").split()
        kept = [w for a, b in zip([0, *hi.tolist()], [*lo.tolist(), len(words)]) for w in words[a:b]]
        text = b" ".join(kept)
        found = [len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest()]
        return [*found, None if data is None else text.decode("utf-8", "replace")] if texts else found

    schema = T.StructType().add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")
    out = apply_spans(rows, spans, finish, schema.add("kept_text", "string") if texts else schema)
    return out.withColumnsRenamed({c: c[2:] for c in out.columns if c.startswith("k_")})


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_substrings(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
least_ AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM win JOIN least_ USING (h) WHERE m < doc_id),
pos AS (SELECT doc_id, w[j] AS word, j FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM d)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS t FROM pos ANTI JOIN cov USING (doc_id, j) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN kept k USING (doc_id)
"""
