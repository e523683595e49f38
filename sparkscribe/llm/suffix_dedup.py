"""Suffix-array dedup of repeated byte strings."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .repeats import Owners, Unit, apply_spans, keyed, repeated_spans
from .suffixes import common_prefixes, first_places, left_of, suffix_array


def covered_places(symbols: np.ndarray, offsets: np.ndarray, owners: Owners, window: int) -> np.ndarray:
    """For each place of a shard whether the window that starts there occurred earlier: the runs of the suffix array whose neighbours
    share a window or more, all but the first place of each. A place of two overlapping texts of a document is one place."""
    sa = suffix_array(symbols, offsets)
    first = first_places(sa, common_prefixes(symbols, offsets, sa), left_of(offsets), window)
    p = np.flatnonzero((first >= 0) & (first != np.arange(len(first))))
    head = first[p]
    region = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = lambda x: x - offsets[region[x]] + owners.at[region[x]]
    other = (owners.documents[region[p]] != owners.documents[region[head]]) | (at(p) != at(head))
    covered = np.zeros(len(symbols), bool)
    covered[p[other]] = True
    return covered


def remove_repeats(docs: DataFrame, *, window: int = 100, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), texts: bool = False) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256, kept columns, and with `texts` the kept text.

    Removes each byte covered by a window that also starts earlier: in a smaller id, or earlier in the same document. Judged on the input;
    matches never cross documents. Null text is empty; null ids come after all others; rows that repeat an id
    and a text count as one document and do not cover each other, rows of one id with different texts are ordered by a hash of the text. An empty
    table gives no rows. In kept texts, bytes that no longer form a character are dropped.
    """
    out = _removed(docs, window, id_col, text_col, (id_col, *(c for c in keep if c != id_col)), texts)
    return out.withColumnsRenamed({c: c[2:] for c in out.columns if c.startswith("k_")})


def _removed(docs: DataFrame, window: int, id_col: str, text_col: str, keep: tuple[str, ...], texts: bool) -> DataFrame:
    rows = keyed(docs, id_col, text_col, keep)
    spans = repeated_spans(rows, Unit(window, min(24, window), False, True), covered_places)

    def finish(data, lo, hi):
        raw = data or b""
        kept = b"".join(raw[a:b] for a, b in zip([0, *hi.tolist()], [*lo.tolist(), len(raw)]))
        found = [len(raw), len(raw) - len(kept), len(lo), hashlib.sha256(kept).hexdigest()]
        return [*found, None if data is None else kept.decode("utf-8", "ignore")] if texts else found

    schema = T.StructType().add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")
    return apply_spans(rows, spans, finish, schema.add("kept_text", "string") if texts else schema)


def without_repeats(docs: DataFrame, *, window: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all rows and columns, with the kept text in place of the text."""
    others = tuple(c for c in docs.columns if c != text_col)
    out = _removed(docs, window, id_col, text_col, others, True)
    return out.select(*(F.col("kept_text" if c == text_col else f"k_{c}").alias(c) for c in docs.columns))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT doc_id, i, md5(x[2 * i - 1:2 * i + 198]) AS h FROM (SELECT doc_id, x, unnest(range(1, len(x) // 2 - 98)) AS i FROM d WHERE len(x) >= 200)),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS r FROM win),
cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + 100)) AS j FROM ranked WHERE r > 1),
span AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, j, lag(j) OVER (PARTITION BY doc_id ORDER BY j) AS p FROM cov) WHERE p IS NULL OR p < j - 1 GROUP BY doc_id),
pos AS (SELECT doc_id, x[2 * j - 1:2 * j] AS b, j FROM (SELECT doc_id, x, unnest(range(1, len(x) // 2 + 1)) AS j FROM d)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(b, '' ORDER BY j) AS t FROM pos ANTI JOIN cov USING (doc_id, j) GROUP BY doc_id)
SELECT d.doc_id, (len(d.x) // 2)::BIGINT AS n_bytes, (len(d.x) // 2 - coalesce(k.n, 0))::BIGINT AS n_removed, coalesce(s.n, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(k.t, ''))) AS kept_sha256
FROM d LEFT JOIN kept k USING (doc_id) LEFT JOIN span s USING (doc_id)
"""
