"""Text expressions: cleaning, normalising, identifiers, titles. All run inside Catalyst."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkscribe.functions.vector import bind

#: White space as Unicode has it, with the four separators U+001C to U+001F.
SPACE = r"[\s\x1c-\x1f]"
#: The same, one by one.
SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

#: Ligatures of typeset documents and their letters.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ft", "ﬆ": "st"}

#: A paragraph that contains one of these counts as a title.
TITLE_KEYWORDS = ("chapter", "introduction", "system theory", "image processing", "signals and systems", "fourier transform", "convolution", "correlation", "morphological operators")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def normalize_text(c: Column) -> Column:
    """One space for each run of white space, none at the ends, lower case."""
    return F.lower(strip(F.regexp_replace(c, rf"(?U){SPACE}+", " ")))


def content_hash(c: Column) -> Column:
    return F.sha2(normalize_text(c), 256)


def slugify(c: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(strip(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(slug == "", "unknown").otherwise(slug)


def concept_id(name: Column, kind: Column) -> Column:
    return F.concat_ws("::", slugify(kind), slugify(name))


def tokens(c: Column) -> Column:
    """The distinct runs of letters and digits of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def overlap_ratio(query: Column, text: Column, prefix: int | None) -> Column:
    """The share of the query's tokens that the text has, in its first `prefix` characters or, with None, anywhere."""
    q, t = tokens(query), F.coalesce(text, F.lit(""))
    return F.size(F.array_intersect(q, tokens(t if prefix is None else F.substring(t, 1, prefix)))) / F.greatest(F.lit(1), F.size(q))


def preview(c: Column, n: int = 350) -> Column:
    return F.substring(F.coalesce(c, F.lit("")), 1, n)


def estimate_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4).cast("int"))


def clean_aliases(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), strip), lambda a: a != "")))


def clean_text(c: Column) -> Column:
    """Line ends, ligatures, broken hyphens, page-number lines, wrapped lines and blanks of an extracted page; null gives ''."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), "\r\n?", "\n")
    for old, new in LIGATURES.items():
        t = F.replace(t, F.lit(old), F.lit(new))
    t = F.regexp_replace(t, r"-\n(?=[\p{L}\p{N}_])", "-")
    lines = F.filter(F.transform(F.split(t, "\n"), strip), lambda x: ~x.rlike(r"(?U)^\d+$"))
    t = strip(F.regexp_replace(F.array_join(lines, "\n"), "[ \t]+", " "))
    return F.array_join(F.transform(F.split(t, "\n{2,}"), lambda p: F.replace(p, F.lit("\n"), F.lit(" "))), "\n\n")


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n\n"), strip), lambda p: p != "")


def is_title(c: Column) -> Column:
    """Holds a title keyword, or is short, few words, and does not end like a sentence."""
    words = F.size(F.filter(F.split(c, rf"(?U){SPACE}+"), lambda w: w != ""))
    keyword = bind(F.lower(c), lambda low: functools.reduce(operator.or_, (F.contains(low, F.lit(k)) for k in TITLE_KEYWORDS)))
    return (F.coalesce(c, F.lit("")) != "") & (keyword | ((F.length(c) < 80) & ~c.rlike("[.!?;:]$") & (words <= 8)))


def _object(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit(""))


def recover_json(c: Column, schema: str) -> Column:
    """Parse a reply that may hold text around its object: as it is, else from the first brace to the last; null if neither parses."""
    whole, inner = F.when(F.try_parse_json(c).isNotNull(), c), _object(c)
    return F.from_json(F.coalesce(whole, F.when(F.try_parse_json(inner).isNotNull(), inner)), schema)


def recovered(c: Column) -> Column:
    """The same as a variant, whatever its type."""
    return F.coalesce(F.try_parse_json(c), F.try_parse_json(_object(c)))
