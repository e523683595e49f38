"""SimHash near-duplicates: one-wildcard variants of two segments, equality join, verification, components."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, frugal, numbered, spread, stage_table, table
from .components import components
from .repeats import NO_ID, marked, only

#: A variant shared by more fingerprints than this is not joined with itself; its members go by the one-bit neighbourhoods.
BUCKET = 64

#: Shingles hashed at once.
STEP = 1 << 16

_BLANK = re.compile(rb"[ \t\n\v\f\r]")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _spaced(data: bytes) -> bytes:
    """The words of a lower-cased text parted by one space; a long text in parts that end at white space, so only a part's words are listed."""
    out, at = [], 0
    while at < len(data):
        stop = at + STEP * 16
        if stop < len(data):
            blank = _BLANK.search(data, stop)
            stop = blank.start() if blank else len(data)
        out.append(b" ".join(data[at:stop].split()))
        at = stop
    return b" ".join(x for x in out if x)


def fingerprint(data: bytes, shingle: int = 3) -> bytes:
    """The 8 bytes, most significant first: a bit is set if set in over half the hashes of all shingles, repeats included."""
    import xxhash

    text, digest = _spaced(data.translate(_LOWER)), xxhash.xxh64_digest
    if not text:
        return bytes(8)
    blanks = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    starts, ends = np.concatenate(([0], blanks + 1)), np.append(blanks, len(text))
    n, times = len(starts) - shingle + 1, np.zeros(64, np.int64)
    if n <= 1:
        return digest(text, 42)
    for at in range(0, n, STEP):
        to = min(n, at + STEP)
        hashes = b"".join([digest(text[a:b], 42) for a, b in zip(starts[at:to].tolist(), ends[at + shingle - 1 : to + shingle - 1].tolist())])
        times += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(times * 2 > n).tobytes()


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, th, fp): th hashes the text, fp is the fingerprint as a signed 64-bit number; null text has no words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def prints(batches):
        import pyarrow as pa

        for batch in batches:
            found = b"".join(fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle) for t in batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.frombuffer(found, ">i8").astype(np.int64))], ["doc_id", "th", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th")).mapInArrow(frugal(prints), f"doc_id {kind}, th long, fp long")


def links(prints: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints that connect all those at 2 or fewer differing bits.

    Two segments of 32 bits: one of them differs by at most one bit, so a pair shares that segment's variant with
    this bit blanked. Pairs of a variant are joined and verified, each in one of its variants only. A variant
    with more than `bucket` members is not paired: its members are grouped by all fingerprints within one bit of them.
    Any two at 2 or fewer bits share such a neighbour, any two that share one are linked, and a neighbour has at most 65
    members; so their links come from stars instead of pairs, exactly.
    """
    i = F.col("i")
    half = F.shiftrightunsigned("fp", 0).bitwiseAND(F.lit(0xFFFFFFFF))
    segment = F.when(i < 32, half).otherwise(F.shiftrightunsigned("fp", 32))
    blank = F.expr("~shiftleft(1L, i % 32)")
    variants = prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")).select("fp", "i", F.shiftleft(i.cast("long"), 32).bitwiseOR(segment.bitwiseAND(blank)).alias("key"))
    # counted with a partial sum and joined, so a variant of many fingerprints is not one task
    counts = variants.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = cut(variants.join(spread(counts), "key").select("key", "i", "fp", "n"))

    cold = shared.where(F.col("n") <= bucket)
    x = F.col("a").bitwiseXOR(F.col("b"))
    low, high = x.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(x, 32)
    own = F.when(i < 32, low).otherwise(high)
    bit = F.expr("shiftleft(1L, i % 32)")
    first = ((own == 0) & (i % 32 == 0)) | (own == bit)  # the one variant of a segment that answers for the pair
    once = (i < 32) | (F.bit_count(low) > 1)  # the second segment only where the first differs by more
    pairs = cold.select("key", "i", F.col("fp").alias("a")).join(spread(cold.select("key", F.col("fp").alias("b"))), "key").where((F.col("a") < F.col("b")) & (F.bit_count(x) <= 2) & first & once).select("a", "b")

    hot = shared.where(F.col("n") > bucket).select("fp").distinct()
    near = hot.select("fp", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("i")).select("fp", F.expr("if(i = 64, fp, fp ^ shiftleft(1L, i))").alias("near"))
    stars = near.groupBy("near").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a < b")
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links of 2 or fewer bits.

    Null and empty texts have fingerprint zero and link like any other. A null id gets the component of its
    fingerprint, null if that holds null ids only. Repeated rows and copies share a fingerprint, are counted as one node
    and never paired. An empty table gives no rows; other columns are ignored.
    """
    found = stage_table(fingerprints(docs, id_col=id_col, text_col=text_col))
    rooted = _rooted(found)
    label = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(spread(label), "root").select("fp", "component_id")
    return found.join(spread(named), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _rooted(found: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(fp, first, root) for each distinct fingerprint: its least document and its component."""
    nodes = cut(found.groupBy("fp").agg(F.min(doc).alias("first")))
    roots = components(links(nodes.select("fp")))
    return nodes.join(spread(roots), nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, the one of the least id (a null one last), with all columns of docs.

    Rows that repeat an id are told apart by their texts' hash; of rows that repeat both one stays. Only rows that may go
    are shuffled with their texts.
    """
    own = docs.columns
    docs, number = numbered(docs, id_col)
    docs = docs.select(*own, F.coalesce(number, F.lit(NO_ID)).alias("_order"))
    found = stage_table(fingerprints(docs, id_col="_order", text_col=text_col).withColumnRenamed("doc_id", "doc"))
    # copies of one fingerprint are combined before the shuffle, so the join sees each fingerprint once
    least = found.groupBy("fp").agg(F.min(F.struct("doc", "th")).alias("k"))
    stays = least.join(spread(_rooted(found, "doc").select("fp", "root")), "fp").groupBy("root").agg(F.min("k").alias("k")).select("k.doc", "k.th", F.lit(True).alias("stay"))
    each = found.groupBy("doc", "th").agg(F.count(F.lit(1)).alias("n"))
    judged = stage_table(each.join(spread(stays), ["doc", "th"], "left").select("doc", "th", "n", F.coalesce("stay", F.lit(False)).alias("stay")))
    doubtful = marked(judged.where("n > 1 or not stay"), "th")
    keyed_docs = docs.select(F.struct(*own).alias("row"), F.col("_order").alias("doc"), F.xxhash64(text_col).alias("th"))
    clear = only(keyed_docs, doubtful, inside=False).select("row.*")
    rest = only(keyed_docs, doubtful).join(spread(judged.where("stay").select("doc", "th")), ["doc", "th"], "left_semi").dropDuplicates(["doc", "th"]).select("row.*")
    return clear.unionByName(rest)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
