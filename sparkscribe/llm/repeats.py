"""Which elements of a corpus lie in windows that also occur earlier: the frame of the two exact dedup operators.

0. Of bytes, documents that are whole copies of one of a smaller id are covered, and left out of the next steps.
1. Every document gives its anchors (see anchors.py). Those that occur once are dropped, by a bitmap sized from the corpus; it may let
   some through and loses none. Beyond its largest size more are let through, and step 2 counts them exactly.
2. Anchors only route. An anchor's group is the part of its first document in which it stands, or the anchor itself if it is one of the
   most frequent. The text around its occurrences, merged into regions of each document, goes to that group, so two equal windows meet.
3. Regions are sorted by group over range partitions and read as shards of bounded bytes. Equal regions enter a shard
   once, with all their owners. An operator's own method finds the repeats of a shard by comparing text.
4. A group too large for one shard, or cut by a partition's border, is spread over several. What several of its shards hold
   without an earlier occurrence is merged: each shard's sorted windows are searched in the others' by binary search.
5. Covered spans are applied to the texts. Texts move only for documents that have regions or spans.

Positions are those of elements: bytes or words. A document is (doc, th): its id, the largest number for a null one, and a hash of its
text; so rows that repeat both are one document, and rows of one id with different texts are told apart. Ids that are not integers are
numbered in their order.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .anchors import _sliding, anchors, word_elements
from .common import drop_tables, frugal, frugal_group, numbered, spread, stage_table, trim
from .rolling import BYTE, arrow_bytes, mix, runs

NO_ID = (1 << 63) - 1
#: Bytes of a shard; bytes of text handled at once; rows of a bucket of occurrences or windows; elements of a piece of a long region.
SHARD_BYTES, STEP_BYTES, BUCKET_ROWS, PIECE = 1 << 18, 1 << 19, 100_000, 1 << 15
#: An anchor is listed if it occurs more often than this, and more often than one in LISTED of all occurrences: so at most LISTED are.
HOT, LISTED = 8192, 500_000
#: Bytes of text whose shards are merged in one task.
MERGE_BYTES = 1 << 18
#: Bits of the smallest and the largest bitmap (128 KB, 32 MB).
LEAST_BITS, MOST_BITS = 20, 28


def slots_for(rows: int) -> int:
    """Slots of a bitmap of so many keys: eight for each, within the bounds."""
    return 1 << max(LEAST_BITS, min(MOST_BITS, (8 * rows).bit_length()))


@dataclass(frozen=True)
class Unit:
    """What repeats: windows of `window` bytes or words, anchored by grams of `gram`; by_start: an earlier start in the same document counts."""

    window: int
    gram: int
    words: bool
    by_start: bool


def _slices(batch, column: int):
    """Parts of a record batch of about STEP_BYTES of text."""
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    edges = [0, *(np.flatnonzero(np.diff(np.cumsum(size) // STEP_BYTES)) + 1).tolist(), batch.num_rows]
    return (batch.slice(a, b - a) for a, b in zip(edges, edges[1:]) if b > a)


def _elements(unit: Unit, texts):
    data, ends = arrow_bytes(texts)
    if not unit.words:
        return BYTE[data], ends, data, None, None
    elements, offsets, starts, stops = word_elements(data, ends)
    return elements, offsets, data, starts, stops


def keyed(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc, th, _text and the kept columns under their names after `k_`."""
    text = F.col(text_col)
    docs, number = numbered(docs, id_col)
    return docs.select(F.coalesce(number, F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("th"), text.alias("_text"), *(F.col(c).alias(f"k_{c}") for c in keep))


@dataclass
class Repeated:
    """Keys seen more than once: a broadcast bitmap by their leading bits, those seen most often, and how many rows they make up."""

    bits: object
    slots: int
    hot: object
    rows: int

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) >> np.uint64(65 - self.slots.bit_length())).astype(np.int64)

    def held(self, keys: np.ndarray) -> np.ndarray:
        slot = self.slot(keys)
        return (self.bits.value[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1

    def often(self, keys: np.ndarray) -> np.ndarray:
        hot, short = self.hot.value, keys.view(np.uint64) >> np.uint64(24)
        if not len(hot):
            return np.zeros(len(keys), bool)
        return hot[np.minimum(np.searchsorted(hot, short), len(hot) - 1)] == short


def _parts(rows: DataFrame) -> int:
    """Parts of the key space: 256, more where the input has more partitions."""
    return min(1 << 16, max(256, 1 << (rows.rdd.getNumPartitions() - 1).bit_length()))


def _packed(keys: list[np.ndarray], parts: int):
    """Rows (part, the next 32 bits of its keys): the leading 40 bits of well mixed keys."""
    import pyarrow as pa

    bits = parts.bit_length() - 1
    short = np.sort(np.concatenate(keys) >> np.uint64(24))
    part = (short >> np.uint64(40 - bits)).astype(np.int64)
    low = (short & np.uint64((1 << (40 - bits)) - 1)).astype(np.uint32)
    head = np.flatnonzero(np.diff(part, prepend=-1))
    data = [x.tobytes() for x in np.split(low, head[1:])] if len(low) else []
    return pa.RecordBatch.from_arrays([pa.array(part[head], pa.int32()), pa.array(data, pa.binary())], ["part", "keys"])


def seen_more(packed: DataFrame, parts: int, slots: int, least: int = 2) -> Repeated:
    """From _packed() rows: each part is counted by one task, slots / 8 bytes of bits come back in all."""
    bits = parts.bit_length() - 1
    down = 40 - bits - (slots.bit_length() - 1 - bits)

    def count(key, batch):
        import pyarrow as pa

        keys = np.sort(np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in batch["keys"]]))
        head = np.flatnonzero(np.diff(keys, prepend=keys[0] + np.uint32(1)))
        n = np.diff(np.append(head, len(keys)))
        keys = keys[head]
        own = np.zeros(slots // parts, bool)
        own[(keys[n >= least] >> np.uint32(down)).astype(np.int64)] = True
        hot = n > HOT
        part = key[0].as_py()
        full = (np.uint64(part) << np.uint64(40 - bits)) | keys[hot].astype(np.uint64)
        longs = pa.list_(pa.int64())
        values = {
            "part": pa.array([part], pa.int32()),
            "bits": pa.array([np.packbits(own).tobytes()], pa.binary()),
            "rows": pa.array([int(n[n >= least].sum())], pa.int64()),
            "hot": pa.array([full.astype(np.int64).tolist()], longs),
            "times": pa.array([n[hot].tolist()], longs),
        }
        return pa.table(values)

    kind = "part int, bits binary, rows long, hot array<long>, times array<long>"
    found = stage_table(packed.groupBy("part").applyInArrow(frugal_group(count), kind))
    whole, rows = np.zeros((parts, slots // parts // 8), np.uint8), 0
    for r in found.select("part", "bits", "rows").toLocalIterator():
        whole[r.part] = np.frombuffer(bytes(r.bits), np.uint8)
        rows += r.rows
    listed = found.select(F.explode(F.arrays_zip("hot", "times")).alias("x")).where(F.col("x.times") > max(HOT, rows // LISTED))
    often = listed.select("x.hot").collect()  # fewer than LISTED: each is more than one in LISTED of all rows
    sc = packed.sparkSession.sparkContext
    out = Repeated(sc.broadcast(whole.reshape(-1)), slots, sc.broadcast(np.sort(np.array([r.hot for r in often], np.uint64))), rows)
    del whole
    trim()
    return out


def marked(keys: DataFrame, column: str, times: int = 1) -> Repeated:
    """A bitmap of all keys of a column of a written table, of `times` as many slots as usual."""
    parts, slots = _parts(keys), slots_for(keys.count() * times)

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                yield _packed([batch.column(0).to_numpy().view(np.uint64)], parts)

    return seen_more(keys.select(column).mapInArrow(frugal(pack), "part int, keys binary"), parts, slots, least=1)


def _merge(row: np.ndarray, start: np.ndarray, stop: np.ndarray, key: np.ndarray | None = None):
    """Union of spans by row (and key): sorted, those that touch joined."""
    if not len(row):
        return row, start, stop, key
    order = np.lexsort((start, row)) if key is None else np.lexsort((start, key, row))
    row, start, stop = row[order], start[order], stop[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = row[1:] != row[:-1]
    if key is not None:
        key = key[order]
        fresh[1:] |= key[1:] != key[:-1]
    group = np.cumsum(fresh) - 1
    big = int(stop.max()) + 2
    reach = np.maximum.accumulate(stop + group * big) - group * big
    fresh[1:] |= start[1:] > reach[:-1]
    first = np.flatnonzero(fresh)
    return row[first], start[first], np.maximum.reduceat(stop, first), None if key is None else key[first]


def _copies(rows: DataFrame, unit: Unit) -> DataFrame:
    """(doc, th, n) of keyed() rows: documents of n bytes, a window or more, whose whole text a smaller id has too. Texts are told by SHA-256."""
    size = F.octet_length("_text").cast("long")
    told = stage_table(rows.where(size >= unit.window).select("doc", "th", F.sha2("_text", 256).alias("sha"), size.alias("n")))
    first = told.groupBy("sha", "n").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("last > first").drop("last")
    out = stage_table(told.join(spread(first), ["sha", "n"]).where("doc > first").select("doc", "th", "n").distinct())
    drop_tables(told)
    return out


def _without(rows: DataFrame, gone: DataFrame) -> tuple[DataFrame, Repeated]:
    """(doc, th, _text, key) and a bitmap: those of the rows whose key is not in it are the documents not gone. Ones that the bitmap has by chance stand
    once more, without a key."""
    key = F.xxhash64("doc", "th")
    bits = marked(gone.select(key.alias("key")), "key", times=8)
    doubtful = only(rows.select("doc", F.col("th").alias("_th"), "_text", key.alias("th")), bits).withColumnsRenamed({"th": "key", "_th": "th"})
    saved = stage_table(doubtful.join(spread(gone), ["doc", "th"], "left_anti").select("doc", "th", "_text", F.lit(None).cast("long").alias("key")))
    return rows.select("doc", "th", "_text", key.alias("key")).unionByName(saved), bits


def _left(batches, bits: Repeated | None):
    """Batches whose last column is the key, without the rows that the bitmap has."""
    import pyarrow as pa

    for batch in batches:
        if bits is not None and batch.num_rows:
            key = batch.column(batch.num_columns - 1)
            own = ~bits.held(key.fill_null(0).to_numpy(zero_copy_only=False)) | key.is_null().to_numpy(zero_copy_only=False)
            batch = batch if own.all() else batch.filter(pa.array(own))
        yield batch


def _anchor_keys(rows: DataFrame, unit: Unit, gone: Repeated | None = None) -> Repeated:
    parts = _parts(rows)
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    about = size // (5 if unit.words else 1) * 2 // (unit.window - unit.gram + 2)

    def scan(batches):
        waiting, held = [], 0
        for batch in _left(batches, gone):
            for part in _slices(batch, 0):
                elements, offsets, *_ = _elements(unit, part.column(0))
                waiting.append(anchors(elements, offsets, unit.window, unit.gram)["a"])
                held += len(waiting[-1])
                if held > 1 << 19:
                    yield _packed(waiting, parts)
                    waiting, held = [], 0
        if waiting:
            yield _packed(waiting, parts)

    return seen_more(rows.select("_text", *_key(gone)).mapInArrow(frugal(scan), "part int, keys binary"), parts, slots_for(about))


def _key(gone: Repeated | None) -> list[str]:
    return [] if gone is None else ["key"]


_ROW = ("b", "often", "a", "doc", "th", "at", "lo", "hi")


def _occurrences(rows: DataFrame, unit: Unit, repeated: Repeated, gone: Repeated | None = None) -> DataFrame:
    """The anchors in the bitmap, with the spans of all windows they can stand for. b deals them: by anchor, listed ones by document."""

    def scan(batches):
        import pyarrow as pa

        for batch in _left(batches, gone):
            for part in _slices(batch, 2):
                elements, offsets, *_ = _elements(unit, part.column(2))
                v = anchors(elements, offsets, unit.window, unit.gram)
                own = repeated.held(v["a"])
                v = {k: x[own] for k, x in v.items()}
                d = v["doc"]
                doc, th = (part.column(i).to_numpy()[d] for i in (0, 1))
                often = repeated.often(v["a"])
                b = np.where(often, mix(th.view(np.uint64) + doc.view(np.uint64)), v["a"]).view(np.int64)
                place = [(v[k] - offsets[d]).astype(np.int32) for k in ("at", "left", "right")]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (b, often, v["a"].view(np.int64), doc, th, *place)], _ROW)

    kind = "b long, often boolean, a long, doc long, th long, at int, lo int, hi int"
    return rows.select("doc", "th", "_text", *_key(gone)).mapInArrow(frugal(scan), kind)


def _by_document(occurrences: DataFrame, unit: Unit, buckets: int) -> DataFrame:
    """(doc, th, need): the spans of a document to compare, each with its group m; those of one group are merged."""

    def route(key, table):
        import pyarrow as pa

        v = {k: table[k].to_numpy(zero_copy_only=False) for k in _ROW}
        listed = np.flatnonzero(v["often"])
        rest = np.flatnonzero(~v["often"])
        rest = rest[np.lexsort(tuple(v[k][rest] for k in ("at", "th", "doc", "a")))]
        a, doc, th, at = (v[k][rest] for k in ("a", "doc", "th", "at"))
        fresh = np.ones(len(rest), bool)
        fresh[1:] = a[1:] != a[:-1]
        heads = np.flatnonzero(fresh)
        size = np.diff(np.append(heads, len(rest)))
        lead = np.repeat(heads, size)  # an anchor's first occurrence: the least document, and its place there
        other = doc != doc[lead]
        if unit.by_start:
            other |= (th != th[lead]) | (at != at[lead])
        several = np.repeat(np.add.reduceat(other, heads) > 0, size) if len(rest) else other
        m = mix(mix(doc[lead].view(np.uint64)) + (at[lead] // (20 * unit.window)).astype(np.uint64))
        use = np.concatenate((rest[several], listed))
        m = np.concatenate((m[several], mix(v["a"][listed].view(np.uint64)))).view(np.int64)
        return pa.table({k: v[k][use] for k in ("doc", "th", "lo", "hi")} | {"m": m})

    dealt = occurrences.withColumn("bucket", F.pmod("b", F.lit(buckets)).cast("int"))
    spans = dealt.groupBy("bucket").applyInArrow(frugal_group(route), "doc long, th long, lo int, hi int, m long")

    def gather(key, table):
        import pyarrow as pa

        v = {k: table[k].to_numpy() for k in ("doc", "th", "lo", "hi", "m")}
        order = np.lexsort((v["th"], v["doc"]))
        v = {k: x[order] for k, x in v.items()}
        at = _firsts(v["doc"], v["th"])
        row, lo, hi, m = _merge(_document(v["doc"], v["th"]), v["lo"].astype(np.int64), v["hi"].astype(np.int64), v["m"])
        edges = np.searchsorted(row, np.arange(len(at) + 1))
        fields = {"lo": pa.array(lo), "hi": pa.array(hi), "m": pa.array(m)}
        need = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays([*fields.values()], [*fields]))
        return pa.table({"doc": v["doc"][at], "th": v["th"][at], "need": need})

    # by documents, so a group holds as many spans as some documents have anchors
    dealt = spans.withColumn("bucket", F.pmod(F.xxhash64("doc", "th"), F.lit(buckets)).cast("int"))
    return dealt.groupBy("bucket").applyInArrow(frugal_group(gather), "doc long, th long, need array<struct<lo: long, hi: long, m: long>>")


def only(rows: DataFrame, bits: Repeated, inside: bool = True) -> DataFrame:
    """Rows whose th is (or is not) in a bitmap."""
    at = rows.columns.index("th")

    def keep(batches):
        import pyarrow as pa

        for batch in batches:
            own = bits.held(batch.column(at).to_numpy()) == inside
            if own.any():
                yield batch if own.all() else batch.filter(pa.array(own))

    return rows.mapInArrow(frugal(keep), rows.schema)


_REGION = "m long, doc long, th long, lo long, hi long, size long, text binary"


def _regions(rows: DataFrame, spans: DataFrame, unit: Unit) -> DataFrame:
    """(m, doc, th, lo, hi, size, text): each span to compare with its text, words parted by one space; a long one in pieces that overlap.

    Text that an earlier row of the same batch and group has, byte by byte, is not passed on: such a span is covered (its text is null)."""
    key = F.xxhash64("doc", "th")  # not th alone, which copies share
    near = only(rows.select("doc", F.col("th").alias("_th"), "_text", key.alias("th")), marked(spans.select(key.alias("key")), "key"))
    joined = near.select("doc", F.col("_th").alias("th"), "_text").join(spread(spans), ["doc", "th"]).select("_text", "doc", "th", "need")
    step = PIECE - unit.window + 1

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            found = []
            for text, doc, th, need in zip(*(batch.column(i) for i in range(4))):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                items = data.split() if unit.words else None
                doc, th = doc.as_py(), th.as_py()
                for s in need.as_py():
                    for lo in range(s["lo"], max(s["lo"] + 1, s["hi"] - unit.window + 1), step):
                        hi = min(s["hi"], lo + PIECE)
                        found.append((doc, th, lo, hi, s["m"], b" ".join(items[lo:hi]) if unit.words else data[lo:hi]))
            found.sort(key=lambda x: x[:3])
            out, first = [], {}
            for doc, th, lo, hi, m, text in found:
                owner = first.setdefault((m, text), (doc, th, lo))
                if owner == (doc, th, lo):
                    if (m, text, owner) not in first:  # a repeated row is one document
                        first[m, text, owner] = True
                        out.append((m, doc, th, lo, hi, len(text), text))
                elif unit.by_start or owner[0] < doc:
                    out.append((m, doc, th, lo, hi, 0, None))
                else:
                    out.append((m, doc, th, lo, hi, len(text), text))
            names = ["m", "doc", "th", "lo", "hi", "size", "text"]
            columns = [*zip(*out)] if out else [()] * 7
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:6]), pa.array(columns[6], pa.binary())], names)

    return joined.mapInArrow(frugal(cut), _REGION)


#: A shard's method: (symbols, offsets of its texts, Owners, window) -> for each place whether the window that starts there occurred earlier.
Method = Callable[..., np.ndarray]


@dataclass
class Owners:
    """The first owner of each text of a shard, in their order: numbers of ids and of documents, and where the text starts there."""

    ids: np.ndarray
    documents: np.ndarray
    at: np.ndarray


def symbols_of(texts: list[bytes], words: bool) -> tuple[np.ndarray, np.ndarray]:
    """Texts end to end as bytes or as numbers of their words (equal words, equal numbers), and the offsets of each text."""
    import pyarrow as pa

    if not words:
        return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
    data = b"".join(t + b" " for t in texts)
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 32) + 1
    offsets = np.concatenate(([0], ends)).astype(np.int64)
    items = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])
    stops = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    return items.dictionary_encode().indices.to_numpy().astype(np.int32), np.concatenate(([0], np.searchsorted(offsets, stops)))


def solve(shard: dict[bytes, list[tuple]], unit: Unit, method: Method) -> list[tuple]:
    """(doc, th, lo, hi, m, text) of a shard of texts and their owners (doc, th, lo, the group if other shards hold it too): covered spans, whose
    text is null, and of shared groups the stretches of windows without an earlier occurrence here."""
    entries = []
    for text, owners in shard.items():
        shared = sorted({o[3] for o in owners if o[3] is not None})
        owners = sorted({o[:3] for o in owners})
        entries.append((owners, text, shared))
    entries.sort(key=lambda e: e[0][0])
    first = [e[0][0] for e in entries]
    symbols, offsets = symbols_of([e[1] for e in entries], unit.words)
    doc, th, lo = (np.array([o[k] for o in first], np.int64) for k in range(3))
    ids = np.cumsum(np.diff(doc, prepend=doc[:1]) != 0)
    covered = method(symbols, offsets, Owners(ids, _document(doc, th), lo), unit.window)
    size = np.diff(offsets)
    region = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(symbols)) - offsets[region]
    out = []

    def stretches(on: np.ndarray):
        """(region, first place, last place) of the runs of places."""
        p = np.flatnonzero(on)
        fresh = np.ones(len(p), bool)
        fresh[1:] = (p[1:] != p[:-1] + 1) | (region[p[1:]] != region[p[:-1]])
        head = np.flatnonzero(fresh)
        tail = np.append(head[1:], len(p)) - 1 if len(p) else head
        return zip(region[p[head]].tolist(), place[p[head]].tolist(), place[p[tail]].tolist())

    # owners of the same id as the first fare like it; all others have every window earlier
    alike = [[e[0][0]] if unit.by_start else [o for o in e[0] if o[0] == e[0][0][0]] for e in entries]
    for r, a, b in stretches(covered):
        out += [(d, t, s + a, s + b + unit.window, None, None) for d, t, s in alike[r]]
    for (owners, _, _), same, n in zip(entries, alike, size.tolist()):
        out += [(d, t, s, s + n, None, None) for d, t, s in owners[len(same) :]]
    share = np.array([bool(e[2]) for e in entries], bool)
    if share.any():
        whole = place <= np.maximum(size - unit.window, -1)[region]
        for r, a, b in stretches(whole & ~covered & share[region]):
            text = entries[r][1]
            text = b" ".join(text.split(b" ")[a : b + unit.window]) if unit.words else text[a : b + unit.window]
            out += [(d, t, s + a, -1, m, text) for d, t, s in alike[r] for m in entries[r][2]]
    return out


def _shards(regions: DataFrame, unit: Unit, method: Method, shard_bytes: int) -> DataFrame:
    """(doc, th, lo, hi, m, text, shard): what solve() finds in each shard."""
    from pyspark import TaskContext

    total = regions.agg(F.sum("size")).first()[0] or 0
    parts = min(20_000, max(12, -(-total // (32 * shard_bytes))))
    fields = ["doc", "th", "lo", "hi", "m", "text", "shard"]

    def run(batches):
        import pyarrow as pa

        task, number = TaskContext.get().partitionId() << 32, 0
        block, held = {}, 0  # whole groups
        group, size, now, shared = {}, 0, None, True  # a partition's first group may have begun before it

        def flush(shard):
            nonlocal number
            number += 1
            out = solve(shard, unit, method)
            columns = [*zip(*out)] if out else [()] * 6
            rows = [*(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.binary())]
            return pa.RecordBatch.from_arrays([*rows, pa.array([task + number] * len(out), pa.int64())], fields)

        def close():
            nonlocal held, group, size
            for text, owners in group.items():
                block.setdefault(text, []).extend((*o, now if shared else None) for o in owners)
            held += size
            group, size = {}, 0

        for batch in batches:
            m, doc, th, lo = (batch.column(i).to_pylist() for i in range(4))
            for i, text in enumerate(batch.column(4).to_pylist()):
                if m[i] != now:
                    if now is not None:
                        if held and held + size > shard_bytes:
                            yield flush(block)
                            block, held = {}, 0
                        close()
                        shared = False
                    now = m[i]
                elif size > shard_bytes:  # the group goes on in another shard
                    if held:
                        yield flush(block)
                        block, held = {}, 0
                    shared = True
                    close()
                    yield flush(block)
                    block, held = {}, 0
                size += 64 + (0 if text in group else len(text))
                group.setdefault(text, []).append((doc[i], th[i], lo[i]))
        shared = True  # and its last one may go on in the next
        close()
        if block:
            yield flush(block)

    spread = regions.where(F.col("text").isNotNull()).select("m", "doc", "th", "lo", "text", F.xxhash64("doc", "th", "lo").alias("salt"))
    ordered = spread.repartitionByRange(parts, "m", "salt").sortWithinPartitions("m", "salt").drop("salt")
    return ordered.mapInArrow(frugal(run), "doc long, th long, lo long, hi long, m long, text binary, shard long")


def merged(arrays: list[list[bytes]]) -> list[bytes]:
    """One sorted array of the distinct windows of several: two at a time, the places of one's windows found in the other by binary search."""
    arrays = [np.array([*a, None], object)[:-1] for a in arrays]  # the extra item keeps numpy from making byte strings of it
    while len(arrays) > 1:
        pairs = []
        for a, b in zip(arrays[::2], [*arrays[1::2], None]):
            if b is not None:
                at = np.searchsorted(a, b)
                known = np.zeros(len(b), bool)
                inside = np.flatnonzero(at < len(a))
                known[inside] = a[at[inside]] == b[inside]
                a = np.insert(a, at[~known], b[~known])
            pairs.append(a)
        arrays = pairs
    return arrays[0]


_LIVE = "m long, shard long, doc long, th long, lo long, text binary"


def _windows_of(text: bytes, unit: Unit) -> list[bytes]:
    w = unit.window
    if not unit.words:
        return [text[i : i + w] for i in range(len(text) - w + 1)]
    items = text.split(b" ")
    return [b" ".join(items[i : i + w]) for i in range(len(items) - w + 1)]


def _part(text: bytes, lo: int, hi: int, unit: Unit) -> bytes:
    return b" ".join(text.split(b" ")[lo:hi]) if unit.words else text[lo:hi]


def merge_shards(rows: list[tuple[int, int, int, int, int, bytes]], unit: Unit) -> list[tuple]:
    """(m, doc, th, lo, hi, text) of stretches (m, shard, doc, th, lo, text) of several shards: runs of windows that an earlier place has, whose
    text is null, and runs of the others."""
    windows = [_windows_of(r[5], unit) for r in rows]
    by: dict[int, set[bytes]] = {}
    for r, own in zip(rows, windows):
        by.setdefault(r[1], set()).update(own)
    arrays = [sorted(x) for x in by.values()]
    union = merged(arrays)
    size = np.array([len(x) for x in windows])
    row = np.repeat(np.arange(len(rows)), size)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    number = np.searchsorted(union, np.array([*(w for own in windows for w in own), None], object)[:-1])
    doc, th, lo = (np.array([r[k] for r in rows], np.int64)[row] for k in (2, 3, 4))
    at = lo + place
    order = np.lexsort((at, th, doc, number))
    head = order[np.searchsorted(number[order], number)]  # each window's first place of all shards
    late = doc != doc[head]
    if unit.by_start:
        late |= (th != th[head]) | (at != at[head])
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (late[1:] != late[:-1])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(row)) - 1
    out = []
    for r, a, b, done in zip(row[first].tolist(), place[first].tolist(), place[last].tolist(), late[first].tolist()):
        m, _, d, t, s, text = rows[r]
        out.append((m, d, t, s + a, s + b + unit.window, None if done else _part(text, a, b + unit.window, unit)))
    return out


def _across(reports: DataFrame, unit: Unit, size: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Of stretches of shared groups (m, shard, doc, th, lo, text): the tables of all rounds, whose rows without text are covered spans,
    and the other tables written.

    Windows that only one shard holds are left out. A group's shards then go to one task, or to several of bounded bytes, whose
    results are merged in the next round. Where groups shrink too little from round to round, such as a frequent phrase between
    different texts, stretches are cut and dealt by rare grams: a window's is its gram of the least hash among those that occur so
    seldom that all text around them fits a task. Neighbouring windows mostly share it, so a stretch stays in few parts. Where that
    shrinks too little too (windows of frequent grams only), each window is dealt by itself, so that only copies of one window meet.
    """
    parts = _parts(reports)
    frequent_from = max(2, MERGE_BYTES // (2 * unit.window * (6 if unit.words else 1)))

    def run_keys(texts, length):
        """Hashes of all runs of `length` elements of the texts, and where each text's begin."""
        texts = [t.as_buffer().to_pybytes() for t in texts]
        ends = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)))
        data = np.frombuffer(b"".join(t + b" " for t in texts), np.uint8)
        if unit.words:
            elements, offsets = word_elements(data, ends)[:2]
            stops = offsets[1:]
        else:
            elements, offsets, stops = BYTE[data], ends, ends[1:] - 1
        left = np.repeat(stops, np.diff(offsets)) - np.arange(len(elements))
        counts = np.maximum(stops - offsets[:-1] - length + 1, 0)
        return texts, mix(runs(elements, length))[np.flatnonzero(left >= length)], np.concatenate(([0], np.cumsum(counts)))

    def seen(rows, length, size, least):
        def keys(batches):
            for batch in batches:
                for part in _slices(batch, 0):
                    own = run_keys(part.column(0), length)[1]
                    if len(own):
                        yield _packed([own], parts)

        packed = rows.select("text").mapInArrow(frugal(keys), "part int, keys binary")
        return seen_more(packed, parts, slots_for(size // (5 if unit.words else 1)), least)

    twice = seen(reports, unit.window, size, 2)
    names = ["m", "shard", "doc", "th", "lo", "text"]

    def live_batch(rows):
        import pyarrow as pa

        columns = [*zip(*rows)] if rows else [()] * 6
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.binary())], names)

    def narrow(batches):
        for batch in batches:
            for part in _slices(batch, 5):
                texts, own, begin = run_keys(part.column(5), unit.window)
                held, rows = twice.held(own), []
                edge = np.diff(np.concatenate(([0], held.astype(np.int8), [0])))
                starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                others = [part.column(k).to_pylist() for k in range(5)]
                for a, b in zip(starts.tolist(), stops.tolist()):
                    r = int(np.searchsorted(begin, a, "right")) - 1
                    while a < b:  # a run may reach over several texts
                        to = min(b, int(begin[r + 1]))
                        if to > a:
                            i, j = a - int(begin[r]), to - int(begin[r]) + unit.window - 1
                            m, shard, doc, th, lo = (c[r] for c in others)
                            rows.append((m, shard, doc, th, lo + i, _part(texts[r], i, j, unit)))
                        a, r = to, r + 1
                yield live_batch(rows)

    def by_rare(frequent):
        def deal(batches):
            for batch in batches:
                for part in _slices(batch, 5):
                    texts, own, begin = run_keys(part.column(5), unit.gram)
                    order = (own >> np.uint64(1)) | (frequent.held(own).astype(np.uint64) << np.uint64(63))
                    rows = []
                    for r, (_, shard, doc, th, lo) in enumerate(zip(*(part.column(k).to_pylist() for k in range(5)))):
                        least = _sliding(order[begin[r] : begin[r + 1]], unit.window - unit.gram + 1, np.minimum)
                        edges = [0, *(np.flatnonzero(least[1:] != least[:-1]) + 1).tolist(), len(least)]
                        for m, a, b in zip(mix(least[edges[:-1]]).view(np.int64).tolist(), edges, edges[1:]):
                            rows.append((m, shard, doc, th, lo + a, _part(texts[r], a, b + unit.window - 1, unit)))
                    yield live_batch(rows)

        return deal

    def singles(batches):
        for batch in batches:
            rows = []
            for m, shard, doc, th, lo, text in zip(*(batch.column(k).to_pylist() for k in range(6))):
                for i, w in enumerate(_windows_of(text, unit)):
                    rows.append((int(np.frombuffer(hashlib.blake2b(w, digest_size=8).digest(), np.int64)[0]), shard, doc, th, lo + i, w))
            yield live_batch(rows)

    def merge(key, table):
        import pyarrow as pa

        columns = [*zip(*merge_shards([*zip(*(table[c].to_pylist() for c in names))], unit))]
        values = {c: pa.array(x, pa.int64()) for c, x in zip(("m", "doc", "th", "lo", "hi"), columns)}
        return pa.table(values | {"text": pa.array(columns[5], pa.binary()), "shard": pa.array([key[1].as_py()] * len(columns[0]), pa.int64())})

    kind = "m long, doc long, th long, lo long, hi long, text binary, shard long"
    live = stage_table(reports.select(*names).mapInArrow(frugal(narrow), _LIVE))
    out, dealt_again, before, finer = [live], [], None, 0
    while True:
        groups = live.groupBy("m").agg(F.sum(F.octet_length("text")).alias("n"))
        largest, total = groups.agg(F.max("n"), F.sum("n")).first()
        if not total:
            break
        if before and largest > 0.7 * before and finer < 2:
            deal = singles if finer else by_rare(seen(live, unit.gram, total, frequent_from))
            live, finer, before = stage_table(live.mapInArrow(frugal(deal), _LIVE)), finer + 1, None
            dealt_again.append(live)
            continue
        # copies of one window shrink to one a set, but for places of one id, which do not cover each other: they end in one task
        sets = 1 if before and largest > 0.7 * before else -(-largest // MERGE_BYTES)
        before = largest
        buckets = max(12, -(-total // MERGE_BYTES))
        spread = F.pmod(F.xxhash64("shard"), F.lit(sets)) if sets > 1 else F.lit(0).cast("long")
        dealt = live.withColumn("set", spread).withColumn("b", F.pmod(F.xxhash64("m", "set"), F.lit(buckets)).cast("int"))
        done = stage_table(dealt.groupBy("b", "set").applyInArrow(frugal_group(merge), kind))
        out.append(done)
        if sets == 1:
            break
        live = done.where(F.col("text").isNotNull()).select(*names)
    return out[1:], [out[0], *dealt_again]


def _document(doc: np.ndarray, th: np.ndarray) -> np.ndarray:
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])
    return np.cumsum(fresh) - 1


def _firsts(doc: np.ndarray, th: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(np.concatenate(([-1], _document(doc, th)))))


def repeated_spans(rows: DataFrame, unit: Unit, method: Method) -> DataFrame:
    """(doc, th, spans): for each document of keyed() rows with any, its covered spans in elements, merged.

    Of bytes, whole copies of texts with smaller ids are covered at once and compared no more: what they hold starts in the smaller id too."""
    gone, bits, left = None if unit.words else _copies(rows, unit), None, rows
    if gone is not None and not gone.isEmpty():
        left, bits = _without(rows, gone)
    repeated = _anchor_keys(left, unit, bits)
    buckets = max(12, -(-repeated.rows // BUCKET_ROWS))
    need = stage_table(_by_document(_occurrences(left, unit, repeated, bits), unit, buckets))
    regions = stage_table(_regions(rows, need, unit))
    drop_tables(need)
    found = stage_table(_shards(regions, unit, method, SHARD_BYTES))
    spans = [x.where(F.col("text").isNull()).select("doc", "th", "lo", "hi") for x in (regions, found)]
    if gone is not None:
        spans.append(gone.select("doc", "th", F.lit(0).cast("long").alias("lo"), F.col("n").alias("hi")))
    every, reports, across = functools.reduce(DataFrame.unionByName, spans), found.where(F.col("text").isNotNull()), []
    size = reports.agg(F.sum(F.octet_length("text"))).first()[0]
    if size:
        rounds, others = _across(reports, unit, size)
        across = rounds + others
        for done in rounds:
            every = every.unionByName(done.where(F.col("text").isNull()).select("doc", "th", "lo", "hi"))
    out = stage_table(every.groupBy("doc", "th").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans")))
    drop_tables(regions, found, *across)
    return out


def apply_spans(rows: DataFrame, spans: DataFrame, finish: Callable, schema: T.StructType) -> DataFrame:
    """finish(data, starts, stops) -> values for each document, its merged covered spans given; kept columns come first.

    Only documents with spans are shuffled."""
    bits = marked(spans, "th")
    kept = [c for c in rows.columns if c.startswith("k_")]
    out = T.StructType([*(rows.schema[c] for c in kept), *schema.fields])

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.schema.names[-1] == "th":  # rows as they are scanned: those without spans are finished here
                own = ~bits.held(batch.column(batch.num_columns - 1).to_numpy())
                batch = batch.filter(pa.array(own)).select(batch.schema.names[:-1])
            for part in _slices(batch, 0):
                values = [[] for _ in schema.fields]
                for text, s in zip(part.column(0), part.column(1)):
                    data = text.as_buffer().to_pybytes() if text.is_valid else None
                    lo, hi = (np.array([x[k] for x in s.as_py() or ()], np.int64) for k in ("lo", "hi"))
                    _, lo, hi, _ = _merge(np.zeros(len(lo), np.int64), lo, hi)
                    for column, v in zip(values, finish(data, lo, hi)):
                        column.append(v)
                types = [pa.string() if isinstance(f.dataType, T.StringType) else pa.int64() for f in schema.fields]
                yield pa.RecordBatch.from_arrays([*part.columns[2:], *(pa.array(v, t) for v, t in zip(values, types))], out.names)

    none = F.lit(None).cast("array<struct<lo: long, hi: long>>")
    clean = rows.select("_text", none.alias("spans"), *kept, "th")
    touched = only(rows, bits).join(spread(spans), ["doc", "th"], "left").select("_text", "spans", *kept)
    return clean.mapInArrow(frugal(work), out).unionByName(touched.mapInArrow(frugal(work), out))
