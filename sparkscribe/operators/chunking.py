"""Pages to chunks: page filters, paragraphs, the ordered chunk rule, neighbours."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkscribe.functions.text import clean_text, estimate_tokens, is_title, paragraphs
from sparkscribe.functions.vector import bind
from sparkscribe.sources.staging import bound_batches, discard, scratch, shared_folder, staged

TARGET, LEAST, MOST, PAGE_LEAST = 1200, 600, 1800, 80


def body_pages(pages: DataFrame, start_page: int = 11) -> DataFrame:
    return pages.where(F.coalesce("page_num", F.lit(0)) >= start_page)


def clean_pages(pages: DataFrame, start_page: int = 11) -> DataFrame:
    """With clean_text and char_count. A filter on these is not pushed below the generator, where it would clean each text once more."""
    cleaned = body_pages(pages, start_page).withColumn("clean_text", F.explode(F.array(clean_text(F.col("raw_text")))))
    return cleaned.withColumn("char_count", F.length("clean_text"))


def kept_pages(pages: DataFrame, least: int = PAGE_LEAST) -> DataFrame:
    """A page stays if it has `least` characters, or is short but reads like a title."""
    short = bind(F.coalesce("clean_text", F.lit("")), is_title)  # the cleaned text, where it is computed, is computed once
    return pages.where((F.col("char_count") > 0) & ((F.col("char_count") >= least) | short))


def page_paragraphs(pages: DataFrame) -> DataFrame:
    """(source_name, page_num, para_no, para)"""
    return pages.select("source_name", F.coalesce("page_num", F.lit(0)).alias("page_num"), F.posexplode(paragraphs(F.col("clean_text"))).alias("para_no", "para"))


class _Rule:
    """The ordered rule that closes and opens chunks of one source; the state is one number, one length and one flag.

    Without an open chunk, a paragraph opens one. A title closes a chunk of `least` characters or more, and so does a paragraph that
    would carry such a chunk beyond `most`; it opens the next. Else it joins, two characters for the break; a chunk of `target` or more
    that then ends like a sentence is closed.
    """

    def __init__(self, target: int = TARGET, least: int = LEAST, most: int = MOST):
        self.target, self.least, self.most, self.source = target, least, most, object()

    def enter(self, source, number: int = 0, length: int = 0, fresh: bool = True) -> None:
        self.source, self.number, self.length, self.fresh = source, number, length, fresh

    def numbers(self, source, marks: list[int]) -> list[int]:
        """The chunks of the next paragraphs of a source."""
        if source != self.source:
            self.enter(source)
        number, length, fresh, out = self.number, self.length, self.fresh, []
        target, least, most = self.target, self.least, self.most
        for m in marks:
            size = m >> 2
            if fresh or length >= least and (m & 2 or length + 2 + size > most):
                number, length, fresh = number + 1, size, False
            else:
                length += 2 + size
                fresh = length >= target and bool(m & 1)
            out.append(number)
        self.number, self.length, self.fresh = number, length, fresh
        return out


def _mark(para: Column) -> Column:
    """A paragraph's length and two flags in one number: length * 4, 2 for a title, 1 for the end of a sentence."""
    final = functools.reduce(operator.or_, (F.endswith(para, F.lit(x)) for x in ".!?;"))
    return F.length(para) * 4 + is_title(para).cast("int") * 2 + final.cast("int")


def _lists(batch, name: str):
    """A column of lists of numbers, list by list."""
    column = batch.column(batch.schema.names.index(name))
    values, ends = column.flatten().to_numpy().tolist(), [0]
    for n in column.value_lengths().to_pylist():
        ends.append(ends[-1] + n)
    return (values[a:b] for a, b in zip(ends, ends[1:]))


#: Tasks at least that the sources' streams are dealt over: Spark would join what is small in bytes into one task.
STREAMS = 24


def _states(ordered: DataFrame, **sizes) -> DataFrame:
    """(part, number, length, fresh): the rule's state where a part begins inside a source, a row a part at most.

    The rule depends on all earlier paragraphs, so a source is one ordered stream, sorted by Spark; only lengths and two flags go to it."""
    flags = ordered.select("source_name", "part", "page", "marks")

    def fold(batches):
        import pyarrow as pa

        rule, part = _Rule(**sizes), None
        for batch in batches:
            out = []
            for source, at, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _lists(batch, "marks")):
                if source != rule.source:
                    rule.enter(source)
                elif at != part:
                    out.append((at, rule.number, rule.length, rule.fresh))
                part = at
                rule.numbers(source, marks)
            columns, kinds = [*zip(*out)] if out else [()] * 4, [pa.int32(), pa.int32(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], ["part", "number", "length", "fresh"])

    return flags.repartition(max(STREAMS, ordered.rdd.getNumPartitions()), "source_name").sortWithinPartitions("source_name", "page").mapInArrow(fold, "part int, number int, length long, fresh boolean")


def build_chunks(pages: DataFrame, prefix: str = "chunk", *, target: int = TARGET, least: int = LEAST, most: int = MOST, parts: int | None = None) -> DataFrame:
    """Chunk rows of kept pages, with ids prefix_chunk_number (numbers from 1 in each source), texts joined by a blank line, and neighbours.

    Pages stand in the order of their numbers, a missing one as 0, those of equal number in the order of their texts; pages without a source
    are a source of their own; repeated pages count each; no pages give no chunks.

    Texts are sorted into ranges of source, page and text (`parts` of them; else as many as Spark chooses), so a source's text spreads over many
    tasks, and the ranges are checkpointed. Each source's lengths and flags alone pass through one ordered stream, which gives the rule's state at the start of each range;
    from there each range makes its own chunks. Those at a range's ends, two a range at most, are merged by number.
    """
    shared_folder(pages.sparkSession)
    bound_batches(pages.sparkSession)
    sizes = {"target": target, "least": least, "most": most}
    path = scratch(pages.sparkSession)
    cleaned = staged(pages.select("source_name", F.coalesce("page_num", F.lit(0)).alias("page_num"), "clean_text"), path)  # cleaned once: cutting ranges reads it too
    order = ("source_name", "page_num", "clean_text")
    cuts = ("source_name", "page_num", F.substring("clean_text", 1, 64))  # what is sampled for the ranges' ends goes to the driver: no whole texts
    ranged = cleaned.repartitionByRange(parts, *cuts) if parts else cleaned.repartitionByRange(*cuts)
    rows = ranged.sortWithinPartitions(*order).select("source_name", "page_num", paragraphs(F.col("clean_text")).alias("paras"))
    rows = rows.select("source_name", "page_num", F.array_join("paras", "\n\n").alias("text"), F.transform("paras", _mark).alias("marks")).checkpoint()
    discard(pages.sparkSession, path)
    ordered = rows.withColumns({"part": F.spark_partition_id(), "page": F.monotonically_increasing_id()})
    entered = ordered.drop("page").join(F.broadcast(_states(ordered, **sizes)), "part", "left")  # one row a part
    kind = dict(rows.dtypes)["page_num"]

    def fold(batches):
        import pyarrow as pa

        rule, open_, entry = _Rule(**sizes), None, None  # the open chunk: source, number, first and last page, at an edge, paragraphs
        page = pa.int64() if kind == "bigint" else pa.int32()
        kinds = [pa.string(), pa.int32(), page, page, pa.bool_(), pa.string(), pa.bool_(), pa.int32()]
        names = ["source_name", "chunk_no", "page_start", "page_end", "edge", "chunk_text", "more", "part"]

        def closed(more: bool, at_end: bool = False) -> tuple:
            return (*open_[:4], open_[4] or at_end, "\n\n".join(open_[5]), more, part)

        def batch_of(rows):
            columns = [*zip(*rows)] if rows else [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            out, c = [], {x: _lists(batch, x) if x == "marks" else batch.column(i).to_pylist() for i, x in enumerate(batch.schema.names)}
            for source, number, text, marks, part, *state in zip(*(c[x] for x in ("source_name", "page_num", "text", "marks", "part", "number", "length", "fresh"))):
                if entry is None:
                    entry = (source,) if state[0] is not None else ()
                    if entry:
                        rule.enter(source, *state)
                at = 0
                for m, n in zip(marks, rule.numbers(source, marks)):
                    if open_ is None or (source, n) != (open_[0], open_[1]):
                        if open_ is not None:
                            out.append(closed(source == open_[0]))
                        open_ = [source, n, number, number, open_ is None and entry == (source,), []]
                    open_[3] = number
                    open_[5].append(text[at : at + (m >> 2)])
                    at += (m >> 2) + 2
            yield batch_of(out)
        if open_ is not None:
            yield batch_of([closed(False, at_end=True)])

    made = staged(entered.mapInArrow(fold, f"source_name string, chunk_no int, page_start {kind}, page_end {kind}, edge boolean, chunk_text string, more boolean, part int"))
    columns = ["source_name", "chunk_no", "page_start", "page_end", "chunk_text"]
    inner = made.where(~F.col("edge")).select(*columns, (~F.col("more")).alias("is_last"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "chunk_text"))), lambda x: x["chunk_text"]), "\n\n")
    edges = made.where("edge").groupBy("source_name", "chunk_no").agg(F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"), text.alias("chunk_text"), F.max("more").alias("more"))
    after = F.lead("chunk_no").over(Window.partitionBy("source_name").orderBy("chunk_no"))  # two rows a part at most
    edges = edges.withColumn("is_last", ~F.col("more") & after.isNull()).select(*columns, "is_last")
    chunks = inner.unionByName(edges)
    return link_neighbours(chunks.withColumns({"char_count": F.length("chunk_text"), "token_estimate": estimate_tokens(F.col("chunk_text"))}), prefix)


def link_neighbours(chunks: DataFrame, prefix: str = "chunk") -> DataFrame:
    """chunk_id, prev_chunk_id and next_chunk_id: ids follow from the number, so neighbours need no window; null at the ends."""
    named = lambda n: F.format_string(f"{prefix}_chunk_%04d", n)
    n = F.col("chunk_no")
    return chunks.withColumns({"chunk_id": named(n), "prev_chunk_id": F.when(n > 1, named(n - 1)), "next_chunk_id": F.when(~F.col("is_last"), named(n + 1))}).drop("is_last")
