"""The property graph as node and edge tables, and one-hop context of hits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkscribe.sources.files import assert_unique
from sparkscribe.sources.staging import bound_batches, staged
from sparkscribe.sources.store import chunk_concept_map, upsert


def chunk_nodes(chunks: DataFrame) -> DataFrame:
    """Graph properties of chunks; counts missing from the input are 0 here."""
    count = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c) if c in chunks.columns else F.lit(0).alias(c)
    link = lambda c: F.col(c) if c in chunks.columns else F.lit(None).cast("string").alias(c)
    return chunks.select("chunk_id", "source_name", "page_start", "page_end", "chunk_text", count("char_count"), count("token_estimate"), link("prev_chunk_id"), link("next_chunk_id"))


def concept_nodes(concepts: DataFrame) -> DataFrame:
    return concepts.select("concept_id", "name", "type", "aliases", "description", "max_confidence")


def next_edges(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.coalesce("next_chunk_id", F.lit("")) != "").select("chunk_id", "next_chunk_id")


def grounded(edges: DataFrame, source: str, sources: DataFrame, source_key: str, target: str, targets: DataFrame, target_key: str) -> DataFrame:
    """Edges both of whose ends exist, each once."""
    kept = edges.join(sources.select(F.col(source_key).alias(source)).distinct(), source, "left_semi")
    return kept.join(targets.select(F.col(target_key).alias(target)).distinct(), target, "left_semi").distinct()


def build_graph(chunks: DataFrame, concepts: DataFrame, relations: DataFrame, mentions: DataFrame | None = None, *, unique: bool = True) -> dict[str, DataFrame]:
    """Node and edge tables. mentions: (chunk_id, concept_id) rows; without them the lists of the concepts are exploded. unique: refuse
    repeated chunk or concept ids."""
    if unique:
        assert_unique(chunks, "chunk_id")
        assert_unique(concepts, "concept_id")
    nodes, ideas = chunk_nodes(chunks), concept_nodes(concepts)
    return {
        "chunks": nodes,
        "concepts": ideas,
        "mentions": grounded(chunk_concept_map(concepts) if mentions is None else mentions, "chunk_id", nodes, "chunk_id", "concept_id", ideas, "concept_id"),
        "next": grounded(next_edges(chunks), "chunk_id", nodes, "chunk_id", "next_chunk_id", nodes, "chunk_id"),
        "relations": grounded(relations.drop("ord"), "source_concept_id", ideas, "concept_id", "target_concept_id", ideas, "concept_id").dropDuplicates(["relation_id"]),
    }


def merge_nodes(existing: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows replace nodes or edges of the same key; ingesting twice changes nothing."""
    return upsert(existing, rows, key)


def statistics(graph: dict[str, DataFrame]) -> DataFrame:
    """One row of counts; an empty table counts 0."""
    names = {"chunks": "chunks", "concepts": "concepts", "mentions": "mentions", "relations": "relations", "next": "next_edges"}
    out = None
    for table, name in names.items():
        one = graph[table].agg(F.count(F.lit(1)).alias(name))
        out = one if out is None else out.crossJoin(one)  # rows of one
    return out


def bind_index(chunks: DataFrame, index_rows: DataFrame, name: str, model: str, dim: int, now: Column) -> dict[str, DataFrame]:
    """The index node, its edges, and chunks with the index properties."""
    spark = chunks.sparkSession
    node = spark.range(1).select(F.lit(name).alias("index_name"), F.lit(model).alias("embedding_model"), F.lit(dim).alias("embedding_dim"), now.alias("indexed_at"))
    edges = index_rows.join(chunks.select("chunk_id"), "chunk_id", "left_semi").select("chunk_id", F.lit(name).alias("index_name"), "vector_row_index")
    bound = chunks.join(edges.select("chunk_id", "index_name", "vector_row_index"), "chunk_id", "left").withColumns({"embedding_model": F.when(F.col("index_name").isNotNull(), model), "embedding_dim": F.when(F.col("index_name").isNotNull(), dim)})
    return {"index": node, "edges": edges, "chunks": bound}


def linked_count(edges: DataFrame, name: str) -> DataFrame:
    return edges.where(F.col("index_name") == name).agg(F.count(F.lit(1)).alias("linked"))


def chunk_mentions(hits: DataFrame, graph: dict[str, DataFrame]) -> DataFrame:
    """Distinct (chunk_id, concept_id, name, type) of the hits' chunks."""
    found = hits.select("chunk_id").distinct().join(graph["mentions"], "chunk_id")
    return found.join(graph["concepts"].select("concept_id", "name", "type"), "concept_id").select("chunk_id", "concept_id", "name", "type").distinct()


def expand(hits: DataFrame, graph: dict[str, DataFrame], max_edges: int = 8) -> DataFrame:
    """Distinct outgoing relations of the concepts a hit's chunk mentions, from any chunk; the first max_edges by source, relation, target."""
    named = graph["concepts"].select("concept_id", "name")
    edges = graph["relations"].groupBy("source_concept_id", "relation", "target_concept_id", "confidence").agg(F.lit(1).alias("_"))  # parallel edges of many chunks collapse before the join
    edges = edges.join(named.select(F.col("concept_id").alias("source_concept_id"), F.col("name").alias("source_name")), "source_concept_id").join(named.select(F.col("concept_id").alias("target_concept_id"), F.col("name").alias("target_name")), "target_concept_id")
    # of a source, a chunk can take its first max_edges only: a concept of many edges and many chunks is not multiplied out
    first = Window.partitionBy("source_concept_id").orderBy("relation", "target_concept_id", "confidence", "source_name", "target_name")
    edges = edges.drop("_").distinct().withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= max_edges).drop("_n")
    out = hits.select("chunk_id").distinct().join(graph["mentions"], "chunk_id").join(edges, F.col("concept_id") == F.col("source_concept_id"))
    out = out.select("chunk_id", "source_concept_id", "source_name", "relation", "target_concept_id", "target_name", "confidence").distinct()
    by = Window.partitionBy("chunk_id").orderBy("source_concept_id", "relation", "target_concept_id", "confidence")
    return out.withColumn("edge_no", F.row_number().over(by)).where(F.col("edge_no") <= max_edges)


def with_context(hits: DataFrame, graph: dict[str, DataFrame], max_edges: int = 8) -> DataFrame:
    """Hits with `graph`: mentions and related edges, nested; one set of joins for all hits."""
    m = chunk_mentions(hits, graph).groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("concept_id", "name", "type"))).alias("mentions"))
    e = expand(hits, graph, max_edges).groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("source_concept_id", "source_name", "relation", "target_concept_id", "target_name", "confidence"))).alias("related"))
    joined = hits.join(m, "chunk_id", "left").join(e, "chunk_id", "left")
    empty = lambda c: F.coalesce(c, F.array().cast(joined.schema[c].dataType)).alias(c)
    return joined.withColumn("graph", F.struct(empty("mentions"), empty("related"))).drop("mentions", "related")


def learning_path(relations: DataFrame, starts: DataFrame, relation: str = "depends_on", most: int = 4) -> DataFrame:
    """(start, concept_id, depth, step) for each start of starts(concept_id): what it depends on, directly or through others up to `most` edges away,
    by the shortest way; step 1 is what to learn first, the start itself comes last.

    Concepts are numbered by id, and what lies within d edges of one is a set of numbers, joined from the sets within d - 1 edges of those it depends
    on: a row of bits for each edge and level, never one for each pair or path, and the pairs of the result are written from the sets in their order,
    without a sort. Parallel edges count once. Steps go by falling depth, then by id. A start without edges is its own path of one step; null ids and
    edges with a null end take no part; repeated starts are one."""
    spark = relations.sparkSession
    bound_batches(spark)
    edges = relations.where((F.col("relation") == relation) & F.col("source_concept_id").isNotNull() & F.col("target_concept_id").isNotNull()).select("source_concept_id", "target_concept_id").distinct()
    edges = staged(edges.where("source_concept_id <> target_concept_id"))
    first = staged(starts.where(F.col("concept_id").isNotNull()).select("concept_id").distinct())
    names, n = _numbered(edges.select("source_concept_id").unionByName(edges.select("target_concept_id").toDF("source_concept_id")).union(first).toDF("concept_id").distinct())
    end = lambda c, out: names.select(F.col("concept_id").alias(c), F.col("n").alias(out))
    edges = staged(edges.join(end("source_concept_id", "a"), "source_concept_id").join(end("target_concept_id", "b"), "target_concept_id").select("a", "b"))
    out = first.join(names, "concept_id").select(F.col("concept_id").alias("start"), F.col("n").alias("a"))
    chosen, parts, within = staged(out.select("a")), max(24, 2 * spark.sparkContext.defaultParallelism), []
    for depth in range(1, int(most) + 1):
        rows = edges if depth < int(most) else edges.join(chosen, "a", "left_semi")
        near = rows.join(within[-1].withColumnsRenamed({"a": "b"}), "b", "left").select("a", "b", "near") if within else rows.withColumn("near", F.lit(None).cast("binary"))
        within.append(staged(near.repartition(parts, "a").sortWithinPartitions("a").mapInArrow(_united(n), "a int, near binary")))
        out = out.join(within[-1].withColumnRenamed("near", f"near_{depth}"), "a", "left")
    steps = out.repartition(parts, "a").mapInArrow(_layers(n, int(most)), f"start {out.schema['start'].dataType.simpleString()}, depth int, before int, found array<int>")
    steps = steps.select("start", "depth", "before", F.posexplode("found").alias("at", "n"))
    return steps.join(names, "n").select("start", "concept_id", "depth", (F.col("before") + F.col("at") + 1).alias("step"))


def _numbered(ids: DataFrame) -> tuple[DataFrame, int]:
    """(concept_id, n), n from 0 in the order of the ids, and how many there are."""
    rows = staged(ids.orderBy("concept_id").withColumn("m", F.monotonically_increasing_id()).withColumn("part", F.shiftright("m", 33)))
    before, total = [], 0
    for r in rows.groupBy("part").count().orderBy("part").collect():  # a row a partition
        before.append((r["part"], total))
        total += r["count"]
    offsets = ids.sparkSession.createDataFrame(before, "part long, before long")
    return staged(rows.join(F.broadcast(offsets), "part").select("concept_id", (F.col("before") + F.col("m") - F.shiftleft("part", 33)).cast("int").alias("n"))), total


#: Numbers in a row of a result's layer, and bytes of sets in a batch that leaves a worker.
LAYER, SETS = 1 << 16, 8 << 20


def _members(near: bytes, n: int) -> np.ndarray:
    """The numbers of a set: one bit each, or four bytes each where that is shorter."""
    if len(near) == -(-n // 8):
        return np.flatnonzero(np.unpackbits(np.frombuffer(near, np.uint8), count=n)).astype(np.int32)
    return np.frombuffer(near, np.int32)


def _united(n: int):
    """Rows (a, b, near), sorted by a, to a set for each a: itself, each b, and the sets near them."""
    width = -(-n // 8)

    def unite(batches):
        import pyarrow as pa

        bits, few, last, out, held = np.zeros(width, np.uint8), [], None, [], 0

        def ended():
            all_ = np.unpackbits(bits, count=n)
            all_[np.concatenate([np.array([last], np.int32), *few])] = 1
            k = int(all_.sum())
            return last, (np.flatnonzero(all_).astype(np.int32) if 4 * k < width else np.packbits(all_)).tobytes()

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["a", "near"])

        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.append(np.flatnonzero(np.diff(a, prepend=a[:1] - 1)), len(a)).tolist()
            for lo, hi in zip(cuts, cuts[1:]):
                if a[lo] != last:
                    if last is not None:
                        out.append(ended())
                        held += len(out[-1][1])
                        bits[:], few = 0, []
                    last = int(a[lo])
                few.append(b[lo:hi])
                for near in batch.column(2).slice(lo, hi - lo):
                    x = near.as_py()
                    if x is None:
                        continue
                    if len(x) == width:
                        np.bitwise_or(bits, np.frombuffer(x, np.uint8), bits)
                    else:
                        few.append(np.frombuffer(x, np.int32))
                if len(few) > 1 and sum(map(len, few)) > max(n, 1024):
                    few = [np.unique(np.concatenate(few))]
                if held >= SETS:
                    yield batch_of(out)
                    out, held = [], 0
        if last is not None:
            out.append(ended())
            yield batch_of(out)

    return unite


def _layers(n: int, most: int):
    """Rows (a, start, sets within 1, 2, ... edges) to the numbers at each distance, the farthest first, by number, with how many come before."""

    def part(batches):
        import pyarrow as pa

        for batch in batches:
            columns, out, held = batch.to_pydict(), [], 0
            for i, (a, start) in enumerate(zip(columns["a"], columns["start"])):
                depth = np.full(n, -1, np.int32)
                for d in range(most, 0, -1):
                    near = columns[f"near_{d}"][i]
                    if near is not None:
                        depth[_members(near, n)] = d
                depth[a] = 0
                before = 0
                for d in range(most, -1, -1):
                    found = np.flatnonzero(depth == d).astype(np.int32)
                    for at in range(0, len(found), LAYER):
                        out.append((start, d, before + at, found[at : at + LAYER]))
                    before += len(found)
                held += 4 * before
                if held >= SETS:
                    yield rows_of(pa, out)
                    out, held = [], 0
            if out:
                yield rows_of(pa, out)

    def rows_of(pa, out):
        start, depth, before, found = zip(*out)
        lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, found)]).astype(np.int32), np.concatenate(found))
        return pa.RecordBatch.from_arrays([pa.array(start), pa.array(depth, pa.int32()), pa.array(before, pa.int32()), lists], ["start", "depth", "before", "found"])

    return part
