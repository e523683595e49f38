"""Typed relations from phrase patterns: a cue between two concepts of one sentence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Cues, and the relation that each states between the concept before and the concept after it.
CUES = (
    ("is a", "is_a"),
    ("is part of", "part_of"),
    ("is used for", "used_for"),
    ("depends on", "depends_on"),
    ("requires", "depends_on"),
    ("compared with", "compares_with"),
    ("measures", "measures"),
    ("produces", "produces"),
    ("is implemented by", "implemented_by"),
)

#: Phrases and cues that are broadcast at most; more are joined by shuffles.
PHRASES = 100_000

_WORD = r"[\p{L}\p{N}]+"


def sentences(chunks: DataFrame) -> DataFrame:
    """(chunk_id, sentence, words): lower-cased words of each sentence; sentences end at . ! ? and line breaks and are numbered from 0."""
    parts = F.split(F.lower(F.coalesce("chunk_text", F.lit(""))), r"[.!?\n\r]")
    out = chunks.select("chunk_id", F.posexplode(parts).alias("sentence", "s"))
    return out.select("chunk_id", "sentence", F.regexp_extract_all("s", F.lit(_WORD), F.lit(0)).alias("words")).where(F.size("words") > 0)


def spans(sentences: DataFrame, phrases: DataFrame, longest: int) -> DataFrame:
    """(chunk_id, sentence, start, stop, ...): where a phrase of phrases(phrase, ...) stands, as word positions [start, stop)."""
    # one array of a sentence's phrases: the words are not copied to each of its rows
    sizes = lambda start: F.sequence(F.lit(1), F.least(F.lit(longest), F.size("words") - start))
    phrase = lambda start, size: F.struct(start.alias("start"), (start + size).alias("stop"), F.array_join(F.slice("words", start + 1, size), " ").alias("phrase"))
    every = F.flatten(F.transform(F.sequence(F.lit(0), F.size("words") - 1), lambda start: F.transform(sizes(start), lambda size: phrase(start, size))))
    found = sentences.select("chunk_id", "sentence", F.inline(every))
    return found.join(phrases, "phrase")


def pattern_relations(chunks: DataFrame, concepts: DataFrame, cues: Sequence[tuple[str, str]] = CUES, longest: int = 4) -> DataFrame:
    """(chunk_id, sentence, at, source_concept_id, relation, target_concept_id, evidence) from chunks(chunk_id, chunk_text) and
    concepts(phrase, concept_id).

    For each cue in a sentence: the concept that ends last before it is the source, the one that starts first after it the target; of several at one
    place the longest, then the smallest id. Both must be there and differ. at is the cue's word position, evidence the words from source to target.
    Phrases and cues of up to `longest` words are compared as lower-cased words. Null texts have no sentences; repeated phrases count
    once; repeated chunk ids are one text in turn, so ids should be unique; empty tables give no rows. Sorted sweeps within a sentence, no pairs.
    """
    spark = chunks.sparkSession
    tidy = lambda c: F.array_join(F.regexp_extract_all(F.lower(c), F.lit(_WORD), F.lit(0)), " ")
    named = concepts.select(tidy("phrase").alias("phrase"), "concept_id").where("phrase <> '' and concept_id is not null").groupBy("phrase").agg(F.min("concept_id").alias("concept_id"))
    stated = spark.createDataFrame([(c, r) for c, r in cues], "phrase string, relation string").select(tidy("phrase").alias("phrase"), "relation").distinct()
    both = named.select("phrase", "concept_id", F.lit(None).cast("string").alias("relation")).unionByName(stated.select("phrase", F.lit(None).cast("string").alias("concept_id"), "relation"))
    begin = [r[0] for r in stated.select(F.element_at(F.split("phrase", " "), 1)).distinct().collect()]  # a word for each cue at most
    text = sentences(chunks.where("chunk_id is not null")).where((F.size("words") > 2) & F.arrays_overlap("words", F.array(*map(F.lit, begin)).cast("array<string>")))  # others have no cue between concepts
    # no word is shuffled but those of a phrase: the words' own joins stay in place
    found = spans(text, F.broadcast(both) if both.count() <= PHRASES else both, longest).drop("phrase")
    concept = F.col("concept_id").isNotNull()
    # a cue looks back from its start at the concepts' ends and ahead from its stop at their starts; the way ahead is swept from the sentence's end, so
    # both ways the concepts of a place come before its cue, the best of them last
    back, ahead = F.when(concept, F.col("stop")).otherwise(F.col("start")), F.when(concept, F.col("start")).otherwise(F.col("stop"))
    tail = (F.when(concept, 0).otherwise(1), F.col("stop") - F.col("start"), F.desc("concept_id"))
    keys = ["chunk_id", "sentence"]
    sweep = lambda place: F.last(F.when(concept, F.struct("start", "stop", "concept_id")), ignorenulls=True).over(Window.partitionBy(*keys).orderBy(place, *tail).rowsBetween(Window.unboundedPreceding, -1))
    seen = found.withColumns({"source": sweep(back.asc()), "target": sweep(ahead.desc())}).where(~concept)
    edges = seen.groupBy(*keys, "start", "stop", "relation").agg(F.max("source").alias("source"), F.max("target").alias("target"))  # dealt by the same keys: no shuffle
    lines = text.select(*keys, F.array_join("words", " ").alias("line"))
    edges = edges.where("source is not null and target is not null and source.concept_id <> target.concept_id").join(lines, keys).withColumn("words", F.split("line", " "))
    words = F.slice("words", F.col("source.start") + 1, F.col("target.stop") - F.col("source.start"))
    return edges.select("chunk_id", "sentence", F.col("start").alias("at"), F.col("source.concept_id").alias("source_concept_id"), "relation", F.col("target.concept_id").alias("target_concept_id"), F.array_join(words, " ").alias("evidence"))
