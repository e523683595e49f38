"""Concepts and relations: lexicon extraction, parsing of model replies, normalisation, errors by chunk, aggregation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkscribe.functions.text import clean_aliases, concept_id, recover_json, recovered, strip
from sparkscribe.sources import schemas

#: Keyword, type and display name of the default lexicon.
LEXICON = (
    ("mri", "modality", "MRI"),
    ("magnetic resonance imaging", "modality", "Magnetic Resonance Imaging"),
    ("ct", "modality", "CT"),
    ("computed tomography", "modality", "Computed Tomography"),
    ("x-ray", "modality", "X-Ray"),
    ("ultrasound", "modality", "Ultrasound"),
    ("oct", "modality", "OCT"),
    ("fourier transform", "method", "Fourier Transform"),
    ("convolution", "method", "Convolution"),
    ("filter", "method", "Filter"),
    ("signal", "signal", "Signal"),
    ("image", "concept", "Image"),
)
#: The concept that anchors every chunk with a match.
ANCHOR = ("Medical Imaging", "concept", "medical imaging", "Domain anchor concept.", 0.8)
#: Allowed types and relations.
TYPES = ("modality", "concept", "method", "signal", "artifact", "task", "metric", "anatomy", "physics_principle")
RELATIONS = ("is_a", "part_of", "used_for", "depends_on", "compares_with", "measures", "produces", "implemented_by")

_CONCEPT = "struct<name: string, type: string, aliases: array<string>, description: string, confidence: string>"
_RELATION = "struct<source: string, relation: string, target: string, evidence: string, confidence: string>"


def extract_by_lexicon(chunks: DataFrame, lexicon: Sequence[tuple[str, str, str]] = LEXICON, anchor: tuple = ANCHOR) -> DataFrame:
    """chunks with `concepts` and `relations`: a keyword counts wherever it stands in the lower-cased text; each modality is used
    for the anchor. The lexicon is an array literal tested within the row: no join and no shuffle."""
    low = F.lower("chunk_text")
    entry = lambda k, t, n: F.struct(F.lit(n).alias("name"), F.lit(t).alias("type"), F.array(F.lit(k)).alias("aliases"), F.lit(f"Keyword match for '{k}'.").alias("description"), F.lit("0.7").alias("confidence"))
    found = F.filter(F.array(*(entry(*x) for x in lexicon)), lambda x: F.contains(low, x["aliases"][0]))
    name, kind, alias, about, confidence = anchor
    anchored = F.struct(F.lit(name).alias("name"), F.lit(kind).alias("type"), F.array(F.lit(alias)).alias("aliases"), F.lit(about).alias("description"), F.lit(str(confidence)).alias("confidence"))
    lacks = (F.size("found") > 0) & ~F.exists("found", lambda x: x["name"] == name)
    relations = F.transform(F.filter("found", lambda x: x["type"] == "modality"), lambda x: F.struct(x["name"].alias("source"), F.lit("used_for").alias("relation"), F.lit(name).alias("target"), F.lit("Heuristic default relation.").alias("evidence"), F.lit("0.6").alias("confidence")))
    out = chunks.withColumn("found", found)
    return out.withColumns({"concepts": F.when(lacks, F.concat("found", F.array(anchored))).otherwise(F.col("found")).cast(f"array<{_CONCEPT}>"), "relations": relations.cast(f"array<{_RELATION}>"), "error": F.lit(None).cast("string")}).drop("found")


def extract_by_model(chunks: DataFrame, reply: Callable[[list[str]], list[str]]) -> DataFrame:
    """The same columns from a model's replies; the model is any function from texts to JSON texts, called by Arrow batch."""

    @F.pandas_udf("string")
    def ask(texts):
        import pandas as pd

        return pd.Series(reply(texts.tolist()))

    return parse_replies(chunks.withColumn("reply", ask("chunk_text")))


def parse_replies(chunks: DataFrame) -> DataFrame:
    """`reply` to `concepts`, `relations` and `error`; a chunk whose reply cannot be read, whose concepts or relations are not lists of objects,
    or with an unreadable confidence yields nothing but its error."""
    parsed = chunks.withColumns({"r": recover_json(F.col("reply"), schemas.EXTRACTION), "v": recovered(F.col("reply"))}).drop("reply")
    kind = lambda p: F.expr(f"schema_of_variant(try_variant_get(v, '{p}', 'variant'))")
    no_object = ~F.coalesce(F.expr("schema_of_variant(v)"), F.lit("")).startswith("OBJECT")
    no_list = lambda p: kind(p).isNotNull() & ~kind(p).startswith("ARRAY")
    no_objects = lambda p: kind(p).startswith("ARRAY") & ~kind(p).startswith("ARRAY<OBJECT") & (kind(p) != "ARRAY<VOID>")
    empty = lambda t: F.array().cast(f"array<{t}>")
    concepts, relations = F.coalesce("r.concepts", empty(_CONCEPT)), F.coalesce("r.relations", empty(_RELATION))
    bad = F.exists(concepts, lambda x: x["confidence"].isNotNull() & x["confidence"].try_cast("double").isNull()) | F.exists(relations, lambda x: x["confidence"].isNotNull() & x["confidence"].try_cast("double").isNull())
    error = F.when(F.col("r").isNull() | no_object, "unreadable reply").when(no_list("$.concepts") | no_list("$.relations"), "concepts and relations must be lists")
    error = error.when(no_objects("$.concepts") | no_objects("$.relations"), "entries must be objects").when(bad, "unreadable confidence")
    out = parsed.withColumn("error", error).drop("v")
    return out.withColumns({"concepts": F.when(F.col("error").isNull(), concepts).otherwise(empty(_CONCEPT)), "relations": F.when(F.col("error").isNull(), relations).otherwise(empty(_RELATION))}).drop("r")


def mentions(extracted: DataFrame, least: float = 0.6) -> DataFrame:
    """One row per named concept of a chunk at or above the confidence; `ord` keeps the reply's order."""
    c = extracted.select("chunk_id", "source_name", "page_start", "page_end", F.posexplode("concepts").alias("ord", "c"))
    kind = F.lower(strip(F.coalesce("c.type", F.lit("concept"))))
    c = c.select("*", strip(F.coalesce("c.name", F.lit(""))).alias("name"), F.when(kind.isin(*TYPES), kind).otherwise("concept").alias("type"), F.coalesce(F.col("c.confidence").cast("double"), F.lit(0.0)).alias("confidence"))
    c = c.where((F.col("name") != "") & (F.col("confidence") >= least))
    return c.select(concept_id(F.col("name"), F.col("type")).alias("concept_id"), "name", "type", clean_aliases(F.col("c.aliases")).alias("aliases"), strip(F.coalesce("c.description", F.lit(""))).alias("description"), "confidence", "chunk_id", "source_name", "page_start", "page_end", "ord")


def relation_rows(extracted: DataFrame, mentioned: DataFrame, least: float = 0.6) -> DataFrame:
    """Allowed relations whose two ends are concepts of the same chunk, by lower-cased name; of equal names the last counts."""
    r = extracted.select("chunk_id", "source_name", "page_start", "page_end", F.posexplode("relations").alias("ord", "r"))
    text = lambda c: strip(F.coalesce(c, F.lit("")))
    r = r.select("*", F.lower(text("r.relation")).alias("relation"), text("r.source").alias("s"), text("r.target").alias("t"), text("r.evidence").alias("evidence"), F.coalesce(F.col("r.confidence").cast("double"), F.lit(0.0)).alias("confidence"))
    r = r.where(F.col("relation").isin(*RELATIONS) & (F.col("confidence") >= least) & (F.col("s") != "") & (F.col("t") != ""))
    names = mentioned.groupBy("chunk_id", F.lower("name").alias("key")).agg(F.max_by("concept_id", "ord").alias("id"))
    end = lambda key, out: names.select("chunk_id", F.col("key").alias(key), F.col("id").alias(out))
    r = r.withColumns({"sk": F.lower("s"), "tk": F.lower("t")}).join(end("sk", "source_concept_id"), ["chunk_id", "sk"]).join(end("tk", "target_concept_id"), ["chunk_id", "tk"])
    return r.select(F.concat_ws("|", "source_concept_id", "relation", "target_concept_id", "chunk_id").alias("relation_id"), "source_concept_id", "relation", "target_concept_id", "confidence", "evidence", "chunk_id", "source_name", "page_start", "page_end", "ord")


def mention_edges(mentioned: DataFrame) -> DataFrame:
    """(chunk_id, concept_id), each once: the edge table of the graph."""
    return mentioned.select("chunk_id", "concept_id").distinct()


def aggregate_concepts(mentioned: DataFrame, order: str = "chunk_id", *, lists: bool = True) -> DataFrame:
    """One row per concept: first name and type, all aliases, largest confidence, first description that is not empty, the number of
    chunks and the first of them; with `lists` also all of them, as the exported table has it.

    "First" is by the chunks' order and the place in a chunk, never by arrival. Without lists every column is a partial
    aggregate of bounded size, however frequent a concept; mention_edges() has the chunks as rows.
    """
    ord_ = F.struct(order, "ord")
    alone = mentioned.groupBy("concept_id", "chunk_id").agg(
        F.min(F.struct(ord_.alias("o"), "name", "type")).alias("head"),
        F.flatten(F.collect_set("aliases")).alias("aliases"),
        F.min(F.when(F.col("description") != "", F.struct(ord_.alias("o"), "description"))).alias("about"),
        F.max("confidence").alias("confidence"),
    )
    one = alone.groupBy("concept_id").agg(
        F.min("head").alias("head"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("aliases")))).alias("aliases"),
        F.min("about").alias("about"),
        F.max("confidence").alias("max_confidence"),
        F.count(F.lit(1)).alias("n_mentions"),
        F.min("chunk_id").alias("first_chunk"),
        *([F.array_sort(F.collect_list("chunk_id")).alias("mention_chunk_ids")] if lists else []),
    )
    tail = ["n_mentions", "first_chunk"] + ["mention_chunk_ids"] * lists
    return one.select("concept_id", "head.name", "head.type", "aliases", F.coalesce("about.description", F.lit("")).alias("description"), "max_confidence", *tail)


def dedup_relations(rows: DataFrame) -> DataFrame:
    """Of a source, relation, target and chunk the most confident, the first on a tie."""
    best = F.max_by(F.struct(*(c for c in rows.columns)), F.struct("confidence", (-F.col("ord")).alias("o")))
    return rows.groupBy("source_concept_id", "relation", "target_concept_id", "chunk_id").agg(best.alias("x")).select("x.*")


def extraction_log(extracted: DataFrame, now: Column, least: float = 0.6) -> DataFrame:
    """One row per chunk: status ok with the counts after normalisation, or error with its message."""
    ok = F.col("error").isNull()
    named = mentions(extracted, least).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("concept_count"))
    related = relation_rows(extracted, mentions(extracted, least), least).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("relation_count"))
    rows = extracted.select("chunk_id", "error").join(named, "chunk_id", "left").join(related, "chunk_id", "left")
    count = lambda c: F.when(ok, F.coalesce(c, F.lit(0)))
    return rows.select(now.alias("timestamp"), "chunk_id", F.when(ok, "ok").otherwise("error").alias("status"), count("concept_count").alias("concept_count"), count("relation_count").alias("relation_count"), "error")


def graph_manifest(log: DataFrame, concepts: DataFrame, relations: DataFrame, backend: str = "heuristic", model: str | None = None) -> DataFrame:
    """One row of totals."""
    chunks = log.agg(F.count(F.lit(1)).alias("chunks_processed"), F.count_if(F.col("status") == "error").alias("log_errors"))
    return chunks.crossJoin(concepts.agg(F.count(F.lit(1)).alias("concepts_total"))).crossJoin(relations.agg(F.count(F.lit(1)).alias("relations_total"))).withColumns({"backend": F.lit(backend), "llm_model": F.lit(model).cast("string")})
