"""JSON-lines, query lists, page tables, key/value documents; checks on what is read."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkscribe.functions.text import estimate_tokens, strip
from sparkscribe.sources import schemas

#: The built-in query list.
DEFAULT_QUERIES = (
    "How does CT differ from MRI?",
    "What is Fourier transform used for in imaging?",
    "How does ultrasound imaging work?",
    "What are benefits of X-ray imaging?",
    "Explain convolution in image processing",
)


def bad_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, line_no, line) of the lines that are not JSON objects of the schema, numbered from 1 in their files, blank lines counted but not reported.

    Files are read in blocks. A line's number is its place in its block plus the lines of the file's blocks before it; only blocks that hold a bad line
    are numbered line by line. Empty files and folders give no rows."""
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    parsed = F.from_json("value", f"{schema}, _unread STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_unread"})
    bad = (strip(F.col("value")) != "") & (parsed.isNull() | parsed["_unread"].isNotNull())
    lines = read.withColumn("bad", F.coalesce(bad, F.lit(False)))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.max("bad").alias("any_bad")).withColumn("before", before).where("any_bad").select("file", "block", "before")
    numbered = lines.join(blocks, ["file", "block"]).withColumn("line_no", F.col("before") + F.row_number().over(Window.partitionBy("file", "block").orderBy("at")))
    return numbered.where("bad").select("file", "line_no", F.col("value").alias("line"))


def checked_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """read_jsonl of lines from elsewhere: an unreadable one ends with an error that names its file and number. One more pass over the lines."""
    first = bad_lines(spark, path, schema).orderBy("file", "line_no").limit(1).collect()
    if first:
        raise ValueError(f"{first[0].file}, line {first[0].line_no}: not a JSON record: {first[0].line[:80]}")
    return read_jsonl(spark, path, schema)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Blank lines are skipped; a malformed line ends the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, files: int | None = None) -> None:
    """Nulls are written; one file per partition unless `files` is given."""
    (df.coalesce(files) if files else df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_queries(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(query_no, query): lines of a file, stripped, blank ones dropped; the built-in list without a path."""
    if path is None:
        return spark.createDataFrame(list(enumerate(DEFAULT_QUERIES)), "query_no INT, query STRING")
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("o"), strip(F.col("value")).alias("query")).where("query <> ''")
    # a query list is a small file: its lines are numbered in one task
    return lines.selectExpr("cast(row_number() over (order by o) - 1 as int) as query_no", "query")


def read_pages(spark: SparkSession, path: str, extract: Callable[[bytes], Iterable[str]]) -> DataFrame:
    """RawPage rows of binary documents: `extract` gives the page texts of one file; pages count from 1."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def pages(batches):
        import pandas as pd

        for batch in batches:
            rows = [(p.rsplit("/", 1)[-1], n, t) for p, c in zip(batch["path"], batch["content"]) for n, t in enumerate(extract(bytes(c)), 1)]
            yield pd.DataFrame(rows, columns=["source_name", "page_num", "raw_text"])

    return files.mapInPandas(pages, schemas.RAW_PAGE)


def require(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """df, ending with an error at the first row that lacks one of the columns' values."""
    checked = df
    for c in columns:
        missing = F.raise_error(F.concat(F.lit(f"missing {c} in "), F.to_json(F.struct(*df.columns))))
        checked = checked.withColumn(c, F.when(F.col(c).isNull(), missing.cast(df.schema[c].dataType)).otherwise(F.col(c)))
    return checked


def assert_unique(df: DataFrame, *key: str) -> DataFrame:
    again = df.groupBy(*key).count().where("count > 1").limit(1).collect()
    if again:
        raise ValueError(f"repeated key {again[0].asDict()}")
    return df


def chunks_for_embedding(df: DataFrame) -> DataFrame:
    """Types and the defaults an embedding run uses: counts missing from the input are taken from the text."""
    text = F.col("chunk_text")
    given = lambda c, other: F.coalesce(F.col(c).cast("int"), other) if c in df.columns else other
    return require(df, ("chunk_id", "source_name", "page_start", "page_end", "chunk_text")).select(
        F.col("chunk_id").cast("string"), F.col("source_name").cast("string"), F.col("page_start").cast("int"), F.col("page_end").cast("int"), text,
        given("char_count", F.length(text)).alias("char_count"), given("token_estimate", estimate_tokens(text)).alias("token_estimate"),
    )


def chunks_for_concepts(df: DataFrame, max_chars: int = 4000) -> DataFrame:
    return require(df, ("chunk_id", "source_name", "page_start", "page_end", "chunk_text")).withColumn("chunk_text", F.substring("chunk_text", 1, max_chars))
