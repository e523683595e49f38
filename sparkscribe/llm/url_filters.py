"""URL filters as a sort-merge range join, with DataFrame functions only.

Canonical keys turn rules into intervals. A url stands once for each suffix of its host that may be a rule's host, keyed by that suffix with
its labels reversed and by the path; a rule holds all keys of its host that begin with its path. One sort brings urls, interval starts and
interval ends together; the sweep over it keeps a stack of the active rules: the running sum of starts and ends is the stack's height,
and its top is the last rule opened at that height, for intervals of prefixes nest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Host, path and verdict of the default rules.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Order of rows with one key: rules that are active where a range begins, starts, urls, ends.
_CARRIED, _START, _URL, _END = -1, 0, 1, 2


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without `://`."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """(host, path, verdict) of a short list of rules."""
    rows = F.array(*(F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules))
    return spark.range(1).select(F.inline(rows))


def _reversed(labels: Column) -> Column:
    return F.array_join(F.reverse(labels), ".")


def judge(pages: DataFrame, rules: DataFrame, *, default: str = "allow", id_col: str = "page_id", url_col: str = "url", ranges: int | None = None) -> DataFrame:
    """id, host, path, rule, verdict: a row for each row of pages.

    rules: (host, path, verdict). A rule fits its host and all hosts that end in a dot and its host, if the url's path starts with the rule's;
    the rule of the most characters (host and path) wins, on a tie that of the longer host. Without one, rule is null and the verdict
    `default`. Rules that repeat host and path are one, `block` if any of them is; rules with a null host or path fit nothing.

    The sorted keys are dealt over `ranges` (the shuffle partitions, where not given) by key, path and row, so a host with a third of
    all rows, or one url in all of them, fills several ranges; a rule that spans ranges stands at the start of each. A host is looked at up to
    as many labels as the longest rule's host has.

    Null urls and urls without `://` have an empty host and path; null ids and repeated rows stay rows of their own; an empty table gives no rows, and
    without rules all rows get the default. Other columns are ignored, whatever their names.
    """
    spark = pages.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rules = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
    rules = rules.groupBy(F.translate("host", _UPPER, _LOWER).alias("host"), "path").agg(F.when(F.max(F.col("verdict") == "block"), "block").otherwise(F.max("verdict")).alias("verdict"))
    deepest = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 0

    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row"))
    if not deepest:
        return rows.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    labels = F.split("host", r"\.")
    asked = cut(rows).withColumn("labels", labels)  # the number of a row must not change
    asked = asked.withColumn("n", F.explode(F.sequence(F.lit(1), F.least(F.size("labels"), F.lit(deepest)))))
    no_rule = F.lit(None).cast("struct<rule: string, verdict: string, size: int, host_size: int>")
    urls = asked.select(
        _reversed(F.slice("labels", -F.col("n"), F.col("n"))).alias("key"),
        F.col("path").cast("binary").alias("place"),
        F.lit(_URL).alias("kind"),
        "row",
        F.when(F.col("n") == 1, F.struct("id", "host", "path")).alias("page"),
        no_rule.alias("opened"),
    )
    own = F.struct(F.concat("host", "path").alias("rule"), "verdict", (F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"))
    page_type = urls.schema["page"].dataType
    edges = rules.select(_reversed(F.split("host", r"\.")).alias("key"), F.col("path").cast("binary").alias("start"), own.alias("opened"))
    edges = edges.select("key", F.explode(F.array(F.struct(F.col("start").alias("place"), F.lit(_START).alias("kind")), F.struct(F.concat("start", F.unhex(F.lit("FF"))).alias("place"), F.lit(_END).alias("kind")))).alias("e"), "opened")
    edges = edges.select("key", "e.place", "e.kind", F.lit(-1).cast("long").alias("row"), F.lit(None).cast(page_type).alias("page"), "opened")

    order = ["key", "place", "kind", "row"]
    dealt = cut(urls.unionByName(edges).repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()))
    spans = dealt.where(F.col("kind") != _URL).groupBy("key", "opened").agg(F.min("range").alias("first"), F.max("range").alias("last"), F.min("place").alias("place"))
    carried = spans.where(F.col("last") > F.col("first")).withColumn("range", F.explode(F.sequence(F.col("first") + 1, F.col("last"))))
    carried = carried.select("key", "place", F.lit(_CARRIED).alias("kind"), F.lit(-1).cast("long").alias("row"), F.lit(None).cast(page_type).alias("page"), "opened", "range")

    # carried rules come first, the outer before the inner; then the range in order
    by = [(F.col("kind") != _CARRIED), *map(F.col, order)]
    step = F.when(F.col("kind") == _URL, 0).when(F.col("kind") == _END, -1).otherwise(1)
    height = F.sum(step).over(Window.partitionBy("range").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
    swept = dealt.unionByName(carried).withColumn("height", height)
    pushed = F.when(F.col("kind").isin(_CARRIED, _START), F.col("opened"))
    top = F.last(pushed, ignorenulls=True).over(Window.partitionBy("range", "height").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
    found = swept.withColumn("top", F.when(F.col("height") > 0, top)).where((F.col("kind") == _URL) & (F.col("page").isNotNull() | F.col("top").isNotNull()))

    best = F.max(F.struct("top.size", "top.host_size", "top.rule", "top.verdict")).alias("best")
    one = found.groupBy("row").agg(F.max("page").alias("page"), best)
    return one.select(F.col("page.id").alias(id_col), "page.host", "page.path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), rule_table(spark))


OP11_SQL = """
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS n FROM u),
r AS (SELECT * FROM (VALUES %s) t(h, p, verdict)),
m AS (SELECT n, h || r.p AS rule, verdict, length(h) + length(r.p) AS size, length(h) AS host_size FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r.p)),
b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY n ORDER BY size DESC, host_size DESC) = 1)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN b USING (n)
""" % ", ".join(repr(r) for r in RULES)
