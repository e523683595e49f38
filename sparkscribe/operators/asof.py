"""As-of join: each left row with the last right row of its key at or before its time, in one sorted pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkscribe.sources.staging import staged


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, *, tie: str, ranges: int | None = None, within: str | None = None) -> DataFrame:
    """left with `found`, the struct of the right row of the same key with the largest (time, tie) at or before the left row's time; null if there is
    none, or, with `within` (an interval such as '1 HOUR'), if it is older than that.

    Both sides are sorted together by key and time over `ranges` partitions (the shuffle partitions, where not given). A key of any number of rows spreads
    over several ranges: the last right row of a range is carried into those after it, one row a range, and counts where the key is the same.
    Rows with a null key or time find nothing and are found by nobody; repeated rows stay; empty tables give empty or unmatched results."""
    spark = left.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = F.struct(*(F.col(c) for c in left.columns))
    other = F.struct(*(F.col(c) for c in right.columns))
    whole = F.col(key).isNotNull() & F.col(time).isNotNull()
    a = left.select(F.col(key).alias("k"), F.col(time).alias("t"), F.lit(1).alias("side"), own.alias("own"))
    b = right.where(whole).select(F.col(key).alias("k"), F.col(time).alias("t"), F.lit(0).alias("side"), F.col(tie).alias("tie"), other.alias("other"))
    both = a.withColumns({"tie": F.lit(None).cast(right.schema[tie].dataType), "other": F.lit(None).cast(b.schema["other"].dataType)}).unionByName(b.withColumn("own", F.lit(None).cast(a.schema["own"].dataType)))
    order = ["k", "t", "side", "tie"]
    # a hash of the row parts ties, so that rows alike in key and time are dealt over ranges too
    dealt = both.withColumn("h", F.xxhash64(F.to_json("own"))).repartitionByRange(ranges, *order, "h").withColumn("range", F.spark_partition_id())
    dealt = staged(dealt.drop("h"))
    held = F.when(F.col("side") == 0, F.struct("k", "t", "tie", "other"))
    ends = dealt.where("side = 0").groupBy("range").agg(F.max(F.struct("k", "t", "tie")).alias("last"))
    ends = ends.join(dealt.where("side = 0"), "range").where((F.col("last.k") == F.col("k")) & (F.col("last.t") == F.col("t")) & F.col("last.tie").eqNullSafe(F.col("tie"))).groupBy("range").agg(F.first(F.struct("k", "t", "tie", "other")).alias("held"))
    every = spark.range(ranges).select(F.col("id").cast("int").alias("range")).join(ends, "range", "left")  # a row a range
    carried = every.select("range", F.last("held", ignorenulls=True).over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    last = F.last(held, ignorenulls=True).over(Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    seen = dealt.withColumn("seen", last).where("side = 1").join(F.broadcast(carried), "range").withColumn("seen", F.coalesce("seen", "carried"))
    fits = (F.col("seen.k") == F.col("k")) & F.col("t").isNotNull()
    if within:
        fits &= F.col("seen.t") >= F.col("t") - F.expr(f"INTERVAL {within}")
    return seen.select("own.*", F.when(fits, F.col("seen.other")).alias("found"))
