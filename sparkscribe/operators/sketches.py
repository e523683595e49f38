"""Mergeable sketches: stored states of distinct counts (HyperLogLog) and quantiles (KLL), merged without the rows they came from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a HyperLogLog register index, accuracy parameter of KLL.
LG_K, KLL_K = 12, 400
#: Largest relative error of a distinct count, and largest error of a quantile's rank, that callers may rely on (about four standard errors).
DISTINCT_ERROR, RANK_ERROR = 0.065, 0.015


def states(rows: DataFrame, keys: Sequence[str], item: str, value: str) -> DataFrame:
    """keys, n, items (HyperLogLog state of `item`), values (KLL state of `value`): a row for each combination of the keys, ready to be stored.

    Null items and values are left out of the states, n counts all rows; null keys are groups of their own; an empty table gives no rows. A
    state's size is bounded (some KB), whatever the number of rows."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(F.col(item), LG_K).alias("items"), F.kll_sketch_agg_double(F.col(value).cast("double"), KLL_K).alias("values"))


def merged(stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """States of coarser groups from stored ones."""
    return stored.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_union_agg("items").alias("items"), F.kll_merge_agg_double("values").alias("values"))


def estimates(stored: DataFrame, ranks: Sequence[float] = (0.5, 0.9)) -> DataFrame:
    """The states' estimates: n_items, and a column q<percent> for each rank; null for a group without a value."""
    some = F.kll_sketch_get_n_double("values") > 0
    quantile = lambda r: F.when(some, F.kll_sketch_get_quantile_double("values", F.lit(float(r)))).alias(f"q{round(r * 100)}")
    return stored.select(*(c for c in stored.columns if c not in ("items", "values")), F.hll_sketch_estimate("items").alias("n_items"), *map(quantile, ranks))
