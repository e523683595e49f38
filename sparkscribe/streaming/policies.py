"""Online models of several policies from a stream of events: keyed state with timers, exact over restarts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkscribe.operators.bandit import FEATURES, LinUCB

#: A part of a policy's sums, as the stream gives it out: the upper triangle of the sum of x x', then the sum of r x.
PART = "policy STRING, shard INT, n BIGINT, sums ARRAY<DOUBLE>"
SHARDS = 16


def sizes(dim: int = FEATURES) -> int:
    return dim * (dim + 1) // 2 + dim


def partial_sums(events: DataFrame, *, dim: int = FEATURES, shards: int = SHARDS, idle: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """PART rows of a stream of events(event_id, ts, policy, x ARRAY<DOUBLE>, r DOUBLE).

    A policy's events are dealt over `shards` by the hash of their id, so a frequent policy is many tasks; each shard keeps its count, its sums and a
    timer: when no event can come within `idle` of its last one (the watermark, the largest time less `late`, has passed both), the
    sums are given out and forgotten. Later events start a new part. An event counts if time, x of `dim` numbers and r are there and finite; rows older
    than the watermark are dropped. A null policy is a policy."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    width, wait = sizes(dim), F.expr(f"interval {idle}")
    at = lambda i: F.get("x", F.lit(i))
    products = [at(i) * at(j) for i in range(dim) for j in range(i, dim)] + [at(i) * F.col("r") for i in range(dim)]
    fits = (F.size("x") == dim) & F.forall(F.array_append("x", F.col("r")), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    shard = F.pmod(F.xxhash64("event_id"), F.lit(shards)).cast("int").alias("shard")
    due = F.unix_millis(F.col("ts") + wait).alias("due")
    timed = events.where(F.col("ts").isNotNull()).withWatermark("ts", late)
    rows = timed.select("ts", "policy", shard, due, F.when(F.coalesce(fits, F.lit(False)), F.array(*products)).alias("terms"))

    def step(key, frames, state):
        import numpy as np
        import pandas as pd

        if state.hasTimedOut:
            n, _, sums = state.get
            state.remove()
            if n:
                yield pd.DataFrame({"policy": [key[0]], "shard": [key[1]], "n": [n], "sums": [list(sums)]})
            return
        n, last, sums = state.get if state.exists else (0, 0, [0.0] * width)
        total = np.array(sums, float)
        for frame in frames:
            last = max(last, int(frame["due"].max()))
            terms = frame["terms"].dropna()
            if len(terms):
                n, total = n + len(terms), total + np.stack(terms.to_numpy()).sum(axis=0)
        state.update((int(n), last, total.tolist()))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1))

    return rows.groupBy("policy", "shard").applyInPandasWithState(step, PART, "n LONG, due LONG, sums ARRAY<DOUBLE>", "append", GroupStateTimeout.EventTimeTimeout)


def run_policies(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, *, files_per_trigger: int | None = None, **options) -> None:
    """Take in the files of `folder` that are new since the checkpoint and append the parts that closed to `out`. State and sink belong to one
    checkpoint, so each event counts once, also when the run is started again after a failure."""
    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader
    found = partial_sums(reader.parquet(folder), **options)
    found.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out).awaitTermination()


def policy_sums(parts: DataFrame, dim: int = FEATURES) -> DataFrame:
    """(policy, n, sums): a row a policy, parts added place by place; no parts give no rows."""
    return parts.groupBy("policy").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(sizes(dim)))).alias("sums"))


def models(parts: DataFrame, *, alpha: float = 1.0, l2: float = 1.0, dim: int = FEATURES) -> dict:
    """The LinUCB model of each policy: one row a policy comes to the driver."""
    import numpy as np

    found = {}
    for row in policy_sums(parts, dim).toLocalIterator():
        upper, b = np.array(row["sums"][:-dim]), np.array(row["sums"][-dim:])
        a = np.zeros((dim, dim))
        a[np.triu_indices(dim)] = upper
        found[row["policy"]] = LinUCB(dim, alpha, l2, a + np.triu(a, 1).T + l2 * np.eye(dim), b)
    return found
