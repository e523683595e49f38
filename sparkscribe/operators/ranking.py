"""Learned ranking: a pairwise logistic model over candidates' features, fitted by distributed sums, judged on held-out queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkscribe.operators.quality import ranking_metrics
from sparkscribe.sources.staging import staged


def pairs(candidates: DataFrame, size: int) -> DataFrame:
    """(query_id, d0, d1, ...): features of a relevant candidate less those of an irrelevant one of the same query. A query has as many as its
    candidates allow, at most a quarter of their number squared; candidates are the first k of a search, so k bounds them."""
    side = lambda own, name: candidates.where(own).select(F.col("query_id").alias("query_id"), F.col("x").alias(name))
    both = side(F.col("relevant"), "good").join(side(~F.col("relevant"), "bad"), "query_id")
    return both.select("query_id", *((F.get("good", F.lit(i)) - F.get("bad", F.lit(i))).alias(f"d{i}") for i in range(size)))


def fit(differences: DataFrame, size: int, *, l2: float = 1.0, rounds: int = 25, enough: float = 1e-9) -> np.ndarray:
    """Weights w that minimise sum(log(1 + exp(-w . d))) + l2 / 2 * |w|^2, by Newton's method.

    Each round is one aggregation of size + size * (size + 1) / 2 sums, with partial sums in each task; the driver solves that small system. The objective
    is strictly convex, so the result does not depend on the start. No rows give zeros."""
    w = np.zeros(size)
    d = [F.col(f"d{i}") for i in range(size)]
    for _ in range(rounds):
        margin: Column = sum((float(v) * c for v, c in zip(w, d)), F.lit(0.0))
        p = 1 / (1 + F.exp(margin))  # weight of a pair in the gradient
        h = p * (1 - p)
        sums = [F.coalesce(F.sum(p * c), F.lit(0.0)).alias(f"g{i}") for i, c in enumerate(d)]
        sums += [F.coalesce(F.sum(h * d[i] * d[j]), F.lit(0.0)).alias(f"h{i}_{j}") for i in range(size) for j in range(i, size)]
        row = differences.agg(*sums).first()
        gradient = l2 * w - np.array([row[f"g{i}"] for i in range(size)])
        hessian = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] for j in range(size)] for i in range(size)]) + l2 * np.eye(size)
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < enough * max(1.0, np.abs(w).max()):
            break
    return w


def fold_of(folds: int) -> Column:
    return F.pmod(F.xxhash64("query_id"), F.lit(folds))


def cross_ranked(candidates: DataFrame, size: int, folds: int = 5, *, l2: float = 1.0) -> tuple[DataFrame, list[np.ndarray]]:
    """Candidates with `score` and `rank` by models that never saw their query, and each fold's weights.

    candidates: (query_id, id, x array<double> of `size` numbers, relevant boolean, ...). Queries are dealt over folds by a hash of their id, so all
    candidates of a query stay together. Ties go to the smaller id. Rows with a null query_id, x or relevant take no part; an empty table gives no rows."""
    usable = staged(candidates.where("query_id is not null and x is not null and relevant is not null"))
    differences = staged(pairs(usable, size).withColumn("fold", fold_of(folds)))
    weights = [fit(differences.where(F.col("fold") != f), size, l2=l2) for f in range(folds)]
    table = F.array(*(F.array(*(F.lit(float(v)) for v in w)) for w in weights))
    own = F.get(table, fold_of(folds).cast("int"))
    score = F.aggregate(F.zip_with("x", own, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    scored = usable.withColumn("score", score)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))), weights


def compare(rankings: dict[str, DataFrame], k: int) -> DataFrame:
    """(ranker, k, precision, recall, mrr) of rankings (query_id, rank, relevant, total_relevant)."""
    out = None
    for name, hits in rankings.items():
        one = ranking_metrics(hits, k).withColumn("ranker", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("ranker", "k", "precision", "recall", "mrr")
