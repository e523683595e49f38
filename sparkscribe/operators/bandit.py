"""Contextual bandits over retrieved candidates: features, rewards, policies, replay, training, off-policy evaluation."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkscribe.functions.text import overlap_ratio
from sparkscribe.functions.vector import normal, uniform
from sparkscribe.sources import schemas

FEATURES = 5
#: Scales and prefixes of features and rewards, and the floor of propensities.
CHARS, TOKENS, FEATURE_PREFIX, REWARD_PREFIX, NOISE, FLOOR = 3000.0, 800.0, 800, 1500, 0.05, 1e-8


def features(query: Column, text: Column, score: Column, rank: Column, chars: Column, tokens: Column, *, prefix: int | None = FEATURE_PREFIX) -> Column:
    short = lambda c, scale: F.least(F.lit(1.0), F.coalesce(c, F.lit(0)).cast("double") / scale)
    return F.array(score.cast("double"), F.lit(1.0) / rank.cast("double"), short(chars, CHARS), short(tokens, TOKENS), overlap_ratio(query, text, prefix).cast("double"))


def reward(query: Column, text: Column, *noise_key, sd: float = NOISE, prefix: int | None = REWARD_PREFIX) -> Column:
    """Token overlap with the query plus keyed noise, clipped to 0..1."""
    base = F.least(F.lit(1.0), overlap_ratio(query, text, prefix).cast("double"))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + normal(*noise_key) * sd))


def first_best(scores: Column) -> Column:
    """Index of the largest score, the first on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def action_probability(best: Column, chosen: Column, arms: Column, epsilon: Column | float) -> Column:
    e = F.lit(epsilon) if isinstance(epsilon, float) else epsilon
    return F.when(best == chosen, 1.0 - e).otherwise(0.0) + e / arms


def epsilon_greedy(best: Column, arms: Column, epsilon: float, *key) -> tuple[Column, Column]:
    """(chosen index, propensity): epsilon is held to 0..1; exploring draws among all arms, the best included."""
    e = min(1.0, max(0.0, float(epsilon)))
    drawn = F.floor(uniform(*key, "arm") * arms).cast("int")
    chosen = F.when(uniform(*key, "explore") < e, drawn).otherwise(best)
    return chosen, action_probability(best, chosen, arms, e)


@dataclass
class LinUCB:
    """A = l2 I + sum x x', b = sum r x; small matrices on the driver, sums over events in Spark."""

    dim: int = FEATURES
    alpha: float = 1.0
    l2: float = 1.0
    A: np.ndarray = field(default=None)
    b: np.ndarray = field(default=None)

    def __post_init__(self):
        self.A = np.eye(self.dim) * self.l2 if self.A is None else np.asarray(self.A, float)
        self.b = np.zeros(self.dim) if self.b is None else np.asarray(self.b, float)
        if self.A.shape != (self.dim, self.dim) or self.b.shape != (self.dim,):
            raise ValueError("A and b do not fit the dimension")

    def theta(self) -> np.ndarray:
        return np.linalg.solve(self.A, self.b)

    def update(self, x, r: float) -> None:
        x = np.asarray(x, float)
        self.A = self.A + np.outer(x, x)
        self.b = self.b + r * x

    def scores(self, x: np.ndarray) -> np.ndarray:
        inverse = np.linalg.inv(self.A)
        return x @ (inverse @ self.b) + self.alpha * np.sqrt(np.maximum(0, np.einsum("ij,jk,ik->i", x, inverse, x)))

    def choose(self, x: np.ndarray) -> int:
        if not len(x):
            raise ValueError("no arms")
        return int(np.argmax(self.scores(np.asarray(x, float))))

    def score(self, x: Column) -> Column:
        """The same score as an expression: the model is a few literals."""
        inverse, theta = np.linalg.inv(self.A), self.theta()
        at = lambda i: F.get(x, F.lit(i))
        exploit = sum((at(i) * float(theta[i]) for i in range(self.dim)), F.lit(0.0))
        spread = sum((at(i) * at(j) * float(inverse[i, j]) for i in range(self.dim) for j in range(self.dim)), F.lit(0.0))
        return exploit + self.alpha * F.sqrt(F.greatest(F.lit(0.0), spread))

    def to_row(self) -> tuple:
        return self.dim, self.alpha, self.l2, self.A.tolist(), self.b.tolist()

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([self.to_row()], schemas.LINUCB).coalesce(1).write.mode("overwrite").json(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> LinUCB:
        r = spark.read.schema(schemas.LINUCB).json(path).first()
        return LinUCB(r["dim"], r["alpha"], r["l2_lambda"], r["A"], r["b"])


def moments(events: DataFrame, x: str = "x", r: str = "r", dim: int = FEATURES) -> DataFrame:
    """One row: a_i_j (i <= j), b_i, n. Commutative sums, combined before the shuffle."""
    at = lambda i: F.get(x, F.lit(i))
    sums = [F.sum(at(i) * at(j)).alias(f"a_{i}_{j}") for i in range(dim) for j in range(i, dim)] + [F.sum(at(i) * F.col(r)).alias(f"b_{i}") for i in range(dim)]
    return events.where(F.col(x).isNotNull() & F.col(r).isNotNull()).agg(*sums, F.count(F.lit(1)).alias("n"), F.avg(r).alias("mean_reward"))


def gram(row, dim: int = FEATURES) -> tuple[np.ndarray, np.ndarray, int]:
    a = np.zeros((dim, dim))
    for i in range(dim):
        for j in range(i, dim):
            a[i, j] = a[j, i] = row[f"a_{i}_{j}"] or 0.0
    return a, np.array([row[f"b_{i}"] or 0.0 for i in range(dim)]), row["n"]


def train(events: DataFrame, model: LinUCB | None = None, alpha: float = 1.0, l2: float = 1.0) -> tuple[LinUCB, dict]:
    """Add all events with a feature and a reward to a model, a new one if none is given. Nothing to learn from is an error."""
    model = model or LinUCB(alpha=alpha, l2=l2)
    flat = events.select(F.col("chosen_arm.feature").alias("x"), F.col("reward").alias("r"))
    wrong = flat.where(F.size("x") != model.dim).limit(1).count()
    if wrong:
        raise ValueError("features do not have the model's dimension")
    row = moments(flat, dim=model.dim).first()
    a, b, n = gram(row, model.dim)
    if not n:
        raise ValueError("no event has a feature and a reward")
    seen = events.count()
    return LinUCB(model.dim, model.alpha, model.l2, model.A + a, model.b + b), {"seen": seen, "trained": n, "skipped": seen - n, "mean_reward": row["mean_reward"]}


def ridge(events: DataFrame, reg: float = 1.0, x: str = "x", r: str = "r", dim: int = FEATURES) -> np.ndarray:
    """Ridge weights without intercept, from distributed sums."""
    a, b, _ = gram(moments(events, x, r, dim).first(), dim)
    return np.linalg.solve(a + reg * np.eye(dim), b)


def predict(x: Column, w) -> Column:
    return sum((F.get(x, F.lit(i)) * float(v) for i, v in enumerate(w)), F.lit(0.0))


def replay(arms: DataFrame, rounds: int, epsilon: float, seed: int = 42, n: int | None = None, *, prefix: int | None = REWARD_PREFIX) -> DataFrame:
    """Events of the retrieval policy: rounds are independent, so each query's arms are built once and rounds are joined to them.

    arms: (query_no, query, arms ARRAY<STRUCT<chunk_id, retrieval_score, rank, feature, text>>), best first; n, its rows, is counted if not
    given. Rewards read the first `prefix` characters of a text, all with None.
    """
    n = n or arms.count()
    rows = arms.sparkSession.range(rounds).select(F.col("id").cast("int").alias("round"), (F.col("id") % n).cast("int").alias("query_no")).join(arms, "query_no")
    best = first_best(F.transform("arms", lambda a: a["retrieval_score"]))
    chosen, p = epsilon_greedy(best, F.size("arms"), epsilon, seed, F.col("round").cast("string"))
    rows = rows.withColumns({"arm_index": chosen, "propensity": p}).withColumn("arm", F.get("arms", "arm_index"))
    rows = rows.withColumn("reward", reward(F.col("query"), F.col("arm.text"), seed, F.col("round").cast("string"), prefix=prefix))
    return rows.select(*_event_columns("retrieval_epsilon", epsilon, seed))


def _event_columns(policy: str, epsilon: float, seed: int) -> list[Column]:
    return [
        F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("round").cast("string")), 256).alias("event_id"),
        "round",
        "query_no",
        "query",
        F.lit(policy).alias("policy_name"),
        F.lit(epsilon).alias("epsilon"),
        F.transform("arms", lambda a: F.struct(a["chunk_id"], a["retrieval_score"], a["rank"], a["feature"])).alias("candidate_arms"),
        F.struct(F.col("arm.chunk_id").alias("chunk_id"), "arm_index", F.col("arm.feature").alias("feature"), "propensity").alias("chosen_arm"),
        "reward",
    ]


def replay_linucb(arms: DataFrame, rounds: int, epsilon: float, alpha: float = 1.0, seed: int = 42, n: int | None = None) -> DataFrame:
    """(round, query_no, arm_index, propensity, reward): each choice depends on all earlier rewards, so one task folds the rounds in
    order, a batch of them in memory. Only numbers go to it: features, and rewards of every arm, made beforehand."""
    n = n or arms.count()
    rows = arms.sparkSession.range(rounds).select(F.col("id").cast("int").alias("round"), (F.col("id") % n).cast("int").alias("query_no")).join(arms, "query_no")
    key = (seed, F.col("round").cast("string"))
    rows = rows.select("round", "query_no", F.transform("arms", lambda a: a["feature"]).alias("x"), F.transform("arms", lambda a: reward(F.col("query"), a["text"], *key)).alias("rewards"), uniform(*key, "explore").alias("u"), uniform(*key, "arm").alias("v"))
    e = min(1.0, max(0.0, epsilon))

    def fold(batches):
        import pyarrow as pa

        model = LinUCB(alpha=alpha)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                x = np.array(r["x"], float)
                best = model.choose(x)
                chosen = int(r["v"] * len(x)) if r["u"] < e else best
                model.update(x[chosen], float(r["rewards"][chosen]))
                out.append((r["round"], r["query_no"], chosen, (1 - e) * (chosen == best) + e / len(x), float(r["rewards"][chosen])))
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["round", "query_no", "arm_index", "propensity", "reward"])

    return rows.repartition(1).sortWithinPartitions("round").mapInArrow(fold, "round int, query_no int, arm_index int, propensity double, reward double")


def policy_index(policy: str, events: DataFrame, model: LinUCB | None = None, seed: int = 42) -> Column:
    """The arm a policy would take: retrieval, random (keyed), linucb."""
    if policy == "retrieval":
        return first_best(F.transform("candidate_arms", lambda a: a["retrieval_score"]))
    if policy == "random":
        return F.floor(uniform(seed, F.col("event_id"), "random") * F.size("candidate_arms")).cast("int")
    if policy == "linucb":
        if model is None:
            raise ValueError("the linucb policy needs a model")
        return first_best(F.transform("candidate_arms", lambda a: model.score(a["feature"])))
    raise ValueError(f"unknown policy {policy!r}")


def event_terms(events: DataFrame, policy: str, w, epsilon: float = 0.05, model: LinUCB | None = None, seed: int = 42) -> DataFrame:
    """(event_id, policy, weight, reward, v_hat, dr): what the estimators sum, once per event."""
    arms, logged = F.size("candidate_arms"), F.col("chosen_arm.arm_index")
    rows = events.withColumn("_best", policy_index(policy, events, model, seed)).withColumn("_q", F.transform("candidate_arms", lambda a: predict(a["feature"], w)))
    weight = action_probability(F.col("_best"), logged, arms, epsilon) / F.greatest(F.lit(FLOOR), F.col("chosen_arm.propensity"))
    v_hat = F.aggregate("_q", F.lit(0.0), lambda s, q: s + q) * (epsilon / arms) + F.get("_q", "_best") * (1.0 - epsilon)
    rows = rows.withColumns({"weight": weight, "v_hat": v_hat})
    return rows.select("event_id", "round", F.lit(policy).alias("policy"), "weight", "reward", "v_hat", (F.col("v_hat") + F.col("weight") * (F.col("reward") - F.get("_q", logged))).alias("dr"))


def estimates(terms: DataFrame) -> DataFrame:
    """(policy, ips, snips, dm, dr, n_events)"""
    gain = F.sum(F.col("weight") * F.col("reward"))
    return terms.groupBy("policy").agg((gain / F.count(F.lit(1))).alias("ips"), (gain / F.greatest(F.lit(FLOOR), F.sum("weight"))).alias("snips"), F.avg("v_hat").alias("dm"), F.avg("dr").alias("dr"), F.count(F.lit(1)).alias("n_events"))


#: How often an event is drawn in a resample as the number of these that a uniform number exceeds: a Poisson number of mean 1.
POISSON = tuple(round(math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)), 12) for k in range(9))


def bootstrap(terms: DataFrame, resamples: int = 200, seed: int = 59) -> DataFrame:
    """(policy, lo, hi): the 2.5 and 97.5 % quantiles of the mean of dr over resamples with replacement.

    Each event has a keyed Poisson weight of mean 1 in each resample, so a resample is a weighted sum over one pass of the
    events, combined before the shuffle: resamples x policies rows move, whatever the number of events. `round` keys an event.
    """
    drawn = terms.select("policy", "round", "dr", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("b"))
    drawn = drawn.withColumn("u", uniform(seed, F.col("b").cast("string"), F.col("round").cast("string")))
    weight = sum(((F.col("u") > c).cast("int") for c in POISSON[1:]), (F.col("u") > POISSON[0]).cast("int"))
    means = drawn.select("policy", "b", "dr", weight.alias("w")).groupBy("policy", "b").agg((F.sum(F.col("w") * F.col("dr")) / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    return means.groupBy("policy").agg(F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"))


def evaluate(events: DataFrame, model: LinUCB | None = None, *, epsilon: float = 0.05, reg: float = 1.0, seed: int = 42) -> DataFrame:
    """The report: estimators and intervals of retrieval, random and, with a model, linucb; reward weights from the logged actions."""
    w = ridge(events.select(F.col("chosen_arm.feature").alias("x"), F.col("reward").alias("r")), reg)
    terms = None
    for policy in ("retrieval", "random", *(["linucb"] if model else [])):
        one = event_terms(events, policy, w, epsilon, model, seed)
        terms = one if terms is None else terms.unionByName(one)
    return estimates(terms).join(bootstrap(terms, seed=seed + 17), "policy")
