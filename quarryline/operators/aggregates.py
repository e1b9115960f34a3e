"""Aggregates Spark lacks: nearest-rank percentiles by weighted values, logistic fit, ranking quality."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def nearest_rank(df: DataFrame, keys: list[str], value: str, ps: dict[str, float]) -> DataFrame:
    """Per group the values at rank p (n - 1), rounded half to even, of the sorted non-null values.

    Rows are first folded to (value, frequency), which combines before the shuffle; the running frequency over distinct values
    finds the ranks, so no group is collected. Groups without values are left out.
    """
    freq = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    by = W.partitionBy(*keys)
    run = freq.withColumn("_to", F.sum("_n").over(by.orderBy(value).rowsBetween(W.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(by))
    at = lambda p: F.bround(F.lit(p) * (F.col("_all") - 1), 0)
    return run.groupBy(*keys).agg(*(F.min(F.when(F.col("_to") > at(p), F.col(value))).alias(name) for name, p in ps.items()))


def logistic_fit(df: DataFrame, x: str, label: str, rounds: int = 25, tolerance: float = 1e-9) -> tuple[float, float, int, int]:
    """(a, b, samples, positives) of P(label) = sigmoid(a x + b) by Newton steps; each step is one aggregate of five sums.

    Raises with fewer than 20 samples or one class only. Separable samples stop at a bounded slope.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(label).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(label).cast("double").alias("y"))
    head = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("p")).first()
    n, positive = head["n"], int(head["p"])
    if n < 20 or positive in (0, n):
        raise ValueError("a fit needs 20 samples of both classes")
    a = b = 0.0
    for _ in range(rounds):
        z = F.lit(a) * F.col("x") + F.lit(b)
        p = 1 / (1 + F.exp(-z))
        w = p * (1 - p)
        s = rows.agg(F.sum((F.col("y") - p) * F.col("x")).alias("ga"), F.sum(F.col("y") - p).alias("gb"), F.sum(w * F.col("x") * F.col("x")).alias("haa"), F.sum(w * F.col("x")).alias("hab"), F.sum(w).alias("hbb")).first()
        det = s["haa"] * s["hbb"] - s["hab"] ** 2
        if det < 1e-12:
            break
        da, db = (s["hbb"] * s["ga"] - s["hab"] * s["gb"]) / det, (s["haa"] * s["gb"] - s["hab"] * s["ga"]) / det
        a, b = a + max(-10.0, min(10.0, da)), b + max(-10.0, min(10.0, db))
        if abs(da) + abs(db) < tolerance or math.hypot(a, b) > 1e6:
            break
    return a, b, n, positive


def log_loss(p: Column, y: Column, eps: float = 1e-12) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q)))


def ranking_quality(hits: DataFrame, query: str, rank: str, relevant: str, k: int, by: list[str] | None = None) -> DataFrame:
    """n queries, hit@k and mean reciprocal rank of the first relevant hit: one row, or one for each value of ``by``."""
    first = hits.groupBy(query, *(by or [])).agg(F.min(F.when(F.col(relevant), F.col(rank))).alias("first"))
    return first.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg((F.coalesce(F.col("first") <= k, F.lit(False))).cast("double")), 4).alias("hit_at_k"),
        F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 4).alias("mrr"),
    )


def share_passed(passed: str, first: Column, fallback: Column) -> Column:
    """Percentage passed of the rows of ``first``, or of those of ``fallback`` if there are none; null without either."""
    share = lambda rows: 100 * F.avg(F.when(rows, F.col(passed).cast("double")))
    return F.when(F.count_if(first) > 0, share(first)).otherwise(share(fallback))


def threshold_choice(rows: DataFrame, thresholds: list[float], floor: float, weights: tuple[float, float, float], floors: tuple[float, float]) -> DataFrame:
    """(threshold, refuse, escalate, answer, score, eligible, chosen) for (p, bucket) with buckets out_of_corpus, underspecified and answer.

    A row is confident from the threshold on and insufficient below threshold and floor. The shares of refused, escalated and answered rows (1 for an empty bucket) are weighted; of the
    thresholds that meet both floors (all, if none does) the best is chosen, the lowest of equals. Every row meets all thresholds in one pass.
    """
    t = F.col("threshold")
    x = rows.select("p", "bucket", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    share = lambda bucket, ok: F.coalesce(F.avg(F.when(F.col("bucket") == bucket, ok.cast("double"))), F.lit(1.0))
    s = x.groupBy("threshold").agg(share("out_of_corpus", F.col("p") < F.least(t, F.lit(floor))).alias("a"), share("underspecified", F.col("p") < t).alias("b"), share("answer", F.col("p") >= t).alias("c"))
    score = F.round(weights[0] * F.col("a") + weights[1] * F.col("b") + weights[2] * F.col("c"), 9)
    w = s.select("threshold", F.round("a", 9).alias("refuse"), F.round("b", 9).alias("escalate"), F.round("c", 9).alias("answer"), score.alias("score"))
    w = w.withColumn("eligible", (F.col("refuse") >= floors[0]) & (F.col("escalate") >= floors[1]))
    best = W.partitionBy(F.lit(0)).orderBy(F.desc("eligible"), F.desc("score"), "threshold")  # one row a threshold
    return w.withColumn("chosen", F.row_number().over(best) == 1)
