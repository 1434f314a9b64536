"""Feedback, weight tuning and retrieval metrics."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram import schema as S
from engram.functions import expr as X


def recent(signals: DataFrame, now, days: int = 30) -> DataFrame:
    return signals.where(X.days_between(F.col("timestamp"), X.at(now)) <= days)


def feedback_rates(signals: DataFrame) -> DataFrame:
    """Shares of each kind, and the score (used + 0.3 ignored) / n, 1 without signals."""
    rate = lambda k: F.coalesce(F.avg(F.when(F.col("signal_type") == k, 1.0).otherwise(0.0)), F.lit(0.0))
    out = signals.agg(F.count("*").alias("n"), *[rate(k).alias(f"{k}_rate") for k in ("used", "ignored", "corrected", "contradicted")])
    return out.withColumn("quality_score", F.when(F.col("n") == 0, 1.0).otherwise(F.col("used_rate") + 0.3 * F.col("ignored_rate")))


TUNED = ["semantic", "lexical", "graph", "recency", "salience", "confidence"]


def tune(weights: S.Weights, signals: Iterable[tuple[str, str | None]], rate: float = 0.01) -> S.Weights:
    """A fold over (signal_type, dominant term); clamped, normalised, the rounding remainder to the largest."""
    w = {k: getattr(weights, k) for k in TUNED}
    epistemic = weights.epistemic
    for kind, dominant in signals:
        key = dominant if dominant in w else max(w, key=w.get)
        if kind == "used":
            w[key] += rate
        elif kind == "ignored":
            w[key] -= rate / 2
        elif kind == "corrected":
            w["semantic"] -= rate
            w["confidence"] += rate
        elif kind == "contradicted":
            w["confidence"] -= rate
            epistemic += rate
    w = {k: min(0.95, max(0.01, v)) for k, v in w.items()}
    total = sum(w.values())
    w = {k: round(v / total, 10) for k, v in w.items()}
    top = max(w, key=w.get)
    w[top] = round(w[top] + 1 - sum(w.values()), 10)
    return replace(weights, **w, epistemic=min(0.95, max(0.01, epistemic)))


def ranking_metrics(results: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, grade, all_relevant) -> precision, recall, F1, nDCG at k and reciprocal rank per query."""
    hit = F.col("grade") > 0
    at_k = F.col("rank") <= k
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rank") + 1)
    ideal_rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "rank"))
    rows = results.withColumns({"ideal_rank": ideal_rank})
    ideal = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("ideal_rank") + 1)
    out = rows.groupBy("query_id").agg(
        F.sum(F.when(at_k & hit, 1.0).otherwise(0.0)).alias("h"),
        F.max("all_relevant").alias("relevant"),
        F.sum(F.when(at_k, gain).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("ideal_rank") <= k, ideal).otherwise(0.0)).alias("idcg"),
        F.min(F.when(hit, F.col("rank"))).alias("first"),
    )
    p, r = F.col("h") / k, F.when(F.col("relevant") > 0, F.col("h") / F.col("relevant")).otherwise(0.0)
    out = out.withColumns({"precision_at_k": p, "recall_at_k": r})
    f1 = F.when(F.col("h") > 0, 2 * F.col("precision_at_k") * F.col("recall_at_k") / (F.col("precision_at_k") + F.col("recall_at_k"))).otherwise(0.0)
    return out.select("query_id", "precision_at_k", "recall_at_k", f1.alias("f1"), F.when(F.col("idcg") > 0, F.least(F.col("dcg") / F.col("idcg"), F.lit(1.0))).otherwise(0.0).alias("ndcg_at_k"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"))


def keyword_match(text, expected):
    """Share of the expected keywords that a text holds, whatever their case."""
    found = F.size(F.filter(expected, lambda k: F.contains(F.lower(text), F.lower(k))))
    return F.when(F.size(expected) > 0, found / F.size(expected)).otherwise(1.0)


def keyword_exclusion(text, excluded):
    """One less the share of the excluded keywords that a text holds."""
    found = F.size(F.filter(excluded, lambda k: F.contains(F.lower(text), F.lower(k))))
    return F.when(F.size(excluded) > 0, 1 - found / F.size(excluded)).otherwise(1.0)


def category_means(scores: DataFrame) -> DataFrame:
    """(category, score) -> the mean score of every category."""
    return scores.groupBy("category").agg(F.avg("score").alias("score"))


def keyword_metrics(results: DataFrame, truth: DataFrame, k: int = 5) -> DataFrame:
    """results: (query_id, rank, content); truth: (query_id, keywords, grades map of keyword to grade).

    A result is relevant if it holds a keyword, its grade is the greatest of the graded keywords it holds, else 1. Precision is
    over the results shown, recall over distinct keywords found, the ideal order over the keywords' grades.
    """
    rows = results.join(truth, "query_id").withColumn("text", F.lower("content"))
    held = lambda words: F.filter(words, lambda w: F.contains(F.col("text"), F.lower(w)))
    graded = F.array_max(F.transform(held(F.map_keys("grades")), lambda w: F.element_at("grades", w)))
    hit = F.size(held(F.col("keywords"))) > 0
    rows = rows.withColumns({"hit": hit, "grade": F.when(F.coalesce(graded, F.lit(0)) > 0, graded).otherwise(hit.cast("int")), "found": F.transform(held(F.col("keywords")), F.lower)})
    top = F.col("rank") <= k
    per = rows.groupBy("query_id").agg(
        F.sum(F.when(top & F.col("hit"), 1.0).otherwise(0.0)).alias("h"), F.sum(F.when(top, 1.0).otherwise(0.0)).alias("shown"),
        F.sum(F.when(top, (F.pow(F.lit(2.0), "grade") - 1) / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"), F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"),
    )
    words = rows.where(top).select("query_id", F.explode("found").alias("word")).distinct().groupBy("query_id").agg(F.count("*").alias("words"))
    best = truth.withColumn("ideal", F.slice(F.reverse(F.array_sort(F.transform("keywords", lambda w: F.coalesce(F.try_element_at("grades", w), F.lit(1))))), 1, k))
    gains = F.transform("ideal", lambda g, i: (F.pow(F.lit(2.0), g) - 1) / F.log2(i + 2))
    best = best.select("query_id", F.size("keywords").alias("total"), F.aggregate(gains, F.lit(0.0), lambda a, b: a + b).alias("idcg"))
    out = best.join(per, "query_id", "left").join(words, "query_id", "left").na.fill(0)
    p, r = F.when(F.col("shown") > 0, F.col("h") / F.col("shown")).otherwise(0.0), F.when(F.col("total") > 0, F.col("words") / F.col("total")).otherwise(0.0)
    out = out.withColumns({"precision": p, "recall": r})
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    ndcg = F.when(F.col("idcg") > 0, F.least(F.col("dcg") / F.col("idcg"), F.lit(1.0))).otherwise(0.0)
    return out.select("query_id", "precision", "recall", f1.alias("f1"), ndcg.alias("ndcg"), F.when(F.col("first") > 0, 1 / F.col("first")).otherwise(0.0).alias("mrr"), (F.col("first") > 0).cast("double").alias("hit_rate"))


def macro_average(metrics: DataFrame) -> DataFrame:
    """The mean of every metric over queries; 0 without any."""
    return metrics.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in metrics.columns if c != "query_id"])


def same_result(a: DataFrame, b: DataFrame) -> bool:
    """Whether two runs gave the same rows, repeats counted."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
