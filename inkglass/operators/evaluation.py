"""Evaluation: precision and recall, ranking, correlation, spans, resampling."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkglass.operators.intervals import overlap_ratio


def precision_recall(rows: DataFrame, truth: Column, predicted: Column, keys: list[str] | None = None, empty_recall: float = 1.0) -> DataFrame:
    """tp, fp, fn, precision, recall, f1; a ratio without cases is 1 (recall:
    ``empty_recall``), f1 of nothing 0."""
    t, p = F.coalesce(truth, F.lit(False)), F.coalesce(predicted, F.lit(False))
    out = rows.groupBy(*(keys or [])).agg(F.count(F.when(t & p, 1)).alias("tp"), F.count(F.when(~t & p, 1)).alias("fp"), F.count(F.when(t & ~p, 1)).alias("fn"))
    tp = F.col("tp")
    precision = F.when(tp + F.col("fp") > 0, tp / F.nullif(tp + F.col("fp"), F.lit(0))).otherwise(1.0)
    recall = F.when(tp + F.col("fn") > 0, tp / F.nullif(tp + F.col("fn"), F.lit(0))).otherwise(empty_recall)
    out = out.withColumn("precision", precision).withColumn("recall", recall)
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / F.nullif(both, F.lit(0.0))).otherwise(0.0))


def ranking_quality(ranked: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """mrr and recall@k over (query_id, rank, relevant)."""
    first = ranked.groupBy("query_id").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"))
    return first.agg(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"), *(F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)).alias(f"recall_at_{k}") for k in ks))


def mean_rank(df: DataFrame, column: str, out: str) -> DataFrame:
    """Ranks from 1 by ``column``, ties at their mean. The counts of distinct
    values are ranked, not the rows, so the one ordered task sees few."""
    counts = df.groupBy(column).agg(F.count("*").alias("_n"))
    w = Window.orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.withColumn(out, F.coalesce(F.sum("_n").over(w), F.lit(0)) + (F.col("_n") + 1) / 2).drop("_n")
    return df.join(ranks, column)


def correlations(pairs: DataFrame) -> DataFrame:
    """pearson and spearman of (x, y)."""
    ranked = mean_rank(mean_rank(pairs, "x", "rx"), "y", "ry")
    return ranked.agg(F.corr("x", "y").alias("pearson"), F.corr("rx", "ry").alias("spearman"))


def split_of(doc_id: Column, parts: tuple[tuple[str, int], ...] = (("development", 60), ("validation", 20), ("holdout", 20))) -> Column:
    """A document's split, by a hash of its id: the same wherever it is computed."""
    bucket = F.pmod(F.conv(F.substring(F.md5(doc_id.cast("string")), 1, 8), 16, 10).cast("long"), F.lit(100))
    edges, low = F.lit(None).cast("string"), 0
    for name, share in parts:
        edges = F.when(edges.isNull() & (bucket < low + share), name).otherwise(edges)
        low += share
    return edges


def match_passages(truth: DataFrame, predictions: DataFrame, least: float = 0.5) -> DataFrame:
    """(prediction_id, truth_id, quality): predictions in their order each take
    the best truth still free, by the lesser overlap on both sides. Order is
    what makes it greedy, so a pair of documents is one group; only pairs that
    overlap enough are in it."""
    on = (F.col("p.suspicious_document") == F.col("t.suspicious_document")) & (F.col("p.source_document") == F.col("t.source_document"))
    p, t = predictions.alias("p"), truth.alias("t")

    def share(side: str) -> Column:
        ps, ts = F.col(f"p.{side}_offset"), F.col(f"t.{side}_offset")
        return overlap_ratio(ps, ps + F.col(f"p.{side}_length"), ts, ts + F.col(f"t.{side}_length"))

    pairs = p.join(t, on).select("p.suspicious_document", "p.source_document", "p.prediction_id", "t.truth_id", F.least(share("suspicious"), share("source")).alias("quality"))

    def greedy(key, f):
        import pandas as pd

        used, out = set(), []
        for pid, g in f.sort_values(["prediction_id", "quality", "truth_id"], ascending=[True, False, True]).groupby("prediction_id", sort=True):
            for tid, q in zip(g["truth_id"], g["quality"], strict=True):
                if tid not in used:
                    used.add(tid)
                    out.append((pid, tid, q))
                    break
        return pd.DataFrame(out, columns=["prediction_id", "truth_id", "quality"])

    return pairs.where(F.col("quality") >= least).groupBy("suspicious_document", "source_document").applyInPandas(greedy, "prediction_id long, truth_id long, quality double")


def bootstrap(values: list[float], rounds: int = 1000, seed: int = 0) -> tuple[float, float]:
    """The 2.5 and 97.5 per cent points of resampled means, on the driver: the
    values are one a document set, and their order is part of the result."""
    if not values:
        return 0.0, 0.0
    r = random.Random(seed)
    means = sorted(sum(r.choice(values) for _ in values) / len(values) for _ in range(rounds))
    return means[int(0.025 * rounds)], means[min(rounds - 1, int(0.975 * rounds))]
