"""Intervals: merging, covering, containment. Ends are exclusive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_spans(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end", touching: bool = True) -> DataFrame:
    """Islands of spans that overlap, or touch, within ``keys``."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.col(start) > before if touching else F.col(start) >= before
    islands = spans.withColumn("_new", F.when(before.isNull() | apart, 1).otherwise(0)).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def overlap_ratio(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Shared part of the second interval; 0 where that is empty."""
    return F.when(b_end > b_start, overlap(a_start, a_end, b_start, b_end) / (b_end - b_start)).otherwise(0.0)


def covered(items: DataFrame, spans: DataFrame, keys: list[str], bin_width: int = 256) -> DataFrame:
    """Rows of ``items`` (keys, start, end) that overlap a span (keys, s_start,
    s_end): a range join as an equi-join on bins that both sides touch."""

    def bins(start: str, end: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(start) / bin_width), F.floor((F.greatest(F.col(end) - 1, F.col(start))) / bin_width)))

    left = items.withColumn("_bin", bins("start", "end"))
    right = spans.select(*keys, "s_start", "s_end").withColumn("_bin", bins("s_start", "s_end"))
    hit = left.join(right, [*keys, "_bin"]).where("s_start < end AND start < s_end")
    return hit.select(*items.columns).distinct()


def locate(points: DataFrame, spans: dict[str, DataFrame], keys: list[str], at: str = "at") -> DataFrame:
    """Rows of ``points`` with, for each name of ``spans``, the span (keys,
    start, end, ...) that the point lies in, as a struct, or null: one sweep
    over starts and points in order, in which the last span that began is
    carried. Spans of one name are disjoint within their keys. One shuffle by
    the keys, however many kinds of spans, and no pair is met that isn't one."""
    w = Window.partitionBy(*keys).orderBy("_at", "_point").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = points.select(*keys, F.col(at).cast("long").alias("_at"), F.lit(1).alias("_point"), F.struct(*points.columns).alias("_row"))
    for name, df in spans.items():
        rest = [c for c in df.columns if c not in keys]
        rows = rows.unionByName(df.select(*keys, F.col("start").cast("long").alias("_at"), F.lit(0).alias("_point"), F.struct(*rest).alias(name)), allowMissingColumns=True)
    for name in spans:
        rows = rows.withColumn(name, F.last(name, ignorenulls=True).over(w))
    open_ = [F.when(F.col(f"{name}.end") > F.col("_at"), F.col(name)).alias(name) for name in spans]
    return rows.where("_point = 1").select("_row.*", *open_)
