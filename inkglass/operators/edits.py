"""Edits of texts by exact wording, with their way back.

An edit names the wording that it replaces. It is applied only where that stands
once, after what was applied before it; a document with an edit that can't be
is left as it is, with the reason. What was applied has places, and is taken
back by them, never by looking for the wording again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkglass.functions import text as T

APPLIED = "array<struct<passage_id:string,original:string,new:string,start:int>>"


def _find(part: Column, text: Column, after: Column) -> Column:
    """The first place of ``part`` at ``after`` or later, from 0; -1 for none."""
    return F.call_function("locate", part, text, (after + 1).cast("int")) - 1


def _cut(text: Column, start: Column, length: Column, new: Column) -> Column:
    return F.concat(F.substring(text, F.lit(1), start), new, F.substring(text, start + length + 1, F.length(text)))


def apply(text: Column, edits: Column) -> Column:
    """struct(text, applied, problem) of an array of struct(passage_id, original,
    new): in the order of their places in the text, those of equal place in the
    array's. problem is null, or ``empty``, ``not_found``, ``ambiguous`` with
    the passage; the text is then the one given, and nothing is applied."""
    ordered = F.transform(F.array_sort(F.transform(edits, lambda e, i: F.struct(_find(e["original"], text, F.lit(0)).alias("at"), i.alias("i"), e.alias("e")))), lambda x: x["e"])
    zero = F.struct(text.alias("text"), F.lit(0).alias("cursor"), F.array().cast(APPLIED).alias("applied"), F.lit(None).cast("string").alias("problem"))

    def step(acc: Column, e: Column) -> Column:
        start = _find(e["original"], acc["text"], acc["cursor"])
        why = F.when(e["original"] == "", "empty").when(start < 0, "not_found").when(_find(e["original"], acc["text"], start + 1) >= 0, "ambiguous")
        one = F.struct(e["passage_id"].cast("string").alias("passage_id"), e["original"].alias("original"), e["new"].alias("new"), start.cast("int").alias("start"))
        after = F.struct(
            _cut(acc["text"], start, F.length(e["original"]), e["new"]).alias("text"), (start + F.length(e["new"])).cast("int").alias("cursor"), F.concat(acc["applied"], F.array(one)).alias("applied"), F.lit(None).cast("string").alias("problem")
        )
        stop = F.struct(acc["text"].alias("text"), acc["cursor"].alias("cursor"), acc["applied"].alias("applied"), F.coalesce(acc["problem"], F.concat_ws(":", why, e["passage_id"].cast("string"))).alias("problem"))
        return F.when(acc["problem"].isNotNull() | why.isNotNull(), stop).otherwise(after)

    def whole(acc: Column) -> Column:
        failed = acc["problem"].isNotNull()
        return F.struct(F.when(failed, text).otherwise(acc["text"]).alias("text"), F.when(failed, F.array().cast(APPLIED)).otherwise(acc["applied"]).alias("applied"), acc["problem"].alias("problem"))

    return T.let(F.aggregate(ordered, zero, step), whole)


def restore(text: Column, applied: Column) -> Column:
    """The text before, from what was applied, the last first; null where the
    text at one of the places is no longer what was put there."""

    def step(acc: Column, e: Column) -> Column:
        there = F.substring(acc, e["start"] + 1, F.length(e["new"])) == e["new"]
        return F.when(there, _cut(acc, e["start"], F.length(e["new"]), e["original"]))

    return F.aggregate(F.reverse(applied), text, step)


def edited(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """(doc_id, text, applied, problem) over (doc_id, text) and (doc_id,
    passage_id, original, new); equal places go by passage_id. Documents without
    edits stay as they are; a null wording counts as empty."""
    each = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("passage_id", F.coalesce("original", F.lit("")).alias("original"), F.coalesce("new", F.lit("")).alias("new")))).alias("_e"))
    rows = docs.select("doc_id", "text").join(each, "doc_id", "left")
    done = F.when(F.col("_e").isNotNull() & F.col("text").isNotNull(), apply(F.col("text"), F.col("_e")))
    none = F.struct(F.col("text").alias("text"), F.array().cast(APPLIED).alias("applied"), F.lit(None).cast("string").alias("problem"))
    return rows.select("doc_id", F.coalesce(done, none).alias("_x")).select("doc_id", "_x.*")
