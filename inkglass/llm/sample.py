"""The bounded sample of labelled rows that classifiers learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_present(labels: DataFrame, docs: DataFrame, most: int) -> DataFrame:
    """Of ``labels``, a row a doc_id, those ``most`` of documents that are there
    whose doc_id has the least hash. Labels without a document don't count.
    The ids are looked for among all documents only when one of the first is
    missing; either way gives the same rows."""
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    first = labels.orderBy(*order).limit(most)
    there = ids.join(F.broadcast(first.select("doc_id")), "doc_id", "left_semi").distinct()
    if there.count() < first.count():
        first = labels.join(ids, "doc_id", "left_semi").orderBy(*order).limit(most)
    return first
