"""Exact deduplication by content-defined chunk recipes, in Spark SQL alone.

Texts are normalised and cut where their content says so: a chunk ends after
one of a few two-character sequences, at MIN_CHUNK characters or more, or at
MAX_CHUNK. An edit moves the cuts near it only, so equal passages of different
documents give equal chunks. A chunk is named by its 64-bit hash. Chunks move
once, deduplicated in each task before the shuffle, to verify the names: where
one hash stands for several texts these get numbers, and documents that hold
them are told apart by those. From there on a document is its ordered list of
names, eight bytes a chunk; lists are compared whole and texts never move again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkglass.session import scratch_dir, stored

MIN_CHUNK, MAX_CHUNK = 256, 4096
#: A chunk may end after these; about one place in a hundred in European prose.
CUT = "(?:[.!?]\\p{Lu}|[aeo]nd|qu|sch)"
CHUNK = f"(?s).{{{MIN_CHUNK},{MAX_CHUNK - 3}}}?{CUT}|.{{1,{MAX_CHUNK}}}"
#: Deleted before texts are compared.
SPACE = "[\\x20\\x09-\\x0D]+"


def chunked(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, norm, chunks): null texts count as empty, which have
    no chunks."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text).cast("long").alias("n_chars"), F.regexp_replace(text, SPACE, "").alias("norm"))
    return docs.withColumn("chunks", F.regexp_extract_all("norm", F.lit(CHUNK), F.lit(0)))


def collisions(docs: DataFrame, name=F.xxhash64) -> DataFrame:
    """(h, chunk, number): the texts of every name that stands for several,
    numbered from 0 in the order of the texts."""
    each = chunked(docs).select(F.explode("chunks").alias("chunk")).select(name("chunk").alias("h"), "chunk").distinct()
    shared = each.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    return each.join(shared, "h").withColumn("number", F.row_number().over(Window.partitionBy("h").orderBy("chunk")) - 1)


def recipes(docs: DataFrame, name=F.xxhash64, collided: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_chars, text_sha256, recipe): recipe is the ordered list of
    chunk names with their numbers, empty for texts without characters."""
    base = chunked(docs)
    out = base.select("doc_id", "n_chars", F.sha2("norm", 256).alias("text_sha256"), F.transform("chunks", lambda c: name(c)).alias("recipe"))
    if collided is None:
        return out
    hits = base.select(F.sha2("norm", 256).alias("text_sha256"), F.posexplode("chunks").alias("pos", "chunk")).withColumn("h", name("chunk"))
    hits = hits.join(collided.where("number > 0"), ["h", "chunk"])
    numbers = hits.groupBy("text_sha256").agg(F.sort_array(F.collect_set(F.struct("pos", "number"))).alias("numbers"))
    out = out.join(numbers, "text_sha256", "left")
    more = F.coalesce(F.flatten(F.transform("numbers", lambda x: F.array(x["pos"].cast("long"), x["number"].cast("long")))), F.array().cast("array<bigint>"))
    return out.select("doc_id", "n_chars", "text_sha256", F.concat("recipe", F.lit([-1]).cast("array<bigint>"), more).alias("recipe"))


def exact_duplicates(docs: DataFrame, name=F.xxhash64) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row per document.

    Texts are equal when the same after deleting ASCII white space; null counts
    as empty, and all empty texts are equal. Of a group the longest original
    stays, then the smallest doc_id; a null doc_id comes last. Repeated rows of
    one doc_id are one group, and each has the flag of its doc_id.
    """
    where = scratch_dir(docs.sparkSession)
    collided = stored(collisions(docs, name), where, "collided")
    rec = stored(recipes(docs, name, None if collided.isEmpty() else collided), where, "recipes")
    groups = rec.groupBy("recipe").agg(
        F.count("*").alias("group_size"), F.min(F.struct((-F.col("n_chars")).alias("o"), F.col("doc_id").isNull().alias("z"), "doc_id")).alias("best")
    )
    several = groups.where("group_size > 1").select("recipe", "group_size", F.col("best.doc_id").alias("keep_id"))
    out = rec.join(several, "recipe", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


ORACLE = """
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS len, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS t FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY t ORDER BY len DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY t ORDER BY len DESC, doc_id) AS kept,
       sha256(t) AS text_sha256
FROM n
"""
