"""Source corpora: licenses, ingestion, deduplication, the stored index."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkglass.functions import arrow
from inkglass.functions import text as T

# License names and the flags of each kind.
OPEN = ["CC-BY", "CC-BY-SA", "CC-BY-NC", "CC-BY-NC-SA", "CC0", "public_domain"]
TRAINING = ["CC-BY", "CC0", "public_domain"]
COMMERCIAL = ["CC-BY", "CC-BY-SA", "CC-BY-ND", "CC0", "public_domain"]
ALIASES = {
    "cc by": "CC-BY", "cc0": "CC0", "cc0-1.0": "CC0", "public domain": "public_domain", "pd": "public_domain", "open access": "open_access", "oa": "open_access",
    "proprietary": "proprietary", "all rights reserved": "proprietary",
}
ELEMENTS = ["CC-BY", "CC-BY-SA", "CC-BY-NC", "CC-BY-NC-SA", "CC-BY-ND", "CC-BY-NC-ND"]
LEAST_ENTRY = 10
VERSION = "1"


def alias_table(spark: SparkSession) -> DataFrame:
    rows = {**ALIASES, **{e.lower(): e for e in ELEMENTS}, **{f"{e.lower()}-4.0": e for e in ELEMENTS}}
    return spark.createDataFrame(sorted(rows.items()), "alias string, license string")


def with_license(df: DataFrame, column: str = "license_text") -> DataFrame:
    """``license`` and three permission flags; what isn't known is not allowed."""
    key = F.replace(F.lower(F.trim(column)), F.lit("_"), F.lit("-"))
    out = df.withColumn("_alias", key).join(F.broadcast(alias_table(df.sparkSession)), F.col("_alias") == F.col("alias"), "left").drop("_alias", "alias")
    out = out.withColumn("license", F.coalesce("license", F.lit("unknown")))
    return out.withColumns({"similarity_index_allowed": F.col("license").isin(OPEN), "training_use_allowed": F.col("license").isin(TRAINING), "commercial_use_allowed": F.col("license").isin(COMMERCIAL)})


def cursor(length: Column, keys: list[str], order: list[str]) -> Column:
    """Characters before each row of its group."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(length).over(w), F.lit(0)).cast("long")


def ingest(sources: DataFrame) -> DataFrame:
    """Entries of (doc_id, text, license_text): sentences of allowed sources,
    normalised, those under ten characters dropped, each with its place. The
    licence filter stands before the splitting."""
    rows = with_license(sources).where("similarity_index_allowed")
    rows = rows.select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("paragraph_index", "paragraph"))
    rows = rows.select("doc_id", "paragraph_index", F.posexplode(arrow.sentences(F.col("paragraph"))).alias("sentence_index", "s"))
    rows = rows.withColumn("char_offset", cursor(F.length("s.text"), ["doc_id"], ["paragraph_index", "sentence_index"])).withColumn("normalized_text", T.normalize_corpus(F.col("s.text")))
    rows = rows.where(F.length("normalized_text") >= LEAST_ENTRY)
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("paragraph_index", "sentence_index")) - 1
    return rows.select("doc_id", index.cast("long").alias("entry_index"), F.col("s.text").alias("text"), "normalized_text", "char_offset", F.sha2("normalized_text", 256).alias("hash"))


def dedup_first(entries: DataFrame, within: list[str] | None = None) -> DataFrame:
    """The first entry of each text, over all documents or within ``within``.
    Tasks keep a text's first entry before the one shuffle."""
    w = Window.partitionBy(*(within or []), "hash").orderBy("doc_id", "entry_index")
    return entries.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def duplicate_groups(entries: DataFrame) -> DataFrame:
    return entries.groupBy("hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


def save_index(entries: DataFrame, path: str, mode: str = "md5") -> dict:
    """Writes entries, fingerprints and term weights under a new version of
    ``path``, counts them, and only then adds a manifest that names it. Earlier
    manifests stay, so there is a whole index at every moment."""
    import uuid

    from inkglass.operators.retrieval import tfidf

    spark = entries.sparkSession
    version = uuid.uuid4().hex
    at = f"{path}/{version}"
    entries = entries.withColumn("entry_id", F.concat_ws("#", F.col("doc_id").cast("string"), F.col("entry_index").cast("string")))
    entries.write.parquet(f"{at}/entries")
    kept = spark.read.parquet(f"{at}/entries")
    arrow.with_points(kept, "normalized_text", mode, ["entry_id"]).select("entry_id", F.explode("points").alias("p")).select("entry_id", "p.*").write.parquet(f"{at}/fingerprints")
    weights, idf = tfidf(kept, "entry_id", "normalized_text")
    idf.write.parquet(f"{at}/idf")
    weights.write.parquet(f"{at}/weights")
    counts = {k: spark.read.parquet(f"{at}/{k}").count() for k in ("entries", "fingerprints", "idf", "weights")}
    number = 1 + max((m["number"] for m in _manifests(spark, path)), default=0)
    manifest = {"number": number, "schema": VERSION, "version": version, "hash": mode, "k": arrow.K, "window": arrow.WINDOW, "counts": counts}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "manifest string").coalesce(1).write.mode("append").json(f"{path}/manifest")
    return manifest


def _manifests(spark: SparkSession, path: str) -> list[dict]:
    try:
        rows = spark.read.schema("manifest string").json(f"{path}/manifest").collect()
    except AnalysisException:  # there is none yet
        return []
    return sorted((json.loads(r[0]) for r in rows), key=lambda m: -m["number"])


def _whole(spark: SparkSession, path: str, manifest: dict) -> dict[str, DataFrame]:
    """The tables that a manifest names; an error if they aren't as it says."""
    if manifest["schema"] != VERSION:
        raise ValueError(f"index schema {manifest['schema']} is not {VERSION}")
    tables = {k: spark.read.parquet(f"{path}/{manifest['version']}/{k}") for k in manifest["counts"]}
    for k, n in manifest["counts"].items():
        if tables[k].count() != n:
            raise ValueError(f"{k} has not the {n} rows of the manifest")
    return tables


def load_index(spark: SparkSession, path: str, recover: bool = False) -> dict[str, DataFrame]:
    """The tables of the current version; an error if it isn't whole. With
    ``recover`` the latest version that is whole."""
    error: Exception = ValueError(f"no index at {path}")
    for manifest in _manifests(spark, path):
        try:
            return _whole(spark, path, manifest)
        except (ValueError, AnalysisException) as e:
            error = e
            if not recover:
                break
    raise error
