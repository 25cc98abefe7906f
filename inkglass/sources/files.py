"""Documents from files: text, Markdown, .docx, web pages, annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkglass.functions import arrow
from inkglass.functions import text as T

SUFFIXES = (".md", ".txt", ".docx")
PRIVATE = "^(?:localhost|127\\.|10\\.|192\\.168\\.|169\\.254\\.|172\\.(?:1[6-9]|2\\d|3[01])\\.|0\\.|\\[?::1)"


def read_paragraphs(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, paragraph_index, text) of the .md, .txt and .docx files under a
    path; one file of another kind is an error, others in a folder are passed."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if "." in name and not name.lower().endswith(SUFFIXES) and "*" not in name:
        raise ValueError(f"unsupported file type: {name}; supported: {', '.join(SUFFIXES)}")

    def read(kinds: str) -> DataFrame:
        return spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", kinds).load(path).select("path", "content")

    plain = read("*.{md,txt,MD,TXT}").select("path", T.paragraphs(F.decode("content", "UTF-8")).alias("p"))
    word = read("*.{docx,DOCX}").select("path", arrow.docx_paragraphs(F.col("content")).alias("p"))
    return plain.unionByName(word).select("path", F.posexplode("p").alias("paragraph_index", "text"))


def unique_paths(paths: DataFrame, most: int | None = None) -> DataFrame:
    """(path, position): each path once, in its first place, up to ``most``."""
    out = paths.groupBy("path").agg(F.min("position").alias("position")).orderBy("position")
    return out.limit(most) if most is not None else out


def allowed_url(url: Column) -> Column:
    """Web addresses with a host that is not private."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https") & (host != "") & ~host.rlike(PRIVATE), F.lit(False))


def page_sources(pages: DataFrame) -> DataFrame:
    """(source_id, url, text, sha256) of (page_id, url, html)."""
    text = T.strip_html(F.col("html"))
    return pages.where(allowed_url(F.col("url"))).select(F.concat(F.lit("url-"), "page_id").alias("source_id"), "url", text.alias("text"), F.sha2(text, 256).alias("sha256"))


def pan_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Truth passages of <document reference=...><feature .../></document> files."""
    attributes = ["name", "obfuscation", "this_offset", "this_length", "source_reference", "source_offset", "source_length"]
    schema = "_reference string, feature array<struct<" + ", ".join(f"_{a}:string" for a in attributes) + ">>"
    rows = spark.read.format("xml").option("rowTag", "document").schema(schema).load(path)
    f = rows.select(F.col("_reference").alias("suspicious_document"), F.explode("feature").alias("f")).where("f._source_reference is not null and f._this_offset is not null")

    def number(c: str) -> Column:
        return F.coalesce(F.col(f"f._{c}").cast("long"), F.lit(0))

    return f.select(
        "suspicious_document", number("this_offset").alias("suspicious_offset"), number("this_length").alias("suspicious_length"), F.col("f._source_reference").alias("source_document"),
        number("source_offset").alias("source_offset"), number("source_length").alias("source_length"), F.col("f._name").alias("plagiarism_type"), F.col("f._obfuscation").alias("obfuscation_type"),
    )


def sts_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, score) from a CSV with a header."""
    return spark.read.csv(path, header=True, schema="a string, b string, score double", multiLine=True, escape='"')


def triplets(spark: SparkSession, path: str) -> DataFrame:
    """(id, original, paraphrase, label) from files <id>-original.txt and so on."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), "/([^/]+)-(?:original|paraphrase|metadata)\\.txt$", 1).alias("id"), F.regexp_extract(F.input_file_name(), "-(original|paraphrase|metadata)\\.txt$", 1).alias("part"), F.col("value"))
    by = files.where("part <> ''").groupBy("id").pivot("part", ["original", "paraphrase", "metadata"]).agg(F.first("value"))
    return by.select("id", "original", "paraphrase", F.lower(F.regexp_extract("metadata", "(?i)Paraphrase:\\s*(\\w+)", 1)).alias("label"))
