"""Candidate records from landed provider payloads, (query_id, payload) each.

Nothing here goes to the network: responses are landed as JSON or XML text and
read with a schema, so a scan parses only the fields it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkglass.functions import text as T

DATES = ["published-print", "published-online", "issued", "created"]
_PARTS = "struct<`date-parts`:array<array<int>>>"
CROSSREF = "struct<title:array<string>,author:array<struct<given:string,family:string>>,`container-title`:array<string>,DOI:string,URL:string,abstract:string," + ",".join(f"`{d}`:{_PARTS}" for d in DATES) + ">"
OPENALEX = (
    "id string, results array<struct<id:string,title:string,doi:string,type:string,publication_year:int,biblio:struct<year:string>,"
    "authorships:array<struct<author:struct<display_name:string>>>,primary_location:struct<source:struct<display_name:string,publication_year:int>>,abstract_inverted_index:map<string,array<int>>>>"
)
SEMANTIC_SCHOLAR = "data array<struct<title:string,year:int,venue:string,url:string,abstract:string,externalIds:struct<DOI:string,ArXiv:string>,authors:array<struct<name:string>>>>"
COLUMNS = ["query_id", "arrival", "title", "authors", "year", "venue", "doi", "arxiv_id", "url", "abstract", "work_type", "source_api"]


def _blank(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _out(rows: DataFrame, api: str, **columns: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    cols = {"arxiv_id": none, "work_type": none, "venue": none} | columns
    out = rows.select("query_id", F.col("pos").cast("long").alias("arrival"), *(cols[c].alias(c) for c in COLUMNS[2:-1]), F.lit(api).alias("source_api"))
    return out.withColumn("year", F.col("year").cast("long")).where("title is not null")


def crossref(payloads: DataFrame) -> DataFrame:
    """Of a search, or of one work; print before online before issued before created."""
    items = F.from_json("payload", f"message struct<items:array<{CROSSREF}>>")["message"]["items"]
    one = F.array(F.from_json("payload", f"message {CROSSREF}")["message"])
    rows = payloads.select("query_id", F.posexplode(F.coalesce(items, one)).alias("pos", "i"))
    year = F.coalesce(*(F.get(F.get(F.col("i")[d]["date-parts"], F.lit(0)), F.lit(0)) for d in DATES))
    names = F.filter(F.transform("i.author", lambda a: F.concat_ws(" ", _blank(a["given"]), _blank(a["family"]))), lambda n: n != "")
    return _out(
        rows, "crossref", title=_blank(F.get("i.title", F.lit(0))), authors=F.coalesce(names, F.array().cast("array<string>")), year=year, venue=F.get(F.col("i")["container-title"], F.lit(0)),
        doi=_blank(F.col("i.DOI")), url=_blank(F.col("i.URL")), abstract=_blank(F.regexp_replace("i.abstract", "<[^>]+>", " ")),
    )


def openalex(payloads: DataFrame) -> DataFrame:
    """Abstracts are put together from their inverted index."""
    rows = payloads.select("query_id", F.posexplode(F.from_json("payload", OPENALEX)["results"]).alias("pos", "i"))

    def year(c: Column) -> Column:
        return F.when(c.cast("int").between(1000, 9999), c.cast("int"))

    words = F.array_sort(F.flatten(F.transform(F.map_entries("i.abstract_inverted_index"), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w"))))))
    names = F.filter(F.transform("i.authorships", lambda a: F.trim(a["author"]["display_name"])), lambda n: F.coalesce(n, F.lit("")) != "")
    doi = F.regexp_replace(F.trim("i.doi"), "^https://doi\\.org/", "")
    return _out(
        rows, "openalex", title=_blank(F.col("i.title")), authors=F.coalesce(names, F.array().cast("array<string>")),
        year=F.coalesce(year(F.col("i.publication_year")), year(F.col("i.biblio.year")), year(F.col("i.primary_location.source.publication_year"))),
        venue=_blank(F.col("i.primary_location.source.display_name")), doi=F.when(doi.rlike(T.DOI), doi), url=F.col("i.id"), abstract=_blank(F.array_join(F.transform(words, lambda x: x["w"]), " ")), work_type=F.col("i.type"),
    )


def semantic_scholar(payloads: DataFrame) -> DataFrame:
    rows = payloads.select("query_id", F.posexplode(F.from_json("payload", SEMANTIC_SCHOLAR)["data"]).alias("pos", "i"))
    names = F.filter(F.transform("i.authors", lambda a: a["name"]), lambda n: n.isNotNull())
    return _out(
        rows, "semantic_scholar", title=_blank(F.col("i.title")), authors=F.coalesce(names, F.array().cast("array<string>")), year=F.col("i.year"), venue=_blank(F.col("i.venue")),
        doi=F.col("i.externalIds.DOI"), arxiv_id=F.col("i.externalIds.ArXiv"), url=_blank(F.col("i.url")), abstract=_blank(F.col("i.abstract")),
    )


def arxiv(payloads: DataFrame) -> DataFrame:
    """Of Atom feeds."""
    schema = "entry array<struct<id:string,title:string,summary:string,published:string,author:array<struct<name:string>>,`arxiv:doi`:string,`arxiv:journal_ref`:string>>"
    rows = payloads.select("query_id", F.posexplode(F.from_xml("payload", schema)["entry"]).alias("pos", "i"))
    year = F.regexp_extract("i.published", "^(\\d{4})", 1)
    return _out(
        rows, "arxiv", title=_blank(T.collapse(F.col("i.title"))), authors=F.coalesce(F.filter(F.transform("i.author", lambda a: F.trim(a["name"])), lambda n: n != ""), F.array().cast("array<string>")),
        year=F.nullif(year, F.lit("")).cast("int"), venue=_blank(F.col("i")["arxiv:journal_ref"]), doi=_blank(F.col("i")["arxiv:doi"]), arxiv_id=F.regexp_extract(F.rtrim(F.col("i.id")), "([^/]+)/?$", 1),
        url=F.col("i.id"), abstract=_blank(T.collapse(F.col("i.summary"))),
    )


def cached(queries: DataFrame, cache: DataFrame) -> DataFrame:
    """(query_id, payload or null): landed responses by the hash of the request;
    a payload that is no JSON object counts as missing."""
    key = F.sha2(F.to_json(F.struct("provider", "query", "rows")), 256)
    rows = queries.withColumn("key", key).join(cache.select("key", F.col("payload")), "key", "left")
    return rows.withColumn("payload", F.when(F.json_object_keys("payload").isNotNull(), F.col("payload")))
