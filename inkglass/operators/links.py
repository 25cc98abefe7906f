"""Links between sentences, citations, sources, claims and rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkglass.functions import text as T

# Statuses that let a reference support a claim, and why others don't.
RESOLVED = ["verified", "partially_verified"]
REASONS = {
    "provider_error": "lookup failed", "not_found": "no record found", "metadata_mismatch": "record does not match", "unresolved": "reference is unresolved",
}
WEAK = 60


def citations_in_sentences(sentences: DataFrame, citations: DataFrame) -> DataFrame:
    """Citations (doc_id, paragraph_index, citation_id, char_offset) with the
    sentence (.., sentence_index, start, end) they start in: equal paragraph
    first, then the place. Spans may overlap here; of a parse they don't, and
    ``intervals.locate`` finds them by a sweep."""
    rows = sentences.join(citations, ["doc_id", "paragraph_index"]).where("start <= char_offset AND char_offset < end")
    return rows.select("doc_id", "paragraph_index", "sentence_index", "citation_id")


def quote_coverage(matched: DataFrame, quotes: DataFrame) -> DataFrame:
    """(id, coverage): share of matched characters that are quoted, over
    disjoint (id, start, end) on both sides; 0 without matched characters."""
    q = quotes.select("id", F.col("start").alias("qs"), F.col("end").alias("qe"))
    part = matched.join(q, "id").groupBy("id").agg(F.sum(F.greatest(F.lit(0), F.least("end", "qe") - F.greatest("start", "qs"))).alias("quoted"))
    whole = matched.groupBy("id").agg(F.sum(F.col("end") - F.col("start")).alias("n"))
    return whole.join(part, "id", "left").select("id", F.when(F.col("n") > 0, F.coalesce("quoted", F.lit(0)) / F.nullif("n", F.lit(0))).otherwise(0.0).alias("coverage"))


def author_tokens(c: Column) -> Column:
    return F.filter(T.tokens_by_space(F.translate(F.lower(F.coalesce(c, F.lit(""))), "&,", "  ")), lambda t: (F.length(t) > 2) & (t != "et"))


def loose_links(citations: DataFrame, entries: DataFrame) -> DataFrame:
    """(doc_id, citation_id, entry_index): the first entry of equal DOI, equal
    number, or equal year and a shared author token."""
    c, e = citations.alias("c"), entries.alias("e")
    doi = F.coalesce(F.lower("c.doi") == F.lower("e.doi"), F.lit(False)) & (F.coalesce("c.doi", F.lit("")) != "")
    number = F.coalesce(F.col("c.numbered_ref") == F.col("e.numbered_ref"), F.lit(False))
    name = F.coalesce(F.col("c.year") == F.col("e.year"), F.lit(False)) & F.arrays_overlap(author_tokens(F.col("c.authors")), author_tokens(F.col("e.authors")))
    rows = c.join(e, F.col("c.doc_id") == F.col("e.doc_id")).where(doi | number | name)
    return rows.groupBy(F.col("c.doc_id").alias("doc_id"), F.col("c.citation_id").alias("citation_id")).agg(F.min("e.entry_index").alias("entry_index"))


def sentences_citing(sentences: DataFrame, cited: DataFrame, sources: DataFrame) -> DataFrame:
    """Sentences with a citation of the source itself: a semi-join on surname
    and year, or DOI, where a null year of the source matches any."""
    hits = cited.withColumn("tokens", author_tokens(F.col("authors"))).alias("c").join(
        sources.withColumn("tokens", author_tokens(F.col("authors"))).alias("o"), F.col("c.source_id") == F.col("o.source_id")
    )
    hits = hits.where(F.expr("(c.doi = o.doi) OR (arrays_overlap(c.tokens, o.tokens) AND (o.year IS NULL OR c.year <=> o.year))")).select("c.sentence_id", "c.source_id")
    return sentences.join(hits, ["sentence_id", "source_id"], "left_semi")


def cited_claims(claims: DataFrame, links: DataFrame, verified: DataFrame) -> DataFrame:
    """(claim_id, citation_id, status, usable, reason) over (claim_id,
    citation_id), (citation_id, entry_index) and (entry_index, status)."""
    rows = claims.join(links, "citation_id", "left").join(verified, "entry_index", "left")
    reason = F.when(F.col("entry_index").isNull(), "not in the bibliography").when(F.col("status").isNull(), "not verified")
    for k, v in REASONS.items():
        reason = reason.when(F.col("status") == k, v)
    usable = F.coalesce(F.col("status").isin(RESOLVED), F.lit(False))
    return rows.select("claim_id", "citation_id", "status", usable.alias("usable"), F.when(~usable, F.coalesce(reason, F.lit("unavailable"))).alias("reason"))


def suggestions(scored: DataFrame, threshold: int = WEAK) -> DataFrame:
    """Candidates at the threshold and above, in the order they were found, of
    (claim_id, arrival, confidence); the first is the best."""
    w = Window.partitionBy("claim_id").orderBy("arrival")
    rows = scored.where(F.coalesce("confidence", F.lit(0)) >= threshold).withColumn("position", F.row_number().over(w).cast("long"))
    return rows.withColumn("best", F.col("position") == 1)


def best_source(assessed: DataFrame) -> DataFrame:
    """The assessed source of highest confidence; the first of equals."""
    w = Window.partitionBy("claim_id").orderBy(F.coalesce("confidence", F.lit(0)).desc(), "position")
    return assessed.where("evaluated").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def diagnostics(calls: DataFrame) -> DataFrame:
    """(phase, calls, providers, errors, failed) over (phase, provider, ok, error)."""
    out = calls.groupBy("phase").agg(
        F.count("*").alias("calls"), F.array_join(F.array_sort(F.collect_set("provider")), ",").alias("providers"), F.array_join(F.array_sort(F.collect_set("error")), ";").alias("errors"),
        F.count(F.when(~F.col("ok"), 1)).alias("failed"),
    )
    return out.withColumn("phase_failed", F.col("failed") == F.col("calls"))


def call_health(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Success rate and mean latency of successful calls."""
    return calls.groupBy(*keys).agg(F.count("*").alias("calls"), F.avg(F.when(F.col("ok"), 1.0).otherwise(0.0)).alias("success_rate"), F.avg(F.when(F.col("ok"), F.col("latency"))).alias("latency"))


def ground(passages: DataFrame, claims: DataFrame) -> DataFrame:
    """(passage_id, claim_id or null): the one claim that a passage contains, or
    that contains it, normalised; none or several leave it to a person."""
    p, c = passages.withColumn("pn", T.normalize_sentence(F.col("text"))), claims.withColumn("cn", T.normalize_sentence(F.col("claim")))
    hits = p.join(c, "doc_id").where(F.contains("pn", "cn") | F.contains("cn", "pn"))
    one = hits.groupBy("passage_id").agg(F.count("*").alias("n"), F.min("claim_id").alias("claim_id")).where("n = 1")
    return passages.join(one, "passage_id", "left").select("passage_id", "claim_id")


def back_map(claims: DataFrame, sentences: DataFrame, least: float = 0.3) -> DataFrame:
    """(claim_id, sentence_index): the sentence that shares most of a claim's
    words, the first of equals, at ``least`` of them."""
    a = F.array_distinct(T.ascii_tokens(F.col("claim")))
    rows = claims.join(sentences, "doc_id").withColumn("share", F.size(F.array_intersect(a, F.array_distinct(T.ascii_tokens(F.col("sentence"))))) / F.greatest(F.size(a), F.lit(1)))
    w = Window.partitionBy("claim_id").orderBy(F.col("share").desc(), "sentence_index")
    return rows.where(F.col("share") >= least).withColumn("_n", F.row_number().over(w)).where("_n = 1").select("claim_id", "sentence_index")


def invented(rewrite: Column, context: Column) -> Column:
    """DOIs, links and citation years of a rewrite that its context lacks."""
    out = []
    for p in (T.DOI, "https?://[^\\s)\\]>]+", "\\b(?:19|20)\\d{2}\\b"):
        out.append(F.array_except(F.regexp_extract_all(F.lower(rewrite), F.lit(p), F.lit(0)), F.regexp_extract_all(F.lower(context), F.lit(p), F.lit(0))))
    return F.array_sort(F.array_distinct(F.flatten(F.array(*out))))


def context(evidence: DataFrame, k: int = 3) -> DataFrame:
    """(claim_id, context): up to k distinct passages of usable evidence, in order."""
    rows = evidence.where(F.col("verdict").isin("supported", "partially_supported")).groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("rank", "sentence"))).alias("e"))
    return rows.select("claim_id", F.array_join(F.slice(F.array_distinct(F.transform("e", lambda x: x["sentence"])), 1, k), "\n").alias("context"))
