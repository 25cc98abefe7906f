"""Queries over links between sentences, citations, sources and rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkglass.functions import text as T
from inkglass.operators import audit, links, support
from inkglass.plans.decision_queries import _CITES, _ENTRIES
from inkglass.plans.registry import Derived, Fixture, query
from inkglass.plans.text_queries import _HTML, sql_collapse, sql_sentence, sql_sentences, sql_tokens
from inkglass.session import table


@query(
    """WITH s AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber % 2 AS BIGINT) AS paragraph_index, CAST(l_linenumber AS BIGINT) AS sentence_index, CAST(l_linenumber * 10 AS BIGINT) AS a, CAST(l_linenumber * 10 + l_quantity AS BIGINT) AS b FROM lineitem),
       c AS (SELECT o_orderkey AS doc_id, CAST(o_custkey % 2 AS BIGINT) AS paragraph_index, o_custkey AS citation_id, CAST(o_custkey % 70 AS BIGINT) AS o FROM orders)
       SELECT doc_id, paragraph_index, sentence_index, citation_id FROM s JOIN c USING (doc_id, paragraph_index) WHERE a <= o AND o < b"""
)
def citations_in_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of an order stand for sentences, the order's customer for a citation."""
    n = F.col("l_linenumber").cast("long")
    s = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (n % 2).alias("paragraph_index"), n.alias("sentence_index"), (n * 10).alias("start"), (n * 10 + F.col("l_quantity")).cast("long").alias("end"))
    c = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") % 2).alias("paragraph_index"), F.col("o_custkey").alias("citation_id"), (F.col("o_custkey") % 70).alias("char_offset"))
    return links.citations_in_sentences(s, c)


@query(
    """WITH m AS (SELECT DISTINCT CAST(user_id AS BIGINT) AS id, CAST(event_id % 40 * 10 AS BIGINT) AS s, CAST(event_id % 40 * 10 + 1 + event_id % 9 AS BIGINT) AS e FROM events), d AS (SELECT id, s, max(e) AS e FROM m GROUP BY id, s),
       q AS (SELECT DISTINCT CAST(user_id AS BIGINT) AS id, CAST(event_id % 20 * 20 + 3 AS BIGINT) AS qs, CAST(event_id % 20 * 20 + 15 AS BIGINT) AS qe FROM events),
       p AS (SELECT id, sum(greatest(0, least(e, qe) - greatest(s, qs))) AS quoted FROM d JOIN q USING (id) GROUP BY id)
       SELECT id, round(coalesce(quoted, 0) / n, 6) AS coverage FROM (SELECT id, sum(e - s) AS n FROM d GROUP BY id) LEFT JOIN p USING (id)"""
)
def quote_coverage(spark: SparkSession, sf: str) -> DataFrame:
    e, ev = F.col("event_id"), table(spark, sf, "events")
    m = ev.select(F.col("user_id").alias("id"), (e % 40 * 10).alias("start"), (e % 40 * 10 + 1 + e % 9).alias("end")).groupBy("id", "start").agg(F.max("end").alias("end"))
    q = ev.select(F.col("user_id").alias("id"), (e % 20 * 20 + 3).alias("start"), (e % 20 * 20 + 15).alias("end")).distinct()
    return links.quote_coverage(m, q).withColumn("coverage", F.round("coverage", 6))


_TOK = "list_filter(string_split(trim(regexp_replace(translate(lower(coalesce({c}, '')), '&,', '  '), '\\s+', ' ', 'g')), ' '), lambda t: length(t) > 2 AND t <> 'et')"


@query(
    f"""SELECT c.doc_id, c.citation_id, min(e.entry_index) AS entry_index FROM {_CITES.sql} c JOIN {_ENTRIES.sql} e ON c.doc_id = e.doc_id
        WHERE (c.doi <> '' AND lower(c.doi) = lower(e.doi)) OR c.numbered_ref = e.numbered_ref OR (c.year = e.year AND len(list_intersect({_TOK.format(c="c.authors")}, {_TOK.format(c="e.authors")})) > 0) GROUP BY c.doc_id, c.citation_id"""
)
def citation_loose_link(spark: SparkSession, sf: str) -> DataFrame:
    return links.loose_links(_CITES.frame(spark, sf), _ENTRIES.frame(spark, sf))


_CLAIM_CITES = Derived("claim_id long, citation_id long", [(1, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (5, 1)],
    "lineitem",
    "1000 + l_orderkey * 8 + l_linenumber",
    "1000 + l_orderkey",
)
_CITE_ENTRIES = Derived("citation_id long, entry_index long", [(1, 0), (2, 1), (3, 2), (4, 3), (6, 5)],
    "orders",
    "CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE 1000 + o_orderkey END",
    "1000 + o_custkey",
)
_STATUSES = Derived("entry_index long, status string", [(0, "verified"), (1, "partially_verified"), (2, "metadata_mismatch"), (3, "provider_error")],
    "customer",
    "CASE WHEN c_nationkey % 6 = 0 THEN NULL ELSE 1000 + c_custkey END",
    "CASE c_nationkey % 7 WHEN 0 THEN 'verified' WHEN 1 THEN 'partially_verified' WHEN 2 THEN 'not_found' WHEN 3 THEN 'metadata_mismatch' WHEN 4 THEN 'provider_error' WHEN 5 THEN 'unresolved' END",
)


@query(
    f"""SELECT claim_id, citation_id, status, coalesce(status IN ('verified', 'partially_verified'), FALSE) AS usable, CASE WHEN coalesce(status IN ('verified', 'partially_verified'), FALSE) THEN NULL WHEN entry_index IS NULL THEN 'not in the bibliography' WHEN status IS NULL THEN 'not verified'
          WHEN status = 'provider_error' THEN 'lookup failed' WHEN status = 'not_found' THEN 'no record found' WHEN status = 'metadata_mismatch' THEN 'record does not match' WHEN status = 'unresolved' THEN 'reference is unresolved' ELSE 'unavailable' END AS reason
        FROM {_CLAIM_CITES.sql} LEFT JOIN {_CITE_ENTRIES.sql} USING (citation_id) LEFT JOIN {_STATUSES.sql} USING (entry_index)"""
)
def cited_claims(spark: SparkSession, sf: str) -> DataFrame:
    return links.cited_claims(_CLAIM_CITES.frame(spark, sf), _CITE_ENTRIES.frame(spark, sf), _STATUSES.frame(spark, sf))


@query(
    """WITH s AS (SELECT l_orderkey AS claim_id, l_linenumber AS arrival, CAST(max(l_quantity) * 2 AS BIGINT) AS confidence FROM lineitem GROUP BY l_orderkey, l_linenumber)
       SELECT claim_id, arrival, confidence, row_number() OVER (PARTITION BY claim_id ORDER BY arrival) AS position, row_number() OVER (PARTITION BY claim_id ORDER BY arrival) = 1 AS best FROM s WHERE confidence >= 60"""
)
def suggestion_threshold(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("claim_id"), F.col("l_linenumber").alias("arrival")).agg((F.max("l_quantity") * 2).cast("long").alias("confidence"))
    return links.suggestions(rows)


@query(
    """SELECT claim_id, position, confidence FROM (SELECT l_orderkey AS claim_id, l_linenumber AS position, CAST(l_quantity AS BIGINT) AS confidence, row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(l_quantity AS BIGINT) DESC, l_linenumber) AS n FROM lineitem WHERE l_returnflag <> 'R') WHERE n = 1"""
)
def best_assessed_source(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("claim_id"), F.col("l_linenumber").alias("position"), F.col("l_quantity").cast("long").alias("confidence"), (F.col("l_returnflag") != "R").alias("evaluated"))
    return links.best_source(rows).drop("evaluated")


@query(
    """SELECT event_type AS phase, count(*) AS calls, array_to_string(list(DISTINCT 'p' || (user_id % 4) ORDER BY 'p' || (user_id % 4)), ',') AS providers, coalesce(array_to_string(list(DISTINCT CASE WHEN value <= 10 THEN 'e' || (user_id % 3) END ORDER BY CASE WHEN value <= 10 THEN 'e' || (user_id % 3) END) FILTER (value <= 10), ';'), '') AS errors,
              count(*) FILTER (NOT value > 10) AS failed, count(*) FILTER (NOT value > 10) = count(*) AS phase_failed FROM events GROUP BY event_type"""
)
def diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    """Events stand for calls."""
    rows = table(spark, sf, "events").select(
        F.col("event_type").alias("phase"), F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string")).alias("provider"), (F.col("value") > 10).alias("ok"),
        F.when(F.col("value") <= 10, F.concat(F.lit("e"), (F.col("user_id") % 3).cast("string"))).alias("error"),
    )
    return links.diagnostics(rows)


@query(
    "SELECT user_id, count(*) AS calls, round(avg(CASE WHEN value > 20 THEN 1.0::DOUBLE ELSE 0 END), 6) AS success_rate, round(avg(value) FILTER (value > 20), 6) AS latency FROM events GROUP BY user_id"
)
def call_health(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", (F.col("value") > 20).alias("ok"), F.col("value").alias("latency"))
    return links.call_health(rows, ["user_id"]).select("user_id", "calls", F.round("success_rate", 6).alias("success_rate"), F.round("latency", 6).alias("latency"))


@query(
    f"""WITH p AS (SELECT item_id AS doc_id, {sql_sentences("text")} AS s, {sql_sentence("text")} AS whole FROM benchmark), c AS (SELECT doc_id, CAST(i AS BIGINT) AS claim_id, {sql_sentence("s[i + 1]")} AS cn FROM p, LATERAL (SELECT unnest(range(len(s))) AS i)),
        h AS (SELECT doc_id, count(*) AS n, min(claim_id) AS claim_id FROM p JOIN c USING (doc_id) WHERE contains(whole, cn) OR contains(cn, whole) GROUP BY doc_id)
        SELECT doc_id AS passage_id, CASE WHEN n = 1 THEN claim_id END AS claim_id FROM p LEFT JOIN h USING (doc_id)"""
)
def grounded_passages(spark: SparkSession, sf: str) -> DataFrame:
    """Passages of one sentence have their claim; others are left to a person."""
    b = table(spark, sf, "benchmark")
    claims = b.select(F.col("item_id").alias("doc_id"), F.posexplode(T.split_sentences(F.col("text"))).alias("claim_id", "claim")).withColumn("claim_id", F.col("claim_id").cast("long"))
    return links.ground(b.select(F.col("item_id").alias("doc_id"), F.col("item_id").alias("passage_id"), "text"), claims)


@query(
    f"""WITH p AS (SELECT item_id AS doc_id, {sql_sentences("text")} AS s FROM benchmark), r AS (SELECT doc_id, CAST(i AS BIGINT) AS sentence_index, s[i + 1] AS sentence, s[len(s)] AS claim FROM p, LATERAL (SELECT unnest(range(len(s))) AS i)),
        o AS (SELECT doc_id, sentence_index, len(list_intersect(list_distinct({sql_tokens("claim")}), list_distinct({sql_tokens("sentence")}))) / greatest(len(list_distinct({sql_tokens("claim")})), 1) AS share FROM r)
        SELECT doc_id AS claim_id, sentence_index FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY share DESC, sentence_index) AS n FROM o WHERE share >= 0.3) WHERE n = 1"""
)
def claim_back_map(spark: SparkSession, sf: str) -> DataFrame:
    """The last sentence of each passage, found again."""
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), T.split_sentences(F.col("text")).alias("s")).where(F.size("s") > 0)
    sentences = b.select("doc_id", F.posexplode("s").alias("sentence_index", "sentence")).withColumn("sentence_index", F.col("sentence_index").cast("long"))
    return links.back_map(b.select("doc_id", F.col("doc_id").alias("claim_id"), F.element_at("s", -1).alias("claim")), sentences)


_EVIDENCE = Fixture(
    "claim_id long, rank long, sentence string, verdict string",
    [(1, 1, "A in 2019.", "supported"), (1, 2, "B 10.1000/x", "partially_supported"), (1, 3, "A in 2019.", "supported"), (1, 4, "C", "supported"), (1, 5, "D", "supported"), (2, 1, "Z", "insufficient_information"), (3, 1, "Only https://a.org here", "supported")],
)
_WRITTEN = Fixture("claim_id long, rewrite string", [(1, "As in 2019 and 2020, see 10.1000/x and 10.1000/y"), (3, "See https://a.org and https://b.org")])


@query(
    f"""WITH d AS (SELECT claim_id, sentence, min(rank) AS rank FROM {_EVIDENCE.sql} WHERE verdict IN ('supported', 'partially_supported') GROUP BY claim_id, sentence),
        k AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY rank) AS n FROM d), c AS (SELECT claim_id, array_to_string(list(sentence ORDER BY rank), chr(10)) AS context FROM k WHERE n <= 3 GROUP BY claim_id),
        x AS (SELECT claim_id, context, list_distinct(list_concat(list_filter(regexp_extract_all(lower(rewrite), '\\b10\\.\\d{{4,9}}/[-._;()/:a-z0-9]+'), lambda t: NOT contains(lower(context), t)), list_concat(list_filter(regexp_extract_all(lower(rewrite), 'https?://[^\\s)\\]>]+'), lambda t: NOT contains(lower(context), t)),
              list_filter(regexp_extract_all(rewrite, '\\b(?:19|20)\\d{{2}}\\b'), lambda t: NOT contains(context, t))))) AS bad FROM c JOIN {_WRITTEN.sql} USING (claim_id))
        SELECT claim_id, context, array_to_string(list_sort(bad), ',') AS invented FROM x"""
)
def rewrite_context(spark: SparkSession, sf: str) -> DataFrame:
    rows = links.context(_EVIDENCE.frame(spark)).join(_WRITTEN.frame(spark), "claim_id")
    return rows.select("claim_id", "context", F.array_join(links.invented(F.col("rewrite"), F.col("context")), ",").alias("invented"))


_RUNS = Derived("id long, command string, phase_failed boolean, score long", [(1, "check", False, 80), (2, "check", False, 79), (3, "check", False, None), (4, "check", True, 95), (5, "suggest", False, None), (6, "verify", True, None)],
    "orders",
    "1000 + o_orderkey",
    "CASE WHEN o_custkey % 3 = 0 THEN 'report' ELSE 'check' END",
    "o_orderkey % 7 = 0",
    "CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_orderkey % 101 END",
)


@query(f"SELECT id, CAST(CASE WHEN phase_failed THEN 3 WHEN command <> 'check' THEN 0 WHEN score IS NULL OR score < 80 THEN 1 ELSE 0 END AS BIGINT) AS code FROM {_RUNS.sql}")
def exit_codes(spark: SparkSession, sf: str) -> DataFrame:
    return _RUNS.frame(spark, sf).select("id", audit.exit_code(F.col("command"), F.col("phase_failed"), F.col("score")).alias("code"))


@query()
def claim_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """The whole chain for a claim and its candidates: evidence, its wording's
    risk, verdict, support and confidence."""
    b = table(spark, sf, "benchmark")
    claims = b.select(F.col("item_id").alias("claim_id"), F.col("item_id").alias("query_id"), T.cap_words(F.col("text"), 12).alias("text"))
    found = support.evidence(claims, b.select(F.col("item_id").alias("query_id"), F.col("item_id").alias("cand_id"), F.col("text").alias("abstract")))
    best = found.where("rank = 1").join(claims, "claim_id")
    from inkglass.functions import claims as C

    rows = best.withColumn("r", C.contradiction_risk(F.col("text"), F.col("sentence"))).withColumn("metadata", support.metadata_match(T.search_query(F.col("text")), F.col("sentence")))
    rows = rows.withColumn("verdict", support.verdict(F.col("metadata"), F.col("score"), F.col("r.verdict"))).withColumn("support", support.support(F.col("score"), F.col("r.verdict"), F.col("r.confidence")))
    return rows.select("claim_id", "cand_id", "metadata", "verdict", "support", support.overall_confidence(F.col("metadata"), F.col("support"), F.lit(True)).alias("overall"))


@query(
    f"""SELECT 'local-' || item_id AS source_id, sha256(text) AS sha256, CAST(length(text) AS BIGINT) AS n_chars FROM benchmark
        UNION ALL SELECT 'url-' || page_id, sha256({sql_collapse(_HTML)}), CAST(length({sql_collapse(_HTML)}) AS BIGINT) FROM pages"""
)
def source_table(spark: SparkSession, sf: str) -> DataFrame:
    """Local passages and pages as one table of sources."""
    from inkglass.sources.files import page_sources

    local = table(spark, sf, "benchmark").select(F.concat(F.lit("local-"), "item_id").alias("source_id"), "text", F.sha2("text", 256).alias("sha256"))
    both = local.unionByName(page_sources(table(spark, sf, "pages")).drop("url"))
    return both.select("source_id", "sha256", F.length("text").cast("long").alias("n_chars"))


@query("SELECT p_type AS path, CAST(min(p_partkey) AS BIGINT) AS position FROM part GROUP BY p_type")
def unique_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Types of parts stand for paths; each keeps its first place."""
    from inkglass.sources.files import unique_paths as unique

    return unique(table(spark, sf, "part").select(F.col("p_type").alias("path"), F.col("p_partkey").alias("position")))


@query()
def candidate_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as candidate records for queries that are their neighbours' names."""
    from inkglass.operators import verification

    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("title"))
    q = p.select((F.floor(F.col("k") / 10)).alias("query_id"), F.col("title").alias("query")).groupBy("query_id").agg(F.min("query").alias("query"))
    rows = p.withColumn("query_id", F.floor(F.col("k") / 10)).join(q, "query_id")
    none = F.lit(None).cast("string")
    rows = rows.withColumns({"doi": none, "arxiv_id": none, "year": 2000 + F.col("k") % 20, "arrival": F.col("k"), "source_api": F.lit("crossref")})
    rows = rows.withColumn("relevance", verification.relevance(F.col("query"), F.col("title"), F.col("doi"), F.col("arxiv_id")))
    return verification.ranked(rows).select("query_id", "k", "relevance", "rank")


@query()
def review_reports(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON report a document with matches."""
    from inkglass.operators import review
    from inkglass.plans import overlap
    from inkglass.sources import sinks

    docs = table(spark, sf, "documents")
    found = overlap.review_matches(docs, table(spark, sf, "benchmark"))
    words, totals = review.covered_words(found), overlap.word_totals(docs)
    summary = review.coverage(words, totals).where("raw_percent > 0")
    shares = review.contributions(review.allocate_words(words, ["doc_id", "paragraph", "word"]), totals)
    matches = found.select("doc_id", "match_rank", "match_id", "source_id", "match_type", "paragraph", "sentence_index", "start", "end", "source_start", "source_end", "source_text", F.size("words").alias("words"), "quoted", "cited", "bibliography", "severity", "status", "explanation", "recommendation")
    return sinks.review_json(summary, matches, shares)
