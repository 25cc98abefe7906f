"""Queries over places in texts, references' records and the audit's sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkglass.functions import text as T
from inkglass.operators import audit, verification
from inkglass.plans.decision_queries import _OVERALL
from inkglass.plans.overlap_queries import _sql_quotes
from inkglass.plans.registry import Fixture, query
from inkglass.session import table

_CUT = "regexp_replace(t, '([.!?])(\\s+)([A-ZÇĞİÖŞÜ])', '\\1' || chr(1) || '\\2' || chr(2) || '\\3', 'g')"


@query(
    f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, greatest(0, least(doc_id * 37 % 3000 - 10, length(coalesce(text, '')) - 1)) AS place FROM documents),
        p AS (SELECT doc_id, place, unnest(string_split({_CUT}, chr(2))) AS s, unnest(range(len(string_split({_CUT}, chr(2))))) AS i FROM d),
        w AS (SELECT *, coalesce(sum(length(replace(s, chr(1), ''))) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM p)
        SELECT doc_id, md5(regexp_replace(string_split(arg_max(s, i), chr(1))[1], '^\\s+|\\s+$', '', 'g')) AS sentence FROM w WHERE start <= place GROUP BY doc_id"""
)
def sentence_at_offset(spark: SparkSession, sf: str) -> DataFrame:
    """The sentence around a place in each document, some places outside it."""
    return table(spark, sf, "documents").select("doc_id", F.md5(T.sentence_at(F.col("text"), F.col("doc_id") * 37 % 3000 - 10)).alias("sentence"))


@query(f"SELECT page_id, count(*) AS n, sum(q.e - q.s) AS chars, min(q.s) AS first_start, max(q.e) AS last_end FROM (SELECT page_id, unnest({_sql_quotes('html')}) AS q FROM pages) GROUP BY page_id")
def quotation_ranges(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "pages").select("page_id", F.explode(T.quote_ranges(F.col("html"))).alias("q"))
    return q.groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.expr("q.end - q.start")).alias("chars"), F.min("q.start").cast("long").alias("first_start"), F.max("q.end").cast("long").alias("last_end"))


_MAP = "list_transform(range(l_linenumber * 3 - 3), lambda i: i * 2 + i % 3)"


@query(
    f"""WITH l AS (SELECT l_orderkey, l_linenumber, {_MAP} AS m, CAST(l_quantity AS BIGINT) - 5 AS s, CAST(l_quantity AS BIGINT) + l_linenumber - 6 AS e FROM lineitem),
        k AS (SELECT *, greatest(0, least(s, len(m) - 1)) AS cs, greatest(0, least(e, len(m))) AS ce FROM l)
        SELECT l_orderkey, l_linenumber, CASE WHEN len(m) = 0 THEN s ELSE m[cs + 1] END AS a, CASE WHEN len(m) = 0 THEN e WHEN cs >= ce THEN m[cs + 1] ELSE m[ce] + 1 END AS b FROM k"""
)
def remapped_spans(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("l_linenumber")
    places = F.when(n == 1, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n * 3 - 4, F.lit(0))), lambda i: i * 2 + i % 3))
    q = F.col("l_quantity").cast("long")
    rows = table(spark, sf, "lineitem").withColumn("r", T.remap_span(q - 5, q + n - 6, places))
    return rows.select("l_orderkey", "l_linenumber", F.col("r.start").alias("a"), F.col("r.end").alias("b"))


_TITLE_SETS = "list_distinct(string_split({}, ' '))"
_TITLES = f"""p AS (SELECT p_partkey, CAST(floor(p_partkey / 10) AS BIGINT) AS entry_id, p_name AS title, p_size / 50 AS sequence, p_size FROM part), q AS (SELECT entry_id, min(title) AS query FROM p GROUP BY entry_id),
    s AS (SELECT p.*, query, len(list_intersect({_TITLE_SETS.format("lower(title)")}, {_TITLE_SETS.format("lower(query)")})) AS shared, len({_TITLE_SETS.format("lower(query)")}) AS nq, len({_TITLE_SETS.format("lower(title)")}) AS nt FROM p JOIN q USING (entry_id))"""


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """Parts stand for records found for an entry, their sizes for the matching
    sequence."""
    p = table(spark, sf, "part").select("p_partkey", F.floor(F.col("p_partkey") / 10).alias("entry_id"), F.col("p_name").alias("title"), (F.col("p_size") / 50).alias("sequence"), "p_size")
    return p.join(p.groupBy("entry_id").agg(F.min("title").alias("query")), "entry_id")


@query(
    f"""WITH {_TITLES}, v AS (SELECT *, CAST(round_even((shared / (nt + nq - shared) * 0.55 + sequence * 0.45) * 100, 0) AS BIGINT) AS title_score, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size * 2 END AS author_score,
              CASE WHEN p_size % 5 = 0 THEN 100 ELSE 0 END AS year_score, CASE WHEN p_size % 7 = 0 THEN 100 WHEN p_size % 11 = 0 THEN 0 END AS doi_score FROM s),
        o AS (SELECT *, {_OVERALL} AS overall FROM v)
        SELECT entry_id, p_partkey, title_score, overall FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY overall DESC, lower(title), p_partkey) AS r FROM o) WHERE r = 1"""
)
def reference_ranking(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    rows = _records(spark, sf).withColumn("title_score", verification.title_similarity(F.col("query"), F.col("title"), F.col("sequence")))
    doi = F.when(size % 7 == 0, 100).when(size % 11 == 0, 0)
    rows = rows.withColumn("overall", verification.overall(F.col("title_score"), F.when(size % 3 != 0, size * 2), F.when(size % 5 == 0, 100).otherwise(0), doi)).withColumn("arrival", F.col("p_partkey"))
    return verification.best_reference(rows).select("entry_id", "p_partkey", "title_score", "overall")


@query(
    f"""WITH {_TITLES} SELECT p_partkey, (p_size % 7 = 0) OR (title = query AND round_even((shared / nq * 0.65 + sequence * 0.35) * 100, 0) >= 80) AS strong FROM s"""
)
def strong_matches(spark: SparkSession, sf: str) -> DataFrame:
    same = F.col("p_size") % 7 == 0
    query_ = F.when(same, F.concat(F.lit("doi 10.1234/"), F.col("p_partkey").cast("string"))).otherwise(F.upper("query"))
    doi = F.when(same, F.concat(F.lit("https://doi.org/10.1234/"), F.col("p_partkey").cast("string")))
    return _records(spark, sf).select("p_partkey", verification.strong_match(query_, F.col("title"), doi, F.lit(None).cast("string"), F.col("sequence")).alias("strong"))


@query(
    """SELECT l_orderkey AS doc_id, count(*) FILTER (l_returnflag = 'R') AS high_risk, count(*) FILTER (l_returnflag = 'A') AS medium_risk, count(*) AS total_sentences, count(*) FILTER (l_discount > 0.05) AS matched_sentences,
              coalesce(sum(CAST(l_quantity AS BIGINT)) FILTER (l_linestatus <> 'F'), 0) AS eligible_chars FROM lineitem GROUP BY l_orderkey"""
)
def similarity_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Lines stand for sentences, orders for documents."""
    risk = F.when(F.col("l_returnflag") == "R", "high").when(F.col("l_returnflag") == "A", "medium").otherwise("low")
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), risk.alias("risk"), (F.col("l_discount") > 0.05).alias("matched"), (F.col("l_linestatus") == "F").alias("bibliography"), F.col("l_quantity").cast("long").alias("length")
    )
    return audit.similarity_summary(rows)


@query(
    """WITH cl AS (SELECT o_custkey AS doc_id, o_orderkey AS claim_id, o_orderkey % 3 <> 0 AS cited, o_totalprice > 100000 AS high FROM orders),
       so AS (SELECT doc_id, claim_id, l_linenumber <> 2 AS used, l_returnflag AS v, l_tax > 0.04 AS ev, CAST(l_quantity * 2 AS BIGINT) AS conf FROM lineitem JOIN cl ON l_orderkey = claim_id WHERE cited),
       ea AS (SELECT doc_id, claim_id, bool_or(used) AS used, bool_or(used AND ev) AS ev, bool_or(used AND v = 'A') AS backed, count(*) FILTER (used AND v = 'R') AS against, count(*) FILTER (used AND conf < 60) AS weak FROM so GROUP BY ALL),
       c AS (SELECT doc_id, count(*) AS total, count(*) FILTER (cited) AS nc, count(*) FILTER (NOT cited AND high) AS uh, count(*) FILTER (used) AS ce, count(*) FILTER (ev) AS cw, count(*) FILTER (backed) AS sc, sum(coalesce(against, 0)) AS con, sum(coalesce(weak, 0)) AS wk,
                    count(*) FILTER (high AND NOT backed) AS unr FROM cl LEFT JOIN ea USING (doc_id, claim_id) GROUP BY doc_id),
       r AS (SELECT o_custkey AS doc_id, count(*) AS bt, count(*) FILTER (o_orderkey % 4 <> 0 OR o_orderstatus <> 'O') AS be, count(*) FILTER (o_orderstatus = 'F') AS vc, count(*) FILTER (o_orderstatus = 'P') AS pv FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL),
       s AS (SELECT o_custkey AS doc_id, count(*) FILTER (o_orderkey % 100 < 60) AS ws FROM orders WHERE o_orderkey % 3 = 0 GROUP BY ALL), i AS (SELECT o_custkey AS doc_id, count(*) AS bi FROM orders WHERE o_totalprice > 200000 GROUP BY ALL),
       t AS (SELECT o_custkey AS doc_id, count(DISTINCT o_orderpriority) AS dc FROM orders GROUP BY ALL),
       j AS (SELECT c.*, coalesce(bt, 0) AS bt, coalesce(be, 0) AS be, coalesce(vc, 0) AS vc, coalesce(pv, 0) AS pv, coalesce(ws, 0) AS ws, coalesce(bi, 0) AS bi, coalesce(dc, 0) AS dc FROM c LEFT JOIN r USING (doc_id) LEFT JOIN s USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN t USING (doc_id)),
       k AS (SELECT *, nc / total AS cc, CASE WHEN bt = 0 THEN 1.0 WHEN be > 0 THEN vc / be END AS vr, CASE WHEN ce > 0 THEN sc / ce END AS sr, CASE WHEN ce > 0 THEN cw / ce END AS er, greatest(0, least(1, 1 - bi / greatest(bt + dc, 1))) AS bc FROM j)
       SELECT doc_id, total AS total_claims, total - nc AS claims_requiring_citations, uh AS uncited_high, con AS contradictions, wk AS weak_cited_source_matches, ws AS weak_suggestions, unr AS unresolved_high, pv AS partially_verified, bt - vc AS unresolved_citations,
              round_even(cc, 3) AS citation_coverage, round_even(vr, 3) AS verification_ratio, round_even(sr, 3) AS support_ratio, round_even(er, 3) AS evidence_coverage, round_even(bc, 3) AS bibliography_consistency,
              concat_ws(',', CASE WHEN vr IS NULL THEN 'verification_ratio' END, CASE WHEN sr IS NULL THEN 'support_ratio' END, CASE WHEN er IS NULL THEN 'evidence_coverage' END) AS unavailable,
              CAST(greatest(0, least(100, round_even(25 * cc + 25 * vr + 20 * sr + 10 * bc + 20 * er - 2 * uh - 4 * con - 2 * unr, 0))) AS BIGINT) * CASE WHEN vr IS NULL OR sr IS NULL OR er IS NULL THEN NULL ELSE 1 END AS health_score FROM k"""
)
def audit_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Customers stand for documents, orders for claims and references, lines
    for the sources of cited claims."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    doc = F.col("o_custkey").alias("doc_id")
    claims = o.select(doc, k.alias("claim_id"), (k % 3 != 0).alias("cited"), F.when(F.col("o_totalprice") > 100000, "high").otherwise("low").alias("severity"))
    verdict = F.when(F.col("l_returnflag") == "A", "supported").when(F.col("l_returnflag") == "R", "contradicted").otherwise("unrelated")
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("claim_id"), (F.col("l_linenumber") != 2).alias("evaluated"), verdict.alias("verdict"), (F.col("l_tax") > 0.04).alias("evidence"), (F.col("l_quantity") * 2).cast("long").alias("confidence")
    )
    sources = claims.where("cited").select("doc_id", "claim_id").join(lines, "claim_id")
    status = F.when(F.col("o_orderstatus") == "F", "verified").when(F.col("o_orderstatus") == "P", "partially_verified").otherwise("unresolved")
    references = o.where(k % 2 == 0).select(doc, status.alias("status"), ((k % 4 != 0) | (F.col("o_orderstatus") != "O")).alias("evaluated"))
    suggestions = o.where(k % 3 == 0).select(doc, (k % 100).alias("confidence"))
    counts = audit.metric_counts(claims, sources, references, suggestions, o.where("o_totalprice > 200000").select(doc), o.select(doc, F.concat(F.lit(" "), F.col("o_orderpriority")).alias("raw_text")))
    rows = audit.product_summary(counts).withColumn("unavailable", F.array_join("unavailable_metrics", ","))
    named = ["total_claims", "claims_requiring_citations", "uncited_high", "contradictions", "weak_cited_source_matches", "weak_suggestions", "unresolved_high", "partially_verified", "unresolved_citations"]
    return rows.select("doc_id", *(F.col(c).cast("long").alias(c) for c in named), *audit.RATIOS, "unavailable", "health_score")


_RUNS = Fixture(
    "id long, offline boolean, queried array<string>, cached array<string>, academic boolean, llm boolean, tasks array<string>, llm_network boolean, network boolean",
    [
        (1, True, [], ["crossref"], False, False, [], False, False), (2, True, [], [], False, True, ["support"], False, False), (3, False, ["crossref", "arxiv"], [], True, True, ["support", "rewrite"], True, True),
        (4, False, ["openalex"], ["openalex"], False, True, [], False, True), (5, False, [], [], False, False, [], False, True), (6, False, ["arxiv"], [], True, True, ["rewrite"], False, False),
    ],
)


@query(
    f"""SELECT id, CASE WHEN offline AND len(cached) > 0 THEN 'Offline: records came from the cache of ' || array_to_string(cached, ', ') || '; no text was sent.' WHEN offline THEN 'Offline: no records were looked up; no text was sent.'
               WHEN len(queried) = 0 THEN 'No record provider was asked.' WHEN academic THEN 'Lookups went to ' || array_to_string(queried, ', ') || '; the document''s text did not.' ELSE 'Records of ' || array_to_string(queried, ', ') || ' came from the cache; nothing was sent.' END
        || ' ' || CASE WHEN NOT llm THEN 'No text went to a language model.' WHEN llm_network THEN 'Claims went to a language model (' || t || ').' WHEN offline OR NOT network THEN 'Language model tasks (' || t || ') were left out.' ELSE 'Language model results (' || t || ') came from the cache.' END
        || ' A verified reference does not show that a claim holds.' AS notice FROM (SELECT *, CASE WHEN len(tasks) = 0 THEN 'language model' ELSE array_to_string(tasks, ', ') END AS t FROM {_RUNS.sql})"""
)
def privacy_notices(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return _RUNS.frame(spark).select("id", audit.privacy_notice(c("offline"), c("queried"), c("cached"), c("academic"), c("llm"), c("tasks"), c("llm_network"), c("network")).alias("notice"))
