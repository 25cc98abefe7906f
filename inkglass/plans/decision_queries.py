"""Queries over citations, references, decisions and metrics, on small fixtures
that both engines build from the same rows, and on the TPC-H-like tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkglass.functions import text as T
from inkglass.operators import audit, bibliography, compare, evaluation, reduction, support, verification
from inkglass.plans.registry import Derived, Fixture, literal, query
from inkglass.session import table

# ---- numbered citations -----------------------------------------------------


@query(
    """WITH p AS (SELECT c_custkey, trim(unnest(string_split((c_custkey % 7 + 1) || '-' || (c_custkey % 5 + 2) || ', ' || (c_custkey % 300) || ',0', ','))) AS part FROM customer),
       r AS (SELECT c_custkey, CAST(regexp_extract(part, '^(\\d+)', 1) AS BIGINT) AS a, CAST(coalesce(nullif(regexp_extract(part, '-(\\d+)$', 1), ''), regexp_extract(part, '^(\\d+)', 1)) AS BIGINT) AS b FROM p),
       n AS (SELECT DISTINCT c_custkey, unnest(range(least(a, b), least(greatest(a, b), least(a, b) + 100) + 1)) AS n FROM r)
       SELECT c_custkey, list(n ORDER BY n) FILTER (n > 0)[1] AS first, CAST(count(*) FILTER (n > 0) AS BIGINT) AS count, CAST(sum(n) AS BIGINT) AS total FROM n GROUP BY c_custkey"""
)
def citations_numbered(spark: SparkSession, sf: str) -> DataFrame:
    """Lists such as "4-2, 17,0" expanded: ranges turned and cut, zeros dropped."""
    k = F.col("c_custkey")
    text = F.concat_ws("", (k % 7 + 1).cast("string"), F.lit("-"), (k % 5 + 2).cast("string"), F.lit(", "), (k % 300).cast("string"), F.lit(",0"))
    parts = F.transform(F.split(text, ","), lambda x: F.trim(x))

    def numbers(part):
        ends = F.transform(F.split(part, "\\s*[-–]\\s*"), lambda x: x.cast("long"))
        lo, hi = F.array_min(ends), F.array_max(ends)
        return F.sequence(lo, F.least(hi, lo + 100))

    n = F.array_sort(F.filter(F.array_distinct(F.flatten(F.transform(parts, numbers))), lambda x: x > 0))
    rows = table(spark, sf, "customer").select("c_custkey", n.alias("n"))
    return rows.select("c_custkey", F.get("n", F.lit(0)).alias("first"), F.size("n").cast("long").alias("count"), F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


# ---- citations and bibliography ---------------------------------------------

_CITES = Derived(
    "doc_id long, citation_id long, authors string, year long, doi string, numbered_ref long, no_date boolean",
    [
        (1, 1, "Smith & Jones", 2019, None, None, False), (1, 2, "Yılmaz vd.", 2020, None, None, False), (1, 3, None, None, None, 3, False), (1, 4, None, None, "10.1000/abc", None, False),
        (1, 5, "Brown", None, None, None, True), (1, 6, "Ghost", 1999, None, None, False), (1, 7, None, None, None, 1200, False), (1, 8, "smith et al.", 2019, None, None, False),
        (2, 9, "Adams", 2001, None, 1, False), (2, 10, "Baker", 2005, "10.1000/zzz", None, False), (2, 11, None, None, None, 9, False), (2, 12, "Adams", 2001, None, None, False),
    ],
    "lineitem",
    "1000 + l_orderkey",
    "l_linenumber",
    "CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE 'Clerk' || (l_partkey % 5) || CASE WHEN l_suppkey % 3 = 0 THEN ' & Smith' ELSE '' END END",
    "CASE WHEN l_partkey % 7 = 0 OR l_suppkey % 9 = 0 THEN NULL ELSE 2000 + l_suppkey % 4 END",
    "CASE WHEN l_partkey % 6 = 0 THEN '10.1000/' || (l_suppkey % 5) END",
    "CASE WHEN l_partkey % 7 = 0 THEN 1 + l_suppkey % 8 END",
    "l_suppkey % 9 = 0 AND l_partkey % 7 > 0",
)
_ENTRIES = Derived(
    "doc_id long, entry_index long, authors string, year long, doi string, numbered_ref long, no_date boolean",
    [
        (1, 0, "Smith, J., Jones, K.", 2019, None, 1, False), (1, 1, "Yilmaz, A.", 2020, "10.1000/abc", 2, False), (1, 2, "Clark, B.", 2010, None, 3, False), (1, 3, "Brown, C.", None, None, None, True),
        (1, 4, "Clark, D.", 2011, None, 3, False), (1, 5, "Extra, E.", 2000, "10.1000/abc", None, False), (2, 0, "Baker, Z.", 2005, "10.1000/yyy", 1, False), (2, 1, "Adams, Q.", 2001, None, 2, False),
        (2, 2, "Baker, Z.", 2005, None, None, False),
    ],
    "lineitem",
    "1000 + l_orderkey",
    "l_linenumber",
    "'Clerk' || (l_suppkey % 5) || ', A., Smith, J.'",
    "CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE 2000 + l_partkey % 4 END",
    "CASE WHEN l_suppkey % 4 = 0 THEN '10.1000/' || (l_partkey % 5) END",
    "CASE WHEN l_partkey % 3 > 0 THEN l_linenumber END",
    "l_partkey % 9 = 0",
)
_KEY = (
    "coalesce(list_filter(string_split(trim(regexp_replace(translate(regexp_replace(replace(lower(authors), '&', 'and'), 'et\\s+al\\.|vd\\.?', ' ', 'g'), 'ığüşöç', 'igusoc'), '[^a-z]+', ' ', 'g')), ' '),"
    " lambda t: t NOT IN ('', 'and', 've', 'vd', 'et', 'al'))[1], '')"
)
_C, _E = f"(SELECT *, {_KEY} AS k FROM {_CITES.sql})", f"(SELECT *, {_KEY} AS k FROM {_ENTRIES.sql})"


@query(
    f"""SELECT c.doc_id, c.citation_id, e.entry_index FROM {_C} c JOIN {_E} e ON c.doc_id = e.doc_id WHERE
        CASE WHEN c.numbered_ref IS NOT NULL AND e.numbered_ref IS NOT NULL THEN c.numbered_ref = e.numbered_ref
             WHEN coalesce(c.doi, '') <> '' AND coalesce(e.doi, '') <> '' THEN c.doi = e.doi
             WHEN coalesce(c.authors, '') = '' OR coalesce(e.authors, '') = '' THEN FALSE
             WHEN (c.year IS NULL AND NOT c.no_date) OR (e.year IS NULL AND NOT e.no_date) THEN FALSE
             ELSE c.k = e.k AND c.year IS NOT DISTINCT FROM e.year END"""
)
def citation_bib_link(spark: SparkSession, sf: str) -> DataFrame:
    return bibliography.link(_CITES.frame(spark, sf), _ENTRIES.frame(spark, sf))


@query(
    f"""SELECT doc_id, numbered_ref, CASE WHEN numbered_ref BETWEEN 1 AND 999 THEN last END AS entry_index FROM (
          SELECT c.doc_id, c.numbered_ref, max(e.entry_index) AS last
          FROM (SELECT DISTINCT doc_id, numbered_ref FROM {_C} WHERE numbered_ref IS NOT NULL) c LEFT JOIN {_E} e ON e.doc_id = c.doc_id AND e.numbered_ref = c.numbered_ref GROUP BY c.doc_id, c.numbered_ref)"""
)
def numbered_resolution(spark: SparkSession, sf: str) -> DataFrame:
    return bibliography.resolve_numbers(_CITES.frame(spark, sf), _ENTRIES.frame(spark, sf))


@query(
    f"""WITH c AS (SELECT DISTINCT doc_id, k, year FROM {_C} WHERE coalesce(authors, '') <> '' AND (year IS NOT NULL OR no_date)), e AS (SELECT DISTINCT doc_id, k, year FROM {_E} WHERE coalesce(authors, '') <> '' AND (year IS NOT NULL OR no_date))
        SELECT doc_id, 'duplicate_doi' AS kind, doi AS key, CAST(NULL AS BIGINT) AS year, count(*) AS count FROM {_E} WHERE doi IS NOT NULL GROUP BY doc_id, doi HAVING count(*) > 1
        UNION ALL SELECT doc_id, 'cited_not_listed', k, year, 1 FROM c WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.doc_id = c.doc_id AND e.k = c.k AND e.year IS NOT DISTINCT FROM c.year)
        UNION ALL SELECT doc_id, 'listed_not_cited', k, year, 1 FROM e WHERE NOT EXISTS (SELECT 1 FROM c WHERE e.doc_id = c.doc_id AND e.k = c.k AND e.year IS NOT DISTINCT FROM c.year)"""
)
def bib_issues(spark: SparkSession, sf: str) -> DataFrame:
    return bibliography.issues(_CITES.frame(spark, sf), _ENTRIES.frame(spark, sf))


_PARAGRAPHS = Derived(
    "doc_id long, paragraph_index long, text string",
    [
        (1, 0, "# Title"), (1, 1, "Some text (Smith, 2019)."), (1, 2, "## References:"), (1, 3, "[1] Smith, J. (2019). Deep things. Journal of Depth. 10.1000/abc."), (1, 4, "2. Brown, C. (n.d.). Undated work. Press."),
        (1, 5, "# Appendix"), (1, 6, "Not an entry 2020."), (2, 0, "Text only."), (2, 1, "More text."), (3, 0, "INTRO"), (3, 1, "Words here."), (3, 2, "EK-1 SOURCES"), (3, 3, "Adams, Q. (2001). A title. Place"),
        (3, 4, "Baker, Z. (2005). Another title"), (3, 5, "Clark, B. 10.1000/xyz"), (3, 6, "Plain line"), (4, 0, "Ek 2: Kaynakça"), (4, 1, "Demir, A. 1999b, Eski bir eser. Ankara"),
    ],
    "lineitem",
    "1000 + l_orderkey",
    "l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey",
    "CASE WHEN l_linenumber = 1 AND l_partkey % 2 = 0 THEN '# Part ' || l_partkey WHEN l_linenumber = 2 AND l_suppkey % 3 = 0 THEN '## References:' WHEN l_linenumber = 2 AND l_suppkey % 3 = 1 THEN 'EK-1 SOURCES' WHEN l_linenumber = 6 AND l_partkey % 4 = 0 THEN '# Appendix' WHEN l_partkey % 5 = 0 THEN '[' || l_linenumber || '] Clerk, A. (' || (1990 + l_suppkey % 30) || '). Title ' || l_partkey || '. Press. 10.1000/' || l_partkey || '.' WHEN l_partkey % 5 = 1 THEN l_linenumber || '. Brown, C. (n.d.). Undated ' || l_partkey || '. Press.' WHEN l_partkey % 5 = 2 THEN 'Adams, Q. (2001). A title. Place' WHEN l_partkey % 5 = 3 THEN 'Clark, B. 10.1000/X' || l_suppkey ELSE 'Plain line ' || l_partkey END",
)
_KEY_OF = "trim(regexp_replace(regexp_replace(lower(regexp_replace(trim(regexp_replace(trim(text), '^#+', '')), ':+$', '')), '^ek\\s*[-.]?\\s*\\d+\\s*:?\\s*', ''), '\\s+', ' ', 'g'))"
_LIKE = "(regexp_matches(text, '(?i)\\b(?:18|19|20|21)\\d{2}[a-z]?\\b') OR regexp_matches(text, '(?i)\\((?:t\\.?\\s*y\\.?|n\\.?\\s*d\\.?)\\)') OR regexp_matches(text, '(?i)\\b10\\.\\d{4,9}/[-._;()/:A-Z0-9]+'))"
_START = f"""(SELECT doc_id, coalesce(min(paragraph_index) FILTER (known), min(paragraph_index) FILTER (guess)) AS bibliography_start FROM (
    SELECT doc_id, paragraph_index, {_KEY_OF} IN ('references', 'bibliography', 'works cited', 'kaynaklar', 'kaynakça') AS known,
           length(text) <= 80 AND len(list_filter(string_split(trim(text), ' '), lambda x: x <> '')) <= 8 AND text = upper(text) AND paragraph_index <= max(paragraph_index) OVER (PARTITION BY doc_id) - 3
           AND coalesce(sum(CAST({_LIKE} AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY paragraph_index ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), 0) >= 3 AS guess FROM {_PARAGRAPHS.sql}) GROUP BY doc_id)"""


@query(f"SELECT * FROM {_START}")
def bibliography_start(spark: SparkSession, sf: str) -> DataFrame:
    return bibliography.starts(_PARAGRAPHS.frame(spark, sf))


_BODY = "trim(regexp_replace(raw, '^\\s*(?:\\[(\\d+)\\]|(\\d+)[.)])\\s*', ''))"
_Y, _ND = "(?i)\\b((?:18|19|20|21)\\d{2})[a-z]?\\b", "(?i)\\((?:t\\.?\\s*y\\.?|n\\.?\\s*d\\.?)\\)"
_DOI = "(?i)\\b10\\.\\d{4,9}/[-._;()/:A-Z0-9]+"


@query(
    f"""WITH p AS (SELECT f.doc_id, f.paragraph_index, f.text AS raw, min(CASE WHEN starts_with(trim(f.text), '#') THEN f.paragraph_index END) OVER (PARTITION BY f.doc_id) AS stop
                   FROM {_PARAGRAPHS.sql} f JOIN {_START} s ON f.doc_id = s.doc_id WHERE f.paragraph_index > s.bibliography_start AND trim(f.text) <> ''),
        b AS (SELECT doc_id, paragraph_index, CAST(coalesce(nullif(regexp_extract(raw, '^\\s*(?:\\[(\\d+)\\]|(\\d+)[.)])\\s*', 1), ''), nullif(regexp_extract(raw, '^\\s*(?:\\[(\\d+)\\]|(\\d+)[.)])\\s*', 2), '')) AS BIGINT) AS numbered_ref, {_BODY} AS body FROM p WHERE stop IS NULL OR paragraph_index < stop),
        y AS (SELECT *, nullif(regexp_extract(body, '{_Y}', 1), '') AS y, nullif(regexp_extract(body, '{_Y}'), '') AS mark, regexp_matches(body, '{_ND}') AND regexp_extract(body, '{_Y}', 1) = '' AS no_date, nullif(regexp_extract(body, '{_ND}'), '') AS nd FROM b)
        SELECT doc_id, paragraph_index, numbered_ref, CAST(y AS BIGINT) AS year, no_date,
               CASE WHEN regexp_extract(body, '{_DOI}') <> '' THEN lower(regexp_replace(regexp_extract(body, '{_DOI}'), '[.,;:)\\]}}>]+$', '')) END AS doi,
               nullif(regexp_replace(CASE WHEN y IS NOT NULL THEN substr(body, 1, instr(body, mark) - 1) WHEN no_date THEN substr(body, 1, instr(body, nd) - 1) END, '^[ .,(;]+|[ .,(;]+$', '', 'g'), '') AS authors FROM y"""
)
def bib_entries(spark: SparkSession, sf: str) -> DataFrame:
    rows = bibliography.entry_paragraphs(_PARAGRAPHS.frame(spark, sf)).withColumn("e", bibliography.parse_entry(F.col("text")))
    return rows.select("doc_id", "paragraph_index", "e.numbered_ref", "e.year", "e.no_date", "e.doi", "e.authors")


# ---- references against records ----------------------------------------------

_REFS = Derived(
    "id long, raw string, title_score long, author_score long, year_score long, doi_score long, work_type string, arxiv_id string, entry_year long, year long",
    [
        (1, "Smith 2019", 90, 100, 100, None, "journal-article", None, 2019, 2019), (2, "Smith 2019", 90, 100, 100, 100, "review", None, 2019, 2019), (3, "Smith 2019", 95, 100, 100, 0, "letter", None, 1980, None),
        (4, "In Proceedings of X", 95, 100, 100, None, "journal-article", None, 1990, 1990), (5, "arXiv preprint", 95, 100, 100, None, None, None, 2021, 2021), (6, "arXiv preprint", 95, 100, 100, None, None, "2101.1", 2021, 2021),
        (7, "Low title", 40, 100, 100, None, "Meta-Analysis", None, None, None), (8, "Low title", 20, 20, 100, None, "clinical-trial", None, 2000, 2001), (9, "Authors", 95, 60, 0, None, "other", None, 1970, 1970),
        (10, "Authors", 95, 10, 100, None, "editorial ", None, 2024, 2024), (11, "Nothing", None, None, None, None, None, None, None, None), (12, "Title only", 65, None, None, None, "book-review", None, 2000, None), (13, "Half", 60, 80, 0, None, "x", None, 1999, 2010),
    ],
    "lineitem",
    "1000 + l_orderkey * 8 + l_linenumber",
    "CASE l_partkey % 4 WHEN 0 THEN 'In Proceedings of X' WHEN 1 THEN 'arXiv preprint' ELSE 'Smith 2019' END",
    "CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE l_partkey * 7 % 101 END",
    "CASE WHEN l_suppkey % 8 = 0 THEN NULL ELSE l_suppkey * 7 % 101 END",
    "CASE l_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 100 END",
    "CASE l_suppkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 100 END",
    "CASE l_orderkey % 6 WHEN 0 THEN 'journal-article' WHEN 1 THEN ' Review' WHEN 2 THEN 'clinical-trial' WHEN 3 THEN 'letter' WHEN 4 THEN 'other' END",
    "CASE WHEN l_suppkey % 3 = 0 THEN '2101.' || l_partkey WHEN l_suppkey % 3 = 1 THEN '' END",
    "CASE WHEN l_partkey % 6 = 0 THEN NULL ELSE 1980 + l_partkey % 45 END",
    "CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE 1980 + l_suppkey % 45 END",
)


def _weighted(parts: list[tuple[str, int]]) -> str:
    total = " + ".join(f"coalesce({c}, 0) * {w}" for c, w in parts)
    weight = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE {w} END" for c, w in parts)
    return f"coalesce(CAST(round_even(({total}) / nullif({weight}, 0), 0) AS BIGINT), 0)"


_PLAIN_MEAN = _weighted([("title_score", 40), ("author_score", 35), ("year_score", 25)])
_DOI_MEAN = _weighted([("doi_score", 60), ("title_score", 20), ("author_score", 15), ("year_score", 5)])
_OVERALL = f"CASE WHEN doi_score IS NULL THEN {_PLAIN_MEAN} WHEN doi_score = 0 THEN least({_DOI_MEAN}, 49) ELSE {_DOI_MEAN} END"


@query(
    f"""SELECT id, overall, CASE WHEN doi_score = 100 THEN 'verified' WHEN doi_score = 0 THEN 'metadata_mismatch' WHEN contains(lower(raw), 'proceedings') AND coalesce(work_type, '') = 'journal-article' THEN 'unresolved'
          WHEN contains(lower(raw), 'arxiv') AND coalesce(arxiv_id, '') = '' THEN 'partially_verified' WHEN title_score < 60 THEN CASE WHEN overall >= 50 THEN 'partially_verified' ELSE 'unresolved' END
          WHEN author_score < 80 THEN CASE WHEN author_score >= 50 THEN 'partially_verified' ELSE 'unresolved' END WHEN overall >= 70 THEN 'verified' WHEN overall >= 50 THEN 'partially_verified' ELSE 'unresolved' END AS status,
          coalesce(2026 - coalesce(year, entry_year) > 25, FALSE) AS outdated,
          CASE WHEN lower(trim(work_type)) IN ('research-article', 'original-research', 'clinical-trial', 'randomized-controlled-trial', 'research-output') THEN 'primary'
               WHEN lower(trim(work_type)) IN ('review', 'editorial', 'letter', 'commentary', 'erratum', 'retraction', 'book-review', 'supplementary-materials', 'meta-analysis', 'systematic-review') THEN 'secondary' ELSE 'unknown' END AS source_type
        FROM (SELECT *, {_OVERALL} AS overall FROM {_REFS.sql})"""
)
def reference_status(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    rows = _REFS.frame(spark, sf).withColumn("overall", verification.overall(c("title_score"), c("author_score"), c("year_score"), c("doi_score")))
    return rows.select(
        "id", "overall", verification.status(c("raw"), c("work_type"), c("arxiv_id"), c("title_score"), c("author_score"), c("doi_score"), c("overall")).alias("status"),
        verification.outdated(c("entry_year"), c("year"), 2026).alias("outdated"), verification.source_type(c("work_type")).alias("source_type"),
    )


_RECORDS = Fixture(
    "query_id long, arrival long, title string, authors array<string>, year long, venue string, doi string, arxiv_id string, abstract string, source_api string",
    [
        (1, 1, "Deep Nets", ["A One"], 2017, None, "10.1000/DN", None, "short", "crossref"), (1, 2, "Deep nets!", ["A One", "B Two"], None, "NeurIPS", "10.1000/dn", None, "a longer abstract", "openalex"),
        (1, 3, "Attention", ["V A"], 2017, None, None, "1706.03762v5", None, "arxiv"), (1, 4, "Attention is all", [], 2018, "X", "10.5555/att", "arXiv:1706.03762", "text", "semantic_scholar"), (1, 5, "Other", ["Q"], 2001, None, None, None, None, "openalex"),
        (2, 1, "Other", ["Q"], 2001, None, None, None, "same title and year", "crossref"), (2, 2, "OTHER.", ["Q"], 2001, None, None, None, "x", "openalex"),
    ],
)
_ID_DOI = "CASE WHEN regexp_extract(doi, '" + _DOI + "') <> '' THEN 'doi:' || lower(regexp_extract(doi, '" + _DOI + "')) END"
_ID_ARXIV = "CASE WHEN regexp_extract(arxiv_id, '(\\d{4}\\.\\d{4,5})', 1) <> '' THEN 'arxiv:' || regexp_extract(arxiv_id, '(\\d{4}\\.\\d{4,5})', 1) END"
_ID_TITLE = "'title:' || array_to_string(regexp_extract_all(lower(title), '[a-z0-9]+'), ' ') || '|' || coalesce(CAST(year AS VARCHAR), '')"


@query(
    f"""SELECT query_id, identity, min(arrival) AS arrival, arg_min(title, arrival) AS title, arg_min(year, arrival) FILTER (year IS NOT NULL) AS year, arg_min(venue, arrival) FILTER (venue IS NOT NULL) AS venue,
               CAST(max(len(authors)) AS BIGINT) AS n_authors, arg_max(abstract, length(abstract) * 1000 - arrival) FILTER (abstract IS NOT NULL) AS abstract, array_to_string(list(source_api ORDER BY arrival), ',') AS apis
        FROM (SELECT *, coalesce({_ID_ARXIV}, {_ID_DOI}, {_ID_TITLE}) AS identity FROM {_RECORDS.sql}) GROUP BY query_id, identity"""
)
def candidate_merge(spark: SparkSession, sf: str) -> DataFrame:
    out = verification.merge_candidates(_RECORDS.frame(spark))
    return out.select("query_id", "identity", "arrival", "title", "year", "venue", F.size("authors").cast("long").alias("n_authors"), "abstract", F.array_join("source_apis", ",").alias("apis"))


# ---- support and audit ---------------------------------------------------------

_SUPPORT = Derived(
    "id long, metadata long, best long, entailed string, confidence long",
    [
        (1, 80, 72, None, None), (2, 60, 55, "insufficient_information", 30), (3, 60, 10, None, None), (4, 90, None, None, None), (5, 40, 30, "contradicted", 85), (6, 50, 20, None, None), (7, 70, 65, "supported", 90),
        (8, 0, 0, None, None), (9, 100, 100, "partially_supported", 100), (10, 35, 49, None, None),
    ],
    "orders",
    "1000 + o_orderkey",
    "o_orderkey % 101",
    "CASE WHEN o_custkey % 6 = 0 THEN NULL ELSE o_custkey % 100 END",
    "CASE o_orderkey % 5 WHEN 0 THEN 'supported' WHEN 1 THEN 'contradicted' WHEN 2 THEN 'insufficient_information' WHEN 3 THEN 'partially_supported' END",
    "CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_orderkey % 97 END",
)


@query(
    f"""SELECT id, CASE WHEN entailed IS NOT NULL AND entailed <> 'insufficient_information' THEN entailed WHEN best >= 50 THEN 'partially_supported' WHEN metadata >= 50 AND (best IS NULL OR best < 20) THEN 'unrelated' ELSE 'insufficient_information' END AS verdict,
               support, CAST(CASE WHEN entailed IS NOT NULL THEN round_even(metadata * 0.2 + support * 0.8, 0) ELSE round_even(metadata * 0.4 + support * 0.6, 0) END AS BIGINT) AS overall
        FROM (SELECT *, CAST(CASE WHEN entailed IS NOT NULL AND entailed <> 'insufficient_information' THEN round_even(coalesce(best, 0) * 0.25 + coalesce(confidence, 0) * 0.75, 0) ELSE coalesce(best, 0) END AS BIGINT) AS support FROM {_SUPPORT.sql})"""
)
def claim_support(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    rows = _SUPPORT.frame(spark, sf).withColumn("support", support.support(c("best"), c("entailed"), c("confidence")))
    return rows.select("id", support.verdict(c("metadata"), c("best"), c("entailed")).alias("verdict"), "support", support.overall_confidence(c("metadata"), c("support"), c("entailed").isNotNull()).alias("overall"))


@query(
    """SELECT p_partkey, CAST(CASE WHEN len(q) = 0 OR len(t) = 0 THEN 0 ELSE round_even((len(list_intersect(q, t)) / greatest(len(q), 1) * 0.6 + len(list_intersect(q, t)) / greatest(len(t), 1) * 0.4) * 100, 0) END AS BIGINT) AS score
       FROM (SELECT p_partkey, list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]+')) AS q, list_distinct(regexp_extract_all(lower(p_type || ' of ' || p_brand), '[a-z0-9]+')) AS t FROM part)"""
)
def metadata_match(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("q"), F.concat(F.col("p_type"), F.lit(" of "), F.col("p_brand")).alias("t"))
    return rows.select("p_partkey", support.metadata_match(F.col("q"), F.col("t")).alias("score"))


_SUMMARY = Derived(
    "claim_id long, evaluated boolean, verdict string",
    [(1, True, "supported"), (1, True, "contradicted"), (2, True, "contradicted"), (3, True, "partially_supported"), (3, False, "contradicted"), (4, True, "unrelated"), (5, False, None), (6, True, None), (6, False, "supported")],
    "lineitem",
    "1000 + l_orderkey",
    "l_linestatus = 'O' OR l_quantity > 25",
    "CASE l_partkey % 5 WHEN 0 THEN 'supported' WHEN 1 THEN 'contradicted' WHEN 2 THEN 'partially_supported' WHEN 3 THEN 'unrelated' END",
)


@query(
    f"""SELECT claim_id, CASE WHEN NOT bool_or(evaluated) THEN 'unavailable' WHEN a AND f THEN 'mixed' WHEN a THEN 'contradicted' WHEN f THEN 'supported' ELSE 'unresolved' END AS summary
        FROM (SELECT *, coalesce(bool_or(evaluated AND verdict = 'contradicted') OVER (PARTITION BY claim_id), FALSE) AS a, coalesce(bool_or(evaluated AND verdict IN ('supported', 'partially_supported')) OVER (PARTITION BY claim_id), FALSE) AS f FROM {_SUMMARY.sql}) GROUP BY claim_id, a, f"""
)
def claim_summary(spark: SparkSession, sf: str) -> DataFrame:
    return support.claim_summary(_SUMMARY.frame(spark, sf))


_COUNTS = Derived(
    "doc_id long, total_claims long, cited_claims long, verified_citations long, bib_evaluated long, bib_total long, supported_cited_claims long, cited_evaluated long, cited_with_evidence long, bibliography_issues long, bibliography_entries long, distinct_citations long, uncited_high long, contradictions long, unresolved_high long",
    [
        (1, 10, 8, 5, 6, 7, 4, 5, 5, 1, 7, 6, 1, 0, 0), (2, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0), (3, 4, 1, 0, 0, 3, 0, 1, 0, 2, 3, 1, 2, 1, 1), (4, 20, 20, 9, 9, 9, 12, 12, 12, 0, 9, 9, 0, 0, 0),
        (5, 20, 2, 1, 9, 9, 1, 12, 2, 30, 9, 9, 9, 9, 9), (6, 7, 3, 2, 3, 3, 1, 2, 1, 1, 3, 4, 0, 0, 1),
    ],
    "orders",
    "1000 + o_orderkey",
    "o_orderkey % 23",
    "least(o_orderkey % 23, o_custkey % 19)",
    "least(o_custkey % 7, o_orderkey % 9)",
    "o_orderkey % 9",
    "(o_orderkey % 9) + (o_custkey % 3)",
    "least(o_custkey % 5, o_orderkey % 6)",
    "o_orderkey % 6",
    "least(o_custkey % 4, o_orderkey % 6)",
    "o_custkey % 8",
    "o_orderkey % 11",
    "o_custkey % 6",
    "o_orderkey % 4",
    "o_custkey % 3",
    "o_orderkey % 2",
)
_RATIOS = f"""(SELECT *, CASE WHEN total_claims > 0 THEN cited_claims / total_claims ELSE 1.0::DOUBLE END AS cc, CASE WHEN bib_total <= 0 THEN 1.0::DOUBLE WHEN bib_evaluated > 0 THEN verified_citations / bib_evaluated END AS vr,
   CASE WHEN cited_evaluated > 0 THEN supported_cited_claims / cited_evaluated END AS sr, CASE WHEN cited_evaluated > 0 THEN cited_with_evidence / cited_evaluated END AS ec,
   greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - bibliography_issues / greatest(bibliography_entries + distinct_citations, 1))) AS bc FROM {_COUNTS.sql})"""


@query(
    f"""SELECT doc_id, round(cc, 6) AS citation_coverage, round(vr, 6) AS verification_ratio, round(sr, 6) AS support_ratio, round(ec, 6) AS evidence_coverage, round(bc, 6) AS bibliography_consistency, h AS health_score, h IS NOT NULL AS health_score_complete,
               CAST(CASE WHEN h IS NULL OR h < 80 THEN 1 ELSE 0 END AS BIGINT) AS exit_code
        FROM (SELECT *, CAST(greatest(0, least(100, round_even(cc * 25 + vr * 25 + sr * 20 + bc * 10 + ec * 20 - uncited_high * 2 - contradictions * 4 - unresolved_high * 2, 0))) AS BIGINT) * CASE WHEN vr IS NULL OR sr IS NULL OR ec IS NULL THEN NULL ELSE 1 END AS h FROM {_RATIOS})"""
)
def health_score(spark: SparkSession, sf: str) -> DataFrame:
    rows = audit.product_ratios(_COUNTS.frame(spark, sf))
    code = audit.exit_code(F.lit("check"), F.lit(False), F.col("health_score"))
    return rows.select("doc_id", *(F.round(c, 6).alias(c) for c in audit.RATIOS), "health_score", "health_score_complete", code.alias("exit_code"))


_QUEUE = Derived(
    "doc_id long, seq long, kind string, summary string, severity string, confidence long",
    [
        (1, 1, "cited", "supported", "high", 90), (1, 2, "cited", "mixed", "low", 40), (1, 3, "cited", "contradicted", "high", 70), (1, 4, "cited", "unresolved", "medium", None), (1, 5, "cited", "unavailable", "low", None),
        (1, 6, "uncited", None, "high", 55), (1, 7, "uncited", None, "high", None), (1, 8, "uncited", None, "medium", 10), (1, 9, "uncited", None, "low", 5), (1, 10, "metadata_conflict", None, "low", 1), (1, 11, "similarity_risk", None, "high", None),
        (1, 12, "bibliography_issue", None, "low", None), (2, 1, "cited", "unresolved", "high", 20), (2, 2, "cited", "unresolved", "high", 10),
    ],
    "lineitem",
    "1000 + l_orderkey",
    "l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey",
    "CASE l_partkey % 5 WHEN 0 THEN 'uncited' WHEN 1 THEN 'metadata_conflict' WHEN 2 THEN 'similarity_risk' ELSE 'cited' END",
    "CASE WHEN l_partkey % 5 < 3 THEN NULL WHEN l_suppkey % 5 = 0 THEN 'supported' WHEN l_suppkey % 5 = 1 THEN 'mixed' WHEN l_suppkey % 5 = 2 THEN 'contradicted' WHEN l_suppkey % 5 = 3 THEN 'unresolved' ELSE 'unavailable' END",
    "CASE (l_partkey + l_linenumber) % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END",
    "CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE l_partkey % 100 END",
)


@query(
    f"""SELECT doc_id, seq, CAST(g AS BIGINT) AS "group", row_number() OVER (PARTITION BY doc_id ORDER BY g, s DESC, CASE WHEN g < 5 THEN coalesce(confidence, -1) ELSE seq END, seq) AS position, CAST(s * 100 + 100 - coalesce(confidence, 0) AS BIGINT) AS priority
        FROM (SELECT *, CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS s,
          CASE WHEN kind = 'cited' THEN CASE WHEN summary IN ('contradicted', 'mixed') THEN 0 WHEN summary = 'supported' THEN NULL WHEN severity IN ('high', 'medium') THEN 1 ELSE 4 END
               WHEN kind = 'uncited' THEN CASE severity WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END ELSE 5 END AS g FROM {_QUEUE.sql}) WHERE g IS NOT NULL"""
)
def review_queue(spark: SparkSession, sf: str) -> DataFrame:
    rows = audit.review_queue(_QUEUE.frame(spark, sf))
    return rows.select("doc_id", "seq", "group", "position", audit.priority(F.col("severity"), F.col("confidence")).alias("priority"))


# ---- attribution and reduction -------------------------------------------------

_MATCHES = Derived(
    "id long, kind string, exact double, lexical double, semantic double, quoted boolean, cited boolean, source_cited boolean, common boolean, bibliography boolean, words long, quote_coverage double",
    [
        (1, "exact", 1.0, 0.9, 0.0, False, False, False, False, False, 30, 0.0), (2, "exact", 1.0, 0.9, 0.0, False, False, False, False, False, 10, 0.0), (3, "exact", 0.96, 0.9, 0.9, True, True, True, False, False, 10, 0.99),
        (4, "exact", 0.97, 0.9, 0.9, True, False, False, False, False, 10, 1.0), (5, "near_duplicate", 0.8, 0.9, 0.0, False, True, True, False, False, 10, 0.0), (6, "near_duplicate", 0.8, 0.6, 0.0, False, True, False, False, False, 10, 0.0),
        (7, "lexical_overlap", 0.3, 0.6, 0.0, False, False, False, False, False, 10, 0.0), (8, "semantic_overlap", 0.1, 0.2, 0.9, False, True, True, False, False, 10, 0.0), (9, "semantic_overlap", 0.1, 0.2, 0.9, False, False, False, False, False, 10, 0.0),
        (10, "exact", 1.0, 1.0, 1.0, False, False, False, True, False, 4, 0.0), (11, "exact", 1.0, 1.0, 1.0, False, True, True, False, True, 40, 0.0), (12, "lexical_overlap", 0.5, 0.75, 0.9, False, True, True, False, False, 9, 0.0),
        (13, "lexical_overlap", 0.75, 0.75, 0.2, True, True, True, False, False, 9, 0.5),
    ],
    "lineitem",
    "1000 + l_orderkey * 8 + l_linenumber",
    "CASE l_partkey % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'near_duplicate' WHEN 2 THEN 'lexical_overlap' ELSE 'semantic_overlap' END",
    "(l_partkey % 21) / 20.0",
    "(l_suppkey % 21) / 20.0",
    "(l_orderkey % 21) / 20.0",
    "l_quantity > 30",
    "l_returnflag = 'A'",
    "l_linestatus = 'O'",
    "l_partkey % 11 = 0",
    "l_orderkey % 13 = 0",
    "6 + l_orderkey % 40",
    "(l_linenumber % 5) / 4.0",
)
_RISK = (
    "CASE WHEN kind = 'semantic_overlap' THEN CASE WHEN cited AND source_cited THEN 'low' ELSE 'medium' END WHEN NOT cited THEN CASE WHEN exact >= 0.95 THEN 'high' ELSE 'medium' END WHEN NOT source_cited THEN 'high'"
    " WHEN exact >= 0.95 THEN CASE WHEN quote_coverage >= 0.95 THEN 'low' ELSE 'medium' END WHEN exact < 0.7 THEN 'medium' ELSE 'low' END"
)


@query(
    f"""SELECT id, {_RISK} AS risk, CASE WHEN bibliography THEN 'review_required' WHEN common THEN 'possible_common_phrase' WHEN quoted AND cited THEN 'quoted_and_attributed' WHEN quoted THEN 'quoted_not_attributed'
          WHEN cited AND (kind = 'exact' OR (kind IN ('near_duplicate', 'lexical_overlap') AND lexical >= 0.85)) THEN 'cited_but_verbatim' WHEN kind = 'exact' THEN 'unattributed_exact'
          WHEN kind IN ('near_duplicate', 'lexical_overlap') THEN CASE WHEN cited THEN 'attributed' ELSE 'unattributed_near_exact' END WHEN cited THEN 'paraphrase_attributed' ELSE 'unattributed_semantic' END AS status,
        CASE WHEN bibliography OR common OR (quoted AND cited) THEN 'low' WHEN quoted THEN 'high' WHEN cited AND (kind = 'exact' OR (kind IN ('near_duplicate', 'lexical_overlap') AND lexical >= 0.85)) THEN 'high'
          WHEN kind = 'exact' THEN CASE WHEN words >= 25 THEN 'critical' ELSE 'high' END WHEN cited THEN 'low' WHEN kind IN ('near_duplicate', 'lexical_overlap') THEN 'high' ELSE 'medium' END AS severity,
        substr(sha256(concat_ws(':', CAST(id AS VARCHAR), kind, CAST(words AS VARCHAR))), 1, 16) AS match_id FROM {_MATCHES.sql}"""
)
def attribution_status(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    rows = _MATCHES.frame(spark, sf).withColumn("a", compare.attribution(c("kind"), c("lexical"), c("quoted"), c("cited"), c("common"), c("bibliography"), c("words")))
    risk = compare.attribution_risk(c("kind"), c("exact"), c("cited"), c("source_cited"), c("quote_coverage"))
    return rows.select("id", risk.alias("risk"), "a.status", "a.severity", compare.match_id(c("id"), c("kind"), c("words")).alias("match_id"))


_ALIKE = "lexical >= 0.7 AND (semantic >= 0.85 OR semantic = 0)"


@query(
    f"""WITH r AS (SELECT id, CASE WHEN quoted AND exact >= 0.7 AND cited THEN 'acceptable_overlap' WHEN quoted AND exact >= 0.7 THEN 'missing_citation' WHEN exact >= 0.7 AND cited THEN 'too_close_paraphrase' WHEN exact >= 0.7 THEN 'exact_copy'
          WHEN {_ALIKE} AND cited THEN 'too_close_paraphrase' WHEN {_ALIKE} THEN 'missing_citation' WHEN level = 'high' AND NOT cited THEN 'missing_citation' WHEN level = 'medium' THEN 'acceptable_overlap' ELSE 'unknown' END AS risk_type,
        CASE WHEN quoted AND exact >= 0.7 AND cited THEN 'leave' WHEN quoted AND exact >= 0.7 THEN 'add_citation' WHEN exact >= 0.7 AND cited THEN 'paraphrase' WHEN exact >= 0.7 THEN 'add_citation'
          WHEN {_ALIKE} AND cited THEN 'paraphrase' WHEN {_ALIKE} THEN 'add_citation' WHEN level = 'high' AND NOT cited THEN 'add_citation' WHEN level = 'medium' THEN 'manual_review' ELSE 'leave' END AS action
        FROM (SELECT *, {_RISK} AS level FROM {_MATCHES.sql}))
        SELECT id, risk_type, CASE WHEN risk_type IN ('exact_copy', 'missing_citation') THEN 'add_citation' ELSE action END AS action, action = 'paraphrase' AS rewrite_allowed FROM r"""
)
def fix_plan(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    rows = _MATCHES.frame(spark, sf).withColumn("level", compare.attribution_risk(c("kind"), c("exact"), c("cited"), c("source_cited"), c("quote_coverage")))
    rows = rows.withColumn("r", reduction.risk(c("exact"), c("lexical"), c("semantic"), c("level"), c("quoted"), c("cited"), F.lit(None).cast("boolean"), F.lit(True)))
    return rows.withColumn("p", reduction.fix_plan(c("r.risk_type"), c("r.action"))).select("id", "r.risk_type", "p.action", "p.rewrite_allowed")


@query(
    """WITH s AS (SELECT user_id AS doc_id, CASE WHEN value > 50 THEN 'after' ELSE 'before' END AS phase, CAST(event_id % 3 AS BIGINT) AS paragraph, CAST(event_id % 211 AS BIGINT) AS a, CAST(event_id % 211 + event_id % 17 AS BIGINT) AS b, CASE WHEN event_id % 5 = 0 THEN 'exact' WHEN event_id % 5 = 1 THEN 'semantic_overlap' ELSE 'lexical_overlap' END AS k FROM events),
       c AS (SELECT doc_id, phase, paragraph, unnest(range(a, b)) AS p, k = 'exact' AS x FROM s WHERE k <> 'semantic_overlap' AND b > a), d AS (SELECT doc_id, phase, paragraph, p, bool_or(x) AS x FROM c GROUP BY ALL)
       SELECT doc_id, phase, count(*) FILTER (x) AS exact, count(*) FILTER (NOT x) AS lexical FROM d GROUP BY doc_id, phase"""
)
def reduction_delta(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    kind = F.when(e % 5 == 0, "exact").when(e % 5 == 1, "semantic_overlap").otherwise("lexical_overlap")
    rows = table(spark, sf, "events").select(
        F.col("user_id").alias("doc_id"), F.when(F.col("value") > 50, "after").otherwise("before").alias("phase"), (e % 3).alias("paragraph"), (e % 211).alias("start"), (e % 211 + e % 17).alias("end"), kind.alias("match_type")
    )
    return reduction.offsets(rows)


_REWRITES = Derived(
    "id long, original string, candidate string, meaning double, support double, delta double, lexical double, e0 double, e1 double, l0 double, l1 double",
    [
        (1, "Coffee may lower risk by 12 %", "Risk may fall by 12 % with coffee", 0.9, 0.8, 0.4, 0.5, 0.9, 0.5, 0.8, 0.4), (2, "Coffee may lower risk", "Coffee will lower risk", 0.95, 0.9, 0.1, 0.9, 0.9, 0.8, 0.8, 0.8),
        (3, "It is associated with age 40", "It causes age 41", 0.5, None, -0.1, None, 0.5, 0.6, 0.5, 0.5), (4, "Some plants grow", "All plants grow", None, 0.2, None, 0.2, 0.5, 0.5, 0.5, 0.5), (5, "It does not rise", "It rises", 0.7, 0.7, 0.7, 0.7, 0.5, 0.4, 0.5, 0.6),
        (6, "Sleep is linked to mood", "Sleep has not caused it; mood fell", 0.7, 0.7, 0.7, 0.7, 0.5, 0.4, 0.5, 0.4), (7, "Sleep is linked to mood", "It is not rare. Sleep led to low mood", 0.7, 0.7, 0.7, 0.7, 0.5, 0.4, 0.5, 0.4),
        (8, "Uyku ile ilişkili bulundu", "Uyku buna neden oldu", 0.7, 0.7, 0.7, 0.7, 0.5, 0.4, 0.5, 0.4), (9, "Etkisi olabilir", "Etkisi kesindir", 0.7, 0.7, 0.7, 0.7, 0.5, 0.4, 0.5, 0.4),
        (10, "Bazı bitkiler büyür", "Tüm bitkiler büyür değil", 0.7, 0.7, 0.7, 0.7, 0.5, 0.4, 0.5, 0.4), (11, "This may help", "This definitely helps", 0.7, 0.7, 0.7, 0.7, 0.5, 0.4, 0.5, 0.4),
    ],
    "lineitem",
    "1000 + l_orderkey * 8 + l_linenumber",
    "CASE l_partkey % 4 WHEN 0 THEN 'Coffee may lower risk' WHEN 1 THEN 'Sleep is linked to mood' WHEN 2 THEN 'Some plants grow' ELSE 'It is associated with age' END",
    "CASE l_suppkey % 5 WHEN 0 THEN 'Coffee will lower risk' WHEN 1 THEN 'Sleep causes mood' WHEN 2 THEN 'All plants grow' WHEN 3 THEN 'It does not cause age; it is linked' ELSE 'It is as it was' END",
    "(l_partkey % 11) / 10.0",
    "CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE (l_suppkey % 11) / 10.0 END",
    "(l_orderkey % 11 - 5) / 10.0",
    "(l_linenumber % 5) / 4.0",
    "(l_partkey % 9) / 8.0",
    "(l_orderkey % 9) / 8.0",
    "(l_suppkey % 9) / 8.0",
    "(l_linenumber % 9) / 8.0",
)


def _sql_any(text: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {literal(p)})" for p in phrases) + ")"


_STRONGER = " OR ".join(
    f"({_sql_any('lower(original)', weak)} AND len(list_filter(string_split_regex(lower(candidate), '[;.!?]+'), lambda x: {_sql_any('x', strong)} AND NOT {_sql_any('x', reduction.NEGATORS)})) > 0)" for weak, strong in reduction.TRANSITIONS
)


@query(
    f"""SELECT id, round(0.4 * coalesce(meaning, 0) + 0.3 * coalesce(support, 0) + 0.2 * greatest(coalesce(delta, 0), 0) + 0.1 * (1 - coalesce(lexical, 0)), 6) AS score,
               e1 <= e0 + 1e-9 AND l1 <= l0 + 1e-9 AND (e1 < e0 - 1e-9 OR l1 < l0 - 1e-9) AS reduced, {_STRONGER} AS stronger FROM {_REWRITES.sql}"""
)
def rewrite_ranking(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    return _REWRITES.frame(spark, sf).select(
        "id", reduction.candidate_score(c("meaning"), c("support"), c("delta"), c("lexical")).alias("score"), reduction.overlap_reduced((c("e0"), c("l0")), (c("e1"), c("l1"))).alias("reduced"),
        reduction.strengthened(c("original"), c("candidate")).alias("stronger"),
    )


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '10.1000/' || o_orderkey ELSE trim('Order ' || o_orderkey || ' ' || 'Clerk' || (o_orderkey % 9) || ' ' || year(o_orderdate)) END AS q FROM orders"""
)
def bibliography_queries(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey").cast("string")
    doi = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("10.1000/"), k))
    authors = F.concat(F.lit("Clerk"), (F.col("o_orderkey") % 9).cast("string"), F.lit(", A. & Other, B."))
    return table(spark, sf, "orders").select("o_orderkey", verification.bibliography_query(doi, F.concat(F.lit("Order "), k), authors, F.year("o_orderdate")).alias("q"))


@query(
    """WITH c AS (SELECT o_orderkey AS citation_id, o_custkey AS doc_id, o_orderkey % 11 AS p FROM orders), s AS (SELECT l_orderkey, l_linenumber FROM lineitem)
       SELECT citation_id, count(*) AS claims, count(*) > 1 AS ambiguous FROM c JOIN s ON l_orderkey = citation_id GROUP BY citation_id"""
)
def citation_ambiguity(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of an order stand for the claims that one citation could belong to."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("citation_id"))
    rows = o.join(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("citation_id")), "citation_id").groupBy("citation_id").agg(F.count("*").alias("claims"))
    return rows.withColumn("ambiguous", F.col("claims") > 1)


_LINKS = Fixture(
    "doc_id long, paragraph_index long, claim_id long, sentence string, paragraph string",
    [
        (1, 0, 1, "Alpha holds (Smith, 2019).", "Alpha holds (Smith, 2019). Beta follows (Jones, 2020) in part."), (1, 0, 2, "Beta follows (Jones, 2020) in part.", "Alpha holds (Smith, 2019). Beta follows (Jones, 2020) in part."),
        (1, 1, 3, "Gamma [1] is odd.", "Gamma [1] is odd. Gamma [1] again."), (1, 1, 4, "Gamma [1] again.", "Gamma [1] is odd. Gamma [1] again."),
    ],
)
_CITED = Fixture("doc_id long, paragraph_index long, citation_id long, raw_text string, char_offset long", [(1, 0, 1, "(Smith, 2019)", 12), (1, 0, 2, "(Jones, 2020)", 40), (1, 1, 3, "[1]", 6)])


@query(
    f"""WITH j AS (SELECT * FROM {_LINKS.sql} JOIN {_CITED.sql} USING (doc_id, paragraph_index) WHERE contains(sentence, raw_text))
        SELECT doc_id, claim_id, citation_id, CAST(CASE WHEN regexp_matches(substr(sentence, instr(sentence, raw_text) + length(raw_text)), '^[.,;:!?)\\]}}\\s]*$') OR regexp_matches(substr(paragraph, char_offset + 1 + length(raw_text)), '^[.,;:!?)\\]}}\\s]*$') THEN 100 ELSE 80 END AS BIGINT) AS link_confidence,
               count(*) OVER (PARTITION BY doc_id, citation_id) > 1 AS ambiguous FROM j"""
)
def claim_links(spark: SparkSession, sf: str) -> DataFrame:
    return audit.link_claims(_LINKS.frame(spark), _CITED.frame(spark))


_TRUTH = Fixture(
    "truth_id long, suspicious_document string, suspicious_offset long, suspicious_length long, source_document string, source_offset long, source_length long",
    [(1, "s1", 0, 100, "a", 0, 100), (2, "s1", 200, 50, "a", 300, 50), (3, "s2", 0, 10, "b", 0, 10)],
)
_FOUND = Fixture(
    "prediction_id long, suspicious_document string, suspicious_offset long, suspicious_length long, source_document string, source_offset long, source_length long",
    [(1, "s1", 0, 90, "a", 0, 90), (2, "s1", 5, 95, "a", 5, 95), (3, "s1", 210, 60, "a", 310, 60), (4, "s2", 0, 3, "b", 0, 3), (5, "s3", 0, 3, "b", 0, 3)],
)


@query()
def passage_matching(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.match_passages(_TRUTH.frame(spark), _FOUND.frame(spark))


@query()
def citations_found(spark: SparkSession, sf: str) -> DataFrame:
    """Citations with their places, in sentences that carry marks."""
    from inkglass.functions import arrow

    marks = F.concat(F.lit("(Smith & Jones, 2019; Brown, n.d.) and Clark (2001, p. 4) say ["), F.col("l_linenumber").cast("string"), F.lit(", 3-5], see 10.1000/x"), F.col("l_orderkey").cast("string"), F.lit("."))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.explode(arrow.citations(marks)).alias("c"))
    return rows.select("l_orderkey", "l_linenumber", "c.*")


@query()
def protected_sentences(spark: SparkSession, sf: str) -> DataFrame:
    from inkglass.functions import arrow

    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(arrow.sentences(F.col("text"))).alias("sentence_index", "s"))
    return rows.select("doc_id", "sentence_index", F.md5("s.text").alias("sentence"), "s.start", "s.end")


@query()
def evidence_ranked(spark: SparkSession, sf: str) -> DataFrame:
    """The benchmark's passages as abstracts for the claim that is their start."""
    b = table(spark, sf, "benchmark")
    claims = b.select(F.col("item_id").alias("claim_id"), F.col("item_id").alias("query_id"), T.cap_words(F.col("text"), 12).alias("text"))
    return support.evidence(claims, b.select(F.col("item_id").alias("query_id"), F.col("item_id").alias("cand_id"), F.col("text").alias("abstract")))
