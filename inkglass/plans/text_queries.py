"""Queries over texts, sentences and claims, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkglass.functions import claims as C
from inkglass.functions import text as T
from inkglass.operators import corpus, support
from inkglass.plans.registry import Derived, Fixture, literal, query
from inkglass.session import table


def sql_sentences(c: str) -> str:
    split = f"string_split(regexp_replace({c}, '([.!?])\\s+([A-ZÇĞİÖŞÜ])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"
    return f"list_filter(list_transform({split}, lambda x: trim(x)), lambda x: length(x) > 0)"


def sql_collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def sql_fold(c: str) -> str:
    return f"lower(translate({c}, 'İI', 'iı'))"


def sql_sentence(c: str) -> str:
    return sql_collapse(sql_fold(c))


def sql_words(c: str) -> str:
    return f"list_filter(string_split({sql_collapse(c)}, ' '), lambda x: length(x) > 0)"


def sql_tokens(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '[a-z0-9]+')"


@query(
    """SELECT sha256(n) AS hash, count(*) AS n, min(doc_id) AS first_doc
       FROM (SELECT doc_id, """ + sql_sentence("text") + """ AS n FROM documents) GROUP BY n HAVING count(*) > 1"""
)
def exact_doc_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", F.sha2(T.normalize_sentence(F.col("text")), 256).alias("hash"))
    return corpus.duplicate_groups(rows)


@query(
    """SELECT doc_id, entry_index, hash FROM (
         SELECT *, row_number() OVER (PARTITION BY hash ORDER BY doc_id, entry_index) AS rn FROM (
           SELECT doc_id, CAST(i AS BIGINT) AS entry_index, sha256(""" + sql_sentence("s[i + 1]") + """) AS hash
           FROM (SELECT doc_id, """ + sql_sentences("text") + """ AS s FROM documents), LATERAL (SELECT unnest(range(len(s))) AS i))) WHERE rn = 1"""
)
def dedup_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(T.split_sentences(F.col("text"))).alias("entry_index", "s"))
    return corpus.dedup_first(rows.select("doc_id", F.col("entry_index").cast("long").alias("entry_index"), F.sha2(T.normalize_sentence(F.col("s")), 256).alias("hash")))


_BLANK_LINES = "regexp_replace(text, '\\.\\n', '.' || chr(10) || chr(10), 'g')"


@query(
    f"""SELECT doc_id, CAST(i AS BIGINT) AS paragraph_index, array_to_string(list_filter(list_transform(string_split(b[i + 1], chr(10)), lambda x: trim(x)), lambda x: length(x) > 0), ' ') AS text
        FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array({_BLANK_LINES}, '\\n\\s*\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) > 0) AS b FROM documents),
             LATERAL (SELECT unnest(range(len(b))) AS i)"""
)
def paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that end a sentence are taken to end a paragraph."""
    text = F.regexp_replace("text", "\\.\\n", ".\n\n")
    return table(spark, sf, "documents").select("doc_id", F.posexplode(T.paragraphs(text)).alias("paragraph_index", "text")).withColumn("paragraph_index", F.col("paragraph_index").cast("long"))


@query(
    f"""SELECT doc_id, CAST(i AS BIGINT) AS sentence_index, s[i + 1] AS sentence
        FROM (SELECT doc_id, {sql_sentences("text")} AS s FROM documents), LATERAL (SELECT unnest(range(len(s))) AS i)"""
)
def sentences_plain(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(T.split_sentences(F.col("text"))).alias("sentence_index", "sentence"))
    return rows.withColumn("sentence_index", F.col("sentence_index").cast("long"))


@query(
    f"""SELECT item_id, x AS sentence FROM (SELECT item_id, unnest(list_filter({sql_sentences("text")}, lambda s: len({sql_words("s")}) >= 2)) AS x FROM benchmark)"""
)
def evidence_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", F.explode(support.evidence_sentences(F.col("text"))).alias("sentence"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[\\p{L}\\p{N}]+(?:[''’][\\p{L}\\p{N}]+)?')) AS BIGINT) AS n_words FROM documents")
def word_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.size(T.words(F.col("text"))).cast("long").alias("n_words"))


@query(f"SELECT doc_id, md5({sql_sentence('text')}) AS normalized, md5({sql_sentence('text')}) AS plain FROM documents")
def normalized_text(spark: SparkSession, sf: str) -> DataFrame:
    """The sentence form, and the typographic form's, which is the same here."""
    return table(spark, sf, "documents").select("doc_id", F.md5(T.normalize_sentence(F.col("text"))).alias("normalized"), F.md5(T.normalize_turkish(F.col("text"))).alias("plain"))


@query(
    """SELECT doc_id, md5(regexp_replace(""" + sql_fold("""regexp_replace(regexp_replace(trim(t), '\\[\\d+(?:\\s*[-–,]\\s*\\d+)*\\]', '', 'g'), '\\([A-ZÇĞİÖŞÜ][\\p{L}''’-]*(?:\\s+et\\s+al\\.)?,\\s*\\d{4}\\)', '', 'g')""") + """, '\\s+', ' ', 'g')) AS normalized, length(t) AS n
       FROM (SELECT doc_id, replace(text, '. ', ' [' || doc_id || ', 2-4] (Smith et al., 2020). ') AS t FROM documents)"""
)
def corpus_normalized(spark: SparkSession, sf: str) -> DataFrame:
    """Citation marks are put in, for there are none, and must go again."""
    marks = F.concat(F.lit(" ["), F.col("doc_id").cast("string"), F.lit(", 2-4] (Smith et al., 2020). "))
    rows = table(spark, sf, "documents").select("doc_id", F.replace("text", F.lit(". "), marks).alias("t"))
    return rows.select("doc_id", F.md5(T.normalize_corpus(F.col("t"))).alias("normalized"), F.length("t").cast("long").alias("n"))


@query(
    "SELECT doc_id, md5(regexp_replace('1.2 Methods and data' || chr(10) || text, '(?m)^\\d+(?:\\.\\d+)*\\.?[ \\t]+[A-ZÇĞİÖŞÜ].*$', '', 'g')) AS stripped FROM documents"
)
def section_headers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(T.strip_section_headers(F.concat(F.lit("1.2 Methods and data\n"), "text"))).alias("stripped"))


@query(
    "SELECT doc_id, CASE WHEN length(regexp_replace(text, '[^çğıöşüÇĞİÖŞÜ]', '', 'g')) / greatest(length(text), 1) > 0.005 THEN 'tr' ELSE 'en' END AS language FROM documents"
)
def lang_detect(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.language(F.col("text")).alias("language"))


_HTML = "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b[^>]*>.*?</style\\s*>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g')"
for _entity, _mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _HTML = f"replace({_HTML}, '{_entity}', '{_mark}')"


@query(f"SELECT page_id, {sql_collapse(_HTML)} AS text FROM pages")
def html_to_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.strip_html(F.col("html")).alias("text"))


@query(
    """SELECT page_id, regexp_extract(url, '^(?:https?)://(?:[^/@]*@)?([^/:?#]+)', 1) AS host FROM pages
       WHERE regexp_matches(lower(url), '^https?://') AND NOT regexp_matches(lower(regexp_extract(url, '^(?:https?)://(?:[^/@]*@)?([^/:?#]+)', 1)), '^(?:localhost|127\\.|10\\.|192\\.168\\.|169\\.254\\.|172\\.(?:1[6-9]|2\\d|3[01])\\.|0\\.)')"""
)
def allowed_pages(spark: SparkSession, sf: str) -> DataFrame:
    from inkglass.sources.files import allowed_url

    return table(spark, sf, "pages").where(allowed_url(F.col("url"))).select("page_id", F.try_parse_url("url", F.lit("HOST")).alias("host"))


def _claim_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").where(~C.not_a_claim(F.col("text")))
    return rows.select("conv_id", "turn", F.posexplode(T.split_sentences(F.col("text"))).alias("i", "sentence")).where(C.is_claim(F.col("sentence")))


def _sql_signal(kind: str, pattern: str) -> str:
    pattern = pattern.replace("[\\p{L}\\p{N}_]*", "[\\p{L}\\p{N}_]*")
    return f"WHEN regexp_matches(sentence, {literal(pattern)}) THEN '{kind}'"


_NOT_CLAIM = f"""(trim(text) = '' OR starts_with(trim(text), '#') OR starts_with(trim(text), '(*)') OR starts_with(trim(text), '(**)')
  OR (length(regexp_replace(trim(text), '[^\\p{{L}}]', '', 'g')) >= 4 AND regexp_replace(trim(text), '[^\\p{{L}}]', '', 'g') = upper(regexp_replace(trim(text), '[^\\p{{L}}]', '', 'g')))
  OR regexp_matches(trim(text), {literal(C.FORM_LABEL)}) OR regexp_matches(trim(text), {literal(C.INSTRUCTION)}) OR regexp_matches(trim(text), {literal(C.DECISION)})
  OR (regexp_matches(trim(text), {literal(C.FORM_CONTEXT)}) AND regexp_matches(trim(text), {literal(C.DIRECTIVE)}))
  OR len({sql_words("text")}) < 5)"""
_CLAIMS = f"""SELECT conv_id, turn, CAST(i AS BIGINT) AS sentence_index, s[i + 1] AS sentence
  FROM (SELECT conv_id, turn, {sql_sentences("text")} AS s FROM conversations WHERE NOT {_NOT_CLAIM}), LATERAL (SELECT unnest(range(len(s))) AS i)
  WHERE len({sql_words("s[i + 1]")}) >= 4"""
_TYPE = "CASE " + " ".join(_sql_signal(k, p) for k, p in C.SIGNALS) + " ELSE 'general_fact' END"
_STOP = literal(T.STOP_WORDS)
_CLEAN = sql_words("regexp_replace(sentence, '[^\\p{L}\\p{N}_\\s]', ' ', 'g')")


@query(
    f"""SELECT conv_id, turn, sentence_index, claim_type,
               CASE WHEN claim_type IN ('statistic', 'causal', 'quotation') THEN 'high' WHEN claim_type IN ('comparative', 'historical', 'definition') THEN 'medium' ELSE 'low' END AS severity
        FROM (SELECT *, {_TYPE} AS claim_type FROM ({_CLAIMS}))"""
)
def claims_typed(spark: SparkSession, sf: str) -> DataFrame:
    rows = _claim_rows(spark, sf).withColumn("claim_type", C.claim_type(F.col("sentence")))
    return rows.select("conv_id", "turn", F.col("i").cast("long").alias("sentence_index"), "claim_type", C.severity(F.col("claim_type")).alias("severity"))


@query(
    f"""SELECT conv_id, turn, sentence_index,
               CASE WHEN len({sql_words("sentence")}) > 25 THEN array_to_string(({sql_words("sentence")})[1:25], ' ') || '...' ELSE sentence END AS claim,
               CASE WHEN len(m) > 0 THEN array_to_string(m[1:12], ' ') ELSE array_to_string(w[1:8], ' ') END AS search_query
        FROM (SELECT *, {_CLEAN} AS w, list_filter({_CLEAN}, lambda x: NOT list_contains({_STOP}, lower(x)) AND length(x) > 2) AS m FROM ({_CLAIMS}))"""
)
def claim_texts(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("sentence")
    return _claim_rows(spark, sf).select("conv_id", "turn", F.col("i").cast("long").alias("sentence_index"), T.cap_words(s).alias("claim"), T.search_query(s).alias("search_query"))


_SENTENCES = Derived(
    "id long, sentence string",
    [
        (1, "Smoking causes lung cancer in adults."), (2, "The rate was higher than the control group."), (3, "About 45 percent of patients improved."), (4, 'He said "all swans are white" in the talk.'),
        (5, "Previous research found no effect here."), (6, "The model was introduced in the nineties."), (7, "Entropy is defined as the log of states."), (8, "Water boils when it is heated enough."),
        (9, "Bu yöntem daha yüksek doğruluk verir."), (10, "Yağış sel baskınına neden olmaktadır ve artar."), (11, "We decided to drop the last column."), (12, "Please note that results vary by site."),
        (13, "Growth reached 3.5 million units over 2 years."), (14, "It correlates with income and is associated with age."), (15, "SHOUTED HEADINGS ARE NOT CLAIMS AT ALL"), (16, "# A heading is no claim either way"),
    ],
    "conversations",
    "1000 + conv_id * 1000 + turn",
    "text",
)


@query(
    f"""SELECT id, {_TYPE} AS claim_type, NOT {_NOT_CLAIM.replace("text", "sentence")} AS is_claim FROM {_SENTENCES.sql}"""
)
def claim_signals(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("sentence")
    return _SENTENCES.frame(spark, sf).select("id", C.claim_type(s).alias("claim_type"), (~C.not_a_claim(s)).alias("is_claim"))


_IDS = Derived(
    "id long, raw string",
    [
        (1, "doi: 10.1000/XYZ-123."), (2, "https://doi.org/10.5555/abc(12)"), (3, "arXiv:2101.01234v2"), (4, "https://arxiv.org/pdf/1706.03762.pdf"), (5, "hep-th/9901001"), (6, "no identifier"), (7, "10.12/short"),
        (8, "see 10.1016/j.cell.2020.01.001]; and more"), (9, None),
    ],
    "pages",
    "1000 + page_id",
    "CASE page_id % 6 WHEN 0 THEN 'doi: 10.1000/P-' || page_id || '.' WHEN 1 THEN 'https://arxiv.org/pdf/17' || (10 + page_id % 80) || '.0' || (1000 + page_id % 9000) || '.pdf' WHEN 2 THEN url WHEN 3 THEN 'See https://doi.org/10.5555/(' || page_id || ')]' WHEN 4 THEN 'hep-th/' || (1000000 + page_id) ELSE 'arXiv:2101.' || (10000 + page_id % 9000) || 'v2' END",
)


@query(
    f"""SELECT id, CASE WHEN regexp_extract(raw, '(?i)\\b10\\.\\d{{4,9}}/[-._;()/:A-Z0-9]+') <> '' THEN lower(regexp_replace(regexp_extract(raw, '(?i)\\b10\\.\\d{{4,9}}/[-._;()/:A-Z0-9]+'), '[.,;:)\\]}}>]+$', '')) END AS doi,
               CASE WHEN regexp_extract(regexp_replace(trim(raw), '(?i)\\.pdf$', ''), '(?i)(?:arxiv:|arxiv\\.org/(?:abs|pdf)/)?([a-z.-]+/\\d{{7}}|\\d{{4}}\\.\\d{{4,5}})', 1) <> ''
                    THEN lower(regexp_extract(regexp_replace(trim(raw), '(?i)\\.pdf$', ''), '(?i)(?:arxiv:|arxiv\\.org/(?:abs|pdf)/)?([a-z.-]+/\\d{{7}}|\\d{{4}}\\.\\d{{4,5}})', 1)) END AS arxiv
        FROM {_IDS.sql}"""
)
def identifiers(spark: SparkSession, sf: str) -> DataFrame:
    return _IDS.frame(spark, sf).select("id", T.normalize_doi(F.col("raw")).alias("doi"), T.normalize_arxiv(F.col("raw")).alias("arxiv"))


@query("SELECT p_partkey, array_to_string(regexp_extract_all(lower(p_name || ': ' || p_brand || '!'), '[a-z0-9]+'), ' ') AS title FROM part")
def title_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", T.normalize_title(F.concat("p_name", F.lit(": "), "p_brand", F.lit("!"))).alias("title"))


_LICENSES = Derived(
    "id long, license_text string",
    [(1, "CC-BY"), (2, " cc_by-sa-4.0 "), (3, "Public Domain"), (4, "All Rights Reserved"), (5, "GPL"), (6, None), (7, "CC BY"), (8, "cc-by-nd"), (9, "OA"), (10, "CC0-1.0"), (11, "cc-by-nc-sa"), (12, "")],
    "documents",
    "1000 + doc_id",
    "CASE doc_id % 9 WHEN 0 THEN 'CC-BY' WHEN 1 THEN ' cc_by-nc ' WHEN 2 THEN 'PD' WHEN 3 THEN lang WHEN 4 THEN 'Open Access' WHEN 5 THEN 'CC0-1.0' WHEN 6 THEN source WHEN 7 THEN 'cc-by-nd-4.0' END",
)
_ALIAS_SQL = ", ".join(f"({literal(a)}, {literal(n)})" for a, n in sorted({**corpus.ALIASES, **{e.lower(): e for e in corpus.ELEMENTS}, **{f"{e.lower()}-4.0": e for e in corpus.ELEMENTS}}.items()))


@query(
    f"""SELECT id, license, license IN {tuple(corpus.OPEN)} AS similarity_index_allowed, license IN {tuple(corpus.TRAINING)} AS training_use_allowed, license IN {tuple(corpus.COMMERCIAL)} AS commercial_use_allowed
        FROM (SELECT id, coalesce(l, 'unknown') AS license FROM {_LICENSES.sql} AS f LEFT JOIN (VALUES {_ALIAS_SQL}) AS a(k, l) ON replace(lower(trim(license_text)), '_', '-') = k)"""
)
def license_flags(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.with_license(_LICENSES.frame(spark, sf)).drop("license_text")


@query(
    f"""SELECT doc_id, CAST(i AS BIGINT) AS sentence_index, CAST(coalesce(sum(length(s[i + 1])) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_offset
        FROM (SELECT doc_id, {sql_sentences("text")} AS s FROM documents), LATERAL (SELECT unnest(range(len(s))) AS i)"""
)
def running_offsets(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(T.split_sentences(F.col("text"))).alias("i", "s"))
    return rows.select("doc_id", F.col("i").cast("long").alias("sentence_index"), corpus.cursor(F.length("s"), ["doc_id"], ["i"]).alias("char_offset"))


_PAIRS = Derived(
    "id long, claim string, evidence string",
    [
        (1, "Coffee lowers the risk of stroke", "Coffee did not lower the risk of stroke in this cohort"), (2, "Coffee lowers the risk of stroke", "Coffee lowers the risk of stroke among adults"),
        (3, "Coffee lowers the risk of stroke", "Tea is grown in hills without shade"), (4, "Coffee lowers the risk of stroke", "Bridges carry the trains"), (5, "", "Nothing to compare"), (6, "Alpha beta gamma delta", "alpha beta epsilon"),
    ],
    "orders",
    "1000 + o_orderkey",
    "'Coffee lowers the risk of stroke ' || (o_custkey % 3)",
    "CASE o_orderkey % 4 WHEN 0 THEN 'Coffee did not lower the risk of stroke ' || (o_custkey % 2) WHEN 1 THEN 'Coffee lowers the risk ' || (o_custkey % 3) WHEN 2 THEN 'Tea has no effect on risk' ELSE 'Bridges carry trains' END",
)
_N = f"regexp_matches(evidence, {literal(C.NEGATION)})"


@query(
    f"""SELECT id, CASE WHEN n = 0 OR neg OR share <= 0.5 THEN 'insufficient_information' ELSE 'partially_supported' END AS verdict,
          CAST(CASE WHEN n = 0 THEN 0 WHEN neg AND share > 0.3 THEN least(round_even(50 + share * 35, 0), 85) WHEN neg THEN least(round_even(20 + share * 30, 0), 50)
               WHEN share > 0.5 THEN least(round_even(30 + share * 50, 0), 75) ELSE round_even(share * 40, 0) END AS BIGINT) AS confidence
        FROM (SELECT id, {_N} AS neg, len(list_distinct({sql_tokens("claim")})) AS n,
                     len(list_intersect(list_distinct({sql_tokens("claim")}), list_distinct({sql_tokens("evidence")}))) / nullif(len(list_distinct({sql_tokens("claim")})), 0) AS share FROM {_PAIRS.sql})"""
)
def evidence_negation(spark: SparkSession, sf: str) -> DataFrame:
    return _PAIRS.frame(spark, sf).select("id", C.contradiction_risk(F.col("claim"), F.col("evidence")).alias("r")).select("id", "r.verdict", "r.confidence")
