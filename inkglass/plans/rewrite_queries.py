"""Queries over edits, prompts and models' replies, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkglass.functions import text as T
from inkglass.operators import edits, rewriting
from inkglass.plans.registry import literal, query
from inkglass.plans.text_queries import sql_sentences
from inkglass.session import table


@query(
    """WITH d AS (SELECT doc_id, text, string_split(text, chr(10))[1] AS l1, string_split(text, chr(10))[2] AS l2 FROM documents WHERE text IS NOT NULL),
       a AS (SELECT *, '<' || l1 || '>' || substr(text, length(l1) + 1) AS t1, length(l1) + 2 AS cur, CASE WHEN l1 = '' THEN 'empty:p1' WHEN instr(substr(text, 2), l1) > 0 THEN 'ambiguous:p1' END AS w1 FROM d),
       b AS (SELECT *, instr(substr(t1, cur + 1), l2) - 1 + cur AS s2 FROM a),
       c AS (SELECT *, coalesce(w1, CASE WHEN l2 = '' THEN 'empty:p2' WHEN instr(substr(t1, s2 + 2), l2) > 0 THEN 'ambiguous:p2' END) AS problem FROM b)
       SELECT doc_id, problem, CASE WHEN problem IS NOT NULL THEN 0 WHEN l2 IS NULL THEN 1 ELSE 2 END::BIGINT AS applied, md5(CASE WHEN problem IS NOT NULL THEN text WHEN l2 IS NULL THEN t1 ELSE substr(t1, 1, s2) || 'x' || substr(t1, s2 + length(l2) + 1) END) AS after, TRUE AS restored FROM c"""
)
def edits_restored(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's first two lines replaced, and put back."""
    docs = table(spark, sf, "documents").where("text is not null").select("doc_id", "text", F.split("text", "\n").alias("l"))
    first = docs.select("doc_id", F.lit("p1").alias("passage_id"), F.col("l")[0].alias("original"), F.concat(F.lit("<"), F.col("l")[0], F.lit(">")).alias("new"))
    second = docs.where(F.size("l") > 1).select("doc_id", F.lit("p2").alias("passage_id"), F.get("l", F.lit(1)).alias("original"), F.lit("x").alias("new"))
    out = edits.edited(docs, first.unionByName(second)).join(docs.select("doc_id", F.col("text").alias("before")), "doc_id")
    return out.select("doc_id", "problem", F.size("applied").cast("long").alias("applied"), F.md5("text").alias("after"), (edits.restore(F.col("text"), F.col("applied")) == F.col("before")).alias("restored"))


_BUDGETS = [256, 280, 320]


@query(
    f"""WITH RECURSIVE p AS (SELECT item_id, b AS budget, {sql_sentences("text")} AS s FROM benchmark, (SELECT unnest({_BUDGETS}) AS b)),
        r(item_id, budget, s, i, used, block) AS (SELECT item_id, budget, s, 0, 0, '' FROM p UNION ALL
          SELECT item_id, budget, s, i + 1, used + length(c), block || CASE WHEN i > 0 THEN chr(10) ELSE '' END || '[' || (i + 1) || '] ' || c FROM (
            SELECT *, CASE WHEN length(s[i + 1]) <= budget - used THEN s[i + 1] ELSE regexp_replace(substr(s[i + 1], 1, budget - used), '\\s+$', '') || ' …' END AS c FROM r WHERE i < len(s) AND used < budget))
        SELECT item_id, CAST(budget AS BIGINT) AS budget, CAST(i AS BIGINT) AS passages, md5(block) AS block FROM r QUALIFY row_number() OVER (PARTITION BY item_id, budget ORDER BY i DESC) = 1"""
)
def prompt_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Each passage's sentences as evidence, at three budgets."""
    rows = table(spark, sf, "benchmark").select("item_id", T.split_sentences(F.col("text")).alias("s"), F.explode(F.array(*map(F.lit, _BUDGETS))).alias("budget"))
    rows = rows.select("item_id", F.col("budget").cast("long").alias("budget"), rewriting.evidence_block(F.col("s"), F.col("budget")).alias("block"))
    return rows.select("item_id", "budget", F.regexp_count("block", F.lit("(?m)^\\[\\d+\\] ")).cast("long").alias("passages"), F.md5("block").alias("block"))


_PLAIN = "[^A-Za-z0-9 .,(){}]"
_HEAD, _TAIL = 'Here it is {0}:\n```json\n{"rewritten_text": "', '", "reason": "as {asked} \\"so\\"", "citation_preserved": '
_SQL_REPLY = f"CASE WHEN kind = 0 THEN NULL WHEN kind = 1 THEN 'I cannot: ' || t WHEN kind = 2 THEN {literal(_HEAD)} || t || {literal(_TAIL)} || '\"yes\", \"warnings\": []}}' WHEN kind = 3 THEN {literal(_HEAD)} || t || ' (Lee, 1850)' || {literal(_TAIL)} || 'true, \"warnings\": [\"w\"]}} {{' ELSE {literal(_HEAD)} || t || {literal(_TAIL)} || 'false, \"warnings\": []}}' END"


@query(
    f"""WITH k AS (SELECT conv_id, turn, regexp_replace(text, '{_PLAIN}', '', 'g') AS t, length(text) % 7 AS kind FROM conversations),
        r AS (SELECT *, {_SQL_REPLY} AS reply, t || CASE WHEN kind = 3 THEN ' (Lee, 1850)' ELSE '' END AS own FROM k),
        s AS (SELECT *, CASE WHEN kind = 0 THEN 'provider_error' WHEN {" OR ".join(f"contains(lower(reply), {literal(m)})" for m in rewriting.REFUSALS)} THEN 'refused' WHEN kind = 2 OR trim(own) = '' OR length(own) > 1000 THEN 'invalid_response'
               WHEN kind = 3 AND NOT list_contains(regexp_extract_all(t, '\\b\\d{{4}}\\b'), '1850') THEN 'invalid_response'
               WHEN len(list_filter(regexp_extract_all(t, '\\([^()]{{1,80}}?,\\s*(\\d{{4}}[a-z]?)\\)', 1), lambda y: NOT list_contains(regexp_extract_all(t, '\\b\\d{{4}}\\b'), y[1:4]))) > 0 THEN 'invalid_response' ELSE 'success' END AS status FROM r)
        SELECT conv_id, turn, status, CASE WHEN status = 'success' THEN md5(trim(own)) END AS rewritten FROM s"""
)
def model_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Turns put into models' replies of several kinds: no reply, a refusal, a
    field of another type, an invented year, and what is in order."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.regexp_replace("text", _PLAIN, "").alias("t"), (F.length("text") % 7).alias("kind"))

    def reply(text, rest: str):
        return F.concat(F.lit(_HEAD), text, F.lit(_TAIL + rest))

    t = F.col("t")
    put = F.when(F.col("kind") == 0, None).when(F.col("kind") == 1, F.concat(F.lit("I cannot: "), t)).when(F.col("kind") == 2, reply(t, '"yes", "warnings": []}'))
    put = put.when(F.col("kind") == 3, reply(F.concat(t, F.lit(" (Lee, 1850)")), 'true, "warnings": ["w"]} {')).otherwise(reply(t, 'false, "warnings": []}'))
    out = rows.select("conv_id", "turn", rewriting.outcome(put, t).alias("o"))
    return out.select("conv_id", "turn", "o.status", F.md5("o.rewritten_text").alias("rewritten"))
