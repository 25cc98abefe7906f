"""Queries over rewrites' meaning, and links between places and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkglass.operators import meaning
from inkglass.plans.registry import Derived, Fixture, literal, query
from inkglass.session import table

_WORDCH = "\\p{L}\\p{N}_"
_PAIRS = "SELECT a.conv_id, a.turn, a.text AS premise, b.text AS hypothesis FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn"


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    """A turn stands for a passage, the next turn for its rewrite."""
    a = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("premise"))
    b = table(spark, sf, "conversations").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hypothesis"))
    return a.join(b, ["conv_id", "turn"])


def _sql_words(c: str) -> str:
    return f"list_distinct(regexp_extract_all(replace(lower({c}), 'ß', 'ss'), '[a-z0-9]+'))"


def _sql_negated(c: str) -> str:
    return f"regexp_matches({c}, '(?i)(^|[^{_WORDCH}])({'|'.join(w.replace(chr(39), chr(39) * 2) for w in meaning.NEGATIONS)})($|[^{_WORDCH}])')"


@query(
    f"""WITH p AS (SELECT conv_id, turn, coalesce(premise, '') AS p, coalesce(hypothesis, '') AS h FROM ({_PAIRS})),
        s AS (SELECT conv_id, turn, len(list_intersect({_sql_words('p')}, {_sql_words('h')})) / nullif(len({_sql_words('h')}), 0) AS share, {_sql_negated('p')} <> {_sql_negated('h')} AS turned FROM p)
        SELECT conv_id, turn, round(CASE WHEN turned THEN least(share, 0.5) ELSE coalesce(share, 0) END, 9) AS score, CASE WHEN turned AND share IS NOT NULL THEN 'contradicted' ELSE 'unknown' END AS verdict
        FROM (SELECT conv_id, turn, share, turned AND share IS NOT NULL AS turned FROM s)"""
)
def entailment_screen(spark: SparkSession, sf: str) -> DataFrame:
    rows = _turns(spark, sf).withColumn("s", meaning.screen(F.col("premise"), F.col("hypothesis")))
    return rows.select("conv_id", "turn", F.round("s.score", 9).alias("score"), "s.verdict")


_LABELS = Derived(
    "id long, raw string",
    [
        (i, x) for i, x in enumerate([
            "ENTAILMENT", "contradiction", "LABEL_0", "label_2 entailment", "neutral", "Non-Entailment", "not entailment", "without any entailment", "Contradicts", "LABEL-1_neutral", "", "unknown", "  Entails ", "entail not",
            "NOT_ENTAILMENT", "label_1 contradictory", "nonentailment",
        ])
    ],
    "events",
    "1000 + event_id",
    "CASE event_id % 3 WHEN 0 THEN 'LABEL_' || (user_id % 3) || ' ' ELSE '' END || CASE user_id % 4 WHEN 0 THEN 'Not_' WHEN 1 THEN 'non-' ELSE '' END || CASE event_id % 5 WHEN 0 THEN 'ENTAILMENT' WHEN 1 THEN 'contradiction' WHEN 2 THEN 'Neutral' WHEN 3 THEN 'entailed' ELSE event_type END",
)


@query(
    f"""WITH n AS (SELECT id, regexp_replace(trim(translate(lower(raw), '_-', '  ')), '^label\\s+\\d+\\s*', '') AS s FROM {_LABELS.sql})
        SELECT id, CASE WHEN contains(s, 'contradict') THEN 'contradicted' WHEN contains(s, 'neutral') OR NOT contains(s, 'entail') OR regexp_matches(s, '\\b(non|not|no|without)\\b.*\\bentail') THEN 'unknown' ELSE 'meaning_preserved' END AS verdict FROM n"""
)
def model_labels(spark: SparkSession, sf: str) -> DataFrame:
    return _LABELS.frame(spark, sf).select("id", meaning.model_label(F.col("raw")).alias("verdict"))


_FORWARD = {"A": "meaning_preserved", "N": "partially_supported", "R": "contradicted"}
_BACKWARD = {"F": "supported", "O": "unrelated"}


def _sql_case(c: str, values: dict[str, str]) -> str:
    return f"CASE {c} {' '.join(f'WHEN {literal(k)} THEN {literal(v)}' for k, v in values.items())} END"


@query(
    f"""WITH l AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount * 10 END AS s, l_tax * 12 AS f, l_quantity / 50 AS b, {_sql_case('l_returnflag', _FORWARD)} AS fv, {_sql_case('l_linestatus', _BACKWARD)} AS bv FROM lineitem),
        v AS (SELECT *, CASE WHEN fv = 'contradicted' THEN 'contradicted' WHEN coalesce(s >= 0.3, FALSE) AND fv IN ('meaning_preserved', 'partially_supported') AND bv = 'supported' AND f >= 0.2 AND b >= 0.2 THEN 'meaning_preserved' ELSE 'insufficient_information' END AS verdict,
              concat_ws('; ', CASE WHEN s IS NULL THEN 'no semantic model' END, CASE WHEN s < 0.3 THEN 'semantic similarity is too low' END, CASE WHEN fv = 'contradicted' THEN 'the original contradicts the rewrite' END,
                        CASE WHEN f < 0.2 THEN 'forward entailment is too low' END, CASE WHEN b < 0.2 THEN 'backward entailment is too low' END) AS why FROM l)
        SELECT l_orderkey, l_linenumber, verdict, round(CASE WHEN s IS NULL THEN (f + b) / 2 ELSE (s + f + b) / 3 END, 6) AS score,
               CASE WHEN verdict = 'meaning_preserved' THEN '' WHEN why = '' THEN 'meaning was not shown to be preserved' ELSE why END AS reasons FROM v"""
)
def meaning_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Lines stand for rewrites, their figures for a model's scores."""

    def mapped(c: str, values: dict[str, str]) -> Column:
        out = F.lit(None).cast("string")
        for k, v in values.items():
            out = F.when(F.col(c) == k, v).otherwise(out)
        return out

    f = F.struct((F.col("l_tax") * 12).alias("score"), mapped("l_returnflag", _FORWARD).alias("verdict"))
    b = F.struct((F.col("l_quantity") / 50).alias("score"), mapped("l_linestatus", _BACKWARD).alias("verdict"))
    rows = table(spark, sf, "lineitem").withColumn("m", meaning.validated(F.when(F.col("l_linenumber") != 7, F.col("l_discount") * 10), f, b, 0.3, 0.2))
    return rows.select("l_orderkey", "l_linenumber", "m.verdict", F.round("m.score", 6).alias("score"), F.array_join("m.reasons", "; ").alias("reasons"))


def _sql_pieces(c: str) -> str:
    return f"string_split(regexp_replace(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"


def _sql_clauses(c: str) -> str:
    """Whole words are marked, the mark of an "and" becomes a cut."""
    return f"string_split(replace(regexp_replace(regexp_replace({c}, '([{_WORDCH}]+)', chr(1) || '\\1' || chr(1), 'g'), chr(1) || '(?i:and)' || chr(1), chr(2), 'g'), chr(1), ''), chr(2))"


_ADDED = f"""p AS (SELECT conv_id, turn, coalesce(premise, '') AS o, coalesce(hypothesis, '') AS c FROM ({_PAIRS})),
    m AS (SELECT conv_id, turn, list_filter(list_transform({_sql_pieces('c')}[len({_sql_pieces('o')}) + 1:] || {_sql_clauses('c')}[len({_sql_clauses('o')}) + 1:], lambda x: trim(x, ' .')), lambda x: x <> '') AS a FROM p)"""


@query(f"WITH {_ADDED}, u AS (SELECT conv_id, turn, unnest(a) AS x, generate_subscripts(a, 1) AS i FROM m), d AS (SELECT conv_id, turn, x, min(i) AS i FROM u GROUP BY ALL) SELECT conv_id, turn, count(*) AS n, string_agg(x, ' | ' ORDER BY i) AS assertions FROM d GROUP BY conv_id, turn")
def new_assertions(spark: SparkSession, sf: str) -> DataFrame:
    rows = _turns(spark, sf).withColumn("a", meaning.new_assertions(F.col("premise"), F.col("hypothesis"))).where(F.size("a") > 0)
    return rows.select("conv_id", "turn", F.size("a").cast("long").alias("n"), F.array_join("a", " | ").alias("assertions"))


@query(
    f"""WITH {_ADDED}, x AS (SELECT DISTINCT conv_id, turn, unnest(a) AS assertion FROM m),
        e AS (SELECT x.conv_id, x.turn, x.assertion FROM x JOIN conversations t ON t.conv_id = x.conv_id AND t.turn IN (x.turn - 1, x.turn)
              WHERE len(list_intersect({_sql_words("coalesce(t.text, '')")}, {_sql_words('assertion')})) / nullif(len({_sql_words('assertion')}), 0) >= 0.5)
        SELECT conv_id, turn, assertion FROM x WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.conv_id = x.conv_id AND e.turn = x.turn AND e.assertion = x.assertion)"""
)
def unsupported_assertions(spark: SparkSession, sf: str) -> DataFrame:
    """The passage and the turn before it are evidence; half of an assertion's
    words back it."""
    key = F.struct("conv_id", "turn").alias("passage_id")
    rewrites = _turns(spark, sf).select(key, F.col("premise").alias("original"), F.col("hypothesis").alias("candidate"))
    t = table(spark, sf, "conversations")
    evidence = t.select(key, "text").unionByName(t.withColumn("turn", F.col("turn") + 1).select(key, "text"))

    def judge(premise: Column, hypothesis: Column) -> Column:
        s = meaning.screen(premise, hypothesis)["score"]
        share = F.size(F.array_intersect(meaning.folded_tokens(premise), meaning.folded_tokens(hypothesis))) / F.nullif(F.size(meaning.folded_tokens(hypothesis)), F.lit(0))
        return F.struct(s.alias("score"), F.when(share >= 0.5, "supported").otherwise("unknown").alias("verdict"))

    return meaning.unsupported(rewrites, evidence, judge).select("passage_id.conv_id", "passage_id.turn", "assertion")
