"""Audit: claims' links, metrics, health, review queue, exit code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkglass.functions import text as T
from inkglass.operators.links import WEAK

PASS = 80
RATIOS = ["citation_coverage", "verification_ratio", "support_ratio", "bibliography_consistency", "evidence_coverage"]
# Weights of the ratios in the health score, and what each finding costs.
WEIGHTS = {"citation_coverage": 25, "verification_ratio": 25, "support_ratio": 20, "bibliography_consistency": 10, "evidence_coverage": 20}
COSTS = {"uncited_high": 2, "contradictions": 4, "unresolved_high": 2}


def health_score() -> Column:
    """0 to 100 from the ratios' and findings' columns; null where a ratio is
    unavailable; a ratio outside 0 to 1 is an error."""
    score = sum((F.col(c) * w for c, w in WEIGHTS.items()), F.lit(0.0))  # term by term: another order of sums may end on the other side of a half
    for c, w in COSTS.items():
        score = score - F.col(c) * w
    outside = F.lit(False)
    for c in RATIOS:
        outside = outside | F.coalesce(~F.col(c).between(0, 1), F.lit(False))
    clamped = F.when(score.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), T.half_even(score))))
    return F.when(outside, F.raise_error(F.lit("ratios must be between 0 and 1")).cast("long")).otherwise(clamped).cast("long")


def product_ratios(df: DataFrame) -> DataFrame:
    """The five ratios from counts; null means unavailable, never whole."""
    some = F.col("cited_evaluated") > 0
    consistency = 1 - F.col("bibliography_issues") / F.greatest(F.col("bibliography_entries") + F.col("distinct_citations"), F.lit(1))
    df = df.withColumns({
        "citation_coverage": F.when(F.col("total_claims") > 0, F.col("cited_claims") / F.nullif("total_claims", F.lit(0))).otherwise(1.0),
        "verification_ratio": F.when(F.col("bib_total") <= 0, 1.0).when(F.col("bib_evaluated") > 0, F.col("verified_citations") / F.nullif("bib_evaluated", F.lit(0))),
        "support_ratio": F.when(some, F.col("supported_cited_claims") / F.nullif("cited_evaluated", F.lit(0))),
        "evidence_coverage": F.when(some, F.col("cited_with_evidence") / F.nullif("cited_evaluated", F.lit(0))),
        "bibliography_consistency": F.greatest(F.lit(0.0), F.least(F.lit(1.0), consistency)),
    })
    return df.withColumn("health_score", health_score()).withColumn("health_score_complete", F.col("health_score").isNotNull())


def legacy_ratios(results: DataFrame, claims: DataFrame, issues: int) -> DataFrame:
    """The older metrics: consistency over claims, empty sets count as whole."""
    verified = F.col("status") == "verified"

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / F.nullif(whole, F.lit(0))).otherwise(1.0)

    r = results.agg(
        F.count("*").alias("n"), F.count(F.when(verified, 1)).alias("v"), F.count(F.when(F.col("verdict").isin("supported", "partially_supported"), 1)).alias("s"),
        F.count(F.when(verified & F.col("has_evidence"), 1)).alias("e"), F.count(F.when(F.col("verdict") == "contradicted", 1)).alias("contradictions"),
        F.count(F.when(~verified & (F.col("severity") == "high"), 1)).alias("unresolved_high"),
    )
    c = claims.agg(F.count("*").alias("total"), F.count(F.when(F.col("cited"), 1)).alias("cited"), F.count(F.when(~F.col("cited") & (F.col("severity") == "high"), 1)).alias("uncited_high"))
    both = c.join(F.broadcast(r))  # one row each
    return both.select(
        share(F.col("cited"), F.col("total")).alias("citation_coverage"), share(F.col("v"), F.col("n")).alias("verification_ratio"), share(F.col("s"), F.col("n")).alias("support_ratio"),
        share(F.col("e"), F.col("v")).alias("evidence_coverage"), F.greatest(F.lit(0.0), 1 - F.lit(issues) / F.greatest(F.col("total"), F.lit(1))).alias("bibliography_consistency"),
        "uncited_high", "contradictions", "unresolved_high",
    )


def severity_weight(c: Column) -> Column:
    return F.when(c == "high", 3).when(c == "medium", 2).otherwise(1)


def priority(severity: Column, confidence: Column) -> Column:
    return (severity_weight(severity) * 100 + (100 - F.coalesce(confidence, F.lit(0)))).cast("long")


def queue_group(kind: Column, summary: Column, severity: Column) -> Column:
    """0 to 5; null for what needs no review."""
    grave = F.when(severity.isin("high", "medium"), 1).otherwise(4)
    uncited = F.when(severity == "high", 2).when(severity == "medium", 3).otherwise(4)
    cited = F.when(summary.isin("contradicted", "mixed"), 0).when(summary != "supported", grave)
    return F.when(kind == "cited", cited).when(kind == "uncited", uncited).otherwise(5)


def review_queue(items: DataFrame) -> DataFrame:
    """(doc_id, position, ...) over (doc_id, seq, kind, summary, severity,
    confidence): by group, severity, lower confidence (none first), arrival;
    informational items by severity and arrival alone."""
    rows = items.withColumn("group", queue_group(F.col("kind"), F.col("summary"), F.col("severity"))).where("group is not null")
    risk = F.when(F.col("group") < 5, F.coalesce("confidence", F.lit(-1))).otherwise(F.col("seq"))
    w = Window.partitionBy("doc_id").orderBy("group", severity_weight(F.col("severity")).desc(), risk, "seq")
    return rows.withColumn("position", F.row_number().over(w).cast("long")).withColumn("group", F.col("group").cast("long"))


def exit_code(command: Column, phase_failed: Column, score: Column) -> Column:
    return F.when(phase_failed, 3).when(command != "check", 0).when(score.isNull() | (score < PASS), 1).otherwise(0).cast("long")


def link_claims(claims: DataFrame, citations: DataFrame) -> DataFrame:
    """Citations whose text stands in a claim's sentence, over (doc_id,
    paragraph_index, claim_id, sentence, paragraph) and (doc_id,
    paragraph_index, citation_id, raw_text, char_offset): confidence 100 where
    the citation ends its sentence or paragraph, else 80, and whether it could
    belong to several claims."""
    rows = claims.join(citations, ["doc_id", "paragraph_index"]).where(F.contains("sentence", "raw_text"))
    closing = "^[.,;:!?)\\]}\\s]*$"
    tail = F.expr("substring(sentence, instr(sentence, raw_text) + length(raw_text))")
    after = F.expr("substring(paragraph, char_offset + 1 + length(raw_text))")
    final = tail.rlike(closing) | after.rlike(closing)
    several = F.count("*").over(Window.partitionBy("doc_id", "citation_id")) > 1
    return rows.select("doc_id", "claim_id", "citation_id", F.when(final, 100).otherwise(80).cast("long").alias("link_confidence"), several.alias("ambiguous"))


def metric_counts(claims: DataFrame, sources: DataFrame, references: DataFrame, suggestions: DataFrame, issues: DataFrame, citations: DataFrame, weak: int = WEAK) -> DataFrame:
    """What ``product_ratios`` reads, a row for each document with claims, over
    claims (doc_id, claim_id, cited, severity), their sources (doc_id, claim_id,
    evaluated, verdict, evidence, confidence), references (doc_id, status,
    evaluated), suggestions (doc_id, confidence), issues (doc_id) and citations
    (doc_id, raw_text). Each table is summed up by document before it is joined."""

    def n(c: Column, name: str) -> Column:
        return F.count(F.when(c, 1)).alias(name)

    high, cited, used = F.col("severity") == "high", F.col("cited"), F.col("evaluated")
    asserted = F.bool_or(used & F.col("verdict").isin("supported", "partially_supported"))
    each = sources.groupBy("doc_id", "claim_id").agg(
        F.bool_or(used).alias("used"), F.bool_or(used & F.col("evidence")).alias("evidence"), F.coalesce(asserted, F.lit(False)).alias("backed"),
        n(used & (F.col("verdict") == "contradicted"), "against"), n(used & (F.col("confidence") < weak), "weak"),
    )
    own = claims.join(each, ["doc_id", "claim_id"], "left").groupBy("doc_id").agg(
        F.count("*").alias("total_claims"), n(cited, "cited_claims"), n(~cited & high, "uncited_high"), n(F.col("used"), "cited_evaluated"), n(F.col("evidence"), "cited_with_evidence"), n(F.col("backed"), "supported_cited_claims"),
        F.coalesce(F.sum("against"), F.lit(0)).alias("contradictions"), F.coalesce(F.sum("weak"), F.lit(0)).alias("weak_cited_source_matches"), n(high & ~F.col("backed"), "unresolved_high"),
    )
    parts = [
        references.groupBy("doc_id").agg(F.count("*").alias("bib_total"), n(used, "bib_evaluated"), n(F.col("status") == "verified", "verified_citations"), n(F.col("status") == "partially_verified", "partially_verified")),
        suggestions.groupBy("doc_id").agg(n(F.col("confidence") < weak, "weak_suggestions")),
        issues.groupBy("doc_id").agg(F.count("*").alias("bibliography_issues")),
        citations.where(F.trim("raw_text") != "").groupBy("doc_id").agg(F.count_distinct(F.trim("raw_text")).alias("distinct_citations")),
    ]
    for p in parts:
        own = own.join(p, "doc_id", "left")
    own = own.fillna(0, [c for p in parts for c in p.columns if c != "doc_id"])
    return own.withColumn("bibliography_entries", F.col("bib_total"))


def product_summary(counts: DataFrame) -> DataFrame:
    """Counts, ratios to three places, the score, and the names of the ratios
    that are unavailable."""
    df = product_ratios(counts)
    missing = F.array_compact(F.array(*(F.when(F.col(c).isNull(), c) for c in ("verification_ratio", "support_ratio", "evidence_coverage"))))
    df = df.withColumn("unavailable_metrics", missing).withColumns({c: F.bround(c, 3) for c in RATIOS})
    return df.withColumns({"claims_requiring_citations": F.col("total_claims") - F.col("cited_claims"), "unresolved_citations": F.col("bib_total") - F.col("verified_citations")})


def similarity_summary(sentences: DataFrame) -> DataFrame:
    """Counts by document over (doc_id, risk, matched, bibliography, length): all
    sentences count in the total, those of the bibliography not as eligible."""
    return sentences.groupBy("doc_id").agg(
        F.count(F.when(F.col("risk") == "high", 1)).alias("high_risk"), F.count(F.when(F.col("risk") == "medium", 1)).alias("medium_risk"), F.count("*").alias("total_sentences"),
        F.count(F.when(F.col("matched"), 1)).alias("matched_sentences"), F.coalesce(F.sum(F.when(~F.col("bibliography"), F.col("length"))), F.lit(0)).alias("eligible_chars"),
    )


def privacy_notice(offline: Column, queried: Column, from_cache: Column, academic_network: Column, llm: Column, llm_tasks: Column, llm_network: Column, network: Column) -> Column:
    """What left the machine, in words, from the record of a run."""

    def names(c: Column) -> Column:
        return F.array_join(c, ", ")

    some, cached = F.size(queried) > 0, F.size(from_cache) > 0
    tasks = F.when(F.size(llm_tasks) > 0, names(llm_tasks)).otherwise("language model")
    lookups = (
        F.when(offline & cached, F.concat(F.lit("Offline: records came from the cache of "), names(from_cache), F.lit("; no text was sent.")))
        .when(offline, F.lit("Offline: no records were looked up; no text was sent."))
        .when(some & academic_network, F.concat(F.lit("Lookups went to "), names(queried), F.lit("; the document's text did not.")))
        .when(some, F.concat(F.lit("Records of "), names(queried), F.lit(" came from the cache; nothing was sent.")))
        .otherwise(F.lit("No record provider was asked."))
    )
    model = (
        F.when(~llm, F.lit("No text went to a language model."))
        .when(llm_network, F.concat(F.lit("Claims went to a language model ("), tasks, F.lit(").")))
        .when(offline | ~network, F.concat(F.lit("Language model tasks ("), tasks, F.lit(") were left out.")))
        .otherwise(F.concat(F.lit("Language model results ("), tasks, F.lit(") came from the cache.")))
    )
    return F.concat_ws(" ", lookups, model, F.lit("A verified reference does not show that a claim holds."))
