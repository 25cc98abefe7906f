"""Evidence for claims: relevance, verdicts, support, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkglass.functions import arrow
from inkglass.functions import text as T

STRONG, MODERATE, FAINT, METADATA = 70, 50, 20, 50


def evidence_sentences(c: Column) -> Column:
    return F.filter(T.split_sentences(c), lambda s: F.size(T.tokens_by_space(s)) >= 2)


def relevance(claim: Column, sentence: Column, sequence: Column | None = None) -> Column:
    """60 share of the claim's words, 20 matching sequence, 20 share of the
    sentence's words."""
    a, b = F.array_distinct(T.ascii_tokens(claim)), F.array_distinct(T.ascii_tokens(sentence))
    both = F.size(F.array_intersect(a, b))
    ratio = arrow.sequence_ratio(F.lower(claim), F.lower(sentence)) if sequence is None else sequence
    score = both / F.greatest(F.size(a), F.lit(1)) * 60 + ratio * 20 + both / F.greatest(F.size(b), F.lit(1)) * 20
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0).otherwise(T.half_even(score)).cast("long")


def evidence(claims: DataFrame, candidates: DataFrame, k: int = 3) -> DataFrame:
    """The k most relevant sentences of each candidate's abstract, over
    (claim_id, query_id, text) and (query_id, cand_id, abstract); a sentence
    that repeats counts once, in its first place."""
    rows = claims.join(candidates, "query_id").select("claim_id", "cand_id", "text", F.posexplode(evidence_sentences(F.col("abstract"))).alias("pos", "sentence"))
    once = Window.partitionBy("claim_id", "cand_id", F.lower("sentence")).orderBy("pos")
    rows = rows.withColumn("n", F.row_number().over(once)).where("n = 1").withColumn("score", relevance(F.col("text"), F.col("sentence")))
    w = Window.partitionBy("claim_id", "cand_id").orderBy(F.col("score").desc(), "pos")
    rows = rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
    hint = F.when(F.col("score") >= STRONG, "partially_supported").otherwise("insufficient_information")
    return rows.select("claim_id", "cand_id", "rank", "sentence", "score", hint.alias("verdict"))


def metadata_match(query: Column, title: Column) -> Column:
    q, t = F.array_distinct(T.ascii_tokens(query)), F.array_distinct(T.ascii_tokens(title))
    both = F.size(F.array_intersect(q, t))
    return F.when((F.size(q) == 0) | (F.size(t) == 0), 0).otherwise(T.half_even((both / F.greatest(F.size(q), F.lit(1)) * 0.6 + both / F.greatest(F.size(t), F.lit(1)) * 0.4) * 100)).cast("long")


def verdict(metadata: Column, best: Column, entailed: Column) -> Column:
    """``best`` is the best evidence's score, null without evidence; ``entailed``
    the entailment's verdict, null without one."""
    unsure = "insufficient_information"
    return (
        F.when(entailed.isNotNull() & (entailed != unsure), entailed)
        .when(best >= MODERATE, "partially_supported")
        .when((metadata >= METADATA) & (best.isNull() | (best < FAINT)), "unrelated")
        .otherwise(unsure)
    )


def support(best: Column, entailed: Column, confidence: Column) -> Column:
    e = F.coalesce(best, F.lit(0))
    known = entailed.isNotNull() & (entailed != "insufficient_information")
    return F.when(known, T.half_even(e * 0.25 + F.coalesce(confidence, F.lit(0)) * 0.75)).otherwise(e).cast("long")


def overall_confidence(metadata: Column, supported: Column, entailment: Column) -> Column:
    """.2 metadata and .8 support with an entailment, .4 and .6 without; scores
    outside 0 to 100 are an error."""
    value = F.when(entailment, T.half_even(metadata * 0.2 + supported * 0.8)).otherwise(T.half_even(metadata * 0.4 + supported * 0.6))
    inside = metadata.between(0, 100) & supported.between(0, 100)
    return F.when(inside, value).otherwise(F.raise_error(F.lit("scores must be between 0 and 100")).cast("long"))


def claim_summary(sources: DataFrame) -> DataFrame:
    """(claim_id, summary) over (claim_id, evaluated, verdict)."""
    used = F.col("evaluated")
    against = F.coalesce(F.bool_or(used & (F.col("verdict") == "contradicted")), F.lit(False))
    for_ = F.coalesce(F.bool_or(used & F.col("verdict").isin("supported", "partially_supported")), F.lit(False))
    summary = F.when(~F.bool_or(used), "unavailable").when(against & for_, "mixed").when(against, "contradicted").when(for_, "supported").otherwise("unresolved")
    return sources.groupBy("claim_id").agg(summary.alias("summary"))
