"""Whether a rewrite keeps its original's meaning: screening, labels of models,
the verdict from both directions, and assertions that a rewrite adds.

Models' scores are landed tables or a ``judge``, a function of two columns that
gives struct(score, verdict); ``screen`` is the judge that needs no model.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkglass.functions import text as T

PRESERVED, CONTRADICTED, INSUFFICIENT, UNKNOWN = "meaning_preserved", "contradicted", "insufficient_information", "unknown"
BACKED = [PRESERVED, "supported", "partially_supported"]
# Words that turn a sentence's polarity, and the most that an overlap of unequal polarity scores.
NEGATIONS = ["not", "no", "never", "without", "neither", "nor", "failed", "lack", "absence", "didn't", "doesn't", "isn't", "wasn't", "weren't"]
POLARITY_CAP = 0.5
Judge = Callable[[Column, Column], Column]


def folded_tokens(c: Column) -> Column:
    return F.array_distinct(T.ascii_tokens(F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))))


def negated(c: Column) -> Column:
    return F.regexp_like(c, F.lit(f"(?iU)\\b(?:{'|'.join(NEGATIONS)})\\b"))


def screen(premise: Column, hypothesis: Column) -> Column:
    """struct(score, verdict): the share of the hypothesis' words that the
    premise has. It never finds meaning preserved; unequal polarity is a
    contradiction. Null counts as empty, and without words the score is 0."""
    p, h = F.coalesce(premise, F.lit("")), F.coalesce(hypothesis, F.lit(""))
    share = F.coalesce(F.size(F.array_intersect(folded_tokens(p), folded_tokens(h))) / F.nullif(F.size(folded_tokens(h)), F.lit(0)), F.lit(0.0))
    turned = (F.size(folded_tokens(h)) > 0) & (negated(p) != negated(h))
    return F.struct(F.when(turned, F.least(share, F.lit(POLARITY_CAP))).otherwise(share).alias("score"), F.when(turned, CONTRADICTED).otherwise(UNKNOWN).alias("verdict"))


def model_label(raw: Column) -> Column:
    """A model's label as a verdict, whatever its case, separators or number;
    what is not plainly entailment or contradiction is unknown."""
    low = F.regexp_replace(F.translate(F.lower(F.regexp_replace(raw, "(?U)^\\s+|\\s+$", "")), "_-", "  "), "(?U)^label\\s+\\d+\\s*", "")
    denied = F.regexp_like(low, F.lit("(?U)\\b(?:non|not|no|without)\\b.*\\bentail"))
    return (
        F.when(low.contains("contradict"), CONTRADICTED)
        .when(low.contains("neutral"), UNKNOWN)
        .when(low.contains("entail") & ~denied, PRESERVED)
        .otherwise(UNKNOWN)
    )


def coerced(verdict: Column) -> Column:
    """A verdict on support or on meaning, as one on meaning."""
    return F.when(verdict == CONTRADICTED, CONTRADICTED).when(verdict.isin(BACKED), PRESERVED).otherwise(UNKNOWN)


def validated(semantic: Column, forward: Column, backward: Column, least_semantic: float = 0.0, least_entailment: float = 0.0) -> Column:
    """struct(verdict, score, reasons) from the similarity, null where no model
    was at hand, and struct(score, verdict) of both directions. A contradiction
    rejects; meaning is preserved only if both directions say so and all reach
    their least values."""
    none = F.array().cast("array<string>")
    f, b = coerced(forward["verdict"]), coerced(backward["verdict"])
    fs, bs = F.coalesce(forward["score"], F.lit(0.0)), F.coalesce(backward["score"], F.lit(0.0))
    against = [
        (semantic.isNull(), "no semantic model"),
        (semantic < least_semantic, "semantic similarity is too low"),
        (f == CONTRADICTED, "the original contradicts the rewrite"),
        (b == CONTRADICTED, "the rewrite contradicts the original"),
        (fs < least_entailment, "forward entailment is too low"),
        (bs < least_entailment, "backward entailment is too low"),
    ]
    reasons = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), r) for c, r in against)))
    kept = (semantic >= least_semantic) & (f == PRESERVED) & (b == PRESERVED) & (fs >= least_entailment) & (bs >= least_entailment)
    verdict = F.when((f == CONTRADICTED) | (b == CONTRADICTED), CONTRADICTED).when(F.coalesce(kept, F.lit(False)), PRESERVED).otherwise(INSUFFICIENT)
    score = (F.coalesce(semantic, F.lit(0.0)) + fs + bs) / F.when(semantic.isNull(), 2).otherwise(3)
    given = F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("meaning was not shown to be preserved")))
    return F.struct(verdict.alias("verdict"), score.alias("score"), F.when(verdict == PRESERVED, none).otherwise(given).alias("reasons"))


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def pieces(c: Column) -> Column:
    """What stands between a sentence mark and white space, whatever follows."""
    return F.split(_stripped(c), "(?U)(?<=[.!?])\\s+")


def new_assertions(original: Column, candidate: Column) -> Column:
    """Sentences beyond the original's number, then clauses after more "and"s
    than it has; each once, without spaces and full stops at its ends."""
    o, c = F.coalesce(original, F.lit("")), F.coalesce(candidate, F.lit(""))

    def beyond(rows: Column, n: Column) -> Column:
        return F.slice(rows, n + 1, F.greatest(F.size(rows) - n, F.lit(0)))

    clauses = F.split(c, "(?iU)\\band\\b")
    ands = F.size(F.split(o, "(?iU)\\band\\b")) - 1
    more = F.concat(beyond(pieces(c), F.size(pieces(o))), beyond(clauses, ands + 1))
    return F.array_distinct(F.filter(F.transform(more, lambda x: F.trim(x, F.lit(" ."))), lambda x: x != ""))


def unsupported(rewrites: DataFrame, evidence: DataFrame, judge: Judge = screen) -> DataFrame:
    """(passage_id, assertion): what rewrites (passage_id, original, candidate)
    add that no evidence (passage_id, text) of the passage backs; an anti-join."""
    added = rewrites.select("passage_id", F.explode(new_assertions(F.col("original"), F.col("candidate"))).alias("assertion")).distinct()
    backed = added.join(evidence.select("passage_id", "text"), "passage_id").where(judge(F.col("text"), F.col("assertion"))["verdict"].isin(BACKED))
    return added.join(backed.select("passage_id", "assertion").distinct(), ["passage_id", "assertion"], "left_anti")
