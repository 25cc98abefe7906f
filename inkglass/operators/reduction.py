"""Reducing overlap: risks, plans, gates for rewrites, ranking, the loop."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkglass.functions import text as T
from inkglass.session import scratch_dir, stored

CLOSE, SEMANTIC = 0.70, 0.85
EPSILON = 1e-9
WEIGHTS = {"meaning": 0.40, "support": 0.30, "source_reduction": 0.20, "structural": 0.10}
# What a rewrite must keep, as numbers with units, versions, identifiers, dates. U: letters and digits beyond ASCII count.
PROTECTED = [
    "(?iU)(?<!\\w)(?:n\\s*=\\s*)?\\d[\\d,]*(?:\\.\\d+)?%?(?:\\s*(?:mg(?:/kg)?|g(?:/kg)?|kg|ml|mmol/l|mol/l|cm|mm|km|hz|mhz|ghz|°c|°f))?(?!\\w)",
    "(?iU)\\b(?:v(?:ersion)?\\s*)?\\d+(?:\\.\\d+){1,3}\\b",
    "(?U)\\b[A-Za-z][A-Za-z0-9_-]*[-_][A-Za-z0-9_.-]*\\d[A-Za-z0-9_.-]*\\b",
    "(?iU)\\b(?:\\d{4}-\\d{2}-\\d{2}|(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\\s+\\d{1,2},\\s+\\d{4})\\b",
]
# Weak wording, and the strong wording that it must not become; what negates a clause.
TRANSITIONS = [
    (["associated with", "correlated with", "linked to", "related to"], ["caused", "causes", "led to", "results in"]),
    (["may ", "might ", "possible"], ["definitely", "certainly", "proves"]),
    (["could "], ["will ", "eliminates"]),
    (["some ", "a subset", "limited to"], ["all ", "every ", "universally"]),
    (["preliminary evidence", "initial evidence", "limited evidence", "suggests"], ["proves", "conclusively established", "conclusively demonstrated", "definitive evidence"]),
    (["ilişkili", "ilişki bulundu", "ilişki gözlendi", "bağlantılı", "korelasyon", "birlikte değişim"], ["neden oldu", "neden olur", "neden olduğu", "sebep oldu", "sebep olur", "yol açtı", "yol açar"]),
    (
        ["olabilir", "olabileceği", "artırabilir", "azaltabilir", "uygulanabilir", "muhtemeldir", "gösterebilir", "işaret etmektedir", "düşündürmektedir"],
        ["kesindir", "kesin olarak", "mutlaka", "kanıtlamaktadır", "kesin olarak gösterilmiştir", "kesin olarak etkilidir"],
    ),
    (["bazı", "bir kısmı", "belirli katılımcılar"], ["tümü", "tüm ", "herkes", "bütün katılımcılar"]),
    (
        ["ön bulgular", "ilk bulgular", "sınırlı kanıt", "işaret etmektedir", "düşündürmektedir", "gözlemsel sonuç"],
        ["kesin kanıt", "kanıtlanmıştır", "kanıtlamaktadır", "kesin olarak gösterilmiştir", "kesin olarak etkilidir", "nedensellik gösterilmiştir"],
    ),
]
NEGATORS = ["not ", "no ", "never ", "does not ", "did not ", "cannot ", "değil", "gösterilmemiş", "kanıtlanmamış", "kurulamaz", "görülmedi", "söylenemez", "doğrulanmamış"]


def risk(exact: Column, lexical: Column, semantic: Column, level: Column, quoted: Column, cited: Column, verified: Column, matched: Column) -> Column:
    """struct(risk_type, action, confidence) of a passage, by the first that holds."""

    def out(kind: str, action: str, confidence: float) -> Column:
        return F.struct(F.lit(kind).alias("risk_type"), F.lit(action).alias("action"), F.lit(confidence).alias("confidence"))

    alike = (lexical >= CLOSE) & ((semantic >= SEMANTIC) | (semantic == 0))
    return (
        F.when(~matched, out("unknown", "leave", 0.35))
        .when(quoted & (exact >= CLOSE) & cited, out("acceptable_overlap", "leave", 0.98))
        .when(quoted & (exact >= CLOSE), out("missing_citation", "add_citation", 0.96))
        .when((exact >= CLOSE) & cited, out("too_close_paraphrase", "paraphrase", 0.92))
        .when(exact >= CLOSE, out("exact_copy", "add_citation", 0.97))
        .when(alike & cited, out("too_close_paraphrase", "paraphrase", 0.84))
        .when(alike, out("missing_citation", "add_citation", 0.88))
        .when((level == "high") & ~cited, out("missing_citation", "add_citation", 0.82))
        .when(level == "medium", out("acceptable_overlap", "manual_review", 0.65))
        .when(F.coalesce(verified, F.lit(False)), out("acceptable_overlap", "leave", 0.80))
        .otherwise(out("unknown", "leave", 0.40))
    )


def fix_plan(risk_type: Column, action: Column) -> Column:
    """struct(action, rewrite_allowed): only close paraphrases are rewritten."""
    plain = F.when(risk_type.isin("exact_copy", "missing_citation"), "add_citation").otherwise(action)
    return F.struct(plain.alias("action"), (action == "paraphrase").alias("rewrite_allowed"))


def protected_tokens(c: Column) -> Column:
    """Numbers with units, versions, identifiers, dates: each once, in order of kind."""
    found = F.transform(F.flatten(F.array(*(F.regexp_extract_all(c, F.lit(p), F.lit(0)) for p in PROTECTED))), lambda x: F.trim(x))
    return F.array_distinct(F.filter(found, lambda x: x != ""))


def _folded(c: Column) -> Column:
    return T.collapse(F.translate(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), "’‘–—", "''--"))


def _holds(c: Column, phrases: list[str]) -> Column:
    return reduce(lambda x, y: x | y, (F.contains(c, F.lit(p)) for p in phrases))


def strengthened(original: Column, candidate: Column) -> Column:
    """Whether the original has weak wording and the candidate asserts its
    strong counterpart, in a clause without a negation."""
    a, clauses = _folded(original), F.filter(F.split(_folded(candidate), "[;.!?]+"), lambda x: ~_holds(x, NEGATORS))

    def asserted(phrases: list[str]) -> Column:
        return F.exists(clauses, lambda x: _holds(x, phrases))

    return reduce(lambda x, y: x | y, (_holds(a, weak) & asserted(strong) for weak, strong in TRANSITIONS))


def gates(
    original: Column, candidate: Column, citations: Column, meaning: Column, unsupported: Column, before: tuple[Column, Column], after: tuple[Column, Column], entities: Column | None = None, verdict: Column | None = None
) -> Column:
    """Reasons against a rewrite, none if it may be used. ``entities`` are the
    original's names (``arrow.entities``), ``verdict`` what its source says of it."""
    none = F.array().cast("array<string>")
    folded, names = F.replace(F.lower(candidate), F.lit("ß"), F.lit("ss")), none if entities is None else F.coalesce(entities, none)
    stronger = strengthened(original, candidate)
    contradicted = F.lit(False) if verdict is None else F.coalesce(verdict == "contradicted", F.lit(False))
    a, b = protected_tokens(original), protected_tokens(candidate)
    reasons = [
        (~F.forall(citations, lambda c: F.contains(candidate, c)), "a citation is missing"),
        (F.size(F.array_except(a, b)) + F.size(F.array_except(b, a)) > 0, "numbers changed"),
        (~F.forall(names, lambda n: F.contains(folded, F.replace(F.lower(n), F.lit("ß"), F.lit("ss")))), "a name is missing"),
        (stronger, "the claim is stronger"),
        (stronger | contradicted, "the source does not support it"),
        (~meaning.isin("preserved", "meaning_preserved"), "meaning is not preserved"),
        (F.size(unsupported) > 0, "unsupported claims"),
        (~overlap_reduced(before, after), "overlap did not fall"),
    ]
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(True)), r) for c, r in reasons)))


def overlap_reduced(before: tuple[Column, Column], after: tuple[Column, Column]) -> Column:
    """No signal rises, one falls."""
    no_rise = (after[0] <= before[0] + EPSILON) & (after[1] <= before[1] + EPSILON)
    return no_rise & ((after[0] < before[0] - EPSILON) | (after[1] < before[1] - EPSILON))


def candidate_score(meaning: Column, support: Column, delta: Column, lexical: Column) -> Column:
    z = F.lit(0.0)
    parts = {"meaning": F.coalesce(meaning, z), "support": F.coalesce(support, z), "source_reduction": F.greatest(F.coalesce(delta, z), z), "structural": 1 - F.coalesce(lexical, z)}
    return F.round(sum((parts[k] * w for k, w in WEIGHTS.items()), z), 6)


def offsets(spans: DataFrame) -> DataFrame:
    """(doc_id, phase, exact, lexical): distinct characters under exact spans,
    and under others alone, of (doc_id, phase, paragraph, start, end, match_type)."""
    textual = spans.where("match_type <> 'semantic_overlap' AND end > start")
    each = textual.select("doc_id", "phase", "paragraph", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("at"), (F.col("match_type") == "exact").alias("exact"))
    by = each.groupBy("doc_id", "phase", "paragraph", "at").agg(F.bool_or("exact").alias("exact"))
    return by.groupBy("doc_id", "phase").agg(F.count(F.when(F.col("exact"), 1)).alias("exact"), F.count(F.when(~F.col("exact"), 1)).alias("lexical"))


def improve(state: DataFrame, candidates: DataFrame, scan: Callable[[DataFrame], DataFrame], most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Applies the best rewrite of each passage, round by round, to each
    document on its own: (doc_id, passage_id, text) as it ends, and (doc_id,
    reason, rounds).

    ``state`` is (doc_id, passage_id, text), ``candidates`` (passage_id, text,
    score, rejected), ``scan`` gives (doc_id, percent, high_risk) for a state.
    A round counts for a document if its high risk does not rise and it, or the
    percentage, falls; a document for which it doesn't count leaves with the
    state before. One whose candidates are used up leaves too. Rounds only touch
    documents that are still in, and every round goes to shared storage, so
    lineage stays short; the driver learns only whether any are left. Passage
    ids are unique over all documents.
    """
    where = scratch_dir(state.sparkSession)
    state = stored(state.select("doc_id", "passage_id", "text"), where, "state0")
    owned = candidates.join(state.select("doc_id", "passage_id").distinct(), "passage_id").select("doc_id", "passage_id", F.col("text").alias("new"), "score", "rejected")
    safe = owned.groupBy("doc_id").agg(F.bool_or(~F.col("rejected")).alias("safe"))
    begin = state.select("doc_id").distinct().join(safe, "doc_id", "left")
    reason = F.when(F.col("safe").isNull(), "no_eligible_reducible_passages").when(~F.col("safe"), "no_safe_candidates")
    left = stored(begin.where("safe is null or not safe").select("doc_id", reason.alias("reason"), F.lit(0).alias("rounds")), where, "left0")
    active = begin.where("safe").select("doc_id")
    done = state.join(active, "doc_id", "left_anti").select(*state.columns)
    state = stored(state.join(active, "doc_id", "left_semi"), where, "active0")
    usable = stored(owned.where(~F.col("rejected")).select("doc_id", "passage_id", "new", "score"), where, "usable0")
    measures = stored(_measured(state, scan), where, "measures0")
    for k in range(1, most + 1):
        if state.isEmpty():
            break
        best = usable.groupBy("doc_id", "passage_id").agg(F.max_by("new", F.struct("score", "new")).alias("new"))
        tried = stored(state.join(best, ["doc_id", "passage_id"], "left").select("doc_id", "passage_id", "text", F.coalesce("new", "text").alias("next"), F.col("new").isNotNull().alias("used")), where, f"tried{k}")
        after = stored(_measured(tried.select("doc_id", "passage_id", F.col("next").alias("text")), scan), where, f"measures{k}")
        changed = tried.where("text <> next").select("doc_id").distinct().withColumn("changed", F.lit(True))
        h, p, h0, p0 = (F.coalesce(c, F.lit(0)) for c in ("a.high_risk", "a.percent", "b.high_risk", "b.percent"))
        counts = F.coalesce("changed", F.lit(False)) & (h <= h0) & ((h < h0) | (p < p0 - EPSILON))
        judged = state.select("doc_id").distinct().join(changed, "doc_id", "left").alias("d").join(after.alias("a"), F.col("d.doc_id") == F.col("a.doc_id"), "left").join(measures.alias("b"), F.col("d.doc_id") == F.col("b.doc_id"), "left")
        judged = stored(judged.select("d.doc_id", counts.alias("counts")), where, f"judged{k}")
        used = tried.where("used").select("doc_id", "passage_id", F.col("next").alias("new"))
        usable = stored(usable.join(used, ["doc_id", "passage_id", "new"], "left_anti").join(judged.where("counts"), "doc_id", "left_semi"), where, f"usable{k}")
        more = usable.select("doc_id").distinct().withColumn("more", F.lit(True))
        ended = judged.join(more, "doc_id", "left").select("doc_id", "counts", (F.col("counts") & F.coalesce("more", F.lit(False)) & F.lit(k < most)).alias("stays"), F.coalesce("more", F.lit(False)).alias("more"))
        reason = F.when(~F.col("counts"), "no_measured_improvement").when(~F.col("more"), "no_safe_candidates").otherwise("max_iterations_reached")
        ended = stored(ended.select("*", reason.alias("reason"), (F.lit(k) - F.when(F.col("counts"), 0).otherwise(1)).alias("rounds")), where, f"ended{k}")
        now = tried.join(ended, "doc_id").select("doc_id", "passage_id", F.when(F.col("counts"), F.col("next")).otherwise(F.col("text")).alias("text"), "stays")
        left = left.unionByName(ended.where("not stays").select("doc_id", "reason", "rounds"))
        done = done.unionByName(now.where("not stays").drop("stays"))
        state, measures = stored(now.where("stays").drop("stays"), where, f"active{k}"), after
    return done, left.withColumn("rounds", F.col("rounds").cast("long"))


def _measured(state: DataFrame, scan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return scan(state).groupBy("doc_id").agg(F.sum(F.col("high_risk").cast("long")).alias("high_risk"), F.sum(F.col("percent").cast("double")).alias("percent"))


def apply_rewrites(texts: DataFrame, edits: DataFrame) -> DataFrame:
    """(doc_id, text, applied) over (doc_id, text) and (doc_id, original, new):
    an original that stands in its text exactly once is replaced."""
    each = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("original", "new"))).alias("e"))
    rows = texts.join(each, "doc_id", "left").withColumn("e", F.coalesce("e", F.array().cast("array<struct<original:string,new:string>>")))

    def once(text: Column, part: Column) -> Column:
        return (F.length(text) - F.length(F.replace(text, part, F.lit("")))) == F.length(part)

    ok = F.filter("e", lambda x: (F.length(x["original"]) > 0) & once(F.col("text"), x["original"]))
    rows = rows.withColumn("ok", ok)
    return rows.select("doc_id", F.aggregate("ok", F.col("text"), lambda t, x: F.replace(t, x["original"], x["new"])).alias("text"), F.size("ok").cast("long").alias("applied"))


def normalised_pair(a: Column, b: Column) -> Column:
    """Character trigram overlap of two wordings."""
    return T.char_ngram_jaccard(a, b)
