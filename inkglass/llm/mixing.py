"""Mixing to target weights, in Spark SQL alone: soft membership of domains.

1. A classifier learnt from the labelled table (naive Bayes over hashed words,
   whose weights count only where they are clear of chance) gives each document
   a posterior over domains: good, poor, toxic.
2. Nonnegative rates, one a document, are fitted so that the expected tokens of
   each domain, rate * tokens * posterior summed over documents, match targets.
   Of all such rates they are the nearest to 1, by squares weighted with tokens:
   the clipped value of 1 - posterior . v, for one vector v with a number a
   domain. v is the minimum of a convex function, found by Newton steps with a
   line search; each is one to three aggregations to a few numbers. A share
   ``EPS`` of the distance to 1 in the objective keeps v finite where targets
   can't be met, and makes it least squares there; when whole steps overshoot,
   v is followed as that share falls from 0.1. Steps end at the targets or
   where that function's gradient vanishes; the gap that remains is logged.
"""

from __future__ import annotations

import logging
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkglass.llm.sample import first_present
from inkglass.session import scratch_dir, stored

DOMAINS = ["good", "poor", "toxic"]
TARGETS = {"good": 0.92, "poor": 0.03, "toxic": 0.05}
BUCKETS = 1 << 16  # slots of hashed words; bounds the weights that are broadcast
TRAIN_ROWS = 4000  # labelled documents the weights are learnt from, at most
CLEAR = 3.5  # standard errors a weight is from 0, at least
SMOOTH = 0.5
CLOSE, FLAT = 1e-5, 1e-8  # share of the budget: a gap, a gradient that end the steps
EPS = 1e-8  # weight of the rates' distance to 1 against the gaps
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"  # words with their digits, and runs of other marks
ROW = -1  # stands for a row itself among the slots of its tokens
COPIES = 10_000  # of one row, dealt out at once


def _tokens(text):
    return F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(TOKEN), F.lit(0))


def _slot(token):
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS))


def weights(docs: DataFrame, labels: DataFrame, where: str) -> tuple[DataFrame, list[float]]:
    """(slot, w1, w2): log likelihood ratios of poor and toxic to good, and the
    domains' log priors. Labels that are null count as 0 for toxic and leave
    the row out for quality; of several rows for a document the worst counts."""
    domain = F.when(F.coalesce("toxic", F.lit(0)) == 1, 2).when(F.col("quality") == 0, 1).otherwise(0)
    y = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(domain).alias("y"))
    y = first_present(y, docs, TRAIN_ROWS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(y), "doc_id")
    each = rows.select("y", F.explode(_tokens(F.col("text"))).alias("t")).groupBy(_slot(F.col("t")).alias("slot")).agg(*(F.count(F.when(F.col("y") == k, 1)).alias(f"c{k}") for k in range(3)))
    each = stored(each, where, "slots")
    n = each.agg(*(F.coalesce(F.sum(f"c{k}"), F.lit(0)) for k in range(3))).first()
    prior = y.groupBy().agg(*(F.count(F.when(F.col("y") == k, 1)) for k in range(3))).first()
    out = each
    for k in (1, 2):
        ratio = F.log((F.col(f"c{k}") + SMOOTH) / (n[k] + SMOOTH * BUCKETS)) - F.log((F.col("c0") + SMOOTH) / (n[0] + SMOOTH * BUCKETS))
        error = F.sqrt(1 / (F.col(f"c{k}") + SMOOTH) + 1 / (F.col("c0") + SMOOTH))
        out = out.withColumn(f"w{k}", F.when(F.abs(ratio) >= CLEAR * error, ratio).otherwise(0.0))
    total = sum(prior) + 3
    return out.where("w1 <> 0 or w2 <> 0").select("slot", "w1", "w2"), [math.log((p + 1) / total) for p in prior]


def posteriors(docs: DataFrame, labels: DataFrame, where: str) -> DataFrame:
    """(doc_id, n_tokens, p_good, p_poor, p_toxic) for every row of ``docs``.
    Texts without tokens have the priors."""
    w, prior = weights(docs, labels, where)
    w = w.unionByName(docs.sparkSession.createDataFrame([(ROW, 0.0, 0.0)], w.schema))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), _tokens(F.col("text")).alias("ts"))
    rows = rows.select("doc_id", "h", F.size("ts").alias("n"), F.explode(F.concat(F.array(F.lit("")), "ts")).alias("t"))
    # tokens without weight end here; the row's own entry goes on, and says how often the row is there
    rows = rows.withColumn("slot", F.when(F.col("t") == "", ROW).otherwise(_slot(F.col("t")))).join(F.broadcast(w), "slot")
    by = rows.groupBy("doc_id", "h").agg(F.max("n").alias("n"), F.count(F.when(F.col("slot") == ROW, 1)).alias("copies"), F.sum("w1").alias("s1"), F.sum("w2").alias("s2"))
    by = by.select(
        "doc_id", F.col("n").cast("long").alias("n_tokens"), "copies",
        *((F.col(f"s{k}") / F.col("copies") + (prior[k] - prior[0])).alias(f"z{k}") for k in (1, 2)),
    )
    top = F.greatest(F.lit(0.0), "z1", "z2")
    e = [F.exp(z - top) for z in (F.lit(0.0), F.col("z1"), F.col("z2"))]
    out = by.select("doc_id", "n_tokens", "copies", *((x / (e[0] + e[1] + e[2])).alias(f"p_{d}") for x, d in zip(e, DOMAINS, strict=True)))
    some = F.least(F.lit(COPIES).cast("long"), F.col("copies") - F.col("part") * COPIES)
    out = out.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES))))
    return out.withColumn("part", F.explode(F.sequence(F.lit(1).cast("long"), some))).drop("copies", "part")


def _inverse(m: list[list[float]]) -> list[list[float]]:
    n = len(m)
    a = [[*row, *(float(i == j) for j in range(n))] for i, row in enumerate(m)]
    for i in range(n):
        p = max(range(i, n), key=lambda r: abs(a[r][i]))
        a[i], a[p] = a[p], a[i]
        a[i] = [x / a[i][i] for x in a[i]]
        for r in range(n):
            if r != i:
                a[r] = [x - a[r][i] * y for x, y in zip(a[r], a[i], strict=True)]
    return [row[n:] for row in a]


def fit(posts: DataFrame, targets: dict[str, float], budget: float | None = None, most: float | None = None) -> list[float]:
    """The vector v of ``rate``. Targets are shares of ``budget`` tokens, by
    default all there are. ``most`` bounds the rates above; then a domain's
    target is at most what its documents hold at that rate."""
    p = [f"p_{d}" for d in DOMAINS]
    held = posts.agg(F.sum("n_tokens"), *(F.sum(F.col("n_tokens") * F.col(a)) for a in p)).first()
    total = float(held[0] or 0)
    if not total:
        return []
    share = sum(targets[d] for d in DOMAINS)
    want = [targets[d] / share * (budget or total) / total for d in DOMAINS]
    if most is not None:
        want = [min(t, most * h / total) for t, h in zip(want, held[1:], strict=True)]

    def value(v):
        """A row's share of the function whose minimum is looked for."""
        r = rate(v, most)
        return F.sum(F.col("n_tokens") / total * (r * _free(v) - r * r / 2))

    def rest(v, eps):
        return sum(t * x for t, x in zip(want, v, strict=True)) + eps / 2 * sum(x * x for x in v)

    def at(v, eps):
        """Value, gaps, gradient and second derivatives at ``v``."""
        r, n = rate(v, most), F.col("n_tokens") / total
        free = (r > 0) if most is None else (r > 0) & (r < most)
        pairs = [(i, j) for i in range(3) for j in range(i, 3)]
        row = posts.agg(value(v), *(F.sum(n * r * F.col(c)) for c in p), *(F.coalesce(F.sum(F.when(free, n * F.col(p[i]) * F.col(p[j]))), F.lit(0.0)) for i, j in pairs)).first()
        gap = [h - t for h, t in zip(row[1:4], want, strict=True)]
        second = [[0.0] * 3 for _ in range(3)]
        for (i, j), x in zip(pairs, row[4:], strict=True):
            second[i][j] = second[j][i] = x + eps * (i == j)
        return row[0] + rest(v, eps), gap, [eps * x - g for x, g in zip(v, gap, strict=True)], second

    def far(x, share):
        return max(map(abs, x)) > share * sum(want)

    # straight at EPS while whole steps lead down, else from 0 by falling weights
    for eps, begins in ((EPS, True), *((max(EPS, 10.0**-k), k == 1) for k in range(1, 1 + round(-math.log10(EPS))))):
        v = [0.0] * 3 if begins else v
        now, gap, slope, second = at(v, eps)
        flat = FLAT if eps == EPS else 1e-3 * max(CLOSE, *map(abs, gap))
        met = True
        while far(gap, CLOSE) and far(slope, flat):
            step = [-sum(m * g for m, g in zip(row, slope, strict=True)) for row in _inverse(second)]
            new = [x + y for x, y in zip(v, step, strict=True)]
            found = at(new, eps)
            if found[0] > now + 1e-4 * sum(g * y for g, y in zip(slope, step, strict=True)):
                met = not begins or eps != EPS
                if not met:
                    break
                tries = [[x + y / 4**k for x, y in zip(v, step, strict=True)] for k in range(1, 21)]
                values = [x + rest(t, eps) for x, t in zip(posts.agg(*map(value, tries)).first(), tries, strict=True)]
                new = tries[values.index(min(values))]
                found = at(new, eps)
                if found[0] >= now:  # as low as numbers of 64 bits go
                    break
            v, (now, gap, slope, second) = new, found
        if not far(gap, CLOSE) or (met and eps == EPS):
            break
    if max(map(abs, gap)) > CLOSE * sum(want):
        logging.getLogger(__name__).warning("targets can't be met; what is too much or lacks, as shares of all tokens: %s", dict(zip(DOMAINS, gap, strict=True)))
    return v


def _free(v: list[float]):
    """A document's rate before it is clipped."""
    return F.lit(1.0) - sum((F.col(f"p_{d}") * v[k] for k, d in enumerate(DOMAINS)), F.lit(0.0))


def rate(v: list[float], most: float | None = None):
    """A document's rate: 1 less posterior . v, clipped."""
    r = F.greatest(F.lit(0.0), _free(v)) if v else F.lit(1.0)
    return F.least(F.lit(float(most)), r) if v and most is not None else r


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, budget: float | None = None, most: float | None = None) -> DataFrame:
    """(doc_id, n_tokens, p_good, p_poor, p_toxic, rate) for every row.

    Null and empty texts have no tokens: their rate is that of the priors and
    bears on no total. Without tokens at all every rate is 1. A table without
    labels gives all documents one posterior, and targets that it can't meet
    are met as nearly as least squares can.
    """
    where = scratch_dir(docs.sparkSession)
    posts = stored(posteriors(docs, labels, where), where, "posteriors")
    return posts.withColumn("rate", rate(fit(posts, targets, budget, most), most))


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, seed: int = 7) -> DataFrame:
    """The rows of ``docs`` drawn at their rates, each once at most: rates lie
    in [0, 1], and the budget is what the good documents can fill. A draw goes
    by a hash of doc_id, so the same rows are drawn each time; a rate within a
    thousandth of 1 counts as 1."""
    where = scratch_dir(docs.sparkSession)
    posts = stored(posteriors(docs, labels, where), where, "posteriors")
    good = posts.agg(F.sum(F.col("n_tokens") * F.col("p_good"))).first()[0] or 0.0
    share = targets["good"] / sum(targets[d] for d in DOMAINS)
    v = fit(posts, targets, max(1.0, good / share), 1.0)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
    gone = posts.withColumn("rate", rate(v, 1.0)).where((F.col("rate") < 0.999) & (draw >= F.col("rate"))).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
