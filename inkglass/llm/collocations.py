"""Phrase collocations by pivot partitioning.

1. Words are counted for each language, and the commonest get ranks; the list
   has a bound, and words beyond it count as rarer than all in it.
2. Every n-gram is owned by its rarest word, its pivot. A map task rewrites the
   text around each word into the fragment that this word may own n-grams of:
   up to MOST - 1 words to either side, up to the first one that is rarer, too
   rare for any phrase, or past a border; to the left also up to the same word,
   so that the first of equal pivots owns an n-gram. Equal fragments are added
   up, and go packed to the shard of their pivot. A pivot with very many
   occurrences is dealt to several shards by its fragments.
3. A shard mines its fragments: n-grams that hold the pivot, with their counts.
   Counts of pivots on one shard are whole, so rare n-grams end there; those of
   dealt pivots are summed after.
4. Scores, containment and the best of each language are joins and aggregations
   over frequent n-grams.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkglass.llm import wordhash as wh
from inkglass.llm.workers import tidy
from inkglass.session import scratch_dir, ship, stored

LEAST, MOST, TOP = 30, 4, 2000
CONTAINED = 80  # per cent
LISTED = 500_000  # words with ranks, broadcast
HOT = 1 << 20  # occurrences of a pivot on a shard
SHARD = 1 << 19  # words a shard
TEXT = 1 << 21  # bytes of texts rewritten at once
TOKENS = 1 << 18  # words rewritten at once
SALTS = 64  # of a language's candidates
BORDER = b".,;:!?\n\x0b\x0c\r"

BREAKS = np.zeros(256, bool)
BREAKS[list(BORDER)] = True
SEPARATORS = BREAKS.copy()
SEPARATORS[[32, 9]] = True
NO_LANGUAGE = "und"


def _values(seed: int) -> np.ndarray:
    v = wh.byte_values(seed)
    v[65:91] = v[97:123]
    return v


def _keyed(batch: pa.RecordBatch, values: np.ndarray):
    """For each run of texts: language numbers and names, its bytes, and the
    words' keys, starts, ends and texts. A key is 63 bits of the word and its
    language, never less than 2^62."""
    langs = batch.column(0).to_pylist()
    texts = wh.utf8(batch.column(1))
    for lo, hi in wh.groups(texts, TEXT):
        names, number = np.unique([x if x is not None else NO_LANGUAGE for x in langs[lo:hi]], return_inverse=True)
        salts = np.array([int.from_bytes(hashlib.blake2b(n.encode(), digest_size=8).digest()) for n in names.tolist()], np.uint64)
        at = np.cumsum([0] + [len(t) + 1 for t in texts[lo:hi]])
        data = b"\n".join(texts[lo:hi]) + b"\n"
        with np.errstate(over="ignore"):
            h, s, e = wh.words(data, SEPARATORS, values)
            of = number[np.searchsorted(at, s, side="right") - 1]
            keys = (wh.mix(h ^ salts[of]) >> np.uint64(2)) | np.uint64(1 << 62)
        yield names, of, data, keys.view(np.int64), s, e


def _counts(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, other = _values(seed), _values(seed + 1000)
        for batch in batches:
            for names, of, data, keys, s, e in _keyed(batch, values):
                _, first, which, n = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
                sums = np.r_[np.uint64(0), np.cumsum(other[np.frombuffer(data, np.uint8)], dtype=np.uint64)]
                check = (sums[e] - sums[s]).view(np.int64)
                if (check[first][which] != check).any():  # one key for several words: each has a row, which the caller finds
                    _, first, n = np.unique(np.stack([keys, check], axis=1), axis=0, return_index=True, return_counts=True)
                words = [data[a:b].lower() for a, b in zip(s[first].tolist(), e[first].tolist(), strict=True)]
                yield pa.record_batch([pa.array(keys[first]), pa.array(names[of[first]].tolist(), pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(n)], names=["key", "lang", "word", "n"])

    return tidy(run, "collocations")


def _ranks(keys: np.ndarray, listed: dict) -> np.ndarray:
    """Ranks of listed words, from 1; others' keys, or 0 where they are too rare for any phrase."""
    other = np.zeros_like(keys) if listed["all"] else keys
    if not len(listed["sorted"]):
        return other
    k = np.minimum(np.searchsorted(listed["sorted"], keys), len(listed["sorted"]) - 1)
    return np.where(listed["sorted"][k] == keys, listed["rank"][k], other)


def fragments(x: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """The fragments of words lo to hi of ``x``, which has 0 for borders and
    words too rare, and MOST - 1 zeros at both ends: 2 * MOST - 1 columns, the
    pivot in the middle, 0 where a fragment has ended."""
    at = np.arange(lo, hi)
    at = at[x[at] > 0]
    pivot, out = x[at], np.zeros((len(at), 2 * MOST - 1), np.int64)
    out[:, MOST - 1] = pivot
    left, right = np.ones(len(at), bool), np.ones(len(at), bool)
    for k in range(1, MOST):
        before, after = x[at - k], x[at + k]
        left &= (before > 0) & (before < pivot)
        right &= (after > 0) & (after <= pivot)
        out[:, MOST - 1 - k][left] = before[left]
        out[:, MOST - 1 + k][right] = after[right]
    return out[(out[:, MOST - 2] > 0) | (out[:, MOST] > 0)]


def _planes(a: np.ndarray) -> bytes:
    """Integers by their first bytes, second bytes and so on, which compress well."""
    return np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T).tobytes()


def _unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def _rewrite(seed: int, shards: int, listed: Broadcast):
    def packed(rows: np.ndarray, hot: np.ndarray) -> Iterator[tuple]:
        """Equal fragments added up, by shard."""
        with np.errstate(over="ignore"):
            h = np.zeros(len(rows), np.uint64)
            for k in range(2 * MOST - 1):
                h = wh.mix(h + rows[:, k].view(np.uint64))
            pivot = rows[:, MOST - 1]
            deals = np.ones(len(rows), np.uint64)
            ranked = pivot < len(hot)
            deals[ranked] = hot[pivot[ranked]]
            to = (wh.mix(pivot.view(np.uint64) * np.uint64(SALTS + 1) + h % deals) % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((h, to))
        rows, to, deals = rows[order], to[order], deals[order] > 1
        new = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)])
        n = np.diff(np.r_[new, len(rows)])
        rows, to, deals = rows[new], to[new], deals[new]
        for dealt in (False, True):
            mine = deals == dealt
            part, some, m = to[mine], rows[mine], n[mine]
            cuts = np.flatnonzero(np.r_[len(part) > 0, part[1:] != part[:-1]])
            for a, b in zip(cuts, np.r_[cuts[1:], len(part)], strict=False):
                yield int(part[a]), dealt, _planes(some[a:b].T), _planes(m[a:b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, words = _values(seed), listed.value
        for batch in batches:
            for _, _, data, keys, s, e in _keyed(batch, values):
                if not len(keys):
                    continue
                breaks = np.cumsum(BREAKS[np.frombuffer(data, np.uint8)])
                new = np.r_[False, breaks[s[1:] - 1] > breaks[e[:-1] - 1]]
                place = np.arange(len(keys)) + np.cumsum(new) + MOST - 1
                x = np.zeros(int(place[-1]) + MOST, np.int64)
                x[place] = _ranks(keys, words)
                for lo in range(MOST - 1, len(x) - MOST + 1, TOKENS):
                    rows = fragments(x, lo, min(lo + TOKENS, len(x) - MOST + 1))
                    if len(rows):
                        out = list(zip(*packed(rows, words["hot"]), strict=True))
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.bool_(), pa.binary(), pa.binary()), strict=True)], names=["shard", "dealt", "rows", "n"])

    return tidy(run, "collocations")


def grams(rows: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length, the n-grams of fragments that hold the pivot, and how often they stand there."""
    words = None
    if len(rows) and rows.max() >= 1 << 31:
        words, rows = np.unique(rows, return_inverse=True)
        rows = rows.reshape(-1, 2 * MOST - 1)
        if words[0]:  # 0 stays the empty place
            words, rows = np.r_[0, words], rows + 1
    for size in range(2, MOST + 1):
        found, times = [], []
        for a in range(MOST - size, MOST):
            part = rows[:, a : a + size]
            there = (part > 0).all(axis=1)
            found.append(part[there])
            times.append(n[there])
        found, times = np.concatenate(found), np.concatenate(times)
        if not len(found):
            continue
        one = found[:, 0] << 32 | found[:, 1]
        two = found[:, 2] << 32 | found[:, 3] if size == 4 else found[:, 2] if size == 3 else None
        order = np.argsort(one, kind="stable") if two is None else np.lexsort((two, one))
        one = one[order]
        new = np.r_[True, one[1:] != one[:-1]]
        if two is not None:
            two = two[order]
            new[1:] |= two[1:] != two[:-1]
        new = np.flatnonzero(new)
        found = found[order[new]]
        yield found if words is None else words[found], np.add.reduceat(times[order], new)


def _mine(least: int, listed: Broadcast):
    def run(table: pa.Table) -> pa.Table:
        by_rank = listed.value["by_rank"]
        g, f = [], []
        for dealt in (False, True):
            part = table.filter(pa.compute.equal(table["dealt"], dealt))
            if not part.num_rows:
                continue
            rows = np.concatenate([_unplanes(x.as_py()).reshape(2 * MOST - 1, -1).T for x in part["rows"]])
            n = np.concatenate([_unplanes(x.as_py()) for x in part["n"]])
            for found, times in grams(rows, n):
                if not dealt:
                    found, times = found[times >= least], times[times >= least]
                ranked = found < len(by_rank)
                found[ranked] = by_rank[found[ranked]]
                g += found.tolist()
                f.append(times)
        return pa.table({"g": pa.array(g, pa.list_(pa.int64())), "f": pa.array(np.concatenate(f) if f else [], pa.int64())})

    return run


def _part(g: Column, start: Column, n: Column) -> Column:
    return F.slice(g, start, n)


def _top(rows: DataFrame, most: int) -> DataFrame:
    """Each language's first ``most`` rows: first of every salt's, then of these."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= most)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, contained: int = CONTAINED, listed: int = LISTED, hot: int = HOT, shard: int = SHARD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of
    2 to 4 words among rows (lang, text).

    Texts are lower-cased in A-Z and cut into pieces at ``.,;:!?`` and line
    ends, pieces into words at spaces and tabs; a null text has none, a null
    language is ``und``. a is how often the phrase stands within pieces,
    ``least`` times or more; l and r those of its two parts at the cut of least
    score floor(2000000 * a / (l + r)), the first of equals; n the words of the
    language. Phrases inside a longer one that stands ``contained`` per cent as
    often are left out. Repeated rows count each; without words there are no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    where = scratch_dir(spark)
    docs = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("text is not null")
    for seed in range(1, 9):
        counted = docs.mapInArrow(_counts(seed), "key long, lang string, word string, n long")
        words = stored(counted.groupBy("key", "lang", "word").agg(F.sum("n").alias("n")), where, f"words{seed}")
        if words.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").isEmpty():
            break
    else:
        raise ValueError("words could not be told apart by eight hashes")
    frequent = stored(words.where(F.col("n") >= least), where, "frequent")
    total = words.agg(F.sum("n")).head()[0] or 0
    first = frequent.orderBy(F.desc("n"), "key").select("key", "n").limit(listed).toArrow()
    keys, n = first["key"].to_numpy(), first["n"].to_numpy()
    order = np.argsort(keys)
    deals = np.minimum(-(-n // hot), SALTS).astype(np.uint64)
    ranked = spark.sparkContext.broadcast({
        "sorted": keys[order], "rank": order + 1, "by_rank": np.r_[0, keys].astype(np.int64), "hot": np.r_[np.uint64(1), deals].astype(np.uint64), "all": frequent.count() <= listed,
    })
    shards = max(1, -(-total // shard))
    packed = docs.mapInArrow(_rewrite(seed, shards, ranked), "shard long, dealt boolean, rows binary, n binary")
    mined = packed.repartition(shards, "shard").groupBy("shard").applyInArrow(_mine(least, ranked), "g array<long>, f long")
    phrases = stored(mined.groupBy("g").agg(F.sum("f").alias("a")).where(F.col("a") >= least), where, "phrases")

    often = frequent.select(F.array("key").alias("g"), F.col("n").alias("f")).unionByName(phrases.select("g", F.col("a").alias("f")))
    size = F.size("g")
    cuts = F.transform(F.sequence(F.lit(1), size - 1), lambda k: F.struct(k.alias("k"), _part(F.col("g"), F.lit(1), k).alias("lg"), _part(F.col("g"), k + 1, size - k).alias("rg")))
    cuts = phrases.select("g", "a", F.inline(cuts))
    cuts = cuts.join(often.select(F.col("g").alias("lg"), F.col("f").alias("l")), "lg").join(often.select(F.col("g").alias("rg"), F.col("f").alias("r")), "rg")
    score = F.expr("cast(2000000 as decimal(10,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))").cast("long")
    best = cuts.select("g", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("g", "a").agg(F.min("cut").alias("cut"))
    starts = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: _part(F.col("g"), i, m))))
    inside = phrases.where(size > 2).select(F.explode(starts).alias("g"), F.col("a").alias("f")).groupBy("g").agg(F.max("f").alias("f"))
    swallowed = F.expr(f"cast(f as decimal(20,0)) * 100 >= cast(a as decimal(20,0)) * {contained}")
    kept = best.join(inside, "g", "left").where(F.col("f").isNull() | ~swallowed).drop("f")
    spelt = kept.select("g", "a", "cut", F.posexplode("g").alias("at", "key")).join(frequent.select("key", "lang", "word"), "key")
    spelt = spelt.groupBy("g", "a", "cut").agg(F.first("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("at", "word"))).alias("words"))
    spelt = spelt.select("lang", F.array_join("words.word", " ").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return _top(spelt, top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = f"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents)
), f AS MATERIALIZED (
  SELECT lang, g, count(*) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(w) - m + 2), lambda i: w[i : i + m - 1])) AS g FROM t, range(1, {MOST + 1}) AS s(m) WHERE len(w) >= m) GROUP BY ALL HAVING count(*) >= {LEAST}
), n AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM t GROUP BY lang
), c AS (
  SELECT lang, g, f AS a, unnest(range(1, len(g))) AS k FROM f WHERE len(g) > 1
), s AS (
  SELECT c.lang, c.g, a, k, l.f AS l, r.f AS r, CAST(CAST(2000000 AS HUGEINT) * a // (l.f + r.f) AS BIGINT) AS score
  FROM c JOIN f l ON l.lang = c.lang AND l.g = c.g[1 : k] JOIN f r ON r.lang = c.lang AND r.g = c.g[k + 1 :]
), b AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
), i AS (
  SELECT lang, g, max(f) AS f FROM (SELECT lang, f, unnest(flatten(list_transform(range(2, len(g)), lambda m: list_transform(range(1, len(g) - m + 2), lambda i: g[i : i + m - 1])))) AS g FROM f WHERE len(g) > 2) GROUP BY ALL
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') AS phrase, a, l, r, n, score
FROM b LEFT JOIN i USING (lang, g) JOIN n USING (lang) WHERE i.f IS NULL OR 100 * i.f < {CONTAINED} * a
QUALIFY rank <= {TOP}
"""
