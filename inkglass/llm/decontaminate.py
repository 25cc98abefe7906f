"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

The test items are a stated query set. They are taken in blocks of bounded size
(``BLOCK_WORDS``); for each block an index of its word n-grams is broadcast and
the corpus is read once. Every n-gram of an item is a seed, however common it
is in the corpus: each that a text holds proposes a window around the place
where the item would lie, and windows of one item that overlap are joined. A
window stays when a stretch as long as a copy can be holds as many of the
item's words as the least score needs, which loses nothing; the item is aligned
with the words of those. The alignment pays 1 for an equal word and -1 for a
changed, missing or added one; its score over the item's length is 1 for a
whole copy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkglass.llm import wordhash as wh
from inkglass.llm.workers import tidy
from inkglass.session import ship

N = 3
MIN_WORDS = 5  # shorter items say too little to align; they are looked for as they are
#: Characters of scripts without spaces, each a word; wide punctuation, which parts words.
UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")
WIDE = re.compile("[\u3000-\u3004\u3008-\u303f\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")
BLOCK_WORDS = 2_000_000  # words of the items that are broadcast together
PAIRS = 1 << 20  # seeds, window words and alignment cells that are held at once, about
THRESHOLD = 0.4
FOUND = "doc_id long, item_id long, score double, n_seeds long, first_word long, last_word long"


def cut(text: bytes) -> bytes:
    """The text with spaces around the characters of unspaced scripts."""
    return text if text.isascii() else UNSPACED.sub(r" \1 ", WIDE.sub(" ", text.decode())).encode()


class Index:
    """The words and n-grams of a block of items."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.ids, self.words = [], []
        short: dict[int, list[tuple[int, int]]] = {}
        with np.errstate(over="ignore"):
            for lo, h, _, _, first, _ in wh.batch_words([cut(t) for _, t in items], wh.PUNCT):
                for k in range(len(first) - 1):
                    if first[k + 1] - first[k] >= MIN_WORDS:
                        self.ids.append(items[lo + k][0])
                        self.words.append(h[first[k] : first[k + 1]])
                    elif n := int(first[k + 1] - first[k]):
                        short.setdefault(n, []).append((int(wh.ngrams(h[first[k] : first[k + 1]], n)[0]), items[lo + k][0]))
            #: By number of words: the sorted grams of whole short items, and the items.
            self.short = {n: (np.array([g for g, _ in sorted(x)], np.uint64), [i for _, i in sorted(x)]) for n, x in short.items()}
            self.size = np.array([len(w) for w in self.words], np.int64)
            self.gram = np.concatenate([*(wh.ngrams(w, N) for w in self.words), np.zeros(0, np.uint64)])
        self.item = np.repeat(np.arange(len(self.words)), np.maximum(self.size - N + 1, 0))
        self.at = np.concatenate([*(np.arange(max(0, n - N + 1)) for n in self.size), np.zeros(0, np.int64)]).astype(np.int64)
        by = np.argsort(self.gram, kind="stable")
        self.gram, self.item, self.at = (x[by] for x in (self.gram, self.item, self.at))
        self.pairs = np.unique(_pair(np.repeat(np.arange(len(self.words)), self.size), np.concatenate([*self.words, np.zeros(0, np.uint64)])))


def _pair(item: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return wh.mix(word + item.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Lookup:
    """Positions of sorted 64-bit keys, behind a one-byte table on their low bits."""

    def __init__(self, keys: np.ndarray):
        bits = max(16, int(len(keys) * 16).bit_length())
        self.keys, self.mask = keys, np.uint64(2**bits - 1)
        self.table = np.zeros(2**bits, bool)
        self.table[keys & self.mask] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``h`` that hold a key, and the first index of that key."""
        place = np.flatnonzero(self.table[h & self.mask])
        at = np.searchsorted(self.keys, h[place])
        ok = at < len(self.keys)
        ok[ok] = self.keys[at[ok]] == h[place][ok]
        return place[ok], at[ok]


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment of each item with its window: score, and the last
    aligned place in the window (-1 without one)."""
    n, rows, cols = len(items), max(map(len, items), default=0), max(map(len, windows), default=0)
    best, end = np.zeros(n, np.int32), np.full(n, -1, np.int64)
    if not n or not cols:
        return best, end
    a, b = np.full((n, rows), 1, np.uint64), np.full((n, cols), 2, np.uint64)  # padding equals nothing
    for k, (x, y) in enumerate(zip(items, windows, strict=True)):
        a[k, : len(x)], b[k, : len(y)] = x, y
    h, ramp = np.zeros((n, cols + 1), np.int32), np.arange(cols + 1, dtype=np.int32)
    for i in range(rows):
        new = np.zeros_like(h)
        new[:, 1:] = np.maximum(h[:, :-1] + np.where(b == a[:, i : i + 1], 1, -1), h[:, 1:] - 1)
        np.maximum(new, 0, out=new)
        h = np.maximum.accumulate(new + ramp, axis=1) - ramp
        top = h.max(axis=1)
        up = top > best
        end[up] = h[up].argmax(axis=1) - 1
        best[up] = top[up]
    return best, end


def joined(doc: np.ndarray, item: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows [a, b) of one document and item that overlap or touch become one; n adds up."""
    if not len(a):
        return doc, item, a, b, n
    by = np.lexsort((a, item, doc))
    doc, item, a, b, n = (x[by] for x in (doc, item, a, b, n))
    other = np.ones(len(by), bool)
    other[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
    shift = np.cumsum(other) * (int(b.max()) + 1)
    b = np.maximum.accumulate(b + shift) - shift
    other[1:] |= a[1:] > b[:-1]
    lows = np.flatnonzero(other)
    return doc[lows], item[lows], a[lows], b[np.append(lows[1:], len(by)) - 1], np.add.reduceat(n, lows)


def proposed(ix: Index, first_of: np.ndarray, several: np.ndarray, place: np.ndarray, at: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """The joined windows of seeds ``at``, found at ``place``: document, item, start, end, seeds."""
    parts = []
    upto = np.cumsum(several[at])
    lo = 0
    while lo < len(place):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS, "right")))
        where, of = place[lo:hi], at[lo:hi]
        n = several[of]  # the items that hold this seed
        k = np.repeat(first_of[of] - np.cumsum(n) + n, n) + np.arange(n.sum())
        where, item = np.repeat(where, n), ix.item[k]
        doc = np.searchsorted(first, where, "right") - 1
        size = ix.size[item]
        pad, begin = size // 4 + 4, where - ix.at[k]
        parts.append(joined(doc, item, np.maximum(begin - pad, first[doc]), np.minimum(begin + size + pad, first[doc + 1]), np.ones(len(k), np.int64)))
        lo = hi
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return parts[0] if len(parts) == 1 else joined(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def possible(ix: Index, find: Lookup, h: np.ndarray, item: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether a window may reach ``threshold``. Each unit of score is an equal
    word, and each word beyond the item's length costs one, so a copy is at most
    (2 - threshold) items long and has threshold * size of the item's words."""
    ok, length = np.zeros(len(item), bool), b - a
    upto, lo = np.cumsum(length), 0
    while lo < len(item):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS, "right")))
        n = length[lo:hi]
        begin = np.cumsum(n) - n
        where = np.repeat(a[lo:hi] - begin, n) + np.arange(n.sum())
        held = np.zeros(len(where) + 1, np.int64)
        held[1 + find.find(_pair(np.repeat(item[lo:hi], n), h[where]))[0]] = 1
        held = np.cumsum(held)
        size = ix.size[item[lo:hi]]
        reach = np.ceil((2 - threshold) * size).astype(np.int64) + 1
        to = np.minimum(np.arange(len(where)) + np.repeat(reach, n), np.repeat(begin + n, n))
        most = np.maximum.reduceat(held[to] - held[:-1], begin)
        ok[lo:hi] = most >= threshold * size
        lo = hi
    return ok


def _grouped(order: np.ndarray, length: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of at most 256 windows, or of about PAIRS words padded to the longest."""
    lo = 0
    while lo < len(order):
        hi, cols = lo, 0
        while hi < len(order) and hi - lo < 256:
            cols = max(cols, int(length[order[hi]]))
            if hi > lo and cols * (hi - lo + 1) > PAIRS:
                break
            hi += 1
        yield order[lo:hi]
        lo = hi


def _search(index, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        grams, first_of = np.unique(ix.gram, return_index=True)
        several = np.diff(np.append(first_of, len(ix.gram)))
        find, words = Lookup(grams), Lookup(ix.pairs)
        shorts = [(n, g, its, Lookup(np.unique(g))) for n, (g, its) in ix.short.items()]
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            with np.errstate(over="ignore"):
                for lo, h, _, _, first, _ in wh.batch_words([cut(t) for t in wh.utf8(batch.column(1))], wh.PUNCT):
                    for size, g, its, one in shorts:
                        place, at = one.find(wh.ngrams(h, size))
                        doc = np.searchsorted(first, place, "right") - 1
                        inside = place + size <= first[doc + 1]
                        if not inside.any():
                            continue
                        pairs, begin = np.unique(np.stack([doc[inside], at[inside]]), axis=1, return_index=True)
                        for (d, x), y in zip(pairs.T, place[inside][begin], strict=True):
                            for i in its[np.searchsorted(g, one.keys[x], "left") : np.searchsorted(g, one.keys[x], "right")]:
                                out.append((ids[lo + d], i, 1.0, 1, int(y - first[d]), int(y - first[d]) + size - 1))
                    place, at = find.find(wh.ngrams(h, N))
                    inside = place + N <= first[np.searchsorted(first, place, "right")]
                    doc, item, a, b, n = proposed(ix, first_of, several, place[inside], at[inside], first)
                    ok = possible(ix, words, h, item, a, b, threshold)
                    doc, item, a, b, n = (x[ok] for x in (doc, item, a, b, n))
                    for some in _grouped(np.lexsort((b - a, ix.size[item])), b - a):
                        w = [(item[x], doc[x], a[x], b[x], n[x]) for x in some]
                        xs, ys = [ix.words[i] for i, *_ in w], [h[p:q] for _, _, p, q, _ in w]
                        best, end = align(xs, ys)
                        ok = np.flatnonzero(best >= threshold * ix.size[[i for i, *_ in w]])
                        back = align([xs[x][::-1] for x in ok], [ys[x][: end[x] + 1][::-1] for x in ok])[1]
                        for x, r in zip(ok, back, strict=True):
                            i, d, p, _, seeds = w[x]
                            last = p + end[x] - first[d]
                            out.append((ids[lo + d], ix.ids[i], float(best[x]) / len(xs[x]), int(seeds), int(last - r), int(last)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "score", "n_seeds", "first_word", "last_word"])

    return tidy(run, "decontaminate")


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document and item it holds a copy of: doc_id, item_id,
    score (its best copy's, ``threshold`` to 1), n_seeds, and the copy's first
    and last word, counted from 0 in the document's words.

    Words are runs of letters, digits and characters beyond ASCII, A-Z folded;
    a character of a script without spaces is a word. Items of fewer than
    MIN_WORDS words are found where all their words follow one another. Null and
    empty texts on either side match nothing; items without words or item_id are
    not looked for.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (BLOCK_WORDS * 5)))
    out = spark.createDataFrame([], FOUND)
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        index = Index([(r.item_id, r.text.encode()) for r in part.toLocalIterator()])
        if not index.ids and not index.short:
            continue
        shared = spark.sparkContext.broadcast(index)
        out = out.unionByName(docs.mapInArrow(_search(shared, threshold), FOUND))
    best = F.max(F.struct("score", "n_seeds", (-F.col("first_word")).alias("o"), "last_word")).alias("best")
    out = out.groupBy("doc_id", "item_id").agg(best)
    return out.select("doc_id", "item_id", "best.score", "best.n_seeds", (-F.col("best.o")).alias("first_word"), "best.last_word")


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that hold no copy of an item; rows without doc_id stay."""
    return docs.join(leaks(docs, items, threshold).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
