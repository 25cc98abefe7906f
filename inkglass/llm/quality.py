"""Quality classifier: logistic regression over hashed word n-grams.

A text is cut into words and runs of punctuation. Its features are hashed into
``2**BITS`` slots: words, word pairs, and runs of one to three word shapes,
where a shape is the punctuation itself, or how a word is written (capitals,
digits) and whether it repeats the word before. A text's vector has the square
roots of its counts, scaled to length 1. Weights are learnt by follow-the-
regularised-leader updates on a bounded sample of labelled rows; a score is the
logistic function of one sparse dot product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkglass.llm import wordhash as wh
from inkglass.llm.sample import first_present
from inkglass.llm.workers import tidy
from inkglass.session import ship

BITS = 18
TRAIN_ROWS = 4000  # labelled documents the weights are learnt from, at most
EPOCHS, ALPHA, BETA, L1, L2 = 5, 0.5, 1.0, 1e-4, 1e-4
FOLDS, HELD_OUT = 3, 1  # crc32(doc_id as text) mod FOLDS = HELD_OUT is never learnt from

_KIND = np.full(256, 2, np.int8)  # 0 space, 1 word, 2 punctuation
_KIND[wh.SPACE] = 0
_KIND[~wh.PUNCT] = 1
_UPPER, _LOWER, _DIGIT = (np.zeros(256, np.int64) for _ in range(3))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = 1


def _block(b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hash, kind, way of writing and first byte of each token of a block."""
    kind = _KIND[b]
    edge = np.flatnonzero(np.diff(kind, prepend=np.int8(0)))
    edge = edge[kind[edge] > 0]
    ends = np.append(np.flatnonzero(np.diff(kind)) + 1, len(b))
    ends = ends[np.searchsorted(ends, edge, "right")]
    up, down = wh._powers(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(wh._BYTE[b] * up[: len(b)], out=sums[1:])
    h = wh.mix((sums[ends] - sums[edge]) * down[edge])

    def count(table):
        c = np.zeros(len(b) + 1, np.int64)
        np.cumsum(table[b], out=c[1:])
        return c[ends] - c[edge]

    upper, lower, digit = count(_UPPER), count(_LOWER), count(_DIGIT)
    return h, kind[edge], 4 * np.minimum(upper, 2) + 2 * (lower > 0) + (digit > 0), edge


def _tokens(data: bytes) -> tuple[np.ndarray, ...]:
    """The same for any length, in blocks. A block ends after a space; a run of
    wh.BLOCK bytes without one is cut there, which depends on the text alone."""
    b, parts, at = np.frombuffer(data, np.uint8), [], 0
    while at < len(b):
        to = min(at + wh.BLOCK + 2, len(b))  # a group of texts, with the ends of its lines, is one block
        if to < len(b):
            space = np.flatnonzero(_KIND[b[at:to]] == 0)
            to = at + int(space[-1]) + 1 if len(space) else to
        h, kind, how, where = _block(b[at:to])
        parts.append((h, kind, how, where + at))
        at = to
    return parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def features(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Slots and values of each text, which depend on that text alone; without
    tokens, none."""
    out = []
    mask = np.uint64(2**BITS - 1)
    for lo, hi in wh.groups(texts):
        part = texts[lo:hi]
        at = np.cumsum([0] + [len(t) + 1 for t in part])
        h, kind, how, where = _tokens(b"\n".join(part) + b"\n")
        first = np.searchsorted(where, at)
        again = np.zeros(len(h) + 1, bool)
        again[1:-1] = h[1:] == h[:-1]
        again[first] = False  # a text's first token repeats none
        shape = np.where(kind == 2, h, wh.mix((2 * how + again[:-1] + 1000).astype(np.uint64)))
        grams = [wh.ngrams(x, n) + np.uint64(k) for k, (x, n) in enumerate(((h, 1), (h, 2), (shape, 1), (shape, 2), (shape, 3)))]
        grams = [((wh.mix(g) & mask).astype(np.int32), n) for g, n in zip(grams, (1, 2, 1, 2, 3), strict=True)]
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            slots, counts = np.unique(np.concatenate([g[a : max(a, b - n + 1)] for g, n in grams]), return_counts=True)
            values = np.sqrt(counts)
            out.append((slots, (values / max(1e-9, np.sqrt((values * values).sum()))).astype(np.float32)))
    return out


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, float]:
    """Weights and bias by follow-the-regularised-leader, in the rows' order."""
    n, z = np.zeros(2**BITS + 1), np.zeros(2**BITS + 1)

    def weights(i):
        return np.where(np.abs(z[i]) <= L1, 0.0, -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for slots, values, y in rows:
            i = np.append(slots, 2**BITS)
            x = np.append(values, 1.0)
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    w = weights(np.arange(2**BITS + 1))
    return w[:-1].astype(np.float32), float(w[-1])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        with np.errstate(over="ignore"):
            v = features(wh.utf8(batch.column(2)))
        yield pa.record_batch(
            [batch.column(0), batch.column(1), pa.array([s.tobytes() for s, _ in v], pa.binary()), pa.array([x.astype(np.float16).tobytes() for _, x in v], pa.binary())],
            names=["doc_id", "y", "slots", "values"],
        )


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = model.value
        for batch in batches:
            texts, scores = wh.utf8(batch.column(1)), []
            for lo in range(0, len(texts), 1000):
                with np.errstate(over="ignore"):
                    scores += [float(1 / (1 + np.exp(-np.clip(w[s] @ x + bias, -35, 35)))) for s, x in features(texts[lo : lo + 1000])]
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64())], names=["row", "score"])

    return tidy(run, "quality")


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)) == HELD_OUT


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> tuple[np.ndarray, float]:
    """Learns from at most TRAIN_ROWS labelled documents, those with the least
    hash of their doc_id, outside the held-out fold. Null labels, and labels
    other than 0 and 1, are not used; of several for a document, the least. Of
    several rows with one doc_id the least text is learnt from."""
    spark = docs.sparkSession
    ship(spark)
    y = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id")))
    y = y.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("y"))
    y = first_present(y, docs, TRAIN_ROWS)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(y), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    rows = texts.mapInArrow(tidy(_vectors, "quality"), "doc_id long, y int, slots binary, values binary").toArrow()
    cols = [rows.column(c).to_pylist() for c in ("doc_id", "y", "slots", "values")]
    order = sorted(range(len(cols[0])), key=lambda k: ((cols[0][k] * 0x9E3779B97F4A7C15) % 2**64, cols[2][k]))
    return fit([(np.frombuffer(cols[2][k], np.int32), np.frombuffer(cols[3][k], np.float16).astype(np.float32), cols[1][k]) for k in order])


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", model: tuple[np.ndarray, float] | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    score is the likelihood of label 1, from the text alone; null and empty
    texts have the score of the bias. Without labelled rows all scores are 0.5.
    A null doc_id is not in the held-out fold. Ties at 0.5 are predicted 1.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model or train(docs, labels, label))
    out = docs.select(F.col("doc_id").cast("long").alias("row"), F.col("text").cast("string").alias("text")).mapInArrow(_score(shared), "row long, score double")
    out = out.select(F.col("row").alias("doc_id"), F.coalesce(held_out(F.col("row")), F.lit(False)).alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _keep(model, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = model.value
        for batch in batches:
            texts, keep = wh.utf8(batch.column(batch.schema.get_field_index("text"))), []
            for lo in range(0, len(texts), 1000):
                with np.errstate(over="ignore"):
                    keep += [bool(1 / (1 + np.exp(-np.clip(w[s] @ x + bias, -35, 35))) >= least) for s, x in features(texts[lo : lo + 1000])]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return tidy(run, "quality")


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label))
    return docs.mapInArrow(_keep(shared, least), docs.schema)
