"""Removal of repeated passages, with a count-min sketch before the grouping.

A window is ``width`` consecutive words of one document; a word goes when it is
covered by a window whose words also start anywhere else.

1. Documents are copied to the shared folder as they are read, in parts of a
   piece of an input partition each, bucketed by part: from there on they never
   move, and what other stages find out comes to them.
2. Each task counts its windows in a sparse count-min sketch of DEPTH rows: the
   cells that it met, and whether twice. A row has a few dozen cells a window of
   all documents and is cut into shards; sketches are merged shard by shard, and
   each part gets back those of its cells that hold two windows or more. A sum
   is never less than a count, so no repeated window is lost.
3. Windows all whose cells hold two or more are grouped by 128 bits of hash, a
   part's equal windows once; each part gets the places of those repeated.
4. Each part cuts the covered words out.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkglass.llm import wordhash as wh
from inkglass.llm.workers import tidy
from inkglass.session import scratch_dir, ship

WIDTH = 35
DEPTH = 2
CELLS = 4  # of a row of the sketch, a byte of text at least
SHARD = 25  # bits: cells of a shard
PIECES = 8  # parts of an input partition
FLUSH = 1 << 20  # windows counted before a sketch is handed on
BUCKET = 1 << 23  # bytes of text a bucket of exact grouping
SEVERAL = np.uint32(2**32 - 1)
WHOLE = 1 << 20  # texts up to so many bytes are split into words at once

_ONE, _TWO = wh.byte_values(0xC0DE), wh.byte_values(0xF00D)
_SALT = [np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC949D7C7509E6557)]
_GAPS = re.compile(rb"[\x20\x09-\x0D]+")


def _pack(a: np.ndarray) -> bytes:
    """Ascending numbers of 32 bits: their differences by first bytes, second bytes and so on, which compress well."""
    d = np.diff(a.astype(np.uint32), prepend=np.uint32(0))
    return np.ascontiguousarray(d.view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpack(b: bytes) -> np.ndarray:
    d = np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
    return np.cumsum(d, dtype=np.uint32)


def _windows(texts: list[bytes], width: int, values: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of texts: the first one's index, the hashes of their windows in order, and how many each text has."""
    for lo, h, _, _, first, _ in wh.batch_words(texts, wh.SPACE, values):
        n = np.diff(first)
        at = np.arange(max(0, len(h) - width + 1))
        inside = at + width <= np.repeat(first[1:], n)[: len(at)]
        yield lo, wh.windows(h, width)[inside], np.maximum(n - width + 1, 0)


def _cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (wh.mix(h ^ _SALT[row]) >> np.uint64(64 - bits)).astype(np.int64)


def _sketches(width: int, bits: int, shard: int):
    shards = 1 << bits - shard

    def flush(parts: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
        out = []
        for part in np.unique(parts).tolist():
            mine = h[parts == part]
            for row in range(DEPTH):
                cells = np.sort(_cells(mine, row, bits))
                cells = cells[np.r_[np.ones(min(2, len(cells)), bool), cells[2:] != cells[:-2]]]
                cuts = np.searchsorted(cells, np.arange(shards + 1) << shard)
                for k in np.flatnonzero(np.diff(cuts)).tolist():
                    out.append((row * shards + k, part, _pack(cells[cuts[k] : cuts[k + 1]] - (k << shard))))
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["shard", "part", "cells"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, found = 0, []
        for batch in batches:
            parts = batch.column(0).to_numpy()
            with np.errstate(over="ignore"):
                for lo, h, n in _windows(wh.utf8(batch.column(1)), width, _ONE):
                    found.append((np.repeat(parts[lo : lo + len(n)], n), h))
                    held += len(h)
                    if held >= FLUSH:
                        yield flush(*(np.concatenate(x) for x in zip(*found, strict=True)))
                        held, found = 0, []
        if held:
            with np.errstate(over="ignore"):
                yield flush(*(np.concatenate(x) for x in zip(*found, strict=True)))

    return tidy(run, "substring_dedup")


def _merge(shard: int):
    """All parts' sketches of a shard: each part's cells that hold two windows or more."""

    def run(table: pa.Table) -> pa.Table:
        once, twice = np.zeros(1 << shard, bool), np.zeros(1 << shard, bool)
        for b in table["cells"]:
            cells = _unpack(b.as_py())
            twice[cells[1:][cells[1:] == cells[:-1]]] = True
            twice[cells[once[cells]]] = True
            once[cells] = True
        parts, out = [], []
        for part, b in zip(table["part"].to_pylist(), table["cells"], strict=True):
            cells = np.unique(_unpack(b.as_py()))
            cells = cells[twice[cells]]
            if len(cells):
                parts.append(part)
                out.append(_pack(cells))
        return pa.table({"part": pa.array(parts, pa.int64()), "shard": pa.array([table["shard"][0].as_py()] * len(parts), pa.int64()), "cells": pa.array(out, pa.binary())})

    return run


def _rows(docs: pa.Table) -> tuple[pa.Table, list[bytes]]:
    """A part's documents in order of their rows, and their texts."""
    docs = docs.take(np.argsort(docs["row"].to_numpy()))
    return docs, wh.utf8(docs["text"].combine_chunks())


def _candidates(width: int, bits: int, shard: int, buckets: int):
    shards = 1 << bits - shard

    def run(key: tuple, docs: pa.Table, heavy: pa.Table) -> pa.Table:
        part, out = key[0].as_py(), []
        names = heavy["shard"].to_pylist()
        cells: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(DEPTH)]
        for k, b in zip(names, heavy["cells"], strict=True):
            cells[k // shards].append(_unpack(b.as_py()).astype(np.int64) + (k % shards << shard))
        full = [np.unique(np.concatenate(c)) for c in cells]
        if all(map(len, full)):
            _, texts = _rows(docs)
            at, places, one, two = 0, [], [], []
            with np.errstate(over="ignore"):
                for (_, h, _), (_, g, _) in zip(_windows(texts, width, _ONE), _windows(texts, width, _TWO), strict=True):
                    hit = np.ones(len(h), bool)
                    for row in range(DEPTH):
                        c = _cells(h, row, bits)
                        hit &= full[row][np.minimum(np.searchsorted(full[row], c), len(full[row]) - 1)] == c
                    k = np.flatnonzero(hit)
                    places.append(k + at)
                    one.append(h[k])
                    two.append(g[k])
                    at += len(h)
                place, one, two = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (places, one, two))
            order = np.lexsort((two, one))
            place, one, two = place[order], one[order], two[order]
            first = np.flatnonzero(np.r_[len(one) > 0, (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
            n = np.diff(np.r_[first, len(one)])
            known = np.sort(place[np.repeat(n > 1, n)])
            if len(known):
                out.append((part % buckets, part, None, None, _pack(known)))
            to, one, two = ((one[first] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32), one[first], two[first]
            place = np.where(n > 1, SEVERAL, place[first].astype(np.uint32))
            cuts = np.searchsorted(to, np.arange(buckets + 1, dtype=np.uint64))
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                a, b = cuts[k], cuts[k + 1]
                out.append((k, part, one[a:b].tobytes(), two[a:b].tobytes(), place[a:b].tobytes()))
        columns = zip(*out, strict=True) if out else [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "part", "one", "two", "places"])

    return run


def _exact(table: pa.Table) -> pa.Table:
    """Of a bucket's windows, a part's equal ones once: each part's places of those that other parts have too.
    Rows without hashes are places already known."""
    known = table.filter(table["one"].is_null())
    table = table.filter(table["one"].is_valid())
    one, two = (np.frombuffer(b"".join(table[c].to_pylist()), np.uint64) for c in ("one", "two"))
    order = np.lexsort((two, one))
    one, two = one[order], two[order]
    new = np.r_[len(one) > 0, (one[1:] != one[:-1]) | (two[1:] != two[:-1])]
    n = np.diff(np.r_[np.flatnonzero(new), len(one)])
    again = np.zeros(len(one), bool)
    again[order] = np.repeat(n > 1, n)
    parts, out, at = known["part"].to_pylist(), known["places"].to_pylist(), 0
    for part, b in zip(table["part"].to_pylist(), table["places"].to_pylist(), strict=True):
        place = np.frombuffer(b, np.uint32)
        mine = np.sort(place[again[at : at + len(place)] & (place != SEVERAL)])
        at += len(place)
        if len(mine):
            parts.append(part)
            out.append(_pack(mine))
    return pa.table({"part": pa.array(parts, pa.int64()), "places": pa.array(out, pa.binary())})


def single_spaced(text: bytes) -> bytes:
    return b" ".join(text.split()) if len(text) <= WHOLE else _GAPS.sub(b" ", text).strip(b" ")


def _cut(width: int):
    def run(docs: pa.Table, repeated: pa.Table) -> pa.Table:
        docs, texts = _rows(docs)
        places = np.sort(np.concatenate([np.zeros(0, np.uint32), *(_unpack(b.as_py()) for b in repeated["places"])])).astype(np.int64)
        n_words, removed, spans, kept, seen = [], [], [], [], 0
        for lo, _, s, e, first, at in wh.batch_words(texts):
            n = np.diff(first)
            before = np.r_[0, np.cumsum(np.maximum(n - width + 1, 0))]
            a, b = np.searchsorted(places, (seen, seen + before[-1]))
            mine = places[a:b] - seen
            doc = np.searchsorted(before, mine, side="right") - 1
            start = mine - before[doc] + first[doc]
            open_ = np.zeros(len(s) + 1, np.int64)
            np.add.at(open_, start, 1)
            np.add.at(open_, start + width, -1)
            gone = np.cumsum(open_)[:-1] > 0
            edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
            # a passage ends where its document does
            for k in range(len(n)):
                x, y = int(first[k]), int(first[k + 1])
                n_words.append(y - x)
                text = texts[lo + k]
                if not gone[x:y].any():
                    removed.append(0)
                    spans.append([])
                    kept.append(single_spaced(text))
                    continue
                cuts = np.r_[x, edge[np.searchsorted(edge, x, side="right") : np.searchsorted(edge, y)], y]
                out = [(p - x, q - x) for p, q in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if gone[p]]
                removed.append(sum(q - p for p, q in out))
                spans.append([{"start": p, "end": q} for p, q in out])
                kept.append(b" ".join(single_spaced(text[s[p] - at[k] : e[q - 1] - at[k]]) for p, q in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if not gone[p]))
            seen += int(before[-1])
        ints = pa.int64()
        return pa.table({
            "doc_id": docs["doc_id"], "n_words": pa.array(n_words, ints), "n_removed": pa.array(removed, ints),
            "removed": pa.array(spans, pa.list_(pa.struct([("start", ints), ("end", ints)]))), "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
        })

    return run


def without_repeats(docs: DataFrame, width: int = WIDTH, shard: int = SHARD) -> DataFrame:
    """(doc_id, n_words, n_removed, removed, kept_text) for each row (doc_id,
    text): ``removed`` has the ranges of words, from 0 and without the last,
    that windows of ``width`` words cover which start anywhere else too, in the
    same text or another; kept_text the others, joined by one space.

    Words lie between ASCII white space. A null text has no words; texts of
    fewer than ``width`` words stay whole. Repeated rows repeat each other's
    windows. Windows are judged on the input, so all copies of a passage go.
    """
    spark = docs.sparkSession
    ship(spark)
    name = f"inkglass_{uuid.uuid4().hex}"
    row = F.monotonically_increasing_id()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("row", row)
    docs = docs.withColumn("part", F.shiftright("row", 33) * PIECES + F.pmod("row", F.lit(PIECES))).withColumn("size", F.octet_length("text").cast("long"))
    docs.write.option("path", f"{scratch_dir(spark)}/parts").option("compression", "zstd").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "part").saveAsTable(name)
    parts = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay
    size = parts.agg(F.sum("size")).head()[0] or 0
    bits, buckets = max(shard, int(CELLS * size).bit_length()), max(1, -(-size // BUCKET))
    sketches = parts.select("part", "text").mapInArrow(_sketches(width, bits, shard), "shard long, part long, cells binary")
    heavy = sketches.groupBy("shard").applyInArrow(_merge(shard), "part long, shard long, cells binary")
    texts = parts.select("part", "row", "text").groupBy("part")
    found = texts.cogroup(heavy.groupBy("part")).applyInArrow(_candidates(width, bits, shard, buckets), "bucket long, part long, one binary, two binary, places binary")
    repeated = found.groupBy("bucket").applyInArrow(_exact, "part long, places binary")
    texts = parts.select("part", "row", "doc_id", "text").groupBy("part")
    return texts.cogroup(repeated.groupBy("part")).applyInArrow(_cut(width), "doc_id long, n_words long, n_removed long, removed array<struct<start: long, end: long>>, kept_text string")


def substring_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): ``without_repeats`` at 35 words."""
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = f"""
WITH w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(w[i : i + {WIDTH - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WIDTH - 2})) AS i FROM w)
), r AS (
  SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY g) > 1
), c AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + {WIDTH})) AS k FROM r
), k AS (
  SELECT e.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY e.k) AS t
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM w) e ANTI JOIN c ON c.doc_id = e.doc_id AND c.k = e.k GROUP BY e.doc_id
)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""
