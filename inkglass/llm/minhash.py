"""MinHash near-duplicate detection with b-bit signatures.

1. One pass over the texts makes, for each document, its set of distinct word
   shingles (64-bit hashes), a digest of the set, ``K`` minima, ``K / ROWS``
   band keys from the whole minima, and a signature of the lowest ``BITS`` bits
   of each minimum, packed. Documents with one set count once from there on.
2. Documents that share a band key are candidates. Their similarity is
   estimated by counting the signature slots that are equal, corrected for
   those equal by chance; estimates within six standard deviations of the
   threshold pass. Members of a bucket meet its first member; those that remain
   under other labels are compared in cells of two bounded blocks, which give
   only the edges that join something. The components of what passed are
   families: two documents that share a bucket and might be similar enough are
   in one.
3. Families are confirmed on full sets, made again from their texts alone, in
   cells of two bounded blocks. A cell tells the links that join something, so
   its output grows with its members and not with their pairs. Families of
   many blocks first meet their first member, so that cells compare only what
   is not united yet.

At similarity 0.8 a pair shares none of 32 bands of 4 rows once in 2*10^7.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkglass.llm import wordhash as wh
from inkglass.llm.components import components
from inkglass.llm.workers import tidy
from inkglass.session import scratch_dir, ship, stored

K, ROWS, BITS = 128, 4, 4
BLOCK = 256  # members of a block,
BLOCK_SHINGLES = 1_000_000  # and about so many shingles
BROADCAST_IDS = 1_000_000  # at most this many ids are broadcast; beyond it, a shuffle join
PER_TASK = 500  # members confirmed against one copy of a first member's set
SLICE = 500  # texts hashed at once

_rng = np.random.Generator(np.random.PCG64(20250101))
_A = _rng.integers(0, 2**32, K, dtype=np.uint32)[:, None] | np.uint32(1)
_B = _rng.integers(0, 2**32, K, dtype=np.uint32)[:, None]
_SALT = wh.mix(np.arange(1, K // ROWS + 1, dtype=np.uint64))
_ONES = 0x1111111111111111


def minima(s: np.ndarray) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32)
    low = np.full(K, 2**32 - 1, np.uint32)
    for k in range(0, len(x), 512):
        np.minimum(low, (x[None, k : k + 512] * _A + _B).min(axis=1), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    rows = low.reshape(-1, K // ROWS, ROWS).astype(np.uint64)
    key = np.broadcast_to(_SALT, rows.shape[:2]).copy()
    for r in range(ROWS):
        key = wh.mix(key ^ rows[:, :, r])
    return key.view(np.int64)


def pack(low: np.ndarray) -> np.ndarray:
    """The lowest BITS bits of each minimum, after mixing: K * BITS / 64 words."""
    bits = (wh.mix(low.astype(np.uint64)) & np.uint64(2**BITS - 1)).astype(np.uint8)
    return np.ascontiguousarray((bits[:, ::2] << BITS) | bits[:, 1::2]).view("<i8")


_CHANCE = 2.0**-BITS


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from packed signatures: the share of equal slots, corrected
    for slots that are equal by chance."""
    x = (a ^ b).view(np.uint64)
    x = x | x >> np.uint64(1)
    x = (x | x >> np.uint64(2)) & np.uint64(_ONES)
    return np.maximum(0, (1 - np.bitwise_count(x).sum(axis=-1, dtype=np.int64) / K - _CHANCE) / (1 - _CHANCE))


def estimated(a: Column, b: Column) -> Column:
    """The same, in SQL, for arrays of words."""

    def other(i: int) -> Column:
        x = a[i].bitwiseXOR(b[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(_ONES)))

    same = 1 - sum((other(i) for i in range(K * BITS // 64)), F.lit(0)) / K
    return F.greatest(F.lit(0.0), (same - _CHANCE) / (1 - _CHANCE))


def floor_of(threshold: float) -> float:
    """Six standard deviations under the threshold."""
    p = threshold + (1 - threshold) * _CHANCE
    return threshold - 6 * (p * (1 - p) / K) ** 0.5 / (1 - _CHANCE)


SIGNED = "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, bands array<long>, sig array<long>"


def _sign(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                with np.errstate(over="ignore"):
                    sets = wh.shingle_sets(wh.utf8(part.column(2)), n)
                    low = np.stack([minima(s) for s in sets])
                    keys, sig = band_keys(low), pack(low)
                    a = [int(wh.mix(s).sum(dtype=np.uint64).view(np.int64)) for s in sets]
                    b = [int(wh.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64)) for s in sets]
                yield pa.record_batch(
                    [
                        part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                        pa.array([k.tolist() if len(s) else [] for k, s in zip(keys, sets, strict=True)], pa.list_(pa.int64())), pa.array(sig.tolist(), pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "bands", "sig"],
                )

    return tidy(run, "minhash")


def _similar(a: np.ndarray, b: np.ndarray, per_cent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return bool(both) and 100 * both >= per_cent * (len(a) + len(b) - both)


def _meet_first(n: int, per_cent: int):
    """Rows (family, part, kind, node, text), the family's first member's first
    in each (family, part): the members that are linked to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for batch in batches:
            a, b = [], []
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                families, parts, kinds, nodes = (part.column(i).to_pylist() for i in range(4))
                with np.errstate(over="ignore"):
                    sets = wh.shingle_sets(wh.utf8(part.column(4)), n)
                for i, s in enumerate(sets):
                    if kinds[i] == 0:
                        at, own = (families[i], parts[i]), s
                    elif at == (families[i], parts[i]) and _similar(own, s, per_cent):
                        a.append(families[i])
                        b.append(nodes[i])
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return tidy(run, "minhash")


def _in_cells(floor: float, exact: tuple[int, int] | None):
    """Rows (key, i, j, side, node, label, n_shingles, sig[, text]) sorted by
    cell (key, i, j): edges between nodes that may be similar, or with ``exact``
    are, and are not united by the edges before. Nodes of one side are not
    compared, but on side 2."""

    def edges(rows: pa.Table) -> tuple[list[int], list[int]]:
        side, node, label, size = (rows.column(c).to_numpy() for c in ("side", "node", "label", "n_shingles"))
        sig = rows.column("sig").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
        sets = None
        if exact:
            with np.errstate(over="ignore"):
                sets = wh.shingle_sets(wh.utf8(rows.column("text").combine_chunks()), exact[0])
        label = np.unique(label, return_inverse=True)[1]
        a, b = [], []
        for i in range(rows.num_rows - 1):
            j = np.flatnonzero((label[i + 1 :] != label[i]) & ((side[i + 1 :] != side[i]) | (side[i] == 2)) & (np.minimum(size[i + 1 :], size[i]) >= floor * np.maximum(size[i + 1 :], size[i]))) + i + 1
            if not len(j):
                continue
            e = estimate(sig[j], sig[i])
            j = j[e >= floor][np.argsort(-e[e >= floor], kind="stable")]
            for k in j.tolist():
                if label[k] != label[i] and (sets is None or _similar(sets[i], sets[k], exact[1])):
                    a.append(int(node[i]))
                    b.append(int(node[k]))
                    label[label == label[k]] = label[i]
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows = None, []

        def out():
            a, b = edges(pa.Table.from_batches(rows)) if rows else ([], [])
            return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            cells = list(zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j")), strict=True))
            lo = 0
            for k in range(1, len(cells) + 1):
                if k == len(cells) or cells[k] != cells[lo]:
                    if cells[lo] != cell:
                        yield out()
                        cell, rows = cells[lo], []
                    rows.append(batch.slice(lo, k - lo))
                    lo = k
        yield out()

    return tidy(run, "minhash")


def _cells(rows: DataFrame) -> DataFrame:
    """Deals rows (key, node, label, n_shingles, ...) of keys with several
    labels to cells. Each key's nodes go to blocks, and every two blocks meet in
    one cell; blocks under the key's commonest label don't meet each other."""
    by = rows.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    top = by.groupBy("key").agg(F.max(F.struct("n", "label", "s")).alias("top"), F.count("*").alias("labels"), F.sum("n").alias("n"), F.sum("s").alias("s")).where("labels > 1")

    def blocks(n: Column, s: Column) -> Column:
        return F.greatest(F.ceil(n / BLOCK), F.ceil(s / BLOCK_SHINGLES)).cast("int")

    top = top.select("key", F.col("top.label").alias("top"), blocks(F.col("top.n"), F.col("top.s")).alias("hot"), blocks(F.col("n") - F.col("top.n"), F.col("s") - F.col("top.s")).alias("rest"))
    rows = rows.join(top, "key")
    h = F.xxhash64("node")
    mine = F.pmod(h, F.col("rest")).cast("int")

    def cell(i, j, side) -> Column:
        return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))

    hot = F.transform(F.sequence(F.lit(0), F.col("rest") - 1), lambda i: cell(i, -1 - F.pmod(h, F.col("hot")), F.lit(0)))
    cold = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("hot") - 1), lambda j: cell(mine, -1 - j, F.lit(1))),
        F.transform(F.sequence(F.lit(0), F.col("rest") - 1), lambda k: cell(F.least(k, mine), F.greatest(k, mine), F.when(k == mine, 2).when(k > mine, 1).otherwise(0))),
    )
    return rows.withColumn("cell", F.explode(F.when(F.col("label") == F.col("top"), hot).otherwise(cold))).drop("top", "hot", "rest").select("*", "cell.*").drop("cell")


def _run_cells(rows: DataFrame, columns: list[str], run: Callable) -> DataFrame:
    rows = rows.select("key", "i", "j", "side", "node", "label", "n_shingles", "sig", *columns)
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long")


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, text) of the rows whose doc_id and text_hash are in ``ids``, each once."""
    few = ids.count() <= BROADCAST_IDS
    out = docs.select(F.col("doc_id").alias("node"), "text_hash", "text").join(F.broadcast(ids) if few else ids, ["node", "text_hash"], "left_semi")
    return out.dropDuplicates(["node"]).select("node", "text")


def near_duplicates(docs: DataFrame, n: int = 5, per_cent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for rows of (doc_id, text).

    Documents are linked when ``100 * intersection >= per_cent * union`` over
    their distinct n-word shingles; component_id is the smallest doc_id
    reachable over links. Null and empty texts have no shingles and no links.
    Rows without doc_id stay alone, with a null component, and are kept. Of
    rows with one doc_id and different texts, each stands for itself among equal
    texts, and the one of the least hash of its text is compared with others.
    """
    spark = docs.sparkSession
    ship(spark)
    where = scratch_dir(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    floor = floor_of(per_cent / 100)
    signed = stored(docs.mapInArrow(_sign(n), SIGNED), where, "signed")
    some = signed.where("n_shingles > 0 and doc_id is not null")
    reps = stored(some.groupBy("n_shingles", "set_a", "set_b").agg(F.min("doc_id").alias("node")), where, "reps")
    nodes = some.join(reps, ["n_shingles", "set_a", "set_b"]).where("doc_id = node")
    first = Window.partitionBy("node").orderBy("text_hash")
    nodes = nodes.withColumn("place", F.row_number().over(first)).where("place = 1").drop("place")
    keyed = stored(nodes.select(F.explode("bands").alias("key"), "node"), where, "keyed")
    full = keyed.groupBy("key").agg(F.count("*").alias("m"), F.min("node").alias("first")).where("m > 1").select("key", "first")
    members = stored(keyed.join(full, "key"), where, "members")
    sigs = stored(nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "text_hash", "n_shingles", "sig"), where, "sigs")

    # families, from signatures alone
    one, two = (sigs.select(*(F.col(c).alias(f"{c}_{s}") for c in ("node", "n_shingles", "sig"))) for s in "ab")
    pairs = members.where("node <> first").select(F.col("first").alias("node_a"), F.col("node").alias("node_b")).distinct().join(one, "node_a").join(two, "node_b")
    pairs = pairs.where(F.least("n_shingles_a", "n_shingles_b") >= floor * F.greatest("n_shingles_a", "n_shingles_b")).where(estimated(F.col("sig_a"), F.col("sig_b")) >= floor)
    edges = stored(pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")), where, "close")
    labels = components(edges)
    rows = members.select("key", "node").join(sigs, "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    more = stored(_run_cells(_cells(rows), [], _in_cells(floor, None)), where, "closer")
    if not more.isEmpty():
        labels = components(edges.unionByName(more))
    families = stored(labels.withColumnRenamed("label", "key").join(sigs, "node"), where, "families")

    # links, from full sets
    texts = stored(_texts(docs, families.select("node", "text_hash")), where, "texts")
    large = families.groupBy("key").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("s")).where((F.col("m") > 2 * BLOCK) | (F.col("s") > 2 * BLOCK_SHINGLES))
    large = stored(large.select(F.col("key").alias("family"), F.ceil(F.col("m") / PER_TASK).cast("int").alias("parts")), where, "large")
    labels = families.select("node", F.col("node").alias("label"))
    links = spark.createDataFrame([], "a long, b long")
    if not large.isEmpty():
        own = large.select("family", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.col("family").alias("node"))
        rest = families.where("node <> key").join(large, F.col("key") == F.col("family")).select("family", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), F.lit(1).alias("kind"), "node")
        both = own.unionByName(rest).join(texts, "node").select("family", "part", "kind", "node", "text")
        links = stored(both.repartition("family", "part").sortWithinPartitions("family", "part", "kind").mapInArrow(_meet_first(n, per_cent), "a long, b long"), where, "first_links")
        labels = families.select("node").join(components(links), "node", "left").withColumn("label", F.coalesce("label", "node"))
    rows = _cells(families.join(labels, "node")).join(texts, "node")
    links = links.unionByName(stored(_run_cells(rows, ["text"], _in_cells(floor, (n, per_cent))), where, "links"))
    # rows without words, however many, have nothing to be joined with
    out = some.join(reps, ["n_shingles", "set_a", "set_b"]).join(components(links), "node", "left").select("doc_id", "n_shingles", "node", "label")
    out = out.unionByName(signed.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles"), allowMissingColumns=True)
    comp = F.coalesce("label", "node", "doc_id")
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, n: int = 5, per_cent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: of each
    component the smallest doc_id, once; rows without doc_id all stay."""
    gone = near_duplicates(docs, n, per_cent).where("not kept").select("doc_id").distinct()
    out = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if again.isEmpty():
        return out
    return out.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(out.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"]))


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) ELSE [array_to_string(w, ' ')] END) AS g FROM w WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(doc_id, other) AS (
  SELECT a, b FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other
), m AS (
  SELECT doc_id, min(other) AS low FROM r GROUP BY doc_id
)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(low, w.doc_id)) AS component_id, coalesce(low, w.doc_id) >= w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.doc_id = w.doc_id
"""
