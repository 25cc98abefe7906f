"""Vector codes by small codebooks, with a VA-file before the distances.

A vector becomes integers and is cut into parts; a part's code is the index of
the nearest entry of its position's codebook. Codebooks are few and small, so
every task holds them. For each position a VA-file stands before the entries:
each of an entry's coordinates is quantised to BITS bits, the number of a cell
that holds as many entries as any other. A query part looks its coordinates up
in a table of least and greatest squared distances to the cells, and sums of
these bound its distance to every entry from below and above. Only entries
whose lower bound is not over the least upper bound are refined, with distances
in integers; nearest is exact, and of equals the lowest index.

Rounds of assignment and averaging run in the tasks; a task hands on a sum for
each entry and coordinate, so what reaches the driver is bounded by the size of
the codebooks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkglass.llm.workers import tidy
from inkglass.session import scratch_dir, ship, stored

PARTS, ENTRIES, ROUNDS, BITS = 16, 64, 2, 3
SCALE = 256
MOST = 65_536.0  # components beyond it count as it
SLICE = 2_048  # vectors assigned at once
BROADCAST_LABELS = 100_000  # at most this many labels' sums are broadcast; beyond it, a salted shuffle join
SALTS = 16


def integer_vectors(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, label, v) of the rows whose vector is not null and has finite
    components only; v holds floor(256 * x)."""
    x = F.col(column).cast("array<double>")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.floor(F.greatest(F.least(c, F.lit(MOST)), F.lit(-MOST)) * SCALE).cast("int"))
    return rows.where(x.isNotNull() & whole).select(F.col("vec_id").cast("long").alias("vec_id"), "label", v.alias("v"))


class Cells:
    """The VA-file of one position's entries, in order of their indexes."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        k, width = entries.shape
        cells = min(k, 2**BITS)
        order = np.argsort(entries, axis=0, kind="stable")
        self.cell = np.empty((k, width), np.int64)
        np.put_along_axis(self.cell, order, np.broadcast_to((np.arange(k) * cells // k)[:, None], (k, width)), 0)
        self.low = np.stack([[entries[self.cell[:, d] == c, d].min() for c in range(cells)] for d in range(width)])
        self.high = np.stack([[entries[self.cell[:, d] == c, d].max() for c in range(cells)] for d in range(width)])

    def candidates(self, q: np.ndarray) -> np.ndarray:
        """Of each query, the entries that may be nearest."""
        lower = np.zeros((len(q), len(self.entries)), np.int64)
        upper = np.zeros_like(lower)
        for d in range(q.shape[1]):
            x = q[:, d, None]
            under, over = self.low[d] - x, x - self.high[d]
            lower += (np.maximum(np.maximum(under, over), 0) ** 2)[:, self.cell[:, d]]
            upper += (np.maximum(-under, -over) ** 2)[:, self.cell[:, d]]
        return lower <= upper.min(axis=1)[:, None]

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each query, and the squared distance."""
        r, e = np.nonzero(self.candidates(q))
        d = ((q[r] - self.entries[e]) ** 2).sum(axis=1)
        every = np.arange(len(q))
        best = np.minimum.reduceat(d, np.searchsorted(r, every))
        hits = np.flatnonzero(d == best[r])
        return e[hits[np.searchsorted(r[hits], every)]], best


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of integers, zeros after those that are shorter."""
    n = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(n), width), np.int64)
    out[np.arange(width) < n[:, None]] = flat
    return out


def _assigned(batches: Iterator[pa.RecordBatch], books: np.ndarray):
    """(slice of a batch, its vectors cut into parts, codes, errors)"""
    parts, _, width = books.shape
    files = [Cells(b) for b in books]
    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE):
            rows = batch.slice(lo, SLICE)
            v = _matrix(rows.column(rows.schema.get_field_index("v")), parts * width).reshape(-1, parts, width)
            codes, errors = zip(*(f.nearest(v[:, p]) for p, f in enumerate(files)), strict=True)
            yield rows, v, np.stack(codes, axis=1), np.sum(errors, axis=0)


def _sums(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for _, v, codes, _ in _assigned(batches, books):
            for p in range(len(books)):
                np.add.at(total[p], codes[:, p], v[:, p])
                n[p] += np.bincount(codes[:, p], minlength=n.shape[1])
        part, entry, place = (x.ravel() for x in np.indices(books.shape))
        used = n[part, entry] > 0
        part, entry, place = part[used], entry[used], place[used]
        yield pa.record_batch([pa.array(part), pa.array(entry), pa.array(place), pa.array(n[part, entry]), pa.array(total[part, entry, place])], names=["part", "entry", "place", "n", "total"])

    return tidy(run, "vector_codes")


def _codes(books: np.ndarray):
    digits = np.array([f"{k:02x}" for k in range(256)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, codes, errors in _assigned(batches, books):
            yield pa.record_batch([rows.column(0), rows.column(1), pa.array(["".join(x) for x in digits[codes]], pa.string()), pa.array(errors, pa.int64())], names=["vec_id", "label", "code", "error"])

    return tidy(run, "vector_codes")


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (part, entry, place) of ``vectors`` (vec_id, v): the first
    entries by vec_id, averaged over their parts ``rounds`` times. Means are
    floored; an entry that no part is nearest to stays. None without vectors."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    if not first:
        return None
    width = max(1, -(-vectors.agg(F.max(F.size("v"))).head()[0] // parts))
    books = np.zeros((len(first), parts * width), np.int64)
    for k, row in enumerate(first):
        books[k, : len(row.v)] = row.v
    books = np.ascontiguousarray(books.reshape(len(first), parts, width).transpose(1, 0, 2))
    for _ in range(rounds):
        sums = vectors.select("v").mapInArrow(_sums(books), "part long, entry long, place long, n long, total long")
        books = books.copy()
        for r in sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
            books[r.part, r.entry, r.place] = r.total // r.n
    return books


def digest(books: np.ndarray | None) -> str:
    return hashlib.sha256(",".join(map(str, [] if books is None else books.ravel().tolist())).encode()).hexdigest()


def compressed(rows: DataFrame, column: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray | None]:
    """(vec_id, label, code, error) for the vectors of ``rows`` (vec_id,
    ``column``, label), and their codebooks.

    Rows whose vector is null or holds null or non-finite components are left
    out. Vectors that are shorter than the longest, or whose length no number
    of parts divides, go on with zeros; components beyond 65,536 count as that.
    With fewer vectors than entries the codebooks are as small. Of repeated
    vec_ids each row is coded, and those with the least components come first
    among the entries; a null vec_id comes last.
    """
    spark = rows.sparkSession
    ship(spark)
    where = scratch_dir(spark)
    vectors = stored(integer_vectors(rows, column), where, "vectors")
    books = train(vectors, parts, entries, rounds)
    kind = vectors.schema["label"].dataType.simpleString()
    schema = f"vec_id long, label {kind}, code string, error long"
    if books is None:
        return spark.createDataFrame([], schema), None
    return stored(vectors.mapInArrow(_codes(books), schema), where, "codes"), books


def vector_codes(rows: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): ``compressed``
    with the production parameters; label_error is the error summed over equal
    labels, nulls together, and null where it passes 64 bits."""
    coded, books = compressed(rows)
    sums = coded.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "of")
    if sums.count() <= BROADCAST_LABELS:
        out = coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("of")))
    else:
        sums = sums.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
        out = salted.join(sums, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("deal")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """The same by scoring every entry, in SQL."""
    near = """
{a} AS MATERIALIZED (
  SELECT p.vec_id, p.part, arg_min(c.entry, d * 64 + c.entry) AS entry, min(d) AS d
  FROM p JOIN {c} c ON c.part = p.part, LATERAL (SELECT CAST(list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i]))) AS BIGINT) AS d) GROUP BY ALL
)"""
    mean = """
{b} AS MATERIALIZED (
  SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM {c} c LEFT JOIN (
    SELECT part, entry, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS v FROM (
      SELECT p.part, a.entry, i, sum(p.v[i]) AS s, count(*) AS n FROM p JOIN {a} a USING (vec_id, part), LATERAL (SELECT unnest(range(1, len(p.v) + 1)) AS i) GROUP BY ALL
    ) GROUP BY part, entry
  ) m USING (part, entry)
)"""
    steps = []
    for k in range(ROUNDS):
        steps += [near.format(a=f"a{k}", c=f"c{k}"), mean.format(b=f"c{k + 1}", c=f"c{k}", a=f"a{k}")]
    steps.append(near.format(a="a", c=f"c{ROUNDS}"))
    return f"""
WITH k AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT vec_id, part, v[part * len(v) // {PARTS} + 1 : (part + 1) * len(v) // {PARTS}] AS v FROM k, range({PARTS}) AS t(part)
), c0 AS MATERIALIZED (
  SELECT part, entry, v FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k QUALIFY entry < {ENTRIES}) USING (vec_id)
), {",".join(steps)}, e AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a GROUP BY vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM c{ROUNDS}) AS codebooks_sha256
FROM e JOIN k USING (vec_id)
"""


ORACLE = _oracle()
