"""Token-ID files: documents compressed one by one under a shared dictionary.

A store is a folder of shards. A shard holds consecutive documents in ascending
doc_id order and is laid out as

    magic "IGTOK1" | u16 width of an id | 32 bytes sha256 of the dictionary
    frames: one zstandard frame for each document, its ids little-endian
    index: for each document  i64 doc_id, u64 offset, u32 length, u64 ids
    u64 offset of the index | u64 documents | magic

so one short document costs a seek, the index entry and a frame. The dictionary
lies beside the shards under its hash; it is trained on the serialised ids of
at most DICTIONARY_DOCS documents, of each at most SAMPLE_PARTS stretches of
SAMPLE_BYTES spread evenly over its whole length. That bears on the files' size
alone, never on their content.

Shards are written to shared storage under a name of their own and renamed, so
a task that runs twice leaves one whole file of each attempt, and the manifest
names those of the attempts that counted.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkglass.llm.workers import tidy
from inkglass.session import scratch_dir, ship, stored

MAGIC = b"IGTOK1"
END_ID = 1
DICTIONARY_DOCS, DICTIONARY_BYTES, LEVEL = 1000, 64 << 10, 3
SAMPLE_PARTS, SAMPLE_BYTES = 8, 4 << 10
CACHE, KEPT = 400_000, 48  # runs that a generation of a worker's memory holds, of at most so many characters
TOKENIZER = "word_bpe_49k.json"
SHARDS = "shard string, n_docs long, n_ids long, first_id long, null_ids boolean"
ENTRY = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("length", "<u4"), ("ids", "<u8")])
NO_ID = -(2**63)  # stands for a null doc_id


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level pieces."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)}


class Encoder(dict):
    """Serialised ids of whole texts, through the tokenizers library, which sees
    a word again only when it was forgotten.

    The tokenizer never joins what white space parts, so texts are cut there,
    and a run is looked up here. A new run is cut further as the tokenizer does
    it, in lower case: into words, digits and runs of other marks, each of which
    the library's model encodes. Runs beyond Latin letters, or with the strings
    of special tokens, go to the whole tokenizer as they are, and so do texts
    with characters that only some count as white space.

    What it knows has two generations of at most CACHE short runs; when the
    younger is full it takes the elder's place, and what is met again comes
    back. Longer runs are not kept.
    """

    LATIN = re.compile("[\\t\\n\\r\\x20-\\x7e\xa1-\u012f\u0131-\u017f]*")
    PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff\u0100-\u017f]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\\sa-z0-9\xaa\xb5\xba\xdf-\xf6\xf8-\xff\u0100-\u017f\xb2\xb3\xb9\xbc-\xbe]+")
    ODD = "\x0b\x0c\x1c\x1d\x1e\x1f\x85\u1680"
    BYTES = _byte_letters()

    def __init__(self, path: str, width: int = 2):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merged = self.tokenizer.model.tokenize
        if max(self.tokenizer.get_vocab(with_added_tokens=True).values()) >= 256**width:
            raise ValueError(f"ids of {path} don't fit in {width} bytes")
        self.kind = {2: "H", 4: "I"}[width]
        self.end = array(self.kind, [END_ID]).tobytes()
        self.elder: dict[str, bytes] = {}

    def __missing__(self, run: str) -> bytes:
        ids = self.elder.get(run)
        if ids is None:
            ids = self._learn(run)
        if len(run) <= KEPT:
            if len(self) >= CACHE:
                self.elder = dict(self)
                self.clear()
            self[run] = ids
        return ids

    def _whole(self, text: str) -> bytes:
        return array(self.kind, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn(self, run: str) -> bytes:
        if not (run.isascii() and run.isprintable() or self.LATIN.fullmatch(run)) or "<|" in run:
            return self._whole(run)
        low = run.lower()
        if low != run or not low.isalpha():
            pieces = self.PIECE.findall(low)
            if pieces != [run]:
                return b"".join(map(self.__getitem__, pieces))
        return array(self.kind, [x.id for x in self.merged(low if low.isascii() else low.encode().decode("latin-1").translate(self.BYTES))]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Serialised ids of each text, the end id last."""
        get = self.__getitem__
        return [(self._whole(t) if any(c in t for c in self.ODD) else b"".join(map(get, t.split()))) + self.end for t in texts]


@functools.lru_cache(maxsize=1)
def encoder(path: str, width: int) -> Encoder:
    """One a worker process: what it has learnt serves the tasks after."""
    return Encoder(path, width)


def _files(url: str):
    """File system and path: whatever store the url names, as the cluster's."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(url if "://" in url or url.startswith("file:") else f"file://{os.path.abspath(url)}")


def train_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary's bytes. Where the samples are too few to train on,
    fixed runs of ids stand beside them."""
    import zstandard

    filler = [np.random.default_rng(k).integers(0, 256, 512, dtype=np.uint8).tobytes() * 2 for k in range(64)]
    for some, size in ((samples, DICTIONARY_BYTES), (samples, DICTIONARY_BYTES >> 4), ([*samples, *filler], DICTIONARY_BYTES >> 4)):
        try:
            return zstandard.train_dictionary(size, some).as_bytes()
        except zstandard.ZstdError:
            continue
    raise ValueError("no dictionary could be trained")


def stretches(ids: bytes) -> list[bytes]:
    """Short ids whole; of longer ones SAMPLE_PARTS stretches from start to end."""
    if len(ids) <= SAMPLE_PARTS * SAMPLE_BYTES:
        return [ids]
    return [ids[at : at + SAMPLE_BYTES] for at in ((len(ids) - SAMPLE_BYTES) * k // (SAMPLE_PARTS - 1) for k in range(SAMPLE_PARTS))]


def _sample(path: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, width)
        for batch in batches:
            some = [x for ids in enc.encode([x or "" for x in batch.column(0).to_pylist()]) for x in stretches(ids)]
            yield pa.record_batch([pa.array(some, pa.binary())], names=["ids"])

    return tidy(run, "token_store")


def _write(path: str, folder: str, dictionary, width: int):
    """A shard of each partition, which is sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        enc = encoder(path, width)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary.value) if dictionary.value else None)
        files, at = _files(folder)
        name = f"{uuid.uuid4().hex}.tok"
        out, index, size = None, [], 0
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo in range(0, len(ids), 200):
                some = [x or "" for x in texts.slice(lo, 200).to_pylist()]
                for i, t in zip(ids[lo : lo + 200], enc.encode(some), strict=True):
                    if out is None:
                        out = files.open_output_stream(f"{at}/{name}.part")
                        size = out.write(MAGIC + struct.pack("<H", width) + hashlib.sha256(dictionary.value).digest())
                    frame = packer.compress(t)
                    index.append((NO_ID if i is None else i, size, len(frame), len(t) // width))
                    size += out.write(frame)
        if out is None:
            return
        rows = np.array(index, ENTRY)
        out.write(rows.tobytes() + struct.pack("<QQ", size, len(rows)) + MAGIC)
        out.close()
        files.move(f"{at}/{name}.part", f"{at}/{name}")
        yield pa.record_batch(
            [pa.array([name]), pa.array([len(rows)], pa.int64()), pa.array([int(rows["ids"].sum())], pa.int64()), pa.array([int(rows["doc_id"][0])], pa.int64()), pa.array([bool(rows["doc_id"][0] == NO_ID)])],
            names=["shard", "n_docs", "n_ids", "first_id", "null_ids"],
        )

    return tidy(run, "token_store")


class Shard:
    """Reads a shard: all documents in order, or one by its place."""

    def __init__(self, folder: str, name: str, dictionary: bytes | None = None):
        import zstandard

        files, at = _files(folder)
        self.file = files.open_input_file(f"{at}/{name}")
        size = self.file.size()
        head = self.file.read_at(len(MAGIC) + 34, 0)
        tail = self.file.read_at(len(MAGIC) + 16, size - len(MAGIC) - 16)
        if head[:6] != MAGIC or tail[16:] != MAGIC:
            raise ValueError(f"{name} is no whole shard")
        self.width, digest = struct.unpack("<H", head[6:8])[0], head[8:]
        if dictionary is None:
            with files.open_input_stream(f"{at}/{digest.hex()}.dict") as f:
                dictionary = f.read()
        if hashlib.sha256(dictionary).digest() != digest:
            raise ValueError(f"{name} needs another dictionary")
        start, n = struct.unpack("<QQ", tail[:16])
        self.index = np.frombuffer(self.file.read_at(n * ENTRY.itemsize, start), ENTRY)
        self.unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def __getitem__(self, k: int) -> np.ndarray:
        e = self.index[k]
        return np.frombuffer(self.unpacker.decompress(self.file.read_at(int(e["length"]), int(e["offset"]))), f"<u{self.width}").astype("<u4")

    def find(self, doc_id: int) -> np.ndarray | None:
        k = int(np.searchsorted(self.index["doc_id"], doc_id))
        return self[k] if k < len(self.index) and self.index["doc_id"][k] == doc_id else None

    def close(self) -> None:
        self.file.close()


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(folder, row["shard"])
                n = shard.index["ids"].astype(np.int64)
                start = row["before"] + np.cumsum(n) - n
                for lo in range(0, len(n), 5000):
                    hi = min(lo + 5000, len(n))
                    ids = [None if x == NO_ID else x for x in shard.index["doc_id"][lo:hi].tolist()]
                    crc = [zlib.crc32(shard[k].tobytes()) for k in range(lo, hi)]
                    cols = [pa.array(x, pa.int64()) for x in (ids, start[lo:hi], n[lo:hi], crc)]
                    yield pa.record_batch(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"])
                shard.close()

    return tidy(run, "token_store")


def write_store(docs: DataFrame, folder: str, tokenizer: str | None = None, width: int = 2) -> DataFrame:
    """Writes (doc_id, text) as a store under ``folder`` and returns its
    manifest: a row for each shard with its documents, ids, first doc_id, and
    the ids of all shards before it. Null texts count as empty: the end id
    alone. A null doc_id comes first; rows of one doc_id stand together.
    """
    spark = docs.sparkSession
    ship(spark)
    path = tokenizer or default_tokenizer()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    named = docs.where("doc_id is not null").withColumn("h", F.xxhash64("text"))
    few = named.select("doc_id", "h").distinct().orderBy(F.crc32(F.col("doc_id").cast("string")), "doc_id", "h").limit(DICTIONARY_DOCS)
    samples = named.join(F.broadcast(few), ["doc_id", "h"]).groupBy("doc_id", "h").agg(F.min("text").alias("text")).orderBy(F.crc32(F.col("doc_id").cast("string")), "doc_id", "h").select("text")
    dictionary = train_dictionary([r.ids for r in samples.mapInArrow(_sample(path, width), "ids binary").toLocalIterator()])
    files, at = _files(folder)
    files.create_dir(at, recursive=True)
    with files.open_output_stream(f"{at}/{hashlib.sha256(dictionary).hexdigest()}.dict") as f:
        f.write(dictionary)
    rows = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.length("text"), F.xxhash64("text"))
    shards = stored(rows.mapInArrow(_write(path, folder, spark.sparkContext.broadcast(dictionary), width), SHARDS), folder, "manifest_parts")
    ordered = sorted(shards.collect(), key=lambda r: r.first_id)  # a row for each task
    before, out = 0, []
    for r in ordered:
        out.append((r.shard, r.n_docs, r.n_ids, r.first_id, before))
        before += r.n_ids
    return spark.createDataFrame(out, "shard string, n_docs long, n_ids long, first_id long, before long")


def read_store(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    n = max(1, manifest.count())
    return manifest.repartition(n, "shard").mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_store(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes a store to the shared folder and reads it back."""
    folder = scratch_dir(docs.sparkSession) + "/tokens"
    return read_store(write_store(docs, folder, tokenizer), folder)
