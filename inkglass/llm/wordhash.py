"""Vectorised word and shingle hashing over batches of UTF-8 texts.

Texts are handled as bytes. Words are maximal runs of bytes outside a separator
class, A-Z folded to a-z; a word's 64-bit hash is a polynomial over random byte
values, taken from prefix sums, so a batch costs a few numpy passes and no
Python loop over words. Separators are ASCII, so UTF-8 sequences stay whole.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 19  # bytes hashed at once; bounds the temporaries
_rng = np.random.Generator(np.random.PCG64(0x5EED))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 2**64)
_POW: list[np.ndarray] = []

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Everything in ASCII but letters and digits.
PUNCT = np.zeros(256, bool)
PUNCT[:128] = True
PUNCT[48:58] = PUNCT[65:91] = PUNCT[97:123] = False


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW[0]) < n:
        n = max(n, BLOCK + 1)
        with np.errstate(over="ignore"):
            _POW[:] = [np.cumprod(np.r_[np.uint64(1), np.full(n - 1, b, np.uint64)], dtype=np.uint64) for b in (_BASE, _INV)]
    return _POW[0], _POW[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_block(b: np.ndarray, sep: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = ~sep[b]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(values[b] * up[: len(b)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), starts, ends


def byte_values(seed: int) -> np.ndarray:
    """Values of bytes for another hash, which tells A-Z from a-z."""
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words(data: bytes, sep: np.ndarray = SPACE, values: np.ndarray = _BYTE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, start and end bytes of all words of ``data``."""
    b = np.frombuffer(data, np.uint8)
    out, at = [], 0
    while at < len(b):
        to = min(at + BLOCK, len(b))
        while to < len(b):  # cut where a word ends
            cut = np.flatnonzero(sep[b[at:to]])
            if len(cut):
                to = at + int(cut[-1]) + 1
                break
            to = min(to + BLOCK, len(b))
        h, s, e = _hash_block(b[at:to], sep, values)
        out.append((h, s + at, e + at))
        at = to
    if not out:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z
    return out[0] if len(out) == 1 else tuple(np.concatenate(x) for x in zip(*out, strict=True))


def groups(texts: list[bytes], limit: int = BLOCK):
    """Runs of consecutive texts of at most ``limit`` bytes, or one longer text."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def batch_words(texts: list[bytes], sep: np.ndarray = SPACE, values: np.ndarray = _BYTE):
    """For each run of texts: its first index, word hashes, word starts and
    ends (bytes in the joined run), the first word of each text (with the total
    last) and the first byte of each text."""
    for lo, hi in groups(texts):
        part = texts[lo:hi]
        at = np.cumsum([0] + [len(t) + 1 for t in part])
        h, s, e = words(b"\n".join(part) + b"\n", sep, values)
        yield lo, h, s, e, np.searchsorted(s, at), at


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position, for all positions that have n."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    acc = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        acc = (acc ^ (acc >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) + h[k : len(h) - n + 1 + k]
    return mix(acc + np.uint64(n))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position, as ``ngrams`` but another one,
    in time that does not grow with n."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for a in range(0, len(out), BLOCK // 2):
        part = h[a : a + BLOCK // 2 + n - 1]
        up, down = _powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        out[a : a + BLOCK // 2] = mix((sums[n:] - sums[:-n]) * down[: len(sums) - n])
    return out


def shingle_sets(texts: list[bytes], n: int = 4, sep: np.ndarray = SPACE) -> list[np.ndarray]:
    """Each text's sorted distinct n-word shingles as 64-bit hashes. A text of
    fewer words has its whole sequence as one shingle; one without words none."""
    out: list[np.ndarray] = []
    for _, h, _, _, first, _ in batch_words(texts, sep):
        grams = ngrams(h, n)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= n:
                out.append(np.unique(grams[a : b - n + 1]))
            else:
                out.append(ngrams(h[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def utf8(column) -> list[bytes]:
    """The texts of an Arrow string column as bytes; null counts as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
