"""What Catalyst has no expression for, as Arrow-batched Python.

One module holds all of it: hashing with BLAKE2b, winnowing, the protected
sentence splitter, positional regex extraction, sequence matching,
Unicode normal forms, quote matching.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkglass.session import ship

K, WINDOW = 5, 4


_SLICE_ROWS, _SLICE_BYTES = 1024, 1 << 20  # of a batch that is worked on at a time
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
TEXT_SPANS = pa.list_(pa.struct([("text", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _slices(arrays: tuple[pa.Array, ...]) -> Iterator[tuple[int, int]]:
    """Start and length of stretches of rows; a row that is longer than a
    stretch may be is one of its own."""
    n = len(arrays[0])
    size = np.zeros(n, np.int64)
    for a in arrays:
        if pa.types.is_string(a.type) or pa.types.is_binary(a.type) or pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type):
            size += pc.fill_null(pc.binary_length(a), 0).to_numpy(zero_copy_only=False)
    ends, lo = np.cumsum(size), 0
    while lo < n:
        before = ends[lo - 1] if lo else 0
        hi = min(lo + _SLICE_ROWS, max(lo + 1, int(np.searchsorted(ends, before + _SLICE_BYTES, "right"))))
        yield lo, hi - lo
        lo = hi


def _scalar(kind: str, type_: pa.DataType) -> Callable[[Callable], Callable[..., Column]]:
    """A column function from a function of lists, which gives a list or an
    Arrow array. What a task holds in Python doesn't grow with its batches: they
    are Arrow's, and are read and answered in slices. The UDF is made when it
    is used, as its type needs a session."""

    def make(f: Callable) -> Callable[..., Column]:
        def run(batches: Iterator) -> Iterator[pa.Array]:
            for batch in batches:
                arrays = batch if isinstance(batch, tuple) else (batch,)
                for lo, n in _slices(arrays):
                    out = f(*(a.slice(lo, n).to_pylist() for a in arrays))
                    yield out if isinstance(out, pa.Array) else pa.array(out, type_)

        @functools.wraps(f)
        def call(*cols: Column) -> Column:
            ship(SparkSession.getActiveSession())
            return F.arrow_udf(run, kind, F.ArrowUDFType.SCALAR_ITER)(*cols)

        return call

    return make


POINT = "array<struct<hash:bigint,position:int>>"


def _hash(mode: str) -> Callable[[str], int]:
    """The first 64 bits of a digest, as an unsigned number."""
    if mode == "md5":
        return lambda s: int.from_bytes(hashlib.md5(s.encode()).digest()[:8], "big")
    return lambda s: int.from_bytes(hashlib.blake2b(s.encode(), digest_size=8).digest(), "big")


def hash_hex(c: Column) -> Column:
    """A point's hash as sixteen hexadecimal digits."""
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def _shingle_hashes(chars: np.ndarray, at: np.ndarray, k: int, hasher: Callable[[str], int], known: dict[str, int]) -> np.ndarray:
    """Hash of the k characters from each place of ``at``. Each distinct run of
    characters is hashed once: a run is one number as long as the characters
    that occur can be numbered in 64 / k bits, else a row of k numbers."""
    import pandas as pd

    there = np.zeros(int(chars.max(initial=0)) + 1, np.int64)
    there[chars] = 1
    letters, number = np.flatnonzero(there), (np.cumsum(there) - 1)[chars]
    if len(letters) ** k < 2**63:
        key = number[at]
        for j in range(1, k):
            key = key * len(letters) + number[at + j]
        back, key = pd.factorize(key)  # by a hash table, where np.unique sorts
        runs = np.stack([key // len(letters) ** j % len(letters) for j in range(k - 1, -1, -1)], axis=1)
    else:
        runs, back = np.unique(np.stack([number[at + j] for j in range(k)], axis=1), axis=0, return_inverse=True)
    grams = letters[runs].astype("<u4").tobytes().decode("utf-32-le")
    out = np.empty(len(runs), np.uint64)
    for i in range(len(runs)):
        g = grams[i * k : i * k + k]
        h = known.get(g)
        if h is None:
            h = known[g] = hasher(g)
        out[i] = h
    return out[back.reshape(-1)]


def fingerprints(texts: list[str], hasher: Callable[[str], int], known: dict[str, int] | None = None, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Points of all texts: hashes, positions, and how many each text has.

    A text's shingles are its runs of k characters, or a shorter text itself.
    Of every ``window`` neighbours the least hash is a point, the last of equal
    ones; of a text with no more than ``window`` shingles the first least.
    """
    known = {} if known is None else known
    size = np.array([len(t) for t in texts], np.int64)
    n = np.where(size >= k, size - k + 1, np.minimum(size, 1))  # shingles
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    begin, first = np.cumsum(size) - size, np.cumsum(n) - n
    h = np.zeros(int(n.sum()), np.uint64)
    long = np.repeat(size >= k, n)
    place = np.arange(len(h)) - np.repeat(first, n)
    if long.any():
        h[long] = _shingle_hashes(chars, (np.repeat(begin, n) + place)[long], k, hasher, known)
    for i in np.flatnonzero((size > 0) & (size < k)):
        h[first[i]] = hasher(texts[i])
    # windows lie inside one text; a text shorter than that is one window, read from its end
    of = np.repeat(np.arange(len(texts)), n)
    start = np.flatnonzero(place + window <= np.repeat(n, n)) if len(h) else np.zeros(0, np.int64)
    start = start[n[of[start]] > window]
    best = start + window - 1
    for j in range(window - 2, -1, -1):
        best = np.where(h[start + j] < h[best], start + j, best)
    if len(best):
        best = best[np.append(True, best[1:] != best[:-1])]
    few = np.flatnonzero((n > 0) & (n <= window))
    least = first[few].copy()
    for j in range(1, window):
        other = np.minimum(first[few] + j, first[few] + n[few] - 1)
        least = np.where(h[other] < h[least], other, least)
    points = np.sort(np.concatenate([best, least]))
    return h[points], place[points].astype(np.int32), np.bincount(of[points], minlength=len(texts)) if len(points) else np.zeros(len(texts), np.int64)


def segment_pairs(a: str, b: str, hasher: Callable[[str], int], known: dict[str, int] | None = None) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Stretches of ``a`` and of ``b`` under common points, the i-th place of a
    hash in the one with the i-th in the other; what touches is one stretch."""
    h, at, n = fingerprints([a, b], hasher, known)
    places: list[dict[int, list[int]]] = [{}, {}]
    for k, (x, p) in enumerate(zip(h.tolist(), at.tolist(), strict=True)):
        places[int(k >= n[0])].setdefault(x, []).append(p)
    met = [pair for x in places[0].keys() & places[1].keys() for pair in zip(places[0][x], places[1][x], strict=False)]

    def merged(starts: list[int], size: int) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for s in sorted(starts):
            e = min(s + K, size)
            out[-1:] = [(out[-1][0], max(out[-1][1], e))] if out and s <= out[-1][1] else [*out[-1:], (s, e)]
        return out

    return merged([p for p, _ in met], len(a)), merged([q for _, q in met], len(b))


@_scalar("struct<document:array<struct<start:int,end:int>>,source:array<struct<start:int,end:int>>>", pa.struct([("document", SPANS), ("source", SPANS)]))
def segments(a, b):
    hasher, known, out = _hash("md5"), {}, []
    for x, y in zip(a, b, strict=True):
        both = segment_pairs(x or "", y or "", hasher, known)
        out.append({k: [{"start": s, "end": e} for s, e in spans] for k, spans in zip(("document", "source"), both, strict=True)})
    return out


def with_points(df: DataFrame, column: str, mode: str = "md5", keep: list[str] | None = None) -> DataFrame:
    """``df`` with a column ``points``. Batches stay in Arrow end to end."""
    ship(df.sparkSession)
    keep = keep or [c for c in df.columns if c != column]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, known = _hash(mode), {}
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                b = whole.slice(lo, 2000)
                if len(known) > 500_000:
                    known.clear()
                h, at, n = fingerprints([t or "" for t in b.column(b.schema.get_field_index(column)).to_pylist()], hasher, known)
                points = pa.StructArray.from_arrays([pa.array(h.view(np.int64)), pa.array(at, pa.int32())], ["hash", "position"])
                ends = pa.array(np.append(0, np.cumsum(n)), pa.int32())
                yield pa.record_batch([*(b.column(b.schema.get_field_index(c)) for c in keep), pa.ListArray.from_arrays(ends, points)], names=[*keep, "points"])

    return df.select(*keep, *([column] if column not in keep else [])).mapInArrow(run, f"{schema}, points {POINT}")


# Abbreviations that no sentence ends after, and what keeps a mark from ending one when the characters up to it hold it.
ABBREVIATIONS = {"dr.", "prof.", "doç.", "müh.", "yrd.", "tek.", "mim.", "ibid.", "bkz.", "vb.", "vd.", "vs.", "örn.", "t.c.", "rh.", "mp."}
PROTECTED = re.compile(r"(?i:Prof\. Dr\.)|(?<!\d)[.,](?=\d)|\b10\.|(?i:https?|ftp)://|(?:^|\s)\d+\.|\.{3}(?=\s|$)")
LOOK_BACK = 21
_BORDER = re.compile(r"[.!?]\s+(?=[A-ZÇĞİÖŞÜ])")
_MAYBE = re.compile(r"\d|://|\.{3}|[dD][rR]\.")  # each of PROTECTED has one of these


def _ends(text: str, mark: int) -> bool:
    """Whether the mark at this place ends a sentence."""
    word = "".join(text[max(0, mark - 200) : mark].rsplit(None, 1)[-1:]).lower()
    near = text[max(0, mark - LOOK_BACK + 1) : mark + 1]
    return word not in ABBREVIATIONS and word + "." not in ABBREVIATIONS and not (_MAYBE.search(near) and PROTECTED.search(near))


def split_protected(paragraph: str) -> list[tuple[str, int, int]]:
    """Sentences with their code point offsets in the stripped paragraph. One
    ends at a mark before white space and a capital, but for abbreviations,
    headings' numbers and the like."""
    text = paragraph.strip()
    borders = [(m.start() + 1, m.end()) for m in _BORDER.finditer(text) if _ends(text, m.start())]
    starts, ends = [0, *(e for _, e in borders)], [*(s for s, _ in borders), len(text)]
    return [(text[s:e], s, e) for s, e in zip(starts, ends, strict=True) if s < e]


@_scalar("array<struct<text:string,start:int,end:int>>", TEXT_SPANS)
def sentences(c):
    each = [split_protected(x or "") for x in c]
    text, start, end = ([r[k] for rows in each for r in rows] for k in range(3))
    ends = np.cumsum([0, *map(len, each)])
    rows = pa.StructArray.from_arrays([pa.array(text, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["text", "start", "end"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)


@_scalar("double", pa.float64())
def sequence_ratio(a, b):
    """Share of matching characters in the longest matching blocks."""
    return [SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)]


@_scalar("string", pa.string())
def nfc(c):
    return [None if x is None else unicodedata.normalize("NFC", x) for x in c]


@_scalar("string", pa.string())
def unescape_html(c):
    import html

    return [None if x is None else html.unescape(x) for x in c]


def matches(pattern: str, flags: int = 0):
    """Column function: (text, start, end) of a regex's matches, in code points."""
    compiled = re.compile(pattern, flags)

    @_scalar("array<struct<text:string,start:int,end:int>>", TEXT_SPANS)
    def run(c):
        return [[{"text": m[0], "start": m.start(), "end": m.end()} for m in compiled.finditer(x or "")] for x in c]

    return run


# Patterns of citations.
DATE = r"(?:\d{4}[a-zA-Z]?|(?i:t\.?\s*y\.?|n\.?\s*d\.?))"
AUTHOR_WORD = r"[A-ZÇĞİÖŞÜ][A-Za-zÀ-ÖØ-öø-ÿÇĞİÖŞÜçğıöşü'’.-]*"
PAGES = r"(?:\s*,\s*(?:[pP]{1,2}|[sS]{1,2})\.\s*\d+(?:\s*[-–]\s*\d+)?)?"
PARENTHESES = re.compile(r"\(([^()\n]{1,250})\)")
PART = re.compile(rf"^(.+?)\s*,\s*({DATE}){PAGES}\s*$", re.I)
NARRATIVE = re.compile(rf"\b({AUTHOR_WORD}(?:(?:,?\s+)(?:et\s+al\.|vd\.|ve|and|&|{AUTHOR_WORD})){{0,10}})\s+\(({DATE}){PAGES}\)")
NUMBERED = re.compile(r"\[(\d+(?:\s*[-–]\s*\d+|\s*,\s*\d+)*)\]")
DOI = re.compile(r"\b10\.\d{4,9}/[-._;()/:A-Z0-9]+", re.I)
AUTHORS = re.compile(r"[\wÀ-ÖØ-öø-ÿÇĞİÖŞÜçğıöşü .,'’&-]+")
CITATION = "array<struct<raw_text:string,authors:string,year:int,doi:string,numbered_ref:int,char_offset:int,no_date:boolean>>"
_CITATION = pa.list_(pa.struct([("raw_text", pa.string()), ("authors", pa.string()), ("year", pa.int32()), ("doi", pa.string()), ("numbered_ref", pa.int32()), ("char_offset", pa.int32()), ("no_date", pa.bool_())]))


def expand_numbers(text: str, most: int = 100) -> list[int]:
    """Numbers of a list with ranges; a range in reverse is turned, a long one cut."""
    out: set[int] = set()
    for part in text.split(","):
        ends = [int(x) for x in re.split(r"\s*[-–]\s*", part.strip()) if x]
        if ends:
            lo, hi = min(ends), max(ends)
            out.update(range(lo, min(hi, lo + most) + 1))
    return sorted(n for n in out if n > 0)


def _plausible(authors: str) -> bool:
    a = authors.strip()
    return bool(a) and a[0].isupper() and len(a.split()) <= 20 and AUTHORS.fullmatch(a) is not None


def find_citations(paragraph: str) -> list[dict]:
    """Citations of a paragraph by place: in parentheses, then named in the
    sentence, then numbered, then DOIs. Names and DOIs that start inside what
    was found before are not counted again. A number that no int holds is null."""
    out: list[dict] = []
    taken: list[tuple[int, int]] = []

    def add(m: re.Match, **more: object) -> None:
        out.append({"raw_text": m[0], "authors": None, "year": None, "doi": None, "numbered_ref": None, "char_offset": m.start(), "no_date": False} | more)

    def dated(m: re.Match, authors: str, date: str) -> None:
        known = date.strip()[:1].isdigit()
        add(m, authors=authors.strip(), year=int(date[:4]) if known else None, no_date=not known)

    def free(m: re.Match) -> bool:
        return not any(s <= m.start() < e for s, e in taken)

    for m in PARENTHESES.finditer(paragraph) if "(" in paragraph else ():
        parts = [p for p in (PART.fullmatch(x.strip()) for x in m[1].split(";")) if p and _plausible(p[1])]
        for p in parts:
            dated(m, p[1], p[2])
        if parts:
            taken.append(m.span())
    for m in NARRATIVE.finditer(paragraph) if "(" in paragraph else ():
        if free(m):
            dated(m, m[1], m[2])
            taken.append(m.span())
    for m in NUMBERED.finditer(paragraph) if "[" in paragraph else ():
        for n in expand_numbers(m[1]):
            add(m, numbered_ref=n if n < 1 << 31 else None)
        taken.append(m.span())
    for m in DOI.finditer(paragraph) if "10." in paragraph else ():
        if free(m):
            add(m, doi=m[0].rstrip(".,;:)]}>").lower())
    return sorted(out, key=lambda c: c["char_offset"])


@_scalar(CITATION, _CITATION)
def citations(c):
    return [find_citations(x or "") for x in c]


QUOTES = {'"': '"', "“": "”", "«": "»"}


def quote_pairs(text: str) -> list[tuple[int, int]]:
    """Quoted stretches, marks included, by nesting; what is left open is none."""
    out: list[tuple[int, int]] = []
    open_: list[tuple[str, int]] = []
    for i, ch in enumerate(text):
        if open_ and ch == open_[-1][0]:
            out.append((open_.pop()[1], i + 1))
        elif ch in QUOTES:
            open_.append((QUOTES[ch], i))
    return sorted(out)


@_scalar("array<struct<start:int,end:int>>", SPANS)
def quotes(c):
    return [[{"start": s, "end": e} for s, e in quote_pairs(x or "")] for x in c]


_TOKEN = re.compile(r"\b[^\W_]+\b")


def name_like(text: str) -> list[str]:
    """Acronyms, words with capitals inside, and runs of two and more
    capitalised words with only white space between, each once."""
    names: list[str] = []
    run: tuple[int, int, int] | None = None  # start, end, words
    for m in _TOKEN.finditer(text):
        token = m[0]
        odd = len(token) > 1 and token.isupper() or any(map(str.isupper, token[1:]))
        title = not odd and token[0].isupper() and token[1:].islower()
        grows = bool(run and title and not text[run[1] : m.start()].strip())
        if run and not grows:
            if run[2] > 1:
                names.append(text[run[0] : run[1]])
            run = None
        if odd:
            names.append(token)
        elif title:
            run = (run[0], m.end(), run[2] + 1) if grows else (m.start(), m.end(), 1)
    if run and run[2] > 1:
        names.append(text[run[0] : run[1]])
    return list(dict.fromkeys(names))


@_scalar("array<string>", pa.list_(pa.string()))
def entities(c):
    return [name_like(x or "") for x in c]


def passages(paragraphs: list[str], most: int) -> list[str]:
    """Paragraphs joined while they fit in ``most`` characters; longer ones cut."""
    out, held = [], ""
    for p in paragraphs:
        if not p.strip():
            continue
        if held and len(held) + 2 + len(p) > most:
            out.append(held)
            held = ""
        if len(p) > most:
            out += [p[k : k + most] for k in range(0, len(p), most)]
        else:
            held = f"{held}\n\n{p}" if held else p
    return [*out, held] if held else out


def passage_spans(text: str, most: int) -> list[tuple[int, int]]:
    """Start and end of passages of at most ``most`` characters: whole
    paragraphs with the blank lines after them, as many as fit; a longer one is
    cut. Blank paragraphs end up in a passage only between others."""
    if len(text) <= most:
        return [(0, len(text))]
    edges = [0, *(m.end() for m in re.finditer(r"\n\s*\n", text)), len(text)]
    out: list[tuple[int, int]] = []
    open_ = False  # whether the last passage may take more paragraphs
    for s, e in zip(edges, edges[1:], strict=False):
        if not text[s:e].strip():
            continue
        if open_ and e - out[-1][0] <= most:
            out[-1] = (out[-1][0], e)
        elif e - s <= most:
            out.append((s, e))
            open_ = True
        else:
            out += [(k, min(k + most, e)) for k in range(s, e, most)]
            open_ = False
    return out


@_scalar("array<struct<text:string,start:int,end:int>>", TEXT_SPANS)
def passage_column(c, most):
    """Passages of a text with their offsets: each is a slice of it."""
    return [[{"text": (x or "")[s:e], "start": s, "end": e} for s, e in passage_spans(x or "", int(n))] for x, n in zip(c, most, strict=True)]


@_scalar("array<string>", pa.list_(pa.string()))
def docx_paragraphs(c):
    """Paragraphs of .docx bytes: body and table cells in order, blank dropped.
    Null where the bytes are no such file."""
    import io
    import zipfile
    from xml.etree import ElementTree

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

    def read(data: bytes) -> list[str] | None:
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                root = ElementTree.fromstring(z.read("word/document.xml"))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
            return None
        texts = ("".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p"))
        return [t.strip() for t in texts if t.strip()]

    return [None if x is None else read(bytes(x)) for x in c]
