"""License scans: ordered signature rules with suppression of contained spans.

A rule is a regex with a label, a priority, a weight, and the keyword without
which it cannot match: one word, as the words of a phrase may be wrapped. A text
that holds no keyword is done after one pass over its bytes; of the others only
the rules whose keyword is there are run. Of two detections of which one
contains the other, the one of higher priority stays, then the longer, then the
earlier rule; what only overlaps in part stays.

Names, notices and clauses are written out, a rule each; those of licenses with
versions are made from families, versions and the ways they are written:
titles, short forms, SPDX ids and tags, file headers, urls.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkglass.llm import wordhash as wh
from inkglass.llm.license_phrases import CLAUSES, NAMES, WEAK
from inkglass.llm.workers import tidy
from inkglass.session import ship

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
#: The phrases that are always looked for, as consecutive words.
PHRASES = {
    ("gnu", "general", "public", "license"): "gpl",
    ("apache", "license"): "apache",
    ("cc", "by"): "cc-by",
    ("mit", "license"): "mit",
}

#: Family: label, keyword, title, short form, versions, url part.
FAMILIES = [
    ("gpl", "gpl", "gnu general public license", "gpl", ("1.0", "2.0", "3.0"), "licenses/gpl"),
    ("lgpl", "lgpl", "gnu (?:lesser|library) general public license", "lgpl", ("2.0", "2.1", "3.0"), "licenses/lgpl"),
    ("agpl", "agpl", "gnu affero general public license", "agpl", ("1.0", "3.0"), "licenses/agpl"),
    ("gfdl", "fdl", "gnu free documentation license", "gfdl", ("1.1", "1.2", "1.3"), "licenses/fdl"),
    ("apache", "apache", "apache (?:software )?license", "apache", ("1.0", "1.1", "2.0"), "apache.org/licenses"),
    ("mpl", "mpl", "mozilla public license", "mpl", ("1.0", "1.1", "2.0"), "mozilla.org/mpl"),
    ("epl", "epl", "eclipse public license", "epl", ("1.0", "2.0"), "eclipse.org/legal/epl"),
    ("eupl", "eupl", "european union public licen[cs]e", "eupl", ("1.0", "1.1", "1.2"), "eupl"),
    ("cddl", "cddl", "common development and distribution license", "cddl", ("1.0", "1.1"), "cddl"),
    ("cpl", "cpl", "common public license", "cpl", ("1.0",), "cpl1"),
    ("artistic", "artistic", "artistic license", "artistic", ("1.0", "2.0"), "artistic-license"),
    ("osl", "osl", "open software license", "osl", ("1.0", "2.0", "2.1", "3.0"), "osl-3"),
    ("afl", "afl", "academic free license", "afl", ("1.1", "2.0", "2.1", "3.0"), "afl-3"),
    ("bsl", "bsl", "boost software license", "bsl", ("1.0",), "license_1_0"),
    ("lppl", "lppl", "latex project public license", "lppl", ("1.0", "1.1", "1.2", "1.3"), "lppl"),
    ("php", "php", "php license", "php", ("3.0", "3.01"), "php.net/license"),
    ("psf", "psf", "python software foundation license", "psf", ("2.0",), "psf-license"),
    ("zpl", "zpl", "zope public license", "zpl", ("1.1", "2.0", "2.1"), "zpl"),
    ("ecl", "ecl", "educational community license", "ecl", ("1.0", "2.0"), "ecl-2"),
    ("ofl", "ofl", "sil open font license", "ofl", ("1.0", "1.1"), "scripts.sil.org/ofl"),
    ("odbl", "odbl", "open database license", "odbl", ("1.0",), "licenses/odbl"),
    ("unlicense", "unlicense", "the unlicense", "unlicense", (), "unlicense.org"),
]
#: Creative Commons: elements, title.
COMMONS = [
    ("cc-by", "by", "attribution"),
    ("cc-by-sa", "by-sa", "attribution-sharealike"),
    ("cc-by-nd", "by-nd", "attribution-no ?deriv(?:ative)?s"),
    ("cc-by-nc", "by-nc", "attribution-non-?commercial"),
    ("cc-by-nc-sa", "by-nc-sa", "attribution-non-?commercial-sharealike"),
    ("cc-by-nc-nd", "by-nc-nd", "attribution-non-?commercial-no ?deriv(?:ative)?s"),
]
COMMONS_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
#: Label, keyword, phrase: licenses without versions, and their texts' best-known lines.
PLAIN = [
    ("mit", "licen", "mit license"), ("mit", "licen", "licensed under (?:the )?mit"), ("mit", "licen", "license: mit"),
    ("mit", "hereby", "permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("bsd", "bsd", "(?:(?:simplified|new|revised|modified|original) )?bsd license"), ("bsd-2-clause", "bsd", "(?:bsd|freebsd) 2-clause"), ("bsd-3-clause", "bsd", "bsd 3-clause"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms, with or without modification"), ("bsd-4-clause", "bsd", "bsd 4-clause"),
    ("isc", "licen", "isc license"), ("isc", "permission", "permission to use, copy, modify, and/?(?:or)? ?distribute this software for any purpose"),
    ("zlib", "licen", "zlib license"), ("zlib", "as-is", "this software is provided 'as-is', without any express or implied warranty"),
    ("cc0", "cc0", "cc0(?: 1\\.0)?(?: universal)?"), ("cc0", "domain", "dedicated to the public domain"), ("public-domain", "domain", "(?:in|into|released to) the public domain"),
    ("wtfpl", "wtfpl", "wtfpl"), ("wtfpl", "fuck", "do what the fuck you want to public license"), ("beerware", "licen", "beer-?ware license"),
    ("proprietary", "reserved", "all rights reserved"), ("proprietary", "proprietary", "proprietary and confidential"),
    ("copyright", "copyright", "copyright (?:\\(c\\) |© ?)?(?:19|20)\\d\\d"), ("openssl", "licen", "openssl license"), ("curl", "licen", "curl license"),
    ("ncsa", "ncsa", "university of illinois/ncsa open source license"), ("x11", "licen", "x11 license"), ("json", "evil", "the software shall be used for good, not evil"),
    ("vim", "licen", "vim license"), ("ruby", "licen", "ruby license"), ("libpng", "licen", "libpng license"), ("postgresql", "licen", "postgresql license"),
]

#: Of those, what is an SPDX id too.
SPDX = {"mit", "bsd-2-clause", "bsd-3-clause", "bsd-4-clause", "isc", "zlib", "wtfpl", "curl", "ncsa", "x11", "json", "vim", "ruby", "libpng", "postgresql", "openssl"}


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int  # higher wins where one span contains another
    weight: float
    keyword: str
    pattern: str


def _spaced(phrase: str) -> str:
    """A phrase whose words may stand apart by any white space."""
    return phrase.replace(" ?", r"\s*").replace(" ", r"\s+")


LINK = re.compile(r"https?://\S*")


def _linked(url: str) -> str:
    """A link that holds ``url``, to its end."""
    return rf"https?://\S*{re.escape(url)}\S*"


def rules() -> list[Rule]:
    out: list[Rule] = []
    for label, key, title, short, versions, url in FAMILIES:
        stem = "licen" if "licen" in title else key
        out.append(Rule(label, 20, 0.8, stem, rf"\b{_spaced(title)}\b"))
        out.append(Rule(label, 10, 0.5, "licen", rf"\blicen[cs]ed?\s+under\s+(?:the\s+)?(?:terms\s+of\s+(?:the\s+)?)?{re.escape(short)}\b"))
        out.append(Rule(label, 30, 0.9, url, _linked(url)))
        out.append(Rule(label, 15, 0.6, "licen", rf"\b{re.escape(short)}[- ]?licen[cs]ed?\b"))
        for v in versions:
            e, whole = re.escape(v), v.removesuffix(".0")
            number = rf"{re.escape(whole)}(?:\.0)?" if whole != v else e
            name = f"{label}-{v}"
            out.append(Rule(name, 40, 0.95, stem, rf"\b{_spaced(title)},?\s+(?:version|v)?\.?\s*{number}(?![\d.]\d)"))
            out.append(Rule(name + "-or-later", 50, 0.95, stem, rf"\b{_spaced(title)},?\s+(?:version|v)?\.?\s*{number},?\s+or\s+(?:\(at\s+your\s+option\)\s+)?(?:any\s+)?later"))
            out.append(Rule(name, 35, 0.9, key, rf"\b{re.escape(short)}[- ]?(?:v|version\s*)?{number}(?![\d.]\d)"))
            out.append(Rule(name, 60, 1.0, "spdx", rf"spdx-license-identifier:\s*{re.escape(short)}-{e}(?:-only)?\b"))
            out.append(Rule(name + "-or-later", 65, 1.0, "spdx", rf"spdx-license-identifier:\s*{re.escape(short)}-{e}(?:-or-later|\+)"))
    for label, parts, title in COMMONS:
        out.append(Rule(label, 20 + len(parts), 0.8, "cc", rf"\bcc[- ]{parts.replace('-', '[- ]')}\b"))
        out.append(Rule(label, 20 + len(parts), 0.8, "commons", rf"\bcreative\s+commons\s+{_spaced(title.replace('-', r'[-\s]?'))}\b"))
        out.append(Rule(label, 30 + len(parts), 0.9, "creativecommons.org", rf"creativecommons\.org/licenses/{parts}/"))
        for v in COMMONS_VERSIONS:
            out.append(Rule(f"{label}-{v}", 40 + len(parts), 0.95, "cc", rf"\bcc[- ]{parts.replace('-', '[- ]')}[- ]{re.escape(v)}(?![\d.]\d)"))
            out.append(Rule(f"{label}-{v}", 50 + len(parts), 0.95, "creativecommons.org", rf"creativecommons\.org/licenses/{parts}/{re.escape(v)}"))
    for label, key, phrase in [*PLAIN, *NAMES, *CLAUSES]:
        out.append(Rule(label, 15 if label in WEAK else 25, 0.3 if label in ("copyright", "disclaimer") else 0.8, key, rf"(?<!\w){_spaced(phrase)}(?!\w)"))
        if label in SPDX:
            out.append(Rule(label, 60, 1.0, "spdx", rf"spdx-license-identifier:\s*{label}\b"))
    return list(dict.fromkeys(out))


class Scanner:
    """Runs rules over texts in lower case. Patterns that open with a word
    border are searched for without it, which lets a search jump to their first
    characters, and their matches are held against the border after. Links are
    found once for all their rules, each to where it ends."""

    BORDER = (r"\b", r"(?<!\w)")

    def __init__(self, own: list[Rule] | None = None):
        import ahocorasick

        self.by_key: dict[str, list] = {}
        self.links: list[tuple[int, Rule]] = []
        for k, r in enumerate(rules() if own is None else own):
            if r.pattern == _linked(r.keyword):
                self.links.append((k, r))
                self.by_key.setdefault(r.keyword, [])
                continue
            border = next((b for b in self.BORDER if r.pattern.startswith(b)), "")
            self.by_key.setdefault(r.keyword, []).append((k, r, re.compile(r.pattern.removeprefix(border)), bool(border)))
        self.keywords = ahocorasick.Automaton()
        for key in {*self.by_key, *(p[-1] if p[-1] == "license" else p[0] for p in PHRASES)}:
            self.keywords.add_word(key, key)
        self.keywords.make_automaton()

    def present(self, text: str) -> set[str]:
        return {k for _, k in self.keywords.iter(text)}

    def detections(self, text: str, present: set[str]) -> list[tuple[int, int, Rule]]:
        """(start, end, rule) of what no other contains, by place."""
        found = []
        links = [(k, r) for k, r in self.links if r.keyword in present]
        for m in LINK.finditer(text) if links else ():
            begin = text.index("://", m.start()) + 3
            found += [(-r.priority, m.start() - m.end(), k, m.start(), m.end(), r) for k, r in links if text.find(r.keyword, begin, m.end()) >= 0]
        for key in present & self.by_key.keys():
            for k, r, p, border in self.by_key[key]:
                m = p.search(text)
                while m:
                    s = m.start()
                    inside = border and s > 0 and (text[s - 1].isalnum() or text[s - 1] == "_")
                    if not inside:
                        found.append((-r.priority, s - m.end(), k, s, m.end(), r))
                    m = p.search(text, s + 1 if inside else m.end())
        # none that is kept contains another, so their starts and their ends rise together
        starts: list[int] = []
        kept: list[tuple[int, int, Rule]] = []
        for *_, s, e, r in sorted(found, key=lambda x: x[:4]):
            at = bisect_left(starts, s)
            inside = at and kept[at - 1][1] >= e
            if not inside and (at == len(kept) or kept[at][0] > s and kept[at][1] > e):
                starts.insert(at, s)
                kept.insert(at, (s, e, r))
        return kept


@functools.lru_cache(maxsize=1)
def standard() -> Scanner:
    return Scanner()


def phrases(words: list[str]) -> list[tuple[int, str]]:
    """Places of the fixed phrases: first word and label."""
    out = []
    for phrase, label in PHRASES.items():
        n, last = len(phrase), phrase[-1]
        k = -1
        while True:
            try:
                k = words.index(last, k + 1)
            except ValueError:
                break
            if k >= n - 1 and tuple(words[k - n + 1 : k + 1]) == phrase:
                out.append((k - n + 1, label))
    return sorted(out)


def word_counts(texts: list[bytes]) -> np.ndarray:
    n = np.zeros(len(texts), np.int64)
    for lo, hi in wh.groups(texts):
        part = texts[lo:hi]
        at = np.cumsum([0] + [len(t) + 1 for t in part])
        inside = ~wh.PUNCT[np.frombuffer(b"\n".join(part) + b"\n", np.uint8)]
        begins = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        begins = np.append(0, begins) if len(inside) and inside[0] else begins
        n[lo:hi] = np.diff(np.searchsorted(begins, at))
    return n


SCANNED = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<start:int,end:int,label:string,priority:int>>"
_DETECTION = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("priority", pa.int32())]))


def _scan(own: list[Rule] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = standard() if own is None else Scanner(own)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                texts = wh.utf8(part.column(1))
                rows = []
                for t in texts:
                    text = t.lower().decode()
                    present = scanner.present(text)
                    if not present:
                        rows.append((0, None, None, "", "", 0.0, []))
                        continue
                    base = phrases(WORD.findall(text))
                    found = scanner.detections(text, present)
                    doubt = 0.1 if base else 1.0
                    for *_, r in found:
                        doubt *= 1 - 0.999 * r.weight
                    names = sorted({x for _, x in base})
                    rows.append((len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(names), ",".join(sorted({*names, *(r.label for *_, r in found)})), 1 - doubt,
                                 [{"start": s, "end": e, "label": r.label, "priority": r.priority} for s, e, r in found]))
                cols = list(zip(*rows, strict=True)) or [[]] * 7
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), _DETECTION]
                yield pa.record_batch(
                    [part.column(0), pa.array(word_counts(texts)), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"],
                )

    return tidy(run, "licenses")


def license_scan(docs: DataFrame, own: list[Rule] | None = None) -> DataFrame:
    """A row for each row of ``docs``: doc_id, n_words, n_base, first_word,
    last_word, base_labels, labels, score, detections.

    Words are runs of letters, digits and characters beyond ASCII, A-Z folded.
    base counts the places of the fixed phrases; detections are the rules' spans
    (code points of the text, end exclusive). score is the chance that a license
    is named, each detection counted as independent. Null texts count as empty:
    no words, no labels, score 0.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_scan(own), SCANNED)
