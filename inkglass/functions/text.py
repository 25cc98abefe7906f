"""Text normalisation and splitting as Catalyst expressions.

Everything here is a Column function, so it stays in generated code and is
pushed and pruned with the rest of the plan. What Catalyst has no expression
for is in ``functions.arrow``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns that results depend on.
SENTENCE_END = "(?<=[.!?])\\s+(?=[A-ZÇĞİÖŞÜ])"
WORD = "[\\p{L}\\p{N}]+(?:['’][\\p{L}\\p{N}]+)?"
DOI = "(?i)\\b10\\.\\d{4,9}/[-._;()/:A-Z0-9]+"
ARXIV = "(?i)(?:arxiv:|arxiv\\.org/(?:abs|pdf)/)?([a-z.-]+/\\d{7}|\\d{4}\\.\\d{4,5})"
TURKISH_LETTERS = "çğıöşüÇĞİÖŞÜ"
STOP_WORDS = [
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "shall", "can", "to", "of", "in", "for", "on", "with", "at", "by", "from", "as", "into", "through", "during",
    "before", "after", "above", "below", "between", "under", "again", "that", "this", "these", "those", "and", "but", "or", "nor", "not",
    "so", "very", "just", "than", "too", "also", "about", "such", "it", "its", "they", "them", "their", "we", "our", "he", "she",
    "his", "her", "which", "who", "whom", "what", "where", "when", "ve", "ile", "veya", "bu", "şu", "o", "bir", "için", "olarak", "gibi",
    "olan", "daha", "tarafından", "üzerinde", "üzerine", "göre", "ise", "kadar", "tüm", "bütün", "çok", "en", "ancak", "fakat",
    "çünkü", "ayrıca", "böylece", "nedeniyle", "sonucunda",
]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row: inside a lambda a
    column's expression would be evaluated anew for every element."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, "\\s+", " "))


def fold_turkish(c: Column) -> Column:
    """Lower case in which dotted and dotless i stay apart."""
    return F.lower(F.translate(c, "İI", "iı"))


def normalize_sentence(c: Column) -> Column:
    return collapse(fold_turkish(c))


def normalize_turkish(c: Column) -> Column:
    """As for sentences, with typographic quotes and dashes made plain. Input
    is taken to be composed (NFC); ``functions.arrow.nfc`` makes it so."""
    return normalize_sentence(F.translate(c, "’‘–—", "''--"))


# White space at the ends of a text, and marks that a source's text loses.
ENDS = "^\\s+|\\s+$"
REFERENCE_MARK = "\\[\\d+(?:[,\\-–]\\s*\\d+)*\\]"
CITATION_MARK = "\\([A-ZÀ-ÖØ-öø-ÿÇĞİÖŞÜ][a-zà-öø-ÿçğıöşü]+(?:\\s+(?:et\\s+al\\.|ve\\s+ark\\.|vd\\.))?,\\s*\\d{4}\\)"


def normalize_corpus(c: Column) -> Column:
    """A source's text without its citation marks; ends are trimmed before the
    marks go, not after. ``functions.offsets.corpus_map`` has its places."""
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, ENDS, ""), REFERENCE_MARK, ""), CITATION_MARK, "")
    return F.regexp_replace(fold_turkish(c), "\\s+", " ")


def strip_section_headers(c: Column) -> Column:
    return F.regexp_replace(c, "(?m)^\\d+(?:\\.\\d+)*\\.?[ \\t]+[A-ZÇĞİÖŞÜ].*$", "")


def split_sentences(c: Column) -> Column:
    """Sentences that end before white space and a capital; blank ones dropped."""
    return F.filter(F.transform(F.split(c, SENTENCE_END), lambda x: F.trim(x)), lambda s: F.length(s) > 0)


def tokens_by_space(c: Column) -> Column:
    """Words between runs of white space."""
    return F.filter(F.split(F.trim(F.regexp_replace(c, "\\s+", " ")), " "), lambda w: F.length(w) > 0)


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def ascii_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def paragraphs(c: Column) -> Column:
    """Blocks between blank lines, their lines joined by spaces. A first line
    that opens with # is a paragraph of its own."""
    unix = F.regexp_replace(c, "\\r\\n?", "\n")
    blocks = F.filter(F.transform(F.split(unix, "\\n\\s*\\n"), lambda b: F.regexp_replace(b, "^\\s+|\\s+$", "")), lambda b: F.length(b) > 0)

    def lines(b: Column) -> Column:
        return F.filter(F.transform(F.split(b, "\\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)

    def parts(b: Column) -> Column:
        rows = lines(b)
        heading = (F.size(rows) > 1) & F.startswith(rows[0], F.lit("#"))
        return F.when(heading, F.array(rows[0], F.array_join(F.slice(rows, F.lit(2), F.size(rows)), " "))).otherwise(F.array(F.array_join(rows, " ")))

    return F.flatten(F.transform(blocks, parts))


def strip_html(c: Column) -> Column:
    """Text of a page: scripts and styles dropped, tags as spaces, the five
    basic entities and the hard space read."""
    c = F.regexp_replace(c, "(?is)<(script|style)\\b[^>]*>.*?</\\1\\s*>", " ")
    c = F.regexp_replace(c, "(?s)<[^>]+>", " ")
    for entity, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(mark))
    return collapse(c)


def is_turkish(c: Column) -> Column:
    """Whether over half a percent of the characters are Turkish letters: these
    go, and what is missing is counted, as they are few."""
    letters = F.when(F.octet_length(c) == F.length(c), 0).otherwise(F.length(c) - F.length(F.regexp_replace(c, f"[{TURKISH_LETTERS}]", "")))
    return letters / F.greatest(F.length(c), F.lit(1)) > 0.005


def language(c: Column) -> Column:
    return F.when(is_turkish(c), "tr").otherwise("en")


def normalize_doi(c: Column) -> Column:
    """The DOI in a text, without closing punctuation, in lower case; or null."""
    found = F.regexp_extract(c, DOI, 0)
    return F.when(found != "", F.lower(F.regexp_replace(found, "[.,;:)\\]}>]+$", "")))


def normalize_arxiv(c: Column) -> Column:
    """An arXiv id without its version or file ending; or null."""
    found = F.regexp_extract(F.regexp_replace(F.trim(c), "(?i)\\.pdf$", ""), ARXIV, 1)
    return F.when(found != "", F.lower(found))


def _plain_letters() -> tuple[str, str, dict[str, str]]:
    """By Unicode's compatibility decomposition: characters whose ASCII part is
    one character, what that is, and the others' parts, where they have one."""
    plain = {c: unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode() for c in map(chr, range(0x80, 0x10000)) if not "\ud800" <= c <= "\udfff" and not "\uac00" <= c <= "\ud7a3"}
    one = {c: p for c, p in plain.items() if len(p) == 1}
    return "".join(one), "".join(one.values()), {c: p for c, p in plain.items() if len(p) > 1}


_FROM, _TO, _LONGER = _plain_letters()
_SEVERAL = "[" + "".join(_LONGER) + "]"


def plain_ascii(c: Column) -> Column:
    """A text's ASCII part after compatibility decomposition: letters lose their
    accents, ligatures and the like are spelt out, the rest is dropped."""

    def spelt(t: Column) -> Column:
        parts = F.map_from_arrays(F.array(*map(F.lit, _LONGER)), F.array(*map(F.lit, _LONGER.values())))
        return F.array_join(F.transform(F.split(t, ""), lambda x: F.coalesce(F.try_element_at(parts, x), x)), "")

    odd = F.when(c.rlike(_SEVERAL), spelt(c)).otherwise(c)
    return F.when(c.rlike("[^\\x00-\\x7F]"), F.regexp_replace(F.translate(odd, _FROM, _TO), "[^\\x00-\\x7F]", "")).otherwise(c)


def plain_tokens(c: Column) -> Column:
    """Words of letters a to z and digits, accents folded."""
    return ascii_tokens(plain_ascii(c))


def normalize_title(c: Column) -> Column:
    """ASCII words of a title, accents folded."""
    return F.array_join(plain_tokens(c), " ")


def cap_words(c: Column, n: int = 25) -> Column:
    w = tokens_by_space(c)
    return F.when(F.size(w) > n, F.concat(F.array_join(F.slice(w, 1, n), " "), F.lit("..."))).otherwise(c)


def search_query(c: Column) -> Column:
    """The first twelve words that say something; without any, the first eight."""
    w = tokens_by_space(F.regexp_replace(c, "[^\\p{L}\\p{N}_\\s]", " "))
    stop = F.array(*map(F.lit, STOP_WORDS))
    said = F.filter(w, lambda x: ~F.array_contains(stop, F.lower(x)) & (F.length(x) > 2))
    return F.when(F.size(said) > 0, F.array_join(F.slice(said, 1, 12), " ")).otherwise(F.array_join(F.slice(w, 1, 8), " "))


def heading_key(c: Column) -> Column:
    key = F.lower(F.regexp_replace(F.trim(F.regexp_replace(F.trim(c), "^#+", "")), ":+$", ""))
    return collapse(F.regexp_replace(key, "^ek\\s*[-.]?\\s*\\d+\\s*:?\\s*", ""))


def half_even(c: Column) -> Column:
    """Rounds to a whole number, halves to even."""
    return F.bround(c, 0).cast("long")


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets held as arrays; 0 where either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - both))


def char_ngrams(c: Column, n: int = 3) -> Column:
    return F.when(F.length(c) < n, F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1))), lambda i: F.substring(c, i, F.lit(n))))
    )


def char_ngram_jaccard(a: Column, b: Column) -> Column:
    """Over distinct three-character runs; over words where a text is shorter."""

    def score(a: Column, b: Column) -> Column:
        short = (F.length(a) < 3) | (F.length(b) < 3)
        by_words = jaccard(F.array_distinct(tokens_by_space(a)), F.array_distinct(tokens_by_space(b)))
        return F.when(short, by_words).otherwise(let(char_ngrams(a), lambda x: let(char_ngrams(b), lambda y: jaccard(x, y))))

    return let(normalize_turkish(a), lambda x: let(normalize_turkish(b), lambda y: score(x, y)))


QUOTED = "\"[^\"\n]+\"|“[^”\n]+”|‘[^’\n]+’|«[^»\n]+»"
#: A numbered mark, or a year in round brackets.
CITED = "\\[\\d+(?:\\s*[-–,]\\s*\\d+)*\\]|\\([^()]*\\b(?:19|20)\\d\\d[a-z]?\\)"


def places(c: Column, pattern: str) -> Column:
    """Start and end of each match, from the lengths of matches and of what
    lies between. For sentences: the list is copied for each match."""
    between, hits = F.split(c, pattern, -1), F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    each = F.arrays_zip(F.slice(between, 1, F.size(hits)).alias("b"), hits.alias("h"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["b"])
        e = s + F.length(x["h"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("start"), e.alias("end")))).alias("out"))

    return F.aggregate(each, zero, add)["out"]


def quote_ranges(c: Column) -> Column:
    """Start and end of quotations, kind of mark by kind of mark, so that one
    within another is found too."""
    return F.concat(*(places(c, p) for p in QUOTED.split("|")))


def in_quotation(paragraph: Column, start: Column, end: Column) -> Column:
    """Whether the span lies in a quotation, or the paragraph is one."""
    inside = F.exists(quote_ranges(paragraph), lambda q: (q["start"] <= start) & (end <= q["end"]))
    return F.startswith(F.regexp_replace(paragraph, "^\\s+", ""), F.lit(">")) | inside


def sentence_at(paragraph: Column, offset: Column) -> Column:
    """The sentence around an offset, which is clamped to the paragraph; white
    space after a sentence belongs to it. Null counts as empty."""
    p = F.coalesce(paragraph, F.lit(""))
    at = F.greatest(F.lit(0), F.least(offset, F.length(p) - 1)).cast("int")
    head = F.substring(p, F.lit(1), at + 1)
    start = F.length(head) - F.length(F.element_at(F.split(head, SENTENCE_END), -1))
    return F.regexp_replace(F.split(F.substring(p, start + 1, F.length(p)), SENTENCE_END)[0], "^\\s+|\\s+$", "")


def remap_span(start: Column, end: Column, offsets: Column) -> Column:
    """struct(start, end) of a normalised text's span in the original, by the
    original place of each character. Spans are clamped; without a map they
    stay as they are, and an empty one stays empty."""
    n = F.size(offsets)
    s = F.greatest(F.lit(0), F.least(start, n - 1)).cast("int")
    e = F.greatest(F.lit(0), F.least(end, n)).cast("int")

    def original(i: Column) -> Column:
        return F.get(offsets, i)

    known = n > 0
    first = F.when(known, original(s)).otherwise(start)
    last = F.when(~known, end).when(s >= e, original(s)).otherwise(original(e - 1) + 1)
    return F.struct(first.cast("long").alias("start"), last.cast("long").alias("end"))
