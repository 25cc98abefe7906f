import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from inkglass.functions import arrow
from inkglass.functions import text as T


def brute_winnow(h, w=4):
    """Every window's least hash, the last of equals; short runs: the first."""
    if len(h) <= w:
        return [min(range(len(h)), key=lambda i: (h[i], i))] if h else []
    return sorted({min(range(i, i + w), key=lambda k: (h[k], -k)) for i in range(len(h) - w + 1)})


def test_winnow_is_the_windows_minima():
    r = random.Random(5)
    for _ in range(500):
        h = [f"{r.randint(0, 6):016x}" for _ in range(r.randint(0, 30))]
        texts = ["".join(r.choice("abc") for _ in range(r.randint(0, 40))) for _ in range(r.randint(0, 6))]
        few = lambda g: sum(map(ord, g)) % 7  # noqa: E731  many ties
        hashes, places, n = arrow.fingerprints(texts, few)
        at = 0
        for t, k in zip(texts, n.tolist(), strict=True):
            h = [few(t[i : i + 5]) for i in range(len(t) - 4)] if len(t) >= 5 else [few(t)] if t else []
            assert places[at : at + k].tolist() == brute_winnow(h) and hashes[at : at + k].tolist() == [h[i] for i in brute_winnow(h)]
            at += k


def test_fingerprint_of_short_and_odd():
    md5 = arrow._hash("md5")
    assert [x.tolist() for x in arrow.fingerprints(["", "abc", ""], md5)] == [[md5("abc")], [0], [0, 1, 0]]
    assert arrow._hash("blake2b")("abc") != md5("abc")
    wide = "".join(chr(0x4E00 + k) for k in range(9000)) + "😀"  # too many letters for one number
    h, at, n = arrow.fingerprints([wide], md5)
    assert at.tolist() == brute_winnow([md5(wide[i : i + 5]) for i in range(len(wide) - 4)]) and n.tolist() == [len(at)]


def test_citations():
    found = arrow.find_citations("As shown (Smith & Jones, 2019; Brown, n.d.) and Clark et al. (2001, p. 4) [1, 4-2] 10.1000/ab.")
    assert [(c["authors"], c["year"], c["numbered_ref"], c["doi"]) for c in found] == [
        ("Smith & Jones", 2019, None, None), ("Brown", None, None, None), ("Clark et al.", 2001, None, None), (None, None, 1, None), (None, None, 2, None), (None, None, 3, None), (None, None, 4, None),
        (None, None, None, "10.1000/ab"),
    ]
    assert arrow.find_citations("(see below) and (lower, 2019)") == []


def test_numbers():
    assert arrow.expand_numbers("3, 1-2, 0") == [1, 2, 3]
    assert len(arrow.expand_numbers("1-900")) == 101


def test_sentences_keep_their_places():
    p = "  Dr. Smith left. It was late! See fig. 3 of J. Doe. Done"
    parts = arrow.split_protected(p)
    assert [t for t, _, _ in parts] == ["Dr. Smith left.", "It was late!", "See fig. 3 of J.", "Doe.", "Done"]
    assert all(p.strip()[s:e] == t for t, s, e in parts)
    cases = {
        "He ate. then he left.": 1, "Bkz. ibid. Ahmet geldi.": 1, "Sayın Müh. Ali geldi.": 1, "See fig. Three. It ends.": 3, "Prof. Dr. Ali geldi. Şimdi gitti.": 1, "Prof. Dr. Ali geldi ve uzun uzun anlattı. Şimdi gitti.": 2, "1. Giriş bölümü. Sonra gelir.": 1,
        "T.C. Ankara. İkinci cümle.": 2, "Oran 3.5 Oldu. Bitti.": 1, "Wait... Now. End.": 1, "Ne? Evet! Tamam.": 3, "bak http://a.org/x. Sonra.": 1,
    }
    assert {t: len(arrow.split_protected(t)) for t in cases} == cases
    assert arrow.split_protected("") == []


def test_quotes():
    assert arrow.quote_pairs('a "b" “c «d»” "open') == [(2, 5), (6, 13), (9, 12)]


def test_entities_and_passages():
    assert arrow.name_like("NASA and John Smith use PySpark") == ["NASA", "John Smith", "PySpark"]
    assert arrow.name_like("iPhone and eBay, Émile Zola") == ["iPhone", "eBay", "Émile Zola"]
    assert arrow.name_like("Ada Lovelace, Grace met Alan Turing DNA Ada Lovelace") == ["Ada Lovelace", "Alan Turing", "DNA"]
    assert arrow.name_like("") == arrow.name_like("plain words Only one") == []
    assert arrow.passages(["aa", "", "bbb", "c" * 7], 8) == ["aa\n\nbbb", "c" * 7]


def test_columns(spark):
    df = spark.createDataFrame([("İSTANBUL  IŞIK\n’x’ ", "# Head\nline one\r\nline two\r\n\r\n  \n\nlast")], "a string, b string")
    r = df.select(T.normalize_turkish(F.col("a")).alias("n"), T.paragraphs(F.col("b")).alias("p"), T.is_turkish(F.col("a")).alias("t")).first()
    assert r.n == "istanbul ışık 'x'"
    assert r.p == ["# Head", "line one line two", "last"]
    assert r.t
    nulls = spark.createDataFrame([(None,)], "a string").select(T.split_sentences(F.col("a")), T.normalize_doi(F.col("a")), T.language(F.col("a"))).first()
    assert nulls[0] is None and nulls[1] is None


def test_trigram_overlap_bounds(spark):
    df = spark.createDataFrame([("abcd", "abcd"), ("ab", "ab"), ("abc", "xyz"), ("", "")], "a string, b string")
    assert [r[0] for r in df.select(T.char_ngram_jaccard(F.col("a"), F.col("b"))).collect()] == [1.0, 1.0, 0.0, 0.0]


def test_udf_columns(spark):
    df = spark.createDataFrame([("Café A. Done.", "Cafe")], "a string, b string")
    r = df.select(T.plain_ascii(F.col("a")).alias("n"), arrow.sequence_ratio(F.col("a"), F.col("b")).alias("s"), F.size(arrow.sentences(F.col("a"))).alias("k"), arrow.quotes(F.lit('"x"')).alias("q")).first()
    assert r.n == "Cafe A. Done." and 0 < r.s < 1 and r.k == 2 and r.q[0].end == 3


def test_segments_pair_places_in_order():
    md5 = arrow._hash("md5")
    a, b = arrow.segment_pairs("one shared passage stands here", "xx one shared passage stands here yy", md5)
    assert a[0][0] <= 4 and a[-1][1] >= 26 and [e - s for s, e in a] == [e - s for s, e in b] and all(s2 - s1 == 3 for (s1, _), (s2, _) in zip(a, b, strict=True))
    # a run that stands twice in the one and once in the other is met once
    twice, once = arrow.segment_pairs("abcdefghij ... abcdefghij", "abcdefghij", md5)
    assert len(once) == 1 and twice[0][0] < 10 and twice[-1][1] <= 11
    assert arrow.segment_pairs("", "abc", md5) == ([], []) and arrow.segment_pairs("abc", "abc", md5) == ([(0, 3)], [(0, 3)])


def test_passages_are_slices():
    text = "one two\n\nthree\n \n\n\n" + "x" * 25 + "\n\nfour\n\n   \n\nfive six seven"
    assert arrow.passage_spans("", 5) == [(0, 0)] and arrow.passage_spans("short", 5) == [(0, 5)]
    for most in range(1, len(text) + 2):
        spans = arrow.passage_spans(text, most)
        assert all(0 < e - s <= most for s, e in spans) and all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
        covered = {k for s, e in spans for k in range(s, e)}
        assert all(k in covered for k, c in enumerate(text) if not c.isspace())
    assert [text[s:e] for s, e in arrow.passage_spans(text, 20)] == ["one two\n\nthree\n \n\n\n", "x" * 20, "x" * 5 + "\n\n", "four\n\n   \n\n", "five six seven"]


def test_passage_column_and_places(spark):
    df = spark.createDataFrame([(1, "Aa bb. Cc «d “e” f» g. Hh", "aa\n\nbbb"), (2, None, None), (3, "> all “of” it", "")], "id int, p string, t string")
    rows = {r.id: r for r in df.select("id", arrow.passage_column(F.col("t"), F.lit(4)).alias("s"), T.sentence_at(F.col("p"), F.lit(12)).alias("at"), T.quote_ranges(F.col("p")).alias("q"), T.in_quotation(F.col("p"), F.lit(0), F.lit(1)).alias("in_q")).collect()}
    assert [(x.text, x.start, x.end) for x in rows[1].s] == [("aa\n\n", 0, 4), ("bbb", 4, 7)]
    assert rows[1].at == "Cc «d “e” f» g." and [(x.start, x.end) for x in rows[1].q] == [(13, 16), (10, 19)] and not rows[1].in_q
    assert rows[2].at == "" and [(x.text, x.start, x.end) for x in rows[2].s] == [("", 0, 0)] and rows[3].in_q


def test_python_columns_work_in_slices(spark):
    @arrow._scalar("struct<rows:int,most:int>", pa.struct([("rows", pa.int32()), ("most", pa.int32())]))
    def seen(c):
        return [{"rows": len(c), "most": sum(map(len, c))}] * len(c)

    rows = spark.range(6000).coalesce(1).select("id", F.when(F.col("id") % 3000 == 7, F.repeat(F.lit("y"), 3 << 20)).otherwise(F.repeat(F.lit("x"), 2000)).alias("t"))
    got = rows.select("id", seen(F.col("t")).alias("s")).select("id", "s.*").collect()
    assert [r.id for r in got] == list(range(6000)) and max(r.rows for r in got) <= 1024
    assert max(r.most for r in got if r.id % 3000 != 7) <= 1 << 20 and {r.rows for r in got if r.id % 3000 == 7} == {1}
    assert spark.range(0).select(seen(F.col("id").cast("string"))).collect() == []


def test_sentence_ends_against_the_plain_rule():
    def plain(paragraph):
        text, cuts = paragraph.strip(), []
        for m in re.finditer(r"(?<=[.!?])\s+(?=[A-ZÇĞİÖŞÜ])", text):
            mark = m.start() - 1
            run = re.search(r"\S+$", text[max(0, mark - 200) : mark].rstrip())
            word = run[0].lower() if run else ""
            if word not in arrow.ABBREVIATIONS and word + "." not in arrow.ABBREVIATIONS and not arrow.PROTECTED.search(text[max(0, mark - 20) : mark + 1]):
                cuts.append(m.span())
        edges = zip([0, *(e for _, e in cuts)], [*(s for s, _ in cuts), len(text)], strict=True)
        return [(text[s:e], s, e) for s, e in edges if s < e]

    rnd = random.Random(11)
    parts = ["A", "b", "Ç", "İ", ".", "!", "?", " ", " ", "\n", " ", "\x1c", "10.", "3,", "4", "...", "http://", "FTP://", "Prof. Dr.", "prof. dR.", "vb", "Doç", "ibid.", "١", "x" * 210]
    for _ in range(20000):
        text = "".join(rnd.choices(parts, k=rnd.randrange(14)))
        assert arrow.split_protected(text) == plain(text), text


def test_turkish_letters_are_counted_by_what_goes(spark):
    rnd = random.Random(3)
    texts = [None, "", "plain ascii", "ç", "😀ş" + "a" * 300, *("".join(rnd.choices("abcç ğİıöşü😀é", weights=[200, 200, 200, 1, 50, 1, 1, 1, 1, 1, 1, 3, 9], k=rnd.randrange(900))) for _ in range(60))]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    for r in df.select("t", T.language(F.col("t")).alias("l")).collect():
        assert r.l == ("tr" if sum(x in T.TURKISH_LETTERS for x in r.t or "") / max(len(r.t or ""), 1) > 0.005 else "en")
    assert "[^" not in str(T.is_turkish(F.col("t")))  # all other characters were replaced one by one
