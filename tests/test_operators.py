import io
import zipfile

import pytest
from pyspark.sql import functions as F

from inkglass.functions import arrow, claims
from inkglass.operators import audit, bibliography, corpus, evaluation, intervals, reduction, retrieval, review, support, verification
from inkglass.plans import overlap
from inkglass.sources import files, providers, sinks


def test_merge_touching_and_strict(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 8), (1, 10, 12)], "k int, start int, end int")
    assert {(r.start, r.end) for r in intervals.merge_spans(df, ["k"]).collect()} == {(0, 8), (10, 12)}
    assert intervals.merge_spans(df, ["k"], touching=False).count() == 3


def test_prefix_filter_loses_nothing(spark):
    import random

    r = random.Random(2)
    sets = {i: sorted({str(r.randint(0, 25)) for _ in range(r.randint(1, 14))}) for i in range(60)}
    df = spark.createDataFrame(list(sets.items()), "id long, hashes array<string>")
    want = {(a, b) for a in sets for b in sets if a < b and len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= 0.5}
    assert {(x.a, x.b) for x in retrieval.similar_sets(df, 0.5).collect()} == want


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-2.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(retrieval.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, -1.0]
    with pytest.raises(Exception, match="differ in length"):
        spark.createDataFrame([([1.0], [1.0, 0.0])], "a array<double>, b array<double>").select(retrieval.cosine(F.col("a"), F.col("b"))).collect()


def test_index_round_trip(spark, tmp_path):
    src = spark.createDataFrame([(1, "First sentence of text. Second sentence here.", "cc-by"), (2, "First sentence of text.", "cc-by"), (3, "Hidden text of no license.", None)], "doc_id long, text string, license_text string")
    entries = corpus.dedup_first(corpus.ingest(src))
    assert entries.count() == 2
    path = f"file://{tmp_path}/index"
    manifest = corpus.save_index(entries, path)
    assert corpus.load_index(spark, path)["entries"].count() == 2
    spark.createDataFrame([], "entry_id string, term string, w double").write.mode("overwrite").parquet(f"{path}/{manifest['version']}/weights")
    with pytest.raises(ValueError, match="weights"):
        corpus.load_index(spark, path)
    again = corpus.save_index(entries, path)
    assert again["number"] == 2 and corpus.load_index(spark, path)["entries"].count() == 2
    spark.createDataFrame([], "term string, idf double").write.mode("overwrite").parquet(f"{path}/{again['version']}/idf")
    with pytest.raises(ValueError, match="idf"):
        corpus.load_index(spark, path)
    with pytest.raises(ValueError, match="weights"):  # the one before isn't whole either
        corpus.load_index(spark, path, recover=True)
    corpus.save_index(entries, path)
    assert corpus.load_index(spark, path, recover=True)["entries"].count() == 2
    with pytest.raises(ValueError, match="no index"):
        corpus.load_index(spark, f"file://{tmp_path}/none")


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\nline\n\nnext")
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>Cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    (tmp_path / "b.docx").write_bytes(data.getvalue())
    (tmp_path / "c.pdf").write_text("no")
    (tmp_path / "d.docx").write_bytes(b"no archive")
    rows = files.read_paragraphs(spark, f"file://{tmp_path}").orderBy("path", "paragraph_index").collect()
    assert [r.text for r in rows] == ["# T", "line", "next", "One", "Cell"]
    with pytest.raises(ValueError, match="unsupported"):
        files.read_paragraphs(spark, f"file://{tmp_path}/c.pdf")
    urls = spark.createDataFrame([("https://a.org/x",), ("http://10.0.0.1/",), ("ftp://a.org",), (None,), ("http://localhost",)], "u string")
    assert [r[0] for r in urls.select(files.allowed_url(F.col("u"))).collect()] == [True, False, False, False, False]


def test_annotations(spark, tmp_path):
    (tmp_path / "d.xml").write_text('<document reference="s1.txt"><feature name="plagiarism" obfuscation="none" this_offset="5" this_length="10" source_reference="a.txt" source_offset="1" source_length="9"/><feature name="x"/></document>')
    r = files.pan_annotations(spark, f"file://{tmp_path}/d.xml").collect()
    assert len(r) == 1 and r[0].suspicious_document == "s1.txt" and r[0].suspicious_offset == 5


def test_providers(spark):
    def one(f, payload):
        return f(spark.createDataFrame([(1, payload)], "query_id long, payload string")).collect()

    c = one(providers.crossref, '{"message":{"items":[{"title":["T "],"author":[{"given":"A","family":"B"},{}],"issued":{"date-parts":[[2019]]},"created":{"date-parts":[[2020]]},"DOI":"10.1/x","abstract":"<p>hi</p>"},{"title":[]}]}}')
    assert [(x.title, x.authors, x.year, x.abstract) for x in c] == [("T", ["A B"], 2019, "hi")]
    o = one(providers.openalex, '{"results":[{"title":"T","publication_year":99,"biblio":{"year":"2001"},"doi":"https://doi.org/10.1000/q","abstract_inverted_index":{"b":[1],"a":[0,2]},"authorships":[{"author":{"display_name":" N "}}]}]}')
    assert [(x.year, x.doi, x.abstract, x.authors) for x in o] == [(2001, "10.1000/q", "a b a", ["N"])]
    s = one(providers.semantic_scholar, '{"data":[{"title":"T","year":2000,"externalIds":{"ArXiv":"2101.1"},"authors":[{"name":"Z"}]}]}')
    assert [(x.year, x.arxiv_id, x.authors) for x in s] == [(2000, "2101.1", ["Z"])]
    a = one(providers.arxiv, "<feed><entry><id>http://arxiv.org/abs/2101.01v1</id><title>T\n x</title><published>2021-01-01</published><summary>s</summary><author><name>Q</name></author></entry></feed>")
    assert [(x.title, x.year, x.arxiv_id) for x in a] == [("T x", 2021, "2101.01v1")]
    assert one(providers.crossref, "not json") == []


def test_confidence_guards(spark):
    with pytest.raises(Exception, match="between 0 and 100"):
        spark.range(1).select(support.overall_confidence(F.lit(101), F.lit(5), F.lit(True))).collect()
    df = spark.createDataFrame([(2.0, 1.0, 1.0, 1.0, 1.0, 0, 0, 0)], [*audit.RATIOS, "uncited_high", "contradictions", "unresolved_high"])
    with pytest.raises(Exception, match="between 0 and 1"):
        df.select(audit.health_score()).collect()


def test_legacy_metrics_of_nothing(spark):
    r = audit.legacy_ratios(spark.createDataFrame([], "status string, verdict string, has_evidence boolean, severity string"), spark.createDataFrame([], "cited boolean, severity string"), 0).first()
    assert r.citation_coverage == r.verification_ratio == r.evidence_coverage == r.bibliography_consistency == 1.0


def test_relevance_and_ranking(spark):
    df = spark.createDataFrame([(1, 1, "Deep nets", 2017, None, None, "crossref"), (1, 2, "Deep nets", 2018, None, None, "arxiv"), (1, 3, "Other", 2020, "10.1000/x", None, "openalex")], "query_id long, arrival long, title string, year long, doi string, arxiv_id string, source_api string")
    rows = df.withColumn("relevance", verification.relevance(F.lit("deep nets"), F.col("title"), F.col("doi"), F.col("arxiv_id")))
    assert [r.arrival for r in verification.ranked(rows).orderBy("rank").collect()] == [2, 1, 3]
    assert rows.orderBy("arrival").first().relevance == 100


def test_author_score(spark):
    df = spark.createDataFrame([("Smith, J. and Jones, K.", ["John Smith", "Ann Lee"])], "e string, a array<string>")
    assert df.select(verification.author_score(F.col("e"), verification.surnames(F.col("a")))).first()[0] == 50


def test_conflicts(spark):
    df = spark.createDataFrame([(1, 0, "x", "A b", 2000, None), (1, 1, "y", "a B!", 2001, "10.1000/q")], "work_id long, pos long, api string, title string, year long, doi string")
    assert [r.field for r in verification.conflicts(df).collect()] == ["year"]


def test_gates(spark):
    df = spark.createDataFrame([("Coffee may cut risk by 12 % (A, 2019)", "Risk may fall by 12 % (A, 2019)"), ("It may rise 5 %", "It will not rise 6 %")], "o string, c string")
    ok = (F.lit(0.9), F.lit(0.9)), (F.lit(0.5), F.lit(0.5))
    out = [r[0] for r in df.select(reduction.gates(F.col("o"), F.col("c"), F.array(F.lit("(A, 2019)")), F.lit("preserved"), F.array().cast("array<string>"), *ok)).collect()]
    assert out[0] == [] and set(out[1]) == {"a citation is missing", "numbers changed"}


def test_gates_of_names_and_verdicts(spark):
    df = spark.createDataFrame([("Work by Marie Curie helps", "Work by marie curie helps"), ("Work by Marie Curie helps", "Her work helps")], "o string, c string")
    ok = (F.lit(0.9), F.lit(0.9)), (F.lit(0.5), F.lit(0.5))
    none = F.array().cast("array<string>")
    out = [r[0] for r in df.select(reduction.gates(F.col("o"), F.col("c"), none, F.lit("preserved"), none, *ok, arrow.entities(F.col("o")), F.lit("supported"))).collect()]
    assert out == [[], ["a name is missing"]]
    bad = df.limit(1).select(reduction.gates(F.col("o"), F.col("c"), none, F.lit("preserved"), none, *ok, None, F.lit("contradicted"))).first()[0]
    assert bad == ["the source does not support it"]


def test_stronger_claims(spark):
    rows = {
        ("It is associated with risk", "It caused risk"): True, ("It may help", "It definitely helps"): True, ("Uyku ile ilişkili", "Uyku buna neden oldu"): True, ("It may help", "It will help"): False,
        ("It is linked to risk", "It has not caused risk"): False, ("It is linked to risk", "It is not rare. It caused risk"): True, ("All plants", "All plants"): False,
    }
    df = spark.createDataFrame([(*k, v) for k, v in rows.items()], "o string, c string, want boolean")
    assert [r.o for r in df.where(reduction.strengthened(F.col("o"), F.col("c")) != F.col("want")).collect()] == []


def test_protected_tokens(spark):
    rows = {
        "5 mmol/l and 3,2 mmol/L": ["5 mmol/l", "3,2 mmol/L"], "10 mg/kg, n = 40": ["10 mg/kg", "n = 40"], "on March 5, 2020 at 2021-03-04": ["5,", "2020", "2021", "03", "04", "March 5, 2020", "2021-03-04"],
        "v1.2.3 of GPT-4 is 12%": ["2.3", "4", "12%", "v1.2.3", "GPT-4"], "none here": [],
    }
    df = spark.createDataFrame([(k,) for k in rows], "t string")
    assert {r.t: r.p for r in df.select("t", reduction.protected_tokens(F.col("t")).alias("p")).collect()} == rows


def test_claims_in_turkish_capitals(spark):
    df = spark.createDataFrame([("Daha YÜKSEK bir değer görüldü",), ("Böylece BU BÖLÜM içinde bir örnek verilmesi Önerilir",), ("Altbu bölümlerde bir örnek verilmesi önerilirse iyi olur",)], "t string")
    r = df.select(claims.claim_type(F.col("t")).alias("k"), claims.not_a_claim(F.col("t")).alias("x")).collect()
    assert r[0].k == "comparative" and r[1].x and not r[2].x


def test_improve_loop(spark):
    state = spark.createDataFrame([(1, "p1", "copied copied"), (1, "p2", "own")], "doc_id long, passage_id string, text string")

    def scan(s):
        return s.groupBy("doc_id").agg(F.sum(F.when(F.contains("text", F.lit("copied")), 50.0).otherwise(0.0)).alias("percent"), F.count(F.when(F.contains("text", F.lit("copied")), 1)).alias("high_risk"))

    good = spark.createDataFrame([("p1", "new words", 0.9, False), ("p1", "copied", 0.1, False)], "passage_id string, text string, score double, rejected boolean")
    out, ended = reduction.improve(state, good, scan)
    assert {r.text for r in out.collect()} == {"new words", "own"} and [tuple(r) for r in ended.collect()] == [(1, "no_measured_improvement", 1)]
    assert [tuple(r) for r in reduction.improve(state, good.withColumn("rejected", F.lit(True)), scan)[1].collect()] == [(1, "no_safe_candidates", 0)]
    assert [tuple(r) for r in reduction.improve(state, good.limit(0), scan)[1].collect()] == [(1, "no_eligible_reducible_passages", 0)]


def test_documents_improve_on_their_own(spark):
    """What one document comes to doesn't depend on the others."""
    state = [(1, "a", "copied"), (2, "b", "copied"), (3, "c", "copied copied copied"), (4, "d", "own"), (5, "e", "copied")]
    new = [("a", "fresh", 0.9), ("b", "copied copied", 0.9), ("c", "copied copied", 0.9), ("c", "copied", 0.5), ("c", "fresh", 0.4), ("c", "all fresh", 0.3), ("e", "copied", 0.7)]
    state = spark.createDataFrame(state, "doc_id long, passage_id string, text string")
    new = spark.createDataFrame([(*r, False) for r in new], "passage_id string, text string, score double, rejected boolean")

    def scan(s):
        n = F.regexp_count("text", F.lit("copied"))
        return s.groupBy("doc_id").agg((F.sum(n) * 10.0).alias("percent"), F.lit(0).alias("high_risk"))

    whole, ended = reduction.improve(state, new, scan)
    got, why = {r.passage_id: r.text for r in whole.collect()}, {r.doc_id: (r.reason, r.rounds) for r in ended.collect()}
    assert got == {"a": "fresh", "b": "copied", "c": "fresh", "d": "own", "e": "copied"}
    assert why == {1: ("no_safe_candidates", 1), 2: ("no_measured_improvement", 0), 3: ("max_iterations_reached", 3), 4: ("no_eligible_reducible_passages", 0), 5: ("no_measured_improvement", 0)}
    alone, ended = reduction.improve(state.where("doc_id in (1, 3)"), new, scan)
    assert {r.passage_id: r.text for r in alone.collect()} == {k: got[k] for k in "ac"} and {r.doc_id: (r.reason, r.rounds) for r in ended.collect()} == {k: why[k] for k in (1, 3)}


def test_apply_rewrites(spark):
    texts = spark.createDataFrame([(1, "a b a"), (2, "x")], "doc_id long, text string")
    edits = spark.createDataFrame([(1, "b", "c"), (1, "a", "z")], "doc_id long, original string, new string")
    assert {(r.doc_id, r.text, r.applied) for r in reduction.apply_rewrites(texts, edits).collect()} == {(1, "a c a", 1), (2, "x", 0)}


def test_bootstrap_is_repeatable():
    assert evaluation.bootstrap([0.0, 1.0, 1.0]) == evaluation.bootstrap([0.0, 1.0, 1.0])
    assert evaluation.bootstrap([]) == (0.0, 0.0)


def test_report(spark):
    s = spark.createDataFrame([(1, 10, 50.0)], "doc_id long, n_words long, raw_percent double")
    m = spark.createDataFrame([(1, 1, "high", "unattributed_exact", 7)], "doc_id long, match_rank long, severity string, status string, source_id long")
    c = spark.createDataFrame([(1, 7, 5, 50.0)], "doc_id long, source_id long, words long, percent double")
    import json

    body = json.loads(sinks.review_json(s, m, c).first().json)
    assert body["matches"][0]["status"] == "unattributed_exact" and "source 7" in sinks.review_markdown(body)


def test_stream(spark, tmp_path, small):
    from inkglass.plans import overlap
    from inkglass.streaming import scan

    spark.read.parquet(f"{small}/documents.parquet").repartition(3).write.parquet(f"file://{tmp_path}/in")
    items = overlap.fingerprints(overlap.sentence_table(spark.read.parquet(f"{small}/benchmark.parquet"), "item_id"), "item_id")
    prints = items.select(F.col("item_id").alias("entry_id"), F.explode("points").alias("p")).select("entry_id", F.col("p.hash").alias("hash"))
    q = scan.run(scan.new_documents(spark, f"file://{tmp_path}/in", 1), prints, f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    q.awaitTermination()
    whole = scan.shared_points(spark.read.parquet(f"{small}/documents.parquet"), prints)
    assert spark.read.parquet(f"file://{tmp_path}/out").drop("batch").exceptAll(whole).isEmpty() and q.lastProgress is not None


def test_review_of_documents(spark):
    """Copied, quoted, cited, edited and too short passages; words count once."""
    copied, edited = "The river carries its stones along the valley floor each spring.", "The river carries its stones along the valley floor every single spring."
    docs = spark.createDataFrame(
        [(1, f"Some own words stand here first. {copied}"), (2, f'They wrote that "{copied}"'), (3, f"As shown elsewhere (Smith, 2019). {copied}"), (4, edited), (5, "Nothing here is taken from any other place at all."), (6, None)],
        "doc_id long, text string",
    )
    sources = spark.createDataFrame([(7, copied), (8, "Too short.")], "item_id long, text string")
    m = {r.doc_id: r for r in overlap.review_matches(docs, sources).collect()}
    assert set(m) == {1, 2, 3, 4}
    assert (m[1].match_type, m[1].status, m[1].severity, len(m[1].words)) == ("exact", "unattributed_exact", "high", 11)
    assert (m[2].match_type, m[2].status, m[2].quoted) == ("exact", "quoted_not_attributed", True) and (m[3].status, m[3].cited) == ("cited_but_verbatim", True)
    assert m[4].match_type == "near_duplicate" and m[4].status == "unattributed_near_exact" and 6 <= len(m[4].words) < 12
    assert all(len(r.match_id) == 16 and r.match_rank == 1 for r in m.values())
    found = overlap.review_matches(docs, sources)
    words = review.covered_words(found)
    by = {r.doc_id: r for r in review.coverage(words, overlap.word_totals(docs)).collect()}
    assert by[1].exact_percent == round(100 * 11 / 17, 2) and by[2].review_percent == 0.0 and by[2].quoted_percent > 0 and by[3].attributed_percent > 0 and by[5].raw_percent == 0.0
    shares = {r.doc_id: r.words for r in review.contributions(review.allocate_words(words, ["doc_id", "paragraph", "word"]), overlap.word_totals(docs)).collect()}
    assert shares == {1: 11, 3: 11, 4: len(m[4].words)}


def test_nearest_vectors(spark, monkeypatch):
    """Blocks of queries and rows against all pairs, with ties and odd vectors."""
    import numpy as np

    r = np.random.default_rng(4)
    v = r.integers(-2, 3, (300, 4)).astype(float)  # many ties, some zero
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(300, None), (None, [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    monkeypatch.setattr(retrieval, "QUERY_VECTORS", 9)
    monkeypatch.setattr(retrieval, "_ROWS", 50)
    monkeypatch.setattr(retrieval, "_QUERIES", 4)
    q = df.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    got = {}
    for x in retrieval.nearest(q, df, 7).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id))
    v = np.vstack([v, np.zeros(4)])
    n = np.linalg.norm(v, axis=1)
    unit = np.divide(v, n[:, None], out=np.zeros_like(v), where=n[:, None] > 0)
    for i in range(0, 301, 10):
        cos = np.round(unit @ unit[i], 9)
        assert [x for _, x in sorted(got[i])] == sorted((j for j in range(301) if j != i), key=lambda j: (-cos[j], j))[:7], i
    with pytest.raises(Exception, match="differ in length"):
        retrieval.nearest(q, spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>"), 2).collect()


@pytest.mark.parametrize("copies", [False, True])
def test_nearest_holds_little(copies):
    """What a task holds doesn't grow with the number of queries, nor with ties: each is met by thousands of copies."""
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    n, d, k = 12_000, 8, 3
    v = np.random.default_rng(2).normal(size=(n, d)).astype(np.float32)
    v[: n // 2 if copies else 0] = v[0]
    rows = pa.record_batch([pa.array(np.arange(n)), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * d, pa.int32()), pa.array(v.ravel()))], names=["vec_id", "embedding"])
    ids = np.arange(0, n, 6)
    q = retrieval._unit_rows(rows.column(1).take(pa.array(ids)), None)
    tracemalloc.start()
    (got,) = retrieval._nearest(SimpleNamespace(value=(ids, q)), k)(iter([rows]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    unit = retrieval._unit_rows(rows.column(1), None)
    found = {}
    for i, j in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True):
        found.setdefault(i, []).append(j)
    for i in (0, 6, 2994, 5994, 6000, 11994):
        cos = np.round(unit @ unit[i], 9)
        cos[i] = -2
        assert found[i] == sorted(np.lexsort((np.arange(n), -cos))[:k].tolist(), key=lambda j: (-cos[j], j)), i


def test_conflict_notes(spark):
    from inkglass.operators import verification

    records = spark.createDataFrame(
        [
            (1, 1, 0, "crossref", "Deep Nets", 2017, "10.1000/a"), (1, 1, 1, "openalex", "Deep nets!", 2018, "10.1000/A"), (1, 1, 2, "arxiv", "Shallow", 2017, None),
            (2, 2, 0, "crossref", "X y", 2000, "10.1000/b"), (2, 2, 1, "openalex", "Z y", 2001, "10.1000/b"), (3, 3, 0, "crossref", "Same", 2000, "10.1000/c"),
        ],
        "entry_id int, work_id int, pos int, api string, title string, year int, doi string",
    )
    candidates = spark.createDataFrame(
        [
            (1, 1, "t", 2017, "10.1000/a", 100, 100), (1, 2, "t", 2017, "10.1000/q", 100, 100), (3, 1, "t", 2000, "10.1000/c", 100, 100), (3, 2, "t", 2000, "10.1000/d", 70, None),
            (3, 3, "t", 2001, "10.1000/e", 100, 100), (3, 4, "t", None, "10.1000/f", 69, 100), (3, 5, "t", 2000, "10.1000/g", 90, 49), (3, 6, "t", 2000, None, 90, 90),
        ],
        "entry_id int, rank int, title string, year int, doi string, title_score int, author_score int",
    )
    notes = {r.entry_id: r.notes for r in verification.conflict_notes(records, candidates).collect()}
    assert notes == {1: "years differ: crossref and openalex", 2: "titles differ: crossref and openalex", 3: "one work, two DOIs: 10.1000/c and 10.1000/d"}


def test_meaning_without_words(spark):
    from inkglass.operators import meaning

    df = spark.createDataFrame([(1, "It is not so.", "It is so."), (2, None, "It holds."), (3, "It holds.", None), (4, "A. B.", "A. B. C and c. C."), (5, "a and b", "A and b AND c. "), (6, "é. Ğ", "é. Ğ landé. Öandé")], "id int, p string, h string")
    s = {r.id: (round(r.s.score, 3), r.s.verdict) for r in df.select("id", meaning.screen(F.col("p"), F.col("h")).alias("s")).collect()}
    assert s[1] == (0.5, "contradicted") and s[2] == (0.0, "unknown") and s[3] == (0.0, "unknown")
    a = {r.id: r.a for r in df.select("id", meaning.new_assertions(F.col("p"), F.col("h")).alias("a")).collect()}
    assert a[4] == ["C and c", "C", "c. C"] and a[5] == ["c"] and a[6] == ["Öandé"] and a[3] == []


def test_best_overlaps_meet_where_the_query_is(spark):
    from inkglass.operators import retrieval
    from inkglass.plans import overlap

    docs = spark.createDataFrame([(1, "The quick brown fox jumps. Over the lazy dog it went. The quick brown fox."), (2, ""), (3, None), (4, "Nothing like it, zzzz qqqq.")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "The quick brown fox jumped. A lazy dog it was."), (9, "Over the lazy dog it went.")], "item_id long, text string")
    got = overlap.best_overlap(docs, items)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = overlap.sentence_overlap(docs, items).groupBy("doc_id", "item_id").agg({"overlap": "max"}).collect()
    assert sorted((r.doc_id, r.item_id, round(r.overlap, 12)) for r in got.collect()) == sorted((r[0], r[1], round(r[2], 12)) for r in want)
    weights, idf = retrieval.tfidf(items, "item_id")
    plan = retrieval.tfidf_cosine(docs.withColumnRenamed("doc_id", "query_id"), weights, idf)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" in plan and "query_id#" in plan and not [x for x in plan.splitlines() if "Exchange hashpartitioning(query_id" in x and "term" in x]


def test_spans_index_terms_and_word_sets_move_little(spark):
    import itertools
    import random

    from pyspark.sql import functions as F

    from inkglass.operators import index, retrieval
    from inkglass.plans import overlap

    docs = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog.")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "A quick brown fox jumped.")], "item_id long, text string")
    plan = overlap.spans(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and "end#" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning" in x)
    words = spark.createDataFrame([(["b", "a", "b"],), ([],), (["c"],)], "w array<string>").select(index._counted(F.col("w")).alias("t"))
    assert [[tuple(x) for x in r.t or []] for r in words.collect()] == [[("a", 1), ("b", 2)], [], [("c", 1)]]
    rng = random.Random(3)
    sets = {i: rng.sample(range(12), rng.randint(1, 9)) for i in range(80)}
    want = {(a, b) for a, b in itertools.combinations(sets, 2) if len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]}) >= 0.6}
    got = retrieval.similar_sets(spark.createDataFrame([(i, v) for i, v in sets.items()], "id long, hashes array<long>"), 0.6)
    assert {(r.a, r.b) for r in got.collect()} == want and got.count() == len(want)


@pytest.mark.parametrize("cells", [3, 2_000_000])
def test_overlaps_where_fingerprints_are_made(monkeypatch, cells):
    import random
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    rnd, hasher = random.Random(cells), arrow._hash("md5")
    texts = ["".join(rnd.choices("ab ", k=rnd.randrange(0, 25))) for _ in range(300)]
    sets = [set(arrow.fingerprints([t], hasher)[0].view(np.int64).tolist()) for t in texts]
    kept = [k for k in range(0, 300, 4) if sets[k]]
    hashes = np.array([h for k in kept for h in sorted(sets[k])], np.int64)
    entry = np.repeat(np.arange(len(kept)), [len(sets[k]) for k in kept])
    by = np.argsort(hashes, kind="stable")
    index = (pa.array(kept), np.array([len(sets[k]) for k in kept]), entry[by], *np.unique(hashes[by], return_index=True, return_counts=True))
    monkeypatch.setattr(retrieval, "_CELLS", cells)
    batches = [pa.record_batch([pa.array(range(300)), pa.array(texts)], names=["query_id", "text"])]
    got = sorted(tuple(r.values()) for b in retrieval._near(SimpleNamespace(value=index), 0.3, "md5")(iter(batches)) for r in b.to_pylist())
    pairs = [(q, e, len(sets[q] & sets[e]), len(sets[q] & sets[e]) / len(sets[q] | sets[e])) for q in range(300) for e in kept if sets[q]]
    assert got == sorted(p for p in pairs if p[3] >= 0.3)


def test_bibliography_issues_in_one_grouping(spark, capsys):
    cites = spark.createDataFrame([(1, "Smith", 2019, False), (1, "Smith & Lee", 2019, False), (1, "Doe", None, True), (1, "Roe", None, False), (2, None, 2001, False), (2, "Poe", 2001, False)], "doc_id long, authors string, year long, no_date boolean")
    entries = spark.createDataFrame([(1, "Smith, J.", 2019, False, "x"), (1, "Doe, A.", None, True, "x"), (1, "Poe, E.", 2001, False, None), (2, "", 2001, False, "x"), (2, "Poe, E.", 2002, False, "y")], "doc_id long, authors string, year long, no_date boolean, doi string")
    out = bibliography.issues(cites, entries)
    expected = [(1, "duplicate_doi", "x", None, 2), (1, "listed_not_cited", "poe", 2001, 1), (2, "cited_not_listed", "poe", 2001, 1), (2, "listed_not_cited", "poe", 2002, 1)]
    assert sorted(map(tuple, out.collect())) == expected
    out.explain()
    assert "Join" not in capsys.readouterr().out


@pytest.mark.parametrize("ranked, block", [(500_000, 2_000_000), (3, 2_000_000), (500_000, 60), (3, 60)])
def test_similar_sets_by_blocks(spark, monkeypatch, ranked, block):
    """Words without a rank, blocks of sets, one size in parts; and no pair moves but those that are found."""
    import itertools
    import random

    rng = random.Random(block + ranked)
    words = [f"w{i}" for i in range(40)]
    sets = {i: rng.sample(words, rng.randint(1, 20)) for i in range(60)}
    sets |= {100 + i: [*sets[i], f"own{i}"] for i in range(30)} | {200 + i: [f"one{i}"] for i in range(4)} | {300: ["one0"], 301: []}
    monkeypatch.setattr(retrieval, "COMMON_WORDS", ranked)
    monkeypatch.setattr(retrieval, "BLOCK_WORDS", block)
    df = spark.createDataFrame(list(sets.items()), "id long, hashes array<string>")
    got = retrieval.similar_sets(df, 0.6)
    want = {(a, b): len({*sets[a]} & {*sets[b]}) / len({*sets[a]} | {*sets[b]}) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b]}
    rows = [((r.a, r.b), r.overlap) for r in got.collect()]
    assert sorted(rows) == sorted((k, v) for k, v in want.items() if v >= 0.6)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
