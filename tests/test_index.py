"""The index by content: hits, increments equal to rebuilding, removal, validity, cleaning."""

import pytest
from pyspark.sql import functions as F

from inkglass.operators import index


@pytest.fixture(scope="module")
def entries(spark):
    rows = [(d, e, f"sentence {d % 7} of {e} with words {d * e % 11} and more") for d in range(30) for e in range(3)]
    return spark.createDataFrame(rows, "doc_id long, entry_index long, normalized_text string").withColumn("hash", F.sha2("normalized_text", 256)).cache()


def state(tables):
    return {k: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*sorted(df.columns)).collect()) for k, df in tables.items()}


def test_increments_equal_rebuilding(spark, entries, tmp_path):
    path, other = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    first, how = index.update(entries.where("doc_id < 20"), path)
    assert how == "built" and index.update(entries.where("doc_id < 20").orderBy(F.rand(3)).repartition(3), path) == (first, "hit")
    changed = F.when(F.col("doc_id") == 3, F.concat("normalized_text", F.lit(" changed"))).otherwise(F.col("normalized_text"))
    later = entries.where("doc_id >= 2").withColumn("normalized_text", changed).withColumn("hash", F.sha2("normalized_text", 256))
    second, how = index.update(later, path)
    new = second["segments"][-1]["counts"]
    assert how == "incremental" and (new["entries"], new["removed"]) == (33, 9) and second["segments"][0] == first["segments"][0]
    whole, _ = index.update(later, other)
    assert second["key"] == whole["key"] and state(index.tables(spark, path, second)) == state(index.tables(spark, other, whole))
    # what was taken out comes back, and the earlier state is still whole
    third, how = index.update(entries, path)
    assert how == "incremental" and state(index.tables(spark, path, third)) == state(index.tables(spark, other, index.update(entries, f"file://{tmp_path}/b")[0]))
    assert index.update(entries.where("doc_id < 20"), path) == (first, "hit")
    none, _ = index.update(entries.limit(0), path)
    assert index.tables(spark, path, none)["weights"].count() == 0 == none["entry_count"]


def test_validity_and_cleaning(spark, entries, tmp_path):
    path = f"file://{tmp_path}/a"
    a, _ = index.update(entries.where("doc_id < 10"), path)
    assert index.problems(spark, path, a, index.SETTINGS | {"entry_count": 30}) == [] and index.problems(spark, path, a, {"tfidf_config": "other", "entry_count": 31}) == ["tfidf_config", "entry_count"]
    b, how = index.update(entries.where("doc_id < 10"), path, {"passage_config": "other"})
    assert how == "built" and b["key"] != a["key"]
    spark.createDataFrame([], "entry_id string, term string, tf long").write.mode("overwrite").parquet(f"{path}/segments/{b['segments'][0]['name']}/terms")
    assert index.problems(spark, path, b, {}) == [f"{b['segments'][0]['name']}/terms"]
    c, how = index.update(entries.where("doc_id < 10"), path, {"passage_config": "other"})
    assert how == "built"  # the damaged state is neither a hit nor a base
    assert index.clean(spark, path, keep=1) == sorted(s["name"] for m in (a, b) for s in m["segments"])
    assert [m["key"] for m in index.manifests(spark, path)] == [c["key"]] and index.problems(spark, path, c, {}) == [] and index.clean(spark, path, keep=1) == []
    assert index.manifests(spark, f"file://{tmp_path}/none") == [] and index.clean(spark, f"file://{tmp_path}/none") == []


def test_accents_are_folded(spark):
    """Every character of the basic plane, and titles that differ in accents alone."""
    import unicodedata

    from inkglass.functions import text as T
    from inkglass.operators import verification

    chars = [(c,) for c in map(chr, range(32, 0x10000)) if not "\ud800" <= c <= "\udfff"]
    df = spark.createDataFrame(chars, "c string").select("c", T.plain_ascii(F.col("c")).alias("p"))
    assert [(r.c, r.p) for r in df.collect() if r.p != unicodedata.normalize("NFKD", r.c).encode("ascii", "ignore").decode()] == []
    names = [("Müller: ﬁne naïve Çağrı №5", "Muller fine naive Cagr No5"), ("日本 Title", "title"), (None, None), ("", "")]
    got = spark.createDataFrame(names, "a string, b string").select(T.normalize_title(F.col("a")).alias("a"), T.normalize_title(F.col("b")).alias("b")).collect()
    assert all(r.a == r.b for r in got) and got[0].a == "muller fine naive cagr no5"
    one = spark.createDataFrame([("Müller, J. and Öz, A.", ["Jörg Muller", "Ayşe Oz"])], "e string, r array<string>")
    assert one.select(verification.author_score(F.col("e"), verification.surnames(F.col("r")))).first()[0] == 100


def test_a_row_an_entry(spark, entries, tmp_path):
    """A segment's files have no entry's name more than once, and terms' counts are the texts'."""
    path = f"file://{tmp_path}/a"
    index.update(entries.where("doc_id < 20"), path)
    m, _ = index.update(entries.where("doc_id >= 2"), path)
    for s in m["segments"]:
        assert s["counts"]["entries"] == s["counts"]["fingerprints"] == s["counts"]["terms"]
    found = index.tables(spark, path, m)
    got = {(r.entry_id, r.term): r.tf for r in found["terms"].collect()}
    want = {}
    for r in found["entries"].collect():
        w = [x for x in r.normalized_text.split() if len(x) > 1]
        for n in (1, 2, 3):
            for i in range(len(w) - n + 1):
                k = (r.entry_id, " ".join(w[i : i + n]))
                want[k] = want.get(k, 0) + 1
    assert got == want and {r.term: r.df for r in found["idf"].collect()} == {t: sum(k[1] == t for k in want) for t in {k[1] for k in want}}
