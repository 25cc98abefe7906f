"""Defined results for odd rows, empty tables and clashing column names."""

import pytest

from inkglass.llm import chat, decontaminate, exact_dedup, licenses, minhash, mixing, quality, secrets, token_counts, token_store


def items(spark):
    return spark.createDataFrame([(1, "Plain words stand in a plain row here today.", 3), (2, None, 3), (None, "A row without an id at all.", 3), (3, "", 3)], "item_id long, text string, doc_id long")


OPS = {
    "exact": lambda s, d, l: exact_dedup.exact_duplicates(d),
    "quality": lambda s, d, l: quality.quality(d, l),
    "licenses": lambda s, d, l: licenses.license_scan(d),
    "token_store": lambda s, d, l: token_store.token_store(d),
    "mixing": lambda s, d, l: mixing.mixing_rates(d, l),
    "token_counts": lambda s, d, l: token_counts.token_counts(d),
    "minhash": lambda s, d, l: minhash.near_duplicates(d),
    "secrets": lambda s, d, l: secrets.secrets(d),
}


@pytest.mark.parametrize("name", sorted(OPS))
def test_a_row_for_each_row(spark, odd, labels, name):
    out = OPS[name](spark, odd, labels)
    assert sorted(str(r.doc_id) for r in out.select("doc_id").collect()) == sorted(str(r.doc_id) for r in odd.select("doc_id").collect())


@pytest.mark.parametrize("name", sorted(OPS))
def test_empty_tables(spark, odd, labels, name):
    assert OPS[name](spark, odd.limit(0), labels.limit(0)).collect() == []


FILTERS = {
    "quality": lambda s, d, l: quality.keep_good(d, l),
    "minhash": lambda s, d, l: minhash.keep_one(d),
    "decontaminate": lambda s, d, l: decontaminate.decontaminate(d, items(s)),
    "mixing": lambda s, d, l: mixing.mixed(d, l),
}


@pytest.mark.parametrize("name", sorted(FILTERS))
def test_filters_keep_columns(spark, odd, labels, name):
    out = FILTERS[name](spark, odd, labels)
    assert out.columns == odd.columns and out.count() <= odd.count()
    assert FILTERS[name](spark, odd.limit(0), labels.limit(0)).count() == 0


def test_exact(spark, odd):
    r = {x.doc_id: x for x in exact_dedup.exact_duplicates(odd).collect() if x.doc_id is not None}
    assert (r[1].keep_id, r[2].keep_id, r[11].keep_id, r[11].kept) == (11, 11, 11, True)  # the longest original stays
    assert r[10].keep_id == 10 and r[3].keep_id == 5 and r[4].group_size == 4 and r[8].group_size == 2 and r[8].kept


def test_minhash(spark, odd):
    r = {x.doc_id: x for x in minhash.near_duplicates(odd).collect() if x.doc_id is not None}
    assert r[1].component_id == r[2].component_id == r[10].component_id == r[11].component_id == 1
    assert (r[3].n_shingles, r[4].component_id, r[5].kept, r[7].component_id) == (0, 4, True, 6)
    kept = minhash.keep_one(odd)
    assert kept.where("doc_id = 8").count() == 1 and kept.where("doc_id is null").count() == 2


def test_leaks(spark, odd):
    r = decontaminate.leaks(odd, items(spark)).collect()
    assert {(x.doc_id, x.item_id) for x in r} == {(1, 1), (2, 1), (10, 1), (11, 1)} and all(x.score == 1.0 for x in r)
    assert decontaminate.leaks(odd, items(spark).limit(0)).count() == 0


def test_leaks_of_short_and_unspaced_items(spark):
    found = {1: "Capital of France?", 2: "法国的首都是哪一座城市？请回答。", 3: "首都？", 4: "word"}
    it = spark.createDataFrame(list(found.items()), "item_id long, text string")
    docs = {1: "He asked: capital of FRANCE, and left", 2: "前文在此，法国的首都是哪一座城市?请回答！后文在此", 3: "the capital of all France", 4: "word by word", 5: "wordy", 6: "capital of", 7: "France"}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    r = decontaminate.leaks(df, it).collect()
    assert decontaminate.leaks(df.where("doc_id in (5, 7)"), it).count() == 0
    assert {(x.doc_id, x.item_id) for x in r} == {(1, 1), (2, 2), (2, 3), (4, 4)} and all(x.score == 1.0 for x in r)
    assert {(x.first_word, x.last_word) for x in r if x.item_id == 1} == {(2, 4)}


def test_quality_without_labels(spark, odd, labels):
    assert {r.score for r in quality.quality(odd, labels.limit(0)).collect()} == {0.5}


def test_rates_without_tokens(spark, odd, labels):
    assert {r.rate for r in mixing.mixing_rates(odd.where("text is null"), labels).collect()} == {1.0}


def test_tokens_of_nothing(spark, odd):
    r = {x.doc_id: x for x in token_store.token_store(odd.where("doc_id in (3, 4)")).collect()}
    assert (r[3].n_tokens, r[4].n_tokens, r[3].start, r[4].start) == (1, 1, 0, 1)
    assert {x.n_tokens for x in token_counts.token_counts(odd.where("doc_id in (3, 4)")).collect()} == {0}


def test_views(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, None, None, "late"), (1, 1, "ann", "hi"), (2, 0, "system", "only"), (None, 0, "ann", "x")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, block long")
    out = chat.perspectives(df).collect()
    assert {(r.conv_id, r.participant) for r in out} == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann")}
    ann = sorted((r for r in out if (r.conv_id, r.participant) == (1, "ann")), key=lambda r: r.seq)
    whole = "".join(r.segment for r in ann)
    assert [r.seq for r in ann] == [0, 1, 2, 3, 4] and all(whole[r.char_start : r.char_end] == r.segment for r in ann)
    assert [whole[r.mask_start : r.mask_end] for r in ann if r.trained] == ["hi<|im_end|>"] * 2
    assert "user name=bob" in whole and chat.perspectives(df.limit(0)).count() == 0


def test_views_over_blocks(spark):
    df = spark.range(300).selectExpr("1L conv_id", "id turn", "concat('p', id % 3) role", "repeat('t', cast(id % 5 as int)) text")
    r = sorted(chat.perspectives(df).where("participant = 'p1'").collect(), key=lambda x: x.seq)
    assert [x.seq for x in r] == list(range(300)) and all(a.char_end == b.char_start for a, b in zip(r, r[1:], strict=False))
