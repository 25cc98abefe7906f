import pytest

LONG = "Word number by number stands here again. " * 4000


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, ties and repeated rows, and
    extra columns whose names operators use inside."""
    rows = [
        (1, "Plain words stand in a plain row here today."), (2, "Plain words stand in a plain row here today."), (3, None), (4, ""), (5, " \t\n"), (6, LONG), (7, LONG + "end"), (None, "A row without an id at all."),
        (None, None), (8, "x"), (8, "x"), (9, "日本語のテキスト 😀 é"), (10, "PLAIN words stand in a plain row here today."), (11, "Plain words  stand in a plain row here today."),
    ]
    more = ["label", "key", "node", "row", "kept", "score", "copies", "slot", "hub", "part", "a", "b", "n", "y", "rate", "component_id", "item_id", "keep_id"]
    return spark.createDataFrame([(i, t, "en", "s", 1, *range(len(more))) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` long" for c in more))


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(1, 1, 0), (2, 1, 0), (6, 0, 0), (7, 0, 1), (8, 1, None), (9, None, 1), (None, 1, 1), (10, 0, 0), (11, 1, 0)]
    return spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, quality int, toxic int, text long")


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
