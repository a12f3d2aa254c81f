import pytest

ODD = [
    (1, "one two three four five six seven"),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (5, "one two three four five six seven"),
    (5, "one two three four five six seven"),
    (None, "a word"),
    (7, "ünïcode — “text” 😀 mit ß und é"),
    (8, "only"),
    (9, "x" * 3000),
    (10, "long text " * 3000),
    # an id that a third of all rows have
    *[(5, "one two three four five six seven")] * 4,
]
#: Columns whose names operators use inside.
CLASHING = ("_text", "row", "key", "size", "shard", "spans", "unit", "place", "at", "tie", "a.b", "c`d", "nth", "id", "tree", "digest", "words", "base")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    rows = [(i, t, "en", None if k % 3 == 0 else f"src{k % 2}", None if t is None else len(t), *(["x"] * len(CLASHING))) for k, (i, t) in enumerate(ODD)]
    extra = ", ".join("`" + c.replace("`", "``") + "` string" for c in CLASHING)
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra}")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("1 = 0")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
