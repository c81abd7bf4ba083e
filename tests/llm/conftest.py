import pytest

from tests.conftest import SF_SMALL

SENTENCE = "the quick brown fox jumps over the lazy dog near the old stone bridge by the river"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, rid long, run long, node string, "
          "label string, bucket string, text_key string, keep_id string, row string, score string, key string, word string")


def edge_rows():
    """(doc_id, text): nulls, empty and long texts, copies, ties, repeated rows."""
    varied = SENTENCE.replace("stone", "wooden")
    words = [f"w{k % 977}x{k // 977}" for k in range(30_000)]
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "alone"), (5, "Alone"), (6, SENTENCE), (7, SENTENCE.upper()),
        (8, f"{SENTENCE} {varied} and so on until the end of it all"), (9, f"{SENTENCE} {varied} and so on until the end of it"),
        (10, " ".join(words)), (11, " ".join(words[:29_000])), (12, SENTENCE), (12, SENTENCE), (None, "a text without an id here"),
        (None, None), (13, "x" * 5_000), (14, f"first line of this text\n{SENTENCE}\nlast line of this text"),
        (15, "ÉCOLE école 日本語 ▁ \x00 end"), (16, "a  b   c\n\n\nd   e"),
    ]


@pytest.fixture(scope="session")
def edge(spark):
    """The edge rows with columns whose names the operators use themselves."""
    rows = [(i, t, "en", "s", 1, *[7] * 2, *["x"] * 9) for i, t in edge_rows()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    """The smallest documents table with the edge rows, and as a list."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(100_000 + k, t) for k, (i, t) in enumerate(edge_rows()) if i is not None],
                                 "doc_id long, text string")
    df = docs.unionByName(more).repartition(4).cache()
    return df, sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda r: r[0])


def rows_of(df, *columns):
    got = [tuple(r) for r in df.select(*columns).collect()]
    return sorted(got, key=repr)
