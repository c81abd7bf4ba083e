"""Text operators against a plain-Python model of the JVM split rules."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bugroute.operators import text as txt


def jvm_split(s, pattern):
    """JVM String.split(regex) rule, written out for the tests."""
    if s == "":
        return [""]
    parts = re.split(pattern, s)
    if len(parts) == 1:
        return parts
    while parts and parts[-1] == "":
        parts.pop()
    return parts


def groups_model(words, h, per=5):
    n = len(words)
    if n == 0:
        return [[] for _ in range(h)]
    padded = list(words)
    if n < per * h:
        padded = words * (2 + (per * h) // n)
    length = len(padded) // h
    return [padded[i * length:(i + 1) * length] for i in range(h)]


def words_of(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    return [r.words for r in txt.words(df, "text").orderBy("id").collect()]


def test_fixture_words(spark):
    got = words_of(spark, ["a b.", "...", " x y", "né e", ""])
    assert got == [["a", "b"], [], ["", "x", "y"], ["n", "e"], [""]]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="ab .,é\n_1", max_size=30), min_size=1, max_size=20))
def test_words_match_jvm_rule(spark, texts):
    got = words_of(spark, texts)
    want = [jvm_split(t, r"[^A-Za-z0-9_]+") for t in texts]
    assert got == want


def test_sentences_trailing_empties(spark):
    df = spark.createDataFrame([(0, "a. b. "), (1, "a. . "), (2, ". "), (3, "x")], "id int, text string")
    rows = txt.sentences(df, "text", key="id").orderBy("id", "pos").collect()
    got = {}
    for r in rows:
        got.setdefault(r.id, []).append(r.sentence)
    assert got == {0: ["a", "b"], 1: ["a"], 3: ["x"]}


@pytest.mark.parametrize("h,n", [(1, 2), (1, 7), (25, 7), (25, 124), (25, 125), (25, 126), (1, 1), (1, 5)])
def test_word_groups_edge_cases(spark, h, n):
    words = [f"w{i}" for i in range(n)]
    df = spark.createDataFrame([(words,)], "words array<string>")
    got = txt.word_groups(df, h, "words", "groups").first().groups
    assert got == groups_model(words, h)


def test_word_groups_fixture_counts(spark):
    df = spark.createDataFrame([(["a", "b"],), ([f"w{i}" for i in range(7)],)], "words array<string>")
    g1 = [r.groups for r in txt.word_groups(df, 1, "words", "groups").collect()]
    assert len(g1[0][0]) == 8 and len(g1[1][0]) == 7
    g25 = txt.word_groups(df.limit(2), 25, "words", "groups").collect()[1].groups
    assert len(g25) == 25 and all(len(g) == 5 for g in g25)


def test_word_groups_empty(spark):
    df = spark.createDataFrame([([],)], "words array<string>")
    assert txt.word_groups(df, 3, "words", "groups").first().groups == [[], [], []]


def test_tokens(spark):
    df = spark.createDataFrame([("Hello, World! 42 it's (ok)\tNew\nline",)], "text string")
    assert txt.tokens(df, "text").first().tokens == ["hello", "world", "its", "ok", "new", "line"]


def test_escape_round_trip(spark):
    df = spark.createDataFrame([("new york",)], "word string")
    e = txt.escape_words(df, "word", "escaped")
    assert e.first().escaped == "new_Az92_york"
    assert txt.unescape_words(e, "escaped", "back").first().back == "new york"


def test_words_on_whole_documents(spark):
    from tests.conftest import SF_SMALL
    from bugroute.sources.tables import load_table

    docs = load_table(spark, SF_SMALL, "documents")
    rows = txt.words(docs, "text").select("text", "words").collect()
    for r in rows:
        assert r.words == jvm_split(r.text, r"[^A-Za-z0-9_]+")


def test_no_inferred_filter_duplicates_split(spark):
    df = spark.createDataFrame([("a b c",)], "text string")
    g = txt.exploded_groups(df.withColumn("k", F.lit(1)), "k", 25)
    plan = g._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
