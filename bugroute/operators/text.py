"""Text operators (TXT1-TXT5): DataFrame -> DataFrame over whole texts.

All splitting is done by JVM regex built-ins inside whole-stage codegen;
explode keeps the document key so later joins/aggregations stay distributed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bugroute.functions.arrays import posexplode_rows
from bugroute.functions.text import (
    SENTENCE_SEPARATOR,
    UNICODE_WORD_SEPARATOR,
    WORD_SEPARATOR,
    escape_word,
    groups_of,
    padded_words,
    token_array,
    trim_trailing_empty,
    unescape_word,
    word_token,
)

# Group height per network architecture, words per group.
HEIGHT_BY_ARCHITECTURE = {"cnn": 25, "rnn": 1, "deep": 1}
WORDS_PER_GROUP = 5


def _split(df: DataFrame, column: str, pattern: str, out: str) -> DataFrame:
    """Split once into a hidden column, then trim it (two projections, so the
    regex is evaluated once per row)."""
    tmp = f"__{out}_parts"
    return (df.withColumn(tmp, F.split(F.col(column), pattern, -1))
            .withColumn(out, trim_trailing_empty(tmp)).drop(tmp))


def sentences(df: DataFrame, column: str = "text", key: str | None = None,
              out: str = "sentence") -> DataFrame:
    """One row per sentence, flattened over all rows, with its position (TXT1)."""
    keep = [key] if key else []
    s = _split(df.select(*keep, column), column, SENTENCE_SEPARATOR, "__s")
    return posexplode_rows(s, keep, "__s", "pos", out)


def words(df: DataFrame, column: str = "text", out: str = "words", unicode: bool = False) -> DataFrame:
    """Add the word array of ``column`` (TXT2)."""
    return _split(df, column, UNICODE_WORD_SEPARATOR if unicode else WORD_SEPARATOR, out)


def tokens(df: DataFrame, column: str = "text", out: str = "tokens") -> DataFrame:
    """Add the embedding token array of ``column`` (TXT3)."""
    return df.withColumn(out, token_array(F.col(column)))


def word_groups(df: DataFrame, height: int, column: str = "words", out: str = "groups",
                per_group: int = WORDS_PER_GROUP) -> DataFrame:
    """Add ``height`` word groups built from the ``column`` word array (TXT4)."""
    tmp = f"__{out}_padded"
    return (df.withColumn(tmp, padded_words(F.col(column), height, per_group))
            .withColumn(out, groups_of(tmp, height)).drop(tmp))


def exploded_groups(df: DataFrame, key: str | list[str], height: int, text: str = "text",
                    per_group: int = WORDS_PER_GROUP) -> DataFrame:
    """(key, group, pos, word): one row per word of every group.

    Empty groups (no words) produce no rows; callers left-join on (key, group)
    to keep them.
    """
    keys = [key] if isinstance(key, str) else list(key)
    w = words(df.select(*keys, text), text, "__w")
    g = word_groups(w, height, "__w", "__g", per_group)
    per_group_rows = posexplode_rows(g, keys, "__g", "group", "__ws")
    return posexplode_rows(per_group_rows, [*keys, "group"], "__ws", "pos", "word")


def exploded_group_tokens(df: DataFrame, key: str | list[str], height: int, text: str = "text",
                          per_group: int = WORDS_PER_GROUP) -> DataFrame:
    """(key, group, token): the words of each group passed through the
    embedding pre-processor (as the group text is tokenised before lookup).

    Words cut at ASCII ``\\W+`` hold only letters, digits and ``_``, so of the
    pre-processor's strip set only digits can occur: a ``translate`` (no
    regex) followed by ``lower`` gives the same token.
    """
    w = exploded_groups(df, key, height, text, per_group)
    token = F.lower(F.translate(F.col("word"), "0123456789", ""))
    keys = [key] if isinstance(key, str) else list(key)
    return w.select(*keys, "group", token.alias("token")).where(F.col("token") != "")


def escape_words(df: DataFrame, column: str = "word", out: str | None = None) -> DataFrame:
    """Space -> escape token (TXT5)."""
    return df.withColumn(out or column, escape_word(F.col(column)))


def unescape_words(df: DataFrame, column: str = "word", out: str | None = None) -> DataFrame:
    return df.withColumn(out or column, unescape_word(F.col(column)))


def group_token_arrays(df: DataFrame, key: str, height: int, text: str = "text",
                       per_group: int = WORDS_PER_GROUP) -> DataFrame:
    """(key, group, tokens array): each word group's tokens, built with array
    functions on the row (no collect, no shuffle).  See
    ``exploded_group_tokens`` for why ``translate`` equals the pre-processor."""
    w = words(df.select(key, text), text, "__w")
    g = word_groups(w, height, "__w", "__g", per_group)
    rows = posexplode_rows(g, key, "__g", "group", "__ws")
    cleaned = F.transform("__ws", lambda x: F.lower(F.translate(x, "0123456789", "")))
    return rows.select(key, "group", F.filter(cleaned, lambda t: t != F.lit("")).alias("tokens"))
