"""Text Column expressions.

The reference splits with the JVM ``String.split`` rule: pieces are cut at
every match, trailing empty pieces are dropped, but an input without any match
is returned whole (so ``''`` gives ``['']``).  Spark's ``split`` keeps trailing
empties, so ``java_split`` trims them explicitly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word escape used by every word-vector text format.
SPACE_ESCAPE = "_Az92_"

# Word and sentence separators of the reference (JVM regex).
WORD_SEPARATOR = r"\W+"
UNICODE_WORD_SEPARATOR = r"(?U)\W+"
SENTENCE_SEPARATOR = r"\. "

# The token pre-processor of the embedding library removes these
# characters (digits and punctuation) and lower-cases; tokens are cut at the
# JVM StringTokenizer default delimiters (space, tab, newline, return, formfeed).
TOKEN_STRIP_PATTERN = r"[\d\.:,\"'\(\)\[\]|/?!;]+"
TOKEN_DELIMITERS = "[ \t\n\r\f]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_trailing_empty(parts: Column | str) -> Column:
    """JVM rule on an already split array: drop trailing empty strings, but
    keep a single-piece result (no match) as it is.

    ``parts`` should be a column reference: it is used several times.
    """
    p = _col(parts)
    # 1-based position, from the end, of the last non-empty piece (0: none).
    last_non_empty = F.array_position(F.transform(F.reverse(p), lambda x: x != F.lit("")), True)
    n = F.size(p)
    return (
        F.when(n <= 1, p)
        .when(last_non_empty == 0, F.array().cast("array<string>"))
        .otherwise(F.slice(p, 1, n - last_non_empty + 1))
    )


def java_split(c: Column | str, pattern: str) -> Column:
    """``split`` with the JVM rule for trailing empty strings.

    Single-expression form; the DataFrame operators in ``operators.text``
    materialise the split in its own projection first so the regex runs once.
    """
    return trim_trailing_empty(F.split(_col(c), pattern, -1))


def sentence_array(c: Column | str) -> Column:
    """Sentences: split on period + space (TXT1)."""
    return java_split(c, SENTENCE_SEPARATOR)


def word_array(c: Column | str, unicode: bool = False) -> Column:
    """Words: split on runs of non-word characters (TXT2).

    ASCII word class by default (accented letters separate words), as the
    reference; ``unicode=True`` treats every letter as a word character.
    """
    return java_split(c, UNICODE_WORD_SEPARATOR if unicode else WORD_SEPARATOR)


def token_array(c: Column | str) -> Column:
    """Embedding tokens (TXT3): whitespace tokens, digits/punctuation removed,
    lower case, empty tokens dropped.

    Removing non-whitespace characters and lower-casing commute with the
    whitespace cut, so both run once on the whole text (one regex pass).
    """
    cleaned = F.lower(F.regexp_replace(_col(c), TOKEN_STRIP_PATTERN, ""))
    return F.filter(F.split(cleaned, TOKEN_DELIMITERS, -1), lambda t: t != F.lit(""))


def group_copies(words: Column | str, height: int, per_group: int = 5) -> Column:
    """How many times the word list is repeated before grouping (TXT4)."""
    n = F.size(_col(words))
    need = per_group * height
    return (F.when(F.coalesce(n, F.lit(0)) <= 0, F.lit(0))
            .when(n < need, F.lit(2) + F.floor(F.lit(need) / n).cast("int"))
            .otherwise(F.lit(1)))


def padded_words(words: Column | str, height: int, per_group: int = 5) -> Column:
    w = _col(words)
    return F.flatten(F.array_repeat(w, group_copies(w, height, per_group)))


def groups_of(padded: Column | str, height: int) -> Column:
    """``height`` consecutive slices of ``total div height`` words; the rest is
    dropped.  An empty list gives ``height`` empty groups.  ``padded`` should
    be a column reference (used inside the lambda)."""
    p = _col(padded)
    length = F.floor(F.size(p) / F.lit(height)).cast("int")
    groups = F.transform(F.sequence(F.lit(0), F.lit(height - 1)),
                         lambda i: F.slice(p, i * length + 1, length))
    empty = F.array_repeat(F.array().cast("array<string>"), height)
    return F.when(F.coalesce(F.size(p), F.lit(0)) <= 0, empty).otherwise(groups)


def word_group_arrays(words: Column | str, height: int, per_group: int = 5) -> Column:
    """Word groups (TXT4) as one expression: ``height`` groups of consecutive
    words.  Fewer than ``per_group * height`` words: the list is repeated
    ``2 + (per_group * height) div n`` times first; each group has
    ``total div height`` words; no words: ``height`` empty groups.

    Prefer ``operators.text.word_groups``, which materialises the padded
    list once per row.
    """
    return groups_of(padded_words(words, height, per_group), height)


def escape_word(c: Column | str) -> Column:
    """Space -> escape token, as written in every word-vector text file."""
    return F.replace(_col(c), F.lit(" "), F.lit(SPACE_ESCAPE))


def unescape_word(c: Column | str) -> Column:
    return F.replace(_col(c), F.lit(SPACE_ESCAPE), F.lit(" "))


def word_token(c: Column | str) -> Column:
    """The embedding token of one word (pre-processor applied); '' if none."""
    return F.lower(F.regexp_replace(_col(c), TOKEN_STRIP_PATTERN, ""))
