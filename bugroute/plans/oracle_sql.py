"""DuckDB SQL text of the checks (one per registered query).

Each string is self-contained over the driver's pre-registered views.  The
shared pieces (the stand-in bug table, JVM-style split) are CTE snippets.
"""

from __future__ import annotations

from bugroute.schema import SEVERITY_STATES

BUGS_CTE = """bugs AS (
SELECT CAST(doc_id AS INT) AS row_id,
       CAST(doc_id % 37 AS INT) AS assigned_to,
       CAST(100000 + doc_id AS INT) AS bug_id,
       CASE doc_id % 7 WHEN 0 THEN 'normal' WHEN 1 THEN 'enhancement'
            WHEN 2 THEN 'major' WHEN 3 THEN 'trivial' WHEN 4 THEN 'critical'
            WHEN 5 THEN 'minor' ELSE 'blocker' END AS bug_severity,
       CASE doc_id % 3 WHEN 0 THEN 'CLOSED' WHEN 1 THEN 'RESOLVED'
            ELSE 'VERIFIED' END AS bug_status,
       CAST(substr(source, 4) AS INT) AS component_id,
       TIMESTAMP '2016-01-01 00:00:00' + INTERVAL '1' MINUTE * doc_id AS creation_ts,
       TIMESTAMP '2016-01-02 00:00:00' + INTERVAL '1' MINUTE * doc_id AS delta_ts,
       CAST(doc_id % 5 AS INT) AS product_id,
       'FIXED' AS resolution,
       substr(text, 1, 60) AS short_desc,
       text AS original_text,
       CASE WHEN doc_id % 50 = 7 THEN '' ELSE text END AS text,
       CASE lang WHEN 'en' THEN 10 WHEN 'fr' THEN 20 WHEN 'de' THEN 30
            ELSE 40 END AS class,
       CASE WHEN doc_id % 97 = 0 THEN 'trivial'
            ELSE CAST(doc_id % 41 AS VARCHAR) END AS class_raw
FROM documents)"""

PREDS_CTE = """preds AS (
SELECT row_id, class AS label,
       CASE WHEN class = 40 OR row_id % 5 = 0 THEN 10 ELSE class END AS prediction
FROM bugs)"""

LABEL_PREDS_CTE = """lpreds AS (SELECT doc_id, quality AS label, toxic AS prediction FROM labels)"""


def java_split(parts: str) -> str:
    """Trim trailing empty strings of a split list column (JVM rule)."""
    last = f"coalesce(list_position(list_transform(list_reverse({parts}), lambda x: x <> ''), true), 0)"
    return (f"CASE WHEN len({parts}) <= 1 THEN {parts} WHEN {last} = 0 THEN []::VARCHAR[] "
            f"ELSE {parts}[1:len({parts}) - {last} + 1] END")


def words_expr(text: str) -> str:
    return java_split(f"string_split_regex({text}, '\\W+')")


def sentences_expr(text: str) -> str:
    return java_split(f"string_split_regex({text}, '\\. ')")


def words_from(table: str, keys: str, text: str = "text", out: str = "w") -> str:
    """Subquery (keys, out): the split runs once, then the trailing trim."""
    return (f"(SELECT {keys}, {java_split('__p')} AS {out} FROM "
            f"(SELECT {keys}, string_split_regex({text}, '\\W+') AS __p FROM {table}))")


TOKEN_STRIP = "[\\d\\.:,\"''\\(\\)\\[\\]|/?!;]+"  # quote doubled for SQL


def tokens_expr(text: str) -> str:
    cleaned = f"lower(regexp_replace({text}, '{TOKEN_STRIP}', '', 'g'))"
    return f"list_filter(string_split_regex({cleaned}, '[ \\t\\n\\r\\f]+'), lambda t: t <> '')"


def word_token_expr(word: str) -> str:
    return f"lower(regexp_replace({word}, '{TOKEN_STRIP}', '', 'g'))"


def groups_expr(words: str, height: int, per_group: int = 5) -> str:
    """List of ``height`` word groups (TXT4) from a word list column."""
    need = per_group * height
    n = f"len({words})"
    copies = f"(CASE WHEN {n} < {need} THEN 2 + {need} // {n} ELSE 1 END)"
    length = f"(({n} * {copies}) // {height})"
    body = (f"list_transform(range({height}), lambda i: list_transform(range({length}), "
            f"lambda j: {words}[((i * {length} + j) % {n}) + 1]))")
    empty = f"list_transform(range({height}), lambda i: []::VARCHAR[])"
    return f"(CASE WHEN coalesce({n}, 0) = 0 THEN {empty} ELSE {body} END)"


def severity_values() -> str:
    return ", ".join(f"({i}, '{s}')" for i, s in enumerate(SEVERITY_STATES))


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
