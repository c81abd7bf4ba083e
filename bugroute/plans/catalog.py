"""Registered checks: one Spark query per operator plus its DuckDB oracle.

Each entry maps a name to ``(spark_fn(spark, sf_dir) -> DataFrame, sql | None)``.
Every query runs over whole driver tables (or tables Spark derives from
them).  Array outputs are exploded with their position and floats are rounded
to 6 places on both sides, so the engines compare value by value.
"""

from __future__ import annotations

import math
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bugroute.functions.arrays import pad_array, posexplode_rows
from bugroute.operators import categories as cat
from bugroute.operators import columns as colops
from bugroute.operators import evaluate as ev
from bugroute.operators import ordering as order
from bugroute.operators import text as txt
from bugroute.operators import vectors as vec
from bugroute.plans import oracle_sql as q
from bugroute.session import scratch_path
from bugroute.schema import LIGHT_JOB_COLUMNS, SEVERITY_STATES, TEXT_JOB_COLUMNS
from bugroute.sources.tables import bugs_table, label_preds_table, load_table, preds_table

SparkFn = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, tuple[SparkFn, str | None]] = {}


def positive_zero_rounds(sql: str) -> str:
    """Wrap every ``round(...)`` as ``(round(...) + 0.0)``: DuckDB keeps a
    negative zero after rounding, Spark does not; IEEE -0.0 + 0.0 = 0.0."""
    out, i = [], 0
    while True:
        j = sql.find("round(", i)
        if j < 0 or (j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k = 0, j + 5
        while k < len(sql):
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        inner = positive_zero_rounds(sql[j + 6:k])
        out.append(sql[i:j] + "(round(" + inner + ") + 0.0)")
        i = k + 1


def check(name: str, sql: str | None):
    def deco(fn: SparkFn) -> SparkFn:
        CATALOG[name] = (fn, positive_zero_rounds(sql) if sql else sql)
        return fn
    return deco


B = q.with_ctes(q.BUGS_CTE)
BP = q.with_ctes(q.BUGS_CTE, q.PREDS_CTE)
LP = q.with_ctes(q.LABEL_PREDS_CTE)


def _r6(c):
    return F.round(c, 6)


# --------------------------------------------------------------------------
# Sources / projections / filters (SRC stand-in, PRJ1-3, FLT1-3)

@check("bugs_table", B + "SELECT * FROM bugs")
def _bugs(spark, sf):
    return bugs_table(spark, sf)


@check("keep_columns", B + "SELECT text, bug_severity, component_id, product_id, class FROM bugs")
def _keep(spark, sf):
    return colops.keep_columns(bugs_table(spark, sf), TEXT_JOB_COLUMNS)


@check("drop_where_class", B + """SELECT bug_severity, component_id, product_id, class
FROM bugs WHERE class < 25""")
def _drop_where(spark, sf):
    kept = colops.drop_where(bugs_table(spark, sf), "class", ">=", 25)
    return colops.keep_columns(kept, LIGHT_JOB_COLUMNS)


@check("drop_where_bad_cells", B + """SELECT row_id, class_raw FROM bugs
WHERE TRY_CAST(class_raw AS INT) < 25""")
def _drop_where_bad(spark, sf):
    return colops.drop_where(bugs_table(spark, sf), "class_raw", ">=", 25).select("row_id", "class_raw")


@check("drop_where_counts", B + """SELECT count(*) FILTER (TRY_CAST(class_raw AS INT) < 25) AS n_kept,
  count(*) FILTER (coalesce(TRY_CAST(class_raw AS INT) >= 25, true)) AS n_removed,
  count(*) FILTER (TRY_CAST(class_raw AS INT) IS NULL) AS n_bad FROM bugs""")
def _drop_where_counts(spark, sf):
    return colops.count_where(bugs_table(spark, sf), "class_raw", ">=", 25)


@check("rows_by_verdict", B + """, v AS (SELECT row_id, CASE WHEN TRY_CAST(class_raw AS INT) IS NULL THEN 'class is no number'
    WHEN TRY_CAST(class_raw AS INT) >= 25 THEN 'class of 25 or more' WHEN length(coalesce(text, '')) = 0 THEN 'no text' ELSE 'kept' END AS verdict
  FROM bugs)
SELECT row_id, verdict, count(*) OVER (PARTITION BY verdict) AS n_observed FROM v""")
def _rows_by_verdict(spark, sf):
    """Kept and rejected rows of one write, with the counts observed on the way."""
    number = F.col("class_raw").try_cast("int")
    rules = {"class is no number": number.isNull(), "class of 25 or more": number >= 25,
             "no text": F.length(F.coalesce("text", F.lit(""))) == 0}
    kept, gone, counts = colops.divide_rows(bugs_table(spark, sf), rules, scratch_path(spark, "verdicts"))
    rows = kept.select("row_id", F.lit(colops.KEPT).alias("verdict")).unionByName(gone.select("row_id", "verdict"))
    seen = spark.createDataFrame(list(counts.items()), "verdict string, n_observed long")
    return rows.join(F.broadcast(seen), "verdict")


_CSV_TEXT = "nullif(regexp_replace({c}, '[\r\n,\"]', ' ', 'g'), '')"
_CSV_SQL = B + "SELECT * REPLACE (" + ", ".join(
    _CSV_TEXT.format(c=c) + " AS " + c for c in ("short_desc", "original_text", "text")) + ") FROM bugs"


def _bugs_csv(spark, sf, **kw):
    """The bug table written as the job's CSV and scanned again (SRC1, SRC2)."""
    from bugroute.sinks.bugs_csv import write_bugs_csv
    from bugroute.sources.bugs_csv import read_bugs

    path = scratch_path(spark, "bugs-csv")
    write_bugs_csv(bugs_table(spark, sf), path)
    return read_bugs(spark, path, **kw)


@check("bugs_csv", _CSV_SQL.replace("SELECT * REPLACE", "SELECT * EXCLUDE (class_raw) REPLACE"))
def _src1(spark, sf):
    return _bugs_csv(spark, sf)


@check("bugs_csv_restricted", B + "SELECT component_id, class FROM bugs")
def _src2(spark, sf):
    return _bugs_csv(spark, sf, columns=[5, 13])


@check("progress_rows", "SELECT count(*) AS n_rows, count(*) AS n_seen FROM documents")
def _progress(spark, sf):
    df, seen = order.with_progress(load_table(spark, sf, "documents").select("doc_id"))
    path = scratch_path(spark, "progress")
    df.write.parquet(path)
    rows = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.withColumn("n_seen", F.lit(seen.get["rows"]).cast("long"))


@check("drop_empty_text", B + "SELECT row_id FROM bugs WHERE length(coalesce(text, '')) > 0")
def _drop_empty(spark, sf):
    return colops.drop_empty_text(bugs_table(spark, sf)).select("row_id")


@check("safe_int", B + """SELECT row_id, TRY_CAST(class_raw AS INT) AS class_raw FROM bugs
WHERE TRY_CAST(class_raw AS INT) IS NOT NULL""")
def _safe_int(spark, sf):
    return colops.safe_int(bugs_table(spark, sf), "class_raw").select("row_id", "class_raw")


@check("to_category", B + "SELECT row_id, CAST(component_id AS VARCHAR) AS component FROM bugs")
def _to_category(spark, sf):
    b = bugs_table(spark, sf)
    names = colops.identity_names(cat.fit_categories(b, "component_id"))
    return colops.to_category(b, "component_id", names, out="component").select("row_id", "component")


# --------------------------------------------------------------------------
# Categories, one-hot, classes (AGG1-3, PRJ4)

@check("fit_categories", B + """SELECT component_id,
  CAST(row_number() OVER (ORDER BY component_id) - 1 AS BIGINT) AS state_idx
FROM (SELECT DISTINCT component_id FROM bugs WHERE component_id IS NOT NULL)""")
def _fit_categories(spark, sf):
    return cat.category_table(bugs_table(spark, sf), "component_id")


_ONE_HOT_SQL = B + """, comp AS (
  SELECT component_id AS state, CAST(row_number() OVER (ORDER BY component_id) - 1 AS INT) AS pos
  FROM (SELECT DISTINCT component_id FROM bugs WHERE component_id IS NOT NULL)),
prod AS (
  SELECT product_id AS state, CAST(row_number() OVER (ORDER BY product_id) - 1 AS INT) AS pos
  FROM (SELECT DISTINCT product_id FROM bugs WHERE product_id IS NOT NULL)),
sev AS (SELECT * FROM (VALUES """ + q.severity_values() + """) s(pos, state))
SELECT row_id, 'bug_severity' AS feature, CAST(sev.pos AS INT) AS pos,
       CAST(CASE WHEN bug_severity = sev.state THEN 1 ELSE 0 END AS DOUBLE) AS value FROM bugs, sev
UNION ALL
SELECT row_id, 'component_id', comp.pos,
       CAST(CASE WHEN component_id = comp.state THEN 1 ELSE 0 END AS DOUBLE) FROM bugs, comp
UNION ALL
SELECT row_id, 'product_id', prod.pos,
       CAST(CASE WHEN product_id = prod.state THEN 1 ELSE 0 END AS DOUBLE) FROM bugs, prod"""


@check("one_hot", _ONE_HOT_SQL)
def _one_hot(spark, sf):
    b = bugs_table(spark, sf)
    lists = cat.fit_categories_many(b, ["component_id", "product_id"])
    comps, prods = lists["component_id"], lists["product_id"]
    enc = cat.one_hot(cat.one_hot(cat.one_hot(b, "bug_severity", SEVERITY_STATES),
                                  "component_id", comps), "product_id", prods)
    features = ("bug_severity", "component_id", "product_id")
    one = enc.select("row_id", F.explode(F.array(*(
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("states")) for c in features))).alias("f"))
    return posexplode_rows(one.select("row_id", "f.feature", "f.states"), ["row_id", "feature"], "states")


@check("index_classes", B + """, cls AS (
  SELECT class, CAST(row_number() OVER (ORDER BY class) - 1 AS INT) AS label
  FROM (SELECT DISTINCT class FROM bugs WHERE class IS NOT NULL))
SELECT row_id, class, label FROM bugs JOIN cls USING (class)""")
def _index_classes(spark, sf):
    indexed, _ = cat.index_classes(bugs_table(spark, sf), "class")
    return indexed.select("row_id", "class", "label")


@check("n_classes", B + "SELECT CAST(count(DISTINCT class) AS BIGINT) AS n_classes FROM bugs")
def _n_classes(spark, sf):
    return cat.n_classes(bugs_table(spark, sf), "class")


# --------------------------------------------------------------------------
# Positional split and batches (AGG4, AGG5)

@check("split_positional", B + """, kept AS (SELECT row_id FROM bugs WHERE length(coalesce(text, '')) > 0)
SELECT row_id, (row_number() OVER (ORDER BY row_id) - 1) < (9 * count(*) OVER ()) // 10 AS is_train
FROM kept""")
def _split(spark, sf):
    kept = colops.drop_empty_text(bugs_table(spark, sf)).select("row_id")
    return order.split_positional(kept, "row_id", 9, 10)


@check("split_positional_light", B + """, kept AS (SELECT row_id FROM bugs WHERE class < 25)
SELECT row_id, (row_number() OVER (ORDER BY row_id) - 1) < (7 * count(*) OVER ()) // 10 AS is_train
FROM kept""")
def _split_light(spark, sf):
    kept = colops.drop_where(bugs_table(spark, sf), "class", ">=", 25).select("row_id")
    return order.split_positional(kept, "row_id", 7, 10)


@check("batches", B + """, kept AS (SELECT row_id FROM bugs WHERE length(coalesce(text, '')) > 0),
pos AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS p, count(*) OVER () AS n FROM kept),
train AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS p
          FROM pos WHERE p < (9 * n) // 10)
SELECT CAST(p // 25 AS BIGINT) AS batch_id, count(*) AS n_rows FROM train GROUP BY 1""")
def _batches(spark, sf):
    kept = colops.drop_empty_text(bugs_table(spark, sf)).select("row_id")
    train, _ = order.train_test(kept, "row_id", 9, 10)
    return order.batch_sizes(order.batches(train, "row_id", 25))


@check("positions", B + """SELECT row_id, CAST(row_number() OVER (ORDER BY product_id, row_id) - 1 AS BIGINT) AS idx
FROM bugs""")
def _positions(spark, sf):
    return order.with_position(bugs_table(spark, sf).select("row_id", "product_id"),
                               ["product_id", "row_id"]).select("row_id", "idx")


@check("positions_text_key", B + """SELECT row_id, CAST(row_number() OVER (ORDER BY bug_severity, short_desc, row_id) - 1
  AS BIGINT) AS idx FROM bugs""")
def _positions_text(spark, sf):
    return order.with_position(bugs_table(spark, sf).select("row_id", "bug_severity", "short_desc"),
                               ["bug_severity", "short_desc", "row_id"]).select("row_id", "idx")


# --------------------------------------------------------------------------
# Evaluation (EV1-EV9)

_PER_CLASS_SQL = """, conf AS (SELECT label, prediction, count(*) AS cnt FROM {src} GROUP BY label, prediction),
bp AS (SELECT prediction AS class, sum(cnt) AS n_pred,
              sum(CASE WHEN label = prediction THEN cnt ELSE 0 END) AS tp FROM conf GROUP BY prediction),
bl AS (SELECT label AS class, sum(cnt) AS n_label FROM conf GROUP BY label),
pc0 AS (SELECT coalesce(bp.class, bl.class) AS class,
               CAST(coalesce(tp, 0) AS BIGINT) AS tp,
               CAST(coalesce(n_pred, 0) - coalesce(tp, 0) AS BIGINT) AS fp,
               CAST(coalesce(n_label, 0) - coalesce(tp, 0) AS BIGINT) AS fn,
               CAST(coalesce(n_label, 0) AS BIGINT) AS class_count
        FROM bp FULL OUTER JOIN bl ON bp.class = bl.class),
pc1 AS (SELECT *, CASE WHEN tp + fp = 0 THEN NULL ELSE tp / (tp + fp) END AS precision,
                  CASE WHEN tp + fn = 0 THEN NULL ELSE tp / (tp + fn) END AS recall FROM pc0),
pc AS (SELECT *, CASE WHEN precision > 0 AND recall > 0
                      THEN 2 * precision * recall / (precision + recall) END AS f1 FROM pc1)
"""

_METRICS_SQL = """, agg AS (SELECT sum(tp) AS tp, sum(class_count) AS n,
  sum(precision) AS sp, count(precision) AS cp, sum(recall) AS sr, count(recall) AS cr,
  sum(CASE WHEN precision IS NOT NULL THEN precision * class_count END) AS wp,
  sum(CASE WHEN precision IS NOT NULL THEN class_count END) AS wpn,
  sum(CASE WHEN recall IS NOT NULL THEN recall * class_count END) AS wr,
  sum(CASE WHEN recall IS NOT NULL THEN class_count END) AS wrn,
  sum(CASE WHEN precision > 0 AND recall > 0 THEN f1 * class_count END) AS wf,
  sum(CASE WHEN precision > 0 AND recall > 0 THEN class_count END) AS wfn FROM pc),
m0 AS (SELECT
  CASE WHEN coalesce(n, 0) = 0 THEN 'NaN'::DOUBLE ELSE tp / n END AS accuracy,
  CASE WHEN cp = 0 THEN 'NaN'::DOUBLE ELSE sp / cp END AS precision,
  CASE WHEN cr = 0 THEN 'NaN'::DOUBLE ELSE sr / cr END AS recall,
  CASE WHEN coalesce(wpn, 0) = 0 THEN 'NaN'::DOUBLE ELSE wp / wpn END AS wprecision,
  CASE WHEN coalesce(wrn, 0) = 0 THEN 'NaN'::DOUBLE ELSE wr / wrn END AS wrecall,
  CASE WHEN coalesce(wfn, 0) = 0 THEN 'NaN'::DOUBLE ELSE wf / wfn END AS wf1,
  CAST(coalesce(n, 0) AS BIGINT) AS n FROM agg),
m AS (SELECT accuracy, precision, recall,
  CASE WHEN isnan(precision) OR isnan(recall) OR precision + recall = 0 THEN 'NaN'::DOUBLE
       ELSE 2 * precision * recall / (precision + recall) END AS f1,
  wprecision, wrecall, wf1, n FROM m0)
"""


def _round_metrics(df: DataFrame) -> DataFrame:
    return df.select(*[_r6(F.col(c)).alias(c) if c != "n" else F.col(c) for c in df.columns])


_METRIC_COLS_SQL = """SELECT round(accuracy, 6) AS accuracy, round(precision, 6) AS precision,
  round(recall, 6) AS recall, round(f1, 6) AS f1, round(wprecision, 6) AS wprecision,
  round(wrecall, 6) AS wrecall, round(wf1, 6) AS wf1, n FROM m"""


@check("confusion_labels", LP + """SELECT label, prediction, count(*) AS count
FROM lpreds GROUP BY label, prediction""")
def _confusion_labels(spark, sf):
    return ev.confusion(label_preds_table(spark, sf))


@check("confusion_preds", BP + """SELECT label, prediction, count(*) AS count
FROM preds GROUP BY label, prediction""")
def _confusion_preds(spark, sf):
    return ev.confusion(preds_table(spark, sf))


@check("per_class", BP + _PER_CLASS_SQL.format(src="preds") + """SELECT class, tp, fp, fn, class_count,
  round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM pc""")
def _per_class(spark, sf):
    pc = ev.per_class(preds_table(spark, sf))
    return pc.select("class", "tp", "fp", "fn", "class_count",
                     *[_r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


@check("metrics_preds", BP + _PER_CLASS_SQL.format(src="preds") + _METRICS_SQL + _METRIC_COLS_SQL)
def _metrics_preds(spark, sf):
    return _round_metrics(ev.metrics(preds_table(spark, sf)))


@check("metrics_labels", LP + _PER_CLASS_SQL.format(src="lpreds") + _METRICS_SQL + _METRIC_COLS_SQL)
def _metrics_labels(spark, sf):
    return _round_metrics(ev.metrics(label_preds_table(spark, sf)))


@check("metric_warnings", BP + _PER_CLASS_SQL.format(src="preds") + """
SELECT class, replace('""" + ev.NEVER_PREDICTED + """', '{c}', CAST(class AS VARCHAR)) AS warning
FROM pc WHERE tp = 0 AND fp = 0
UNION ALL
SELECT class, replace('""" + ev.NEVER_TRUE_LABEL + """', '{c}', CAST(class AS VARCHAR))
FROM pc WHERE tp = 0 AND fn = 0""")
def _warnings(spark, sf):
    return ev.metric_warnings(preds_table(spark, sf))


_FMT = ("CASE WHEN isnan(value) THEN 'NaN' ELSE regexp_replace(regexp_replace("
        "printf('%.4f', round_even(value, 4)), '0+$', ''), '\\.$', '') END")


@check("report_scores", BP + _PER_CLASS_SQL.format(src="preds") + _METRICS_SQL + """
SELECT score, round(value, 6) AS value, """ + _FMT + """ AS text FROM (
  SELECT 'accuracy' AS score, accuracy AS value FROM m UNION ALL
  SELECT 'precision', precision FROM m UNION ALL SELECT 'recall', recall FROM m UNION ALL
  SELECT 'f1', f1 FROM m UNION ALL SELECT 'wprecision', wprecision FROM m UNION ALL
  SELECT 'wrecall', wrecall FROM m UNION ALL SELECT 'wf1', wf1 FROM m)""")
def _report(spark, sf):
    t = ev.report_table(preds_table(spark, sf))
    return t.select("score", _r6(F.col("value")).alias("value"), "text")


@check("report_full", BP + _PER_CLASS_SQL.format(src="preds") + """SELECT
  (SELECT count(*) FROM conf) AS n_cells, (SELECT count(*) FROM pc WHERE tp = 0 AND (fp = 0 OR fn = 0)) AS n_warnings,
  (SELECT string_agg('Examples labeled as ' || label || ' classified by model as ' || prediction || ': ' || cnt || ' times',
   chr(10) ORDER BY label, prediction) FROM conf) AS cells, true AS short_has_none""")
def _report_full(spark, sf):
    preds = preds_table(spark, sf)
    head = ev.report(preds).split(ev.TOP_RULE)[0].split("\n")
    short = ev.report(preds, full=False).split(ev.TOP_RULE)[0].strip()
    cells = [x for x in head if x.startswith("Examples")]
    warned = [x for x in head if x.startswith("Warning")]
    return spark.createDataFrame([(len(cells), len(warned), "\n".join(cells), short == "")],
                                 "n_cells long, n_warnings long, cells string, short_has_none boolean")


# --------------------------------------------------------------------------
# Text (TXT1-TXT5)

@check("sentences", "SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INT) AS pos, unnest(s) AS sentence "
       "FROM (SELECT doc_id, " + q.sentences_expr("text") + " AS s FROM documents)")
def _sentences(spark, sf):
    return txt.sentences(load_table(spark, sf, "documents"), "text", key="doc_id")


@check("words", "SELECT doc_id, CAST(len(w) AS INT) AS n_words, md5(array_to_string(w, '|')) AS words_md5 "
       "FROM " + q.words_from("documents", "doc_id"))
def _words(spark, sf):
    w = txt.words(load_table(spark, sf, "documents"), "text")
    return w.select("doc_id", F.size("words").alias("n_words"),
                    F.md5(F.array_join("words", "|")).alias("words_md5"))


@check("words_exploded", "SELECT item_id, CAST(generate_subscripts(w, 1) - 1 AS INT) AS pos, unnest(w) AS word "
       "FROM " + q.words_from("benchmark", "item_id"))
def _words_exploded(spark, sf):
    w = txt.words(load_table(spark, sf, "benchmark"), "text")
    return posexplode_rows(w, "item_id", "words", "pos", "word")


@check("tokens", "SELECT doc_id, CAST(len(t) AS INT) AS n_tokens, md5(array_to_string(t, '|')) AS tokens_md5 "
       "FROM (SELECT doc_id, " + q.tokens_expr("text") + " AS t FROM documents)")
def _tokens(spark, sf):
    t = txt.tokens(load_table(spark, sf, "documents"), "text")
    return t.select("doc_id", F.size("tokens").alias("n_tokens"),
                    F.md5(F.array_join("tokens", "|")).alias("tokens_md5"))


def _groups_sql(height: int) -> str:
    return ("SELECT doc_id, CAST(generate_subscripts(g, 1) - 1 AS INT) AS grp, "
            "CAST(len(unnest(g)) AS INT) AS n_words, md5(array_to_string(unnest(g), '|')) AS group_md5 "
            "FROM (SELECT doc_id, " + q.groups_expr("w", height) + " AS g FROM "
            + q.words_from("documents", "doc_id") + ")")


def _groups_spark(spark, sf, height):
    w = txt.words(load_table(spark, sf, "documents").select("doc_id", "text"), "text")
    g = txt.word_groups(w, height, "words", "groups")
    e = posexplode_rows(g, "doc_id", "groups", "grp", "ws")
    return e.select("doc_id", "grp", F.size("ws").alias("n_words"),
                    F.md5(F.array_join("ws", "|")).alias("group_md5"))


@check("word_groups_cnn", _groups_sql(25))
def _groups25(spark, sf):
    return _groups_spark(spark, sf, 25)


@check("word_groups_rnn", _groups_sql(1))
def _groups1(spark, sf):
    return _groups_spark(spark, sf, 1)


@check("escape_words", "SELECT conv_id, turn, replace(text, ' ', '_Az92_') AS escaped, "
       "replace(replace(text, ' ', '_Az92_'), '_Az92_', ' ') = text AS round_trip FROM conversations")
def _escape(spark, sf):
    c = load_table(spark, sf, "conversations")
    e = txt.escape_words(c, "text", "escaped")
    back = txt.unescape_words(e, "escaped", "back")
    return back.select("conv_id", "turn", "escaped", (F.col("back") == F.col("text")).alias("round_trip"))


# --------------------------------------------------------------------------
# Vectors (VEC1-3, VEC6-8, PRJ5)

def _exploded_sql(value_expr: str, src: str) -> str:
    return (f"SELECT vec_id, CAST(generate_subscripts(v, 1) - 1 AS INT) AS pos, round(CAST(unnest(v) AS DOUBLE), 6) AS value "
            f"FROM (SELECT vec_id, {value_expr} AS v FROM {src})")


_UNIT = ("(CASE WHEN sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) = 0 "
         "THEN CAST(embedding AS DOUBLE[]) ELSE list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / "
         "sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y)))) END)")


@check("unit_vectors", _exploded_sql(_UNIT, "embeddings"))
def _unit(spark, sf):
    e = vec.unit_vectors(load_table(spark, sf, "embeddings"), "embedding")
    return posexplode_rows(e, "vec_id", "embedding").withColumn("value", _r6(F.col("value")))


@check("clear_nans", _exploded_sql(
    "list_transform(embedding, lambda x: CASE WHEN isnan(x) THEN CAST(0 AS FLOAT) ELSE x END)", "embeddings"))
def _nans(spark, sf):
    e = vec.clear_nans(load_table(spark, sf, "embeddings"), "embedding")
    return (posexplode_rows(e, "vec_id", "embedding")
            .withColumn("value", _r6(F.col("value").cast("double"))))


VOCAB_CTE = ("vocab AS (SELECT word, count, CAST(row_number() OVER (ORDER BY count DESC, word) - 1 AS BIGINT) AS idx "
             "FROM (SELECT word, count(*) AS count FROM (SELECT unnest(" + q.tokens_expr("text") + ") AS word "
             "FROM documents) GROUP BY word))")


@check("build_vocab", "WITH " + VOCAB_CTE + " SELECT word, count, idx FROM vocab")
def _vocab(spark, sf):
    return vec.build_vocab(txt.tokens(load_table(spark, sf, "documents"), "text"), "tokens")


def word_vector_table(spark: SparkSession, sf: str) -> DataFrame:
    """Word vectors derived from the tables: the document vocabulary (by
    frequency) joined to ``embeddings`` on idx = vec_id.  Words beyond the
    embedding count have no vector (unknown words)."""
    vocab = vec.build_vocab(txt.tokens(load_table(spark, sf, "documents"), "text"), "tokens")
    emb = load_table(spark, sf, "embeddings")
    return vec.vectors_from(vocab, emb, matrix_idx="vec_id", matrix_vector="embedding")


WV_CTE = VOCAB_CTE + (", wv AS (SELECT v.word, v.idx, CAST(e.embedding AS DOUBLE[]) AS vector "
                      "FROM vocab v JOIN embeddings e ON v.idx = e.vec_id)")


@check("vectors_from", "WITH " + WV_CTE + " SELECT word, idx, CAST(generate_subscripts(vector, 1) - 1 AS INT) AS pos, "
       "round(unnest(vector), 6) AS value FROM wv")
def _vectors_from(spark, sf):
    wv = word_vector_table(spark, sf)
    return (posexplode_rows(wv, ["word", "idx"], "vector")
            .withColumn("value", _r6(F.col("value").cast("double"))))


def _doc_vectors_sql(height: int, dims_expr: str = "(SELECT max(len(embedding)) FROM embeddings)") -> str:
    return ("WITH " + WV_CTE + """,
w AS (SELECT doc_id, """ + q.groups_expr("w", height) + """ AS g FROM """ + q.words_from("documents", "doc_id") + """),
gw AS (SELECT doc_id, CAST(generate_subscripts(g, 1) - 1 AS INT) AS grp, unnest(g) AS ws FROM w),
tw AS (SELECT doc_id, grp, """ + q.word_token_expr("unnest(ws)") + """ AS token FROM gw),
hits AS (SELECT doc_id, grp, vector FROM tw JOIN wv ON tw.token = wv.word WHERE token <> ''),
hx AS (SELECT doc_id, grp, generate_subscripts(vector, 1) - 1 AS pos, unnest(vector) AS x FROM hits),
means AS (SELECT doc_id, grp, CAST(pos AS INT) AS pos, avg(x) AS value FROM hx GROUP BY doc_id, grp, pos),
allg AS (SELECT doc_id, CAST(grp AS INT) AS grp, CAST(pos AS INT) AS pos FROM documents,
         range(""" + str(height) + """) r(grp), range(""" + dims_expr + """) p(pos))
SELECT allg.doc_id, allg.grp AS "group", allg.pos, round(coalesce(means.value, CAST(0 AS DOUBLE)), 6) AS value
FROM allg LEFT JOIN means ON allg.doc_id = means.doc_id AND allg.grp = means.grp AND allg.pos = means.pos""")


def _doc_vectors_spark(spark, sf, height):
    docs = load_table(spark, sf, "documents")
    dims = len(load_table(spark, sf, "embeddings").select("embedding").first()[0])
    dv = vec.doc_vectors(docs, word_vector_table(spark, sf), "doc_id", height, dims)
    return (posexplode_rows(dv, ["doc_id", "group"], "vector")
            .withColumn("value", _r6(F.col("value"))))


@check("doc_vectors_rnn", _doc_vectors_sql(1))
def _dv1(spark, sf):
    return _doc_vectors_spark(spark, sf, 1)


@check("doc_vectors_cnn", _doc_vectors_sql(25))
def _dv25(spark, sf):
    return _doc_vectors_spark(spark, sf, 25)


@check("vector_labels", "SELECT CASE WHEN label % 4 = 0 THEN 'v ' ELSE 'v' END || vec_id AS label FROM embeddings "
       "WHERE label % 2 = 0")
def _labels(spark, sf):
    return vec.labels(named_vectors(spark, sf))


@check("pad_codes", "SELECT vec_id, CAST(generate_subscripts(v, 1) - 1 AS INT) AS pos, unnest(v) AS code FROM (SELECT vec_id, "
       "list_concat(list_transform(range(vec_id % 13), lambda i: CAST(i + label AS BIGINT)), "
       "[CAST(0 AS BIGINT) FOR k IN range(40)])[1:40] AS v FROM embeddings)")
def _pad(spark, sf):
    e = load_table(spark, sf, "embeddings")
    n = F.col("vec_id") % 13
    codes = F.when(n == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: i + F.col("label")))
    return posexplode_rows(e.select("vec_id", pad_array(codes, 40).alias("v")), "vec_id", "v", "pos", "code")


_ASSEMBLE_SQL = ("WITH " + VOCAB_CTE + B[4:].strip().join([", ", ""]) + """, wv AS (SELECT v.word, CAST(e.embedding AS DOUBLE[])
  AS vector FROM vocab v JOIN embeddings e ON v.idx = e.vec_id),
kept AS (SELECT * FROM bugs WHERE length(coalesce(text, '')) > 0),
w AS (SELECT row_id, unnest(ws) AS word FROM (SELECT row_id, w AS ws FROM """ + q.words_from("kept", "row_id") + """)),
tw AS (SELECT row_id, """ + q.word_token_expr("word") + """ AS token FROM w),
hx AS (SELECT row_id, generate_subscripts(vector, 1) - 1 AS pos, unnest(vector) AS x FROM tw JOIN wv ON tw.token = wv.word
  WHERE token <> ''),
mean AS (SELECT row_id, pos, avg(x) AS value FROM hx GROUP BY row_id, pos),
comp AS (SELECT component_id AS state, row_number() OVER (ORDER BY component_id) - 1 AS pos
  FROM (SELECT DISTINCT component_id FROM bugs)),
prod AS (SELECT product_id AS state, row_number() OVER (ORDER BY product_id) - 1 AS pos
  FROM (SELECT DISTINCT product_id FROM bugs)),
sev AS (SELECT * FROM (VALUES """ + q.severity_values() + """) s(pos, state)),
cls AS (SELECT class, row_number() OVER (ORDER BY class) - 1 AS label FROM (SELECT DISTINCT class FROM bugs)),
size AS (SELECT (SELECT max(len(embedding)) FROM embeddings) AS d, (SELECT count(*) FROM sev) AS s,
  (SELECT count(*) FROM comp) AS c),
one AS (SELECT row_id, mean.pos AS pos, value FROM mean
  UNION ALL SELECT row_id, d + sev.pos, 1 FROM kept JOIN sev ON bug_severity = sev.state, size
  UNION ALL SELECT row_id, d + s + comp.pos, 1 FROM kept JOIN comp ON component_id = comp.state, size
  UNION ALL SELECT row_id, d + s + c + prod.pos, 1 FROM kept JOIN prod ON product_id = prod.state, size)
SELECT row_id, CAST(label AS INT) AS label, CAST(pos AS INT) AS pos, round(value, 6) AS value
FROM one JOIN kept USING (row_id) JOIN cls USING (class) WHERE value <> 0""")


@check("assemble", _ASSEMBLE_SQL)
def _assemble(spark, sf):
    plan = _text_plan(spark, sf)
    out = posexplode_rows(plan.features, ["row_id", "label"], "features")
    return out.where("value != 0").withColumn("value", _r6(F.col("value")))


@check("assemble_sparse", _ASSEMBLE_SQL)
def _assemble_sparse(spark, sf):
    """The same rows from sparse vectors, categories as tables."""
    from pyspark.ml.functions import vector_to_array

    wv, dims = routing.derived_word_vectors(spark, sf)
    plan = routing.text_features(bugs_table(spark, sf), wv, dims, "rnn", sparse=True)
    dense = plan.features.select("row_id", "label", vector_to_array("features").alias("features"))
    out = posexplode_rows(dense, ["row_id", "label"], "features")
    return out.where("value != 0").withColumn("value", _r6(F.col("value")))


# --------------------------------------------------------------------------
# Losses (LS1-LS14)

from bugroute.functions.losses import LOSS_NAMES, activate, example_score  # noqa: E402
from bugroute.operators import losses as lossops  # noqa: E402

# Activation used for each loss in the check (output layer pairing).
LOSS_ACTIVATION = {
    "MCXENT": "softmax", "NegativeLogLikelihood": "softmax", "KLD": "softmax", "Poisson": "softmax",
    "BinaryXENT": "sigmoid", "MSLE": "sigmoid",
}


def loss_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """(vec_id, labels, pre_output, mask) derived from ``embeddings``:
    labels = softmax of the second half of the components, pre_output = the first."""
    e = load_table(spark, sf, "embeddings")
    emb = F.col("embedding").cast("array<double>")
    half = F.floor(F.size(emb) / 2).cast("int")
    return e.select(
        "vec_id",
        activate(F.slice(emb, half + 1, half), "softmax").alias("labels"),
        F.slice(emb, F.lit(1), half).alias("pre_output"),
        F.when(F.col("label") % 3 == 0, F.lit(0.0)).otherwise(F.lit(1.0)).alias("mask"))


_DUCK_ACT = {
    "identity": "z",
    "sigmoid": "list_transform(z, lambda x: 1.0 / (1.0 + exp(-x)))",
    "softmax": ("list_transform(z, lambda x: exp(x - list_max(z)) / "
                "list_sum(list_transform(z, lambda t: exp(t - list_max(z)))))"),
}
_CLIP = "least(greatest({x}, 1e-10), 1 - 1e-10)"


def _duck_loss(name: str, p: str, factor: str = "") -> str:
    """``factor``: SQL factor of output i's share, like ``* m[i]``."""
    a, b = "y[i]", f"{p}[i]"
    cb = _CLIP.format(x=b)
    terms = {
        "MSE": f"({a} - {b}) * ({a} - {b})", "L2": f"({a} - {b}) * ({a} - {b})",
        "MAE": f"abs({a} - {b})", "L1": f"abs({a} - {b})",
        "MCXENT": f"{a} * ln({cb})", "NegativeLogLikelihood": f"{a} * ln({cb})",
        "BinaryXENT": f"{a} * ln({cb}) + (1.0 - {a}) * ln(1.0 - {cb})",
        "Hinge": f"greatest(0.0, 1.0 - {a} * {b})",
        "SquaredHinge": f"pow(greatest(0.0, 1.0 - {a} * {b}), 2)",
        "KLD": f"least(greatest({a}, 1e-10), 1.0) * ln(least(greatest({a}, 1e-10), 1.0) / least(greatest({b}, 1e-10), 1.0))",
        "MAPE": f"abs(({a} - {b}) / {a})",
        "MSLE": f"pow(ln(({b} + 1.0) / ({a} + 1.0)), 2)",
        "Poisson": f"{b} - {a} * ln({cb})",
    }
    if name == "CosineProximity":
        return ("-(list_sum(list_transform(range(1, len(y) + 1), lambda i: y[i] * p[i]" + factor + ")) / "
                "(sqrt(list_sum(list_transform(y, lambda a: a * a))) * "
                f"sqrt(list_sum(list_transform({p}, lambda b: b * b)))))").replace("p[i]", f"{p}[i]")
    s = f"list_sum(list_transform(range(1, len(y) + 1), lambda i: ({terms[name]}){factor}))"
    if name in ("MCXENT", "NegativeLogLikelihood", "BinaryXENT"):
        s = f"-({s})"
    if name in ("MSE", "MAE", "MSLE", "Poisson"):
        s = f"({s}) / len(y)"
    if name == "MAPE":
        s = f"100.0 * ({s}) / len(y)"
    return s


_LOSS_BASE = """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS emb FROM embeddings),
i AS (SELECT vec_id, CASE WHEN label % 3 = 0 THEN 0.0 ELSE 1.0 END AS mask,
  list_transform(t, lambda x: exp(x - list_max(t)) / list_sum(list_transform(t, lambda u: exp(u - list_max(t))))) AS y,
  z FROM (SELECT vec_id, label, emb[len(emb) // 2 + 1:len(emb) // 2 * 2] AS t, emb[1:len(emb) // 2] AS z FROM e)),
act AS (SELECT vec_id, mask, y, """ + ", ".join(
    f"{v} AS p_{k}" for k, v in _DUCK_ACT.items()) + """ FROM i),
scores AS (""" + "\nUNION ALL\n".join(
    f"SELECT vec_id, mask, '{n}' AS loss, "
    f"CAST({_duck_loss(n, 'p_' + LOSS_ACTIVATION.get(n, 'identity'))} AS DOUBLE) AS score FROM act"
    for n in LOSS_NAMES) + ")\n"


def _loss_scores(spark, sf):
    inp = loss_inputs(spark, sf)
    cols = []
    for n in LOSS_NAMES:
        act = LOSS_ACTIVATION.get(n, "identity")
        cols += [F.lit(n), example_score(n, "labels", activate("pre_output", act))]
    stacked = F.stack(F.lit(len(LOSS_NAMES)), *cols).alias("loss", "score")
    return inp.select("vec_id", "mask", stacked)


@check("losses", _LOSS_BASE + "SELECT vec_id, loss, round(score, 6) AS score FROM scores")
def _losses(spark, sf):
    return _loss_scores(spark, sf).select("vec_id", "loss", _r6(F.col("score")).alias("score"))


@check("losses_masked", _LOSS_BASE.split("scores AS (")[0] + "scores AS (" + "\nUNION ALL\n".join(
    f"SELECT vec_id, '{n}' AS loss, CAST({_duck_loss(n, 'p_' + LOSS_ACTIVATION.get(n, 'identity'), ' * ((i + vec_id) % 2)')} AS DOUBLE) "
    "AS score FROM act" for n in LOSS_NAMES) + """)
SELECT vec_id, loss, round(score, 6) AS score FROM scores""")
def _losses_masked(spark, sf):
    """Every second output masked out."""
    half = F.transform("labels", lambda _, i: (F.pmod(i + 1 + F.col("vec_id"), F.lit(2))).cast("double"))
    inp = loss_inputs(spark, sf).withColumn("outputs", half)
    scored = inp
    for n in LOSS_NAMES:
        scored = lossops.loss(scored, n, activation=LOSS_ACTIVATION.get(n, "identity"), mask="outputs", out=n)
    stacked = F.stack(F.lit(len(LOSS_NAMES)), *(x for n in LOSS_NAMES for x in (F.lit(n), F.col(n)))).alias("loss", "score")
    return scored.select("vec_id", stacked).withColumn("score", _r6(F.col("score")))


@check("loss_totals", _LOSS_BASE + """SELECT loss, round(sum(score * mask), 6) AS total,
  round(sum(score * mask) / count(*), 6) AS average FROM scores GROUP BY loss""")
def _loss_totals(spark, sf):
    inp = loss_inputs(spark, sf)
    out = lossops.loss_totals(inp, [(n, LOSS_ACTIVATION.get(n, "identity")) for n in LOSS_NAMES],
                              "labels", "pre_output", "mask")
    return out.select("loss", _r6(F.col("total")).alias("total"), _r6(F.col("average")).alias("average"))


# --------------------------------------------------------------------------
# Formats: each sink writes to the shared scratch folder, its source reads
# it back, and the check compares with the table the file was made from.

from bugroute.sinks import vectors as snk  # noqa: E402
from bugroute.functions.text import unescape_word  # noqa: E402
from bugroute.sources import vectors as src  # noqa: E402
from bugroute.sinks import binary  # noqa: E402
from bugroute.operators import huffman  # noqa: E402

_WORD_SQL = ("CASE WHEN label % 4 = 0 THEN 'v ' || CAST(vec_id AS VARCHAR) "
             "ELSE 'v' || CAST(vec_id AS VARCHAR) END")


def named_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(word, idx, vector, is_label, count) from ``embeddings``; every fourth
    label gets a word with a space (exercises the escape)."""
    e = load_table(spark, sf, "embeddings")
    vid = F.col("vec_id").cast("string")
    word = F.when(F.col("label") % 4 == 0, F.concat(F.lit("v "), vid)).otherwise(F.concat(F.lit("v"), vid))
    return e.select(word.alias("word"), F.col("vec_id").cast("int").alias("idx"),
                    F.col("embedding").alias("vector"), (F.col("label") % 2 == 0).alias("is_label"),
                    (F.col("label") + 1).cast("double").alias("count"))


def _vec_rows(df: DataFrame, keys, vector: str = "vector") -> DataFrame:
    out = posexplode_rows(df, keys, vector)
    return out.withColumn("value", _r6(F.col("value").cast("double")))


#: Exploded rows of an ``embeddings`` vector under other keys.
_VEC_ROWS_SQL = ("SELECT {keys}, CAST(generate_subscripts(v, 1) - 1 AS INT) AS pos, "
                 "round(CAST(unnest(v) AS DOUBLE), 6) AS value FROM (SELECT {cols}, embedding AS v FROM embeddings)")


@check("word_vectors_text", _VEC_ROWS_SQL.format(keys="word", cols=_WORD_SQL + " AS word"))
def _wv_text(spark, sf):
    path = scratch_path(spark, "vectors-text")
    snk.write_word_vectors(named_vectors(spark, sf), path)
    return _vec_rows(src.read_word_vectors(spark, path, header="auto"), "word")


@check("word_vectors_plain", _VEC_ROWS_SQL.format(keys="word", cols=_WORD_SQL + " AS word"))
def _wv_plain(spark, sf):
    path = scratch_path(spark, "vectors-plain")
    snk.write_word_vectors(named_vectors(spark, sf), path, compression="gzip")
    return _vec_rows(src.read_word_vectors(spark, path, header=False), "word")


def _headed_files(spark, sf, path):
    """Three files with a header each; the second also has its header as data."""
    named = named_vectors(spark, sf)
    dims = named.agg(F.max(F.size("vector"))).first()[0]
    for k in range(3):
        own = named.where(F.col("idx") % 3 == k)
        body = own.select(snk.vector_line(F.col("word"), "vector").alias("value"), F.lit(2).alias("at"))
        head = own.agg(F.concat_ws(" ", F.count(F.lit(1)), F.lit(dims)).alias("value")).withColumn("at", F.lit(1))
        lines = head.unionByName(body).repartitionByRange(1, "at").sortWithinPartitions("at")
        lines.select("value").write.mode("append").text(path)


@check("word_vectors_header", _VEC_ROWS_SQL.format(keys="word", cols=_WORD_SQL + " AS word"))
def _wv_header(spark, sf):
    path = scratch_path(spark, "vectors-headed")
    _headed_files(spark, sf, path)
    return _vec_rows(src.read_word_vectors(spark, path), "word")


@check("word_vectors_strict", _VEC_ROWS_SQL.format(keys="word", cols=_WORD_SQL + " AS word"))
def _wv_strict(spark, sf):
    path = scratch_path(spark, "vectors-strict")
    _headed_files(spark, sf, path)
    return _vec_rows(src.read_word_vectors(spark, path, strict_dims=True), "word")


@check("embedding_checkpoints", """SELECT word, CAST(epoch AS INT) AS epoch,
  CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS pos, round(CAST(unnest(embedding) AS DOUBLE), 6) AS value
FROM (SELECT """ + _WORD_SQL + """ AS word, embedding FROM embeddings), (SELECT unnest([1, 12]) AS epoch)""")
def _embedding_checkpoints(spark, sf):
    path = scratch_path(spark, "embedding-checkpoints")
    for epoch in (1, 12):
        snk.save_embeddings(named_vectors(spark, sf).select("word", "vector"), path, epoch)
    return _vec_rows(spark.read.parquet(path), ["word", "epoch"])


@check("tagged_vectors", _VEC_ROWS_SQL.format(
    keys="is_label, word", cols=_WORD_SQL + " AS word, label % 2 = 0 AS is_label"))
def _tagged(spark, sf):
    path = scratch_path(spark, "vectors-tagged")
    snk.write_tagged_vectors(named_vectors(spark, sf), path)
    return _vec_rows(src.read_tagged_vectors(spark, path), ["is_label", "word"])


def _model_words(spark, sf):
    v = named_vectors(spark, sf)
    return v.select("word", "count", "idx",
                    F.array((F.col("count").cast("int") % 2), (F.col("idx") % 2)).alias("codes"),
                    F.array(F.col("idx"), F.col("count").cast("int")).alias("points"),
                    F.col("vector").cast("array<double>").alias("syn0"),
                    F.reverse(F.col("vector").cast("array<double>")).alias("syn1"))


def _numbers(df: DataFrame, keys, **parts) -> DataFrame:
    """(keys, part, pos, value) of several array columns, one row a number."""
    rows = F.array(*(F.struct(F.lit(p).alias("part"), F.col(c).cast("array<double>").alias("v")) for p, c in parts.items()))
    out = df.select(*keys, F.explode(rows).alias("__p")).select(*keys, "__p.part", F.col("__p.v").alias("v"))
    return posexplode_rows(out, [*keys, "part"], "v")


def _numbers_sql(keys: str, source: str, **parts: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {keys}, '{p}' AS part, CAST(generate_subscripts(v, 1) - 1 AS INT) AS pos, unnest(v) AS value "
        f"FROM (SELECT *, CAST({e} AS DOUBLE[]) AS v FROM {source})" for p, e in parts.items())


@check("full_model_json", _numbers_sql("word, count, idx", "(SELECT " + _WORD_SQL + """ AS word, CAST(label + 1 AS DOUBLE) AS count,
  CAST(vec_id AS INT) AS idx, label, embedding FROM embeddings)""", codes="[(label + 1) % 2, idx % 2]", points="[idx, label + 1]",
    syn0="embedding", syn1="list_reverse(embedding)"))
def _full_model(spark, sf):
    path = scratch_path(spark, "full-model")
    snk.write_full_model(_model_words(spark, sf), path, config_json='{"layersSize": 64}')
    words, _config = src.read_full_model(spark, path)
    return _numbers(words, ["word", "count", "idx"], codes="codes", points="points", syn0="syn0", syn1="syn1")


@check("sequence_vectors", _VEC_ROWS_SQL.format(keys="object", cols=_WORD_SQL + " AS object"))
def _sequence(spark, sf):
    path = scratch_path(spark, "sequence")
    v = named_vectors(spark, sf).select(F.col("word").alias("object"), "vector")
    snk.write_sequence_vectors(v, path, config_json='{"layersSize": 64}')
    elements, _config = src.read_sequence_vectors(spark, path)
    return _vec_rows(elements, "object")


@check("vocab_json", "WITH " + VOCAB_CTE + " SELECT word, CAST(count AS DOUBLE) AS count, idx FROM vocab")
def _vocab_json(spark, sf):
    path = scratch_path(spark, "vocab")
    vocab = vec.build_vocab(txt.tokens(load_table(spark, sf, "documents"), "text"), "tokens")
    snk.write_vocab(vocab, path)
    return src.read_vocab(spark, path).select("word", "count", "idx")


_BUNDLE_SQL = _numbers_sql("word, idx, is_label", "(SELECT " + _WORD_SQL + """ AS word, CAST(vec_id AS INT) AS idx,
  label = 0 AS is_label, embedding FROM embeddings)""", syn0="embedding", syn1="list_transform(embedding, lambda x: 2 * CAST(x AS DOUBLE))",
    codes="CASE WHEN idx % 3 = 0 THEN [0, 1] ELSE [] END", points="CASE WHEN idx % 3 = 0 THEN [idx, idx] ELSE [] END")


def _bundle_parts(spark, sf):
    """(vectors, syn1, codes, labels) of a bundle; some codes and labels have no word."""
    v = named_vectors(spark, sf)
    lab = F.col("is_label") & (F.col("count") == 1)
    syn1 = v.select("idx", F.transform(F.col("vector").cast("array<double>"), lambda x: 2 * x).alias("syn1"))
    known = v.where(F.col("idx") % 3 == 0).select(
        "word", F.array(F.lit(0), F.lit(1)).alias("codes"), F.array("idx", "idx").alias("points"))
    unknown = v.select(F.concat(F.lit("u"), F.col("word")).alias("word"),
                       F.array(F.lit(1)).alias("codes"), F.array("idx").alias("points"))
    labels = v.select(F.when(lab, F.col("word")).otherwise(F.concat(F.lit("nolabel"), F.col("word"))).alias("label"))
    return v, syn1, known.unionByName(unknown), labels


def _bundle_rows(bundle: DataFrame) -> DataFrame:
    ids = bundle.withColumn("idx", F.col("idx").cast("int"))
    return _numbers(ids, ["word", "idx", "is_label"], syn0="vector", syn1="syn1", codes="codes", points="points")


@check("embedding_bundle", _BUNDLE_SQL)
def _bundle(spark, sf):
    path = scratch_path(spark, "bundle")
    v, syn1, codes, labels = _bundle_parts(spark, sf)
    spaced = labels.select(F.concat(F.lit(" "), "label", F.lit(" ")).alias("label"))
    snk.write_embedding_bundle(path, v, syn1, codes, spaced, '{"layersSize": 64}')
    return _bundle_rows(src.read_embedding_bundle(spark, path))


@check("zip_bundle", _BUNDLE_SQL)
def _zip_bundle(spark, sf):
    path = scratch_path(spark, "zip-bundle")
    binary.write_zip_bundle(path, *_bundle_parts(spark, sf), '{"layersSize": 64}')
    return _bundle_rows(src.read_zip_bundle(spark, path))


@check("word2vec_binary", _numbers_sql("word", "(SELECT 'v' || CAST(vec_id AS VARCHAR) AS word, embedding FROM embeddings)", syn0="embedding"))
def _word2vec_binary(spark, sf):
    path = scratch_path(spark, "word2vec-binary")
    v = named_vectors(spark, sf).select(F.concat(F.lit("v"), "idx").alias("word"), "vector")
    binary.write_word2vec_binary(v, path, rows_per_file=200)
    back = src.read_word2vec_binary(spark, path, linebreaks=True, normalize=False, partition_bytes=20_000)
    return _numbers(back, ["word"], syn0="vector")


@check("huffman_codes", "WITH " + VOCAB_CTE + """
SELECT word, CAST(1 AS BIGINT) AS n_at_code, true AS as_long, true AS rooted FROM vocab""")
def _huffman(spark, sf):
    """Each word's code is its own, its points start at the root; see also ``huffman_facts``."""
    vocab = vec.build_vocab(txt.tokens(load_table(spark, sf, "documents"), "text"), "tokens")
    codes = huffman.huffman_codes(vocab).withColumn("code", F.array_join("codes", "")).checkpoint()
    at = codes.groupBy("code").agg(F.count(F.lit(1)).alias("n_at_code"))
    top = F.lit(vocab.count() - 2)
    return codes.join(at, "code").select("word", "n_at_code", (F.size("codes") == F.size("points")).alias("as_long"),
                                         (F.get("points", F.lit(0)) == top).alias("rooted"))


@check("huffman_facts", "WITH " + VOCAB_CTE + """
SELECT count(*) AS n_words, 1.0::DOUBLE AS kraft, true AS near_entropy, 0::BIGINT AS n_longer_than_rarer FROM vocab""")
def _huffman_facts(spark, sf):
    """The lengths fill the tree (Kraft sum 1), a word of more occurrences has no
    longer code, and the mean length is within one bit of the entropy."""
    vocab = vec.build_vocab(txt.tokens(load_table(spark, sf, "documents"), "text"), "tokens")
    codes = huffman.huffman_codes(vocab).select("count", F.size("codes").alias("bits"))
    per = codes.groupBy("count").agg(F.min("bits").alias("low"), F.max("bits").alias("high"), F.count(F.lit(1)).alias("n"),
                                     F.sum(F.pow(F.lit(0.5), F.col("bits"))).alias("kraft"), F.sum("bits").alias("bits"))
    rows = sorted(per.collect(), key=lambda r: r["count"])   # distinct counts
    total = sum(r["count"] * r["n"] for r in rows)
    mean = sum(r["count"] * r["bits"] for r in rows) / total
    entropy = -sum(r["n"] * r["count"] / total * math.log2(r["count"] / total) for r in rows)
    longer = sum(b["high"] > a["low"] for a, b in zip(rows, rows[1:]))
    return spark.createDataFrame([(sum(r["n"] for r in rows), sum(r["kraft"] for r in rows), entropy <= mean + 1e-9 < entropy + 1, longer)],
                                 "n_words long, kraft double, near_entropy boolean, n_longer_than_rarer long")


@check("embedding_bundle_plain", """SELECT """ + _WORD_SQL + """ AS word, CAST(vec_id AS INT) AS idx, false AS is_label,
  CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS pos, round(CAST(unnest(embedding) AS DOUBLE), 6) AS value
FROM embeddings""")
def _bundle_plain(spark, sf):
    path = scratch_path(spark, "bundle-plain")
    snk.write_embedding_bundle(path, named_vectors(spark, sf))
    return _vec_rows(src.read_embedding_bundle(spark, path), ["word", "idx", "is_label"])


@check("projection_csv", """SELECT """ + _WORD_SQL + """ AS word,
  round(CAST(embedding[1] AS DOUBLE), 6) AS x, round(CAST(embedding[2] AS DOUBLE), 6) AS y FROM embeddings""")
def _projection(spark, sf):
    path = scratch_path(spark, "projection")
    v = named_vectors(spark, sf)
    coords = v.select("idx", F.slice("vector", 1, 2).alias("coords"))
    snk.write_projection_csv(v.select("word", "idx"), coords, path)
    lines = spark.read.text(path)
    parts = lines.select(F.split("value", ",", -1).alias("p"))
    return parts.select(
        unescape_word(F.rtrim(F.element_at("p", -1))).alias("word"),
        _r6(F.col("p")[0].cast("double")).alias("x"), _r6(F.col("p")[1].cast("double")).alias("y"))


@check("libsvm", """SELECT label, features, count(*) AS n FROM (SELECT CAST(label AS DOUBLE) AS label,
  array_to_string(list_transform(embedding, lambda x: CAST(CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT) AS VARCHAR)), ' ')
  AS features FROM embeddings) GROUP BY ALL""")
def _libsvm(spark, sf):
    from pyspark.ml.functions import vector_to_array

    path = scratch_path(spark, "libsvm")
    e = load_table(spark, sf, "embeddings").select(
        F.col("embedding").cast("array<double>").alias("features"), "label")
    snk.write_libsvm(e, path)
    dims = len(e.first()["features"])
    back = spark.read.format("libsvm").option("numFeatures", dims).load(path)
    text = F.array_join(F.transform(vector_to_array("features"), lambda x: F.round(x * 1000000).cast("long").cast("string")), " ")
    return back.groupBy("label", text.alias("features")).agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------------
# Training and iterative jobs: no SQL oracle (rows-only check by the driver,
# invariants in tests/).

from bugroute.operators import param_avg as pavg  # noqa: E402
from bugroute.streaming.curve import curve_stream  # noqa: E402
from bugroute.operators import train as tr  # noqa: E402
from bugroute.plans import routing  # noqa: E402


@check("route_text_softmax", None)
def _route_text(spark, sf):
    return routing.route_and_score(spark, sf, "rnn")


@check("route_text_cnn_groups", None)
def _route_cnn(spark, sf):
    return routing.route_and_score(spark, sf, "cnn", max_iter=30)


@check("route_light_softmax", None)
def _route_light(spark, sf):
    return routing.route_light(spark, sf)


def _text_plan(spark, sf, architecture="rnn"):
    wv, dims = routing.derived_word_vectors(spark, sf)
    return routing.text_features(bugs_table(spark, sf), wv, dims, architecture)


@check("route_text_mlp", None)
def _route_mlp(spark, sf):
    plan = _text_plan(spark, sf)
    train, test = order.train_test(plan.features, "row_id", 9, 10)
    model = tr.train_mlp(train, plan.width, len(plan.classes), hidden=(100, 100, 100), max_iter=50)
    return ev.metrics(tr.score(model, test))


def _param_avg(spark, sf, epochs, on_epoch=None):
    plan = _text_plan(spark, sf)
    train, test = order.train_test(plan.features, "row_id", 9, 10)
    spec = pavg.NetSpec(n_in=plan.width, n_out=len(plan.classes), lr=0.5, l2=1e-5)
    return pavg.train_param_avg(train, spec, epochs=epochs, batch=25, avg_every=5,
                                save_path=scratch_path(spark, "model"),
                                on_epoch=on_epoch and on_epoch(train, test))


@check("param_avg_softmax_curve", None)
def _pavg_softmax(spark, sf):
    rows = []

    def curve(train, test):
        def on_epoch(epoch, trained):
            for split, part in (("train", train), ("test", test)):
                rows.append((epoch, split, ev.metrics(pavg.predict(trained, part)).first()))
        return on_epoch

    _param_avg(spark, sf, 3, curve)
    return tr.learning_curve(spark, rows)


@check("curve_counts", B + """, kept AS (SELECT row_id, class FROM bugs WHERE length(coalesce(text, '')) > 0),
cls AS (SELECT class, row_number() OVER (ORDER BY class) - 1 AS label FROM (SELECT DISTINCT class FROM bugs)),
s AS (SELECT label, CASE WHEN row_number() OVER (ORDER BY row_id) <= (9 * count(*) OVER ()) // 10 THEN 'train' ELSE 'test' END AS split
      FROM kept JOIN cls USING (class)),
m AS (SELECT split, 'n' AS metric, count(*) AS value FROM s GROUP BY split
      UNION ALL SELECT split, 'n[' || CAST(label AS VARCHAR) || ']', count(*) FROM s GROUP BY split, label)
SELECT CAST(unnest([1, 2]) AS INT) AS epoch, split, metric, CAST(value AS DOUBLE) AS value FROM m""")
def _curve_counts(spark, sf):
    """The learning curve's counts, from a stream over the epochs' checkpoints that
    is started again after the second one."""
    plan = _text_plan(spark, sf)
    train, test = order.train_test(plan.features, "row_id", 9, 10)
    spec = pavg.NetSpec(n_in=plan.width, n_out=len(plan.classes), lr=0.5)
    models, sink, progress = (scratch_path(spark, n) for n in ("curve-models", "curve", "curve-progress"))
    trained = pavg.train_param_avg(train, spec, epochs=1, save_path=models)
    for more in (False, True, False):
        if more:
            pavg.train_param_avg(train, spec, epochs=1, start=trained, start_epoch=2, save_path=models)
        query = curve_stream(spark, models, sink, progress, {"train": train, "test": test})
        query.awaitTermination()
    curve = spark.read.parquet(sink)
    return curve.where("metric like 'n%'").select(F.col("epoch").cast("int").alias("epoch"), "split", "metric", "value")


@check("param_avg_rows", B + """SELECT e.epoch, (9 * n) // 10 AS rows_trained
FROM (SELECT count(*) AS n FROM bugs WHERE length(coalesce(text, '')) > 0),
     (SELECT CAST(unnest([1, 2]) AS BIGINT) AS epoch) e""")
def _pavg_rows(spark, sf):
    return pavg.rows_trained(spark, _param_avg(spark, sf, 2))


@check("param_checkpoint", B + """SELECT 'same' AS params, 'same' AS spec, CAST(1 AS INT) AS epoch,
  CAST((64 + 7 + (SELECT count(DISTINCT component_id) FROM bugs) + (SELECT count(DISTINCT product_id) FROM bugs) + 1)
       * (SELECT count(DISTINCT class) FROM bugs) AS BIGINT) AS n_params""")
def _pavg_checkpoint(spark, sf):
    plan = _text_plan(spark, sf)
    spec = pavg.NetSpec(n_in=plan.width, n_out=len(plan.classes), lr=0.5)
    path = scratch_path(spark, "checkpointed")
    trained = pavg.train_param_avg(plan.features, spec, epochs=1, save_path=path)
    loaded, epoch = pavg.load_model(spark, path)
    same = ["same" if x else "differs" for x in ((loaded.params == trained.params).all(), loaded.spec == trained.spec)]
    return spark.createDataFrame([(*same, epoch, len(loaded.params))], "params string, spec string, epoch int, n_params long")


@check("paragraph_tokens", "WITH " + VOCAB_CTE + """,
t AS (SELECT doc_id, unnest(t) AS word, generate_subscripts(t, 1) AS pos FROM (SELECT doc_id, """ + q.tokens_expr("text") + """ AS t FROM documents)),
i AS (SELECT doc_id, count(*) AS n_tokens, string_agg(CAST(idx AS VARCHAR), ',' ORDER BY pos) AS ids FROM t JOIN vocab USING (word) GROUP BY doc_id)
SELECT doc_id, coalesce(n_tokens, 0) AS n_tokens, sha256(coalesce(ids, '')) AS ids_sha256 FROM documents LEFT JOIN i USING (doc_id)""")
def _paragraph_tokens(spark, sf):
    """The tokens that VEC5 trains on, of rows dealt out without regard to their keys."""
    from bugroute.operators.embedding import token_ids

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # dealt as texts, which are half the size of their tokens
    docs = txt.tokens(load_table(spark, sf, "documents").select("doc_id", "text").repartition(parts), "text")
    ids = token_ids(docs, "doc_id", "tokens", vec.build_vocab(docs.select("tokens")))
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"))


@check("word2vec_vectors", "WITH " + VOCAB_CTE + " SELECT word, CAST(100 AS INT) AS dims FROM vocab")
def _word2vec(spark, sf):
    wv, _ = routing.trained_word_vectors(spark, sf, epochs=20)
    finite = F.forall("vector", lambda x: ~F.isnan(x))
    return wv.select("word", F.when(finite, F.size("vector")).alias("dims"))


@check("paragraph_vectors", "SELECT doc_id, CAST(100 AS INT) AS dims, CAST(100 AS INT) AS inferred_dims FROM documents")
def _paragraph(spark, sf):
    from bugroute.operators import paragraph as pv

    docs = txt.tokens(load_table(spark, sf, "documents").select("doc_id", "text"), "text")
    vectors, model = pv.train_paragraph_vectors(docs, "doc_id", "tokens", dims=100, epochs=20)
    inferred = pv.infer_vectors(model, docs, "doc_id", "tokens").withColumnRenamed("vector", "inferred")
    finite = lambda c: F.when(F.forall(c, lambda x: ~F.isnan(x)), F.size(c))
    return vectors.join(inferred, "doc_id").select(
        "doc_id", finite("vector").alias("dims"), finite("inferred").alias("inferred_dims"))


@check("router_facts", B + """, kept AS (SELECT row_id, class FROM bugs WHERE length(coalesce(text, '')) > 0)
SELECT (9 * count(*)) // 10 AS n_train, count(*) - (9 * count(*)) // 10 AS n_test,
  (SELECT string_agg(DISTINCT CAST(class AS VARCHAR), ',' ORDER BY CAST(class AS VARCHAR)) FROM bugs) AS classes,
  CAST(0 AS BIGINT) AS n_bad_probabilities, true AS beats_majority, true AS objective_falls FROM kept""")
def _router_facts(spark, sf):
    """ML1, ML4, EV10 as facts: split sizes, classes, probabilities that sum to
    one, accuracy above the largest class's share, falling objective."""
    plan = _text_plan(spark, sf)
    train, test = order.train_test(plan.features, "row_id", 9, 10)
    model = tr.train_softmax(train, max_iter=50)
    scored = tr.score(model, test).checkpoint()
    total = F.aggregate("probability", F.lit(0.0), lambda a, x: a + x)
    facts = scored.agg(F.count(F.lit(1)).alias("n_test"), F.count_if(F.abs(total - 1) > 1e-9).alias("n_bad_probabilities"),
                       F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"))
    most = scored.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"))
    history = tr.objective_history(model)
    return facts.join(F.broadcast(most), F.lit(True)).select(
        F.lit(train.count()).cast("long").alias("n_train"), "n_test",
        F.lit(",".join(sorted(map(str, plan.classes)))).alias("classes"), "n_bad_probabilities",
        (F.col("accuracy") > F.col("most") / F.col("n_test")).alias("beats_majority"),
        F.lit(history[-1] < history[0]).alias("objective_falls"))


@check("route_text_paragraph", None)
def _route_pv(spark, sf):
    return routing.route_with_paragraph_vectors(spark, sf)
