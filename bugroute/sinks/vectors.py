"""Word-vector and model file writers (SNK1-SNK8, SNK11).

Every writer is a projection to one text column (or a parquet part) followed
by a distributed ``write``; nothing is gathered on the driver.  Numbers are
written with Spark's float/double to string cast (shortest round-trip form).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bugroute.functions.text import escape_word


def vector_line(word, vector, prefix=None) -> "F.Column":
    parts = [escape_word(word), F.array_join(F.col(vector).cast("array<string>"), " ")]
    if prefix is not None:
        parts.insert(0, prefix)
    return F.concat_ws(" ", *parts)


def write_word_vectors(df: DataFrame, path: str, word: str = "word", vector: str = "vector",
                       compression: str | None = None) -> None:
    """``word v1 ... vn`` per line, spaces in words escaped (SNK1).
    Rows with a null word are skipped."""
    out = df.where(F.col(word).isNotNull()).select(vector_line(F.col(word), vector).alias("value"))
    w = out.write.mode("overwrite")
    if compression:
        w = w.option("compression", compression)
    w.text(path)


def write_tagged_vectors(df: DataFrame, path: str, flag: str = "is_label", word: str = "word",
                         vector: str = "vector") -> None:
    """``L|E word v1 ... vn`` (SNK2)."""
    tag = F.when(F.col(flag), F.lit("L")).otherwise(F.lit("E"))
    (df.where(F.col(word).isNotNull())
     .select(vector_line(F.col(word), vector, tag).alias("value"))
     .write.mode("overwrite").text(path))


def write_embedding_bundle(path: str, vectors: DataFrame, syn1: DataFrame | None = None,
                           codes: DataFrame | None = None, labels: DataFrame | None = None,
                           config_json: str = "{}") -> None:
    """Bundle directory (SNK3 with labels, SNK4 without): parquet parts
    ``syn0`` (word, idx, vector), ``syn1`` (idx, syn1), ``codes`` (word,
    codes, points), ``labels`` (label), and ``config.json``."""
    base = path.rstrip("/")
    spark = vectors.sparkSession
    vectors.select("word", "idx", "vector").write.mode("overwrite").parquet(f"{base}/syn0")
    if syn1 is None:
        syn1 = spark.createDataFrame([], "idx int, syn1 array<double>")
    syn1.select("idx", "syn1").write.mode("overwrite").parquet(f"{base}/syn1")
    if codes is None:
        codes = spark.createDataFrame([], "word string, codes array<int>, points array<int>")
    codes.select("word", "codes", "points").write.mode("overwrite").parquet(f"{base}/codes")
    if labels is not None:
        labels.select(F.col(labels.columns[0]).alias("label")).write.mode("overwrite").parquet(
            f"{base}/labels")
    spark.createDataFrame([(config_json,)], "value string").write.mode("overwrite").text(
        f"{base}/config.json")


def write_full_model(words: DataFrame, path: str, config_json: str = "{}",
                     exp_table: str = "", neg_table: str = "") -> None:
    """Full-model JSON lines (SNK5): config, exp table, negative table, then
    one JSON object per word with its Huffman node and weights.  Readers
    classify lines by content, so part-file order does not matter."""
    node = F.struct(F.col("idx").alias("idx"), F.col("codes").alias("code"),
                    F.col("points").alias("point"), F.size("codes").alias("length"))
    fields = [F.col("word"), F.col("count").cast("double").alias("count"), node.alias("huffmanNode"),
              F.col("syn0").cast("array<double>").alias("syn0"),
              F.col("syn1").cast("array<double>").alias("syn1")]
    if "syn1neg" in words.columns:
        fields.append(F.col("syn1neg").cast("array<double>").alias("syn1Neg"))
    if "gradient" in words.columns:
        fields.append(F.col("gradient").cast("array<double>").alias("historicalGradient"))
    body = words.select(F.to_json(F.struct(*fields)).alias("value"))
    spark = words.sparkSession
    head = spark.createDataFrame([(config_json,), (exp_table,), (neg_table,)], "value string")
    head.unionByName(body).write.mode("overwrite").text(path)


def write_sequence_vectors(elements: DataFrame, path: str, config_json: str = "{}") -> None:
    """Base64 JSON lines (SNK6): config line first (always newline-ended),
    then ``{object, vector}`` per element."""
    spark = elements.sparkSession
    import base64

    head = spark.createDataFrame([(base64.b64encode(config_json.encode()).decode(),)], "value string")
    encoded = F.base64(F.to_json(F.struct(
        F.col("object").cast("string").alias("object"),
        F.col("vector").cast("array<double>").alias("vector"))))
    # Spark may chunk base64 output with line breaks; one record per line.
    body = elements.select(F.regexp_replace(encoded, "[\r\n]", "").alias("value"))
    head.unionByName(body).write.mode("overwrite").text(path)


def write_vocab(vocab: DataFrame, path: str) -> None:
    """Vocabulary cache JSON lines in index order (SNK7); the sort is a
    distributed range sort, part files follow the order."""
    vocab.orderBy("idx").write.mode("overwrite").json(path)


def write_projection_csv(vocab: DataFrame, coords: DataFrame, path: str,
                         coords_col: str = "coords") -> None:
    """t-SNE style CSV (SNK8): ``x,y,...,word `` (escaped word, trailing
    space), coordinates picked by the word index."""
    j = vocab.where(F.col("word").isNotNull()).join(coords, "idx")
    line = F.concat(F.array_join(F.col(coords_col).cast("array<double>").cast("array<string>"), ","),
                    F.lit(","), escape_word(F.col("word")), F.lit(" "))
    j.select(line.alias("value")).write.mode("overwrite").text(path)


def write_libsvm(df: DataFrame, path: str, features: str = "features", label: str = "label") -> None:
    """SVM-light sink (SNK11) via Spark's libsvm data source."""
    from pyspark.ml.functions import array_to_vector

    (df.select(F.col(label).cast("double").alias("label"),
               array_to_vector(F.col(features)).alias("features"))
     .write.mode("overwrite").format("libsvm").save(path))


def save_embeddings(df: DataFrame, base: str, epoch: int) -> None:
    """Embedding checkpoint after a training epoch (SNK10): every epoch is
    kept, as ``{base}/epoch=NN`` (zero-padded below 10)."""
    df.write.mode("overwrite").parquet(f"{base.rstrip('/')}/epoch={epoch:02d}")
