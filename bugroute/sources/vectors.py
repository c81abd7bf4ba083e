"""Word-vector and model file formats as Spark tables (SRC3-SRC12).

Text formats are read with ``spark.read.text`` (gzip by extension, split
across tasks) and parsed with JVM built-ins.  Line roles in the JSON formats
are told apart by content, not by line number, so no global line index (and
no single-task pass) is needed.  Binary word2vec files are read by byte ranges and
foreign zip bundles by their members (``bugroute.sources.ranges``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bugroute.functions.arrays import clear_nan_values
from bugroute.functions.text import trim_trailing_empty, unescape_word
from bugroute.session import exists, ship_package
from bugroute.sources import ranges

VOCAB_SCHEMA = T.StructType([
    T.StructField("word", T.StringType()),
    T.StructField("count", T.DoubleType()),
    T.StructField("idx", T.LongType()),
    T.StructField("codes", T.ArrayType(T.IntegerType())),
    T.StructField("points", T.ArrayType(T.IntegerType())),
    T.StructField("is_label", T.BooleanType()),
])

HUFFMAN_SCHEMA = T.StructType([
    T.StructField("idx", T.IntegerType()),
    T.StructField("code", T.ArrayType(T.IntegerType())),
    T.StructField("point", T.ArrayType(T.IntegerType())),
    T.StructField("length", T.IntegerType()),
])

FULL_WORD_SCHEMA = T.StructType([
    T.StructField("word", T.StringType()),
    T.StructField("count", T.DoubleType()),
    T.StructField("huffmanNode", HUFFMAN_SCHEMA),
    T.StructField("syn0", T.ArrayType(T.DoubleType())),
    T.StructField("syn1", T.ArrayType(T.DoubleType())),
    T.StructField("syn1Neg", T.ArrayType(T.DoubleType())),
    T.StructField("historicalGradient", T.ArrayType(T.DoubleType())),
])

ELEMENT_SCHEMA = "object string, vector array<double>"


def _tokens(line) -> "F.Column":
    """Space split with the JVM trailing-empty rule (writers end lines with a space)."""
    return trim_trailing_empty(F.split(line, " ", -1))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their file and an id that rises within a file."""
    return spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id"))


def first_lines(lines: DataFrame) -> DataFrame:
    """(__file, __first, __id): the first line of each file, one row a file."""
    return lines.where("__block = 0").groupBy("__file").agg(
        F.min_by("value", "__id").alias("__first"), F.min("__id").alias("__id"))


def is_header(line) -> "F.Column":
    """Auto header rule: no space, or a non-number after the first token, or
    fewer than 4 tokens."""
    tokens = _tokens(line)
    words = F.exists(F.slice(tokens, 2, F.lit(1 << 30)), lambda x: x.try_cast("double").isNull())
    return ~line.contains(" ") | words | (F.size(tokens) < 4)


def _parse_vector_lines(lines: DataFrame, first: int, *keep: str) -> DataFrame:
    """(word, vector array<float>) from tokenised lines; tokens from ``first``."""
    t = lines.select(_tokens(F.col("value")).alias("__t"), *keep)
    vector = F.transform(F.slice("__t", first + 2, F.lit(1 << 30)), lambda x: x.cast("float"))
    return t.select(unescape_word(F.col("__t")[first]).alias("word"),
                    clear_nan_values(vector).alias("vector"), *keep)


def read_word_vectors(spark: SparkSession, path: str, header="auto",
                      strict_dims: bool = False) -> DataFrame:
    """Vectors as text: ``word v1 ... vn`` (SRC3, SRC4, SRC5), of one file or many.

    header='auto' applies the auto rule to each file's first line; True/False
    force it for each file.  Exactly that line is left out: later lines equal to
    it are data.  ``strict_dims`` requires a ``words dims`` header in every file
    and rows of exactly dims values (other rows raise).
    """
    lines = _lines(spark, path)
    firsts = first_lines(lines)
    if strict_dims:
        if firsts.isEmpty():
            raise ValueError("empty vector file")
        dims = F.split("__first", " ")[1].cast("int")
        body = (lines.join(firsts.select("__id"), "__id", "left_anti")
                .join(firsts.select("__file", dims.alias("__dims")), "__file"))
    elif header is False:
        body = lines
    else:
        heads = firsts if header is True else firsts.where(is_header(F.col("__first")))
        body = lines.join(heads.select("__id"), "__id", "left_anti")
    if not strict_dims:
        return _parse_vector_lines(body, 0)
    parsed = _parse_vector_lines(body, 0, "__dims")
    checked = F.when(F.size("vector") == F.col("__dims"), F.col("vector")).otherwise(F.raise_error(
        F.concat(F.lit("vector length differs from the header's: "), F.col("word"))))
    return parsed.select("word", checked.alias("vector"))


def read_tagged_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``L|E word v1 ... vn`` -> (is_label, word, vector) (SRC7); other tags raise."""
    lines = spark.read.text(path)
    t = lines.select("value", _tokens(F.col("value")).alias("__t"))
    tag = F.col("__t")[0]
    checked = F.when(tag.isin("L", "E"), tag == "L").otherwise(
        F.raise_error(F.concat(F.lit("line without the tag L or E: "), F.col("value"))))
    vector = F.transform(F.slice("__t", 3, F.lit(1 << 30)), lambda x: x.cast("float"))
    return t.select(checked.alias("is_label"), unescape_word(F.col("__t")[1]).alias("word"),
                    clear_nan_values(vector).alias("vector"))


def _checked(json, bad, what: str) -> "F.Column":
    return F.when(bad, F.raise_error(F.concat(F.lit(what + ": "), F.substring(json, 1, 200)))).otherwise(json)


def read_full_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Full-model JSON lines (SRC10) -> (words, config).

    words: (word, count, idx, codes, points, syn0, syn1, syn1neg, gradient); idx
    comes from the Huffman node.  config: the JSON object without a word.  The
    exp and negative tables are lines of numbers (or empty).  Any other line, a
    broken object or a word without ``syn0`` raises.
    """
    value = F.col("value")
    lines = spark.read.text(path).select(
        value, F.try_parse_json(value).isNotNull().alias("valid"), F.from_json(value, FULL_WORD_SCHEMA).alias("j"))
    table = value.rlike(r"^[-+0-9.eE ,\[\]]*$")
    is_word = F.col("j.word").isNotNull()
    is_config = F.col("valid") & value.startswith("{") & F.col("j.word").isNull() & F.col("j.syn0").isNull()
    # the filters may run in any order, so the check itself leaves the tables alone
    bad = ~table & ((~is_word & ~is_config) | (is_word & (F.col("j.syn0").isNull() | ~F.col("valid"))))
    body = lines.where(~table).withColumn("value", _checked(value, bad, "not a word or a configuration"))
    words = body.where(is_word | F.col("value").isNull() | bad).select(
        F.col("j.word").alias("word"), F.col("j.count").alias("count"),
        F.col("j.huffmanNode.idx").alias("idx"), F.col("j.huffmanNode.code").alias("codes"),
        F.col("j.huffmanNode.point").alias("points"), F.col("j.syn0").alias("syn0"),
        F.col("j.syn1").alias("syn1"), F.col("j.syn1Neg").alias("syn1neg"),
        F.col("j.historicalGradient").alias("gradient"))
    config = body.where(is_config).select(F.col("value").alias("config"))
    return words, config


def read_sequence_vectors(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Base64 JSON lines (SRC11) -> (elements (object, vector), config).

    An object with the key ``object`` is an element and needs a vector; an object
    without it is the configuration; any other line raises.
    """
    lines = spark.read.text(path).where(F.length("value") > 0)
    decoded = lines.select("value", F.coalesce(F.try_to_binary("value", F.lit("base64")).cast("string"), F.lit("")).alias("json"))
    json = F.col("json")
    parsed = decoded.select("value", json, F.try_parse_json(json).isNotNull().alias("valid"),
                            F.from_json(json, ELEMENT_SCHEMA).alias("j"))
    is_element = F.col("j.object").isNotNull()
    bad = ~F.col("valid") | ~json.startswith("{") | (is_element != F.col("j.vector").isNotNull())
    parsed = parsed.withColumn("json", _checked(json, (F.length("value") > 0) & F.coalesce(bad, F.lit(True)), "not an element or a configuration"))
    elements = parsed.where(F.col("json").isNotNull() & is_element).select("j.object", "j.vector")
    config = parsed.where(F.col("json").isNotNull() & ~is_element).select(F.col("json").alias("config"))
    return elements, config


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """Vocabulary cache, one JSON object per line (SRC12)."""
    return spark.read.schema(VOCAB_SCHEMA).json(path)


def read_embedding_bundle(spark: SparkSession, path: str) -> DataFrame:
    """Our bundle directory (SRC8, SRC9) -> (word, idx, vector, syn1, codes,
    points, is_label).

    Parts: ``syn0`` (word, idx, vector), ``syn1`` (idx, syn1), ``codes``
    (word, codes, points), optional ``labels`` (label).  Codes/points for a
    word that has no vector are dropped by the left join; labels are trimmed
    and unknown ones ignored.
    """
    base = path.rstrip("/")
    out = (spark.read.parquet(f"{base}/syn0")
           .join(spark.read.parquet(f"{base}/syn1"), "idx", "left")
           .join(spark.read.parquet(f"{base}/codes"), "word", "left"))
    if not exists(spark, f"{base}/labels"):   # the labels part is optional
        return out.withColumn("is_label", F.lit(False))
    flags = spark.read.parquet(f"{base}/labels").select(F.trim("label").alias("word")).distinct().withColumn("__lab", F.lit(True))
    return (out.join(flags, "word", "left")
            .withColumn("is_label", F.coalesce("__lab", F.lit(False))).drop("__lab"))


def read_bundle_config(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(f"{path.rstrip('/')}/config.json").select(F.col("value").alias("config"))


# ---------------------------------------------------------------- binary/zip

def _stream(path: str, content: bytes):
    import gzip
    import io

    raw = io.BytesIO(content)
    return gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw


def _word2vec_batches(f, linebreaks: bool, normalize: bool, batch_rows: int = 4096):
    import numpy as np
    import pandas as pd

    n_words, dims = (int(x) for x in f.readline().split()[:2])
    words, vecs = [], []
    for _ in range(n_words):
        w = bytearray()
        while (ch := f.read(1)) not in (b" ", b"") and not (ch == b"\n" and w):
            if ch != b"\n":
                w += ch
        raw = f.read(4 * dims)
        if len(raw) < 4 * dims:
            raise ValueError(f"the file ends inside the vector of {bytes(w)!r}")
        v = np.frombuffer(raw, dtype="<f4").astype(np.float32)
        if normalize:
            norm = float(np.sqrt(np.dot(v.astype(np.float64), v.astype(np.float64))))
            if norm > 0:
                v = (v / norm).astype(np.float32)
        if linebreaks:
            f.read(1)
        words.append(w.decode("utf-8", errors="replace"))
        vecs.append(v)
        if len(words) >= batch_rows:
            yield pd.DataFrame({"word": words, "vector": vecs})
            words, vecs = [], []
    if words:
        yield pd.DataFrame({"word": words, "vector": vecs})


def read_word2vec_binary(spark: SparkSession, path: str, linebreaks: bool = False,
                         normalize: bool = True, partition_bytes: int = ranges.PARTITION_BYTES) -> DataFrame:
    """word2vec binary (SRC6), a file or a folder of files: ASCII ``count dims``
    then per word a space-terminated string and dims little-endian float32.

    Files are cut into ranges of about ``partition_bytes`` (see
    ``bugroute.sources.ranges``); a file of one range or many gives the same rows,
    all records that it holds.  Gzipped files can't be cut: each is one task, which
    gives bounded batches.
    """
    ship_package(spark)
    spark.dataSource.register(ranges.Word2VecBinary)
    plain = spark.read.format(ranges.Word2VecBinary.name()).options(
        path=path, linebreaks=linebreaks, normalize=normalize, partitionBytes=partition_bytes).load()

    def parse(frames):
        for pdf in frames:
            for p, content in zip(pdf["path"], pdf["content"]):
                yield from _word2vec_batches(_stream(p, content), linebreaks, normalize)

    if not ranges.data_files(path, ".gz"):
        return plain
    packed = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return plain.unionByName(packed.repartition(F.col("path")).mapInPandas(parse, "word string, vector array<float>"))


def read_bundle_zip(spark: SparkSession, path: str) -> DataFrame:
    """Foreign zip bundles (SRC8), a file or a folder of them: (file, part,
    line_no, line) of every text part.  A member is a task, which inflates it as a
    stream."""
    ship_package(spark)
    spark.dataSource.register(ranges.ZipLines)
    return spark.read.format(ranges.ZipLines.name()).option("path", path).load()


def bundle_tables(lines: DataFrame) -> DataFrame:
    """The text parts of one bundle (``read_bundle_zip``) as (word, idx, vector,
    syn1, codes, points, is_label) (SRC8, SRC9).

    Row i of ``syn0.txt`` is word i (a header line does not count), row i of
    ``syn1.txt`` its output weights; ``codes.txt`` and ``huffman.txt`` are joined
    by word, unknown words left out; ``labels.txt`` may be absent.
    """
    def part(name, numbers, out):
        t = lines.where(F.col("part") == name).select("line_no", "line", _tokens(F.col("line")).alias("__t"))
        rest = F.transform(F.slice("__t", 2, F.lit(1 << 30)), lambda x: x.cast(numbers))
        return t.select("line_no", "line", unescape_word(F.col("__t")[0]).alias("word"), rest.alias(out))

    syn0 = part("syn0.txt", "float", "vector")
    head = syn0.where((F.col("line_no") == 0) & is_header(F.col("line"))).select(F.lit(1).alias("__h"))
    shift = head.agg(F.count(F.lit(1)).alias("__shift"))  # one row: 1 with a header line, else 0
    syn0 = syn0.join(F.broadcast(shift), F.col("line_no") >= F.col("__shift")).select(
        "word", (F.col("line_no") - F.col("__shift")).alias("idx"), clear_nan_values(F.col("vector")).alias("vector"))
    syn1 = lines.where("part = 'syn1.txt'").select(F.col("line_no").alias("idx"), F.transform(
        _tokens(F.col("line")), lambda x: x.cast("double")).alias("syn1"))
    codes = part("codes.txt", "int", "codes").select("word", "codes")
    points = part("huffman.txt", "int", "points").select("word", "points")
    flags = lines.where("part = 'labels.txt'").select(
        unescape_word(F.trim("line")).alias("word"), F.lit(True).alias("__label")).distinct()
    return (syn0.join(syn1, "idx", "left").join(codes, "word", "left").join(points, "word", "left")
            .join(flags, "word", "left")
            .select("word", "idx", "vector", "syn1", "codes", "points", F.coalesce("__label", F.lit(False)).alias("is_label")))


def read_zip_bundle(spark: SparkSession, path: str) -> DataFrame:
    """A zip bundle as one table (see ``bundle_tables``).  The lines are written
    once to the shared folder, since each part is read from them."""
    from bugroute.session import scratch_path

    scratch = scratch_path(spark, "zip-lines")
    read_bundle_zip(spark, path).write.partitionBy("part").parquet(scratch)
    return bundle_tables(spark.read.parquet(scratch))
