"""Vector and embedding operators (VEC1-VEC3, VEC6-VEC8, PRJ5).

Vectors are ``array<float>`` / ``array<double>`` columns.  Per-document
vectors are computed with joins and a grouped mean, not by shipping a model
to every task: the word table is joined on ``word`` (broadcast only when its
measured size is under a bound, otherwise its rows are brought to the texts that
name them, see ``lookup``), and the mean runs as sums of the components in a hash aggregate,
with a buffer of one vector per group.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bugroute.functions.arrays import clear_nan_values, posexplode_rows, unit_vector
from bugroute.operators.lookup import SLOT, deal, slots_for, with_rows
from bugroute.operators.text import WORDS_PER_GROUP, exploded_group_tokens

# Broadcast the word-vector table only below this many (rows x dims) cells.
BROADCAST_CELL_LIMIT = 25_000_000
TEXT_BYTES = 8 << 20     # text of a task that cuts it into tokens and counts them in memory


def unit_vectors(df: DataFrame, column: str = "vector", out: str | None = None) -> DataFrame:
    """Unit-normalise (VEC1); zero vectors stay zero."""
    return df.withColumn(out or column, unit_vector(F.col(column)))


def clear_nans(df: DataFrame, column: str = "vector", out: str | None = None) -> DataFrame:
    """NaN -> 0 (VEC2)."""
    return df.withColumn(out or column, clear_nan_values(F.col(column)))


def build_vocab(df: DataFrame, tokens: str = "tokens", min_count: int = 1) -> DataFrame:
    """(word, count, idx): idx by count descending then word (VEC3).

    Word counting is a partial + final aggregate; the index is a distributed
    rank over the distinct vocabulary (range sort, no single-task window).
    The result is checkpointed once, so later joins reuse it.
    """
    from bugroute.operators.ordering import rank_by

    exploded = posexplode_rows(df.select(tokens), [], tokens, "__pos", "word")
    counts = (exploded.groupBy("word").agg(F.count(F.lit(1)).alias("count"))
              .where(F.col("count") >= min_count))
    return rank_by(counts, [F.col("count").desc(), F.col("word")], "idx").select("word", "count", "idx")


def vectors_from(vocab: DataFrame, matrix: DataFrame, matrix_idx: str = "idx",
                 matrix_vector: str = "vector") -> DataFrame:
    """(word, idx, vector): a vocabulary joined with a vector matrix (VEC7)."""
    m = matrix.select(F.col(matrix_idx).alias("idx"), F.col(matrix_vector).alias("vector"))
    if _sized_for_broadcast(m, "vector", BROADCAST_CELL_LIMIT):
        m = F.broadcast(m)  # measured rows x dims under the bound
    return vocab.join(m, "idx").select("word", "idx", "vector")


def labels(df: DataFrame, flag: str = "is_label", word: str = "word") -> DataFrame:
    """Words tagged as labels (VEC8)."""
    return df.where(F.col(flag)).select(F.col(word).alias("label"))


def _sized_for_broadcast(vectors: DataFrame, vector_col: str, limit: int) -> bool:
    """Measure the word table (rows x dims) before deciding to broadcast it."""
    stats = vectors.agg(F.count(F.lit(1)).alias("n"),
                        F.max(F.size(vector_col)).alias("d")).first()
    n, d = stats["n"] or 0, stats["d"] or 0
    return n * max(d, 1) <= limit


def group_vector_arrays(df: DataFrame, vectors: DataFrame, key: str, height: int, dims: int,
                        text: str = "text", per_group: int = WORDS_PER_GROUP,
                        broadcast_cell_limit: int = BROADCAST_CELL_LIMIT) -> DataFrame:
    """(key, vectors array<array<double>>): ``height`` group vectors per
    document, each the mean of the known word vectors of that group, zeros
    when none is known.  Documents without any known token are absent
    (callers left-join by ``joined_groups`` and fill zeros).

    Texts are dealt by key once, before they are cut into tokens.  Every later step then
    stays in its partition, so what is shuffled is the text and not a vector for each
    (key, group) and task.  A word table under a measured size bound is broadcast; of a
    larger one each slot of texts gets the rows of its distinct tokens, and the
    result has the column ``__slot``.  The number of partitions
    follows the measured length of the texts: a text becomes many times its size in
    tokens, so partitions that are merged to fit as text would spill.  Means are sums of
    the components by a hash aggregate (no sort of the joined rows).
    """
    v = F.col("vector")
    bad = (F.size(v) != dims) | F.exists(v, lambda x: x.isNull())
    checked = F.when(bad, F.raise_error(F.lit(f"a word vector has nulls or not {dims} components"))).otherwise(v)
    wv = vectors.where(v.isNotNull()).select(F.col("word").alias("token"), checked.alias("__v"))
    rows = df.select(key, text)
    length = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = slots_for(rows, length, TEXT_BYTES)
    small = _sized_for_broadcast(wv, "__v", broadcast_cell_limit)
    slot = [] if small else [SLOT]
    rows = rows.repartition(parts, F.col(key)) if small else deal(rows, [key], parts)
    toks = exploded_group_tokens(rows, [*slot, key], height, text, per_group)
    if height == 1:
        # Whole-document groups repeat tokens a lot: pre-aggregate them (a
        # codegen'd hash aggregate) so the join and the weighted mean see each
        # distinct (key, token) once.  Groups of a few words barely repeat, so
        # there the extra aggregate is not worth it.
        counts = toks.groupBy(*slot, key, "group", "token").agg(F.count(F.lit(1)).cast("double").alias("__n"))
    else:
        counts = toks.withColumn("__n", F.lit(1.0))
    hits = counts.join(F.broadcast(wv), "token") if small else with_rows(counts, [key], "token", wv, parts)
    sums = [F.sum(F.get("__v", F.lit(i)).cast("double") * F.col("__n")).alias(f"__s{i}") for i in range(dims)]
    mean = F.array(*(F.col(f"__s{i}") / F.col("__w") for i in range(dims)))
    own = [*slot, key]
    by = own if height == 1 else [*own, "group"]
    means = hits.groupBy(*by).agg(F.sum("__n").alias("__w"), *sums).select(*by, mean.alias("__m"))
    if height == 1:
        arrays = means.withColumn("vectors", F.array("__m"))
    else:
        zeros = F.array_repeat(F.lit(0.0), dims)
        per_key = means.groupBy(*own).agg(
            F.map_from_entries(F.collect_list(F.struct("group", "__m"))).alias("__map"))
        arrays = per_key.withColumn("vectors", F.transform(
            F.sequence(F.lit(0), F.lit(height - 1)), lambda i: F.coalesce(F.element_at("__map", i), zeros)))
    return arrays.select(*(F.col(c).alias(c, metadata={"slots": parts}) for c in slot), key, "vectors")


def joined_groups(base: DataFrame, arrays: DataFrame, key: str) -> DataFrame:
    """``base`` left-joined with the ``group_vector_arrays`` of its keys; where these lie
    in slots, ``base`` goes to them."""
    if SLOT not in arrays.columns:
        return base.join(arrays, key, "left")
    return deal(base, [key], arrays.schema[SLOT].metadata["slots"]).join(arrays, [SLOT, key], "left").drop(SLOT)


def _zero_groups(height: int, dims: int):
    return F.array_repeat(F.array_repeat(F.lit(0.0), dims), height)


def doc_vectors(df: DataFrame, vectors: DataFrame, key: str, height: int, dims: int,
                text: str = "text", per_group: int = WORDS_PER_GROUP,
                broadcast_cell_limit: int = BROADCAST_CELL_LIMIT) -> DataFrame:
    """One vector per (key, group): the mean of the known word vectors (VEC6).

    Groups whose words are all unknown (or empty texts) get the zero vector.
    Output: (key, group, vector array<double>).
    """
    from bugroute.functions.arrays import posexplode_rows

    arrays = group_vector_arrays(df, vectors, key, height, dims, text, per_group, broadcast_cell_limit)
    full = (joined_groups(df.select(key), arrays, key)
            .select(key, F.coalesce("vectors", _zero_groups(height, dims)).alias("vectors")))
    return posexplode_rows(full, key, "vectors", "group", "vector")


def assemble(df: DataFrame, key: str, group_arrays: DataFrame, one_hot_columns: Sequence[str],
             height: int, dims: int, label: str = "label", out: str = "features") -> DataFrame:
    """Feature row: for each group i < height, [vector_i ++ one-hots], then label (PRJ5).

    Width = height * (dims + sum of one-hot widths).  ``group_arrays`` is the
    (key, vectors) output of ``group_vector_arrays``; documents missing there
    get zero vectors.
    """
    tail = F.concat(*[F.col(c).cast("array<double>") for c in one_hot_columns]) \
        if one_hot_columns else F.array().cast("array<double>")
    base = df.select(key, tail.alias("__tail"), F.col(label).alias(label))
    joined = joined_groups(base, group_arrays, key).withColumn(
        "vectors", F.coalesce("vectors", _zero_groups(height, dims)))
    feats = F.flatten(F.transform("vectors", lambda v: F.concat(v, F.col("__tail"))))
    return joined.select(key, feats.alias(out), F.col(label))


def assemble_sparse(df: DataFrame, key: str, group_arrays: DataFrame | None, one_hot_columns: Sequence[str],
                    height: int, dims: int, label: str = "label", out: str = "features") -> DataFrame:
    """The rows of ``assemble`` as sparse ML vectors (PRJ5): for each group its vector,
    then the one-hot vectors (sparse ML vectors too), so a row costs its entries and
    not its width.  Without ``group_arrays`` a row is its one-hots alone.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import array_to_vector

    rows = df.select(key, *one_hot_columns, F.col(label).alias(label))
    groups = []
    if group_arrays is not None:
        rows = joined_groups(rows, group_arrays, key).withColumn("vectors", F.coalesce("vectors", _zero_groups(height, dims)))
        groups = [f"__group_{g}" for g in range(height)]
        rows = rows.select("*", *(array_to_vector(F.col("vectors")[g]).alias(c) for g, c in enumerate(groups)))
    columns = [c for g in groups for c in (g, *one_hot_columns)] if groups else list(one_hot_columns)
    return VectorAssembler(inputCols=columns, outputCol=out).transform(rows).select(key, out, label)
