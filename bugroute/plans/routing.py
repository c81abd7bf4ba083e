"""Bug routing plans: text job and no-text job, end to end.

Text job:  bug table -> keep columns -> category fits (distinct lists only)
-> one-hots + dense class index -> drop empty text -> word groups ->
mean word vectors per group -> feature rows -> positional 9/10 split ->
softmax -> scores on the test split.

The feature table is checkpointed to the shared checkpoint folder before
training: it cuts the text/join lineage, so iterative training and any task
retry read a written table instead of re-running the text work.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bugroute.operators import categories as cat
from bugroute.operators import columns as colops
from bugroute.operators import evaluate as ev
from bugroute.operators import ordering as order
from bugroute.operators import train as tr
from bugroute.operators import vectors as vec
from bugroute.operators.embedding import train_word_vectors
from bugroute.operators.text import HEIGHT_BY_ARCHITECTURE
from bugroute.schema import LIGHT_JOB_COLUMNS, SEVERITY_STATES, TEXT_JOB_COLUMNS
from bugroute.session import ensure_checkpoint_dir
from bugroute.sources.tables import bugs_table, load_table


@dataclass
class FeaturePlan:
    features: DataFrame          # (row_id, features array<double>, label int)
    components: list
    products: list
    classes: list
    dims: int
    height: int

    @property
    def width(self) -> int:
        return self.height * (self.dims + len(self.components) + len(self.products)
                              + len(SEVERITY_STATES))


def encode_columns(bugs: DataFrame, columns=TEXT_JOB_COLUMNS, key: str = "row_id",
                   fitted: tuple | None = None, sparse: bool = False):
    """Projection, category fits and one-hots shared by both jobs.

    ``fitted`` = (components, products, classes) reuses earlier fits (new
    data, streams); otherwise they are fitted here (distinct lists only).
    With ``sparse`` one-hots are sparse vectors and the lists of components and
    products stay tables (their places are returned as ranges).
    """
    kept = colops.keep_columns(bugs, [key, *columns])
    if sparse:
        states = F.array(*map(F.lit, SEVERITY_STATES))
        place = F.array_position(states, F.col("bug_severity"))
        placed, widths = cat.category_places(kept, ["component_id", "product_id"])
        placed = placed.withColumn("bug_severity", F.when(place > 0, (place - 1).cast("int")))
        indexed, classes = cat.index_classes(placed, "class", "dense", "label")
        hot = cat.one_hot_vectors(indexed, {"bug_severity": len(SEVERITY_STATES), **widths})
        return hot, range(widths["component_id"]), range(widths["product_id"]), classes
    if fitted is None:
        # one pass over the table for all three lists
        lists = cat.fit_categories_many(kept, ["component_id", "product_id", "class"])
        comps, prods, fitted_classes = lists["component_id"], lists["product_id"], lists["class"]
    else:
        comps, prods, _ = fitted
    encoded = cat.one_hot(kept, "bug_severity", SEVERITY_STATES)
    encoded = cat.one_hot(encoded, "component_id", comps)
    encoded = cat.one_hot(encoded, "product_id", prods)
    if fitted is None:
        encoded, classes = cat.index_classes(encoded, "class", "dense", "label", classes=fitted_classes)
    else:
        classes = fitted[2]
        encoded = cat.join_index(encoded, F.col("class").try_cast("int"), classes, "label")
    return encoded, comps, prods, classes


def text_features(bugs: DataFrame, word_vectors: DataFrame | None, dims: int,
                  architecture: str = "rnn", key: str = "row_id",
                  checkpoint: bool = True, fitted: tuple | None = None,
                  paragraph=None, sparse: bool = False) -> FeaturePlan:
    """Feature rows of the text job (with ``sparse`` as sparse vectors, for any
    number of components and products).  Group vectors are the mean of known word
    vectors, or, with a trained ``paragraph`` model, inferred paragraph
    vectors (one per word group, as the reference infers them)."""
    height = HEIGHT_BY_ARCHITECTURE[architecture]
    encoded, comps, prods, classes = encode_columns(bugs, TEXT_JOB_COLUMNS, key, fitted, sparse)
    rows = colops.drop_empty_text(encoded)
    if paragraph is not None:
        from bugroute.operators.paragraph import paragraph_group_vectors

        dims = paragraph.dims
        gv = paragraph_group_vectors(paragraph, rows.select(key, "text"), key, height)
        # one row per (key, group), exactly height per key: gather in order
        gv = gv.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("group", "vector"))).alias("__p"))
        gv = gv.select(key, F.transform("__p", lambda x: x["vector"]).alias("vectors"))
    else:
        gv = vec.group_vector_arrays(rows.select(key, "text"), word_vectors, key, height, dims)
    put_together = vec.assemble_sparse if sparse else vec.assemble
    feats = put_together(rows, key, gv, ["bug_severity", "component_id", "product_id"], height, dims, label="label")
    if checkpoint:
        ensure_checkpoint_dir(feats.sparkSession)
        feats = feats.checkpoint(eager=True)
    return FeaturePlan(feats, comps, prods, classes, dims, height)


def light_features(bugs: DataFrame, key: str = "row_id", drop_class_from: int = 25, sparse: bool = False) -> FeaturePlan:
    """No-text job: drop class >= 25, one-hots only, class kept as its name."""
    kept = colops.drop_where(bugs, "class", ">=", drop_class_from)
    encoded, comps, prods, classes = encode_columns(kept, LIGHT_JOB_COLUMNS, key, sparse=sparse)
    if sparse:
        feats = vec.assemble_sparse(encoded, key, None, ["bug_severity", "component_id", "product_id"], 1, 0)
        return FeaturePlan(feats, comps, prods, classes, 0, 1)
    feats = encoded.select(key, F.concat("bug_severity", "component_id", "product_id").alias("features"),
                           "label")
    return FeaturePlan(feats, comps, prods, classes, 0, 1)


def derived_word_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Word vectors from the driver tables: document vocabulary by frequency
    joined to ``embeddings`` (idx = vec_id)."""
    from bugroute.operators import text as txt

    docs = load_table(spark, sf_dir, "documents")
    vocab = vec.build_vocab(txt.tokens(docs.select("text"), "text"), "tokens")
    emb = load_table(spark, sf_dir, "embeddings")
    dims = len(emb.select("embedding").first()[0])
    return vec.vectors_from(vocab, emb, matrix_idx="vec_id", matrix_vector="embedding"), dims


def trained_word_vectors(spark: SparkSession, sf_dir: str, dims: int = 100, epochs: int = 5) -> tuple[DataFrame, int]:
    """Word vectors trained on the sentences of all documents, one for every
    word that occurs (windows do not cross sentences)."""
    from bugroute.operators import text as txt

    docs = load_table(spark, sf_dir, "documents")
    sentences = txt.sentences(docs, "text", key="doc_id").withColumn("key", F.concat_ws("/", "doc_id", "pos"))
    return train_word_vectors(txt.tokens(sentences, "sentence"), "key", dims=dims, epochs=epochs), dims


def route_and_score(spark: SparkSession, sf_dir: str, architecture: str = "rnn",
                    max_iter: int = 50, split=(9, 10), trained: bool = True) -> DataFrame:
    """Train the softmax router on the first 9/10 and score the rest:
    one row with the seven scores (and n).  Word vectors are trained on the
    documents, or (``trained=False``) loaded from the ``embeddings`` table."""
    wv, dims = (trained_word_vectors if trained else derived_word_vectors)(spark, sf_dir)
    plan = text_features(bugs_table(spark, sf_dir), wv, dims, architecture)
    train, test = order.train_test(plan.features, "row_id", *split)
    model = tr.train_softmax(train, max_iter=max_iter)
    return ev.metrics(tr.score(model, test))


def route_with_paragraph_vectors(spark: SparkSession, sf_dir: str, dims: int = 100, epochs: int = 5,
                                 min_count: int = 1, max_iter: int = 50) -> DataFrame:
    """Text job with PV-DBOW group vectors trained on all document tokens."""
    from bugroute.operators import paragraph as pv
    from bugroute.operators import text as txt

    docs = txt.tokens(load_table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    _, model = pv.train_paragraph_vectors(docs, "doc_id", "tokens", dims=dims, epochs=epochs,
                                          min_count=min_count)
    plan = text_features(bugs_table(spark, sf_dir), None, dims, "rnn", paragraph=model)
    train, test = order.train_test(plan.features, "row_id", 9, 10)
    return ev.metrics(tr.score(tr.train_softmax(train, max_iter=max_iter), test))


def light_bugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bugs of the no-text job with a class that its columns tell: the driver
    tables' language says nothing about them, so the class follows severity (a
    fifth of it at random) and 40 stands for what the job drops."""
    noise = F.pmod(F.xxhash64("row_id"), F.lit(5)) == 0
    severe = F.col("bug_severity").isin("critical", "blocker", "major")
    cls = F.when(F.col("class") == 40, 40).when(severe != noise, 10).otherwise(20)
    return bugs_table(spark, sf_dir).withColumn("class", cls)


def route_light(spark: SparkSession, sf_dir: str, max_iter: int = 50) -> DataFrame:
    """The no-text job: 7/10 split, softmax over one-hot columns."""
    plan = light_features(light_bugs(spark, sf_dir))
    train, test = order.train_test(plan.features, "row_id", 7, 10)
    model = tr.train_softmax(train, max_iter=max_iter)
    return ev.metrics(tr.score(model, test))
