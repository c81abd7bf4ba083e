"""Paragraph vectors, PV-DBOW with negative sampling (VEC5 paragraph half,
VEC6 inference).

Le & Mikolov (2014), distributed bag of words: each document vector is trained
to tell the document's own words from sampled noise words, through output
weights that all documents share.  The weights are a table, see
``bugroute.operators.embedding``; documents meet only the rows of their own words
and of their noise words.

Start vectors and noise are seeded by the documents' keys and the words' places, so
neither the partitioning of the input nor the size of the cluster changes a result.
Inference for new documents reads the weights and changes their vectors only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from bugroute.operators import embedding as emb
from bugroute.session import ship_package


@dataclass
class ParagraphModel:
    vocab: DataFrame     # (word, count, idx)
    weights: DataFrame   # (idx, w), output weights
    dims: int
    seed: int


def _rng(seed: int, key_hash: int, epoch: int):
    return np.random.default_rng([seed, key_hash & 0xFFFFFFFFFFFFFFFF, epoch])


def _start(seed: int, key_hash: int, dims: int):
    return ((_rng(seed, key_hash, 0).random(dims) - 0.5) / dims).astype(np.float32)


def train_paragraph_vectors(df: DataFrame, key: str, tokens: str = "tokens", dims: int = 100,
                            epochs: int = 20, lr: float = 0.025, min_lr: float = 0.001,
                            negative: int = 5, min_count: int = 1, seed: int = 12345,
                            save_path: str | None = None) -> tuple[DataFrame, ParagraphModel]:
    """((key, vector array<float>), ParagraphModel).

    A document without known tokens keeps its start vector.  With ``save_path``
    the vectors are kept after every epoch.
    """
    from bugroute.operators.vectors import build_vocab
    from bugroute.sinks.vectors import save_embeddings

    vocab = build_vocab(df.select(tokens), tokens, min_count).select("word", "count", "idx")
    docs, slots, base = emb.dealt(emb.token_ids(df, key, tokens, vocab), key)

    def train(documents, weights, pool, epoch):
        rate = emb.rate_of(epoch, epochs, lr, min_lr)
        return [emb.dbow_pass(ids, _start(seed, h, dims) if v is None else v, weights, pool, rate, negative, _rng(seed, h, epoch))
                for h, ids, v in documents]

    def start(idx):
        return np.zeros((len(idx), dims), np.float32)

    def after(epoch, vectors):
        if save_path:
            save_embeddings(vectors, save_path, epoch)

    vectors, weights = emb.rounds(docs, key, slots, base, vocab, dims, train, start, max(1, epochs), seed, after)
    return vectors, ParagraphModel(vocab, weights, dims, seed)


def infer_vectors(model: ParagraphModel, df: DataFrame, key: str, tokens: str = "tokens",
                  epochs: int = 5, lr: float = 0.025, negative: int = 5, seed: int = 12345,
                  keep=()) -> DataFrame:
    """(key, keep..., vector) of (new) documents with the output weights frozen.
    A document's vector follows from its key and tokens alone; without known
    tokens it is zero."""
    spark = df.sparkSession
    ship_package(spark)
    dims = model.dims
    docs, slots, base = emb.dealt(emb.token_ids(df, key, tokens, model.vocab, keep), key)
    # the same noise words for every slot: a vector doesn't depend on the other documents
    need = emb.needed(docs, model.vocab, slots, model.seed, 1, f"{base}/need", shared=True).select("slot", "idx", "n")
    docs = docs.select(key, *keep, "__hash", "slot", "ids", F.lit(None).cast("array<float>").alias("vector"))
    schema = StructType([docs.schema[k] for k in (key, *keep, "vector")])
    out = to_arrow_schema(schema)

    def run(batches):
        parts = emb.slot_parts(batches, dims, None)
        idx, weights, pool = next(parts, (None, None, None))
        for batch in parts:
            vectors = []
            for h, ids, _ in emb._documents(batch, idx):
                v = _start(seed, h, dims) if len(ids) else np.zeros(dims, np.float32)
                for e in range(epochs):
                    v = emb.dbow_pass(ids, v, weights, pool, lr * (1 - e / max(1, epochs)), negative, _rng(seed, h, e + 1),
                                      update_out=False)
                vectors.append(np.asarray(v, np.float32))
            columns = {k: batch.column(k) for k in (key, *keep)} | {"vector": pa.array(vectors, pa.list_(pa.float32()))}
            yield emb._rows(columns, batch.num_rows, out)

    return emb.slot_rows(docs, need.join(model.weights, "idx"), slots).mapInArrow(run, schema)


def paragraph_group_vectors(model: ParagraphModel, df: DataFrame, key: str, height: int,
                            text: str = "text", epochs: int = 5, seed: int = 12345) -> DataFrame:
    """(key, group, vector array<double>): one inferred vector per word group
    (VEC6 with paragraph vectors); groups without known tokens get zeros."""
    from bugroute.operators.text import group_token_arrays

    groups = group_token_arrays(df, key, height, text)
    keyed = groups.select(F.concat_ws("/", F.col(key).cast("string"), "group").alias("__gid"), key, "group", "tokens")
    # key and group ride along through the task: no join back
    inferred = infer_vectors(model, keyed, "__gid", "tokens", epochs, seed=seed, keep=(key, "group"))
    return inferred.select(key, "group", F.col("vector").cast("array<double>").alias("vector"))
