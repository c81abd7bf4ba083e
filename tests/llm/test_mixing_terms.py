"""The word and triple counts of a chunk are made from some texts at a time."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from bugroute.llm import context_mixing


def test_terms_of_some_texts_at_a_time(monkeypatch):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    texts = [" ".join(rng.choice(words, 50_000)) for _ in range(20)] + ["", None]
    n = len(texts)
    batch = pa.RecordBatch.from_pydict({"k1": np.arange(n), "k2": np.arange(n) + 7, "held_out": [i % 3 == 0 for i in range(n)],
                                        "text": texts})
    monkeypatch.setattr(context_mixing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    most, plain = [], context_mixing.trigrams
    monkeypatch.setattr(context_mixing, "trigrams", lambda t: most.append(sum(map(len, t))) or plain(t))
    got = [b.to_pydict() for b in context_mixing._term_rows(iter([batch]))]
    assert max(most) <= context_mixing.TRAIN_CHUNK
    monkeypatch.setattr(context_mixing, "TRAIN_CHUNK", context_mixing.CHUNK)
    assert got == [b.to_pydict() for b in context_mixing._term_rows(iter([batch]))]
