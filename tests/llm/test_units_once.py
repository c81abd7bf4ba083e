"""Units of merge-dropout: hashed once, segmented together as one by one."""

import numpy as np
import public_tokenizers

from bugroute.llm import pieces


def test_units_are_hashed_once(monkeypatch):
    hashed = []
    keys = pieces.unit_keys
    monkeypatch.setattr(pieces, "unit_keys", lambda units, seed: hashed.extend(units) or keys(units, seed))
    encoder = pieces.UnitEncoder(pieces.Vocabulary(public_tokenizers.path("piece_bpe_32k.model")), 0.5, 3)
    texts = ["the merged words of the text are the words of the text"] * 20
    encoder.encode(texts, np.arange(20, dtype=np.uint64))
    assert len([u for u in hashed if u]) <= 2 * len(set(hashed))


def test_segment_all_equals_segment():
    vocabulary = pieces.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    units = [" the", "x", " ", "  wide", "\n", " internationalization", " " + "long" * 12, " ▁é日", ""] * 3
    variants = np.arange(len(units))
    for dropout in (0.0, 0.4):
        ids, sizes = vocabulary.segment_all(units, variants, dropout, 5)
        assert ids.tolist() == [i for u, v in zip(units, variants.tolist()) for i in vocabulary.segment(u, v, dropout, 5)]
        again, _ = vocabulary.segment_all(units, variants, dropout, 5, keys=pieces.unit_keys(units, 5))
        assert again.tolist() == ids.tolist() and sizes.sum() == len(ids)
