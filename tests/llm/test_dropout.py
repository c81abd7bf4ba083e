"""Merge dropout is drawn for each occurrence of a unit."""

import numpy as np
import public_tokenizers

from bugroute.llm import pieces

VOCABULARY = pieces.Vocabulary(public_tokenizers.path("piece_bpe_32k.model"))


def test_each_occurrence_is_drawn():
    for word in ("of", "international", "unbelievably"):
        texts = [" ".join([word] * 50)] * 400
        encoder = pieces.UnitEncoder(VOCABULARY, 0.1, 17)
        ids, counts = encoder.encode(texts, np.arange(400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        unit, made, seen = " " + word, [], []
        plain = VOCABULARY.segment(unit, 0, 0.0, 17, made)
        for k in range(20_000):
            seen.append(tuple(VOCABULARY.segment(unit, k * 0x9E3779B97F4A7C15 % 2**64, 0.1, 17)))
        at, own = np.cumsum(counts) - counts, []
        for a, n in zip(at.tolist(), counts.tolist()):
            own.append(tuple(ids[a:a + n].tolist()))
        assert len(set(own)) > 4
        longer = ids.size / (20_000 * len(plain))
        wanted = np.mean([len(x) for x in seen]) / len(plain)
        assert abs(longer - wanted) < 0.03 * wanted and wanted > 1.05


def test_kept_units_equal_single_ones():
    rng = np.random.default_rng(3)
    words = ["the", "tokenizer", "segmentation", "日本語の文章", "x" * 45, "a▁b", " indented", "naïve", "of"]
    texts = [" ".join(rng.choice(words, 60)) + "\n" + " ".join(rng.choice(words, 9)) for _ in range(50)]
    keys = rng.integers(0, 2**63, 50).astype(np.uint64)
    for dropout in (0.0, 0.1, 0.5):
        encoder = pieces.UnitEncoder(VOCABULARY, dropout, 5)
        for _ in range(2):
            ids, counts = encoder.encode(texts, keys)
            want = []
            for t, key in zip(texts, keys):
                units = pieces.UNIT.findall(" " + t)
                draw = pieces.mix64(key + np.arange(len(units), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                want += [i for u, d in zip(units, draw.tolist()) for i in VOCABULARY.segment(u, d, dropout, 5)]
            assert ids.tolist() == want and counts.sum() == len(want)
