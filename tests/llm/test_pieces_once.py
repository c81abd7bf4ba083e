"""Token blocks: a piece is looked up once a slice, runs are packed together."""

import numpy as np
import public_tokenizers

from bugroute.llm import token_blocks


def test_pieces_are_looked_up_once(monkeypatch):
    asked = []

    class Counted(token_blocks._Numbers):
        def __getitem__(self, piece):
            asked.append(piece)
            return super().__getitem__(piece)

    monkeypatch.setattr(token_blocks, "_Numbers", Counted)
    encoder = token_blocks.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"), 0)
    texts = ["one two two, two one one two one", "", " one  two", "two\none", "é two"] * 10
    counts, ids = encoder.encode(texts)
    assert len(asked) <= len({p for t in texts for p in t.split(" ")}) + len(texts)
    want = [[*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    assert ids.tolist() == sum(want, []) and counts.tolist() == list(map(len, want))


def test_runs_of_a_block():
    rng = np.random.default_rng(3)
    for n in (0, 1, token_blocks.RUN, token_blocks.RUN + 1, 3 * token_blocks.RUN + 7):
        ids = rng.integers(0, 1 << rng.integers(1, 62, n)).astype(np.uint64) if n else np.empty(0, np.uint64)
        words, first, escapes = token_blocks.pack(ids)
        got = token_blocks.unpack(words, first, n)
        got[escapes] = ids[escapes]
        assert got.tolist() == ids.tolist() and len(first) == -(-n // token_blocks.RUN)
