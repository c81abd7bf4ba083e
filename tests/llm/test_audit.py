"""The filter audit against a direct count of every order."""

import random
import re
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest

from bugroute.llm import filter_audit as fa
from tests.llm.conftest import rows_of

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def reference(rows, labels):
    """rows: (doc_id, text, part), labels: (doc_id, quality, toxic)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    docs = []
    for i, text, part in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
                 bool(re.search(r"[#$%&*|]", t)), i is not None and least[t] < i]
        docs.append((part or "", {x for x, f in zip("ABCDE", fails) if f}, i in good, i in toxic))
    out, removed = [], defaultdict(int)
    parts = sorted({d[0] for d in docs})
    for order in map("".join, permutations("ABCDE")):
        for part in parts:
            left = gone = None
            left, gone = [d for d in docs if d[0] == part], []
            every = left
            for step, f in enumerate(order, 1):
                out_now = [d for d in left if f in d[1]]
                redundant = sum(f in d[1] for d in gone)
                left, gone = [d for d in left if f not in d[1]], gone + out_now
                removed[part, f] += len(out_now)
                out.append([part, order, step, len(left), len(out_now), redundant, sum(d[1] == {f} for d in every),
                            sum(d[2] for d in out_now), sum(d[3] for d in out_now), f])
    return sorted((tuple(r[:-1]) + (removed[r[0], r[-1]],) for r in out), key=repr)


@pytest.fixture(scope="module")
def case():
    rng = random.Random(3)
    base = [" ".join(f"w{rng.randrange(150)}" for _ in range(n)) for n in (0, 5, 199, 200, 260, 900)]
    texts = [None, "", " \t\v", *base, "A" + "b" * 49, "A" + "b" * 48, "a&b", "É" * 20 + "A", "x " * 200, "\x1c\x85 a", "y|z " * 210]
    rows = [(i, rng.choice(texts) if i % 3 else rng.choice(texts) or "" + f" {i}", rng.choice(["s", "t", None, ""])) for i in range(120)]
    rows += [(None, base[3], "s"), (None, base[3], "t"), (7, base[3], "s"), (7, base[3], "s"), (1, "solo", "u"), (1, "solo", "u")]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 120, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (999, 1, 1), (6, None, None)]
    return rows, labels


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, p, 7, "x", "y") for i, t, p in rows],
                                 "doc_id long, text string, source string, mask int, part string, digest string").repartition(5)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").repartition(2)


def test_every_order(spark, case):
    assert rows_of(fa.audit(*frames(spark, *case)), *COLUMNS) == reference(*case)


def test_saturated_sketch_stays_exact(spark, case, monkeypatch):
    """A sketch that clears nothing changes nothing."""
    monkeypatch.setattr(fa, "repeat_bits", lambda rows, n_rows: (3, np.full(1, 255, np.uint8)))
    assert rows_of(fa.audit(*frames(spark, *case)), *COLUMNS) == reference(*case)


def test_empty_tables(spark, case):
    rows, labels = case
    docs, marks = frames(spark, rows, labels)
    assert fa.audit(docs.limit(0), marks).collect() == []
    assert rows_of(fa.audit(docs, marks.limit(0)), *COLUMNS) == reference(rows, [])


def test_sketch_clears_unique_texts_only(spark):
    """No repeated digest is cleared; nearly all unique ones are."""
    rng = np.random.default_rng(5)
    digests = [rng.bytes(32) for _ in range(20_000)]
    rows = spark.createDataFrame([(d,) for d in digests + digests[:500]], "digest binary").repartition(7)
    log2, bits = fa.repeat_bits(rows, 20_500)
    at = fa._probes(fa._heads(digests), log2)
    maybe = (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool).all(0)
    assert maybe[:500].all() and maybe[500:].mean() < 0.03
