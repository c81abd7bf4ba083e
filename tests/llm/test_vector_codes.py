"""Vector codes against plain Python."""

import hashlib
import math
import random

import pytest

from bugroute.llm import vector_codes as vc
from tests.llm.conftest import rows_of

COLUMNS = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def reference(rows, parts, entries=64, rounds=2):
    """rows: (vec_id, vector, label)."""
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // parts
    cut = [[v[p * w:(p + 1) * w] for p in range(parts)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            own = [[] for _ in books[p]]
            for c in cut:
                own[nearest(p, c[p])[1]].append(c[p])
            books[p] = [[sum(col) // len(xs) for col in zip(*xs)] if xs else e for xs, e in zip(own, books[p])]
    found = [[nearest(p, c[p]) for p in range(parts)] for c in cut]
    error = [sum(d for d, _ in f) for f in found]
    total = {}
    for (_, _, lab), e in zip(kept, error):
        total[lab] = total.get(lab, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), e, total[lab], sha) for (i, _, lab), f, e in zip(kept, found, error)), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1, "x", [2]) for i, v, lab in rows],
                                 "vec_id long, embedding array<double>, label int, error long, code string, ints array<int>").repartition(4)


def vectors(n, dims, rng, spread=1.0):
    return [[round(rng.gauss(0, spread), 3) for _ in range(dims)] for _ in range(n)]


@pytest.mark.parametrize("dims, parts, spread", [(32, 16, 0.2), (32, 16, 60000.0), (16, 16, 0.05), (6, 2, 1.0)])
def test_codes(spark, dims, parts, spread):
    rng = random.Random(dims)
    vs = [[min(max(x, -2e5), 2e5) for x in v] for v in vectors(150, dims, rng, spread)]
    rows = [(k * 3 % 151, v, rng.choice([0, 1, None])) for k, v in enumerate(vs)]
    bad = [None, [None] * dims, [float("nan")] * dims, [float("inf")] + [0.0] * (dims - 1), [0.0] * (dims - 1) + [float("-inf")]]
    rows += [(-k, b, 0) for k, b in enumerate(bad)]
    rows += [(5, vs[0], 1), (5, vs[1], 1), (None, vs[2], None), (None, vs[3], 1), (500, vs[4], 0), (501, vs[4], 0)]
    assert rows_of(vc.code_report(frame(spark, rows), parts=parts), *COLUMNS) == reference(rows, parts)


def test_blocks_and_labels_without_broadcast(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(k, v, rng.choice([1, 2, None])) for k, v in enumerate(vectors(300, 16, rng))]
    monkeypatch.setattr(vc, "BROADCAST_LABELS", 0)
    assert rows_of(vc.code_report(frame(spark, rows)), *COLUMNS) == reference(rows, 16)


def test_few_and_no_vectors(spark):
    rows = [(k, v, 0) for k, v in enumerate(vectors(3, 16, random.Random(2)))]
    assert rows_of(vc.code_report(frame(spark, rows)), *COLUMNS) == reference(rows, 16)
    assert vc.code_report(frame(spark, rows).limit(0)).collect() == []
    none = vc.code_report(frame(spark, [(1, [], 3), (2, [], 3)])).collect()
    assert [(r.code, r.error, r.label_error) for r in none] == [("00" * 16, 0, 0)] * 2


@pytest.mark.parametrize("vecs", [[[1.0] * 16, [1.0] * 32], [[1.0] * 20], [[1e6] * 16]])
def test_vectors_that_do_not_fit(spark, vecs):
    with pytest.raises(Exception, match="components|too large"):
        vc.code_report(frame(spark, [(k, v, 0) for k, v in enumerate(vecs)])).collect()
