import hashlib
from collections import defaultdict

import numpy as np
import pytest

from bugroute.llm import exact_dedup, line_dedup, near_dedup
from bugroute.llm.components import components
from tests.llm import brute
from tests.llm.conftest import SENTENCE, edge_rows, rows_of


def expected_exact(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[brute.low(t)].append(i)
    out = []
    for i, t in rows:
        ids = by[brute.low(t)]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(brute.low(t)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("fan_in", [2, 16])
def test_exact_dedup(edge, empty, fan_in):
    columns = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert rows_of(exact_dedup.exact_dedup(edge, fan_in=fan_in), *columns) == expected_exact(edge_rows())
    assert rows_of(exact_dedup.exact_dedup(empty), *columns) == []


def test_exact_dedup_many_runs(spark):
    rows = [(k, "Same" if k % 3 == 0 else f"text {k % 50}") for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(23)
    assert rows_of(exact_dedup.exact_dedup(df, fan_in=2), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == \
        expected_exact(rows)


def test_near_duplicates(small):
    df, rows = small
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect()}
    assert got == {i: (n, c, k) for i, n, c, k in brute.near(rows)}


def test_near_duplicates_edges(edge, empty):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(edge).collect()),
                 key=repr)
    want = [(i, n, c if n else i, k if n else True) for i, n, c, k in brute.near(edge_rows())]
    want = [(i, n, c, k) if i is not None else (i, n, None, True) for i, n, c, k in want]
    assert got == sorted(want, key=repr)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_duplicates_large_group(spark, monkeypatch):
    """A large group of varied copies whose members are often not linked with
    each other: blocks of 16, so that the search goes over many cells."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng = np.random.default_rng(5)
    base = [f"word{k}" for k in rng.integers(0, 400, 120)]
    rows = []
    for i in range(90):
        words = list(base)
        for k in rng.integers(0, len(words), rng.integers(0, 7)):
            words[k] = f"new{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect())
    assert got == brute.near(rows)


def test_estimate_is_near_the_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for n in (5, 60, 900):
        for share in (0.3, 0.75, 1.0):
            a = rng.integers(0, 2**64, n, dtype=np.uint64)
            b = np.concatenate([a[:int(n * share)], rng.integers(0, 2**64, n - int(n * share), dtype=np.uint64)])
            true = int(n * share) / (2 * n - int(n * share))
            got = near_dedup.estimate(near_dedup.signature(a)[None], near_dedup.signature(b)[None], np.array([n]), np.array([n]))
            errors.append(abs(got[0, 0] - true))
    assert max(errors) < 0.2 and np.mean(errors) < 0.08


def test_line_dedup(small):
    df, rows = small
    got = sorted((r.row.doc_id, r.kept) for r in line_dedup.line_dedup(df).collect())
    assert [x for x in zip(got, sorted(brute.line_dedup(rows), key=lambda r: r[0])) if x[0] != x[1]] == []


def test_line_dedup_edges(edge, empty):
    out = line_dedup.line_dedup(edge)
    got = {r.row.doc_id: r for r in out.where("row.doc_id is not null").collect()}
    assert out.count() == len(edge_rows()) and out.select("row.*").columns == edge.columns
    assert got[1].kept is None and got[1].n_lines == 0 and got[2].kept == "" and got[4].kept == "alone"
    assert got[6].kept == SENTENCE and got[7].kept == "" and got[12].kept == ""
    assert got[14].kept == "first line of this text\nlast line of this text" and got[14].n_dropped == 1
    assert line_dedup.line_dedup(empty).count() == 0


def test_line_dedup_varied_lines(spark):
    rng = np.random.default_rng(3)
    base = SENTENCE.split() * 2
    rows = []
    for i in range(60):
        words = list(base)
        for k in rng.integers(0, len(words), rng.integers(0, 3)):
            words[k] = f"other{rng.integers(0, 50)}"
        rows.append((i, " ".join(words) + f"\nown line {i} of text {i * 7} with words{i}"))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r.row.doc_id, r.kept) for r in line_dedup.line_dedup(df).collect())
    assert got == brute.line_dedup(rows)


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(400, 440)] + [(500, 500)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect())
    root = brute.groups(600, links)
    assert got == {k: root[k] for pair in links if pair[0] != pair[1] for k in pair}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
