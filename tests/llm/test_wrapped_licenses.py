"""Notices whose lines are wrapped, against runs of words cut without blocks_of."""

import math
import random

from bugroute.llm import licenses
from tests.llm import brute

REACH = licenses.BLOCK // 2


def runs_that_meet(words):
    """Labels of the templates that some run of up to REACH words meets."""
    found = set()
    for label, texts in licenses.TEMPLATES.items():
        for t in texts:
            own = set(brute.ALNUM.findall(t.encode()))
            need = math.ceil(licenses.THRESHOLD * len(own) - 1e-9)
            if any(len(own.intersection(words[k:k + REACH])) >= need for k in range(max(len(words) - REACH, 0) + 1)):
                found.add(label)
    return found


def wrapped(text, width, mark):
    lines, line = [], ""
    for w in text.split():
        if line and len(line) + len(w) >= width:
            lines.append(line)
            line = ""
        line += " " * bool(line) + w
    return "\n".join(mark + x for x in [*lines, line])


def test_wrapped_notices(spark):
    rng = random.Random(6)
    texts, labels = [], []
    for label, notices in licenses.TEMPLATES.items():
        for t in notices:
            for width, mark in ((72, " * "), (30, "# "), (12, "\r")):
                before = "\n".join(" ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 80)))
                texts.append(f"{before}\n{wrapped(t, width, mark)}\n\n{before[::-1]}")
                labels.append(label)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    for i, (text, label) in enumerate(zip(texts, labels)):
        words = brute.ALNUM.findall(brute.low(text))
        found = {x for x in got[i].labels.split(",") if x}
        assert label in found and runs_that_meet(words) <= found and got[i].n_words == len(words)
        assert got[i].score == 1.0
        for b in got[i].blocks:
            block = set(words[b.first_word:b.first_word + b.n_words])
            shares = [len(own & block) / len(own) for t in licenses.TEMPLATES[b.label]
                      for own in [set(brute.ALNUM.findall(t.encode()))]]
            assert any(abs(s - b.containment) < 1e-9 for s in shares) and b.containment >= licenses.THRESHOLD
