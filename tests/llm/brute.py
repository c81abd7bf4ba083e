"""Plain Python versions of the operators' rules, for small inputs."""

import re
from collections import defaultdict
from itertools import combinations

ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())


def shingles(text, k=5):
    w = SPACE.findall(low(text))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def groups(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def linked(sets, percent):
    """Index pairs of similar sets that share an element."""
    having = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            having[x].append(i)
    pairs = {p for ids in having.values() if len(ids) > 1 for p in combinations(ids, 2)}
    return [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]


def near(rows):
    """rows: (doc_id, text) -> (doc_id, n_shingles, component_id, kept)."""
    sets = [shingles(t) for _, t in rows]
    root = groups(len(rows), linked(sets, 75))
    least = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return [(i, len(s), least.get(r), i == least.get(r)) for (i, _), s, r in zip(rows, sets, root)]


def contamination(rows, items, window=10):
    windows = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall(low(text))
        n = min(len(w), window)
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i:i + n])] |= {str(item)} if item is not None else set()
    lengths = {len(g) for g in windows}
    out = []
    for i, text in rows:
        w = ALNUM.findall(low(text))
        hit, found = set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k:k + n])]
        out.append((i, len(w), len(hit), ",".join(sorted(found))))
    return out


def line_shingles(line, k=7):
    """All runs of k characters; a shorter line is one."""
    return {line[i:i + k] for i in range(max(len(line) - k, 0) + 1)}


def line_dedup(rows, percent=75):
    """rows: (doc_id, text) with distinct ids -> texts without repeated lines."""
    lines = [(i, p, x.lower().strip(" ")) for i, t in rows if t is not None for p, x in enumerate(t.split("\n")) if x.strip()]
    names = sorted({x for *_, x in lines})
    at = {x: k for k, x in enumerate(names)}
    root = groups(len(names), linked([line_shingles(x) for x in names], percent))
    first = {}
    for i, p, x in lines:
        r = root[at[x]]
        first[r] = min(first.get(r, (i, p)), (i, p))
    gone = {(i, p) for i, p, x in lines if first[root[at[x]]] != (i, p)}
    return [(i, t if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone)) for i, t in rows]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]
