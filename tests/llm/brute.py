"""Plain versions of the operators' definitions, for small inputs."""

import re
from collections import Counter, defaultdict

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def distance(a, b):
    row = list(range(len(a) + 1))
    for j, c in enumerate(b, 1):
        old, row = row, [j]
        for i in range(1, len(a) + 1):
            row.append(min(old[i] + 1, row[i - 1] + 1, old[i - 1] + (a[i - 1] != c)))
    return row[-1]


def shingles(text):
    found = WORD.findall((text or "").translate(LOWER))
    if len(found) < 5:
        return {tuple(found)} if found else set()
    return {tuple(found[k:k + 5]) for k in range(len(found) - 4)}


def jaccard_groups(rows):
    """[(doc_id, n_shingles, component_id)], sorted."""
    sets = [(d, shingles(t)) for d, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)]) for i, (d, s) in enumerate(sets))


def kept_lines(rows, edits=2, least=1):
    """doc_id -> text, by comparing every line with every earlier one. Ids are unique."""
    rows = sorted(rows)
    spots = [(d, i, x) for d, t in rows for i, x in enumerate((t or "").split("\n")) if len(x) >= least]
    first = {}
    for d, i, x in spots:
        first.setdefault(x, (d, i))
    names = list(first)
    gone = {max(x, y, key=first.get) for k, x in enumerate(names) for y in names[:k]
            if abs(len(x) - len(y)) <= edits and distance(x, y) <= min(edits, min(len(x), len(y)) // 16)}
    return {d: None if t is None else "\n".join(
        x for i, x in enumerate(t.split("\n")) if len(x) < least or first[x] == (d, i) and x not in gone) for d, t in rows}


def byte_spans(rows, length):
    """[(doc_id, spans, kept)] with every string of `length` bytes counted."""
    raw = [(d, (t or "").encode()) for d, t in rows]
    count = Counter(b[p:p + length] for _, b in raw for p in range(len(b) - length + 1))
    out = []
    for d, b in raw:
        spans = []
        for p in range(len(b) - length + 1):
            if count[b[p:p + length]] > 1:
                if spans and p <= spans[-1][1]:
                    spans[-1][1] = p + length
                else:
                    spans.append([p, p + length])
        kept, at = b"", 0
        for x, y in spans:
            kept, at = kept + b[at:x], y
        out.append((d, [tuple(s) for s in spans], kept + b[at:]))
    return out


def shares(rows, column, weight):
    out = defaultdict(float)
    for r in rows:
        out[r[column]] += r[weight]
    total = sum(out.values())
    return {k: v / total for k, v in out.items()}
