"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text):
    w = WORD.findall((text or "").translate(FOLD))
    return frozenset(zip(w, w[1:], w[2:])) if len(w) > 2 else frozenset([tuple(w)] if w else [])


def jaccard(rows):
    """(row number) -> n, component, links; rows are (doc_id, text)."""
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])]
    of = components(range(len(rows)), links)
    groups = defaultdict(list)
    for i, g in of.items():
        groups[g].append(rows[i][0])
    count = Counter(x for l in links for x in l)
    return [(rows[i][0], len(sets[i]), min((d for d in groups[of[i]] if d is not None), default=None), count[i]) for i in range(len(rows))]


def quality(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(8)}
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text):
    text = text or ""
    s = [(m.start(), 0, "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    s += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    s += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    c = Counter(x[2] for x in s)
    listed = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(s))
    return c["assign"], c["access"], c["hex"], hashlib.sha256(listed.encode()).hexdigest(), listed


def entropies(s):
    """Highest window entropy of a string, and whether a window passes as a whole and in each class."""
    hexadecimal = bool(re.fullmatch("[0-9a-f]+|[0-9A-F]+", s))
    best, passes = 0.0, False
    for i in range(len(s) - 19):
        window = s[i : i + 20]

        def bits(x):
            return -sum(k / len(x) * np.log2(k / len(x)) for k in Counter(x).values())

        best = max(best, bits(window))
        fine = bits(window) >= (2.9 if hexadecimal else 3.6) - 1e-9
        for test, letters in ((str.isdigit, 10), (str.islower, 26), (str.isupper, 26), (lambda c: c in "+/_-", 4)):
            own = [c for c in window if test(c)]
            letters = 6 if hexadecimal and letters == 26 else letters
            fine &= len(own) < 6 or bits(own) >= 0.6 * np.log2(min(len(own), letters)) - 1e-9
        passes |= fine
    return best, passes


ALLOWED = [r"(?i)example|sample|dummy|placeholder|xxxx", r"^/?(?:[A-Z]?[a-z]+(?:[_-][A-Z]?[a-z]+)*/)+[A-Za-z0-9_-]{0,19}$", r"^[a-z]+(?:[-_][a-z0-9]+)+$", r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"]


def all_spans(text):
    """The spans of the fixed patterns and of the entropy method, listed."""
    base = [(int(a), i, int(b), k) for i, k in enumerate(("assign", "access", "hex")) for x in secrets(text)[4].split(",") if x for n, a, b in [x.split(":")] if n == k]
    out = list(base)
    for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}", text or ""):
        s = m[0]
        inside = any(a <= m.start() and m.end() <= b for a, _, b, _ in base)
        if not inside and re.search("[0-9]", s) and re.search("[A-Za-z]", s) and not any(re.search(p, s) for p in ALLOWED) and entropies(s)[1]:
            out.append((m.start(), 3, m.end(), "entropy"))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def targets(sizes):
    """Source -> target."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        level = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else weight[s] * level for s in names}
        capped |= over


def vectors(rows):
    """(vec_id, vector) -> n_links, component."""
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    links = []
    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if ok[i] and ok[j] and len(a) == len(b):
                x, y = np.array(a, float), np.array(b, float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95:
                    links.append((i, j))
    of = components(range(len(rows)), links)
    count = Counter(x for l in links for x in l)
    least = {}
    for i, g in of.items():
        least[g] = min(least.get(g, rows[i][0]), rows[i][0])
    return {rows[i][0]: (count[i], least[of[i]]) for i in range(len(rows))}
