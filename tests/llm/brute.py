"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def low(t: str | None) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


def words(t: str | None) -> list[str]:
    return [w for w in SPACE.split(t or "") if w]


def repeat_words(t: str | None, n: int = 8) -> int:
    w = words(t)
    seen = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    return len({j for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for j in range(i, i + n)})


def shingles(t: str | None, k: int) -> frozenset:
    w = words(low(t))
    return frozenset(zip(*[w[i:] for i in range(k)], strict=False)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(docs: dict[int, str | None], k: int, percent: int = 80) -> dict[int, int]:
    sets = {d: shingles(t, k) for d, t in docs.items()}
    top = {d: d for d in docs}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    where = defaultdict(list)
    for d in sorted(sets):
        common = Counter(e for s in sets[d] for e in where[s])
        for e, n in common.items():
            if 100 * n >= percent * (len(sets[d]) + len(sets[e]) - n):
                a, b = find(d), find(e)
                top[max(a, b)] = min(a, b)
        for s in sets[d]:
            where[s].append(d)
    return {d: find(d) for d in docs}


def lcs(a: list, b: list) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def templates(line: str) -> set[tuple]:
    w = [("<*>" if re.search("[0-9]", x) else x) for x in words(line)]
    if len(w) < 3:
        return set()
    m = len(w) - 3
    cut = [3 + m * j // 4 for j in range(5)]
    runs = [tuple(w[cut[j] : cut[j + 1]]) for j in range(4)]
    out = {(len(w), -1, tuple(w[:3]), *runs)}
    if len(w) >= 11:
        out |= {(len(w), j, tuple(w[:3]), *[() if k == j else r for k, r in enumerate(runs)]) for j in range(4)}
    return out


def dropped(docs: dict[int, str | None]) -> dict[int, set[str]]:
    first: dict[tuple, int] = {}
    for d in sorted(docs):
        for x in (docs[d] or "").split("\n"):
            for t in templates(x):
                first.setdefault(t, d)
    return {d: {x for x in (t or "").split("\n") if any(first[y] < d for y in templates(x))} for d, t in docs.items()}
