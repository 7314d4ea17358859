"""Plain versions of the operators, for small tables."""

import random
import re
from collections import defaultdict

import numpy as np

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "ru", "so", "ti", "vu") for b in
         ("bar", "den", "fol", "gan", "hem", "jor", "kel", "lim", "mon", "nat", "pir", "rus")]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


def text(rng: random.Random, lines: int, words: int = 12) -> str:
    return "\n".join(sentence(rng, words) for _ in range(lines))


class Union:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def top(self, i):
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, a, b):
        a, b = self.top(a), self.top(b)
        self.up[max(a, b)] = min(a, b)


def water_fill(sizes: dict, shares=(5, 2, 1), cap=3.0) -> dict:
    """Targets of sources by repeated capping and resharing."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    share = {s: shares[i % len(shares)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        whole = sum(share[s] for s in open_)
        over = [s for s in open_ if left * share[s] / whole > cap * sizes[s]]
        if not over:
            return target | {s: left * share[s] / whole for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= set(over)
    return target


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
       "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
       "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def pii_spans(body: str) -> dict:
    """Plain patterns and checks, span by span."""
    out = defaultdict(list)
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, body):
            digits = re.sub("[^0-9]", "", m.group())
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m.group().split("."))
                    or kind == "card" and 13 <= len(digits) <= 19 and _luhn(digits)
                    or kind == "phone" and 9 <= len(digits) <= 15):
                out[kind].append((m.start(), m.end()))
    return out


def vector_classes(ids, x, threshold=0.95):
    """Number of links and smallest reachable id of each unit vector, by brute force."""
    x = x / np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= threshold
    u = Union(ids)
    for i, j in zip(*np.nonzero(near)):
        u.join(ids[i], ids[j])
    return {i: (int(near[k].sum()) - 1, u.top(i)) for k, i in enumerate(ids)}
