"""A small corpus with copies, near copies, shared passages, odd rows, for brute-force comparison."""

from __future__ import annotations

import random
import re

FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SPACED = re.compile(r"[^\x20\x09-\x0d]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def word(r: random.Random) -> str:
    return "".join(r.choice(["an", "er", "in", "th", "é", "on", "re", "st"]) for _ in range(r.randrange(1, 4)))


def prose(r: random.Random, n: int) -> str:
    out = []
    for _ in range(n):
        w = word(r)
        w = w.capitalize() if r.random() < 0.15 else w
        out.append(w + (r.choice([". ", ".\n", ", "]) if r.random() < 0.2 else " "))
    return "".join(out)


def documents(seed: int = 5) -> list[tuple[int | None, str | None]]:
    r = random.Random(seed)
    texts: list[str | None] = [prose(r, r.choice([1, 2, 3, 12, 30, 80, 200])) for _ in range(60)]
    passage = prose(r, 70) + "end. "
    base = prose(r, 120)
    texts += [prose(r, 40) + passage + prose(r, 40) for _ in range(6)]
    texts += [base] * 5
    for _ in range(25):
        w = base.split(" ")
        for _ in range(r.randrange(0, 6)):
            w[r.randrange(len(w))] = word(r)
        texts.append(" ".join(w))
    texts += [None, "", " \t\n ", "!!! ???", "one", "one two", "ONE two", prose(r, 5000), "a " * 400]
    return list(enumerate(texts, 10))
