"""Seating arrangements of Pitman-Yor restaurants, sampled by Gibbs for many dishes at once."""

from __future__ import annotations

import math
from functools import cache

import numpy as np

from trajecta.llm.arrowtext import mix


#: Customers up to which the weights of all table counts of a row are listed; numbers of a matrix of them (so that it stays in a core's cache); parts of a larger row's range.
#: Customers up to which weights are multiplied as they are: they stay within 10^200 for restaurants of up to 10^9 customers.
LISTED, CELLS, PARTS = 128, 200_000, 48
PLAIN = 16
#: Terms of the series for a large row's weights.
TERMS = 60


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers, by Stirling's series eight places on."""
    y = x + 8.0
    low = np.log(x) + np.log(x + 1) + np.log(x + 2) + np.log(x + 3) + np.log(x + 4) + np.log(x + 5) + np.log(x + 6) + np.log(x + 7)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - low


@cache
def listed_ways(d: float) -> np.ndarray:
    """Logarithms of the generalized Stirling numbers [c, t] up to LISTED: the weight of c customers at t tables."""
    out = np.full((LISTED + 1, LISTED + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(1, LISTED + 1)
    for c in range(1, LISTED):
        out[c + 1, 1:] = np.logaddexp(out[c, :-1], np.where(t <= c, out[c, 1:] + np.log(np.maximum(c - d * t, 1e-300)), -np.inf))
    return out


def series_terms(c: np.ndarray, d: float) -> np.ndarray:
    """(TERMS, rows): the coefficients of x^c in (1 - x)^(d k), k from 1, with sign, over the first one's size."""
    out = np.zeros((TERMS, len(c)))
    start = log_gamma(c - d)
    for k in range(1, TERMS + 1):
        if abs(d * k - round(d * k)) > 1e-9:
            sign = (-1.0) ** k * (-1.0 if math.floor(d * k) % 2 == 0 else 1.0)
            out[k - 1] = sign * np.exp(log_gamma(c - d * k) - start - math.lgamma(-d * k))
    return out


def log_ways(c: np.ndarray, t: np.ndarray, d: float, terms: np.ndarray) -> np.ndarray:
    """`listed_ways` of large c, t < c, less what depends on c alone: from the coefficient of x^c in (1 - (1 - x)^d)^t.

    By its binomial series (`series_terms`) while that loses few digits, at the saddle point beyond.
    """
    near = (d * t / c**d) ** (1 / (1 - d)) < 8
    out = np.empty(len(c))
    i = np.flatnonzero(near)
    if len(i):
        choose, total = np.ones(len(i)), np.zeros(len(i))
        for k in range(TERMS):
            choose = choose * ((t[i] - k) / (k + 1))
            total += choose * terms[k, i]
        out[i] = np.log(np.maximum(total, 1e-300))
    i = np.flatnonzero(~near)
    if len(i):
        n, m = c[i], t[i]
        share = n / m
        low, high = np.full(len(i), -200.0), np.full(len(i), -1e-12)
        for _ in range(48):
            z = (low + high) / 2
            above = d * -np.expm1(z) * np.exp((d - 1) * z) > -np.expm1(d * z) * share
            low, high = np.where(above, z, low), np.where(above, high, z)
        y, x = np.exp(low), -np.expm1(low)
        spread = np.maximum(n * (1 + (1 - d) * x / y - share), 1e-9)
        out[i] = m * np.log(-np.expm1(d * low)) - n * np.log(x) - 0.5 * np.log(2 * np.pi * spread) + log_gamma(n + 1.0) - log_gamma(n - d)
    return out - log_gamma(t + 1.0) - t * np.log(d)


def drawn_tables(c: np.ndarray, outer: np.ndarray, rise: np.ndarray, over: np.ndarray, d: float, draw: np.ndarray) -> np.ndarray:
    """A table count of all c customers of each row, given all else, whatever count the row had.

    The weight of t tables is the generalized Stirling number of (c, t) times, for each table j from 0, outer * (rise + j) / (over + j);
    where `over` is infinite, times outer for each. Up to LISTED customers all counts are listed; beyond, the range in which
    the weight is within exp(-14) of the largest is dealt to PARTS parts, so the work of a row is bounded. draw: two
    numbers from 0 to 1 for each row (2, rows), which decide it.
    """
    out = np.minimum(c, 1)
    fixed = np.isinf(over)

    def weight(i: np.ndarray, t: np.ndarray) -> np.ndarray:
        own = t * np.log(outer[i])
        j = np.where(fixed[i], 1.0, over[i])
        return own + np.where(fixed[i], 0.0, log_gamma(rise[i] + t) - log_gamma(rise[i]) - log_gamma(j + t) + log_gamma(j))

    known, plain = listed_ways(d), np.exp(listed_ways(d)[: PLAIN + 1, : PLAIN + 1])
    least = 1
    for most in (2, 3, 4, 6, 8, PLAIN, 48, LISTED):
        rows = np.flatnonzero((c > least) & (c <= most))
        j = np.arange(most)
        for a in range(0, len(rows), CELLS // most):
            i = rows[a : a + CELLS // most]
            f = fixed[i][:, None]
            ratio = np.where(f, 1.0, (rise[i][:, None] + j) / np.where(f, 1.0, over[i][:, None] + j)) * outer[i][:, None]
            if most <= PLAIN:  # numbers that need no logarithms
                w = plain[c[i], 1 : most + 1] * np.cumprod(ratio, axis=1)
            else:
                w = known[c[i], 1 : most + 1] + np.cumsum(np.log(ratio), axis=1)
                w = np.exp(w - w.max(axis=1, keepdims=True))
            sums = np.cumsum(w, axis=1)
            out[i] = 1 + (sums < (draw[0, i] * sums[:, -1])[:, None]).sum(axis=1)
        least = most
    rows = np.flatnonzero(c > LISTED)
    for a in range(0, len(rows), CELLS // PARTS):
        i = rows[a : a + CELLS // PARTS]
        n, top = c[i].astype(float), (c[i] - 1).astype(float)
        terms = series_terms(n, d)

        def value(some: np.ndarray, t: np.ndarray) -> np.ndarray:
            return log_ways(n[some], t, d, terms[:, some]) + weight(i[some], t)

        low, high = np.ones(len(i)), top.copy()  # the largest weight: the first t that the next doesn't exceed
        left = np.arange(len(i))
        while len(left):
            t = np.floor((low[left] + high[left]) / 2)
            up = value(left, np.minimum(t + 1, top[left])) > value(left, t)
            low[left], high[left] = np.where(up, t + 1, low[left]), np.where(up, high[left], t)
            left = left[low[left] < high[left]]
        mode, every = low, np.arange(len(i))
        best = value(every, mode)
        # from there on out, in growing steps, as far as the weight is within exp(-14) of it
        first, last = mode.copy(), mode.copy()
        for side, end in ((first, np.ones(len(i))), (last, top)):
            left, step = every[side != end], np.ones(len(i))
            while len(left):
                t = np.where(end[left] > side[left], np.minimum(mode[left] + step[left], end[left]), np.maximum(mode[left] - step[left], end[left]))
                side[left] = t
                step[left] *= 1.5
                left = left[(best[left] - value(left, t) < 14) & (t != end[left])]
        low = last
        wide = np.maximum((low - first + 1) / PARTS, 1.0)
        t = first[:, None] + (np.arange(PARTS)[None, :] + 0.5) * wide[:, None] - 0.5
        inside = t <= low[:, None] + 0.5
        t = np.minimum(np.floor(t + 0.5), low[:, None])
        w = np.stack([value(every, t[:, p]) for p in range(PARTS)], axis=1)
        w = np.where(inside, w - best[:, None], -np.inf)
        sums = np.cumsum(np.exp(w), axis=1)
        part = (sums < (draw[0, i] * sums[:, -1])[:, None]).sum(axis=1)
        out[i] = np.clip(np.floor(first + (part + np.where(wide > 1, draw[1, i], 0.0)) * wide), first, low).astype(np.int64)
    return out


def draws(keys: np.ndarray, number: int) -> np.ndarray:
    """(2, rows) numbers from 0 to 1 that depend on the row's key and the number of the draw alone."""
    k = keys.astype(np.int64, copy=False).view(np.uint64) * np.uint64(0xD1342543DE82EF95)
    return np.stack([mix(k + np.uint64((2 * number + j + 1) * 0x9E3779B97F4A7C15 % 2**64)) for j in (0, 1)]) / 2.0**64


def gibbs(
    customers: np.ndarray, dish: np.ndarray, outer: np.ndarray, base: float, inner: tuple[float, float], over: tuple[float, float, float, float] | None, burn: int, samples: int, moves: int, seed: int,
    alone: np.ndarray | None = None, parent: np.ndarray | None = None, start: np.ndarray | None = None, keys: np.ndarray | None = None,
) -> np.ndarray:
    """Table counts of the rows, `samples` of each (rows, samples) after `burn` sweeps.

    customers, dish: of each row; dish numbers from 0. outer: the row's restaurant's weight of a new table, but for the
    dish's parent probability. inner: discount and strength here. over: discount and strength of the parent, its tables
    and its customers, with `base` as its own base; None if the dishes' probability is `base` itself. A sweep draws the
    table count of every row anew, of all its customers at once; `moves` parts of the rows, dealt at random, take turns,
    each given the others. alone: tables that each dish has besides those of the rows. parent: the tables of each dish
    in the parent restaurant, which are held (see `parent_tables`). start: the table counts to begin with. keys: what the draws of a
    row depend on, besides the seed; its place if not given.
    """
    n = len(customers)
    keys = np.arange(n) if keys is None else keys
    customers = customers.astype(np.int64)
    d = inner[0]
    number = 1000 * seed
    if over is None:
        nothing, never = np.ones(n), np.full(n, np.inf)
        kept = [drawn_tables(customers, outer * base, nothing, never, d, draws(keys, number + i)) for i in range(samples)]
        return np.array(kept).T.reshape(n, samples)
    d0, s0, opened, served = over
    alone = np.zeros(int(dish.max()) + 1 if n else 0) if alone is None else alone
    parent = np.minimum(alone, 1) if parent is None else parent
    t = np.minimum(customers, 1) if start is None else start.astype(np.int64)
    c0 = alone + np.bincount(dish, t, minlength=len(alone))
    fresh = (s0 + d0 * opened) * base
    kept = []
    for sweep in range(burn + samples):
        turn = (draws(keys, number)[0] * moves).astype(np.int64)
        for step in range(moves):
            rows = np.flatnonzero((turn == step) & (customers > 1))
            k = dish[rows]
            others = np.maximum(c0[k] - t[rows], 0)
            rise = np.maximum(others - d0 * np.minimum(parent[k], others), 0) + fresh
            new = drawn_tables(customers[rows], outer[rows], rise, np.maximum(s0 + served - t[rows], s0 + others), d, draws(keys[rows], number + 1 + step))
            c0 += np.bincount(k, new - t[rows], minlength=len(c0))
            t[rows] = new
        number += moves + 1
        if sweep >= burn:
            kept.append(t.copy())
    return np.array(kept).T.reshape(n, samples)


def parent_tables(c0: np.ndarray, base: float, over: tuple[float, float], opened: float, draw: np.ndarray) -> np.ndarray:
    """Tables of each dish in the parent restaurant, drawn given its customers there (the tables below)."""
    d0, s0 = over
    return drawn_tables(c0, np.full(len(c0), (s0 + d0 * opened) * base), np.ones(len(c0)), np.full(len(c0), np.inf), d0, draw)
