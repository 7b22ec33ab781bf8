"""The tables of the language model (see `lm`), whose rows are blocks: each holds the numbers of many words or pairs as bytes.

A chunk is a run of whole texts with the distinct words and pairs of them. Chunks, parts of the pairs and parts of the words are told
apart by number, and what one asks of or tells another is a row of the shuffle, of the columns of ROW: its kind, the number it goes
to, the number it comes from, and lists of numbers. An answer has the order of the question, so it repeats no word and no pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from trajecta.llm.arrowtext import mix
from trajecta.llm.seating import gibbs, parent_tables

ROW = "kind int, to long, at long, data array<binary>"
SCHEMA = pa.schema([("kind", pa.int32()), ("to", pa.int64()), ("at", pa.int64()), ("data", pa.list_(pa.binary()))])
#: How tables are stored: rows are megabytes, and so are pages; this codec needs no buffers of a page outside the heap, of which an executor would keep several.
STORED = {"compression": "zstd"}
#: A word that is learned once and stands in no other text, and one that isn't learned. The start of a text is word 0.
ONCE, NEW, START = -1, -2, 0
#: Most bits of a word's number, of which a pair has two.
WORD_BITS = 31
#: Tokens that are handled at once where a number of each is enough to keep, so that a chunk takes few bytes a token.
STEP = 1 << 16
#: Odd factors that spread the numbers of pairs.
FACTORS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)

Row = tuple[int, int, int, list[bytes]]


def table(rows: list[Row]) -> pa.Table:
    kind, to, at, data = ([r[i] for r in rows] for i in range(4))
    return pa.table([pa.array(kind, pa.int32()), pa.array(to, pa.int64()), pa.array(at, pa.int64()), pa.array(data, pa.list_(pa.binary()))], schema=SCHEMA)


def rows_of(part: pa.Table | pa.RecordBatch) -> list[Row]:
    """In order of their kinds and of where they come from."""
    found = zip(*(part.column(i).to_pylist() for i in range(4)))
    return sorted(found, key=lambda r: (r[0], r[2]))


def thin(x: np.ndarray) -> bytes:
    """Numbers from 0 on, first all lowest bytes, then the next ones, as far as there are any; they are compressed well like this."""
    size = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([size]) + np.ascontiguousarray(x.astype(f"<u{x.itemsize}", copy=False).view(np.uint8).reshape(-1, x.itemsize)[:, :size].T).tobytes()


def thick(data: bytes, kind: str = "<i8") -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    planes = raw[1:].reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], np.dtype(kind).itemsize), dtype=np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view(kind)[:, 0]


def rising(x: np.ndarray) -> bytes:
    """Sorted numbers, by their differences."""
    return thin(np.diff(x, prepend=x.dtype.type(0)))


def risen(data: bytes) -> np.ndarray:
    return np.cumsum(thick(data))


def joined(found: list[np.ndarray], kind: type = np.int64) -> np.ndarray:
    return np.concatenate(found) if found else np.zeros(0, dtype=kind)


def order_of(x: np.ndarray) -> np.ndarray:
    """Sorts numbers from 0 on: their highest bits with their places as one number, which is far faster than argsort and seldom not enough."""
    low = np.uint64(len(x).bit_length())
    bits = int(x.max()).bit_length() if len(x) else 0
    packed = x.view(np.uint64) >> np.uint64(max(0, bits - 64 + int(low)))
    packed <<= low
    packed |= np.arange(len(x), dtype=np.uint64)
    packed.sort()
    packed &= np.uint64((1 << int(low)) - 1)
    order = packed.view(np.int64)
    y = x[order]
    return order if (y[1:] >= y[:-1]).all() else np.argsort(x, kind="stable")


def firsts(x: np.ndarray) -> np.ndarray:
    """Where a new number begins in sorted ones."""
    new = np.ones(len(x), dtype=bool)
    new[1:] = x[1:] != x[:-1]
    return new


def each(f: Callable[[Row], Iterator[Row]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: the rows that f makes of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                for row in rows_of(batch.slice(i, 1)):
                    yield from table(list(f(row))).to_batches()

    return run


def met(left: DataFrame, right: DataFrame, f: Callable[[int, list[Row], list[Row]], Iterator[Row]]) -> DataFrame:
    """The rows that f makes of those of both frames that go to one number."""

    def run(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        return table(list(f(key[0].as_py(), rows_of(a), rows_of(b))))

    return left.groupBy("to").cogroup(right.groupBy("to")).applyInArrow(run, ROW)


def gathered(rows: DataFrame, f: Callable[[int, list[Row]], Iterator[Row]]) -> DataFrame:
    """The rows that f makes of those that go to one number."""

    def run(key: tuple, part: pa.Table) -> pa.Table:
        return table(list(f(key[0].as_py(), rows_of(part))))

    return rows.groupBy("to").applyInArrow(run, ROW)


def chunks(texts: DataFrame, tokens: Callable, most: int) -> DataFrame:
    """Chunks of the texts (key, learn, text): rows of kind 0 with the keys, whether they are learned, tokens of each and the words' places; of kind 1 with the sorted hashes of the words and twice the times that each is learned, plus 1 if it stands in another text; of kind 2, with the number of tokens and of learned texts in place of to and at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n, number = 0, TaskContext.get().partitionId() << 32

        def chunk() -> Iterator[pa.RecordBatch]:
            keys, learn, sizes, h = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order, size = order_of(h), len(h)
            h = h[order]
            new = firsts(h)
            words = h[new]
            del h
            place = np.empty(size, dtype=np.int32)
            place[order] = np.cumsum(new, dtype=np.int32)
            del order, new
            place -= 1
            learned = np.repeat(learn, sizes)
            times = np.bincount(place[learned], minlength=len(words))
            other = np.bincount(place[~learned], minlength=len(words)) > 0
            yield from table(
                [(0, number, number, [keys.tobytes(), learn.tobytes(), thin(sizes), thin(place)]), (1, number, number, [rising(words), thin(times << 1 | other)]), (2, size, int(learn.sum()), [])]
            ).to_batches()

        for batch in batches:
            key_of, learn_of = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for a, b, of, h in tokens(batch.column(2)):
                held.append((key_of[a:b], learn_of[a:b], np.bincount(of, minlength=b - a), h))
                n += len(h)
                if n >= most:
                    yield from chunk()
                    held, n, number = [], 0, number + 1
        if held:
            yield from chunk()

    return texts.mapInArrow(run, ROW)


def by_hash(chunk: Row, n_parts: int) -> Iterator[Row]:
    """The words of a chunk, to ranges of their hashes."""
    words, times = risen(chunk[3][0]).view(np.uint64), thick(chunk[3][1])
    bounds = np.searchsorted(words, np.array([(i << 64) // n_parts for i in range(n_parts)], dtype=np.uint64)).tolist()
    for part, (a, b) in enumerate(zip(bounds, [*bounds[1:], len(words)])):
        if a < b:
            yield 0, part, chunk[2], [rising(words[a:b]), thin(times[a:b])]


def vocabulary(part: int, asked: list[Row]) -> Iterator[Row]:
    """Kind 0: the words with a number, of a range of hashes, and their times. Kind 1: how many tokens and words are learned, how many have no number, and how many of each class have one.

    A word has a number if it is learned twice, or once and another text has it. Its class is the number of bits of its times.
    """
    words = joined([risen(r[3][0]) for r in asked]).view(np.uint64)
    times = joined([thick(r[3][1]) for r in asked])
    order = order_of(words)
    words, times = words[order], times[order]
    first = np.flatnonzero(firsts(words))
    words, c, other = words[first], np.add.reduceat(times >> 1, first), np.bitwise_or.reduceat(times & 1, first) > 0
    named = (c > 1) | ((c == 1) & other)
    yield 0, part, part, [rising(words[named]), thin(c[named])]
    yield 1, part, part, [thin(np.array([c.sum(), (c > 0).sum(), ((c == 1) & ~named).sum()])), thin(np.bincount(class_of(c[named]), minlength=64))]


def class_of(c: np.ndarray) -> np.ndarray:
    return np.frexp(c.astype(float))[1].astype(np.int64)


def numbers(c: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Numbers of the words of a range: from where each class of it starts on, in order of the words."""
    kind = class_of(c)
    order = np.argsort(kind, kind="stable")
    out = np.empty(len(c), dtype=np.int64)
    sizes = np.bincount(kind, minlength=64)
    out[order] = np.arange(len(c)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
    return out


def named(part: int, asked: list[Row], words: list[Row], starts: np.ndarray) -> Iterator[Row]:
    """Numbers and times of the words that chunks ask for."""
    h, c = (risen(words[0][3][0]).view(np.uint64), thick(words[0][3][1])) if words else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    number = np.append(numbers(c, starts[part]), NEW)
    c, ended = np.append(c, 0), np.append(h, np.uint64(0))
    for r in asked:
        one, learned = risen(r[3][0]).view(np.uint64), thick(r[3][1]) > 1
        at = np.searchsorted(h, one)
        at = np.where((at < len(h)) & (ended[at] == one), at, len(h))
        alone = (at == len(h)) & learned
        yield 1, r[2], part, [thin(np.where(alone, ONCE, number[at]) - NEW), thin(np.where(alone, 1, c[at]))]


def numbered(chunk: int, texts: list[Row], answers: list[Row], norm: float) -> Iterator[Row]:
    """The chunk with its words' numbers, and by text the tokens that are learned and the sum of log10 of one more than their times, less norm for each token."""
    keys, learn, sizes, place = texts[0][3]
    word, c = (joined([thick(r[3][i]) for r in answers]) for i in (0, 1))
    place, n = thick(place, "<i4"), thick(sizes)
    of = np.repeat(np.arange(len(n)), n)
    b = np.bincount(of, np.log10(c + 1.0)[place], minlength=len(n)) - norm * n
    known = np.bincount(of[(c > 0)[place]], minlength=len(n))
    del of
    yield 0, chunk, chunk, [keys, learn, sizes, thin(word[place]), thin(known), b.astype(float).tobytes()]


class Numbers:
    """Numbers of pairs and parts: n_parts parts of the words and as many of the pairs, for words under 2^bits."""

    def __init__(self, bits: int, n_parts: int):
        if bits > WORD_BITS:
            raise ValueError(f"over 2^{WORD_BITS} words")
        self.bits, self.n_parts, self.mask = np.uint64(bits), n_parts, np.uint64((1 << 2 * bits) - 1)
        self.bounds = np.array([(i << 2 * bits) // n_parts for i in range(n_parts)], dtype=np.int64)

    def pair(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        """A number under 2^(2 bits) of each pair, spread so that ranges of them hold as many pairs."""
        x = u.view(np.uint64) << self.bits | w.view(np.uint64)
        for f in FACTORS:
            x = x * np.uint64(f) & self.mask
            x ^= x >> self.bits
        return x.view(np.int64)

    def words(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = pair.view(np.uint64)
        for f in reversed(FACTORS):
            x = x ^ x >> self.bits
            x = x * np.uint64(pow(f, -1, 1 << 64)) & self.mask
        return (x >> self.bits).view(np.int64), (x & np.uint64((1 << int(self.bits)) - 1)).view(np.int64)

    def sliced(self, pairs: np.ndarray) -> Iterator[tuple[int, slice]]:
        """The parts of sorted pairs."""
        at = np.searchsorted(pairs, self.bounds).tolist()
        return ((i, slice(a, b)) for i, (a, b) in enumerate(zip(at, [*at[1:], len(pairs)])) if a < b)

    def seat(self, w: np.ndarray) -> np.ndarray:
        """A word's part, and its place there in the lower half; sorted by it, words stand by parts."""
        return w % self.n_parts << np.int64(32) | w // self.n_parts

    def seats(self, seat: np.ndarray) -> Iterator[tuple[int, slice, np.ndarray]]:
        """The parts of sorted seats, with the places there."""
        part, place = seat >> np.int64(32), seat & np.int64(0xFFFFFFFF)
        at = np.searchsorted(part, np.arange(self.n_parts)).tolist()
        return ((i, slice(a, b), place[a:b]) for i, (a, b) in enumerate(zip(at, [*at[1:], len(part)])) if a < b)


def words_of(chunk: Row) -> np.ndarray:
    """The word of each token."""
    w = thick(chunk[3][3], "<u4")
    w -= np.uint32(-NEW)
    return w.view(np.int32)


def pairs_of(chunk: Row, w: np.ndarray, by: Numbers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the tokens (words w) that have a number, as the word before has: places in order of their pairs, the first place there of each pair, and the distinct pairs."""
    n = thick(chunk[3][2])
    u = np.empty_like(w)
    u[1:] = w[:-1]
    u[np.cumsum(n) - n] = START  # a text has one token at least
    at = np.flatnonzero((u >= 0) & (w >= 0)).astype(np.int32)
    pair = np.empty(len(at), dtype=np.int64)
    for a in range(0, len(at), STEP):
        some = at[a : a + STEP]
        pair[a : a + STEP] = by.pair(u[some].astype(np.int64), w[some].astype(np.int64))
    del u
    order = order_of(pair)
    at, pair = at[order], pair[order]
    del order
    first = np.flatnonzero(firsts(pair))
    return at, first, pair[first]


def paired(chunk: Row, by: Numbers) -> Iterator[Row]:
    """The distinct pairs of a chunk to their parts, with twice the times that each is learned, plus 1 if it stands in another text."""
    at, first, pair = pairs_of(chunk, words_of(chunk), by)
    if not len(pair):
        return
    learned = np.repeat(np.frombuffer(chunk[3][1], dtype=bool), thick(chunk[3][2]))[at]
    times = np.add.reduceat(learned, first, dtype=np.int64)
    times = times << 1 | (np.diff(np.append(first, len(at))) > times)
    del at, first, learned
    for part, some in by.sliced(pair):
        yield 0, part, chunk[2], [rising(pair[some]), thin(times[some])]


def merged(part: int, asked: list[Row]) -> Iterator[Row]:
    """Kind 2: their number, in place of to. Kind 0: the pairs of a part that were learned twice or more, or once and stand in a text that wasn't learned, with their times. Kind 1: for each chunk which of its pairs these are, and at which places."""
    found = [risen(r[3][0]) for r in asked]
    pair, bounds = joined(found), np.cumsum([0, *map(len, found)]).tolist()
    del found
    order = order_of(pair)
    pair, times = pair[order], joined([thick(r[3][1]) for r in asked])[order]
    first = np.flatnonzero(firsts(pair))
    c, other = np.add.reduceat(times >> 1, first), np.bitwise_or.reduceat(times & 1, first) > 0
    stay, every = (c > 1) | ((c == 1) & other), np.diff(np.append(first, len(pair)))
    pair = pair[first[stay]]
    del times, first
    yield 2, int(stay.sum()), part, []
    yield 0, part, part, [rising(pair), thin(c[stay])]
    of_row = np.empty(len(order), dtype=np.int32)
    of_row[order] = np.repeat(np.where(stay, np.cumsum(stay, dtype=np.int32), np.int32(0)), every)  # from 1
    del order
    for r, a, b in zip(asked, bounds, bounds[1:]):
        mine = of_row[a:b]
        yield 1, part, r[2], [thin(np.array([b - a])), np.packbits(mine > 0).tobytes(), rising(mine[mine > 0])]


class Part:
    """A part of the pairs: pair, times and tables (samples, pairs learned twice or more) and those pairs' words, by seats."""

    def __init__(self, row: Row, by: Numbers):
        self.pair, self.c = risen(row[3][0]), thick(row[3][1])
        self.many = np.flatnonzero(self.c > 1)
        u, w = by.words(self.pair[self.many])
        (self.contexts, self.context), (self.dishes, self.dish) = (np.unique(by.seat(x), return_inverse=True) for x in (u, w))
        self.tables = thick(row[3][2]).reshape(-1, len(self.many)) if len(row[3]) > 2 and len(self.many) else np.ones((1, len(self.many)), dtype=np.int64)


def told(row: Row, by: Numbers, start: bool) -> Iterator[Row]:
    """To the parts of the words: sums over the pairs of each dish and each context of the samples of tables; at the start of times and rows instead."""
    part = Part(row, by)
    values = [part.c[part.many], np.ones(len(part.many), dtype=np.int64)] if start else list(part.tables)
    told_to: dict[int, list[bytes]] = {}
    for i, (seats, of) in enumerate(((part.dishes, part.dish), (part.contexts, part.context))):
        sums = [np.bincount(of, v, minlength=len(seats)).astype(np.int64) for v in values]
        for to, some, place in by.seats(seats):
            told_to.setdefault(to, [thin(np.zeros(0, np.int64)), thin(np.zeros(0, np.int64))] * 2)[2 * i : 2 * i + 2] = [rising(place), thin(np.concatenate([s[some] for s in sums]))]
    for to, data in told_to.items():
        yield 0, to, row[1], data


def counted(row: Row, by: Numbers, starts: np.ndarray) -> Iterator[Row]:
    """The words' numbers and times, from ranges of hashes to their parts."""
    c = thick(row[3][1])
    yield 1, START % by.n_parts, row[1], [rising(c[:0]), thin(c[:0])]  # there is always a part with the start
    seat = by.seat(numbers(c, starts[row[1]]))
    order = np.argsort(seat)
    for to, some, place in by.seats(seat[order]):
        yield 1, to, row[1], [rising(place), thin(c[order][some])]


class Words:
    """A part of the words: times, of these those of pairs that are met once (as a dish, as a context), and samples of tables in all restaurants, in the parent and in the word's own."""

    def __init__(self, row: Row | None = None):
        if row is not None:
            self.n, self.alone, self.single, *more = (thick(x) for x in row[3])
            self.served, self.over, self.sat = (x.reshape(-1, len(self.n)) if len(self.n) else x.reshape(1, 0) for x in more)

    def row(self, part: int) -> Row:
        return 0, part, part, [thin(x) for x in (self.n, self.alone, self.single, self.served.ravel(), self.over.ravel(), self.sat.ravel())]


def reseated(part: int, old: list[Row], sums: list[Row], by: Numbers, base: float, parent: tuple[float, float], opened: float, seed: int, samples: int, n_starts: int = -1) -> Iterator[Row]:
    """Kind 0: the part of the words with what the pairs tell; 1: to each part of the pairs tables of its dishes, in all restaurants and the parent, and of its contexts; 2: the sums of tables below and in the parent.

    At the start (n_starts texts are learned) `old` has the words' times instead.
    """
    at_start = n_starts >= 0
    words = Words() if at_start else Words(old[0])
    if at_start:
        places = [risen(r[3][0]) for r in old]
        words.n = np.zeros(max([int(x[-1]) + 1 for x in places if len(x)], default=0), dtype=np.int64)
        if part == START % by.n_parts:
            words.n = np.append(words.n, 0)[: max(1, len(words.n))]
        for r, place in zip(old, places):
            words.n[place] = thick(r[3][1])
        if part == START % by.n_parts:
            words.n[START // by.n_parts] = n_starts
    asked = []
    totals = [np.zeros((samples + at_start, len(words.n)), dtype=np.int64) for _ in range(2)]
    for r in sums:
        dishes, contexts = risen(r[3][0]), risen(r[3][2])
        asked.append((dishes, contexts))
        for i, (place, value) in enumerate(((dishes, r[3][1]), (contexts, r[3][3]))):
            totals[i][:, place] += thick(value).reshape(len(totals[i]), len(place))
    if at_start:
        words.alone, words.single = (words.n - x[0] for x in totals)
        if part == START % by.n_parts:
            words.alone[START // by.n_parts] = 0
        totals = [x[1:] for x in totals]
    words.served, words.sat = words.alone + totals[0], words.single + totals[1]
    name = (np.arange(len(words.n), dtype=np.uint64) * np.uint64(by.n_parts) + np.uint64(part)) * np.uint64(0xD1342543DE82EF95)
    words.over = np.zeros_like(words.served)
    for i in range(len(words.served)):
        draw = np.stack([mix(name + np.uint64(1000 * seed + 10 * i + j + 1)) for j in (0, 1)]) / 2.0**64
        words.over[i] = parent_tables(words.served[i], base, parent, opened, draw)
    yield words.row(part)
    for r, (dishes, contexts) in zip(sums, asked):
        yield 1, r[2], part, [thin(words.served[0][dishes]), thin(words.over[0][dishes]), thin(words.sat.sum(axis=0)[contexts]), thin(np.array([len(words.sat)]))]
    yield 2, part, part, [thin(words.served.sum(axis=1)), thin(words.over.sum(axis=1))]


def sat_down(to: int, old: list[Row], answers: list[Row], by: Numbers, base: float, inner: tuple[float, float], over: tuple[float, float, float, float], burn: int, samples: int, moves: int, seed: int) -> Iterator[Row]:
    """The part of the pairs with new tables. It takes those of a word's other pairs as they are."""
    row = old[0]
    part = Part(row, by)
    s, o, t = (joined([thick(r[3][i]) for r in answers]) for i in range(3))
    several = np.repeat([thick(r[3][3])[0] for r in answers], [len(thick(r[3][2])) for r in answers]) if answers else t
    seats = np.zeros((0, samples), dtype=np.int64)
    if len(part.many):
        outer = inner[1] + inner[0] * (t / several)
        here = part.tables[0]
        elsewhere = s - np.bincount(part.dish, here, minlength=len(s)).astype(np.int64)
        seats = gibbs(part.c[part.many], part.dish, outer[part.context], base, inner, over, burn, samples, moves, seed, elsewhere, o, here, part.pair[part.many])
    yield 0, row[1], row[1], [*row[3][:2], thin(seats.T.ravel())]


def pairs_answered(part: int, old: list[Row], asked: list[Row], samples: int) -> Iterator[Row]:
    """To each chunk: which of its pairs are known, their times, and samples of their tables."""
    c = thick(old[0][3][1])
    many = np.flatnonzero(c > 1)
    tables = np.ones((samples, len(c)), dtype=np.int64)
    tables[:, many] = thick(old[0][3][2]).reshape(samples, len(many))
    for r in asked:
        place = risen(r[3][2]) - 1
        yield 1, r[2], part, [*r[3][:2], thin(c[place]), *(thin(t[place]) for t in tables)]


def words_asked(chunk: Row, by: Numbers) -> Iterator[Row]:
    for to, _, place in by.seats(seats_of(words_of(chunk), by)):
        yield 0, to, chunk[2], [rising(place)]


def seats_of(w: np.ndarray, by: Numbers) -> np.ndarray:
    return np.unique(by.seat(np.append(np.unique(w[w >= 0]).astype(np.int64), START)))


def words_answered(part: int, old: list[Row], asked: list[Row]) -> Iterator[Row]:
    words = Words(old[0])
    for r in asked:
        place = risen(r[3][0])
        yield 2, r[2], part, [thin(words.n[place]), *(thin(x[place]) for some in (words.served, words.over, words.sat) for x in some)]


def scored(chunk: Row, answers: list[Row], by: Numbers, inner: tuple[float, float], parent: tuple[float, float], served: list[float], opened: list[float], base: float) -> tuple[np.ndarray, ...]:
    """(keys, tokens, learned tokens, base score, score) of the chunk's texts."""
    d1, s1 = inner
    d0, s0 = parent
    samples = len(served)
    w, sizes = words_of(chunk), thick(chunk[3][2])
    known, told_words = ([r for r in answers if r[0] == k] for k in (1, 2))
    n, *state = (joined([thick(r[3][i]) for r in told_words]) for i in range(1 + 3 * samples))
    # terms of the words by place, then of a new word and one that is learned once (so that places -2 and -1 are theirs)
    rest = [(s0 + d0 * o) / (s0 + t) * base for t, o in zip(served, opened)]
    n = np.concatenate([n, [0, 1]])
    top = [np.concatenate([np.maximum(state[i] - d0 * state[samples + i], 0) / (s0 + served[i]) + rest[i], [rest[i], (1 - d0) / (s0 + served[i]) + rest[i]]]) for i in range(samples)]
    back = [np.concatenate([(s1 + d1 * state[2 * samples + i]) / (s1 + n[:-2]), [1.0, (s1 + d1) / (s1 + 1)]]) for i in range(samples)]
    # times and tables of the distinct pairs that are known, to their tokens
    found = joined([np.unpackbits(np.frombuffer(r[3][1], dtype=np.uint8), count=int(thick(r[3][0])[0])).astype(bool) for r in known], bool)
    c = joined([thick(r[3][2]) for r in known])
    more = c - d1 * sum((joined([thick(r[3][3 + i]) for r in known]) for i in range(samples)), np.zeros(len(c))) / samples
    at, first, pair = pairs_of(chunk, w, by)
    times = np.diff(np.append(first, len(at)))
    del first, pair
    at = at[np.repeat(found, times)]
    more = np.repeat(more, times[found])
    del times
    own = np.where(np.repeat(np.frombuffer(chunk[3][1], dtype=bool), sizes), 1 - d1, 0.0)  # a pair that isn't listed is met once, here
    for a in range(0, len(at), STEP):
        own[at[a : a + STEP]] = more[a : a + STEP]
    del at, more, found, c
    # words are found by an own sorted list of their numbers
    seats = seats_of(w, by)
    word = (seats & np.int64(0xFFFFFFFF)) * by.n_parts + (seats >> np.int64(32))
    order = np.argsort(word)
    word = word[order]
    begin = order[np.searchsorted(word, START)]
    starts = np.cumsum(sizes) - sizes
    last = begin
    for a in range(0, len(w), STEP):
        some = w[a : a + STEP].astype(np.int64)
        place = np.where(some >= 0, order[np.minimum(np.searchsorted(word, some), len(word) - 1)], some)
        before = np.insert(place[:-1], 0, last)
        before[starts[slice(*np.searchsorted(starts, (a, a + len(some))))] - a] = begin
        last = place[-1]
        p = own[a : a + STEP] * (1 / (s1 + n[before]))
        for i in range(samples):
            p += back[i][before] * top[i][place] / samples
        own[a : a + STEP] = np.log10(p)
    del w
    total = np.bincount(np.repeat(np.arange(len(sizes)), sizes), own, minlength=len(sizes)).astype(float)
    return np.frombuffer(chunk[3][0], dtype=np.int64), sizes, thick(chunk[3][4]), np.frombuffer(chunk[3][5], dtype=np.float64), total
