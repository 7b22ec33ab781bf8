"""Byte-pair merging over a piece vocabulary: token counts, and encoding with decoding.

The vocabulary (pieces, scores, byte pieces) is read from a model file; merging and decoding are done here.
No piece of such a vocabulary has the word marker after another character, so merges never cross the start of a
marked chunk (`▁` run and what follows it up to the next `▁`), and every distinct chunk needs one segmentation.
`Vocabulary` checks that property and treats the whole text as one chunk where it does not hold.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajecta.llm.arrowtext import blocks, buffers, gathered, hashes, strings
from trajecta.llm.scratch import Scratch, plain

MARK = "▁"
_CHUNKS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: A worker keeps the segmentations of so many chunks of at most KEPT_CHARS characters; others are made anew.
KEPT_CHUNKS, KEPT_CHARS = 400_000, 48
#: Least share of all chunks of one that is looked up in a table that every task has: at most 2,000,000 chunks.
COMMON = 5e-7
#: Chunks that a task holds before it sums them up.
HELD = 1_000_000
#: Up to so many symbols a chunk is merged by scanning its pairs, above that by the heap.
SCANNED = 40


class Vocabulary:
    """Pieces and merge ranks of a model file. rank: lower merges first."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        self.text: list[str | int] = []  # of each id: its text, or the value of its byte
        self.byte: list[int] = [0] * 256
        crossing = False
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte[value] = i
                self.text.append(value)
            elif model.is_control(i):
                self.text.append("")
            elif model.is_unknown(i):
                self.text.append(" ⁇ ")
            else:
                self.ids[piece] = i
                self.rank[piece] = -model.get_score(i)
                self.text.append(piece.replace(MARK, " "))
                crossing |= MARK in piece.lstrip(MARK)
        self.end = model.eos_id()
        self.whole = crossing

    def chunks(self, text: str) -> list[str]:
        """The marked chunks of a text; their concatenation is the text with a leading marker and marked spaces."""
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        return [marked] if self.whole else _CHUNKS.findall(marked)

    def weight(self, symbol: str) -> int:
        """Tokens of a symbol: one, or its UTF-8 bytes where the vocabulary lacks it."""
        return 1 if symbol in self.ids else len(symbol.encode("utf-8"))

    def merged(self, chunk: str) -> tuple[list[str], int, int]:
        """Final symbols, tokens of the initial symbols, and tokens that merges removed: a heap of adjacent pairs over a linked list."""
        rank = self.rank
        symbols: list[str] = list(chunk)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, int, int]] = []
        for i in range(n - 1):
            r = rank.get(symbols[i] + symbols[i + 1])
            if r is not None:
                heap.append((r, i, i + 1, 2))
        heapq.heapify(heap)
        initial = sum(map(self.weight, symbols))
        removed = 0
        while heap:
            _, left, right, size = heapq.heappop(heap)
            a, b = symbols[left], symbols[right]
            if not a or not b or len(a) + len(b) != size:
                continue  # one of the two has been merged meanwhile
            removed += self.weight(a) + self.weight(b) - 1
            symbols[left], symbols[right] = a + b, ""
            after[left] = j = after[right]
            if j < n:
                before[j] = left
                r = rank.get(symbols[left] + symbols[j])
                if r is not None:
                    heapq.heappush(heap, (r, left, j, size + len(symbols[j])))
            i = before[left]
            if i >= 0:
                r = rank.get(symbols[i] + symbols[left])
                if r is not None:
                    heapq.heappush(heap, (r, i, left, size + len(symbols[i])))
        return [s for s in symbols if s], initial, removed

    def segment(self, chunk: str) -> list[int]:
        """Ids of a chunk."""
        if len(chunk) > SCANNED:
            symbols = self.merged(chunk)[0]
        else:
            rank, never = self.rank, float("inf")
            symbols = list(chunk)
            ranks = [rank.get(a + b, never) for a, b in zip(symbols, symbols[1:])]
            while ranks and (least := min(ranks)) != never:
                i = ranks.index(least)
                symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
                del ranks[i]
                if i:
                    ranks[i - 1] = rank.get(symbols[i - 1] + symbols[i], never)
                if i < len(ranks):
                    ranks[i] = rank.get(symbols[i] + symbols[i + 1], never)
        ids = self.ids
        out: list[int] = []
        for s in symbols:
            i = ids.get(s)
            if i is not None:
                out.append(i)
            else:
                out.extend(self.byte[b] for b in s.encode("utf-8"))
        return out

    def plain(self, ids: list[int]) -> str:
        """Text of the ids, byte pieces put together as UTF-8 (U+FFFD for bytes that are none)."""
        out: list[str] = []
        held = bytearray()
        for i in ids:
            t = self.text[i]
            if isinstance(t, int):
                held.append(t)
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(t)
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """Text of a whole encoding: without the space of the leading marker."""
        return self.plain(ids).removeprefix(" ")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class _Kept(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, chunk: str):
        made = self.make(chunk)
        if len(self) < KEPT_CHUNKS and len(chunk) <= KEPT_CHARS:
            self[chunk] = made
        return made


@lru_cache(maxsize=4)
def _counts(path: str) -> _Kept:
    merged = vocabulary(path).merged

    def tokens(chunk: str) -> int:
        _, initial, removed = merged(chunk)
        return initial - removed

    return _Kept(tokens)


def count_tokens(docs: DataFrame, path: str, text: str = "text", n_bytes: str = "n_bytes", n_tokens: str = "n_tokens") -> DataFrame:
    """`docs` with the UTF-8 length and the token count of each whole text, in place of equally named columns.

    A count is the number of initial symbols less the number of merges. Null and empty texts have 0 bytes and 0 tokens;
    every row is counted on its own, so repeated rows give repeated counts. No shuffle; memory is bounded by KEPT_CHUNKS.
    """
    kept_names = [c for c in docs.columns if c not in (n_bytes, n_tokens)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, counts = vocabulary(path), _counts(path)
        known = counts.__getitem__
        for batch in batches:
            sizes, tokens = [], []
            for t in batch.column(len(kept_names)).to_pylist():
                sizes.append(len(t.encode("utf-8")) if t else 0)
                tokens.append(sum(map(known, v.chunks(t))) if t else 0)
            rest = [batch.column(i) for i in range(len(kept_names))]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], names=[*kept_names, n_bytes, n_tokens])

    picked = docs.select(*(plain(c).alias(f"k{i}") for i, c in enumerate(kept_names)), plain(text).alias("__text"))
    fields = docs.select(*map(plain, kept_names)).schema.add(n_bytes, "long").add(n_tokens, "long")
    return picked.mapInArrow(run, fields)


class Segments:
    """Ids and plain text of chunks, one after the other; `h`: sorted hashes of the chunks."""

    def __init__(self, v: Vocabulary, h: np.ndarray, chunks: list[str]):
        order = np.argsort(h)
        self.h = h[order]
        ids = [v.segment(chunks[i].replace(" ", MARK)) for i in order]
        plain = [v.plain(x).encode("utf-8") for x in ids]
        self.n_ids, self.n_plain = (np.array([len(x) for x in y], dtype=np.int64) for y in (ids, plain))
        self.ids = np.array([i for x in ids for i in x], dtype=np.int32)
        self.plain = np.frombuffer(b"".join(plain), dtype=np.uint8)
        self.at_ids, self.at_plain = np.cumsum(self.n_ids) - self.n_ids, np.cumsum(self.n_plain) - self.n_plain

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 where there is none."""
        if not len(self.h):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[at] == h, at, -1)


def _marked(column: pa.Array, whole: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, last + 1, bytes, text, start, end, hash) of the chunks of blocks of texts, each of which begins with a space or is empty.

    A chunk begins at a marker (a space, or the character that stands for it) that doesn't follow another.
    """
    for a, b, raw, at in blocks(column):
        mark = raw == 0x20
        for p in np.flatnonzero(raw[:-2] == 0xE2):
            if raw[p + 1] == 0x96 and raw[p + 2] == 0x81:
                mark[p : p + 3] = True
        begins = mark.copy()
        begins[1:] &= ~mark[:-1]
        if whole:
            begins[:] = False
        begins[at[:-1][at[1:] > at[:-1]]] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(raw)) if len(start) else start
        yield a, b, raw, np.searchsorted(at, start, "right") - 1, start, end, hashes(raw, start, end).view(np.int64)


def _chunk_table(texts: DataFrame, path: str) -> DataFrame:
    """(chunk, n): every distinct chunk of `texts` (text), and how often it occurs. Tasks sum up what they hold before it is dealt by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = vocabulary(path).whole
        held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        size = 0

        def summed() -> pa.RecordBatch:
            h, n, text = (np.concatenate(x) if k < 2 else pa.concat_arrays(x) for k, x in enumerate(zip(*held)))
            order = np.argsort(h, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
            return pa.RecordBatch.from_arrays([text.take(pa.array(order[first])), pa.array(np.add.reduceat(n[order], first))], names=["chunk", "n"])

        for batch in batches:
            for _, _, raw, _, start, end, h in _marked(batch.column(0), whole):
                h, first, n = np.unique(h, return_index=True, return_counts=True)
                if not len(h):
                    continue
                held.append((h, n, strings(raw, start[first], end[first] - start[first])))
                size += len(h)
                if size >= HELD:
                    yield summed()
                    held, size = [], 0
        if held:
            yield summed()

    return texts.mapInArrow(run, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))


def _segmented(chunks: DataFrame, path: str) -> Segments:
    """The segments of the chunks, each made once; `chunks` are at most 1 / COMMON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = buffers(batch.column(0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes(raw, at[:-1], at[1:]).view(np.int64))], names=["chunk", "h"])

    got = chunks.select("chunk").mapInArrow(run, "chunk string, h long").toArrow()
    return Segments(vocabulary(path), got["h"].to_numpy(), got["chunk"].to_pylist())


def encode_decode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = True, decoded: bool = True, digests: bool = False, common: float = COMMON) -> DataFrame:
    """The columns `keep` of `docs` with the encoding of each whole text, an end id last, and what decoding it gives.

    n_tokens always; ids (array) and decoded (text) if asked for, or their SHA-256 digests (ids in decimal, joined by a space).
    Null and empty texts encode to the end id alone and decode to the empty text; repeated rows have equal results; a kept
    column with the name of a result gives way to it.

    A table of the distinct chunks of the whole corpus is made first. Those of at least the share `common` of all chunks are
    segmented once, and every task looks them up by their hash; a text's ids are its chunks' ids put together by position.
    Of chunks under that share, which are too many for one machine, a task segments each once for each block of texts that has it.
    """
    results = ["n_tokens", *(["ids"] if ids else []), *(["decoded"] if decoded else []), *(["ids_sha256", "decoded_sha256"] if digests else [])]
    kept = [c for c in keep if c not in results]
    kinds = {"n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType())}
    fields = docs.select(*map(plain, kept)).schema
    for c in results:
        fields = fields.add(c, kinds.get(c, T.StringType()))
    spark = docs.sparkSession
    marked = F.when(F.length(plain(text)) > 0, F.concat(F.lit(" "), plain(text))).otherwise(F.lit(""))
    scratch = Scratch(spark, "pieces")
    table = scratch.table(_chunk_table(docs.select(marked.alias("text")), path))
    least = common * (table.agg(F.sum("n")).first()[0] or 0)
    shared = spark.sparkContext.broadcast(_segmented(table.where(F.col("n") >= F.lit(least)), path))
    scratch.drop(table)
    n_kept = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, known = vocabulary(path), shared.value
        decimal = [str(i) for i in range(len(v.text))]
        for batch in batches:
            for a, b, raw, owner, start, end, h in _marked(batch.column(n_kept), v.whole):
                at = known.find(h)
                there = at >= 0
                _, first, of = np.unique(h[~there], return_index=True, return_inverse=True)
                rare = np.flatnonzero(~there)[first]
                own = Segments(v, np.arange(len(rare)), strings(raw, start[rare], end[rare] - start[rare]).to_pylist())
                n_ids, n_plain = np.empty(len(h), dtype=np.int64), np.empty(len(h), dtype=np.int64)
                n_ids[there], n_ids[~there] = known.n_ids[at[there]], own.n_ids[of]
                n_plain[there], n_plain[~there] = known.n_plain[at[there]], own.n_plain[of]
                flat, back = np.empty(int(n_ids.sum()), dtype=np.int32), np.empty(int(n_plain.sum()), dtype=np.uint8)
                for some, place, by in ((there, at[there], known), (~there, of, own)):
                    for out, size, source, starts in ((flat, n_ids, by.ids, by.at_ids), (back, n_plain, by.plain, by.at_plain)):
                        out[np.repeat(some, size)] = gathered(source, starts[place], size[some])
                cut_ids, cut_plain = (np.concatenate([[0], np.cumsum(np.bincount(owner, x, minlength=b - a))]).astype(np.int64) for x in (n_ids, n_plain))
                out = {"n_tokens": pa.array(np.diff(cut_ids) + 1)}
                if ids:
                    with_end = np.insert(flat, cut_ids[1:], v.end)
                    out["ids"] = pa.ListArray.from_arrays(pa.array((cut_ids + np.arange(b - a + 1)).astype(np.int32)), pa.array(with_end))
                if decoded or digests:
                    begin = cut_plain[:-1] + ((cut_plain[1:] > cut_plain[:-1]) & (np.append(back, 0)[cut_plain[:-1]] == 0x20))
                    if decoded:
                        out["decoded"] = strings(back, begin, cut_plain[1:] - begin)
                if digests:
                    listed, whole_back = flat.tolist(), back.tobytes()
                    ends = decimal[v.end]
                    out["ids_sha256"] = pa.array([hashlib.sha256(" ".join([*[decimal[i] for i in listed[x:y]], ends]).encode()).hexdigest() for x, y in zip(cut_ids[:-1], cut_ids[1:])], pa.string())
                    out["decoded_sha256"] = pa.array([hashlib.sha256(whole_back[x:y]).hexdigest() for x, y in zip(begin, cut_plain[1:])], pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(n_kept)), *(out[c] for c in results)], names=fields.names)

    return docs.select(*(plain(c).alias(f"k{i}") for i, c in enumerate(kept)), marked.alias("__text")).mapInArrow(run, fields)


def decode(frame: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`frame` with the text of each row's ids; null ids give a null text."""

    @F.pandas_udf("string")
    def back(column):
        v = vocabulary(path)
        return column.map(lambda x: None if x is None else v.decode([int(i) for i in x]))

    return frame.withColumn(out, back(F.col(ids)))
