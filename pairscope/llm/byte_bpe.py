"""Operator 10, byte-level BPE by merge replay over the distinct words of blocks of the corpus, and its decoder.

The distinct words of a few blocks (a bounded number of new ones) become one chain of symbols. An inverted index leads from each merge to the positions of
its pair; merges are applied in rank order to all their positions at once (as arrays, so the steps of the interpreter grow
with the different merges and not with the positions), and only the touched neighbours change. A block is a bounded part of
a task's rows; words that the worker has met before are remembered with their ids (a bounded number), so no text or word
moves between tasks. The ids of a block are stated and decoded as arrays, too. A chain over one word table of the whole
corpus gives the same ids, but sending each block its words' ids takes several times the disk and processor time (figures in
README).

A merge may make a pair of lower rank than its own (a vocabulary need not be a list of merges). Then what comes after it in
its word waits until that pair has been applied, which keeps the order within each word exact.

Defined cases: a null or empty text has no ids, the digest of an empty string and decodes to nothing; repeated rows are
encoded alike, each in its row; a doc_id may be null; an empty table gives an empty result; other columns are kept under any
name (those named like results give way to them); a very long text is a block for itself.
"""

from __future__ import annotations

import base64
import bisect
import functools
import hashlib
import heapq
import itertools
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairscope.llm.pretokens import split
from pairscope.llm.store import chunks, documents, numbered, plus

BLOCK = 4 << 20  # bytes of text in a block
TOGETHER = 4  # blocks, at most, whose new words are replayed at once
NEW = 100_000  # new words that no further block is waited for
CACHE = 600_000  # words a worker remembers
STEP = 1 << 18  # ids that are stated and decoded at a time
NONE = 1 << 40  # above every rank: no merge


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def joined(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of ``flat`` one after another, and where each begins (one more: the end)."""
    ends = np.append(0, np.cumsum(sizes))
    return flat[np.arange(ends[-1]) + np.repeat(starts - ends[:-1], sizes)], ends


class Pieces:
    """Strings of bytes by number, one after another."""

    def __init__(self, pieces: list[bytes]):
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)
        self.sizes = np.array([len(b) for b in pieces], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def digests(self, ids: np.ndarray, ends: np.ndarray, left_out: int = 0) -> list[str]:
        """SHA-256 of each text's pieces, without the last ``left_out`` bytes; some ids at a time, however long a text is."""
        found, ends = [hashlib.sha256() for _ in ends[1:]], ends.tolist()
        for lo in range(0, len(ids), STEP):
            some = ids[lo : lo + STEP]
            flat, begin = joined(self.flat, self.starts[some], self.sizes[some])
            hi = lo + len(some)
            k = bisect.bisect_right(ends, lo) - 1
            while k < len(found) and ends[k] < hi:
                a, b = max(ends[k], lo), min(ends[k + 1], hi)
                if a < b:
                    found[k].update(flat[begin[a - lo] : begin[b - lo] - (left_out if b == ends[k + 1] else 0)])
                k += 1
        return [f.hexdigest() for f in found]


class Merges:
    """For each symbol, the symbols that it can merge with on one side (in order), and the ranks of these merges."""

    def __init__(self, symbol: np.ndarray, other: np.ndarray, rank: np.ndarray, n: int):
        order = np.lexsort((other, symbol))
        self.other, self.rank = other[order], rank[order]
        self.starts = np.searchsorted(symbol[order], np.arange(n + 1)).tolist()

    def ranks(self, symbol: int, others: np.ndarray) -> np.ndarray:
        """The ranks of the symbol's merges with ``others``."""
        lo, hi = self.starts[symbol], self.starts[symbol + 1]
        if lo == hi:
            return np.full(len(others), NONE)
        row = self.other[lo:hi]
        k = row[:-1].searchsorted(others)
        return np.where(row[k] == others, self.rank[lo:hi][k], NONE)


class MergeReplay:
    def __init__(self, ranks: dict[bytes, int]):
        bytes_of = {i: b for b, i in ranks.items()}
        every = range(max(bytes_of) + 1)
        self.bytes_of = bytes_of
        self.back = Pieces([bytes_of.get(i, b"") for i in every])
        self.stated = Pieces([b"%d," % i for i in every])
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.first_rank = np.array([[ranks.get(bytes([a, b]), NONE) for b in range(256)] for a in range(256)], np.int64)
        halves = ((ranks.get(b[:k]), ranks.get(b[k:]), i) for b, i in ranks.items() for k in range(1, len(b)))
        first, second, made = np.array([h for h in halves if None not in h], np.int64).reshape(-1, 3).T
        self.with_next, self.with_last = Merges(first, second, made, len(every)), Merges(second, first, made, len(every))
        self.forget()

    def forget(self) -> None:
        """Words are numbered as they come; the ids of each stand in ``flat`` from ``starts``."""
        self.known: dict[str, int] = defaultdict(itertools.count().__next__)
        self.flat, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct, non-empty words one after another, and how many each has."""
        text = np.frombuffer(b"".join(words), np.uint8)
        n = len(text)
        ends = np.cumsum([len(w) for w in words])
        starts = np.append(0, ends[:-1])
        # position n stands for what is before a word's first and after its last symbol; symbols that are merged away are -1, too
        symbol = np.append(self.byte_ids[text], -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends - 1] = before[starts] = n
        merge = np.full(n + 1, NONE)  # the rank of a position's merge with the next one
        merge[: n - 1] = self.first_rank[text[:-1], text[1:]]
        merge[ends - 1] = NONE
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(at: np.ndarray, rank: np.ndarray) -> None:
            if not len(at):
                return
            order = rank.argsort()
            at, rank = at[order], rank[order]
            cuts = [0, *((rank[1:] != rank[:-1]).nonzero()[0] + 1).tolist(), len(rank)]
            for r, lo, hi in zip(rank[cuts[:-1]].tolist(), cuts, cuts[1:]):
                if r == NONE:
                    break
                if r not in index:
                    heapq.heappush(heap, r)
                    index[r] = []
                index[r].append(at[lo:hi])

        enter(np.arange(n), merge[:n])
        while heap:
            r = heapq.heappop(heap)
            at = np.concatenate(index.pop(r))
            at = at[merge[at] == r]  # not those that a neighbour has changed since
            if not len(at):
                continue
            at.sort()
            every = at
            q = after[at]
            if (overlaps := q[:-1] == at[1:]).any():  # of a run of overlapping ones each second
                k = np.arange(len(at))
                at = at[(k - np.maximum.accumulate(np.where(np.append(False, overlaps), 0, k))) % 2 == 0]
                q = after[at]
            following, leading = after[q], before[at]
            left = symbol[leading]
            left[1:][leading[1:] == q[:-1]] = r  # made just now
            x, y = self.with_next.ranks(r, symbol[following]), self.with_last.ranks(r, left)
            if x.min() < r or y.min() < r:  # what comes after a lower one in its word waits
                lower = np.minimum(x, y) < r
                word = np.searchsorted(ends, at, "right")
                earlier = np.cumsum(lower) - lower
                now = earlier == earlier[np.searchsorted(word, word)]
                waiting = every[np.isin(np.searchsorted(ends, every, "right"), word[~now])]
                enter(waiting, np.full(len(waiting), r))
                at, q, following, x, y = at[now], q[now], following[now], x[now], y[now]
            symbol[at], symbol[q] = r, -1
            after[at], before[following] = following, at
            merge[q], merge[at] = NONE, x
            leading = before[at]
            merge[leading] = y
            x = x < NONE
            x[:-1] &= leading[1:] != at[:-1]  # those are among the leading ones
            changed = np.concatenate([at[x], leading[y < NONE]])
            enter(changed, merge[changed])
        stays = symbol[:n] >= 0
        return symbol[:n][stays].astype(np.int32), np.add.reduceat(stays, starts, dtype=np.int64)

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def unlearnt(self) -> int:
        return len(self.known) - len(self.sizes)

    def learn(self) -> None:
        """Finds the ids of the words that have a number only."""
        if new := [w.encode() for w in itertools.islice(self.known, len(self.sizes), None)]:
            flat, sizes = self.replay(new)
            self.flat, self.sizes = np.append(self.flat, flat), np.append(self.sizes, sizes)
            self.starts = np.cumsum(self.sizes) - self.sizes

    def ids(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after another, and where each word's begin (one more: the end)."""
        return joined(self.flat, self.starts[number], self.sizes[number])


@functools.cache
def merge_replay(path: str) -> MergeReplay:
    return MergeReplay(read_ranks(path))


def pooled(coder: MergeReplay, texts: pa.Array):
    """Yields lists of blocks whose words the coder has learnt: first row, last row + 1, the words' numbers, each text's bounds."""
    read = []
    for lo, hi, *_ in chunks(texts, BLOCK):
        if not read and len(coder.known) > CACHE:
            coder.forget()
        words, counts = split([t or "" for t in texts.slice(lo, hi - lo).to_pylist()])
        read.append((lo, hi, coder.numbers(words), np.append(0, np.cumsum(counts))))
        del words
        if len(read) == TOGETHER or coder.unlearnt() > NEW:
            coder.learn()
            yield read
            read = []
    if read:
        coder.learn()
        yield read


def _encoded(docs: DataFrame, at: int, ranks: str, fields: str, result) -> DataFrame:
    """``docs`` and the columns ``fields``, made by ``result(ids, ends)`` of each block: the ids of its texts one after
    another, and where each text's begin (one more: the end)."""
    columns, names = docs.columns, [f.split(" ")[0] for f in fields.split(", ")]

    def run(batches):
        coder = merge_replay(ranks)
        for batch in batches:
            for read in pooled(coder, batch.column(at)):
                for lo, hi, number, bounds in read:
                    rows = batch.slice(lo, hi - lo)
                    ids, ends = coder.ids(number)
                    yield pa.RecordBatch.from_arrays([*rows.columns, *result(ids, ends[bounds])], names=[*columns, *names])

    return docs.mapInArrow(run, plus(docs.schema, fields))


def _prepared(docs: DataFrame, text: str, results: list[str]) -> tuple[DataFrame, list[str], int]:
    own, names = numbered(docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in results)))
    return own, names, names.index(text)


def with_ids(docs: DataFrame, ranks: str, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``ids``, the ids of each text."""
    own, names, at = _prepared(docs, text, ["ids"])

    def result(ids, ends):
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))]

    return _encoded(own, at, ranks, "ids array<int>", result).toDF(*names, "ids")


def decoded(coded: DataFrame, ranks: str, ids: str = "ids") -> DataFrame:
    """All columns of ``coded`` (but one of that name) and ``decoded``, the bytes that the ids stand for (null: none)."""
    own, names, at = _prepared(coded, ids, ["decoded"])
    columns = own.columns

    def run(batches):
        bytes_of = merge_replay(ranks).bytes_of
        for batch in batches:
            out = pa.array([b"".join(map(bytes_of.__getitem__, i or ())) for i in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*columns, "decoded"])

    return own.mapInArrow(run, plus(own.schema, "decoded binary")).toDF(*names, "decoded")


RESULTS = ["n_tokens", "ids_sha256", "decoded_sha256"]


def with_digests(docs: DataFrame, ranks: str, text: str = "text") -> DataFrame:
    """All columns of ``docs``, and of each text its number of ids and the digests of its ids and of what they decode to."""
    own, names, at = _prepared(docs, text, RESULTS)

    def result(ids, ends):
        coder = merge_replay(ranks)
        ids_sha, back_sha = coder.stated.digests(ids, ends, left_out=1), coder.back.digests(ids, ends)
        return [pa.array(np.diff(ends), pa.int64()), pa.array(ids_sha, pa.string()), pa.array(back_sha, pa.string())]

    return _encoded(own, at, ranks, "n_tokens long, ids_sha256 string, decoded_sha256 string", result).toDF(*names, *RESULTS)


def op10_byte_bpe(spark: SparkSession, sf_dir: str, ranks: str | None = None) -> DataFrame:
    return with_digests(documents(spark, sf_dir).select("doc_id", "text"), ranks or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).drop("text")
