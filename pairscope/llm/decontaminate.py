"""Operator 1, benchmark decontamination by the q-gram lemma and banded alignment.

Texts are compared in lower case with every row of spaces and ASCII punctuation as one space, and one space before and after
each text, so that words are whole at the ends of an item. An item of m bytes is found where a stretch of a document differs
from it by at most e = floor(``RATE`` * m) edits (its m + 2 bytes with the spaces count). Such a stretch shares at least
m + 2 - q + 1 - q * e q-grams with the item, on diagonals (place in the document less place in the item) that lie at most e
apart. So shared q-grams are counted in bands of 2e + 1 diagonals that start every e + 1 diagonals and overlap by e: one
band holds all of them. Bands that reach the bound are aligned, a row of the item at a time for all of them together.
q is ``Q``, or for an item too short for that the largest that leaves a bound of 1, (m + 2) // (e + 1): the method and
the edits are the same at every length.

The benchmark goes to the tasks in blocks of about ``BLOCK`` bytes (its hash decides a row's block), each against all
documents, and no document is shuffled. A block's index is made once, with the bits that pass over most q-grams, and a worker
reads it once. Its broadcast is released before the next one is made, so what tasks hold has a bound whatever the benchmark's
size; a benchmark of n blocks costs n passes.

Defined cases: null and empty texts and items match nothing; repeated rows are answered each; other columns, under any name,
are neither read nor lost (``without_leaks``); an empty benchmark finds nothing; a very long text is a chunk for itself, and is
searched whole; very long items are aligned fewer at a time.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairscope.llm.repeats import span, sums
from pairscope.llm.store import as_table, chunks, documents, free

Q = 10
RATE = 0.07
BLOCK = 16 << 20  # a worker holds about 20 bytes of index for each byte of a block
CELLS = 1 << 21  # of the tables that are aligned together
_MAP = np.array([c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256)], np.uint8)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def normal(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes as they are compared; each text begins and ends with one space (an empty one is a space)."""
    n = len(offsets) - 1
    starts = offsets + 2 * np.arange(n + 1)
    wide = np.full(len(data) + 2 * n, 32, np.uint8)
    body = np.ones(len(wide), bool)
    body[starts[:-1]] = body[starts[1:] - 1] = False
    wide[body] = _MAP[data]
    space = wide == 32
    drop = space.copy()
    drop[1:] &= space[:-1]
    drop[starts[:-1]] = False
    kept = np.concatenate([[0], np.cumsum(~drop)])
    return wide[~drop], kept[starts]


def grams(data: np.ndarray, q: int) -> np.ndarray:
    total = sums(data.astype(np.uint64) + np.uint64(1))
    at = np.arange(max(0, len(data) - q + 1))
    h = span(total, at, at + q) * _MIX
    return (h ^ (h >> np.uint64(29))) * _MIX


@dataclass(frozen=True)
class Index:
    """Of items with one q: q-grams in order with their items and places."""

    ids: list
    texts: list[bytes]
    q: int
    gram: np.ndarray
    item: np.ndarray
    place: np.ndarray
    marks: np.ndarray  # bits, by a q-gram's first bits: most q-grams of no item have none
    sizes: np.ndarray
    budget: np.ndarray
    bound: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple], q: int, rate: float) -> list[Index]:
        """Of a block of the benchmark: an index for each q that its items need."""
        groups: dict[int, list[tuple]] = {}
        for item_id, text in rows:
            data = np.frombuffer((text or "").encode(), np.uint8)
            own = normal(data, np.array([0, len(data)]))[0].tobytes()
            if len(own) > 1:
                budget = math.floor(rate * (len(own) - 2))
                groups.setdefault(min(q, len(own) // (budget + 1)), []).append((item_id, own, budget))
        return [cls._of(group, k) for k, group in sorted(groups.items())]

    @classmethod
    def _of(cls, group: list[tuple], q: int) -> Index:
        ids, texts, budget = zip(*group)
        sizes, budget = np.array([len(t) for t in texts], np.int64), np.array(budget, np.int64)
        found = [grams(np.frombuffer(t, np.uint8), q) for t in texts]
        item = np.repeat(np.arange(len(texts), dtype=np.int32), [len(g) for g in found])
        place = np.concatenate([np.arange(len(g), dtype=np.int32) for g in found])
        gram = np.concatenate(found)
        by = np.argsort(gram, kind="stable")
        bits = max(20, math.ceil(math.log2(len(gram) * 16 + 1)))
        marks = np.zeros(1 << bits, bool)
        marks[gram >> np.uint64(64 - bits)] = True
        return cls(list(ids), list(texts), q, gram[by], item[by], place[by], np.packbits(marks, bitorder="little"), sizes, budget, sizes - q + 1 - q * budget)

    def marked(self, gram: np.ndarray) -> np.ndarray:
        """Places of the q-grams that have a mark."""
        slot = gram >> np.uint64(61 - int(math.log2(len(self.marks))))
        return np.flatnonzero(self.marks[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)


def _bands(index: Index, data: np.ndarray, offsets: np.ndarray):
    """(document, item, first diagonal, shared q-grams) of bands that reach the bound."""
    gram = grams(data, index.q)
    at = index.marked(gram)
    lo, hi = np.searchsorted(index.gram, gram[at], "left"), np.searchsorted(index.gram, gram[at], "right")
    some = hi > lo
    at, lo, many = at[some], lo[some], (hi - lo)[some]
    doc = np.searchsorted(offsets, at, "right") - 1
    inside = at + index.q <= offsets[doc + 1]
    at, lo, many, doc = at[inside], lo[inside], many[inside], doc[inside]
    keys, counts = [], []
    edges = np.searchsorted(np.cumsum(many), np.arange(0, many.sum() + 2_000_000, 2_000_000))
    spread = int(offsets[-1]) + int(index.sizes.max(initial=0)) + 1
    for a, b in zip(edges[:-1], np.append(edges[1:-1], len(many))):
        n = many[a:b]
        if not len(n):
            continue
        which = np.repeat(np.arange(a, b), n)
        entry = lo[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        item = index.item[entry]
        e = index.budget[item]
        diagonal = at[which] - offsets[doc[which]] - index.place[entry] + int(index.sizes.max())
        band, rest = diagonal // (e + 1), diagonal % (e + 1)
        key = (doc[which] * len(index.ids) + item) * spread * 2 + band
        key = np.concatenate([key, key[(rest < e) & (band > 0)] - 1])
        k, c = np.unique(key, return_counts=True)
        keys.append(k)
        counts.append(c)
    if not keys:
        return ()
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.bincount(at, np.concatenate(counts)).astype(np.int64)
    owner, band = key // (spread * 2), key % (spread * 2)
    doc, item = owner // len(index.ids), owner % len(index.ids)
    ok = count >= index.bound[item]
    return doc[ok], item[ok], band[ok] * (index.budget[item[ok]] + 1) - int(index.sizes.max()), count[ok]


def distances(items: list[bytes], data: np.ndarray, starts: np.ndarray, stops: np.ndarray, first: np.ndarray, budget: int) -> np.ndarray:
    """Least edits of each item against stretches of its text (starts to stops in data) that begin on the 2e + 1 diagonals
    from ``first`` on and leave them by at most e on either side."""
    width = 4 * budget + 1
    sizes = np.array([len(t) for t in items])
    longest = int(sizes.max())
    rows = np.zeros((len(items), longest), np.uint8)
    for k, t in enumerate(items):
        rows[k, : len(t)] = np.frombuffer(t, np.uint8)
    step = np.arange(width)
    begin = first - budget  # diagonal of column 0
    far = 1 << 20
    cost = np.zeros((len(items), width), np.int64)
    out = np.full(len(items), far)
    for i in range(longest):
        place = starts[:, None] + begin[:, None] + i + step  # the byte that a match or change would use
        inside = (place >= starts[:, None]) & (place < stops[:, None])
        sign = np.where(inside, data[np.clip(place, 0, len(data) - 1)], 0)
        turn = np.where(inside, cost + (sign != rows[:, i : i + 1]), far)
        turn[:, :-1] = np.minimum(turn[:, :-1], cost[:, 1:] + 1)
        grown = np.minimum.accumulate(turn - step, axis=1) + step
        cost = np.where(inside, grown, turn)  # what stands outside the text is never added to a stretch
        ended = sizes == i + 1
        out[ended] = cost[ended].min(axis=1)
    return out


def leaks(indexes: list[Index], data: np.ndarray, offsets: np.ndarray) -> list[tuple]:
    """(document, item_id, edits, shared q-grams) for a chunk of texts."""
    data, offsets = normal(data, offsets)
    return [(d, index.ids[k], x, c) for index in indexes for d, k, x, c in _leaks(index, data, offsets)]


def _leaks(index: Index, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
    best: dict[tuple[int, int], tuple[int, int]] = {}
    if len(found := _bands(index, data, offsets)):
        doc, item, first, count = found
        exact = np.zeros(len(doc), bool)
        for j, (d, k, f) in enumerate(zip(doc.tolist(), item.tolist(), first.tolist())):
            e, size = int(index.budget[k]), int(index.sizes[k])
            stretch = data[offsets[d] + max(0, f) : min(offsets[d + 1], offsets[d] + max(0, f + 2 * e + 1 + size))]
            if index.texts[k] in stretch.tobytes():  # the alignment without edits
                exact[j] = True
                best[d, k] = min(best.get((d, k), (0, 0)), (0, -int(count[j])))
        doc, item, first, count = doc[~exact], item[~exact], first[~exact], count[~exact]
        for e in np.unique(index.budget[item]):
            own = np.flatnonzero(index.budget[item] == e)
            together = int(min(512, max(1, CELLS // (4 * e + 1 + index.sizes[item[own]].max()))))
            for lo in range(0, len(own), together):
                some = own[lo : lo + together]
                edits = distances([index.texts[k] for k in item[some]], data, offsets[doc[some]], offsets[doc[some] + 1], first[some], int(e))
                for d, k, x, c in zip(doc[some].tolist(), item[some].tolist(), edits.tolist(), count[some].tolist()):
                    if x <= e:
                        best[d, k] = min(best.get((d, k), (x, -c)), (x, -c))
    return [(d, k, x, -c) for (d, k), (x, c) in sorted(best.items())]


def _blocks(benchmark: DataFrame, q: int, rate: float, block: int):
    """The broadcast indexes of each block of the benchmark, and whether it is the last one."""
    items = benchmark.select("item_id", "text").where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, math.ceil(size / block))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text")
        yield benchmark.sparkSession.sparkContext.broadcast(Index.of([tuple(r) for r in rows.collect()], q, rate)), k == n - 1  # about ``block`` bytes


def find_leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, edits, n_shared of each document and item that it holds."""
    docs = docs.select("doc_id", "text")
    shape = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, edits long, n_shared long"
    out = None
    for shared, _ in _blocks(benchmark, q, rate, block):

        def run(batches, shared=shared):
            indexes = shared.value  # kept by the worker for all its tasks
            for batch in batches:
                rows = []
                for lo, _, data, offsets in chunks(batch.column("text"), 1 << 19):
                    rows += [(lo + d, *found) for d, *found in leaks(indexes, data, offsets)]
                if rows:
                    at, ids, edits, count = zip(*rows)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), pa.array(ids), pa.array(edits, pa.int64()), pa.array(count, pa.int64())], names=["doc_id", "item_id", "edits", "n_shared"])

        found = as_table(docs.mapInArrow(run, shape), "leaks")
        shared.unpersist()
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns. Between two blocks the rows that are left are a table."""
    at, held = docs.columns.index("text"), None
    for shared, last in _blocks(benchmark, q, rate, block):

        def run(batches, shared=shared):
            indexes = shared.value  # kept by the worker for all its tasks
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for lo, _, data, offsets in chunks(batch.column(at), 1 << 19):
                    clean[[lo + d for d, *_ in leaks(indexes, data, offsets)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
        if not last:
            docs = as_table(docs, "left")
            shared.unpersist()
            if held is not None:
                free(held)
            held = docs
    return docs


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
