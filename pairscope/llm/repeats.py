"""Repeated windows of symbols (words or bytes) across all documents: what operators 7 and 9 share.

A *window* is ``window`` consecutive symbols of one document. Its *anchor* is the k-symbol string inside it with the
smallest hash (leftmost of equals), so equal windows have equal anchors at equal places. A *run* is a maximal row of
windows with one anchor place. Only runs are shuffled, about 2 / (window - k + 2) of all windows:

1. Anchors that occur once are dropped by a count (partial sums first) and a join; their windows are unique.
2. Runs of equal hash are merged into one, with the number of places and a source: the place in the document of the
   smallest key.
3. The operator's own method (``resolve``) decides which windows of the merged runs repeat, and where each of them stands
   in a source: pieces of windows that are consecutive in both.
4. Pieces go back to the documents by a join, where neighbours that are consecutive in one source become one *span*, and what
   spans cover is cut out.
5. In the same pass each span is made ready for a comparison with its source: it is divided where the source's *stretches* of
   fixed size end, and of every part the document sends (source, stretch, from, to) and the SHA-256 of its own symbols. A source
   sends the stretches that its own places lie in, each once. Both meet by an equal join on (source, stretch), where the digest of
   the source's symbols is made. So a 64-bit hash never decides alone. If one had joined different texts, the job stops with an
   error that says so, and another ``seed`` helps. Equal questions are merged before they are shuffled, so a stretch is asked at
   most for its own substrings, however many documents quote it, and no list of questions is gathered for a source.

A document is found again by 96 bits of hash of id and text, so repeated rows share their decisions, which are equal anyway,
and nothing depends on how rows are dealt out. Joins on anchors, runs and documents are equal joins of a large side with one
that has each key once: adaptive execution splits the hot ones.

Very long texts: runs are found block by block (``BLOCK`` symbols and a window's overlap); a document's list of spans and
the document itself are held by one task when it is cut.
"""

from __future__ import annotations

import hashlib
import itertools
from dataclasses import dataclass
from typing import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairscope.llm.store import as_table, chunks, free

_BASE = 0x9E3779B97F4A7C55
_ODD = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_LOW = np.uint64(0xFFFFFFFF)
_POWERS: list[np.ndarray] = []
BLOCK = 1 << 22  # symbols of a long text that are handled at once
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _ODD[0]
    x = (x ^ (x >> np.uint64(27))) * _ODD[1]
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the base and of its inverse, at least n."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, np.uint64(b))]), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def sums(codes: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span`` takes the hash of any stretch."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers(len(codes))[0][: len(codes)], dtype=np.uint64)])


def span(total: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return (total[hi] - total[lo]) * powers(len(total))[1][lo]


def _byte_table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _ODD[2] ^ mix(np.array([seed], np.uint64)))


def byte_codes(data: np.ndarray, offsets: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    return _byte_table(seed)[data], offsets


def word_codes(data: np.ndarray, offsets: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (what stands between spaces) and where the documents' words begin."""
    n, codes, starts, lo, table = len(data), [], [], 0, _byte_table(seed)
    edge = np.zeros(n + 1, bool)  # a document's end ends a word
    edge[offsets] = True
    while lo < n:
        hi = min(lo + BLOCK, n)
        while hi < n:  # a block ends at a space or a document's end
            stops = np.flatnonzero(SPACE[data[lo:hi]] | edge[lo + 1 : hi + 1])
            if len(stops):
                hi = lo + int(stops[-1]) + 1
                break
            hi = min(hi + BLOCK, n)
        text = data[lo:hi]
        full = ~SPACE[text]
        first = full.copy()
        first[1:] &= SPACE[text[:-1]] | edge[lo + 1 : hi]
        last = full.copy()
        last[:-1] &= SPACE[text[1:]] | edge[lo + 1 : hi]
        first, last = np.flatnonzero(first), np.flatnonzero(last) + 1
        codes.append(mix(span(sums(table[text]), first, last)))
        starts.append(first + lo)
        lo = hi
    if not codes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(codes), np.searchsorted(np.concatenate(starts), offsets)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minima of all stretches of ``width``."""
    have, out = 1, values
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _visits(gram: np.ndarray, place: np.ndarray, first: np.ndarray, many: np.ndarray, window: int, k: int):
    """The nodes (stretches of window - 1 symbols) that a walk enters and leaves by windows of other anchors than the node's
    own: where they start, and that anchor's place."""
    nxt = first[1:]
    met = (nxt == first[:-1] + many[:-1]) & (place[first[:-1]] == nxt - 1) & (place[nxt] == nxt + window - k)
    at = nxt[met]
    if not len(at):
        return at, at
    inside = at[:, None] + np.arange(window - k)
    least = ((gram[inside] & ~_LOW) | inside.astype(np.uint64)).min(1)
    return at, (least & _LOW).astype(np.int64)


def _runs(codes: np.ndarray, bounds: np.ndarray, window: int, k: int, visits: bool):
    n = len(codes)
    if n < window:
        return None
    total = sums(codes)
    at = np.arange(n - k + 1)
    gram = mix(span(total, at, at + k))
    place = _least((gram & ~_LOW) | at.astype(np.uint64), window - k + 1) & _LOW
    inside = at[: n - window + 1] + window <= np.repeat(bounds[1:], np.diff(bounds))[: n - window + 1]
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (place[1:] != place[:-1])
    first = np.flatnonzero(new)
    if not len(first):
        return None
    seen = np.cumsum(inside)
    many = np.append(seen[first[1:] - 1], seen[-1]) - seen[first] + 1
    place = place.astype(np.int64)
    off = place[first] - first
    content = span(total, first, first + many + window - 1)
    run = mix(content ^ (many.astype(np.uint64) * _ODD[2]) ^ (off.astype(np.uint64) * _ODD[3]))
    anchor = gram[place[first]]
    if visits:
        at, own = _visits(gram, place, first, many, window, k)
        first, many, off = np.concatenate([first, at]), np.concatenate([many, np.zeros(len(at), np.int64)]), np.concatenate([off, own - at])
        anchor, run = np.concatenate([anchor, gram[own]]), np.concatenate([run, mix(span(total, at, at + window - 1))])
    doc = np.searchsorted(bounds, first, "right") - 1
    return doc, first - bounds[doc], many, off, anchor.view(np.int64), run.view(np.int64)


def runs(codes: np.ndarray, bounds: np.ndarray, window: int, k: int, visits: bool = False):
    """Yields (document, first window, windows, anchor's place in the run, anchor, run); long texts block by block. With
    ``visits``, also nodes that belong to an anchor without a window of it around them, as runs of no windows."""
    if len(codes) <= 2 * BLOCK:
        pieces = [(0, codes, bounds, 0)]
    else:
        pieces = [(d, codes[lo : min(lo + BLOCK + window - 1, hi)], None, lo - bounds[d]) for d, hi in enumerate(bounds[1:]) for lo in range(int(bounds[d]), int(hi), BLOCK)]
    for d, part, own, skipped in pieces:
        if (found := _runs(part, np.array([0, len(part)]) if own is None else own, window, k, visits)) is not None:
            yield found[0] + d, found[1] + skipped, *found[2:]


@dataclass(frozen=True)
class Windows:
    symbols: Callable  # (bytes, offsets, seed) -> (codes, where documents begin)
    window: int
    k: int
    seed: int = 0
    visits: bool = False


KEY = ["k1", "k2"]
PIECES = "array<struct<o:int,n:int,s1:long,s2:int,sat:int,path:int>>"


def keyed(docs: DataFrame) -> DataFrame:
    """k1, k2 (the document's key), doc_id, text."""
    return docs.select(F.xxhash64("doc_id", "text").alias("k1"), F.hash("doc_id", "text").alias("k2"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))


def runs_of(docs: DataFrame, how: Windows) -> DataFrame:
    def emit(batches):
        for batch in batches:
            k1, k2 = np.asarray(batch.column("k1"), np.int64), np.asarray(batch.column("k2"), np.int32)
            for lo, _, data, offsets in chunks(batch.column("text"), 1 << 20):
                codes, bounds = how.symbols(data, offsets, how.seed)
                for doc, at, many, off, anchor, run in runs(codes, bounds, how.window, how.k, how.visits):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor), pa.array(run), pa.array(k1[lo + doc]), pa.array(k2[lo + doc]), pa.array(at.astype(np.int32)), pa.array(many.astype(np.int32)), pa.array(off.astype(np.int32))],
                        names=["anchor", "run", "k1", "k2", "at", "n", "off"],
                    )

    return docs.select("k1", "k2", "text").mapInArrow(emit, "anchor long, run long, k1 long, k2 int, at int, n int, off int")


def first_place(k1: str, k2: str, at: str) -> list:
    """Aggregates for the place that is the source of others: the smallest in an order of (upper half of the key, place), so
    what follows one another in a document has sources that follow one another, too."""
    order = F.col("k1").bitwiseAND(F.lit(-(1 << 32))).bitwiseOR(F.col("at").cast("long"))
    return [F.min_by("k1", order).alias(k1), F.min_by("k2", order).alias(k2), F.min_by("at", order).alias(at)]


def with_lists(docs: DataFrame, lists: DataFrame, names: list[str], how: str) -> tuple[DataFrame, DataFrame]:
    """docs with what ``lists`` has for their key, gathered (a document's own runs or pieces, each once), and the gathered table."""
    gathered = as_table(lists.groupBy(*KEY).agg(F.collect_set(F.struct(*names)).alias("found")), "lists")
    return docs.join(gathered, KEY, how), gathered


def repeated_pieces(docs: DataFrame, how: Windows, resolve: Callable[[DataFrame, DataFrame], DataFrame]) -> tuple[DataFrame, list[DataFrame]]:
    """Pieces: k1, k2, at, n (windows of the document that repeat), s1, s2, sat (where the same windows stand in the source) and path
    (pieces of different paths never become one span; below 0: the document's own place, which no other has as its source); and the
    tables that they are made of.

    ``resolve`` gets the documents and the merged runs (anchor, run, places, n, off, k1, k2, at) of anchors that occur more than
    once; it returns a table of anchor, run and pieces (``PIECES``, o: windows before the piece).
    """
    found = runs_of(docs, how)
    again = as_table(found.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"), "anchors")
    some = as_table(found.join(again, "anchor"), "runs")
    free(again)
    merged = as_table(some.groupBy("anchor", "run").agg(F.count("*").alias("places"), F.first("n").alias("n"), F.first("off").alias("off"), *first_place("k1", "k2", "at")), "merged")
    decided = resolve(docs, merged)
    free(merged)
    pieces = some.select("anchor", "run", "k1", "k2", "at").join(decided, ["anchor", "run"]).select("k1", "k2", "at", F.explode("pieces").alias("p"))
    return pieces.select("k1", "k2", (F.col("at") + F.col("p.o")).alias("at"), "p.n", "p.s1", "p.s2", "p.sat", "p.path"), [some, decided]


@dataclass(frozen=True)
class Form:
    """A text as a sequence of symbols: ``opened`` takes its bytes, ``joined`` makes bytes of symbols again, with ``gap`` bytes
    between them; ``stretch``: symbols of a stretch."""

    opened: Callable
    joined: Callable
    kept: Callable
    gap: int
    stretch: int


def _kept_words(words: list[bytes], gone: np.ndarray) -> bytes:
    return b" ".join(itertools.compress(words, (~gone).tolist()))


def _kept_bytes(data: bytes, gone: np.ndarray) -> bytes:
    return np.frombuffer(data, np.uint8)[~gone].tobytes()


WORDS = Form(bytes.split, b" ".join, _kept_words, 1, 512)  # at the six ASCII spaces
BYTES = Form(bytes, bytes, _kept_bytes, 0, 4096)


def _spans(found: pa.Array) -> tuple:
    """Pieces of each row in order, neighbours that are consecutive in one source as one: where each row's spans begin, and
    at, n, s1, s2, sat, path of the spans."""
    sizes = pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(found)), sizes)
    flat = found.flatten()
    at, n, s1, s2, sat, path = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("at", "n", "s1", "s2", "sat", "path"))
    by = np.lexsort((path, sat, n, at, row))
    row, at, n, s1, s2, sat, path = (x[by] for x in (row, at, n, s1, s2, sat, path))
    new = np.ones(len(row), bool)
    new[1:] = (at[1:] != at[:-1] + n[:-1]) | (sat[1:] != sat[:-1] + n[:-1])
    for x in (row, s1, s2, path):
        new[1:] |= x[1:] != x[:-1]
    first = np.flatnonzero(new)
    n = np.add.reduceat(n, first) if len(first) else n
    row, at, s1, s2, sat, path = (x[first] for x in (row, at, s1, s2, sat, path))
    return np.searchsorted(row, np.arange(len(found) + 1)), at, n, s1, s2, sat, path


CHECKS = "checks array<struct<s1:long,s2:int,q:int,lo:int,hi:int,digest:binary>>, stretches array<struct<q:int,starts:array<int>,body:binary>>"
_CHECK = pa.list_(pa.struct([("s1", pa.int64()), ("s2", pa.int32()), ("q", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("digest", pa.binary())]))
_STRETCH = pa.list_(pa.struct([("q", pa.int32()), ("starts", pa.list_(pa.int32())), ("body", pa.binary())]))


def _digest(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()[:16]


def _cut(window: int, form: Form):
    """Of each document what stays of it, the questions about its spans, and the stretches that others ask for."""
    size = form.stretch

    def parts(sat: int, n: int):
        return range(sat // size, (sat + n + window - 2) // size + 1)

    def emit(batches):
        # a few MB of texts at a time: what is made of them is held until it is sent
        for batch in (whole.slice(lo, hi - lo) for whole in batches for lo, hi, *_ in chunks(whole.column("text"), 2 << 20)):
            edges, *spans = _spans(batch.column("found"))
            spans = [x.tolist() for x in spans]
            k1, k2, out = batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), []
            for d, text in enumerate(batch.column("text")):
                symbols = form.opened(text.as_py().encode())
                change, asked, own = np.zeros(len(symbols) + 1, np.int64), set(), set()
                for at, n, s1, s2, sat, path in zip(*(x[edges[d] : edges[d + 1]] for x in spans)):
                    change[at] += 1
                    change[at + n - 1 + window] -= 1
                    if s1 == k1[d] and s2 == k2[d] and at == sat:
                        if path >= 0:
                            own.update(parts(sat, n))
                        continue
                    for q in parts(sat, n):
                        lo, hi = max(sat, q * size), min(sat + n - 1 + window, (q + 1) * size)
                        asked.add((s1, s2, q, lo - q * size, hi - q * size, _digest(form.joined(symbols[at + lo - sat : at + hi - sat]))))
                gone = np.cumsum(change[:-1]) > 0
                sent = []
                for q in sorted(own):
                    some = symbols[q * size : (q + 1) * size]
                    starts = np.cumsum([0, *(len(x) + form.gap for x in some)]).tolist() if form.gap else None
                    sent.append({"q": q, "starts": starts, "body": form.joined(some)})
                n_spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
                checks = [dict(zip(("s1", "s2", "q", "lo", "hi", "digest"), c)) for c in asked]
                out.append((len(symbols), int(gone.sum()), n_spans, form.kept(symbols, gone) if edges[d] < edges[d + 1] else form.joined(symbols), checks, sent))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), _CHECK, _STRETCH)
            columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 6, kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *KEY)), *columns], names=["doc_id", *KEY, "n", "n_removed", "n_spans", "kept", "checks", "stretches"])

    return emit


def differing(done: DataFrame) -> int:
    """How many questions have no source or another answer there."""
    fields = ["s1", "s2", "q", "lo", "hi", "digest"]
    asked = done.select(F.explode("checks").alias("c")).select(*(F.col(f"c.{c}").alias(c) for c in fields)).distinct()
    sent = done.select(F.col("k1").alias("s1"), F.col("k2").alias("s2"), F.explode("stretches").alias("s")).select("s1", "s2", "s.q", "s.starts", "s.body")
    once = sent.groupBy("s1", "s2", "q").agg(F.first(F.struct("starts", "body")).alias("s"))  # repeated rows of a source say the same
    place = lambda k: F.coalesce(F.get("s.starts", F.col(k)), F.col(k))
    gap = F.when(F.col("s.starts").isNotNull(), 1).otherwise(0)
    own = F.substring(F.unhex(F.sha2(F.substring("s.body", place("lo") + 1, place("hi") - gap - place("lo")), 256)), 1, 16)
    equal = F.coalesce(own == F.col("digest"), F.lit(False))
    return asked.join(once, ["s1", "s2", "q"], "left").agg(F.count_if(~equal)).first()[0]


def without_spans(docs: DataFrame, pieces: DataFrame, made_of: list[DataFrame], window: int, form: Form) -> DataFrame:
    """doc_id, n (symbols), n_removed, n_spans (maximal removed rows) and kept (bytes) of each document, as a table."""
    texts, lists = with_lists(docs, pieces, ["at", "n", "s1", "s2", "sat", "path"], "left")
    free(*made_of)
    kind = docs.select("doc_id").schema.simpleString()[7:-1].replace(":", " ", 1)
    shape = f"{kind}, k1 long, k2 int, n long, n_removed long, n_spans long, kept binary, {CHECKS}"
    done = as_table(texts.select("doc_id", *KEY, "text", "found").mapInArrow(_cut(window, form), shape), "cut")
    free(lists)
    if differing(done):
        raise RuntimeError("two different texts have equal hashes: run again with another seed")
    return done.select("doc_id", "n", "n_removed", "n_spans", "kept")
