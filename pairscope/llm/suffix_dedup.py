"""Operator 9, suffix-array dedup: threshold-bounded interval expansion on a Burrows-Wheeler transform.

Every 200-byte window belongs to a run with its anchor (see ``repeats``); suffixes that can share 200 bytes thus meet under
one anchor, and the corpus' suffix array falls into independent parts. Parts of runs that differ are dealt by anchor and
packed into pieces of about ``PIECE`` bytes. Of each piece the transform is made; intervals are extended backwards,
breadth first, and an interval that ends where no common prefix is known yet states it: values come in increasing order.
The search stops at the window's length; what has no value then has a longer common prefix, and its windows repeat.

An anchor with more than ``MOST`` different runs (a line in very many documents) is never gathered: its runs are halved by
where their windows stand around the anchor and dealt by the text that all windows of a half share, merged again, and so
on; halves of one window share all their text, so they merge. Each level is a table in the shared folder.

Runs of equal hash are one string of the transform with its number of places; whether their bytes are equal is seen when
each removed span is compared with its source, by SHA-256 (see ``repeats``).

Defined cases: null or empty texts have no bytes; texts shorter than the window keep all; repeated rows are places of their
own; a null doc_id is a document like others; an empty table gives an empty result; other columns, under any name, are not
read; very long texts are treated in blocks (see ``repeats``), no byte is left out. Removal may cut inside a character: kept
bytes are bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairscope.llm.repeats import BYTES, KEY, PIECES, Windows, byte_codes, keyed, repeated_pieces, with_lists, without_spans
from pairscope.llm.store import as_table, documents, free

WINDOW = 200
ANCHOR = 48
MOST = 1000
PIECE = 1 << 20
PART = "key long, anchor long, run long, o int, n int, off int, lo int, hi int, places long, same long, slice binary"


def suffix_order(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The suffix array of strings in one array of bytes + 1 with a 0 at each end; ends are ordered by string. What is
    alone in its group keeps its place, so each round sorts only the rest, by the ranks of as many stretches as a key holds."""
    n = len(text)
    left = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(n)  # bytes before the string's end
    wide = np.concatenate([text.astype(np.int64), np.zeros(7, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(7):
        key = (key << 9) | np.where(left >= k, wide[k : k + n], 0)
    order = np.argsort(key)
    near = left[order] < 7  # these hold an end: each is a group, by string
    at = order[near]
    order[near] = at[np.lexsort((at, key[at]))]
    new = near
    new[0] = True
    new[1:] |= np.diff(key[order]) != 0
    rank, h, stretches = np.empty(n, np.int64), 7, 3 if n < 1 << 21 else 2
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rest = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(rest):
        at = order[rest]
        key = rank[at]
        for k in range(1, stretches):
            key = key * n + rank[np.minimum(at + k * h, n - 1)]
        by = np.argsort(key)
        at, key = at[by], key[by]
        new = np.ones(len(rest), bool)
        new[1:] = np.diff(key) != 0
        order[rest] = at
        rank[at] = np.maximum.accumulate(np.where(new, rest, 0))
        rest = rest[~(new & np.append(new[1:], True))]
        h *= stretches
    return order


def shared_starts(strings: list[bytes], length: int) -> np.ndarray:
    """Of each place in the joined strings (each with an end sign), whether ``length`` bytes from there stand elsewhere too."""
    sizes = np.array([len(s) + 1 for s in strings])
    ends = np.cumsum(sizes) - 1
    text = np.zeros(int(sizes.sum()), np.int16)
    body = np.ones(len(text), bool)
    body[ends] = False
    text[body] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int16) + 1
    n = len(text)
    order = suffix_order(text, ends)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = text[order - 1]  # the transform; 0: nothing before
    back = place[order - 1]
    common = np.full(n + 1, -1, np.int16)
    common[[0, n]] = 0
    first = text[order]
    new = np.ones(n, bool)
    new[1:] = (first[1:] != first[:-1]) | (first[1:] == 0)
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], n)
    common[hi] = 0
    for level in range(1, length):
        size = hi - lo
        one = lo[size == 1]
        one = back[one[before[one] > 0]]
        lo, hi, size = lo[size > 1], hi[size > 1], size[size > 1]
        if len(lo):
            owner = np.repeat(np.arange(len(lo)), size)
            row = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
            sign = before[row]
            owner, row, sign = owner[sign > 0], row[sign > 0], sign[sign > 0]
            kind = owner * 512 + sign
            by = np.argsort(kind, kind="stable")
            kind, row = kind[by], back[row[by]]
            start = np.flatnonzero(np.concatenate([np.ones(min(1, len(kind)), bool), np.diff(kind) != 0]))
            stop = np.append(start[1:], len(kind))[: len(start)]
            lo, hi = row[start], row[start] + (stop - start)
            lo, hi = np.concatenate([one, lo]), np.concatenate([one + 1, hi])
        else:
            lo, hi = one, one + 1
        fresh = common[hi] < 0
        lo, hi = lo[fresh], hi[fresh]
        if not len(lo):
            break
        common[hi] = level
    open_ = common < 0
    out = np.zeros(n, bool)
    out[order] = open_[:-1] | open_[1:]
    return out


def _slices(window: int, anchor: int):
    """The text of each run that is to be opened."""

    def emit(batches):
        for batch in batches:
            rows = []
            for text, found in zip(batch.column("text"), batch.column("found").to_pylist()):
                data = text.as_py().encode()
                for f in found:
                    piece = data[f["at"] : f["at"] + f["n"] - 1 + window]
                    rows.append((f["anchor"], f["anchor"], f["run"], 0, f["n"], f["off"], 0, window - anchor + 1, f["places"], f["run"], piece))
            yield _parts(rows)

    return emit


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split(" ") for x in PART.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, names)], names=[n for n, _ in names])


def _signed(data: bytes, seed: int = 0) -> int:
    x = xxhash.xxh3_64_intdigest(data, seed)
    return x - (1 << 64) if x >> 63 else x


def _halve(window: int):
    """Splits parts by how many bytes stand before the anchor; a half's key is the text that all its windows would share."""

    def emit(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                lo, hi, off = r["lo"], r["hi"], r["off"]
                mid = (lo + hi) // 2
                for a, b in ((lo, mid), (mid, hi)):
                    # windows that start x bytes before the anchor, a <= x < b
                    first, last = max(0, off - b + 1), min(r["n"] - 1, off - a)
                    if a < b and first <= last:
                        piece = r["slice"][first : last + window]
                        common = r["slice"][off - a : off - b + 1 + window]
                        rows.append((_signed(common, 2 * a + 1), r["anchor"], r["run"], r["o"] + first, last - first + 1, off - first, a, b, r["places"], _signed(piece, 7919 + off - first), piece))
            yield _parts(rows)

    return emit


def _expand(window: int):
    """Opens whole keys, packed into pieces; rows come ordered by key."""

    def opened(held):
        starts = shared_starts([r["slice"] for r in held], window)
        at = 0
        for r in held:
            hit = starts[at : at + r["n"]]
            at += len(r["slice"]) + 1
            if hit.any():
                yield r["anchor"], r["run"], r["same"], r["key"], r["o"], hit.astype(np.uint8).tobytes()

    def emit(batches):
        held, size = [], 0

        def flush():
            rows = list(zip(*opened(held)))
            kinds = [pa.int64()] * 4 + [pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows or [()] * 6, kinds)], names=["anchor", "run", "same", "key", "o", "bits"])

        for batch in batches:
            for r in batch.to_pylist():
                if size > PIECE and r["key"] != held[-1]["key"]:
                    yield flush()
                    held, size = [], 0
                held.append(r)
                size += len(r["slice"]) + 1
        if held:
            yield flush()

    return emit


def _resolve(window: int, anchor: int, most: int):
    def resolve(docs: DataFrame, merged: DataFrame) -> DataFrame:
        several = as_table(merged.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"), "several")
        runs = as_table(merged.join(several, "anchor"), "opened")
        texts, lists = with_lists(docs.select(*KEY, "text"), runs, ["anchor", "run", "n", "off", "places", "at"], "inner")
        parts, verdicts, old = as_table(texts.select("text", "found").mapInArrow(_slices(window, anchor), PART), "parts"), [], []
        while True:
            # one copy of each content under a key; several copies repeat as they are
            one = as_table(parts.groupBy("key", "same").agg(F.sum("places").alias("places"), *(F.first(c).alias(c) for c in ("anchor", "run", "o", "n", "off", "lo", "hi", "slice"))), "one")
            sizes = as_table(one.groupBy("key").agg(F.count("*").alias("c")), "sizes")
            many = as_table(sizes.where(F.col("c") > most).select("key", F.lit(True).alias("many")), "many")
            marked = one.join(many, "key", "left")
            small = marked.where("many is null").drop("many")
            lone = as_table(sizes.where("c > 1").select("key"), "keys")
            dealt = small.join(lone, "key", "left_semi").select("key", "anchor", "run", "same", "o", "n", "slice")
            dealt = dealt.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key")
            hits = as_table(dealt.mapInArrow(_expand(window), "anchor long, run long, same long, key long, o int, bits binary"), "hits")
            # the verdict on a content holds for every part that has it
            each = parts.select("key", "same", "anchor", "run", "o", "n")
            copies = one.where("places > 1").select("key", "same")
            verdicts.append(each.join(hits.select("key", "same", "bits"), ["key", "same"]).select("anchor", "run", "o", "n", "bits"))
            verdicts.append(each.join(copies, ["key", "same"]).select("anchor", "run", "o", "n", F.lit(None).cast("binary").alias("bits")))
            old += [parts, one, sizes, many, lone, hits]
            if many.isEmpty():
                break
            parts = as_table(marked.where("many").select(*parts.columns).mapInArrow(_halve(window), PART), "halves")
        found = verdicts[0]
        for v in verdicts[1:]:
            found = found.unionByName(v)
        source = [F.col(a).alias(b) for a, b in (("k1", "s1"), ("k2", "s2"), ("at", "sat"))]
        once = runs.where("places = 1").select("anchor", "run", F.col("n").alias("whole"), *source)
        gathered = found.join(once, ["anchor", "run"]).groupBy("anchor", "run", "whole", "s1", "s2", "sat").agg(F.collect_set(F.struct("o", "n", "bits")).alias("some"))
        opened = gathered.mapInArrow(_merged, f"anchor long, run long, pieces {PIECES}")
        all_ = F.array(F.struct(F.lit(0).alias("o"), "n", *source, F.lit(0).alias("path"))).cast(PIECES)
        decided = as_table(merged.where("places > 1").select("anchor", "run", all_.alias("pieces")).unionByName(opened), "decided")
        free(several, runs, lists, *old)
        return decided

    return resolve


def _merged(batches):
    """Of each run, its repeated windows as pieces; the run is its own source, which no other has."""
    shape = pa.list_(pa.struct([("o", pa.int32()), ("n", pa.int32()), ("s1", pa.int64()), ("s2", pa.int32()), ("sat", pa.int32()), ("path", pa.int32())]))
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            bits = np.zeros(r["whole"] + 2, np.int8)
            for s in r["some"]:
                bits[s["o"] + 1 : s["o"] + s["n"] + 1] |= 1 if s["bits"] is None else np.frombuffer(s["bits"], np.int8)
            starts, stops = np.flatnonzero(np.diff(bits) == 1), np.flatnonzero(np.diff(bits) == -1)
            out.append([{"o": a, "n": b - a, "s1": r["s1"], "s2": r["s2"], "sat": r["sat"] + a, "path": -1} for a, b in zip(starts.tolist(), stops.tolist())])
        yield pa.RecordBatch.from_arrays([batch.column("anchor"), batch.column("run"), pa.array(out, shape)], names=["anchor", "run", "pieces"])


def without_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, most: int = MOST, seed: int = 0) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes that stay) of each row."""
    docs = keyed(docs)
    return without_spans(docs, *repeated_pieces(docs, Windows(byte_codes, window, anchor, seed), _resolve(window, anchor, most)), window, BYTES).withColumnRenamed("n", "n_bytes")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
