"""Operator 4, SimHash near-duplicates: tiled exact comparison with numpy exclusive-or and bit counts.

A fingerprint's bits are counted in ``BLOCKS`` equal blocks. If two fingerprints differ in at most ``radius`` bits, their
block counts differ by at most ``radius`` in sum, so a tile (the distinct fingerprints with equal counts, divided into
sub-tiles of bounded size) meets only tiles within that distance: all other pairs of tiles are skipped. Pairs are made of
the tiles' names alone and dealt by both names, so the pairs of a crowded count are spread over all tasks; then each
pair's fingerprints come by two joins. A pair is compared whole, exactly; of its links a spanning forest goes on (at most as
many as it has fingerprints), so groups of near copies never turn into all their pairs. Components come from alternating large-star and small-star rounds.

Defined cases: a null or empty text, or one without words, has fingerprint zero and is linked like any other; equal
fingerprints are one vertex, whatever the number of copies; repeated rows get a row each; a null ``doc_id`` never
names a component unless nothing else can; an empty table gives an empty result; other columns, under any name, survive in
``one_of_each``; a very long text is hashed whole, its bits counted 8,192 shingles at a time.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairscope.llm.store import as_table, documents, numbered, plus

BLOCKS = 4
TILE = 4096
RADIUS = 3
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def fingerprint(text: str | None, shingle: int = 3) -> int:
    words = _WORD.findall((text or "").translate(_LOWER))
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [" ".join(words)]
    else:
        grams = map(" ".join, zip(*(words[k:] for k in range(shingle))))
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(g, 42) for g in grams]), np.uint8).reshape(-1, 8)
    ones, n = np.zeros(64, np.int64), len(hashes)
    for lo in range(0, n, 8192):
        ones += np.unpackbits(hashes[lo : lo + 8192], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def with_fingerprint(df: DataFrame, text: str = "text", column: str = "fp__") -> DataFrame:
    at, names = df.columns.index(text), df.columns

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(at)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps)], names=[*names, column])

    return df.mapInArrow(run, plus(df.schema, f"{column} long"))


def near_cells(blocks: int, radius: int) -> list[tuple[int, ...]]:
    """Differences of block counts within the radius, one of each pair of opposites."""
    out = [()]
    for _ in range(blocks):
        out = [(*d, k) for d in out for k in range(-radius, radius + 1) if sum(map(abs, d)) + abs(k) <= radius]
    return [d for d in out if d >= (0,) * blocks]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of links: every end with the smallest one that it reaches."""
    ends, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ends))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    far = root != np.arange(len(ends))
    return ends[root[far]], ends[far]


def _compare(radius: int):
    def run(left: np.ndarray, right: np.ndarray, same: bool):
        a, b = [], []
        step = max(1, (1 << 20) // max(1, len(right)))
        for lo in range(0, len(left), step):
            differ = np.bitwise_count(left[lo : lo + step, None] ^ right[None, :])
            i, j = np.nonzero(differ <= radius)
            if same:
                i, j = i[up := i + lo < j], j[up]
            a.append(left[i + lo].view(np.int64))
            b.append(right[j].view(np.int64))
            if sum(map(len, a)) > 1 << 20:
                a, b = ([x] for x in _forest(np.concatenate(a), np.concatenate(b)))
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        return _forest(a, b) if len(a) else (a, b)

    def pairs(batches):
        for batch in batches:
            heads, tails = [], []
            for x, y, same in zip(batch.column("left"), batch.column("right"), batch.column("same").to_pylist()):
                a, b = run(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), same)
                heads.append(a)
                tails.append(b)
            heads, tails = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (heads, tails))
            yield pa.RecordBatch.from_arrays([pa.array(heads), pa.array(tails)], names=["a", "b"])

    return pairs


def links(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """fps: distinct values in column fp. Links a < b (as signed numbers) whose closure is that of all pairs within the radius."""
    width = 64 // blocks
    cell = F.array(*(F.bit_count(F.shiftrightunsigned("fp", k * width).bitwiseAND(F.lit((1 << width) - 1))) for k in range(blocks)))
    keyed = fps.select("fp", cell.alias("cell"))
    # sub-tiles by a hash: their number follows the size of the cell, so that each has about ``tile`` fingerprints
    sizes = keyed.groupBy("cell").agg(F.count("*").alias("n")).select("cell", F.ceil(F.col("n") / tile).cast("int").alias("parts"))
    subs = keyed.join(sizes, "cell").select("fp", "cell", "parts", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int").alias("part"))
    packed = subs.groupBy("cell", "part").agg(F.array_sort(F.collect_list("fp")).alias("fps"))

    def pack(batches):
        for batch in batches:
            blobs = [np.asarray(x.values, np.int64).tobytes() for x in batch.column("fps")]
            yield pa.RecordBatch.from_arrays([batch.column("cell"), batch.column("part"), pa.array(blobs, pa.binary())], names=["cell", "part", "blob"])

    tiles = as_table(packed.mapInArrow(pack, "cell array<int>, part int, blob binary"), "tiles")
    near = F.array(*(F.array(*map(F.lit, d)) for d in near_cells(blocks, radius)))
    names = tiles.select(F.col("part").alias("pa"), F.col("cell").alias("ca"))
    left = names.select("pa", "ca", F.explode(near).alias("d")).select("pa", "ca", F.zip_with("ca", "d", lambda x, y: x + y).alias("cb"))
    bounded = F.forall("cb", lambda x: x.between(0, width))
    met = left.where(bounded).join(tiles.select(F.col("part").alias("pb"), F.col("cell").alias("cb")), "cb")
    met = met.where((F.col("ca") != F.col("cb")) | (F.col("pa") <= F.col("pb")))
    met = met.join(tiles.select(F.col("blob").alias("left"), F.col("part").alias("pa"), F.col("cell").alias("ca")), ["ca", "pa"])
    met = met.join(tiles.select(F.col("blob").alias("right"), F.col("part").alias("pb"), F.col("cell").alias("cb")), ["cb", "pb"])
    # the work of a pair does not show in its bytes: a number of partitions of our own, which no plan merges
    met = met.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "ca", "pa", "cb", "pb")
    met = met.select("left", "right", ((F.col("ca") == F.col("cb")) & (F.col("pa") == F.col("pb"))).alias("same"))
    return met.mapInArrow(_compare(radius), "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): of each vertex of the links the smallest vertex that it reaches, by large-star and small-star rounds.

    Minima come from partial aggregates, never from a vertex's gathered neighbours.
    """
    edges = as_table(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a < b").distinct(), "links")
    while True:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("m"))
        large = both.join(low.withColumnRenamed("v", "a"), "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        large = as_table(large, "large")
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        small = as_table(small, "small")
        # a star forest: no vertex is both a root and a leaf, and each leaf has one root
        leaves = small.groupBy(F.col("b").alias("leaf")).agg(F.count("*").alias("n"))
        loose = leaves.where("n > 1").select("leaf").union(small.select(F.col("a").alias("leaf")).join(leaves, "leaf", "left_semi"))
        if loose.isEmpty():
            return small.select(F.col("b").alias("node"), F.col("a").alias("root"))
        edges = small


def _components_of(rows: DataFrame, id_column: str, radius: int) -> DataFrame:
    """Of each fingerprint that has links its component's smallest doc_id; rows: id and fp__."""
    lowest = rows.groupBy(F.col("fp__").alias("fp")).agg(F.min(id_column).alias("least"))
    lowest = as_table(lowest, "fingerprints")
    roots = components(links(lowest.select("fp"), radius))
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    whole = lowest.join(roots, lowest.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = whole.groupBy("root").agg(F.min("least").alias("component_id"))
    return whole.join(named, "root").select(F.col("fp").alias("fp__"), "component_id")


def near_copies(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint, component_id of each row."""
    rows = as_table(with_fingerprint(docs.select("doc_id", "text")).select("doc_id", "fp__"), "rows")
    return rows.join(_components_of(rows, "doc_id", radius), "fp__").select("doc_id", F.lower(F.lpad(F.hex("fp__"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row of each component, that with the smallest doc_id, and all its columns."""
    own, names = numbered(docs)
    columns, text, id_column = own.columns, own.columns[names.index(text)], own.columns[names.index(id_column)]
    rows_of = as_table(with_fingerprint(own.select("*", F.monotonically_increasing_id().alias("row")), text), "rows")
    rows = rows_of.select(F.col(id_column).alias("id"), "row", "fp__")
    # null ids come last, repeated ids by row number
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    keys = rows.groupBy("fp__").agg(first.alias("first"))
    comp = _components_of(rows, "row", radius).withColumnRenamed("component_id", "group")
    keep = keys.join(comp, "fp__").groupBy("group").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    return rows_of.join(keep, "row", "left_semi").select(*columns).toDF(*names)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(documents(spark, sf_dir))
