"""The tiled pair plan: samples are packed into blocks, and every pair of blocks is one matrix product in a task.

A block is a row of bytes (ids, identities, vectors). Blocks are written once, in files of a number that follows from the shuffle's
partitions, and a join on bi <= bj (every file with every other one) reads them where they lie: each pair of blocks is a tile once,
and the samples are shuffled once, however large the set. Of a tile only what is asked for leaves the task: counts by bin (summed
over all tiles of the task), or the pairs that pass a predicate.

With ``within``, only blocks of one identity meet, however many samples that identity has, and there is no square to walk through.
The blocks of an identity are dealt to bands, and each pair of bands x <= y is a cell: its blocks of x wait in the task while those
of y pass by. A block is sent to as many cells as its identity has bands, a number that follows from the partitions, from the
identity's share of the work and from what a task may hold.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairscope.functions.vectors import BINS
from pairscope.sources.tables import kept

SIZE = 1024
HELD = 64 << 20  # bytes of the vectors that a task keeps while others pass by
HOLD, MEET, BOTH = 0, 1, 2  # what a block does in a cell: waits, meets those that wait, or meets them and itself and waits
COUNTED = None  # an accumulator, if tiles are to be counted


@dataclass(frozen=True)
class Block:
    ids: np.ndarray
    who: np.ndarray
    v: np.ndarray

    @classmethod
    def of(cls, ids: bytes, who: bytes, v: bytes) -> Block:
        n = len(ids) // 8
        return cls(np.frombuffer(ids, np.int64), np.frombuffer(who, np.int64), np.frombuffer(v, np.float64).reshape(n, -1))

    def part(self, rows: slice | np.ndarray) -> Block:
        return Block(self.ids[rows], self.who[rows], self.v[rows])


def _pack(batches):
    for batch in batches:
        ids, who, vectors = [], [], []
        for row in batch.column("rows"):
            own = row.values
            ids.append(np.asarray(own.field("sample_id"), np.int64).tobytes())
            who.append(np.asarray(own.field("identity"), np.int64).tobytes())
            vectors.append(np.asarray(own.field("v").flatten(), np.float64).tobytes())
        kind = [pa.array(x, pa.binary()) for x in (ids, who, vectors)]
        yield pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("block"), batch.column("blocks"), *kind], names=["grp", "block", "blocks", "ids", "who", "v"])


def blocks(samples: DataFrame, size: int = SIZE, within: bool | str = False, partitions: int | None = None) -> DataFrame:
    """grp, block (0 .. blocks - 1 of its grp), blocks, ids, who, v. ``within``: the column whose values never meet (True: identity)."""
    grp = F.col("identity" if within is True else within) if within else F.lit(0).cast("long")
    rows = samples.select("sample_id", "identity", "v", grp.alias("grp"))
    counts = rows.groupBy("grp").agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
    sized = rows.join(counts, "grp") if within else rows.crossJoin(F.broadcast(counts.select("blocks")))  # one row
    dealt = sized.withColumn("block", F.pmod(F.xxhash64("sample_id"), F.col("blocks")).cast("int"))
    if partitions:
        dealt = dealt.repartition(partitions, "grp", "block", "blocks")
    packed = dealt.groupBy("grp", "block", "blocks").agg(F.collect_list(F.struct("sample_id", "identity", "v")).alias("rows"))
    return packed.mapInArrow(_pack, "grp long, block int, blocks int, ids binary, who binary, v binary")


def fitted_size(samples: DataFrame, memory: int = 128 << 20) -> int:
    """Rows of a block, by the vectors' dimension and the set's size: a task's tile (two blocks, their scores and what is made of
    them) takes at most about ``memory`` bytes, and there are several tiles for each partition of a shuffle."""
    n, dim = samples.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    linear, square = 32.0 * max(1, dim), 32.0  # bytes for a row and for a pair
    size = int((math.sqrt(linear * linear + 4 * square * memory) - linear) / (2 * square))
    wanted = math.ceil(math.sqrt(8 * int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))))  # blocks for four tiles a partition
    return max(32, min(size, math.ceil(n / wanted)))


def large_size(samples: DataFrame, memory: int = 8 << 20) -> int:
    """Rows of a block where tiles are met in parts: blocks of at most about ``memory`` bytes, so that few tiles are handed over, but
    several for each partition of a shuffle; never less than ``SIZE``."""
    n, dim = samples.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    wanted = math.ceil(math.sqrt(8 * int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))))  # blocks for four tiles a partition
    return max(SIZE, min(memory // (8 * max(1, dim)), math.ceil(n / wanted)))


def _bands(most: int, size: int, share: Column | None = None) -> Column:
    """How many bands the blocks of a row's set are dealt to: enough that all sets together (``share``: the root of the set's part
    of the work) give each of ``most`` partitions several cells, and so many that a band's vectors take at most about ``HELD`` bytes."""
    row = F.octet_length("v") * 8 / F.octet_length("ids")  # bytes of a vector, the same for all blocks of a set
    fit = F.greatest(F.lit(1), F.floor(HELD / (row * size)))
    several = F.ceil(math.sqrt(8 * most) * (F.lit(1.0) if share is None else share))
    return F.least("blocks", F.greatest(F.ceil(F.col("blocks") / fit), several)).cast("int")


def _together(rows: DataFrame, most: int) -> DataFrame:
    """Cells in partitions of a fixed number (small tables of much work are not coalesced), blocks to be held first."""
    return rows.repartition(most, "grp", "x", "y").sortWithinPartitions("grp", "x", "y", "role", "block")


def cells(samples: DataFrame, size: int = SIZE, within: bool | str = False) -> DataFrame:
    """grp, x, y, role, block, ids, who, v: the blocks of each cell of a triangle of bands, x <= y."""
    most = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed, share = blocks(samples, size, within), None
    if within:
        own = samples.groupBy("identity" if within is True else within).agg(F.ceil(F.count("*") / size).alias("b"))
        packed = packed.crossJoin(F.broadcast(own.agg(F.sqrt(F.sum(F.col("b") * F.col("b"))).alias("work"))))  # one row
        share = F.col("blocks") / F.col("work")
    packed = packed.withColumn("bands", _bands(most, size, share))
    band = F.floor(F.col("block").cast("long") * F.col("bands") / F.col("blocks")).cast("int")
    dealt = packed.withColumn("band", band).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("bands") - 1)))
    role = F.when(F.col("band") == F.col("other"), BOTH).when(F.col("band") < F.col("other"), HOLD).otherwise(MEET)
    return _together(dealt.select("grp", F.least("band", "other").alias("x"), F.greatest("band", "other").alias("y"), role.alias("role"), "block", "ids", "who", "v"), most)


def cross_cells(one: DataFrame, two: DataFrame, size: int = SIZE) -> DataFrame:
    """Cells of every sample of ``one`` with every sample of ``two``: sets without a common sample, the smaller one better first."""
    most = int(one.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, b = (blocks(s, size).withColumn("bands", _bands(most, size)) for s in (one, two))
    count = lambda t: F.broadcast(t.select("grp", F.col("bands").alias("others")).distinct())  # noqa: E731, one row
    band = F.floor(F.col("block").cast("long") * F.col("bands") / F.col("blocks")).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.col("others") - 1))
    left = a.join(count(b), "grp").select("grp", band.alias("x"), each.alias("y"), F.lit(HOLD).alias("role"), "block", "ids", "who", "v")
    right = b.join(count(a), "grp").select("grp", each.alias("x"), band.alias("y"), F.lit(MEET).alias("role"), "block", "ids", "who", "v")
    return _together(left.unionByName(right), most)


def files(samples: DataFrame) -> int:
    """In how many files blocks are written: each with each other one is about two tasks for a partition of a shuffle."""
    return math.ceil(math.sqrt(2 * int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def every_two(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """A join that reads both sides from their files, each file with each other one, and shuffles neither."""
    return left.hint("shuffle_replicate_nl").join(right, on)


def side_of(packed: DataFrame, number: str, side: str, *more: str) -> DataFrame:
    return packed.select(F.col(number).alias(f"b{side}"), *(F.col(c).alias(f"{c}_{side}") for c in ("ids", "who", "v")), *more)


def tiles(samples: DataFrame, size: int = SIZE) -> DataFrame:
    """bi, ids_i, who_i, v_i, bj, ids_j, who_j, v_j of all blocks bi <= bj."""
    packed = kept(blocks(samples, size, partitions=files(samples)).select("block", "ids", "who", "v"))
    return every_two(side_of(packed, "block", "i"), side_of(packed, "block", "j"), F.col("bi") <= F.col("bj"))


def scores(a: Block, b: Block, same: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Clamped scores of all pairs of a tile, and which are wanted (None: all)."""
    sim = np.clip(a.v @ b.v.T, -1.0, 1.0)
    return sim, np.triu(np.ones(sim.shape, bool), 1) if same else None


def _met(batches):
    """Number of tiles, and the tiles, of rows of ``cells``: the held blocks of a cell with each that comes."""
    cell, held = None, []
    for batch in batches:
        where = list(zip(*(batch.column(c).to_pylist() for c in ("grp", "x", "y"))))
        roles, columns = batch.column("role").to_pylist(), [batch.column(c) for c in ("ids", "who", "v")]
        for k, role in enumerate(roles):
            if where[k] != cell:
                cell, held = where[k], []
            now = Block.of(*(c[k].as_buffer() for c in columns))
            yield [(old, now, False) for old in held if role != HOLD] + [(now, now, True)] * (role == BOTH)
            if role != MEET:
                held.append(now)


def _laid_out(batches):
    """The same of rows that are tiles."""
    for batch in batches:
        columns = [batch.column(c) for c in ("ids_i", "who_i", "v_i", "ids_j", "who_j", "v_j")]
        bi, bj = batch.column("bi").to_pylist(), batch.column("bj").to_pylist()
        for k in range(batch.num_rows):
            yield [(Block.of(*(c[k].as_buffer() for c in columns[:3])), Block.of(*(c[k].as_buffer() for c in columns[3:])), bi[k] == bj[k])]
        del batch, columns  # else it waits until the next one is there


def parts_of(a: Block, b: Block, same: bool):
    """A tile as tiles of at most a quarter of ``SIZE`` * ``SIZE`` pairs (2 MB of scores, which a cache holds): what a task makes of
    pairs at a time follows from that, not from the blocks."""
    rows = max(1, SIZE * SIZE // 4 // max(1, len(b.ids)))
    if len(a.ids) <= rows:
        yield a, b, same
        return
    for k in range(0, len(a.ids), rows):
        some = a.part(slice(k, k + rows))
        if same:
            yield some, some, True
        rest = b.part(slice(k + rows, None)) if same else b
        if len(rest.ids):
            yield some, rest, False


def run_tiles(samples: DataFrame, each: Callable, schema: str, size: int = SIZE, within: bool | str = False, finish: Callable | None = None, chosen: DataFrame | None = None) -> DataFrame:
    """``each(state, a, b, same)`` yields record batches of a tile; ``finish(state)`` what the task has summed up. ``chosen``: cells
    (as ``cells`` gives them) or tiles (bi, ids_i, who_i, v_i, bj, ids_j, who_j, v_j) laid out already."""
    counted = COUNTED
    layout = chosen if chosen is not None else cells(samples, size, within) if within else tiles(samples, size)
    read = _met if "role" in layout.columns else _laid_out

    def tile_by_tile(state, some):
        for a, b, same in some:
            yield from each(state, a, b, same)

    def run(batches):
        state: dict = {}
        for some in read(batches):
            if counted is not None:
                counted.add(len(some))
            yield from tile_by_tile(state, some)
            del some
        if finish:
            yield from finish(state)

    return layout.mapInArrow(run, schema)


def binned(sim: np.ndarray, bins: int, policy: str) -> np.ndarray:
    small = np.int32 if bins < 1 << 30 else np.int64  # doubles become short numbers several times faster
    if policy == "nearest":
        return np.rint((sim + 1) * (bins / 2)).astype(small).astype(np.int64)
    if policy == "wide":
        return np.floor((sim + 1) / 2 * (bins - 1)).astype(small).astype(np.int64)
    return np.minimum(bins - 1, np.floor((sim + 1) * (bins / 2)).astype(small)).astype(np.int64)


def _counted(state: dict, kind: str, at: np.ndarray, bins: int) -> None:
    if kind not in state:
        state[kind] = np.zeros(bins + 1, np.int64)
    if len(at):  # only as many slots as the tile's bins span
        low = int(at.min())
        found = np.bincount(at - low)
        state[kind][low : low + len(found)] += found


def _moments(state: dict, x: np.ndarray, pos: np.ndarray) -> None:
    """Adds to the moments of both sides (n, s, ss, least, most) the scores x, of which those at ``pos`` are of one identity. What is
    not of one identity is the rest of the sums; its ends are looked for only where the ends of all are new."""
    p = x[pos]
    sums = {True: (len(p), float(p.sum()), float(np.vdot(p, p)))}
    sums[False] = tuple(u - v for u, v in zip((len(x), float(x.sum()), float(np.vdot(x, x))), sums[True]))
    for side, (n, total, squares) in sums.items():
        if n:
            old = state.get(side, (0, 0.0, 0.0, 2.0, -2.0))
            ends = (float(p.min()), float(p.max())) if side else (float(x.min()), float(x.max()))
            if not side and len(p) and (ends[0] < old[3] or ends[1] > old[4]):
                rest = np.delete(x, pos)
                ends = float(rest.min()), float(rest.max())
            state[side] = (old[0] + n, old[1] + total, old[2] + squares, min(old[3], ends[0]), max(old[4], ends[1]))


def histogram(samples: DataFrame, bins: int = BINS, size: int = SIZE, policy: str = "floor", within: bool = False, chosen: DataFrame | None = None) -> DataFrame:
    """bin, n_pos, n_neg of all pairs i < j (of the ``chosen`` tiles). Tiles without a common identity skip the comparison of identities."""

    def each(state, *tile):
        for a, b, same in parts_of(*tile):
            sim, want = scores(a, b, same)
            at = binned(sim, bins, policy)
            _counted(state, "all", at.ravel() if want is None else at[want], bins)
            if same or np.isin(a.who, b.who).any():
                pos = a.who[:, None] == b.who[None, :]
                _counted(state, "pos", at[pos if want is None else pos & want], bins)
        return ()

    def finish(state):
        if state:
            at = np.flatnonzero(state["all"])
            state.setdefault("pos", np.zeros(bins + 1, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(state["pos"][at]), pa.array(state["all"][at] - state["pos"][at])], names=["bin", "n_pos", "n_neg"])

    found = run_tiles(samples, each, "bin long, n_pos long, n_neg long", size, within, finish, chosen)
    return found.groupBy("bin").agg(F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"))


def summaries(samples: DataFrame, size: int = SIZE) -> DataFrame:
    """is_pos, n, s (sum of the scores), ss (of their squares), least, most: a row per side and task, to be added up."""

    def each(state, *tile):
        for a, b, same in parts_of(*tile):
            sim, want = scores(a, b, same)
            pos = a.who[:, None] == b.who[None, :]
            _moments(state, *((sim.ravel(), np.flatnonzero(pos)) if want is None else (sim[want], np.flatnonzero(pos[want]))))
        return ()

    def finish(state):
        if state:
            yield pa.RecordBatch.from_arrays([pa.array(list(state)), *(pa.array(list(c)) for c in zip(*state.values()))], names=["is_pos", "n", "s", "ss", "least", "most"])

    return run_tiles(samples, each, "is_pos boolean, n long, s double, ss double, least double, most double", size, finish=finish)


PAIR = "i long, j long, id_i long, id_j long, is_pos boolean, sim double"
KEEP = Callable[[np.ndarray, np.ndarray], np.ndarray]


def drawn(i, j, of: int):
    """Whether the pair i < j is in the sample that takes about one of ``of``: whole-number arithmetic, so numpy, columns and
    SQL can state the same."""
    x = (i % 2147483647 * 48271 + j % 2147483647 * 69621) % 2147483647
    return x * x % 2147483647 * 16807 % 2147483647 % of == 0


def _chosen(a: Block, b: Block, sim: np.ndarray, pos: np.ndarray, wanted: np.ndarray) -> list[np.ndarray]:
    """The columns of ``PAIR`` of the marked pairs of a tile, i < j."""
    x, y = np.nonzero(wanted)
    turn = a.ids[x] > b.ids[y]
    one, two = np.where(turn, b.ids[y], a.ids[x]), np.where(turn, a.ids[x], b.ids[y])
    who1, who2 = np.where(turn, b.who[y], a.who[x]), np.where(turn, a.who[x], b.who[y])
    return [one, two, who1, who2, pos[x, y], sim[x, y]]


def pairs(samples: DataFrame, keep: KEEP, size: int = SIZE, within: bool = False, sample: int = 1, chosen: DataFrame | None = None) -> DataFrame:
    """The pairs for which keep(sim, is_pos) holds, with i < j; with ``sample``, about one of so many of them."""

    def each(state, a, b, same):
        sim, want = scores(a, b, same)
        pos = a.who[:, None] == b.who[None, :]
        wanted = keep(sim, pos)
        if sample > 1:
            low, high = np.minimum(a.ids[:, None], b.ids[None, :]), np.maximum(a.ids[:, None], b.ids[None, :])
            wanted = wanted & drawn(low, high, sample)
        columns = _chosen(a, b, sim, pos, wanted if want is None else wanted & want)
        if len(columns[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["i", "j", "id_i", "id_j", "is_pos", "sim"])

    return run_tiles(samples, each, PAIR, size, within, chosen=chosen)


# one pass over the tiles for several results: rows of all kinds in one table, told apart by ``part``
MOMENTS = ["n", "s", "ss", "least", "most"]
MEASURED = f"part string, bin long, n_pos long, n_neg long, n long, s double, ss double, least double, most double, {PAIR}"
_TYPES = {"part": pa.string(), **dict.fromkeys(("bin", "n_pos", "n_neg", "n", "i", "j", "id_i", "id_j"), pa.int64()), **dict.fromkeys(("s", "ss", "least", "most", "sim"), pa.float64()), "is_pos": pa.bool_()}


def _measured_rows(part: str, columns: dict) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    columns = columns | {"part": [part] * n}
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in ((x.split(" ")[0], _TYPES[x.split(" ")[0]]) for x in MEASURED.split(", "))], names=[x.split(" ")[0] for x in MEASURED.split(", ")])


@dataclass(frozen=True)
class Measured:
    """A written table of one pass, and its parts."""

    table: DataFrame

    def histogram(self) -> DataFrame:
        return self.table.where("part = 'histogram'").groupBy("bin").agg(F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"))

    def moments(self) -> DataFrame:
        """is_pos, n, s, ss, least, most."""
        own = self.table.where("part = 'moments'").groupBy("is_pos")
        return own.agg(*(F.sum(c).alias(c) for c in ("n", "s", "ss")), F.min("least").alias("least"), F.max("most").alias("most"))

    def pairs(self, name: str) -> DataFrame:
        return self.table.where(F.col("part") == name).select(*(x.split(" ")[0] for x in PAIR.split(", ")))


def in_element_order(a: Block, b: Block, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Scores of some pairs of a tile, summed element by element as SQL does: the same bits in whichever tile a pair lies."""
    parts = [np.cumsum(a.v[x[k : k + 16384]] * b.v[y[k : k + 16384]], 1)[:, -1] for k in range(0, len(x), 16384)]
    return np.clip(np.concatenate(parts or [np.zeros(0)]), -1.0, 1.0)


def measured(samples: DataFrame, bins: int | None = BINS, policy: str = "floor", moments: bool = False, keep: dict[str, KEEP] | None = None, size: int = SIZE, within: bool = False, ordered: bool = False, chosen: DataFrame | None = None) -> Measured:
    """Histogram (unless bins is None), moments of both sides, and any sets of pairs by name, each tile being scored once. ``ordered``:
    the scores of the pairs are those of ``in_element_order``. Tiles are met in parts, unless there are sets of pairs: these may be the
    best pairs of a tile."""

    def each(state, *tile):
        for a, b, same in [tile] if keep else parts_of(*tile):
            sim, want = scores(a, b, same)
            pos = a.who[:, None] == b.who[None, :]
            for name, test in (keep or {}).items():
                wanted = test(sim, pos) if want is None else test(sim, pos) & want
                columns = _chosen(a, b, sim, pos, wanted)
                if len(columns[0]):
                    if ordered:
                        columns[-1] = in_element_order(a, b, *np.nonzero(wanted))
                    yield _measured_rows(name, dict(zip(("i", "j", "id_i", "id_j", "is_pos", "sim"), columns)))
            x, own = (sim.ravel(), np.flatnonzero(pos)) if want is None else (sim[want], np.flatnonzero(pos[want]))
            if bins:
                at = binned(x, bins, policy)
                _counted(state, "all", at, bins)
                _counted(state, "pos", at[own], bins)
            if moments:
                _moments(state, x, own)

    def finish(state):
        if "pos" in state:
            at = np.flatnonzero(state["all"])
            yield _measured_rows("histogram", {"bin": at, "n_pos": state["pos"][at], "n_neg": state["all"][at] - state["pos"][at]})
        for side in (True, False):
            if side in state:
                yield _measured_rows("moments", {"is_pos": [side], **{c: [v] for c, v in zip(MOMENTS, state[side])}})

    if not {"histogram", "moments"}.isdisjoint(keep or {}):
        raise ValueError("these names are taken")
    return Measured(kept(run_tiles(samples, each, MEASURED, size, within, finish, chosen)))


def above(samples: DataFrame, levels: list[float], closed: bool = False, size: int = SIZE) -> dict[float, int]:
    """How many same-identity pairs score above (with ``closed``: at least) each level, counted inside the tiles."""
    levels = sorted(set(levels))
    edges = np.array(levels)

    def each(state, a, b, same):
        sim, want = scores(a, b, same)
        x = sim.ravel() if want is None else sim[want]
        below = np.searchsorted(edges, x, "right" if closed else "left")  # levels that the score passes
        state["n"] = state.get("n", 0) + np.bincount(below, minlength=len(edges) + 1)[::-1].cumsum()[::-1][1:]
        return ()

    def finish(state):
        if state:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(edges))), pa.array(state["n"])], names=["k", "n"])

    found = run_tiles(samples, each, "k long, n long", size, True, finish).groupBy("k").agg(F.sum("n").alias("n")).collect()  # a row a level
    return dict.fromkeys(levels, 0) | {levels[r["k"]]: r["n"] for r in found}
