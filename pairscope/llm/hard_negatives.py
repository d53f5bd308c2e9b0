"""Operator 12, hard-negative mining: per-anchor full score sort over blocks of rows.

Vectors become whole numbers, so scores are exact sums in any order. Rows are packed into blocks where they are read, and blocks
into *stripes*; the anchors' blocks go to every stripe by an equal join on its number. So a task scores its stripe's rows against
all anchors, strip by strip, and what leaves it is bounded by the anchors, not by the rows. There are two passes:

1. positives: same-label rows in the order of (score, id), of which each task sends its first ones of each anchor, and a ranking
   over the tasks' answers keeps the first ``positives``;
2. negatives: the scores of an anchor against a block are sorted in full by score and id, the upper limit of each positive is
   found by binary search in them, and the first ``k`` entries of other labels above its lower limit are read. A task merges
   the answers of its blocks; a ranking over the tasks gives the first ``k`` of all.

Reading the first k of every block is exact, not a cap: what is not among the first k of its block is not among the first k.

Defined cases: rows with a null id, label or vector or with a component that is null or not finite take no part; an empty vector
scores 0, and of vectors of different lengths the shorter one counts as filled up with zeros; rows with an anchor's own id are
never its positives; repeated rows are rows of their own (a repeated anchor is mined once a row, a repeated row may be returned
several times); ties go to the smaller id; anchors without positives, and positives without negatives between the limits, have
no rows; an empty table gives an empty result; other columns, under any name, are not read. Scores of 2^53 or more (components
beyond about 10^6) are an error: they would not be exact.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairscope.llm.store import as_table, free

SCALE = 256
ROWS = 4096  # rows of a block
ANCHORS = 256  # anchors of a block
STRIP = 64  # anchors whose scores are held at once
MOST = 1 << 20  # entries that a task holds before it sends them
_KINDS = [np.int16, np.int32, np.int64]


def usable(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """id, label, v (whole numbers) of the rows that take part; from columns id, label, v."""
    x = F.transform("v", lambda c: c.cast("double"))
    known = F.col("id").isNotNull() & F.col("label").isNotNull() & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return rows.where(known).select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of numbers as rows of the smallest whole-number kind, filled up with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = np.asarray(column.flatten())
    kind = next(k for k in _KINDS if not len(flat) or (flat.min() >= np.iinfo(k).min and flat.max() <= np.iinfo(k).max))
    dim = int(sizes.max(initial=0))
    out = np.zeros((len(sizes), dim), kind)
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def _packed(size: int, extra: list[str]):
    """Rows as blocks: ids ascending, with labels, vectors and the extra columns beside them as bytes."""

    def emit(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, size):
                part = batch.slice(lo, size)
                ids = np.asarray(part.column("id"), np.int64)
                by = np.argsort(ids, kind="stable")
                v = _matrix(part.column("v"))[by]
                rest = [np.asarray(part.column(c), np.int64)[by].tobytes() for c in ["label", *extra]]
                columns = [ids[by].tobytes(), *rest, v.astype(v.dtype.newbyteorder("<")).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v.dtype.itemsize], pa.int32()), *(pa.array([c], pa.binary()) for c in columns)], names=["kind", "ids", "labels", *extra, "v"])

    return emit


def _blocks(rows: DataFrame, size: int, extra: tuple = ()) -> DataFrame:
    names = "".join(f", {c} binary" for c in ("ids", "labels", *extra, "v"))
    return rows.select("id", "label", *extra, "v").mapInArrow(_packed(size, list(extra)), "kind int" + names)


def _opened(row: dict, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = (np.frombuffer(row[f"{c}_{side}"], np.int64) for c in ("ids", "labels"))
    v = np.frombuffer(row[f"v_{side}"], f"<i{row[f'kind_{side}']}")
    return ids, labels, v.reshape(len(ids), -1).astype(np.float64)


def _scored(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    dim = min(a.shape[1], b.shape[1])
    a, b = a[:, :dim], b[:, :dim]
    if dim * max(1.0, np.abs(a).max(initial=0)) * np.abs(b).max(initial=0) >= 2**53:
        raise ValueError("scores of 2^53 or more are not exact")
    return (a @ b.T).astype(np.int64)  # sums of whole numbers below 2^53: exact in any order


def _meet(anchors: DataFrame, rows: DataFrame, stripes: int) -> DataFrame:
    """Every block of anchors with every block of rows, once: by the number of the rows' stripe."""
    one = anchors.select(*(F.col(c).alias(f"{c}_a") for c in anchors.columns), F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"))
    two = rows.select(*(F.col(c).alias(f"{c}_b") for c in rows.columns), F.pmod(F.xxhash64("ids"), F.lit(stripes)).cast("int").alias("stripe"))
    # the anchors' blocks are many more after they are copied to the stripes than Spark expects of their table: never broadcast
    return one.join(two.hint("merge"), "stripe").drop("stripe")


def _first(key: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the first ``most`` of each key in the order of (score, id)."""
    by = np.lexsort((ids, -score, key))
    key = key[by]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    start = np.flatnonzero(new)
    inside = np.arange(len(key)) - np.repeat(start, np.diff(np.append(start, len(key))))
    return by[inside < most]


class _Best:
    """The first ``most`` entries (key, score, id) of each key so far; merged whenever there are many."""

    def __init__(self, most: int):
        self.most, self.parts, self.size, self.kept = most, [], 0, 0

    def add(self, *columns: np.ndarray) -> None:
        if len(columns[0]):
            self.parts.append(columns)
            self.size += len(columns[0])
            if self.size > 100_000 + 2 * self.kept:
                columns = self._merged()
                self.parts, self.size, self.kept = [columns], len(columns[0]), len(columns[0])

    def _merged(self) -> tuple:
        columns = [np.concatenate(c) for c in zip(*self.parts)]
        keep = _first(*columns, self.most)
        return tuple(c[keep] for c in columns)

    def sent(self, least: int = 0):
        """What is held, if it is more than ``least``; then nothing is held. The ranking over the tasks merges it with the rest."""
        if self.kept >= least and self.parts:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in self._merged()], names=["own", "score", "id"])
            self.parts, self.size, self.kept = [], 0, 0


def _near(most: int):
    """Of each anchor its first rows of the same label."""

    def emit(batches):
        best = _Best(most)
        for batch in batches:
            for row in batch.to_pylist():
                own = np.frombuffer(row["own_a"], np.int64)
                ids, labels, v = _opened(row, "a")
                other, kinds, w = _opened(row, "b")
                for label in np.intersect1d(labels, kinds):
                    mine, theirs = np.flatnonzero(labels == label), np.flatnonzero(kinds == label)
                    for lo in range(0, len(mine), STRIP):
                        some = mine[lo : lo + STRIP]
                        score = _scored(v[some], w[theirs])
                        order = np.argsort(-score, axis=1, kind="stable")[:, : most + 1]  # ids ascend; one more, as its own id may be there
                        x, y = np.repeat(some, order.shape[1]), theirs[order.ravel()]
                        s = np.take_along_axis(score, order, 1).ravel()
                        fits = other[y] != ids[x]
                        if (other[theirs][:, None] == ids[some]).sum(0).max(initial=0) > 1:  # repeated ids: look at all
                            x, y, s = np.repeat(some, len(theirs)), np.tile(theirs, len(some)), score.ravel()
                            fits = other[y] != ids[x]
                        best.add(own[x[fits]], s[fits], other[y[fits]])
                yield from best.sent(MOST)
        yield from best.sent()

    return emit


def _hard(k: int, low: int, high: int):
    """Of each positive of each anchor its first rows of other labels between the limits."""

    def emit(batches):
        best = _Best(k)
        for batch in batches:
            for row in batch.to_pylist():
                own, score_p = (np.frombuffer(row[f"{c}_a"], np.int64) for c in ("own", "score"))
                _, labels, v = _opened(row, "a")
                other, kinds, w = _opened(row, "b")
                # a block has an anchor once for each of its positives, one after another
                new = np.ones(len(own), bool)
                new[1:] = own[1:] // 256 != own[:-1] // 256
                heads = np.flatnonzero(new)
                tails = np.append(heads[1:], len(own))
                for lo in range(0, len(heads), STRIP):
                    some = heads[lo : lo + STRIP]
                    score = _scored(v[some], w)
                    order = np.argsort(-score, axis=1, kind="stable")  # by score, then by id, as ids ascend
                    ranked = np.take_along_axis(score, order, 1)
                    for i, head in enumerate(some.tolist()):
                        apart = np.flatnonzero(kinds[order[i]] != labels[head])
                        s = ranked[i, apart]
                        mine = slice(head, tails[lo + i])
                        upper, lower = high * score_p[mine] // 100, -(-low * score_p[mine] // 100)
                        start = np.searchsorted(-s, -upper, "left")
                        at = start[:, None] + np.arange(k)
                        good = at < len(s)
                        at = np.minimum(at, max(0, len(s) - 1))
                        good &= s[at] >= lower[:, None] if len(s) else False
                        which = np.nonzero(good)[0]
                        best.add(own[mine][which], s[at[good]] if len(s) else s, other[order[i, apart[at[good]]]] if len(s) else s)
                yield from best.sent(MOST)
        yield from best.sent()

    return emit


def _ranked(found: DataFrame, most: int) -> DataFrame:
    """With ``rank`` (from 1); each task sends few of a key, and Spark limits them again before they are shuffled."""
    order = Window.partitionBy("own").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


FOUND = "own long, score long, id long"


def mined(rows: DataFrame, anchor, positives: int = 5, k: int = 3, low: int = 50, high: int = 95, scale: int = SCALE, size: int = ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. ``rows`` has id, label and v; ``anchor`` says by
    its id which rows are anchors; limits are hundredths of the positive's score."""
    if positives > 255:
        raise ValueError("at most 255 positives of an anchor")
    part = usable(rows, scale)
    # a row of its own number for each anchor; a table, as the numbers must stay
    anchors = as_table(part.where(anchor(F.col("id"))).withColumn("own", F.monotonically_increasing_id()), "anchors")
    blocks = as_table(_blocks(part, size), "blocks")
    total = blocks.agg(F.sum(F.length("ids"))).first()[0] or 0
    stripes = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / 8 / size))
    near = _meet(_blocks(anchors, ANCHORS, ("own",)), blocks, stripes).mapInArrow(_near(positives), FOUND)
    best = as_table(_ranked(near, positives), "positives")
    # an anchor beside each of its positives; a positive's number is its anchor's and its rank
    wanted = anchors.select("own", F.col("id").alias("anchor"), "label", "v").join(best, "own").select(
        (F.col("own") * 256 + F.col("rank")).alias("own"), F.col("anchor").alias("id"), "label", "v", "score", F.col("id").alias("positive"))
    wanted = as_table(wanted, "wanted")
    asked = _blocks(wanted.repartition(F.expr("own div 256")).sortWithinPartitions("own"), ANCHORS, ("own", "score"))
    found = as_table(_ranked(_meet(asked, blocks, stripes).mapInArrow(_hard(k, low, high), FOUND), k), "negatives")
    free(anchors, best, blocks)
    named = found.select("own", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(wanted.select("own", "id", "positive", "score"), "own")
    return named.select(F.col("id").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), "negative_id", F.col("score").alias("positive_score"), "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(table.select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("v")), lambda i: i % 50 == 0)


OP12_SQL = """
WITH u AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM u a JOIN u b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b) AS INTEGER) AS rank, n.b AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""
