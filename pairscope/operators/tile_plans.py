"""How the pairs of a sample set fall to blocks of ids: tiles, which of them hold positives, and even splits of rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairscope.plans import tiled
from pairscope.sources.samples import numbered_in_order


def tile_plan(samples: DataFrame, size: int) -> DataFrame:
    """bi <= bj of the blocks of ``size`` consecutive samples in the order of their ids, rows and columns of each tile, and its number
    of pairs."""
    placed = numbered_in_order(samples.select("sample_id"), "sample_id", "r")
    b = placed.groupBy(F.expr(f"r div {size}").alias("b")).agg(F.count("*").alias("n"))
    left, right = (b.select(F.col("b").alias(f"b{k}"), F.col("n").alias(f"n_{k}")) for k in "ij")
    count = F.when(F.col("bi") == F.col("bj"), F.expr("n_i * (n_i - 1) div 2")).otherwise(F.col("n_i") * F.col("n_j"))
    return left.join(right, F.col("bi") <= F.col("bj")).select("bi", "bj", F.col("n_i").alias("n_rows"), F.col("n_j").alias("n_columns"), count.alias("n_pairs"))


def positive_tiles(samples: DataFrame, size: int) -> DataFrame:
    """Tiles (of blocks of ``size`` consecutive ids) that hold a pair of one identity. The identities of the blocks are dealt as
    samples are, all of a block to one place, so a tile is found by one task only: nothing is made distinct afterwards."""
    own = samples.groupBy("identity", F.expr(f"sample_id div {size}").alias("b")).agg(F.count("*").alias("c"))
    rows = own.where("identity is not null").select(F.col("b").alias("sample_id"), "identity", F.array(F.col("c").cast("double")).alias("v"))

    def each(state, a, b, same):
        left, right = np.unique(a.ids), np.unique(b.ids)
        hit = np.zeros((len(left), len(right)), bool)
        x, y = np.searchsorted(left, a.ids), np.searchsorted(right, b.ids)
        for who in np.intersect1d(a.who, b.who):
            hit[np.ix_(x[a.who == who], y[b.who == who])] = True
        if same:  # a block with itself: two samples of one identity
            hit = np.triu(hit, 1)
            alone = x[a.v[:, 0] > 1]
            hit[alone, alone] = True
        for lo in range(0, len(left), 64):
            i, j = np.nonzero(hit[lo : lo + 64])
            one, two = left[lo + i], right[j]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], names=["bi", "bj"])

    return tiled.run_tiles(rows, each, "bi long, bj long", 4096)


def identity_ranges(samples: DataFrame, size: int) -> DataFrame:
    """Least and greatest identity of each block: blocks whose ranges do not meet share none."""
    return samples.groupBy(F.expr(f"sample_id div {size}").alias("b")).agg(F.min("identity").alias("least"), F.max("identity").alias("most"))


def _rows(samples: DataFrame) -> tuple[DataFrame, int]:
    """r: the places of the samples in the order of their ids; and how many there are."""
    return numbered_in_order(samples.select("sample_id"), "sample_id", "r").select("r"), samples.count()


def row_splits(samples: DataFrame, parts: int) -> DataFrame:
    """Least row from which at most (parts - p) / parts of the pairs are left, for p = 0 .. parts - 1."""
    rows, n = _rows(samples)
    left = F.expr(f"({n} - r) * ({n} - r - 1) div 2")
    p = F.broadcast(samples.sparkSession.range(parts).withColumnRenamed("id", "part"))  # a row a part
    return rows.crossJoin(p).where(left * parts <= F.lit(n * (n - 1) // 2) * (F.lit(parts) - F.col("part"))).groupBy("part").agg(F.min("r").alias("first_row"))


def equal_area_bounds(samples: DataFrame, parts: int) -> DataFrame:
    """Rows before each bound, so that the parts between hold about as many pairs each."""
    rows, n = _rows(samples)
    k = F.broadcast(samples.sparkSession.range(parts + 1).select(F.col("id").alias("k")))  # a row a bound
    before = F.col("r") + 1 <= n * (1 - F.sqrt(1 - F.col("k") / parts)) + 0.5
    return rows.crossJoin(k).groupBy("k").agg(F.count_if(before).alias("bound"))
