"""Sample sets: sample_id long, identity long, v array<double>, path string."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairscope.functions import vectors as V
from pairscope.sources.tables import kept

def load(spark: SparkSession, path: str, policy: str = "raw", sample_id="vec_id", identity="label", embedding="embedding", max_n: int | None = None) -> DataFrame:
    """Reads parquet and normalises. max_n keeps the samples with sample_id < max_n; identities may be any comparable type."""
    table = spark.read.parquet(path)
    if max_n is not None:
        table = table.where(F.col(sample_id) < max_n)
    kind = dict(table.dtypes)[identity]
    who = F.col(identity).cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(identity)
    shown = F.col("path") if "path" in table.columns else F.concat(F.lit("vec_"), F.col(sample_id).cast("string"))
    return table.select(F.col(sample_id).cast("long").alias("sample_id"), who.alias("identity"), V.normalised(F.col(embedding), policy).alias("v"), shown.alias("path"))


def raw(spark: SparkSession, path: str, sample_id="vec_id", identity="label", embedding="embedding") -> DataFrame:
    """As stored, vectors as doubles: what is already normalised needs no division."""
    table = spark.read.parquet(path)
    return table.select(F.col(sample_id).cast("long").alias("sample_id"), F.col(identity).cast("long").alias("identity"), V.doubles(F.col(embedding)).alias("v"), F.concat(F.lit("vec_"), F.col(sample_id).cast("string")).alias("path"))


def problems(samples: DataFrame, least_dim: int = 1) -> DataFrame:
    """One row of counts; all zero for a valid sample set."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    bad = lambda c: F.count_if(F.coalesce(c, F.lit(True))).alias
    one = samples.agg(
        F.count("*").alias("n_rows"),
        bad(F.col("v").isNull())("null_vectors"),
        bad(F.col("v").isNotNull() & ~finite)("not_finite"),
        bad(finite & (V.norm(F.col("v")) == 0) & F.col("v").isNotNull())("zero_vectors"),
        bad(F.size("v") < least_dim)("too_short"),
        (F.coalesce(F.max(F.size("v")) - F.min(F.size("v")), F.lit(0))).alias("ragged"),
        F.count_if(F.col("identity").isNull()).alias("null_identities"),
        F.count_if(F.col("sample_id").isNull()).alias("null_ids"),
    )
    again = samples.groupBy("sample_id").count().agg(F.count_if(F.col("count") > 1).alias("repeated_ids"))
    return one.crossJoin(F.broadcast(again))  # one row each


def validated(samples: DataFrame, least_dim: int = 1) -> DataFrame:
    """The samples, or an error: a NaN would become a perfect score, a repeated id would lose pairs."""
    found = problems(samples, least_dim).first().asDict()
    wrong = {k: v for k, v in found.items() if v and k != "n_rows"}
    if wrong:
        raise ValueError(f"invalid samples: {wrong}")
    return samples


def set_normalised(samples: DataFrame, off: float = 1e-3, eps: float | None = None) -> DataFrame:
    """All vectors divided by their norms if any norm of the set is off 1 by more than ``off``; else as they are. A zero vector
    is an error, or with ``eps`` stays zero (norms are at least that)."""
    n = V.norm(F.col("v"))
    wrong, zeros = samples.agg(F.max(F.abs(n - 1)), F.count_if(n == 0)).first()
    if zeros and eps is None:
        raise ValueError(f"{zeros} zero vectors have no direction")
    if wrong is None or wrong <= off:
        return samples
    return samples.withColumn("v", V.normalised(F.col("v"), "raw" if eps is None else "eps", eps or 1e-10))


def numbered_in_order(rows: DataFrame, key: str, name: str, size: int = 50_000) -> DataFrame:
    """All columns and ``name``: the place (from 0) in the order of ``key``, a whole number that no two rows share. Rows are dealt
    to ranges of about ``size`` and sorted there; a row's number is its place in its range after the sizes of the ranges before."""
    ranges = min(10_000, max(1, -(-rows.count() // size)))
    dealt = rows.repartitionByRange(ranges, key).sortWithinPartitions(key).withColumn("at__", F.monotonically_increasing_id())
    dealt = kept(dealt)  # the range is the upper part of the number, the place in it the lower one
    before = Window.orderBy("range__").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sizes = dealt.groupBy(F.shiftright("at__", 33).alias("range__")).agg(F.count("*").alias("c__"))
    bases = sizes.select("range__", F.coalesce(F.sum("c__").over(before), F.lit(0)).alias("base__"))
    placed = dealt.withColumn("range__", F.shiftright("at__", 33)).join(F.broadcast(bases), "range__")  # at most 10,000 rows
    return placed.withColumn(name, (F.col("base__") + F.col("at__").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("range__", "at__", "base__")


def compact_identities(samples: DataFrame) -> DataFrame:
    """identity as 0 .. G-1 in its order. The distinct identities are ranked, not the samples."""
    ranked = numbered_in_order(samples.select("identity").distinct(), "identity", "code")
    return samples.join(ranked, "identity").select("sample_id", F.col("code").alias("identity"), "v", "path")


def sorted_by_identity(samples: DataFrame) -> DataFrame:
    """Ordered by identity; ``order`` is the place that a sample had before, by sample_id."""
    return numbered_in_order(samples, "sample_id", "order").orderBy("identity", "order")


def generate(spark: SparkSession, identities: int, per_identity: int, dim: int = 512, noise: float = 0.15, seed: int = 42) -> DataFrame:
    """Centres plus noise, renormalised: so many samples of so many identities."""
    rows = spark.range(identities * per_identity).select(F.col("id").alias("vec_id"), F.expr(f"id div {per_identity}").alias("label"), (F.col("id") % per_identity).alias("at"))
    return generated(rows, dim, noise, seed).select("vec_id", "label", "embedding", F.format_string("identity_%06d/sample_%04d.jpg", "label", F.col("vec_id") % per_identity).alias("path"))


def generated(rows: DataFrame, dim: int = 512, noise: float = 0.15, seed: int = 42) -> DataFrame:
    """vec_id, label, embedding: a made vector for each row (vec_id, label), a centre of the label plus noise, renormalised. Labels
    and rows have random streams of their own, so a row's vector does not depend on which others there are or how they are dealt."""

    def make(parts):
        for part in parts:
            made = []
            for i, who in zip(part["vec_id"], part["label"]):
                mid = np.random.default_rng([seed, int(who)]).standard_normal(dim)
                mid /= np.linalg.norm(mid)
                x = mid + noise * np.random.default_rng([seed, int(who), int(i)]).standard_normal(dim)
                made.append((x / np.linalg.norm(x)).astype(np.float32))
            yield pd.DataFrame({"vec_id": part["vec_id"], "label": part["label"], "embedding": made})

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label")).mapInPandas(make, "vec_id long, label long, embedding array<float>")


def files(spark: SparkSession, root: str, extension: str | None = None) -> DataFrame:
    """Paths below a folder, at any depth."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if extension:
        reader = reader.option("pathGlobFilter", f"*{extension}")
    return reader.load(root).select("path", "length")


def folder_parents(paths: DataFrame) -> DataFrame:
    """(child, parent) of two-level folders parent/child/file; of several parents the greatest."""
    parts = paths.select(F.split("path", "/").alias("p")).where(F.size("p") >= 3)
    return parts.select(F.element_at("p", -2).alias("child"), F.element_at("p", -3).alias("parent")).groupBy("child").agg(F.max("parent").alias("parent"))
