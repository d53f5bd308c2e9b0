"""Histograms of sample sets that grow, and of probes that stream in.

A store is a folder with a part for each version: the samples that came with it, and what they add to the histogram (their own pairs,
and their pairs with all samples before). The histogram of the whole set is the sum of the parts, so a new version costs the new
pairs alone. A version's parts replace what a broken attempt at it has left, so a retry adds nothing twice; the samples of a version
are seen by later ones only once its histogram is there.

Against a fixed gallery, probes arrive as a stream: each micro-batch is a version, numbered by Spark, which repeats the number of a
batch that it repeats after a restart. So every batch counts once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pairscope.functions import vectors as V
from pairscope.operators import histograms
from pairscope.plans import tiled
from pairscope.sources.tables import kept

SAMPLE = "sample_id long, identity long, v array<double>, path string"
HISTOGRAM = "bin long, n_pos long, n_neg long"


def in_one_file(hist: DataFrame) -> DataFrame:
    """At most as many rows as bins go to one task, which does not add them up: the tasks before it do."""
    return hist.repartition(1)


@dataclass(frozen=True)
class Store:
    """``path``: a folder that the driver and all executors share. Versions are whole numbers; one writer at a time."""

    spark: SparkSession
    path: str
    bins: int = V.BINS
    size: int = tiled.SIZE

    def _at(self, kind: str, version: int) -> str:
        return f"{self.path}/{kind}/version={version}"

    def versions(self) -> list[int]:
        """Finished versions: those whose histogram was written to its end."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/histogram")
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        parts = [f.getPath() for f in files.listStatus(folder)]
        done = [p for p in parts if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p.toString() + "/_SUCCESS"))]
        return sorted(int(p.getName().removeprefix("version=")) for p in done)

    def _read(self, kind: str, schema: str, versions: list[int]) -> DataFrame:
        if not versions:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(self._at(kind, v) for v in versions))

    def samples(self, before: int | None = None) -> DataFrame:
        return self._read("samples", SAMPLE, [v for v in self.versions() if before is None or v < before])

    def histogram(self) -> DataFrame:
        """bin, n_pos, n_neg of all pairs so far."""
        return histograms.added(self._read("histogram", HISTOGRAM, self.versions()))

    def add(self, samples: DataFrame, version: int) -> None:
        """Adds a version, or repeats its attempt. Later versions must not be there: their pairs were counted without this one."""
        if any(v > version for v in self.versions()):
            raise ValueError(f"there are versions after {version}")
        old = self.samples(before=version)
        samples.select("sample_id", "identity", "v", "path").write.mode("overwrite").parquet(self._at("samples", version))
        new = self._read("samples", SAMPLE, [version])
        again = new.join(old, "sample_id", "left_semi").count() + new.count() - new.select("sample_id").distinct().count()
        if again:
            raise ValueError(f"{again} samples are there already")
        own = tiled.histogram(new, self.bins, self.size)
        with_old = tiled.histogram(new, self.bins, self.size, chosen=tiled.cross_cells(new, old, self.size))
        self._put(histograms.added(own, with_old), version)

    def _put(self, hist: DataFrame, version: int) -> None:
        in_one_file(hist).write.mode("overwrite").parquet(self._at("histogram", version))

    def add_probes(self, probes: DataFrame, gallery: DataFrame, version: int) -> None:
        """Pairs of the probes with the gallery alone."""
        probes = kept(probes.select("sample_id", "identity", "v"))
        self._put(tiled.histogram(probes, self.bins, self.size, chosen=tiled.cross_cells(probes, gallery, self.size)), version)

    def follow(self, probes: DataFrame, gallery: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Runs the stream of probes (sample_id, identity, v) against the gallery; ``trigger`` as Spark takes it."""
        gallery = kept(gallery.select("sample_id", "identity", "v"))
        writer = probes.writeStream.foreachBatch(lambda batch, number: self.add_probes(batch, gallery, number)).option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).start()

    def compact(self, path: str) -> Store:
        """A store elsewhere with all samples and counts as its first version."""
        other = Store(self.spark, path, self.bins, self.size)
        self.samples().write.mode("overwrite").parquet(other._at("samples", 0))
        other._put(self.histogram(), 0)
        return other


def conserved(store: Store) -> DataFrame:
    """One row: pairs counted, and pairs that the samples have."""
    n = F.count("*")
    return store.histogram().agg(F.coalesce(F.sum(F.col("n_pos") + F.col("n_neg")), F.lit(0)).alias("counted")).crossJoin(store.samples().agg((n * (n - 1) / 2).cast("long").alias("pairs")))  # one row each
