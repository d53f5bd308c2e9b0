"""Intermediate results that cut lineage: tables in the shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}


def _root(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``; a folder of our own only where none is named on a local master."""
    sc = spark.sparkContext
    if sc.applicationId not in _ROOTS:
        base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
        if not base:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="spark-")
        _ROOTS[sc.applicationId] = f"{base.rstrip('/')}/pairs-{sc.applicationId}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _ROOTS[sc.applicationId])
    return _ROOTS[sc.applicationId]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)
    except Exception:  # the JVM may have ended already
        pass


def fresh(spark: SparkSession) -> str:
    """A path below the shared folder that nothing has yet."""
    return f"{_root(spark)}/{uuid.uuid4().hex[:12]}"


def kept(df: DataFrame) -> DataFrame:
    """Written and read again. (A checkpoint would carry the constraints of all rounds before into the next plan.)"""
    path = fresh(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def released(spark: SparkSession):
    """Inside, Spark removes the shuffle files of what is run as soon as it has ended, not when the driver next collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
