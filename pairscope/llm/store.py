"""Shared tables that cut lineage, and small helpers every operator of this folder uses."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid
import weakref

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ROOTS: dict[str, str] = {}
_PATHS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def shared_root(spark: SparkSession) -> str:
    """This application's folder below the shared one named by ``spark.checkpoint.dir``.

    Only where the setting is absent and the master is local (single-machine tests) a folder of our own is set.
    """
    sc = spark.sparkContext
    if sc.applicationId in _ROOTS:
        return _ROOTS[sc.applicationId]
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(base)
    root = f"{base.rstrip('/')}/pairscope-{sc.applicationId}-{uuid.uuid4().hex[:8]}"
    _ROOTS[sc.applicationId] = root
    atexit.register(_remove, spark, root)
    return root


def _remove(spark: SparkSession, root: str) -> None:
    """The application's tables go with the application."""
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the JVM may have ended already
        pass


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def as_table(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: what follows no longer depends on how it was made."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def free(*tables: DataFrame) -> None:
    """Removes tables of ``as_table`` whose consumers have been written, so that nothing can be asked of them again."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(_PATHS.pop(t))
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with its columns named c0, c1, ... and the names they had: names of our own beside them never clash."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns)))), df.columns


def parts_for(df: DataFrame, n_bytes, most: int) -> int:
    """Partitions of a shuffle so that each has at most about ``most`` bytes (a column's sum), and no fewer than the session's."""
    total = df.agg(F.sum(n_bytes)).first()[0] or 0
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / most))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def chunks(column: pa.Array, most_bytes: int = 4 << 20):
    """Yields (first row, last row + 1, bytes, offsets) of a text column, whole texts together up to ``most_bytes``
    (a longer text stands alone). Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most_bytes, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def plus(schema: T.StructType, fields: str) -> T.StructType:
    """A new schema with more fields, stated as "name type, ..."."""
    return T.StructType([*schema.fields, *(T.StructField(n, T._parse_datatype_string(t)) for n, t in (f.split(" ") for f in fields.split(", ")))])
