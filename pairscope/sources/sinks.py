"""Sinks: every result is a table; these give it the usual file forms. Text forms are compressed, as pairs grow with the square of the samples."""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def error_pairs(pairs: DataFrame) -> DataFrame:
    """The typed form of extracted pairs, also when there is none."""
    return pairs.select(
        F.when(F.col("is_pos"), "positive").otherwise("negative").alias("side"),
        F.col("sim").alias("score"),
        *("i", "id_i", "path_i", "j", "id_j", "path_j"),
    )


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").option("compression", "gzip").csv(path)


def write_tsv(df: DataFrame, path: str, kind: str) -> None:
    """Tab-separated parts below path/rows, and a one-line head file ``# kind= count=`` below path/head: the rows written are counted,
    not made again."""
    df.write.mode("overwrite").option("header", "true").option("sep", "\t").option("compression", "gzip").csv(f"{path}/rows")
    written = df.sparkSession.read.schema(df.schema).option("header", True).option("sep", "\t").csv(f"{path}/rows")
    head = written.agg(F.format_string("# kind=%s count=%d", F.lit(kind), F.count("*")).alias("value"))
    head.coalesce(1).write.mode("overwrite").text(f"{path}/head")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "gzip").json(path)


def write_files(rows: DataFrame, root: str) -> int:
    """A small file for each row (folder, name, text) below root/folder, and how many. The tasks write them: a commit of every single
    file, and what a local Hadoop file costs (processes that set its permissions), take longer than all else. Names hold the task and
    the row, so a repeated attempt writes the same files and equal names of rows stay apart."""
    store, base = fs.FileSystem.from_uri(root)
    store.create_dir(base)

    def write(batches):
        store, base = fs.FileSystem.from_uri(root)
        task, at, made = TaskContext.get().partitionId(), 0, set()
        for batch in batches:
            for folder, name, text in zip(*(batch.column(c).to_pylist() for c in ("folder", "name", "text"))):
                if folder not in made:
                    store.create_dir(f"{base}/{folder}")
                    made.add(folder)
                with store.open_output_stream(f"{base}/{folder}/{name}-{task}-{at}.txt") as out:
                    out.write((text or "").encode())
                at += 1
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64())], names=["n"])

    return rows.select("folder", "name", "text").mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_histogram(hist: DataFrame, path: str) -> None:
    write_parquet(hist, path)


def read_histogram(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("bin long, n_pos long, n_neg long").parquet(path)
