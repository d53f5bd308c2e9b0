"""Run records and usage ledgers as files: stated schemas, lines that do not fit set apart, nothing inferred.

Defined cases: a line or object that does not fit its schema goes to the bad rows with its text; missing fields are null; a JSON
field that cannot be read is null in its parts; a folder without rows gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairscope.sources.tables import kept

RUN = "stage string, model string, status string, reason string, load_s double, core_s double, wall_s double, peak_rss_gb double, timeout_s double, pairs struct<total:long,pos:long,neg:long>"
USAGE = "input_tokens long, output_tokens long, cache_read_tokens long, cache_creation_tokens long"
LEDGER = "request_id string, app string, provider string, model string, created_at long, cost_usd double, usage string"
BAD = "bad_record"


def _parted(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    read = kept(read)  # parsed as a whole, whatever columns are asked for: else fields that nobody reads are not checked
    return read.where(F.col(BAD).isNull()).drop(BAD), read.where(F.col(BAD).isNotNull()).select(BAD)


def runs(spark: SparkSession, path: str, one_per_file: bool = False) -> tuple[DataFrame, DataFrame]:
    """Run records in JSON, one a line or one a file, with success and pairs as the ranking wants them; and what is none."""
    read = spark.read.schema(f"{RUN}, {BAD} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).option("multiLine", one_per_file).json(path)
    good, bad = _parted(read)
    return good.select("stage", "model", (F.col("status") == "success").alias("success"), "status", "reason", "core_s", "wall_s", "peak_rss_gb", "timeout_s", F.col("pairs.total").alias("pairs"), F.col("pairs.pos").alias("n_pos"), F.col("pairs.neg").alias("n_neg")), bad


def ledger(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A ledger of requests in CSV with a header: epoch seconds, and a JSON field of token counts; and what is none."""
    read = spark.read.schema(f"{LEDGER}, {BAD} string").option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).option("quote", '"').option("escape", '"').option("enforceSchema", False).csv(path)
    good, bad = _parted(read)
    opened = good.withColumn("u", F.from_json("usage", USAGE)).withColumn("at", F.timestamp_seconds("created_at"))
    return opened.select("request_id", "app", "provider", "model", "at", F.to_date("at").cast("string").alias("day"), "cost_usd", *(f"u.{c.split(' ')[0]}" for c in USAGE.split(", "))), bad
