"""Rankings of runs, and rollups of a usage ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ranking(runs: DataFrame, baseline: str) -> DataFrame:
    """runs: stage, model, success, wall_s, pairs, timeout_s. Ranks by wall time in a stage; throughput in 1e9 pairs a second."""
    base = runs.where(F.col("model") == baseline).select("stage", F.col("wall_s").alias("base_s"))
    order = Window.partitionBy("stage").orderBy(F.col("success").desc(), "wall_s", "model")
    return runs.join(base, "stage", "left").select(
        "stage", "model", F.row_number().over(order).cast("long").alias("place"), F.round(F.col("pairs") / F.col("wall_s") / 1e9, 4).alias("gpairs_s"),
        F.round(F.try_divide("wall_s", "base_s"), 4).alias("ratio"), (F.col("success") & (F.col("wall_s") <= F.col("timeout_s"))).alias("qualified"),
    )


def usage_rollup(ledger: DataFrame, by: list[str]) -> DataFrame:
    """Requests, tokens and cost of a ledger by any of its columns (day, app, provider, model); unknown token counts count as none."""
    tokens = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")
    return ledger.groupBy(*by).agg(F.count("*").alias("requests"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in tokens), F.round(F.sum("cost_usd"), 4).alias("cost_usd"))


def _seconds(ts):
    """Also of times without a zone, which count as UTC in a session whose zone is UTC."""
    return ts.cast("timestamp").cast("double")


def daily_rollup(events: DataFrame) -> DataFrame:
    return events.groupBy(F.to_date("ts").cast("string").alias("day"), "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"))


def session_rollup(events: DataFrame) -> DataFrame:
    span = _seconds(F.max("ts")) - _seconds(F.min("ts"))
    return events.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(span, 3).alias("span_s"))


def effective_time(events: DataFrame, most_gap_s: float = 600.0) -> DataFrame:
    """Span of each user without gaps above the limit; a gap of the limit itself counts."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = _seconds(F.col("ts")) - _seconds(F.lag("ts").over(w))
    rows = events.select("user_id", gap.alias("gap"))
    return rows.groupBy("user_id").agg(F.round(F.sum(F.when(F.col("gap") <= most_gap_s, F.col("gap")).otherwise(0.0)), 3).alias("effective_s"), F.count_if(F.col("gap") > most_gap_s).alias("breaks"))
