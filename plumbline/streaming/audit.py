"""Auditing a folder that JSON lines drop into, as a stream of micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.config import Config
from plumbline.functions.canonical import raw_key
from plumbline.operators import rules
from plumbline.schema import parsed, split


def lines(spark: SparkSession, folder: str, cfg: Config | None = None, ttl: str | None = None) -> DataFrame:
    """New lines of the folder, each raw body once within the time that the memo keeps it."""
    cfg = cfg or Config()
    ttl = ttl or f"{cfg.cache_ttl_seconds} seconds"
    d = spark.readStream.text(folder).where(F.trim("value") != "")
    d = d.withColumn("key", raw_key(F.col("value"), cfg.version, cfg.model_revision)).withColumn("arrived", F.current_timestamp())
    return d.withWatermark("arrived", ttl).dropDuplicatesWithinWatermark(["key"])


def observed_findings(findings: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """findings that count themselves by verdict as they pass; the figures are there once an action has run, without a second pass."""
    o = Observation(name)
    by = [F.count(F.when(F.col("verdict") == v, 1)).alias(v) for v in (rules.FLAG, rules.WARN, rules.PASS, rules.NA)]
    return findings.observe(o, F.count(F.lit(1)).alias("findings"), *by), o


def observed_lines(bad: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Quarantined lines (raw, errors) that count themselves, and those among them that are no JSON."""
    o = Observation(name)
    return bad.observe(o, F.count(F.lit(1)).alias("quarantined"), F.count(F.when(F.array_contains("errors", "not_json"), 1)).alias("not_json")), o


def start(spark: SparkSession, folder: str, findings: str, quarantine: str, checkpoint: str, cfg: Config | None = None, once: bool = False, on_metrics: Callable[[int, dict], None] | None = None) -> StreamingQuery:
    """Append findings and quarantined lines as Parquet; a batch that runs again replaces its own folder.

    on_metrics gets each batch's number and figures, observed while the batch is written.
    """
    cfg = cfg or Config()

    def audit(batch: DataFrame, number: int) -> None:
        good, bad = split(parsed(batch.select("value")))
        found, one = observed_findings(rules.findings(good, cfg), f"findings-{number}")
        found.write.mode("overwrite").parquet(f"{findings}/batch={number}")
        lost, two = observed_lines(bad.select("raw", "errors"), f"quarantine-{number}")
        lost.write.mode("overwrite").parquet(f"{quarantine}/batch={number}")
        if on_metrics:
            on_metrics(number, one.get | two.get)

    w = lines(spark, folder, cfg).writeStream.foreachBatch(audit).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
