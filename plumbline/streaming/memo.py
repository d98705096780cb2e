"""Responses to a stream of raw bodies, remembered by key for a time.

State keeps one response for each raw key (body, settings and extractor): a body that comes again within the time to live gets the
response that was given first, marked as a hit; after that it is a miss again. Needs the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from plumbline.config import Config
from plumbline.functions.canonical import raw_key
from plumbline.operators import rules
from plumbline.schema import parsed

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ANSWER = "key string, response string, status string"


class Memo(StatefulProcessor):
    """The first response of each key, kept for so many milliseconds."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("response", "response string", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        known = self.kept.get()[0] if self.kept.exists() else None
        for batch in rows:
            status = []
            for response in batch["response"]:
                status.append("miss" if known is None else "hit")
                if known is None:
                    known = response
                    self.kept.update((response,))
            yield pd.DataFrame({"key": key[0], "response": known, "status": status})

    def close(self) -> None:
        pass


def answers(lines: DataFrame, cfg: Config | None = None, ttl_seconds: int | None = None) -> DataFrame:
    """(key, response, status) of a stream of lines (value): responses as JSON, or the errors of a line that isn't valid."""
    cfg = cfg or Config()
    r = parsed(lines.where(F.trim("value") != ""))
    key = raw_key(F.col("raw"), cfg.version, cfg.model_revision)
    out = rules.responses(r.withColumn("key", key), cfg, keep=("key", "errors"))
    body = F.to_json(F.struct("study_id", "completeness_score", "feasibility_verdict", "checks", "config_version", "rules_version"))
    refused = F.to_json(F.struct("errors"))
    told = out.select("key", F.when(F.size("errors") > 0, refused).otherwise(body).alias("response"))
    memo = Memo(1000 * (ttl_seconds or cfg.cache_ttl_seconds))
    return told.groupBy("key").transformWithStateInPandas(memo, outputStructType=ANSWER, outputMode="Append", timeMode="ProcessingTime")


def start(spark: SparkSession, folder: str, output: str, checkpoint: str, cfg: Config | None = None, ttl_seconds: int | None = None, once: bool = False) -> StreamingQuery:
    """Answers to the lines that drop into a folder, as Parquet. once: one batch (available-now never ends where state has a time to live)."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    w = answers(spark.readStream.text(folder), cfg, ttl_seconds).writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint)
    return (w.trigger(once=True) if once else w).start()
