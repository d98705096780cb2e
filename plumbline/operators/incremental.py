"""Auditing only what is new: a table of responses by raw key and settings, and the first so many records in an order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.config import Config
from plumbline.functions.canonical import content_hash, raw_key
from plumbline.operators import rules
from plumbline.schema import parsed, split
from plumbline.sources import files

STORED = "key string, study_id string, feasibility_verdict string, completeness_score double, checks_json string, input_hash string, errors array<string>"
RANGES = 200


def store_path(store: str, cfg: Config) -> str:
    """The settings' own part of a store: other settings or rules find nothing there, so that a change audits all lines again."""
    return f"{store}/config={cfg.version}-{cfg.model_revision}-{cfg.rules_version}"


def stored(spark, store: str, cfg: Config) -> DataFrame:  # noqa: ANN001
    """What is known under these settings, a row a key (two runs at the same time may have stored one twice)."""
    path = store_path(store, cfg)
    if not files.exists(spark, path):
        return spark.createDataFrame([], STORED)
    return spark.read.schema(STORED).option("recursiveFileLookup", "true").parquet(path).dropDuplicates(["key"])


def audit_new(lines: DataFrame, store: str, cfg: Config | None = None, line: str = "value") -> DataFrame:
    """Responses (STORED, with the line) of all lines that aren't blank; only those whose raw key the store lacks are audited.

    A line that isn't valid is stored with its errors and no verdict, so that it isn't parsed again either. Every line gets its row,
    repeated ones the same response. The new ones are written as a batch of their own before they are read, so
    a run that fails leaves the store as it was.
    """
    cfg = cfg or Config()
    spark = lines.sparkSession
    keyed = lines.where(F.trim(F.col(line)) != "").select(F.col(line).alias("value"), raw_key(F.col(line), cfg.version, cfg.model_revision).alias("key"))
    known = stored(spark, store, cfg).select("key")
    fresh = keyed.dropDuplicates(["key"]).join(known, "key", "left_anti")
    own = raw_key(F.col("raw"), cfg.version, cfg.model_revision)
    # written first: the batch's valid and other lines are then read from one parse
    new = files.written(parsed(fresh.select("value")).withColumn("key", own), "audit-new")
    good, bad = split(new)
    good = good.withColumn("input_hash", content_hash(F.col("raw"), cfg.version, cfg.model_revision))
    none = F.lit(None)
    rows = rules.responses(good, cfg, keep=("key", "input_hash")).withColumn("checks_json", F.to_json("checks")).withColumn("errors", none.cast("array<string>"))
    names = [f.split()[0] for f in STORED.split(", ")]
    kinds = dict(f.split(" ", 1) for f in STORED.split(", "))
    lost = bad.select("key", "errors", *[none.cast(kinds[n]).alias(n) for n in names if n not in ("key", "errors")])
    files.append(rows.select(*names).unionByName(lost.select(*names)), store_path(store, cfg))
    return keyed.join(stored(spark, store, cfg), "key")


def accept_first(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in an order (whose columns together are unique), without a sort of all: fewer than n raise an error.

    Rows are dealt to ranges of the order and written so; counts of the ranges say which are taken whole and where
    the cut lies, and only that range is sorted.
    """
    ranged = files.written(df.repartitionByRange(RANGES, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("__range").agg(F.count("*").alias("c")).orderBy("__range").collect()  # at most RANGES rows
    left, cut = n, -1
    for r in counts:
        cut = r["__range"]
        if r["c"] >= left:
            break
        left -= r["c"]
    else:
        if left:
            raise RuntimeError(f"cohort incomplete: {n - left} of {n} accepted")
    whole = ranged.where(F.col("__range") < cut)
    last = ranged.where(F.col("__range") == cut).orderBy(*order).limit(left)
    return whole.unionByName(last).drop("__range")
