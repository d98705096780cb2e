"""File sources and sinks: JSON lines, payloads, notices, ledgers, manifests."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import normalize
from plumbline.operators.extract import extract
from plumbline.schema import parsed, read_jsonl

__all__ = ["read_jsonl", "read_json", "read_texts", "read_notices", "read_ledger", "write_jsonl", "write_exactly", "write_queue", "write_report", "digest", "manifest", "publish", "read_stdin", "written", "append", "exists"]


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder (spark.checkpoint.dir); it goes when the driver ends."""
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not top:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="plumbline-")
        sc.setCheckpointDir(top)
    p, fs = _fs(spark, f"{top.rstrip('/')}/plumbline-{name}-{uuid.uuid4().hex}")
    fs.deleteOnExit(p)
    return p.toString()


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: later steps start from files that survive lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append(df: DataFrame, path: str) -> None:
    """df as a batch folder of its own below path; readers see it whole or not at all."""
    spark, name = df.sparkSession, uuid.uuid4().hex
    part, fs = _fs(spark, f"{path}/_partial-{name}")
    try:
        df.write.parquet(part.toString())
        final, _ = _fs(spark, f"{path}/batch-{name}")
        if not fs.rename(part, final):
            raise RuntimeError(f"{path} could not be extended")
    finally:
        fs.delete(part, True)


def read_stdin(spark: SparkSession) -> DataFrame:
    """What comes in on standard input, as JSON lines: one object or an array over several lines, or an object a line."""
    text = sys.stdin.read()
    lines = [x for x in text.splitlines() if x.strip()]
    whole = text.lstrip().startswith("[") or not all(x.strip().startswith("{") and x.strip().endswith("}") for x in lines)
    rows = spark.createDataFrame([(x,) for x in ([text] if whole else lines)], "value string")
    return rows.select(F.explode(F.when(F.trim("value").startswith("["), F.from_json("value", "array<string>")).otherwise(F.array("value"))).alias("value"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Records of whole JSON files, each an object or an array of objects."""
    whole = spark.read.text(path, wholetext=True)
    rows = F.when(F.trim("value").startswith("["), F.from_json("value", "array<string>")).otherwise(F.array("value"))
    return parsed(whole.select(F.explode(rows).alias("value")))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Text lines {text, study_id}, with what the extractor finds in them."""
    return extract(spark.read.schema("study_id string, text string").json(path))


def read_notices(spark: SparkSession, path: str) -> DataFrame:
    """Retraction notices (line, doi, reason, date) of a CSV with a header; the file's order is kept in line."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    names = {c.lstrip("﻿"): c for c in raw.columns}
    col = lambda n: F.col(f"`{names[n]}`") if n in names else F.lit(None).cast("string")
    # ids grow along a file, as partitions are its slices in order
    return raw.select(F.monotonically_increasing_id().alias("line"), F.coalesce(col("OriginalPaperDOI"), col("DOI")).alias("doi"), col("Reason").alias("reason"), col("RetractionDate").alias("date"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("release string, commit string, passed bigint, total bigint, run_url string").json(path)


def sorted_json(df: DataFrame) -> Column:
    """A row as compact JSON with its columns by name, nulls kept."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"})


def write_jsonl(df: DataFrame, path: str) -> None:
    df.select(sorted_json(df).alias("value")).write.mode("overwrite").text(path)


def write_exactly(df: DataFrame, path: str, rows: int) -> None:
    """Write df to path only if it has so many rows: to path.partial first, renamed at the end, deleted on failure."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    part, final = jvm.org.apache.hadoop.fs.Path(path + ".partial"), jvm.org.apache.hadoop.fs.Path(path)
    fs = final.getFileSystem(conf)
    try:
        write_jsonl(df, path + ".partial")
        got = spark.read.text(path + ".partial").count()
        if got != rows:
            raise RuntimeError(f"{got} rows, not {rows}")
        fs.delete(final, True)
        if not fs.rename(part, final):
            raise RuntimeError(f"{path} could not be replaced")
    finally:
        fs.delete(part, True)


def publish(df: DataFrame, about: DataFrame, path: str, rows: int) -> None:
    """Data (JSON lines) to path and its manifest to path.manifest, both or neither: with another number of rows, or on any failure, the old ones stay."""
    spark = df.sparkSession
    paths = [_fs(spark, x)[0] for x in (path + ".partial", path, path + ".manifest.partial", path + ".manifest")]
    fs = _fs(spark, path)[1]
    try:
        write_jsonl(df, path + ".partial")
        got = spark.read.text(path + ".partial").count()
        if got != rows:
            raise RuntimeError(f"{got} rows, not {rows}")
        write_report(about, path + ".manifest.partial")
        for part, final in (paths[:2], paths[2:]):
            fs.delete(final, True)
            if not fs.rename(part, final):
                raise RuntimeError(f"{final.toString()} could not be replaced")
    finally:
        fs.delete(paths[0], True)
        fs.delete(paths[2], True)


def write_queue(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def digest(records: DataFrame) -> Column:
    """An aggregate over records that no order of rows changes: SHA-256 of their count and of the sums of four parts of each row's SHA-256."""
    h = F.sha2(sorted_json(records), 256)
    part = lambda k: F.sum(F.conv(F.substring(h, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return F.sha2(F.concat_ws(":", F.count("*").cast("string"), *[F.coalesce(part(k), F.lit("0")) for k in range(4)]), 256)


def manifest(studies: DataFrame, records: DataFrame, requested: int, parameters: dict | None = None) -> DataFrame:
    """One row about a retrieval: requested, downloaded, accepted, exclusions by reason, request parameters, assertions and a digest."""
    seen = studies.agg(F.count("*").alias("downloaded"))
    out = normalize.exclusions(studies).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "studies")))).alias("exclusions"))
    one = records.agg(F.count("*").alias("accepted"), digest(records).alias("digest")).crossJoin(seen).crossJoin(out)
    given = F.create_map(*[F.lit(str(x)) for kv in sorted((parameters or {}).items()) for x in kv]).cast("map<string,string>")
    return one.withColumn("requested", F.lit(requested)).withColumn("request_parameters", given).withColumn("assertions", F.array(*[F.lit(x) for x in ("COMPLETED", "INTERVENTIONAL", "RANDOMIZED", "hasResults=true")]))


def write_report(row: DataFrame, path: str) -> None:
    """The only row of a DataFrame as an indented JSON object, by one task."""
    pretty = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(row.columns)]), {"pretty": "true", "ignoreNullFields": "false"})
    row.limit(1).select(pretty.alias("value")).coalesce(1).write.mode("overwrite").text(path)
