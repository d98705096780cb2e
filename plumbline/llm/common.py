"""What the training-data operators share: tables, written cuts of the lineage, words."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these characters (space and \t to \r).
SPACE_RE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir. Only a local session may do without one."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="plumbline-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/plumbline-{name}-{uuid.uuid4().hex}"
    p, fs = _path(spark, path)
    fs.deleteOnExit(p)
    return path


#: Spark then deletes a query's shuffle files when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK, _WRITERS = threading.Lock(), {"n": 0, "before": "false"}


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """Have shuffle files deleted with their query; the setting comes back when the last of several writers ends."""
    with _LOCK:
        if not _WRITERS["n"]:
            _WRITERS["before"] = spark.conf.get(CLEANUP, "false")
            spark.conf.set(CLEANUP, "true")
        _WRITERS["n"] += 1
    try:
        yield
    finally:
        with _LOCK:
            _WRITERS["n"] -= 1
            if not _WRITERS["n"]:
                spark.conf.set(CLEANUP, _WRITERS["before"])


def cut(df: DataFrame, name: str, rows_a_group: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it again.

    Later steps then start from files that survive a lost executor, not from
    the lineage before them; the shuffle files of that lineage go at once.
    The result knows its path, so that ``discard`` can delete it when it is consumed.
    Readers hold a row group's values at once, up to 4,096 rows: wide rows want few rows a group.
    """
    spark = df.sparkSession
    path = new_dir(spark, name)
    with _cleaning(spark):
        df.write.option("compression", "zstd").options(**({"parquet.block.row.count.limit": rows_a_group} if rows_a_group else {})).parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again.cut_path = path
    return again


def discard(*cuts: DataFrame) -> None:
    """Delete the files of cuts that nothing reads any more."""
    for df in cuts:
        p, fs = _path(df.sparkSession, df.cut_path)
        fs.delete(p, True)


def words(text: Column) -> Column:
    """array<string> of the words of a text; null counts as empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_RE, -1), lambda w: w != "")


def take_columns(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the wanted columns, under inner names that extra columns can't clash with."""
    return df.select(*[F.col(f"`{c}`").alias(n) for n, c in wanted.items()])
