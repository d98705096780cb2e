"""Secret scans with corpus-wide ownership frequency.

Every text gives base spans (assignments, access keys, long hex runs) and wider
candidates (long tokens that mix letters and digits). The hash of each
candidate's value is counted over the whole corpus: in how many repositories
and for how many owners it occurs. A value that a share of all owners hold (two at
least, ten are always enough), or very many repositories of one owner, is a copied
example; others look live, and such wider candidates become spans of kind
``owned``. Built-in functions only; counts are taken level
by level (value, owner, repository), so that a value which fills a third of
the corpus is summed before it is shuffled.

Defined cases: a null text counts as empty and has no spans. A null owner is an
owner of its own, as is a null repository. Rows that repeat each get their row;
an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import spans as S
from plumbline.llm.common import cut, table, take_columns

# Fixed patterns of the base kinds, in the listed order.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BASE_KINDS = ("assign", "access", "hex")

#: A wider candidate: a whole token of 20 characters or more.
WIDE = r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{20,}+"
#: One part of it has 12 characters and goes from digits to letters and back; paths, addresses and model numbers have none such.
RANDOM = r"(?<![A-Za-z0-9+])(?=[A-Za-z+]*+[0-9]++[A-Za-z+]++[0-9])[A-Za-z0-9+]{12}"
#: A value that this share of all owners hold is a copied example, within these bounds on their number.
COPIED_SHARE = 0.01
COPIED_OWNERS = (2, 10)
#: So is one in this many repositories, even of a single owner.
COPIED_REPOSITORIES = 1000


def _assign_ok(m: Column) -> Column:
    return F.length(F.regexp_extract(m, ASSIGN, 1)) >= 6


def _wide_ok(m: Column) -> Column:
    return m.rlike(RANDOM)


def base_spans(text: Column) -> Column:
    """Assign, access and hex spans by start. {16,} and {24,} take whole greedy runs, as + and a length test do."""
    return S.merged(
        S.find(text, ASSIGN, "assign", 0, _assign_ok),
        S.find(text, ACCESS, "access", 1, guard=text.contains("AKIA")),
        S.find(text, HEX, "hex", 2),
    )


def value(span: Column) -> Column:
    """What is counted of a span: an assignment's value, else all of it."""
    return F.when(span["kind"] == "assign", F.regexp_extract(span["text"], ASSIGN, 1)).otherwise(span["text"])


def ownership(candidates: DataFrame) -> DataFrame:
    """(hash, n_repositories, n_owners) of rows (hash, owner, repository)."""
    one = candidates.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    two = one.groupBy("hash", "owner").agg(F.count("*").alias("n_repositories"))
    return two.groupBy("hash").agg(F.sum("n_repositories").alias("n_repositories"), F.count("*").alias("n_owners"))


def copied_owners(n: int) -> int:
    """From how many of n owners on a value is a copied example."""
    least, most = COPIED_OWNERS
    return max(least, min(most, math.ceil(n * COPIED_SHARE)))


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """Per row: doc_id, base spans, all spans, and how many base values look live or copied."""
    d = df.select(*[F.col(f"`{c}`").alias(n) for n, c in (("doc_id", doc_id), ("owner", owner), ("repository", repository))], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    d = d.select("doc_id", "owner", "repository", base_spans(F.col("text")).alias("base"), S.find(F.col("text"), WIDE, "owned", 3, _wide_ok).alias("wide"))
    d = cut(d.withColumn("wide", S.outside(F.col("wide"), F.col("base"))).withColumn("row", F.monotonically_increasing_id()), "secret-spans")
    each = d.where((F.size("base") > 0) | (F.size("wide") > 0)).select(
        "row", "owner", F.col("repository").cast("string").alias("repository"), F.explode(F.concat("base", "wide")).alias("span")
    ).withColumn("hash", F.sha2(value(F.col("span")), 256))
    stats = ownership(each.select("hash", "owner", "repository"))
    live = (F.col("n_owners") < copied_owners(d.select("owner").distinct().count())) & (F.col("n_repositories") < COPIED_REPOSITORIES)
    based = F.col("span.kind") != "owned"
    judged = each.join(stats, "hash").groupBy("row").agg(
        F.collect_list(F.when(live & ~based, F.col("span"))).alias("owned"),
        F.count(F.when(live & based, 1)).alias("n_live"), F.count(F.when(~live & based, 1)).alias("n_copied"),
    )
    none = F.array().cast(S.SPAN)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return d.join(judged, "row", "left").select(
        "doc_id", "base", S.merged(F.col("base"), F.coalesce("owned", none)).alias("spans"), zero("n_live"), zero("n_copied")
    )


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scan(table(spark, sf_dir, "documents"))
    return s.select(
        "doc_id", *[S.count(F.col("base"), k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(S.written(F.col("base")), 256).alias("base_sha256"), S.written(F.col("spans")).alias("spans"), "n_live", "n_copied",
    )


QUERIES = {"op5_secret_scans": op5_secret_scans}
ORACLE_SQL: dict[str, str] = {}
