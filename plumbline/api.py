"""What users call: audit, extract, evaluate and rerun, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.config import Config, load
from plumbline.functions.canonical import content_hash
from plumbline.functions.kernels import register
from plumbline.operators import corpus, rules
from plumbline.operators.extract import extract
from plumbline.schema import parsed, split, with_defaults

__all__ = ["Config", "audit", "audit_batch", "audit_lines", "evaluate", "extract", "extract_text", "labelled", "load", "parsed", "register", "rerun", "rule_manifest", "split"]

#: A batch may hold so many records, a line so many bytes, a text so many characters.
MOST_RECORDS, MOST_BYTES, MOST_CHARS = 500, 5_000_000, 500_000


def rule_manifest() -> list[dict[str, str]]:
    return [{"rule_id": r, "version": Config().rules_version, "reference": rules.REFERENCES[r]} for r in rules.RANKS]


def audit(records: DataFrame, cfg: Config | None = None) -> DataFrame:
    """Responses of valid records that have a record_key."""
    return rules.responses(records, cfg)


def audit_lines(lines: DataFrame, cfg: Config | None = None) -> tuple[DataFrame, DataFrame]:
    """(responses with input_hash, quarantined lines) of JSON lines."""
    cfg = cfg or Config()
    fits = F.coalesce(F.octet_length("value") <= MOST_BYTES, F.lit(False))
    good, bad = split(parsed(lines.where(fits)))
    hashed = good.withColumn("input_hash", content_hash(F.col("raw"), cfg.version, cfg.model_revision))
    out = rules.responses(hashed, cfg, keep=("input_hash",))
    large = lines.where(~fits).select(F.col("value").alias("raw"), F.array(F.lit("too_large")).alias("errors"))
    return out, bad.select("raw", "errors").unionByName(large)


def labelled(lines: DataFrame) -> DataFrame:
    """Valid records of JSON lines with reference_flag, which stands in the record or in its metadata."""
    good, bad = split(parsed(lines, more=("reference_flag",)))
    if bad.limit(1).count():
        raise ValueError(f"records that aren't valid: {[r.errors for r in bad.select('errors').limit(3).collect()]}")
    flag = lambda p: F.get_json_object("raw", p).try_cast("boolean")
    return good.withColumn("reference_flag", F.coalesce(flag("$.reference_flag"), flag("$.metadata.reference_flag")))


def evaluate(records: DataFrame, cfg: Config | None = None, replicates: int = corpus.BOOTSTRAP) -> DataFrame:
    """Agreement of the flag verdict with the boolean column reference_flag, with 95 % intervals."""
    if records.where(F.col("reference_flag").isNull()).limit(1).count():
        raise ValueError("a record has no reference_flag")
    v = rules.verdicts(records, cfg).select("record_key", (F.col("verdict") == "flag").alias("pred"))
    pairs = records.select("record_key", F.col("reference_flag").alias("ref")).join(v, "record_key")
    ends = corpus.bootstrap(pairs, "record_key", replicates).select(F.struct("metric", "low", "high").alias("x"))
    return corpus.agreement(pairs).crossJoin(ends.agg(F.array_sort(F.collect_list("x")).alias("intervals")))


def rerun(records: DataFrame, runs: int = 3, cfg: Config | None = None) -> DataFrame:
    """Audits the records so many times and counts those whose responses differ."""
    out = None
    for k in range(runs):
        h = rules.responses(with_defaults(records), cfg).select("record_key", F.lit(k).alias("run"), F.sha2(F.to_json(F.struct("feasibility_verdict", "completeness_score", "checks")), 256).alias("hash"))
        out = h if out is None else out.unionByName(h)
    return corpus.rerun_mismatches(out)


def audit_batch(records: DataFrame, cfg: Config | None = None) -> DataFrame:
    """As audit, for one request: more than MOST_RECORDS records are refused."""
    if records.limit(MOST_RECORDS + 1).count() > MOST_RECORDS:
        raise ValueError(f"a batch holds at most {MOST_RECORDS} records")
    return audit(records, cfg)


def extract_text(texts: DataFrame) -> DataFrame:
    """As extract, for requests: texts of more than MOST_CHARS characters are refused."""
    if texts.where(F.length("text") > MOST_CHARS).limit(1).count():
        raise ValueError(f"a text holds at most {MOST_CHARS} characters")
    return extract(texts)


def session(name: str = "plumbline") -> SparkSession:
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
