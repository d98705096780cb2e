"""Corpus-level aggregates: verdict counts, accounting, percentiles, agreement, sampling, determinism."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators.rules import exploded

# Severity of verdicts, and the review queue's quotas.
ORDER = {"flag": 3, "warn": 2, "pass": 1, "not_applicable": 0}
QUOTAS = {
    ("STATCHECK", "warn"): 45, ("STATCHECK", "pass"): 35, ("STATCHECK", "not_applicable"): 10, ("BASELINE-ANOMALY", "warn"): 10, ("BASELINE-ANOMALY", "pass"): 20,
    ("BASELINE-ANOMALY", "not_applicable"): 10, ("SUBGROUP-PARTITION", "warn"): 10, ("SUBGROUP-PARTITION", "pass"): 20, ("SUBGROUP-PARTITION", "not_applicable"): 10,
    ("REPORTING-COMPLETENESS", "warn"): 15, ("REPORTING-COMPLETENESS", "pass"): 15,
}
QUEUE_ROWS, QUEUE_SEED = 200, 20250903
BOOTSTRAP, BOOTSTRAP_SEED = 2000, 20250314
#: Bounds of the buckets that a selection counts first.
EDGES = 1000
#: Rows whose cells one broadcast holds, at two bits a row.
CELLS = 1 << 30


def rank(verdict: Column) -> Column:
    out = None
    for v, k in ORDER.items():
        out = F.when(verdict == v, k) if out is None else out.when(verdict == v, k)
    return out


def verdict_of(r: Column) -> Column:
    out = None
    for v, k in ORDER.items():
        out = F.when(r == k, v) if out is None else out.when(r == k, v)
    return out


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def worst_checks(checks: Column, *names: str) -> Column:
    """An array of a record's rules, each with its worst verdict: names of rule_id, verdict, scope, n (findings that say so) and rationale (theirs, joined)."""
    said = lambda at: F.array_join(F.array_sort(F.array_distinct(F.transform(at, lambda f: f["rationale"]))), " | ")

    def alone(f: Column) -> Column:
        own = {"n": F.lit(1).cast("bigint"), "rationale": F.coalesce(f["rationale"], F.lit(""))}
        return F.struct(*[(own[k] if k in own else f[k]).alias(k) for k in names])

    def several(at: Column) -> Column:
        own = {"n": F.size(at).cast("bigint"), "rationale": said(at)}
        return F.struct(*[(own[k] if k in own else at[0][k]).alias(k) for k in names])

    def worst(mine: Column) -> Column:
        return _let(F.array_max(F.transform(mine, lambda f: rank(f["verdict"]))), lambda top: _let(F.filter(mine, lambda f: rank(f["verdict"]) == top), several))

    kinds = F.array_distinct(F.transform(checks, lambda f: f["rule_id"]))
    general = F.transform(kinds, lambda rule: _let(F.filter(checks, lambda f: f["rule_id"] == rule), worst))
    # as a rule each of a record's rules has one finding
    return F.when(F.size(kinds) == F.size(checks), F.transform(checks, alone)).otherwise(general)


def outlined(checked: DataFrame, outline: Column) -> DataFrame:
    """The structs of outline, an array a record, with ``findings``, how often: records of one outline are counted first, so that few rows are exploded and shuffled."""
    alike = checked.select(outline.alias("outline")).groupBy("outline").agg(F.count("*").alias("findings"))
    rows = exploded(alike, F.col("outline"), "findings")
    return rows.groupBy(*[c for c in rows.columns if c != "findings"]).agg(F.sum("findings").alias("findings"))


def _counted(findings: DataFrame) -> DataFrame:
    """(rule_id, verdict, scope, findings) of findings, or of records with their checks."""
    if "checks" in findings.columns:
        return outlined(findings, F.transform("checks", lambda f: F.struct(*[f[k].alias(k) for k in ("rule_id", "verdict", "scope")])))
    return findings.groupBy("rule_id", "verdict", "scope").agg(F.count("*").alias("findings"))


def rule_verdicts(findings: DataFrame) -> DataFrame:
    """findings: rows, or records with their checks."""
    return _counted(findings).groupBy("rule_id", "verdict").agg(F.sum("findings").alias("findings"))


def verdict_cube(findings: DataFrame) -> DataFrame:
    """(level, rule_id, verdict, scope, findings): counts overall, by rule, by rule and verdict, and by rule and scope, in one pass; the levels are sums over the finest counts."""
    rule, verdict, scope = F.col("rule_id"), F.col("verdict"), F.col("scope")
    d = _counted(findings).groupingSets([[], [rule], [rule, verdict], [rule, scope]], rule, verdict, scope).agg(F.grouping_id().alias("g"), F.sum("findings").alias("findings"))
    # a bit of grouping_id says that its column is summed over, the rule's first
    level = F.when(F.col("g") == 7, "all").when(F.col("g") == 3, "rule").when(F.col("g") == 1, "verdict").otherwise("scope")
    return d.select(level.alias("level"), "rule_id", "verdict", "scope", "findings").where("level <> 'scope' OR scope IS NOT NULL")


def worst_by_rule(findings: DataFrame) -> DataFrame:
    """(record_key, rule_id, verdict): a record's worst verdict of each rule. findings: rows, or records with their checks, which nothing shuffles."""
    if "checks" in findings.columns:
        return exploded(findings, worst_checks(F.col("checks"), "rule_id", "verdict"))
    return findings.groupBy("record_key", "rule_id").agg(F.max(rank(F.col("verdict"))).alias("r")).select("record_key", "rule_id", verdict_of(F.col("r")).alias("verdict"))


def rollup(findings: DataFrame) -> DataFrame:
    """(record_key, verdict): flag, else warn, else pass."""
    return findings.groupBy("record_key").agg(F.max(rank(F.col("verdict"))).alias("r")).select("record_key", verdict_of(F.greatest("r", F.lit(1))).alias("verdict"))


def study_outcomes(findings: DataFrame) -> DataFrame:
    """Per rule: records by worst verdict, scopes of those not applicable, and the flag rate among the others. findings: rows, or records with their checks."""
    if "checks" in findings.columns:
        d = outlined(findings, worst_checks(F.col("checks"), "rule_id", "verdict", "scope"))
    else:
        scope = F.max(F.when(F.col("verdict") == "not_applicable", F.when(F.col("scope") == "source_schema", 1).otherwise(0)))
        w = findings.groupBy("record_key", "rule_id").agg(F.max(rank(F.col("verdict"))).alias("r"), scope.alias("schema"))
        d = w.select("rule_id", verdict_of(F.col("r")).alias("verdict"), F.when(F.col("schema") == 1, "source_schema").otherwise("record").alias("scope"), F.lit(1).cast("bigint").alias("findings"))
    n = lambda c: F.sum(F.when(c, F.col("findings")).otherwise(0)).cast("bigint")
    v, schema = F.col("verdict"), F.col("scope") == "source_schema"
    na = v == "not_applicable"
    out = d.groupBy("rule_id").agg(
        n(v == "pass").alias("passed"), n(v == "warn").alias("warned"), n(v == "flag").alias("flagged"), n(na).alias("not_applicable"),
        n(na & schema).alias("by_source_schema"), n(na & ~schema).alias("by_record"), n(~na).alias("applicable"),
    )
    return out.withColumn("flag_rate", F.try_divide("flagged", "applicable"))


def hydration(records: DataFrame) -> DataFrame:
    """One row of counters over records."""
    meta = lambda k: F.coalesce(F.get_json_object("metadata", f"$.{k}").try_cast("bigint"), F.lit(0))
    studies = lambda c: F.sum(c.cast("int")).cast("bigint")
    tiers = lambda t: F.sum(F.size(F.filter("reported_effects", lambda e: e["applicability_tier"] == t))).cast("bigint")
    d = records.agg(
        F.count("*").alias("records"), studies(F.size("subgroups") > 0).alias("with_partitions"), studies(F.size("integer_summaries") > 0).alias("with_summaries"),
        studies(F.size("baseline_comparisons") > 0).alias("with_comparisons"), studies(meta("reported_analyses_count") > 0).alias("with_analyses"),
        studies(meta("ci_p_eligible_analyses_before_cap") > 0).alias("with_eligible"), F.sum(meta("ci_p_eligible_analyses_before_cap")).alias("eligible"),
        F.sum(F.size("reported_effects")).cast("bigint").alias("processed"), F.sum(meta("ci_p_analyses_truncated")).alias("truncated"), tiers("high_confidence").alias("high_confidence"),
        tiers("approximate_review").alias("approximate_review"), studies(F.coalesce(F.element_at("reporting", "analysis_population"), F.lit(False))).alias("with_population"),
    )
    return d.withColumn("invariant_holds", F.col("processed") + F.col("truncated") == F.col("eligible"))


def _buckets(rows: DataFrame) -> DataFrame:
    """rows (v, ...) with the range bucket of v: about EDGES buckets of equal numbers of rows, by approximate quantiles of all."""
    at = [k / EDGES for k in range(1, EDGES)]
    edges = rows.agg(F.percentile_approx(F.col("v").cast("double"), at, 10 * EDGES).alias("e")).first()["e"] or [0.0]
    splits = [-float("inf"), *sorted({e for e in edges if np.isfinite(e)} or {0.0}), float("inf")]
    d = Bucketizer(splits=splits, inputCol="__v", outputCol="bucket", handleInvalid="keep").transform(rows.withColumn("__v", F.col("v").cast("double")))
    return d.withColumn("bucket", F.col("bucket").cast("int")).drop("__v")


def _same(a: DataFrame, b: DataFrame, keys: tuple[str, ...]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def nearest_rank(df: DataFrame, value: str, shares: tuple[float, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """Nearest-rank percentiles of a number: the value at place ceil(share * n), no interpolation.

    A first look counts range buckets, a second one only the values of the buckets that hold a place. A bucket has
    about a thousandth of all rows (a value that fills more has one of its own), so no task sorts a whole column or a whole group.
    """
    rows = _buckets(df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("v")))
    counted = rows.groupBy(*by, "bucket").agg(F.count("*").alias("c"))
    # at most EDGES + 1 entries a group
    groups = counted.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("bucket", "c"))).alias("bs"), F.sum("c").alias("n"))
    place = lambda s: F.least(F.col("n"), F.greatest(F.lit(1), F.ceil(F.lit(s) * F.col("n")))).cast("bigint")
    names = [f"p{round(100 * s):02d}" for s in shares]
    wanted = groups.select(*by, "bs", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), place(s).alias("place")) for k, s in zip(names, shares, strict=True)])).alias("w"))
    start = F.struct(F.lit(0).cast("bigint").alias("before"), F.lit(None).cast("int").alias("bucket"))

    def step(a: Column, x: Column) -> Column:
        here = a["bucket"].isNull() & (a["before"] + x["c"] >= F.col("w.place"))
        return F.struct((a["before"] + F.when(a["bucket"].isNull() & ~here, x["c"]).otherwise(0)).alias("before"), F.when(here, x["bucket"]).otherwise(a["bucket"]).alias("bucket"))

    found = wanted.select(*by, F.col("w.name").alias("name"), F.col("w.place").alias("place"), F.aggregate("bs", start, step).alias("x"))
    found = found.select(*by, "name", "x.bucket", (F.col("place") - F.col("x.before")).alias("rest"))
    keys = (*by, "bucket")
    near = rows.join(found, _same(rows, found, keys), "left_semi").groupBy(*keys, "v").agg(F.count("*").alias("c"))
    upto = near.withColumn("upto", F.sum("c").over(W.partitionBy(*keys).orderBy("v")))
    hit = upto.join(found, _same(upto, found, keys)).where("upto >= rest").select(*[upto[k] for k in by], "name", "v")
    return hit.groupBy(*by).agg(*[F.min(F.when(F.col("name") == k, F.col("v"))).alias(k) for k in names])


def agreement(pairs: DataFrame, by: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """Confusion counts, raw agreement, Cohen's kappa and Gwet's AC1 of boolean columns ref and pred."""
    w = F.col(weight) if weight else F.lit(1)
    s = lambda c: F.sum(F.when(c, w).otherwise(0)).cast("bigint")
    r, p = F.col("ref"), F.col("pred")
    aggs = [s(r & p).alias("tp"), s(~r & ~p).alias("tn"), s(~r & p).alias("fp"), s(r & ~p).alias("fn")]
    return scored((pairs.groupBy(*by) if by else pairs).agg(*aggs), by)


def scored(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Confusion counts (tp, tn, fp, fn) with their agreement metrics."""
    d = cells.withColumn("n", F.expr("tp + tn + fp + fn"))
    d = d.where("n > 0").withColumn("raw", F.expr("(tp + tn) / n")).withColumn("pr", F.expr("(tp + fn) / n")).withColumn("pp", F.expr("(tp + fp) / n"))
    d = d.withColumn("ek", F.expr("pr * pp + (1 - pr) * (1 - pp)")).withColumn("mp", F.expr("(pr + pp) / 2")).withColumn("ea", F.expr("2 * mp * (1 - mp)"))
    return d.select(*by, "n", "tp", "tn", "fp", "fn", "raw", F.expr("CASE WHEN ek < 1 THEN (raw - ek) / (1 - ek) ELSE 1.0D END").alias("kappa"), F.expr("CASE WHEN ea < 1 THEN (raw - ea) / (1 - ea) ELSE 1.0D END").alias("ac1"))


def hash_int(*parts: Column) -> Column:
    """A 32-bit number from the SHA-256 of the parts, alike in every engine."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256), 1, 8), 16, 10).cast("bigint")


def _packed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's rows as (part, n, cells): two bits a row, ref and pred."""
    for k, b in enumerate(it):
        ref, pred = (b.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("ref", "pred"))
        bits = np.packbits(np.stack([ref, pred], 1).ravel())
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([k], pa.int32()), pa.array([len(ref)]), pa.array([bits.tobytes()])], names=["part", "batch", "n", "cells"])


def _resampled(cells: bytes, first: int, size: int, n: int, seed: int):  # noqa: ANN202
    """Per replicate the cells of its draws among rows first .. first + size - 1 of n."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = np.unpackbits(np.frombuffer(cells, np.uint8))[: 2 * size].reshape(-1, 2)
        code = (2 * code[:, 0] + code[:, 1]).astype(np.int64)
        for b in it:
            counts = []
            for r in b.column("b").to_pylist():
                total = np.zeros(4, np.int64)
                for at in range(0, n, 1 << 16):
                    row = np.array([int.from_bytes(hashlib.sha256(b"%d:%d:%d" % (seed, r, j)).digest()[:4]) for j in range(at, min(n, at + (1 << 16)))]) % n - first
                    total += np.bincount(code[row[(row >= 0) & (row < size)]], minlength=4)
                counts.append(total)
            m = np.array(counts).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([b.column("b"), *[pa.array(m[:, k]) for k in (3, 0, 1, 2)]], names=["b", "tp", "tn", "fp", "fn"])

    return run


def bootstrap(pairs: DataFrame, key: str = "idx", replicates: int = BOOTSTRAP, seed: int = BOOTSTRAP_SEED) -> DataFrame:
    """95 % intervals of the agreement metrics, from resampled cells.

    pairs: ref, pred and a unique key. Draw j of replicate b takes the row at place hash(seed, b, j) mod n in the order of the key. Rows matter
    only by their cell, so all rows are two bits each, which every replicate's task reads; draws are counted where they are
    made. CELLS rows at a time are sent to the tasks (256 MB), as a rule all of them.
    """
    spark = pairs.sparkSession
    got = pairs.select(key, "ref", "pred").sort(key).select("ref", "pred").mapInArrow(_packed, "part int, batch int, n long, cells binary").toArrow().sort_by([("part", "ascending"), ("batch", "ascending")])
    sizes = got["n"].to_pylist()
    n = sum(sizes)
    bits = np.concatenate([np.unpackbits(np.frombuffer(c, np.uint8))[: 2 * k] for c, k in zip(got["cells"].to_pylist(), sizes, strict=True)]) if n else np.empty(0, np.uint8)
    runs, out = spark.range(replicates).select(F.col("id").alias("b")), None
    for first in range(0, n, CELLS):
        size = min(CELLS, n - first)
        own = runs.mapInArrow(_resampled(np.packbits(bits[2 * first : 2 * (first + size)]).tobytes(), first, size, n, seed), "b long, tp long, tn long, fp long, fn long")
        out = own if out is None else out.unionByName(own)
    out = spark.createDataFrame([], "b long, tp long, tn long, fp long, fn long") if out is None else out
    cells = ("tp", "tn", "fp", "fn")
    m = scored(out.groupBy("b").agg(*[F.sum(c).alias(c) for c in cells]), ("b",))
    names = ("raw", "kappa", "ac1")
    long = m.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("v")) for k in names])).alias("x")).select("x.*")
    r = long.withColumn("place", F.row_number().over(W.partitionBy("metric").orderBy("v")) - 1)
    lo, hi = int(0.025 * replicates), min(replicates - 1, int(0.975 * replicates))
    return r.groupBy("metric").agg(F.max(F.when(F.col("place") == lo, F.col("v"))).alias("low"), F.max(F.when(F.col("place") == hi, F.col("v"))).alias("high"))


def stratified(rows: DataFrame, quotas: DataFrame, strata: list[str], key: str, target: int, seed: int = QUEUE_SEED) -> DataFrame:
    """A stratified sample: each stratum's quota, then a refill from what is left, in seeded hash order.

    rows must have a unique key; quotas has the strata columns and quota. Both picks are row numbers up to a
    bound, worked out among the rows of each stratum's first hash buckets; rows are gone through twice.
    """
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)
    d = rows.withColumn("h", order).join(quotas, strata, "left").withColumn("quota", F.coalesce("quota", F.lit(0))).withColumn("bucket", F.substring("h", 1, 4))
    most = (quotas.agg(F.max("quota")).first()[0] or 0) + target
    # hashes are even: the first of 65,536 buckets hold the rows looked for, and no task sorts a stratum
    counted = d.groupBy(*strata, "bucket").agg(F.count("*").alias("c"))
    upto = counted.withColumn("before", F.sum("c").over(W.partitionBy(*strata).orderBy("bucket")) - F.col("c"))
    bounds = upto.where(F.col("before") < most).groupBy(*strata).agg(F.max("bucket").alias("bound"))
    bounds = bounds.select("bound", *[F.col(k).alias(f"of_{k}") for k in strata])
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in strata])
    near = d.join(F.broadcast(bounds), same & (F.col("bucket") <= F.col("bound"))).drop("bucket", *bounds.columns)
    head = near.withColumn("r", F.row_number().over(W.partitionBy(*strata).orderBy("h"))).where(F.col("r") <= most)
    # head, a few hundred rows a stratum, is gone through once
    both = head.withColumn("refill", F.col("r") > F.col("quota")).withColumn("place", F.row_number().over(W.partitionBy("refill").orderBy("h")))
    taken = F.count(F.when(~F.col("refill"), 1)).over(W.partitionBy(F.lit(0)))
    return both.where(f"NOT refill OR place <= {target}").withColumn("taken", taken).where(~F.col("refill") | (F.col("place") <= target - F.col("taken"))).drop("r", "quota", "place", "taken")


def review_rows(findings: DataFrame) -> DataFrame:
    """(record_key, check_family, pipeline_label, n, rationale): per record and reviewed family its worst verdict and what says so. findings: rows, or records with their checks."""
    families = sorted({family for family, _ in QUOTAS})
    if "checks" in findings.columns:
        own = findings.select("record_key", F.filter("checks", lambda f: f["rule_id"].isin(families)).alias("own"))
        return exploded(own, worst_checks(F.col("own"), "rule_id", "verdict", "n", "rationale")).select("record_key", F.col("rule_id").alias("check_family"), F.col("verdict").alias("pipeline_label"), "n", "rationale")
    r = rank(F.col("verdict"))
    worst = findings.where(F.col("rule_id").isin(families)).groupBy("record_key", F.col("rule_id").alias("check_family"), r.alias("r")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("rationale")), " | ").alias("rationale"))
    top = worst.groupBy("record_key", "check_family").agg(F.max_by(F.struct("r", "n", "rationale"), "r").alias("x"))
    return top.select("record_key", "check_family", verdict_of(F.col("x.r")).alias("pipeline_label"), "x.n", "x.rationale")


def review_queue(findings: DataFrame, target: int = QUEUE_ROWS, seed: int = QUEUE_SEED) -> DataFrame:
    """review_rows sampled by the eleven quotas and refilled to target, in a seeded order."""
    rows = review_rows(findings).withColumn("key", F.concat_ws("/", "record_key", "check_family"))
    quotas = rows.sparkSession.createDataFrame([(*k, q) for k, q in QUOTAS.items()], "check_family string, pipeline_label string, quota int")
    picked = stratified(rows, quotas, ["check_family", "pipeline_label"], "key", target, seed)
    return picked.withColumn("place", hash_int(F.lit(f"{seed}:order"), F.col("key"))).orderBy("place", "key").drop("h", "place")


def span_scores(rows: DataFrame) -> DataFrame:
    """(tp, fp, fn, precision, recall, f1) of rows with arrays gold and predicted; each counts as a set."""
    size = lambda a: F.sum(F.size(a)).cast("bigint")
    d = rows.agg(size(F.array_intersect("predicted", "gold")).alias("tp"), size(F.array_except("predicted", "gold")).alias("fp"), size(F.array_except("gold", "predicted")).alias("fn"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    d = d.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn")))
    return d.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def largest_error(rows: DataFrame, tolerance: float, by: tuple[str, ...] = ()) -> DataFrame:
    """(n, max_error, failures) of columns got and want; a missing or undefined value fails."""
    e = F.abs(F.col("got") - F.col("want"))
    good = F.coalesce(~F.isnan(e) & (e <= tolerance), F.lit(False))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.max(F.when(~F.isnan(e), e)).alias("max_error"), F.count(F.when(~good, 1)).alias("failures"))


def miss_schedule(requests: DataFrame, number: str, share: float) -> DataFrame:
    """requests with miss: such a share of the numbers 0, 1, ..., as evenly spread as whole numbers allow."""
    steps = lambda k: F.floor(k * F.lit(share) + 1e-9)
    return requests.withColumn("miss", steps(F.col(number) + 1) > steps(F.col(number)))


def rerun_mismatches(runs: DataFrame) -> DataFrame:
    """Of rows (record_key, run, hash): records, and those whose hashes differ between runs."""
    k = runs.groupBy("record_key").agg(F.count_distinct("hash").alias("kinds"))
    d = k.agg(F.count("*").alias("records"), F.count(F.when(F.col("kinds") > 1, 1)).alias("mismatches"))
    return d.withColumn("agreement", 1 - F.try_divide("mismatches", "records"))


def release_rate(ledger: DataFrame, least: int = 30) -> DataFrame:
    """Passed over total; no row where there are fewer different releases than wanted."""
    d = ledger.agg(F.count_distinct("release").alias("releases"), F.sum("passed").alias("passed"), F.sum("total").alias("total"))
    return d.where(F.col("releases") >= least).withColumn("pass_rate", F.col("passed") / F.col("total"))


def enrich(records: DataFrame, notices: DataFrame) -> DataFrame:
    """records left joined with retraction notices on the normal form of the DOI; of equal DOIs the last notice counts."""
    from plumbline.functions.parsers import doi as normal

    w = W.partitionBy("key").orderBy(F.desc("line"))
    kept = notices.withColumn("key", normal(F.col("doi"))).where("key <> ''").withColumn("r", F.row_number().over(w)).where("r = 1").select("key", "reason", F.col("date").alias("notice_date"))
    return records.withColumn("key", normal(F.col("doi"))).join(kept, "key", "left").withColumn("matched", F.col("reason").isNotNull())


def cohort_qc(records: DataFrame, expected: int, manifest: DataFrame | None = None, digest: Column | None = None) -> DataFrame:
    """Counts that a cohort must meet, and whether it does; with a manifest, also its accepted number and digest."""
    aggs = [F.count("*").alias("records"), F.count_distinct("study_id").alias("ids"), F.count(F.when(F.col("study_id").isNull(), 1)).alias("missing"), F.count(F.when(F.col("randomized_n").isNull() | (F.col("randomized_n") <= 0), 1)).alias("bad_enrollment")]
    if manifest is not None:
        aggs.append(digest.alias("digest"))
    d = records.agg(*aggs)
    dup = F.col("records") - F.col("missing") - F.col("ids")
    d = d.withColumn("duplicates", dup)
    ok = (F.col("records") == expected) & (F.col("missing") == 0) & (dup == 0) & (F.col("bad_enrollment") == 0)
    if manifest is None:
        return d.withColumn("ok", ok)
    m = manifest.select(F.col("accepted").alias("m_accepted"), F.col("digest").alias("m_digest"))
    same = F.coalesce((F.col("records") == F.col("m_accepted")) & (F.col("digest") == F.col("m_digest")), F.lit(False))
    return d.crossJoin(m).withColumn("manifest_equal", same).withColumn("ok", ok & same).drop("m_accepted", "m_digest", "digest")
