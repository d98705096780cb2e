"""What the third round's findings came down to."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

import duckdb
import pytest
from plumbline import schema
from plumbline.operators import corpus, rules
from plumbline.plans import catalogue
from pyspark.sql import functions as F


def of_sql(name, d):
    c = duckdb.connect()
    for p in Path(d).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    cur = c.execute(catalogue.ORACLE_SQL[name])
    names = [x[0] for x in cur.description]
    return [dict(zip(names, r, strict=True)) for r in cur.fetchall()]


def one_order_each(spark, d, rows):
    """A table of orders with one a customer, from (key, z in hundredths)."""
    price = F.round(150000 + 20000 * (F.col("h") / 100 - (F.col("k") % 7 - 3) / 2), 2)
    spark.createDataFrame(rows, "k long, h double").coalesce(1).select(F.col("k").alias("o_orderkey"), F.col("k").alias("o_custkey"), price.alias("o_totalprice")).write.parquet(f"{d}/orders.parquet")
    Path(f"{d}/orders.parquet").rename(f"{d}/parts")
    next(Path(f"{d}/parts").glob("*.parquet")).rename(f"{d}/orders.parquet")


def test_f1_z_on_half_a_hundredth_is_rounded_as_in_sql(spark, tmp_path):
    one_order_each(spark, str(tmp_path), [(k, h + 0.5) for k, h in enumerate(range(-700, 1700))])
    got = {r.unit: r.n for r in catalogue.QUERIES["largest_kernel_error"](spark, str(tmp_path)).collect()}
    assert got == {r["unit"]: r["n"] for r in of_sql("largest_kernel_error", tmp_path)}


def test_f2_intervals_that_only_touch_are_consistent(spark):
    """With two degrees of freedom p of r is 1 - |r|: a box of r touches the printed p's exactly where they add up to 1.01 or 0.99."""
    rows = [(r, p, (100 - r - p) in (-1, 0, 1)) for r in range(1, 98) for p in range(1, 100) if abs(100 - r - p) < 4]
    d = spark.createDataFrame(rows, "r int, rp int, want boolean")
    none = lambda t: F.lit(None).cast(t)
    s = F.struct(F.lit("r").alias("stat_type"), (F.col("r") / 100).alias("value"), F.lit(2.0).alias("df1"), none("double").alias("df2"), (F.col("rp") / 100).alias("reported_p"), F.lit("=").alias("p_operator"), F.lit(2).alias("statistic_decimals"), F.lit(2).alias("p_decimals"), F.lit(False).alias("adjusted"), F.lit(False).alias("one_tailed"), none("string").alias("source"))
    got = rules.statcheck(d.select("*", s.alias("s")), catalogue.CFG).select("r", "rp", "want", "agree.consistent").collect()
    assert [x for x in got if x.consistent != x.want] == []


def mixed_records(spark):
    """Records with several findings a rule, and with none but the fixed ones."""
    lines = [
        {"randomized_n": 100, "integer_summaries": [{"name": "g", "mean": 5.19, "n": 28}, {"name": "h", "mean": 5.21, "n": 28, "sd": 1.6, "sd_decimals": 1}]},
        {"randomized_n": 100, "subgroups": [{"variable": "a", "levels": [{"name": "x", "n": 500}]}, {"variable": "b", "levels": [{"name": "x", "n": 1}], "effect_claimed": True}]},
        {"randomized_n": 9, "reported_stats": [{"stat_type": "z", "value": 1.0, "reported_p": 0.01}, {"stat_type": "z", "value": 1.0, "reported_p": 0.32}], "arm_ns": {"a": 5}},
        {"randomized_n": 9, "metadata": {"source_schema_unavailable_rules": ["GRIM", "STATCHECK"]}},
        {"randomized_n": 9},
    ]
    good, _ = schema.split(schema.parsed(spark.createDataFrame([(json.dumps(x),) for x in lines], "value string")))
    return good.localCheckpoint()


def same(a, b):
    return sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(a.columns)).collect()))


@pytest.mark.parametrize("count", [corpus.study_outcomes, corpus.worst_by_rule, corpus.verdict_cube, corpus.rule_verdicts, corpus.review_rows])
def test_f3_to_f7_records_with_their_checks_count_as_their_findings(spark, count):
    r = mixed_records(spark)
    assert same(count(rules.findings(r)), count(rules.checked(r)))


@pytest.mark.parametrize("name", ["na_scope", "study_worst_verdict", "verdict_cube", "findings_rule_verdict"])
def test_f3_f5_f6_f7_findings_are_worked_out_once(spark, tmp_path, name):
    spark.createDataFrame([(k // 3, float(k)) for k in range(9)], "l_orderkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    plan = catalogue.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Filter (size(") == 0


def test_f4_places_are_numbered_among_the_first_hash_buckets(spark):
    rows = spark.range(20000).select("id", F.when(F.col("id") % 4 > 0, (F.col("id") % 4).cast("string")).alias("s"))
    quotas = spark.createDataFrame([("1", 5), ("2", 3)], "s string, quota int")
    picked = corpus.stratified(rows, quotas, ["s"], "id", 12, 7)
    order = sorted(range(20000), key=lambda k: hashlib.sha256(b"7:%d" % k).hexdigest())
    first = [k for k in order if k % 4 == 1][:5] + [k for k in order if k % 4 == 2][:3]
    rest = [k for k in order if k not in first][:4]
    assert {(r.id, r.refill) for r in picked.collect()} == {(k, False) for k in first} | {(k, True) for k in rest}
    assert "bound" in picked._jdf.queryExecution().optimizedPlan().toString()
