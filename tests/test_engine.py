"""Rules, kernels, parsing and corpus operators on small records."""

from __future__ import annotations

import json
import math

import numpy as np
import pytest
from plumbline import api, schema
from plumbline.config import Config
from plumbline.functions import canonical
from plumbline.functions import kernels as K
from plumbline.operators import corpus, extract, normalize, rules
from plumbline.sources import files, registry
from plumbline.streaming import audit as streaming
from pyspark.sql import functions as F


def one(kind, x, df1=0.0, df2=0.0):
    a = np.array
    return K.test_p(a([kind]), a([x]), a([df1], float), a([df2], float), a([False]))[0]


def test_reference_p_values():
    cases = [("t", 2.20, 28, 0, 0.036225484778837864), ("F", 2.20, 2, 28, 0.1295932244740937), ("r", 0.22, 28, 0, 0.2427389879127071), ("z", 2.20, 0, 0, 0.02780689502699722), ("chi2", 22.20, 28, 0, 0.7719487040329371), ("Q", 22.20, 28, 0, 0.7719487040329371)]
    for kind, x, d1, d2, p in cases:
        assert abs(one(kind, x, d1, d2) - p) < 1e-12


def test_kernels_against_integrals():
    for df in (1.0, 3.0, 30.0, 400.0):
        x = np.linspace(0, 2.5, 20001)
        c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
        y = c * (1 + x * x / df) ** (-(df + 1) / 2)
        w = np.ones_like(x)
        w[1:-1:2], w[2:-1:2] = 4, 2
        area = (y * w).sum() * (x[1] - x[0]) / 3
        assert abs(one("t", 2.5, df) - (1 - 2 * area)) < 2e-10
    assert math.isinf(K.normal_ppf(np.array([1.0]))[0]) and math.isnan(K.normal_ppf(np.array([1.5]))[0])


def audited(spark, *records):
    d = schema.parsed(spark.createDataFrame([(json.dumps(r),) for r in records], "value string"))
    good, bad = schema.split(d)
    return good, bad


def by_rule(spark, record):
    good, _ = audited(spark, record)
    return {(r.rule_id, r.seq): r for r in rules.findings(good).collect()}


def test_a_full_record(spark):
    r = {
        "study_id": "S1", "randomized_n": 100, "arm_ns": {"a": 60, "b": 50},
        "subgroups": [{"variable": "sex", "levels": [{"name": "f", "n": 60, "percentage": 61.0}, {"name": "m", "n": 50}], "effect_claimed": True}],
        "reported_stats": [{"stat_type": "t", "value": 2.2, "df1": 28, "reported_p": 0.036}, {"stat_type": "z", "value": 1.0, "reported_p": 0.01}],
        "reported_effects": [{"name": "e", "estimate": 1.0, "ci_lower": 0.5, "ci_upper": 1.5, "reported_p": 0.9, "estimate_decimals": 1, "ci_lower_decimals": 1, "ci_upper_decimals": 1}],
        "integer_summaries": [{"name": "g", "mean": 5.19, "n": 28}, {"name": "h", "mean": 5.21, "n": 28, "sd": 1.6, "sd_decimals": 1}],
        "baseline_comparisons": [{"name": "age", "mean_a": 50.0, "sd_a": 10, "n_a": 50, "mean_b": 50.1, "sd_b": 10, "n_b": 50}],
        "reporting": {"harms": True, "precision": None}, "metadata": {"source_schema_unavailable_rules": ["SUBGROUP-EVENT-FLOOR"]},
    }
    f = by_rule(spark, r)
    v = {k: x.verdict for k, x in f.items()}
    assert v["ENROLLMENT-ARM-SUM", 0] == "flag" and v["SUBGROUP-PARTITION", 0] == "flag" and v["SUBGROUP-PERCENT", 0] == "flag"
    assert v["SUBGROUP-INTERACTION-TEST", 0] == "warn" and v["SUBGROUP-INTERACTION-POWER", 0] == "not_applicable"
    assert f["SUBGROUP-EVENT-FLOOR", 0].scope == "source_schema" and f["SUBGROUP-EXPECTED-CELL", 0].scope == "record"
    assert v["STATCHECK", 0] == "pass" and v["STATCHECK", 1] == "flag" and v["STATCHECK", 2] == "warn"
    assert v["GRIM", 0] == "flag" and v["GRIM", 1] == "pass" and v["GRIMMER", 0] == "not_applicable" and v["GRIMMER", 1] == "pass"
    assert v["BASELINE-ANOMALY", 0] == "pass" and v["REPORTING-COMPLETENESS", 0] == "warn"


@pytest.mark.parametrize(("mean", "n", "items", "sd", "places", "grim", "grimmer"), [(5.19, 28, 1, None, 2, False, None), (5.19, 32, 1, None, 2, True, None), (2.84, 16, 2, None, 2, True, None), (5.22, 28, 1, None, 2, False, None), (5.21, 28, 1, 1.6, 1, True, True), (3.44, 18, 1, 2.47, 2, True, False), (5.23, 35, 1, 2.55, 2, True, False)])
def test_grim_cases(spark, mean, n, items, sd, places, grim, grimmer):
    f = by_rule(spark, {"randomized_n": 1, "integer_summaries": [{"name": "x", "mean": mean, "n": n, "items": items, "sd": sd, "sd_decimals": places}]})
    assert f["GRIM", 0].verdict == ("pass" if grim else "flag")
    if grimmer is not None:
        assert f["GRIMMER", 0].verdict == ("pass" if grimmer else "flag")


def test_quarantine(spark):
    good, bad = audited(spark, {"randomized_n": "20"}, {"randomized_n": 0}, {"randomized_n": 5, "x": 1}, {"randomized_n": 5, "reported_stats": [{"stat_type": "q", "value": 1}]})
    assert good.count() == 1 and good.first().randomized_n == 20
    assert sorted(sum((r.errors for r in bad.collect()), [])) == ["randomized_n", "reported_stats", "unknown_field"]
    assert schema.parsed(spark.createDataFrame([("{oops",)], "value string")).first().errors == ["randomized_n", "not_json"]


def test_strict_and_lax_at_every_depth(spark):
    """Names that the schema lacks are errors in nested structs too; numbers in quotes are numbers there too."""
    lines = [
        '{"randomized_n": "20.0", "reported_stats": [{"stat_type": "t", "value": "2.2", "df1": "28", "reported_p": "0.036"}]}', '{"randomized_n": 5, "integer_summaries": [{"name": "a", "mean": 1, "n": 3, "bogus": 1}]}',
        '{"randomized_n": 5, "subgroups": [{"variable": "v", "levels": [{"name": "a", "n": "x"}]}]}', '{"randomized_n": 5, "arm_ns": {"a": "7", "b": 8}}', '{"randomized_n": 5, "subgroups": {"variable": "v"}}', '{"randomized_n": 5, "reference_flag": true}',
    ]
    d = spark.createDataFrame([(x,) for x in lines], "value string")
    rows = {r.raw: r for r in schema.parsed(d).collect()}
    assert [rows[x].errors for x in lines] == [[], ["integer_summaries"], ["levels", "subgroups"], [], ["subgroups"], ["unknown_field"]]
    assert rows[lines[0]].randomized_n == 20 and (rows[lines[0]].reported_stats[0].value, rows[lines[0]].reported_stats[0].df1) == (2.2, 28.0)
    assert rows[lines[3]].arm_ns == {"a": 7, "b": 8} and len({r.record_key for r in rows.values()}) == len(lines)


def test_evaluate_labelled_lines(spark):
    """The label may stand in the record or in its metadata; the intervals hold the point."""
    lines = [json.dumps({"randomized_n": 10, "arm_ns": {"a": 11 if k % 2 else 10}, **({"reference_flag": bool(k % 2)} if k < 4 else {"metadata": {"reference_flag": k == 5}})}) for k in range(6)]
    r = api.evaluate(api.labelled(spark.createDataFrame([(x,) for x in lines], "value string")), replicates=40).first()
    assert (r.n, r.tp, r.tn, r.raw, r.kappa) == (6, 3, 3, 1.0, 1.0)
    assert [(x.metric, x.low, x.high) for x in r.intervals if x.metric == "raw"] == [("raw", 1.0, 1.0)]


def test_response(spark):
    good, _ = audited(spark, {"study_id": None, "randomized_n": 10, "arm_ns": {"a": 10}})
    r = rules.responses(good).first()
    ranks = [(c.rule_rank, c.seq) for c in r.checks]
    assert ranks == sorted(ranks) and len(r.checks) == 12 and r.feasibility_verdict == "warn" and r.completeness_score == pytest.approx(0.2)


def test_extraction(spark):
    d = spark.createDataFrame([("Enrolled 120 adults. Arm low dose: n=61; group low dose: n=59; arm sham; n = 60. z(1)=1.96, p=0.050; r(30) = -0.41, p <= .02. chi^2(3)=7.81, p=.050, Q(4)=9.5, p>0.04",), (None,)], "text string")
    r, none = extract.extract(d).collect()
    assert r.randomized_n == 120 and r.arm_ns == {"low dose": 59, "sham": 60}
    assert [(s.stat_type, s.value, s.df1, s.df2, s.p_operator, s.p_decimals) for s in r.reported_stats] == [("z", 1.96, 1.0, None, "=", 3), ("r", -0.41, 30.0, None, "<=", 2), ("chi2", 7.81, 3.0, None, "=", 3), ("Q", 9.5, 4.0, None, ">", 2)]
    assert none.randomized_n is None and none.reported_stats == []


def study(groups=3):
    gs = [{"id": f"BG{i:03d}", "title": f"arm {i}"} for i in range(groups)] + [{"id": "BGX", "title": "Total"}]
    rows = [{"groupId": g["id"], "value": "10.5", "spread": "2.10"} for g in gs]
    counts = [{"groupId": g["id"], "value": "1,000"} for g in gs]
    cats = [{"title": t, "measurements": [{"groupId": g["id"], "value": v} for g in gs]} for t, v in (("F", "400"), ("M", "600"))]
    measures = [{"title": "Age", "paramType": "MEAN", "dispersionType": "STANDARD_DEVIATION", "classes": [{"categories": [{"measurements": rows}]}]}, {"title": "Sex", "paramType": "COUNT_OF_PARTICIPANTS", "classes": [{"categories": cats}]}]
    analyses = [{"pValue": "<0.001", "paramType": "Hazard Ratio", "paramValue": "0.80", "ciLowerLimit": "0.60", "ciUpperLimit": "1.10", "ciPctValue": "95", "statisticalMethod": "Cox, 1-sided"}, {"pValue": "n/a"}]
    return {
        "hasResults": True,
        "protocolSection": {"identificationModule": {"nctId": "NCT1", "briefTitle": "t"}, "statusModule": {"overallStatus": "COMPLETED"}, "designModule": {"studyType": "INTERVENTIONAL", "enrollmentInfo": {"count": 3000}, "designInfo": {"allocation": "RANDOMIZED"}}},
        "resultsSection": {
            "participantFlowModule": {"groups": gs, "periods": [{"milestones": [{"type": "STARTED", "achievements": [{"groupId": "BG000", "numSubjects": "1,000"}]}]}]},
            "baselineCharacteristicsModule": {"groups": gs, "denoms": [{"counts": []}, {"counts": counts}], "measures": measures},
            "outcomeMeasuresModule": {"outcomeMeasures": [{"type": "PRIMARY", "title": "o", "populationDescription": "all", "groups": gs, "denoms": [{"counts": counts}], "analyses": analyses}]},
            "adverseEventsModule": {"x": 1},
        },
    }


def test_normalizing(spark):
    rows = spark.createDataFrame([(json.dumps(study()),), (json.dumps(study(24)),)], "value string")
    s = rows.select(F.from_json("value", normalize.STUDY_DDL).alias("s")).select("s.*")
    assert s.select(normalize.qualification_errors().alias("e")).first().e == []
    a, b = normalize.normalize(s).collect()
    m = json.loads(a.metadata)
    assert a.arm_ns == {"arm 0": 1000} and a.randomized_n == 3000 and len(a.integer_summaries) == 3 and len(a.baseline_comparisons) == 3
    assert a.subgroups[0].population_n == 3000 and [v.n for v in a.subgroups[0].levels] == [1200, 1800] and a.subgroups[0].exhaustive
    e = a.reported_effects[0]
    assert (e.scale, e.one_tailed, e.applicability_tier, e.estimate_decimals, e.p_operator, e.p_decimals) == ("ratio", True, "approximate_review", 2, "<", 3)
    assert m["reported_analyses_count"] == 2 and a.reporting["precision"] and a.reporting["harms"] and a.reporting["data_sharing"] is False
    assert len(b.baseline_comparisons) == 250 and json.loads(b.metadata)["baseline_comparisons_truncated"] == 26
    keyed = normalize.normalize(s).withColumn("record_key", F.col("study_id"))
    assert rules.findings(keyed.limit(1)).where("verdict = 'flag'").count() == 0


def test_agreement(spark):
    d = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "ref boolean, pred boolean")
    r = corpus.agreement(d).first()
    assert (r.raw, r.kappa, r.ac1) == (0.5, 0.0, 0.0)


def test_canonical_form():
    assert canonical.canonical_json('{"b": " ﬁ  x ", "a": [1.0000000000001, -0.0, 2]}') == '{"a":[1.0,0.0,2],"b":"fi x"}'
    with pytest.raises(ValueError, match="finite"):
        canonical.canonical_json('{"a": NaN}')


def test_config():
    assert Config().version == Config(cache_ttl_seconds=5).version != Config(alpha=0.01).version
    with pytest.raises(ValueError, match="alpha"):
        Config(alpha=2)


def test_config_sections(tmp_path):
    p = tmp_path / "c.toml"
    p.write_text("[engine]\nalpha = 0.01\ninteraction_sample_multiplier = 0.5\nmemory_cache_entries = 7\n[completeness.weights]\nharms = 2.0\n")
    c = api.load(str(p))
    assert (c.alpha, c.interaction_sample_multiplier, c.cache_max_entries, c.completeness_weights["harms"], c.completeness_weights["precision"]) == (0.01, 0.5, 7, 2.0, 1.0)
    p.write_text("[completeness]\nodd = 1\n")
    with pytest.raises(ValueError, match="odd"):
        api.load(str(p))


def test_registry_pages():
    pages = [{"studies": [{"i": 1}, {"i": 2}], "nextPageToken": "x"}, {"studies": [{"i": 3}]}]
    asked = []

    def get(url, params):
        asked.append(params)
        return pages[len(asked) - 1]

    assert [s["i"] for s in registry.studies(10, get=get, pause=0)] == [1, 2, 3]
    assert asked[1]["pageToken"] == "x" and asked[0]["pageSize"] == 10


def test_files_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"randomized_n": 5}\n\n{"randomized_n": 5}\n{"randomized_n": -1}\n')
    q = streaming.start(spark, str(tmp_path / "in"), str(tmp_path / "f"), str(tmp_path / "q"), str(tmp_path / "c"), once=True)
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "f")).count() == 12 and spark.read.parquet(str(tmp_path / "q")).count() == 1
    d = spark.createDataFrame([(1, "a"), (2, None)], "n int, s string")
    with pytest.raises(RuntimeError):
        files.write_exactly(d, str(tmp_path / "out"), 3)
    files.write_exactly(d, str(tmp_path / "out"), 2)
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ['{"n":1,"s":"a"}', '{"n":2,"s":null}']
    (tmp_path / "n.csv").write_text("OriginalPaperDOI,Reason,RetractionDate\n10.1/A,old,x\nhttps://doi.org/10.1/a,new,y\n")
    notices = files.read_notices(spark, str(tmp_path / "n.csv"))
    got = corpus.enrich(spark.createDataFrame([("doi:10.1/a",), ("",)], "doi string"), notices).collect()
    assert {(r.doi, r.reason, r.matched) for r in got} == {("doi:10.1/a", "new", True), ("", None, False)}


def test_lines_in_responses_out(spark):
    out, bad = api.audit_lines(spark.createDataFrame([('{"randomized_n": 5}',), ("x",)], "value string"))
    assert len(out.first().input_hash) == 64 and bad.count() == 1 and len(api.rule_manifest()) == 12
