"""Queries on registry studies, record lines, samples and scores; see catalogue."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import kernels as K
from plumbline.functions import parsers
from plumbline.operators import corpus, doses, incremental, normalize, rules
from plumbline.plans import catalogue as C
from plumbline.plans.catalogue import query, t
from plumbline.schema import LEVEL, SUBGROUP, SUMMARY, parsed, with_defaults
from plumbline.sources import files

# -- registry studies -----------------------------------------------------------------------------

LEVELS = 30


def studies(spark: SparkSession, d: str) -> DataFrame:
    """A registry study a nation, as JSON read back: market segments are groups beside a total, residues of customers the categories."""
    seg = F.col("c_mktsegment")
    cust = t(spark, d, "customer").select(F.col("c_nationkey").alias("k"), seg.alias("g"), (F.col("c_custkey") % 3).cast("string").alias("cat"), F.col("c_acctbal").alias("bal"))
    n = cust.groupBy("k", "g").agg(F.count("*").alias("n"), F.round(F.avg("bal") / 100, 1).alias("m"))
    group = F.struct(F.col("g").alias("id"), F.concat(F.lit("arm "), F.col("g")).alias("title"))
    base = n.groupBy("k").agg(
        F.array_sort(F.collect_list(group)).alias("gs"), F.array_sort(F.collect_list(F.struct(F.col("g").alias("groupId"), F.col("n").cast("string").alias("value")))).alias("counts"), F.sum("n").alias("people"),
        F.array_sort(F.collect_list(F.struct(F.col("g").alias("groupId"), F.format_string("%.1f", "m").alias("value"), F.lit("2.50").alias("spread")))).alias("means"),
    )
    cats = cust.groupBy("k", "cat", "g").agg(F.count("*").alias("n")).groupBy("k", "cat").agg(F.array_sort(F.collect_list(F.struct(F.col("g").alias("groupId"), F.col("n").cast("string").alias("value"), F.lit(None).cast("string").alias("spread")))).alias("ms"))
    cats = cats.groupBy("k").agg(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("third "), "cat").alias("title"), F.col("ms").alias("measurements")))).alias("cats"))
    b = base.join(cats, "k")
    k, total = F.col("k"), F.struct(F.lit("T").alias("id"), F.lit(" Total ").alias("title"))
    groups = F.concat("gs", F.array(total))
    denoms = F.array(F.struct(F.concat("counts", F.array(F.struct(F.lit("T").alias("groupId"), F.col("people").cast("string").alias("value")))).alias("counts")))
    named = F.when(k % 4 == 0, "Choice, select all that apply").when(k % 4 == 1, "Choice, if yes").otherwise("Choice")
    none = F.lit(None).cast("string")
    count = F.struct(named.alias("title"), none.alias("description"), F.lit("COUNT_OF_PARTICIPANTS").alias("paramType"), none.alias("dispersionType"), F.array(F.struct(none.alias("title"), none.alias("description"), F.col("cats").alias("categories"))).alias("classes"))
    many = F.transform(F.sequence(F.lit(1), F.lit(LEVELS)), lambda i: F.struct(F.format_string("level %02d", i).alias("title"), F.col("means").alias("measurements")))
    mean = F.struct(F.lit("Balance").alias("title"), none.alias("description"), F.lit("MEAN").alias("paramType"), F.lit("STANDARD_DEVIATION").alias("dispersionType"), F.array(F.struct(none.alias("title"), none.alias("description"), many.alias("categories"))).alias("classes"))
    started = F.transform("counts", lambda c: F.struct(c["groupId"].alias("groupId"), c["value"].alias("numSubjects")))
    stones = F.array(F.struct(F.lit("OTHER").alias("type"), F.slice(started, 1, 1).alias("achievements")), F.struct(F.lit("Started").alias("type"), started.alias("achievements")))
    one = lambda i, p, kind, e, lo, hi, level, method: F.struct(F.lit(p).alias("pValue"), F.lit(kind).alias("paramType"), F.lit(e).alias("paramValue"), F.lit(lo).alias("ciLowerLimit"), F.lit(hi).alias("ciUpperLimit"), F.lit(level).alias("ciPctValue"), F.lit(method).alias("statisticalMethod"))
    analyses = F.array(
        one(0, "<0.001", "Hazard Ratio", "0.80", "0.60", "1.10", "95", "Cox"), one(1, "0.04", "Mean Difference", "1.5", "0.5", "2.5", "95", "t test"), one(2, "0.04", "Odds Ratio", "1.5", "-0.5", "2.5", "95", "Logistic"),
        one(3, "n/a", "Mean", "1", "0", "2", "95", ""), one(4, "0.5", "Mean", "1", "2", "0", "95", ""), one(5, "0.2", "Slope", "1,000", "900", "1,100", "90", "ANOVA, 1-sided"), one(6, "0.2", "Mean", "1", "0", "2", "100", ""),
    )
    outcome = F.struct(F.when(k % 2 == 0, "PRIMARY").otherwise("SECONDARY").alias("type"), F.lit("o").alias("title"), F.when(k % 3 != 0, "all").alias("populationDescription"), groups.alias("groups"), denoms.alias("denoms"), F.when(k % 5 != 0, analyses).otherwise(F.slice(analyses, 4, 1)).alias("analyses"))
    design = F.struct(F.lit("INTERVENTIONAL").alias("studyType"), F.struct(F.col("people").cast("string").alias("count"), F.lit("ACTUAL").alias("type")).alias("enrollmentInfo"), F.struct(F.lit("RANDOMIZED").alias("allocation"), F.lit("PARALLEL").alias("interventionModel")).alias("designInfo"))
    protocol = F.struct(F.struct(k.cast("string").alias("nctId"), F.lit("t").alias("briefTitle")).alias("identificationModule"), F.struct(F.lit("COMPLETED").alias("overallStatus")).alias("statusModule"), design.alias("designModule"), F.when(k % 7 == 0, F.struct(F.lit("YES").alias("ipdSharing"))).alias("ipdSharingStatementModule"))
    results = F.struct(
        F.struct(groups.alias("groups"), F.array(F.struct(stones.alias("milestones"))).alias("periods")).alias("participantFlowModule"), F.struct(groups.alias("groups"), denoms.alias("denoms"), F.array(count, mean).alias("measures")).alias("baselineCharacteristicsModule"),
        F.struct(F.array(outcome).alias("outcomeMeasures")).alias("outcomeMeasuresModule"), F.when(k % 3 == 0, F.struct(F.lit(1).alias("x"))).alias("adverseEventsModule"),
    )
    body = F.to_json(F.struct(protocol.alias("protocolSection"), results.alias("resultsSection"), F.lit(True).alias("hasResults")))
    return b.select(F.from_json(body, normalize.STUDY_DDL).alias("s")).select("s.*")


def records(spark: SparkSession, d: str) -> DataFrame:
    return normalize.normalize(studies(spark, d)).withColumn("k", F.col("study_id").cast("int"))


_PEOPLE = "n AS (SELECT c_nationkey AS k, c_mktsegment AS g, count(*) AS n, round(avg(c_acctbal) / 100, 1) AS m FROM customer GROUP BY 1, 2), p AS (SELECT k, sum(n)::BIGINT AS people, count(*) AS gs FROM n GROUP BY 1)"


@query(f"WITH {_PEOPLE} SELECT k, 'arm ' || g AS arm, n, people AS randomized_n FROM n JOIN p USING (k)")
def registry_arms(spark, d):  # noqa: ANN001, ANN201
    return records(spark, d).select("k", F.explode("arm_ns").alias("arm", "n"), "randomized_n")


@query(f"""WITH {_PEOPLE}, c AS (SELECT c_nationkey AS k, c_custkey % 3 AS c, count(*) AS n FROM customer GROUP BY 1, 2), l AS (SELECT k, count(*) AS levels, sum(n)::BIGINT AS total FROM c GROUP BY 1)
SELECT k, people AS population_n, k % 4 <> 0 AS exclusive, k % 4 NOT IN (0, 1) AS exhaustive, levels, total FROM p JOIN l USING (k) WHERE levels >= 2""")  # fmt: skip
def registry_partitions(spark, d):  # noqa: ANN001, ANN201
    """Counted participants of the groups that are no totals, with the wordings that tell of overlap or of a subset."""
    s = records(spark, d).select("k", F.explode("subgroups").alias("s"))
    total = F.aggregate("s.levels", F.lit(0).cast("bigint"), lambda a, v: a + v["n"])
    return s.select("k", "s.population_n", F.col("s.mutually_exclusive").alias("exclusive"), F.col("s.exhaustive").alias("exhaustive"), F.size("s.levels").cast("bigint").alias("levels"), total.alias("total"))


@query(f"""WITH {_PEOPLE}, l AS (SELECT unnest(range(1, {LEVELS + 1})) AS level),
x AS (SELECT n.k, level, n.g, n.n, n.m FROM n, l), q AS (SELECT a.k, a.level, a.g AS ga, b.g AS gb, a.m AS mean_a, b.m AS mean_b, a.n AS n_a, b.n AS n_b FROM x a JOIN x b ON a.k = b.k AND a.level = b.level AND a.g < b.g WHERE a.n > 1 AND b.n > 1),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY level, ga, gb) AS i, count(*) OVER (PARTITION BY k) AS c FROM q)
SELECT k, 'Balance: level ' || lpad(level::VARCHAR, 2, '0') || ': arm ' || ga || ' vs arm ' || gb AS name, mean_a, mean_b, n_a, n_b, greatest(c - {normalize.CAP}, 0) AS truncated FROM r WHERE i <= {normalize.CAP}""")  # fmt: skip
def registry_comparisons(spark, d):  # noqa: ANN001, ANN201
    """Pairs of groups by category, the first 250 kept and the others counted."""
    cut_off = F.get_json_object("metadata", "$.baseline_comparisons_truncated").cast("bigint")
    r = records(spark, d).select("k", F.explode("baseline_comparisons").alias("b"), cut_off.alias("truncated"))
    return r.select("k", "b.name", "b.mean_a", "b.mean_b", "b.n_a", "b.n_b", "truncated")


@query(f"""WITH {_PEOPLE}, l AS (SELECT unnest(range(1, {LEVELS + 1})) AS level) SELECT k, count(*) AS summaries, sum(n)::BIGINT AS people, round(sum(m), 1) AS means FROM n, l GROUP BY k""")
def registry_summaries(spark, d):  # noqa: ANN001, ANN201
    r = records(spark, d).select("k", F.explode("integer_summaries").alias("s")).where("NOT s.integer_scale AND s.sd = 2.5 AND s.sd_decimals = 2 AND s.mean_decimals = 1")
    return r.groupBy("k").agg(F.count("*").alias("summaries"), F.sum("s.n").alias("people"), F.round(F.sum("s.mean"), 1).alias("means"))


@query(f"""WITH {_PEOPLE}, e AS (SELECT * FROM (VALUES ('o: Hazard Ratio', 'ratio', false, 'approximate_review', 'survival_model', 'Cox'), ('o: Mean Difference', 'additive', false, 'high_confidence', 'mean_comparison', 't test'),
('o: Slope', 'additive', true, 'approximate_review', 'mean_comparison', 'ANOVA, 1-sided')) v(name, scale, one_tailed, tier, family, method))
SELECT k, name, scale, one_tailed, tier, family, method, people, gs AS groups FROM p, e WHERE k % 5 <> 0""")  # fmt: skip
def registry_effects(spark, d):  # noqa: ANN001, ANN201
    """Of seven analyses the three that allow a check of interval against p-value."""
    r = records(spark, d).select("k", F.explode("reported_effects").alias("e"))
    return r.select("k", "e.name", "e.scale", "e.one_tailed", F.col("e.applicability_tier").alias("tier"), F.col("e.statistical_method_family").alias("family"), parsers.method_of_source(F.col("e.source")).alias("method"), F.col("e.analysis_population_n").alias("people"), F.size("e.selected_groups").cast("bigint").alias("groups"))


@query("""WITH p AS (SELECT c_nationkey AS k, count(*) AS people FROM customer GROUP BY 1)
SELECT k, k % 3 <> 0 AS analysis_population, k % 2 = 0 AS primary_outcome, true AS effect_estimate, k % 5 <> 0 OR true AS "precision", k % 3 = 0 AS harms, k % 7 = 0 AS data_sharing, CASE WHEN k % 5 <> 0 THEN 7 ELSE 1 END::BIGINT AS analyses, CASE WHEN k % 5 <> 0 THEN 3 ELSE 0 END::BIGINT AS eligible,
people AS population FROM p""")  # fmt: skip
def registry_flags(spark, d):  # noqa: ANN001, ANN201
    m = lambda k: F.get_json_object("metadata", f"$.{k}")
    said = [F.element_at("reporting", c).alias(c) for c in ("analysis_population", "primary_outcome", "effect_estimate", "precision", "harms", "data_sharing")]
    return records(spark, d).select("k", *said, m("reported_analyses_count").cast("bigint").alias("analyses"), m("ci_p_eligible_analyses_before_cap").cast("bigint").alias("eligible"), F.from_json(m("analysis_population_ns"), "array<bigint>")[0].alias("population"))


@query("""SELECT DISTINCT c_nationkey AS k, CASE WHEN c_nationkey % 5 <> 0 THEN 3 ELSE 0 END::BIGINT AS processed, CASE WHEN c_nationkey % 5 <> 0 THEN 1 ELSE 0 END::BIGINT AS high, CASE WHEN c_nationkey % 5 <> 0 THEN 2 ELSE 0 END::BIGINT AS rough, 'COMPLETED' AS status FROM customer""")
def backfilled_effects(spark, d):  # noqa: ANN001, ANN201
    """Records whose effects lack the newer fields, as older pulls left them."""
    lost = ("statistical_method_family", "applicability_tier", "analysis_population_n", "ci_sidedness", "parameter_type", "adjustment_comment", "selected_groups")
    r = records(spark, d)
    r = r.withColumn("reported_effects", F.transform("reported_effects", lambda e: e.withField("one_tailed", e["one_tailed"]).withField(lost[0], F.lit(None).cast("string")).withField(lost[1], F.lit(None).cast("string")).withField(lost[2], F.lit(None).cast("bigint"))))
    m = lambda k: F.get_json_object("metadata", f"$.{k}")
    return normalize.backfill(r).select("k", m("ci_p_eligible_analyses_processed").cast("bigint").alias("processed"), m("ci_p_high_confidence_analyses_processed").cast("bigint").alias("high"), m("ci_p_approximate_review_analyses_processed").cast("bigint").alias("rough"), m("overall_status").alias("status"))


@query("""WITH n AS (SELECT count(DISTINCT c_nationkey) AS n FROM customer) SELECT n AS downloaded, n AS accepted, 0::BIGINT AS excluded, true AS same, n = 25 AS ok FROM n""")
def manifest_and_cohort(spark, d):  # noqa: ANN001, ANN201
    """The manifest of a retrieval, and a cohort in another order checked against it."""
    s, r = studies(spark, d), records(spark, d).drop("k")
    flat = r.select("study_id", "randomized_n", "metadata")
    m = files.manifest(s.where(F.size(normalize.assertions()) == 0), flat, 25, {"pageSize": 1000})
    qc = corpus.cohort_qc(flat.orderBy(F.desc("study_id")), 25, m, files.digest(flat))
    excluded = F.coalesce(F.aggregate(F.map_values("exclusions"), F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0).cast("bigint"))
    return m.crossJoin(qc.select("manifest_equal", "ok")).select("downloaded", "accepted", excluded.alias("excluded"), F.col("manifest_equal").alias("same"), "ok")


# -- lines, corruptions, samples and scores -------------------------------------------------------


@query("""WITH k AS (SELECT o_orderkey % 10 AS k FROM orders), e AS (SELECT CASE k WHEN 1 THEN 'randomized_n' WHEN 2 THEN 'unknown_field' WHEN 3 THEN 'integer_summaries' WHEN 4 THEN 'randomized_n,not_json' WHEN 5 THEN 'levels' WHEN 6 THEN 'reported_stats' WHEN 7 THEN 'subgroups' ELSE '' END AS errors FROM k)
SELECT errors, count(*) AS lines FROM e GROUP BY 1""")  # fmt: skip
def quarantined_lines(spark, d):  # noqa: ANN001, ANN201
    """Lines with faults at several depths, and fine ones whose numbers stand in quotes."""
    n = F.col("n")
    line = {
        1: F.lit('{"randomized_n":0}'), 2: F.lit('{"randomized_n":5,"odd":1}'), 3: F.format_string('{"randomized_n":5,"integer_summaries":[{"name":"a","mean":%d.5,"n":3,"bogus":1}]}', n),
        4: F.lit('{"randomized_n":'), 5: F.lit('{"randomized_n":5,"subgroups":[{"variable":"v","levels":[{"name":"a","n":-1}]}]}'), 6: F.lit('{"randomized_n":5,"reported_stats":[{"stat_type":"t","value":"x","df1":3}]}'),
        7: F.lit('{"randomized_n":5,"subgroups":[{"variable":"v","levels":[{"name":"a","n":1,"bogus":2}]}]}'), 8: F.format_string('{"randomized_n":"%d","reported_stats":[{"stat_type":"z","value":"2.2","reported_p":"0.03"}]}', n), 9: F.format_string('{"randomized_n":%d,"metadata":{"any":{"thing":[1]}}}', n),
    }
    text = F.lit('{"randomized_n":20.0}')
    for k, v in line.items():
        text = F.when(F.col("o_orderkey") % 10 == k, v).otherwise(text)
    lines = t(spark, d, "orders").withColumn("n", (F.col("o_custkey") + 1).cast("bigint")).select(text.alias("value"))
    return parsed(lines).groupBy(F.array_join(F.when(F.array_contains("errors", "reported_stats"), F.array(F.lit("reported_stats"))).otherwise(F.col("errors")), ",").alias("errors")).agg(F.count("*").alias("lines"))


_P_OF = C._T_TAIL.format(z="x")


@query(f"""WITH d AS (SELECT * FROM (VALUES ('count_+1'), ('count_+2'), ('count_+5')) v(dose)), r AS (SELECT * FROM (VALUES ('ENROLLMENT-ARM-SUM'), ('SUBGROUP-PARTITION')) v(rule_id)), c AS (SELECT least(50, count(DISTINCT c_nationkey)) AS n FROM customer),
s AS (SELECT dose, p, 28.0::DOUBLE AS df FROM (VALUES ('p_+0.001', 0.037::DOUBLE), ('p_+0.010', 0.046), ('p_+0.050', 0.086)) v(dose, p)), b AS (SELECT dose, p, df, unnest([2.195, 2.205]::DOUBLE[]) AS x FROM s), q AS (SELECT dose, p, {_P_OF} AS q FROM b),
a AS (SELECT dose, p, min(q) AS lo, max(q) AS hi FROM q GROUP BY 1, 2), v AS (SELECT dose, CASE WHEN hi <= 0.05 AND p - 0.0005 > 0.05 THEN 'flag' WHEN NOT (hi >= p - 0.0005 AND p + 0.0005 >= lo) THEN 'warn' ELSE 'pass' END AS verdict FROM a),
g AS (SELECT c_nationkey AS k, count(*) AS n, sum(c_custkey % 11)::BIGINT AS tot FROM customer GROUP BY 1 HAVING count(*) <= 1000 ORDER BY k LIMIT 50),
m AS (SELECT dose, n, (2000 * tot + n) // (2 * n) + u AS m FROM (VALUES ('mean_+1_unit', 1), ('mean_+2_units', 2), ('mean_+5_units', 5)) w(dose, u), g), h AS (SELECT dose, abs(2000 * (n * m // 1000) - 2 * n * m) <= n OR abs(2000 * ((n * m + 999) // 1000) - 2 * n * m) <= n AS ok FROM m)
SELECT rule_id, dose, n AS cases, n AS detected, n AS hard_flags, 0::BIGINT AS clean_nonpass FROM r, d, c
UNION ALL SELECT 'STATCHECK', dose, n, CASE WHEN verdict <> 'pass' THEN n ELSE 0 END, CASE WHEN verdict = 'flag' THEN n ELSE 0 END, 0 FROM v, c
UNION ALL SELECT 'GRIM', dose, count(*), count(*) FILTER (WHERE NOT ok), count(*) FILTER (WHERE NOT ok), 0 FROM h GROUP BY dose""")  # fmt: skip
def dose_response(spark, d):  # noqa: ANN001, ANN201
    """Four rules at three doses on the first carriers: found, hard flags, and clean records that don't pass."""
    seg = t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k"), "c_mktsegment").agg(F.count("*").alias("n"), F.sum(F.col("c_custkey") % 11).alias("points"))
    level = F.struct(F.col("c_mktsegment").alias("name"), "n")
    r = seg.groupBy("k").agg(F.sum("n").alias("randomized_n"), F.sum("points").alias("points"), F.map_from_entries(F.collect_list(F.struct("c_mktsegment", "n"))).alias("arm_ns"), F.array_sort(F.collect_list(level)).alias("levels"))
    one = F.struct(F.lit("segment").alias("variable"), F.col("randomized_n").alias("population_n"), F.transform("levels", lambda v: F.from_json(F.to_json(v), LEVEL)).alias("levels"))
    mean = F.expr("(2000 * points + randomized_n) div (2 * randomized_n)") / 1000
    scale = F.struct(F.lit("points").alias("name"), mean.alias("mean"), F.col("randomized_n").alias("n"), F.lit(3).alias("mean_decimals"))
    r = r.select(F.format_string("%03d", "k").alias("record_key"), "randomized_n", "arm_ns", F.array(F.from_json(F.to_json(one), SUBGROUP)).alias("subgroups"), F.array(F.from_json(F.to_json(scale), SUMMARY)).alias("integer_summaries"))
    return doses.response(doses.cases(with_defaults(r))).drop("detection_rate", "hard_flag_rate")


@query(f"""WITH v AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), f AS (SELECT k, r.rule_id, r.verdict, r.quota FROM v CROSS JOIN (VALUES ('STATCHECK', 'not_applicable', 10), ('BASELINE-ANOMALY', 'not_applicable', 10), ('SUBGROUP-PARTITION', 'not_applicable', 10), ('REPORTING-COMPLETENESS', 'warn', 15)) r(rule_id, verdict, quota)),
h AS (SELECT k || '/' || rule_id AS key, rule_id, verdict, quota, sha256('{corpus.QUEUE_SEED}:' || k || '/' || rule_id) AS h FROM f), i AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY h) AS i FROM h),
a AS (SELECT key, rule_id, verdict, false AS refill FROM i WHERE i <= quota), b AS (SELECT key, rule_id, verdict, true AS refill FROM i WHERE i > quota ORDER BY h LIMIT (SELECT {corpus.QUEUE_ROWS} - count(*) FROM a))
SELECT key, rule_id AS check_family, verdict AS pipeline_label, refill FROM a UNION ALL SELECT key, rule_id, verdict, refill FROM b""")  # fmt: skip
def review_queue(spark, d):  # noqa: ANN001, ANN201
    """The adjudication queue of 200 rows by its eleven quotas."""
    return corpus.review_queue(rules.checked(C.order_records(spark, d), C.CFG)).select("key", "check_family", "pipeline_label", "refill")


@query("""WITH r AS (SELECT l_orderkey AS k, l_linenumber AS i, bool_or(l_quantity > 25) AS gold, bool_or(l_discount > 0.05) AS predicted FROM lineitem GROUP BY 1, 2),
c AS (SELECT count(*) FILTER (WHERE gold AND predicted) AS tp, count(*) FILTER (WHERE predicted AND NOT gold) AS fp, count(*) FILTER (WHERE gold AND NOT predicted) AS fn FROM r), s AS (SELECT *, tp / (tp + fp)::DOUBLE AS p, tp / (tp + fn)::DOUBLE AS r FROM c)
SELECT tp, fp, fn, round(p, 9) AS "precision", round(r, 9) AS recall, round(2 * p * r / (p + r), 9) AS f1 FROM s""")  # fmt: skip
def span_scores(spark, d):  # noqa: ANN001, ANN201
    of = lambda c: F.collect_set(F.when(c, F.col("l_linenumber")))
    rows = t(spark, d, "lineitem").groupBy("l_orderkey").agg(of(F.col("l_quantity") > 25).alias("gold"), of(F.col("l_discount") > 0.05).alias("predicted"))
    return corpus.span_scores(rows).select("tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


STEPS = 64


@query(f"""WITH {C._CUST}, q AS (SELECT abs(z) AS a, {C._TAIL.format(z="abs(z)")} AS got, 0.5 - abs(z) / {3 * STEPS} / sqrt(2 * pi()) * list_sum([CASE WHEN i = 0 OR i = {STEPS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-0.5 * (abs(z) * i / {STEPS}) ** 2) for i in range({STEPS + 1})]) AS want FROM c)
SELECT floor(a)::BIGINT AS unit, count(*) AS n, round(max(abs(got - want)), 6) AS max_error, count(*) FILTER (WHERE abs(got - want) > 1e-6) AS failures FROM q GROUP BY 1""")  # fmt: skip
def largest_kernel_error(spark, d):  # noqa: ANN001, ANN201
    """Upper tails of the normal law against Simpson's rule over the density from 0 on, by whole units of z."""
    a = F.abs("z")
    weight = lambda i: F.when((i == 0) | (i == STEPS), 1).when(i % 2 == 1, 4).otherwise(2)
    area = F.aggregate(F.sequence(F.lit(0), F.lit(STEPS)), F.lit(0.0), lambda x, i: x + weight(i) * F.exp(-0.5 * F.pow(a * i / STEPS, 2)))
    rows = C.customer_z(spark, d).select(F.floor(a).alias("unit"), K.normal_sf_udf(a).alias("got"), (0.5 - a / (3 * STEPS) / math.sqrt(2 * math.pi) * area).alias("want"))
    return corpus.largest_error(rows, 1e-6, ("unit",)).withColumn("max_error", F.round("max_error", 6))


@query("SELECT event_id, floor((event_id + 1) * 0.3::DOUBLE + 1e-9) > floor(event_id * 0.3::DOUBLE + 1e-9) AS miss FROM events")
def miss_schedule(spark, d):  # noqa: ANN001, ANN201
    return corpus.miss_schedule(t(spark, d, "events").select("event_id"), "event_id", 0.3)


@query("""WITH n AS (SELECT count(*) FILTER (WHERE c_custkey % 10 <> 0) AS known, count(*) FILTER (WHERE c_custkey % 10 = 0) AS audited FROM customer)
SELECT CASE WHEN c_custkey % 3 = 2 THEN 'flag' ELSE 'warn' END AS verdict, count(*) AS lines, any_value(known) AS known, any_value(audited) AS audited FROM customer, n GROUP BY 1""")  # fmt: skip
def incremental_audit(spark, d):  # noqa: ANN001, ANN201
    """A second run over all lines, nine tenths of which a first run has stored: only the others are audited."""
    n = F.col("c_nationkey") + 1
    line = F.format_string('{"study_id":"%d","randomized_n":%d,"arm_ns":{"a":%d}}', "c_custkey", n, n + F.col("c_custkey") % 3 - 1)
    lines, store, cfg = t(spark, d, "customer").select("c_custkey", line.alias("value")), files.scratch(spark, "responses"), C.CFG
    incremental.audit_new(lines.where("c_custkey % 10 <> 0").select("value"), store, cfg)
    known = incremental.stored(spark, store, cfg).count()
    out = incremental.audit_new(lines.select("value"), store, cfg)
    audited = incremental.stored(spark, store, cfg).count() - known
    return out.groupBy(F.col("feasibility_verdict").alias("verdict")).agg(F.count("*").alias("lines")).withColumns({"known": F.lit(known).cast("bigint"), "audited": F.lit(audited).cast("bigint")})


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 500")
def accepted_first(spark, d):  # noqa: ANN001, ANN201
    """The first 500 accepted orders by date."""
    return incremental.accept_first(t(spark, d, "orders").where("o_orderstatus = 'O'"), ["o_orderdate", "o_orderkey"], 500).select("o_orderkey", "o_custkey", "o_totalprice")
