"""The audit rules: each family is an array of findings over a record's own columns.

A finding is (record_key, rule_id, rule_rank, seq, verdict, severity, rationale, evidence,
guideline_ref). All families stand in one projection, so that records are read and parsed once and never
shuffled; p-values of continuous laws leave the JVM in one Arrow call a batch for all rules together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.config import FIELDS, Config
from plumbline.functions import intervals as I
from plumbline.functions import kernels as K
from plumbline.schema import LEVEL, SUBGROUP, SUMMARY, with_defaults

# Rule names and their ranks.
RANKS = {
    "REPORTING-COMPLETENESS": 0, "ENROLLMENT-ARM-SUM": 10, "SUBGROUP-PARTITION": 20, "SUBGROUP-PERCENT": 21, "SUBGROUP-INTERACTION-TEST": 22,
    "SUBGROUP-INTERACTION-POWER": 23, "SUBGROUP-EVENT-FLOOR": 24, "SUBGROUP-EXPECTED-CELL": 25, "STATCHECK": 30, "GRIM": 40, "GRIMMER": 41,
    "BASELINE-ANOMALY": 50,
}
REFERENCES = {
    "REPORTING-COMPLETENESS": "CONSORT reporting items", "ENROLLMENT-ARM-SUM": "CONSORT participant flow", "SUBGROUP-PARTITION": "CONSORT subgroup reporting",
    "SUBGROUP-PERCENT": "integer feasibility", "SUBGROUP-INTERACTION-TEST": "ICEMAN", "SUBGROUP-INTERACTION-POWER": "Brookes et al.",
    "SUBGROUP-EVENT-FLOOR": "events per parameter", "SUBGROUP-EXPECTED-CELL": "chi-square approximation", "STATCHECK": "Nuijten & Epskamp",
    "GRIM": "Brown & Heathers 2016", "GRIMMER": "Allard 2018", "BASELINE-ANOMALY": "Carlisle 2017",
}
NA, PASS, WARN, FLAG = "not_applicable", "pass", "warn", "flag"
FINDING = ("record_key", "rule_id", "rule_rank", "seq", "verdict", "severity", "rationale", "evidence", "guideline_ref")
#: A finding within its record.
CHECKS = "array<struct<rule_rank:int,seq:int,rule_id:string,verdict:string,severity:string,rationale:string,evidence:string,guideline_ref:string,scope:string>>"


def _case(*branches: tuple, last: tuple) -> Column:
    """struct(verdict, severity, rationale) of the first branch that holds."""
    one = lambda v: F.struct(*[(x if isinstance(x, Column) else F.lit(x)).alias(n) for x, n in zip(v, ("verdict", "severity", "rationale"), strict=True)])
    out = None
    for test, *v in branches:
        out = F.when(test, one(v)) if out is None else out.when(test, one(v))
    return out.otherwise(one(last)) if out is not None else one(last)


def _made(rule: str, judged: Column, evidence: Column | None, seq: Column | int = 0, ref: str | None = None) -> Column:
    """One finding, but for its record, in the order that responses sort by; its scope looks at the record's column ``rules``."""
    scope = F.when(judged["verdict"] == NA, F.when(F.array_contains("rules", rule), "source_schema").otherwise("record"))
    return F.struct(
        F.lit(RANKS[rule]).alias("rule_rank"), (seq if isinstance(seq, Column) else F.lit(seq)).cast("int").alias("seq"), F.lit(rule).alias("rule_id"),
        judged["verdict"].alias("verdict"), judged["severity"].alias("severity"), judged["rationale"].alias("rationale"),
        (F.lit("{}") if evidence is None else F.to_json(evidence)).alias("evidence"), F.lit(ref or REFERENCES[rule]).alias("guideline_ref"), scope.alias("scope"),
    )


def _absent(*named: tuple[str, str]) -> Column:
    """Constant findings (rule, why it isn't applicable) of a record that has nothing to look at."""
    return F.array(*[_made(rule, _case(last=(NA, "info", why)), None) for rule, why in named])


def _with_rules(r: DataFrame) -> DataFrame:
    """r with ``rules``: those that its source has no fields for."""
    return r.withColumn("rules", F.coalesce(F.from_json(F.get_json_object("metadata", "$.source_schema_unavailable_rules"), "array<string>"), F.array().cast("array<string>")))


def _rows(df: DataFrame, findings: Column) -> DataFrame:
    return exploded(_with_rules(df), findings).select(*FINDING)


def exploded(df: DataFrame, findings: Column, *keep: str) -> DataFrame:
    """A row each of an array of findings. For F.inline Spark filters on the array's size first, and works the whole array out a second time for that (more often where parts repeat)."""
    return df.select(*(keep or ("record_key",)), F.inline_outer(findings)).where("rule_id IS NOT NULL")


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _fields(x: Column, *names: str) -> list[Column]:
    return [x[n].alias(n) for n in names]


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0)))


# -- completeness and enrollment ------------------------------------------------------------------


def completeness(cfg: Config) -> Column:
    """struct(score, present, applicable, missing)."""
    own = {"randomized_n": F.col("randomized_n") > 0, "arm_sizes": F.size(F.map_keys("arm_ns")) > 0}
    said = {k: F.element_at("reporting", k) for k in FIELDS if k not in own}
    silent = {k: ~F.array_contains(F.map_keys("reporting"), k) for k in said}
    held = {k: F.coalesce(own.get(k, said.get(k)), F.lit(False)) for k in FIELDS}
    counts = {k: F.lit(True) if k in own else silent[k] | said[k].isNotNull() for k in FIELDS}
    population = F.col("analyzed_n").isNotNull()
    held["analysis_population"] = population | held["analysis_population"]
    counts["analysis_population"] = population | said["analysis_population"].isNotNull()
    w = cfg.completeness_weights
    total = lambda tests: sum((F.when(t, F.lit(float(w[k]))).otherwise(0.0) for k, t in tests.items()), F.lit(0.0))
    applicable, present = total(counts), total({k: counts[k] & held[k] for k in FIELDS})
    missing = F.array_sort(F.array_compact(F.array(*[F.when(counts[k] & ~held[k], F.lit(k)) for k in FIELDS])))
    score = F.when(applicable > 0, present / applicable).otherwise(1.0)
    return F.struct(score.alias("score"), present.alias("present"), applicable.alias("applicable"), missing.alias("missing"))


def completeness_array(cfg: Config, evidence: bool = True) -> Column:  # noqa: FBT001, FBT002
    def one(c: Column) -> Column:
        n = F.size(c["missing"])
        judged = _case((n > 0, WARN, "low", F.concat(n.cast("string"), F.lit(" applicable reporting fields are missing"))), last=(PASS, "info", "all applicable reporting fields are present"))
        return _made("REPORTING-COMPLETENESS", judged, F.struct(*_fields(c, "present", "applicable", "missing")) if evidence else None)

    return F.transform(F.array(completeness(cfg)), one)


def enrollment_array(cfg: Config, evidence: bool = True) -> Column:  # noqa: FBT001, FBT002
    n = F.col("randomized_n")
    basis = F.get_json_object("metadata", "$.arm_count_basis")
    other = ~F.col("arm_counts_comparable_to_randomized_n") | F.coalesce(basis == "participant_flow_first_period_started", F.lit(False))

    def one(arms: Column) -> Column:
        judged = _case(
            (F.size(F.map_keys("arm_ns")) == 0, NA, "info", "no arm sizes were reported"),
            (other, NA, "info", "arm sizes and enrollment count different populations"),
            (arms > n, FLAG, "high", "arm sizes add up to more than were randomized"),
            (arms < n, WARN, "low", "arm sizes leave randomized participants out"),
            last=(PASS, "info", "arm sizes add up to the randomized number"),
        )
        return _made("ENROLLMENT-ARM-SUM", judged, F.struct(arms.alias("arm_total"), "randomized_n", "arm_ns", basis.alias("arm_count_basis")) if evidence else None)

    general = F.transform(F.array(_total(F.map_values("arm_ns"))), one)
    return general if evidence else F.when(F.size(F.map_keys("arm_ns")) == 0, _absent(("ENROLLMENT-ARM-SUM", "no arm sizes were reported"))).otherwise(general)


# -- subgroups ------------------------------------------------------------------------------------


def _or_none(items: Column, kind: str) -> Column:
    """An array's items, or one null where there are none."""
    return F.when(F.size(items) > 0, items).otherwise(F.array(F.lit(None).cast(kind)))


def subgroup_array(cfg: Config, evidence: bool = True) -> Column:  # noqa: FBT001, FBT002
    """Six findings a subgroup, or six that say there is none."""
    general = F.flatten(F.transform(_or_none(F.col("subgroups"), SUBGROUP), lambda s, i: _subgroup(s, i, cfg, evidence)))
    none = _absent(*[(rule, "no subgroup analysis was supplied") for rule in RANKS if rule.startswith("SUBGROUP")])
    return general if evidence else F.when(F.size("subgroups") == 0, none).otherwise(general)


def _subgroup(s: Column, seq: Column, cfg: Config, evidence: bool) -> Column:  # noqa: FBT001
    levels, none = F.coalesce(s["levels"], F.array().cast(f"array<{LEVEL}>")), s.isNull()
    target = F.coalesce(s["population_n"], "analyzed_n", "randomized_n")
    absent = (none, NA, "info", "no subgroup analysis was supplied")
    var = s["variable"].alias("variable")
    shown_as = lambda *xs: F.struct(var, *xs) if evidence else None
    names = lambda xs: F.transform(xs, lambda v: v["name"])

    def counts(c: Column) -> Column:
        partition = _case(
            absent,
            ((F.size(c["over"]) > 0) | (F.size(c["torn"]) > 0) | (s["mutually_exclusive"] & (c["total"] > target)), FLAG, "high", "subgroup counts cannot come from the analysed population"),
            (s["mutually_exclusive"] & s["exhaustive"] & (c["total"] < target), WARN, "medium", "an exhaustive subgroup leaves participants out"),
            (~s["mutually_exclusive"], PASS, "info", "overlapping levels each fit the analysed population"),
            last=(PASS, "info", "subgroup counts fit the analysed population"),
        )
        return _made("SUBGROUP-PARTITION", partition, shown_as(c["total"].alias("subgroup_total"), target.alias("target_n"), names(c["over"]).alias("over"), names(c["torn"]).alias("arm_mismatches")), seq)

    torn = F.filter(levels, lambda v: F.coalesce((F.size(F.map_keys(v["arm_ns"])) > 0) & (_total(F.map_values(v["arm_ns"])) != v["n"]), F.lit(False)))
    partition = _let(F.struct(_total(F.transform(levels, lambda v: v["n"])).alias("total"), F.filter(levels, lambda v: v["n"] > target).alias("over"), torn.alias("torn")), counts)
    shown = F.filter(levels, lambda v: v["percentage"].isNotNull())
    implied = lambda v: F.lit(100.0) * v["n"] / F.coalesce(v["percentage_denominator"], target)
    wrong = F.filter(shown, lambda v: F.abs(implied(v) - v["percentage"]) > I.pow10(v["percentage_decimals"]) / 2 + 1e-12)
    percent = _case(
        absent, (F.size(shown) == 0, NA, "info", "no percentages were supplied"), (F.size(wrong) > 0, FLAG, "medium", "percentages do not fit integer counts"),
        last=(PASS, "info", "percentages fit integer counts"),
    )
    quiet = (~s["effect_claimed"], NA, "info", "no subgroup effect is claimed")
    test = _case(absent, quiet, (F.coalesce(s["formal_interaction_test"], F.lit(False)), PASS, "info", "an interaction test backs the claim"), last=(WARN, "medium", "a subgroup effect is claimed without an interaction test"))
    need = F.ceil(s["main_effect_required_n"] * F.lit(cfg.interaction_sample_multiplier))
    power = _case(
        absent, quiet, (F.coalesce(s["powered_for_interaction"], F.lit(False)), PASS, "info", "the sample was planned for the interaction"),
        (s["main_effect_required_n"].isNull(), NA, "info", "there is no planned size to compare with"),
        (F.col("randomized_n") < need, WARN, "medium", "enrollment is under the size an interaction needs"), last=(PASS, "info", "enrollment reaches the size an interaction needs"),
    )
    events = F.filter(levels, lambda v: v["events"].isNotNull())
    floor = F.lit(cfg.min_events_per_parameter) * s["estimated_parameters"]
    few = F.filter(events, lambda v: v["events"] < floor)
    event = _case(absent, (F.size(events) == 0, NA, "info", "no event counts were supplied"), (F.size(few) > 0, WARN, "medium", "a level has fewer events than the floor"), last=(PASS, "info", "every level reaches the event floor"))
    cells = F.coalesce(s["contingency_cells"], F.array().cast("array<double>"))
    low = F.filter(cells, lambda c: c < cfg.min_expected_cell_count)
    cell = _case(absent, (F.size(cells) == 0, NA, "info", "no expected cell counts were supplied"), (F.size(low) > 0, WARN, "medium", "an expected cell is under the floor"), last=(PASS, "info", "expected cells reach the floor"))
    return F.array(
        partition,
        _made("SUBGROUP-PERCENT", percent, shown_as(names(wrong).alias("issues")), seq),
        _made("SUBGROUP-INTERACTION-TEST", test, shown_as(s["interaction_p"].alias("interaction_p")), seq),
        _made("SUBGROUP-INTERACTION-POWER", power, shown_as(need.alias("interaction_required_n")), seq),
        _made("SUBGROUP-EVENT-FLOOR", event, shown_as(floor.alias("floor"), names(few).alias("failures")), seq),
        _made("SUBGROUP-EXPECTED-CELL", cell, shown_as(F.array_min(cells).alias("observed_min"), low.alias("low_cells")), seq),
    )


# -- p-values -------------------------------------------------------------------------------------
#
# What the kernel is asked is flat: K.STAT, K.EFFECT and K.COMPARISON numbers an item. It answers three numbers an item.


def _number(x: Column) -> Column:
    return x.cast("double")


def _answer(p: Column, i: Column) -> Column:
    """struct(p, p_min, p_max) of item i; what is undefined is null."""
    at = lambda k: F.nanvl(F.get(p, 3 * i + k), F.lit(None).cast("double"))
    return F.struct(at(0).alias("p"), at(1).alias("p_min"), at(2).alias("p_max"))


def stat_ask(s: Column) -> Column:
    half = I.pow10(s["statistic_decimals"]) / 2
    kind, v, edge = s["stat_type"], s["value"], F.lit(0.999999999999)
    low = F.when(kind.isin("F", "chi2", "Q"), F.greatest(F.lit(0.0), v - half)).when(kind == "r", F.greatest(-edge, v - half)).otherwise(v - half)
    high = F.when(kind == "r", F.least(edge, v + half)).otherwise(v + half)
    across = kind.isin("t", "z", "r") & (low <= 0) & (high >= 0)
    usable = s["reported_p"].isNotNull() & ~s["adjusted"]
    code = F.array_position(F.array(*[F.lit(k) for k in K.TESTS]), kind)
    return F.array(*map(_number, (F.when(usable, code), s["df1"], s["df2"], s["one_tailed"], v, low, high, F.when(across, 0.0))))


def effect_scaled(e: Column, x: Column) -> Column:
    return F.when(e["scale"] == "ratio", F.log(F.when(x > 0, x))).otherwise(x)


def effect_ask(e: Column) -> Column:
    """Level, tails, and of estimate and limits the printed value, its rounding box, and the null value where the box holds it."""
    null = F.when(e["scale"] == "ratio", 1.0).otherwise(0.0)

    def box(value: str) -> list[Column]:
        v, h = e[value], I.pow10(e[f"{value}_decimals"]) / 2
        return [effect_scaled(e, x) for x in (v, v - h, v + h, F.when((v - h <= null) & (null <= v + h), null))]

    return F.array(*map(_number, (e["confidence_level"], e["one_tailed"], *box("estimate"), *box("ci_lower"), *box("ci_upper"))))


def comparison_ask(b: Column) -> Column:
    half = [I.pow10(b[f"{v}_decimals_{g}"]) / 2 for v in ("mean", "sd") for g in ("a", "b")]
    return F.array(*map(_number, (b["mean_a"], b["mean_b"], b["sd_a"], b["sd_b"], *half, b["n_a"], b["n_b"])))


ASKED = {"reported_stats": stat_ask, "reported_effects": effect_ask, "baseline_comparisons": comparison_ask}


def with_p(r: DataFrame) -> DataFrame:
    """Records with column p: what the kernel says of their statistics, effects and comparisons."""
    return r.withColumn("p", K.audit_p(*[F.flatten(F.transform(c, f)) for c, f in ASKED.items()]))


def _alone(ask: Column, place: int) -> Column:
    """The kernel's answer to one item of one kind."""
    none = F.array().cast("array<double>")
    return K.audit_p(*[ask if k == place else none for k in range(3)])


def stat_judged(s: Column, a: Column, cfg: Config) -> Column:
    """struct(consistent, decision_error, significance) of a statistic and its answer."""
    alpha = F.lit(cfg.alpha)
    return I.consistency(a["p_min"], a["p_max"], I.printed(s["reported_p"], s["p_operator"], s["p_decimals"], alpha), alpha)


def statcheck(d: DataFrame, cfg: Config) -> DataFrame:
    """d with struct column s (a reported statistic): adds p, p_min, p_max and agree."""
    d = d.withColumn("a", _alone(stat_ask(F.col("s")), 0)).withColumn("a", _answer(F.col("a.stats"), F.lit(0)))
    return d.select("*", "a.*").withColumn("agree", stat_judged(F.col("s"), F.col("a"), cfg)).drop("a")


def stat_array(cfg: Config, evidence: bool = True) -> Column:  # noqa: FBT001, FBT002
    def one(x: Column) -> Column:
        s, a, agree = x["s"], x["a"], x["agree"]
        judged = _case(
            (s["reported_p"].isNull(), NA, "info", "no p-value was reported"), (s["adjusted"], NA, "info", "the p-value is adjusted"),
            (agree["decision_error"], FLAG, "high", "reported and recomputed p-values differ on significance"),
            (~agree["consistent"], WARN, "medium", "the reported p-value is outside what rounding allows"), last=(PASS, "info", "the reported p-value fits the statistic"),
        )
        e = F.struct(F.lit("test_statistic").alias("method_family"), x["i"].alias("index"), *_fields(s, "stat_type", "value", "reported_p"), a["p"].alias("recomputed_p"), F.array(a["p_min"], a["p_max"]).alias("recomputed_interval"))
        return _made("STATCHECK", judged, e if evidence else None, x["i"])

    asked = F.transform("reported_stats", lambda s, i: F.struct(s.alias("s"), i.alias("i"), _answer(F.col("p.stats"), i).alias("a")))
    made = F.transform(F.transform(asked, lambda x: F.struct(*_fields(x, "s", "i", "a"), stat_judged(x["s"], x["a"], cfg).alias("agree"))), one)
    return F.when(F.size("reported_stats") > 0, made).otherwise(F.array().cast(CHECKS))


def effect_inside(e: Column) -> Column:
    """Whether the interval holds the estimate."""
    m, low, high = (effect_scaled(e, e[k]) for k in ("estimate", "ci_lower", "ci_upper"))
    return (low <= m) & (m <= high)


def effect_skew(e: Column) -> Column:
    m, low, high = (effect_scaled(e, e[k]) for k in ("estimate", "ci_lower", "ci_upper"))
    left, right = m - low, high - m
    return F.when(F.least(left, right) > 0, F.greatest(left, right) / F.least(left, right))


def ci_check(d: DataFrame, cfg: Config) -> DataFrame:
    """d with struct column e (a reported effect): adds inside, p, p_min, p_max, skew and agree."""
    e = F.col("e")
    d = d.withColumn("a", _alone(effect_ask(e), 1)).withColumn("a", _answer(F.col("a.effects"), F.lit(0)))
    d = d.select("*", "a.*").withColumn("agree", stat_judged(e, F.col("a"), cfg)).drop("a")
    return d.withColumn("inside", effect_inside(e)).withColumn("skew", effect_skew(e))


def effect_array(cfg: Config, evidence: bool = True) -> Column:  # noqa: FBT001, FBT002
    def one(x: Column) -> Column:
        e, a, agree = x["e"], x["a"], x["agree"]
        judged = _case(
            (~effect_inside(e), NA, "info", "the confidence interval does not hold the estimate"), (a["p_min"].isNull(), NA, "info", "no interval fits the printed precision"),
            (agree["decision_error"], WARN, "medium", "interval and p-value differ on significance; check model, adjustment and tails"),
            (~agree["consistent"], WARN, "medium", "the p-value is outside what the interval allows"), last=(PASS, "info", "the p-value fits the interval"),
        )
        shown = F.struct(
            F.lit("ci_to_p").alias("method_family"), x["i"].alias("index"), *_fields(e, "name", "estimate", "reported_p", "applicability_tier"),
            a["p"].alias("recomputed_p"), F.array(a["p_min"], a["p_max"]).alias("recomputed_interval"), effect_skew(e).alias("ci_symmetry_ratio"),
        )
        return _made("STATCHECK", judged, shown if evidence else None, F.size("reported_stats") + x["i"], "Altman & Bland 2011")

    asked = F.transform("reported_effects", lambda e, i: F.struct(e.alias("e"), i.alias("i"), _answer(F.col("p.effects"), i).alias("a")))
    made = F.transform(F.transform(asked, lambda x: F.struct(*_fields(x, "e", "i", "a"), stat_judged(x["e"], x["a"], cfg).alias("agree"))), one)
    return F.when(F.size("reported_effects") > 0, made).otherwise(F.array().cast(CHECKS))


def no_stat_array(cfg: Config, evidence: bool = True) -> Column:  # noqa: FBT001, FBT002
    def one(n: Column) -> Column:
        judged = _case((n > 0, NA, "info", "the registry's analyses give no statistic to recompute"), last=(NA, "info", "no statistics were reported"))
        return _made("STATCHECK", judged, F.struct(n.alias("registry_analyses")) if evidence else None)

    n = F.coalesce(F.get_json_object("metadata", "$.reported_analyses_count").try_cast("int"), F.lit(0))
    none = (F.size("reported_stats") == 0) & (F.size("reported_effects") == 0)
    return F.when(none, F.transform(F.array(n), one) if evidence else F.array(one(n))).otherwise(F.array().cast(CHECKS))


# -- integer means --------------------------------------------------------------------------------


def _power(d: Column) -> Column:
    """10 ** d as an exact decimal, d in 0..10."""
    return F.element_at(F.array(*[F.lit(10**k).cast("decimal(11,0)") for k in range(11)]), d + 1)


def grim_of(s: Column) -> Column:
    """struct(reason (null if GRIM applies), ok) of a summary, in exact decimals.

    A mean is feasible if some integer total next to mean * granule has it as its rounded mean; ties round either way.
    """
    tens, g = _power(s["mean_decimals"]), (s["n"] * s["items"]).cast("decimal(18,0)")
    mean = s["mean"].cast("decimal(28,10)")
    shown = F.round((mean * tens).cast("decimal(38,10)"), 0).cast("decimal(26,0)")
    raw = (mean * g).cast("decimal(38,10)")
    fits = lambda total: F.abs((2 * total.cast("decimal(20,0)") * tens).cast("decimal(38,0)") - (2 * g * shown.cast("decimal(18,0)")).cast("decimal(38,0)")) <= g
    why = F.when(~s["integer_scale"], "the scale is not of integers").when(s["n"] > tens, "there are more values than the decimals can tell apart")
    return F.struct(why.alias("reason"), (fits(F.floor(raw)) | fits(F.ceil(raw))).alias("ok"))


def grim(d: DataFrame) -> DataFrame:
    """d with struct column s (a summary): adds grim_reason and grim_ok."""
    return d.withColumn("g", grim_of(F.col("s"))).select("*", F.col("g.reason").alias("grim_reason"), F.col("g.ok").alias("grim_ok")).drop("g")


def grimmer_of(s: Column, g: Column) -> Column:
    """struct(reason, ok) of a summary and what GRIM says of it.

    Among the integer sums of squares that the rounded SD allows, those with the parity of the
    sum must give back the SD. Inside the window all do, so that the three nearest to
    either end and one in the middle decide.
    """
    n, tens = s["n"].cast("double"), _power(s["sd_decimals"])
    total = F.round((s["mean"].cast("decimal(28,10)") * s["n"].cast("decimal(10,0)")).cast("decimal(38,10)"), 0).cast("bigint")
    half = I.pow10(s["sd_decimals"]) / 2
    square = lambda x: x * x
    goal = F.floor(s["sd"].cast("decimal(25,12)") * tens + F.lit("0.5").cast("decimal(2,1)"))

    def window(total: Column) -> Column:
        m = total / n
        low = F.ceil((n - 1) * square(F.greatest(F.lit(0.0), s["sd"] - half)) + n * square(m) - 1e-12)
        high = F.floor((n - 1) * square(s["sd"] + half) + n * square(m) + 1e-12)
        odd = F.pmod(total, F.lit(2))
        return F.struct(m.alias("m"), (low + F.pmod(low - odd, F.lit(2))).alias("first"), (high - F.pmod(high - odd, F.lit(2))).alias("last"), goal.alias("goal"))

    def decided(w: Column) -> Column:
        first, last = w["first"], w["last"]
        middle = first + 2 * F.floor((last - first) / 4)

        def good(ss: Column) -> Column:
            spread = ss - n * square(w["m"])
            sd = F.sqrt(F.greatest(F.lit(0.0), spread) / (n - 1))
            return (ss >= first) & (ss <= last) & (spread >= -1e-12) & (F.floor(sd.cast("decimal(25,12)") * tens + F.lit("0.5").cast("decimal(2,1)")) == w["goal"])

        return F.exists(F.array(first, first + 2, first + 4, middle, last - 4, last - 2, last), good)

    why = (
        F.when(s["sd"].isNull(), "no standard deviation was supplied").when(s["items"] != 1, "the geometry of scales of several items is unknown")
        .when(g["reason"].isNotNull(), g["reason"]).when(g["ok"] & (s["n"] == 1), "one value has no spread")
    )
    ok = F.when(why.isNull() & g["ok"], _let(_let(total, window), decided)).when(why.isNull(), F.lit(False))
    return F.struct(why.alias("reason"), ok.alias("ok"))


def summary_array(cfg: Config, evidence: bool = True) -> Column:  # noqa: FBT001, FBT002
    def two(x: Column) -> Column:
        s, g, h = x["s"], x["g"], x["h"]
        none = (s.isNull(), NA, "info", "no integer summaries were supplied")
        one = _case(none, (g["reason"].isNotNull(), NA, "info", g["reason"]), (g["ok"], PASS, "info", "the mean fits integer data"), last=(FLAG, "high", "no integer data has this mean"))
        more = _case(none, (h["reason"].isNotNull(), NA, "info", h["reason"]), (h["ok"], PASS, "info", "the SD fits integer data"), last=(FLAG, "high", "no integer data has this mean and SD"))
        e = F.struct(F.when(s.isNotNull(), x["i"]).alias("index"), *_fields(s, "name", "mean", "n", "sd")) if evidence else None
        return F.array(_made("GRIM", one, e, x["i"]), _made("GRIMMER", more, e, x["i"]))

    items = F.transform(_or_none(F.col("integer_summaries"), SUMMARY), lambda s, i: F.struct(s.alias("s"), i.alias("i"), grim_of(s).alias("g")))
    return F.flatten(F.transform(F.transform(items, lambda x: F.struct(*_fields(x, "s", "i", "g"), grimmer_of(x["s"], x["g"]).alias("h"))), two))


# -- baselines ------------------------------------------------------------------------------------


def welch(d: DataFrame) -> DataFrame:
    """d with struct column b (a comparison): adds p, p_low and p_high over the rounding boxes."""
    d = d.withColumn("a", _alone(comparison_ask(F.col("b")), 2)).withColumn("a", _answer(F.col("a.comparisons"), F.lit(0)))
    return d.select("*", F.col("a.p").alias("p"), F.col("a.p_min").alias("p_low"), F.col("a.p_max").alias("p_high")).drop("a")


def combined(p: Column) -> Column:
    """The kernel's combination of a record's comparisons by its names (K.COMBINED), Fisher's and Stouffer's; null without comparisons."""
    at = lambda k: F.nanvl(F.get(p, F.lit(k)), F.lit(None).cast("double"))
    return F.struct(*[(at(k).cast("bigint") if n == "size" else at(k)).alias(n) for k, n in enumerate(K.COMBINED)])


def baseline_array(cfg: Config, evidence: bool = True) -> Column:  # noqa: FBT001, FBT002
    b = F.col("baseline_comparisons")
    free = lambda x: x["independent_from_other_variables"] & (F.coalesce(F.size(x["correlated_with"]), F.lit(0)) <= 0)

    def one(c: Column) -> Column:
        judged = _case(
            (F.size(b) == 0, NA, "info", "no baseline comparisons were supplied"),
            (F.exists(b, lambda x: x["variable_type"] != "continuous"), NA, "info", "a baseline variable is not continuous"),
            ((F.size(b) > 1) & F.exists(b, lambda x: ~free(x)), NA, "info", "the variables are not known to be independent"),
            (c["safe_p"] < cfg.baseline_extreme_p, WARN, "low", "baseline p-values are unusually extreme; a weak signal"),
            last=(PASS, "info", "baseline p-values are not extreme"),
        )
        made = lambda e: _made("BASELINE-ANOMALY", judged, e)
        return F.when(F.size(b) > 0, made(c)).otherwise(made(None)) if evidence else made(None)

    general = F.transform(F.array(combined(F.col("p.combined"))), one)
    return F.when(F.size(b) == 0, _absent(("BASELINE-ANOMALY", "no baseline comparisons were supplied"))).otherwise(general)


# -- all of them ----------------------------------------------------------------------------------

FAMILIES = (completeness_array, enrollment_array, subgroup_array, stat_array, effect_array, no_stat_array, summary_array, baseline_array)


def completeness_findings(r: DataFrame, cfg: Config) -> DataFrame:
    return _rows(r, completeness_array(cfg))


def enrollment_findings(r: DataFrame, cfg: Config) -> DataFrame:
    return _rows(r, enrollment_array(cfg))


def subgroup_findings(r: DataFrame, cfg: Config) -> DataFrame:
    return _rows(r, subgroup_array(cfg))


def stat_findings(r: DataFrame, cfg: Config) -> DataFrame:
    return _rows(with_p(r), stat_array(cfg))


def summary_findings(r: DataFrame, cfg: Config) -> DataFrame:
    return _rows(r, summary_array(cfg))


def baseline_findings(r: DataFrame, cfg: Config) -> DataFrame:
    return _rows(with_p(r), baseline_array(cfg))


def _judged(records: DataFrame, cfg: Config, evidence: bool) -> DataFrame:  # noqa: FBT001
    """records, defaults filled in, with ``checks``: all findings in order of rule and place, each with its scope.

    The kernel is asked only where records come with a column that it looks at; a family without input is a constant.
    """
    r = _with_rules(with_defaults(records))
    silent = F.lit(None).cast("struct<stats:array<double>,effects:array<double>,comparisons:array<double>,combined:array<double>>")
    r = with_p(r) if set(ASKED) & set(records.columns) else r.withColumn("p", silent)
    return r.withColumn("checks", F.concat(*[f(cfg, evidence) for f in FAMILIES])).drop("rules", "p")


def findings(records: DataFrame, cfg: Config | None = None, *, evidence: bool = True) -> DataFrame:
    """All findings of records (with record_key), each not-applicable one with its scope.

    evidence=False leaves the evidence empty ("{}"), for aggregates that don't look at it.
    """
    return _judged(records, cfg or Config(), evidence).transform(lambda r: exploded(r, F.col("checks"))).select(*FINDING, "scope")


def checked(records: DataFrame, cfg: Config | None = None) -> DataFrame:
    """(record_key, checks): a record's findings in its row, without evidence; record_key is unique. What corpus counts without a shuffle of findings."""
    return _judged(records, cfg or Config(), evidence=False).select("record_key", "checks")


def verdict_of_record(checks: Column) -> Column:
    """flag, else warn, else pass."""
    has = lambda v: F.exists(checks, lambda f: f["verdict"] == v)
    return F.when(has(FLAG), FLAG).when(has(WARN), WARN).otherwise(PASS)


def verdicts(records: DataFrame, cfg: Config | None = None) -> DataFrame:
    """(record_key, verdict) per record, without a shuffle."""
    return _judged(records, cfg or Config(), evidence=False).select("record_key", verdict_of_record(F.col("checks")).alias("verdict"))


def responses(records: DataFrame, cfg: Config | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a record: verdict, completeness score and its findings in order, without a shuffle. keep: columns to carry along."""
    cfg = cfg or Config()
    r = _judged(records, cfg, evidence=True).withColumn("checks", F.array_sort("checks"))
    return r.select(
        "record_key", "study_id", F.round(completeness(cfg)["score"], 6).alias("completeness_score"), verdict_of_record(F.col("checks")).alias("feasibility_verdict"), "checks",
        F.lit(cfg.version).alias("config_version"), F.lit(cfg.rules_version).alias("rules_version"), F.lit(DISCLAIMER).alias("disclaimer"), *keep,
    )


DISCLAIMER = "Findings are for human review. They are no evidence of error or misconduct: rounding, transcription, adjusted analyses and sound choices of method can all raise them."
