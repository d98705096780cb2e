"""Registry studies (nested JSON) to study records, in one projection.

Everything is higher-order functions over a typed struct: no explode, no shuffle. Lookups of a
group by its id take the last entry of that id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import parsers as P
from plumbline.schema import BASELINE, EFFECT, SUBGROUP, SUMMARY, violations, with_defaults

GROUPS = "groups:array<struct<id:string,title:string>>"
DENOMS = "denoms:array<struct<counts:array<struct<groupId:string,value:string>>>>"
STUDY_DDL = (
    "protocolSection struct<identificationModule:struct<nctId:string,briefTitle:string>,statusModule:struct<overallStatus:string>,"
    "designModule:struct<studyType:string,enrollmentInfo:struct<count:string,type:string>,designInfo:struct<allocation:string,interventionModel:string>>,"
    "ipdSharingStatementModule:struct<ipdSharing:string>>, "
    f"resultsSection struct<participantFlowModule:struct<{GROUPS},periods:array<struct<milestones:array<struct<type:string,achievements:array<struct<groupId:string,numSubjects:string>>>>>>>,"
    f"baselineCharacteristicsModule:struct<{GROUPS},{DENOMS},measures:array<struct<title:string,description:string,paramType:string,dispersionType:string,"
    f"classes:array<struct<title:string,description:string,{DENOMS},categories:array<struct<title:string,measurements:array<struct<groupId:string,value:string,spread:string>>>>>>>>>,"
    f"outcomeMeasuresModule:struct<outcomeMeasures:array<struct<type:string,title:string,populationDescription:string,{GROUPS},{DENOMS},"
    "analyses:array<struct<pValue:string,paramType:string,paramValue:string,ciLowerLimit:string,ciUpperLimit:string,ciPctValue:string,statisticalMethod:string>>>>>,"
    "adverseEventsModule:string>, hasResults boolean"
)

# Names of group totals, and wordings that tell of overlap or of a subset.
TOTALS = ("total", "overall", "all participants", "all groups")
OVERLAP_WORDS = ("select all", "check all", "multiple response", "multiple selection", "more than one", "not mutually exclusive")
SUBSET_WORDS = ("among those", "subset", "if yes", "optional")
UNAVAILABLE = (
    "ENROLLMENT-ARM-SUM", "GRIM", "GRIMMER", "SUBGROUP-PERCENT", "SUBGROUP-INTERACTION-TEST", "SUBGROUP-INTERACTION-POWER",
    "SUBGROUP-EVENT-FLOOR", "SUBGROUP-EXPECTED-CELL",
)
CAP = 250


def some(xs: Column, kind: str) -> Column:
    return F.coalesce(xs, F.array().cast(f"array<{kind}>"))


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x worked out once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def group_ids(groups: Column) -> Column:
    """Ids of the groups that are no totals; all ids if that leaves none."""
    plain = F.filter(groups, lambda g: ~F.lower(F.trim(F.coalesce(g["title"], g["id"]))).isin(*TOTALS))
    return F.transform(F.when(F.size(plain) > 0, plain).otherwise(groups), lambda g: g["id"])


def title_of(groups: Column, gid: Column) -> Column:
    return F.coalesce(F.get(F.transform(F.slice(F.reverse(F.filter(groups, lambda g: g["id"] == gid)), 1, 1), lambda g: g["title"]), F.lit(0)), gid)


def denominators(denoms: Column) -> Column:
    """array<struct<g, n>> of the first denominator that has counts."""
    parsed = F.transform(denoms, lambda d: F.filter(F.transform(d["counts"], lambda c: F.struct(c["groupId"].alias("g"), P.integer(c["value"]).alias("n"))), lambda c: c["n"].isNotNull()))
    return F.coalesce(F.get(F.filter(parsed, lambda d: F.size(d) > 0), F.lit(0)), F.array().cast("array<struct<g:string,n:bigint>>"))


def count_of(counts: Column, gid: Column) -> Column:
    return F.get(F.transform(F.reverse(F.filter(counts, lambda c: c["g"] == gid)), lambda c: c["n"]), F.lit(0))


def total_of(counts: Column, gids: Column) -> Column:
    return F.aggregate(F.transform(gids, lambda g: F.coalesce(count_of(counts, g), F.lit(0))), F.lit(0).cast("bigint"), lambda a, x: a + x)


def _any(s: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | s.contains(w)
    return out


def _text(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def _joined(*parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), " / ")


def qualification_errors(study: str = "") -> Column:
    """Why a study doesn't qualify; an empty array if it does."""
    c = lambda p: F.col(study + p)
    differs = lambda x, v: ~x.eqNullSafe(F.lit(v))
    return F.array_compact(F.array(
        F.when(differs(c("protocolSection.statusModule.overallStatus"), "COMPLETED"), "not_completed"),
        F.when(differs(c("protocolSection.designModule.studyType"), "INTERVENTIONAL"), "not_interventional"),
        F.when(differs(c("protocolSection.designModule.designInfo.allocation"), "RANDOMIZED"), "not_randomized"),
        F.when(differs(c("hasResults"), True) | c("resultsSection").isNull(), "no_posted_results"),
    ))


def arms() -> Column:
    """map of arm title to size: the first period's first STARTED milestone, else its first one."""
    flow = F.col("resultsSection.participantFlowModule")
    stones = some(F.get(flow["periods"], F.lit(0))["milestones"], "struct<type:string,achievements:array<struct<groupId:string,numSubjects:string>>>")
    chosen = F.coalesce(F.get(F.filter(stones, lambda m: F.upper(m["type"]) == "STARTED"), F.lit(0)), F.get(stones, F.lit(0)))
    groups = some(flow["groups"], "struct<id:string,title:string>")
    rows = F.transform(some(chosen["achievements"], "struct<groupId:string,numSubjects:string>"), lambda a: F.struct(title_of(groups, a["groupId"]).alias("key"), P.integer(a["numSubjects"]).alias("value")))
    rows = F.filter(rows, lambda a: a["value"].isNotNull())
    names = F.array_distinct(F.transform(rows, lambda a: a["key"]))
    last = lambda k: F.element_at(F.filter(rows, lambda a: a["key"] == k), -1)["value"]
    return F.map_from_arrays(names, F.transform(names, last))


def _measures() -> Column:
    m = "struct<title:string,description:string,paramType:string,dispersionType:string,classes:array<struct<title:string,description:string," + DENOMS + ",categories:array<struct<title:string,measurements:array<struct<groupId:string,value:string,spread:string>>>>>>>"
    return some(F.col("resultsSection.baselineCharacteristicsModule.measures"), m)


def _base() -> tuple[Column, Column, Column]:
    b = F.col("resultsSection.baselineCharacteristicsModule")
    groups = some(b["groups"], "struct<id:string,title:string>")
    return groups, group_ids(groups), denominators(b["denoms"])


def count_partitions() -> Column:
    """Subgroups of counted participants, class by class."""
    groups, gids, module = _base()

    def level(cat: Column, k: Column) -> Column:
        rows = F.filter(F.transform(some(cat["measurements"], "struct<groupId:string,value:string,spread:string>"), lambda r: F.struct(r["groupId"].alias("g"), P.integer(r["value"]).alias("n"))), lambda r: r["n"].isNotNull() & F.array_contains(gids, r["g"]))
        n = F.aggregate(F.transform(rows, lambda r: r["n"]), F.lit(0).cast("bigint"), lambda a, x: a + x)
        names = F.array_distinct(F.transform(rows, lambda r: title_of(groups, r["g"])))
        arm = F.map_from_arrays(names, F.transform(names, lambda t: F.element_at(F.filter(rows, lambda r: title_of(groups, r["g"]) == t), -1)["n"]))
        label = F.when(F.trim(_text(cat["title"])) != "", F.trim(cat["title"])).otherwise(F.concat(F.lit("category-"), k.cast("string")))
        return F.struct(label.alias("name"), n.alias("n"), arm.alias("arm_ns"), F.size(rows).alias("k"))

    def one(m: Column, c: Column, at: Column) -> Column:
        prefix = F.concat((at + 1).cast("string"), F.lit("-"))
        levels = F.filter(F.transform(c["categories"], lambda cat, k: level(cat, F.concat(prefix, (k + 1).cast("string")))), lambda v: v["k"] > 0)
        own = denominators(c["denoms"])
        people = total_of(F.when(F.size(own) > 0, own).otherwise(module), gids)
        wording = F.lower(F.concat_ws(" ", m["title"], m["description"], c["title"], c["description"]))

        def made(ls: Column) -> Column:
            seen = F.aggregate(F.transform(ls, lambda v: v["n"]), F.lit(0).cast("bigint"), lambda a, x: a + x)
            exclusive = ~(_any(wording, OVERLAP_WORDS) | ((people > 0) & (seen > people)))
            none = lambda t: F.lit(None).cast(t)
            lv = F.transform(ls, lambda v: F.struct(v["name"].alias("name"), v["n"].alias("n"), v["arm_ns"].alias("arm_ns"), none("double").alias("percentage"), F.lit(1).alias("percentage_decimals"), none("bigint").alias("percentage_denominator"), none("bigint").alias("events")))
            return F.struct(
                _joined(F.coalesce(m["title"], F.lit("unnamed baseline measure")), F.trim(_text(c["title"]))).alias("variable"), people.alias("population_n"), exclusive.alias("mutually_exclusive"),
                (exclusive & ~_any(wording, SUBSET_WORDS)).alias("exhaustive"), none("boolean").alias("prespecified"), F.lit(False).alias("effect_claimed"), none("boolean").alias("formal_interaction_test"),
                none("double").alias("interaction_p"), none("boolean").alias("powered_for_interaction"), none("bigint").alias("main_effect_required_n"), F.lit(1).cast("bigint").alias("estimated_parameters"),
                F.array().cast("array<double>").alias("contingency_cells"), lv.alias("levels"),
            ).cast(SUBGROUP)

        return bound(levels, made)

    counted = F.filter(_measures(), lambda m: m["paramType"] == "COUNT_OF_PARTICIPANTS")
    each = F.transform(counted, lambda m: F.filter(F.transform(m["classes"], lambda c, at: F.when(F.size(c["categories"]) >= 2, one(m, c, at))), lambda s: s.isNotNull()))
    return F.filter(F.flatten(F.filter(each, lambda x: x.isNotNull())), lambda s: (F.size(s["levels"]) >= 2) & (s["population_n"] > 0))


MEAN_ROW = "struct<label:string,rows:array<struct<g:string,title:string,mean:double,sd:double,n:bigint,dm:int,ds:int>>>"


def mean_rows() -> Column:
    """Per measure, class and category of means with SDs: its usable groups."""
    groups, gids, module = _base()

    def of(m: Column, c: Column, cat: Column, label: Column) -> Column:
        own = denominators(c["denoms"])
        n = lambda g: count_of(F.when(F.size(own) > 0, own).otherwise(module), g)
        rows = F.transform(some(cat["measurements"], "struct<groupId:string,value:string,spread:string>"), lambda r: F.struct(
            r["groupId"].alias("g"), title_of(groups, r["groupId"]).alias("title"), P.number(r["value"]).alias("mean"), P.number(r["spread"]).alias("sd"),
            n(r["groupId"]).alias("n"), P.decimals(r["value"]).alias("dm"), P.decimals(r["spread"]).alias("ds")))
        good = F.filter(rows, lambda r: F.array_contains(gids, r["g"]) & r["mean"].isNotNull() & r["sd"].isNotNull() & (r["n"] > 0))
        return F.struct(F.concat(F.coalesce(m["title"], F.lit("unnamed baseline measure")), F.lit(": "), label).alias("label"), good.alias("rows"))

    def labelled(c: Column, at: Column, cat: Column, k: Column) -> Column:
        s = _joined(F.trim(_text(c["title"])), F.trim(_text(cat["title"])))
        return F.when(s != "", s).otherwise(F.concat(F.lit("category-"), (at + 1).cast("string"), F.lit("-"), (k + 1).cast("string")))

    means = F.filter(_measures(), lambda m: (m["paramType"] == "MEAN") & (m["dispersionType"] == "STANDARD_DEVIATION"))
    each = F.transform(means, lambda m: F.flatten(F.transform(m["classes"], lambda c, at: F.transform(c["categories"], lambda cat, k: of(m, c, cat, labelled(c, at, cat, k))))))
    return F.flatten(F.filter(each, lambda x: x.isNotNull())).cast(f"array<{MEAN_ROW}>")


def summaries(rows: Column) -> Column:
    make = lambda x, r: F.struct(F.concat(x["label"], F.lit(": "), r["title"]).alias("name"), r["mean"].alias("mean"), r["n"].alias("n"), r["dm"].alias("mean_decimals"), F.lit(1).cast("bigint").alias("items"), r["sd"].alias("sd"), r["ds"].alias("sd_decimals"), F.lit(False).alias("integer_scale"))
    return F.flatten(F.transform(rows, lambda x: F.transform(x["rows"], lambda r: make(x, r)))).cast(f"array<{SUMMARY}>")


def comparisons(rows: Column) -> Column:
    """All pairs of groups of a category, by group id as text."""

    def pair(x: Column, a: Column, b: Column) -> Column:
        return F.struct(
            F.concat(x["label"], F.lit(": "), a["title"], F.lit(" vs "), b["title"]).alias("name"), a["mean"].alias("mean_a"), a["sd"].alias("sd_a"), a["n"].alias("n_a"),
            b["mean"].alias("mean_b"), b["sd"].alias("sd_b"), b["n"].alias("n_b"), a["dm"].alias("mean_decimals_a"), a["ds"].alias("sd_decimals_a"), b["dm"].alias("mean_decimals_b"),
            b["ds"].alias("sd_decimals_b"), F.lit("continuous").alias("variable_type"), F.lit(False).alias("independent_from_other_variables"), F.array().cast("array<string>").alias("correlated_with"),
        )

    usable = lambda x: F.array_sort(F.filter(x["rows"], lambda r: (r["sd"] > 0) & (r["n"] > 1)))
    of = lambda x: bound(usable(x), lambda g: F.flatten(F.transform(g, lambda a, i: F.transform(F.slice(g, i + 2, F.size(g)), lambda b: pair(x, a, b)))))
    return F.flatten(F.transform(rows, of)).cast(f"array<{BASELINE}>")


def effects() -> Column:
    """Reported effects that allow a CI to p check."""

    def of(o: Column, a: Column) -> Column:
        groups = some(o["groups"], "struct<id:string,title:string>")
        gids = group_ids(groups)
        people = total_of(denominators(o["denoms"]), gids)
        method = _text(a["statisticalMethod"])
        est, lo, hi, level = (P.number(a[k]) for k in ("paramValue", "ciLowerLimit", "ciUpperLimit", "ciPctValue"))
        scale, tail = P.effect_scale(a["paramType"]), P.one_sided(method)
        p = P.p_value(a["pValue"])
        real = lambda x: x.isNotNull() & ~F.isnan(x)
        ok = p.isNotNull() & real(est) & real(lo) & real(hi) & (lo < hi) & (level > 0) & (level < 100) & ((scale == "additive") | (F.least(est, lo, hi) > 0))
        made = F.struct(
            F.concat(F.coalesce(o["title"], F.lit("unnamed outcome")), F.lit(": "), F.when(_text(a["paramType"]) != "", a["paramType"]).otherwise("effect")).alias("name"), est.alias("estimate"), lo.alias("ci_lower"), hi.alias("ci_upper"),
            level.alias("confidence_level"), p["p"].alias("reported_p"), p["operator"].alias("p_operator"), P.decimals(a["paramValue"]).alias("estimate_decimals"), P.decimals(a["ciLowerLimit"]).alias("ci_lower_decimals"),
            P.decimals(a["ciUpperLimit"]).alias("ci_upper_decimals"), p["decimals"].alias("p_decimals"), scale.alias("scale"), tail.alias("one_tailed"), P.method_family(method).alias("statistical_method_family"),
            P.ci_tier(method, tail).alias("applicability_tier"), F.when(people > 0, people).alias("analysis_population_n"), F.when(tail, "one_sided").otherwise("two_sided").alias("ci_sidedness"),
            F.nullif(a["paramType"], F.lit("")).alias("parameter_type"), F.when(_any(F.lower(method), P.ADJUSTED_WORDS), method).alias("adjustment_comment"), F.transform(gids, lambda g: title_of(groups, g)).alias("selected_groups"),
            F.concat(F.lit("ClinicalTrials.gov analysis; "), F.when(method != "", method).otherwise("method unspecified")).alias("source"),
        )
        return F.when(F.coalesce(ok, F.lit(False)), made)

    outcomes = F.col("resultsSection.outcomeMeasuresModule.outcomeMeasures")
    each = F.transform(outcomes, lambda o: F.filter(F.transform(o["analyses"], lambda a: of(o, a)), lambda e: e.isNotNull()))
    return some(F.flatten(F.filter(each, lambda x: x.isNotNull())), EFFECT).cast(f"array<{EFFECT}>")


def read_studies(spark: SparkSession, path: str) -> DataFrame:
    """Staged registry pages: one study a line."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.col("value").alias("raw"), F.from_json("value", STUDY_DDL).alias("s")).select("raw", "s.*")


def normalize(studies: DataFrame) -> DataFrame:
    """Records of the studies with a positive enrollment; metadata is JSON text."""
    n = P.integer(F.col("protocolSection.designModule.enrollmentInfo.count"))
    outcomes = F.col("resultsSection.outcomeMeasuresModule.outcomeMeasures")
    analyses = some(F.flatten(F.filter(F.transform(outcomes, lambda o: o["analyses"]), lambda x: x.isNotNull())), "struct<pValue:string,paramType:string,paramValue:string,ciLowerLimit:string,ciUpperLimit:string,ciPctValue:string,statisticalMethod:string>")
    d = studies.withColumns({"__n": n, "__rows": some(mean_rows(), MEAN_ROW), "__effects": effects(), "__subgroups": count_partitions(), "__analyses": analyses}).where("__n > 0")
    d = d.withColumn("__pairs", comparisons(F.col("__rows")))
    described = F.size(F.filter(outcomes, lambda o: F.trim(_text(o["populationDescription"])) != ""))
    kept = F.slice("__effects", 1, CAP)
    tier = lambda t: F.size(F.filter(kept, lambda e: e["applicability_tier"] == t))
    sizes = F.transform(outcomes, lambda o: total_of(denominators(o["denoms"]), group_ids(some(o["groups"], "struct<id:string,title:string>"))))
    flags = {
        "analysis_population": F.when(F.size(outcomes) > 0, described > 0), "primary_outcome": F.coalesce(F.exists(outcomes, lambda o: _text(o["type"]) == "PRIMARY"), F.lit(False)),
        "effect_estimate": F.size("__analyses") > 0, "precision": F.exists("__analyses", lambda a: a["ciLowerLimit"].isNotNull() & a["ciUpperLimit"].isNotNull()),
        "harms": ~F.coalesce(F.col("resultsSection.adverseEventsModule"), F.lit("{}")).isin("{}", "null", ""), "protocol_registration": F.lit(True),
        "data_sharing": F.col("protocolSection.ipdSharingStatementModule.ipdSharing").isNotNull(), "conflicts_of_interest": F.lit(None).cast("boolean"), "patient_public_involvement": F.lit(None).cast("boolean"),
    }
    p = "protocolSection."
    meta = F.to_json(F.struct(
        F.lit("v2").alias("retrieved_api_version"), F.col(p + "statusModule.overallStatus").alias("overall_status"), F.col(p + "designModule.studyType").alias("study_type"),
        F.col(p + "designModule.enrollmentInfo.type").alias("enrollment_type"), F.col(p + "designModule.designInfo.allocation").alias("allocation"), F.col(p + "designModule.designInfo.interventionModel").alias("intervention_model"),
        F.coalesce("hasResults", F.lit(False)).alias("has_results"), F.lit("participant_flow_first_period_started").alias("arm_count_basis"), F.array(*[F.lit(r) for r in UNAVAILABLE]).alias("source_schema_unavailable_rules"),
        F.size("__analyses").alias("reported_analyses_count"), F.slice("__analyses", 1, 25).alias("reported_analyses_preview"), F.size("__effects").alias("ci_p_eligible_analyses_before_cap"),
        F.size(kept).alias("ci_p_eligible_analyses_processed"), F.greatest(F.size("__effects") - CAP, F.lit(0)).alias("ci_p_analyses_truncated"), tier("high_confidence").alias("ci_p_high_confidence_analyses_processed"),
        tier("approximate_review").alias("ci_p_approximate_review_analyses_processed"), F.array_sort(F.array_distinct(F.filter(sizes, lambda x: x > 0))).alias("analysis_population_ns"), F.greatest(described, F.lit(0)).alias("outcomes_with_population_description"),
        F.size("__subgroups").alias("count_partitions"), F.size(F.filter("__subgroups", lambda s: ~s["mutually_exclusive"])).alias("overlapping_count_sets"), F.least(F.size("__pairs"), F.lit(CAP)).alias("baseline_comparisons"),
        F.greatest(F.size("__pairs") - CAP, F.lit(0)).alias("baseline_comparisons_truncated"),
    ))
    return d.select(
        F.col(p + "identificationModule.nctId").alias("study_id"), F.lit("ClinicalTrials.gov API v2").alias("source"), F.col(p + "identificationModule.briefTitle").alias("title"), F.col("__n").alias("randomized_n"),
        F.lit(None).cast("bigint").alias("analyzed_n"), arms().alias("arm_ns"), F.lit(False).alias("arm_counts_comparable_to_randomized_n"), F.col("__subgroups").alias("subgroups"), F.array().cast("array<string>").alias("__none"),
        kept.alias("reported_effects"), summaries(F.col("__rows")).alias("integer_summaries"), F.slice("__pairs", 1, CAP).alias("baseline_comparisons"),
        F.map_from_arrays(F.array(*[F.lit(k) for k in flags]), F.array(*flags.values())).alias("reporting"), meta.alias("metadata"),
    ).drop("__none")


def assertions(study: str = "") -> Column:
    """What must hold of a study that is written: completed, interventional, randomized, with results. Names of what doesn't."""
    c = lambda p: F.col(study + p)
    wanted = {
        "COMPLETED": c("protocolSection.statusModule.overallStatus") == "COMPLETED", "INTERVENTIONAL": c("protocolSection.designModule.studyType") == "INTERVENTIONAL",
        "RANDOMIZED": c("protocolSection.designModule.designInfo.allocation") == "RANDOMIZED", "hasResults=true": c("hasResults"),
    }
    return F.array_compact(F.array(*[F.when(~F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in wanted.items()]))


def backfill(records: DataFrame) -> DataFrame:
    """Records of an earlier form with the newer fields of their effects, and the counts of effects in their metadata, filled in."""
    meta = lambda k: F.get_json_object("metadata", f"$.{k}")
    people = F.from_json(meta("analysis_population_ns"), "array<bigint>")
    alone = F.when(F.size(people) == 1, F.get(people, F.lit(0)))

    def full(e: Column) -> Column:
        method, tail = P.method_of_source(e["source"]), F.coalesce(e["one_tailed"], F.lit(False))
        last = F.element_at(F.split(F.coalesce(e["name"], F.lit("")), ": "), -1)
        new = {
            "statistical_method_family": P.method_family(method), "applicability_tier": P.ci_tier(method, tail), "analysis_population_n": alone,
            "ci_sidedness": F.when(tail, "one_sided").otherwise("two_sided"), "parameter_type": F.nullif(last, F.lit("")),
            "adjustment_comment": F.when(_any(F.lower(method), P.ADJUSTED_WORDS), method), "selected_groups": F.array().cast("array<string>"),
        }
        names = [x.split(":")[0] for x in EFFECT.removeprefix("struct<").removesuffix(">").replace("array<string>", "a").split(",")]
        return F.struct(*[(F.coalesce(e[n], new[n]) if n in new else e[n]).alias(n) for n in names]).cast(EFFECT)

    d = records.withColumn("reported_effects", F.transform("reported_effects", full))
    n = F.size("reported_effects")
    tier = lambda t: F.size(F.filter("reported_effects", lambda e: e["applicability_tier"] == t))
    whole = lambda k, other: F.coalesce(meta(k).try_cast("bigint"), other)
    counts = {
        "ci_p_eligible_analyses_before_cap": whole("ci_p_eligible_analyses_before_cap", whole("ci_p_eligible_analyses", n)), "ci_p_eligible_analyses_processed": n,
        "ci_p_analyses_truncated": whole("ci_p_analyses_truncated", F.lit(0)), "ci_p_high_confidence_analyses_processed": tier("high_confidence"), "ci_p_approximate_review_analyses_processed": tier("approximate_review"),
    }
    # metadata is an open object: its members stay as they are, the counts take the place of older ones
    kept = F.map_filter(F.from_json(F.coalesce("metadata", F.lit("{}")), "map<string,variant>"), lambda k, _: ~k.isin(*counts))
    new = F.map_from_arrays(F.array(*[F.lit(k) for k in counts]), F.array(*[v.cast("bigint").cast("variant") for v in counts.values()]))
    return d.withColumn("metadata", F.to_json(F.map_concat(kept, new)))


def exclusions(studies: DataFrame) -> DataFrame:
    """(reason, studies): a study counts for each of its reasons; those that qualify but have no enrollment as invalid_enrollment,

    and those whose record breaks the schema as schema_validation_error.
    """
    n = P.integer(F.col("protocolSection.designModule.enrollmentInfo.count"))
    why = qualification_errors()
    why = F.when(F.size(why) == 0, F.when(F.coalesce(n > 0, F.lit(False)), F.array().cast("array<string>")).otherwise(F.array(F.lit("invalid_enrollment")))).otherwise(why)
    counted = studies.select(F.explode(why).alias("reason"))
    fine = studies.where((F.size(qualification_errors()) == 0) & F.coalesce(n > 0, F.lit(False)))
    broken = with_defaults(normalize(fine)).where(F.size(violations()) > 0).select(F.lit("schema_validation_error").alias("reason"))
    return counted.unionByName(broken).groupBy("reason").agg(F.count("*").alias("studies"))
