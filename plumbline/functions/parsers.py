"""Parsers of registry strings, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def integer(x: Column) -> Column:
    """Commas out, then a whole number or null."""
    s = F.trim(F.replace(x, F.lit(","), F.lit("")))
    return F.when(s.rlike(r"^[+-]?[0-9]+$"), s.try_cast("bigint"))


def number(x: Column) -> Column:
    """Commas out, then a double or null; nan, inf and exponents count."""
    return F.replace(x, F.lit(","), F.lit("")).try_cast("double")


def decimals(x: Column) -> Column:
    """How many decimals are printed, 0 to 10; an exponent counts, commas make it 0."""
    s = F.trim(x)
    ok = s.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    digits = F.length(F.regexp_extract(s, r"\.([0-9]*)", 1))
    shift = F.coalesce(F.regexp_extract(s, r"[eE]([+-]?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    return F.when(ok, F.greatest(F.lit(0), F.least(F.lit(10), digits - shift))).otherwise(0)


def p_value(x: Column) -> Column:
    """struct(p, operator, decimals) of texts like '<0.001'; null outside [0, 1]."""
    s = F.replace(F.trim(x), F.lit(" "), F.lit(""))
    op = F.regexp_extract(s, r"^(<=|>=|<|>|=)", 1)
    rest = F.substring(s, F.length(op) + 1, F.length(s))
    v = rest.try_cast("double")
    found = F.struct(v.alias("p"), F.when(op == "", "=").otherwise(op).alias("operator"), decimals(rest).alias("decimals"))
    return F.when((v >= 0) & (v <= 1) & ~F.isnan(v), found)


# The words that mark a ratio, a family of methods, and so on, in the order of testing.
RATIO_WORDS = ("ratio", "relative risk", "cox proportional hazard")
FAMILIES = (
    ("survival_model", ("cox", "log-rank", "hazard")),
    ("regression_model", ("logistic", "poisson", "regression", "ancova", "glm", "mixed")),
    ("nonparametric", ("wilcoxon", "mann-whitney", "rank-sum", "rank sum", "nonparam")),
    ("exact_test", ("exact", "fisher")),
    ("mean_comparison", ("t test", "ttest", "anova", "mean difference")),
    ("z_test", ("z test",)),
)
APPROXIMATE = ("survival_model", "regression_model", "nonparametric", "exact_test", "other")
ADJUSTED_WORDS = ("adjust", "correct", "strat", "covariate")


def _any(s: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | s.contains(w)
    return out


def effect_scale(parameter: Column) -> Column:
    return F.when(_any(F.lower(F.coalesce(parameter, F.lit(""))), RATIO_WORDS), "ratio").otherwise("additive")


def method_family(method: Column) -> Column:
    s = F.lower(F.coalesce(method, F.lit("")))
    out = F.when(s == "", F.lit("unspecified"))
    for name, marks in FAMILIES:
        out = out.when(_any(s, marks), F.lit(name))
    return out.otherwise(F.lit("other"))


def ci_tier(method: Column, one_tailed: Column) -> Column:
    s = F.lower(F.coalesce(method, F.lit("")))
    rough = F.coalesce(one_tailed, F.lit(False)) | _any(s, ADJUSTED_WORDS) | method_family(method).isin(*APPROXIMATE)
    return F.when(rough, "approximate_review").otherwise("high_confidence")


def method_of_source(source: Column) -> Column:
    """What follows the registry's prefix, else all of it."""
    prefix = "ClinicalTrials.gov analysis;"
    s = F.coalesce(source, F.lit(""))
    return F.when(s.contains(prefix), F.trim(F.substring(s, F.instr(s, prefix) + len(prefix), F.length(s)))).otherwise(s)


def one_sided(x: Column) -> Column:
    return F.coalesce(x, F.lit("")).rlike(r"(?i)(1|one)[- ]sided")


def doi(x: Column) -> Column:
    """Trimmed, lower case, without resolver and scheme; null gives ''."""
    s = F.lower(F.trim(F.coalesce(x, F.lit(""))))
    return F.regexp_replace(F.regexp_replace(s, r"^https://doi\.org/", ""), "^doi:", "")
