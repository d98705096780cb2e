"""Study records: their schema, strict reading, and what makes a record valid."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.config import REPORTING

LEVEL = "struct<name:string,n:bigint,arm_ns:map<string,bigint>,percentage:double,percentage_decimals:int,percentage_denominator:bigint,events:bigint>"
SUBGROUP = (
    "struct<variable:string,population_n:bigint,mutually_exclusive:boolean,exhaustive:boolean,prespecified:boolean,effect_claimed:boolean,"
    "formal_interaction_test:boolean,interaction_p:double,powered_for_interaction:boolean,main_effect_required_n:bigint,"
    f"estimated_parameters:bigint,contingency_cells:array<double>,levels:array<{LEVEL}>>"
)
STAT = "struct<stat_type:string,value:double,df1:double,df2:double,reported_p:double,p_operator:string,statistic_decimals:int,p_decimals:int,adjusted:boolean,one_tailed:boolean,source:string>"
EFFECT = (
    "struct<name:string,estimate:double,ci_lower:double,ci_upper:double,confidence_level:double,reported_p:double,p_operator:string,"
    "estimate_decimals:int,ci_lower_decimals:int,ci_upper_decimals:int,p_decimals:int,scale:string,one_tailed:boolean,"
    "statistical_method_family:string,applicability_tier:string,analysis_population_n:bigint,ci_sidedness:string,parameter_type:string,"
    "adjustment_comment:string,selected_groups:array<string>,source:string>"
)
SUMMARY = "struct<name:string,mean:double,n:bigint,mean_decimals:int,items:bigint,sd:double,sd_decimals:int,integer_scale:boolean>"
BASELINE = (
    "struct<name:string,mean_a:double,sd_a:double,n_a:bigint,mean_b:double,sd_b:double,n_b:bigint,mean_decimals_a:int,sd_decimals_a:int,"
    "mean_decimals_b:int,sd_decimals_b:int,variable_type:string,independent_from_other_variables:boolean,correlated_with:array<string>>"
)
RECORD_DDL = (
    "study_id string, source string, title string, randomized_n bigint, analyzed_n bigint, arm_ns map<string,bigint>, "
    f"arm_counts_comparable_to_randomized_n boolean, subgroups array<{SUBGROUP}>, reported_stats array<{STAT}>, "
    f"reported_effects array<{EFFECT}>, integer_summaries array<{SUMMARY}>, baseline_comparisons array<{BASELINE}>, "
    "reporting map<string,boolean>, metadata string"
)

@functools.cache
def record_type() -> T.StructType:
    return T.StructType.fromDDL(RECORD_DDL)


# What a field that is left out counts as.
DEFAULTS = {
    "subgroups": {"mutually_exclusive": True, "exhaustive": True, "effect_claimed": False, "estimated_parameters": 1},
    "levels": {"percentage_decimals": 1},
    "reported_stats": {"p_operator": "=", "statistic_decimals": 2, "p_decimals": 3, "adjusted": False, "one_tailed": False},
    "reported_effects": {
        "confidence_level": 95.0, "p_operator": "=", "estimate_decimals": 10, "ci_lower_decimals": 10, "ci_upper_decimals": 10, "p_decimals": 3,
        "scale": "additive", "one_tailed": False, "ci_sidedness": "unspecified",
    },
    "integer_summaries": {"mean_decimals": 2, "items": 1, "sd_decimals": 2, "integer_scale": True},
    "baseline_comparisons": {
        "mean_decimals_a": 10, "sd_decimals_a": 10, "mean_decimals_b": 10, "sd_decimals_b": 10, "variable_type": "continuous",
        "independent_from_other_variables": False,
    },
}


def _each(xs: Column, f: T.StructField) -> Column:
    """An array of structs (or of anything else) with defaults in each."""
    if not isinstance(f.dataType.elementType, T.StructType):
        return xs
    return F.transform(xs, lambda y: _filled(y, f.dataType.elementType, f.name))


def _filled(x: Column, kind: T.StructType, name: str) -> Column:
    """A struct with its defaults in, level by level."""
    out = []
    for f in kind.fields:
        v = x[f.name]
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            v = _each(v, f)
        elif f.name in DEFAULTS.get(name, {}):
            v = F.coalesce(v, F.lit(DEFAULTS[name][f.name]).cast(f.dataType))
        out.append(v.alias(f.name))
    return F.struct(*out)


def with_defaults(df: DataFrame) -> DataFrame:
    """df with every record column: missing ones null, defaults filled in, arrays and maps never null."""
    cols = []
    for f in record_type().fields:
        v = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        if isinstance(f.dataType, T.ArrayType) and f.name not in df.columns:
            v = F.array().cast(f.dataType)  # a constant, by which rules without input are constants too
        elif isinstance(f.dataType, T.ArrayType):
            v = F.coalesce(_each(v, f), F.array().cast(f.dataType))
        elif isinstance(f.dataType, T.MapType):
            v = F.coalesce(v, F.create_map().cast(f.dataType))
        elif f.name == "arm_counts_comparable_to_randomized_n":
            v = F.coalesce(v, F.lit(True))
        cols.append(v.alias(f.name))
    return df.select(*[c for c in df.columns if c not in record_type().names], *cols)


def violations() -> Column:
    """array<string> of what is wrong with a record (with its defaults in)."""
    c = F.col
    positive = lambda x: F.coalesce(x <= 0, F.lit(False))
    negative = lambda x: F.coalesce(x < 0, F.lit(False))
    share = lambda x, most: F.coalesce((x < 0) | (x > most), F.lit(False))
    places = lambda x, most=10: F.coalesce((x < 0) | (x > most), F.lit(False))
    odd = lambda x, *known: F.coalesce(~x.isin(*known), F.lit(True))
    ops = ("=", "<", ">", "<=", ">=")
    df1, df2 = lambda s: F.coalesce(s["df1"] <= 0, F.lit(True)), lambda s: F.coalesce(s["df2"] <= 0, F.lit(True))
    tests = {
        "randomized_n": c("randomized_n").isNull() | positive(c("randomized_n")),
        "analyzed_n": positive(c("analyzed_n")),
        "arm_ns": F.exists(F.map_values("arm_ns"), lambda n: F.coalesce(n < 0, F.lit(True))),
        "reporting": F.size(F.array_except(F.map_keys("reporting"), F.array(*[F.lit(k) for k in REPORTING]))) > 0,
        "subgroups": F.exists("subgroups", lambda s: s["variable"].isNull() | positive(s["population_n"]) | share(s["interaction_p"], 1) | positive(s["main_effect_required_n"]) | positive(s["estimated_parameters"])),
        "levels": F.exists(F.flatten(F.transform("subgroups", lambda s: F.coalesce(s["levels"], F.array().cast(f"array<{LEVEL}>")))), lambda v: v["name"].isNull() | v["n"].isNull() | negative(v["n"]) | share(v["percentage"], 100) | places(v["percentage_decimals"], 6) | positive(v["percentage_denominator"]) | negative(v["events"]) | F.coalesce(F.exists(F.map_values(v["arm_ns"]), lambda n: n < 0), F.lit(False))),
        "reported_stats": F.exists("reported_stats", lambda s: odd(s["stat_type"], "t", "F", "chi2", "r", "z", "Q") | s["value"].isNull() | share(s["reported_p"], 1) | odd(s["p_operator"], *ops) | places(s["statistic_decimals"]) | places(s["p_decimals"]) | (s["stat_type"].isin("t", "chi2", "r", "Q", "F") & df1(s)) | ((s["stat_type"] == "F") & df2(s)) | ((s["stat_type"] == "r") & (F.abs(s["value"]) >= 1))),
        "reported_effects": F.exists("reported_effects", lambda e: e["name"].isNull() | F.coalesce(~(e["ci_lower"] < e["ci_upper"]), F.lit(True)) | e["estimate"].isNull() | F.coalesce((e["confidence_level"] <= 0) | (e["confidence_level"] >= 100), F.lit(True)) | e["reported_p"].isNull() | share(e["reported_p"], 1) | odd(e["p_operator"], *ops) | odd(e["scale"], "additive", "ratio") | ((e["scale"] == "ratio") & (F.least(e["estimate"], e["ci_lower"], e["ci_upper"]) <= 0)) | places(e["estimate_decimals"]) | places(e["ci_lower_decimals"]) | places(e["ci_upper_decimals"]) | places(e["p_decimals"]) | odd(e["ci_sidedness"], "two_sided", "one_sided", "unspecified") | positive(e["analysis_population_n"])),
        "integer_summaries": F.exists("integer_summaries", lambda s: s["name"].isNull() | s["mean"].isNull() | s["n"].isNull() | positive(s["n"]) | places(s["mean_decimals"]) | positive(s["items"]) | negative(s["sd"]) | places(s["sd_decimals"])),
        "baseline_comparisons": F.exists("baseline_comparisons", lambda b: b["name"].isNull() | b["mean_a"].isNull() | b["mean_b"].isNull() | F.coalesce((b["sd_a"] <= 0) | (b["sd_b"] <= 0) | (b["n_a"] <= 1) | (b["n_b"] <= 1), F.lit(True)) | odd(b["variable_type"], "continuous", "binary", "categorical") | places(b["mean_decimals_a"]) | places(b["sd_decimals_a"]) | places(b["mean_decimals_b"]) | places(b["sd_decimals_b"])),
    }
    return F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]))


def _scalar(s: Column, t: T.DataType) -> Column:
    """A scalar's text as type t, or null; whole numbers may be written 20.0."""
    if isinstance(t, (T.LongType, T.IntegerType)):
        d = s.try_cast("decimal(38,10)")
        return F.when(d == F.floor(d), d.try_cast(t))
    return s if isinstance(t, T.StringType) else s.try_cast(t)


def _shape(t: T.DataType) -> str:
    """What a value of type t is taken out of a variant as: scalars as text, so that numbers may stand in quotes."""
    return "array<variant>" if isinstance(t, T.ArrayType) else "map<string,string>" if isinstance(t, T.MapType) else "string"


def _part(v: Column, f: T.StructField) -> Column:
    """A field of a variant object, or null where it is missing, JSON null or of another shape."""
    return F.try_variant_get(v, f"$.{f.name}", _shape(f.dataType))


def _given(v: Column, f: T.StructField) -> Column:
    """Whether an object has a field that is not JSON null."""
    x = F.try_variant_get(v, f"$.{f.name}", "variant")
    return x.isNotNull() & ~F.is_variant_null(x)


def _typed(v: Column, f: T.StructField) -> Column:
    """A field of a variant object as its type."""
    x, t = _part(v, f), f.dataType
    if isinstance(t, T.MapType):
        return F.transform_values(x, lambda _, y: _scalar(y, t.valueType))
    if not isinstance(t, T.ArrayType):
        return _scalar(x, t)
    if isinstance(t.elementType, T.StructType):
        return F.transform(x, lambda y: F.struct(*[_typed(y, g).alias(g.name) for g in t.elementType.fields]))
    return F.transform(x, lambda y: _scalar(F.try_variant_get(y, "$", "string"), t.elementType))


def _names_other_than(v: Column, names: list[str]) -> Column:
    """Whether a variant is no object or has other names."""
    keys = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
    return F.coalesce(F.size(F.array_except(keys, F.array(*[F.lit(n) for n in names]))) > 0, F.lit(True))


def _misread(v: Column, f: T.StructField) -> Column:
    """Whether a field has names that its type lacks or values that it can't hold, at any depth."""
    x, t = _part(v, f), f.dataType
    lost = lambda y, kind: F.lit(False) if isinstance(kind, T.StringType) else y.isNotNull() & _scalar(y, kind).isNull()
    if isinstance(t, T.MapType):
        inner = F.exists(F.map_values(x), lambda y: lost(y, t.valueType))
    elif isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StructType):
        fields = t.elementType.fields
        inner = F.exists(x, lambda y: F.coalesce(functools.reduce(lambda a, g: a | _misread(y, g), fields, _names_other_than(y, t.elementType.names)), F.lit(True)))
    elif isinstance(t, T.ArrayType):
        inner = F.exists(x, lambda y: F.coalesce(F.is_variant_null(y), F.lit(True)) | lost(F.try_variant_get(y, "$", "string"), t.elementType))
    else:
        return F.coalesce(lost(x, t), F.lit(False))
    return _given(v, f) & F.coalesce(x.isNull() | inner, F.lit(True))


#: Numbers that JSON lacks and lenient writers use; they are put in quotes before the line is parsed.
_ODD_NUMBER = r"([:,\[]\s*)(-?(?:NaN|Infinity))(?=\s*[,}\]])"


def parsed(lines: DataFrame, line: str = "value", more: tuple[str, ...] = ()) -> DataFrame:
    """Records of JSON lines, with record_key, the raw line, and errors.

    Numbers may be written as strings at any depth, as lax validation allows; names that the
    schema (and more) lacks are errors at any depth: ``unknown_field`` for the record's own, else the
    field that they lie in. A line is parsed once, to a variant, and all checks walk that; one in which an object
    repeats a name is ``not_json``. record_key is the line's SHA-256 and a number of its row, made without a shuffle.
    """
    # a stream has no row numbers: there lines that repeat share their key
    number = F.lit(0).cast("bigint") if lines.isStreaming else F.monotonically_increasing_id()
    text = lines.where(F.trim(F.col(line)) != "").select(F.col(line).alias("raw"), number.alias("__row"))
    fields = record_type().fields
    plain = F.when(F.col("raw").rlike(_ODD_NUMBER), F.regexp_replace("raw", _ODD_NUMBER, '$1"$2"')).otherwise(F.col("raw"))
    d = text.withColumn("v", F.try_parse_json(plain))
    v = F.col("v")
    d = d.withColumn("__keys", F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")))
    known = F.array(*[F.lit(n) for n in (*record_type().names, *more)])
    extra = F.coalesce(F.size(F.array_except("__keys", known)) > 0, F.lit(False))
    broken = F.col("__keys").isNull()
    bad = F.array_compact(F.array(*[F.when(_misread(v, f), F.lit(f.name)) for f in fields if not isinstance(f.dataType, T.StringType)]))
    # metadata is open: it stays as JSON text
    typed = [F.to_json(F.try_variant_get(v, "$.metadata", "variant")).alias(f.name) if f.name == "metadata" else _typed(v, f).alias(f.name) for f in fields]
    d = d.select("raw", "__row", broken.alias("__broken"), extra.alias("__extra"), bad.alias("__odd"), *typed)
    full = with_defaults(d).withColumn("__bad", violations())
    said = F.when(F.col("__broken"), F.col("__bad")).otherwise(F.array_distinct(F.concat("__bad", "__odd")))
    errors = F.concat(said, F.array_compact(F.array(F.when(F.col("__broken"), F.lit("not_json")), F.when(F.col("__extra"), F.lit("unknown_field")))))
    key = F.concat_ws("-", F.sha2("raw", 256), F.col("__row").cast("string"))
    return full.select(key.alias("record_key"), "raw", *record_type().names, errors.alias("errors"))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark.read.text(path))


def split(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid records, quarantined ones with their errors)."""
    return records.where(F.size("errors") == 0).drop("errors"), records.where(F.size("errors") > 0)
