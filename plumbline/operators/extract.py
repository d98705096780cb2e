"""Statistics, sample sizes and arms in free text, by regular expressions on the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns of reports in APA style and of sample sizes.
SIZE = r"(?i)(?:randomi[sz]ed|enrolled|sample(?:\s+size)?)\s*(?:n\s*=|[:=]|was)?\s*(\d+)"
SIZE_N = r"\bN\s*=\s*(\d+)\b"
ARM = r"(?i)(?:arm|group)\s+([\w -]{1,40}?)\s*[:;,]\s*n\s*=\s*(\d+)"
STAT = (
    r"(?iU)\b(t|F|z|r|chi(?:\^?2|²)|χ²|Q)\s*\(\s*([\d.]+)(?:\s*,\s*([\d.]+))?\s*\)\s*=\s*(-?[\d.]+)\s*[,;]?\s*p\s*([<>=]+)\s*(0?\.\d+|1(?:\.0+)?)"
)


def randomized_n(text: Column) -> Column:
    first = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit("")).try_cast("bigint")
    return F.coalesce(first(SIZE), first(SIZE_N))


def arm_ns(text: Column) -> Column:
    """map of arm to size; of one name the last counts."""
    found = F.transform(F.regexp_extract_all(text, F.lit(ARM), F.lit(0)), lambda m: F.struct(F.trim(F.regexp_extract(m, ARM, 1)).alias("k"), F.regexp_extract(m, ARM, 2).try_cast("bigint").alias("n")))
    names = F.array_distinct(F.transform(found, lambda a: a["k"]))
    return F.map_from_arrays(names, F.transform(names, lambda k: F.element_at(F.filter(found, lambda a: a["k"] == k), -1)["n"]))


def stats(text: Column) -> Column:
    """Reported statistics in order; what can't be read as a number or operator is left out."""

    def one(m: Column) -> Column:
        g = lambda i: F.regexp_extract(m, STAT, i)
        kind = F.lower(g(1))
        name = F.when(kind.startswith("chi") | (kind == "χ²"), "chi2").when(kind.isin("f", "q"), F.upper(kind)).otherwise(kind)
        places = lambda s: F.length(F.regexp_extract(s, r"\.(\d*)$", 1))
        return F.struct(
            name.alias("stat_type"), g(4).try_cast("double").alias("value"), F.nullif(g(2), F.lit("")).try_cast("double").alias("df1"), F.nullif(g(3), F.lit("")).try_cast("double").alias("df2"),
            g(6).try_cast("double").alias("reported_p"), g(5).alias("p_operator"), places(g(4)).alias("statistic_decimals"), places(g(6)).alias("p_decimals"),
            F.lit(False).alias("adjusted"), F.lit(False).alias("one_tailed"), m.alias("source"),
        )

    found = F.transform(F.regexp_extract_all(text, F.lit(STAT), F.lit(0)), one)
    return F.filter(found, lambda s: s["value"].isNotNull() & s["p_operator"].isin("=", "<", ">", "<=", ">="))


def extract(df: DataFrame, text: str = "text") -> DataFrame:
    """df with randomized_n, arm_ns and reported_stats."""
    t = F.coalesce(F.col(text), F.lit(""))
    return df.withColumns({"randomized_n": randomized_n(t), "arm_ns": arm_ns(t), "reported_stats": stats(t)})
