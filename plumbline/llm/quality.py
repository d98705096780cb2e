"""Quality rules: a threshold table compiled into Spark projections.

``RULES`` holds one row per rule: a name, a ratio of two measured counts, and the
closed range that it must be in. ``score`` measures each text with built-in
functions only and turns the table into one boolean expression; no Python runs
on the executors, nothing is shuffled.

Defined cases: a null text counts as empty. A text without words fails the base
rule. A ratio whose denominator is 0 is 0. Rows that repeat are scored alike,
one output row each; an empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import table, words

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"

#: The commonest function words of the four languages that the corpus holds.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "as", "on", "be", "by", "this", "at", "are", "was",
    "le", "la", "les", "de", "des", "du", "et", "en", "un", "une", "que", "qui", "dans", "pour", "par", "est", "pas", "sur", "au", "avec",
    "el", "los", "las", "y", "del", "se", "una", "por", "con", "para", "su", "no", "lo",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "ist", "dem", "ein", "eine", "nicht", "auf", "im", "für",
)


class Rule(NamedTuple):
    name: str
    over: str
    under: str
    least: float
    most: float


#: The method's verdict: kept if every ratio over/under lies in [least, most].
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbols_per_word", "n_symbols", "n_words", 0.0, 0.3),
    Rule("stop_word_share", "n_stop_words", "n_words", 0.02, 1.0),
    Rule("letter_word_share", "n_letter_words", "n_words", 0.6, 1.0),
    Rule("duplicate_line_share", "n_dup_lines", "n_lines", 0.0, 0.3),
    Rule("bullet_line_share", "n_bullet_lines", "n_lines", 0.0, 0.9),
    Rule("ellipsis_line_share", "n_ellipsis_lines", "n_lines", 0.0, 0.3),
)


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda a, x: a + x)


def _bound(xs: Column, f) -> Column:
    """f(xs), where xs is worked out once though f's lambdas use it at every element."""
    return F.get(F.transform(F.array(xs), f), F.lit(0))


def windows(ws: Column, n: int = WINDOW) -> Column:
    """64-bit hashes of all runs of n words."""
    return F.when(
        F.size(ws) >= n,
        F.transform(F.sequence(F.lit(1), F.size(ws) - (n - 1)), lambda i: F.xxhash64(F.slice(ws, i, n))),
    ).otherwise(F.array().cast("array<bigint>"))


def repeated_words(wins: Column, n: int = WINDOW) -> Column:
    """How many words lie in a window that occurs twice or more.

    Windows are sorted with their places; equal neighbours are the repeated ones,
    and each adds the words up to the next one's start, n at most.
    """
    tagged = F.array_sort(F.transform(wins, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(a: Column) -> Column:
        same = lambda x, j, d: F.coalesce(F.get(a, j + d)["h"] == x["h"], F.lit(False))
        hits = F.filter(a, lambda x, j: same(x, j, 1) | same(x, j, -1))
        places = F.array_sort(F.transform(hits, lambda x: x["i"]))
        return _bound(places, lambda p: _sum(F.transform(p, lambda x, j: F.least(F.lit(n), F.coalesce(F.get(p, j + 1) - x, F.lit(n))))))

    return F.when(F.size(F.array_distinct(wins)) < F.size(wins), _bound(tagged, covered)).otherwise(F.lit(0))


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the counts that the rules are about (columns __q.*), then flattened by ``score``."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("__q_words", words(t)).withColumn("__q_lines", lines)
    ws, ls = F.col("__q_words"), F.col("__q_lines")
    df = df.withColumn("__q_windows", windows(ws))
    counts = {
        "n_words": F.size(ws),
        "word_chars": F.length(F.translate(t, " \t\n\x0b\x0c\r", "")),
        "n_symbols": F.length(t) - F.length(F.translate(t, SYMBOLS, "")),
        "n_lines": F.size(ls),
        "n_dup_lines": F.size(ls) - F.size(F.array_distinct(ls)),
        "n_repeat_words": repeated_words(F.col("__q_windows")),
        "n_stop_words": F.size(F.filter(ws, lambda w: F.lower(w).isin(*STOP_WORDS))),
        "n_letter_words": F.size(F.filter(ws, lambda w: w.rlike(r"\p{L}"))),
        "n_bullet_lines": F.size(F.filter(ls, lambda x: x.rlike(r"^[\x20\x09]*[-*•]"))),
        "n_ellipsis_lines": F.size(F.filter(ls, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09\r]*$"))),
    }
    return df.withColumns({f"__q_{k}": v.cast("long") for k, v in counts.items()})


def compiled(rules: tuple[Rule, ...] = RULES) -> dict[str, Column]:
    """Per rule, whether a measured row breaks it."""
    ratio = lambda r: F.coalesce(F.try_divide(F.col(f"__q_{r.over}").cast("double"), F.col(f"__q_{r.under}").cast("double")), F.lit(0.0))
    return {r.name: (ratio(r) < r.least) | (ratio(r) > r.most) for r in rules}


def score(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df's columns under ``row``, and the counts, the rules broken, base_failed and kept."""
    names = df.columns
    m = measure(df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text}`").alias("__q_text")), "__q_text")
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_letter_words")
    n, rep = F.col("__q_n_words"), F.col("__q_n_repeat_words")
    base = (n < MIN_WORDS) | (100 * rep > MAX_REPEAT_PERCENT * n)
    broken = compiled(rules)
    failed = F.array_compact(F.array(*[F.when(b, F.lit(k)) for k, b in broken.items()]))
    m = m.select("row", *[F.col(f"__q_{c}").alias(c) for c in counts], base.alias("base_failed"), failed.alias("broken_rules"))
    return m.withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))


def keep(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of df that the rules keep, unchanged.

    The number beside the verdict changes nothing but the plan: a filter isn't pushed
    below a projection that numbers rows, which would repeat the measuring in every place
    where a count is used.
    """
    numbered = score(df, text).select("row", "kept", F.monotonically_increasing_id().alias("n"))
    return numbered.where("kept AND n >= 0").select("row.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = score(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return s.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", F.array_join("broken_rules", ",").alias("broken_rules"),
    )


def _sql() -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    ratio = lambda r: f"coalesce({r.over} / nullif({r.under}, 0)::DOUBLE, 0.0)"
    broken = {r.name: f"({ratio(r)} < {r.least} OR {ratio(r)} > {r.most})" for r in RULES}
    listed = ", ".join(f"CASE WHEN {b} THEN '{k}' END" for k, b in broken.items())
    return rf"""
WITH t AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
win AS (SELECT rid, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS s
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW})),
hit AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n
        FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM hit) GROUP BY rid),
c AS (SELECT doc_id, rid, len(ws)::BIGINT AS n_words, len(ls)::BIGINT AS n_lines,
        length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
        (length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        len(list_filter(ws, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop_words,
        len(list_filter(ws, lambda x: regexp_matches(x, '\p{{L}}')))::BIGINT AS n_letter_words,
        len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09]*[-*\x{{2022}}]')))::BIGINT AS n_bullet_lines,
        len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|\x{{2026}})[\x20\x09\r]*$')))::BIGINT AS n_ellipsis_lines
      FROM w),
m AS (SELECT c.*, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM c LEFT JOIN rep USING (rid)),
v AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed,
        list_filter([{listed}], lambda x: x IS NOT NULL) AS broken FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND len(broken) = 0) AS kept, array_to_string(broken, ',') AS broken_rules
FROM v"""


QUERIES = {"op10_quality_rules": op10_quality_rules}
ORACLE_SQL = {"op10_quality_rules": _sql()}
