"""Personal data: base patterns, and identifiers that bootstrapped contexts discover.

The base patterns give the seed entities. The word before and the word after each
seed are lexical patterns (spans and punctuation end words, in contexts and in
totals alike); a pattern's score is the share of all its occurrences in the corpus
that stand at a known entity. Tokens with digits that no base
pattern covers are the unseen instances; an instance's score joins the scores of
the high-confidence patterns that it occurs with (noisy or). Instances over the
threshold become seeds of the next round; when a round changes no score, or after
``ROUNDS``, they are spans of kind ``context``. Built-in functions only: the pattern-instance graph is a
table of counted edges, aggregated before it is joined.

Defined cases: a null text counts as empty. A null id is an id like others. Rows that repeat each get their row;
an empty table gives an empty result. Long runs of digits or letters take linear
time: every pattern starts only where a run starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import spans as S
from plumbline.llm.common import cut, table

KINDS = ("email", "ip", "card", "phone")

# The base patterns. Possessive loops and the tests on what stands before change no
# match, they only save the walk over starts that must fail.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

#: A token of an unseen identifier: at least six characters, three of them digits.
TOKEN = r"(?<![A-Za-z0-9@._+/=-])(?=[A-Za-z@._+/=-]{0,40}[0-9])[A-Za-z0-9@._+/=-]{6,}+"

#: Words of context: left of a span punctuation ends a word ("id:"), right of it punctuation is a word of its own.
PUNCT = r"!-/:-@\[-`{-~"
BORDERS = {"L": rf"[^\x20\x09-\x0D{PUNCT}]*+[{PUNCT}]++|[^\x20\x09-\x0D{PUNCT}]++", "R": rf"[{PUNCT}]++|[^\x20\x09-\x0D{PUNCT}]++"}

#: Rounds end when scores no longer change (to six digits), at the latest after so many.
ROUNDS = 8
#: A pattern counts from so many different seeds and this share of its occurrences on.
MIN_SEEDS = 3
MIN_PATTERN_SCORE = 0.3
MIN_INSTANCE_SCORE = 0.6


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check sum of a digit string is a multiple of ten; the last digit has place 0."""
    ones = F.transform(F.split(F.reverse(digits), ""), lambda c: F.try_to_number(c, F.lit("9")).cast("int"))
    weighed = F.transform(ones, lambda d, i: F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return F.aggregate(weighed, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _card_ok(m: Column) -> Column:
    return F.when(F.length(_digits(m)).between(14, 19), _luhn(_digits(m))).otherwise(F.lit(False))


def base_spans(text: Column) -> Column:
    ip_ok = lambda m: m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    phone_ok = lambda m: F.length(_digits(m)).between(10, 15)
    return S.merged(
        S.find(text, EMAIL, "email", 0, guard=text.contains("@")),
        S.find(text, IP, "ip", 1, ip_ok),
        S.find(text, CARD, "card", 2, _card_ok),
        S.find(text, PHONE, "phone", 3, phone_ok, guard=text.contains("+")),
    )


def _word(s: Column) -> Column:
    """A context word as patterns hold it: lower case, digits as 0, none at the text's ends."""
    return F.regexp_replace(F.lower(s), "[0-9]", "0")


_pieces = S.pieces


def _heard(side: str) -> Column:
    """All words of a row's pieces as patterns of one side; a block of spans is one word."""
    find = lambda p: F.regexp_extract_all(_word(p["gap"]), F.lit(BORDERS[side]), F.lit(0))
    found = F.flatten(F.transform("pieces", lambda p: F.concat(find(p), F.array(_word(p["body"])))))
    return F.transform(F.filter(found, lambda w: w != ""), lambda w: F.concat(F.lit(f"{side}:"), w))


def _contexts(p: Column, i: Column) -> Column:
    """The patterns at the spans of piece i: of the words that _heard counts the one just before and the one just after."""
    before, after = F.get("pieces", i - 1), F.get("pieces", i + 1)
    all_left = F.regexp_extract_all(_word(p["gap"]), F.lit(BORDERS["L"]), F.lit(0))
    left = F.coalesce(F.get(all_left, F.size(all_left) - 1), _word(before["body"]), F.lit(""))
    right = F.coalesce(F.get(F.regexp_extract_all(_word(after["gap"]), F.lit(BORDERS["R"]), F.lit(0)), F.lit(0)), _word(after["body"]), F.lit(""))
    pats = F.array(F.concat(F.lit("L:"), left), F.concat(F.lit("R:"), right))
    return F.filter(pats, lambda p: F.length(p) > 2)


def _pattern_totals(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(pattern, total): how often the wanted patterns' words occur in all texts."""
    heard = texts.select(F.explode(F.concat(_heard("L"), _heard("R"))).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("total"))
    return wanted.join(heard, "pattern")


def discover(texts: DataFrame, edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(instance, score) of the unseen instances that high-confidence patterns lead to.

    texts: pieces. edges: rows (pattern, instance, is_seed, n), each pair once.
    """
    # What a round discovers can be another pattern's only seeds, so unseen instances count here too.
    firm = edges.groupBy("pattern").agg(F.count(F.when(~F.col("is_seed"), 1)).alias("unseen"), F.count("*").alias("any"))
    wanted = firm.where((F.col("any") >= MIN_SEEDS) & (F.col("unseen") > 0)).select("pattern")
    totals = cut(_pattern_totals(texts, wanted), "pii-patterns")
    edges = cut(edges.join(totals, "pattern"), "pii-edges")
    known = edges.where("is_seed").select("instance").distinct().withColumn("score", F.lit(1.0))
    before = (0, 0.0)
    for _ in range(rounds):
        scored = edges.join(known.where(F.col("score") >= MIN_INSTANCE_SCORE), "instance").groupBy("pattern").agg(
            F.round(F.sum(F.col("n") * F.col("score")) / F.first("total"), 9).alias("weight"), F.count("*").alias("seeds")
        ).where((F.col("seeds") >= MIN_SEEDS) & (F.col("weight") >= MIN_PATTERN_SCORE))
        doubt = F.log1p(-F.least(F.col("weight"), F.lit(0.999)))
        found = edges.where("NOT is_seed").join(scored, "pattern").groupBy("instance").agg((1 - F.exp(F.sum(doubt))).alias("score"))
        seeds = edges.where("is_seed").select("instance").distinct().withColumn("score", F.lit(1.0))
        fresh = cut(found.join(seeds, "instance", "left_anti").where(F.col("score") >= MIN_INSTANCE_SCORE), "pii-scores")
        now = tuple(fresh.agg(F.count("*"), F.round(F.coalesce(F.sum("score"), F.lit(0.0)), 6)).first())
        if now == before:
            break
        before, known = now, seeds.unionByName(fresh)
    return fresh


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of df: doc_id, the text's hash, base spans and all spans."""
    t = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    d = t.select("doc_id", "text", F.sha2("text", 256).alias("hash"), base_spans(F.col("text")).alias("base"), S.find(F.col("text"), TOKEN, "context", 4, lambda m: m.rlike("[0-9].*[0-9].*[0-9]")).alias("wide"))
    d = d.withColumn("wide", S.outside(F.col("wide"), F.col("base")))
    d = d.select("doc_id", "hash", "base", S.pieces(F.col("text"), S.merged(F.col("base"), F.col("wide"))).alias("pieces"))
    d = cut(d.withColumn("row", F.monotonically_increasing_id()), "pii-spans")
    # Overlapping spans share the one place of their contexts, so that no pattern has more places than its total.
    seen = F.transform("pieces", lambda p, i: F.struct(p["spans"].alias("spans"), (F.lit(1.0) / F.greatest(F.size(p["spans"]), F.lit(1))).alias("share"), _contexts(p, i).alias("patterns")))
    each = d.where(F.size("pieces") > 1).select("row", F.explode(seen).alias("b")).select("row", "b.share", "b.patterns", F.explode("b.spans").alias("s"))
    each = each.select("row", "share", "patterns", "s.start", "s.end", "s.kind", "s.text", (F.col("s.kind") != "context").alias("is_seed"), F.sha2(F.lower("s.text"), 256).alias("instance"))
    edges = each.select("instance", "is_seed", "share", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance").agg(
        F.max("is_seed").alias("is_seed"), F.sum("share").alias("n")
    )
    found = discover(d.select("pieces"), edges)
    extra = each.where("NOT is_seed").join(found, "instance").groupBy("row").agg(
        F.collect_list(F.struct(F.col("start"), F.lit(4).alias("rank"), F.col("end"), F.col("kind"), F.col("text"))).alias("extra")
    )
    return d.join(extra, "row", "left").select("doc_id", "hash", "base", S.merged(F.col("base"), F.coalesce("extra", F.array().cast(S.SPAN))).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    kind = lambda p: F.when(F.size(p["spans"]) > 0, F.concat(F.lit("["), F.upper(F.get(p["spans"], F.lit(0))["kind"]), F.lit("]"))).otherwise("")
    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(F.transform(S.pieces(text, spans), lambda p: F.concat(p["gap"], kind(p))), ""))


def redact(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df with the spans in its texts replaced; null texts stay null, all rows stay.

    Rows are matched with their spans by id and the text's hash, so that ids need
    not be unique; equal rows have equal spans.
    """
    names = df.columns
    key = lambda c, x: [F.col(c).alias("__id"), F.sha2(F.coalesce(x, F.lit("")), 256).alias("__hash")]
    flat = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    spans = scan(flat).where(F.size("spans") > 0).dropDuplicates(["doc_id", "hash"])
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), *key(f"`{doc_id}`", F.col(f"`{text}`")))
    joined = rows.join(spans.select(F.col("doc_id").alias("__i"), F.col("hash").alias("__h"), "spans"), F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__hash") == F.col("__h")), "left")
    new = redacted(F.col("row")[text], F.coalesce("spans", F.array().cast(S.SPAN)))
    return joined.select(*[(new if c == text else F.col("row")[c]).alias(c) for c in names])


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scan(table(spark, sf_dir, "documents"))
    return s.select(
        "doc_id", *[S.count(F.col("base"), k).alias(f"n_{k}") for k in KINDS],
        F.sha2(S.written(F.col("base")), 256).alias("base_sha256"), S.written(F.col("spans")).alias("spans"),
    )


QUERIES = {"op7_pii": op7_pii}
ORACLE_SQL: dict[str, str] = {}
