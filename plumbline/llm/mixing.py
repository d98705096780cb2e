"""Mixing sources to target weights by fitting word budgets exactly where lengths allow.

Each source's target is its weight's share of all words, at most three times its
own size; what a capped source leaves is shared anew by weight. A source is then
taken whole as often as its target allows, and the rest of the budget is a
bounded subset sum over the histogram of document lengths: most of it goes to
every length in proportion to its documents, what rounding leaves goes to lengths in a seeded
order that favours none, and a bounded-knapsack table fits the last words.
Which documents of a length are taken follows a seeded hash.

Only histograms are gathered: per source as many rows as it has different
lengths. Documents of one length are chosen by hash buckets: those below the
bucket where the number is reached are all taken, and only that bucket's are ranked,
in finer buckets first, so that copies which fill a third of the corpus don't meet in one task.

Defined cases: a null text has size 0 and is never taken. A null source is a
source of its own, after all others. Null ids and repeated rows are documents like others; equal
hashes are ordered by a hash of the text and the carried columns, so that only
rows alike in all of these can change places, which gives the same rows. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import cut, table, words

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
SEED = 20250903
#: The knapsack table fits at most so many words more than the longest length; proportion and the seeded order cover the rest.
TABLE_WORDS = 1 << 16
#: Documents of one source and length are dealt over so many hash buckets, and those of the last bucket over as many again.
BUCKETS = 256


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, weight, target) of rows (source, source_size): the water level of the weights.

    Ranks come from a sorted table of the sources alone. Each round caps the
    sources whose share is above their cap; shares only grow, so at most as many
    rounds as there are sources are needed, and few in practice. All sums are
    of integers, so that any order of adding gives the same targets.
    """
    # one row a source; strings compare by their UTF-8 bytes, which is the order of code points
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    d = sizes.select("source", "source_size", place.alias("place"))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("place") % len(WEIGHTS) + 1).cast("int")).cast("long")
    cap = MOST_COPIES * F.col("source_size")
    d = cut(d.select("source", "source_size", weight.alias("weight"), cap.alias("cap")), "mix-sources")
    total = d.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    rest, weights, capped = total, 0, F.lit(False)
    while True:
        row = d.agg(
            F.coalesce(F.sum(F.when(capped, F.col("cap"))), F.lit(0)).alias("used"),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0)).alias("weights"),
            F.count(F.when(capped, 1)).alias("n"),
        ).first()
        rest, weights = total - row["used"], row["weights"]
        share = F.col("weight").cast("double") * F.lit(float(rest)) / F.lit(float(weights or 1))
        now = F.lit(False) if not weights else capped | (share > F.col("cap"))
        if not weights or d.where(now).count() == row["n"]:
            return d.select("source", "source_size", "weight", F.when(capped, F.col("cap").cast("double")).otherwise(share).alias("target"))
        # a cap once reached stays reached: the level only rises
        capped = now


def turns(shares: dict[int, float], seed: int = SEED) -> list[int]:
    """Lengths in a seeded order: each one's place is drawn by its share of a further document, whatever the length."""
    u = {n: (xxhash.xxh64_intdigest(str(n), seed & (1 << 63) - 1) + 1) / (2**64 + 1) for n in shares}
    return sorted(shares, key=lambda n: (-math.log(u[n]) / shares[n], n))


def fit(budget: int, counts: dict[int, int], most: int = TABLE_WORDS, seed: int = SEED) -> dict[int, int]:
    """How many documents of each length to take for a sum next to the budget.

    counts: documents by length (> 0). First floor(count * budget / all) of each
    length; then, while more than ``most`` words are left, one more of each length in the
    seeded order of the shares that were rounded off; then a bounded knapsack over
    what is left of each length, whose reachable sums are the bits of one integer per item.
    """
    size = sum(n * c for n, c in counts.items())
    if budget <= 0 or not size:
        return dict.fromkeys(counts, 0)
    if budget >= size:
        return dict(counts)
    took = {n: c * budget // size for n, c in counts.items()}
    left = budget - sum(n * k for n, k in took.items())
    for n in turns({n: c * budget % size / size for n, c in counts.items() if c * budget % size}, seed):
        if left <= most:
            break
        if n <= left:
            took[n] += 1
            left -= n
    # Any single document may also overshoot; the table reaches as far as the longest one would.
    edge = left + min((n for n in counts if took[n] < counts[n]), default=0)
    full, reach, items = (1 << (edge + 1)) - 1, 1, []
    for n in turns({n: 1.0 for n in counts if took[n] < counts[n]}, seed + 1):
        spare, k = min(counts[n] - took[n], edge // n), 1
        while spare > 0:
            step = min(k, spare)
            new = (reach | (reach << (n * step))) & full
            if new != reach:
                items.append((n, step, reach))
                reach = new
            spare, k = spare - step, 2 * k
        if reach >> left & 1:
            break
    below = (reach & ((1 << (left + 1)) - 1)).bit_length() - 1
    above = reach >> left
    over = left + ((above & -above).bit_length() - 1) if above else None
    goal = over if over is not None and over - left < left - below else below
    for n, step, before in reversed(items):
        if not before >> goal & 1:
            took[n] += step
            goal -= n * step
    return took


def _plan(seed: int):  # noqa: ANN202
    def run(f: pd.DataFrame) -> pd.DataFrame:
        target, size = float(f["target"].iloc[0]), int(f["source_size"].iloc[0])
        whole = min(MOST_COPIES, int(target // size))
        budget = round(target - whole * size) if whole < MOST_COPIES else 0
        took = fit(budget, dict(zip(f["size"].tolist(), f["count"].tolist(), strict=True)), seed=seed)
        return pd.DataFrame({"src": f["src"].iloc[0], "no_src": f["no_src"].iloc[0], "size": list(took), "whole": whole, "k": list(took.values())})

    return run


def first_by_hash(d: DataFrame, wanted: DataFrame, keys: list[str], order: list[str], bucket: Column) -> tuple[DataFrame, DataFrame]:
    """Of each group the bucket in which its k-th row lies: rows (keys, last, k left for that bucket), and the rows of d in those buckets.

    Groups and buckets are counted before anything is shuffled.
    """
    dealt = d.select(*keys, "n", *order, bucket.alias("bucket")).join(wanted.where("k > 0"), keys)
    counted = dealt.groupBy(*keys, "k", "bucket").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(W.partitionBy(*keys).orderBy("bucket"))
    last = counted.withColumn("upto", upto).where((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("c") < F.col("k")))
    last = cut(last.select(*keys, F.col("bucket").alias("last"), (F.col("k") - F.col("upto") + F.col("c")).alias("k")), "mix-last")
    return last, dealt.drop("k").join(last.select(*keys, F.col("last").alias("bucket"), "k"), [*keys, "bucket"])


def chosen(d: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """(n) of the first k rows of each group in the order of (h1, h2). wanted: (keys, k)."""
    order = ["h1", "h2"]
    coarse = F.pmod(F.shiftrightunsigned("h1", 40), F.lit(BUCKETS)).cast("int")
    fine = F.pmod(F.shiftrightunsigned("h1", 20), F.lit(BUCKETS)).cast("int")
    last, rest = first_by_hash(d, wanted, keys, order, coarse)
    whole = d.select(*keys, "n", coarse.alias("b")).join(last.select(*keys, "last"), keys).where("b < last").select("n")
    rest = cut(rest.drop("bucket"), "mix-rest")
    finer, final = first_by_hash(rest.drop("k"), last.select(*keys, "k"), keys, order, fine)
    more = rest.select(*keys, "n", fine.alias("b")).join(finer.select(*keys, "last"), keys).where("b < last").select("n")
    ranked = final.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("rank <= k").select("n")
    return whole.unionByName(more).unionByName(ranked)


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", carry: list[str] | None = None, seed: int = SEED) -> DataFrame:
    """(row, size, source_size, target, copies) per row of df; row is the struct of the carried columns (all by default)."""
    row = F.struct(*[F.col(f"`{c}`") for c in (df.columns if carry is None else carry)])
    d = df.select(
        row.alias("row"), F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("src"), F.col(f"`{source}`").isNull().alias("no_src"),
        F.size(words(F.col(f"`{text}`"))).cast("long").alias("size"), F.xxhash64(F.col(f"`{doc_id}`").cast("string"), F.lit(seed)).alias("h1"),
        F.xxhash64(F.col(f"`{text}`"), row).alias("h2"), F.monotonically_increasing_id().alias("n"),
    )
    d = cut(d, "mix-rows")
    keys, by_source = ["src", "no_src", "size"], ["src", "no_src"]
    hist = cut(d.groupBy(*keys).agg(F.count("*").alias("count")), "mix-histogram")
    sizes = hist.groupBy(*by_source).agg(F.sum(F.col("size") * F.col("count")).alias("source_size"))
    goals = targets(sizes.select(F.when(~F.col("no_src"), F.col("src")).alias("source"), "source_size"))
    goals = cut(goals.select(F.coalesce("source", F.lit("")).alias("src"), F.col("source").isNull().alias("no_src"), "source_size", "target"), "mix-goals")
    plan = hist.where("size > 0").join(goals, by_source).groupBy(*by_source).applyInPandas(_plan(seed), "src string, no_src boolean, size long, whole int, k long")
    plan = cut(plan, "mix-plan")
    # only row numbers and hashes are dealt and ranked; the carried columns join last
    more = cut(chosen(d.drop("row"), plan.select(*keys, "k"), keys).withColumn("more", F.lit(1)), "mix-chosen")
    wholes = plan.select(*by_source, "whole").distinct()
    numbers = d.join(more, "n", "left").join(goals, by_source).join(wholes, by_source, "left")
    copies = F.when(F.col("size") > 0, F.coalesce("whole", F.lit(0)) + F.coalesce("more", F.lit(0))).otherwise(0)
    return numbers.select("row", "size", "source_size", "target", copies.alias("copies"))


def repeat(df: DataFrame) -> DataFrame:
    """df as the mix takes it: each row as often as it has copies."""
    m = mix(df).where("copies > 0")
    return m.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return m.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


QUERIES = {"op9_mixing": op9_mixing}
ORACLE_SQL: dict[str, str] = {}
