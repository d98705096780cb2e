"""The join against comparing all pairs of shingle sets."""

from __future__ import annotations

import random
import re

from plumbline.llm import graph, ngram_join
from pyspark.sql import functions as F


def shingle_set(text, n=4):
    ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not ws:
        return frozenset()
    return frozenset([tuple(ws)] if len(ws) < n else [tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)])


def brute(rows, n=4, share=85):
    sets = [shingle_set(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= share * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[top(i)] = min(d, low.get(top(i), d))
    return sorted([(d, len(sets[i]), low.get(top(i))) for i, (d, _) in enumerate(rows)], key=str)


def made(seed, n=220):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["é", "Ünder", "THE", "the"]
    passage = [r.choice(vocabulary) for _ in range(40)]
    texts = []
    while len(texts) < n:
        kind = r.random()
        if kind < 0.35 or not texts:
            ws = [r.choice(vocabulary) for _ in range(r.randint(1, 120))]
        elif kind < 0.85:  # a chain of edits: near copies of near copies
            ws = list(r.choice(texts[-25:]).split() or ["x"])
            for _ in range(r.randint(0, 3)):
                ws[r.randrange(len(ws))] = r.choice(vocabulary)
        else:
            ws = passage + [r.choice(vocabulary) for _ in range(r.randint(0, 12))]
        texts.append(r.choice([" ", "\t", "\n "]).join(ws))
    return list(enumerate(texts))


def test_against_all_pairs(spark):
    for seed in (1, 2):
        rows = made(seed) + [(None, "a lone text of its own here"), (900, None), (901, ""), (902, " \n"), (903, "A b"), (904, "a B"), (905, "a b c"), (5, "dup of id"), (5, "dup of id"), (906, None), (None, "x y")]
        rows += [(None, "one two three four five six"), (907, "ONE two three four five six")]
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).repartition(5)
        got = sorted([tuple(r) for r in ngram_join.join(df).collect()], key=str)
        assert got == brute(rows)


def test_hot_group_of_near_copies(spark):
    r = random.Random(9)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(400):
        ws = list(base)
        for _ in range(r.randint(0, 2)):
            ws[r.randrange(200)] = f"e{r.randrange(10**6)}"
        rows.append((i, " ".join(ws)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted([tuple(x) for x in ngram_join.join(df).collect()], key=str) == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.join(df).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(3, 3), (1, 2), (2, 1)], "u long, v long")
    got = {r.node: r.component for r in graph.components(edges).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 1: 1, 2: 1}


def test_long_lists_in_bands(spark, monkeypatch):
    """One n-gram in all documents of many groups, even short lists compared by bands of sizes."""
    monkeypatch.setattr(ngram_join, "LIST", 4)
    r = random.Random(12)
    shared, rows = "one very common passage", []
    for g in range(12):
        base = [f"g{g}x{i}" for i in range(r.randint(20, 45))]
        for _ in range(8):
            ws = list(base)
            for _ in range(r.randint(0, 2)):
                ws[r.randrange(len(ws))] = f"e{r.randrange(10**6)}"
            rows.append((len(rows), f"{shared} {' '.join(ws)} {shared}"))
    rows += made(3, 120)[:120]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted([tuple(x) for x in ngram_join.join(df).collect()], key=str) == brute(rows)


def test_one_of_each_against_all_pairs(spark):
    """The pipeline's stage, five words and 0.8: of each group by all pairs the smallest id stays, and texts without words stay."""
    rows = made(7, n=260) + [(None, "a lone text of its own here"), (900, None), (901, ""), (902, " \n"), (903, "A b"), (904, "a B"), (905, "a b c")]
    rows.append((None, rows[11][1]))
    low = brute(rows, n=5, share=80)
    want = sorted((d for d, _, least in low if d == least), key=str)
    got = sorted((x.doc_id for x in ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()), key=str)
    assert len(want) < 200 and got == want


def test_one_of_each_goes_by_row(spark):
    t = " ".join(f"w{i}" for i in range(60))
    near, other = t.replace("w30", "x30"), " ".join(f"o{i}" for i in range(40))
    rows = [(1, t, "a"), (2, t, "b"), (2, other, "c"), (5, other + " z", "d"), (7, None, "e"), (7, "", "f"), (None, t, "g"), (None, "lone " * 9, "h"), (9, near, "i"), (9, near, "j")]
    df = spark.createDataFrame(rows, "doc_id long, text string, th string").repartition(3)
    got = sorted([tuple(x) for x in ngram_join.one_of_each(df).collect()], key=str)
    assert got == sorted([rows[0], rows[2], rows[4], rows[5], rows[7]], key=str)
    alike = [(5, t, "a"), (5, near, "b"), (5, t, "c")]
    left = ngram_join.one_of_each(spark.createDataFrame(alike, "doc_id long, text string, row string")).collect()
    assert len(left) == 1
    assert ngram_join.one_of_each(df.limit(0)).columns == df.columns
