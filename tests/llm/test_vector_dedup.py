"""Links, counts and components against all pairs of vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from plumbline.llm import vector_dedup as V
from pyspark.sql import functions as F


def brute(rows, cosine=0.95):
    ok = [i for i, (_, v) in enumerate(rows) if v is not None and len(v) == 16 and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    x = np.array([rows[i][1] for i in ok], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    link = x @ x.T >= cosine
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in zip(*np.nonzero(link), strict=True):
        root[top(ok[a])] = top(ok[b])
    n = dict.fromkeys(range(len(rows)), 0) | {ok[k]: int(link[k].sum()) - 1 for k in range(len(ok))}
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[top(i)] = min(d, low.get(top(i), d))
    return sorted([(d, n[i], low.get(top(i)), d == low.get(top(i))) for i, (d, _) in enumerate(rows)], key=str)


def made(seed, n=900, dim=16):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim))
    for i in range(n // 2, n):  # groups of many widths, chains among them
        j = r.integers(0, 40) if i % 2 else i - r.integers(1, 30)
        x[i] = x[j] / np.linalg.norm(x[j]) + r.choice([0.0, 0.01, 0.03, 0.06]) * r.normal(size=dim)
    return [(int(i), [float(c) for c in v]) for i, v in enumerate(x)]


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(V, "SHARD", 150)
    rows = made(3) + [(None, [1.0] * 16), (2000, [2.0] * 16), (2001, None), (2002, [0.0] * 16), (2003, [1.0] * 15 + [None]), (2004, [1.0] * 15 + [float("nan")]), (2005, [1.0] * 3), (2006, []), (7, made(3)[7][1]), (7, made(3)[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("row", F.lit("clash")).repartition(3)
    got = sorted([tuple(x) for x in V.dedup(df).collect()], key=str)
    want = brute(rows)
    assert [g[0] for g in got] == [w[0] for w in want]
    found, real = sum(g[1] for g in got), sum(w[1] for w in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert found >= 0.95 * real
    if found == real:
        assert got == want


def test_all_alike_and_empty(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert {tuple(x)[1:3] for x in V.dedup(df).collect()} == {(49, 0)}
    assert V.dedup(df.limit(0)).count() == 0
    assert V.dedup(df.limit(1)).count() == 1


def test_links_found_from_either_end_and_through_long_lists(spark):
    """A hub of 100 neighbours keeps them all, and a link that only the larger id's search reaches stays."""
    n = 101
    x = np.eye(n + 1)[:n] * 0.3
    x[:, n] = 1.0
    x /= np.linalg.norm(x, axis=1)[:, None]
    limit = float(np.arccos((x @ x.T).min())) + 1e-6
    lists = [list(range(1, n))] + [[] for _ in range(n - 1)]
    shard = lambda near: pd.DataFrame({"ball": np.arange(n), "unit": list(x), "radius": np.zeros(n), "near": near})
    got = V._search(limit)(shard(lists))
    assert {(0, k) for k in range(1, n)} <= set(zip(got["a"], got["b"], strict=True))
    lists = [[] for _ in range(n - 1)] + [list(range(n - 1))]
    got = V._search(limit)(shard(lists))
    assert {(k, n - 1) for k in range(n - 1)} <= set(zip(got["a"], got["b"], strict=True))


def test_exact_comparison_where_the_search_misses_links(spark, monkeypatch):
    monkeypatch.setattr(V, "_search", lambda limit: lambda t: pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)}))
    monkeypatch.setattr(V, "BLOCK", 40)
    rows = made(5, n=120)
    got = sorted([tuple(x) for x in V.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()], key=str)
    assert got == brute(rows)


def test_recall_is_not_carried_by_a_hot_group(spark):
    """All links of 60 copies are found, none of five pairs."""
    e = np.eye(6).tolist()
    x = [(i, 0, e[0], 59) for i in range(60)] + [(100 + i, 100 + i, e[1 + i % 5], 0) for i in range(10)]
    good = spark.createDataFrame([(r, v, v) for r, _, v, _ in x], "row long, v array<double>, unit array<double>")
    links = spark.createDataFrame([(r, b, n) for r, b, _, n in x], "row long, ball long, n_links long")
    assert V.recall(good, links) < V.MIN_RECALL


def test_lengths_are_treated_apart(spark):
    """Equal vectors of a rarer length link with each other, and with no vector of another length."""
    rows = [(i, [1.0, 0.0, 0.1 * i]) for i in range(5)] + [(10, [1.0, 0.0]), (11, [2.0, 0.0]), (12, [1.0])]
    got = {x.vec_id: (x.n_links, x.component_id) for x in V.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got[10] == (1, 10) and got[11] == (1, 10) and got[12] == (0, 12) and got[0][1] == 0


def test_many_rare_lengths_take_one_job(spark, monkeypatch):
    """Chains, copies, null ids and lone vectors in 60 lengths against all pairs; only lengths of more than RARE have a run."""
    monkeypatch.setattr(V, "RARE", 40)
    runs, one = [], V._of_one_length
    monkeypatch.setattr(V, "_of_one_length", lambda good, d, n, cosine: runs.append(d) or one(good, d, n, cosine))
    r, rows, want = np.random.default_rng(9), [], []
    for d in range(1, 61):
        n = {16: 120, 24: 60}.get(d, int(r.integers(1, 30)))
        x = r.normal(size=(n, d))
        for i in range(1, n):
            if i % 3:
                x[i] = x[i - 1] * r.uniform(0.5, 2) + r.choice([0.0, 0.1]) * r.normal(size=d) / np.sqrt(d)
        mine = [(None if d == 7 and i == 1 else d * 1000 + int(i), [float(c) for c in v]) for i, v in enumerate(x)]
        rows += mine
        link = np.array([[np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b)) >= 0.95 for b in x] for a in x])
        for i, (vec, _) in enumerate(mine):
            seen, todo = {i}, [i]
            while todo:
                todo = [k for k in np.flatnonzero(link[todo].any(0)).tolist() if k not in seen]
                seen |= set(todo)
            low = min((mine[k][0] for k in seen if mine[k][0] is not None), default=None)
            want.append((vec, int(link[i].sum()) - 1, low, vec == low))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted([tuple(x) for x in V.dedup(df).collect()], key=str)
    assert runs == [16, 24] and got == sorted(want, key=str)


def test_large_shards_are_dealt_anew(spark, monkeypatch):
    monkeypatch.setattr(V, "SHARD", 60)
    monkeypatch.setattr(V, "MOST", 90)
    monkeypatch.setattr(V, "BLOCK", 64)
    rows = made(6, n=500)
    got = sorted([tuple(x) for x in V.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()], key=str)
    want = brute(rows)
    assert sum(g[1] for g in got) >= 0.95 * sum(w[1] for w in want) and all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    leaders = spark.createDataFrame([(i, v) for i, v in rows], "ball long, unit array<double>")
    homes = V.small_shards(leaders.select("ball", F.lit("0").alias("shard")), leaders)
    assert homes.select("ball").distinct().count() == 500 and homes.groupBy("shard").count().agg(F.max("count")).first()[0] <= 90


@pytest.mark.parametrize("n", [500, 2000])
def test_planted_groups_at_the_tables_sizes(spark, n):
    """The driver's tables of 500 and 2,000 vectors hold few links or none: groups are planted, and the recall measured."""
    r = np.random.default_rng(n)
    x = r.normal(size=(n, 16))
    for i in range(n // 2, n):
        x[i] = x[i % (n // 5)] / np.linalg.norm(x[i % (n // 5)]) + 0.05 * r.normal(size=16)
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(x)]
    got = sorted([tuple(g) for g in V.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()], key=str)
    want = brute(rows)
    found, real = sum(g[1] for g in got), sum(w[1] for w in want)
    print(f"recall {found / real:.4f} of {real} links at {n} vectors")
    assert real > n and found >= 0.95 * real and all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
