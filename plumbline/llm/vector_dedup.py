"""Embedding near-dedup on a robust-pruned flat graph.

1. Classes and balls. Vectors of equal length are treated together. Equal ones are one point with a
   weight. Points go to the nearest of some centroids, fitted on a bounded sample, and
   within salted blocks of a centroid to leaders that lie within a small angle of
   them. Members of one ball all link with each other, so that a group of very many near
   copies becomes a few balls with weights; other points are balls of one.
2. Graph. Leaders go to the shards of their OVERLAP nearest centroids; a shard of more than MOST
   is dealt anew by pivots of its own. Each shard links its
   leaders to near ones, robustly pruned: a candidate is dropped where a kept neighbour is
   nearer to it by the factor ALPHA. The adjacency lists of all shards, with their
   reverses, are united per leader.
3. Search. The united graph is searched shard by shard, each with the neighbours of its leaders
   that lie in other shards: every leader by greedy beam from the medoid
   and from itself, then the range is expanded through all neighbours within it.
4. Verification by the cosine in double precision. Two balls whose angle less the radii
   is within the limit link; if the angle plus the radii is, all their members do,
   else their members are compared as two matrices, which gives a count a member.
5. Audit. The links of AUDIT leaders, drawn by hash, are compared with brute force over all
   rows, always; while their mean recall is below MIN_RECALL everything is done again with twice the
   overlap, and after the largest overlap with all pairs of leaders, in blocks. The figure is logged.

Bounds: the centroids are fitted on at most FIT vectors and number at most CENTROIDS;
what is collected is that sample, the audit's vectors and sums, and the lengths of more than RARE
vectors (at most one in RARE rows). The commonest length and those go through steps 1 to 5, a run each;
all rarer lengths are compared exactly in one job, a group a length.

Defined cases: vectors that are null, zero, or hold null or non-finite components link with
nothing, and those of different lengths not with each other. Equal rows are vectors of their own and
link with each other. A null id is never the smallest. An empty table gives an empty result.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import cut, discard, table
from plumbline.llm.graph import components

LOG = logging.getLogger(__name__)
COSINE = 0.95
FIT, CENTROIDS, ROUNDS = 20_000, 4096, 8
SHARD, BLOCK = 1000, 2048
#: A shard of more leaders is dealt anew, so often at most.
MOST, DEALS = 4096, 4
OVERLAP, AUDIT, MIN_RECALL = 2, 128, 0.95
#: A length of no more vectors, unless it is the commonest, is compared exactly in one group.
RARE = 1024
#: A ball's radius, as a share of the angle of a link; under a half, members all link.
RADIUS = 0.25
NEAR, DEGREE, ALPHA, BEAM = 48, 16, 1.2, 24


def _matrix(column) -> np.ndarray:  # noqa: ANN001
    return np.stack(column.to_numpy()) if len(column) else np.empty((0, 0))


def angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def centroids(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means of unit vectors, started at evenly spread rows."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        at = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        size = np.linalg.norm(sums, axis=1)
        c = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-300)[:, None], c)
    return c


def _balls(limit: float):  # noqa: ANN202
    """Leaders of one block: each vector not yet taken leads those within RADIUS of the limit."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("row")
        rows, x = t["row"].to_numpy(), _matrix(t["unit"])
        reach = math.cos(RADIUS * limit)
        lead, radius = np.arange(len(rows)), np.zeros(len(rows))
        crowd = np.zeros(len(rows), bool)
        for i in range(0, len(rows), 1024):
            crowd[i : i + 1024] = ((x[i : i + 1024] @ x.T) >= reach).sum(1) > 1
        free_ = crowd.copy()
        for i in np.flatnonzero(crowd):
            if free_[i]:
                mine = np.flatnonzero(free_)
                cos = x[mine] @ x[i]
                mine = mine[(cos >= reach) | (mine == i)]
                lead[mine] = i
                radius[mine] = angle(x[mine] @ x[i]) * (mine != i)
                free_[mine] = False
        return pd.DataFrame({"row": rows, "ball": rows[lead], "radius": radius})

    return run


def prune(x: np.ndarray, near: np.ndarray, sims: np.ndarray) -> list[np.ndarray]:
    """Robust pruning: of each row's candidates (nearest first) those that no kept one is ALPHA times nearer to."""
    out = []
    for i in range(0, len(near), 256):
        c, d = near[i : i + 256], angle(sims[i : i + 256])
        between = angle(np.einsum("nad,nbd->nab", x[c], x[c]))
        alive, kept = np.isfinite(d), np.zeros(d.shape, bool)
        rows = np.arange(len(c))
        for _ in range(min(DEGREE, c.shape[1])):
            first = alive.argmax(1)
            some = alive[rows, first]
            kept[rows[some], first[some]] = True
            alive &= ~(ALPHA * between[rows, first] <= d)
            alive[rows, first] = False
        out += [c[k][kept[k]] for k in range(len(c))]
    return out


def _build(t: pd.DataFrame) -> pd.DataFrame:
    """Rows (ball, near): a shard's pruned adjacency and its reverse."""
    ids, x = t["ball"].to_numpy(), _matrix(t["unit"])
    n, k = len(ids), min(NEAR, len(ids) - 1)
    if k < 1:
        return pd.DataFrame({"ball": ids, "near": [np.empty(0, np.int64)] * n})
    near, sims = np.empty((n, k), np.int64), np.empty((n, k))
    for i in range(0, n, 1024):
        s = x[i : i + 1024] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -2
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)
        near[i : i + 1024], sims[i : i + 1024] = top, np.take_along_axis(s, top, 1)
    lists = prune(x, near, sims)
    to = np.concatenate(lists)
    of = np.repeat(np.arange(n), [len(a) for a in lists])
    edges = pd.DataFrame({"ball": np.concatenate([ids[of], ids[to]]), "near": np.concatenate([ids[to], ids[of]])})
    return edges.groupby("ball", sort=False)["near"].agg(lambda s: list(dict.fromkeys(s))).reset_index()


def _dots(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x[a] . x[b], pair by pair, in pieces of bounded memory."""
    parts = [np.einsum("pd,pd->p", x[a[i : i + 65536]], x[b[i : i + 65536]]) for i in range(0, len(a), 65536)]
    return np.concatenate([np.empty(0), *parts])


def _fan(start: np.ndarray, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The neighbours of rows at: (place in at, place in its list, neighbour)."""
    sizes = start[at + 1] - start[at]
    of = np.repeat(np.arange(len(at)), sizes)
    place = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return of, place, flat[start[at][of] + place]


def search(x: np.ndarray, lists: list[list[int]], radius: np.ndarray, limit: float, asked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(query, found) places within the limit, radii allowed for. lists: neighbours by row, of any length; asked: the queries (all)."""
    n = len(x)
    asked = np.arange(n) if asked is None else asked
    start = np.concatenate([[0], np.cumsum([len(a) for a in lists])]).astype(np.int64)
    flat = np.array([b for a in lists for b in a], np.int64)
    medoid = int((x @ x.mean(0)).argmax())
    reach = np.cos(np.minimum(limit + radius + radius.max(initial=0.0), math.pi))
    pairs_q, pairs_v = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i in range(0, len(asked), 512):
        q = asked[i : i + 512]
        rows = np.arange(len(q))
        seen, done = np.zeros((len(q), n), bool), np.zeros((len(q), n), bool)
        beam = np.stack([np.full(len(q), medoid), q], 1)
        seen[rows[:, None], beam] = True
        sims = np.einsum("qbd,qd->qb", x[beam], x[q])
        while True:
            open_ = np.where(done[rows[:, None], beam] | (sims < -1.5), -3.0, sims)
            best = open_.argmax(1)
            live = np.flatnonzero(open_[rows, best] > -2)
            if not len(live):
                break
            at = beam[live, best[live]]
            done[live, at] = True
            of, place, more = _fan(start, flat, at)
            fresh = ~seen[live[of], more]
            of, place, more = live[of[fresh]], place[fresh], more[fresh]
            seen[of, more] = True
            new, ids = np.full((len(q), place.max(initial=0) + 1), -2.0), np.zeros((len(q), place.max(initial=0) + 1), np.int64)
            new[of, place], ids[of, place] = _dots(x, more, q[of]), more
            beam, sims = np.concatenate([beam, ids], 1), np.concatenate([sims, new], 1)
            top = np.argsort(-sims, axis=1, kind="stable")[:, :BEAM]
            beam, sims = np.take_along_axis(beam, top, 1), np.take_along_axis(sims, top, 1)
        hit = sims >= reach[q][:, None]
        fq, fv = np.nonzero(hit)[0], beam[hit]
        got = np.zeros((len(q), n), bool)
        got[fq, fv] = True
        while len(fq):  # the range, through the neighbours of all that was found in it
            step = np.cumsum(start[fv + 1] - start[fv]) // 2**20
            next_q, next_v = [], []
            for k in np.unique(step):
                part = step == k
                of, _, b = _fan(start, flat, fv[part])
                key = np.unique(fq[part][of] * n + b)
                a, b = key // n, key % n
                fresh = ~got[a, b]
                a, b = a[fresh], b[fresh]
                ok = _dots(x, q[a], b) >= reach[q[a]]
                got[a[ok], b[ok]] = True
                next_q.append(a[ok])
                next_v.append(b[ok])
            fq, fv = np.concatenate(next_q), np.concatenate(next_v)
        a, b = np.nonzero(got)
        pairs_q.append(q[a])
        pairs_v.append(b)
    return np.concatenate(pairs_q), np.concatenate(pairs_v)


def _search(limit: float):  # noqa: ANN202
    def run(t: pd.DataFrame) -> pd.DataFrame:
        ids, x, radius = t["ball"].to_numpy(), _matrix(t["unit"]), t["radius"].to_numpy()
        place = {b: k for k, b in enumerate(ids.tolist())}
        lists = [[place[b] for b in ([] if a is None else a) if b in place] for a in t["near"]]
        # neighbours from other shards are found, and passed through, but not asked for
        asked = np.flatnonzero(t["member"].to_numpy(bool)) if "member" in t else None
        a, b = search(x, lists, radius, limit, asked)
        two, a, b = a != b, ids[a], ids[b]
        return pd.DataFrame({"a": np.minimum(a, b)[two], "b": np.maximum(a, b)[two]}).drop_duplicates()

    return run


def _pairs(limit: float):  # noqa: ANN202
    """Exact comparison of two blocks of leaders, or of one with itself."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        one, two = t[t["block"] == t["i"]], t[t["block"] == t["j"]]
        ids, x, y = [one["ball"].to_numpy(), two["ball"].to_numpy()], _matrix(one["unit"]), _matrix(two["unit"])
        found = [np.empty((0, 2), np.int64)]
        for i in range(0, len(x) if len(y) else 0, 1024):
            reach = np.cos(np.minimum(limit + one["radius"].to_numpy()[i : i + 1024, None] + two["radius"].to_numpy(), math.pi))
            a, b = np.nonzero(x[i : i + 1024] @ y.T >= reach - 1e-12)
            found.append(np.stack([ids[0][i + a], ids[1][b]], 1))
        ends = np.sort(np.concatenate(found), axis=1)
        ends = ends[ends[:, 0] < ends[:, 1]]
        return pd.DataFrame({"a": ends[:, 0], "b": ends[:, 1]}).drop_duplicates()

    return run


def compared(leaders: DataFrame, limit: float) -> DataFrame:
    """(a, b): all pairs of leaders within the limit, radii allowed for; every pair of blocks is a group."""
    m = max(1, -(-leaders.count() // BLOCK))
    k = leaders.select("ball", "unit", "radius", F.pmod(F.xxhash64("ball"), F.lit(m)).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))).alias("other"))
    k = k.select("ball", "unit", "radius", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return k.groupBy("i", "j").applyInPandas(_pairs(limit), "a long, b long").distinct()


def _cosine(x: str, y: str):  # noqa: ANN202
    """The cosine of two double arrays, in double precision."""
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    return dot(F.col(x), F.col(y)) / F.sqrt(dot(F.col(x), F.col(x)) * dot(F.col(y), F.col(y)))


def _between(limit: float, cosine: float):  # noqa: ANN202
    """Of two balls: how many vectors of the other each member links with."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        one, two = t[t["first"]], t[~t["first"]]
        x, y = _matrix(one["v"]), _matrix(two["v"])
        nx, ny = np.einsum("nd,nd->n", x, x), np.einsum("nd,nd->n", y, y)
        rows, cols = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
        for i in range(0, len(x), 1024):
            link = (x[i : i + 1024] @ y.T) / np.sqrt(nx[i : i + 1024, None] * ny) >= cosine
            rows[i : i + 1024] = link @ two["weight"].to_numpy(np.int64)
            cols += one["weight"].to_numpy(np.int64)[i : i + 1024] @ link
        out = pd.DataFrame({"a": t["a"].iloc[0], "b": t["b"].iloc[0], "row": pd.concat([one["row"], two["row"]]), "more": np.concatenate([rows, cols])})
        return out[out["more"] > 0]

    return run


def _nearest(shared, width: int, count: int):  # noqa: ANN001, ANN202
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x = b.column("unit").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width)
            s = x @ shared.value.T
            top = np.argsort(-s, axis=1, kind="stable")[:, : min(count, s.shape[1])]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(list(top), pa.list_(pa.int64()))], names=["row", "shards"])

    return run


def _by_pivots(key: tuple, members: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
    """A block of a shard's leaders at their OVERLAP nearest pivots."""
    x, p = _matrix(members["unit"]), pivots.sort_values("pivot")
    if not len(x) or not len(p):
        return pd.DataFrame({"ball": members["ball"], "shard": members["shard"]})
    top = np.argsort(-(x @ _matrix(p["unit"]).T), axis=1, kind="stable")[:, :OVERLAP]
    names = np.array([f"{key[0]}/{k}" for k in p["pivot"]], object)
    return pd.DataFrame({"ball": np.repeat(members["ball"].to_numpy(), top.shape[1]), "shard": names[top.ravel()]})


def small_shards(homes: DataFrame, leaders: DataFrame) -> DataFrame:
    """homes (ball, shard) with each shard of more than MOST leaders dealt to pivots, one for SHARD leaders, drawn by hash.

    Pivots and members meet in blocks of members. What is still larger after DEALS rounds is dealt by hash.
    """
    for deal in range(DEALS + 1):
        big = homes.groupBy("shard").agg(F.count("*").alias("c")).where(F.col("c") > MOST)
        big = cut(big.select("shard", F.ceil(F.col("c") / SHARD).alias("k"), F.ceil(F.col("c") / BLOCK).alias("blocks")), "vector-big")
        if not big.limit(1).count():
            return homes
        mine = homes.join(big, "shard").withColumn("block", F.pmod(F.xxhash64("ball"), F.col("blocks")))
        rest = homes.join(big, "shard", "left_anti").select("ball", "shard")
        if deal == DEALS:
            return cut(rest.unionByName(mine.select("ball", F.concat_ws("#", "shard", F.col("block").cast("string")).alias("shard"))), "vector-homes")
        rank = F.row_number().over(W.partitionBy("shard").orderBy(F.xxhash64("ball", F.lit(deal))))
        pivots = mine.withColumn("pivot", rank).where("pivot <= k").join(leaders.select("ball", "unit"), "ball")
        pivots = cut(pivots.select("shard", "pivot", "unit", "blocks"), "vector-pivots")
        pivots = pivots.select("shard", "pivot", "unit", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
        members = mine.join(leaders.select("ball", "unit"), "ball").select("ball", "shard", "block", "unit")
        dealt = members.groupBy("shard", "block").cogroup(pivots.groupBy("shard", "block")).applyInPandas(_by_pivots, "ball long, shard string")
        homes = cut(rest.unionByName(dealt.distinct()), "vector-homes")
    return homes


def dedup(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of df."""
    v = F.transform(F.col(f"`{embedding}`"), lambda c: c.cast("double"))
    raw = df.select(F.col(f"`{vec_id}`").alias("vec_id"), v.alias("v"))
    odd = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c))
    fine = F.coalesce(F.col("v").isNotNull() & ~odd & (norm > 0) & (norm < float("inf")), F.lit(False))
    unit = F.when(fine, F.transform("v", lambda c: c / norm))
    raw = cut(raw.select("vec_id", "v", unit.alias("unit"), F.coalesce(F.when(fine, F.size("v")), F.lit(0)).alias("d"), F.monotonically_increasing_id().alias("row")), "vectors")
    lengths = cut(raw.where("d > 0").groupBy("d").agg(F.count("*").alias("n")), "vector-lengths")
    # a run for the commonest length and for each of more than RARE vectors; the others in one job
    common = {r["d"]: r["n"] for r in lengths.orderBy(F.desc("n"), "d").limit(1).collect() + lengths.where(F.col("n") > RARE).collect()}
    rare = lengths.where((F.col("n") <= RARE) & ~F.col("d").isin(list(common))).select("d")
    out = raw.where("d = 0").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    out = out.unionByName(_of_rare_lengths(raw.join(rare, "d"), cosine))
    for d, n in sorted(common.items()):
        out = out.unionByName(_of_one_length(raw.where(F.col("d") == d).drop("d"), d, n, cosine))
    return out


def _links_within(cosine: float):  # noqa: ANN202
    """Of all vectors of one length: each one's links and the smallest row that it reaches."""

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("row")
        x, row = _matrix(t["v"]), t["row"].to_numpy()
        norm = np.einsum("nd,nd->n", x, x)
        link = (x @ x.T) / np.sqrt(norm[:, None] * norm) >= cosine
        np.fill_diagonal(link, True)
        at, before = np.arange(len(x)), None
        while before is None or (at != before).any():
            before = at
            at = np.where(link, at, len(x)).min(1)
            at = at[at]
        return pd.DataFrame({"row": row, "n_links": link.sum(1) - 1, "component": row[at]})

    return run


def _of_rare_lengths(good: DataFrame, cosine: float) -> DataFrame:
    """The result for lengths of at most RARE vectors each, however many lengths there are: a group a length, compared exactly."""
    found = good.select("d", "row", "v").groupBy("d").applyInPandas(_links_within(cosine), "row long, n_links long, component long")
    rows = cut(good.select("row", "vec_id").join(found, "row"), "vector-rare")
    least = rows.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    return rows.join(least, "component").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _of_one_length(good: DataFrame, width: int, n: int, cosine: float) -> DataFrame:
    spark, limit = good.sparkSession, math.acos(cosine)
    points = cut(good.groupBy("v").agg(F.min("row").alias("row"), F.count("*").alias("weight"), F.first("unit").alias("unit")), "vector-points")
    drawn = points.select("unit", F.xxhash64("row").alias("h")).orderBy("h").limit(FIT).toArrow()
    c = centroids(drawn.column("unit").combine_chunks().flatten().to_numpy().reshape(drawn.num_rows, width), max(1, min(CENTROIDS, drawn.num_rows, n // SHARD)))
    del drawn
    shared = spark.sparkContext.broadcast(c)

    sizes = cut(points.select("row", "unit").mapInArrow(_nearest(shared, width, 1), "row long, shards array<long>").select("row", F.col("shards")[0].alias("shard")), "vector-shards")
    salts = sizes.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK).alias("salts"))
    blocks = sizes.join(salts, "shard").select("row", "shard", F.pmod(F.xxhash64("row"), F.col("salts")).alias("salt")).join(points.select("row", "unit"), "row")
    members = blocks.groupBy("shard", "salt").applyInPandas(_balls(limit), "row long, ball long, radius double")
    members = cut(members.join(points.select("row", "weight"), "row"), "vector-balls")
    balls = members.groupBy("ball").agg(F.sum("weight").alias("size"), F.count("*").alias("points"), F.max("radius").alias("radius"))
    leaders = cut(balls.join(points.select(F.col("row").alias("ball"), "unit", "v"), "ball"), "vector-leaders")
    discard(sizes)

    overlap, exact = OVERLAP, False
    while True:
        found = compared(leaders, limit) if exact else _found(leaders, shared, width, overlap, limit)
        ends = [leaders.select(F.col("ball").alias(s), F.col("v").alias(f"v_{s}"), F.col("radius").alias(f"r_{s}"), F.col("size").alias(f"size_{s}"), F.col("points").alias(f"points_{s}")) for s in "ab"]
        near = found.join(ends[0], "a").join(ends[1], "b").withColumn("cos", _cosine("v_a", "v_b"))
        phi = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), "cos")))
        single = (F.col("points_a") == 1) & (F.col("points_b") == 1)
        slack = F.col("r_a") + F.col("r_b")
        sure = F.when(single, F.col("cos") >= cosine).otherwise(phi + slack <= limit - 1e-9)
        maybe = ~single & ~sure & (phi - slack <= limit + 1e-9)
        near = cut(near.select("a", "b", "size_a", "size_b", sure.alias("sure"), maybe.alias("maybe")).where("sure OR maybe"), "vector-near")
        unsure = near.where("maybe").select("a", "b")
        side = lambda s: unsure.join(members.select("row", "weight", F.col("ball").alias(s)), s).select("a", "b", "row", "weight", F.lit(s == "a").alias("first"))
        both = side("a").unionByName(side("b")).join(points.select("row", "v"), "row")
        checked = cut(both.groupBy("a", "b").applyInPandas(_between(limit, cosine), "a long, b long, row long, more long"), "vector-checked")
        yes = near.where("sure")
        per_ball = yes.select(F.col("a").alias("ball"), F.col("size_b").alias("c")).unionAll(yes.select("b", "size_a")).groupBy("ball").agg(F.sum("c").alias("c"))
        per_row = checked.groupBy("row").agg(F.sum("more").alias("more"))
        links_of = members.join(balls.select("ball", "size"), "ball").join(per_ball, "ball", "left").join(per_row, "row", "left").select(
            "row", "ball", (F.col("size") - 1 + F.coalesce("c", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n_links")
        )
        links_of = cut(links_of, "vector-links")
        if exact or recall(good, links_of, cosine) >= MIN_RECALL:
            break
        discard(near, checked, links_of)
        exact = overlap >= len(c)
        overlap = min(2 * overlap, len(c))

    edges = yes.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(checked.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
    group = components(edges)
    at = links_of.join(group.select(F.col("node").alias("ball"), "component"), "ball", "left").select("row", "n_links", F.coalesce("component", "ball").alias("component"))
    at = cut(at.join(points.select("row", "v"), "row").drop("row"), "vector-at")
    rows = cut(good.select("v", "vec_id").join(at, "v").drop("v"), "vector-rows")
    least = cut(rows.groupBy("component").agg(F.min("vec_id").alias("component_id")), "vector-least")
    discard(points, members, leaders, near, checked, links_of, at)
    return rows.join(least, "component").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _found(leaders: DataFrame, shared, width: int, overlap: int, limit: float) -> DataFrame:  # noqa: ANN001
    """(a, b): pairs of leaders that the united graph's search finds within the limit, radii allowed for."""
    homes = leaders.select(F.col("ball").alias("row"), "unit").mapInArrow(_nearest(shared, width, overlap), "row long, shards array<long>")
    homes = cut(homes.select(F.col("row").alias("ball"), F.explode(F.col("shards").cast("array<string>")).alias("shard")), "vector-homes")
    homes = small_shards(homes, leaders)
    placed = homes.join(leaders.select("ball", "unit", "radius"), "ball")
    lists = placed.groupBy("shard").applyInPandas(lambda t: _build(t), "ball long, near array<long>")
    united = cut(lists.groupBy("ball").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near")), "vector-graph")
    # a shard's leaders, and the neighbours that they have in other shards
    beside = homes.join(united, "ball").select("shard", F.explode("near").alias("ball")).distinct().join(homes, ["shard", "ball"], "left_anti")
    nodes = homes.select("shard", "ball", F.lit(True).alias("member")).unionByName(beside.select("shard", "ball", F.lit(False).alias("member")))
    nodes = nodes.join(leaders.select("ball", "unit", "radius"), "ball").join(united, "ball", "left")
    return nodes.groupBy("shard").applyInPandas(_search(limit), "a long, b long").distinct()


def recall(good: DataFrame, links_of: DataFrame, cosine: float = COSINE, queries: int = AUDIT) -> float:
    """The mean, over some leaders with links, of the share of their links that was found; brute force over all rows in blocks.

    Leaders are drawn by hash, so that a group of very many near copies counts as its few balls. Half
    are drawn from those with links found, so that there is something to miss. The share of queries
    with a missed link is logged.
    """
    drawn = good.select("row", "v", "unit").join(links_of.where("row = ball").select("row", "n_links"), "row").withColumn("h", F.xxhash64("row", F.lit(7)))
    picked = drawn.where("n_links > 0").orderBy("h").limit(queries // 2).collect() + drawn.orderBy("h").limit(queries // 2).collect()
    picked = list({r["row"]: r for r in picked}.values())
    q = good.sparkSession.sparkContext.broadcast(np.array([r["unit"] for r in picked]))

    def counts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(q.value), np.int64)
        for b in it:
            if b.num_rows:
                x = np.array(b.column("unit").values).reshape(b.num_rows, -1)
                total += (q.value @ x.T >= cosine).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["k", "n"])

    got = good.select("unit").mapInArrow(counts, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    real = {r["k"]: r["n"] - 1 for r in got}
    shares = [min(r["n_links"], real[k]) / real[k] for k, r in enumerate(picked) if real[k] > 0]
    if not shares:
        return 1.0
    mean = sum(shares) / len(shares)
    LOG.info("recall %.4f over %d leaders, %.4f of them with a missed link", mean, len(shares), sum(x < 1 for x in shares) / len(shares))
    return mean


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "embeddings"))


QUERIES = {"op2_embedding_near_dedup": op2_embedding_near_dedup}
#: All pairs by their cosine, and reachability by a recursive union.
ORACLE_SQL = {
    "op2_embedding_near_dedup": """
WITH RECURSIVE e AS (SELECT vec_id, list_transform(embedding, lambda c: c::DOUBLE) AS v FROM embeddings),
ok AS (
  SELECT * FROM e WHERE v IS NOT NULL AND len(list_filter(v, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_sum(list_transform(v, lambda c: c * c)) > 0),
link AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM ok x JOIN ok y ON len(x.v) = len(y.v) AND x.vec_id <> y.vec_id
  WHERE list_inner_product(x.v, y.v) / sqrt(list_inner_product(x.v, x.v) * list_inner_product(y.v, y.v)) >= 0.95),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
least_of AS (SELECT a, min(b) AS low FROM reach GROUP BY a), n AS (SELECT a, count(*) AS c FROM link GROUP BY a)
SELECT e.vec_id, coalesce(n.c, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(low, e.vec_id)) AS component_id, e.vec_id <= coalesce(low, e.vec_id) AS kept
FROM e LEFT JOIN least_of l ON l.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id"""
}
