"""Embedding whitening from a compensated covariance.

Entries become whole numbers x, so that the sums S of the fit list (each distinct x vector once) and n*x - S are exact.
Centred outer products are accumulated in double-double: each product with its rounding error (Dekker's
product), each sum with its own (Knuth's sum). A task puts out high and low parts, a row of the matrix each;
they are merged in double-double again, in two steps, so that no task gets a whole table's parts. The
covariance is solved where its rows meet, by LAPACK's tridiagonal divide and conquer (syevd), a task a matrix.

Vectors of different lengths are fitted apart. Models (16 components a length at most) are sent to the executors in portions of
at most MODEL_BYTES, as a rule all at once.

Defined cases: a vector that is null or holds a null or non-finite entry gives no row, nor does an empty one. Entries beyond 2**46 in size count as
that. Components without variance (eigenvalue within rounding of 0, as when all vectors are equal) are left out. A sign is
chosen so that a component's largest entry (the first of equal ones) is positive. Rows that repeat each get
their rows; a deviation over the largest long counts as that. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import cut, discard, table, take_columns

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
MODEL_BYTES = 64 << 20
#: Parts of one matrix row are merged in so many groups first.
GROUPS = 64
_MOST = 1 << 52
_LONG = (1 << 63) - 1
#: Elements of a block of products.
_BLOCK = 1 << 18
_SPLIT = float((1 << 27) + 1)


# ------------------------------------------------------------------ double-double


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b and its rounding error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """High and low half of each number's digits."""
    t = a * _SPLIT
    high = t - (t - a)
    return high, a - high


def add(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Sum of two double-double arrays."""
    s, e = two_sum(a[0], b[0])
    return two_sum(s, e + (a[1] + b[1]))


def total(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Double-double sum along the first axis, in pairs."""
    while len(high) > 1:
        odd = (high[-1:], low[-1:]) if len(high) % 2 else None
        k = len(high) // 2
        high, low = add((high[:k], low[:k]), (high[k : 2 * k], low[k : 2 * k]))
        if odd:
            high, low = np.concatenate([high, odd[0]]), np.concatenate([low, odd[1]])
    return high[0], low[0]


class Products:
    """The sum of outer products of rows, upper triangle, in double-double."""

    def __init__(self, d: int) -> None:
        self.high, self.low = np.zeros((d, d)), np.zeros((d, d))

    def add(self, rows: np.ndarray) -> None:
        d = rows.shape[1]
        step = max(1, _BLOCK // d)
        for at in range(0, len(rows), step):
            c = rows[at : at + step]
            h, t = split(c)
            for i in range(d):
                p = c[:, i : i + 1] * c[:, i:]
                hi, ti = h[:, i : i + 1], t[:, i : i + 1]
                e = ((hi * h[:, i:] - p) + hi * t[:, i:] + ti * h[:, i:]) + ti * t[:, i:]
                self.high[i, i:], self.low[i, i:] = add((self.high[i, i:], self.low[i, i:]), total(p, e))


# ------------------------------------------------------------------ whole numbers


def integers(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, dim, x) of the vectors whose entries are all there and finite: x = floor(64 c) + 1000000."""
    d = take_columns(df, vec_id=vec_id, v=embedding).select("vec_id", F.col("v").cast("array<double>").alias("v"))
    # functions of null are null: only whole vectors pass
    d = d.where((F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & (F.abs(F.coalesce(c, F.lit(float("nan")))) < F.lit(float("inf")))))
    most = float(_MOST)
    x = F.transform("v", lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(most)), F.lit(-most))).cast("long") + SHIFT)
    return d.select("vec_id", F.size("v").alias("dim"), x.alias("x"))


def _matrices(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, places in the batch, rows) for each length in the batch."""
    dims = b.column("dim").to_numpy(zero_copy_only=False)
    x = b.column("x")
    flat, starts = x.values.to_numpy(zero_copy_only=False), x.offsets.to_numpy()
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        yield int(d), at, flat[starts[at][:, None] + np.arange(d)]


def _sum_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per length of a task: the number of its vectors and their sums."""
    sums: dict[int, list] = {}
    for b in it:
        for d, _, m in _matrices(b):
            s = sums.setdefault(d, [0, [0] * d])
            s[0] += len(m)
            # in halves, so that no long overflows
            s[1] = [a + (h << 26) + t for a, h, t in zip(s[1], (m >> 26).sum(0).tolist(), (m & (1 << 26) - 1).sum(0).tolist(), strict=True)]
    rows = [(d, n, i, Decimal(v)) for d, (n, s) in sums.items() for i, v in enumerate(s)]
    cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.decimal128(38))
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["dim", "n", "i", "s"])


def fit_sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """{dim: (n, S)} of the fit list; at most as many numbers as half the square of the largest length."""
    parts = fit.mapInArrow(_sum_batches, "dim int, n long, i int, s decimal(38,0)")
    rows = parts.groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s")).orderBy("dim", "i").toArrow()
    out: dict[int, tuple[int, list[int]]] = {}
    for d, n, s in zip(*(rows[c].to_pylist() for c in ("dim", "n", "s")), strict=True):
        out.setdefault(d, (n, []))[1].append(int(s))
    return out


def deviations(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """n*x - S, exact: longs where all fit, else Python's integers."""
    if n * (2 * _MOST) < 1 << 62 or n * max(int(x.max()), -int(x.min())) + max(map(abs, s)) < 1 << 62:
        return x * n - np.array(s, np.int64)
    return x.astype(object) * n - np.array(s, object)


def centred(x: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    return deviations(x, n, s).astype(np.float64) / n


# ------------------------------------------------------------------ covariance


def _product_batches(rows_of):  # noqa: ANN001, ANN202
    """Per length of a task: the rows of its sum of outer products. rows_of(dim, x): the rows to multiply, or None."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, Products] = {}
        for b in it:
            for d, _, m in _matrices(b):
                rows = rows_of(d, m)
                if rows is not None:
                    sums.setdefault(d, Products(rows.shape[1])).add(rows)
        names = ["dim", "i", "task", "high", "low"]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()))
        for d, p in sums.items():
            k = len(p.high)
            cols = ([d] * k, range(k), [TaskContext.get().partitionId() % GROUPS] * k, [p.high[i, i:] for i in range(k)], [p.low[i, i:] for i in range(k)])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return run


def _merge_rows(group: pa.Table) -> pa.Table:
    """One row of a matrix from its parts; their order is fixed, so that reruns agree."""
    high, low = (np.array(group[c].to_pylist()) for c in ("high", "low"))
    order = np.lexsort(np.concatenate([low.T, high.T]))
    h, t = total(high[order], low[order])
    return pa.table([group["dim"][:1], group["i"][:1], group["task"][:1], pa.array([h], pa.list_(pa.float64())), pa.array([t], pa.list_(pa.float64()))], names=["dim", "i", "task", "high", "low"])


def outer_products(fit: DataFrame, rows_of) -> DataFrame:  # noqa: ANN001
    """(dim, i, task, high, low): row i, from the diagonal on, of the sum of outer products over the fit list."""
    kind = "dim int, i int, task int, high array<double>, low array<double>"
    parts = fit.mapInArrow(_product_batches(rows_of), kind)
    return parts.groupBy("dim", "i", "task").applyInArrow(_merge_rows, kind).groupBy("dim", "i").applyInArrow(_merge_rows, kind)


def _whole(group: pa.Table) -> np.ndarray:
    """The symmetric matrix of a group's rows."""
    d = group.num_rows
    m = np.zeros((d, d))
    for i, h, t in zip(group["i"].to_pylist(), group["high"].to_pylist(), group["low"].to_pylist(), strict=True):
        m[i, i:] = np.array(h) + np.array(t)
    return np.triu(m) + np.triu(m, 1).T


def eigen(v: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric matrix, falling, and their unit vectors as rows; none that is 0 within rounding."""
    e, q = np.linalg.eigh(v)  # syevd: tridiagonal form, divide and conquer
    e, q = e[::-1][:most], q[:, ::-1].T[:most]
    some = e > len(v) * np.finfo(float).eps * max(np.trace(v), 0.0)
    e, q = e[some], q[some]
    sign = np.sign(np.take_along_axis(q, np.argmax(np.abs(q) > np.abs(q).max(1, keepdims=True) * (1 - 1e-9), axis=1)[:, None], 1)) if len(q) else 1.0
    return e, q * sign


def _solve(sizes: dict[int, int]):  # noqa: ANN202
    def run(group: pa.Table) -> pa.Table:
        d = group["dim"][0].as_py()
        v = _whole(group) / sizes[d]
        e, q = eigen(v)
        cols = ([d] * len(e), range(1, len(e) + 1), e, [np.trace(v)] * len(e), list(q))
        kinds = (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float64()))
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["dim", "component", "e", "trace", "axis"])

    return run


class Model:
    """What one length's rows need: n, S, axes over the roots of their eigenvalues, explained shares, identity error."""

    def __init__(self, n: int, s: list[int], e: np.ndarray, trace: float, axes: np.ndarray) -> None:
        self.n, self.s, self.explained, self.error = n, s, e / trace, 0.0
        self.axes = axes / np.sqrt(e)[:, None]

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.s) @ self.axes.T


def _portions(sums: dict[int, tuple[int, list[int]]]) -> Iterator[dict[int, tuple[int, list[int]]]]:
    """The lengths in portions whose models are at most MODEL_BYTES (one length at least)."""
    part, size = {}, 0
    for d, x in sorted(sums.items()):
        if part and size + 8 * d * (COMPONENTS + 2) > MODEL_BYTES:
            yield part
            part, size = {}, 0
        part[d], size = x, size + 8 * d * (COMPONENTS + 2)
    if part:
        yield part


def _fit_portion(fit: DataFrame, sums: dict[int, tuple[int, list[int]]]) -> dict[int, Model]:
    products = outer_products(fit, lambda d, x: centred(x, *sums[d]) if d in sums else None)
    solved = products.groupBy("dim").applyInArrow(_solve({d: n for d, (n, _) in sums.items()}), "dim int, component int, e double, trace double, axis array<double>")
    rows = solved.orderBy("dim", "component").toArrow().to_pylist()
    models = {}
    for d in {r["dim"] for r in rows}:
        own = [r for r in rows if r["dim"] == d]
        models[d] = Model(*sums[d], np.array([r["e"] for r in own]), own[0]["trace"], np.array([r["axis"] for r in own]))

    def error(group: pa.Table) -> pa.Table:
        d = group["dim"][0].as_py()
        m = _whole(group) / models[d].n
        return pa.table([pa.array([d], pa.int32()), pa.array([np.abs(m - np.eye(len(m))).max()])], names=["dim", "error"])

    # whitened rows are centred already, as their x are: their mean is 0 within rounding
    again = outer_products(fit, lambda d, x: models[d].whiten(x) if d in models else None)
    for r in again.groupBy("dim").applyInArrow(error, "dim int, error double").collect():
        models[r["dim"]].error = r["error"]
    return models


def _row_batches(models: dict[int, Model]):  # noqa: ANN202
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for d, at, x in _matrices(b):
                m = models.get(d)
                if m is None:
                    continue
                k = len(m.axes)
                dev = deviations(x, m.n, m.s)
                exact = dev.dtype == np.int64 and d * float(np.abs(dev).max()) ** 2 < 2.0**62
                deviation = (dev * dev).sum(1) if exact else [min(sum(int(v) ** 2 for v in row), _LONG) for row in dev]
                each = lambda v: np.repeat(np.asarray(v, np.int64), k)
                cols = [
                    b.column("vec_id").take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(each([m.n] * len(at))), pa.array(each(deviation)),
                    pa.array(m.whiten(x).ravel()), pa.array(np.tile(m.explained, len(at))), pa.array(np.full(k * len(at), m.error)),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) per remaining row of df and component."""
    x = integers(df, vec_id, embedding)
    fit = cut(x.groupBy("dim", "x").agg(F.count("*").alias("rows")).drop("rows"), "whitening-fit")
    kind = x.select("vec_id").schema.add("component", "integer").add("n", "long").add("deviation", "long").add("whitened", "double").add("explained", "double").add("identity_error", "double")
    out = []
    for sums in _portions(fit_sums(fit)):
        out.append(x.mapInArrow(_row_batches(_fit_portion(fit, sums)), kind))
    discard(fit)
    if not out:
        return df.sparkSession.createDataFrame([], kind)
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_whitening": op13_whitening}
ORACLE_SQL: dict[str, str] = {}
