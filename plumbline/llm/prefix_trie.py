"""Prefix trie of conversations by an LCP-aware external mergesort.

A conversation is the sequence of its turns' 128-bit content hashes; texts never travel, only their
byte lengths. LCPs (longest common prefixes) count turns.

1. Runs. A task sorts RUN_BYTES of sequences at a time, by sequence and then id, and writes each run
   front-coded: a row's LCP with the row before it, and only the turns beyond that. A run is cut at range bounds.
2. Merging. A task has the runs of one range and merges them with a loser tree. Each run's head carries its LCP
   with the last row put out: of two heads the one with the longer LCP is smaller without a look at its turns,
   and heads of equal LCP are compared from there on only.
3. Nodes. The merged rows pass a stack of open nodes (the path of the last row). What lies deeper than a
   row's LCP is finished: it is put out, and its sums go to its parent.

Range bounds are rows of the table, ids included, so that any number of equal conversations is split.
Nodes on a bound's path ("edge" nodes, at most two paths a range) can have members in several ranges: their
partial sums are added up by a digest of the path, and their subtrees summed bottom-up, deepest first; all others
are whole within one range. Ids that end at an edge node are written in chunks and hashed as a stream in their order.

Defined cases: a null role or text is empty. Turns of one number (null first) are ordered by content hash, so rows that repeat
are turns that repeat. Rows with a null conv_id belong to no conversation. The table's ids are longs. An empty table has no node.
One conversation's hashes (24 bytes a turn) must fit a task.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import cut, discard, table, take_columns

#: Bytes of a turn's hash.
TURN = 16
#: A run holds at most so many bytes of sequences (and one row at least); a range about as many.
RUN_BYTES = 32 << 20
#: Rows drawn for each range to choose the bounds from.
DRAWN = 8
#: Ids of an edge node's ends are put out in chunks of about so many characters.
CHUNK = 1 << 20

_NO_ENDS = hashlib.sha256(b"").hexdigest()
_ROOT = bytes(16)
_RUN_SCHEMA = "range int, run long, ids array<long>, lcps array<int>, tails array<binary>, sizes array<array<long>>"
_NODE_SCHEMA = (
    "kind int, conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, "
    "key binary, parent_key binary, bytes long, range int, chunk int"
)
_NODE_ARROW = pa.schema(
    [("kind", pa.int32()), ("conv_id", pa.int64()), ("depth", pa.int32()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
     ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.string()), ("key", pa.binary()), ("parent_key", pa.binary()), ("bytes", pa.int64()), ("range", pa.int32()), ("chunk", pa.int32())]
)
NODE, EDGE, ENDS = 0, 1, 2


# ------------------------------------------------------------------ sequences


def sequences(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, seq, sizes): a conversation's turn hashes in order, laid end to end, and its texts' byte lengths."""
    d = take_columns(df, conv_id=conv_id, turn=turn, role=role, text=text).where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    content = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    one = F.struct("turn", F.substring(F.sha2(content, 256), 1, 2 * TURN).alias("hash"), F.octet_length("text").cast("long").alias("size"))
    turns = d.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    return turns.select("conv_id", F.unhex(F.array_join("turns.hash", "")).alias("seq"), F.col("turns.size").alias("sizes"))


def rebuilt(convs: DataFrame, base: Column, head: Column, most: int) -> DataFrame:
    """Sequences with their first turns (head many, at most ``most``) taken from the conversation ``base``, own turns after that."""
    heads = convs.select(F.col("conv_id").alias("base"), F.expr(f"substring(seq, 1, {most * TURN})").alias("b_seq"), F.slice("sizes", 1, most).alias("b_sizes"))
    own = convs.select("conv_id", "seq", "sizes", base.alias("base"), head.cast("int").alias("h")).join(heads, "base", "left")
    none = F.array().cast("array<long>")
    seq = F.concat(F.coalesce(F.expr(f"substring(b_seq, 1, h * {TURN})"), F.lit(b"")), F.expr(f"substring(seq, h * {TURN} + 1)"))
    sizes = F.concat(F.coalesce(F.slice("b_sizes", F.lit(1), F.col("h")), none), F.slice("sizes", F.col("h") + 1, F.greatest(F.size("sizes") - F.col("h"), F.lit(0))))
    return own.select("conv_id", seq.alias("seq"), sizes.alias("sizes"))


# ------------------------------------------------------------------ runs


def lcp(a: bytes, b: bytes, at: int = 0) -> int:
    """Turns that a and b share from the start; the first ``at`` are known to be equal."""
    n = min(len(a), len(b)) // TURN
    while at < n:
        step = min(n - at, 64)
        x, y = a[at * TURN : (at + step) * TURN], b[at * TURN : (at + step) * TURN]
        if x != y:
            return at + int(np.argmax(np.frombuffer(x, np.uint8) != np.frombuffer(y, np.uint8))) // TURN
        at += step
    return at


def _run_batches(bounds: list[tuple[bytes, int]]):  # noqa: ANN202
    """Sorted, front-coded runs, a row for each range that a run meets."""

    def coded(rows: list, run: int) -> Iterator[tuple]:
        rows.sort(key=lambda r: (r[0], r[1]))
        i = 0
        while i < len(rows):
            part = bisect.bisect_right(bounds, (rows[i][0], rows[i][1]))
            end = bisect.bisect_left(rows, bounds[part], lo=i, key=lambda r: (r[0], r[1])) if part < len(bounds) else len(rows)
            ids, lcps, tails, sizes, last = [], [], [], [], b""
            for seq, c, size in rows[i:end]:
                k = lcp(last, seq)
                ids.append(c)
                lcps.append(k)
                tails.append(seq[k * TURN :])
                sizes.append(size[k:])
                last = seq
            yield part, run, ids, lcps, tails, sizes
            i = end

    def batch(rows: list, run: int) -> pa.RecordBatch:
        cols = list(zip(*coded(rows, run), strict=True))
        kinds = (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["range", "run", "ids", "lcps", "tails", "sizes"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, n, task = [], 0, 0, TaskContext.get().partitionId() << 24
        for b in it:
            for seq, c, sizes in zip(b.column("seq").to_pylist(), b.column("conv_id").to_pylist(), b.column("sizes").to_pylist(), strict=True):
                if rows and held + len(seq) > RUN_BYTES:
                    yield batch(rows, task + n)
                    rows, held, n = [], 0, n + 1
                rows.append((seq, c, sizes))
                held += len(seq) + 8
        if rows:
            yield batch(rows, task + n)

    return run


def bounds_of(convs: DataFrame, ranges: int) -> list[tuple[bytes, int]]:
    """At most ranges - 1 rows (seq, conv_id) that cut the table into about equal parts, from DRAWN rows a range."""
    n = convs.count()
    share = min(1.0, DRAWN * ranges / max(1, n))
    drawn = convs.where(F.pmod(F.xxhash64("conv_id", F.lit(17)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))).select("seq", "conv_id").toArrow()
    rows = sorted(zip(map(bytes, drawn["seq"].to_pylist()), drawn["conv_id"].to_pylist(), strict=True))
    return sorted({rows[k * len(rows) // ranges] for k in range(1, ranges)}) if rows else []


# ------------------------------------------------------------------ merging


class _Run:
    """The rows of one run, decoded one at a time. lcp: with the last row that the merge put out."""

    __slots__ = ("at", "ids", "lcp", "lcps", "seq", "sizes", "tails", "turns")

    def __init__(self, ids, lcps, tails, sizes) -> None:  # noqa: ANN001
        self.ids, self.lcps, self.tails, self.sizes = ids, lcps, tails, sizes
        self.at, self.seq, self.lcp, self.turns = -1, b"", 0, []
        self.step()

    def step(self) -> None:
        """On to the next row; its LCP with the row before it is its LCP with what was just put out."""
        self.at += 1
        if self.at < len(self.ids):
            self.lcp = self.lcps[self.at]
            self.seq = self.seq[: self.lcp * TURN] + self.tails[self.at]
            del self.turns[self.lcp :]
            self.turns += self.sizes[self.at]

    @property
    def done(self) -> bool:
        return self.at >= len(self.ids)


def _beats(a: _Run, b: _Run) -> bool:
    """Whether a's head comes before b's; the loser's LCP becomes its LCP with the winner where turns had to be compared."""
    if a.done or b.done:
        return not a.done
    if a.lcp != b.lcp:
        return a.lcp > b.lcp
    k = lcp(a.seq, b.seq, a.lcp)
    at = k * TURN
    x, y = (a.seq[at : at + TURN], a.ids[a.at]), (b.seq[at : at + TURN], b.ids[b.at])
    if x < y:
        b.lcp = k
        return True
    a.lcp = k
    return False


def merged(runs: list[_Run]) -> Iterator[tuple[int, _Run]]:
    """(LCP with the row before, run whose head is the next row) in sorted order."""
    n = len(runs)
    losers: list[int] = [-1] * n  # inner nodes 1 .. n - 1 of the tree; run i is leaf n + i

    def climb(i: int) -> int:
        node = (n + i) // 2
        while node:
            j = losers[node]
            if j < 0:  # first time: wait here for the other subtree
                losers[node] = i
                return -1
            if _beats(runs[j], runs[i]):
                losers[node], i = i, j
            node //= 2
        return i

    best = 0
    for i in range(n):
        best = climb(i)
    while n and not runs[best].done:
        yield runs[best].lcp, runs[best]
        runs[best].step()
        best = climb(best)


class _Open:
    """A node of the open path."""

    __slots__ = ("bytes", "children", "chunk", "depth", "edge", "ends", "key", "least", "n_children", "n_convs", "n_ends", "n_leaves", "saved")

    def __init__(self, depth: int, size: int, edge: bool, key: bytes | None) -> None:  # noqa: FBT001
        self.depth, self.bytes, self.edge, self.key = depth, size, edge, key
        self.least, self.n_convs, self.n_children, self.n_leaves, self.saved = None, 0, 0, 0, 0
        self.ends, self.n_ends, self.chunk, self.children = None, 0, 0, []


def nodes_of(runs: list[_Run], part: int, lower: bytes | None, upper: bytes | None) -> list[tuple]:
    """Rows (as _NODE_SCHEMA) of one range; lower and upper are the sequences of its bounds, None at the table's ends."""
    out: list[list] = []
    low, high = (0 if lower is not None else -1), (0 if upper is not None else -1)
    path = [_Open(0, 0, max(low, high) >= 0, _ROOT)]
    first = True

    def flush(x: _Open) -> None:
        out.append([ENDS, None, None, None, None, None, None, None, ",".join(x.ends), x.key, None, None, part, x.chunk])
        x.ends, x.chunk = [], x.chunk + 1

    def end(x: _Open, c: int) -> None:
        x.n_convs += 1
        x.least = c if x.least is None or c < x.least else x.least
        if x.edge:
            x.ends = x.ends or []
            x.ends.append(str(c))
            if len(x.ends) * 8 >= CHUNK:
                flush(x)
        else:
            if x.ends is None:
                x.ends = hashlib.sha256()
            x.ends.update(b",%d" % c if x.n_ends else b"%d" % c)
        x.n_ends += 1

    def close() -> None:
        x = path.pop()
        up = path[-1] if path else None
        if x.edge:
            if x.ends:
                flush(x)
            out.append([EDGE, x.least, x.depth, None, x.n_convs, x.n_children, x.n_leaves, x.saved, None, x.key, up.key if up else None, x.bytes, part, None])
        else:
            x.n_leaves = x.n_leaves or 1
            x.saved += (x.n_convs - 1) * x.bytes
            for k in x.children:
                out[k][3] = x.least
            out.append([NODE, x.least, x.depth, None, x.n_convs, x.n_children, x.n_leaves, x.saved, x.ends.hexdigest() if x.ends else _NO_ENDS, None, up.key if up and up.edge else None, None, part, None])
        if up:
            up.n_convs += x.n_convs
            up.least = x.least if up.least is None or x.least < up.least else up.least
            if not x.edge:
                up.n_children, up.n_leaves, up.saved = up.n_children + 1, up.n_leaves + x.n_leaves, up.saved + x.saved
                up.children.append(len(out) - 1)

    for k, run in merged(runs):
        while path[-1].depth > k:
            close()
        if lower is not None:
            low = lcp(lower, run.seq) if first else min(low, k)
        if upper is not None:
            high = lcp(upper, run.seq, min(high, k))
        first = False
        for d in range(path[-1].depth + 1, len(run.seq) // TURN + 1):
            edge = d <= max(low, high)
            key = hashlib.blake2b(path[-1].key + run.seq[(d - 1) * TURN : d * TURN], digest_size=16).digest() if edge else None
            path.append(_Open(d, run.turns[d - 1], edge, key))
        end(path[-1], run.ids[run.at])
    while path and not first:
        close()
    return out


def _merge(bounds: list[tuple[bytes, int]]):  # noqa: ANN202
    def run(group: pa.Table) -> pa.Table:
        part = group["range"][0].as_py()
        runs = [_Run(*x) for x in zip(*(group[c].to_pylist() for c in ("ids", "lcps", "tails", "sizes")), strict=True)]
        rows = nodes_of(runs, part, bounds[part - 1][0] if part else None, bounds[part][0] if part < len(bounds) else None)
        cols = list(zip(*rows, strict=True))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _NODE_ARROW, strict=True)], schema=_NODE_ARROW)

    return run


# ------------------------------------------------------------------ edge nodes


def _roll_up(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Subtree sums of the edge nodes, which come deepest first."""
    below: dict[bytes, list[int]] = {}
    for b in it:
        rows = b.to_pylist()
        for r in rows:
            children, leaves, saved = below.pop(r["key"], (0, 0, 0))
            r["n_children"] += children
            r["n_leaves"] += leaves + (r["n_children"] == 0)
            r["saved_tokens"] += saved + (r["n_convs"] - 1) * r["bytes"]
            if r["parent_key"] is not None:
                up = below.setdefault(r["parent_key"], [0, 0, 0])
                for i, v in enumerate((1, r["n_leaves"], r["saved_tokens"])):
                    up[i] += v
        yield pa.RecordBatch.from_pylist(rows, schema=b.schema)


def _hash_ends(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ends_sha256) of chunks in order of key and place; only one hash is open at a time."""
    key, h = None, None
    names = ["key", "ends_sha256"]
    for b in it:
        done = []
        for k, text in zip(b.column("key").to_pylist(), b.column("ends").to_pylist(), strict=True):
            if k != key:
                if h:
                    done.append((key, h.hexdigest()))
                key, h = k, hashlib.sha256(text.encode())
            else:
                h.update(b"," + text.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], names=names)
    if h:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([h.hexdigest()], pa.string())], names=names)


# ------------------------------------------------------------------ the operator


def trie(convs: DataFrame, ranges: int | None = None) -> DataFrame:
    """The trie's nodes of sequences (conv_id, seq, sizes), an id once: a row per distinct sequence of first turns.

    conv_id: smallest member; depth; parent_conv_id (root: null); n_convs; n_children; n_leaves; saved_tokens; ends_sha256.
    """
    spark = convs.sparkSession
    if ranges is None:
        total = convs.agg(F.sum(F.octet_length("seq") + 8)).first()[0] or 0
        ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RUN_BYTES))
    bounds = bounds_of(convs, ranges)
    runs = cut(convs.mapInArrow(_run_batches(bounds), _RUN_SCHEMA), "trie-runs")
    found = cut(runs.groupBy("range").applyInArrow(_merge(bounds), _NODE_SCHEMA), "trie-nodes")
    discard(runs)

    sums = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    parts = found.where(F.col("kind") == EDGE).groupBy("key").agg(
        F.first("parent_key").alias("parent_key"), F.first("depth").alias("depth"), F.first("bytes").alias("bytes"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in sums]
    )
    # two paths a range at most
    edges = parts.repartition(1).sortWithinPartitions(F.desc("depth")).mapInArrow(_roll_up, parts.schema)
    chunks = found.where(F.col("kind") == ENDS).select("key", "range", "chunk", "ends")
    ends = chunks.repartition("key").sortWithinPartitions("key", "range", "chunk").mapInArrow(_hash_ends, "key binary, ends_sha256 string")
    edges = cut(edges.join(ends, "key", "left"), "trie-edges")
    parents = edges.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("p"))

    columns = ("conv_id", "depth", "parent_conv_id", *sums, "ends_sha256")
    whole = found.where(F.col("kind") == NODE).withColumn("ends_sha256", F.col("ends"))
    inner = whole.where("parent_key IS NULL").select(*columns)
    outer = whole.where("parent_key IS NOT NULL").drop("parent_conv_id").join(parents, "parent_key").withColumnRenamed("p", "parent_conv_id").select(*columns)
    edge = edges.join(parents, "parent_key", "left").withColumns({"parent_conv_id": F.col("p"), "ends_sha256": F.coalesce("ends_sha256", F.lit(_NO_ENDS))}).select(*columns)
    return inner.unionByName(outer).unionByName(edge).withColumn("depth", F.col("depth").cast("long"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = cut(sequences(table(spark, sf_dir, "conversations")), "trie-conversations")
    c = F.col("conv_id")
    again = cut(rebuilt(convs, c - c % 5, F.crc32(c.cast("string").cast("binary")) % 9, 8), "trie-rebuilt")
    discard(convs)
    return trie(again)


QUERIES = {"op11_prefix_trie": op11_prefix_trie}
#: Every conversation's prefixes as lists, grouped; sums over a subtree by all prefixes of a node's list.
ORACLE_SQL = {
    "op11_prefix_trie": r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, sha256(concat(strlen(role)::VARCHAR, ':', role, text))) AS turns FROM t GROUP BY conv_id),
h AS (
  SELECT conv_id, turns, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)), 4294967295::BIGINT) % 9 AS h
  FROM own),
again AS (
  SELECT a.conv_id, list_concat(coalesce(b.turns, [])[1:a.h], a.turns[a.h + 1:]) AS turns FROM h a LEFT JOIN h b ON b.conv_id = a.conv_id - a.conv_id % 5),
prefix AS (SELECT conv_id, turns[1:d] AS path, len(turns) = d AS ends FROM again, unnest(range(0, len(turns) + 1)) AS u(d)),
node AS (
  SELECT path, len(path) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM prefix GROUP BY path),
child AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1),
own_sum AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children, CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * strlen(n.path[n.depth].text) END AS saved FROM node n LEFT JOIN child c ON c.path = n.path),
below AS (
  SELECT path[1:d] AS path, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM own_sum, unnest(range(0, depth + 1)) AS u(d) GROUP BY 1)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, n.n_children::BIGINT AS n_children,
  b.n_leaves::BIGINT AS n_leaves, b.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM own_sum n JOIN below b ON b.path = n.path LEFT JOIN node p ON n.depth > 0 AND p.path = n.path[1:n.depth - 1]"""
}
