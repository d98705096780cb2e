"""Packing documents into sequences by cutting-stock column generation.

A document's ids are cut into full sequences and a rest shorter than one. The histogram of the rests (at most one entry a
length) is all that the driver sees:

1. Two rests that fill a sequence exactly are paired.
2. What is left is a cutting-stock problem: patterns (how many rests of each length stand in a sequence), each
   at the cost of its padded size. The linear program over patterns is solved by the revised simplex method; its dual values price
   lengths, and an unbounded knapsack over the capacity finds for each length the best pattern with it, so that new columns
   come in portions. It ends when nothing improves, when nothing is padded any more, or after PIVOTS steps; each state is a feasible packing.
3. Multiplicities are rounded down. Patterns that would be padded are given up.
4. Rests are ranked by length: a task numbers its own of each length, and per length and task the numbers before
   it are summed. A rank says by arithmetic which sequence and which offset a rest gets.
5. Rests of the smallest ranks that no pattern took are laid end to end and cut at the sequences' ends; the last, shorter stretch
   is cut at powers of two. So nothing is padded, and few rests are cut.

Ids come from the tokenizer's library. A text's words (between ASCII white space) have the same ids alone as in their text, as the tokenizer drops
white space and none of its steps looks across it; so a task keeps the ids of WORDS words at most.

Defined cases: a null text is empty, and an empty text is the end id alone. A null id is an id like others, rows that
repeat are documents of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import cut, table, take_columns

LENGTH = 2048
END_ID = 1
#: A task keeps the ids of so many words at most, none longer than so many bytes.
WORDS, WORD_BYTES = 1_000_000, 64
#: Steps of the simplex method; columns that one pricing may add.
PIVOTS, PORTION = 4000, 200
#: How far prices are drawn towards the lengths; the next if nothing is found.
PULLS = (0.9, 0.5, 0.0)
#: A column comes in if it saves so many tokens.
GAIN = 1e-6
#: A table of so many rests at most is sent to all tasks.
SENT = 200_000


# ------------------------------------------------------------------ cutting stock


def padded(n: int, length: int = LENGTH) -> int:
    """Size of a sequence of n ids: a power of two stays, others are padded to the full length."""
    return n if n & (n - 1) == 0 else length


def first_patterns(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray, float]]]:
    """(place of the length that it uses up, (rows, counts, multiplicity)): patterns for the longest length that is left.

    As many of that length as fit, completed exactly by one or two other lengths, those of which most is left, if
    any do; fewer of it if none do.
    """
    place = {int(s): i for i, s in enumerate(lengths)}
    left = np.zeros(capacity + 1)
    left[lengths] = demand

    def complete(s: int) -> list[int]:
        for k in range(capacity // s, 0, -1):
            rest = capacity - k * s
            if rest == 0:
                return [s] * k
            if left[rest] and rest < s:
                return [s] * k + [rest]
            one = np.minimum(left[1:rest], left[rest - 1 : 0 : -1])
            one[s - 1 :] = 0
            if rest > 1 and one.max() > 0:
                a = int(np.argmax(one)) + 1
                return [s] * k + [a, rest - a]
        return [s] * (capacity // s)

    for s in map(int, lengths[::-1]):
        while left[s] > 0:
            items, counts = np.unique(complete(s), return_counts=True)
            x = left[items] / counts
            end = s if left[s] / counts[items == s][0] <= x.min() else int(items[np.argmin(x)])
            most = float(x.min())
            left[items] -= most * counts
            left[end] = 0.0
            left[left < 1e-9] = 0.0
            yield place[end], (np.array([place[int(i)] for i in items]), counts.astype(float), most)


class Master:
    """The linear program: least padded size of patterns that hold each length as often as it is there."""

    def __init__(self, lengths: np.ndarray, demand: np.ndarray, capacity: int) -> None:
        self.lengths, self.capacity, self.pivots = lengths, capacity, 0
        taken = dict(first_patterns(lengths, demand, capacity))
        k = range(len(lengths))
        # a length that none used up stands for itself, so that the columns make a triangle
        self.columns = [taken[i][:2] if i in taken else (np.array([i]), np.array([capacity // lengths[i]], float)) for i in k]
        self.x = np.array([taken[i][2] if i in taken else 0.0 for i in k])
        self.cost = np.array([float(padded(int(lengths[rows] @ counts), capacity)) for rows, counts in self.columns])
        basis = np.zeros((len(lengths), len(lengths)))
        for i, (rows, counts) in enumerate(self.columns):
            basis[rows, i] = counts
        self.inverse = np.linalg.inv(basis)
        self.refresh()

    def enter(self, rows: np.ndarray, counts: np.ndarray, cost: float) -> bool:
        """Bring a column into the basis, if it still saves anything."""
        saved = self.dual[rows] @ counts - cost
        if saved <= GAIN:
            return False
        d = self.inverse[:, rows] @ counts
        up = np.flatnonzero(d > 1e-9)
        if not len(up):
            return False
        ratio = self.x[up] / d[up]
        r = int(up[np.argmin(ratio)])
        step = self.x[r] / d[r]
        self.x -= step * d
        np.maximum(self.x, 0, out=self.x)
        self.x[r] = step
        pivot = self.inverse[r] / d[r]
        some, at = np.flatnonzero(np.abs(d) > 1e-12), np.flatnonzero(pivot)
        self.inverse[np.ix_(some, at)] -= np.outer(d[some], pivot[at])
        self.inverse[r] = pivot
        self.columns[r], self.cost[r] = (rows, counts), cost
        self.dual -= saved * pivot
        self.pivots += 1
        if self.pivots % 200 == 0:
            self.refresh()
        return True

    def refresh(self) -> None:
        """Dual values from the inverse again, without what steps have summed up in errors."""
        self.dual = self.cost @ self.inverse

    def price(self, pull: float) -> list[tuple[np.ndarray, np.ndarray, float]]:
        """Patterns that save most: the knapsack's best for the full length and the powers of two, and the best with each length.

        Prices are drawn towards the lengths themselves, a dual solution without padding: a pattern that
        saves by such prices saves more by the dual values.
        """
        cap = self.capacity
        best, last = np.full(cap + 1, -np.inf), np.zeros(cap + 1, np.int64)
        best[0] = 0.0
        order = np.argsort(self.lengths)
        lengths = self.lengths[order]
        dual = pull * lengths + (1 - pull) * self.dual[order]
        upto = np.searchsorted(lengths, np.arange(cap + 1), side="right")
        for c in range(1, cap + 1):
            if k := upto[c]:
                v = best[c - lengths[:k]] + dual[:k]
                j = int(np.argmax(v))
                best[c], last[c] = v[j], j
        powers = [1 << k for k in range(cap.bit_length()) if 1 << k < cap]
        ends = [(best[c] - c, c, -1) for c in powers]
        # at most the full length, whatever of it stays empty
        fill = np.maximum.accumulate(best)
        where = np.maximum.accumulate(np.where(best >= fill, np.arange(cap + 1), 0))
        ends.append((fill[cap] - cap, int(where[cap]), -1))
        rest = cap - lengths
        ends += list(zip((dual + fill[rest] - cap).tolist(), where[rest].tolist(), range(len(lengths)), strict=True))
        found, seen = [], set()
        for gain, c, with_one in sorted(ends, key=lambda e: (-e[0], e[1], e[2]))[:PORTION]:
            if gain <= GAIN or not np.isfinite(gain):
                break
            items = [with_one] if with_one >= 0 else []
            while c > 0:
                items.append(int(last[c]))
                c -= int(lengths[last[c]])
            rows, counts = np.unique(order[items], return_counts=True)
            key = (rows.tobytes(), counts.tobytes())
            if key not in seen:
                seen.add(key)
                found.append((rows, counts.astype(float), float(padded(int(self.lengths[rows] @ counts), cap))))
        return found

    def solve(self) -> None:
        tokens = float(self.lengths @ self.demand())
        while self.pivots < PIVOTS and self.cost @ self.x > tokens * (1 + 1e-9):
            # several of a portion may still save when their turn comes
            if not any(sum([self.enter(*c) for c in self.price(pull)]) for pull in PULLS):
                break

    def demand(self) -> np.ndarray:
        out = np.zeros(len(self.lengths))
        for (rows, counts), x in zip(self.columns, self.x, strict=True):
            out[rows] += counts * x
        return out


def patterns(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, dict[int, int]]]:
    """(copies, {length: count}) of unpadded sequences, within the histogram of lengths up to ``length``."""
    left = {s: n for s, n in histogram.items() if n > 0}
    out: list[tuple[int, dict[int, int]]] = []

    def use(copies: int, items: dict[int, int]) -> None:
        if copies:
            out.append((copies, items))
            for s, k in items.items():
                left[s] -= copies * k

    for s in sorted(left):
        if s == length:
            use(left[s], {s: 1})
        elif 2 * s < length and left.get(length - s):
            use(min(left[s], left[length - s]), {s: 1, length - s: 1})
        elif 2 * s == length:
            use(left[s] // 2, {s: 2})
    lengths = np.array(sorted(s for s, n in left.items() if n), np.int64)
    if len(lengths):
        lp = Master(lengths, np.array([left[s] for s in lengths.tolist()], float), length)
        lp.solve()
        for r in np.argsort(-lp.x, kind="stable"):
            rows, counts = lp.columns[r]
            items = {int(lengths[i]): int(k) for i, k in zip(rows, counts, strict=True)}
            n = sum(s * k for s, k in items.items())
            if padded(n, length) == n:
                use(max(0, min([int(lp.x[r] + 1e-7), *(left[s] // k for s, k in items.items())])), items)
    return out


class Plan:
    """Where each rank of each length stands. Ranks below ``loose`` of a length are laid end to end and cut."""

    def __init__(self, histogram: dict[int, int], length: int = LENGTH) -> None:
        self.length = length
        taken = patterns(histogram, length)
        used: dict[int, int] = {}
        for copies, items in taken:
            for s, k in items.items():
                used[s] = used.get(s, 0) + copies * k
        self.loose = {s: n - used.get(s, 0) for s, n in histogram.items() if n > used.get(s, 0)}
        slots, nexts, sequence = [], dict(self.loose), 0
        for copies, items in taken:
            offset = 0
            for s, k in sorted(items.items(), reverse=True):
                rank = nexts.get(s, 0)
                slots.append((s, rank, sequence, k, offset))
                nexts[s] = rank + copies * k
                offset += s * k
            sequence += copies
        slots.sort()
        self.slots = np.array(slots, np.int64).reshape(-1, 5)
        self.first_loose, self.places, at = sequence, {}, 0
        for s in sorted(self.loose, reverse=True):
            self.places[s] = at
            at += s * self.loose[s]
        full, tail = divmod(at, length)
        # starts of the sequences in which the loose rests lie, and the end
        self.tail = [full * length]
        for k in range(length.bit_length(), -1, -1):
            if tail >> k & 1:
                self.tail.append(self.tail[-1] + (1 << k))

    def whole(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of rests that a pattern took."""
        mine = self.slots[:, 0] * (1 << 42) + self.slots[:, 1]
        s, rank, sequence, k, offset = self.slots[np.searchsorted(mine, lengths * (1 << 42) + ranks, side="right") - 1].T
        i = ranks - rank
        return sequence + i // k, offset + i % k * s

    def cuts(self, size: int, rank: int) -> Iterator[tuple[int, int, int, int]]:
        """(start in the rest, length, sequence, offset) of a loose rest's pieces."""
        at = self.places[size] + rank * size
        end, start = at + size, 0
        while at < end:
            if at < self.tail[0]:
                k, offset = divmod(at, self.length)
                stop = (k + 1) * self.length
            else:
                j = int(np.searchsorted(self.tail, at, side="right")) - 1
                k, offset, stop = self.tail[0] // self.length + j, at - self.tail[j], self.tail[j + 1]
            n = min(stop, end) - at
            yield start, n, self.first_loose + k, offset
            at, start = at + n, start + n


# ------------------------------------------------------------------ ids


#: A word of Latin letters, each one code point in normal form, and ASCII punctuation after it: two pre-tokens at most, whatever stands around them.
_SIMPLE = re.compile(r"([a-zA-Z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([!-&(-/:-@\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from code point 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Words:
    """Ids of texts as little-endian 32-bit bytes, by a bounded store of words.

    Simple words go straight to the tokenizer's merges, in lower case; all others through the whole tokenizer.
    """

    def __init__(self, text: str, end_id: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(text)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.end, self.known = np.uint32(end_id).astype("<u4").tobytes(), {}

    def _merged(self, word: bytes) -> bytes:
        """Ids of one pre-token."""
        if (got := self.known.get(word)) is None:
            got = self.known[word] = np.array([x.id for x in self.model.tokenize(word.decode("latin-1").translate(self.letters))], "<u4").tobytes()
        return got

    def _learn(self, words: set[bytes]) -> None:
        others = []
        for w in words:
            if (m := _SIMPLE.fullmatch(w.decode())) and b"<|" not in w:
                got = self._merged(m[1].lower().encode())
                self.known[w] = got + self._merged(m[2].encode()) if m[2] else got
            else:
                others.append(w)
        if others:
            coded = self.tokenizer.encode_batch_fast([w.decode() for w in others], add_special_tokens=False)
            self.known.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(others, coded, strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out = []
        for t in texts:
            ws = (t or "").encode().split()  # bytes part at ASCII white space only
            ids = list(map(self.known.get, ws))
            if None in ids:
                fresh = {w for w, i in zip(ws, ids, strict=True) if i is None}
                if len(self.known) + 2 * len(fresh) > WORDS:
                    self.known, fresh = {}, set(ws)
                self._learn(fresh)
                ids = list(map(self.known.__getitem__, ws))
                for w in fresh:
                    if len(w) > WORD_BYTES:
                        del self.known[w]
            out.append(b"".join(ids) + self.end)
        return out


_STORES: dict[int, Words] = {}


def vocabulary_text(path: str | None = None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def pieces(df: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Full sequences and rests of df's texts: (doc_id, doc_tokens, start, length, crc, part, no, ids).

    part, no: the task and its running number among its pieces of that length. ids (bytes) for rests only.
    """
    vocabulary = df.sparkSession.sparkContext.broadcast(vocabulary_text(path))
    flat = take_columns(df, doc_id=doc_id, text=text)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash((vocabulary.value, end_id))
        if key not in _STORES:
            _STORES.clear()
            _STORES[key] = Words(vocabulary.value, end_id)
        store, part, counts = _STORES[key], TaskContext.get().partitionId(), [0] * (length + 1)
        for b in it:
            rows, at = [], []
            for i, ids in enumerate(store.encode(b.column("text").to_pylist())):
                n = len(ids) // 4
                for start in range(0, n, length):
                    own = ids[4 * start : 4 * (start + length)]
                    size = len(own) // 4
                    rows.append((n, start, size, zlib.crc32(own), part, counts[size], own if size < length else None))
                    at.append(i)
                    counts[size] += 1
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            names = ["doc_id", "doc_tokens", "start", "length", "crc", "part", "no", "ids"]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=names)

    kind = flat.select("doc_id").schema.add("doc_tokens", "long").add("start", "long").add("length", "integer").add("crc", "long").add("part", "integer").add("no", "long").add("ids", "binary")
    return flat.mapInArrow(batches, kind)


# ------------------------------------------------------------------ the operator


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _placed(plan: Plan):  # noqa: ANN202
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            size, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            sequence, offset = plan.whole(size, rank)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array(size), b.column("crc"), b.column("doc_tokens"), pa.array(sequence), pa.array(offset)], names=_NAMES)

    return run


def _laid(plan: Plan):  # noqa: ANN202
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows, at = [], []
            for i, (size, rank, start, n, ids) in enumerate(zip(*(b.column(c).to_pylist() for c in ("length", "rank", "start", "doc_tokens", "ids")), strict=True)):
                for s, k, sequence, offset in plan.cuts(size, rank):
                    rows.append((start + s, k, zlib.crc32(ids[4 * s : 4 * (s + k)]), n, sequence, offset))
                    at.append(i)
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int64())), *[pa.array(c, pa.int64()) for c in cols]], names=_NAMES)

    return run


def pack(df: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) per piece of df's rows. length: a power of two."""
    found = cut(pieces(df, doc_id, text, path, length, end_id), "packing-pieces")
    counts = cut(found.groupBy("length", "part").agg(F.count("*").alias("n")), "packing-counts")
    sums = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most a row a length
    plan = Plan({r["length"]: r["n"] for r in sums}, length)

    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    before = cut(counts.select("length", "part", before.alias("before")), "packing-ranks")
    spark = df.sparkSession
    loose = F.broadcast(spark.createDataFrame([(s, n) for s, n in plan.loose.items()], "length int, loose long"))  # at most a row a length
    kind = found.select("doc_id").schema
    for c in _NAMES[1:]:
        kind = kind.add(c, "long")

    ranked = found.drop("ids").join(before, ["length", "part"]).withColumn("rank", F.col("no") + F.col("before"))
    firm = ranked.join(loose, "length", "left").where(F.col("rank") >= F.coalesce("loose", F.lit(0)))
    firm = firm.select("doc_id", "start", "length", "crc", "doc_tokens", "rank").mapInArrow(_placed(plan), kind)

    # rests of the smallest ranks lie in the first tasks, so that few rows bring their ids along
    few = before.join(loose, "length").where("before < loose")
    few = F.broadcast(few) if sum(plan.loose.values()) <= SENT else few
    rests = found.join(few, ["length", "part"]).withColumn("rank", F.col("no") + F.col("before")).where("rank < loose")
    rests = rests.select("doc_id", "start", "length", "doc_tokens", "rank", "ids").mapInArrow(_laid(plan), kind)
    return firm.unionByName(rests)


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op12_packing": op12_packing}
ORACLE_SQL: dict[str, str] = {}
