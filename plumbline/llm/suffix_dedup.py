"""Suffix-array dedup: removing bytes of long strings that an earlier document also holds.

Texts are cut into blocks of whole documents. Every LENGTH-byte string has a minimizer,
its smallest hashed SEED-byte part, so equal strings meet where their minimizers go:

1. Each block sends its minimizers' hashes once; those in two documents or more are
   flagged, in the block itself or where the hashes of all blocks meet.
2. Around flagged minimizers each block sends the pieces of text whose strings all have
   that minimizer, equal pieces once, with the smallest document that holds them.
3. Each shard of pieces gets a run-length index: the Burrows-Wheeler transform of its
   pieces, kept as runs with the suffix array sampled at run heads and ends, and the smallest document
   of each interval of suffixes that agree in LENGTH bytes. Pieces stream through it from
   right to left, a run step a byte; where a byte leaves its run, the match goes on from the nearer
   run's sample, as far as both texts agree. This gives every place's longest match with the
   indexed text and a suffix that shows it (matching statistics). A string is repeated where that
   match is LENGTH bytes or more and an earlier document is in its interval. Of pieces with one minimizer
   the last document's need no index, and the first document's need not be streamed; a minimizer's only
   piece needs neither, as equal pieces are one. Other pieces are first cut down to strings whose LONG-byte
   minimizers two documents hold. A shard makes an index for every INDEX_BYTES of its pieces.
4. Blocks mark those strings, and those of equal pieces in their own later documents,
   and keep the other bytes.

A text moves to no other machine as a whole but with its block; a passage in
very many documents is one piece per block. Blocks send pieces and get back one bit a
string.

Defined cases: a null text counts as empty. A null id is larger than all others;
rows with equal ids don't remove each other's bytes. An empty table gives an empty
result. Texts under LENGTH bytes are kept whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import cut, table

LENGTH, SEED, LONG = 50, 16, 32
WINDOW = LENGTH - SEED + 1
BLOCK_BYTES = 1 << 20
#: Blocks whose hashes, and whose pieces, meet in one shard on average. A block sends a row to each shard: fewer blocks a shard are more rows a block.
BLOCKS_A_HASH_SHARD, BLOCKS_A_PIECE_SHARD = 64, 12
#: Blocks in a row group of their files, all of which a reader holds at once.
BLOCKS_A_GROUP = 8
#: Bytes of pieces that one index takes; it always takes all pieces of a minimizer.
INDEX_BYTES = 2 << 20
LAST = np.iinfo(np.int64).max
#: Strings whose minimizers are looked for at a time.
STRETCH = 1 << 14

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


# -- blocks ---------------------------------------------------------------------------------------


def _block_batches(most: int):  # noqa: ANN202
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        ids, sizes, data, held = [], [], [], 0

        def made() -> pa.RecordBatch:
            nonlocal ids, sizes, data, held, count
            block = (part << 32) + count
            row = [pa.array([block]), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([b"".join(data)], pa.binary())]
            ids, sizes, data, held, count = [], [], [], 0, count + 1
            return pa.RecordBatch.from_arrays(row, names=["block", "ids", "sizes", "data"])

        for b in it:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()), strict=True):
                t = t.as_py() or b""
                if ids and held + len(t) > most:
                    yield made()
                ids.append(i)
                sizes.append(len(t))
                data.append(t)
                held += len(t)
        if ids:
            yield made()

    return run


def _minima(data: bytes, seed: int = SEED) -> np.ndarray:
    """Of each LENGTH-byte string the smallest hash of its seed-byte parts (SEED or LONG), its place's low six bits below it; in stretches that stay in a core's cache."""
    b = np.frombuffer(data, np.uint8)
    eight = np.ndarray((len(b) - 7,), np.dtype("<u8"), b, strides=(1,))
    out, window = np.empty(len(b) - LENGTH + 1, np.uint64), LENGTH - seed + 1
    for a in range(0, len(out), STRETCH):
        n = min(STRETCH, len(out) - a) + window - 1
        h = _mixed(eight[a : a + n + seed - SEED], eight[a + 8 : a + 8 + n + seed - SEED])
        if seed > SEED:
            h = _mixed(h[:-SEED], h[SEED:])
        h &= ~np.uint64(63)
        h |= np.arange(a, a + n, dtype=np.uint64) & np.uint64(63)
        width = 1
        while 2 * width <= window:
            h = np.minimum(h[: len(h) - width], h[width:])
            width *= 2
        np.minimum(h[: len(h) - (window - width)], h[window - width :], out=out[a : a + n - window + 1])
    return out


def _mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    h = x * _M1
    h ^= y * _M2
    h ^= h >> np.uint64(32)
    h *= _M1
    h ^= h >> np.uint64(29)
    return h


class Block:
    """A block's documents and the pieces of their strings that share a minimizer."""

    def __init__(self, ids: list, sizes: list, data: bytes):
        self.ids = np.array([LAST if i is None else i for i in ids], np.int64)
        self.sizes = np.array(sizes, np.int64)
        self.ends = np.cumsum(self.sizes)
        self.data = data
        n = len(data)
        self.doc = self.start = self.count = self.id = np.empty(0, np.int64)
        self.hash = np.empty(0, np.uint64)
        if n < LENGTH:
            return
        m = _minima(data)
        new = np.ones(len(m), bool)
        # the low six bits tell places of one hash apart that one window reaches
        np.not_equal(m[1:], m[:-1], out=new[1:])
        # strings are named by their first byte's place; none crosses the end of a document
        edges = np.concatenate([self.ends - self.sizes, self.ends - LENGTH + 1])
        new[edges[(edges >= 0) & (edges < len(m))]] = True
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(m)))
        doc = np.searchsorted(self.ends, first, side="right")
        good = first + LENGTH <= self.ends[doc]
        self.start, self.count, self.doc = first[good], count[good], doc[good]
        self.hash = m[self.start] >> np.uint64(6)
        self.id = self.ids[self.doc]

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct hashes, sorted, and which of them two documents of the block or more hold."""
        if not len(self.hash):
            return self.hash, np.empty(0, bool)
        order = np.argsort(self.hash)
        h, ids = self.hash[order], self.ids[self.doc[order]]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        return h[first], np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)

    def flagged(self, shards: int, masks: dict[int, bytes]) -> np.ndarray:
        """Whether each piece's minimizer is in two documents or more, here or (by the masks) anywhere."""
        h, flags = self.hashes()
        if not len(h):
            return np.empty(0, bool)
        shard = (h % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        bounds = np.concatenate(([0], np.cumsum(np.bincount(shard, minlength=shards)))).tolist()
        for s, mask in masks.items():
            mine = order[bounds[s] : bounds[s + 1]]
            flags[mine] |= np.unpackbits(np.frombuffer(mask, np.uint8))[: len(mine)].astype(bool)
        return flags[np.searchsorted(h, self.hash)]

    def pieces(self, flagged: np.ndarray, shards: int) -> Pieces:
        """The flagged pieces by shard, equal ones told."""
        which = np.flatnonzero(flagged)
        shard = (self.hash[which] % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        which, shard = which[order], shard[order]
        # only pieces of one minimizer can be equal
        number = np.arange(len(which))
        _, at, times = np.unique(self.hash[which], return_inverse=True, return_counts=True)
        again = np.flatnonzero(times[at] > 1)
        start, seen = self.start[which[again]], {}
        for j, a, z in zip(again.tolist(), start.tolist(), (start + self.count[which[again]] + LENGTH - 1).tolist(), strict=True):
            number[j] = seen.setdefault(self.data[a:z], j)
        one = np.flatnonzero(number == np.arange(len(which)))
        number = np.searchsorted(one, number)
        least = np.full(len(one), LAST)
        np.minimum.at(least, number, self.id[which])
        shard, first = np.unique(shard[one], return_index=True)
        return Pieces(which, number, which[one], least, shard.tolist(), np.append(first, len(one)).tolist())


class Pieces(NamedTuple):
    """A block's flagged pieces and the distinct ones among them; both in the order of their shards."""

    places: np.ndarray
    #: Of each piece the distinct one that it equals.
    number: np.ndarray
    #: Of each distinct piece a place, and the smallest document that holds it.
    one: np.ndarray
    least: np.ndarray
    #: The shards, and where the distinct pieces of each begin; last, where they end.
    shards: list
    bounds: list


def _blocks(b: pa.RecordBatch) -> Iterator[tuple[int, Block]]:
    for block, ids, sizes, data in zip(*[b.column(c) for c in ("block", "ids", "sizes", "data")], strict=True):
        yield block.as_py(), Block(ids.as_py(), sizes.as_py(), data.as_py())


def _by_shard(x: pa.Scalar, name: str) -> dict[int, bytes]:
    return {r["shard"]: r[name] for r in (x.as_py() or ())}


# -- 1: minimizers --------------------------------------------------------------------------------


def _hash_batches(shards: int):  # noqa: ANN202
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for block, x in _blocks(b):
                h, _ = x.hashes()
                shard = (h % np.uint64(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                short = ((h // np.uint64(shards)) & np.uint64(0xFFFFFFFF)).astype("<u4")[order]
                present, first = np.unique(shard[order], return_index=True)
                parts = [p.tobytes() for p in np.split(short, first[1:])] if len(present) else []
                yield pa.RecordBatch.from_arrays([pa.array(present, pa.int64()), pa.array([block] * len(present), pa.int64()), pa.array(parts, pa.binary())], names=["shard", "block", "hashes"])

    return run


def _flag(t: pd.DataFrame) -> pd.DataFrame:
    """Of one shard: per block one bit a hash, set if another block sent the hash too."""
    sent = [np.frombuffer(x, "<u4") for x in t["hashes"]]
    h = np.concatenate(sent)
    _, at, count = np.unique(h, return_inverse=True, return_counts=True)
    again = count[at] > 1
    parts = np.split(again, np.cumsum([len(x) for x in sent])[:-1])
    kept = [(s, b, np.packbits(p).tobytes()) for s, b, p in zip(t["shard"], t["block"], parts, strict=True) if p.any()]
    return pd.DataFrame(kept, columns=["shard", "block", "mask"])


# -- 2 and 3: pieces and their index --------------------------------------------------------------


def _piece_batches(hash_shards: int, shards: int):  # noqa: ANN202
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for (block, x), masks in zip(_blocks(b), b.column("masks"), strict=True):
                p = x.pieces(x.flagged(hash_shards, _by_shard(masks, "mask")), shards)
                keys = ((x.hash[p.one] // np.uint64(shards)) & np.uint64(0xFFFFFFFF)).astype("<u4")
                size = x.count[p.one] + LENGTH - 1
                data, upto = np.frombuffer(x.data, np.uint8)[_ranges(x.start[p.one], size)], np.concatenate(([0], np.cumsum(size)))
                least, lengths = p.least.astype("<i8"), size.astype("<u2")
                rows = [(s, block, least[a:z].tobytes(), keys[a:z].tobytes(), lengths[a:z].tobytes(), data[upto[a] : upto[z]].tobytes()) for s, a, z in zip(p.shards, p.bounds, p.bounds[1:])]  # noqa: B905
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["shard", "block", "least", "keys", "lengths", "data"])

    return run


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + count[0] - 1, then those of the next."""
    before = np.cumsum(count) - count
    return np.repeat(start - before, count) + np.arange(int(count.sum()))


def suffix_array(symbols: np.ndarray, span: int = 28) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, ranks by the first span symbols); symbols under 512, span 7 times a power of two.

    Prefix doubling from seven symbols a word; only suffixes not yet told apart are sorted again.
    """
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(6, symbols.dtype)]).astype(np.uint64)
    word = padded[:n].copy()
    for k in range(1, 7):
        word = (word << np.uint64(9)) | padded[k : k + n]
    sa = np.argsort(word)
    word = word[sa]
    first = np.append(True, word[1:] != word[:-1])
    rank = np.empty(n, np.int64)
    starts = np.flatnonzero(first)
    rank[sa] = np.repeat(starts, np.diff(np.append(starts, n)))
    open_ = np.flatnonzero(~(first & np.append(first[1:], True)))
    h, early = 7, None
    while len(open_):
        if h == span:
            early = rank.copy()
        at = sa[open_]
        after = at + h
        key = (rank[at] << 32) | np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.argsort(key)
        at, key = at[order], key[order]
        sa[open_] = at
        first = np.append(True, key[1:] != key[:-1])
        starts = np.flatnonzero(first)
        rank[at] = np.repeat(open_[starts], np.diff(np.append(starts, len(at))))
        open_ = open_[~(first & np.append(first[1:], True))]
        h *= 2
    return sa, rank if early is None else early


class RunLengthIndex:
    """The run-compressed Burrows-Wheeler transform of some pieces, each closed by an end mark.

    Runs are ordered by (byte, first row), so that base, the rows before a run in this order, is where
    its first row steps to. head and tail sample the suffix array at a run's first and last row. run and
    interval tell a row's run and interval; only where a byte leaves its run is another one looked for.
    """

    def __init__(self, pieces: list[bytes], docs: np.ndarray):
        text = np.frombuffer(b"\0".join([*pieces, bytes(16)]), np.uint8)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        end = np.cumsum(size + 1) - 1
        n = int(end[-1]) + 1
        symbols = text[:n].astype(np.int16) + np.int16(1)
        symbols[end] = 0
        self.text = np.ndarray((len(text) - 7,), np.dtype("<u8"), text, strides=(1,))
        self.room = np.repeat(end, size + 1) - np.arange(n)
        sa, rank = suffix_array(symbols)

        # intervals of suffixes that agree in LENGTH bytes, with their smallest documents
        same = np.zeros(n, bool)
        long = np.flatnonzero((self.room[sa[1:]] >= LENGTH) & (self.room[sa[:-1]] >= LENGTH)) + 1
        x, y = sa[long], sa[long - 1]
        # ranks of all places by 28 symbols: two of them cover 50
        same[long] = (rank[x] == rank[y]) & (rank[x + LENGTH - 28] == rank[y + LENGTH - 28])
        self.interval = (np.cumsum(~same) - 1).astype(np.int32)
        self.least = np.minimum.reduceat(np.repeat(docs, size + 1)[sa], np.flatnonzero(~same))

        before = symbols[sa - 1]
        start = np.flatnonzero(np.append(True, before[1:] != before[:-1]))
        length = np.diff(np.append(start, n))
        order = np.argsort(before[start], kind="stable")
        self.start, self.length, self.byte = start[order], length[order], before[start][order].astype(np.int64)
        self.key = (self.byte << 40) | self.start
        number = np.empty(len(order), np.int32)
        number[order] = np.arange(len(order), dtype=np.int32)
        self.run = np.repeat(number, length)
        self.base = np.cumsum(self.length) - self.length
        self.head, self.tail = sa[self.start], sa[self.start + self.length - 1]

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many bytes agree from the places a and b on, at most so many, and up to the end of b's piece."""
        out = np.minimum(most, self.room[b])
        todo, k = np.flatnonzero(out > 0), 0
        while len(todo):
            x = self.text[a[todo] + k] ^ self.text[b[todo] + k]
            ended = x != 0
            low = x[ended]
            agree = k + (np.log2((low & (~low + np.uint64(1))).astype(np.float64)) // 8).astype(np.int64)
            out[todo[ended]] = np.minimum(out[todo[ended]], agree)
            k += 8
            todo = todo[~ended]
            todo = todo[out[todo] > k]
        return out

    def statistics(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(offsets, lengths, rows): of each place of the texts the longest match that starts there, and a row of the index that shows it."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        offsets = np.concatenate(([0], np.cumsum(size)))
        symbols = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
        lengths, rows = np.zeros(offsets[-1], np.int64), np.zeros(offsets[-1], np.int64)
        live = np.argsort(-size, kind="stable")
        live = live[size[live] > 0]
        left, last = size[live] - 1, len(self.key) - 1
        row, place, match = (np.zeros(len(live), np.int64) for _ in range(3))
        place += self.head[np.argmin(self.start)]
        while len(live):
            c = symbols[offsets[live] + left]
            j = self.run[row]
            to, place, match = self.base[j] + row - self.start[j], place - 1, match + 1
            out = np.flatnonzero(self.byte[j] != c)
            if len(out):
                up = np.searchsorted(self.key, (c[out] << 40) | row[out], side="right") - 1
                down = np.minimum(up + 1, last)
                here, most = place[out] + 1, match[out] - 1
                has = (up >= 0) & (self.byte[up] == c[out])
                a = np.where(has, self.common(here, self.tail[up], np.where(has, most, 0)), -1)
                has = (up < last) & (self.byte[down] == c[out])
                b = np.where(has, self.common(here, self.head[down], np.where(has, most, 0)), -1)
                upper, best = a >= b, np.maximum(a, b)
                run = np.where(upper, up, down)
                none = best < 0
                to[out] = np.where(none, row[out], self.base[run] + np.where(upper, self.length[run] - 1, 0))
                place[out] = np.where(none, here, np.where(upper, self.tail[run], self.head[run]) - 1)
                match[out] = best + 1
            row = to
            lengths[offsets[live] + left], rows[offsets[live] + left] = match, row
            more = left > 0
            live, left, row, place, match = live[more], left[more] - 1, row[more], place[more], match[more]
        return offsets, lengths, rows

    def earliest(self, lengths: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The smallest document that holds a match of LENGTH bytes or more, LAST where the match is shorter."""
        out, long = np.full(len(rows), LAST), np.flatnonzero(lengths >= LENGTH)
        out[long] = self.least[self.interval[rows[long]]]
        return out


def _parts(of: np.ndarray, size: np.ndarray) -> list[slice]:
    """Stretches of about INDEX_BYTES that keep neighbours of one group together."""
    if not len(of):
        return []
    part = ((np.cumsum(size) - size) // INDEX_BYTES)[np.searchsorted(of, of)]
    bounds = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(of)]
    return [slice(a, z) for a, z in zip(bounds, bounds[1:])]  # noqa: B905


def _span(kind: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the smallest and the largest document of its kind."""
    n = int(kind.max(initial=-1)) + 1
    first, last = np.full(n, LAST), np.full(n, -LAST)
    np.minimum.at(first, kind, low)
    np.maximum.at(last, kind, high)
    return first[kind], last[kind]


def _holders(names: list[bytes], low: np.ndarray, high: np.ndarray, kind: np.ndarray, pare: bool = True) -> np.ndarray:  # noqa: FBT001, FBT002
    """Of each string of distinct pieces the smallest document that holds it, LAST where no two do; low and high are the documents of a piece, equal strings are in pieces of one kind.

    Pieces are cut down to strings whose LONG-byte minimizers are in two documents; parts that then are equal are one.
    """
    count = np.fromiter(map(len, names), np.int64, len(names)) - LENGTH + 1
    at = np.cumsum(count) - count
    # no other piece has the strings of a kind's only piece
    alone = np.bincount(kind, minlength=1)[kind] == 1
    best = np.repeat(np.where(alone, low, LAST), count)
    first, last = _span(kind, low, high)
    use = np.flatnonzero(~alone & (first < last))
    use = use[np.argsort(kind[use], kind="stable")]
    if pare and len(use):
        piece, start, many = _shared([names[i] for i in use], count[use], low[use], high[use])
        number: dict[bytes, int] = {}
        k = np.array([number.setdefault(names[i][a : a + m + LENGTH - 1], len(number)) for i, a, m in zip(use[piece].tolist(), start.tolist(), many.tolist(), strict=True)], np.int64)
        least, most, of = np.full(len(number), LAST), np.full(len(number), -LAST), np.empty(len(number), np.int64)
        np.minimum.at(least, k, low[use[piece]])
        np.maximum.at(most, k, high[use[piece]])
        of[k] = kind[use[piece]]
        size = np.fromiter(map(len, number), np.int64, len(number)) - LENGTH + 1
        found = _holders(list(number), least, most, of, pare=False)
        best[_ranges(at[use[piece]] + start, many)] = found[_ranges((np.cumsum(size) - size)[k], many)]
        return best
    for part in _parts(kind[use], count[use] + LENGTH):
        part = use[part]
        indexed, streamed = part[low[part] < last[part]], part[high[part] > first[part]]
        index = RunLengthIndex([names[i] for i in indexed], low[indexed])
        offsets, lengths, rows = index.statistics([names[i] for i in streamed])
        best[_ranges(at[streamed], count[streamed])] = index.earliest(lengths, rows)[_ranges(offsets[:-1], count[streamed])]
    return best


def _shared(names: list[bytes], count: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, first string, strings) of the stretches of strings whose LONG-byte minimizers two documents hold."""
    m = _minima(b"".join(names), LONG)
    begin = np.cumsum(count + LENGTH - 1) - (count + LENGTH - 1)
    new = np.ones(len(m), bool)
    np.not_equal(m[1:], m[:-1], out=new[1:])
    new[begin] = True
    end = begin + count
    new[end[:-1]] = True
    at = np.flatnonzero(new)
    piece = np.searchsorted(begin, at, side="right") - 1
    many = np.diff(np.append(at, len(m)))
    good = at < end[piece]
    at, piece, many = at[good], piece[good], many[good]
    first, last = _span(np.unique(m[at] >> np.uint64(6), return_inverse=True)[1], low[piece], high[piece])
    two = np.flatnonzero(first < last)
    at, piece, many = at[two], piece[two], many[two]
    joined = np.append(False, (at[1:] == at[:-1] + many[:-1]) & (piece[1:] == piece[:-1]))
    head = np.flatnonzero(~joined[: len(at)])
    return piece[head], (at - begin[piece])[head], np.add.reduceat(many, head) if len(head) else many


def _index(t: pd.DataFrame) -> pd.DataFrame:
    """Of one shard: per block one bit a string of its pieces, set if a smaller document than the piece's own holds it."""
    number: dict[bytes, int] = {}
    sent = []
    for least, keys, lengths, data in zip(t["least"], t["keys"], t["lengths"], t["data"], strict=True):
        ends, at, k = np.cumsum(np.frombuffer(lengths, "<u2")).tolist(), 0, []
        for z in ends:
            k.append(number.setdefault(data[at:z], len(number)))
            at = z
        sent.append((np.array(k, np.int64), np.frombuffer(least, "<i8"), np.frombuffer(keys, "<u4")))
    names, n = list(number), len(number)
    k, doc, key = (np.concatenate([x[i] for x in sent]) for i in range(3))
    low, high = np.full(n, LAST), np.full(n, -LAST)
    np.minimum.at(low, k, doc)
    np.maximum.at(high, k, doc)
    of = np.empty(n, np.int64)
    of[k] = np.unique(key, return_inverse=True)[1]
    best = _holders(names, low, high, of)
    count = np.fromiter(map(len, names), np.int64, n) - LENGTH + 1
    at = np.cumsum(count) - count
    kept = []
    for shard, block, (k, doc, _) in zip(t["shard"], t["block"], sent, strict=True):
        bits = best[_ranges(at[k], count[k])] < np.repeat(doc, count[k])
        if bits.any():
            kept.append((shard, block, np.packbits(bits).tobytes()))
    return pd.DataFrame(kept, columns=["shard", "block", "bits"])


# -- 4: marks -------------------------------------------------------------------------------------


def _marked(x: Block, p: Pieces, bits: dict[int, bytes]) -> np.ndarray:
    """Whether each byte of the block is in a string to remove."""
    n = len(x.data)
    count = x.count[p.one]
    at = np.concatenate(([0], np.cumsum(count)))
    own = np.zeros(at[-1], bool)
    for s, a, z in zip(p.shards, at[p.bounds[:-1]].tolist(), at[p.bounds[1:]].tolist(), strict=True):
        if s in bits:
            own[a:z] = np.unpackbits(np.frombuffer(bits[s], np.uint8))[: z - a]
    count = x.count[p.places]
    gone = own[_ranges(at[p.number], count)] | np.repeat(x.id[p.places] > p.least[p.number], count)
    strings = np.zeros(n + 1, bool)
    strings[_ranges(x.start[p.places], count)[gone]] = True
    upto = np.cumsum(strings)
    covered = upto[:n].copy()
    covered[LENGTH:] -= upto[: max(0, n - LENGTH)]
    return covered > 0


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _mark_batches(hash_shards: int, shards: int, texts: bool):  # noqa: ANN202
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for (_, x), masks, bits in zip(_blocks(b), b.column("masks"), b.column("bits"), strict=True):
                gone = _marked(x, x.pieces(x.flagged(hash_shards, _by_shard(masks, "mask")), shards), _by_shard(bits, "bits"))
                raw, rows, kept_texts = np.frombuffer(x.data, np.uint8), [], []
                for i, a, z in zip(x.ids.tolist(), (x.ends - x.sizes).tolist(), x.ends.tolist(), strict=True):
                    g = gone[a:z]
                    kept = raw[a:z][~g].tobytes()
                    spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum())
                    rows.append((None if i == LAST else i, z - a, int(g.sum()), spans, hashlib.sha256(kept).hexdigest()))
                    if texts:
                        kept_texts.append(kept)
                cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)] + [pa.array([r[4] for r in rows], pa.string())]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if texts:
                    cols, names = [*cols, pa.array(kept_texts, pa.binary())], [*names, "kept"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def shards(blocks: int) -> tuple[int, int]:
    """(shards of hashes, shards of pieces) of so many blocks."""
    return max(16, blocks // BLOCKS_A_HASH_SHARD), max(64, blocks // BLOCKS_A_PIECE_SHARD)


def dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", texts: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row of df; texts adds the kept bytes."""
    spark = df.sparkSession
    flat = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    blocks = cut(flat.mapInArrow(_block_batches(block_bytes), "block long, ids array<long>, sizes array<long>, data binary"), "suffix-blocks", rows_a_group=BLOCKS_A_GROUP)
    n = blocks.select("block").count()
    hash_shards, piece_shards = shards(n)

    sent = blocks.mapInArrow(_hash_batches(hash_shards), "shard long, block long, hashes binary")
    flags = sent.groupBy("shard").applyInPandas(_flag, "shard long, block long, mask binary")
    masks = cut(flags.groupBy("block").agg(F.collect_list(F.struct("shard", "mask")).alias("masks")), "suffix-masks", rows_a_group=16 * BLOCKS_A_GROUP)

    known = blocks.join(masks, "block", "left")
    pieces = known.mapInArrow(_piece_batches(hash_shards, piece_shards), "shard long, block long, least binary, keys binary, lengths binary, data binary")
    found = pieces.groupBy("shard").applyInPandas(_index, "shard long, block long, bits binary")
    bits = cut(found.groupBy("block").agg(F.collect_list(F.struct("shard", "bits")).alias("bits")), "suffix-bits", rows_a_group=16 * BLOCKS_A_GROUP)

    ready = blocks.join(masks.join(bits, "block", "left"), "block", "left")
    return ready.mapInArrow(_mark_batches(hash_shards, piece_shards, texts), OUT + ", kept binary" * texts)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op6_suffix_dedup": op6_suffix_dedup}
ORACLE_SQL: dict[str, str] = {}
