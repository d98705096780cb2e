"""op6 of the fourth round: which pieces its indexes take, and that what they leave out is found all the same."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from plumbline.llm import suffix_dedup as S
from test_suffix_dedup import brute


class Noted(S.RunLengthIndex):
    """An index that notes the bytes it takes."""

    taken: list = []

    def __init__(self, pieces, docs):
        Noted.taken.append(sum(map(len, pieces)))
        super().__init__(pieces, docs)


@pytest.fixture
def taken(monkeypatch):
    monkeypatch.setattr(S, "RunLengthIndex", Noted)
    Noted.taken = []
    return Noted.taken


def sent(block, *pieces):
    """What a block sends: (key, document, bytes) a piece."""
    keys, docs, data = zip(*pieces, strict=True)
    return (0, block, np.array(docs, "<i8").tobytes(), np.array(keys, "<u4").tobytes(), np.array([len(x) for x in data], "<u2").tobytes(), b"".join(data))


def index(*rows):
    return S._index(pd.DataFrame(rows, columns=["shard", "block", "least", "keys", "lengths", "data"]))


def test_equal_pieces_and_chance_meetings_of_minimizers_take_no_index(taken):
    r = random.Random(3)
    some = lambda n: bytes(r.choice(b"abcdefgh ") for _ in range(n))
    same, seed = some(80), some(16)
    got = index(sent(0, (1, 10, same), (2, 10, some(30) + seed + some(30))), sent(1, (1, 20, same), (2, 20, some(30) + seed + some(30))))
    assert not taken
    assert got.block.tolist() == [1]
    assert np.unpackbits(np.frombuffer(got.bits[0], np.uint8))[:58].tolist() == [1] * 31 + [0] * 27


def test_pieces_that_share_a_part_meet_in_an_index(taken):
    r = random.Random(4)
    some = lambda n: bytes(r.choice(b"abcdefgh ") for _ in range(n))
    part = some(60)
    got = index(sent(0, (2, 10, some(9) + part)), sent(1, (2, 20, part + some(7))))
    assert len(taken) <= 1
    assert np.unpackbits(np.frombuffer(got.bits[0], np.uint8))[:18].tolist() == [1] * 11 + [0] * 7


def without_spark(rows, block_rows, shards):
    """dedup's steps 2 to 4 with every piece flagged."""
    blocks = []
    for a in range(0, len(rows), block_rows):
        data = [(t or "").encode() for _, t in rows[a : a + block_rows]]
        blocks.append(pa.RecordBatch.from_pylist([{"block": a, "ids": [d for d, _ in rows[a : a + block_rows]], "sizes": [len(x) for x in data], "data": b"".join(data)}]))
    x = [S.Block(*(b.column(c)[0].as_py() for c in ("ids", "sizes", "data"))) for b in blocks]
    p = [b.pieces(np.ones(len(b.hash), bool), shards) for b in x]
    parts = {}
    for k, (b, q) in enumerate(zip(x, p, strict=True)):
        for s, a, z in zip(q.shards, q.bounds, q.bounds[1:]):  # noqa: B905
            pieces = [((int(b.hash[i]) // shards) & 0xFFFFFFFF, d, b.data[b.start[i] : b.start[i] + b.count[i] + 49]) for i, d in zip(q.one[a:z].tolist(), q.least[a:z].tolist(), strict=True)]
            parts.setdefault(s, []).append(sent(k, *pieces))
    bits = [{} for _ in x]
    for s, of in parts.items():
        for k, found in zip(*[index(*of)[c] for c in ("block", "bits")], strict=True):
            bits[k][s] = found
    return [(b, S._marked(b, q, m)) for b, q, m in zip(x, p, bits, strict=True)]


@pytest.mark.parametrize("seed", range(6))
def test_near_copies_runs_and_boilerplate_against_all_strings(monkeypatch, seed):
    """Edges of one boilerplate, near copies and runs of one letter, over indexes of a few pieces."""
    monkeypatch.setattr(S, "INDEX_BYTES", 400)
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    line, rows = prose(25), []
    for i in range(60):
        t = prose(r.randint(0, 40)) + r.choice([line, line[:70], line[20:], "=" * r.randint(40, 160), "ab" * r.randint(20, 90)]) + prose(r.randint(0, 5))
        if rows and r.random() < 0.4:
            t = r.choice(rows)[1]
            at = r.randint(0, len(t))
            t = t[:at] + r.choice(["", "x", prose(3)]) + t[at:]
        rows.append((r.choice([i, i, None, 7]), t))
    r.shuffle(rows)
    got = []
    for b, gone in without_spark(rows, 13, 3):
        for d, a, z in zip(b.ids.tolist(), (b.ends - b.sizes).tolist(), b.ends.tolist(), strict=True):
            got.append((None if d == S.LAST else d, z - a, int(gone[a:z].sum())))
    assert sorted(got, key=str) == sorted([x[:3] for x in brute(rows)], key=str)


def test_rows_that_blocks_send():
    """A row a block and shard: twelve times the blocks of 0.5 GB may not send 144 times its rows of a few pieces."""
    n = 10_000
    hash_shards, shards = S.shards(n)
    assert n * shards <= 10_000_000
    assert n * hash_shards <= 2_000_000


def test_blocks_are_read_a_few_at_a_time(spark, monkeypatch):
    """A reader holds a row group of blocks, 1 MB each, at once: with all of a file's it ran out of memory on 5 GB."""
    groups, cut = [], S.cut

    def noted(df, name, **kw):
        out = cut(df, name, **kw)
        if name == "suffix-blocks":
            for f in out.inputFiles():
                m = pq.ParquetFile(f.removeprefix("file://")).metadata
                groups.extend(m.row_group(k).num_rows for k in range(m.num_row_groups))
        return out

    monkeypatch.setattr(S, "cut", noted)
    rows = spark.range(60, numPartitions=1).selectExpr("id AS doc_id", "repeat(md5(string(id)), 20) AS text")
    assert S.dedup(rows, block_bytes=700).count() == 60
    assert sum(groups) == 60
    assert max(groups) <= 8
