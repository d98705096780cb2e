"""Removed bytes against a table of all 50-byte strings."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from plumbline.llm import suffix_dedup
from pyspark.sql import functions as F


def brute(rows, length=50):
    key = lambda d: 2**63 - 1 if d is None else d
    least = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            least[s] = min(key(d), least.get(s, key(d)))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if least[b[i : i + length]] < key(d):
                gone[i : i + length] = b"\x01" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def made(seed, n=150):
    r = random.Random(seed)
    words = ["alpha", "beta", "é", "日本", "gamma", "x", "the", "of", "delta"]
    passages = [" ".join(r.choice(words) for _ in range(r.randint(9, 60))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(r.randint(0, 5)):
            parts.append(r.choice(passages) if r.random() < 0.4 else " ".join(f"{r.choice(words)}{r.randint(0, 999)}" for _ in range(r.randint(1, 30))))
        t = "|".join(parts)
        if rows and r.random() < 0.2:
            t = r.choice(rows)[1] or ""
            cut_at = r.randint(0, len(t))
            t = t[:cut_at] + r.choice(["", "!", "zz"]) + t[cut_at:]
        rows.append((i, t))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [900, 1 << 20])
def test_against_all_strings(spark, block):
    rows = made(4) + [(None, "q" * 120), (500, "a" * 49), (501, "a" * 50), (502, "a" * 300), (503, None), (504, ""), (2, "same id " * 20), (2, "same id " * 20), (505, "same id " * 9)]
    rows += [(None, made(4)[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit("clash")).repartition(3)
    got = sorted([tuple(x) for x in suffix_dedup.dedup(df, block_bytes=block).collect()], key=str)
    assert got == brute(rows)


def test_empty(spark):
    assert suffix_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def longest(text, at, pieces):
    best = 0
    for p in pieces:
        while best < len(text) - at and text[at : at + best + 1] in p:
            best += 1
    return best


@pytest.mark.parametrize("seed", range(4))
def test_matching_statistics_against_all_substrings(seed):
    """Texts that the index doesn't hold, over small and large alphabets, with zero bytes."""
    r = random.Random(seed)
    letters = [b"ab", b"\0\1ab", bytes(range(256)), b"abcdefgh"][seed]
    make = lambda n: bytes(r.choice(letters) for _ in range(n))
    base = make(400)
    cut_out = lambda: base[(a := r.randrange(300)) : a + r.randint(1, 100)]
    pieces = list(dict.fromkeys([make(r.randint(1, 30)) + cut_out() for _ in range(40)] + [b"a" * 84, b"a" * 60, b"ab" * 40]))
    docs = np.arange(len(pieces), 0, -1).astype(np.int64)
    index = suffix_dedup.RunLengthIndex(pieces, docs)
    texts = [cut_out() + make(r.randint(0, 9)) + cut_out() for _ in range(25)] + [b"", b"z", b"a" * 84, pieces[3]]
    offsets, lengths, rows = index.statistics(texts)
    least = index.earliest(lengths, rows)
    for k, t in enumerate(texts):
        got = lengths[offsets[k] : offsets[k + 1]].tolist()
        assert got == [longest(t, i, pieces) for i in range(len(t))]
        for i, n in enumerate(got):
            holders = [d for p, d in zip(pieces, docs.tolist(), strict=True) if t[i : i + 50] in p]
            assert least[offsets[k] + i] == (min(holders) if n >= 50 else suffix_dedup.LAST)


def test_suffix_array():
    r = random.Random(1)
    for n in (1, 5, 40, 300):
        for top in (1, 2, 256):
            x = np.array([r.randint(0, top) for _ in range(n)], np.int16)
            sa, _ = suffix_dedup.suffix_array(x)
            assert sa.tolist() == sorted(range(n), key=lambda i: x[i:].tolist())


def test_one_very_long_text_at_the_real_block_size(spark):
    r = random.Random(6)
    long = "".join(r.choice("abcdefghij klmnop") for _ in range(1_300_000))
    rows = [(1, long), (2, "start " + long[5_000:9_000] + " middle " + long[1_200_000:1_200_060]), (3, long[700_000:700_050])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_removed, x.n_spans) for x in suffix_dedup.dedup(df).collect()}
    assert got == {1: (0, 0), 2: (4060, 2), 3: (50, 1)}
