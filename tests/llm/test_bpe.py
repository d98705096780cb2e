"""The encoder against the tokenizers library and against merging by rank, and exact round trips."""

from __future__ import annotations

import hashlib
import json
import random

import numpy as np
import pytest
from plumbline.llm import bpe
from pyspark.sql import functions as F
from tokenizers import Tokenizer

TEXTS = [
    "", " ", "  \n\t x", "Hello, world's  end", "a" * 5000, "naïve café — 日本語 😀😀", "<|endoftext|>", "x<|endoftext|> y<|endoftext|><|endoftext|>", "<|endoftext|",
    "\x1c\x1d\x1e\x1f \x85   　x", "tab\tsep\r\n\r\n", "1234567890" * 30, "!!!???***" * 50, "é̂ ½ ² Ⅷ", "​‍﻿", "don't WE'LL we'll 'S",
]


@pytest.fixture(scope="module")
def enc():
    return bpe.Encoder(bpe.Vocabulary(json.load(open(bpe.default_path(), encoding="utf-8"))))


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(bpe.default_path())


def random_texts(n, seed=3):
    r = random.Random(seed)
    pools = ["abcdefghij etaoin", "  \n\t\x0b\x1c ", "éèüßñç", "0123456789.,-", "日本語😀́", "THEtheing '", "<|endoftext|>"]
    for _ in range(n):
        pool = "".join(r.sample(pools, r.randint(1, 4)))
        yield "".join(r.choice(pool) for _ in range(r.randint(1, 60)))


def test_same_ids_as_the_library(enc, lib):
    for t in [*TEXTS, *random_texts(3000)]:
        got = enc.encode(t)
        want = lib.encode(t, add_special_tokens=False).ids
        assert got == want, repr(t)
        assert enc.decode(np.array(got, np.int64)) == lib.decode(want, skip_special_tokens=False)


def test_every_character_splits_as_in_the_library(enc, lib):
    chars = [chr(c) for c in [*range(0x3000), *range(0xFE00, 0x10000), *range(0x1F000, 0x1F700)] if not 0xD800 <= c < 0xE000]
    for c in chars:
        t = f"a {c} {c}1{c}\n"
        assert enc.encode(t) == lib.encode(t, add_special_tokens=False).ids, hex(ord(c))


def test_merging_by_rank_gives_the_same(enc):
    def merged(data):
        parts = [enc.v.byte_id[b] for b in data]
        while True:
            best = min(((enc.v.merges[p][0], i) for i, p in enumerate(zip(parts, parts[1:])) if p in enc.v.merges), default=None)
            if best is None:
                return parts
            i = best[1]
            parts[i : i + 2] = [enc.v.merges[parts[i], parts[i + 1]][1]]

    r = random.Random(1)
    for _ in range(3000):
        data = bytes(r.choice(b"aeionstrh the") for _ in range(r.randint(1, 40)))
        assert enc.pretoken(data) == merged(data), data


def test_rows(spark, lib):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, None), (3, "same"), (3, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    got = bpe.digests(df).collect()
    assert len(got) == len(rows)
    for (i, t), r in zip(rows, sorted(got, key=lambda r: 0), strict=True):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert (r.doc_id, r.n_tokens) == (i, len(ids))
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    full = bpe.encode(df).select("row.text", "decoded").collect()
    assert all((r.text or "") == r.decoded for r in full)
    assert bpe.digests(df.limit(0)).count() == 0
