"""Prefix trie, packing and whitening against plain Python."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import struct
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from plumbline.llm import packing, prefix_trie, whitening
from pyspark.sql import functions as F

# ------------------------------------------------------------------ prefix trie


def plain_trie(rows):
    """Nodes by dictionaries of prefixes. rows: (conv_id, turn, role, text)."""
    own = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((t is not None, t or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    again = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        again[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + v[h:]
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, v in again.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
        ends[tuple(v)].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    return {
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items()
    }


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversations(seed, n, ids):
    r = random.Random(seed)
    rows = []
    for c in ids:
        kind = r.random()
        for t in range(r.choice([1, 2, 3, 9, 14])):
            text = "hello" if t == 0 and kind < 0.7 else f"same {t}" if kind < 0.4 else r.choice(["a", "b", "é" * 3, "", None, "x" * 30])
            rows.append((c, r.choice([t, t, t, None]), r.choice(["user", "user", None]), text))
    return rows


@pytest.mark.parametrize("ranges", [1, 2, 7, 40])
def test_prefix_trie_matches_dictionaries(spark, ranges):
    rows = conversations(3, 0, list(range(-12, 140))) + [(None, 1, "user", "no conversation"), (7, 0, "user", "hello"), (7, 0, "user", "hello")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("seq", F.lit("clash")).repartition(5)
    c = F.col("conv_id")
    seqs = prefix_trie.rebuilt(prefix_trie.sequences(df), c - c % 5, F.crc32(c.cast("string").cast("binary")) % 9, 8)
    got = [tuple(x) for x in prefix_trie.trie(seqs, ranges).select(*COLUMNS).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_trie(rows)


def test_prefix_trie_of_equal_conversations_and_none(spark, monkeypatch):
    """One conversation fills the table; its ids come in several chunks and runs."""
    monkeypatch.setattr(prefix_trie, "CHUNK", 64)
    rows = [(5 * c, t, "user", f"turn {t}") for c in range(400) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    seqs = prefix_trie.sequences(df)
    got = prefix_trie.trie(seqs, 6).select(*COLUMNS).orderBy("depth").collect()
    ids = hashlib.sha256(",".join(str(5 * c) for c in range(400)).encode()).hexdigest()
    assert [tuple(g)[:7] for g in got] == [(0, 0, None, 400, 1, 1, 399 * 18), (0, 1, 0, 400, 1, 1, 399 * 18), (0, 2, 0, 400, 1, 1, 399 * 12), (0, 3, 0, 400, 0, 1, 399 * 6)]
    assert got[-1].ends_sha256 == ids and got[0].ends_sha256 == hashlib.sha256(b"").hexdigest()
    assert prefix_trie.trie(seqs.limit(0)).count() == 0


def test_prefix_trie_merges_without_comparing_shared_turns():
    """Runs in a loser tree come out sorted with true LCPs."""
    r = random.Random(5)
    seqs = sorted({(bytes(r.choice([0, 1]) for _ in range(16 * r.randint(0, 3))), i) for i in range(200)})
    runs = []
    for k in range(7):
        own, last, cols = seqs[k::7], b"", ([], [], [], [])
        for s, i in own:
            n = prefix_trie.lcp(last, s)
            for c, v in zip(cols, (i, n, s[16 * n :], [1] * (len(s) // 16 - n)), strict=True):
                c.append(v)
            last = s
        runs.append(prefix_trie._Run(*cols))
    out, last = [], b""
    for n, run in prefix_trie.merged(runs):
        assert n == prefix_trie.lcp(last, run.seq) and len(run.turns) == len(run.seq) // 16
        out.append((run.seq, run.ids[run.at]))
        last = run.seq
    assert out == seqs


def test_prefix_trie_sql_gives_the_same_rows(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet'")
    want = con.execute(f"SELECT {','.join(COLUMNS)} FROM ({prefix_trie.ORACLE_SQL['op11_prefix_trie']})").fetchall()
    got = [tuple(x) for x in prefix_trie.op11_prefix_trie(spark, d).select(*COLUMNS).collect()]
    assert collections.Counter(got) == collections.Counter(want)


# ------------------------------------------------------------------ packing


def encoded(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = encoded.__dict__.setdefault("t", Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


def check_packing(rows, got, length=2048):
    """Every id once, right sums, no gaps; returns (padding, documents cut below full sequences)."""
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for g in got:
        by_doc[g.doc_id].append(g)
        by_seq[g.sequence_id].append(g)
    cuts = 0
    for i, text in rows:
        ids, at = encoded(text), 0
        for g in sorted(by_doc[i], key=lambda g: g.start):
            own = ids[at : at + g.length]
            assert g.start == at and g.doc_tokens == len(ids) and g.length == len(own) > 0
            assert g.ids_crc32 == zlib.crc32(struct.pack(f"<{len(own)}I", *own))
            at += g.length
        assert at == len(ids)
        cuts += len(by_doc[i]) - math.ceil(len(ids) / length)
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for g in sorted(pieces, key=lambda g: g.offset):
            assert g.offset == at
            at += g.length
        assert at <= length
        padding += packing.padded(at, length) - at
    return padding, cuts


def test_words_alone_have_the_ids_that_they_have_in_their_text():
    """Every Latin letter and ASCII sign, letters with marks, and strings of special tokens."""
    r = random.Random(6)
    store = packing.Words(packing.vocabulary_text(), 1)
    letters = [chr(c) for c in (*range(33, 127), *range(0xA0, 0x180), 0x300, 0x308, 0x30A, 0x30C, 0x331, 0x1F0, 0x3A3, 0x130, 0x2028, 0x3000, 0x1F600, 0x1C)]
    texts = ["".join(r.choice(letters if r.random() < 0.5 else letters[32:94]) + r.choice(["", "", "", " ", "\n"]) for _ in range(60)) for _ in range(300)]
    texts += [f"{a}{c} {c.upper()}{a}." for c in letters for a in ("j\u030c", "T\u0308", "it's", "WE'LL,", "<|endoftext|>", "<|ENDOFTEXT|>")]
    for t, ids in zip(texts, store.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == encoded(t), repr(t)


def test_packing(spark):
    r = random.Random(8)
    odd = [None, "", " ", "a\x1cb", "<|endoftext|> a<|startoftext|>b", "ÉÀ ΣΑΣ é ́x ﬁ İ", "a b c\x85d", "x" * 9000, "don't WE'LL 3.14", "語" * 50]
    words = ["the", "Quick", "naïve", "x1y2", "...", "can't", "Straße"]
    texts = odd + ["copy of one text " * 60] * 80 + [" ".join(r.choices(words, k=r.choice([3, 40, 400, 900, 1500, 5000]))) for _ in range(60)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("clash")).repartition(6)
    got = packing.pack(df).collect()
    padding, cuts = check_packing(rows, got)
    assert padding == 0 and cuts < 0.5 * len(rows)
    assert packing.pack(df.limit(0)).count() == 0


def test_packing_takes_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c")] * 5 + [(1, "a b c")] * 3, "doc_id int, text string")
    got = packing.pack(df).collect()
    assert sum(g.length for g in got) == 8 * 4 and sum(g.doc_id is None for g in got) >= 5


def test_patterns_keep_within_the_histogram_and_use_most_of_it():
    r = random.Random(1)
    histogram = dict(collections.Counter(n for n in (int(r.lognormvariate(6, 1)) + 1 for _ in range(60_000)) if n < 2048))
    used = collections.Counter()
    for copies, items in packing.patterns(histogram):
        n = sum(s * k for s, k in items.items())
        assert packing.padded(n) == n and copies > 0
        for s, k in items.items():
            used[s] += copies * k
    assert all(used[s] <= n for s, n in histogram.items())
    assert sum(s * k for s, k in used.items()) > 0.9 * sum(s * n for s, n in histogram.items())


def test_master_finds_the_least_number_of_sequences():
    """Three lengths whose best patterns are known: 9 = 4 + 5, 9 = 3 + 3 + 3."""
    lp = packing.Master(np.array([3, 4, 5]), np.array([9.0, 6.0, 6.0]), 9)
    lp.solve()
    assert lp.cost @ lp.x == pytest.approx(81) and lp.demand() == pytest.approx([9, 6, 6])


# ------------------------------------------------------------------ whitening


def plain_whitening(vectors):
    """Exact covariance by fractions, eigenvectors by numpy."""
    xs = {i: [math.floor(64 * float(c)) + 1000000 for c in v] for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)}
    fit = sorted({tuple(x) for x in xs.values()})
    n, d = len(fit), len(fit[0])
    s = [sum(x[k] for x in fit) for k in range(d)]
    c = [[n * x[k] - s[k] for k in range(d)] for x in fit]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in c), n**3)) for j in range(d)] for i in range(d)])
    e, q = np.linalg.eigh(v)
    return xs, n, s, e[::-1], q[:, ::-1].T, float(np.trace(v))


def test_whitening(spark):
    r = np.random.default_rng(4)
    mix = r.normal(size=(20, 20)) * np.linspace(3, 0.2, 20)
    vectors = [(i, v.tolist()) for i, v in enumerate((r.normal(size=(300, 20)) @ mix).astype(np.float32))]
    vectors += [(1000 + i, vectors[3][1]) for i in range(150)]
    vectors += [(2000, None), (2001, []), (2002, [None] * 20), (2003, [float("nan")] * 20), (2004, [float("inf")] + [0.0] * 19), (None, vectors[5][1])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("dim", F.lit("clash")).repartition(4)
    got = whitening.whiten(df).collect()
    xs, n, s, e, q, trace = plain_whitening([(-1 if i is None else i, v) for i, v in vectors])
    assert len(got) == 16 * len(xs)
    sign = {}
    for g in got:
        x = xs[-1 if g.vec_id is None else g.vec_id]
        k = g.component - 1
        want = float(np.array([Fraction(n * a - b, n) for a, b in zip(x, s, strict=True)], float) @ q[k]) / math.sqrt(e[k])
        if abs(want) > 1e-3:
            sign.setdefault(k, math.copysign(1, want * g.whitened))
        assert g.n == n and g.deviation == sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True))
        assert g.whitened == pytest.approx(sign.get(k, 1) * want, abs=1e-9)
        assert g.explained == pytest.approx(e[k] / trace, rel=1e-10) and g.identity_error < 1e-9


def test_whitening_odd_tables(spark):
    """Lengths apart, equal vectors, huge entries, nothing at all."""
    rows = [(i, [float(i % 7), float(i * i % 11), 1.0]) for i in range(60)] + [(100 + i, [float(i % 5), float(i % 3)]) for i in range(30)] + [(200, [5.0]), (201, [5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.Counter(g.vec_id // 100 for g in whitening.whiten(df).collect())
    assert got == {0: 120, 1: 60}
    huge = spark.createDataFrame([(0, [1e300, 1.0]), (1, [-1e300, 2.0]), (2, [1.0, 3.0])], "vec_id long, embedding array<double>")
    assert {(g.vec_id, g.deviation) for g in whitening.whiten(huge).collect()} == {(0, 2**63 - 1), (1, 2**63 - 1), (2, 128**2 + 192**2)}
    assert whitening.whiten(df.limit(0)).collect() == []


def test_products_are_exact_to_double_double():
    """Sums that cancel: plain sums of doubles lose them."""
    r = np.random.default_rng(2)
    rows = np.concatenate([r.normal(size=(700, 3)) * 1e8, r.normal(size=(700, 3))])
    p = whitening.Products(3)
    p.add(rows)
    for i in range(3):
        for j in range(i, 3):
            exact = sum(Fraction(a) * Fraction(b) for a, b in zip(rows[:, i].tolist(), rows[:, j].tolist(), strict=True))
            assert abs(Fraction(p.high[i, j]) + Fraction(p.low[i, j]) - exact) < Fraction(1, 10**10)


# ------------------------------------------------------------------ spans of long texts


def test_spans_of_a_long_text_take_about_linear_time(spark):
    """40,000 spans in one text; a quadratic walk would take many minutes."""
    import re
    import time

    from plumbline.llm import pii, spans

    text = " ".join(f"mail a{i}@b.org or id X{i:07d} now" for i in range(20_000))
    t = F.col("text")
    d = spark.createDataFrame([(text,)], "text string").select("text", pii.base_spans(t).alias("base"), spans.find(t, pii.TOKEN, "context", 4).alias("wide"))
    d = d.select("text", spans.merged(F.col("base"), spans.outside(F.col("wide"), F.col("base"))).alias("all"))
    began = time.time()
    r = d.select(spans.written(F.col("all")).alias("all"), F.size(spans.pieces(t, F.col("all"))).alias("n"), pii.redacted(t, F.col("all")).alias("out")).first()
    assert time.time() - began < 60
    want = [f"email:{m.start()}:{m.end()}" if "@" in m[0] else f"context:{m.start()}:{m.end()}" for m in re.finditer(r"a\d+@b\.org|X\d{7}", text)]
    assert r.all == ",".join(want) and r.n == 40_001 and r.out == re.sub(r"X\d{7}", "[CONTEXT]", re.sub(r"a\d+@b\.org", "[EMAIL]", text))
