"""Quality rules, mixing, languages, archives and the pipeline against plain Python."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from plumbline.llm import langid, mixing, quality, warc
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def quality_counts(text):
    text = text or ""
    ws = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    wins = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    n = collections.Counter(wins)
    hit = {j for i, w in enumerate(wins) if n[w] > 1 for j in range(i, i + 8)}
    return len(ws), sum(map(len, ws)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_quality_counts(spark):
    r = random.Random(2)
    texts = [None, "", " \n ", "a", "x y " * 40, "é " * 9, "# | <b>\n# | <b>\n\n# | <b>", "w " * 3000]
    texts += ["".join(r.choice(["the", "of", "ab", "é", "*", " ", " ", "\n", "\t", "\x0b"]) for _ in range(r.randint(1, 200))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    got = quality.score(df).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    for g in got:
        want = quality_counts(texts[g.doc_id])
        assert tuple(g)[1:6] == want, repr(texts[g.doc_id])
        assert g.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (g.base_failed and g.kept)
    assert quality.keep(df).columns == df.columns
    assert quality.keep(df).count() == sum(g.kept for g in got)
    assert quality.score(df.limit(0)).count() == 0


def water_level(sizes):
    names = sorted((k for k in sizes if k is not None)) + [None] * (None in sizes)
    w = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [k for k in names if k not in capped]
        rest, weights = total - sum(3 * sizes[k] for k in capped), sum(w[k] for k in free)
        share = {k: w[k] * rest / weights for k in free}
        over = {k for k in free if share[k] > 3 * sizes[k]}
        if not over:
            return share | {k: 3.0 * sizes[k] for k in capped}
        capped |= over


def test_mixing(spark):
    r = random.Random(4)
    rows = [(i, "w " * r.choice([3, 3, 5, 40, 200]), r.choice(["a", "a", "a", "b", "ç", None, "d"])) for i in range(600)]
    rows += [(9000, None, "empty"), (9001, "", "empty"), (None, "a b c", "b"), (7, rows[7][1], rows[7][2]), (7, rows[7][1], rows[7][2]), (9002, "lone word", "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mixing.mix(df).select("row.doc_id", "row.source", F.col("size").alias("n"), "source_size", "target", "copies").collect()
    again = mixing.mix(df.repartition(7)).select("row.doc_id", "row.source", F.col("size").alias("n"), "source_size", "target", "copies").collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want, took = water_level(sizes), collections.Counter()
    for g in got:
        assert g.source_size == sizes[g.source] and g.target == pytest.approx(want[g.source]) and 0 <= g.copies <= 3
        took[g.source] += g.n * g.copies
    assert all(abs(took[s] - want[s]) <= 3 for s in want), (took, want)
    assert mixing.mix(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_fit_reaches_what_can_be_reached(seed):
    r = random.Random(seed)
    counts = {n: r.randint(1, 4) for n in r.sample(range(1, 60), 6)}
    sums = {0}
    for n, c in counts.items():
        sums = {s + n * k for s in sums for k in range(c + 1)}
    budget = r.randint(0, max(sums))
    took = mixing.fit(budget, counts)
    assert all(0 <= took[n] <= counts[n] for n in counts)
    assert abs(sum(n * k for n, k in took.items()) - budget) <= 2 * max(counts)
    whole = mixing.fit(budget, counts, most=0)
    assert all(0 <= whole[n] <= counts[n] for n in counts)


@pytest.mark.parametrize("seed", range(6))
def test_fit_is_as_near_as_the_table_allows(seed):
    """The knapsack against all reachable sums of what proportion leaves."""
    r = random.Random(100 + seed)
    counts = {n: r.randint(1, 5) for n in r.sample(range(3, 90), 7)}
    size = sum(n * c for n, c in counts.items())
    budget = r.randint(1, size - 1)
    base = {n: c * budget // size for n, c in counts.items()}
    sums = {sum(n * k for n, k in base.items())}
    for n, c in counts.items():
        sums = {s + n * k for s in sums for k in range(c - base[n] + 1)}
    took = mixing.fit(budget, counts)
    assert all(base[n] <= took[n] <= counts[n] for n in counts)
    assert abs(sum(n * k for n, k in took.items()) - budget) == min(abs(s - budget) for s in sums)


def test_fit_favours_no_length():
    """3,000 documents of 3,000 lengths, half of the words: every third of the lengths gives about half of its documents."""
    counts = dict.fromkeys(range(1000, 4000), 1)
    budget = sum(counts) // 2
    took = mixing.fit(budget, counts)
    thirds = [sum(took[n] for n in range(a, a + 1000)) for a in (1000, 2000, 3000)]
    assert sum(n * k for n, k in took.items()) == budget and all(400 < x < 600 for x in thirds)


def test_languages(spark):
    r = random.Random(1)
    words = {"en": "the of and to in is that for it with".split(), "fr": "le la les de des et en un une que".split(), "de": "der die das und den von zu mit ist dem".split()}
    rows = [(i, " ".join(r.choice(words[lang]) for _ in range(30)), lang) for i, lang in enumerate(r.choice("en fr de".split()) for _ in range(300))]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = langid.fit(d.where(~langid.held_out(F.col("doc_id"))))
    odd = spark.createDataFrame([(-1, None), (-2, "12 ## 3"), (None, "der und die")], "doc_id long, text string").withColumn("lang_pred", F.lit("clash"))
    got = {x.doc_id: x for x in langid.predict(odd, m).collect()}
    assert got[-1].lang_pred == got[-2].lang_pred == "und" and got[-1].score == 0 and got[None].lang_pred == "de"
    held = d.where(langid.held_out(F.col("doc_id")))
    assert {x.doc_id for x in held.collect()} == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    p = langid.predict(held, m).join(held.select("doc_id", "lang"), "doc_id").collect()
    assert sum(x.lang == x.lang_pred for x in p) >= 0.95 * len(p) and all(0 <= x.score <= 1 for x in p)
    none = langid.fit(d.limit(0))
    assert langid.predict(held, none).first().lang_pred == "und" and langid.predict(d.limit(0), m).count() == 0


class PlainKneserNey:
    """One language's model from dictionaries of strings, by the textbook formulas; vocabulary: the characters of all languages."""

    def __init__(self, texts, vocabulary, order=5):
        self.v, self.order, self.c = len(vocabulary), order, {}
        raw = {n: collections.Counter() for n in range(1, order + 1)}
        for t in texts:
            padded = " " * order + t
            for i in range(order + 1, len(padded)):
                for n in range(1, order + 1):
                    raw[n][padded[i - n + 1 : i + 1]] += 1
        for n in range(1, order + 1):
            self.c[n] = raw[n] if n == order else collections.Counter(g[1:] for g in raw[n + 1])
        self.d = {}
        for n, c in self.c.items():
            ones, twos = sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
            self.d[n] = ones / (ones + 2 * twos) if ones and twos else 0.5
        self.total, self.kinds = collections.Counter(), collections.Counter()
        for c in self.c.values():
            for g, x in c.items():
                self.total[len(g), g[:-1]] += x
                self.kinds[len(g), g[:-1]] += 1

    def p(self, context, char, n=None):
        n = self.order if n is None else n
        if n == 0:
            return 1 / (self.v + 1)
        context = context[len(context) - n + 1 :]
        low = self.p(context[1:], char, n - 1)
        total = self.total[n, context]
        if not total:
            return low
        return (max(self.c[n][context + char] - self.d[n], 0) + self.d[n] * self.kinds[n, context] * low) / total


def test_kneser_ney_against_dictionaries(spark):
    r = random.Random(8)
    texts = {"en": ["the cat and the hat"], "fr": ["le chat et le chapeau"], "xx": ["zé"]}
    for lang, ts in texts.items():
        ts += [" ".join(r.choice(ts[0].split()) for _ in range(r.randint(1, 9))) for _ in range(20)]
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, ts in texts.items() for t in ts)]
    m = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    clean = lambda t: "".join(map(chr, langid.codes(t).tolist()))
    vocabulary = {c for ts in texts.values() for t in ts for c in clean(t)[1:]}
    assert m.langs == ["en", "fr", "xx"]
    plain = [PlainKneserNey([clean(t) for t in texts[lang]], vocabulary) for lang in m.langs]
    for model in plain:
        for context in ("    ", "the ", "e ch", "zzzz", "at a"):
            assert sum(model.p(context, c) for c in vocabulary) + model.p(context, "?") == pytest.approx(1)
    for t in ["the chat and", "zé zé le", "unknown letters жжж", "a", "cat" * 50]:
        s = clean(t)
        padded = "     " + s
        want = [-sum(math.log(model.p(padded[i + 1 : i + 5], padded[i + 5])) for i in range(1, len(s))) / (len(s) - 1) for model in plain]
        assert m.entropies(langid.codes(t)) == pytest.approx(want, rel=1e-5)
    assert [m.predict(t)[0] for t in ("the cat", "le chapeau", "zé")] == ["en", "fr", "xx"]


def test_language_of_a_text_beyond_the_piece(spark, monkeypatch):
    rows = [(i, t, lang) for i, (lang, t) in enumerate([("en", "the cat and the hat"), ("fr", "le chat et le chapeau")] * 5)]
    m = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    long = "the hat and le chat " * 40
    whole = m.predict(long)
    monkeypatch.setattr(langid, "PIECE", 7)
    assert m.predict(long)[:1] == whole[:1] and m.predict(long)[2] == pytest.approx(whole[2], rel=1e-5)


def test_language_sample_is_bounded_and_repeatable(spark, monkeypatch):
    rows = [(None, f"text number {i} of some", "en") for i in range(30)] + [(1, "x" * 500, "fr"), (1, "court", "fr"), (1, "court", "fr"), (2, None, "fr"), (3, "nul", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("n", F.lit("clash"))
    got = sorted((x.lang, x.text) for x in langid.sample(df, rows=10, chars=100).collect())
    again = sorted((x.lang, x.text) for x in langid.sample(df.repartition(5), rows=10, chars=100).collect())
    assert got == again and [x for x in got if x[0] == "fr"] == [("fr", "court")] and 1 <= sum(x[0] == "en" for x in got) <= 5
    monkeypatch.setattr(langid, "MODEL_BYTES", 20_000)
    small = langid.fit(df)
    assert small.langs == ["en", "fr"] and sum(map(len, small.grams)) * 2 * 8 <= 20_000


def test_archives(spark, tmp_path):
    big = "".join(chr(97 + i % 26) for i in range(50_000)) + "é\r\n\r\nWARC/1.1\r\n" * 50
    rows = [(3, "http://a/", big), (1, "u", big), (2, None, "x" * 100), (5, "u", "x" * 100), (6, "u", "small"), (7, "u", "small"), (8, "", None), (9, "u", ""), (None, "u", "x" * 100), (1, "u", big), (4, "a b\r\nX: y", "日本" * 9000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)
    path = str(tmp_path / "w")
    warc.write(df, path)
    got = [tuple(x) for x in warc.read(spark, path).collect()]
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        first = min(j for j, _, g in rows if j is not None and (g or "") == (h or ""))
        again = len(b) >= 100 and i != first
        want.append((None if i is None else str(i), len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", str(first) if again else None))
    assert sorted(got, key=str) == sorted(want, key=str)
    warc.write(df.limit(0), str(tmp_path / "e"))
    assert warc.read(spark, str(tmp_path / "e")).count() == 0
    assert warc.unchunked(b"3;x=y\r\nabc\r\n0\r\n\r\n") == b"abc"


def test_pipeline_stages(spark):
    import corpus_pipeline as c

    r = random.Random(3)
    base = " ".join(r.choice(["the", "of", "house", "river", "stone", "and", "walks", "sees", "to", "green"]) + r.choice(["", "s"]) for _ in range(80))
    rows = [(i, base.replace("stone", f"stone{i % 2}", 1) if i < 4 else " ".join(r.sample(base.split(), 60)) + f" mail me u{i}@x.org the of", "en", f"s{i % 3}", 1) for i in range(30)]
    rows += [(100, "short", "en", "s0", 1), (101, "word " * 100, "en", "s1", 1), (102, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert 4 <= len(c.STAGES) <= 5
    ids = lambda d: sorted(x.doc_id for x in d.select("doc_id").collect())
    one = c.cut(c.quality_rules(spark, docs, ""), "t")
    assert ids(one) == list(range(30))
    two = c.cut(c.near_duplicates(spark, one, ""), "t")
    assert ids(two) == [0, *range(4, 30)]
    three = c.cut(c.personal_data(spark, two, ""), "t")
    assert ids(three) == ids(two) and all("@" not in x.text and x.n_chars == len(x.text) for x in three.collect())
    four = c.cut(c.source_mix(spark, three, ""), "t")
    assert four.columns == docs.columns and set(ids(four)) <= set(ids(three))
    five = c.tokens(spark, four, "").collect()
    assert len(five) == four.count() and all(x.n_tokens == len(x.ids) > 0 for x in five)
