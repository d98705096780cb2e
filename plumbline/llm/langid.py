"""Language identification by interpolated Kneser-Ney character models.

For each language the n-grams of up to ORDER characters of a bounded sample of
labelled rows are counted, discounted and interpolated. The models are sorted
arrays of n-gram hashes beside the log probabilities under every language, so
that one binary search serves all languages. A text gets the language of the
lowest cross-entropy per character; a language's calibrated bound says when even
that one is too high (column rejected).

The lowest order is interpolated with the uniform 1 / (V + 1) over the V characters of
the sample and one for all others, so each model's probabilities sum to one.

The fit takes at most FIT_ROWS rows and FIT_CHARS characters a language, whole rows in
the order of a hash, with all of their n-grams. Their table is counted before it is
fetched, and both bounds are halved until it fits MODEL_BYTES; this also bounds
what is broadcast. Prediction reads every character of every text.

Defined cases: a null text, or one without letters, is ``und`` with score 0; so
is every text where no labelled row exists. A null id is not held out. Equal
entropies go to the first language by code point. Repeated rows each get their
row; an empty table gives an empty result.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import cut, discard, table

ORDER = 5
FIT_ROWS, FIT_CHARS = 2000, 8_000_000
#: The largest table of the fit: n-grams times languages, 8 bytes each.
MODEL_BYTES = 1 << 28
#: A table holds one column a language; more labels than this are refused.
MAX_LANGS = 500
#: Rows that are ranked for each one wanted, about.
DRAWN = 4
#: A fourth of the sampled rows sets the bounds of rejection: their entropies' quantile, and some room.
CALIBRATE, QUANTILE, ROOM = 4, 0.999, 1.15
#: A language with fewer rows keeps them all for its model and has no bound.
CALIBRATE_ROWS = 40
#: Texts are scored in pieces of so many characters at once.
PIECE = 1 << 19

_MULT = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1) ** 5 | 1) & (2**64 - 1) for k in range(1, ORDER + 1)], np.uint64)


def _alphabetic() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)])


_LETTER: list[np.ndarray] = []


def codes(text: str | None) -> np.ndarray:
    """A text's lower-case letters, each run of other characters as one space, with a space at both ends; empty without letters."""
    if not text:
        return np.empty(0, np.uint64)
    if not _LETTER:
        _LETTER.append(_alphabetic())
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _LETTER[0][c]
    if not letter.any():
        return np.empty(0, np.uint64)
    c = np.concatenate(([32], np.where(letter, c, 32), [32]))
    return c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))].astype(np.uint64)


def hashes(c: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
    """Hashes of the n characters that end at each place of at (places before the text count as spaces)."""
    h = np.full(len(at), n, np.uint64)
    for k in range(n):
        p = at - k
        h += np.where(p >= 0, c[np.maximum(p, 0)], np.uint64(32)) * _MULT[k]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def count_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, n, gram, context, suffix, count) of a batch's texts; a later sum joins batches."""
    for b in it:
        by: dict[str, list[np.ndarray]] = {}
        for lang, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            by.setdefault(lang, []).append(codes(t))
        for lang, cs in by.items():
            for n in range(1, ORDER + 1):
                grams = []
                for c in cs:
                    at = np.arange(1, len(c))
                    grams.append(np.stack([hashes(c, n, at), hashes(c, n - 1, at - 1), hashes(c, n - 1, at)]))
                g = np.concatenate(grams, axis=1)
                if not g.shape[1]:
                    continue
                _, first, count = np.unique(g[0], return_index=True, return_counts=True)
                cols = [pa.array(x[first].astype(np.int64)) for x in g]
                size = len(first)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * size), pa.array(np.full(size, n, np.int32)), *cols, pa.array(count)], names=["lang", "n", "gram", "context", "suffix", "count"])


def find(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of h in the sorted keys, -1 where missing."""
    if not len(keys):
        return np.full(len(h), -1)
    i = np.searchsorted(keys, h)
    i[i == len(keys)] = 0
    return np.where(keys[i] == h, i, -1)


class Model:
    """Per order: sorted n-gram hashes with log probabilities, sorted contexts with log backoff weights, a column a language."""

    def __init__(self, langs: list[str]):
        self.langs = langs
        self.grams: list[np.ndarray] = []
        self.logp: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.backoff: list[np.ndarray] = []
        self.floor = 0.0
        self.bound = np.full(len(langs), np.inf)

    @classmethod
    def fit(cls, counts) -> Model:  # noqa: ANN001
        """counts: a pandas frame of summed count_batches rows."""
        m = cls(sorted(counts["lang"].unique().tolist()))
        prob = None
        for n in range(1, ORDER + 1):
            at_n = counts[counts["n"] == n]
            u = at_n.drop_duplicates("gram").sort_values("gram", key=lambda s: s.astype("uint64"))
            gram, context, suffix = (u[k].to_numpy().astype(np.uint64) for k in ("gram", "context", "suffix"))
            contexts = np.unique(context)
            where = find(contexts, context)
            if prob is None:
                below, m.floor = np.full((len(gram), len(m.langs)), 1 / (len(gram) + 1)), -float(np.log(len(gram) + 1))
            else:
                of = find(m.grams[-1], suffix)
                if (of < 0).any():
                    raise ValueError("an n-gram without its suffix: counts must be whole")
                below = prob[of]
            share, weight = np.zeros((len(gram), len(m.langs))), np.ones((len(contexts), len(m.langs)))
            for k, lang in enumerate(m.langs):
                mine = at_n[at_n["lang"] == lang]
                c = np.zeros(len(gram))
                if n == ORDER:
                    c[find(gram, mine["gram"].to_numpy().astype(np.uint64))] = mine["count"].to_numpy()
                else:  # continuations: by how many different characters an n-gram is preceded
                    up = counts[(counts["n"] == n + 1) & (counts["lang"] == lang)]
                    places = find(gram, up["suffix"].to_numpy().astype(np.uint64))
                    c += np.bincount(places[places >= 0], minlength=len(gram))
                ones, twos = (c == 1).sum(), (c == 2).sum()
                d = ones / (ones + 2 * twos) if ones and twos else 0.5
                total = np.bincount(where, weights=c, minlength=len(contexts))
                kinds = np.bincount(where, weights=c > 0, minlength=len(contexts))
                seen = total > 0
                weight[seen, k] = d * kinds[seen] / total[seen]
                share[:, k] = np.maximum(c - d, 0) / np.maximum(total, 1e-300)[where] * seen[where]
            prob = share + weight[where] * below
            m.grams.append(gram)
            m.logp.append(np.log(prob).astype(np.float32))
            m.contexts.append(contexts)
            m.backoff.append(np.log(weight).astype(np.float32))
        return m

    def entropies(self, c: np.ndarray) -> np.ndarray:
        """Cross-entropy a character under each language."""
        total = np.zeros(len(self.langs))
        for start in range(1, len(c), PIECE):
            at = np.arange(start, min(len(c), start + PIECE))
            for n in range(ORDER, 0, -1):
                i = find(self.grams[n - 1], hashes(c, n, at))
                total += self.logp[n - 1][i[i >= 0]].sum(axis=0, dtype=np.float64)
                at = at[i < 0]
                if not len(at):
                    break
                j = find(self.contexts[n - 1], hashes(c, n - 1, at - 1))
                total += self.backoff[n - 1][j[j >= 0]].sum(axis=0, dtype=np.float64)
            else:
                total += self.floor * len(at)
        return -total / max(1, len(c) - 1)

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """(language, score, entropy, rejected): the score is the best language's share of the likelihoods of a mean stretch."""
        c = codes(text)
        if not len(c) or not self.langs:
            return "und", 0.0, 0.0, True
        e = self.entropies(c)
        k = int(np.argmin(e))
        score = 1 / np.exp(np.maximum(e[k] - e, -30) * min(len(c), 20)).sum()
        return self.langs[k], float(score), float(e[k]), bool(e[k] > self.bound[k])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(df: DataFrame, rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> DataFrame:
    """(lang, text, h, calibrating) of at most so many rows and characters a language, by the smallest hashes; rows alike count once.

    Only rows under a language's bound on the hash are ranked: a few times as many as wanted, so no task sorts a whole language.
    Where they turn out too few (rows alike, long texts), the bound rises. Of more than MAX_LANGS languages the most frequent are learned.
    """
    d = df.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", F.xxhash64(F.col("doc_id").cast("string"), F.col("text"), F.lit(11)).alias("h"), F.length("text").cast("long").alias("size"))
    counts = {r["lang"]: r["n"] for r in d.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()}
    shares = {lang: min(1.0, DRAWN * rows / n) for lang, n in counts.items()}
    while True:
        bounds = d.sparkSession.createDataFrame([(lang, int(-(2**63) + x * 2**64) if x < 1 else 2**63 - 1) for lang, x in shares.items()], "lang string, bound long")
        near = cut(d.join(F.broadcast(bounds), "lang").where("h <= bound").select("lang", "text", "h", "size").dropDuplicates(["lang", "h"]), "language-near")
        have = {r["lang"]: r["n"] for r in near.where(F.col("size") <= chars).groupBy("lang").agg(F.count("*").alias("n")).collect()}
        few = [lang for lang, x in shares.items() if x < 1 and have.get(lang, 0) < rows]
        if not few:
            break
        shares |= {lang: min(1.0, 8 * shares[lang]) for lang in few}
        discard(near)
    # shorter rows first only where a single text is over the bound; the first row always counts
    order = W.partitionBy("lang").orderBy(F.col("size") > chars, "h")
    ranked = near.select("lang", "h", "size").withColumn("r", F.row_number().over(order)).where(F.col("r") <= rows)
    ranked = ranked.withColumn("upto", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0))).where((F.col("upto") <= chars) | (F.col("r") == 1))
    kept = cut(ranked.select("lang", "h", F.count("*").over(W.partitionBy("lang")).alias("n")), "language-rows")
    # at most rows times MAX_LANGS pairs of a name and a number
    drawn = near.join(F.broadcast(kept), ["lang", "h"])
    return drawn.select("lang", "text", "h", ((F.pmod("h", F.lit(CALIBRATE)) == 0) & (F.col("n") >= CALIBRATE_ROWS)).alias("calibrating"))


def fit(df: DataFrame, rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> Model:
    """The model of rows (doc_id, text, lang), bounded as said above."""
    while True:
        drawn = cut(sample(df, rows, chars), "language-sample")
        counted = drawn.where("NOT calibrating").mapInArrow(count_batches, "lang string, n int, gram long, context long, suffix long, count long")
        sums = counted.groupBy("lang", "n", "gram").agg(F.first("context").alias("context"), F.first("suffix").alias("suffix"), F.sum("count").alias("count"))
        sums = cut(sums, "language-counts")
        size = sums.agg(F.count_distinct("n", "gram").alias("grams"), F.count_distinct("lang").alias("langs"), F.count("*").alias("rows")).first()
        # a row of counts takes about as much as six cells
        if 8 * max(size["grams"] * size["langs"], 6 * size["rows"]) <= MODEL_BYTES or rows <= 1:
            break
        rows, chars = rows // 2, chars // 2
        discard(drawn, sums)
    # as an Arrow table: rows of Python objects would take many times the memory on the driver
    m = Model.fit(sums.toArrow().to_pandas(categories=["lang"]))

    def entropies(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            got = [(lang, m.predict(t)) for lang, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True)]
            got = [(lang, p[2]) for lang, p in got if p[0] == lang]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names=["lang", "e"])

    for r in drawn.where("calibrating").mapInArrow(entropies, "lang string, e double").groupBy("lang").agg(F.percentile("e", F.lit(QUANTILE)).alias("q")).collect():
        m.bound[m.langs.index(r["lang"])] = ROOM * r["q"]
    discard(drawn, sums)
    return m


def predict(df: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, entropy, rejected) of rows (doc_id, text)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            got = [shared.value.predict(t.as_py()) for t in b.column("text")]
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array([g[k] for g in got], t) for k, t in enumerate(kinds)]], names=["doc_id", "lang_pred", "score", "entropy", "rejected"])

    d = df.select("doc_id", "text")
    kind = d.select("doc_id").schema
    return d.mapInArrow(batches, kind.add("lang_pred", "string").add("score", "double").add("entropy", "double").add("rejected", "boolean"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    p = predict(d, fit(d.where(~held_out(F.col("doc_id")))))
    return p.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op8_language_id": op8_language_id}
ORACLE_SQL: dict[str, str] = {}
