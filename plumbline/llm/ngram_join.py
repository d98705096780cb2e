"""N-gram Jaccard join with vertical partitioning.

A document's set holds the 64-bit hashes of its distinct word n-grams; the global
order of n-grams is the order of these hashes. Sets of equal 128-bit hashes form a class, and
classes, named by the row number of their first row, are joined:

1. Survivors. By a link's least overlap, two linked sets share at least k of the first
   n - a + k n-grams of each (a: the least overlap). A class with fewer than k of its prefix in
   other classes has no link.
2. Index. Of the survivors' whole sets, the s n-grams of a set that another survivor holds are
   counted. n - s may not exceed what a link can miss, and of the others the rarest are indexed,
   as many as a link needs to meet in one. A passage that very many documents share is the
   commonest part of a set, so it is indexed only where a document holds little else.
3. Stars. In each posting list the class with the largest shared part is the centre; a class's
   candidate is the centre that it meets most often. The same is done once more with what classes
   hold beside that centre. Linked stars give first components.
4. The rest. Pairs of one posting list that lie in different components so far, and whose shared
   parts allow the overlap; within a component no pair can change the result. Two classes of one
   centre, one of which overlaps too little with it, must share something beside it, so they are
   only looked for in the lists of n-grams beside the centre. A list of more than LIST classes is
   dealt by size: linked sets lie in the same or the next band of sizes.

Pairs are verified by vertical partitioning: the global order is cut into
FRAGMENTS ranges, each set into its segments, a row each. A pair meets its classes' segments fragment by fragment, no
task sees a whole set; partial overlaps are counted apart, and their sum per pair is the exact overlap.

Defined cases: a null text counts as empty; an empty set links with nothing. A null id
is never the smallest. Rows that repeat have equal sets, hence one component. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import cut, discard, table
from plumbline.llm.graph import components

N, PERCENT = 4, 85
FRAGMENTS = 4
#: Posting lists of more classes are compared by bands of set sizes.
LIST = 256

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _B
    return h ^ (h >> np.uint64(29))


def shingles(text: bytes | None, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of a text's n-word shingles; A-Z count as a-z, and fewer than n words are one shingle."""
    ws = text.lower().split() if text else []  # bytes: lower() and split() know ASCII only
    if not ws:
        return np.empty(0, np.uint64)
    h = np.array([xxhash.xxh64_intdigest(w) for w in ws], np.uint64)
    width = min(n, len(h))
    s = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        s = _mix(s * _A + h[k : len(h) - width + 1 + k])
    return np.unique(s)


def slack(n, percent: int = PERCENT):  # noqa: ANN001, ANN201
    """How many of n n-grams a link may miss."""
    return n - (percent * n + 99) // 100


def depth(n, percent: int = PERCENT):  # noqa: ANN001, ANN201
    """k: how many shared n-grams the prefixes of n-gram sets guarantee."""
    return slack(n, percent) // 2 + 1


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _texts(b: pa.RecordBatch) -> Iterator[bytes | None]:
    return (t.as_py() for t in b.column("text").cast(pa.binary()))


def _prefix_batches(n: int, percent: int):  # noqa: ANN202
    """Per text: its set's size and 128-bit hash; the prefix with the first of equal sets in a task."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sizes, high, low, prefixes, seen = [], [], [], [], set()
            for t in _texts(b):
                s = shingles(t, n)
                h = xxhash.xxh3_128_intdigest(s.tobytes()) if len(s) else None
                sizes.append(len(s))
                high.append(None if h is None else h >> 64)
                low.append(None if h is None else h & (1 << 64) - 1)
                fresh = h is not None and h not in seen
                prefixes.append(s[: slack(len(s), percent) + depth(len(s), percent)].view(np.int64) if fresh else None)
                seen.add(h)
            signed = lambda v: pa.array([None if x is None else x - (x >> 63 << 64) for x in v], pa.int64())
            cols = [b.column("doc_id"), b.column("th"), pa.array(sizes, pa.int32()), signed(high), signed(low), pa.array(prefixes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "th", "n", "high", "low", "prefix"])

    return run


def _segment_batches(n: int):  # noqa: ANN202
    """Per class the segments of its set, a row for each fragment; rows that repeat a class's text count once a task."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        edges = np.arange(1, FRAGMENTS, dtype=np.uint64) * np.uint64((1 << 32) // FRAGMENTS)
        for b in it:
            nodes, sizes, grams = [], [], []
            for node, size, t in zip(b.column("node").to_pylist(), b.column("n").to_pylist(), b.column("text").cast(pa.binary()), strict=True):
                if node in seen:
                    continue
                seen.add(node)
                s = shingles(t.as_py(), n)
                nodes += [node] * FRAGMENTS
                sizes += [size] * FRAGMENTS
                grams += np.split(s.view(np.int64), np.searchsorted(s >> np.uint64(32), edges))
            fragments = list(range(FRAGMENTS)) * (len(nodes) // FRAGMENTS)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(fragments, pa.int32()), pa.array(grams, pa.list_(pa.int64()))], names=["node", "n", "fragment", "grams"])

    return run


def _near(percent: int, a: str = "n_a", b: str = "n_b"):  # noqa: ANN202
    """Sizes that allow a link."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def survivors(firsts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, n) of the classes that share enough of their prefix with others. firsts: (node, n, prefix), a row a class."""
    postings = firsts.select("node", "n", F.explode("prefix").alias("gram"))
    # written, so that the shuffle of all prefixes is gone before that of the join
    shared = cut(postings.groupBy("gram").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("gram"), "ngram-common")
    met = postings.join(shared, "gram").groupBy("node", "n").agg(F.count("*").alias("q"))
    smallest = f"({percent} * n + 99) div 100"
    k = F.expr(f"({smallest} - ({percent} * ({smallest}) + 99) div 100) div 2 + 1")
    alive = cut(met.where(F.col("q") >= k).select("node", "n"), "ngram-survivors")
    discard(shared)
    return alive


def index(segments: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(gram, node, n, s): of each class its rarest shared n-grams, enough to meet each link; s is how many it shares.

    Segments that repeat may count an n-gram of one class as shared: s is then larger, and more is indexed, never less.
    """
    postings = segments.select("node", "n", F.explode("grams").alias("gram"))
    # written, so that the shuffle of all counts is gone before that of the postings
    shared = cut(postings.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1"), "ngram-shared")
    met = postings.join(shared, "gram").groupBy("node", "n").agg(F.collect_set(F.struct("c", "gram")).alias("grams"))
    room = F.expr(f"n - ({percent} * n + 99) div 100 + 1 - (n - s)").cast("int")
    few = met.withColumn("s", F.size("grams")).withColumn("room", room).where("room > 0")
    posted = cut(few.select("node", "n", "s", F.explode(F.slice(F.array_sort("grams"), F.lit(1), F.col("room"))).alias("g")).select("g.gram", "node", "n", "s"), "ngram-index")
    discard(shared)
    return posted


def _fits(percent: int, n_a: str, s_a: str, n_b: str, s_b: str):  # noqa: ANN202
    """Whether shared parts of these sizes allow the overlap of a link."""
    return (100 + percent) * F.least(s_a, s_b) >= percent * (F.col(n_a) + F.col(n_b))


def parts(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """pairs (a, b, n_a, n_b) by fragment, with the fragment's overlap and extra, a's n-grams there that b lacks.

    Rows that repeat bring their segments again; each fragment of a pair counts once.
    """
    left = segments.select(F.col("node").alias("a"), "fragment", F.col("grams").alias("g_a"))
    right = segments.select(F.col("node").alias("b"), "fragment", F.col("grams").alias("g_b"))
    each = pairs.select("a", "b", "n_a", "n_b", F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1))).alias("fragment"))
    both = each.join(left, ["a", "fragment"]).join(right, ["b", "fragment"])
    counted = both.select("a", "b", "n_a", "n_b", "fragment", F.size(F.array_intersect("g_a", "g_b")).alias("part"), F.array_except("g_a", "g_b").alias("extra"))
    return counted.dropDuplicates(["a", "b", "fragment"])


def linked(parts: DataFrame, percent: int) -> DataFrame:
    """(a, b, n_a, n_b, overlap, link) of pairs by fragment: partial overlaps summed per pair, and whether it links."""
    sums = parts.groupBy("a", "b", "n_a", "n_b").agg(F.sum("part").alias("overlap"))
    return sums.withColumn("link", 100 * F.col("overlap") >= percent * (F.col("n_a") + F.col("n_b") - F.col("overlap")))


def stars(posted: DataFrame, percent: int) -> DataFrame:
    """(a, b, n_a, n_b): for each class the centre of posting lists that it meets most often."""
    best = F.max(F.struct((F.col("s") / F.col("n")).alias("share"), F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("s").alias("s_b"))).alias("x")
    centre = posted.groupBy("gram").agg(best).select("gram", "x.b", "x.n_b", "x.s_b")
    pairs = posted.select("gram", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("s").alias("s_a")).join(centre, "gram")
    met = pairs.where((F.col("a") != F.col("b")) & _near(percent) & _fits(percent, "n_a", "s_a", "n_b", "s_b")).groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("c"))
    return met.groupBy("a").agg(F.max_by(F.struct("b", "n_a", "n_b"), F.struct("c", "b")).alias("x")).select("a", "x.*")


def _pairs_of_lists(lists: DataFrame, about: DataFrame, keys: list[str], apart, percent: int) -> DataFrame:  # noqa: ANN001
    """(a, b, n_a, n_b): pairs of a posting list in different components, whose shared parts allow a link, and apart."""
    tagged = lists.select("gram", "node").join(about, "node")
    open_ = tagged.groupBy(*keys).agg(F.min("g").alias("lo"), F.max("g").alias("hi"), F.min("n").alias("least"), F.count("*").alias("c")).where("lo < hi")
    # written, so that the join below is one that Spark can broadcast or split
    open_ = cut(open_.select(*keys, "least", "c"), "ngram-open")
    # a partner has n-grams enough: at least the list's smallest number, and the share of one's own
    partner = F.greatest(F.col("least"), F.expr(f"({percent} * n + 99) div 100"))
    left = tagged.join(open_, keys).where((100 + percent) * F.col("s") >= percent * (F.col("n") + partner))
    # in a long list one side lies in its band, the other also in the bands beside its own
    band = F.floor(F.log("n") / float(np.log(100 / percent)))
    long, none = F.col("c") > LIST, F.lit(0).cast("long")
    one, every = F.when(long, band).otherwise(none), F.when(long, F.array(band - 1, band, band + 1)).otherwise(F.array(none))
    named = lambda i: [F.col(c).alias(f"{c}_{i}") for c in ("node", "n", "s", "g", "o", *({"hub"} - {*keys}))]
    x = left.select(*keys, one.alias("band"), *named("a"))
    y = left.select(*keys, F.explode(every).alias("band"), *named("b"))
    met = x.join(y, [*keys, "band"]).where((F.col("g_a") < F.col("g_b")) & _near(percent) & _fits(percent, "n_a", "s_a", "n_b", "s_b") & apart)
    return met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), "n_a", "n_b")


def join(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of df. doc_id may be of any type with an order, a struct for one."""
    flat = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("th"))
    kind = flat.select("doc_id").schema
    sets = flat.mapInArrow(_prefix_batches(n, percent), f"doc_id {kind[0].dataType.simpleString()}, th long, n int, high long, low long, prefix array<long>")
    sets = cut(sets.withColumn("row", F.monotonically_increasing_id()), "ngram-prefixes")
    classes = cut(sets.where("prefix IS NOT NULL").groupBy("high", "low").agg(F.min("row").alias("node")), "ngram-classes")
    firsts = sets.where("prefix IS NOT NULL").select(F.col("row").alias("node"), "n", "prefix").join(classes.select("node"), "node")
    alive = survivors(firsts, percent)
    some = sets.where("high IS NOT NULL").select("doc_id", "th", "n", "high", "low", "row").join(classes, ["high", "low"]).select("doc_id", "th", "n", "row", "node")
    none = sets.where("high IS NULL").select("doc_id", "th", "n", "row", F.lit(None).cast("long").alias("node"))
    docs = cut(some.unionByName(none), "ngram-nodes")
    discard(sets, classes)

    # the survivors' whole sets, from the class's first text
    chosen = docs.where("row = node").join(alive.select("node"), "node").select("node", "n", F.col("th").alias("c_th"), F.col("doc_id").alias("c_id"))
    texts = flat.join(chosen, (flat["th"] == chosen["c_th"]) & flat["doc_id"].eqNullSafe(chosen["c_id"]))
    segments = cut(texts.select("node", "n", "text").mapInArrow(_segment_batches(n), "node long, n int, fragment int, grams array<long>"), "ngram-segments")
    posted = index(segments, percent)
    discard(alive)

    # stars, and then stars of what classes hold beside their first centre
    met = cut(parts(cut(stars(posted, percent), "ngram-stars"), segments), "ngram-parts")
    first = cut(linked(met, percent), "ngram-links")
    one = posted.select("node", "n", "s").distinct()
    hub = first.select(F.col("a").alias("node"), F.col("b").alias("hub"), F.col("overlap").alias("o"))
    extra = met.select(F.col("a").alias("node"), F.explode("extra").alias("gram"))
    extra = cut(extra.join(one, "node"), "ngram-extras")
    again = cut(linked(parts(cut(stars(extra, percent), "ngram-stars"), segments).drop("extra"), percent), "ngram-links")
    edges = first.unionByName(again).where("link").select(F.col("a").alias("u"), F.col("b").alias("v"))
    group = components(edges)

    # the rest: pairs of a posting list that lie in different components so far
    about = cut(one.join(hub, "node", "left").join(group, "node", "left").select("node", "n", "s", F.coalesce("hub", "node").alias("hub"), F.coalesce("o", "n").alias("o"), F.coalesce("component", "node").alias("g")), "ngram-about")
    # What two classes of one centre share beside it is missing from the overlap with the centre: if that is too
    # small for one of them, they need a common n-gram beside the centre, and meet in the lists of those.
    short = (100 + percent) * F.least("o_a", "o_b") < percent * (F.col("n_a") + F.col("n_b"))
    some = _pairs_of_lists(posted, about, ["gram"], ~((F.col("hub_a") == F.col("hub_b")) & short), percent)
    beside = _pairs_of_lists(extra, about, ["gram", "hub"], short, percent)
    left_over = cut(some.unionByName(beside).distinct(), "ngram-rest")
    more = cut(linked(parts(left_over, segments).drop("extra"), percent).where("link").select(F.col("a").alias("u"), F.col("b").alias("v")), "ngram-links")
    final = components(edges.unionByName(more))
    discard(segments, posted, extra, about, left_over, met, first, again, more)

    ids = docs.where("node IS NOT NULL").join(final, "node", "left").select("doc_id", "n", F.coalesce("component", "node").alias("component"))
    # written, so that the join below is one that Spark can broadcast or split
    smallest = cut(ids.groupBy("component").agg(F.min("doc_id").alias("component_id")), "ngram-smallest")
    some = ids.join(smallest, "component").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    none = docs.where("node IS NULL").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return some.unionByName(none)


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """df without near duplicates: one row of each component, that with the smallest id (null last), then text hash.

    Rows are told apart by the row numbers of a written copy, so equal ids neither take each other's texts
    along nor save them. Of rows alike in id and text one stays. Rows with an empty text all stay.
    """
    names = df.columns
    i, t = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    key = F.struct(i.isNull().alias("no_id"), i.alias("id"), F.xxhash64(t).alias("th"), F.monotonically_increasing_id().alias("row"))
    rows = cut(df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("it"), key.alias("key")), "ngram-rows")
    gone = join(rows.select("key", F.col("it")[text].alias("text")), "key", "text", n, percent).where("n_shingles > 0 AND doc_id <> component_id").select(F.col("doc_id.row").alias("row"))
    return rows.join(gone, rows["key.row"] == gone["row"], "left_anti").select("it.*")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


QUERIES = {"op1_ngram_jaccard_join": op1_ngram_jaccard_join}
#: All pairs that share a shingle, and reachability by a recursive union.
ORACLE_SQL = {
    "op1_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [ws]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i:i + 3]) END) AS grams FROM w),
g AS (SELECT doc_id, unnest(grams) AS gram FROM s),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM o JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b
  WHERE 100 * shared >= 85 * (len(x.grams) + len(y.grams) - shared)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT s.doc_id, len(s.grams)::BIGINT AS n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS component_id
FROM s LEFT JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, len(s.grams)"""
}
