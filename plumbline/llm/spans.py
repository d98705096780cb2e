"""Places of pattern matches in texts, with built-in functions only.

``split`` and ``regexp_extract_all`` both walk the leftmost non-overlapping matches
of one pattern; the gaps of the one and the matches of the other, laid end to end,
give each match's place in code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,rank:int,end:int,kind:string,text:string>>"


#: Running values are worked out in blocks of so many, so that they take about linear time.
BLOCK = 256
#: A text is cut into chunks of so many characters before parts of it are taken by place.
CHUNK = 1024


def _before(xs: Column, zero: int, f: Callable[[Column, Column], Column]) -> Column:
    """For each element what f makes of zero and all elements before it. Kept as a string: that is copied far faster than an array."""
    start = F.struct(F.lit(zero).alias("at"), F.lit("").alias("out"))
    step = lambda a, x: F.struct(f(a["at"], x).alias("at"), F.concat(a["out"], a["at"].cast("string"), F.lit(",")).alias("out"))
    text = F.aggregate(xs, start, step, lambda a: a["out"])
    return F.transform(F.slice(F.split(text, ","), F.lit(1), F.size(xs)), lambda s: s.cast("int"))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def running(xs: Column, zero: int, f: Callable[[Column, Column], Column]) -> Column:
    """As _before, block by block and then within each block. f: associative, with zero as its neutral element."""

    def blocks(v: Column) -> Column:
        n = F.size(v)
        return F.when(n > BLOCK, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))).otherwise(F.array(v))

    def joined(bs: Column) -> Column:
        totals = F.transform(bs, lambda b: F.aggregate(b, F.lit(zero), f))
        return F.flatten(F.zip_with(bs, _before(totals, zero, f), lambda b, at: F.transform(_before(b, zero, f), lambda v: f(at, v))))

    return _let(_let(xs, blocks), joined)


def find(text: Column, pattern: str, kind: str, rank: int, keep: Callable[[Column], Column] | None = None, guard: Column | None = None) -> Column:
    """Spans of a pattern's matches in the (non-null) text; keep drops failing matches after the walk.

    guard: a cheap condition without which there is no match.
    """
    pairs = F.zip_with(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1),
        lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g"), F.length(m).alias("n")),
    )
    matches = F.filter(pairs, lambda x: x["m"].isNotNull())

    def span(x: Column, at: Column) -> Column:
        start = at + x["g"]
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + x["n"]).alias("end"), F.lit(kind).alias("kind"), x["m"].alias("text"))

    found = _let(matches, lambda ms: F.zip_with(ms, running(F.transform(ms, lambda x: x["g"] + x["n"]), 0, lambda a, b: a + b), span))
    found = F.filter(found, lambda s: keep(s["text"])) if keep else found
    seen = text.rlike(pattern) if guard is None else guard & text.rlike(pattern)
    return F.when(seen, found).otherwise(F.array().cast(SPAN))


def merged(*spans: Column) -> Column:
    """All spans by start, then rank."""
    return F.array_sort(F.concat(*spans))


def written(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def outside(spans: Column, others: Column) -> Column:
    """Those of spans (by end) that overlap none of others: no other that starts before a span's end ends after its start."""
    none = F.lit(None).cast(SPAN[6:-1])
    mine = F.transform(spans, lambda s: F.struct(s["end"].alias("at"), F.lit(0).alias("other"), F.lit(0).alias("end"), s.alias("span")))
    theirs = F.transform(others, lambda o: F.struct(o["start"].alias("at"), F.lit(1).alias("other"), o["end"].alias("end"), none.alias("span")))
    # beside each event the furthest end of the others before it
    reach = lambda es: F.zip_with(es, running(F.transform(es, lambda e: e["end"]), 0, lambda a, b: F.greatest(a, b)), lambda e, r: F.struct(e["span"].alias("span"), r.alias("reach")))
    free = F.filter(_let(F.array_sort(F.concat(mine, theirs)), reach), lambda x: x["span"].isNotNull() & (x["reach"] <= x["span"]["start"]))
    return F.when((F.size(spans) == 0) | (F.size(others) == 0), spans).otherwise(F.transform(free, lambda x: x["span"]))


def _part(chunks: Column, at: Column, n: Column) -> Column:
    """n characters from place at on, of a text in chunks."""
    first = F.floor(at / CHUNK).cast("int")
    last = F.floor((at + n) / CHUNK).cast("int")
    return F.when(n > 0, F.substring(F.array_join(F.slice(chunks, first + 1, last - first + 1), ""), at - first * CHUNK + 1, n)).otherwise("")


def pieces(text: Column, spans: Column) -> Column:
    """The text cut at its spans (by start): per block of overlapping spans the gap before it, its text and its spans, then the last gap."""
    return _let(spans, lambda own: _pieces(text, own))


def _pieces(text: Column, spans: Column) -> Column:
    size = F.length(text)
    chunks = F.transform(F.sequence(F.lit(0), F.floor(size / CHUNK).cast("int")), lambda k: F.substring(text, k * CHUNK + 1, F.lit(CHUNK)))
    top = running(F.transform(spans, lambda s: s["end"]), 0, lambda a, b: F.greatest(a, b))
    heads = F.filter(F.transform(F.zip_with(spans, top, lambda s, t: s["start"] >= t), lambda new, i: F.when(new, i)), lambda i: i.isNotNull())

    def made(x: Column) -> Column:
        heads, own, chunks = x["heads"], x["spans"], x["chunks"]
        block = lambda i, k: F.slice(own, i + 1, F.coalesce(F.get(heads, k + 1), F.size(own)) - i)
        cut = F.transform(heads, lambda i, k: F.struct(F.get(own, i)["start"].alias("start"), F.array_max(F.transform(block(i, k), lambda s: s["end"])).alias("end"), block(i, k).alias("spans")))

        def gaps(y: Column) -> Column:
            before = lambda k: F.coalesce(F.get(y, k - 1)["end"], F.lit(0))
            body = F.transform(y, lambda b, k: F.struct(_part(chunks, before(k), b["start"] - before(k)).alias("gap"), _part(chunks, b["start"], b["end"] - b["start"]).alias("body"), b["spans"].alias("spans")))
            end = before(F.size(y))
            tail = F.struct(_part(chunks, end, size - end).alias("gap"), F.lit("").alias("body"), F.array().cast(SPAN).alias("spans"))
            return F.concat(body, F.array(tail))

        return _let(cut, gaps)

    return _let(F.struct(heads.alias("heads"), spans.alias("spans"), chunks.alias("chunks")), made)
