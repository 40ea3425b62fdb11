"""All matches of a pattern with code-point offsets, as Spark expressions only.

``split`` gives what lies between the matches and ``regexp_extract_all`` the matches; both walk the same leftmost
non-overlapping matches, so running lengths give the offsets. ``length`` counts code points. Running sums are taken in
blocks, and texts are cut in blocks, so the time grows with a text's length and its matches, not with their product.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,kind:string,rank:int,s:string,g:string>>"
NEAR = "array<struct<start:int,end:int,kind:string,rank:int,s:string,g:string,before:string,after:string>>"
#: Values added up one by one, and code points of a text looked through at once.
BLOCK, PAGE = 256, 4096


def none() -> Column:
    return F.array().cast(SPAN)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def scan(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """Running merges (from 0) of array<int>."""
    last = lambda acc: F.element_at(acc, F.lit(-1))
    run = lambda xs, start: F.aggregate(xs, F.array(start), lambda acc, x: F.concat(acc, F.array(merge(last(acc), x))))

    def whole(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))

        def joined(bs: Column) -> Column:
            offsets = run(F.transform(bs, lambda x: F.aggregate(x, F.lit(0), lambda a, b: merge(a, b))), F.lit(0))
            return F.flatten(F.transform(F.arrays_zip(bs.alias("xs"), F.slice(offsets, F.lit(1), F.size(bs)).alias("at")), lambda z: F.slice(run(z["xs"], z["at"]), F.lit(2), F.lit(BLOCK))))

        return F.when(F.size(v) == 0, v).otherwise(bind(blocks, joined))

    return bind(values.cast("array<int>"), whole)


def find(text: Column, pattern: str, kind: str, rank: int, group: int = 0, guard: Column | None = None, near: int = 0) -> Column:
    """array<struct<start, end, kind, rank, s, g>>: every match ``s`` in order, ``g`` its group. ``guard`` is a cheap necessary condition.

    With ``near``, also ``before``, at most so many code points before the match, and ``after``, the one after it.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else F.lit(None).cast("array<string>")

    def spans(x: Column) -> Column:
        hits, gaps, n = x["hits"], x["gaps"], F.size(x["hits"])
        parts = {"gap": F.slice(gaps, F.lit(1), n), "s": hits, "g": F.coalesce(x["groups"], hits)}
        if near:
            parts |= {"last": F.concat(F.array(F.lit("")), hits), "next": F.slice(gaps, F.lit(2), n)}
        zipped = F.arrays_zip(*[F.slice(c, F.lit(1), n).alias(k) for k, c in parts.items()])
        ends = scan(F.transform(zipped, lambda z: F.length(z["gap"]) + F.length(z["s"])), lambda a, b: a + b)

        def one(z: Column) -> Column:
            cols = [(z["end"] - F.length(z["z"]["s"])).alias("start"), z["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), z["z"]["s"].alias("s"), z["z"]["g"].alias("g")]
            if near:
                cols += [F.right(F.concat(F.right(z["z"]["last"], F.lit(near)), z["z"]["gap"]), F.lit(near)).alias("before"), F.left(z["z"]["next"], F.lit(1)).alias("after")]
            return F.struct(*cols)

        return F.transform(F.arrays_zip(ends.alias("end"), zipped.alias("z")), one)

    found = bind(F.struct(hits.alias("hits"), F.split(text, pattern, -1).alias("gaps"), groups.alias("groups")), spans).cast(NEAR if near else SPAN)
    has = text.rlike(pattern)
    return F.when((guard & has) if guard is not None else has, found).otherwise(F.array().cast(NEAR if near else SPAN))


def touching(spans: Column, others: Column) -> Column:
    """Whether each of ``spans``, ordered by start, overlaps one of ``others``: array<struct<h, touches>>."""
    far = 2**31 - 1
    events = F.array_sort(F.concat(F.transform(spans, lambda h: F.struct(h["start"].alias("start"), F.lit(1).alias("own"), h["end"].alias("end"), h.alias("h"))), F.transform(others, lambda h: F.struct(h["start"].alias("start"), F.lit(0).alias("own"), h["end"].alias("end"), F.element_at(spans, 1).alias("h")))))

    def marked(es: Column) -> Column:
        ends = scan(F.transform(es, lambda e: F.when(e["own"] == 0, e["end"]).otherwise(0)), F.greatest)
        starts = F.reverse(scan(F.reverse(F.transform(es, lambda e: F.when(e["own"] == 0, F.lit(far) - e["start"]).otherwise(0))), F.greatest))
        every = F.arrays_zip(es.alias("e"), ends.alias("reach"), starts.alias("next"))
        own = F.filter(every, lambda z: z["e"]["own"] == 1)
        return F.transform(own, lambda z: F.struct(z["e"]["h"].alias("h"), ((z["reach"] > z["e"]["start"]) | (F.lit(far) - z["next"] < z["e"]["end"])).alias("touches")))

    return bind(events, marked)


def replaced(text: Column, spans: Column, tag: Callable[[Column], Column]) -> Column:
    """The text with each of the spans, ordered by start, replaced by its tag; a span that overlaps an earlier one is part of it."""

    def cut(pages: Column, start: Column, length: Column) -> Column:
        first, last = F.floor(start / PAGE).cast("int"), F.floor((start + length) / PAGE).cast("int")
        return F.substring(F.array_join(F.slice(pages, first + 1, last - first + 1), ""), start % PAGE + 1, length)

    def built(x: Column) -> Column:
        ends = scan(F.transform(x["spans"], lambda h: h["end"]), F.greatest)

        def pieces(e: Column) -> Column:
            each = F.arrays_zip(x["spans"].alias("h"), F.slice(F.concat(F.array(F.lit(0)), e), F.lit(1), F.size(e)).alias("at"))
            made = F.transform(each, lambda z: F.when(z["h"]["start"] >= z["at"], F.concat(cut(x["pages"], z["at"], z["h"]["start"] - z["at"]), tag(z["h"]))).otherwise(""))
            end = F.element_at(e, F.lit(-1))
            return F.concat(F.array_join(made, ""), cut(x["pages"], end, x["size"] - end))

        return bind(ends, pieces)

    pages = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, bind(F.struct(spans.alias("spans"), pages.alias("pages"), F.length(text).alias("size")), built)).otherwise(text)


def in_order(spans: Column) -> Column:
    """By start, then kind as listed (rank), then end."""
    return F.array_sort(F.transform(spans, lambda h: F.struct(h["start"].alias("start"), h["rank"].alias("rank"), h["end"].alias("end"), h["kind"].alias("kind"), h["s"].alias("s"))))


def joined(ordered: Column) -> Column:
    """kind:start:end of spans of ``in_order``, comma-joined."""
    return F.array_join(F.transform(ordered, lambda h: F.concat_ws(":", h["kind"], h["start"].cast("string"), h["end"].cast("string"))), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda h: h["kind"] == kind)).cast("long")
