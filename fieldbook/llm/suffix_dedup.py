"""Suffix-array dedup: bytes covered by a string of ``length`` bytes that also starts in a document with a smaller doc_id.

Suffixes are sorted at anchors. The anchor of a string of ``length`` bytes is the place in it whose ``GRAM`` bytes hash least, so equal
strings have their anchor at the same place, and neighbouring strings mostly share one: a block is an anchor with all strings that
it stands for. Sampled splitters range-partition the blocks by the leading bytes of the suffix at the anchor. Each bucket sorts
its suffixes by multikey quicksort, with characters of eight bytes; equal blocks become one class, and classes that share
enough bytes right or left of their anchors are compared string by string, sorted the same way.

No splitter cuts a run of equal leading bytes, so equal strings never lie on two sides of a boundary, with one exception: leading
bytes that fill several buckets. Their blocks are split into single strings, which are dealt over those buckets by hash.
What is left to compare across boundaries is compared first: tasks collapse the equal blocks of a slice of text. A copy with a larger
doc_id than another one of its slice is answered there, and only blocks of the smallest go to the buckets. So a bucket receives
a string once from each slice, however many rows hold it.

Null text: empty. Empty texts and texts shorter than ``length``: nothing is removed. Null doc_id: comparisons with it are unknown, so such a row loses
nothing and takes nothing away. Ties and repeated rows: rows of one doc_id take nothing from each other, whatever their texts.
Very long texts are cut into slices that overlap, and are judged whole. An empty table gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

import gc
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, mix64, read

LENGTH = 50
#: Bytes of which the least hash makes an anchor.
GRAM = 12
#: Bytes of text whose equal blocks a task collapses, and bytes that it looks through at once.
SLICE, STEP = 6_000_000, 1_000_000
#: Bytes of blocks in a bucket, as sampled; bytes of text in a group of the last pass; bytes of text looked at for splitters.
BUCKET, PART, SAMPLE = 24_000_000, 8_000_000, 32_000_000

#: Of the sampled blocks, in the order of their content, every so many-th gives a key for splitters.
SPARSE = 16
#: Compression of what goes to the buckets, which is several times the text.
LEVEL = 6

MEMBERS = np.dtype([("entry", "<i4"), ("doc", "<i8"), ("text", "<i8"), ("at", "<i8")])
BOUNDS = np.dtype([("high", "u1"), ("low", "u1")])
SPANS = np.dtype([("doc", "<i8"), ("text", "<i8"), ("start", "<i8"), ("end", "<i8")])
ROUTED = "bucket int, entries int, members int, content binary, bounds binary, places binary"
FOUND = "doc_id long, text_hash long, start long, end long"


@dataclass(frozen=True)
class Layout:
    """A row of a block: bytes left of the anchor, the anchor at column ``at``, bytes right of it; zeros where no string of the block reaches."""

    length: int

    @property
    def at(self) -> int:
        return -(-(self.length - GRAM) // 8) * 8

    @property
    def width(self) -> int:
        return -(-(self.at + self.length) // 8) * 8

    @property
    def shared(self) -> int:
        """Characters of eight bytes that equal strings share right or else left of their anchor."""
        return self.length // 16


def least(keys: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each ``n`` neighbours, by doubling."""
    have = 1
    while have < n:
        step = min(have, n - have)
        keys = np.minimum(keys[: len(keys) - step], keys[step:])
        have += step
    return keys


def blocks(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, lay: Layout) -> tuple[np.ndarray, ...]:
    """Blocks of documents that lie end to end in ``text``: rows, distances of their first and last string from the anchor, document, place of the anchor in ``text``."""
    n, span = len(text), lay.length - GRAM + 1
    counts = np.maximum(ends - starts - lay.length + 1, 0)
    if counts.sum() == 0:
        return np.zeros((0, lay.width), np.uint8), np.zeros(0, BOUNDS), np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded = np.concatenate([np.zeros(lay.at, np.uint8), text, np.zeros(lay.width + 8, np.uint8)])
    first = np.ndarray((n,), "<u8", padded, lay.at, (1,)).astype(np.uint64)
    rest = np.ndarray((n,), "<u4", padded, lay.at + 8, (1,)).astype(np.uint64)
    with np.errstate(over="ignore"):
        keys = mix64(first ^ rest * np.uint64(0x9E3779B97F4A7C15))
    del first, rest
    keys = keys & np.uint64(0xFFFFFFFF00000000) | np.arange(n, dtype=np.uint64)
    anchor = (least(keys, span) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    doc = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(doc)) + np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    anchor = anchor[place]
    new = np.ones(len(doc), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    final = np.append(begin[1:], len(doc)) - 1
    bounds = np.zeros(len(begin), BOUNDS)
    bounds["high"], bounds["low"] = anchor[begin] - place[begin], anchor[begin] - place[final]
    rows = np.lib.stride_tricks.sliding_window_view(padded, lay.width)[anchor[begin]]
    return masked(rows, bounds, lay), bounds, doc[begin], anchor[begin]


def masked(rows: np.ndarray, bounds: np.ndarray, lay: Layout) -> np.ndarray:
    columns = np.arange(lay.width, dtype=np.uint8)
    inside = (columns >= (lay.at - bounds["high"].astype(np.int16))[:, None]) & (columns < (lay.at + lay.length - bounds["low"].astype(np.int16))[:, None])
    return rows * inside


def words(rows: np.ndarray) -> np.ndarray:
    """Characters of eight bytes whose order is that of the bytes."""
    return rows.view(">u8")


def multikey(n: int, depth: int, character) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort: the order of n strings, and for each place in it the first place of equal ones. ``character(d, rows)``: the d-th characters of rows.

    A level sorts by one character, within strings whose earlier characters are equal; only those still tied go on to the next.
    """
    order, same = np.arange(n), np.zeros(n, np.int64)
    tied = np.arange(n)
    for d in range(depth):
        if len(tied) == 0:
            break
        keys = character(d, order[tied])
        sub = np.lexsort((keys, same[tied])) if d else np.argsort(keys)
        order[tied], keys, of = order[tied][sub], keys[sub], same[tied]
        new = np.ones(len(tied), bool)
        new[1:] = (of[1:] != of[:-1]) | (keys[1:] != keys[:-1])
        begin = np.flatnonzero(new)
        sizes = np.diff(np.append(begin, len(tied)))
        same[tied] = np.repeat(tied[begin], sizes)
        tied = tied[np.repeat(sizes > 1, sizes)]
    return order, same


def content_order(rows: np.ndarray, bounds: np.ndarray, lay: Layout) -> tuple[np.ndarray, np.ndarray]:
    """Blocks by the suffix at the anchor, then by what lies left of it, nearest first."""
    chars, mid = words(rows), lay.at // 8
    columns = [*range(mid, lay.width // 8), *reversed(range(mid))]
    reach = bounds["high"].astype(np.uint64) << np.uint64(8) | bounds["low"]
    return multikey(len(rows), len(columns) + 1, lambda d, at: chars[at, columns[d]].astype(np.uint64) if d < len(columns) else reach[at])


def firsts(same: np.ndarray) -> np.ndarray:
    return np.flatnonzero(same == np.arange(len(same)))


def coalesced(spans: np.ndarray) -> np.ndarray:
    """Spans of each document, overlapping and adjoining ones joined."""
    if len(spans) == 0:
        return spans
    spans = spans[np.lexsort((spans["start"], spans["text"], spans["doc"]))]
    new = np.ones(len(spans), bool)
    new[1:] = (spans["doc"][1:] != spans["doc"][:-1]) | (spans["text"][1:] != spans["text"][:-1])
    owner = np.cumsum(new) - 1
    far = np.int64(1) << np.int64(33)  # a text is under 2^31 bytes
    reach = np.maximum.accumulate(spans["end"] + owner * far) - owner * far
    new[1:] |= spans["start"][1:] > reach[:-1]
    begin = np.flatnonzero(new)
    out = spans[begin]
    out["end"] = np.maximum.reduceat(spans["end"], begin)
    return out


def members_of(entry: np.ndarray, doc: np.ndarray, text: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(entry), MEMBERS)
    for name, value in zip(MEMBERS.names, (entry, doc, text, at), strict=True):
        out[name] = value
    return out


def whole_spans(members: np.ndarray, bounds: np.ndarray, length: int) -> np.ndarray:
    """What all strings of the members' blocks cover."""
    out, of = np.zeros(len(members), SPANS), bounds[members["entry"]]
    for name in ("doc", "text"):
        out[name] = members[name]
    out["start"], out["end"] = members["at"] - of["high"], members["at"] - of["low"] + length
    return out


def classes(rows: np.ndarray, bounds: np.ndarray, members: np.ndarray, order: np.ndarray, same: np.ndarray, length: int):
    """Equal blocks as one: representatives, members with the smallest doc_id of each, that doc_id, and spans of all other members."""
    lead = firsts(same)
    number = np.empty(len(rows), np.int64)
    number[order] = np.searchsorted(lead, same)
    members = members.copy()
    kept_rows, kept_bounds = rows[order[lead]], bounds[order[lead]]
    members["entry"] = number[members["entry"]]
    members = members[np.argsort(members["entry"], kind="stable")]
    smallest = np.minimum.reduceat(members["doc"], np.searchsorted(members["entry"], np.arange(len(lead)))) if len(lead) else np.zeros(0, np.int64)
    later = members["doc"] > smallest[members["entry"]]
    return kept_rows, kept_bounds, members[~later], smallest, whole_spans(members[later], kept_bounds, length)


def slices_of(batches: Iterator[pa.RecordBatch], lay: Layout, most: int, step: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, bounds and members of about ``most`` bytes of text at a time."""
    made, size = [], 0

    def look(docs: list[tuple[int, int, int, bytes]]) -> None:
        """docs: doc, hash of the text, place of the piece in it, piece."""
        lengths = np.array([len(d[3]) for d in docs], np.int64)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        rows, bounds, of, at = blocks(np.frombuffer(b"".join(d[3] for d in docs), np.uint8), starts, ends, lay)
        columns = [np.array([d[k] for d in docs], np.int64) for k in range(3)]
        made.append((rows, bounds, members_of(np.arange(len(rows)), columns[0][of], columns[1][of], at - starts[of] + columns[2][of])))

    def whole() -> tuple[np.ndarray, ...]:
        base = np.cumsum([0] + [len(m[0]) for m in made])
        for k, m in enumerate(made):
            m[2]["entry"] += base[k]
        return tuple(np.concatenate([m[k] for m in made]) for k in range(3))

    waiting, held = [], 0
    for batch in batches:
        for doc, text_hash, text in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "text_hash")), batch.column("text"), strict=True):
            text = text.as_py() or b""
            for at in range(0, max(len(text) - lay.length + 1, 0), step):
                piece = text[at : at + step + lay.length - 1]
                waiting.append((doc, text_hash, at, piece))
                held += len(piece)
                if held >= step:
                    look(waiting)
                    size += held
                    waiting, held = [], 0
                if size >= most:
                    yield whole()
                    made, size = [], 0
    if waiting:
        look(waiting)
    if made:
        yield whole()


def packed(a: np.ndarray) -> bytes:
    """Compressed; of rows of numbers all first bytes, then all second ones, and so on, as most are equal."""
    if a.dtype.itemsize > 1:
        a = a.view(np.uint8).reshape(len(a), -1).T
    return pa.Codec("zstd", compression_level=LEVEL).compress(np.ascontiguousarray(a).tobytes(), asbytes=True)


def unpacked(b: bytes, dtype, n: int) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    flat = np.frombuffer(pa.decompress(b, n * size, codec="zstd", asbytes=True), np.uint8)
    return flat.view(dtype) if size == 1 else np.ascontiguousarray(flat.reshape(size, n).T).view(dtype).ravel()


def leading(rows: np.ndarray, lay: Layout) -> np.ndarray:
    """The leading bytes of the suffix at each anchor, as comparable strings."""
    return np.ascontiguousarray(rows[:, lay.at : lay.at + GRAM]).view(f"S{GRAM}").ravel()


def singles(rows: np.ndarray, bounds: np.ndarray, members: np.ndarray, lay: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks as one block for each of their strings."""
    n = bounds["high"].astype(np.int64) - bounds["low"] + 1
    of = np.repeat(np.arange(len(rows)), n)
    away = (bounds["low"][of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint8)
    one = np.zeros(len(of), BOUNDS)
    one["high"] = one["low"] = away
    begin = np.cumsum(n) - n
    each = n[members["entry"]]
    more = members[np.repeat(np.arange(len(members)), each)]
    more["entry"] = np.repeat(begin[members["entry"]], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    return masked(rows[of], one, lay), one, more


def route(batches: Iterator[pa.RecordBatch], lay: Layout, splitters: np.ndarray, buckets: int, most: int, step: int) -> Iterator[pa.RecordBatch]:
    """Each slice's blocks, collapsed, by bucket; and the spans that the slice itself answers, in one row."""
    repeated, times = np.unique(splitters, return_counts=True)
    hot = repeated[times > 1]
    for rows, bounds, members in slices_of(batches, lay, most, step):
        order, same = content_order(rows, bounds, lay)
        rows, bounds, members, _, spans = classes(rows, bounds, members, order, same, lay.length)
        out: list[tuple] = []
        spans = coalesced(spans)
        if len(spans):
            out.append((buckets + int(spans["doc"][0]) % buckets, 0, len(spans), b"", b"", packed(spans)))
        keys = leading(rows, lay)
        is_hot = np.isin(keys, hot) if len(hot) else np.zeros(len(rows), bool)
        for chosen, split in ((~is_hot, False), (is_hot, True)):
            if not chosen.any():
                continue
            entry = np.flatnonzero(chosen)
            number = np.full(len(rows), -1, np.int64)
            number[entry] = np.arange(len(entry))
            part, own = members[chosen[members["entry"]]].copy(), bounds[entry]
            part["entry"] = number[part["entry"]]
            some = rows[entry]
            if split:
                some, own, part = singles(some, own, part, lay)
                key = leading(some, lay)
                low, high = np.searchsorted(splitters, key, side="left"), np.searchsorted(splitters, key, side="right")
                h = np.full(len(some), 7, np.uint64)
                for c in range(lay.width // 8):
                    h = mix64(h ^ words(some)[:, c].astype(np.uint64))
                to = low + 1 + (h % (high - low).astype(np.uint64)).astype(np.int64)
            else:
                to = np.searchsorted(splitters, keys[entry], side="right")
            # entries are in the order of their content, so those of a bucket that no hot bytes share lie together
            by = np.argsort(to, kind="stable")
            place = np.empty(len(by), np.int64)
            place[by] = np.arange(len(by))
            part["entry"] = place[part["entry"]]
            part, some, own, to = part[np.argsort(part["entry"], kind="stable")], some[by], own[by], to[by]
            begin = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
            for a, b in zip(begin, np.append(begin[1:], len(to)), strict=True):
                x, y = np.searchsorted(part["entry"], [a, b])
                places = part[x:y].copy()
                places["entry"] -= a
                out.append((int(to[a]), int(b - a), int(y - x), packed(some[a:b]), packed(own[a:b]), packed(places)))
        for k in range(0, len(out), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k : k + 64], strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "entries", "members", "content", "bounds", "places"])


def strings_of(entry: np.ndarray, rows: np.ndarray, bounds: np.ndarray, lay: Layout):
    """All strings of the blocks ``entry``: block, distance from the anchor, and a reader of their characters."""
    n = bounds["high"][entry].astype(np.int64) - bounds["low"][entry] + 1
    of = np.repeat(entry, n)
    away = bounds["low"][of].astype(np.int64) + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    flat = np.concatenate([rows.ravel(), np.zeros(8, np.uint8)])
    view = np.ndarray((len(flat) - 7,), ">u8", flat, 0, (1,))
    begin = of * lay.width + lay.at - away

    def character(d: int, at: np.ndarray) -> np.ndarray:
        left = lay.length - 8 * d
        got = view[begin[at] + 8 * d].astype(np.uint64)
        return got if left >= 8 else got >> np.uint64(64 - 8 * left)

    return of, away, character


def resolve(rows: np.ndarray, bounds: np.ndarray, members: np.ndarray, lay: Layout) -> np.ndarray:
    """Spans of a bucket's members covered by strings that a smaller doc_id of the bucket holds too."""
    order, same = content_order(rows, bounds, lay)
    rows, bounds, members, smallest, spans = classes(rows, bounds, members, order, same, lay.length)
    if len(rows) == 0:
        return coalesced(spans)
    chars, mid, k = words(rows), lay.at // 8, lay.shared
    # classes lie in the order of their suffixes: those that share the first characters are neighbours
    near = np.zeros(len(rows), bool)
    equal = (chars[1:, mid : mid + k] == chars[:-1, mid : mid + k]).all(axis=1)
    near[1:] |= equal
    near[:-1] |= equal
    far = np.flatnonzero(bounds["high"] >= 8 * k)
    columns = [mid, *range(mid - 1, mid - 1 - k, -1)]
    order, same = multikey(len(far), len(columns), lambda d, at: chars[far[at], columns[d]].astype(np.uint64))
    sizes = np.bincount(same, minlength=len(far))
    near[far[order[sizes[same] > 1]]] = True
    some = np.flatnonzero(near)
    found = [spans]
    if len(some):
        of, away, character = strings_of(some, rows, bounds, lay)
        order, same = multikey(len(of), -(-lay.length // 8), character)
        lead = firsts(same)
        least_doc = np.empty(len(of), np.int64)
        least_doc[order] = np.repeat(np.minimum.reduceat(smallest[of[order]], lead), np.diff(np.append(lead, len(of))))
        # members left all have their class's smallest doc_id, so a string of theirs goes where another class has a smaller one
        gone = np.flatnonzero(least_doc < smallest[of])
        members = members[np.argsort(members["entry"], kind="stable")]
        low, high = np.searchsorted(members["entry"], of[gone], side="left"), np.searchsorted(members["entry"], of[gone], side="right")
        n = high - low
        at = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out = np.zeros(len(at), SPANS)
        for name in ("doc", "text"):
            out[name] = members[name][at]
        out["start"] = members["at"][at] - np.repeat(away[gone], n)
        out["end"] = out["start"] + lay.length
        found.append(out)
    return coalesced(np.concatenate(found))


def as_rows(spans: np.ndarray) -> pa.Table:
    return pa.table([pa.array(np.ascontiguousarray(spans[n])) for n in SPANS.names], names=["doc_id", "text_hash", "start", "end"])


def bucket_spans(table: pa.Table, lay: Layout) -> pa.Table:
    made, answered, base = [], [], 0
    for row in table.to_pylist():
        if row["entries"] == 0:
            answered.append(unpacked(row["places"], SPANS, row["members"]))
            continue
        n = row["entries"]
        places = unpacked(row["places"], MEMBERS, row["members"]).copy()
        places["entry"] += base
        base += n
        made.append((unpacked(row["content"], np.uint8, n * lay.width).reshape(n, lay.width), unpacked(row["bounds"], BOUNDS, n), places))
    spans = [coalesced(np.concatenate(answered))] if answered else []
    if made:
        spans.append(resolve(*(np.concatenate([m[k] for m in made]) for k in range(3)), lay))
    return as_rows(np.concatenate(spans))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, text_hash: 0 but where a doc_id has several texts, so (doc_id, text_hash) names a text; rows that repeat one get equal answers."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    hashed = F.xxhash64("text")
    several = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min(hashed).alias("low"), F.max(hashed).alias("high")).where("low < high")
    if several.isEmpty():
        return rows.withColumn("text_hash", F.lit(0).cast("long"))
    both = rows.join(several.select("doc_id", F.lit(True).alias("some")), "doc_id", "left")
    return both.select("doc_id", "text", F.when(F.col("some"), hashed).otherwise(0).alias("text_hash"))


def with_part(df: DataFrame, parts: int) -> DataFrame:
    """Groups of the last pass."""
    return df.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(parts)).cast("int"))


def sampled_splitters(docs: DataFrame, total: int, buckets: int, lay: Layout) -> np.ndarray:
    """Quantiles of the leading bytes of a bounded sample of texts, chosen by hash; equal ones mark bytes that fill several buckets."""
    share = max(1, -(-total // SAMPLE))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds, members in slices_of(batches, lay, SLICE, STEP):
            rows = classes(rows, bounds, members, *content_order(rows, bounds, lay), lay.length)[0]
            got = leading(rows, lay)[::SPARSE]
            yield pa.RecordBatch.from_arrays([pa.array([bytes(x) for x in got], pa.binary())], ["key"])

    if buckets < 2:
        return np.zeros(0, f"S{GRAM}")
    got = docs.where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).mapInArrow(keys, "key binary").toArrow()
    values = np.sort(np.array(got.column("key").to_pylist(), f"S{GRAM}"))
    return values[np.arange(1, buckets) * len(values) // buckets] if len(values) else np.zeros(0, f"S{GRAM}")


def repeated_spans(rows: DataFrame, total: int, length: int = LENGTH, bucket: int = BUCKET, slice_bytes: int = SLICE, step: int = STEP) -> DataFrame:
    """Of keyed documents with so many bytes in total, the spans that a string of a smaller doc_id covers (doc_id, text_hash, start, end; of one document they may overlap)."""
    if length < 2 * GRAM:
        raise ValueError(f"strings of {2 * GRAM} bytes or more can be compared")
    lay = Layout(length)
    known = rows.where("doc_id is not null")
    # a block has about half as many strings as bytes stand between the ends of the string and its anchor
    buckets = max(1, -(-total * 2 * lay.width // (length - GRAM) // bucket))
    splitters = sampled_splitters(known, total, buckets, lay)
    routed = known.mapInArrow(lambda batches: route(batches, lay, splitters, buckets, slice_bytes, step), ROUTED)
    spans = routed.groupBy("bucket").applyInArrow(lambda table: bucket_spans(table, lay), FOUND)
    return cut(spans, "repeated-spans")


def without(docs: pa.Table, spans: pa.Table) -> pa.Table:
    """The documents of a group without their spans."""
    found = np.zeros(spans.num_rows, SPANS)
    for name, column in zip(SPANS.names, ("doc_id", "text_hash", "start", "end"), strict=True):
        found[name] = spans.column(column).to_numpy()
    found = coalesced(found)
    begin = np.flatnonzero((found["doc"][1:] != found["doc"][:-1]) | (found["text"][1:] != found["text"][:-1])) + 1
    edges = [0, *begin.tolist(), len(found)] if len(found) else []
    where = {(int(found["doc"][a]), int(found["text"][a])): (a, b) for a, b in itertools.pairwise(edges)}
    kept, removed = [], []
    for doc, text_hash, text in zip(docs.column("doc_id").to_pylist(), docs.column("text_hash").to_pylist(), docs.column("text"), strict=True):
        text = text.as_py()
        a, b = where.get((doc, text_hash), (0, 0))
        own = list(zip(found["start"][a:b].tolist(), found["end"][a:b].tolist(), strict=True))
        at, pieces = 0, []
        for start, end in own:
            pieces.append(text[at:start])
            at = end
        kept.append(b"".join([*pieces, text[at:]]))
        removed.append([{"start": s, "end": e} for s, e in own])
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    lengths = pa.array([len(t) + sum(x["end"] - x["start"] for x in r) for t, r in zip(kept, removed, strict=True)], pa.int64())
    return pa.table([docs.column("doc_id").combine_chunks(), lengths, pa.array(kept, pa.binary()), pa.array(removed, spans_type)], names=["doc_id", "n_bytes", "kept", "removed"])


def deduplicate(docs: DataFrame, length: int = LENGTH, part: int = PART, **sizes: int) -> DataFrame:
    """Per document: doc_id, n_bytes, what is left of its text (binary: a span may end inside a character), and the removed runs."""
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    rows, parts = keyed(docs), max(1, -(-total // part))
    spans = repeated_spans(rows, total, length, **sizes)
    # nothing refers to the blocks any more, so their shuffle files may go before the texts are shuffled
    gc.collect()
    docs.sparkSession._jvm.System.gc()
    kind = docs.schema["doc_id"].dataType.simpleString()
    both = with_part(rows, parts).groupBy("part").cogroup(with_part(spans, parts).groupBy("part"))
    return both.applyInArrow(without, "doc_id long, n_bytes long, kept binary, removed array<struct<start:long,end:long>>").withColumn("doc_id", F.col("doc_id").cast(kind))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    return deduplicate(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", runs.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Strings as hex, cut from pieces of a thousand bytes so that each is near the start of what it is cut from.
ORACLE = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
pieces as (select doc_id, h, unnest(range(0, length(h) // 2, 1000)) as pos from d),
cuts as (select doc_id, pos, substr(h, 2 * pos + 1, 2098) as p from pieces),
places as (select doc_id, pos, p, unnest(range(0, least(1000, length(p) // 2 - 49))) as i from cuts),
strings as (select doc_id, pos + i as pos, substr(p, 2 * i + 1, 100) as s from places),
first_in as (select s, min(doc_id) as least_doc from strings group by s having min(doc_id) < max(doc_id)),
hits as (select doc_id, pos from strings join first_in using (s) where least_doc < doc_id),
marks as (select doc_id, pos, case when pos <= lag(pos) over w + 50 then 0 else 1 end as new from hits window w as (partition by doc_id order by pos)),
numbered as (select doc_id, pos, sum(new) over (partition by doc_id order by pos rows unbounded preceding) as run from marks),
runs as (select doc_id, run, min(pos) as a, max(pos) + 50 as b from numbered group by doc_id, run),
edges as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as before from runs),
left_over as (select e.doc_id, string_agg(substr(d.h, (2 * before + 1)::bigint, (2 * (a - before))::bigint), '' order by a) as kept, max(b) as tail, sum(b - a) as gone, count(*) as n from edges e join d using (doc_id) group by e.doc_id)
select d.doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(gone, 0)::bigint as n_removed, coalesce(n, 0)::bigint as n_spans,
 sha256(unhex(coalesce(kept, '') || substr(h, (2 * coalesce(tail, 0) + 1)::bigint))) as kept_sha256
from d left join left_over using (doc_id)
"""
