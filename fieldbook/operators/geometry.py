"""Polygons and lines: split until they are small, joined by grid cells, and measured where they overlap; unions that cancel shared edges.

A region is an array of closed rings of struct(x, y); what an odd number of rings encloses is inside, so holes and several parts need no
marks of their own. ``split`` halves regions until each part has few points. All pair work then runs on parts, whose
edges are one flat array of doubles (ax, ay, bx, by of each, the inside to the left): a batch of pairs is a few padded arrays.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbook.operators.balanced import cell_join, spread
from fieldbook.operators.stored import stored

RINGS = "array<array<struct<x:double,y:double>>>"
#: Points of a part, and (edge, edge) cells of pairs worked on at once.
MOST, CELLS = 64, 1_000_000
#: What counts as the same place, as a part of a pair's extent.
SAME = 1e-10

Rings = list[np.ndarray]


def signed_area(ring: np.ndarray) -> float:
    at = ring - ring[0]
    return float(np.sum(at[:-1, 0] * at[1:, 1] - at[1:, 0] * at[:-1, 1])) / 2


def inside(at: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Even-odd test of points against edges, both [..., n or m, 2 or 4]."""
    x, y = at[..., :, None, 0], at[..., :, None, 1]
    ax, ay, bx, by = (edges[..., None, :, k] for k in range(4))
    spans = (ay > y) != (by > y)
    return (spans & (x < (bx - ax) * (y - ay) / np.where(by == ay, 1.0, by - ay) + ax)).sum(axis=-1) % 2 == 1


def ring_edges(ring: np.ndarray) -> np.ndarray:
    return np.hstack([ring[:-1], ring[1:]])


def oriented(rings: Rings) -> Rings:
    """Rings with the inside to their left: counter-clockwise where an even number of other rings is around, else clockwise."""
    out = []
    for k, ring in enumerate(rings):
        others = [ring_edges(r) for i, r in enumerate(rings) if i != k]
        middle = (ring[:1] + ring[1:2]) / 2
        depth = sum(int(inside(middle, e)[0]) for e in others)
        out.append(ring if (signed_area(ring) > 0) == (depth % 2 == 0) else ring[::-1])
    return out


def half(rings: Rings, axis: int, at: float, low: bool) -> Rings:
    """The part of a region on one side of a line; points on the line belong to the upper side.

    The rings are cut into chains that begin and end on the line. Along the line the inside lies between the first and second end, the third and fourth, and so on,
    so these are joined, and walking chains and joints closes the new rings.
    """
    whole, chains, ends = [], [], []

    def crossing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        below, above = (a, b) if a[axis] < b[axis] else (b, a)
        point = below + (above - below) * ((at - below[axis]) / (above[axis] - below[axis]))
        point[axis] = at
        return point

    for ring in rings:
        points = ring[:-1]
        kept = (points[:, axis] < at) == low
        if kept.all():
            whole.append(ring)
        elif kept.any():
            start = int(np.flatnonzero(kept & ~np.roll(kept, 1))[0])
            points, kept = np.roll(points, -start, 0), np.roll(kept, -start)
            edges = np.flatnonzero(np.diff(np.concatenate([[0], kept.astype(np.int8), [0]])))
            for a, b in edges.reshape(-1, 2):
                chain = np.vstack([crossing(points[a - 1], points[a]), points[a:b], crossing(points[b - 1], points[b % len(points)])])
                ends += [(chain[0][1 - axis], len(chains), 0), (chain[-1][1 - axis], len(chains), 1)]
                chains.append(chain)
    ends.sort()
    partner = {}
    for (_, c, e), (_, d, f) in zip(ends[::2], ends[1::2], strict=True):
        partner[c, e], partner[d, f] = (d, f), (c, e)
    left = set(range(len(chains)))
    while left:
        walk, here = [], (min(left), 0)
        while here[0] in left:
            left.remove(here[0])
            walk.append(chains[here[0]] if here[1] == 0 else chains[here[0]][::-1])
            here = partner[here[0], 1 - here[1]]
        ring = np.vstack(walk)
        ring = ring[np.concatenate([[True], (ring[1:] != ring[:-1]).any(axis=1)])]
        ring = ring if (ring[0] == ring[-1]).all() else np.vstack([ring, ring[:1]])
        if len(ring) > 3 and signed_area(ring) != 0:
            whole.append(ring)
    return whole


def parts(rings: Rings, most: int = MOST) -> list[Rings]:
    """A region halved across its longer side until no part has more than so many points; a part too narrow to be halved stays."""
    out, waiting = [], [rings]
    while waiting:
        some = waiting.pop()
        if not some:
            continue
        if sum(map(len, some)) <= most:
            out.append(some)
            continue
        every = np.vstack(some)
        low, high = every.min(axis=0), every.max(axis=0)
        axis = 0 if high[0] - low[0] > high[1] - low[1] else 1
        at = (low[axis] + high[axis]) / 2
        halves = [half(some, axis, at, side) for side in (True, False)]
        if any(h and sum(map(len, h)) >= sum(map(len, some)) and (np.vstack(h).min(axis=0) == low).all() and (np.vstack(h).max(axis=0) == high).all() for h in halves):
            out.append(some)
        else:
            waiting += halves
    return out


def rings_of(edges: np.ndarray) -> Rings:
    """Directed edges that close, walked to rings; where several go on, the one farthest to the left, so touching rings stay apart."""
    onward = defaultdict(list)
    for ax, ay, bx, by in edges.tolist():
        onward[ax, ay].append((bx, by))
    out = []
    while onward:
        start = min(onward)
        path, came = [start], None
        while True:
            here = path[-1]
            ways = onward[here]
            if came is None or len(ways) == 1:
                pick = 0
            else:
                back = math.atan2(came[1] - here[1], came[0] - here[0])
                turn = lambda w, h=here, b=back: (b - math.atan2(w[1] - h[1], w[0] - h[0])) % (2 * math.pi) or 2 * math.pi
                pick = max(range(len(ways)), key=lambda k: -turn(ways[k]))
            came, to = here, ways.pop(pick)
            if not ways:
                del onward[here]
            path.append(to)
            if to == start:
                break
        ring = np.array(path)
        before, after = np.roll(ring[:-1], 1, 0), np.roll(ring[:-1], -1, 0)
        leg, then = ring[:-1] - before, after - ring[:-1]
        corner = leg[:, 0] * then[:, 1] != leg[:, 1] * then[:, 0]
        kept = ring[:-1][corner]
        if len(kept) > 2:
            out.append(np.vstack([kept, kept[:1]]))
    return out


# Between Arrow and numpy


def _regions(column: pa.Array) -> Iterator[Rings]:
    for region in column:
        rings = [np.column_stack([r.values.field("x").to_numpy(), r.values.field("y").to_numpy()]) for r in (region if region.is_valid else []) if r.is_valid and len(r) > 3]
        yield [r for r in rings if signed_area(r) != 0]


def _as_rings(regions: list[Rings]) -> pa.Array:
    rings = [r for region in regions for r in region]
    points = np.vstack(rings) if rings else np.zeros((0, 2))
    inner = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rings)]), pa.int32()), pa.StructArray.from_arrays([pa.array(points[:, 0]), pa.array(points[:, 1])], ["x", "y"]))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, regions)]), pa.int32()), inner)


def _flat(regions: list[Rings]) -> pa.Array:
    edges = [np.vstack([ring_edges(r) for r in region]).ravel() if region else np.zeros(0) for region in regions]
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, edges)]), pa.int32()), pa.array(np.concatenate(edges) if edges else np.zeros(0)))


def split(df: DataFrame, key: str, rings: str, most: int = MOST) -> DataFrame:
    """key, part, rings, edges: each region's parts of at most ``most`` points. Null and flat regions have none; areas of parts add up to their region's."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, region in enumerate(_regions(batch.column("rings"))):
                made = parts(oriented(region), most)
                for at in range(0, len(made), 1000):
                    some = made[at : at + 1000]
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays([batch.column("key").slice(k, 1)] * len(some)), pa.array(range(at, at + len(some)), pa.int32()), _as_rings(some), _flat(some)], ["key", "part", "rings", "edges"])

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(F.col(key).alias("key"), F.col(rings).cast(RINGS).alias("rings")), 5000).mapInArrow(cut, f"key {kind}, part int, rings {RINGS}, edges array<double>").withColumnRenamed("key", key)


def refreshed(stored_parts: DataFrame, changed: DataFrame, key: str, rings: str, most: int = MOST) -> DataFrame:
    """The stored parts once some regions have changed: theirs are split anew, all others stay; a changed region that is null has none."""
    return stored_parts.join(changed.select(key), key, "left_anti").unionByName(split(changed, key, rings, most))


def area_of(edges: str = "edges") -> Column:
    """Area of a part by its directed edges."""
    e = F.col(edges)
    first = lambda k: F.element_at(e, k)
    cross = lambda i: (e[i * 4] - first(1)) * (e[i * 4 + 3] - first(2)) - (e[i * 4 + 2] - first(1)) * (e[i * 4 + 1] - first(2))
    return F.when(F.size(e) > 0, F.aggregate(F.sequence(F.lit(0), (F.size(e) / 4 - 1).cast("int")), F.lit(0.0), lambda a, i: a + cross(i)) / 2).otherwise(0.0)


def line_edges(points: Column) -> Column:
    """Edges of a line, an array of struct(x, y)."""
    legs = F.transform(F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))), lambda p, i: F.array(p["x"], p["y"], points[i + 1]["x"], points[i + 1]["y"]))
    return F.flatten(legs)


# Pairs of parts


def padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """[rows, most edges, 4] and which are there; missing ones are a place, the row's first point."""
    counts = np.diff(column.offsets.to_numpy()) // 4
    width = max(1, int(counts.max(initial=0)))
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
    there = np.arange(width) < counts[:, None]
    out = np.zeros((len(counts), width, 4))
    out[there] = values
    return np.where(there[..., None], out, out[:, :1, [0, 1, 0, 1]]), there


def meetings(a: np.ndarray, a_on: np.ndarray, b: np.ndarray, b_on: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where edges of pairs meet: (pair, edge of a, place on it), and whether the pair's edges meet at all."""
    ax, ay, rx, ry = a[:, :, None, 0], a[:, :, None, 1], (a[..., 2] - a[..., 0])[:, :, None], (a[..., 3] - a[..., 1])[:, :, None]
    qx, qy, sx, sy = b[:, None, :, 0] - ax, b[:, None, :, 1] - ay, (b[..., 2] - b[..., 0])[:, None, :], (b[..., 3] - b[..., 1])[:, None, :]
    both = a_on[:, :, None] & b_on[:, None, :]
    across, off = rx * sy - ry * sx, qx * ry - qy * rx
    length2 = rx * rx + ry * ry
    s2 = sx * sx + sy * sy
    parallel = across * across <= SAME**2 * length2 * s2
    with np.errstate(all="ignore"):
        t, u = (qx * sy - qy * sx) / across, off / across
        slack_t, slack_u = same[:, None, None] / np.sqrt(length2), same[:, None, None] / np.sqrt(s2)
        crossing = both & ~parallel & (t >= -slack_t) & (t <= 1 + slack_t) & (u >= -slack_u) & (u <= 1 + slack_u)
        along = both & parallel & (np.abs(off) <= same[:, None, None] * np.sqrt(length2)) & (length2 > 0)
        t0 = (qx * rx + qy * ry) / length2
        t1 = t0 + (sx * rx + sy * ry) / length2
        shared = along & (np.minimum(np.maximum(t0, t1), 1) - np.maximum(np.minimum(t0, t1), 0) >= -slack_t)
    found = []
    for mask, place in ((crossing, t), (shared, t0), (shared, t1)):
        at = np.nonzero(mask)
        found.append((at[0], at[1], place[at]))
    pair, edge, place = (np.concatenate([f[k] for f in found]) for k in range(3))
    return pair, edge, np.clip(place, 0, 1), (crossing | shared).any(axis=(1, 2)), both


def pieces(a: np.ndarray, a_on: np.ndarray, met: tuple, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges of a cut where b meets them: pair, and [n, 4]."""
    n, width = a_on.shape
    own = np.nonzero(a_on)
    pair, edge, place = (np.concatenate(x) for x in zip((own[0], own[1], np.zeros(len(own[0]))), (own[0], own[1], np.ones(len(own[0]))), met, strict=True))
    order = np.lexsort((place, edge, pair))
    pair, edge, place = pair[order], edge[order], place[order]
    go = (pair[1:] == pair[:-1]) & (edge[1:] == edge[:-1])
    pair, edge, low, high = pair[:-1][go], edge[:-1][go], place[:-1][go], place[1:][go]
    e = a[pair, edge]
    delta = e[:, 2:] - e[:, :2]
    long = (high - low) * np.hypot(delta[:, 0], delta[:, 1]) > same[pair]
    pair, e, delta, low, high = pair[long], e[long], delta[long], low[long, None], high[long, None]
    return pair, np.hstack([e[:, :2] + low * delta, e[:, :2] + high * delta])


def placed(pair: np.ndarray, cut: np.ndarray, b: np.ndarray, b_on: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each piece: whether its middle is inside b, and whether it lies on an edge of b, 1 in its direction, -1 against it, 0 not at all."""
    within, on = np.zeros(len(pair), bool), np.zeros(len(pair), np.int8)
    step = max(1, CELLS // b.shape[1])
    for at in range(0, len(pair), step):
        p, c = pair[at : at + step], cut[at : at + step]
        middle, edges, there = (c[:, :2] + c[:, 2:]) / 2, b[p], b_on[p]
        within[at : at + step] = inside(middle[:, None], edges)[:, 0]
        dx, dy = edges[..., 2] - edges[..., 0], edges[..., 3] - edges[..., 1]
        length = np.hypot(dx, dy)
        x, y = middle[:, :1] - edges[..., 0], middle[:, 1:] - edges[..., 1]
        with np.errstate(all="ignore"):
            near = there & (np.abs(x * dy - y * dx) <= 4 * same[p, None] * length) & ((x * dx + y * dy) >= 0) & ((x * dx + y * dy) <= length * length) & (length > 0)
        ways = np.sign((c[:, 2:3] - c[:, :1]) * dx + (c[:, 3:4] - c[:, 1:2]) * dy)
        on[at : at + step] = np.where(near.any(axis=1), np.where((near * ways).sum(axis=1) >= 0, 1, -1), 0)
    return within, on


def measured(a: np.ndarray, a_on: np.ndarray, b: np.ndarray, b_on: np.ndarray, lines: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs: the area that both regions cover, or the length of a's line inside region b, and whether they share a point.

    The common area is bounded by the pieces of each border inside the other region and the pieces that both borders share in one direction; the area is
    the sum of these pieces' cross products.
    """
    a, b = a.copy(), b.copy()
    origin = a[:, :1, :2].copy()
    for x in (a, b):
        x[..., :2] -= origin
        x[..., 2:] -= origin
    extent = np.maximum(np.abs(a).max(axis=(1, 2)), np.abs(b).max(axis=(1, 2)))
    same = SAME * np.maximum(extent, 1e-300)
    *met_a, touch, _ = meetings(a, a_on, b, b_on, same)
    pair, cut = pieces(a, a_on, tuple(met_a), same)
    within, on = placed(pair, cut, b, b_on, same)
    ends_in = (inside(a[..., :2], b) & a_on).any(axis=1)
    if lines:
        size = np.hypot(cut[:, 2] - cut[:, 0], cut[:, 3] - cut[:, 1])
        return np.bincount(pair, np.where(within | (on != 0), size, 0), len(a)), touch | ends_in
    cross = lambda c: c[:, 0] * c[:, 3] - c[:, 2] * c[:, 1]
    area = np.bincount(pair, np.where((within & (on == 0)) | (on == 1), cross(cut), 0), len(a))
    *met_b, _, _ = meetings(b, b_on, a, a_on, same)
    pair, cut = pieces(b, b_on, tuple(met_b), same)
    within, on = placed(pair, cut, a, a_on, same)
    area += np.bincount(pair, np.where(within & (on == 0), cross(cut), 0), len(a))
    return np.maximum(area / 2, 0), touch | ends_in | (inside(b[..., :2], a) & b_on).any(axis=1)


def _celled(df: DataFrame, key: str, p: str, size: float) -> DataFrame:
    """A row for each grid cell that a part's box meets."""
    every = lambda k: F.transform(F.sequence(F.lit(0), (F.size("edges") / 2 - 1).cast("int")), lambda i: F.col("edges")[i * 2 + k])
    boxed = df.where(F.size("edges") > 0).select(F.col(key).alias(f"{p}_key"), F.col("edges").alias(f"{p}_edges"), *[f(every(k)).alias(f"{p}_{c}{n}") for k, c in enumerate("xy") for n, f in enumerate((F.array_min, F.array_max))])
    across = boxed.withColumn("cx_", F.explode(F.sequence(F.floor(F.col(f"{p}_x0") / size), F.floor(F.col(f"{p}_x1") / size))))
    return across.withColumn("cy_", F.explode(F.sequence(F.floor(F.col(f"{p}_y0") / size), F.floor(F.col(f"{p}_y1") / size))))


#: Pairs for each distinct placement from which on placements are measured instead of pairs.
ALIKE = 10
#: Placements that are sent to all tasks, at most.
SENT = 200_000


def _formed(df: DataFrame, p: str) -> DataFrame:
    """Parts with their form, two hashes of the edges from the first point on, and their first point."""
    edges = F.col(f"{p}_edges")
    form = F.transform(edges, lambda e, i: e - edges[i % 2])
    return df.withColumns({f"{p}_form": form, f"{p}_at": F.struct(edges[0].alias("x"), edges[1].alias("y"))}).withColumn(f"{p}_id", F.struct(F.xxhash64(f"{p}_form").alias("h"), F.xxhash64(f"{p}_form", F.lit(1)).alias("i")))


def _whole(df: DataFrame, key: str) -> bool:
    """Whether no region has several parts."""
    return df.groupBy(key).agg(F.count("*").alias("n_")).where("n_ > 1").isEmpty()


def overlaps(a: DataFrame, a_key: str, b: DataFrame, b_key: str, size: float, lines: bool = False, wanted: Column | None = None) -> DataFrame:
    """a_key, b_key, measure of all pairs that share a point; a and b hold parts (key, edges), those of b of regions, of a too unless ``lines``. ``wanted``: a test of a_key and b_key, made before anything is measured.

    Where pairs repeat, two forms one way from each other, each distinct placement is measured once and the pairs look theirs up.

    Parts meet in the grid cells of their boxes, each pair of parts in the lowest common cell alone. The measure, area or length, is summed
    over the parts of a pair: parts of a region share borders only, which have no area; a line's length on such a border is no
    part of two regions' measure but could be of two parts, so lines along a cut are best met by regions that were split elsewhere.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            longest = [max(1, int(np.diff(batch.column(c).offsets.to_numpy()).max(initial=0)) // 4) for c in ("a_edges", "b_edges")]
            step = max(1, CELLS // (longest[0] * longest[1]))
            for at in range(0, batch.num_rows, step):
                some = batch.slice(at, step)
                value, touch = measured(*padded(some.column("a_edges")), *padded(some.column("b_edges")), lines)
                yield pa.RecordBatch.from_arrays([some.column("a_key"), some.column("b_key"), pa.array(value), pa.array(touch)], ["a_key", "b_key", "measure", "touch"])

    # several passes read the parts
    a, b = stored(a.select(a_key, "edges"), "parts"), stored(b.select(b_key, "edges"), "parts")
    left, right = _formed(_celled(a, a_key, "a", size), "a"), _formed(_celled(b, b_key, "b", size), "b")
    meet = (F.col("a_x0") <= F.col("b_x1")) & (F.col("b_x0") <= F.col("a_x1")) & (F.col("a_y0") <= F.col("b_y1")) & (F.col("b_y0") <= F.col("a_y1"))
    once = (F.col("cx_") == F.floor(F.greatest("a_x0", "b_x0") / size)) & (F.col("cy_") == F.floor(F.greatest("a_y0", "b_y0") / size))
    test = meet & once if wanted is None else meet & once & wanted
    kind = lambda df, k: df.schema[k].dataType.simpleString()
    narrow = cell_join(left.drop("a_edges", "a_form"), right.drop("b_edges", "b_form"), ["cx_", "cy_"]).where(test)
    place = [F.col("a_id"), F.col("b_id"), (F.col("b_at")["x"] - F.col("a_at")["x"]).alias("dx_"), (F.col("b_at")["y"] - F.col("a_at")["y"]).alias("dy_")]
    placed_pairs = narrow.select("a_key", "b_key", *place)
    seen = placed_pairs.agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64("a_id", "b_id", "dx_", "dy_")).alias("d")).first()
    if seen["n"] >= ALIKE * seen["d"]:
        forms = lambda df, p: df.groupBy(f"{p}_id").agg(F.first(f"{p}_form").alias(f"{p}_form"))
        places = placed_pairs.select("a_id", "b_id", "dx_", "dy_").distinct().join(forms(left, "a"), "a_id").join(forms(right, "b"), "b_id")
        moved = F.transform("b_form", lambda e, i: e + F.when(i % 2 == 0, F.col("dx_")).otherwise(F.col("dy_")))
        keyed = spread(places.select(F.struct("a_id", "b_id", "dx_", "dy_").alias("a_key"), F.lit(0).alias("b_key"), F.col("a_form").alias("a_edges"), moved.alias("b_edges")))
        known = stored(keyed.mapInArrow(measure, f"a_key {kind(keyed, 'a_key')}, b_key int, measure double, touch boolean").where("touch").select("a_key.*", "measure"), "placements")
        each = placed_pairs.join(F.broadcast(known) if known.count() <= SENT else known, ["a_id", "b_id", "dx_", "dy_"]).select("a_key", "b_key", "measure")
    else:
        pairs = cell_join(left.drop("a_form", "a_id", "a_at"), right.drop("b_form", "b_id", "b_at"), ["cx_", "cy_"]).where(test).select("a_key", "b_key", "a_edges", "b_edges")
        each = pairs.mapInArrow(measure, f"a_key {kind(a, a_key)}, b_key {kind(b, b_key)}, measure double, touch boolean").where("touch").drop("touch")
    # where each region is one part, each pair has one row already
    if _whole(a, a_key) and _whole(b, b_key):
        return each
    return each.groupBy("a_key", "b_key").agg(F.sum("measure").alias("measure"))


def at_distance_zero(a: DataFrame, a_key: str, b: DataFrame, b_key: str, size: float) -> DataFrame:
    """Distinct pairs of regions that share a point, a touching border included."""
    return overlaps(a, a_key, b, b_key, size).select("a_key", "b_key")


def street_codes(lines: DataFrame, key: str, areas: DataFrame, code: str, addresses: DataFrame, size: float, least: float = 7.0, urban: tuple[int, int] = (1000, 1999)) -> DataFrame:
    """key, code, measure: the postal codes of streets: those whose area holds more than ``least`` of its line, and those of its addresses (key, code).

    Urban codes belong to streets, not areas: they come from addresses alone.
    """
    outside = areas.where(~F.col(code).between(*urban))
    on_map = overlaps(lines, key, outside, code, size, lines=True).where(F.col("measure") > least).select(F.col("a_key").alias(key), F.col("b_key").alias(code), "measure")
    named = addresses.select(key, code).distinct().withColumn("measure", F.lit(None).cast("double"))
    return on_map.unionByName(named).groupBy(key, code).agg(F.max("measure").alias("measure"))


def covering(points: DataFrame, point_key: str, x: str, y: str, areas: DataFrame, key: str, size: float) -> DataFrame:
    """point_key, key: the regions, given as parts, that cover each point, borders included; a point on a cut between two parts counts once."""
    cells = _celled(stored(areas.select(key, "edges"), "parts"), key, "b", size)
    at = points.select(F.col(point_key).alias("p_"), F.col(x).alias("x_"), F.col(y).alias("y_")).withColumn("cx_", F.floor(F.col("x_") / size)).withColumn("cy_", F.floor(F.col("y_") / size))
    e, px, py = F.col("b_edges"), F.col("x_"), F.col("y_")
    number = F.sequence(F.lit(0), (F.size("b_edges") / 4 - 1).cast("int"))
    edge = lambda i: (e[i * 4], e[i * 4 + 1], e[i * 4 + 2], e[i * 4 + 3])

    def crossed(i: Column) -> Column:
        ax, ay, bx, by = edge(i)
        return F.coalesce(((ay > py) != (by > py)) & (px < (bx - ax) * (py - ay) / F.nullif(by - ay, F.lit(0.0)) + ax), F.lit(False))

    def on_edge(i: Column) -> Column:
        ax, ay, bx, by = edge(i)
        return ((px - ax) * (by - ay) == (py - ay) * (bx - ax)) & px.between(F.least(ax, bx), F.greatest(ax, bx)) & py.between(F.least(ay, by), F.greatest(ay, by))

    box = px.between(F.col("b_x0"), F.col("b_x1")) & py.between(F.col("b_y0"), F.col("b_y1"))
    hits = cell_join(cells, at, ["cx_", "cy_"]).where(box).where((F.size(F.filter(number, crossed)) % 2 == 1) | F.exists(number, on_edge))
    return hits.select(F.col("p_").alias(point_key), F.col("b_key").alias(key)).distinct()


# Aggregates


def union(df: DataFrame, group: list[str], rings: str) -> DataFrame:
    """group, rings: the union of each group's regions, which may share borders but no area.

    An edge that two regions share runs once each way, so both go; sums of directions by edge, partly made before the shuffle, leave the outline, and only
    outlines are walked. Shared borders must have the same points on both sides.
    """

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("group_"), _flat([oriented(r) for r in _regions(batch.column("rings_"))])], ["group_", "edges_"])

    def walked(table: pa.Table) -> pa.Table:
        e = np.column_stack([table.column(c).to_numpy() for c in ("ax", "ay", "bx", "by")])
        e = np.repeat(e, np.abs(table.column("n").to_numpy()), axis=0)
        return pa.table([table.column("group_").slice(0, 1).combine_chunks(), _as_rings([rings_of(e)])], names=["group_", "rings_"])

    kind = df.select(F.struct(*group).alias("g")).schema["g"].dataType.simpleString()
    flat = df.select(F.struct(*group).alias("group_"), F.col(rings).cast(RINGS).alias("rings_")).mapInArrow(edges, f"group_ {kind}, edges_ array<double>")
    each = flat.select("group_", F.explode(F.transform(F.sequence(F.lit(0), (F.size("edges_") / 4 - 1).cast("int")), lambda i: F.slice("edges_", i * 4 + 1, F.lit(4)))).alias("e"))
    low, high = F.struct(F.col("e")[0].alias("x"), F.col("e")[1].alias("y")), F.struct(F.col("e")[2].alias("x"), F.col("e")[3].alias("y"))
    named = each.where(low != high).select("group_", F.least(low, high).alias("low"), F.greatest(low, high).alias("high"), F.when(low < high, 1).otherwise(-1).alias("way"))
    left = named.groupBy("group_", "low", "high").agg(F.sum("way").alias("n")).where("n <> 0")
    first, then = F.when(F.col("n") > 0, F.col("low")).otherwise(F.col("high")), F.when(F.col("n") > 0, F.col("high")).otherwise(F.col("low"))
    outline = left.select("group_", first["x"].alias("ax"), first["y"].alias("ay"), then["x"].alias("bx"), then["y"].alias("by"), "n")
    return outline.groupBy("group_").applyInArrow(walked, f"group_ {kind}, rings_ {RINGS}").select("group_.*", F.col("rings_").alias(rings))


def collected(df: DataFrame, group: list[str], line: str, order: list[str]) -> DataFrame:
    """group, lines: each group's lines in order, as one multi-line."""
    return df.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(line).alias("line_")))).alias("l_")).select(*group, F.transform("l_", lambda x: x["line_"]).alias("lines"))
