"""Address washing: a raw text's parts, read off its cheapest alignment with the text of a candidate address.

Pairs of texts are aligned in batches: one row of the table of costs is worked out for all pairs at once, and so is one step of the way back.
The way back gives each pair a list of entries (raw character, candidate character; 0 where there is none). Where a field of the candidate ends in that
list, its raw part ends too, moved to the next white space where the field must end at one. What stands between two fields and belongs
to neither is an unknown token. All of it is arrays over the batch; the parts themselves are cut by Spark from offsets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbook.operators import matching
from fieldbook.operators.balanced import SPREAD, spread

FIELDS = ("street", "number", "floor", "door", "locality", "postal", "city")
#: Fields that need not begin, and not end, at white space: floor and door may be written together.
LOOSE_BEGIN, LOOSE_END = "door", "floor"
#: Costs of a raw character without counterpart, of a changed one, and of a candidate's character without counterpart.
INSERT, UPDATE, DELETE = 1, 2, 1
#: Cells of cost tables worked on at once.
CELLS = 8_000_000

_BLANKS = np.array([ord(c) for c in "., "], np.uint32)
_NONE = 0


def address_text(fields: dict[str, Column]) -> Column:
    """A candidate's text: its parts in the order of ``FIELDS``."""
    part = lambda name, before="", after="": F.when(F.coalesce(fields[name], F.lit("")) != "", F.concat(F.lit(before), fields[name], F.lit(after))).otherwise("")
    unit = F.when(fields["floor"].isNotNull() | fields["door"].isNotNull(), ",").otherwise("")
    blank = lambda name: F.coalesce(fields[name], F.lit(""))
    return F.concat(part("street"), part("number", " "), unit, part("floor", " ", "."), part("door", " "), F.lit(", "), part("locality", "", ", "), blank("postal"), F.lit(" "), blank("city"))


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, a row each, and their lengths."""
    sizes = np.array([len(x) for x in texts], np.int64)
    width = max(1, int(sizes.max(initial=0)))
    return np.array(texts, f"U{width}").view(np.uint32).reshape(len(texts), width), sizes


def lowered(codes: np.ndarray) -> np.ndarray:
    known, at = np.unique(codes, return_inverse=True)
    low = [ord(x) if len(x := chr(c).lower()) == 1 else int(c) for c in known]
    return np.array(low, np.uint32)[at].reshape(codes.shape)


def costs(a: np.ndarray, b: np.ndarray, insert: int, update: int, delete: int) -> np.ndarray:
    """[rows of b + 1, pairs, columns of a + 1]: cheapest edits between all beginnings of b and of a.

    In a row, the cheapest run of inserts up to each column is a running minimum of the costs less the inserts up to there.
    """
    n, width = a.shape
    step = np.arange(width + 1, dtype=np.int32) * insert
    table = np.empty((b.shape[1] + 1, n, width + 1), np.int32)
    table[0] = step
    for i in range(1, b.shape[1] + 1):
        row = table[i - 1] + delete
        change = table[i - 1][:, :-1] + np.where(a == b[:, i - 1 : i], 0, update)
        row[:, 1:] = np.minimum(row[:, 1:], change)
        table[i] = np.minimum.accumulate(row - step, axis=1) + step
    return table


def aligned(raw: np.ndarray, raw_size: np.ndarray, other: np.ndarray, other_size: np.ndarray, insert: int = INSERT, update: int = UPDATE, delete: int = DELETE) -> tuple[np.ndarray, np.ndarray]:
    """The cheapest edits from each raw text to its candidate, in order: places in the raw and the candidate text, -1 where an edit has none.

    From the end, a raw character without counterpart is preferred, then a candidate's, then a pair.
    """
    a, b = lowered(raw), lowered(other)
    table = costs(a, b, insert, update, delete)
    rows, i, j = np.arange(len(raw)), other_size.copy(), raw_size.copy()
    steps = []
    while (i > 0).any() or (j > 0).any():
        here, back_i, back_j = table[i, rows, j], np.maximum(i - 1, 0), np.maximum(j - 1, 0)
        left = (j > 0) & (here - table[i, rows, back_j] == insert)
        up = ~left & (i > 0) & (here - table[back_i, rows, j] == delete)
        both = ~left & ~up & (i > 0) & (j > 0)
        steps.append((np.where(left | both, back_j, -1), np.where(up | both, back_i, -1)))
        i, j = np.where(up | both, back_i, i), np.where(left | both, back_j, j)
    if not steps:
        return np.full((len(raw), 1), -1), np.full((len(raw), 1), -1)
    at_raw, at_other = (np.stack([s[k] for s in reversed(steps)], axis=1) for k in range(2))
    # shorter lists end before the first step: their entries move to the front
    shift = ((at_raw < 0) & (at_other < 0)).sum(axis=1)
    order = np.arange(len(steps)) + shift[:, None]
    inside = order < len(steps)
    order = np.minimum(order, len(steps) - 1)
    pick = lambda x: np.where(inside, np.take_along_axis(x, order, 1), -1)
    return pick(at_raw), pick(at_other)


def next_true(flags: np.ndarray) -> np.ndarray:
    """For each place of each row, and the one behind the last, the first place from there on with the flag; the width if there is none."""
    width = flags.shape[1]
    places = np.where(flags, np.arange(width), width)
    places = np.concatenate([places, np.full((len(flags), 1), width)], axis=1)
    return np.minimum.accumulate(places[:, ::-1], axis=1)[:, ::-1]


def read_off(raw: np.ndarray, at_raw: np.ndarray, other: np.ndarray, at_other: np.ndarray, sizes: np.ndarray, strict_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """Bounds of each field in the raw text ([pairs, fields]; equal where nothing of it is there), and unknown tokens as (pairs, starts, ends).

    ``sizes``: characters of each candidate's fields, 0 where it has none; ``strict_end``: whether the field must end at white space.
    """
    n, width = at_raw.shape
    rows = np.arange(n)
    take = lambda codes, at: np.where(at >= 0, np.take_along_axis(codes, np.maximum(at, 0), 1), _NONE)
    own, theirs = take(raw, at_raw), take(other, at_other)
    theirs_blank = np.isin(theirs, _BLANKS)
    solid = (theirs != _NONE) & ~theirs_blank
    hard = next_true(solid)
    passed = np.concatenate([np.zeros((n, 1), np.int64), np.cumsum(theirs != _NONE, axis=1)], axis=1)
    starts, ends = np.zeros(sizes.shape, np.int64), np.zeros(sizes.shape, np.int64)
    at, at_blank, met_unknown, unknown = np.zeros(n, np.int64), np.ones(n, bool), np.zeros(n, bool), []
    extra = np.concatenate([at_raw, np.full((n, 1), -1)], axis=1)
    for field in range(sizes.shape[1]):
        active = sizes[:, field] > 0
        own_blank = np.isin(own, _BLANKS)
        lone = (theirs == _NONE) & ~own_blank  # raw only, no white space; or nothing any more
        first_own, blank_own, other_than_lone = next_true(own != _NONE), next_true(own_blank), next_true(~lone)
        last_own = np.maximum.accumulate(np.where(own != _NONE, np.arange(width), -1), axis=1)
        last_before = lambda x, last=last_own: np.where(x > 0, last[rows, np.maximum(x - 1, 0)], -1)
        behind = np.minimum((passed < (passed[rows, at] + sizes[:, field])[:, None]).sum(axis=1), width)
        end = other_than_lone[rows, behind]
        last = last_before(end)
        blank = np.where(last >= at, own_blank[rows, np.maximum(last, 0)], at_blank)
        closed = (end >= width) | (own_blank[rows, np.minimum(end, width - 1)] & (theirs[rows, np.minimum(end, width - 1)] == _NONE))
        on = active & ~closed & strict_end[:, field] & ~blank
        until = np.where(on, blank_own[rows, end], end)
        first, last = first_own[rows, at], last_before(until)
        found = active & (last >= first) & (first < until)
        starts[:, field] = np.where(found, extra[rows, first], 0)
        ends[:, field] = np.where(found, extra[rows, np.maximum(last, 0)] + 1, 0)
        places = np.arange(width)
        own = np.where(on[:, None] & (places >= end[:, None]) & (places < until[:, None]), _NONE, own)
        at_blank = np.where(active, blank | on, at_blank)
        at = np.where(active, end, at)
        # between two fields
        own_blank = np.isin(own, _BLANKS)
        word, blank_own, first_own = next_true((own != _NONE) & ~own_blank), next_true(own_blank), next_true(own != _NONE)
        last_own = np.maximum.accumulate(np.where(own != _NONE, np.arange(width), -1), axis=1)
        going = active.copy()
        while going.any():
            here, stop = word[rows, at], hard[rows, at]
            gap = going & (here < stop)  # a raw word begins before the next field does
            at = np.where(going & ~gap, stop, at)
            going = gap
            here = np.where(gap, here, 0)
            paired = theirs[rows, here] != _NONE
            ends_first = blank_own[rows, here] <= hard[rows, here]
            at = np.where(gap, here, at)
            going = gap & (paired | ends_first)
            end = np.where(going, np.minimum(blank_own[rows, here], hard[rows, here]), at)
            some = np.flatnonzero(going)
            if len(some):
                unknown.append((some, extra[some, here[some]], extra[some, last_own[some, end[some] - 1]] + 1))
                met_unknown[some] = True
            at = end
        at_blank |= met_unknown
    return starts, ends, unknown


def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        longest = max(1, max((len(x) for c in ("raw_", "other_") for x in batch.column(c).to_pylist()), default=1))
        most = max(1, CELLS // (longest + 1) ** 2)
        for begin in range(0, batch.num_rows, most):
            part = batch.slice(begin, most)
            raw, raw_size = characters(part.column("raw_").to_pylist())
            other, other_size = characters(part.column("other_").to_pylist())
            width = len(FIELDS)
            sizes, strict = (part.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, width) for c in ("sizes_", "strict_"))
            at_raw, at_other = aligned(raw, raw_size, other, other_size)
            starts, ends, unknown = read_off(raw, at_raw, other, at_other, sizes.astype(np.int64), strict.astype(bool))
            pairs, u_start, u_end = (np.concatenate([u[k] for u in unknown]) if unknown else np.zeros(0, np.int64) for k in range(3))
            order = np.lexsort((u_start, pairs))
            counts = np.bincount(pairs, minlength=part.num_rows)
            lists = lambda x, bounds: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(x, pa.int32()))
            even, some = np.arange(part.num_rows + 1) * width, np.concatenate([[0], np.cumsum(counts)])
            made = [lists(starts.ravel(), even), lists(ends.ravel(), even), lists(u_start[order], some), lists(u_end[order], some)]
            yield pa.RecordBatch.from_arrays([*part.columns, *made], [*part.schema.names, "starts_", "ends_", "unknown_starts_", "unknown_ends_"])


def with_fields(pairs: DataFrame, text: str, fields: dict[str, str], out: str = "parsed") -> DataFrame:
    """``pairs`` with ``out``: struct of the raw text's parts, named as ``FIELDS``, null where the candidate has none, and its unknown tokens.

    ``fields`` maps each of ``FIELDS`` to the column of the candidate; leading zeros of number and floor go, "12 B" becomes "12B".
    Null text: as an empty one.
    """
    return _with_fields(spread(pairs), text, fields, out)


def _with_fields(pairs: DataFrame, text: str, fields: dict[str, str], out: str = "parsed") -> DataFrame:
    of = {f: F.col(fields[f]).cast("string") if f in fields else F.lit(None).cast("string") for f in FIELDS}
    blank = {f: F.coalesce(c, F.lit("")) for f, c in of.items()}
    sizes = [F.length(blank[f]) for f in FIELDS]
    digit_end, digit_begin = {f: c.rlike("[0-9]$") for f, c in blank.items()}, {f: c.rlike("^[0-9]") for f, c in blank.items()}

    def strict(k: int) -> Column:
        """Whether field k must end at white space: by itself, as the last, by the next field there is, or as both meet in digits."""
        after = F.lit(True)
        for f in reversed(FIELDS[k + 1 :]):
            begins = F.lit(f != LOOSE_BEGIN) | (digit_end[FIELDS[k]] & digit_begin[f])
            after = F.when(F.length(blank[f]) > 0, begins).otherwise(after)
        return F.lit(FIELDS[k] != LOOSE_END) | after

    ready = pairs.select(F.struct(*pairs.columns).alias("pair_"), F.trim(F.coalesce(F.col(text), F.lit(""))).alias("raw_"), F.trim(address_text(of)).alias("other_"), F.array(*sizes).alias("sizes_"), F.array(*[strict(k) for k in range(len(FIELDS))]).alias("strict_"), F.struct(*[of[f].alias(f) for f in FIELDS]).alias("known_"))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in ready.schema.fields]
    found = ready.mapInArrow(parts_of, ", ".join([*kinds, "starts_ array<int>", "ends_ array<int>", "unknown_starts_ array<int>", "unknown_ends_ array<int>"]))
    cut = lambda a, b: F.substring(F.col("raw_"), a + 1, b - a)
    got = {f: cut(F.col("starts_")[k], F.col("ends_")[k]) for k, f in enumerate(FIELDS)}
    got["number"] = F.regexp_replace(F.ltrim(got["number"], F.lit("0")), "^([0-9]+) ([A-Za-z])$", "$1$2")
    got["floor"] = F.ltrim(got["floor"], F.lit("0"))
    here = {f: F.coalesce(F.col("known_")[f], F.lit("")) != "" for f in FIELDS}
    unknown = F.transform(F.arrays_zip(F.col("unknown_starts_").alias("a"), F.col("unknown_ends_").alias("b")), lambda u: cut(u["a"], u["b"]))
    parsed = F.struct(*[F.when(here[f], got[f]).alias(f) for f in FIELDS], unknown.alias("unknown"))
    return found.select("pair_.*", parsed.alias(out))


#: Edits of a street name up to which it may still be meant.
NEAR = 3


def differences(parsed: Column, fields: dict[str, str]) -> dict[str, Column]:
    """Edits between each part read off a text and the candidate's; a part that one side lacks costs its length. A locality that the text does not name is no difference."""
    out = {}
    for f, column in fields.items():
        got, known = parsed[f], F.nullif(F.col(column).cast("string"), F.lit(""))
        cost = F.when(got.isNotNull() & known.isNotNull(), F.levenshtein(F.lower(got), F.lower(known))).otherwise(F.length(F.coalesce(got, known)))
        out[f] = F.when(F.lit(f != "locality") | (F.coalesce(got, F.lit("")) != ""), cost).cast("long")
    return out


def graded(pairs: DataFrame, text: str, fields: dict[str, str], closest: Column | None = None) -> DataFrame:
    """``pairs`` with ``parsed``, ``differences`` (struct), ``total`` and ``category``: A no difference and no unknown word; B the street alone differs, by ``NEAR`` edits at most, and ``closest`` says that no other street is nearer; else C."""
    found = with_fields(pairs, text, fields)
    each = differences(F.col("parsed"), fields)
    found = found.withColumn("differences", F.struct(*[c.alias(f) for f, c in each.items()]))
    cost = lambda f: F.coalesce(F.col("differences")[f], F.lit(0)) if f in fields else F.lit(0)
    total = sum((cost(f) for f in fields), F.lit(0).cast("long"))
    none_unknown = F.size("parsed.unknown") == 0
    postal = (cost("postal") == 0) | ((F.col("parsed")["postal"] == "") & (cost("city") == 0)) if "postal" in fields else F.lit(True)
    rest = none_unknown & (cost("number") == 0) & postal & (cost("floor") == 0) & (cost("door") == 0)
    near = rest & (cost("street") <= NEAR) & (F.lit(True) if closest is None else closest)
    return found.withColumn("total", total).withColumn("category", F.when((total == 0) & none_unknown, "A").when(near, "B").otherwise("C"))


def washed(pairs: DataFrame, key: list[str], text: str, fields: dict[str, str], order: list[str], closest: Column | None = None) -> DataFrame:
    """One row per text: its best candidate. Candidates of the best category that the text has stay; of these the one with the least difference of postal code, street, number, floor, door, locality in turn, then by ``order``."""
    found = graded(pairs, text, fields, closest)
    by = [F.coalesce(F.col("differences")[f], F.lit(0)) for f in ("postal", "street", "number", "floor", "door", "locality") if f in fields]
    rank = F.struct(F.col("category").alias("a_"), *[c.alias(f"d{k}_") for k, c in enumerate(by)], *[F.col(c).alias(f"o{k}_") for k, c in enumerate(order)])
    rest = [c for c in found.columns if c not in key]
    return found.groupBy(*key).agg(F.min_by(F.struct(*rest), rank).alias("best_")).select(*key, "best_.*")


def best_variant(rows: DataFrame, key: list[str], text: str, choices: dict[str, list[str]], fields: dict[str, str], weights: dict[str, float], unknown_weight: float = 3.0) -> DataFrame:
    """``rows`` with the variant of each that fits the text best: ``choices`` maps a field to the columns that may stand for it (the first one first).

    A variant's score is the sum of its parts' scores and, for each unknown word, 2 + ``unknown_weight`` times its length. Of equal ones the first
    stays, in the order of the choices. Variants stand in a list of each row, so they reach the aligner without meeting other rows.
    """
    # dealt before they grow: tasks of as many variants as rows elsewhere
    tried = spread(rows, max(1, SPREAD // math.prod(len(c) for c in choices.values())))
    for name, columns in choices.items():
        every = F.array(*[F.struct(F.lit(k).alias("place"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for k, c in enumerate(columns)])
        usable = F.filter(every, lambda x: (x["place"] == 0) | (x["value"] != ""))
        tried = tried.withColumn(f"{name}_", F.explode(usable))
    lower = {f: f"variant_{f}" for f in FIELDS}
    chosen = {f: F.col(f"{f}_")["value"] if f in choices else F.coalesce(F.col(fields[f]).cast("string"), F.lit("")) if f in fields else F.lit("") for f in FIELDS}
    tried = tried.withColumns({lower[f]: F.nullif(F.lower(chosen[f]), F.lit("")) for f in FIELDS})
    read = _with_fields(tried, text, lower)
    scores = {f: matching.element_score(F.coalesce(F.col(lower[f]), F.lit("")), F.lower(F.coalesce(F.col("parsed")[f], F.lit(""))), weights[f]) for f in weights}
    unknown = F.aggregate(F.col("parsed")["unknown"], F.lit(0.0), lambda a, u: a + 2 + unknown_weight * F.length(u))
    read = read.withColumns({f"score_{f}": c for f, c in scores.items()}).withColumn("total", sum((F.col(f"score_{f}") for f in scores), unknown))
    place = F.struct(F.col("total").alias("t_"), *[F.col(f"{c}_")["place"].alias(f"p{k}_") for k, c in enumerate(reversed(choices))])
    keep = [c for c in read.columns if c not in key and c not in [f"{c}_" for c in choices]]
    return read.groupBy(*key).agg(F.min_by(F.struct(*keep), place).alias("best_")).select(*key, "best_.*")
