"""Address search: fuzzy candidates, washing order, autocomplete order and cascade."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.operators import matching

__all__ = ["Window", "asked_number", "by_relevance", "caret_wildcard", "cascade", "fuzzy", "ordered_results", "relevance", "version_order"]


def asked_number(query: str) -> tuple[str, int | None]:
    """A query's words without numbers, and its one number; none where there are two or more."""
    numbers = re.findall(r"\b[0-9]+\b", query)
    return " ".join(re.sub(r"\b[0-9]+\b", " ", query).split()), int(numbers[0]) if len(numbers) == 1 else None


def fuzzy(df: DataFrame, name: str, key: str, query: str, narrow: dict[str, object] | None = None, streets: int = 15, most: int = 30) -> DataFrame:
    """The rows of the names nearest to the query by trigrams, narrowed by exact columns, by edit distance then key.

    Only distinct names are compared, and the few that are near enough go back to the rows by a semi join.
    """
    words, _ = asked_number(query)
    near = matching.trigram_top(df.select(name).distinct(), name, words, name, streets).select(name)
    rows = df
    for column, value in (narrow or {}).items():
        rows = rows.filter(F.col(column) == value)
    edits = F.levenshtein(F.col(name), F.lit(words)).cast("long")
    return rows.join(F.broadcast(near), name, "left_semi").withColumn("edits", edits).orderBy("edits", key).limit(most)


def relevance(fields: list[str], required: set[str]) -> list[Column]:
    """Sort columns of washing results: field by field its difference, missing required fields last."""
    return [x for f in fields for x in ([F.col(f).isNull()] if f in required else []) + [F.coalesce(F.col(f), F.lit(0))]]


def by_relevance(df: DataFrame, fields: list[str], required: set[str], key: list[str]) -> DataFrame:
    return df.orderBy(*relevance(fields, required), *key)


def version_order(lo: str, hi: str) -> list[Column]:
    """Versions of one address: those still open first, then by their start."""
    return [F.col(hi).isNotNull(), F.col(lo).asc_nulls_first()]


def ordered_results(df: DataFrame, scores: dict[str, Column], first: list[str], then: list[str]) -> DataFrame:
    """Autocomplete results by the sum of their element scores, then by the scores named first, then by columns."""
    scored = df.withColumns({f"score_{k}": c for k, c in scores.items()})
    total = sum((F.col(f"score_{k}") for k in scores), F.lit(0.0))
    return scored.withColumn("total", total).orderBy("total", *[f"score_{k}" for k in first], *then)


def cascade(steps: list[tuple[str, Callable[[], DataFrame]]], least: int, size: int) -> DataFrame:
    """entity, id: the first entity's results if there are enough of them, else the next one's; the last one's in any case.

    One plan: each step's rows are joined with whether the steps before it have enough, which is at most one row.
    """
    if not steps:
        raise ValueError("a cascade has a step at least")
    out, before = None, []
    for k, (name, make) in enumerate(steps):
        found = make().limit(size)
        rows = found.select(F.lit(name).alias("entity"), "id")
        enough = make().limit(least).agg(F.count("*").alias("n_")).where(F.col("n_") >= least)
        for other in before:
            rows = rows.join(other, F.lit(True), "left_anti")
        if k < len(steps) - 1:
            rows = rows.join(enough, F.lit(True), "left_semi")
        before.append(enough)
        out = rows if out is None else out.unionByName(rows)
    return out


def shown(a: dict[str, Column], locality: bool = False, multiline: bool = False) -> Column:
    """An address as text: street and number, floor and door behind a comma, the locality if asked, postal code and city; on lines of its own with ``multiline``."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    part = lambda f, before, after="": F.when(has(a[f]), F.concat(F.lit(before), a[f], F.lit(after))).otherwise("")
    unit = F.concat(F.when(has(a["floor"]) | has(a["door"]), ",").otherwise(""), part("floor", " ", "."), part("door", " "))
    step = "\n" if multiline else ", "
    place = part("locality", step) if locality else F.lit("")
    return F.concat(a["street"], part("number", " "), unit, place, F.lit(step), a["postal"], F.lit(" "), a["city"])


def suggestions(df: DataFrame, fields: dict[str, str], query: str, large: tuple[str, str] | None = None, locality: bool = False, multiline: bool = False, complete: bool = True) -> DataFrame:
    """A row, or two, for each address found: ``text`` for the input field, ``suggestion`` to choose from, ``caret``, ``large``, ``place``.

    Addresses with a postal code of their own (columns ``large``: code and city) come in both forms: not in the one that the query spells out already, as the other is wanted then, and
    that with the own code first if the query names it. An address that is not complete ends its street part with room for floor and door, where the caret stands.
    """
    a = {f: F.col(fields[f]).cast("string") if f in fields else F.lit(None).cast("string") for f in ("street", "number", "floor", "door", "locality", "postal", "city")}
    forms = [(F.lit(False), a)]
    if large:
        forms.append((F.lit(True), {**a, "postal": F.col(large[0]).cast("string"), "city": F.col(large[1])}))
    asked, whole = F.lit(query), [shown(x, locality) for _, x in forms]

    def form(is_large: Column, x: dict[str, Column]) -> Column:
        full = shown(x, locality)
        before = F.concat(x["street"], F.lit(" "), F.coalesce(x["number"], F.lit("")), F.lit(", "))
        rest = F.concat(F.when(F.lit(locality) & (F.coalesce(x["locality"], F.lit("")) != ""), F.concat(F.lit(", "), x["locality"])).otherwise(""), F.lit(", "), a["postal"], F.lit(" "), a["city"])
        text = full if complete else F.concat(before, rest)
        return F.struct(text.alias("text"), shown(x, locality, multiline).alias("suggestion"), F.length(full if complete else before).alias("caret"), is_large.alias("large"))

    made = [form(*f) for f in forms]
    if not large:
        listed = F.array(made[0])
    else:
        both = F.array_compact(F.array(F.when(asked != whole[1], made[0]), F.when(asked != whole[0], made[1])))
        own_first = (F.size(both) > 1) & F.contains(asked, F.col(large[0]).cast("string"))
        listed = F.when(F.coalesce(F.col(large[0]).cast("string"), F.lit("")) == "", F.array(made[0])).otherwise(F.when(own_first, F.reverse(both)).otherwise(both))
    return df.select("*", F.posexplode(listed).alias("place", "s_")).select(*df.columns, "s_.*", "place")


def caret_wildcard(query: str, caret: int | None = None) -> str:
    """The query with a * at the end of the word that is being typed."""
    at = len(query) if caret is None else min(caret, len(query))
    end = at + len(re.match(r"\w*", query[at:])[0])
    return query[:end] + ("*" if at and query[at - 1].isalnum() else "") + query[end:]


