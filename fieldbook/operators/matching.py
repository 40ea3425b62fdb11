"""Search and matching of short texts: token index, ranks, fuzzy candidates, confidence grades."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldbook.functions import text as tx

#: Weights of token classes A to D.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}


def token_index(df: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """key, token, weight class: one row per distinct token of each field; fields maps columns to classes."""

    def tagged(column: str, kind: str) -> Column:
        return F.transform(tx.tokens(F.col(column)), lambda t: F.struct(t.alias("token"), F.lit(kind).alias("class")))

    each = F.concat(*[tagged(c, k) for c, k in fields.items()])
    return df.select(key, F.explode(each).alias("x")).select(key, "x.*").groupBy(key, "token").agg(F.min("class").alias("class"))


# Fixed value: characters of search terms besides digits and ASCII letters, in lower case.
LETTERS = "æøåäèéëüöóÿ"


def terms(query: str, prefix_last: bool = False) -> list[tuple[str, bool]]:
    """(token, is a prefix) of a query text: a * at a word's end asks for a prefix, and so does the last word while it is being typed, that is if nothing stands behind it.

    Characters that no term has part words, and so does a * inside one; a * alone is nothing.
    """
    text = "".join(c if c == "*" or c in LETTERS or (c.isascii() and c.isalnum()) else " " for c in query.lower())
    words = re.sub(r"\*(?=[^ *])", " ", re.sub(r"\*+", "*", text)).split()
    words = [w for w in words if w != "*"]
    typed = prefix_last and not text.endswith((" ", "*"))
    return [(w.rstrip("*"), w.endswith("*") or (typed and i == len(words) - 1)) for i, w in enumerate(words)]


def rank_of(weight: Column, asked: int, n: Column) -> Column:
    """Rank of a row in millionths: the class weights of the tokens that each of the ``asked`` terms meets, by the limit of the sum of 1 / i^2, the number of terms, and log2(1 + distinct tokens)."""
    return F.round(1_000_000 * weight / (F.lit(1.64493406685 * asked) * F.log2(n + 1))).cast("long")


def match_all(index: DataFrame, key: str, query: str, prefix_last: bool = False) -> DataFrame:
    """key, ``rank`` (``rank_of``) of the rows that have every term."""
    wanted = terms(query, prefix_last)
    if not wanted:
        return index.select(key).limit(0).withColumn("rank", F.lit(0.0))
    hit = lambda t, p: F.col("token").startswith(t) if p else F.col("token") == t
    weight = F.lit(0.0)
    for k, v in WEIGHTS.items():
        weight = F.when(F.col("class") == k, v).otherwise(weight)
    met = reduce(lambda a, b: a + b, [hit(*t).cast("int") for t in wanted])
    tested = index.groupBy(key).agg(*[F.max(hit(t, p)).alias(f"t{i}") for i, (t, p) in enumerate(wanted)], F.sum(weight * met).alias("w"), F.count("*").alias("n"))
    every = F.lit(True)
    for i in range(len(wanted)):
        every = every & F.col(f"t{i}")
    return tested.filter(every).select(key, rank_of(F.col("w"), len(wanted), F.col("n")).alias("rank"))


def match_scan(df: DataFrame, key: str, fields: dict[str, str], query: str, prefix_last: bool = False) -> DataFrame:
    """``match_all`` without a stored index: every row is judged where it is read, and nothing is shuffled."""
    wanted = terms(query, prefix_last)
    hit = lambda x, t, p: x.startswith(t) if p else x == t
    ordered = sorted(fields.items(), key=lambda f: f[1])
    split = df.select(key, *[F.array_distinct(tx.tokens(F.col(c))).alias(f"tokens{i}") for i, (c, _) in enumerate(ordered)])
    own = split.select(key, *[(F.array_except(f"tokens{i}", F.array_union(F.concat(*[f"tokens{j}" for j in range(i)]), F.array().cast("array<string>"))) if i else F.col("tokens0")).alias(f"tokens{i}") for i in range(len(ordered))])
    if not wanted:
        return own.select(key).limit(0).withColumn("rank", F.lit(0.0))
    every = F.concat(*[f"tokens{i}" for i in range(len(ordered))])
    found = own.withColumn("all", every)
    for t, p in wanted:
        found = found.filter(F.exists("all", lambda x: hit(x, t, p)))
    met = lambda column: sum((_filtered(column, hit, *t) for t in wanted), F.lit(0))
    weight = sum((met(f"tokens{i}") * F.lit(WEIGHTS[k]) for i, (_, k) in enumerate(ordered)), F.lit(0.0))
    return found.select(key, rank_of(weight, len(wanted), F.size("all")).alias("rank"))


def _filtered(column: str, hit, term: str, prefix: bool) -> Column:
    """How many tokens of an array a term meets."""
    return F.size(F.filter(column, lambda x: hit(x, term, prefix)))


def name_first(df: DataFrame, key: str, fields: dict[str, str], name: str, query: str, prefix_last: bool = False) -> DataFrame:
    """key, exact, named, rank, edits of the rows that have every term of the query, those that are named so first.

    ``exact`` and ``named`` are ranks in the name alone, of whole words and of words that a term begins; ``rank`` is that over all fields. Edits are those from the query to the name.
    """
    wanted = terms(query, prefix_last)
    split = df.select(key, name, F.array_distinct(tx.tokens(F.col(name))).alias("own_")).join(match_scan(df, key, fields, query, prefix_last), key)

    def within(whole: bool) -> Column:
        hit = lambda x, t, p: x.startswith(t) if p and not whole else x == t
        met = sum((_filtered("own_", hit, *t) for t in wanted), F.lit(0))
        return rank_of(met, len(wanted), F.greatest(F.size("own_"), F.lit(1)))

    edits = F.levenshtein(F.lower(name), F.lower(F.lit(query))).cast("long")
    return split.select(key, within(True).alias("exact"), within(False).alias("named"), "rank", edits.alias("edits")).orderBy(F.desc("exact"), F.desc("named"), F.desc("rank"), "edits", key)


def by_rank_then_edits(found: DataFrame, line: Column, query: str, then: list[str]) -> DataFrame:
    """Search results of one rank by the edits between their text and the query, then by columns such as number, floor and door."""
    return found.withColumn("edits", F.levenshtein(line, F.lit(query)).cast("long")).orderBy(F.desc("rank"), "edits", *then)


def near_names(df: DataFrame, name: str, query: str, looked_at: int = 1000, names: int = 100, costs: tuple[int, int, int] = (2, 3, 1)) -> DataFrame:
    """The rows of the names nearest to the query, with ``edits``: of the ``looked_at`` rows nearest by trigrams the ``names`` nearest distinct names, then weighted edits (insert, update, delete)."""
    counted = df.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n_"))
    d = F.round(tx.trigram_distance(tx.trigrams(F.col(name)), tx.trigrams(F.lit(query))), 6)
    # as many names as rows at most, so a first choice of names bounds what is summed up
    near = counted.withColumn("d_", d).orderBy("d_", name).limit(looked_at)
    before = F.sum("n_").over(Window.orderBy("d_", name)) - F.col("n_")
    some = near.withColumn("before_", before).where(F.col("before_") < looked_at).orderBy("d_", name).limit(names).select(name)
    if costs == (1, 1, 1):
        cost = some.withColumn("edits", F.levenshtein(F.lower(name), F.lower(F.lit(query))).cast("long"))
    else:
        pairs = some.withColumn("a_text", F.lower(name)).withColumn("b_text", F.lower(F.lit(query)))
        cost = edit_cost(pairs, "a_text", "b_text", *costs).select(name, F.col("cost").alias("edits"))
    return df.join(cost, name)


def trigram_top(df: DataFrame, column: str, query: str, key: str, k: int) -> DataFrame:
    """The k rows nearest to the query by trigram distance, then key. Only a top-k goes to one place."""
    d = F.round(tx.trigram_distance(tx.trigrams(F.col(column)), tx.trigrams(F.lit(query))), 6)
    return df.withColumn("distance", d).orderBy("distance", key).limit(k)


def edit_cost(df: DataFrame, a: str, b: str, insert: int, update: int, delete: int) -> DataFrame:
    """df with ``cost``: weighted edit distance from column a to column b, worked out once for each distinct pair of texts."""
    chars = lambda c: F.split(F.col(c), "")

    def row(prev: Column, x: Column) -> Column:
        def cell(done: Column, j: Column) -> Column:
            change = prev[j - 1] + F.when(x == F.col("b_chars_")[j - 1], 0).otherwise(update)
            return F.concat(done, F.array(F.least(prev[j] + delete, F.element_at(done, F.lit(-1)) + insert, change)))

        return F.aggregate("places_", F.array(prev[0] + delete), cell)

    pairs = df.select(a, b).distinct().select(a, b, F.filter(chars(a), lambda x: x != "").alias("a_chars_"), F.filter(chars(b), lambda x: x != "").alias("b_chars_"))
    placed = pairs.withColumn("places_", F.filter(F.sequence(F.lit(0), F.size("b_chars_")), lambda j: j > 0))
    first = F.transform(F.sequence(F.lit(0), F.size("b_chars_")), lambda j: j * insert)
    costs = placed.select(F.col(a).alias("a_"), F.col(b).alias("b_"), F.element_at(F.aggregate("a_chars_", first, row), F.lit(-1)).cast("long").alias("cost"))
    return df.join(costs, F.col(a).eqNullSafe(F.col("a_")) & F.col(b).eqNullSafe(F.col("b_"))).drop("a_", "b_")


def element_score(element: Column, query: Column, weight: float) -> Column:
    """Autocomplete score of one address element: 0 equal, 1 not asked for, 2 asked for by prefix, else 2 + weighted edits.

    What the element has beyond the end of the query is no edit but costs 1 in all: the edits are those to the element's shortest
    beginning from which on every further character costs one more.
    """
    size, lower = F.length(element), F.lower(query)
    costs = F.transform(F.sequence(F.lit(0), size), lambda k: F.levenshtein(F.lower(F.left(element, k)), lower))

    def rated(cs: Column) -> Column:
        end = F.array_max(F.filter(F.sequence(F.lit(0), size), lambda k: (k == 0) | (cs[k] != cs[F.greatest(k - 1, F.lit(0))] + 1)))
        return 2 + cs[end] * weight + F.when(end < size, 1.0).otherwise(0.0)

    edited = F.transform(F.array(costs), rated)[0]
    return F.when(element == query, 0.0).when(query.isNull() | (query == ""), 1.0).when(element.startswith(query), 2.0).otherwise(edited)


def difference(field: Column, given: Column) -> Column:
    """Edits between a register field and the given one; a missing given field costs its length."""
    return F.when(given.isNull(), F.length(field)).otherwise(F.levenshtein(F.coalesce(field, F.lit("")), given))


def confidence(total: Column, exact_rest: Column, street: Column, closest: Column) -> Column:
    """A: no difference at all; B: only the street differs, by 3 edits at most, and no other street is as close; else C."""
    return F.when(total == 0, "A").when(exact_rest & (street <= 3) & closest, "B").otherwise("C")


def variants(df: DataFrame, parts: dict[str, list[str]]) -> DataFrame:
    """One row per distinct combination of alternatives: parts maps a new column to the columns that may stand for it (null columns don't count)."""
    for name, columns in parts.items():
        df = df.withColumn(name, F.explode_outer(F.array_distinct(F.array_compact(F.array(*[F.col(c) for c in columns])))))
    return df
