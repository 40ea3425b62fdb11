"""A stored inverted index: postings range-partitioned by term, so that a term, or a prefix, is a range of few buckets.

``built`` deals the postings out by (term, key) ranges, so a frequent term fills several buckets and no task gets all of it. Each bucket is one folder;
its first and last term are the sorted dictionary, of one entry a bucket. A search reads only the folders whose range meets one of
its terms. Short numeric prefixes, which meet nearly every row, are not looked up at all where another term narrows the search: the tokens of
the keys found so far are fetched from a second table, in folders by key, and tested there.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbook.functions import text as tx
from fieldbook.operators import matching, spelling
from fieldbook.operators.balanced import spread
from fieldbook.operators.stored import stored_by

#: Prefixes that are not looked up where other terms narrow the search: one or two digits.
DIFFICULT = re.compile("^[0-9]{1,2}$")
#: Characters of a whole term, or of a prefix, from which on it narrows a search.
NARROWING, NARROWING_PREFIX = 2, 4

Term = tuple[str, bool]


@dataclass(frozen=True)
class Index:
    """postings: token, key, class, n (the key's tokens), bucket; tokens: key, list (token, class), part; bounds: first and last token of each bucket."""

    key: str
    postings: DataFrame
    tokens: DataFrame
    bounds: list[tuple[int, str, str]]
    parts: int

    def buckets(self, terms: list[Term]) -> list[int]:
        def meets(low: str, high: str, term: str, prefix: bool) -> bool:
            return low <= term <= high if not prefix else high >= term and (low <= term or low.startswith(term))

        return [b for b, low, high in self.bounds if any(meets(low, high, t, p) for t, p in terms)]


def own_tokens(fields: dict[str, str]) -> Column:
    """Distinct tokens of a row, each with the best class of the fields it is in, by token."""
    tagged = lambda c, kind: F.transform(tx.tokens(F.col(c)), lambda x: F.struct(x.alias("token"), F.lit(kind).alias("class")))
    each = F.array_sort(F.concat(*[tagged(c, k) for c, k in fields.items()]))
    # sorted by token, then class: the first of each token is the best one
    # as the one entry of an array it is made once a row, not once a token
    first = lambda tokens: F.filter(tokens, lambda x, i: (i == 0) | (x["token"] != F.coalesce(F.get(tokens, i - 1)["token"], F.lit(""))))
    return F.transform(F.array(each), first)[0]


def with_group_words(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """key, list with the other words of each token's groups(synonyms: array) added, in the token's class: on the index side only, so a query for any word of a group finds them all."""
    each = rows.select("key", F.explode("list").alias("x")).select("key", "x.token", "x.class")
    members = groups.select("synonyms", F.explode("synonyms").alias("token")).select("token", F.explode("synonyms").alias("other"))
    added = each.join(members, "token").select("key", F.col("other").alias("token"), "class")
    best = each.unionByName(added).groupBy("key", "token").agg(F.min("class").alias("class"))
    return best.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("token", "class"))).alias("list"))


def built(df: DataFrame, key: str, fields: dict[str, str], buckets: int = 64, groups: DataFrame | None = None) -> Index:
    """fields maps columns to classes (A to D). Rows without any token are in no answer.

    With ``groups`` of synonyms (as ``spelling.synonym_groups`` gives them) letters are written out first, and each token stands for its groups' words; queries then go through ``spelling.asked``.
    """
    if groups is not None:
        df = df.select(key, *[spelling.written_out(F.col(c)).alias(c) for c in fields])
    rows = spread(df.select(key, *[c for c in fields if c != key])).select(F.col(key).alias("key"), own_tokens(fields).alias("list"))
    if groups is not None:
        rows = with_group_words(rows, groups)
    tokens = stored_by(rows.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")).repartition(buckets, "part"), "tokens", "part")
    each = tokens.select("key", F.size("list").alias("n"), F.explode("list").alias("x")).select("x.token", "key", "x.class", "n")
    ranged = each.repartitionByRange(buckets, "token", "key").sortWithinPartitions("token", "key").withColumn("bucket", F.spark_partition_id())
    postings = stored_by(ranged, "postings", "bucket")
    bounds = postings.groupBy("bucket").agg(F.min("token").alias("low"), F.max("token").alias("high")).orderBy("bucket").collect()  # one row a bucket
    return Index(key, postings, tokens, [(r.bucket, r.low, r.high) for r in bounds], buckets)


def _hit(token: Column, term: Term) -> Column:
    return token.startswith(term[0]) if term[1] else token == term[0]


def _hits(token: Column, terms: list[Term]) -> Column:
    return reduce(Column.__add__, [_hit(token, x).cast("int") for x in terms])


def _weight(kind: Column) -> Column:
    return reduce(lambda w, kv: F.when(kind == kv[0], kv[1]).otherwise(w), matching.WEIGHTS.items(), F.lit(0.0))


def split_terms(terms: list[Term]) -> tuple[list[Term], list[Term]]:
    """(looked up, tested on what these find): the second list is empty where no term narrows."""
    difficult = [t for t in terms if t[1] and DIFFICULT.match(t[0])]
    narrows = any(len(t) >= (NARROWING_PREFIX if p else NARROWING) for t, p in terms if (t, p) not in difficult)
    return ([t for t in terms if t not in difficult], difficult) if narrows and difficult else (terms, [])


def found(index: Index, terms: list[Term]) -> DataFrame:
    """key, rank of the rows that have every term: as ``matching.match_all``, from the buckets of the terms only."""
    if not terms:
        return index.postings.select(F.col("key").alias(index.key), F.lit(0).cast("long").alias("rank")).limit(0)
    first, then = split_terms(terms)
    here = index.postings.where(F.col("bucket").isin(index.buckets(first)) & reduce(Column.__or__, [_hit(F.col("token"), x) for x in first]))
    per_key = here.groupBy("key").agg(*[F.max(_hit(F.col("token"), x)).alias(f"has{i}") for i, x in enumerate(first)], F.sum(_weight(F.col("class")) * _hits(F.col("token"), first)).alias("weight"), F.first("n").alias("n"))
    every = per_key.where(reduce(Column.__and__, [F.col(f"has{i}") for i in range(len(first))]))
    if not then:
        return every.select(F.col("key").alias(index.key), matching.rank_of(F.col("weight"), len(terms), F.col("n")).alias("rank"))
    keys = every.select("key", F.pmod(F.xxhash64("key"), F.lit(index.parts)).cast("int").alias("part"))
    both = index.tokens.join(keys, ["part", "key"])
    some_hit = lambda wanted: lambda y: reduce(Column.__or__, [_hit(y["token"], x) for x in wanted])
    for x in then:
        both = both.where(F.exists("list", some_hit([x])))
    weight = F.aggregate("list", F.lit(0.0), lambda a, y: a + _weight(y["class"]) * _hits(y["token"], terms))
    return both.select(F.col("key").alias(index.key), matching.rank_of(weight, len(terms), F.size("list")).alias("rank"))


def wash_candidates(index: Index, rows: DataFrame, text_of: Column, street: str, postal: str, query: str, most: int = 30, streets: int = 12, costs: tuple[int, int, int] = (2, 3, 1)) -> DataFrame:
    """The rows that may be meant by a raw address, best first: those with all its words by rank, then edits; if there are none, those of the nearest streets by edits.

    ``costs``: insert, update, delete. The way over streets looks at distinct (street, postal) pairs only, narrowed by the one number of four digits of the query if it
    is some row's postal code. Both ways are one plan; the second is empty where the first finds a row.
    """
    key, asked = index.key, F.lower(F.lit(query))
    exact = found(index, [(w, False) for w, _ in matching.terms(query)])
    codes = re.findall("[0-9]{4}", query)
    places = rows.select(street, postal).distinct()
    if len(codes) == 1 and not places.where(F.col(postal).cast("string") == codes[0]).isEmpty():
        places = places.where(F.col(postal).cast("string") == codes[0])
    near = matching.trigram_top(places.withColumn("place_", F.concat_ws(" ", street, postal)), "place_", query, "place_", streets).select(street, postal)
    none = exact.select(F.lit(1).alias("one_")).limit(1)
    fuzzy = rows.join(near, [street, postal], "left_semi").join(none, F.lit(True), "left_anti").select(key, F.lit(0).cast("long").alias("rank"))
    texts = rows.select(key, text_of.alias("text_")).join(exact.unionByName(fuzzy), key).withColumn("asked_", asked).withColumn("lower_", F.lower("text_"))
    if costs == (1, 1, 1):
        rated = texts.withColumn("edits", F.levenshtein("lower_", "asked_").cast("long"))
    else:
        rated = matching.edit_cost(texts, "lower_", "asked_", *costs).withColumnRenamed("cost", "edits")
    return rated.select(key, "rank", "edits", F.col("text_").alias("text")).orderBy(F.desc("rank"), "edits", key).limit(most)
