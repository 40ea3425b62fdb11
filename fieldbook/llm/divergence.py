"""Source divergence audit: how far the term shares of a language's sources lie from each other and from the language.

Terms with the same sparse vector of counts by source behave alike, so each distinct vector of a language is kept once, with its
multiplicity: every pair of sources is evaluated once for each distinct vector and the value multiplied. For the report of terms the
best vectors of each source are ranked, and only then do the original terms come back, by a join on the vector.

Shares are p = 1 + floor(SCALE * (count + ADDED) / (N + ADDED * V)) in whole numbers; nothing is rounded elsewhere.

Null text, lang and source: ''. Empty texts hold no terms, but their group occurs: it gives every kept term its share of a zero count. Very long texts are counted
whole. Repeated rows count as often as they are there. Ties are ranked by item. A language without kept terms has pairs of value 0 and no terms.
An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read

#: Documents that a kept term must be in, what is added to each count, the scale of shares, ranks of terms.
LEAST_DOCS, ADDED, SCALE, RANKS = 30, 5, 1_000_000_000, 50
#: Counts that a task holds before it passes them on; cells of a dense block of vectors.
HELD, CELLS = 400_000, 1_000_000

#: Letters become lower case, all other ASCII a blank; other bytes stay, so ``split`` gives the terms.
TERMS = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term, by language and source, of a part of the rows."""

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), words in found.items():
            terms = list(words)
            for at in range(0, len(terms), 50_000):
                some = terms[at : at + 50_000]
                n = len(some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array([w.decode("utf-8", "replace") for w in some], pa.string()), pa.array([words[w] for w in some], pa.int64()), pa.array([docs[lang, source][w] for w in some], pa.int64())],
                    ["lang", "source", "term", "n", "docs"],
                )

    found: dict[tuple, Counter] = defaultdict(Counter)
    docs: dict[tuple, Counter] = defaultdict(Counter)
    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text"), strict=True):
            words = text.as_py().translate(TERMS).split()
            found[lang, source].update(words)
            docs[lang, source].update(set(words))
        if sum(map(len, found.values())) > HELD:
            yield from out()
            found.clear()
            docs.clear()
    yield from out()


def grouped(docs: DataFrame) -> DataFrame:
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(name("lang").alias("lang"), name("source").alias("source"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def kept_terms(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, term, vector: the counts of each kept term by source, sparse and ordered by source."""
    counts = grouped(docs).mapInArrow(counted, "lang string, source string, term string, n long, docs long")
    each = counts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = each.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("vector"))
    return terms.where(F.col("docs") >= least_docs).select("lang", "term", "vector")


def share(count: Column, n: Column, v: Column) -> Column:
    """Exact in whole numbers of up to 38 digits."""
    whole = lambda c: c.cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", whole(count + ADDED) * F.lit(SCALE).cast("decimal(10,0)"), whole(n + v * ADDED))


def exact_shares(counts: np.ndarray, n: np.ndarray, v: int) -> np.ndarray:
    """``share`` of whole arrays: three decimal digits at a time, so that no product leaves 64 bits while N is below 9e15."""
    total = n + v * ADDED
    left, out = counts + ADDED, np.zeros(counts.shape, np.int64)
    out, left = left // total, left % total
    for _ in range(3):
        left = left * 1000
        out, left = out * 1000 + left // total, left % total
    return out + 1


def pair_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of |p - q| of the pairs of sources, over distinct vectors times their multiplicity; one row a pair, language and batch of rows."""
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for lang in dict.fromkeys(langs):
            rows = np.flatnonzero(langs == lang)
            some = batch.take(pa.array(rows))
            first = some.slice(0, 1)
            sources = first.column("sources").to_pylist()[0]
            n, v = np.array(first.column("totals").to_pylist()[0], np.int64), first.column("terms").to_pylist()[0]
            if len(sources) < 2:
                continue
            place = {s: k for k, s in enumerate(sources)}
            sums = np.zeros((len(sources), len(sources)), np.int64)
            step = max(1, CELLS // len(sources))
            for at in range(0, len(rows), step):
                part = some.slice(at, step)
                vectors = part.column("vector")
                owner = np.repeat(np.arange(part.num_rows), vectors.value_lengths().to_numpy())
                cells = vectors.flatten()
                dense = np.zeros((part.num_rows, len(sources)), np.int64)
                dense[owner, [place[s] for s in cells.field("source").to_pylist()]] = cells.field("n").to_numpy()
                times = part.column("times").to_numpy()
                p = exact_shares(dense, n, v)
                for k in range(len(sources) - 1):
                    sums[k, k + 1 :] += times @ np.abs(p[:, k + 1 :] - p[:, k : k + 1])
            a, b = np.triu_indices(len(sources), 1)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array([sources[k] for k in a], pa.string()), pa.array([sources[k] for k in b], pa.string()), pa.array(sums[a, b])], ["lang", "a", "b", "value"])


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value, rank: part ``pair`` of all other sources, part ``term`` of the terms that a source has more of than its language."""
    terms = cut(kept_terms(docs, least_docs), "kept-terms")
    distinct = cut(terms.groupBy("lang", "vector").agg(F.count("*").alias("times")), "term-vectors")
    groups = grouped(docs).select("lang", "source").distinct()
    cells = distinct.select("lang", "times", F.explode("vector").alias("cell"))
    sums = cells.groupBy("lang", F.col("cell.source").alias("source")).agg(F.sum(F.col("cell.n") * F.col("times")).alias("n"))
    sizes = distinct.groupBy("lang").agg(F.sum("times").alias("terms"))
    totals = cut(groups.join(sums, ["lang", "source"], "left").join(sizes, "lang", "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("terms", F.lit(0)).alias("terms")), "group-totals")
    by_lang = totals.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("g"), F.first("terms").alias("terms"), F.sum("n").alias("lang_n"))

    each = distinct.join(by_lang.select("lang", F.col("g.source").alias("sources"), F.col("g.n").alias("totals"), "terms"), "lang")
    values = each.mapInArrow(pair_values, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = values.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value").select("lang", "x.source", "x.item", "value")
    others = totals.select("lang", "source").join(totals.select("lang", F.col("source").alias("item")), "lang").where("source != item")
    pairs = others.join(both, ["lang", "source", "item"], "left").withColumn("value", F.coalesce("value", F.lit(0).cast("long")))

    # each distinct vector once: how far a source's share lies above its language's
    whole = F.aggregate("vector", F.lit(0).cast("long"), lambda a, c: a + c["n"])
    of_lang = share(whole, F.col("lang_n"), F.col("terms"))
    above = distinct.join(by_lang.select("lang", "terms", "lang_n"), "lang").select("lang", "vector", "terms", of_lang.alias("q"), F.explode("vector").alias("cell"))
    above = above.select("lang", "vector", "terms", "q", F.col("cell.source").alias("source"), F.col("cell.n").alias("count")).join(totals.select("lang", "source", "n"), ["lang", "source"])
    above = above.withColumn("value", share(F.col("count"), F.col("n"), F.col("terms")) - F.col("q")).where("value > 0")
    per = Window.partitionBy("lang", "source")
    # a vector stands for a term at least, so terms of the first ranks have vectors of the first ranks
    best = above.withColumn("place", F.rank().over(per.orderBy(F.desc("value")))).where(F.col("place") <= ranks).select("lang", "vector", "source", "value")
    named = best.join(terms, ["lang", "vector"]).select("lang", "source", F.col("term").alias("item"), "value")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(per.orderBy(F.desc("value"), "item")))
    first = ranked(named).where(F.col("rank") <= ranks)
    shown = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return shown(ranked(pairs), "pair").unionByName(shown(first, "term"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"))


ORACLE = r"""
with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
kept as (select lang, term from (select lang, unnest(list_distinct(terms)) as term from d) group by lang, term having count(*) >= 30),
grp as (select distinct lang, source from d),
counts as (select lang, source, term, count(*) as n from (select lang, source, unnest(terms) as term from d) semi join kept using (lang, term) group by all),
dense as (select grp.lang, grp.source, kept.term, coalesce(counts.n, 0) as n from grp join kept on kept.lang = grp.lang left join counts on counts.lang = grp.lang and counts.source = grp.source and counts.term = kept.term),
v as (select lang, count(*) as v from kept group by lang),
p as (select lang, source, term, n, 1 + (1000000000::hugeint * (n + 5)) // (sum(n) over (partition by lang, source) + 5 * v) as p from dense join v using (lang)),
whole as (select lang, term, sum(n) as n from counts group by all),
q as (select lang, term, 1 + (1000000000::hugeint * (n + 5)) // (sum(n) over (partition by lang) + 5 * v) as q from whole join v using (lang)),
pairs as (select a.lang, a.source, b.source as item, coalesce(s.value, 0) as value from grp a join grp b on a.lang = b.lang and a.source <> b.source
 left join (select x.lang, x.source, y.source as item, sum(abs(x.p - y.p)) as value from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all) s on s.lang = a.lang and s.source = a.source and s.item = b.source),
terms as (select p.lang, p.source, p.term as item, p.p - q.q as value from p join q on q.lang = p.lang and q.term = p.term where p.n > 0 and p.p > q.q),
listed as (select lang, source, 'pair' as part, item, value from pairs union all select lang, source, 'term', item, value from terms)
select lang, source, part, item, value::bigint as value, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from listed
qualify part = 'pair' or rank <= 50
"""
