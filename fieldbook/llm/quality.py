"""Operator 10: quality rules with n-gram perplexity bands.

Base rules fail texts that are short or repeat themselves. The method's verdict on the others is a perplexity band: Spark
counts the byte 5-grams of all documents by language, and modified Kneser-Ney probabilities are made of these counts
(raw counts for the longest order, continuation counts below, three discounts for each order and language). Probabilities
and back-off weights are stored in sorted arrays of 64-bit hashes. Every whole text gets its perplexity per byte under
its language; the band of a language reaches from three interquartile ranges below to three above the quartiles of
the documents that pass the base rules, so that both babble and boilerplate far from the language's bulk are rejected.

Text for the model is lower-cased, with runs of white space as one blank. The arrays hold at most ``ENTRIES`` n-grams: the most frequent
5-grams, by a limit found from a histogram, and all their endings. Windows that the arrays don't settle leave the task as rows and get their probability by joins
with the whole tables, so every text has the perplexity that arrays without a limit would give. Each language has its own model. Null text has no words and fails; a null lang is a language of its own. Repeated rows and ids give a row
each; a null id stays null. A very long text is scored whole; ties don't occur, as every text is judged by itself. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHash, cut, mix64, read, shingle_hashes, slices, texts_of, word_hashes

ORDER = 5
#: n-grams and their contexts sent to all tasks, at most; 12 bytes each. The others are joined.
ENTRIES = 1_500_000
#: Languages known by number in all tasks, at most; the others are known by a hash of their name.
LANGUAGES = 1 << 16
#: Stands for a null lang inside.
NO_LANG = "\x00"
#: Bands, and discounts, sent to all tasks, at most; more are joined.
BANDS_SENT = 10_000
FENCE = 3.0
STEADY = 2000
_BASE = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"

_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_STARTS = np.array([(b & 0xC0) != 0x80 and b not in (9, 10, 11, 12, 13, 32) for b in range(256)])
_SYMBOLS = np.array([b in b"#*$%&|<>" for b in range(256)])


def _per_text(flags: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(flags)])
    ends = np.cumsum(sizes)
    return run[ends] - run[ends - sizes]


def repeated_words(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Words of each text that lie in a 3-word window found twice or more in it."""
    long = counts >= 3
    grams, owner = shingle_hashes(words[np.repeat(long, counts)], np.where(long, counts, 0), 3)
    if not len(grams):
        return np.zeros(len(counts), np.int64)
    _, back, n = np.unique(mix64(grams ^ mix64(owner.astype(np.uint64))), return_inverse=True, return_counts=True)
    # windows start at the words' places; the last two words of a text start none
    starts = np.cumsum(counts) - counts
    first = np.cumsum(np.where(long, counts - 2, 0)) - np.where(long, counts - 2, 0)
    place = starts[owner] + np.arange(len(grams)) - first[owner]
    covered = np.zeros(len(words) + 2, bool)
    hit = place[n[back] > 1]
    for k in range(3):
        covered[hit + k] = True
    return _per_text(covered[: len(words)], counts)


def base_counts(texts: list[bytes], known: WordHash) -> list[np.ndarray]:
    words, n = word_hashes(texts, known, lower=False)
    flat, sizes = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts], np.int64)
    dup = []
    for t in texts:
        lines = [x for x in t.split(b"\n") if x.strip()]
        dup.append(len(lines) - len(set(lines)))
    return [n, _per_text(_STARTS[flat], sizes), _per_text(_SYMBOLS[flat], sizes), np.array(dup, np.int64), repeated_words(words, n)]


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 5-byte windows ending at each byte of each normalised text, as numbers, and their number for each text."""
    ready = [b" ".join(t.lower().split()) + b" " for t in texts]
    flat = np.frombuffer(b"".join(b"    " + t for t in ready), np.uint8).astype(np.uint64)
    sizes = np.array([len(t) for t in ready], np.int64)
    if not len(ready):
        return np.zeros(0, np.uint64), sizes
    keys = flat[: len(flat) - 4].copy()
    for k in range(1, ORDER):
        keys = (keys << np.uint64(8)) | flat[k : len(flat) - 4 + k]
    keep = np.ones(len(flat), bool)
    heads = np.cumsum(sizes + 4) - sizes - 4
    for k in range(4):
        keep[heads + k] = False
    return keys[keep[4:]], sizes


def _hash(lang: np.ndarray, order: np.ndarray | int, key: np.ndarray) -> np.ndarray:
    return mix64(mix64(np.asarray(lang, np.uint64) * np.uint64(16) + np.asarray(order, np.uint64)) ^ key.astype(np.uint64))


class KneserNey:
    """Sorted hash arrays: n-gram -> discounted probability, context -> back-off weight; ``tables``, of the driver only: all n-grams (g, k, w, p) and contexts (g, k, c, v) where the arrays lack some."""

    def __init__(self, langs: list[str], grams: tuple[np.ndarray, np.ndarray], contexts: tuple[np.ndarray, np.ndarray], tables: tuple[DataFrame, DataFrame] | None = None):
        self.langs, self.tables, self.whole = {g: i for i, g in enumerate(langs)}, tables, tables is None
        self.grams, self.contexts = (self._sorted(*x) for x in (grams, contexts))

    def __getstate__(self) -> dict:
        return {**self.__dict__, "tables": None}

    @staticmethod
    def _sorted(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key)
        return key[order], value[order].astype(np.float32)

    @staticmethod
    def _look(arrays: tuple[np.ndarray, np.ndarray], key: np.ndarray, default: float) -> np.ndarray:
        keys, values = arrays
        if not len(keys):
            return np.full(len(key), default)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        return np.where(keys[at] == key, values[at], default)

    def log_probability(self, lang: np.ndarray, window: np.ndarray) -> np.ndarray:
        """Natural log of P(last byte | four before) for windows under languages (numbers)."""
        p = np.full(len(window), 1 / 256)
        for k in range(1, ORDER + 1):
            gram = window & np.uint64((1 << 8 * k) - 1)
            p = self._look(self.grams, _hash(lang, k, gram), 0.0) + self._look(self.contexts, _hash(lang, k, gram >> np.uint64(8)), 1.0) * p
        return np.log(p)

    def settled(self, lang: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shortest order of each window that the arrays lack, ``ORDER`` + 1 if they have all, and the probability by the orders before it."""
        p, order = np.full(len(window), 1 / 256), np.full(len(window), ORDER + 1)
        for k in range(1, ORDER + 1):
            gram = window & np.uint64((1 << 8 * k) - 1)
            own = self._look(self.grams, _hash(lang, k, gram), np.nan)
            order = np.where(np.isnan(own) & (order > k), k, order)
            p = np.where(order > k, own + self._look(self.contexts, _hash(lang, k, gram >> np.uint64(8)), 1.0) * p, p)
        return order, p

    def costs(self, texts: list[bytes], langs: list[str]) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
        """Of each text: the negative log probability of its windows that the arrays settle, and the number of all its windows; and the open ones as (text, language, window, order, p, times), by text."""
        keys, sizes = windows(texts)
        owner = np.repeat(np.arange(len(texts)), sizes)
        number, local = _numbers(langs, self.langs)
        # 40 bits of window, the language's place in the batch above
        distinct, back = np.unique(keys | (local[owner] << np.uint64(40)), return_inverse=True)
        lang, window = number[(distinct >> np.uint64(40)).astype(np.int64)], distinct & np.uint64((1 << 40) - 1)
        if self.whole:
            cost, lacking = -self.log_probability(lang, window), np.zeros(len(distinct), bool)
            order, p = np.zeros(len(distinct), np.int64), cost
        else:
            order, p = self.settled(lang, window)
            lacking = order <= ORDER
            cost = np.where(lacking, 0.0, -np.log(p))
        at = lacking[back]
        pairs, times = np.unique(np.stack([owner[at], back[at]]), axis=1, return_counts=True) if at.any() else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
        return np.bincount(owner, weights=cost[back], minlength=len(texts)), sizes, (pairs[0], lang[pairs[1]], window[pairs[1]], order[pairs[1]], p[pairs[1]], times)


def _numbers(langs: list[str], known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the distinct languages, and each one's place among them. Languages without a number have 56 bits of a hash, above all numbers."""
    names, local = np.unique(np.array(langs, object), return_inverse=True) if langs else (np.zeros(0, object), np.zeros(0, np.int64))
    hashed = lambda name: LANGUAGES + int.from_bytes(hashlib.blake2b(name.encode(), digest_size=7).digest(), "big")
    return np.array([known[x] if x in known else hashed(x) for x in names], np.uint64), local.astype(np.uint64)


def _named(lang) -> F.Column:
    return F.coalesce(lang, F.lit(NO_LANG))


def fit(docs: DataFrame, entries: int = ENTRIES) -> KneserNey:
    """The model, from the counts of all rows of docs(text, lang)."""
    spark = docs.sparkSession
    usable = docs.select("text", _named(F.col("lang")).alias("lang")).filter("text is not null")
    langs = sorted(r["lang"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect())
    shared = spark.sparkContext.broadcast({g: i for i, g in enumerate(langs)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, number, key, n = {}, [], np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            lang = np.array(number, np.int64)[(key >> np.uint64(40)).astype(np.int64)] if len(key) else np.zeros(0, np.int64)
            return pa.record_batch([pa.array(lang), pa.array((key & np.uint64((1 << 40) - 1)).astype(np.int64)), pa.array(n)], ["g", "w", "n"])

        for b in slices(batches):
            keys, sizes = windows(texts_of(b))
            numbers, local = _numbers(b.column("lang").to_pylist(), shared.value)
            for g in numbers.tolist():
                if g not in place:
                    place[g] = len(number)
                    number.append(g)
            lang = np.array([place[g] for g in numbers.tolist()], np.uint64)[local.astype(np.int64)]
            one, m = np.unique(keys | (np.repeat(lang, sizes) << np.uint64(40)), return_counts=True)
            both, back = np.unique(np.concatenate([key, one]), return_inverse=True)
            key, n = both, np.bincount(back, weights=np.concatenate([n, m])).astype(np.int64)
            if len(key) > 1_000_000:
                yield out()
                place, number, key, n = {}, [], np.zeros(0, np.uint64), np.zeros(0, np.int64)
        yield out()

    top = cut(usable.mapInArrow(count, "g long, w long, n long").groupBy("g", "w").agg(F.sum("n").alias("n")), "ngrams")
    # continuation counts: in how many longer n-grams an n-gram is the end; most: the highest count of a 5-gram that ends in it
    tables = {ORDER: top.withColumn("most", F.col("n"))}
    for k in range(ORDER - 1, 0, -1):
        tables[k] = tables[k + 1].groupBy("g", F.col("w").bitwiseAND((1 << 8 * k) - 1).alias("w")).agg(F.count("*").alias("n"), F.max("most").alias("most"))
    every = tables[ORDER].withColumn("k", F.lit(ORDER))
    for k in range(ORDER - 1, 0, -1):
        every = every.unionByName(tables[k].withColumn("k", F.lit(k)))
    every = cut(every, "ngrams")
    d = cut(_discounts(every), "discounts")
    d = F.broadcast(d) if d.count() <= BANDS_SENT else d
    context = F.shiftright("w", 8).alias("c")
    sums = every.groupBy("g", "k", context).agg(F.sum("n").alias("total"), *[F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2)], F.count_if(F.col("n") > 2).alias("n3"))
    weights = sums.join(d, ["g", "k"]).select("g", "k", "c", "total", ((F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * F.col("n3")) / F.col("total")).alias("v"))
    least, whole = _limit(every, entries // 2)
    less = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    rated = lambda grams: grams.withColumn("c", F.shiftright("w", 8)).join(weights, ["g", "k", "c"]).join(d, ["g", "k"]).select("g", "k", "w", (F.greatest(F.col("n") - less, F.lit(0.0)) / F.col("total")).alias("p"), "c", "v", "most")
    grams = rated(every) if whole else cut(rated(every), "ngrams")
    got = grams.where(F.col("most") >= least).drop("most").toArrow()
    g, k, w, p, c, v = (got[x].to_numpy() for x in ("g", "k", "w", "p", "c", "v"))
    ctx, at = np.unique(_hash(g, k, c), return_index=True)
    full = None if whole else (grams.select("g", "k", "w", "p"), grams.groupBy("g", "k", "c").agg(F.first("v").alias("v")))
    return KneserNey(langs, (_hash(g, k, w), p), (ctx, v[at]), full)


def _discounts(every: DataFrame) -> DataFrame:
    """g, k, d1, d2, d3: modified Kneser-Ney discounts of counts 1, 2 and 3 or more; plain fractions where counts of counts are missing."""
    of = every.groupBy("g", "k").agg(*[F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)])
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    some = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0)
    rate = lambda i: F.least(F.greatest(i - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}")), F.lit(0.05)), F.lit(i - 0.05))
    return of.select("g", "k", *[F.when(some, rate(i)).otherwise(plain).alias(f"d{i}") for i, plain in ((1, 0.5), (2, 0.75), (3, 0.9))])


def _limit(every: DataFrame, room: int) -> tuple[int, bool]:
    """Least count of the 5-grams that are kept, with all their endings, within the room; and whether these are all."""
    bins = every.groupBy(F.floor(F.log2("most") * 4).alias("bin")).agg(F.count("*").alias("c"), F.min("most").alias("least")).collect()
    least = 1 << 62
    for r in sorted(bins, key=lambda r: -r["bin"]):
        if r["c"] > room:
            return least, False
        room -= r["c"]
        least = r["least"]
    return least, True


_OPEN = "g long, w long, k int, p double, n long"


def assess(docs: DataFrame, model: KneserNey) -> DataFrame:
    """doc_id, lang, the base counts and log_perplexity of every row: the mean negative log probability of a byte."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for b in slices(batches, 4_000_000):
            texts, langs = texts_of(b), b.column("lang").to_pylist()
            cols = [pa.array(x.astype(np.int64)) for x in base_counts(texts, known)]
            cost, sizes, (owner, *rest) = shared.value.costs(texts, langs)
            bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))])
            kinds = (np.int64, np.int64, np.int32, np.float64, np.int64)
            entries = pa.StructArray.from_arrays([pa.array(x.astype(t)) for x, t in zip(rest, kinds, strict=True)], ["g", "w", "k", "p", "n"])
            rows = [b.column("row"), b.column("doc_id").cast(pa.int64()), pa.array(langs, pa.string()), *cols, pa.array(cost), pa.array(sizes), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), entries)]
            yield pa.record_batch(rows, ["row"] + [c.split()[0] for c in _BASE.split(", ")] + ["cost", "size", "open"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text", _named(F.col("lang")).alias("lang"))
    scored = rows.mapInArrow(score, f"row long, {_BASE}, cost double, size long, open array<struct<{_OPEN.replace(' ', ':').replace(',:', ',')}>>")
    cost = F.col("cost")
    if not model.whole:
        scored = cut(scored, "perplexities")
        scored, cost = scored.join(_open_costs(scored.select("row", F.inline("open")), *model.tables), "row", "left"), cost + F.coalesce("open_cost", F.lit(0.0))
    return scored.select(*[c.split()[0] for c in _BASE.split(", ")], F.round(cost / F.greatest("size", F.lit(1)), 12).alias("log_perplexity"))


def _open_costs(windows: DataFrame, grams: DataFrame, contexts: DataFrame) -> DataFrame:
    """row, open_cost: the negative log probability of windows (row, g, w, k, p, n), n times each, from their order k on, below which it is p."""
    once = windows.groupBy("g", "w").agg(F.first("k").alias("k"), F.first("p").alias("below"))
    each = once.select("g", F.col("w").alias("window"), "below", F.explode(F.sequence("k", F.lit(ORDER))).alias("k")).withColumn("w", F.expr("window & (shiftleft(1L, 8 * k) - 1)")).withColumn("c", F.shiftright("w", 8))
    found = each.join(grams, ["g", "k", "w"], "left").join(contexts, ["g", "k", "c"], "left")
    steps = F.array_sort(F.collect_list(F.struct("k", F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("v", F.lit(1.0)).alias("v"))))
    p = found.groupBy("g", F.col("window").alias("w")).agg(F.first("below").alias("below"), steps.alias("steps")).select("g", "w", F.aggregate("steps", F.col("below"), lambda a, x: x["p"] + x["v"] * a).alias("chance"))
    return windows.join(p, ["g", "w"]).groupBy("row").agg(F.sum(-F.col("n") * F.log("chance")).alias("open_cost"))


def rate(docs: DataFrame, model: KneserNey | None = None, fence: float = FENCE) -> DataFrame:
    """The rows of ``assess`` with base_failed, the language's band and kept."""
    scored = cut(assess(docs, model or fit(docs)), "perplexities").withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    q = scored.filter("not base_failed").groupBy("lang").agg(F.percentile_approx("log_perplexity", F.array(F.lit(0.25), F.lit(0.75)), 10_000).alias("q"))
    spread = F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(0.01)) * fence
    bands = q.select("lang", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), spread.alias("spread"))
    reach = F.col("spread") * F.sqrt(1 + F.lit(STEADY) / F.greatest(F.col("word_chars") + F.col("n_words"), F.lit(1)))
    bands = cut(bands, "bands")
    bands = F.broadcast(bands) if bands.count() <= BANDS_SENT else bands
    banded = scored.join(bands, "lang", "left").withColumn("lang", F.nullif("lang", F.lit(NO_LANG))).withColumn("lower", F.col("low") - reach).withColumn("upper", F.col("high") + reach).drop("low", "high", "spread")
    return banded.withColumn("kept", ~F.col("base_failed") & F.col("log_perplexity").between(F.col("lower"), F.col("upper")))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = rate(read(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.coalesce("kept", F.lit(False)).alias("kept"), "log_perplexity")
