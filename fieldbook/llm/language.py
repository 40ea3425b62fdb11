"""Operator 5: language identification by prediction by partial matching (PPM).

Each language has a byte context tree of orders 0 to 3. Spark counts, over all labelled training documents, how often each
byte follows each context of up to three bytes; the counts are then frozen. A byte's probability under a language is
PPM's, method C with exclusion: in the longest context that the tree has, a byte seen n times among N with D distinct
bytes gets n / (N + D), and with D / (N + D) the coder escapes to the next shorter context without the bytes already
excluded; below order 0 all bytes left are equally likely. The code length of a text is the exact sum over its bytes; the
language with the shortest code wins, and the score is its share of likelihood per byte against the others.

A code length only depends on four-byte windows, so each distinct window is coded once and texts are sums over windows.
Texts are lower-cased, other characters than letters and apostrophes become single blanks.

Trees are of bounded size: at most ``NODES`` (context, byte) pairs are kept, those with the highest counts; the limit on
counts is found from a histogram, so it is one rule at all sizes. Null text or a text without letters is ``und`` with score 0; so
is everything if there is nothing to learn from. A very long text is coded whole; of languages with equal codes the first by name wins. Repeated rows and ids give a row each; a null id stays null, is learned
from, and is not held out. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_of, read, slices

ORDER = 3
#: (context, byte) pairs of all languages that the trees keep, at most; 16 bytes each.
NODES = 1_500_000
#: Languages learned at most: those with the most documents.
LANGUAGES = 200
_OTHER = re.compile(r"[^\w']+|[\d_]+")


def normal(text: str) -> bytes:
    """Lower case; runs of other characters than letters and apostrophes become one blank, with one blank at either end."""
    return b" " + " ".join(_OTHER.sub(" ", text.lower()).split()).encode() + b" "


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The four-byte windows (big-endian numbers) that end at each byte of each text, end to end, and their number for each text. A text is preceded by three blanks."""
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer(b"".join(b"   " + t for t in texts), np.uint8).astype(np.uint32)
    keys = (flat[:-3] << 24) | (flat[1:-2] << 16) | (flat[2:-1] << 8) | flat[3:] if len(flat) > 3 else np.zeros(0, np.uint32)
    owner = np.repeat(np.arange(len(texts)), sizes + 3)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes + 3) - sizes - 3, sizes + 3)
    keep = (place >= 3)[3:] if len(flat) > 3 else np.zeros(0, bool)
    return keys[keep], np.bincount(owner[place >= 3], minlength=len(texts)).astype(np.int64) if len(flat) else sizes


class Tree:
    """One language's contexts: context -> {byte: count}; a context is (length, number of its bytes)."""

    def __init__(self):
        self.contexts: dict[tuple[int, int], dict[int, int]] = {}

    def add(self, length: int, context: int, byte: int, n: int) -> None:
        self.contexts.setdefault((length, context), {})[byte] = n

    def bits(self, context: int, byte: int) -> float:
        """Code length of a byte after the three bytes of ``context``."""
        out, excluded = 0.0, set()
        for k in range(ORDER, -1, -1):
            seen = self.contexts.get((k, context & ((1 << 8 * k) - 1)))
            if not seen:
                continue
            if excluded:
                total = sum(n for b, n in seen.items() if b not in excluded)
                distinct = sum(b not in excluded for b in seen)
            else:
                total, distinct = sum(seen.values()), len(seen)
            if not distinct:
                continue
            if byte in seen and byte not in excluded:
                return out - np.log2(seen[byte] / (total + distinct))
            if len(excluded) + distinct < 256:
                out -= np.log2(distinct / (total + distinct))
            excluded.update(seen)
        return out + np.log2(256 - len(excluded))


class Model:
    """All languages' trees, sent to the tasks; code lengths of windows are remembered in sorted arrays."""

    def __init__(self, langs: list[str], rows: tuple[np.ndarray, ...]):
        self.langs, self.rows, self.trees = langs, rows, None

    def _grow(self) -> None:
        self.trees = [Tree() for _ in self.langs]
        for g, k, c, b, n in zip(*(x.tolist() for x in self.rows), strict=True):
            self.trees[g].add(k, c, b, n)
        self.known, self.costs = np.zeros(0, np.uint32), np.zeros((0, len(self.langs)), np.float32)

    def lengths(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each text [texts, languages], and its bytes."""
        if self.trees is None:
            self._grow()
        keys, counts = windows(texts)
        owner = np.repeat(np.arange(len(texts)), counts)
        distinct, back = np.unique(keys, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        have = (at < len(self.known)) & (self.known[np.minimum(at, max(len(self.known) - 1, 0))] == distinct) if len(self.known) else np.zeros(len(distinct), bool)
        costs = np.empty((len(distinct), len(self.langs)), np.float32)
        costs[have] = self.costs[at[have]]
        new = distinct[~have]
        fresh = np.array([[t.bits(w >> 8, w & 255) for t in self.trees] for w in new.tolist()], np.float32).reshape(len(new), len(self.langs))
        costs[~have] = fresh
        if len(self.known) + len(new) <= 2_000_000:
            order = np.argsort(np.concatenate([self.known, new]), kind="stable")
            self.known, self.costs = np.concatenate([self.known, new])[order], np.concatenate([self.costs, fresh])[order]
        out = np.empty((len(texts), len(self.langs)))
        for g in range(len(self.langs)):
            out[:, g] = np.bincount(owner, weights=costs[back, g], minlength=len(texts))
        return out, counts

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        ready = [normal(t or "") for t in texts]
        letters = np.array([bool(t) and any(c.isalpha() for c in t) for t in texts], bool)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        bits, n = self.lengths(ready)
        # share of likelihood, with the evidence of at most 64 bytes so that long texts don't all come out as 1
        gap = (bits - bits.min(axis=1, keepdims=True)) / np.maximum(n, 1)[:, None] * np.minimum(n, 64)[:, None]
        share = 1 / np.exp2(-gap).sum(axis=1)
        best = bits.argmin(axis=1)
        return [self.langs[g] if ok else "und" for g, ok in zip(best.tolist(), letters.tolist(), strict=True)], np.where(letters, share, 0.0)


def _texts(b: pa.RecordBatch) -> list[str | None]:
    return b.column("text").to_pylist()


def fit(docs: DataFrame, nodes: int = NODES) -> Model:
    """The frozen trees, from all rows of docs(text, lang) with both; the caller chooses the rows it may learn from."""
    spark = docs.sparkSession
    usable = docs.filter("text is not null and lang is not null").select("text", "lang")
    top = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    langs = sorted(r["lang"] for r in top)
    if not langs:
        return Model([], ())
    shared = spark.sparkContext.broadcast({g: i for i, g in enumerate(langs)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # counts of windows within the task; shorter contexts follow from these by summing
        held: dict[int, list[np.ndarray]] = {}
        for b in slices(batches):
            owners = np.array([shared.value.get(g, -1) for g in b.column("lang").to_pylist()])
            texts = _texts(b)
            for g in np.unique(owners[owners >= 0]).tolist():
                keys, _ = windows([normal(t) for t, o in zip(texts, owners.tolist(), strict=True) if o == g])
                key, n = np.unique(keys, return_counts=True)
                if g in held:
                    key, back = np.unique(np.concatenate([held[g][0], key]), return_inverse=True)
                    n = np.bincount(back, weights=np.concatenate([held[g][1], n])).astype(np.int64)
                held[g] = [key, n]
                if len(key) > 1_000_000:
                    yield _rows(g, *held.pop(g))
        for g, (key, n) in held.items():
            yield _rows(g, key, n)

    counted = usable.mapInArrow(count, "g int, w long, n long").groupBy("g", "w").agg(F.sum("n").alias("n"))
    # a (context, byte) pair of every order; shorter orders are sums of the longest
    orders = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.shiftright("w", 8).bitwiseAND((1 << 8 * k) - 1)).alias("c")) for k in range(ORDER + 1)]))
    pairs = counted.select("g", F.col("w").bitwiseAND(255).alias("b"), "n", orders.alias("x")).groupBy("g", "x.k", "x.c", "b").agg(F.sum("n").alias("n"))
    sized = pairs.groupBy(F.floor(F.log2("n") * 4).alias("bin")).agg(F.count("*").alias("pairs"), F.min("n").alias("least"))
    room, least = nodes, None
    for r in sorted(sized.collect(), key=lambda r: -r["bin"]):
        if r["pairs"] > room:
            break
        room, least = room - r["pairs"], r["least"]
    kept = pairs.filter(F.col("n") >= (least or 1)).select("g", "k", "c", "b", "n").toArrow()
    return Model(langs, tuple(kept[c].to_numpy() for c in ("g", "k", "c", "b", "n")))


def _rows(g: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.full(len(key), g, np.int32)), pa.array(key.astype(np.int64)), pa.array(n.astype(np.int64))], ["g", "w", "n"])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2_000_000):
            lang, share = shared.value.predict(_texts(b))
            yield pa.record_batch([b.column("doc_id").cast(pa.int64()), pa.array(lang, pa.string()), pa.array(share)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, lang_pred string, score double")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = F.coalesce(fold_of("doc_id", 4) == 2, F.lit(False))
    model = fit(docs.filter(~held))
    return identify(docs, model).select("doc_id", F.coalesce(fold_of("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
