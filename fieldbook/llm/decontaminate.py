"""Operator 3: benchmark decontamination by SimHash over item-sized windows.

A benchmark item of n words is looked for in every window of n words of every whole text. Words are lower-cased runs of letters and
digits, so punctuation and case don't matter. A window or item is a multiset of five-word shingles
(of n-word shingles where the item has n < 5 words) with weights: the rarer a shingle is among the benchmark's items, the
more it weighs. Windows of weighted Jaccard similarity 0.75 or more are leaks. A text shorter than the item is one window.

* A window that similar has at least three quarters of its shingles in the benchmark, so others are skipped without loss.
* Windows get 64-bit SimHashes from running sums of the shingles' signed bits, so all windows of all lengths are cheap.
* Multi-index: fingerprints are cut into ``BLOCKS`` blocks. Two fingerprints within ``RADIUS`` bits differ in at most
  ``RADIUS // BLOCKS`` bits in one block at least, so probing all block values that near finds every fingerprint within the radius.
* Candidates, nearest first, are compared exactly; a document gets one row per item it leaks.

The benchmark is taken in blocks of bounded size, each sent to all tasks; documents are only read, never shuffled. Shingles
are counted over the whole benchmark, and with each block go those of several items (20 bytes each), so verdicts don't
depend on the blocks.

Null or empty text leaks nothing, and null or wordless items are never found. A very long text is searched whole; of equally near windows the first is taken. Repeated documents give a row each per item;
repeated items each give their row. Null ids stay null. Empty tables give an empty result. Extra columns are ignored by
``leaks`` and kept by ``reject``.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHash, mix64, plain, read, shingle_hashes, slices, small_batches, texts_of, word_hashes

WORDS = 5
SIMILARITY = 0.75
RADIUS = 20
BLOCKS = 7
#: Benchmark text sent to the tasks at once, at most about.
BENCHMARK_BYTES = 2_000_000


def _words(texts: list[bytes], known: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased runs of letters, digits and other non-ASCII characters, end to end, and their number for each text."""
    return word_hashes([plain(t) for t in texts], known, lower=False)


def _signs(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of 64 bits of each hash."""
    bits = np.unpackbits(mix64(hashes ^ np.uint64(0xA0761D6478BD642F)).view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def _packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view(np.uint64).ravel()


def _edges() -> list[tuple[int, int]]:
    """(shift, width) of the blocks of a fingerprint."""
    cuts = [round(64 * i / BLOCKS) for i in range(BLOCKS + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


class Index:
    """Items of one shingle size: shingle weights, fingerprints, and the items behind every block value."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]], k: int, total: int | None = None, shared: dict[int, int] | None = None):
        """total: items of this shingle size in the whole benchmark; shared: shingles of several of them, and of how many. Without these the items are the benchmark."""
        self.k, self.total = k, len(items) if total is None else total
        self.items = [(i, len(w)) for i, w in items]
        shingles, owner = shingle_hashes(np.concatenate([w for _, w in items]), np.array([len(w) for _, w in items]), k)
        self.bags = [Counter(shingles[owner == j].tolist()) for j in range(len(items))]
        seen = Counter(s for bag in self.bags for s in bag) if shared is None else dict.fromkeys((s for bag in self.bags for s in bag), 1) | shared
        self.heaviest = self._weight(0)
        self.known = np.array(sorted(seen), np.uint64)
        self.weights = np.array([self._weight(seen[s]) for s in self.known.tolist()], np.int32)
        self.first = np.zeros(1 << 20, bool)
        self.first[(self.known >> np.uint64(44)).astype(np.int64)] = True
        loads = [np.array(list(b.values()), np.int32) * self._weigh(np.array(list(b), np.uint64)) for b in self.bags]
        self.mass = np.array([int(x.sum()) for x in loads])
        self.prints = np.array([int(_packed((_signs(np.array(list(b), np.uint64)) * x[:, None]).sum(axis=0)[None])[0]) for b, x in zip(self.bags, loads, strict=True)], np.uint64)
        self.by_length: dict[int, np.ndarray] = {n: np.array([j for j, (_, m) in enumerate(self.items) if m == n]) for n in sorted({m for _, m in self.items})}
        # for every length and block: which of its items are near which block values
        self.near_values = {n: [self._near(self.prints[members], *edge) for edge in _edges()] for n, members in self.by_length.items()}

    def _weight(self, df: int) -> int:
        return round(16 * (1 + np.log((1 + self.total) / (1 + max(df, 1)))))

    def _weigh(self, shingles: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, shingles), len(self.known) - 1)
        return np.where(self.known[at] == shingles, self.weights[at], self.heaviest)

    @staticmethod
    def _near(prints: np.ndarray, shift: int, width: int) -> np.ndarray:
        """[block values, items]: whether a value differs from the item's block in few enough bits."""
        mine = ((prints >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
        ones = np.array([v.bit_count() for v in range(1 << width)])
        return ones[np.arange(1 << width)[:, None] ^ mine[None]] <= RADIUS // BLOCKS

    def near(self, length: int, prints: np.ndarray) -> list[tuple[int, int, int]]:
        """(place in prints, item, distance) of all items of that length within the radius."""
        met = np.zeros((len(prints), len(self.by_length[length])), bool)
        for table, (shift, width) in zip(self.near_values[length], _edges(), strict=True):
            met |= table[((prints >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)]
        i, j = np.nonzero(met)
        items = self.by_length[length][j]
        d = np.bitwise_count(prints[i] ^ self.prints[items])
        ok = d <= RADIUS
        return list(zip(i[ok].tolist(), items[ok].tolist(), d[ok].tolist(), strict=True))

    def similarity(self, window: np.ndarray, j: int) -> float:
        bag, mine = self.bags[j], Counter(window.tolist())
        both = either = 0
        every = list(bag.keys() | mine.keys())
        for s, w in zip(every, self._weigh(np.array(every, np.uint64)).tolist(), strict=True):
            a, b = bag.get(s, 0), mine.get(s, 0)
            both += w * min(a, b)
            either += w * max(a, b)
        return both / either

    def leaks(self, words: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """(text, item, first word of the window, distance, similarity), one for each item that a text leaks."""
        k = self.k
        long = counts >= k
        shingles, owner = shingle_hashes(words[np.repeat(long, counts)], np.where(long, counts, 0), k)
        if not len(shingles):
            return []
        hit = self.first[(shingles >> np.uint64(44)).astype(np.int64)]
        maybe = np.flatnonzero(hit)
        at = np.minimum(np.searchsorted(self.known, shingles[maybe]), len(self.known) - 1)
        right = self.known[at] == shingles[maybe]
        weight = np.full(len(shingles), self.heaviest, np.int32)
        weight[maybe[right]] = self.weights[at[right]]
        hit[:] = False
        hit[maybe[right]] = True
        out = []
        ends = np.cumsum(np.bincount(owner, minlength=len(counts)))
        for i in np.unique(owner[hit]).tolist():
            lo, hi = (int(ends[i - 1]) if i else 0), int(ends[i])
            out += [(i, *x) for x in self._leaks_of(shingles[lo:hi], weight[lo:hi], hit[lo:hi])]
        return out

    def _leaks_of(self, shingles: np.ndarray, weight: np.ndarray, hit: np.ndarray) -> Iterator[tuple[int, int, float]]:
        n = len(shingles)
        hits = np.concatenate([[0], np.cumsum(hit)])
        if hits[-1] < SIMILARITY * min(n, min(self.by_length) - self.k + 1):
            return
        todo = []
        for length, members in self.by_length.items():
            m = length - self.k + 1
            if m > n:
                # the whole text is the one window; what it shares weighs no more than its known shingles
                if hits[-1] < SIMILARITY * n or weight[hit].sum() < SIMILARITY * self.mass[members].min():
                    continue
                m = n
            starts = np.flatnonzero(hits[m:] - hits[:-m] >= SIMILARITY * m)
            if len(starts):
                todo.append((length, m, starts, members))
        if not todo:
            return
        lo = min(int(s[0]) for _, _, s, _ in todo)
        hi = max(int(s[-1]) + m for _, m, s, _ in todo)
        base = lo
        sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(_signs(shingles[lo:hi]) * weight[lo:hi, None], axis=0, dtype=np.int32)])
        for length, m, starts, _ in todo:
            prints = _packed(sums[starts - base + m] - sums[starts - base])
            done: set[int] = set()
            for i, j, d in sorted(self.near(length, prints), key=lambda x: (x[2], starts[x[0]])):
                if j in done:
                    continue
                first = int(starts[i])
                if (s := self.similarity(shingles[first : first + m], j)) >= SIMILARITY:
                    done.add(j)
                    yield j, first, d, s


def _shared_shingles(benchmark: DataFrame) -> tuple[dict[int, int], dict[int, dict[int, int]]]:
    """By shingle size: the number of items, and the shingles of several items with the number of these."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for b in slices(batches):
            sizes, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            words, counts = _words(texts_of(b), known)
            for w in np.split(words, np.cumsum(counts)[:-1]) if len(counts) else []:
                if len(w):
                    k = min(WORDS, len(w))
                    # 0 stands for the item itself
                    hashes += [np.unique(shingle_hashes(w, np.array([len(w)]), k)[0]), np.zeros(1, np.uint64)]
                    sizes += [np.full(len(hashes[-2]), k), np.array([-k])]
            yield pa.record_batch([pa.array(np.concatenate(sizes)), pa.array(np.concatenate(hashes).view(np.int64))], ["k", "s"])

    total, shared = defaultdict(int), defaultdict(dict)
    for r in benchmark.select("text").mapInArrow(emit, "k long, s long").groupBy("k", "s").agg(F.count("*").alias("n")).filter("k < 0 or n > 1").toLocalIterator():
        if r["k"] < 0:
            total[-r["k"]] = r["n"]
        else:
            shared[r["k"]][r["s"] % (1 << 64)] = r["n"]
    return total, shared


def indexes(items: list[tuple[int | None, str | None]], total: dict[int, int], shared: dict[int, dict[int, int]]) -> list[Index]:
    known = WordHash()
    by_k: dict[int, list] = defaultdict(list)
    for i, text in items:
        words, _ = _words([(text or "").encode()], known)
        if len(words):
            by_k[min(WORDS, len(words))].append((i, words))
    return [Index(v, k, total[k], shared[k]) for k, v in sorted(by_k.items())]


def _benchmark_blocks(benchmark: DataFrame) -> Iterator[list[Index]]:
    """The benchmark in blocks of about BENCHMARK_BYTES, however large it is."""
    total = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // BENCHMARK_BYTES)
    counted = _shared_shingles(benchmark) if n else None
    for b in range(n):
        part = benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).select(F.col("item_id").cast("long"), "text")
        yield indexes([(r[0], r[1]) for r in part.collect()], *counted)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, first_word, distance, similarity of every leak."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, item_id long, first_word long, distance int, similarity double"
    out = docs.sparkSession.createDataFrame([], schema)
    for block in _benchmark_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = WordHash()
            for b in slices(batches):
                ids, rows = b.column("doc_id").to_pylist(), []
                words, counts = _words(texts_of(b), known)
                for index in shared.value:
                    rows += [(ids[i], index.items[j][0], first, d, s) for i, j, first, d, s in index.leaks(words, counts)]
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64()), strict=True)], ["doc_id", "item_id", "first_word", "distance", "similarity"])

        out = out.union(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(find, schema))
    return out


def reject(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without leaks, with all their columns; the verdict is made where the text is, so nothing is shuffled."""
    small_batches(docs.sparkSession)
    out = docs
    for block in _benchmark_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = WordHash()
            for b in slices(batches):
                words, counts = _words(texts_of(b), known)
                clean = np.ones(b.num_rows, bool)
                for index in shared.value:
                    clean[[x[0] for x in index.leaks(words, counts)]] = False
                yield b.filter(pa.array(clean))

        out = out.mapInArrow(keep, docs.schema)
    return out


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
