"""Operator 6: language-model scores of a hashed maximum-entropy model with class-factored softmax.

P(token | history) is the product of choices down a tree of classes: a class, a class inside it and so on, at last the word
among its class's members. Every choice, the last one included, is a softmax over at most ``BRANCH`` children whose features
are the node together with the history: the previous word, the two previous words (n-grams) and the second word back (a
skip), all hashed into one table of weights. What the features add to is the log of the child's share of the node's
tokens. Words are put in the tree by the lang they occur in most and then by count, and each node is split into children of
about equal mass, so frequent words need few choices.

Words seen less than ``LEAST`` times, or beyond the ``VOCAB`` most frequent ones, are one leaf of the tree; among these a word's
probability is its discounted share of their counts, and the rest is that of an unknown word. Their counts come by a join,
so every word has its own probability and base scores and n_known are exact.

* Counts: by word over all training documents, shuffled after summing within tasks; nothing is left out.
* Training: distributed gradient updates. The training texts are dealt by hash into ``ROUNDS`` rounds, so every token is learned
  from once. In each round learners (tasks of about ``SHARE`` tokens, at most ``LEARNERS``) take Adagrad steps over their tokens from the shared weights; their rows are averaged, weighted by the squared gradients that each has seen,
  in a tree of bounded fan-in. The table has four rows a known word, at most ``1 << MOST_BITS``.
* Scoring: sparse numpy batches of (token, node) pairs.

Null text is empty text: the end token only. A very long text is scored whole, in batches. Words of equal count are put in the order of their hashes.
Repeated rows and ids give a row each; rows without an id are training rows and not held out. Without training rows the base
score is that of unknown words and the model knows the end and unknown words only. An empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop_cut, fold_of, mix64, read, slices, texts_of

#: Words in the tree, at most; about 60 bytes each are sent to all tasks.
VOCAB = 1 << 19
LEAST = 3
BRANCH = 16
LEAST_BITS, MOST_BITS = 12, 19
ROUNDS = 2
RATE = 0.5
BATCH = 1 << 12
SHARE, LEARNERS = 6_000_000, 4096
FAN_IN = 64
BLOCK = 256
END, START, RARE = np.uint64(0x5EED0E4D), np.uint64(0x5EED57A7), np.uint64(0x5EEDAAAA)
_NEXT = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(0xD6E8FEB86659FD93)
FEATURES = 3


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A random number for each byte, the same for A-Z as for a-z.
_LETTERS = mix64(np.arange(1, 257, dtype=np.uint64))
_LETTERS[ord("A") : ord("Z") + 1] = _LETTERS[ord("a") : ord("z") + 1]
#: Words hashed at a time.
_PIECE = 1 << 16


class _Powers:
    """Powers of ``_NEXT`` and of its inverse modulo 2^64, as many as were needed so far."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            inverse = np.uint64(pow(int(_NEXT), -1, 1 << 64))
            cls.up, cls.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(2 * n, x))]) for x in (_NEXT, inverse))
        return cls.up, cls.down


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in lower case, end to end, and the number of words of each text.

    A word's hash is that of the polynomial of its bytes; all words of a piece are differences of one running sum.
    """
    flat = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    blank = _SPACE[flat]
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    ends = np.flatnonzero(blank & np.concatenate([[False], ~blank[:-1]]))
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    first = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
    out = np.empty(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(starts), _PIECE):
            s, e = starts[i : i + _PIECE], ends[i : i + _PIECE]
            low, n = s[0], e[-1] - s[0]
            up, down = _Powers.upto(int(n))
            run = np.zeros(n + 1, np.uint64)
            np.cumsum(_LETTERS[flat[low : low + n]] * up[:n], out=run[1:])
            out[i : i + _PIECE] = mix64((run[e - low] - run[s - low]) * down[s - low] + (e - s).astype(np.uint64))
    return out, np.diff(first)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text and one end, end to end; the number of tokens of each."""
    words, counts = word_hashes(texts)
    out = np.full(len(words) + len(texts), END, np.uint64)
    out[np.arange(len(words)) + np.repeat(np.arange(len(texts)), counts)] = words
    return out, counts + 1


def features(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Hashes [tokens, FEATURES] of what stands before each token."""
    place = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
    back = []
    for k in (1, 2):
        w = np.full(len(flat), START, np.uint64)
        w[k:] = np.where(place[k:] >= k, flat[:-k] if len(flat) > k else flat[:0], START)
        back.append(w)
    with np.errstate(over="ignore"):
        kinds = [back[0], back[1] ^ (back[0] * _NEXT), back[1]]
        return np.column_stack([mix64(x + np.uint64(i + 1) * _NEXT) for i, x in enumerate(kinds)])


class Vocabulary:
    """Sorted hashes of the frequent words, the end and the rare leaf, with their counts and their paths (node, child) in the tree."""

    _first = None

    def __init__(self, words: np.ndarray, counts: np.ndarray, group: np.ndarray, total: int, distinct: int, rare: tuple[int, int, float]):
        """rare: tokens, distinct words and discount of the words that are not listed."""
        self.total, self.distinct = total, distinct
        self.rare_mass, self.rare_words, self.discount = rare
        if not len(words) or not (words == END).any():
            words, counts, group = np.append(words, END), np.append(counts, 0), np.append(group, -1)
        words, counts, group = np.append(words, RARE), np.append(counts, self.rare_mass), np.append(group, -1)
        order = np.argsort(words)
        self.words, self.counts, group = words[order], counts[order], group[order]
        self.base = np.log10((self.counts + 0.1) / self.denominator)
        self._plant(np.lexsort((self.words, -self.counts, group)))

    def _plant(self, order: np.ndarray) -> None:
        """Split nodes into children until every word is a leaf; order: the words as they lie side by side in the tree."""
        mass = np.maximum(self.counts[order], 0.5)
        node, steps, at = np.zeros(len(order), np.int64), [], 0
        live = np.arange(len(order))
        priors, size = [], 0
        while len(live):
            heads = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            n = np.diff(np.append(heads, len(live)))
            m, own = mass[live], np.repeat(np.arange(len(heads)), n)
            before, whole = np.cumsum(m) - m, np.add.reduceat(m, heads)
            middle = (before - before[heads][own] + m / 2) / whole[own]
            child = np.where((n <= BRANCH)[own], np.arange(len(live)) - heads[own], np.minimum((middle * BRANCH).astype(np.int64), BRANCH - 1))
            # children are numbered without gaps
            new = np.concatenate([[True], (child[1:] != child[:-1]) | (own[1:] != own[:-1])])
            rank = np.cumsum(new) - 1
            child = rank - rank[heads][own]
            prior = np.full((len(heads), BRANCH), -np.inf, np.float32)
            prior[own[new], child[new]] = np.log(np.add.reduceat(m, np.flatnonzero(new)) / whole[own[new]])
            priors.append(prior)
            steps.append((order[live], size + own, child))
            size += len(heads)
            alone = np.bincount(rank)[rank] == 1
            live, node = live[~alone], rank[~alone]
        word, where, child = (np.concatenate(x) for x in zip(*steps, strict=True))
        by_word = np.argsort(word, kind="stable")
        self.nodes, self.children = where[by_word].astype(np.int32), child[by_word].astype(np.int8)
        self.depth = np.bincount(word, minlength=len(order))
        self.starts = np.cumsum(self.depth) - self.depth
        self.priors = np.concatenate(priors)
        self.salts = mix64(np.arange(1, len(self.priors) + 1, dtype=np.uint64))
        self.bits = int(np.clip(np.ceil(np.log2(4 * len(order))), LEAST_BITS, MOST_BITS))

    @property
    def denominator(self) -> float:
        return self.total + 0.1 * (self.distinct + 1)

    def look(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each token, the rare leaf's for those not listed, and whether it is listed."""
        if self._first is None:
            # the first word of each range of hashes; most words are the only one of theirs
            self._shift = np.uint64(64 - int(np.ceil(np.log2(4 * len(self.words)))))
            edges = np.arange(1 << (64 - int(self._shift)), dtype=np.uint64) << self._shift
            self._first = np.minimum(np.searchsorted(self.words, edges), len(self.words) - 1).astype(np.int32)
        at = self._first.take((flat >> self._shift).astype(np.int64)).astype(np.int64)
        here = self.words.take(at) == flat
        miss = np.flatnonzero(~here)
        at[miss] = np.minimum(np.searchsorted(self.words, flat[miss]), len(self.words) - 1)
        here[miss] = self.words[at[miss]] == flat[miss]
        at[~here] = np.searchsorted(self.words, RARE)
        return at, here

    def choices(self, at: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The choices of tokens at places ``at``: their token, node, child, and rows [choices, FEATURES] of the weights."""
        depth = self.depth[at]
        token = np.repeat(np.arange(len(at)), depth)
        pair = np.arange(len(token)) - np.repeat(np.cumsum(depth) - depth, depth) + np.repeat(self.starts[at], depth)
        node = self.nodes[pair]
        with np.errstate(over="ignore"):
            rows = ((hashes[token] ^ self.salts.take(node)[:, None]) * _TURN) >> np.uint64(64 - self.bits)
        return token, node, self.children[pair].astype(np.int64), rows.astype(np.int64)


def _levels(weights: np.ndarray, priors: np.ndarray, node: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Scores [choices, BRANCH] of the children, within what exp takes; children that a node lacks have the least."""
    z = priors.take(node, axis=0)
    for f in range(rows.shape[1]):
        z += weights.take(rows[:, f], axis=0)
    return np.clip(z, -60, 60, out=z)


def _residual(weights: np.ndarray, priors: np.ndarray, node: np.ndarray, child: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Gradient [choices, BRANCH] of the negative log likelihood by the scores."""
    g = _levels(weights, priors, node, rows)
    np.exp(g, out=g)
    g /= np.einsum("ij->i", g)[:, None]
    g[np.arange(len(child)), child] -= 1
    return g


def _gradient(g: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows and the sums of g over them."""
    order = np.sort((rows << 32) | np.arange(len(rows)))
    key = order >> 32
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    n = np.diff(np.append(head, len(key)))
    at = order & 0xFFFFFFFF
    sums = g.take(at[head], axis=0)
    # most rows occur once; only the others are added up
    many = np.flatnonzero(n > 1)
    if len(many):
        mine = np.repeat(n > 1, n)
        starts = np.cumsum(n[many]) - n[many]
        sums[many] = np.add.reduceat(g.take(at[mine], axis=0), starts, axis=0)
    return key[head], sums


def _step(weights: np.ndarray, squares: np.ndarray, priors: np.ndarray, node: np.ndarray, child: np.ndarray, rows: np.ndarray) -> None:
    """One Adagrad step, with one rate a row, on the negative log likelihood of the choices."""
    g = _residual(weights, priors, node, child, rows)
    whole = weights.view(f"V{weights.itemsize * BRANCH}").ravel()
    for f in range(rows.shape[1]):
        at, grad = _gradient(g, rows[:, f])
        sums = squares[at] + np.einsum("ij,ij->i", grad, grad)
        squares[at] = sums
        grad *= (RATE / np.sqrt(sums))[:, None]
        # whole rows are put back as one item each
        whole[at] = np.subtract(weights.take(at, axis=0), grad, out=grad).view(whole.dtype).ravel()


def _is_held(doc_id="doc_id"):
    return F.coalesce(fold_of(doc_id, 10) == 0, F.lit(False))


def count(docs: DataFrame) -> DataFrame:
    """word (hash), lang, n of all tokens of docs(text, lang), once per word and lang; written once."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}

        def rows(g: str) -> pa.RecordBatch:
            key, n = held.pop(g)
            return pa.record_batch([pa.array(key.view(np.int64)), pa.array([g] * len(key), pa.string()), pa.array(n)], ["word", "lang", "n"])

        for b in slices(batches):
            texts, langs = texts_of(b), np.array([x or "" for x in b.column("lang").to_pylist()], object)
            for g in dict.fromkeys(langs.tolist()):
                flat, _ = tokens([t for t, x in zip(texts, langs, strict=True) if x == g])
                key, n = np.unique(flat, return_counts=True)
                if g in held:
                    key, back = np.unique(np.concatenate([held[g][0], key]), return_inverse=True)
                    n = np.bincount(back, weights=np.concatenate([held[g][1], n])).astype(np.int64)
                held[g] = [key, n.astype(np.int64)]
                if len(key) > 500_000:
                    yield rows(g)
        for g in list(held):
            yield rows(g)

    return docs.select("text", "lang").mapInArrow(emit, "word long, lang string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))


def vocabulary(counted: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary, and the counts table (word, n) of all words."""
    words = cut(counted.groupBy("word").agg(F.sum("n").alias("n"), F.max_by("lang", F.struct("n", "lang")).alias("lang")), "word-counts")
    sums = words.agg(F.sum("n"), F.count("*")).first()
    total, distinct = sums[0] or 0, sums[1]
    # exact counts up to 64, then bins of a quarter of a doubling: the least count that keeps the vocabulary in bounds
    level = F.when(F.col("n") <= 64, F.col("n")).otherwise(64 + F.floor(4 * F.log2(F.col("n") / 64)))
    bins = sorted(words.groupBy(level.alias("l")).agg(F.count("*").alias("c"), F.min("n").alias("least")).collect(), key=lambda r: -r["l"])
    room, least = VOCAB, None
    for r in bins:
        if r["c"] > room or r["least"] < LEAST:
            break
        room, least = room - r["c"], r["least"]
    end = int(END.view(np.int64))
    often = (F.col("n") >= least) if least is not None else F.lit(False)
    top = words.filter(often | (F.col("word") == end)).toArrow()
    few = {r["l"]: r["c"] for r in bins}
    n1, n2 = few.get(1, 0), few.get(2, 0)
    discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    rare = words.filter(~often & (F.col("word") != end)).agg(F.sum("n"), F.count("*")).first()
    langs = top["lang"].to_pylist()
    mass: dict[str, int] = {}
    for g, n in zip(langs, top["n"].to_pylist(), strict=True):
        mass[g] = mass.get(g, 0) + n
    number = {g: i for i, g in enumerate(sorted(mass, key=lambda g: (-mass[g], g)))}
    group = np.array([number[g] for g in langs], np.int64)
    return Vocabulary(top["word"].to_numpy().view(np.uint64), top["n"].to_numpy(), group, total, distinct, (rare[0] or 0, rare[1], discount)), words.select("word", "n")


_DELTA = "part long, block int, used binary, rows binary"


def _average(deltas: DataFrame, parts: int, bits: int) -> np.ndarray:
    """Weights averaged over learners, row by row, by squared gradients (used): deltas(part, block, used, rows) are summed up a tree of at most FAN_IN at a time."""

    def add(key: tuple, t: pa.Table) -> pa.Table:
        used, rows = np.zeros(BLOCK), np.zeros((BLOCK, BRANCH))
        for u, r in zip(t["used"].to_pylist(), t["rows"].to_pylist(), strict=True):
            n = np.frombuffer(u, np.float32)
            used += n
            rows += np.frombuffer(r, np.float16).reshape(BLOCK, BRANCH) * n[:, None]
        mean = (rows / np.maximum(used, 1e-12)[:, None]).astype(np.float16)
        return pa.table({"part": pa.array([key[1].as_py()], pa.int64()), "block": pa.array([key[0].as_py()], pa.int32()), "used": pa.array([used.astype(np.float32).tobytes()]), "rows": pa.array([mean.tobytes()])})

    while True:
        deltas = deltas.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("block", "part").applyInArrow(add, _DELTA)
        parts = -(-parts // FAN_IN)
        if parts == 1:
            break
    out = np.zeros((1 << bits, BRANCH), np.float32)
    got = deltas.select("block", "rows").toArrow()
    for b, r in zip(got["block"].to_pylist(), got["rows"].to_pylist(), strict=True):
        out[b * BLOCK : (b + 1) * BLOCK] = np.frombuffer(r, np.float16).reshape(BLOCK, BRANCH)
    return out


def train(docs: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> np.ndarray:
    """Weights [rows, BRANCH], learned from all tokens of docs(text)."""
    sc = docs.sparkSession.sparkContext
    weights = None
    known_words = sc.broadcast(vocab)
    parts = int(np.clip(-(-vocab.total // (SHARE * rounds)), 1, LEARNERS))
    for k in range(rounds):
        shared = sc.broadcast(None if weights is None else weights.astype(np.float16))

        def learn(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            vocab = known_words.value
            weights = np.zeros((1 << vocab.bits, BRANCH), np.float32) if shared.value is None else shared.value.astype(np.float32)
            squares = np.ones(len(weights), np.float32)
            for b in slices(batches, 1_000_000):
                flat, counts = tokens(texts_of(b))
                at, _ = vocab.look(flat)
                hashes = features(vocab.words[at], counts)
                for i in range(0, len(flat), BATCH):
                    _, node, child, rows = vocab.choices(at[i : i + BATCH], hashes[i : i + BATCH])
                    _step(weights, squares, vocab.priors, node, child, rows)
            part, used = TaskContext.get().partitionId(), squares - 1
            blocks = [i for i in range(len(weights) // BLOCK) if used[i * BLOCK : (i + 1) * BLOCK].any()]
            for i in range(0, len(blocks), 64):
                some = blocks[i : i + 64]
                cols = [[x[j * BLOCK : (j + 1) * BLOCK].astype(kind).tobytes() for j in some] for x, kind in ((used, np.float32), (weights, np.float16))]
                yield pa.record_batch([pa.array([part] * len(some), pa.int64()), pa.array(some, pa.int32()), *(pa.array(c, pa.binary()) for c in cols)], ["part", "block", "used", "rows"])

        weights = _average(docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(rounds)) == k).coalesce(parts).mapInArrow(learn, _DELTA), parts, vocab.bits)
        shared.destroy()
    known_words.destroy()
    return weights


def log_choices(vocab: Vocabulary, weights: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Natural log of the product of each token's choices; its place in the vocabulary, and whether it is listed."""
    at, here = vocab.look(flat)
    hashes, logs = features(vocab.words[at], counts), np.empty(len(flat))
    for i in range(0, len(flat), BATCH):
        token, node, child, rows = vocab.choices(at[i : i + BATCH], hashes[i : i + BATCH])
        z = _levels(weights, vocab.priors, node, rows)
        p = z[np.arange(len(child)), child]
        p -= np.log(np.einsum("ij->i", np.exp(z, out=z)))
        logs[i : i + BATCH] = np.bincount(token, weights=p, minlength=len(at[i : i + BATCH]))
    return logs, at, here


def score(docs: DataFrame, vocab: Vocabulary, words: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every row of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast((vocab, weights.astype(np.float16)))
    kind = pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int64())]))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, half = shared.value
        weights = half.astype(np.float32)
        for b in slices(batches, 1_000_000):
            flat, counts = tokens(texts_of(b))
            logs, at, here = log_choices(vocab, weights, flat, counts)
            logs /= np.log(10)
            owner = np.repeat(np.arange(len(counts)), counts)
            base = np.where(here, vocab.base[at], 0.0)
            # an end never met in training is listed, with no count
            met = here & (vocab.counts[at] > 0)
            sums = [np.bincount(owner, weights=x, minlength=len(counts)) for x in (base, logs, met)]
            rest = ~here
            mine, word = owner[rest], flat[rest]
            order = np.lexsort((word, mine))
            mine, word = mine[order], word[order]
            head = np.flatnonzero(np.concatenate([[True], (mine[1:] != mine[:-1]) | (word[1:] != word[:-1])])) if len(mine) else np.zeros(0, np.int64)
            n = np.diff(np.append(head, len(mine)))
            sizes = np.bincount(mine[head], minlength=len(counts))
            tail = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.StructArray.from_arrays([pa.array(word[head].view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"]))
            yield pa.record_batch([b.column("doc_id").cast(pa.int64()), pa.array(counts), pa.array(sums[0]), pa.array(sums[1]), pa.array(sums[2].astype(np.int64)), tail.cast(kind)], ["doc_id", "n_tokens", "base", "logs", "here", "tail"])

    scored = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(emit, "doc_id long, n_tokens long, base double, logs double, here long, tail array<struct<word:long,n:long>>").withColumn("row", F.monotonically_increasing_id()), "scored")
    shared.destroy()
    rare = scored.select("row", F.inline("tail")).select("row", "word", F.col("n").alias("times")).join(words, "word", "left")
    mass, d = max(vocab.rare_mass, 1), vocab.discount
    unknown = float(np.log10(d * vocab.rare_words / mass)) if vocab.rare_words else 0.0
    c = F.coalesce("n", F.lit(0))
    sums = rare.groupBy("row").agg(
        F.sum(F.col("times") * F.log10((c + 0.1) / F.lit(vocab.denominator))).alias("rare_base"),
        F.sum(F.col("times") * F.when(c > 0, F.log10((c - F.lit(d)) / F.lit(float(mass)))).otherwise(unknown)).alias("rare_logs"),
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known"),
    )
    zero = lambda x: F.coalesce(x, F.lit(0))
    return scored.drop("tail").join(sums, "row", "left").select(
        "doc_id", "n_tokens", (F.col("here") + zero("rare_known")).cast("long").alias("n_known"), (F.col("base") + zero("rare_base")).alias("base_score"), (F.col("logs") + zero("rare_logs")).alias("score")
    )


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    learn = docs.filter(~_is_held())
    vocab, words = vocabulary(count(learn))
    got = score(docs, vocab, words, train(learn, vocab))
    return got.select("doc_id", _is_held().alias("held_out"), "n_tokens", "n_known", F.lit(vocab.total).cast("long").alias("train_tokens"), "base_score", "score")
