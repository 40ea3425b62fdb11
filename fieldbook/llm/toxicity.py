"""Operator 4: toxicity by a linear-chain conditional random field.

Labels go to the texts: while there are at most ``SENT`` of them they are broadcast and texts stay where they are; beyond that
number texts and labels are joined by shuffling and written once.

1. Token labels. The labels are per document, so tokens are labelled from a distance: over ALL labelled training documents
   Spark counts in how many toxic and clean documents each word and word beginning occurs and after how many different
   words it stands in toxic ones. A word or beginning that is far likelier in toxic documents, significantly so and in
   varied contexts (copies of one text don't make it varied), marks a toxic token where it stands in a toxic document.
   Neither test depends on the size of the input: variety is the number of different words before ``DRAWS`` of its
   occurrences, expected over all choices of these. Beginnings of all lengths in ``STEMS`` are tried, so that each family of inflected
   words finds its own; a word is known by its shortest one. At most ``LEXICON`` units, the most significant, are sent to the tasks.
   Tokens are runs of letters, digits and other non-ASCII characters, lower-cased.
2. The field has the labels O and T; its features are the word, its neighbours, its ends, its shape and the unit it is known by, hashed. It is fitted
   on at most ``FIT_ROWS`` labelled documents, half of each class, taken whole in hash order. A document that would bring
   its class over half of ``FIT_TOKENS`` (about, at 6 bytes each) is passed over and the next ones are tried; where none
   fits, the class's shortest stands in. The gradient is summed over batches of about ``BATCH`` tokens.
3. Every whole text is tagged: forward-backward marginals of all tokens, exactly, as products of 2x2 matrices over blocks.
   The marginals give the offending spans (offsets in code points) and, through a logistic calibration fitted on the same
   bounded rows and set to the class sizes over all labelled rows, the document's score.

Null text is empty text; an empty text gets the score of a document without toxic tokens. Repeated rows and ids give a row
each; a null id stays null and is not held out. A very long text is tagged whole, in blocks. Ties decide nothing: units of equal
significance go by their bytes, sample rows of equal hash are taken alike. A document with several labels counts as toxic if one says so. Without
labels of both classes every score is the share of toxic labels (0 without labels). An empty table gives an empty result;
extra columns are ignored by ``tag`` and kept by ``reject``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fold_of, mix64, plain, read, slices, small_batches, texts_of

FIT_ROWS = 1200
FIT_TOKENS = 2_000_000
BATCH = 100_000
HASH_BITS = 18
THRESHOLD = 0.7
#: A toxic token: at least so many times likelier in toxic documents, after so many different words at least, and so varied.
ODDS, CONTEXTS, VARIED = 20.0, 5, 0.3
#: Occurrences among which variety is measured, however many there are.
DRAWS = 50
#: Chance that any unit at all passes the test of significance without being likelier in toxic documents, at most.
CHANCE = 0.01
#: Units sent to the tasks, at most.
LEXICON = 200_000
#: Lengths of the word beginnings that count as units, in bytes.
STEMS = range(3, 13)
BLOCK = 32
ROUNDS = 40
#: Labels broadcast to the texts, at most; about 60 bytes each.
SENT = 2_000_000
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
_SPANS = "array<struct<start:int,end:int,p:double>>"


#: Features of a word itself; the last two columns of its slots are those it gives its neighbours.
OWN = 7


def _slots(words: list[bytes], lexicon: set[bytes]) -> np.ndarray:
    """Slots [words, OWN + 2] of the features of words: own word, first 4 and 6 bytes, last 4, shape, whether a unit knows it and which; as the word before, as the word after."""
    first = [next((u for u in units(w) if u in lexicon), b"") for w in words]
    unit = np.fromiter(map(xxhash.xxh3_64_intdigest, first), np.uint64, len(words))
    known = np.array([bool(u) for u in first], np.uint64)
    whole = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    first4 = np.array(words, "S4").view("<u4").astype(np.uint64)
    first6 = np.array(words, "S6").astype("S8").view("<u8")
    last4 = np.array([w[-4:] for w in words], "S4").view("<u4").astype(np.uint64)
    kinds = _KIND[np.array(words, "S12").view(np.uint8).reshape(-1, 12)].astype(np.uint64)
    shape = kinds @ (np.uint64(4) ** np.arange(12, dtype=np.uint64))
    with np.errstate(over="ignore"):
        each = [mix64(x + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15)) for k, x in enumerate((whole, first4, first6, last4, shape, known, unit, whole, whole), 1)]
    return (np.column_stack(each) & np.uint64((1 << HASH_BITS) - 1)).astype(np.int64)


_KIND = np.array([0 if b == 0 else 2 if 48 <= b <= 57 else 1 for b in range(256)], np.uint8)


class Words(dict):
    """word -> row of ``table``: its slots, or with weights its scores (own, as the word before, as the word after). Cleared beyond a bounded number of rows."""

    def __init__(self, lexicon: set[bytes], weights: np.ndarray | None = None, most: int = 100_000):
        super().__init__()
        self.lexicon, self.weights, self.most = lexicon, weights, most
        self.table = np.zeros((0, OWN + 2), np.int64) if weights is None else np.zeros((0, 3), np.float32)

    def learn(self, words: list[bytes]) -> None:
        rows = _slots(words, self.lexicon)
        if self.weights is not None:
            rows = np.column_stack([self.weights[rows[:, :OWN]].sum(axis=1), self.weights[rows[:, OWN]], self.weights[rows[:, OWN + 1]]]).astype(np.float32)
        self.update(zip(words, range(len(self.table), len(self.table) + len(words)), strict=True))
        self.table = np.concatenate([self.table, rows])

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()
            self.table = self.table[:0]


def _tokens(texts: list[bytes], words: Words) -> tuple[np.ndarray, np.ndarray]:
    words.trim()
    split = [plain(t).split() for t in texts]
    if new := list(set().union(*split) - words.keys()):
        words.learn(new)
    counts = np.array([len(w) for w in split], np.int64)
    return np.concatenate([np.zeros(0, np.int64), *[np.fromiter(map(words.__getitem__, w), np.int64, len(w)) for w in split]]), counts


def _neighbours(values: np.ndarray, counts: np.ndarray, by: int) -> np.ndarray:
    """values moved by one place within each text; 0 at the ends. by: 1 gives the value before, -1 the value after."""
    out = np.zeros_like(values)
    if len(values) > 1:
        owner = np.repeat(np.arange(len(counts)), counts)
        same = owner[1:] == owner[:-1]
        if by == 1:
            out[1:][same] = values[:-1][same]
        else:
            out[:-1][same] = values[1:][same]
    return out


def _chain(e: np.ndarray, blocks: np.ndarray, m: np.ndarray, start: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """v[t] = (v[t-1] @ m) * (1, e[t]) for every place t of every sequence, up to a factor; v[-1] is ``start`` and the first step takes ``first`` for m.

    e [all blocks, BLOCK]; blocks: number for each sequence. Products inside the blocks are taken for all blocks at once, then
    carried from block to block for all sequences at once. What follows a sequence's end in its last block is never used.
    """
    total, heads = len(e), np.cumsum(blocks) - blocks
    run = np.empty((4, BLOCK, total))
    step = np.repeat(m.ravel()[:, None], total, axis=1)
    step[:, heads[blocks > 0]] = first.ravel()[:, None]
    run[0, 0], run[1, 0], run[2, 0], run[3, 0] = step[0], step[1] * e[:, 0], step[2], step[3] * e[:, 0]
    for j in range(1, BLOCK):
        p, q, r, s = run[:, j - 1]
        x = e[:, j]
        run[0, j], run[1, j] = p * m[0, 0] + q * m[1, 0], (p * m[0, 1] + q * m[1, 1]) * x
        run[2, j], run[3, j] = r * m[0, 0] + s * m[1, 0], (r * m[0, 1] + s * m[1, 1]) * x
        if j % 4 == 0:
            run[:, j] /= run[:, j].max(axis=0)
    run[:, BLOCK - 1] /= run[:, BLOCK - 1].max(axis=0)
    into = np.empty((2, total))
    at = np.flatnonzero(blocks > 0)
    v = np.repeat(start[:, None], len(at), axis=1)
    for k in range(int(blocks.max(initial=0))):
        on = blocks[at] > k
        at, v = at[on], v[:, on]
        into[:, heads[at] + k] = v
        end = run[:, BLOCK - 1, heads[at] + k]
        v = np.stack([v[0] * end[0] + v[1] * end[2], v[0] * end[1] + v[1] * end[3]])
        v /= v.sum(axis=0)
    o, t = into[0] * run[0] + into[1] * run[2], into[0] * run[1] + into[1] * run[3]
    both = o + t
    return (o / both).T.ravel(), (t / both).T.ravel()


def marginals(emit: np.ndarray, counts: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """P(label = T) of every token by forward-backward. emit: score of T over O; trans: log potentials [[OO, OT], [TO, TT]]; the start counts as O."""
    return _messages(emit, counts, trans)[0]


def expectations(emit: np.ndarray, counts: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(label = T) of every token, and the expected number [2, 2] of each transition, from the marginals of neighbouring pairs."""
    p, ahead, back = _messages(emit, counts, trans)
    if not len(p):
        return p, np.zeros((2, 2))
    first = (np.cumsum(counts) - counts)[counts > 0]
    before = np.concatenate([np.zeros((1, 2)), ahead[:-1]])
    before[first] = 1.0, 0.0
    pair = before[:, :, None] * np.exp(trans)[None] * back[:, None, :]
    return p, (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


def _messages(emit: np.ndarray, counts: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals, and the forward and backward messages [tokens, 2], each with the token's own emission in it and up to a factor."""
    if not len(emit):
        return np.zeros(0), np.zeros((0, 2)), np.zeros((0, 2))
    blocks = -(-counts // BLOCK)
    owner = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(emit)) - (np.cumsum(counts) - counts)[owner]
    base = (np.cumsum(blocks) - blocks)[owner] * BLOCK
    at, back_at = base + place, base + counts[owner] - 1 - place
    m, e = np.exp(trans), np.exp(np.clip(emit, -30, 30))
    grid = np.ones(int(blocks.sum()) * BLOCK)
    grid[at] = e
    ao, at_ = (x[at] for x in _chain(grid.reshape(-1, BLOCK), blocks, m, np.array([1.0, 0.0]), m))
    # the backward messages with the token's own emission in them follow the same recursion, from the right, under the transposed matrix
    grid[:] = 1
    grid[back_at] = e
    bo, bt = (x[back_at] for x in _chain(grid.reshape(-1, BLOCK), blocks, m.T, np.array([1.0, 1.0]), np.eye(2)))
    one, other = at_ * bt / e, ao * bo
    return one / (one + other), np.column_stack([ao, at_]), np.column_stack([bo, bt])


class Field:
    """Weights of the hashed features, transitions, and the calibration from marginals to a document's score."""

    def __init__(self):
        self.weights, self.trans, self.bias = np.zeros(1 << HASH_BITS), np.zeros((2, 2)), -4.0
        self.calibration: np.ndarray | None = None
        self.flat = 0.0
        self.lexicon: set[bytes] = set()

    def emissions(self, words: Words, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
        own, prev, nxt = words.table[flat].T.astype(float)
        return own + _neighbours(nxt, counts, 1) + _neighbours(prev, counts, -1) + self.bias

    def score(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if self.calibration is None:
            return np.full(len(counts), self.flat)
        return 1 / (1 + np.exp(-(_summary(p, counts) @ self.calibration)))


def _summary(p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """1, largest marginal, log(1 + sum of marginals), their share, of every text."""
    owner = np.repeat(np.arange(len(counts)), counts)
    total = np.bincount(owner, weights=p, minlength=len(counts)) if len(p) else np.zeros(len(counts))
    top = np.zeros(len(counts))
    np.maximum.at(top, owner, p)
    return np.column_stack([np.ones(len(counts)), top, np.log1p(total), 10 * total / np.maximum(counts, 10)])


def _fit_field(texts: list[bytes], toxic: np.ndarray, lexicon: set[bytes], share: float) -> Field:
    """Maximum likelihood of the token labels by Adagrad steps over all sequences, then the calibration by Newton steps."""
    field, batches, at = Field(), [], 0
    field.lexicon = lexicon
    size = np.cumsum([len(t) // 6 + 1 for t in texts])
    while at < len(texts):
        n = max(1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BATCH, side="right")) - at)
        words = Words(lexicon)
        flat, counts = _tokens(texts[at : at + n], words)
        names = {i: any(u in lexicon for u in units(w)) for w, i in words.items()}
        known = np.array([names[i] for i in range(len(words))], bool)
        y = known[flat] & np.repeat(toxic[at : at + n], counts)
        batches.append((words.table.astype(np.int32), flat.astype(np.int32), counts, y))
        at += n

    def features(slots: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
        before, after = _neighbours(slots[flat, OWN + 1], counts, 1), _neighbours(slots[flat, OWN], counts, -1)
        return np.column_stack([slots[flat, :OWN], before, after])

    size, g2, tg2, bg2 = 1 << HASH_BITS, np.full(1 << HASH_BITS, 1e-3), np.full((2, 2), 1e-3), 1e-3
    for _ in range(ROUNDS):
        grad, bias, tg = -0.02 * field.weights, 0.0, -0.02 * field.trans
        for slots, flat, counts, y in batches:
            feats = features(slots, flat, counts)
            p, have = expectations(field.weights[feats].sum(axis=1) + field.bias, counts, field.trans)
            gap = y - p
            grad += np.bincount(feats.ravel(), weights=np.repeat(gap, OWN + 2), minlength=size)
            bias += gap.sum()
            before_y = _neighbours(y.astype(np.int64), counts, 1)
            want = np.array([[((1 - before_y) * (1 - y)).sum(), ((1 - before_y) * y).sum()], [(before_y * (1 - y)).sum(), (before_y * y).sum()]])
            tg += want - have
        g2 += grad**2
        field.weights += 0.5 * grad / np.sqrt(g2)
        bg2 += bias**2
        field.bias += 0.5 * bias / np.sqrt(bg2)
        tg2 += tg**2
        field.trans += 0.1 * tg / np.sqrt(tg2)
    x = np.concatenate([_summary(marginals(field.weights[features(s, f, c)].sum(axis=1) + field.bias, c, field.trans), c) for s, f, c, _ in batches])
    t, w = toxic.astype(float), np.zeros(4)
    for _ in range(25):
        q = 1 / (1 + np.exp(-(x @ w)))
        hess = (x * (q * (1 - q))[:, None]).T @ x + 0.5 * np.eye(4)
        w += np.linalg.solve(hess, x.T @ (t - q) - 0.5 * w)
    # the rows hold as many of each class as asked for; the intercept follows the classes' true sizes
    ours = t.mean()
    w[0] += np.log(share / (1 - share)) - np.log(ours / (1 - ours))
    field.calibration = w
    return field


def units(w: bytes) -> tuple[bytes, ...]:
    """What a toxic token may be known by: its beginnings (inflected words share these), the shortest first, marked by a *, and the word."""
    return (*(w[:n] + b"*" for n in STEMS if len(w) > n), w) if w else ()


class _Units(dict):
    """word -> those of its units that are wanted (all without a choice), remembered up to a bound."""

    def __init__(self, wanted: set[bytes] | None = None, most: int = 60_000):
        super().__init__()
        self.wanted, self.most = wanted, most

    def __missing__(self, raw: bytes) -> tuple[bytes, ...]:
        got = units(raw)
        if self.wanted is not None:
            got = tuple(u for u in got if u in self.wanted)
        if len(self) < self.most:
            self[raw] = got
        return got


def varied(times: list[tuple[int, int]]) -> bool:
    """Whether a unit's contexts are varied. times: (n, k), k different words stand before n of its occurrences each.

    The words expected before m of all occurrences, drawn without replacement, have a mean that doesn't depend on the number of occurrences.
    """
    total = sum(n * k for n, k in times)
    m = min(total, DRAWS)
    log_choose = lambda n: math.lgamma(n + 1) - math.lgamma(n - m + 1)
    none = log_choose(total)
    expected = sum(k * (1 - (math.exp(log_choose(total - n) - none) if total - n >= m else 0.0)) for n, k in times)
    return sum(k for _, k in times) >= CONTEXTS and expected >= VARIED * m


def _lexicon(labelled: DataFrame, toxic_rows: int, clean_rows: int) -> set[bytes]:
    """Units of toxic tokens, from counts over all labelled rows (doc_id, text, toxic)."""

    def occurs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Units()
        for b in slices(batches):
            n: tuple[Counter, Counter] = (Counter(), Counter())
            for t, toxic in zip(texts_of(b), b.column("toxic").to_pylist(), strict=True):
                n[toxic == 1].update({u for w in set(plain(t).split()) for u in known[w]})
            words = list(n[0].keys() | n[1].keys())
            yield pa.record_batch([pa.array(words, pa.binary()), pa.array([n[1][w] for w in words], pa.int64()), pa.array([n[0][w] for w in words], pa.int64())], ["unit", "t", "c"])

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Units(shared.value)
        for b in slices(batches):
            pairs: Counter = Counter()
            for t in texts_of(b):
                before = b""
                for raw in plain(t).split():
                    for u in known[raw]:
                        pairs[u, before] += 1
                    before = raw
            yield pa.record_batch([pa.array([u for u, _ in pairs], pa.binary()), pa.array([xxhash.xxh3_64_intdigest(p) >> 1 for _, p in pairs], pa.int64()), pa.array(list(pairs.values()), pa.int64())], ["unit", "prev", "n"])

    counted = labelled.select("text", "toxic").mapInArrow(occurs, "unit binary, t long, c long").groupBy("unit").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    counted = cut(counted.filter(F.col("t") > 0), "toxic-units")
    odds = (F.col("t") / max(toxic_rows, 1)) / ((F.col("c") + 0.5) / max(clean_rows, 1))
    # Chernoff's bound on the chance of t toxic ones among t + c documents, for all units tested together
    base, n = toxic_rows / (toxic_rows + clean_rows), F.col("t") + F.col("c")
    surprise = F.col("t") * F.log(F.col("t") / (n * base)) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / (n * (1 - base)))).otherwise(0.0)
    least = math.log(max(counted.count(), 1) / CHANCE)
    sure = counted.withColumn("surprise", surprise).filter((odds >= ODDS) & (F.col("t") >= CONTEXTS) & (F.col("surprise") >= least))
    likely = {bytes(r["unit"]) for r in sure.orderBy(F.desc("surprise"), "unit").limit(LEXICON).select("unit").collect()}
    shared = labelled.sparkSession.sparkContext.broadcast(likely)
    pairs = labelled.filter("toxic = 1").select("text").mapInArrow(contexts, "unit binary, prev long, n long")
    times = pairs.groupBy("unit", "prev").agg(F.sum("n").alias("n")).groupBy("unit", "n").agg(F.count("*").alias("k")).groupBy("unit").agg(F.collect_list(F.struct("n", "k")).alias("times"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [varied([(x["n"], x["k"]) for x in t]) for t in b.column("times").to_pylist()]
            yield b.select(["unit"]).filter(pa.array(kept, pa.bool_()))

    return {bytes(r["unit"]) for r in times.mapInArrow(choose, "unit binary").collect()}


def _sample(labelled: DataFrame, rows: int, most_tokens: int) -> list[bytes]:
    """At most so many whole texts, in hash order, of about so many tokens together; what doesn't fit is passed over."""
    sizes = labelled.select("h", F.floor(F.coalesce(F.octet_length("text"), F.lit(0)) / 6).alias("n"))
    picked, room = Counter(), most_tokens
    for r in sizes.filter(F.col("n") <= most_tokens).orderBy("h").limit(rows).collect():
        if r["n"] <= room:
            picked[r["h"]] += 1
            room -= r["n"]
    if not picked:
        picked[sizes.orderBy("n", "h").first()["h"]] = 1
    out = []
    for r in sorted(labelled.filter(F.col("h").isin(*picked)).select("h", "text").toLocalIterator(), key=lambda r: r["h"]):
        if picked[r["h"]]:
            picked[r["h"]] -= 1
            out.append((r["text"] or "").encode())
    return out


def _labelled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """doc_id, text, toxic, h of the documents with a label."""
    marks = cut(labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic")), "labels")
    texts = docs.select("doc_id", "text").filter("doc_id is not null")
    few = marks.count() <= most
    joined = texts.join(F.broadcast(marks), "doc_id") if few else cut(texts.join(marks, "doc_id"), "labelled")
    return joined.withColumn("h", F.xxhash64("text", "doc_id"))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, most_tokens: int = FIT_TOKENS, most_sent: int = SENT) -> Field:
    """The field, from docs(doc_id, text) and labels(doc_id, toxic); the caller chooses the rows it may learn from."""
    small_batches(docs.sparkSession)
    labelled = _labelled(docs, labels, most_sent)
    sizes = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    if not pos or not neg:
        out = Field()
        out.flat = pos / max(pos + neg, 1)
        return out
    lexicon = _lexicon(labelled, pos, neg)
    sample = [(t, toxic) for toxic in (1, 0) for t in _sample(labelled.filter(F.col("toxic") == toxic), rows // 2, most_tokens // 2)]
    return _fit_field([t for t, _ in sample], np.array([y == 1 for _, y in sample]), lexicon, pos / (pos + neg))


def tag(docs: DataFrame, field: Field, spans: bool = True) -> DataFrame:
    """doc_id, score, spans (offsets of toxic tokens in code points, with their marginals) of every row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        words = Words(field.lexicon, field.weights)
        for b in slices(batches, 1_500_000):
            texts = texts_of(b)
            flat, counts = _tokens(texts, words)
            p = marginals(field.emissions(words, flat, counts), counts, field.trans)
            found: list[list[dict]] = [[] for _ in texts]
            ends = np.cumsum(counts)
            hot = np.flatnonzero(p >= 0.5) if spans else []
            places: dict[int, list] = {}
            for at in hot:
                i = int(np.searchsorted(ends, at, side="right"))
                if i not in places:
                    text = texts[i].decode("utf-8", "replace")
                    places = {i: [m.span() for m in _WORD.finditer(text)]}
                s, e = places[i][int(at - ends[i] + counts[i])]
                found[i].append({"start": s, "end": e, "p": float(p[at])})
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
            yield pa.record_batch([b.column("doc_id").cast(pa.int64()), pa.array(field.score(p, counts)), pa.array(found, kind)], ["doc_id", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, f"doc_id long, score double, spans {_SPANS}")


def learn(docs: DataFrame, labels: DataFrame) -> Field:
    """The field of op4: fitted on the rows that are not held out."""
    kept = fold_of("doc_id", 3) != 1
    return fit(docs.filter(kept), labels.filter(kept))


def reject(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score stays under the threshold; learns like op4. Rows keep all their columns: the verdict is made where the text is."""
    field = learn(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        words = Words(field.lexicon, field.weights)
        for b in slices(batches, 1_500_000):
            flat, counts = _tokens(texts_of(b), words)
            p = marginals(field.emissions(words, flat, counts), counts, field.trans)
            yield b.filter(pa.array(field.score(p, counts) < threshold))

    return docs.mapInArrow(keep, docs.schema)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    field = learn(docs, read(spark, sf_dir, "labels"))
    return tag(docs, field).select("doc_id", F.coalesce(fold_of("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")
