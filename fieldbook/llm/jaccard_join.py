"""Operator 9: n-gram Jaccard self-join with prefix filters under several global token orders.

Tokens are 64-bit hashes of the five-word shingles of a text. Two sets with Jaccard similarity t or more share a token
among the first ``n - ceil(t*n) + 1`` tokens of each, under ANY global order of tokens. Three orders are used:

* order 1: common tokens last, then by hash. Which tokens are common is counted over all documents; as any order is
  valid, only its usefulness depends on those counts, never the result. Its prefixes are the join keys.
* order 2: ascending hash, order 3: descending hash. Sets are fetched in ascending order, so these prefixes are their two
  ends; both must share a token too, else a candidate is dropped before its sets are compared exactly.

Each set also has a parity sketch: every token flips one of ``SKETCH`` bits, so two sets differ in at least as many tokens
as their sketches differ in bits. Pairs whose sketches differ in too many bits are never listed; no similar pair is lost.

Texts with one and the same set are one node (64-bit digest of the set), so copies cost nothing. In a group of near
copies each node is first compared with the few central nodes it has most tokens in common with; then only pairs that
are still in different components remain to be compared. All of those are, so no link between components is missed,
while pairs inside a component are never listed.

Null or wordless text: empty set, linked with nothing, component_id is its own doc_id. Texts of one to four words: the
whole sequence is the one token. Repeated rows get a row each. Rows without doc_id are linked like others, and a component
without any doc_id has component_id null. Ties between central nodes go to the larger digest. A very long text is one set
of all its shingles. An empty table gives an empty result; extra columns are ignored by ``join``
and kept by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordHash, cut, drop_cut, lists, mix64, read, shingle_hashes, slices, small_batches, texts_of, word_hashes
from .graph import components

WORDS = 5
PERCENT = 75
#: Tokens whose counts are sent to all tasks, at most: 16 bytes each.
COMMON = 1 << 18
#: Bits by which a counting task knows tokens of its earlier slices.
SEEN = 1 << 27
#: Words whose hashes a task remembers, and bytes of text that it works on at once: a worker's memory beside its batch.
KNOWN, PIECE = 1 << 17, 1_000_000
#: Central nodes that a node is compared with first.
PIVOTS = 2
#: Bits of a set's parity sketch: eight numbers of 64 bits, chosen by the three highest bits of a token.
SKETCH = 512


def prefix_size(n, percent: int = PERCENT):
    return n - (-(-n * percent // 100)) + 1


def prefix_size_of(n: Column, percent: int) -> Column:
    return n - F.ceil(n * percent / 100) + 1


def sets_of(texts: list[bytes], known: WordHash, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of every text, ascending, end to end, and how many each text has."""
    words, counts = word_hashes(texts, known)
    hashes, owner = shingle_hashes(words, counts, k)
    if len(hashes):
        # a text's hashes lie together, so each text is sorted where it lies
        ends = np.cumsum(np.bincount(owner, minlength=len(texts))).tolist()
        for start, end in zip([0, *ends], ends, strict=False):
            hashes[start:end].sort()
        new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])])
        hashes, owner = hashes[new], owner[new]
    return hashes, np.bincount(owner, minlength=len(texts)).astype(np.int64)


def nodes_of(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The digest of each set, as int64; 0 for the empty set."""
    ends = np.cumsum(sizes)
    raw = memoryview(np.ascontiguousarray(hashes).view(np.uint8))
    got = [xxhash.xxh3_64_intdigest(raw[8 * (e - n) : 8 * e]) if n else 0 for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
    return np.array(got, np.uint64).view(np.int64)


def sketches_of(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Parity sketches [texts, SKETCH / 64] of the sets, as int64."""
    out = np.zeros((len(sizes), SKETCH // 64), np.uint64)
    if len(hashes):
        # the highest bits choose the number, so in ascending sets the tokens of one number lie together
        slot = np.repeat(np.arange(len(sizes)) * (SKETCH // 64), sizes) + (hashes >> np.uint64(61)).astype(np.int64)
        heads = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        out.ravel()[slot[heads]] = np.bitwise_xor.reduceat(np.uint64(1) << (hashes & np.uint64(63)), heads)
    return out.view(np.int64)


def _common_tokens(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens met in most different sets, ascending, with their counts: counted within tasks, then summed over all.

    A task passes on the tokens that it meets twice or more, which a bit table of fixed size tells. Single ones are left
    out, so counts may be low by one for each task; they only decide how useful order 1 is.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen, met = WordHash(KNOWN), set(), np.zeros(SEEN // 8, np.uint8)
        for b in slices(batches, PIECE):
            hashes, sizes = sets_of(texts_of(b), known, k)
            fresh = np.zeros(len(sizes), bool)
            for i, x in enumerate(nodes_of(hashes, sizes).tolist()):
                if x not in seen:
                    fresh[i] = True
                    seen.add(x)
            if len(seen) > 1_000_000:
                seen.clear()
            token, n = np.unique(hashes[np.repeat(fresh, sizes)], return_counts=True)
            byte, bit = ((token >> np.uint64(3)) % np.uint64(SEEN // 8)).astype(np.int64), np.uint8(1) << (token & np.uint64(7)).astype(np.uint8)
            often = (n >= 2) | (met[byte] & bit > 0)
            met[byte] |= bit  # where two tokens of a slice share a byte, one may go unnoted
            yield pa.record_batch([pa.array(token[often].view(np.int64)), pa.array(n[often].astype(np.int64))], ["token", "n"])

    counted = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counted.filter("n >= 8").orderBy(F.desc("n"), "token").limit(COMMON).toArrow()
    token, n = top["token"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(token)
    return token[order], n[order]


def _prefixes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n, node, prefix (order 1), sketch; the two are null where the task has given them before for the same node."""
    token, n = _common_tokens(docs, k)
    maybe = np.zeros(1 << 22, bool)
    maybe[(token >> np.uint64(42)).astype(np.int64)] = True
    shared = docs.sparkSession.sparkContext.broadcast((token, n, np.packbits(maybe)))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, often, packed = shared.value
        maybe = np.unpackbits(packed).astype(bool)
        known, seen = WordHash(KNOWN), set()
        for b in slices(batches, PIECE):
            hashes, sizes = sets_of(texts_of(b), known, k)
            nodes = nodes_of(hashes, sizes)
            fresh = np.zeros(len(sizes), bool)
            for i, x in enumerate(nodes.tolist()):
                if x not in seen and sizes[i]:
                    fresh[i] = True
                    seen.add(x)
            if len(seen) > 1_000_000:
                seen.clear()
            take = np.repeat(fresh, sizes)
            token, owner = hashes[take], np.repeat(np.arange(len(sizes)), sizes)[take]
            # order 1: how common (0 if not counted as common), then a hash unrelated to the other orders
            rank = np.zeros(len(token), np.uint64)
            if len(common) and len(token):
                hit = np.flatnonzero(maybe[(token >> np.uint64(42)).astype(np.int64)])
                at = np.minimum(np.searchsorted(common, token[hit]), len(common) - 1)
                rank[hit] = np.where(common[at] == token[hit], often[at], 0)
            order = np.lexsort((mix64(token ^ np.uint64(0xD1B54A32D192ED03)), rank, owner))
            token, owner = token[order], owner[order]
            own = np.where(fresh, sizes, 0)
            place = np.arange(len(token)) - np.repeat(np.cumsum(own) - own, own)
            cut_at = np.where(fresh, prefix_size(sizes, percent), 0)
            keep = place < cut_at[owner]
            sketch = sketches_of(hashes, sizes)[fresh]

            def masked(values: np.ndarray, kind: pa.DataType, counts: np.ndarray = cut_at, fresh: np.ndarray = fresh) -> pa.ListArray:
                made = lists(values, counts, kind)
                return pa.ListArray.from_arrays(made.offsets, made.values, mask=pa.array(~fresh))

            yield pa.record_batch(
                [b.column("doc_id").cast(pa.int64()), pa.array(sizes.astype(np.int64)), pa.array(nodes), masked(token[keep].view(np.int64), pa.int64()), masked(sketch.ravel(), pa.int64(), np.where(fresh, SKETCH // 64, 0))],
                ["doc_id", "n", "node", "prefix", "sketch"],
            )

    return cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(emit, "doc_id long, n long, node long, prefix array<long>, sketch array<long>"), "prefixes")


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """node, tokens (ascending) of wanted(node, doc_id). A bit filter of bounded size over the ids spares most texts the work; the join decides."""
    bits = 1 << 24
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(bits)).cast("int")
    filled = wanted.filter("doc_id is not null").select(F.floor(slot / 8).cast("int").alias("byte"), F.pow(F.lit(2), slot % 8).cast("int").alias("b"))
    got = filled.groupBy("byte").agg(F.bit_or("b").alias("b")).toArrow()
    table = np.zeros(bits // 8, np.uint8)
    table[got["byte"].to_numpy()] = got["b"].to_numpy().astype(np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen, filled = WordHash(KNOWN), set(), shared.value
        for b in batches:
            at = b.column("slot").to_numpy(zero_copy_only=False)
            maybe = np.isnan(at) if at.dtype.kind == "f" else np.zeros(len(at), bool)
            at = np.nan_to_num(at).astype(np.int64)
            maybe |= ((filled[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
            for part in slices([b.filter(pa.array(maybe))], PIECE):
                hashes, sizes = sets_of(texts_of(part), known, k)
                nodes = nodes_of(hashes, sizes)
                fresh = sizes > 0
                for i in np.flatnonzero(fresh).tolist():
                    if (x := int(nodes[i])) in seen:
                        fresh[i] = False
                    seen.add(x)
                if len(seen) > 1_000_000:
                    seen.clear()
                yield pa.record_batch([pa.array(nodes[fresh]), lists(hashes[np.repeat(fresh, sizes)].view(np.int64), sizes[fresh], pa.int64())], ["node", "tokens"])

    found = docs.select(F.when(F.col("doc_id").isNotNull(), slot).alias("slot"), "text").mapInArrow(emit, "node long, tokens array<long>")
    return found.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _enough(most: Column, na: Column, nb: Column, percent: int) -> Column:
    """Whether sets of na and nb tokens, at most ``most`` of them common, can be similar enough."""
    return F.lit(100 + percent) * most >= F.lit(percent) * (na + nb)


def _sketch_room(a: Column, b: Column, na: Column, nb: Column) -> Column:
    """Most common tokens of two sets by their sketches."""
    apart = sum((F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(SKETCH // 64)), F.lit(0))
    return F.floor((na + nb - apart) / 2)


def _verified(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """u, v: the pairs(a, b), which order 1 lets pass, that orders 2 and 3 let pass too and that have the similarity, compared exactly."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = cut(_sets(docs, nodes.join(wanted, "node", "left_semi"), k), "sets")
    got = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta")), "a").join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb")), "b")
    length = lambda x: prefix_size_of(F.size(x), percent).cast("int")
    low = F.arrays_overlap(F.slice("ta", 1, length("ta")), F.slice("tb", 1, length("tb")))
    high = F.arrays_overlap(F.slice("ta", -length("ta"), length("ta")), F.slice("tb", -length("tb"), length("tb")))
    similar = F.lit(100 + percent) * F.size(F.array_intersect("ta", "tb")) >= F.lit(percent) * (F.size("ta") + F.size("tb"))
    out = cut(got.filter(low & high).filter(similar).select(F.col("a").alias("u"), F.col("b").alias("v")), "verified")
    drop_cut(sets)
    return out


def link_nodes(docs: DataFrame, prefixes: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """node, label: components of the nodes(node, doc_id) that have a link."""
    by_token = Window.partitionBy("token")
    postings = prefixes.filter("prefix is not null").select("node", "n", F.posexplode("prefix").alias("at", "token"))
    shared = cut(postings.select("*", F.min("node").over(by_token).alias("lo"), F.max("node").over(by_token).alias("hi")).filter("lo <> hi").select("token", "node", "n", (F.col("at") + 1).alias("at")).distinct(), "postings")
    sketches = cut(prefixes.filter("sketch is not null").select("node", "n", "sketch").join(shared.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "sketches")
    # central nodes have the largest part of their prefix in common with others; every node is first compared with the central nodes of its tokens
    share = shared.groupBy("node").agg((F.count("*") / prefix_size_of(F.first("n"), percent)).alias("share"))
    central = shared.join(share, "node").groupBy("token").agg(F.max(F.struct("share", "node"))["node"].alias("pivot"))
    met = shared.join(central, "token").filter("node <> pivot").groupBy("node", "pivot").agg(F.count("*").alias("c"))
    best = met.withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("c"), "pivot"))).filter(F.col("k") <= PIVOTS)
    side = lambda x: sketches.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    fits = _enough(_sketch_room(F.col("sa"), F.col("sb"), F.col("na"), F.col("nb")), F.col("na"), F.col("nb"), percent)
    size_ok = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    tried = cut(best.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct().join(side("a"), "a").join(side("b"), "b").filter(size_ok & fits).select("a", "b", "na", "nb"), "pairs")
    links = _verified(docs, tried, nodes, k, percent)
    labels = cut(components(links), "labels")
    # what is left: nodes of one token in different components
    labelled = shared.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_tokens = labelled.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("token")
    rest = cut(labelled.join(open_tokens, "token", "left_semi").join(sketches.select("node", "sketch"), "node").select("token", "node", "n", "at", "label", "sketch"), "rest")
    drop_cut(shared)
    major = rest.groupBy("token", "label").agg(F.count("*").alias("c")).groupBy("token").agg(F.max_by("label", F.struct("c", "label")).alias("major"))
    minor = rest.join(major, "token").filter("label <> major")
    others = (F.col("a.label") != F.col("b.label")) & ((F.col("b.label") == F.col("a.major")) | (F.col("a.node") < F.col("b.node")))
    na, nb = F.col("a.n"), F.col("b.n")
    similar = F.least(na, nb) * 100 >= F.greatest(na, nb) * percent
    # a common token at places i and j leaves room for min(i, j) common tokens up to it and min(na - i, nb - j) after it
    similar &= _enough(F.least("a.at", "b.at") + F.least(na - F.col("a.at"), nb - F.col("b.at")), na, nb, percent)
    similar &= _enough(_sketch_room(F.col("a.sketch"), F.col("b.sketch"), na, nb), na, nb, percent)
    turned = F.col("a.node") < F.col("b.node")
    pair = [F.when(turned, F.col(f"{x}.{c}")).otherwise(F.col(f"{y}.{c}")).alias(name) for c, two in (("node", "a b"), ("n", "na nb"), ("at", "i j")) for (x, y), name in zip(("ab", "ba"), two.split(), strict=True)]
    met = minor.alias("a").join(rest.alias("b"), (F.col("a.token") == F.col("b.token")) & others & similar).select(*pair)
    # every common token of two prefixes is a row here, so up to the nearer prefix's end the common tokens are counted, and only what lies beyond is unknown
    counted = met.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.count("*").alias("c"), F.max("i").alias("i"), F.max("j").alias("j"))
    na, nb = F.col("na"), F.col("nb")
    beyond = F.greatest(F.least(na - prefix_size_of(na, percent), nb - F.col("j")), F.least(na - F.col("i"), nb - prefix_size_of(nb, percent)))
    left = cut(counted.filter(_enough(F.col("c") + beyond, na, nb, percent)).select("a", "b", "na", "nb"), "pairs")
    drop_cut(rest)
    untried = cut(left.join(tried, ["a", "b"], "left_anti"), "pairs")
    out = cut(components(links.union(_verified(docs, untried, nodes, k, percent))), "labels")
    for used in (sketches, tried, links, labels, left, untried):
        drop_cut(used)
    return out


def join(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    small_batches(docs.sparkSession)
    prefixes = _prefixes(docs, k, percent)
    rows = cut(prefixes.select("doc_id", "n", "node"), "rows")
    nodes = rows.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    labels = link_nodes(docs, prefixes, nodes, k, percent)
    drop_cut(prefixes)
    named = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    known = named.join(least, "label").select("node", "component_id")
    full = rows.filter("n > 0").join(known, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def deduplicate(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One document of each group: that with the smallest id. Rows that repeat an id and its text are one document; rows without an id stay."""
    gone = join(docs, k, percent).filter("doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct()
    row = docs.select(F.struct("*").alias("doc"))
    left = row.filter("doc.doc_id is not null").join(gone, F.col("doc.doc_id") == F.col("id"), "left_anti")
    same = Window.partitionBy("doc.doc_id", F.xxhash64("doc.text")).orderBy(F.lit(0))
    first = left.withColumn("copy", F.row_number().over(same)).filter("copy = 1").select("doc")
    return first.union(row.filter("doc.doc_id is null")).select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(read(spark, sf_dir, "documents"))


#: The same rows by all pairs with a common shingle and a recursive walk: for small tables.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS sh FROM w),
u AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * c >= 75 * (len(x.sh) + len(y.sh) - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS n, doc_id AS m FROM s UNION SELECT r.n, e.b FROM r JOIN e ON r.m = e.a),
c AS (SELECT n, min(m) AS component_id FROM r GROUP BY n)
SELECT doc_id, len(sh) AS n_shingles, component_id FROM s JOIN c ON n = doc_id
"""
