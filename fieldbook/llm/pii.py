"""Operator 8: personal data by candidate gradient boosting, in Spark expressions only.

1. Base rules (email, ip, card, phone) give spans that always stay.
2. High-recall generators propose overlapping candidate spans: anything with an @ or "(at)", digits with single separators,
   digits in the groups of a phone number, dotted numbers.
3. Each candidate gets format features (lengths, kinds of characters, groups) and context features (neighbouring
   characters, cue words within ``CONTEXT`` code points before it).
4. Labels come from what the features don't show. A candidate is right where a base span, and so a validator (Luhn, parts up to
   255, a mail host, a dialling prefix), confirms it. It is refuted where a validator speaks against it: a card-sized number
   that fails Luhn, a dotted number that is no address, digits inside a longer word, a date, a single repeated digit, a handle without a
   host. All others (phone numbers without a prefix, written-out addresses, mail at a host without a dot) are open: they are never learned from, and only
   they can be added. A string that is proposed at several places is one candidate, a confirmed place with its own features before a refuted one. The plus sign, the @ and the outcome of validators are no features, so open candidates look like confirmed ones.
5. Gradient-boosted trees are fitted on at most ``FIT_ROWS`` distinct labelled candidates of each generator, taken in hash
   order over the whole corpus. A quarter of all distinct candidates, by hash, is held out and never fitted.
6. Per generator, the lowest score whose precision over ALL held-out labelled candidates reaches ``PRECISION`` is the
   threshold. Open candidates at or over it that touch no base span are added. A generator with fewer than ``LEAST`` held-out
   candidates of either class has no calibration and adds nothing.

The trees become nested CASE expressions, so scoring is one projection without a shuffle. Spans and redaction take time in
proportion to a text's length and matches, however long it is.

Null text is empty text: no spans, and a redacted null stays null. Repeated rows and ids give a row each; a null id stays
null. Spans of equal start are ordered by kind as listed, then end. An empty table, or one with a single class of labels,
has no model and keeps base spans only. Extra columns are kept by ``redact`` and ignored by ``scan``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spans
from .common import cut, read

FIT_ROWS = 20_000
PRECISION = 0.9
#: Held-out candidates of each class that a threshold needs, at least.
LEAST = 20
CONTEXT = 40

# The base patterns, in the order their kinds are listed. (?:(?<!x)|\G) starts a run of x at its first
# character or where the last match ended, which leaves the matches as they are and the time linear.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){13,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

# The generators, and the cue words of the context features.
GENERATORS = {
    "email_like": r"""(?:(?<![^\s@<>"'(),;])|\G)[^\s@<>"'(),;]++(?:@|\x20?[(\[]at[)\]]\x20?)[^\s@<>"'(),;]{2,}+(?:\x20?[(\[]dot[)\]]\x20?[A-Za-z0-9-]++)*+""",
    "digits_like": r"[0-9](?:[\x20./-]?[0-9]){6,}+",
    "phone_like": r"(?:\+?[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}",
    "dotted_like": r"(?:(?<![0-9.])|\G)[0-9]++(?:\.[0-9]++){3,}+",
}
HOST = r"^[^@]*[\p{L}\p{N}][^@]*@[^@]*\p{L}"
DATE = r"^(?:[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./][0-9]{4})"
CUES = (
    r"(?i)\b(phone|tel|telephone|call|fax|mobile|cell|whatsapp)\b",
    r"(?i)\b(card|visa|mastercard|amex|iban|account|credit|debit|ssn|passport)\b",
    r"(?i)\b(e-?mail|mail|contact|write|reach|address)\b",
    r"(?i)\b(version|release|section|chapter|isbn|order|invoice|ticket|page|year|build)\b",
    r"(?i)\b(ip|host|server|client|addr)\b",
)


def base_spans(text: Column) -> Column:
    digits = lambda h: F.regexp_replace(h["s"], "[^0-9]", "")
    email = spans.find(text, EMAIL, "email", 0, guard=F.contains(text, F.lit("@")))
    ip = F.filter(spans.find(text, IP, "ip", 1), lambda h: F.forall(F.split(h["s"], r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(F.concat(F.lit("000"), p), F.lit(3)).cast("int") <= 255)))
    card = F.filter(spans.find(text, CARD, "card", 2), lambda h: F.length(digits(h)).between(14, 19) & F.call_function("luhn_check", digits(h)))
    phone = F.filter(spans.find(text, PHONE, "phone", 3, guard=F.contains(text, F.lit("+"))), lambda h: F.length(digits(h)).between(10, 15))
    return F.concat(email, ip, card, phone)


def _features(h: Column) -> Column:
    s, before = h["s"], h["before"]
    n = lambda pattern: F.length(F.regexp_replace(s, f"[^{pattern}]", ""))
    groups = F.filter(F.split(s, r"[^A-Za-z0-9]+"), lambda g: F.length(g) > 0)
    sizes = F.transform(groups, lambda g: F.length(g))
    side = lambda c: F.when(F.length(c) == 0, 0).when(c.rlike(r"\s"), 1).when(c.rlike(r"[\p{L}\p{N}]"), 2).otherwise(3)
    digits = F.regexp_replace(s, "[^0-9]", "")
    numbers = [
        h["rank"],
        *map(n, ("0-9", "A-Za-z", "A-Z", r"\x20", "-", ".", "()", "_%")),
        F.size(F.array_distinct(F.split(digits, ""))),
        F.size(groups),
        F.coalesce(F.array_max(sizes), F.lit(0)),
        F.coalesce(F.array_min(sizes), F.lit(0)),
        F.coalesce(F.element_at(F.when(F.size(sizes) > 0, sizes), -1), F.lit(0)),
        side(F.right(before, F.lit(1))),
        side(h["after"]),
        *[F.when(before.rlike(c), 1).otherwise(0) for c in CUES],
    ]
    return F.array(*[x.cast("double") for x in numbers])


def _label(h: Column, confirmed: Column) -> Column:
    """1 confirmed, 0 refuted, null open."""
    digits = F.regexp_replace(h["s"], "[^0-9]", "")
    inside = F.right(h["before"], F.lit(1)).rlike(r"[\p{L}\p{N}]") | h["after"].rlike(r"[\p{L}\p{N}]")
    card = F.length(digits).between(14, 19) & ~F.call_function("luhn_check", digits)
    numeric = h["kind"].isin("digits_like", "phone_like")
    refuted = (
        (numeric & (inside | card | (F.length(digits) > 19) | h["s"].rlike(DATE) | digits.rlike(r"^([0-9])\1*$")))
        | (h["kind"] == "dotted_like")
        | ((h["kind"] == "email_like") & F.contains(h["s"], F.lit("@")) & ~h["s"].rlike(HOST))
    )
    return F.when(confirmed, 1).when(refuted, 0)


def _proposed(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """keep, base, cands: array<struct<start, end, kind, rank, s, label, x>>; written once."""
    text = F.coalesce(F.col("doc.text"), F.lit(""))
    guards = {"email_like": F.contains(text, F.lit("@")) | text.rlike(r"[(\[]at[)\]]")}
    cands = F.concat(*[spans.find(text, p, k, len(KINDS) + i, guard=guards.get(k), near=CONTEXT) for i, (k, p) in enumerate(GENERATORS.items())])
    found = docs.select(F.struct("*").alias("doc")).select("doc", base_spans(text).alias("base"), cands.alias("cands"))

    def row(z: Column) -> Column:
        h = z["h"]
        return F.struct(*[h[c].alias(c) for c in ("start", "end", "kind", "rank", "s")], _label(h, z["touches"]).alias("label"), _features(h).alias("x"))

    rows = F.when(F.size("cands") > 0, F.transform(spans.touching(F.col("cands"), F.col("base")), row)).otherwise(F.array())
    return cut(found.select(*keep, "base", rows.alias("cands")), "pii-candidates")


def _tree(node, x: Column) -> Column:
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(x[int(split.featureIndex())] <= float(split.threshold()), _tree(node.leftChild(), x)).otherwise(_tree(node.rightChild(), x))


class Boosted:
    """The fitted trees as an expression, and a threshold for each generator."""

    def __init__(self, trees: list | None = None, weights: list[float] | None = None):
        self.trees, self.weights, self.thresholds = trees or [], weights or [], {}

    def score(self, x: Column) -> Column:
        margin = reduce(lambda a, b: a + b, [_tree(t, x) * w for t, w in zip(self.trees, self.weights, strict=True)], F.lit(0.0))
        return 1 / (1 + F.exp(-2 * margin))

    def accepts(self, h: Column) -> Column:
        if not self.thresholds:
            return F.lit(False)
        limit = reduce(lambda c, kt: c.when(h["kind"] == kt[0], F.lit(kt[1])), list(self.thresholds.items())[1:], F.when(h["kind"] == next(iter(self.thresholds)), F.lit(next(iter(self.thresholds.values())))))
        return F.coalesce(self.score(h["x"]) >= limit, F.lit(False))


def fit(proposed: DataFrame, rows: int = FIT_ROWS, precision: float = PRECISION) -> Boosted:
    flat = proposed.filter(F.size("cands") > 0).select(F.explode("cands").alias("h")).select("h.kind", "h.s", "h.label", "h.x").filter("label is not null")
    flat = flat.withColumn("h", F.xxhash64("s", "kind"))
    held = F.pmod(F.col("h"), F.lit(4)) == 0
    distinct = lambda part: part.groupBy("kind", "s", "h").agg(F.max(F.struct("label", "x")).alias("best")).select("kind", "s", "h", "best.label", "best.x")
    each = [distinct(flat.filter(~held & (F.col("kind") == kind))).orderBy("h", "s").limit(rows).select("kind", "h", "label", "x") for kind in GENERATORS]
    sample = cut(reduce(DataFrame.unionByName, each), "pii-sample")
    seen = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(seen) < 2 or min(seen.values()) < 10:
        return Boosted()
    out = boosted(sample)
    bins = distinct(flat.filter(held)).select("kind", "label", F.floor(out.score(F.col("x")) * 1000).alias("bin")).groupBy("kind", "bin").agg(F.sum("label").alias("pos"), F.count("*").alias("n")).collect()
    for kind in GENERATORS:
        mine = sorted((r for r in bins if r["kind"] == kind), key=lambda r: -r["bin"])
        whole, right = sum(r["n"] for r in mine), sum(r["pos"] for r in mine)
        if min(right, whole - right) < LEAST:
            continue
        pos = n = 0
        for r in mine:
            pos, n = pos + r["pos"], n + r["n"]
            if pos >= LEAST and pos >= precision * n:
                out.thresholds[kind] = r["bin"] / 1000
    return out


def boosted(sample: DataFrame) -> Boosted:
    """The trees fitted on sample(x, label)."""
    model = GBTClassifier(featuresCol="v", labelCol="y", maxIter=15, maxDepth=3, stepSize=0.3, seed=7).fit(sample.select(array_to_vector("x").alias("v"), F.col("label").cast("double").alias("y")).coalesce(2))
    out = Boosted([t._call_java("rootNode") for t in model.trees], list(model.treeWeights))
    out.model = model
    return out


def _chosen(model: Boosted) -> Column:
    added = F.filter("cands", lambda h: h["label"].isNull() & model.accepts(h))
    return F.concat("base", F.transform(added, lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), h["kind"].alias("kind"), h["rank"].alias("rank"), h["s"].alias("s"), F.lit(None).cast("string").alias("g"))).cast(spans.SPAN))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base, spans: ordered arrays of the base spans and of all spans."""
    proposed = _proposed(docs.select("doc_id", "text"), [F.col("doc.doc_id")])
    return proposed.select("doc_id", spans.in_order(F.col("base")).alias("base"), spans.in_order(_chosen(fit(proposed))).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; n_chars follows the text."""
    proposed = _proposed(docs, [F.col("doc")])
    tag = lambda h: F.concat(F.lit("["), F.upper(F.regexp_replace(h["kind"], "_like$", "")), F.lit("]"))
    done = proposed.select("doc", spans.in_order(_chosen(fit(proposed))).alias("found")).select("doc", spans.replaced(F.col("doc.text"), F.col("found"), tag).alias("new"))
    value = {"text": F.col("new"), "n_chars": F.length("new").cast("long")}
    return done.select(*[value.get(c, F.col("doc.`" + c.replace("`", "``") + "`")).alias(c) for c in docs.columns])


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scan(read(spark, sf_dir, "documents"))
    return got.select(
        "doc_id",
        *[spans.count(F.col("base"), k).alias(f"n_{k}") for k in KINDS],
        F.sha2(spans.joined(F.col("base")), 256).alias("base_sha256"),
        spans.joined(F.col("spans")).alias("spans"),
    )
