"""Operator 1: secret scans by multipart credential linking.

Strong parts (assigned values, access keys, long hex runs) are reported by themselves. Weak parts (opaque strings, account
names, endpoints) are reported only where a complementary part lies within ``REACH`` code points in the same scope, a scope
being a block of text without a blank line. The link is an interval join: parts are binned by place, each bin keeps its
smallest start and largest end per role, and a weak part probes the bins its reach touches. As a bin is as wide as the
reach, those two numbers decide exactly whether a partner exists; no pair of parts is ever emitted.

Scopes, and which weak parts overlap strong ones, come from one window over a text's parts in order, so a very long text takes
time in proportion to its length and parts. Parts of equal start are ordered by kind as listed.

Null text is empty text: no spans. Repeated rows and repeated ids give a row each. A null id stays null. An empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import spans
from .common import cut, read

#: Code points between two parts of one credential, at most.
REACH = 200

# The strong patterns, in the order their kinds are listed. Possessive or counted forms that match the same
# spans as the plain ones and take linear time.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
STRONG = ("assign", "access", "hex")

# The weak patterns.
OPAQUE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+(?![A-Za-z0-9+/_=-])"
ACCOUNT = r"""(?i:\b(?:user(?:name)?|login|client_?id|account|access_?key_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,}+)"""
ENDPOINT = r"""(?<![a-z0-9+.-])[a-z][a-z0-9+.-]*+://[^\s"'<>]{3,}+"""
BREAK = r"\n[\x20\t\r]*+(?=\n)"

#: Role of each kind, and the roles that complete it.
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "opaque": "secret", "account": "identifier", "endpoint": "endpoint"}
PARTNERS = {"secret": ("identifier", "endpoint"), "identifier": ("secret",), "endpoint": ("secret",)}


def strong_spans(text: Column) -> Column:
    assign = F.filter(spans.find(text, ASSIGN, "assign", 0, group=2), lambda h: F.length(h["g"]) >= 6)
    access = spans.find(text, ACCESS, "access", 1, guard=F.contains(text, F.lit("AKIA")))
    return F.concat(assign, access, spans.find(text, HEX, "hex", 2))


def weak_spans(text: Column) -> Column:
    opaque = F.filter(spans.find(text, OPAQUE, "opaque", 3), lambda h: h["s"].rlike("[0-9].*[0-9].*[0-9]") & h["s"].rlike("[A-Za-z].*[A-Za-z]"))
    account = spans.find(text, ACCOUNT, "account", 4, group=1)
    return F.concat(opaque, account, spans.find(text, ENDPOINT, "endpoint", 5, guard=F.contains(text, F.lit("://"))))


def link(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """The weak rows of parts(row, scope, start, end, kind, role, weak) that have a complementary part within ``reach`` in their scope."""
    key = ["row", "scope", "role"]
    starts = parts.groupBy(*key, F.floor(F.col("start") / reach).alias("bin")).agg(F.min("start").alias("lo"), F.max("start").alias("hi")).withColumn("side", F.lit("after"))
    ends = parts.groupBy(*key, F.floor(F.col("end") / reach).alias("bin")).agg(F.min("end").alias("lo"), F.max("end").alias("hi")).withColumn("side", F.lit("before"))
    places = starts.unionByName(ends).withColumnRenamed("role", "partner")
    after, before = F.floor(F.col("end") / reach), F.floor(F.col("start") / reach)
    wanted = F.create_map(*[x for r, p in PARTNERS.items() for x in (F.lit(r), F.array(*map(F.lit, p)))])
    probes = (
        parts.filter("weak")
        .withColumn("partner", F.explode(wanted[F.col("role")]))
        .withColumn("probe", F.explode(F.array(*[F.struct(F.lit(side).alias("side"), b.alias("bin"), F.lit(edge).alias("edge")) for side, b, edge in (("after", after, "first"), ("after", after + 1, "last"), ("before", before, "last"), ("before", before - 1, "first"))])))
        .select("*", "probe.*")
        .drop("probe")
    )
    found = probes.alias("p").join(
        places.alias("q"),
        (F.col("p.row") == F.col("q.row")) & (F.col("p.scope") == F.col("q.scope")) & (F.col("p.partner") == F.col("q.partner")) & (F.col("p.side") == F.col("q.side")) & (F.col("p.bin") == F.col("q.bin"))
        & F.when((F.col("p.side") == "after") & (F.col("edge") == "first"), F.col("hi") >= F.col("end"))
        .when(F.col("p.side") == "after", F.col("lo") <= F.col("end") + reach)
        .when(F.col("edge") == "last", F.col("lo") <= F.col("start"))
        .otherwise(F.col("hi") >= F.col("start") - reach),
        "left_semi",
    )
    return found.select("row", "start", "end", "kind", "rank", "s").distinct()


def scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, spans: array<struct<start, rank, end, kind, s>> of strong spans and linked weak spans, ordered; plus ``strong``, the strong ones."""
    text = F.coalesce(F.col("text"), F.lit(""))
    breaks = F.when(F.size("weak") > 0, spans.find(F.col("text"), BREAK, "break", len(ROLE))).otherwise(spans.none())
    found = cut(
        docs.select("doc_id", strong_spans(text).alias("strong"), weak_spans(text).alias("weak"), text.alias("text"))
        .select(F.monotonically_increasing_id().alias("row"), "doc_id", "strong", "weak", breaks.alias("breaks")),
        "secret-parts",
    )
    every = found.filter(F.size("weak") > 0).select("row", F.inline(F.concat("strong", "weak", "breaks")))
    order = Window.partitionBy("row").orderBy("start", "rank", "end")
    back = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("rank"), F.desc("end"))
    strong, before, after = F.col("kind").isin(*STRONG), order.rowsBetween(Window.unboundedPreceding, 0), back.rowsBetween(Window.unboundedPreceding, 0)
    placed = every.select(
        "*",
        F.count_if(F.col("kind") == "break").over(before).alias("scope"),
        F.max(F.when(strong, F.col("end"))).over(before).alias("reach"),
        F.min(F.when(strong, F.col("start"))).over(after).alias("next"),
    )
    overlaps = F.coalesce(F.col("reach") > F.col("start"), F.lit(False)) | F.coalesce(F.col("next") < F.col("end"), F.lit(False))
    parts = placed.filter(strong | ((F.col("kind") != "break") & ~overlaps)).select("row", "scope", "start", "end", "kind", "rank", "s", "g")
    role = F.create_map(*[F.lit(x) for kv in ROLE.items() for x in kv])[F.col("kind")]
    linked = link(parts.withColumn("role", role).withColumn("weak", ~F.col("kind").isin(*STRONG)), reach)
    per_row = linked.groupBy("row").agg(F.collect_list(F.struct("start", "end", "kind", "rank", "s", F.lit(None).cast("string").alias("g"))).cast(spans.SPAN).alias("linked"))
    both = found.join(per_row, "row", "left")
    return both.select("doc_id", spans.in_order(F.col("strong")).alias("strong"), spans.in_order(F.concat("strong", F.coalesce("linked", spans.none()))).alias("spans"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scan(read(spark, sf_dir, "documents"))
    return got.select(
        "doc_id",
        *[spans.count(F.col("strong"), k).alias(f"n_{k}") for k in STRONG],
        F.sha2(spans.joined(F.col("strong")), 256).alias("base_sha256"),
        spans.joined(F.col("spans")).alias("spans"),
    )
