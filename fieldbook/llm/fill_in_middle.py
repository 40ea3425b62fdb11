"""Fill-in-middle transformation: texts cut at two token bounds and put in a new order, by a parallel automaton scan.

Tokens are runs of ASCII letters and single other characters. An automaton of ``STATES`` follows both, the tokens and the marks ``<P>``,
``<S>``, ``<M>`` that a text may hold already. A chunk of a text does not know the state it is entered in, so it emits, for every state, the state
it is left in and the tokens that begin in it. These functions compose associatively: their composition from a text's first chunk on gives each
chunk's true entry state and the tokens before it, so the chunk that holds a cut is known, and only that chunk is looked through again.

Texts of more than ``chunk`` characters are split into chunks that are dealt over all tasks; the summaries of a text's chunks, a few
numbers each, meet in one group. Shorter texts are one chunk, entered in the first state, and are cut where they lie.

Null text: empty, of form plain. Empty texts: plain, no tokens. Null doc_id: as the empty string in the hash. Repeated rows and ties: a row's result depends on
its doc_id and text alone. Very long texts: whole. An empty table gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read, slices

#: Characters of a chunk.
CHUNK = 65_536
#: Outside a word; in a word; after ``<``; after ``<P``, ``<S`` or ``<M``; and, from when a mark has been seen, outside and in a word.
OUT, WORD, OPEN, NAMED, MARKED_OUT, MARKED_WORD = range(6)
STATES = 6
#: In percent: texts left plain, and suffix first among the others.
PLAIN_FROM, SUFFIX_FIRST = 90, 20
MARKS = r"<[PSM]>"

_LETTER = np.array([chr(b).isalpha() if b < 128 else False for b in range(256)])
_NAME = np.isin(np.arange(256), np.frombuffer(b"PSM", np.uint8))


def joined(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes end to end, and where each begins; the last bound ends them."""
    text = pc.fill_null(batch.column("text"), b"")
    ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64))
    return np.frombuffer(b"".join(text.to_pylist()), np.uint8), np.concatenate([[0], ends])


def inner_tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes where a character begins, and those where a token does if the chunk is not entered in a word."""
    letter = _LETTER[data]
    char = (data & 0xC0) != 0x80
    after_word = np.zeros(len(data), bool)
    after_word[1:] = letter[:-1]
    after_word[bounds[:-1][bounds[:-1] < len(data)]] = False
    return char, char & ~(letter & after_word)


def summaries(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each chunk, from each state: the state at its end and the tokens that begin in it; and its characters."""
    n = len(bounds) - 1
    char, token = inner_tokens(data, bounds)
    sums = lambda x: np.concatenate([[0], np.cumsum(x)])
    chars, tokens = (np.diff(sums(x)[bounds]) for x in (char, token))
    at = np.flatnonzero((data[:-2] == 0x3C) & _NAME[data[1:-1]] & (data[2:] == 0x3E)) if len(data) > 2 else np.zeros(0, np.int64)
    inside = np.zeros(n, bool)
    of = np.searchsorted(bounds, at, side="right") - 1
    inside[of[at + 3 <= bounds[of + 1]]] = True
    byte = lambda back: np.where(size >= back, data[np.clip(bounds[1:] - back, 0, max(len(data) - 1, 0))] if len(data) else 0, 0)
    front = lambda k: np.where(size > k, data[np.clip(bounds[:-1] + k, 0, max(len(data) - 1, 0))] if len(data) else 0, 0)
    size = np.diff(bounds)
    ends, counts = np.zeros((n, STATES), np.int8), np.zeros((n, STATES), np.int64)
    word_end, open_end = _LETTER[byte(1)], byte(1) == 0x3C
    for state in range(STATES):
        in_word = state in (WORD, NAMED, MARKED_WORD)
        counts[:, state] = tokens - (in_word & _LETTER[front(0)])
        marked = inside | (state in (MARKED_OUT, MARKED_WORD))
        if state == OPEN:
            marked = marked | (_NAME[front(0)] & (front(1) == 0x3E))
        if state == NAMED:
            marked = marked | (front(0) == 0x3E)
        named_end = _NAME[byte(1)] & np.where(size >= 2, byte(2) == 0x3C, state == OPEN)
        plain_end = np.where(open_end, OPEN, np.where(named_end, NAMED, np.where(word_end, WORD, OUT)))
        ends[:, state] = np.where(size == 0, state, np.where(marked, np.where(word_end, MARKED_WORD, MARKED_OUT), plain_end))
    return ends, counts, chars


def places(data: np.ndarray, bounds: np.ndarray, units: np.ndarray, in_word: np.ndarray) -> np.ndarray:
    """Characters of each chunk before the token that has so many (``units``) tokens of the chunk before it; all of them if none has."""
    char, token = inner_tokens(data, bounds)
    token = token.copy()
    first = bounds[:-1]
    begins = np.flatnonzero(in_word & (np.diff(bounds) > 0))
    token[first[begins]] &= ~_LETTER[data[first[begins]]]
    tokens, chars = (np.concatenate([[0], np.cumsum(x)]) for x in (token, char))
    where = np.flatnonzero(token)
    begin = tokens[first]
    index = begin + units
    byte = np.where(index < tokens[bounds[1:]], np.append(where, 0)[np.minimum(index, len(where))], bounds[1:])
    return chars[byte] - chars[first]


def hashed(doc_id: Column) -> list[Column]:
    """The first four groups of eight hexadecimal digits of the hash of a doc_id."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def cut_units(n: Column, h: Column) -> tuple[Column, Column]:
    a, b = h[0] % (n + 1), h[1] % (n + 1)
    return F.least(a, b), F.greatest(a, b)


def short_cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of one chunk: tokens, whether a mark is in them, characters, and the characters before both cuts."""
    for batch in slices(batches):
        data, bounds = joined(batch)
        ends, counts, chars = summaries(data, bounds)
        n = counts[:, OUT]
        draws = [batch.column(k).to_numpy() % (n + 1) for k in ("h1", "h2")]
        no = np.zeros(len(n), bool)
        a, b = (places(data, bounds, pick(*draws), no) for pick in (np.minimum, np.maximum))
        made = [pa.array(x) for x in (n, ends[:, OUT] >= MARKED_OUT, chars, a, b)]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("doc_id", "text", "h3", "h4")), *made], ["doc_id", "text", "h3", "h4", "n", "marked", "chars", "first_cut", "second_cut"])


def chunk_functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        ends, counts, chars = summaries(*joined(batch))
        lists = lambda x, kind: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel(), kind), STATES).cast(pa.list_(kind))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("chunk"), lists(ends, pa.int8()), lists(counts, pa.int64()), pa.array(chars)], ["doc", "chunk", "ends", "counts", "chars"])


def chunk_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        state = batch.column("entry").to_numpy()
        found = places(*joined(batch), batch.column("units").to_numpy(), np.isin(state, (WORD, NAMED, MARKED_WORD)))
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("which"), pa.array(found + batch.column("before").to_numpy())], ["doc", "which", "place"])


def long_cuts(long_docs: DataFrame, chunk: int) -> DataFrame:
    """As ``short_cuts``, for texts of several chunks: composed functions, then a look into the chunks that hold the cuts."""
    doc = F.struct("doc_id", F.sha2("text", 256).alias("digest"))
    texts = long_docs.dropDuplicates(["doc_id", "text"]).withColumn("doc", doc)
    pieces = texts.select("doc", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))).alias("chunk", "text")).select("doc", "chunk", F.col("text").cast("binary").alias("text"))
    pieces = cut(pieces.repartition("doc", "chunk"), "chunks")
    functions = pieces.mapInArrow(chunk_functions, "doc struct<doc_id:long,digest:string>, chunk int, ends array<byte>, counts array<long>, chars long")
    start = F.struct(F.lit(OUT).cast("byte").alias("state"), F.lit(0).cast("long").alias("tokens"), F.lit(0).cast("long").alias("chars"))
    after = lambda a, f: F.struct(f["ends"][a["state"].cast("int")].alias("state"), (a["tokens"] + f["counts"][a["state"].cast("int")]).alias("tokens"), (a["chars"] + f["chars"]).alias("chars"))
    entered = lambda acc, f: F.struct(after(acc["now"], f).alias("now"), F.concat(acc["seen"], F.array(acc["now"])).alias("seen"))
    zero = F.struct(start.alias("now"), F.array().cast("array<struct<state:tinyint,tokens:bigint,chars:bigint>>").alias("seen"))
    composed = functions.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("chunk", "ends", "counts", "chars"))).alias("f")).withColumn("run", F.aggregate("f", zero, entered))
    known = composed.select("doc", F.col("run.seen").alias("seen"), F.col("run.now.tokens").alias("n"), (F.col("run.now.state") >= MARKED_OUT).alias("marked"), F.col("run.now.chars").alias("chars"))
    known = cut(known, "entries")
    units = cut_units(F.col("n"), hashed(F.col("doc.doc_id")))
    wanted = known.select("doc", "seen", F.posexplode(F.array(*units)).alias("which", "unit"))
    # the last chunk with no more tokens before it than the cut holds it; a cut past the last token is at that chunk's end
    holder = F.size(F.filter("seen", lambda s: s["tokens"] <= F.col("unit"))) - 1
    wanted = wanted.withColumn("chunk", holder).withColumn("s", F.col("seen")[F.col("chunk")])
    wanted = wanted.select("doc", "which", "chunk", (F.col("unit") - F.col("s.tokens")).alias("units"), F.col("s.state").cast("int").alias("entry"), F.col("s.chars").alias("before"))
    found = pieces.join(wanted, ["doc", "chunk"]).mapInArrow(chunk_places, "doc struct<doc_id:long,digest:string>, which int, place long")
    both = found.groupBy("doc").agg(F.min("place").alias("first_cut"), F.max("place").alias("second_cut"))
    cuts = known.select("doc", "n", "marked", "chars").join(both, "doc")
    return long_docs.withColumn("doc", doc).join(cuts, "doc").select("doc_id", "text", "h3", "h4", "n", "marked", "chars", "first_cut", "second_cut")


def transform(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Per document: doc_id, text, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    names = ["h1", "h2", "h3", "h4"]
    rows = rows.withColumns(dict(zip(names, hashed(F.col("doc_id")), strict=True)))
    kind = "doc_id long, text string, h3 long, h4 long, n long, marked boolean, chars long, first_cut long, second_cut long"
    short = rows.where(F.length("text") <= chunk).withColumn("text", F.col("text").cast("binary")).mapInArrow(short_cuts, kind.replace("text string", "text binary")).withColumn("text", F.col("text").cast("string"))
    both = short.unionByName(long_cuts(rows.where(F.length("text") > chunk), chunk))
    form = F.when((F.col("chars") == 0) | F.col("marked") | (F.col("h3") % 100 >= PLAIN_FROM), "plain").when(F.col("h4") % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    a, b = F.col("first_cut").cast("int"), F.col("second_cut").cast("int")
    prefix, middle, suffix = F.substring("text", F.lit(1), a), F.substring("text", a + 1, b - a), F.substring("text", b + 1, F.col("chars").cast("int"))
    marked = {"psm": F.concat(F.lit("<P>"), prefix, F.lit("<S>"), suffix, F.lit("<M>"), middle), "spm": F.concat(F.lit("<S>"), suffix, F.lit("<P>"), prefix, F.lit("<M>"), middle)}
    output = F.when(F.col("form") == "psm", marked["psm"]).when(F.col("form") == "spm", marked["spm"]).otherwise(F.col("text"))
    shown = lambda c: F.when(F.col("form") != "plain", c.cast("long"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return both.withColumn("form", form).select(F.col("doc_id").cast(kind).alias("doc_id"), "text", "n", "form", shown(F.col("first_cut")).alias("prefix_chars"), shown(F.col("second_cut") - F.col("first_cut")).alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that ``transform`` made this output of. No text that was cut holds a mark, so the marks split the output."""
    parts = F.split(output, MARKS, -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transform(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = r"""
with d as (select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
t as (select *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') as tokens, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from d),
u as (select *, len(tokens) as n, least(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) as a, greatest(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) as b from t),
f as (select *, case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form,
 array_to_string(tokens[1:a], '') as prefix, array_to_string(tokens[a + 1:b], '') as middle, array_to_string(tokens[b + 1:], '') as suffix from u)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
 sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
 sha256(text) as restored_sha256 from f
"""
