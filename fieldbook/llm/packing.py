"""Operator 2: best-fit packing with swap-based local search.

1. Every whole text becomes token ids and a final end id; only documents longer than a sequence are cut into pieces.
   Of each piece its length, place and a checksum are kept, never its ids.
2. Pieces are dealt by hash into groups of about ``GROUP`` pieces, so a hot source is spread evenly and the number of
   groups grows with the input. Each group is packed best fit, longest first.
3. Local search inside the group moves documents from less filled to fuller bins, exchanges one for one, or two for one,
   until no such step makes the sum of squared fills grow, so that little-filled bins empty.
4. Pieces of bins that stay underfull are dealt into fewer groups and packed again, while that saves sequences (``rounds`` times
   at most).

Null text is empty text (the end id alone, one piece). A very long text is encoded whole and cut into pieces. Ties: the steps of
largest gain go first, among equals that of the first bin. Repeated rows and ids are packed as rows of their own; a null id
stays null. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read, slices, small_batches

LENGTH = 2048
GROUP = 8000
#: Bins under this part of a sequence are packed again.
UNDERFULL = 0.985
END_ID = 0
#: Words whose ids a worker remembers, at most.
KNOWN_WORDS = 400_000
_MARK = "\x01"
# Letters that the tokenizer lowers one by one and that no mark or neighbour changes: ASCII, Latin to U+017E but the dotted capital I, Cyrillic.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-žЀ-џ"
_WORD, _SIMPLE = f"^[{_LETTERS}]+$", f"^[!-~{_LETTERS}]+$"
# The tokenizer's own split, for lowered words of _SIMPLE.
_UNITS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")
_BYTES = {b: b if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else None for b in range(256)}
_BYTES |= {b: 256 + n for n, b in enumerate(b for b in range(256) if _BYTES[b] is None)}
_BYTES[32] = 32
# Marks at a word's end are a unit of their own after a letter or digit. ' may begin a unit, > end a special token.
_TAIL = "".join(chr(b) for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in "'>")
# Last two bytes (or the last, where it is ASCII) of such a letter or digit.
_ENDS = np.zeros((256, 256), bool)
for _c in map(chr, range(0x460)):
    if re.match(f"[0-9{_LETTERS}]", _c):
        _ENDS[_c.encode()[-2] if _c > "\x7f" else slice(None), _c.encode()[-1]] = True

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACED = f"{PIECE}, sequence_id long, offset long, fill long"


class Ids:
    """Ids of texts as little-endian unsigned 32-bit bytes. White space only separates words in this vocabulary, so a text's ids are its words' ids.

    Arrow splits texts at ASCII white space and numbers the distinct words; only those not remembered reach the tokenizer.
    """

    def __init__(self, path: str, most: int = KNOWN_WORDS):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        # a control character between blanks is a token of its own, so many words can be encoded in one text and told apart again
        mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        # the same merges over units split beforehand; the last id of each has the suffix
        self.units = Tokenizer(self.tokenizer.model)
        self.units.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.words, self.ids = pa.array([], pa.string()), pa.array([], pa.large_binary())

    def _whole(self, words: list[str]) -> list[bytes]:
        """Words as the whole tokenizer encodes them."""
        alone = [w for w in words if self.mark is None or _MARK in w]
        rest = [w for w in words if _MARK not in w] if self.mark is not None else []
        out = {w: array("I", e.ids).tobytes() for w, e in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False), strict=True)}
        groups = [rest[i : i + 256] for i in range(0, len(rest), 256)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([f" {_MARK} ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            raw, ends = ids.tobytes(), [*(4 * np.flatnonzero(ids == self.mark)).tolist(), 4 * len(ids)]
            at = 0
            for w, end in zip(group, ends, strict=True):
                out[w] = raw[at:end]
                at = end + 4
        return [out[w] for w in words]

    def _simple(self, words: pa.Array, counts: np.ndarray) -> pa.Array | None:
        """Words given as units with blanks between, and the units of each; None if the ids don't close one unit each."""
        if not len(words):
            return pa.array([], pa.large_binary())
        groups = pa.ListArray.from_arrays(pa.array([*range(0, len(words), 256), len(words)], pa.int32()), words)
        texts = [t.lower().encode().decode("latin-1").translate(_BYTES) for t in pc.binary_join(groups, " ").to_pylist()]
        ids = np.concatenate([np.array(e.ids, "<u4") for e in self.units.encode_batch_fast(texts, add_special_tokens=False)])
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != counts.sum():
            return None
        ends = np.concatenate([[0], 4 * ends[np.cumsum(counts) - 1]])
        return pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(ends), pa.py_buffer(ids)])

    def _encoded(self, words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """The words, reordered, and their ids."""
        plain = pc.match_substring_regex(words, _WORD)
        letters, rest = words.filter(plain), words.filter(pc.invert(plain))
        # the name of a special token is found before lowering
        simple = pc.and_not(pc.match_substring_regex(rest, _SIMPLE), pc.match_substring(rest, "<|"))
        mixed, other = rest.filter(simple), rest.filter(pc.invert(simple))
        units = [_UNITS.findall(w.lower()) for w in mixed.to_pylist()]
        counts = np.concatenate([np.ones(len(letters), np.int64), np.array([len(u) for u in units], np.int64)])
        got = self._simple(pa.concat_arrays([letters, pa.array([" ".join(u) for u in units], pa.string())]), counts)
        if got is None:
            got, other = pa.array([], pa.large_binary()), pa.concat_arrays([letters, mixed, other])
            letters = mixed = letters.slice(0, 0)
        return pa.concat_arrays([letters, mixed, other]), pa.concat_arrays([got, pa.array(self._whole(other.to_pylist()), pa.large_binary())])

    @staticmethod
    def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Words of all texts, marks at a word's end apart, and where each text's begin. An empty word at a text's end has no ids."""
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten()
        if not len(words):
            return words, split.offsets.to_numpy()
        _, at, raw = words.buffers()
        at = np.frombuffer(at, np.int32)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(raw or b"", np.uint8)
        end = at[:-1] + pc.binary_length(pc.ascii_rtrim(words, _TAIL)).to_numpy()
        tails = np.flatnonzero((end < at[1:]) & (end > at[:-1]))
        last = end[tails] - 1
        tails = tails[_ENDS[data[last - 1], data[last]]]
        at = np.insert(at, tails + 1, end[tails])
        more = np.searchsorted(tails, split.offsets.to_numpy())
        return pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int32)), raw]), split.offsets.to_numpy() + more

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        words, begin = self._split(pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string()), ""))
        coded = words.dictionary_encode()
        known = pc.index_in(coded.dictionary, value_set=self.words)
        new, got = self._encoded(coded.dictionary.filter(pc.is_null(known)))
        at = pc.coalesce(known, pc.add(pc.index_in(coded.dictionary, value_set=new), pa.scalar(len(self.words), pa.int32())))
        ids = pa.concat_arrays([self.ids, got])
        if len(self.words) < self.most:
            self.words, self.ids = pa.concat_arrays([self.words, new]).slice(0, self.most), ids.slice(0, self.most)
        found = ids.take(at.take(coded.indices))
        ends = np.frombuffer(found.buffers()[1], np.int64)[begin]
        raw = memoryview(found.buffers()[2] or b"")
        return [bytes(raw[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


_LOADED: dict[str, Ids] = {}


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    small_batches(docs.sparkSession)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _LOADED.setdefault(tokenizer, None) or Ids(tokenizer)
        _LOADED[tokenizer] = ids
        end = np.array([END_ID], "<u4").tobytes()
        for b in slices(batches, 4_000_000):
            doc, piece, start, size, crc = [], [], [], [], []
            for d, raw in zip(b.column("doc_id").to_pylist(), ids.encode(b.column("text")), strict=True):
                raw += end
                for k in range(0, len(raw), 4 * length):
                    part = raw[k : k + 4 * length]
                    doc.append(d)
                    piece.append(k // (4 * length))
                    start.append(k // 4)
                    size.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(emit, PIECE)


def best_fit(sizes: list[int], cap: int) -> list[list[int]]:
    """Bins (lists of places in sizes), longest first into the fullest bin that has room."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (free, bin), ascending
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        s = sizes[i]
        at = bisect_left(room, (s, -1))
        if at < len(room):
            free, b = room.pop(at)
            bins[b].append(i)
        else:
            free, b = cap, len(bins)
            bins.append([i])
        if free > s:
            insort(room, (free - s, b))
    return bins


def local_search(bins: list[list[int]], sizes: list[int], cap: int) -> list[list[int]]:
    """Moves, one-for-one and two-for-one exchanges between underfull bins, until none makes the sum of squared fills grow."""
    fill = [sum(sizes[i] for i in b) for b in bins]
    done = [b for b, f in zip(bins, fill, strict=True) if f >= cap]
    open_bins = [b for b, f in zip(bins, fill, strict=True) if f < cap]
    fills = np.array([f for f in fill if f < cap], np.int64)
    item = np.array([i for b in open_bins for i in b], np.int64)
    size = np.array(sizes, np.int64)[item] if len(item) else item
    home = np.repeat(np.arange(len(open_bins)), [len(b) for b in open_bins])
    changed = True
    while changed:
        changed = False
        for a in np.argsort(fills, kind="stable"):
            while fills[a]:
                mine = np.flatnonzero(home == a)
                best, act = 0, None
                # documents of one size are alike, so one of each size, and one pair of each sum of two, stand for all
                own = size[mine]
                some = mine[np.sort(np.unique(own, return_index=True)[1])]
                left, right = np.triu_indices(len(mine), 1)
                _, first = np.unique(own[left] + own[right], return_index=True)
                groups = [(x,) for x in some] + list(zip(mine[left[first]].tolist(), mine[right[first]].tolist(), strict=True))
                for g in groups:
                    s = int(size[list(g)].sum())
                    if len(g) == 1:
                        # a move: d = s more in the other bin
                        gain = np.where((fills + s <= cap) & (fills + s > fills[a]), 2 * s * (fills - fills[a] + s), 0)
                        gain[a] = 0
                        if len(gain) and gain.max() > best:
                            best, act = int(gain.max()), (g, int(gain.argmax()), None)
                    # an exchange of g for one document of another bin: d = s - its size
                    d = s - size
                    other = fills[home]
                    gain = np.where((d > 0) & (other + d <= cap) & (home != a), 2 * d * (other - fills[a] + d), 0)
                    if len(gain) and gain.max() > best:
                        y = int(gain.argmax())
                        best, act = int(gain.max()), (g, int(home[y]), y)
                if act is None:
                    break
                g, b, y = act
                moved = int(size[list(g)].sum())
                home[list(g)] = b
                if y is not None:
                    home[y] = a
                    moved -= int(size[y])
                fills[b] += moved
                fills[a] -= moved
                changed = True
        if not changed:
            break
    out: dict[int, list[int]] = {}
    for i, h in zip(item.tolist(), home.tolist(), strict=True):
        out.setdefault(h, []).append(i)
    return done + list(out.values())


def pack_group(rows: pa.Table, cap: int, base: int) -> pa.Table:
    sizes = rows["length"].to_pylist()
    bins = local_search(best_fit(sizes, cap), sizes, cap)
    seq, off, fill = (np.empty(len(sizes), np.int64) for _ in range(3))
    for k, b in enumerate(bins):
        at = 0
        for i in b:
            seq[i], off[i] = base + k, at
            at += sizes[i]
        fill[b] = at
    for name, values in (("sequence_id", seq), ("offset", off), ("fill", fill)):
        rows = rows.append_column(name, pa.array(values))
    return rows


def _placer(length: int, r: int):
    def place(key: tuple, rows: pa.Table) -> pa.Table:
        return pack_group(rows.drop_columns(["g"]), length, (r << 56) | (key[0].as_py() << 24))

    return place


def pack_pieces(parts: DataFrame, length: int = LENGTH, group: int = GROUP, rounds: int = 3) -> DataFrame:
    """The pieces with sequence_id and offset."""
    kept, left = [], cut(parts, "pieces")
    n = left.count()
    before = None
    for r in range(rounds):
        deal = max(1, -(-n // group))

        names = [c.split()[0] for c in PIECE.split(", ")]
        placed = cut(left.select(*names, F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(r)), F.lit(deal)).alias("g")).groupBy("g").applyInArrow(_placer(length, r), _PLACED), "packed")
        bad = placed.filter(F.col("fill") < int(UNDERFULL * length))
        now = bad.agg(F.count("*"), F.count_distinct("sequence_id")).first()
        kept.append(placed.filter(F.col("fill") >= int(UNDERFULL * length)))
        if r == rounds - 1 or deal == 1 or (before is not None and now[1] > 0.95 * before):
            kept.append(bad)
            break
        left, n, before = bad, now[0], now[1]
    out = kept[0]
    for k in kept[1:]:
        out = out.unionByName(k)
    return out.drop("fill")


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    return pack_pieces(pieces(docs, tokenizer, length), length)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), default_tokenizer())
