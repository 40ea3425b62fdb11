"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of every word contract: space and \t \n \v \f \r. ``bytes.split()`` splits on exactly these.
WORD = r"[^\x20\x09-\x0D]+"
MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Bytes of a batch that goes to a Python worker or of the texts that it works on at once, about (one row at least).
BATCH_BYTES = 3_000_000
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a fresh local one only where it is unset and Spark is one local process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="fieldbook-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write ``df`` once to the shared folder and read it back, so lost executors lose no finished work."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    spark._jvm.System.gc()  # nothing needs the shuffle files behind this table any more; they go once the driver has let go of them
    return out


def drop_cut(df: DataFrame) -> None:
    """Remove a table of ``cut`` that nothing reads any more."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.cut_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fold_of(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n: the fixed fold rule of the contracts."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64 on uint64 arrays."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class WordHash(dict):
    """word bytes -> 64-bit hash, remembered up to a bounded number of words."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.most:
            self[word] = h
        return h


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The whole texts of a batch as UTF-8; null is empty."""
    return [b"" if t is None else t for t in batch.column(name).cast(pa.large_binary()).to_pylist()]


_PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def plain(text: bytes) -> bytes:
    """Lower case, with a blank for every ASCII character that is no letter or digit: ``split()`` then gives the plain words."""
    return text.decode("utf-8", "replace").lower().encode().translate(_PLAIN)


def word_hashes(texts: list[bytes], known: WordHash, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, end to end, and the number of words of each text."""
    counts = np.zeros(len(texts), np.int64)
    parts = [np.zeros(0, np.uint64)]
    for i, t in enumerate(texts):
        words = (t.lower() if lower else t).split()
        counts[i] = len(words)
        parts.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
    return np.concatenate(parts), counts


def shingle_hashes(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every k-word shingle (the whole sequence where a text has fewer words), and the text each belongs to, in order of place."""
    total, starts = len(words), np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64) if len(counts) else np.zeros(0, np.int64)
    if total == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    mult = np.uint64(0x9E3779B97F4A7C15)
    doc = np.repeat(np.arange(len(counts)), counts)
    with np.errstate(over="ignore"):
        n = total - k + 1
        rolled = np.zeros(max(n, 0), np.uint64)
        for j in range(k if n > 0 else 0):
            rolled = rolled * mult + words[j : j + n]
        ok = doc[:n] == doc[k - 1 :] if n > 0 else np.zeros(0, bool)
        hashes, owner = mix64(rolled[ok]), doc[:n][ok] if n > 0 else doc[:0]
        short = np.flatnonzero((counts > 0) & (counts < k))
        if len(short):
            extra = np.zeros(len(short), np.uint64)
            for at, i in enumerate(short):
                x = np.uint64(int(counts[i]))
                for w in words[starts[i] : starts[i] + counts[i]]:
                    x = x * mult + w
                extra[at] = x
            hashes, owner = np.concatenate([hashes, mix64(extra ^ mult)]), np.concatenate([owner, short])
            order = np.argsort(owner, kind="stable")
            hashes, owner = hashes[order], owner[order]
    return hashes, owner


def small_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches end at ``BATCH_BYTES``; a lower limit of the caller's stays. Else 10,000 rows go at once, and executor and worker each hold that, in memory outside the heap."""
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH_CONF))
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def slices(batches: Iterator[pa.RecordBatch], most_bytes: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of each take a bounded number of bytes (one text at least)."""
    for b in batches:
        sizes = np.zeros(b.num_rows)
        if "text" in b.schema.names:
            sizes = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False)
        at, ends = 0, np.cumsum(sizes)
        while at < b.num_rows:
            before = ends[at - 1] if at else 0
            n = max(1, int(np.searchsorted(ends, before + most_bytes, side="right")) - at)
            yield b.slice(at, n)
            at += n


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))
