"""What the operators of this subpackage share: scratch tables, null rules, word hashing."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Word separators of the contracts: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a local session (a test) names none a temporary one is set; on a
    cluster that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again.

    Unlike a checkpoint the table is compressed and columnar, so later steps
    read only the columns they need, and a lost executor costs no recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_files(spark: SparkSession, name: str) -> str:
    """URI of a new subfolder of the shared folder, for files that tasks write."""
    base = shared_dir(spark)
    base = base if urlparse(base).scheme else f"file://{base}"
    return f"{base}/{name}-{uuid.uuid4().hex}"


def open_fs(uri: str):
    """(pyarrow file system, path) of a URI; the file system is the cluster's."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def text_of(col: str = "text"):
    """The text column with null read as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until df has none of them (in any case)."""
    taken, prefix = {c.lower() for c in df.columns}, ""
    while any((prefix + n).lower() in taken for n in names):
        prefix += "_"
    return [prefix + n for n in names]


def bounded_sample(df: DataFrame, n: int, by: str) -> DataFrame:
    """At most n rows: those with the smallest hashes of a column, among a share that has about 2 * n.

    The share goes by the hash too, so tasks send the driver about 2 * n rows
    together, not n each; rows with a null there aren't taken.
    """
    some = df.where(F.col(by).isNotNull()).withColumn("_h", F.xxhash64(by))
    share = max(1, df.count() // (2 * n))
    return some.where(F.pmod("_h", F.lit(share)) == 0).orderBy("_h", *df.columns).limit(n).drop("_h")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col):
    """Lower-cases A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = np.ones(0, np.uint64)


def _powers(n: int) -> np.ndarray:
    """The first n powers of the base, modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        grown = np.full(size, _BASE, np.uint64)
        grown[0] = 1
        _POWERS = np.multiply.accumulate(grown)
    return _POWERS[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashed_piece(raw: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    inside = ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    lengths = ends - starts
    chars = (_LOWER[raw] if lower else raw)[inside].astype(np.uint64) + np.uint64(1)
    first = np.cumsum(lengths) - lengths
    at = np.arange(len(chars)) - np.repeat(first, lengths)
    sums = np.add.reduceat(chars * _powers(int(lengths.max()))[at], first)
    return mix(sums ^ (lengths.astype(np.uint64) << np.uint64(48))), starts


def hashed_words(raw: np.ndarray, lower: bool = True, piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash and the start of every word of a text's UTF-8 bytes, in order.

    Words are ``[^\\x20\\x09-\\x0D]+``; a word's hash is a polynomial in its bytes,
    mixed; it depends on the word alone. Works on about ``piece`` bytes at a
    time, so that a huge text needs little more memory than its words.
    """
    if len(raw) <= piece:
        return _hashed_piece(raw, lower)
    out, lo = [], 0
    while lo < len(raw):
        hi = lo + piece
        while hi < len(raw) and not _SPACE[raw[lo:hi][-4096:]].any():
            hi += 4096
        if hi < len(raw):
            hi -= int(np.argmax(_SPACE[raw[lo:hi][::-1][:4096]]))
        hashes, starts = _hashed_piece(raw[lo:hi], lower)
        out.append((hashes, starts + lo))
        lo = hi
    return np.concatenate([h for h, _ in out]), np.concatenate([s for _, s in out])


def word_hashes(text: str, lower: bool = True) -> np.ndarray:
    """hashed_words of a text, without the starts."""
    return hashed_words(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), lower)[0]


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; of the whole sequence where it is shorter."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    out = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        out = (out * np.uint64(0xD6E8FEB86659FD93)) + mix(words[i : n - k + 1 + i] + np.uint64(i + 1))
    return mix(out)
