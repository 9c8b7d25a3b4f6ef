"""Byte-level BPE encoding and decoding.

A pre-token that is itself in the vocabulary is resolved by a minimal perfect
hash; any other is merged with a heap of candidate pairs over linked bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

#: Pre-tokens that a task remembers; a full table is emptied, results don't change.
REMEMBERED = 1_000_000
#: Pre-tokens that are handled at a time, so that a huge text needs no huge list.
PIECE = 100_000


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file (base64 token, space, rank a line), by rank."""
    with open(path, "rb") as f:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in (line.split() for line in f if line.strip()))
    if [rank for rank, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    return [token for _, token in pairs]


#: Letters and digits up to U+00FF, and the characters there that a Latin-1 pattern doesn't treat as Unicode does.
_LATIN = {"L": "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "N": "0-9"}
_NOT_LATIN = re.compile("[^\x00-\x1b\x20-\x84\x86-\xb1\xb4-\xb8\xba\xbb\xbf-\xff]|[\xb2\xb3\xb9]")


def _latin(pattern: str) -> str | None:
    """The pattern with its letter and number properties spelled out for Latin-1 texts; None if it has others."""
    out, inside = "", False
    for part in re.findall(r"\\p\{\w+\}|\\.|[^\\]", pattern):
        if part in (r"\p{L}", r"\p{N}"):
            own = _LATIN[part[3]]
            part = own if inside else f"[{own}]"
        elif part[:2].lower() == r"\p":
            return None
        elif part in "[]":
            inside = part == "["
        out += part
    try:
        re.compile(out)
    except re.error:
        return None
    return out


class Splitter:
    """Splits texts into pre-tokens by a pattern of the regex module.

    For texts of Latin-1 characters the standard module finds the same with
    explicit classes, about twice as fast.
    """

    def __init__(self, pattern: str):
        import regex

        latin = _latin(pattern)
        self.full, self.latin = regex.compile(pattern), re.compile(latin) if latin else None

    def pieces(self, text: str):
        """Lists of pre-tokens, PIECE at most in each."""
        find = self.full if self.latin is None or _NOT_LATIN.search(text) else self.latin
        if len(text) <= PIECE:
            yield find.findall(text)
            return
        found = (m.group() for m in find.finditer(text))
        while piece := list(islice(found, PIECE)):
            yield piece


class MinimalPerfectHash:
    """Maps each of n keys to its own slot of n, by hashing and displacing.

    Keys fall into buckets; for each bucket, largest first, a displacement is
    sought that sends its keys to free slots. Buckets of one key get a free slot
    outright (stored as a negative displacement), so the table ends up full.
    A slot keeps its key, which tells members from strangers.
    """

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        self.m = m = max(1, n // 2)
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        buckets: list[list[int]] = [[] for _ in range(m)]
        for i, h in enumerate(hashes):
            buckets[h % m].append(i)
        self.shift, owner = [0] * m, [-1] * n
        order = sorted(range(m), key=lambda b: -len(buckets[b]))
        for b in order:
            own = buckets[b]
            if len(own) < 2:
                break
            d = 1
            while True:
                slots = {self._slot(hashes[i], d) for i in own}
                if len(slots) == len(own) and all(owner[s] < 0 for s in slots):
                    break
                d += 1
            for i in own:
                owner[self._slot(hashes[i], d)] = i
            self.shift[b] = d
        free = (s for s in range(n) if owner[s] < 0)
        for b in order:
            if len(buckets[b]) == 1:
                s = next(free)
                owner[s], self.shift[b] = buckets[b][0], -1 - s
        self.keys, self.values = [keys[i] for i in owner], owner

    def _slot(self, h: int, d: int) -> int:
        return ((h >> 20) ^ (d * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) ^ (h >> 43) * d) % self.n

    def get(self, key: bytes) -> int:
        """The key's index among the keys, -1 for a stranger."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.m]
        s = -1 - d if d < 0 else self._slot(h, d)
        return self.values[s] if self.keys[s] == key else -1


class Codec:
    """Encodes and decodes by the ranks of a vocabulary."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.pattern, self.table = tokens, pattern, MinimalPerfectHash(tokens)
        self.single = [self.table.get(bytes([b])) for b in range(256)]
        if min(self.single) < 0:
            raise ValueError("a byte-level vocabulary has all single bytes")

    def prepare(self) -> Codec:
        """What a worker needs and a broadcast needn't carry; made once in each worker."""
        if hasattr(self, "seen"):
            return self
        self.split = Splitter(self.pattern)
        self.pairs = {t[0] << 8 | t[1]: r for r, t in enumerate(self.tokens) if len(t) == 2}
        self.seen = Remembered(self)
        return self

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the pair of lowest rank merges first, the leftmost of equals."""
        rank = self.table.get(piece)
        if rank >= 0:
            return [rank]
        n, pairs, get = len(piece), self.pairs, self.table.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := pairs.get(piece[i] << 8 | piece[i + 1], -1)) >= 0]
        heapify(heap)
        gone, ids = bytearray(n), [self.single[b] for b in piece]
        while heap:
            r, i, end = heappop(heap)
            if gone[i] or (j := after[i]) >= n or after[j] != end:
                continue  # one of the two has grown or gone since
            gone[j], ids[i], after[i] = 1, r, end
            if end < n:
                before[end] = i
                if (x := get(piece[i : after[end]])) >= 0:
                    heappush(heap, (x, i, after[end]))
            if (p := before[i]) >= 0 and (x := get(piece[p:end])) >= 0:
                heappush(heap, (x, p, end))
        return [ids[i] for i in range(n) if not gone[i]]

    def encode(self, text: str):
        """Ids of a text as little-endian unsigned 32-bit integers, a chunk of bytes at a time."""
        for piece in self.split.pieces(text):
            yield b"".join(map(self.seen.__getitem__, piece))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Remembered(dict):
    """Ids of pre-tokens met before; of others they are worked out on first use."""

    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, token: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        out = np.array(self.codec.merge(token.encode("utf-8", "replace")), "<u4").tobytes()
        if len(token) < 256:
            self[token] = out
        return out


def with_codec(spark, ranks_path: str, pattern: str):
    """A broadcast codec; a vocabulary file has a fixed size, whatever the corpus."""
    return spark.sparkContext.broadcast(Codec(read_ranks(ranks_path), pattern))


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encodes each text, decodes the ids again and returns digests of both.

    Columns: the id, n_tokens (long), ids_sha256 (of the ids as little-endian
    unsigned 32-bit integers), decoded_sha256 (of the decoded bytes) and, with
    keep_ids, ids (binary). A null text counts as empty and has 0 tokens; null
    and repeated ids pass through, a row each; other columns are left out, so
    that none can clash. A text of any length is worked on piece by piece; only
    with keep_ids does one text's result stand in memory as a whole.
    """
    shared = with_codec(docs.sparkSession, ranks_path, pattern)
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def work(batches):
        codec = shared.value.prepare()
        for batch in batches:
            counts, first, second, kept = [], [], [], []
            for text in batch.column(1).to_pylist():
                n, ids_hash, text_hash, own = 0, hashlib.sha256(), hashlib.sha256(), []
                for ids in codec.encode(text):
                    n += len(ids) // 4
                    ids_hash.update(ids)
                    text_hash.update(codec.decode(ids))
                    if keep_ids:
                        own.append(ids)
                counts.append(n)
                first.append(ids_hash.hexdigest())
                second.append(text_hash.hexdigest())
                kept.append(b"".join(own))
            out = [batch.column(0), pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]
            yield pa.RecordBatch.from_arrays(out + [pa.array(kept, pa.binary())] * keep_ids, names)

    kind = rows.schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + keep_ids]
    return rows.mapInArrow(work, schema)


def decode_ids(rows: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of ids as encode_decode(keep_ids=True) returns them: the id and text.

    Null ids give a null text; bytes that aren't UTF-8 (ids cut mid-character)
    become U+FFFD; an id beyond the vocabulary raises.
    """
    shared = with_codec(rows.sparkSession, ranks_path, pattern)
    some = rows.select(F.col(id_col), F.col(ids_col).alias("_ids"))

    def work(batches):
        codec = shared.value
        for batch in batches:
            texts = [None if x is None else codec.decode(x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return some.mapInArrow(work, f"`{id_col}` {some.schema[0].dataType.simpleString()}, text string")
