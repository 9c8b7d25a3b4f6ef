"""Token ids in binary files: independent zstandard frames and a trailing seek table.

A file is a skippable frame with a JSON header, then frames of ids, then the
seek table of the public zstd seekable format: for each frame its compressed
size, its size and a checksum (the low half of XXH64 of the content). A reader
takes the footer, then only the frames that hold the ids it wants.
"""

from __future__ import annotations

import json
import struct
import sys
import zlib
from array import array
from bisect import bisect_right
from itertools import accumulate
from uuid import uuid4

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from .bpe import REMEMBERED, Splitter
from .common import open_fs, shared_files, written

#: Fixed values of the zstd seekable format.
SKIPPABLE_HEADER, SKIPPABLE_TABLE, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
#: Bytes of ids in a frame, at which it is closed.
FRAME = 1 << 18


class FrameWriter:
    """Writes ids, given as bytes, to a binary stream."""

    def __init__(self, stream, width: int, frame: int = FRAME):
        self.stream, self.frame, self.buffer, self.table = stream, frame, bytearray(), []
        self.pack = zstandard.ZstdCompressor(level=3, write_content_size=True)
        head = json.dumps({"width": width}).encode()
        stream.write(struct.pack("<II", SKIPPABLE_HEADER, len(head)) + head)

    def write(self, ids: bytes) -> None:
        self.buffer += ids
        while len(self.buffer) >= self.frame:
            self._flush(self.frame)

    def _flush(self, n: int) -> None:
        own = bytes(self.buffer[:n])
        del self.buffer[:n]
        packed = self.pack.compress(own)
        self.stream.write(packed)
        self.table.append(struct.pack("<III", len(packed), len(own), xxhash.xxh64_intdigest(own) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.buffer:
            self._flush(len(self.buffer))
        rows = b"".join(self.table) + struct.pack("<IBI", len(self.table), 0x80, SEEKABLE)
        self.stream.write(struct.pack("<II", SKIPPABLE_TABLE, len(rows)) + rows)
        self.stream.close()


class FrameReader:
    """Reads ranges of ids from a file that FrameWriter wrote."""

    def __init__(self, stream):
        self.stream, self.kept, self.unpack = stream, (-1, b""), zstandard.ZstdDecompressor()
        magic, size = struct.unpack("<II", self._at(0, 8))
        if magic != SKIPPABLE_HEADER:
            raise ValueError("not a token file")
        self.width = json.loads(self._at(8, size))["width"]
        end = stream.size()
        n, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEKABLE or flags != 0x80:
            raise ValueError("no seek table with checksums")
        rows = np.frombuffer(self._at(end - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3)
        self.sizes, self.sums = rows[:, 0].tolist(), rows[:, 2].tolist()
        self.places = list(accumulate(self.sizes, initial=8 + size))
        self.starts = list(accumulate(rows[:, 1].tolist(), initial=0))

    def _at(self, place: int, n: int) -> bytes:
        self.stream.seek(place)
        return self.stream.read(n)

    def frame(self, k: int) -> bytes:
        if self.kept[0] != k:
            own = self.unpack.decompress(self._at(self.places[k], self.sizes[k]))
            if xxhash.xxh64_intdigest(own) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"frame {k} is damaged")
            self.kept = k, own
        return self.kept[1]

    def read(self, start: int, n: int):
        """The n ids from the start-th on, as arrays of unsigned 32-bit integers, a frame at a time."""
        at, end = start * self.width, (start + n) * self.width
        if end > self.starts[-1]:
            raise ValueError("beyond the end of the file")
        while at < end:
            k = bisect_right(self.starts, at) - 1
            own = self.frame(k)[at - self.starts[k] : end - self.starts[k]]
            at += len(own)
            yield np.frombuffer(own, f"<u{self.width}").astype("<u4")


class _Encoder(dict):
    """Ids of pre-tokens by the tokenizers library, each worked out once.

    A byte-level tokenizer without a normaliser treats pre-tokens on their own,
    so a text's ids are those of its pre-tokens, one after the other. Texts that
    hold an added token (an end-of-text mark, say), which the library cuts out
    first, are encoded whole.
    """

    def __init__(self, definition: str, pattern: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        own = json.loads(definition)
        self.added = [t["content"] for t in own.get("added_tokens") or []]
        before = own.get("pre_tokenizer") or {}
        self.apart = own.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        self.split, self.code = Splitter(pattern), "H" if self.width == 2 else "I"

    def bytes_of(self, ids: list[int]) -> bytes:
        return np.array(ids, f"<u{self.width}").tobytes() if sys.byteorder == "big" else array(self.code, ids).tobytes()

    def __missing__(self, token: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        out = self.bytes_of(self.tokenizer.encode(token, add_special_tokens=False).ids)
        if len(token) < 256:
            self[token] = out
        return out

    def encode(self, text: str):
        if not self.apart or any(t in text for t in self.added):
            yield self.bytes_of(self.tokenizer.encode(text, add_special_tokens=False).ids)
            return
        for piece in self.split.pieces(text):
            yield b"".join(map(self.__getitem__, piece))


_ENCODERS: dict[tuple[int, str], _Encoder] = {}


def _encoder(definition: str, pattern: str) -> _Encoder:
    """One for each worker, whatever the number of its tasks."""
    key = hash(definition), pattern
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = _Encoder(definition, pattern)
    return _ENCODERS[key]


def write_token_files(docs: DataFrame, tokenizer_path: str, pattern: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of all texts, each followed by end_id, in ascending order of the id column.

    Texts are dealt out by ranges of the id; each task writes one file to
    ``folder`` (in the shared folder by default) under a name of its own, so a
    repeated task harms nothing: the index names the files that count. Returns
    the index: id, file, part, at (ids before the document in its file),
    n_tokens and start (ids of all documents before it). A null text is empty
    and leaves only the end id; rows with a null id come first; repeated ids
    stand side by side in an order of their texts; an empty table has an empty
    index and no files. Other columns are left out. Ids are those of the
    library's encode(text, add_special_tokens=False): an added token's string in
    a text gives that token's id.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())  # of fixed size, whatever the corpus
    folder = folder or shared_files(spark, "tokens")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), text.alias("_text")).withColumn("_tie", F.xxhash64("_text"))
    rows = rows.repartitionByRange(F.col(id_col), F.col("_tie")).sortWithinPartitions(id_col, "_tie", "_text").select(id_col, "_text", F.spark_partition_id().alias("_part"))

    def work(batches):
        encoder = _encoder(shared.value, pattern)
        end, writer, at = encoder.bytes_of([end_id]), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                part = batch.column(2)[0].as_py()
                fs, path = open_fs(folder)
                fs.create_dir(path, recursive=True)
                name = f"{part:06d}-{uuid4().hex}.tokens"
                writer = FrameWriter(fs.open_output_stream(f"{path}/{name}", compression=None), encoder.width)
            starts, sizes = [], []
            for text in batch.column(1).to_pylist():
                n = 1
                for ids in encoder.encode(text):
                    n += len(ids) // encoder.width
                    writer.write(ids)
                writer.write(end)
                starts.append(at)
                sizes.append(n)
                at += n
            file = pa.array([f"{folder}/{name}"] * len(sizes), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), file, batch.column(2), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], [id_col, "file", "part", "at", "n_tokens"])
        if writer is not None:
            writer.close()

    schema = f"`{id_col}` {rows.schema[0].dataType.simpleString()}, file string, part int, at long, n_tokens long"
    index = written(rows.mapInArrow(work, schema), "token-index")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    files = index.groupBy("part").agg(F.sum("n_tokens").alias("_n")).select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return index.join(F.broadcast(files), "part").withColumn("start", F.col("_before") + F.col("at")).drop("_before")


def read_token_files(index: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Reads the documents of an index (all or some of its rows) back from the files.

    Returns id, start, n_tokens and ids_crc32 (of the ids, as little-endian
    unsigned 32-bit integers) as found in the files; frames that hold none of
    the wanted documents aren't read. A damaged frame raises.
    """
    rows = index.select(id_col, "file", "at", "n_tokens", "start").repartition("file").sortWithinPartitions("file", "at")

    def work(batches):
        name, reader = None, None
        for batch in batches:
            sizes, sums = [], []
            for file, at, n in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if file != name:
                    fs, path = open_fs(file)
                    name, reader = file, FrameReader(fs.open_input_file(path))
                got, crc = 0, 0
                for ids in reader.read(at, n):
                    got += len(ids)
                    crc = zlib.crc32(ids, crc)
                sizes.append(got)
                sums.append(crc)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())], [id_col, "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(work, f"`{id_col}` {index.schema[id_col].dataType.simpleString()}, start long, n_tokens long, ids_crc32 long")
