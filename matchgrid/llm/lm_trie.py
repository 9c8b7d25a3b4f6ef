"""Language-model scoring with an Elias-Fano n-gram trie of three levels.

Level 1 holds the words (their hashes, sorted) with counts. Levels 2 and 3 hold
their successors: keys of a context's number and a successor's, in one monotone
sequence, with monotone pointers to where each context begins. At level 2 a
successor is a word's number; at level 3, whose contexts are the places of level
2, it is relative to its context: its rank among the successors that the middle
word has in level 2. Levels are cut into shards, files in the shared folder that
tasks map into memory; Spark counts, deals out and merges what goes into them.
"""

from __future__ import annotations

import json
import mmap
import struct
from collections import OrderedDict
from dataclasses import dataclass, field
from uuid import uuid4

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import hashed_words, mix, open_fs, shared_files, written
from .elias_fano import EliasFano

#: Absolute discount of successor counts.
DISCOUNT = 0.75
#: Bytes of text, and keys, that a task holds at a time.
CHUNK, HELD = 2 << 20, 2_000_000
#: Occurrences for which a shard of levels 2 and 3 is planned; a context with more is split over several.
SHARD = 2_000_000
#: Bytes of text for which a shard of level 1 is planned.
WORDS_SHARD = 256 << 20
#: Files that a worker keeps mapped.
MAPPED = 4096
END = mix(np.array([0x2545F4914F6CDD1D], np.uint64))[0]


# Files of arrays ------------------------------------------------------------


def save(folder: str, arrays: dict[str, np.ndarray], facts: dict) -> str:
    """Writes arrays to a new file of the folder; returns its URI."""
    fs, path = open_fs(folder)
    fs.create_dir(path, recursive=True)
    name, at, head = f"{uuid4().hex}.level", 0, []
    for k, a in arrays.items():
        head.append([k, a.dtype.str, len(a), at])
        at += (a.nbytes + 63) // 64 * 64
    first = json.dumps({"facts": facts, "arrays": head}).encode()
    start = (8 + len(first) + 63) // 64 * 64
    with fs.open_output_stream(f"{path}/{name}", compression=None) as f:
        f.write((struct.pack("<Q", len(first)) + first).ljust(start, b"\0"))
        for a in arrays.values():
            f.write(a.tobytes().ljust((a.nbytes + 63) // 64 * 64, b"\0"))
    return f"{folder}/{name}"


_MAPPED: OrderedDict[str, tuple[dict, dict[str, np.ndarray]]] = OrderedDict()


def load(uri: str) -> tuple[dict, dict[str, np.ndarray]]:
    """Facts and arrays of a file; those used last stay mapped (where the store isn't a file system: read)."""
    if uri in _MAPPED:
        _MAPPED.move_to_end(uri)
        return _MAPPED[uri]
    fs, path = open_fs(uri)
    if fs.type_name == "local":
        with open(path, "rb") as f:
            data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    else:
        with fs.open_input_file(path) as f:
            data = f.read()
    (n,) = struct.unpack_from("<Q", data)
    head, start = json.loads(data[8 : 8 + n]), (8 + n + 63) // 64 * 64
    _MAPPED[uri] = head["facts"], {k: np.frombuffer(data, np.dtype(d), size, start + at) for k, d, size, at in head["arrays"]}
    while len(_MAPPED) > (MAPPED if fs.type_name == "local" else 64):
        _MAPPED.popitem(last=False)
    return _MAPPED[uri]


def _sequence(facts: dict, arrays: dict[str, np.ndarray], name: str) -> EliasFano:
    n, width = facts[name]
    return EliasFano(n, width, *(arrays[f"{name}.{k}"] for k in ("low", "high", "before")))


def _named(name: str, s: EliasFano) -> tuple[dict[str, np.ndarray], dict]:
    return {f"{name}.{k}": a for k, a in s.parts().items()}, {name: [s.n, s.width]}


# Tokens ---------------------------------------------------------------------


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts, an end after each text's, and the number of each text's tokens."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    hashes, starts = hashed_words(np.frombuffer(b"\n".join(raw), np.uint8))
    offsets = np.cumsum([0, *(len(r) + 1 for r in raw)])
    text = np.searchsorted(offsets, starts, "right") - 1
    out = np.full(len(hashes) + len(texts), END, np.uint64)
    out[np.arange(len(hashes)) + text] = hashes
    return out, np.bincount(text, minlength=len(texts)) + 1


def _chunks(texts: list[str]):
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= CHUNK):
            size += len(texts[hi])
            hi += 1
        yield lo, hi
        lo = hi


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _packed(a: np.ndarray) -> bytes:
    """Compressed integers; bytes of equal weight stand together."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes())


def _unpacked(b: bytes, kind: str) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(size, -1).T).view(kind).ravel()


def _rows_by_shard(keys: np.ndarray, counts: np.ndarray, shard: np.ndarray):
    """Sorted keys and counts as a row for each shard that has some."""
    cut = np.flatnonzero(np.diff(shard)) + 1
    for k, c, s in zip(np.split(keys, cut), np.split(counts, cut), np.split(shard, cut), strict=True):
        if len(k):
            yield int(s[0]), _packed(np.diff(k, prepend=k.dtype.type(0))), _packed(c.astype(np.uint32))


_PARTS = "shard int, keys binary, counts binary"


def _gathered(texts: DataFrame, turn, cut) -> DataFrame:
    """Rows of keys and counts of all texts: turn(hashes) gives keys, cut(sorted keys) their shards."""

    def work(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out():
            keys, counts = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            rows = list(_rows_by_shard(keys, counts, cut(keys)))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["shard", "keys", "counts"])

        size = 0
        for batch in batches:
            every = batch.column(0).to_pylist()
            for lo, hi in _chunks(every):
                keys, counts = np.unique(turn(*tokens(every[lo:hi])), return_counts=True)
                held.append((keys, counts.astype(np.int64)))
                size += len(keys)
                if size >= HELD:
                    yield out()
                    size = 0
        if held:
            yield out()

    return texts.mapInArrow(work, _PARTS)


def _merged(rows) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of a shard, from all its rows; rows are unpacked one by one into their place."""
    parts = list(zip(rows["keys"], rows["counts"], strict=True))
    ends = np.cumsum([zstandard.frame_content_size(k) // 8 for k, _ in parts])
    keys, counts, lo = np.empty(ends[-1], np.uint64), np.empty(ends[-1], np.uint32), 0
    for (k, c), hi in zip(parts, ends.tolist(), strict=True):
        np.cumsum(_unpacked(k, "<u8"), dtype=np.uint64, out=keys[lo:hi])
        counts[lo:hi] = _unpacked(c, "<u4")
        lo = hi
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    counts = counts[order]
    del order
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first, dtype=np.int64)


# The model ------------------------------------------------------------------


def _coded(p: np.ndarray) -> tuple[np.ndarray, float]:
    """Probabilities as steps of -log10 in a byte each, and the step: the least of them is 255."""
    far = -np.log10(p)
    step = max(float(far.max()) / 255, 1e-9) if len(p) else 1.0
    return np.rint(far / step).astype(np.uint8), step


@dataclass
class Level:
    """Successors of contexts 0 to contexts - 1 as keys context * span + successor: where the shards are.

    starts: least keys of the shards, ascending; files ("" for none) and bases:
    keys in the shards before. split: successors of contexts that are in several
    shards, and what they leave.
    """

    contexts: int
    span: int
    starts: np.ndarray
    files: list[str] = field(default_factory=list)
    bases: list[int] = field(default_factory=list)
    size: int = 0
    split: dict[int, tuple[int, float]] = field(default_factory=dict)

    def shard_of(self, keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, keys, "right") - 1

    def _by_shard(self, keys: np.ndarray):
        """Parts of sorted keys, with the shard that each belongs to."""
        shard = self.shard_of(keys)
        cut = np.flatnonzero(np.diff(shard, prepend=-1, append=-1))
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            yield int(shard[lo]), slice(lo, hi)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of sorted keys the place in the level (-1: absent) and the discounted probability (0: absent)."""
        place, p = np.full(len(keys), -1, np.int64), np.zeros(len(keys))
        for s, own in self._by_shard(keys):
            if self.files[s]:
                facts, arrays = load(self.files[s])
                at = _sequence(facts, arrays, "keys").find(keys[own] - self.starts[s])
                seen = np.flatnonzero(at >= 0)
                place[own.start + seen] = at[seen] + self.bases[s]
                p[own.start + seen] = 10.0 ** (-facts["step"] * arrays["codes"][at[seen]])
        return place, p

    def begins(self, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of sorted contexts the place of the first successor, and the probability left to shorter contexts (1: no successors)."""
        place, left = np.full(len(contexts), self.size, np.int64), np.ones(len(contexts))
        for s, own in self._by_shard(contexts.astype(np.uint64) * np.uint64(self.span)):
            place[own] = self.bases[s]
            if self.files[s]:
                facts, arrays = load(self.files[s])
                k = contexts[own] - facts["first"]
                place[own] += _sequence(facts, arrays, "pointers").get(k).astype(np.int64)
                codes = arrays["left"][k]
                left[own] = np.where(codes == 255, 1.0, 10.0 ** (-facts["left"] * codes))
        for c, (_, rest) in self.split.items():
            k = np.searchsorted(contexts, c)
            if k < len(contexts) and contexts[k] == c:
                left[k] = rest
        return place, left


@dataclass
class Trie:
    """A model. words: (URI, first number) by range of hashes."""

    words: list[tuple[str, int]]
    total: int
    distinct: int
    bits: int
    pairs: Level | None = None
    triples: Level | None = None
    span: int = 0

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers (-1: unknown) and counts of sorted hashes."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        shard = (hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)
        edges = np.searchsorted(shard, np.arange(len(self.words) + 1))
        for s, (uri, first) in enumerate(self.words):
            lo, hi = edges[s], edges[s + 1]
            if uri and lo < hi:
                facts, arrays = load(uri)
                at = _sequence(facts, arrays, "hashes").find(hashes[lo:hi] - np.uint64(facts["base"]))
                known = at >= 0
                ids[lo:hi][known] = at[known] + first
                counts[lo:hi][known] = arrays["counts"][at[known]]
        return ids, counts

    def placed(self, hashes: np.ndarray, sizes: np.ndarray) -> Placed:
        """Where the tokens of texts, one text after the other, stand in the levels that there are."""
        own, back = np.unique(hashes, return_inverse=True)
        ids, counts = self.look_up(own)  # numbers ascend as hashes do
        starts = np.cumsum(sizes) - sizes
        before = np.empty_like(back)
        before[1:] = back[:-1]
        before[starts] = np.searchsorted(own, END)  # every text has an end, and begins after one
        at = Placed(ids[back], counts[back], starts)
        at.known = np.flatnonzero((ids[before] >= 0) & (at.ids >= 0))
        at.pair_keys = ids[before[at.known]].astype(np.uint64) * np.uint64(max(self.distinct, 1)) + at.ids[at.known].astype(np.uint64)
        if not self.pairs:
            return at
        begin, left = np.zeros(len(own), np.int64), np.ones(len(own))
        some = ids >= 0
        begin[some], left[some] = self.pairs.begins(ids[some])
        at.left = left[before]
        keys, pair = np.unique(at.pair_keys, return_inverse=True)
        places, p = self.pairs.find(keys)  # they ascend as keys do
        at.p = np.zeros(len(hashes))
        at.p[at.known] = p[pair]
        index = np.full(len(hashes), -1, np.int64)  # of each token's pair among the keys, if the level has it
        index[at.known] = np.where(places[pair] >= 0, pair, -1)
        context = np.empty_like(index)
        context[1:] = index[:-1]
        context[starts] = -1
        at.rows = np.flatnonzero((context >= 0) & (index >= 0))
        span = self.triples.span if self.triples else self.span
        rank = places[index[at.rows]] - begin[before[at.rows]]
        at.triple_keys = places[context[at.rows]].astype(np.uint64) * np.uint64(span) + rank.astype(np.uint64)
        if self.triples:
            rest, seen = np.ones(len(keys) + 1), np.flatnonzero(places >= 0)
            rest[seen] = self.triples.begins(places[seen])[1]
            at.rest = rest[context]  # the last stands for tokens without a context
        return at

    def probabilities(self, at: Placed) -> tuple[np.ndarray, np.ndarray]:
        """Of each token alone, and after those before it."""
        p1 = (at.counts + 1.0) / (self.total + 1.0 * (self.distinct + 1))
        if not self.pairs:
            return p1, p1
        p = at.p + at.left * p1
        if self.triples:
            keys, back = np.unique(at.triple_keys, return_inverse=True)
            p = at.rest * p
            p[at.rows] += self.triples.find(keys)[1][back]
        return p1, p


@dataclass
class Placed:
    """Tokens in a model: numbers (-1: unknown) and counts; of known pairs (rows known) the keys and, by level 2, probabilities p, what the word before leaves; of triples (rows) the keys and what pairs leave."""

    ids: np.ndarray
    counts: np.ndarray
    starts: np.ndarray
    known: np.ndarray | None = None
    pair_keys: np.ndarray | None = None
    left: np.ndarray | None = None
    p: np.ndarray | None = None
    rows: np.ndarray | None = None
    triple_keys: np.ndarray | None = None
    rest: np.ndarray | None = None


def _starts(cuts: list[int], hot: dict[int, int], span: int, contexts: int, each: int) -> np.ndarray:
    """Least keys of shards: at the cuts, and within hot contexts at equal parts of the span."""
    keys = {0} | {c * span for c in cuts if c < contexts}
    for c, n in hot.items():
        parts = -(-n // each)
        keys |= {c * span + span * k // parts for k in range(parts)}
        keys |= {(c + 1) * span} if c + 1 < contexts else set()
    return np.array(sorted(keys), np.uint64)


_RESULT = "shard int, file string, n long, total long, cuts array<long>, hot array<struct<number: long, n: long>>, most long"


def _made(shard: int, file: str, counts: np.ndarray, each: int, most: int = 0):
    """What a task says of a shard that it wrote: where each so many occurrences have gone by, and entries with a quarter of that."""
    import pandas as pd

    cuts = (np.flatnonzero(np.diff(np.cumsum(counts) // each, prepend=0) > 0) + 1).tolist()
    hot = np.flatnonzero(counts > each // 4)
    return pd.DataFrame({"shard": [shard], "file": [file], "n": [len(counts)], "total": [int(counts.sum())], "cuts": [cuts], "hot": [[{"number": int(i), "n": int(counts[i])} for i in hot]], "most": [most]})


def _level(parts: DataFrame, level: Level, hot: dict[int, int], folder: str, name: str, each: int) -> tuple[Level, list[int], dict[int, int], int]:
    """Writes a level's shards from gathered parts; also the cuts and hot places of the next, and the most successors of a context in a shard."""
    starts, span, contexts = level.starts, level.span, level.contexts

    def work(key, rows):
        shard = int(key[0])
        keys, counts = _merged(rows)
        low = int(starts[shard])
        high = int(starts[shard + 1]) if shard + 1 < len(starts) else contexts * span
        first, last = -(-low // span), -(-high // span)  # contexts that begin here
        context = (keys // np.uint64(span)).astype(np.int64)
        begin = low // span
        totals, fans = np.bincount(context - begin, counts, last - begin), np.bincount(context - begin, minlength=last - begin)
        for c, n in hot.items():
            if begin <= c < last:
                totals[c - begin] = n
        q, step = _coded(np.maximum(counts - DISCOUNT, 1e-3) / totals[context - begin])
        arrays, facts = _named("keys", EliasFano.build(keys - np.uint64(low), high - low))
        pointers = np.searchsorted(keys, np.arange(first, last, dtype=np.uint64) * np.uint64(span))
        more, named = _named("pointers", EliasFano.build(pointers, len(keys) + 1))
        totals, fans = totals[first - begin :], fans[first - begin :].astype(float)
        fans = np.where(totals > 0, fans, 0)
        left, code = np.full(last - first, 255, np.uint8), 1.0
        if (some := np.flatnonzero(fans)).size:
            far = -np.log10(DISCOUNT * fans[some] / totals[some])
            code = max(float(far.max()) / 254, 1e-9)
            left[some] = np.rint(far / code).astype(np.uint8)
        file = save(folder, {**arrays, **more, "codes": q, "left": left}, facts | named | {"step": step, "left": code, "first": first})
        return _made(shard, file, counts, each, int(fans.max(initial=0)))

    made = {r["shard"]: r for r in written(parts.groupBy("shard").applyInPandas(work, _RESULT), name).collect()}  # a row for each shard
    cuts, next_hot, base = [], {}, 0
    for s in range(len(starts)):
        level.bases.append(base)
        level.files.append(made[s]["file"] if s in made else "")
        if s in made:
            cuts += [base + c for c in made[s]["cuts"]] + [base]
            next_hot |= {base + h["number"]: h["n"] for h in made[s]["hot"]}
            base += made[s]["n"]
    level.size = base
    for c, n in hot.items():  # what is left of a context that is split follows from all its shards
        if n > each:
            end = level.begins(np.array([c + 1]))[0][0] if c + 1 < contexts else base
            fan = int(end - level.begins(np.array([c]))[0][0])
            if fan:
                level.split[c] = fan, DISCOUNT * fan / n
    return level, cuts, next_hot, max((r["most"] for r in made.values()), default=0)


def build(texts: DataFrame, each: int = SHARD) -> Trie:
    """A model of a one-column DataFrame of texts; shards of levels 2 and 3 are planned for so many occurrences."""
    spark = texts.sparkSession
    folder = shared_files(spark, "trie")
    size = texts.agg(F.sum(F.octet_length(texts.columns[0]))).first()[0] or 0
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // WORDS_SHARD)
    bits = max(0, (partitions - 1).bit_length())
    shift = np.uint64(64 - bits) if bits else np.uint64(0)
    cut = (lambda keys: (keys >> shift).astype(np.int64)) if bits else (lambda keys: np.zeros(len(keys), np.int64))

    def words_level(key, rows):
        keys, counts = _merged(rows)
        base = int(key[0]) << (64 - bits) if bits else 0
        arrays, facts = _named("hashes", EliasFano.build(keys - np.uint64(base), 1 << 64 - bits))
        arrays["counts"] = counts.astype(np.uint32 if counts.max() < 1 << 32 else np.int64)
        return _made(key[0], save(folder, arrays, facts | {"base": base}), counts, each)

    parts = _gathered(texts, lambda hashes, sizes: hashes, cut)
    made = {r["shard"]: r for r in written(parts.groupBy("shard").applyInPandas(words_level, _RESULT), "words").collect()}  # a row for each shard
    words, cuts, hot, first = [], [], {}, 0
    for s in range(1 << bits):
        words.append((made[s]["file"] if s in made else "", first))
        if s in made:
            cuts += [first + c for c in made[s]["cuts"]]
            hot |= {first + h["number"]: h["n"] for h in made[s]["hot"]}
            first += made[s]["n"]
    trie = Trie(words, sum(r["total"] for r in made.values()), first, bits)
    if not trie.total:
        return trie

    shared = spark.sparkContext.broadcast(trie)  # names of files
    level = Level(trie.distinct, trie.distinct, _starts(cuts, hot, trie.distinct, trie.distinct, each))
    parts = _gathered(texts, lambda hashes, sizes: shared.value.placed(hashes, sizes).pair_keys, level.shard_of)
    trie.pairs, cuts, next_hot, most = _level(parts, level, hot, folder, "pairs", each)
    most = max([most, *(fan for fan, _ in trie.pairs.split.values())])

    trie.span = span = most + 1
    if trie.pairs.size * span >= 1 << 63:
        raise ValueError("too many pairs for keys of 63 bits")
    shared_pairs = spark.sparkContext.broadcast(trie)
    level = Level(trie.pairs.size, span, _starts(cuts, next_hot, span, trie.pairs.size, each))
    parts = _gathered(texts, lambda hashes, sizes: shared_pairs.value.placed(hashes, sizes).triple_keys, level.shard_of)
    trie.triples = _level(parts, level, next_hot, folder, "triples", each)[0]
    return trie


def scores(texts: list[str], trie: Trie) -> dict[str, np.ndarray]:
    """Counts and scores of texts."""
    hashes, sizes = tokens(texts)
    at = trie.placed(hashes, sizes)
    p1, p = trie.probabilities(at)
    sums = lambda x: np.add.reduceat(x, at.starts)
    return {"n_tokens": sizes, "n_known": sums((at.ids >= 0).astype(np.int64)), "base_score": sums(np.log10(p1)), "score": sums(np.log10(p))}


def lm_scores(docs: DataFrame, folds: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores every whole text by a model of the texts outside the held-out fold.

    A row is held out if crc32(id as text; empty for null) mod folds is held.
    Tokens are words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end.
    Returns id, held_out, n_tokens, n_known (tokens seen in training),
    train_tokens, base_score (sum of log10 of add-one unigram probabilities) and
    score: log10 probability by the trie, trigrams and bigrams with absolute
    discounting, interpolated with those unigrams, quantised. A null text is empty: one end.
    If all rows are held out nothing is known and scores are those of an empty
    model. Repeated rows each stay and count; other columns are left out; an
    empty table gives no rows.
    """
    held_out = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == held
    text = F.coalesce(F.col(text_col), F.lit(""))
    trie = build(docs.where(~held_out).select(text.alias("_text")))
    shared = docs.sparkSession.sparkContext.broadcast(trie)  # names of files
    rows = docs.select(F.col(id_col), held_out.alias("held_out"), text.alias("_text"))

    def work(batches):
        trie = shared.value
        for batch in batches:
            every = batch.column(2).to_pylist()
            at = 0
            for lo, hi in _chunks(every):
                s = scores(every[lo:hi], trie)
                part = batch.slice(at, hi - lo)
                at += hi - lo
                total = np.full(hi - lo, trie.total)
                columns = [part.column(0), part.column(1), *(pa.array(s[k], pa.int64()) for k in ("n_tokens", "n_known")), pa.array(total, pa.int64()), *(pa.array(s[k], pa.float64()) for k in ("base_score", "score"))]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(work, f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
