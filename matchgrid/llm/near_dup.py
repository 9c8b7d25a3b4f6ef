"""Near-duplicate documents: MinHash bands, odd sketches, exact confirmation.

MinHash samples of a document's shingle set are cut into bands, which propose
candidates. Its least hashes, all of them in a set of up to SAMPLE shingles, are
folded into a bitmap of parities (an odd sketch): hashes that two sets share
cancel out in the XOR of their bitmaps, so its population count tells high
similarities precisely. What passes is confirmed on the full shingle sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import free_names, mix, shingle_hashes, word_hashes, written
from .graph import components

#: 32 bands of 4 samples: a pair of similarity 0.8 shares no band once in 2 * 10**7.
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
#: Bits of an odd sketch, and hashes in a sample up to which the sample is the whole set.
BITS, SAMPLE = 1024, 1024
#: Parts that groups are dealt out in where they meet their smallest ids.
SALTS = 16
_RANDOM = np.random.default_rng(20240607)
_FACTORS = _RANDOM.integers(0, 1 << 31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_OFFSETS = _RANDOM.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
_BAND_SALTS = mix(np.arange(1001, 1001 + BANDS, dtype=np.uint64))


def shingle_set(text: str, k: int) -> np.ndarray:
    """Sorted distinct hashes of a text's k-word shingles (A-Z lower-cased)."""
    return np.unique(shingle_hashes(word_hashes(text), k))


def samples(own: np.ndarray) -> np.ndarray:
    """MinHash samples of a set that isn't empty."""
    x = (own >> np.uint64(32)).astype(np.uint32)
    step, out = max(1, (1 << 18) // len(x)), np.empty(SAMPLES, np.uint32)
    for i in range(0, SAMPLES, step):
        out[i : i + step] = (x * _FACTORS[i : i + step, None] + _OFFSETS[i : i + step, None]).min(axis=1)
    return out


def band_keys(own: np.ndarray) -> np.ndarray:
    """A key for each band, as signed 64-bit integers."""
    keys = _BAND_SALTS.copy()
    for column in samples(own).astype(np.uint64).reshape(BANDS, ROWS).T:
        keys = mix(keys ^ column) + _BAND_SALTS
    return keys.view(np.int64)


def odd_sketch(own: np.ndarray) -> tuple[int, np.ndarray]:
    """Level and parity bitmap of the least hashes of a set: those below 2**(64 - level).

    The level is 0, so that the sample is the whole set, up to SAMPLE hashes, and
    grows by one each time the set doubles.
    """
    level = max(0, (len(own) - 1).bit_length() - (SAMPLE - 1).bit_length())
    least = own[: np.searchsorted(own, np.uint64(1 << 64 - level))] if level else own
    bits = np.bincount((mix(least) % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return level, np.packbits(bits.astype(np.uint8)).view(np.int64)


def set_key(own: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    a, b = np.add.reduce(mix(own)), np.bitwise_xor.reduce(mix(own ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
    return int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big")


def signatures(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """For each row: id, place (hash of the text), n_shingles, node (key of the set; null if empty), bands, level, sketch."""
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(text_col)).alias("place"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def work(batches):
        for batch in batches:
            sizes, nodes, bands, levels, sketches = [], [], [], [], []
            for text in batch.column(2).to_pylist():
                own = shingle_set(text, k)
                sizes.append(len(own))
                nodes.append(set_key(own) if len(own) else None)
                bands.append(band_keys(own) if len(own) else None)
                level, sketch = odd_sketch(own) if len(own) else (None, None)
                levels.append(level)
                sketches.append(sketch)
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (bands, sketches)]
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), lists[0], pa.array(levels, pa.int32()), lists[1]]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "place", "n_shingles", "node", "bands", "level", "sketch"])

    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(work, f"doc {kind}, place long, n_shingles long, node binary, bands array<long>, level int, sketch array<long>")


def _alike(percent: int, a: str, b: str) -> Column:
    """Whether sizes and odd sketches allow this similarity.

    Of two sets of m and n hashes at least this similar, at most
    (m + n) * (1 - s) / (1 + s) stand in one only, and each of those flips one
    bit, so at level 0 no such pair is refused. At higher levels the sampled
    share of them has room for 5.5 standard deviations. Neighbouring levels,
    as sets near a power of two may have, aren't compared.
    """
    n, m, level = F.col(f"{a}.n"), F.col(f"{b}.n"), F.col(f"{a}.level")
    differing = sum((F.bit_count(F.col(f"{a}.sketch")[i].bitwiseXOR(F.col(f"{b}.sketch")[i])) for i in range(BITS // 64)), F.lit(0))
    most = (n + m) * (100 - percent) / (100 + percent)
    share = most / F.pow(F.lit(2.0), level)
    limit = F.when(level == 0, most).otherwise(share + 5.5 * F.sqrt(share) + 6)
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((level != F.col(f"{b}.level")) | (differing <= limit))


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    both = pairs.join(texts.select(F.col("nid").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("nid").alias("b"), F.col("text").alias("tb")), "b")

    def work(batches):
        kept: dict[int, np.ndarray] = {}

        def own(node: int, text: str) -> np.ndarray:
            if node not in kept:
                if len(kept) >= 64:
                    kept.clear()
                kept[node] = shingle_set(text, k)
            return kept[node]

        for batch in batches:
            a, b, ta, tb = (batch.column(i).to_pylist() for i in range(4))
            same = []
            for x, y, tx, ty in zip(a, b, ta, tb, strict=True):
                s, t = own(x, tx), own(y, ty)
                n = len(np.intersect1d(s, t, assume_unique=True))
                same.append(100 * n >= percent * (len(s) + len(t) - n))
            yield batch.select([0, 1]).filter(pa.array(same, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(work, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents whose sets of k-word shingles overlap by percent or more.

    Returns a row for each row of docs: id, n_shingles, component_id (the
    smallest id that can be reached over links, itself included) and kept (the
    row's id is its component_id). Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z
    lower-cased; a text of fewer than k words is one shingle; one without words,
    empty or null has no shingles and links with nothing. Rows with equal sets
    are one node, so copies are never paired. Repeated rows and repeated ids
    stay, a result each. A null id counts as no candidate for component_id; a
    group of null ids only has a null component_id and all of them kept. Other
    columns are left out; an empty table gives no rows.

    Every band compares its members with the smallest of them and with one drawn
    by hash, another in each band. If confirmed links
    leave members of a band in different groups, the pairs between those groups
    are compared too, so a link is lost only where a pair shares no band at all
    (see BANDS) or, among sets of over SAMPLE shingles, its samples differ improbably.
    """
    rows = written(signatures(docs, k, id_col, text_col), "signatures")
    first = rows.where("node is not null").groupBy("node").agg(F.min("doc").alias("least"), F.first(F.struct("doc", "place", "n_shingles", "bands", "level", "sketch")).alias("r"))
    nodes = first.select("node", "least", "r.doc", "r.place", F.col("r.n_shingles").alias("n"), "r.bands", "r.level", "r.sketch", F.monotonically_increasing_id().alias("nid"))
    nodes = written(nodes, "nodes")
    banded = nodes.select("nid", F.explode("bands").alias("band"))
    drawn = F.min_by("nid", F.xxhash64("nid", "band"))
    leaders = banded.groupBy("band").agg(F.min("nid").alias("leader"), drawn.alias("other"), F.count("*").alias("members")).where("members > 1")
    shared = written(banded.join(leaders, "band"), "bands")
    side = nodes.select("nid", "n", "level", "sketch")
    hubs = F.array_distinct(F.array("leader", "other"))
    stars = shared.select(F.explode(hubs).alias("hub"), "nid").where("hub <> nid").select(F.least("hub", "nid").alias("a"), F.greatest("hub", "nid").alias("b")).distinct()
    pairs = stars.alias("p").join(side.alias("x"), F.col("p.a") == F.col("x.nid")).join(side.alias("y"), F.col("p.b") == F.col("y.nid")).where(_alike(percent, "x", "y")).select("p.a", "p.b")
    pairs = written(pairs, "pairs")

    def texts_of(pairs: DataFrame) -> DataFrame:
        """(nid, text) of the nodes in pairs: the text of one of the rows that have the node's set."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("nid")).distinct()
        places = nodes.select("nid", "doc", "place").join(wanted, "nid")
        text = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text")).withColumn("_place", F.xxhash64("text"))
        found = text.join(places, (F.col("_place") == F.col("place")) & F.col("_doc").eqNullSafe(F.col("doc")))
        return written(found.select("nid", "text").dropDuplicates(["nid"]), "texts")

    links = written(_confirmed(pairs, texts_of(pairs), k, percent), "confirmed")
    groups = written(components(links), "groups")

    members = shared.where("members > 2").select("band", "nid").join(groups.withColumnRenamed("node", "nid"), "nid", "left").select("band", "nid", F.coalesce("root", "nid").alias("root"))
    members = written(members, "members")
    split = members.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band")
    open_ = members.join(split, "band").join(side, "nid")
    across = open_.alias("x").join(open_.alias("y"), (F.col("x.band") == F.col("y.band")) & (F.col("x.root") < F.col("y.root")) & _alike(percent, "x", "y"))
    across = across.select(F.least("x.nid", "y.nid").alias("a"), F.greatest("x.nid", "y.nid").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    across = written(across, "across")
    if not across.isEmpty():
        more = written(_confirmed(across, texts_of(across), k, percent), "confirmed")
        if not more.isEmpty():
            groups = written(components(more.unionByName(groups.select(F.col("node").alias("a"), F.col("root").alias("b")))), "groups")

    # A component may hold a third of all nodes: its rows are dealt out in parts, to each of which its smallest id goes.
    grouped = groups.select(F.col("node").alias("nid"), "root").join(nodes.select("nid", "node", "least"), "nid").withColumn("part", F.pmod(F.xxhash64("nid"), F.lit(SALTS)))
    smallest = grouped.groupBy("root").agg(F.min("least").alias("component_id")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
    linked = grouped.join(smallest, ["root", "part"]).select("node", "component_id")
    alone = nodes.join(groups.select(F.col("node").alias("nid")), "nid", "left_anti").select("node", F.col("least").alias("component_id"))
    placed = linked.unionByName(alone)
    found = rows.select("doc", "n_shingles", "node").join(placed, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc")).otherwise(F.col("component_id"))
    return found.select(F.col("doc").alias(id_col), "n_shingles", component.alias("component_id")).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def first_of_each_group(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with their columns, that near_duplicates keeps: of each group that with the smallest id.

    Rows without words all stay. Rows that share an id stay or go together: they
    go if for one of them the id isn't the smallest of its group.
    """
    (gone,) = free_names(docs, "gone")
    found = near_duplicates(docs, k, percent, id_col, text_col).where(~F.col("kept")).select(F.col(id_col).alias(gone)).distinct()
    return docs.join(found, F.col(id_col).eqNullSafe(F.col(gone)), "left_anti")
