"""Hard-negative mining: blocks of anchors against blocks of candidates as dense products.

Anchors are dealt out by a hash into blocks of a bounded size. For each block a
first pass over all rows multiplies it with every batch of candidates and keeps,
for each anchor, the best rows of its own label; bests of tasks merge into the
anchor's positives. The block and its positives are broadcast again, and a second
pass keeps the best rows of other labels inside each positive's window of scores.
Both kinds of bests are mergeable: the best of a union are among the bests of its
parts, so a task holds one batch, a piece of the block's products and the bests.

Rules: a row with a null id, label or vector, or with a null or non-finite
component, takes no part. Of rows with the same id the least (by label, then
vector) counts. Vectors shorter than the longest end in zeros. Products are exact:
in float64 while the largest squared norm is below 2**53, in 64-bit integers below
2**56; beyond, a ValueError. Any other columns are left alone. Tables without
rows or anchors give no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import shared_dir, written

#: Bytes of an anchor block's vectors, which are broadcast.
BLOCK_BYTES = 16 << 20
#: Products that a task holds at once.
PIECE = 1 << 21

_FOUND = "anchor_id long, positive_id long, positive_score long, other_id long, score long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def usable(rows: DataFrame, label: Column, id_col: str, vector_col: str) -> DataFrame:
    """The rows that take part, one for each id: id, label, v."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).alias("v")).dropna().where(~bad)
    return kept.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")


def _matrix(column: pa.ListArray, width: int, kind: type) -> np.ndarray:
    """floor(256 * x) of every component, padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = np.floor(256 * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).astype(kind)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if (lengths == width).all():
        return values.reshape(len(column), width)
    out = np.zeros((len(column), width), kind)
    out[np.arange(width) < lengths[:, None]] = values
    return out


class Best:
    """For each of n slots the k best (score, id) met so far: highest score first, then smallest id."""

    def __init__(self, n: int, k: int, kind: type):
        self.none = -np.inf if kind is np.float64 else -(1 << 62)
        self.scores, self.ids = np.full((n, k), self.none, kind), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of candidates (ascending ids) for the slots from ``first`` on; ``none`` where a candidate isn't one."""
        k, at = self.scores.shape[1], slice(first, first + len(scores))
        held, held_ids = self.scores[at], self.ids[at]
        if scores.shape[1] > k:
            # only what can be among the batch's own k best, ties at the edge included
            edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        else:
            edge = np.full(len(scores), self.none, scores.dtype)
        last, last_id = held[:, -1], held_ids[:, -1]
        floor = np.maximum(edge, last)[:, None]
        slot, j = np.nonzero((scores >= floor) & (scores > self.none))
        new, new_ids = scores[slot, j], ids[j]
        may = (new > last[slot]) | (new_ids < last_id[slot])
        slot, new, new_ids = slot[may], new[may], new_ids[may]
        if not len(slot):
            return
        touched = np.unique(slot)
        slot = np.concatenate([slot, np.repeat(touched, k)])
        new = np.concatenate([new, held[touched].ravel()])
        new_ids = np.concatenate([new_ids, held_ids[touched].ravel()])
        order = np.lexsort((new_ids, -new, slot))
        slot, new, new_ids = slot[order], new[order], new_ids[order]
        starts = np.searchsorted(slot, touched)
        take = starts[:, None] + np.arange(k)
        held[touched], held_ids[touched] = new[take], new_ids[take]

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """(slot, place) of what was found."""
        return np.nonzero(self.scores > self.none)


def _batches(batches: Iterator[pa.RecordBatch], width: int, kind: type):
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        yield ids[order], batch.column(1).to_numpy(zero_copy_only=False)[order], _matrix(batch.column(2), width, kind)[order]


def _pieces(n: int, m: int) -> Iterator[slice]:
    step = max(1, PIECE // max(1, m))
    return (slice(a, min(a + step, n)) for a in range(0, n, step))


def _found(anchors, positives, positive_scores, ids, scores) -> pa.RecordBatch:
    cast = lambda x: pa.array(np.asarray(x).astype(np.int64))
    return pa.RecordBatch.from_arrays([cast(anchors), cast(positives), cast(positive_scores), cast(ids), cast(scores)], names=["anchor_id", "positive_id", "positive_score", "other_id", "score"])


def _same_label(block, n_positives: int, kind: type):
    """First pass: a task's best rows of each anchor's label."""

    def run(batches):
        ids, labels, vectors = block.value
        best = Best(len(ids), n_positives, kind)
        for c_ids, c_labels, c in _batches(batches, vectors.shape[1], kind):
            for label in np.intersect1d(labels, c_labels):
                own, theirs = np.flatnonzero(labels == label), np.flatnonzero(c_labels == label)
                for piece in _pieces(len(own), len(theirs)):
                    scores = vectors[own[piece]] @ c[theirs].T
                    scores[ids[own[piece]][:, None] == c_ids[theirs]] = best.none
                    best.add(own[piece][0], scores, c_ids[theirs])
        slot, place = best.rows()
        yield _found(ids[slot], np.zeros(len(slot)), np.zeros(len(slot)), best.ids[slot, place], best.scores[slot, place])

    return run


def _other_label(block, low: int, high: int, n_negatives: int, kind: type):
    """Second pass: a task's best rows of other labels in each positive's window."""

    def run(batches):
        ids, labels, vectors, positives, positive_scores, has = block.value
        n, per = positives.shape
        best = Best(n * per, n_negatives, kind)
        # integer bounds of low * p <= 100 * s <= high * p
        least, most = -((-low * positive_scores) // 100), (high * positive_scores) // 100
        for c_ids, c_labels, c in _batches(batches, vectors.shape[1], kind):
            for piece in _pieces(n, len(c_ids)):
                scores = vectors[piece] @ c.T
                scores[labels[piece][:, None] == c_labels] = best.none
                for k in range(per):
                    inside = has[piece, k, None] & (scores >= least[piece, k, None]) & (scores <= most[piece, k, None])
                    best.add(k * n + piece.start, np.where(inside, scores, best.none), c_ids)
        slot, place = best.rows()
        a, k = slot % n, slot // n
        yield _found(ids[a], positives[a, k], positive_scores[a, k], best.ids[slot, place], best.scores[slot, place])

    return run


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, label: Column, is_anchor: Column, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95,
    id_col: str = "vec_id", vector_col: str = "embedding", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Negatives of every anchor and positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on the column ``id``. A negative's score is
    from ``low`` to ``high`` percent of its positive's.
    """
    spark = rows.sparkSession
    table = written(usable(rows, label, id_col, vector_col), "candidates")
    # |floor(256 * x)| is at most 256 * |x| + 1
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.pow(256 * F.abs(x.cast("double")) + 1, F.lit(2.0)))
    n, width, norm = table.agg(F.count_if(is_anchor), F.max(F.size("v")), F.max(square)).first()
    if not n:
        return spark.createDataFrame([], RESULT)
    if norm >= 2.0**56:
        raise ValueError("inner products pass 2**56")
    kind = np.float64 if norm < 2.0**53 else np.int64
    per_block = max(1, block_bytes // (8 * max(1, width)))
    n_blocks = -(-n // per_block)
    place = f"{shared_dir(spark)}/anchors-{uuid.uuid4().hex}"
    numbered = table.where(is_anchor).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int"))
    numbered.write.partitionBy("block").parquet(place)
    anchors, out = spark.read.parquet(place), f"{shared_dir(spark)}/negatives-{uuid.uuid4().hex}"
    for b in range(n_blocks):
        block = anchors.where(F.col("block") == b).select("id", "label", "v").toArrow().sort_by([("label", "ascending"), ("id", "ascending")])
        if not len(block):
            continue
        ids, labels = block.column(0).to_numpy(), block.column(1).to_numpy()
        vectors = _matrix(block.column(2), width, kind)
        sent = spark.sparkContext.broadcast((ids, labels, vectors))
        near = _ranked(table.mapInArrow(_same_label(sent, n_positives, kind), _FOUND), ["anchor_id"], n_positives)
        best = near.select("anchor_id", "rank", "other_id", "score").toArrow()
        slot = np.argsort(ids)[np.searchsorted(np.sort(ids), best.column(0).to_numpy())]
        k = best.column(1).to_numpy() - 1
        positives, scores, has = np.zeros((len(ids), n_positives), np.int64), np.zeros((len(ids), n_positives), np.int64), np.zeros((len(ids), n_positives), bool)
        positives[slot, k], scores[slot, k], has[slot, k] = best.column(2).to_numpy(), best.column(3).to_numpy(), True
        both = spark.sparkContext.broadcast((ids, labels, vectors, positives, scores, has))
        far = _ranked(table.mapInArrow(_other_label(both, low, high, n_negatives, kind), _FOUND), ["anchor_id", "positive_id"], n_negatives)
        far.select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(out)
        sent.destroy()
        both.destroy()
    return spark.read.schema(RESULT).parquet(out)
