"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of 50 words. Each is encoded by a layer over
measures of its characters and words; gated attention weighs the encodings, and
a logistic layer scores their weighted sum. All weights are learned from labels
of documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import _SPACE, _powers, bounded_sample, mix

#: Words in a passage.
PASSAGE = 50
#: Characters of text that are encoded at a time.
CHUNK = 1 << 20
#: Labelled rows at most that the model is fitted on.
MAX_TRAINING_ROWS = 4000
#: Passages at most, spread over the text, that a row has in fitting.
MAX_TRAINING_PASSAGES = 400
#: Width of a passage's encoding, and of the attention's hidden layer.
WIDTH, ATTENTION = 24, 12

_CLASSES = 8  # lower, upper, digit, symbols, marks, other ASCII, first bytes of non-ASCII, further bytes
_CLASS = np.full(256, 5, np.uint8)
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A] = 0, 1, 2
_CLASS[np.frombuffer(b"#*$%&|<>", np.uint8)] = 3
_CLASS[np.frombuffer(b".,;:!?'\"()-", np.uint8)] = 4
_CLASS[0xC0:], _CLASS[0x80:0xC0] = 6, 7
_PAIRS = 24
FEATURES = _CLASSES + 9 + _PAIRS


def _chunk_features(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    inside = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edge[::2], edge[1::2]
    n = len(starts)
    if not n:
        return np.zeros((0, FEATURES), np.float32)
    lengths = ends - starts
    owner = np.arange(n) // PASSAGE
    p = int(owner[-1]) + 1
    words = np.bincount(owner, minlength=p).astype(np.float64)
    chars = data[inside]
    first = np.cumsum(lengths) - lengths
    holder = np.repeat(owner, lengths)
    size = np.bincount(owner, lengths, p)
    classes = np.bincount(holder * _CLASSES + _CLASS[chars], minlength=p * _CLASSES).reshape(p, _CLASSES) / size[:, None]
    at = np.arange(len(chars)) - np.repeat(first, lengths)
    hashes = mix(np.add.reduceat((chars.astype(np.uint64) + np.uint64(1)) * _powers(int(lengths.max()))[at], first))
    again = np.zeros(n, bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(n, bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    mean = size / words
    spread = np.sqrt(np.maximum(np.bincount(owner, lengths.astype(np.float64) ** 2, p) / words - mean**2, 0))
    share = lambda flags: np.bincount(owner, flags, p) / words
    capital = _CLASS[data[starts]] == 1
    marked = np.isin(_CLASS[data[ends - 1]], (3, 4))
    rest = [np.minimum(mean, 40) / 10, np.minimum(spread, 40) / 10, share(again), share(new[np.argsort(order)]), share(lengths <= 3), share(lengths == 1), share(capital), share(marked), words / PASSAGE]
    code = (chars[:-1].astype(np.uint32) * 31 + chars[1:]) * np.uint32(2654435761)
    pairs = np.bincount(holder[1:] * _PAIRS + ((code >> np.uint32(16)) % _PAIRS), minlength=p * _PAIRS).reshape(p, _PAIRS) / size[:, None]
    return np.concatenate([classes, np.stack(rest, 1), pairs * 4], 1).astype(np.float32)


def passages(text: str) -> np.ndarray:
    """A row of FEATURES measures for each passage; a text without words has one row of zeros."""
    out, lo = [], 0
    while lo < len(text):
        hi = min(len(text), lo + CHUNK)
        if hi < len(text) and (cut := text.rfind(" ", lo, hi)) > lo:
            hi = cut
        out.append(_chunk_features(text[lo:hi].encode("utf-8", "replace")))
        lo = hi
    found = np.concatenate(out) if out else np.zeros((0, FEATURES), np.float32)
    return found if len(found) else np.zeros((1, FEATURES), np.float32)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionModel:
    """Encoder, gated attention and logistic head, fitted with Adam."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        draw = lambda a, b: r.normal(0, 1 / np.sqrt(a), (a, b))
        self.w = {"E": draw(FEATURES, WIDTH), "e": np.zeros(WIDTH), "V": draw(WIDTH, ATTENTION), "U": draw(WIDTH, ATTENTION), "a": draw(ATTENTION, 1)[:, 0], "o": draw(WIDTH, 1)[:, 0], "b": np.zeros(1)}
        self.mean, self.scale = np.zeros(FEATURES), np.ones(FEATURES)

    def forward(self, x: np.ndarray, starts: np.ndarray):
        """x: passages of bags, one after the other; starts: where each bag begins."""
        w, sizes = self.w, np.diff(starts, append=len(x))
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ w["E"] + w["e"])
        t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        s = (t * g) @ w["a"]
        e = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), sizes))
        a = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return _sigmoid(z @ w["o"] + w["b"]), (x, h, t, g, a, z, sizes)

    def gradients(self, p, y, starts, kept):
        w, (x, h, t, g, a, z, sizes) = self.w, kept
        d = (p - y) / len(y)
        dz = d[:, None] * w["o"]
        per = np.repeat(dz, sizes, axis=0)
        da = (per * h).sum(1)
        ds = a * (da - np.repeat(np.add.reduceat(a * da, starts), sizes))
        dt, dg = ds[:, None] * w["a"] * g * (1 - t * t), ds[:, None] * w["a"] * t * g * (1 - g)
        dh = (a[:, None] * per + dt @ w["V"].T + dg @ w["U"].T) * (1 - h * h)
        return {"E": x.T @ dh, "e": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "a": (t * g).T @ ds, "o": z.T @ d, "b": np.array([d.sum()])}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = 40, batch: int = 64, rate: float = 0.01, decay: float = 1e-3, seed: int = 6) -> AttentionModel:
        if not bags:
            return self
        every = np.concatenate(bags).astype(np.float64)
        self.mean, self.scale = every.mean(0), every.std(0) + 1e-3
        r, m, v, step = np.random.default_rng(seed), {k: 0.0 for k in self.w}, {k: 0.0 for k in self.w}, 0
        for epoch in range(epochs):
            order = r.permutation(len(bags))
            for lo in range(0, len(bags), batch):
                own = order[lo : lo + batch]
                starts = np.cumsum([0, *(len(bags[i]) for i in own)])[:-1]
                p, kept = self.forward(np.concatenate([bags[i] for i in own]).astype(np.float64), starts)
                step += 1
                for k, grad in self.gradients(p, labels[own], starts, kept).items():
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad**2
                    move = m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
                    self.w[k] = self.w[k] - rate * (1 - epoch / epochs) * (move + decay * self.w[k])
        return self

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        starts = np.cumsum([0, *map(len, bags)])[:-1]
        return self.forward(np.concatenate(bags).astype(np.float64), starts)[0]


def _spread(own: np.ndarray, n: int) -> np.ndarray:
    """own, or n of its rows at equal distances."""
    return own if len(own) <= n else own[np.linspace(0, len(own) - 1, n).astype(int)]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text", max_passages: int = MAX_TRAINING_PASSAGES) -> AttentionModel:
    """Fits a model to at most max_rows labelled rows (see bounded_sample), each with max_passages passages at most.

    Only fitting is bounded so: scores are of whole texts.

    Rows with a null label or id aren't used; without any the model is as initialised.
    """
    known = labels.select(F.col(id_col).alias("_doc"), F.col(label).cast("double").alias("_label")).where("_doc is not null and _label is not null")
    known = bounded_sample(known, max_rows, "_doc")
    found = docs.join(F.broadcast(known), F.col(id_col) == F.col("_doc")).select("_doc", "_label", F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def work(batches):
        for batch in batches:
            own = [_spread(passages(t), max_passages).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.binary())], ["_doc", "_label", "bag"])

    rows = found.mapInArrow(work, f"_doc {found.schema[0].dataType.simpleString()}, _label double, bag binary")
    rows = sorted(rows.orderBy(F.xxhash64("_doc"), F.xxhash64("bag")).limit(max_rows).collect(), key=lambda r: (str(r["_doc"]), bytes(r["bag"])))
    bags = [np.frombuffer(r["bag"], np.float32).reshape(-1, FEATURES) for r in rows]
    return AttentionModel().fit(bags, np.array([r["_label"] for r in rows]))


def scored(docs: DataFrame, model: AttentionModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1) of every row, from the whole text; null and empty texts are one blank passage."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def work(batches):
        model = shared.value
        for batch in batches:
            scores, texts = [], batch.column(1).to_pylist()
            for lo in range(0, len(texts), 64):
                scores.append(model.score([passages(t) for t in texts[lo : lo + 64]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else [], pa.float64())], [id_col, "score"])

    return rows.mapInArrow(work, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = 0.3, label: str = "quality", max_rows: int = MAX_TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores every row of docs by a model fitted to labels outside the held-out fold.

    A row is held out if crc32(id as text) mod folds is held; labels of such rows
    are never read. Returns id, held_out, score and predicted (1 from threshold
    on, else 0). Null and empty texts get a score too; a null id counts as
    empty text for the fold; repeated rows each stay; ids labelled twice are
    used twice; other columns are left out; an empty table gives no rows.
    """
    fold = lambda c: F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % folds == held
    model = train(docs, labels.where(~fold(F.col(id_col))), label, max_rows, id_col, text_col)
    rows = scored(docs, model, id_col, text_col)
    return rows.select(id_col, fold(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
