"""Languages of texts: a linear-chain conditional random field labels every word.

A word is a run of ASCII letters (A-Z lower-cased) and of bytes outside ASCII. Its
features are hashed byte n-grams, affixes, and what a lexicon says of it: for each
language, how likely the word is there rather than elsewhere, in LEVELS steps. The
lexicon has the words that make up at least LEXICON_SHARE of a language, so at most
1 / LEXICON_SHARE words for each; it is counted over all texts to learn from.

Emissions and transitions are fitted together, in numpy on the driver, to the
likelihood of code-switched sequences: runs of words from a bounded sample of texts
(MAX_TRAINING_ROWS rows with RUNS runs each), one behind the other in drawn order, so
that languages change in the middle. Scoring runs forward-backward over every word of
every text; a text's language is the one with the largest sum of marginals, its score
that language's share.

All texts of a piece form one chain whose transitions forget what came before at each
text's start. The chain is cut into blocks: products of their transition matrices give
each block its incoming messages, and all blocks then go through their words side by
side. That is exact, and no loop is as long as a text.

Rules: null texts and texts without a letter are ``und`` with score 0, and so is
everything if there's nothing to learn from. A text of more than PIECE bytes is decoded
in parts of that size, whose marginals add up. Ties go to the language that comes
first. A null id counts as empty text for the fold; repeated rows each stay; null
languages aren't learned; other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import hashed_words, written

MAX_TRAINING_ROWS, RUNS = 2000, 8
LEXICON_SHARE, LEVELS = 1 / 20_000, 6
FEATURES = 1 << 16
#: Bytes of text decoded at once; words in a block of the chain.
PIECE, BLOCK = 4 << 20, 64

_BYTES = np.full(256, 0x20, np.uint8)
_BYTES[0x61:0x7B] = np.arange(0x61, 0x7B)
_BYTES[0x41:0x5B] = np.arange(0x61, 0x7B)
_BYTES[0x80:] = np.arange(0x80, 0x100)


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and length of each word of bytes that went through _BYTES."""
    hashes, starts = hashed_words(raw, lower=False)
    inside = np.concatenate([raw != 0x20, [False]])
    return hashes, starts, np.flatnonzero(inside[:-1] & ~inside[1:]) + 1 - starts


def _slots(code: np.ndarray, kind: int) -> np.ndarray:
    return ((code * np.uint64(0x9E3779B97F4A7C15) + np.uint64(kind * 0x632BE59BD9B4E019 % 2**64)) >> np.uint64(48)).astype(np.int64) & (FEATURES - 1)


def features(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot, word) of every feature of words: n-grams of two and three bytes with the word's ends, affixes of three and four."""
    sizes = lengths + 2
    first = np.cumsum(sizes) - sizes
    word = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(word)) - first[word]
    own = (at > 0) & (at <= lengths[word])
    chars = np.full(len(word) + 2, 0x20, np.uint64)
    chars[:-2][own] = raw[(starts[word] + at - 1)[own]]
    two, three = at <= lengths[word], at < lengths[word]
    a, b, c = chars[:-2], chars[1:-1], chars[2:]
    slots, owners = [_slots((a << np.uint64(8) | b)[two], 1), _slots((a << np.uint64(16) | b << np.uint64(8) | c)[three], 2)], [word[two], word[three]]
    for n in (3, 4):
        long = np.flatnonzero(lengths >= n)
        for kind, begin in ((2 * n, starts[long]), (2 * n + 1, starts[long] + lengths[long] - n)):
            code = np.zeros(len(long), np.uint64)
            for k in range(n):
                code = code << np.uint64(8) | raw[begin + k]
            slots.append(_slots(code, kind))
            owners.append(long)
    return np.concatenate(slots), np.concatenate(owners)


def marginals(scores: np.ndarray, starts: np.ndarray, transitions: np.ndarray, first: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Label marginals of words (rows of scores) of sequences that begin where ``starts`` is true, the first word's included."""
    n, labels = scores.shape
    blocks = -(-n // block)
    e, begins = np.ones((blocks * block, labels)), np.ones(blocks * block, bool)  # what fills up the last block is apart
    e[:n], begins[:n] = np.exp(scores - scores.max(1, keepdims=True)), starts
    e, begins = e.reshape(blocks, block, labels), begins.reshape(blocks, block)
    at = [np.flatnonzero(begins[:, i]) for i in range(block)]
    k, s = np.exp(transitions - transitions.max()), np.exp(first - first.max())
    through = np.broadcast_to(np.eye(labels), (blocks, labels, labels))
    for i in range(block):
        moved = (through.reshape(-1, labels) @ k).reshape(through.shape)
        moved[at[i]] = through[at[i]].sum(2)[:, :, None] * s
        through = moved * e[:, i, None, :]
        through = through / through.sum((1, 2), keepdims=True)
    left, right = np.empty((blocks, labels)), np.empty((blocks, labels))
    v = np.ones(labels)
    for b in range(blocks):
        left[b] = v
        v = v @ through[b]
        v = v / v.sum()
    v = np.ones(labels)
    for b in range(blocks - 1, -1, -1):
        right[b] = v
        v = through[b] @ v
        v = v / v.sum()
    out = np.empty((blocks, block, labels))
    for i in range(block):
        moved = left @ k
        moved[at[i]] = s
        left = moved * e[:, i]
        left /= left.sum(1, keepdims=True)
        out[:, i] = left
    for i in range(block - 1, -1, -1):
        both = out[:, i] * right
        out[:, i] = both / both.sum(1, keepdims=True)
        right = (e[:, i] * right) @ k.T
        right[at[i]] = 1.0
        right /= right.sum(1, keepdims=True)
    return out.reshape(-1, labels)[:n]


class Lexicon:
    """Hashes of words (sorted), and for each language the level of each: 0 where it has none of the word."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, totals: np.ndarray):
        order = np.argsort(hashes)
        rates = counts[order] / np.maximum(totals, 1)
        share = rates / np.maximum(rates.sum(1, keepdims=True), 1e-300)
        self.hashes = hashes[order]
        self.levels = np.where(share > 0, np.clip(np.digitize(share, np.linspace(0, 1, LEVELS)), 1, LEVELS - 1), 0)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the lexicon, whether it is there)."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes


class LanguageField:
    """The field: weights of hashed features and of lexicon levels for each language, transitions, first labels."""

    def __init__(self, langs: list[str], lexicon: Lexicon):
        n = len(langs)
        self.langs, self.lexicon = langs, lexicon
        self.w = {"ngram": np.zeros((n, FEATURES)), "level": np.zeros((n, n * LEVELS)), "missing": np.zeros(n), "move": np.zeros((n, n)), "first": np.zeros(n)}

    def _level_slots(self, places: np.ndarray) -> np.ndarray:
        return self.lexicon.levels[places] + np.arange(len(self.langs)) * LEVELS

    def emissions(self, hashes: np.ndarray, slots: np.ndarray, owners: np.ndarray) -> np.ndarray:
        out = np.empty((len(hashes), len(self.langs)))
        place, known = self.lexicon.find(hashes)
        levels = self._level_slots(place[known])
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(owners, self.w["ngram"][k][slots], len(hashes))
            out[known, k] += self.w["level"][k][levels].sum(1)
            out[~known, k] += self.w["missing"][k]
        return out

    def fit(self, runs: list[tuple[str, bytes]], length: int = 48, epochs: int = 60, rate: float = 0.1, decay: float = 1e-4, seed: int = 13) -> LanguageField:
        """Maximises the penalised likelihood of sequences made of runs (language, words) in drawn order."""
        number = {lang: k for k, lang in enumerate(self.langs)}
        order = np.random.default_rng(seed).permutation(len(runs))
        parts = [_BYTES[np.frombuffer(runs[i][1] + b" ", np.uint8)] for i in order]
        if not parts or len(self.langs) < 2:
            return self
        raw = np.concatenate(parts)
        hashes, starts, lengths = _words(raw)
        of = np.searchsorted(np.cumsum([len(p) for p in parts]), starts, side="right")
        truth = np.array([number[runs[i][0]] for i in order])[of]
        n = len(hashes) // length * length
        if not n:
            length = n = len(hashes)
        hashes, where, inverse = np.unique(hashes[:n], return_index=True, return_inverse=True)
        slots, owners = features(raw, starts[where], lengths[where])
        place, known = self.lexicon.find(hashes)
        levels = self._level_slots(place[known])
        y = truth[:n].reshape(-1, length)
        sequences, labels = len(y), len(self.langs)
        goal = np.eye(labels)[y]
        moves = np.bincount((y[:, :-1] * labels + y[:, 1:]).ravel(), minlength=labels**2).reshape(labels, labels)
        mean, square = {k: 0.0 for k in self.w}, {k: 0.0 for k in self.w}
        for step in range(1, epochs + 1):
            e = self.emissions(hashes, slots, owners)[inverse].reshape(sequences, length, labels)
            e = np.exp(e - e.max(2, keepdims=True))
            k = np.exp(self.w["move"])
            ahead, back = np.empty_like(e), np.ones_like(e)
            a = np.exp(self.w["first"]) * e[:, 0]
            for t in range(length):
                a = a if t == 0 else (a @ k) * e[:, t]
                a = a / a.sum(1, keepdims=True)
                ahead[:, t] = a
            for t in range(length - 1, 0, -1):
                b = (e[:, t] * back[:, t]) @ k.T
                back[:, t - 1] = b / b.sum(1, keepdims=True)
            gamma = ahead * back
            gamma /= gamma.sum(2, keepdims=True)
            expected = np.zeros((labels, labels))
            for t in range(1, length):
                pair = ahead[:, t - 1, :, None] * k * (e[:, t] * back[:, t])[:, None, :]
                expected += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
            off = (goal - gamma).reshape(-1, labels)
            by_word = np.stack([np.bincount(inverse, off[:, c], len(hashes)) for c in range(labels)], 1) / n
            grad = {
                "ngram": np.stack([np.bincount(slots, by_word[owners, c], FEATURES) for c in range(labels)]),
                "level": np.stack([np.bincount(levels.ravel(), np.repeat(by_word[known, c], labels), labels * LEVELS) for c in range(labels)]),
                "missing": by_word[~known].sum(0),
                "move": (moves - expected) / n,
                "first": (goal[:, 0] - gamma[:, 0]).sum(0) / n,
            }
            for key, g in grad.items():
                g = g - decay / 100 * self.w[key]
                mean[key] = 0.9 * mean[key] + 0.1 * g
                square[key] = 0.99 * square[key] + 0.01 * g**2
                self.w[key] = self.w[key] + rate * (1 - step / (epochs + 1)) * mean[key] / (1 - 0.9**step) / (np.sqrt(square[key] / (1 - 0.99**step)) + 1e-7)
        self.w["ngram"] = self.w["ngram"].astype(np.float32)
        return self

    def totals(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each part of a text: sums of its words' marginals, and whether it has an ASCII letter."""
        sizes = np.array([len(p) + 1 for p in parts])
        begins = np.cumsum(sizes) - sizes
        raw = _BYTES[np.frombuffer(b" ".join(parts) + b" ", np.uint8)]
        letters = np.add.reduceat((raw > 0x20) & (raw < 0x80), begins, dtype=np.int64) > 0
        hashes, starts, lengths = _words(raw)
        sums = np.zeros((len(parts), len(self.langs)))
        if len(hashes) and self.langs:
            part = np.searchsorted(begins, starts, side="right") - 1
            hashes, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            slots, owners = features(raw, starts[where], lengths[where])
            scores = self.emissions(hashes, slots, owners)[inverse]
            own = marginals(scores, np.diff(part, prepend=-1) > 0, self.w["move"], self.w["first"])
            for k in range(len(self.langs)):
                sums[:, k] = np.bincount(part, own[:, k], len(parts))
        return sums, letters


def _parts(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """(rows, parts of their texts), about PIECE bytes at a time."""
    rows, parts, size = [], [], 0
    for i, text in enumerate(texts):
        lo = 0
        while lo < len(text) or lo == 0:
            hi = lo + PIECE
            if hi < len(text):
                cut = text.rfind(b" ", lo + 1, hi)
                hi = cut if cut > 0 else hi
            rows.append(i)
            parts.append(text[lo:hi])
            size += len(parts[-1])
            lo = max(hi, 1)
            if size >= PIECE:
                yield rows, parts
                rows, parts, size = [], [], 0
    if rows:
        yield rows, parts


def _learned(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))


def lexicon_of(rows: DataFrame, langs: list[str], share: float = LEXICON_SHARE) -> Lexicon:
    """The words that are at least ``share`` of a language's, with their counts in each, over all rows (lang, text)."""
    number = {lang: k for k, lang in enumerate(langs)}

    def count(batches):
        for batch in batches:
            lang, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            for own, parts in _parts(texts):
                raw = _BYTES[np.frombuffer(b" ".join(parts) + b" ", np.uint8)]
                hashes, starts, _ = _words(raw)
                sizes = np.array([len(p) + 1 for p in parts])
                part = np.searchsorted(np.cumsum(sizes) - sizes, starts, side="right") - 1
                of = np.array([number[lang[i]] for i in own], np.int32)[part]
                for k in np.unique(of):
                    words, n = np.unique(hashes[of == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(np.full(len(words), k, np.int32)), pa.array(n)], ["word", "k", "n"])

    counted = rows.mapInArrow(count, "word long, k int, n long").groupBy("word").agg(*(F.sum(F.when(F.col("k") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(len(langs))))
    counted = written(counted, "lexicon")
    totals = np.array(counted.agg(*(F.coalesce(F.sum(f"n{k}"), F.lit(0)) for k in range(len(langs)))).first(), np.int64)
    often = F.lit(False)
    for k, n in enumerate(totals.tolist()):
        often = often | (F.col(f"n{k}") >= max(2.0, share * n))
    found = counted.where(often).toArrow()
    counts = np.stack([found.column(f"n{k}").to_numpy() for k in range(len(langs))], 1)
    return Lexicon(found.column("word").to_numpy().view(np.uint64), counts, totals)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """RUNS runs of 4 to 24 words of each text, spread over all of it."""
    for batch in batches:
        out = []
        for text in batch.column(2).cast(pa.binary()).to_pylist():
            r, runs = np.random.default_rng(zlib.crc32(text)), []
            for at in np.sort(r.integers(0, max(1, len(text)), RUNS)):
                words = text[at : at + 400].split(b" ")[1 if at else 0 : 1 + int(r.integers(4, 25))]
                runs.append(b" ".join(words))
            out.append(runs)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.binary()))], ["h", "lang", "runs"])


def train(docs: DataFrame, max_rows: int = MAX_TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageField:
    """A field fitted to the texts and languages of docs.

    The lexicon counts all rows; the weights are fitted to at most max_rows rows,
    those with the least hashes of their ids. Rows with a null language or text
    aren't used.
    """
    rows = _learned(docs, text_col, lang_col)
    langs = sorted((r[0] for r in rows.select("lang").distinct().collect()), key=lambda x: x.encode())
    if not langs:
        return LanguageField([], Lexicon(np.zeros(0, np.uint64), np.zeros((0, 0)), np.zeros(0)))
    lexicon = lexicon_of(rows, langs)
    hashed = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.xxhash64(id_col).alias("h"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    share = max(1, hashed.count() // (2 * max_rows))
    cut = hashed.where(F.pmod("h", F.lit(share)) == 0).mapInArrow(_cut, "h long, lang string, runs array<binary>")
    sample = cut.orderBy("h", "lang", "runs").limit(max_rows).collect()
    return LanguageField(langs, lexicon).fit([(r["lang"], bytes(x)) for r in sample for x in r["runs"]])


def predicted(docs: DataFrame, field: LanguageField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score of every row, from its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(field)  # FEATURES weights and a bounded lexicon for each language
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))

    def work(batches):
        field = shared.value
        langs = np.array([*field.langs, "und"], object)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            sums, letters = np.zeros((len(texts), len(field.langs))), np.zeros(len(texts), bool)
            for own, parts in _parts(texts):
                more, has = field.totals(parts)
                np.add.at(sums, own, more)
                np.logical_or.at(letters, own, has)
            words = sums.sum(1)
            for i in np.flatnonzero(~letters & (words > 0)):  # nothing but what is outside ASCII
                letters[i] = any(c.isalpha() for c in texts[i].decode("utf-8", "replace"))
            some = letters & (words > 0)
            best = np.where(some, sums.argmax(1), len(field.langs)) if len(field.langs) else np.zeros(len(texts), int)
            score = np.zeros(len(texts))
            score[some] = np.minimum(sums[some].max(1) / words[some], 1.0) if some.any() else 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs[best].tolist(), pa.string()), pa.array(score)], [id_col, "lang_pred", "score"])

    return rows.mapInArrow(work, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, lang_pred string, score double")


def fold(col: Column, folds: int, held: int) -> Column:
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % folds == held


def languages(docs: DataFrame, folds: int = 5, held: int = 0, max_rows: int = MAX_TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The language of every row of docs by a field fitted outside the held-out fold: id, held_out, lang_pred, score."""
    out = fold(F.col(id_col), folds, held)
    field = train(docs.where(~out), max_rows, id_col, text_col, lang_col)
    return predicted(docs, field, id_col, text_col).select(id_col, out.alias("held_out"), "lang_pred", "score")
