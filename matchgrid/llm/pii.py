"""Personal data: patterns, and a character-level bidirectional LSTM with CRF transitions.

The patterns give the base spans. The model, trained in numpy from labelled
spans, finds more of the same kinds in other notations. It decodes overlapping
windows; each position takes the tag of the window whose middle is nearest, and
spans are read from the tags of the whole text. What no span of a kind can lack
(see _candidates) tells which windows can matter; others aren't decoded.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

KINDS = ("email", "ip", "card", "phone")
#: Characters in a window, between the starts of neighbouring windows, and on either side of those that a window decides.
WINDOW, STRIDE = 96, 48
MARGIN = (WINDOW - STRIDE) // 2
#: Characters in a span of the model's, at most.
LONGEST = 64
#: Words of the corpus at most that surround the training spans, and texts, about, that they are taken from.
MAX_CONTEXT_WORDS, CONTEXT_TEXTS = 3000, 400
HIDDEN = 20

_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL, _DOMAIN = re.compile(r"[A-Za-z0-9._%+-]"), re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_SIGNAL = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _emails(text: str):
    """Each @ with the longest local part before it that no earlier match holds."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans, sorted; offsets count code points."""
    out = [(s, 0, e) for s, e in _emails(text)]
    if _SIGNAL.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            if 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return sorted(out)


# The model ------------------------------------------------------------------

_SIGNS = "@.-()+ %_:/=\"',;#[]<>|\n"
_CODES = {c: i for i, c in enumerate(_SIGNS)}
_CODES |= {c: len(_SIGNS) for c in "0123456789"} | {chr(97 + i): len(_SIGNS) + 1 + i for i in range(26)} | {chr(65 + i): len(_SIGNS) + 27 + i for i in range(26)}
_OTHER = len(_SIGNS) + 53
SYMBOLS = _OTHER + 2  # the last pads windows
TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind


def codes(text: str) -> np.ndarray:
    return np.array([_CODES.get(c, _OTHER) for c in text], np.int64)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lse(x, axis):
    top = x.max(axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)


class Tagger:
    """Two LSTMs, one for each direction, a linear layer and a CRF over tags."""

    def __init__(self, hidden: int = HIDDEN, seed: int = 11):
        r = np.random.default_rng(seed)
        self.h = hidden
        # Weights of both directions side by side; columns are gates: in, forget, out, new.
        self.w = {"x": r.normal(0, 0.3, (2, SYMBOLS, 4 * hidden)), "h": r.normal(0, 1 / np.sqrt(hidden), (2, hidden, 4 * hidden))}
        self.w["x"][:, :, hidden : 2 * hidden] += 1  # gates start open
        self.w |= {"o": r.normal(0, 0.3, (2 * hidden, TAGS)), "c": np.zeros(TAGS), "t": np.zeros((TAGS, TAGS))}
        self.w = {k: w.astype(np.float32) for k, w in self.w.items()}
        self.bars = np.zeros((TAGS, TAGS), np.float32)
        for b in range(TAGS):
            if b and b % 2 == 0:  # an inside tag follows its begin or itself
                self.bars[[a for a in range(TAGS) if a not in (b - 1, b)], b] = -1e4
        self.first = np.array([-1e4 if b and b % 2 == 0 else 0.0 for b in range(TAGS)], np.float32)

    def emissions(self, x, kept: list | None = None):
        """Scores (window, place, tag), and the states of both directions; steps are appended to kept."""
        kind = self.w["x"].dtype
        (n, t), h = x.shape, self.h
        half = np.repeat(np.array([0.5, 1], kind), [3 * h, h])  # sigmoid(z) = (1 + tanh(z / 2)) / 2
        both = np.stack([x, x[:, ::-1]]).transpose(2, 0, 1)
        inputs, hidden = self.w["x"] * half, self.w["h"] * half
        state, c, out = np.zeros((2, n, h), kind), np.zeros((2, n, h), kind), np.empty((2, n, t, h), kind)
        for k in range(t):
            z = state @ hidden
            z[0] += inputs[0][both[k, 0]]
            z[1] += inputs[1][both[k, 1]]
            np.tanh(z, out=z)
            z[:, :, : 3 * h] += 1
            z[:, :, : 3 * h] *= kind.type(0.5)
            i, f, o, g = (z[:, :, j * h : (j + 1) * h] for j in range(4))
            before, c = (state, c), f * c + i * g
            tc = np.tanh(c)
            state = o * tc
            out[:, :, k] = state
            if kept is not None:
                kept.append((*before, i, f, o, g, tc))
        states = np.concatenate([out[0], out[1][:, ::-1]], 2)
        return states @ self.w["o"] + self.w["c"], states

    def _back(self, x, dstates, kept, grads):
        h, (n, t) = self.h, x.shape
        both = np.stack([x, x[:, ::-1]])
        dout = np.stack([dstates[:, :, :h], dstates[:, ::-1, h:]])
        dh, dc = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        dz = np.empty((2, n, t, 4 * h), np.float32)
        for k in range(t - 1, -1, -1):
            h0, c0, i, f, o, g, tc = kept[k]
            dh = dh + dout[:, :, k]
            dc = dc + dh * o * (1 - tc * tc)
            own = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 2)
            dz[:, :, k] = own
            grads["h"] += h0.transpose(0, 2, 1) @ own
            dh, dc = own @ self.w["h"].transpose(0, 2, 1), dc * f
        for d in range(2):
            flat, order = both[d].ravel(), np.argsort(both[d].ravel(), kind="stable")
            first = np.flatnonzero(np.diff(flat[order], prepend=-1))
            grads["x"][d][flat[order][first]] += np.add.reduceat(dz[d].reshape(-1, 4 * h)[order], first)

    def loss(self, x, y):
        """Negative log-likelihood of tags y, and the gradients of all weights."""
        kept: list = []
        em, states = self.emissions(x, kept)
        n, t, _ = em.shape
        a = self.w["t"] + self.bars
        alpha, beta = np.empty_like(em), np.zeros_like(em)
        alpha[:, 0] = em[:, 0] + self.first
        for k in range(1, t):
            alpha[:, k] = em[:, k] + _lse(alpha[:, k - 1, :, None] + a, 1)
        for k in range(t - 2, -1, -1):
            beta[:, k] = _lse(a + (em[:, k + 1] + beta[:, k + 1])[:, None, :], 2)
        z = _lse(alpha[:, -1], 1)
        de = np.exp(alpha + beta - z[:, None, None])
        pair = np.exp(alpha[:, :-1, :, None] + a + (em[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]).sum((0, 1))
        rows, cols = np.arange(n)[:, None], np.arange(t)
        gold = em[rows, cols, y].sum() + a[y[:, :-1], y[:, 1:]].sum()
        de[rows, cols, y] -= 1
        np.add.at(pair, (y[:, :-1], y[:, 1:]), -1.0)
        grads = {k: np.zeros_like(v) for k, v in self.w.items()}
        grads["t"], grads["o"], grads["c"] = pair, states.reshape(-1, 2 * self.h).T @ de.reshape(-1, TAGS), de.sum((0, 1))
        self._back(x, de @ self.w["o"].T, kept, grads)
        return (z.sum() - gold) / n, {k: g / n for k, g in grads.items()}

    def fit(self, x, y, steps: int = 550, batch: int = 64, rate: float = 0.02, seed: int = 12) -> Tagger:
        r, m, v = np.random.default_rng(seed), {k: np.float32(0) for k in self.w}, {k: np.float32(0) for k in self.w}
        for step in range(1, steps + 1):
            own = r.integers(0, len(x), batch)
            _, grads = self.loss(x[own], y[own])
            norm = np.sqrt(sum((g**2).sum() for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 5 / (norm + 1e-9))
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g**2
                self.w[k] = (self.w[k] - rate * (1 - step / (steps + 1)) * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def decode(self, x):
        """The best tags of each window (Viterbi)."""
        em, _ = self.emissions(x)
        n, t, _ = em.shape
        # Tags lead where they do, so that a step is a maximum over the last axis.
        a, best, back = (self.w["t"] + self.bars).T, em[:, 0] + self.first, np.empty((t, n, TAGS), np.int8)
        for k in range(1, t):
            score = best[:, None, :] + a
            back[k] = score.argmax(2)
            best = score.max(2) + em[:, k]
        tags, rows = np.empty((n, t), np.int64), np.arange(n)
        tags[:, -1] = best.argmax(1)
        for k in range(t - 1, 0, -1):
            tags[:, k - 1] = back[k, rows, tags[:, k]]
        return tags


#: What is in every address: a sign for "at", and after it a dot before a letter, or the word.
_AT = re.compile(r"(?:@|\b[aA][tT]\b)[^@]{0,40}?(?:\.[A-Za-z]|\b[dD][oO][tT]\b)")
#: What of a span is the address: two parts without spaces around the sign.
_ADDRESS = re.compile(r"[^\s@,;:]+\s?[\[(]?\s?(?:@|\b[aA][tT]\b)\s?[\])]?\s?[^\s@,;:]+(?:\s[dD][oO][tT]\s[^\s@,;:]+)*")
#: And in every other span: four digits with at most four other characters, no letters, between two.
_FOUR = re.compile(r"[0-9](?:[^0-9A-Za-z]{0,4}[0-9]){3}")
#: Characters that no span begins or ends with.
_EDGE = " \t\n\r.,;:"
_GAPS = re.compile(r"[0-9](?:[^0-9A-Za-z]{0,4}[0-9])+")


def _candidates(text: str) -> tuple[list[int], list[int]]:
    """Starts of what each of the model's spans that count has: first those in addresses, then those in the others."""
    ats = [m.start() for m in re.finditer(r"@|\b[aA][tT]\b", text) if _AT.match(text, m.start())]
    fours, m = [], _FOUR.search(text)
    while m:
        fours.append(m.start())
        m = _FOUR.search(text, m.start() + 1)
    return ats, fours


def _plausible(kind: int, text: str, s: int, e: int, ats: list[int]):
    """What of a span has all that any of its kind has, whatever its notation: (start, kind, end)."""
    if e - s > LONGEST:
        return
    if kind == 0:
        if any(_AT.match(text, at).end() <= e for at in ats[bisect_left(ats, s) : bisect_left(ats, e)]):
            for m in _ADDRESS.finditer(text, s, e):
                own = m.group().rstrip(_EDGE)
                if len(own) >= 6 and "." in own[-8:]:
                    yield m.start(), 0, m.start() + len(own)
        return
    own = text[s:e]
    d = len(_digits(own))
    if not own.strip("0123456789" + ("", ".:", " .-", "+() .-")[kind]) and (m := _GAPS.search(own)) and len(_digits(m.group())) == d:
        if 4 <= d <= 12 and sum(c in ".:" for c in own) == 3 if kind == 1 else 14 <= d <= 19 and luhn(_digits(own)) if kind == 2 else 10 <= d <= 15:
            yield s, kind, e


def _owners(text: str, starts: list[int]) -> list[int]:
    """Numbers of the windows that decide positions within LONGEST characters of the starts."""
    last = max(0, -(-(len(text) - MARGIN) // STRIDE) - 1)
    own = lambda p: min(last, max(0, (p - MARGIN) // STRIDE))
    out: list[int] = []
    for p in starts:
        out += range(max(own(p - LONGEST), out[-1] + 1 if out else 0), own(p + LONGEST) + 1)
    return out


def found_spans(texts: list[str], model: Tagger, every: bool = False) -> list[list[tuple[int, int, int]]]:
    """All spans of each text: the base ones and the model's that overlap none of them.

    Only windows near candidates are decoded, or all: the spans are the same.
    """
    signs = [_candidates(t) for t in texts]
    where = [(n, k) for n, t in enumerate(texts) for k in _owners(t, list(range(0, len(t), LONGEST)) if every else sorted(sum(signs[n], [])))]
    tags = np.full((len(where), WINDOW), -1, np.int8)
    for lo in range(0, len(where), 512):
        x = np.full((len(where[lo : lo + 512]), WINDOW), SYMBOLS - 1)
        for i, (n, k) in enumerate(where[lo : lo + 512]):
            own = codes(texts[n][k * STRIDE : k * STRIDE + WINDOW])
            x[i, : len(own)] = own
        tags[lo : lo + 512] = model.decode(x)
    mine: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    at = 0
    while at < len(where):  # windows without a gap between them, as one sequence
        n, window = where[at]
        size = 1
        while at + size < len(where) and where[at + size] == (n, window + size):
            size += 1
        middle = tags[at : at + size, MARGIN : MARGIN + STRIDE].ravel()
        row = middle if window else np.concatenate([tags[at, :MARGIN], middle])
        first = window * STRIDE + MARGIN if window else 0
        row = row[: len(texts[n]) - first]
        kind = (row.astype(np.int64) + 1) // 2  # 0: outside
        cut = np.flatnonzero((np.diff(kind, prepend=0) != 0) | (row % 2 == 1))
        for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(row)]):
            if k := int(kind[s]):
                own = texts[n][first + s : first + e]
                s += len(own) - len(own.lstrip(_EDGE))
                mine[n].append((first + s, k - 1, first + s + len(own.strip(_EDGE))))
        at += size
    out = []
    for text, spans, (ats, _) in zip(texts, mine, signs, strict=True):
        base = base_spans(text)
        extra = sorted((x for s, k, e in spans for x in _plausible(k, text, s, e, ats)), key=lambda x: (x[0] - x[2], x))
        if extra:
            taken: list[tuple[int, int]] = []  # apart from each other, in order
            for s, _, e in base:
                if taken and s < taken[-1][1]:
                    taken[-1] = taken[-1][0], max(e, taken[-1][1])
                else:
                    taken.append((s, e))
            for s, k, e in extra:  # longer ones first
                i = bisect_left(taken, (e,))
                if i == 0 or taken[i - 1][1] <= s:
                    taken.insert(i, (s, e))
                    base.append((s, k, e))
        out.append(sorted(base))
    return out


def labelled_texts(words: list[str], n: int, seed: int = 13, size: int = WINDOW + 20) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Texts among these words, with spans of each kind in many notations, and with look-alikes of none."""
    r = random.Random(seed)
    words = words or ["lorem", "ipsum", "dolor", "sit", "amet"]
    word = lambda: r.choice(words)
    low = lambda: re.sub("[^a-z]", "", word().lower()) or "a"
    num = lambda k: "".join(r.choices("0123456789", k=k))
    pick = lambda *x: r.choice(x)

    def card() -> str:
        d = num(r.randrange(13, 19))
        d += next(c for c in "0123456789" if luhn(d + c))
        s = pick("", "", " ", "-", ".")
        return s.join(d[i : i + 4] for i in range(0, len(d), 4))

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return pick(f"+{num(1)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{num(2)} {a} {b} {c}", f"00{num(2)} {a} {b} {c}", f"({a}) {b} {c}")

    def email() -> str:
        at, dot = pick("@", "@", " @ ", "[@]", " at ", " at ", "[at]", " (at) "), "."
        return f"{low()}{pick('', '.', '_')}{pick(low(), num(2))}{at}{low()}{pick('', num(1))}{dot}{pick('com', 'org', 'net', 'example.com', 'de', 'co.uk')}"

    def ip() -> str:
        return pick(".", ".", ":").join(str(r.randrange(256)) for _ in range(4))

    def other() -> str:
        return pick(f"{num(4)}-{num(2)}-{num(2)}", f"{num(2)}:{num(2)}:{num(2)}", f"${num(3)}.{num(2)}", f"{num(1)}.{num(1)}.{num(1)}", num(r.randrange(1, 13)), f"@{low()}", f"password={''.join(pick(*'0123456789abcdef') for _ in range(18))}", f'token = "{"".join(pick(*"0123456789abcdef") for _ in range(40))}"', f"AKIA{num(6)}", f"{num(3)},{num(3)}", f"{num(2)}%", f"pp. {num(3)}-{num(3)}", f"{num(3)} {num(4)}", f"{low()} at {low()}", f"{num(1)}.{num(2)}.{num(4)}")

    makers, out = (email, ip, card, phone), []
    for _ in range(n):
        text, spans = "".join(word() + " " for _ in range(r.randrange(5))), []
        while len(text) < size:
            u = r.random()
            if u < 0.25:
                k = r.randrange(4)
                own = makers[k]()
                spans.append((len(text), k, len(text) + len(own)))
                text += own
            else:
                text += other() if u < 0.45 else word()
            text += pick(" ", " ", " ", ", ", ". ", "\n")
        out.append((text, spans))
    return out


def labelled_windows(words: list[str], n: int = 8000, seed: int = 13, size: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Windows of labelled texts, from anywhere near their beginning, and their tags."""
    r = random.Random(seed + 1)
    x, y = np.full((n, size), SYMBOLS - 1), np.zeros((n, size), np.int64)
    for i, (text, spans) in enumerate(labelled_texts(words, n, seed, size + 20)):
        shift = r.randrange(12)
        window = text[shift : shift + size]
        x[i, : len(window)] = codes(window)
        for s, k, e in spans:
            s, e = max(0, s - shift), min(size, e - shift)
            if s < e:
                y[i, s:e], y[i, s] = 2 * k + 2, 2 * k + 1
    return x, y


def context_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[str]:
    """At most MAX_CONTEXT_WORDS words of letters, those with the least hashes in about CONTEXT_TEXTS texts."""
    rows = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(id_col).alias("h"), F.col(text_col).alias("t"))
    some = rows.where(F.pmod("h", F.lit(max(1, rows.count() // CONTEXT_TEXTS))) == 0)
    words = some.select(F.explode(F.split("t", r"\s+")).alias("w")).where(F.col("w").rlike(r"^\p{L}{1,15}$")).distinct()
    return [r["w"] for r in words.orderBy(F.xxhash64("w"), "w").limit(MAX_CONTEXT_WORDS).collect()]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Tagger:
    """A tagger fitted to labelled spans among words of the corpus (see context_words)."""
    return Tagger().fit(*labelled_windows(context_words(docs, id_col, text_col)))


def _listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def personal_data(docs: DataFrame, model: Tagger | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of personal data in every whole text.

    Returns id, n_email, n_ip, n_card and n_phone (base spans), base_sha256 (of
    the base spans, "kind:start:end", by start, then kind, joined by commas) and
    spans (base and model spans, written likewise). A null text counts as
    empty and has no spans; repeated rows and null ids stay, a row each; other
    columns are left out; an empty table gives no rows. The model is trained on
    the texts' words if none is given.
    """
    model = model or train(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    def work(batches):
        model = shared.value
        for batch in batches:
            counts, digests, spans = [[] for _ in KINDS], [], []
            texts = batch.column(1).to_pylist()
            for lo in range(0, len(texts), 256):
                for text, every in zip(texts[lo : lo + 256], found_spans(texts[lo : lo + 256], model), strict=True):
                    base = base_spans(text) if every else []
                    for k, own in enumerate(counts):
                        own.append(sum(b[1] == k for b in base))
                    digests.append(hashlib.sha256(_listed(base).encode()).hexdigest())
                    spans.append(_listed(every))
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = [id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    counted = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInArrow(work, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, {counted}, base_sha256 string, spans string")
