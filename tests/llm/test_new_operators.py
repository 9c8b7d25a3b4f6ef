"""Hard negatives, divergence of sources and languages of texts, against plain versions."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchgrid.llm import divergence, hard_negatives as hn, language_crf as crf

from . import brute

SCHEMA = "vec_id long, embedding array<float>, label int, score long"


def plain_negatives(rows, low=50, high=95):
    known = {}
    for i, v, label, _ in rows:
        if None in (i, v, label) or any(x is None or not np.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        known[i] = min(known.get(i, (label, v)), (label, v))
    ints = {i: (label, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, (label, v) in known.items()}
    out = []
    for a in (i for i in ints if i % 50 == 0):
        score = {c: sum(x * y for x, y in zip(ints[a][1], v)) for c, (_, v) in ints.items() if c != a}
        best = sorted(score, key=lambda c: (-score[c], c))
        for p in [c for c in best if ints[c][0] == ints[a][0]][:5]:
            fits = [c for c in best if ints[c][0] != ints[a][0] and low * score[p] <= 100 * score[c] <= high * score[p]]
            out += [(a, p, r + 1, c, score[p], score[c]) for r, c in enumerate(fits[:3])]
    return sorted(out)


def mined(spark, rows, **more):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = hn.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3), label, F.col("id") % 50 == 0, **more)
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("scale", [1.0, 200_000.0])
def test_hard_negatives(spark, monkeypatch, scale):
    monkeypatch.setattr(hn, "PIECE", 500)
    rng = np.random.default_rng(3)
    vectors = np.float32(rng.normal(0.4, 0.3, (400, 12)) * scale)
    vectors[40:90] = vectors[40]  # copies: ties of scores
    rows = [(int(i), [float(x) for x in v], int(rng.integers(0, 4)), 7) for i, v in enumerate(vectors)]
    rows += rows[:30]  # repeated rows
    rows += [(None, [1.0] * 12, 1, 0), (1000, None, 1, 0), (1050, [1.0] * 12, None, 0), (1100, [1.0, None], 1, 0), (1150, [float("nan")], 1, 0), (1200, [float("inf")], 1, 0)]
    rows += [(1250, [0.5, 0.25], 1, 0), (1300, [], 2, 0)]  # short vectors end in zeros
    want = plain_negatives(rows)
    assert len(want) > 50 and mined(spark, rows) == want
    assert mined(spark, rows, block_bytes=2 * 12 * 8) == want  # several blocks


def test_hard_negatives_of_few_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 0, 0), (2, [1.0], 1, 0)]) == []  # no anchor
    assert mined(spark, [(50, [1.0], 0, 0)]) == []
    with pytest.raises(ValueError):
        mined(spark, [(50, [3e30], 0, 0)])


DOCS = "doc_id long, text string, lang string, source string, n long, term string"


def plain_divergence(rows, least=3, top=200):
    terms, docs, groups = Counter(), defaultdict(set), set()
    for i, (_, text, lang, source, *_) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", brute.lower(text or "")):
            terms[lang, source, t] += 1
            docs[lang, t].add(i)
    kept = {k for k, d in docs.items() if len(d) >= least}
    prob = lambda n, total: 1 + 10**9 * (n + 1) // total
    value = lambda p, q: (p - q) ** 2 // q
    of_lang, out = {}, set()
    for lang in {lang for lang, _ in groups}:
        own = [t for k, t in kept if k == lang]
        whole = {t: sum(terms[lang, s, t] for k, s in groups if k == lang) for t in own}
        of_lang[lang] = own, whole, sum(whole.values())
    for lang, source in groups:
        own, whole, n_lang = of_lang[lang]
        p = lambda s: {t: prob(terms[lang, s, t], sum(terms[lang, s, u] for u in own) + len(own)) for t in own}  # noqa: B023, E731
        mine = p(source)
        pair = [(sum(value(mine[t], q[t]) for t in own), s) for k, s in groups if k == lang and s != source for q in [p(s)]]
        best = [(v, t) for t in own if terms[lang, source, t] and mine[t] > (q := prob(whole[t], n_lang + len(own))) for v in [value(mine[t], q)]]
        for part, found in (("pair", pair), ("term", best)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out |= {(lang, source, part, item, v, r + 1) for r, (v, item) in enumerate(found) if part == "pair" or r < top}
    return out


def test_source_divergence(spark, monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 200)
    monkeypatch.setattr(divergence, "GATHERED", 50)
    rng = random.Random(5)
    words = ["the", "The", "ÉCOLE", "École", "naïve", "x_y", "a1b", "漢字", "is", "of"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30))), rng.choice(["en", "fr", None]), rng.choice(["s0", "s1", "s2", None]), 1, "t") for i in range(150)]
    rows += [(0, None, "en", "s9", 1, "t"), (0, "", "xx", "s1", 1, "t"), (1, "alone", "xx", "s2", 1, "t"), (None, "the \x00 the", None, "s0", 1, None), (2, "the " * 20_000, "en", "s0", 1, "t")]
    rows += rows[:20]
    got = divergence.source_divergence(spark.createDataFrame(rows, DOCS).repartition(3), top=6)
    want = plain_divergence(rows, top=6)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert divergence.source_divergence(spark.createDataFrame([], DOCS)).count() == 0


def plain_marginals(scores, starts, trans, first):
    out, n = np.zeros_like(scores), len(scores)
    at = [*np.flatnonzero(starts), n]
    for lo, hi in zip(at, at[1:], strict=False):
        f, b = [np.exp(first + scores[lo])], [np.ones(scores.shape[1])]
        for i in range(lo + 1, hi):
            f.append(f[-1] @ np.exp(trans) * np.exp(scores[i]))
            b.append(np.exp(trans) @ (np.exp(scores[hi + lo - i]) * b[-1]))
        both = np.array(f) * np.array(b[::-1])
        out[lo:hi] = both / both.sum(1, keepdims=True)
    return out


@pytest.mark.parametrize("n", [1, 5, 64, 300])
def test_marginals_over_blocks_are_those_of_each_text(n):
    r = np.random.default_rng(n)
    scores, trans, first = r.normal(0, 2, (n, 3)), r.normal(0, 1, (3, 3)), r.normal(0, 1, 3)
    starts = r.random(n) < 0.1
    starts[0] = True
    want = plain_marginals(scores, starts, trans, first)
    for block in (1, 7, 64):
        assert np.allclose(crf.marginals(scores, starts, trans, first, block), want, atol=1e-9)


def test_features_of_a_word():
    raw = np.frombuffer(b" abcd ef ", np.uint8)
    slots, owners = crf.features(raw, np.array([1, 6]), np.array([4, 2]))
    assert np.bincount(owners).tolist() == [5 + 4 + 4, 3 + 2]  # ends included; affixes of 3 and 4 bytes
    again, _ = crf.features(np.frombuffer(b"xx abcd", np.uint8), np.array([3]), np.array([4]))
    assert sorted(again) == sorted(slots[owners == 0])


TONGUES = {"aa": "the and thing over erly tion", "bb": "élan qué façon leur oeil aux", "cc": "ung sch über keit auf der"}


def text_in(lang, rng, n):
    stems = TONGUES[lang].split()
    return " ".join(rng.choice(stems) + rng.choice(["", *stems]) for _ in range(n))


def test_languages(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, text_in(lang, rng, rng.randint(8, 60)), lang, "s", 1, "t") for i in range(240) for lang in [rng.choice(list(TONGUES))]]
    rows += [(900, None, "aa", "s", 1, "t"), (901, "", "aa", "s", 1, "t"), (902, "12 -- € ½ 🙂", "bb", "s", 1, "t"), (903, "漢字", "bb", "s", 1, "t"), (904, text_in("bb", rng, 30), None, "s", 1, "t")]
    rows += [(None, text_in("cc", rng, 30), "cc", "s", 1, "t"), (905, text_in("aa", rng, 60) + " " + text_in("bb", rng, 20), "cc", "s", 1, "t"), (906, text_in("cc", rng, 20_000), "cc", "s", 1, "t"), (5, rows[5][1], rows[5][2], "s", 1, "t")]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    want = {r[0]: r[2] for r in rows}
    want |= {904: "bb", 905: "aa"} | dict.fromkeys([900, 901, 902], "und")
    got = crf.languages(docs).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "held_out", "lang_pred", "score"}
    for r in got:
        assert r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and (r["score"] == 0) == (r["lang_pred"] == "und")
        assert r["lang_pred"] in ("aa", "bb", "cc") if r["doc_id"] == 903 else r["lang_pred"] == want[r["doc_id"]], r
    before = {r["doc_id"]: r["lang_pred"] for r in got}
    monkeypatch.setattr(crf, "PIECE", 4000)  # parts of texts, whose marginals add up
    field = crf.train(docs)
    assert {r["doc_id"]: r["lang_pred"] for r in crf.predicted(docs, field).collect()} == before
    # words of a code-switched text
    raw = crf._BYTES[np.frombuffer((text_in("aa", rng, 15) + " " + text_in("cc", rng, 15)).encode(), np.uint8)]
    hashes, starts, lengths = crf._words(raw)
    own = crf.marginals(field.emissions(hashes, *crf.features(raw, starts, lengths)), np.arange(30) == 0, field.w["move"], field.w["first"]).argmax(1)
    assert (own == np.repeat([0, 2], 15)).mean() > 0.9


def test_languages_without_anything_to_learn(spark):
    empty = crf.languages(spark.createDataFrame([], DOCS))
    assert empty.count() == 0
    alone = crf.languages(spark.createDataFrame([(1, "some words", None, "s", 1, "t"), (2, "more", "xx", "s", 1, "t")], DOCS).where("doc_id = 1"))
    assert [tuple(r) for r in alone.collect()] == [(1, False, "und", 0.0)]
    one = crf.languages(spark.createDataFrame([(1, "some words", "xx", "s", 1, "t"), (2, "more", None, "s", 1, "t")], DOCS))
    assert {(r["lang_pred"], r["score"]) for r in one.collect()} == {("xx", 1.0)}
