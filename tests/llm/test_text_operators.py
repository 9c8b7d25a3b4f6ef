"""Operators on texts against plain versions, with the odd cases of every contract."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from matchgrid.llm import decontaminate, graph, line_dedup, near_dup, quality_rules

from . import brute

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, _k1 string, words int"
WORDS = [f"word{i}" for i in range(400)]
LONG = " ".join(WORDS) * 40
ODD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two"), (6, "One TWO"), (7, "one\ntwo\none\ntwo\n\n"), (8, "É é Ünï ١٢ 漢字 🙂 " * 5),
    (9, LONG), (10, LONG + " end"), (11, "a b c d e a b c d e"), (12, "same text of some words that repeats"), (12, "same text of some words that repeats"),
    (13, "same text of some words that repeats"), (None, "same text of some words that repeats"), (14, "x\x1cy \x85 z\xa0w"), (15, "# * $ % & | < >"),
]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", 1) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs():
    rows = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return [(r["doc_id"] + 100, r["text"]) for r in rows]


@pytest.fixture(scope="module")
def near_copies():
    base = [f"tok{i}" for i in range(120)]
    out = []
    for n in range(60):
        own = list(base)
        for j in range(n % 12):
            own[(17 * j + 5 * n) % 120] = f"new{n}_{j}"
        out.append((1000 + n, " ".join(own)))
    return out


def test_quality_rules(spark, docs):
    rows = ODD + docs
    found = quality_rules.quality_verdicts(table(spark, rows)).collect()
    assert len(found) == len(rows)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((str(r["doc_id"]), *(r[n] for n in names)) for r in found) == sorted((str(i), *brute.base_rules(t)) for i, t in rows)
    assert not any(r["kept"] for r in found if r["base_failed"])
    assert quality_rules.quality_verdicts(table(spark, [])).count() == 0


def test_quality_rules_keep_columns(spark):
    out = quality_rules.quality_rules(table(spark, ODD).withColumn("quality", F.lit(1)))
    assert out.columns == ["doc_id", "text", "lang", "_k1", "words", "quality", "_quality"] and out.count() == len(ODD)


def test_near_duplicates(spark, docs, near_copies):
    rows = [x for x in ODD if x[0] is not None] + docs + near_copies
    for k in (4, 5):
        found = near_dup.near_duplicates(table(spark, rows), k=k).collect()
        expected = brute.near(dict(rows).items(), k)
        assert len(found) == len(rows)
        for r in found:
            assert (r["n_shingles"], r["component_id"]) == expected[r["doc_id"]], r
            assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_near_duplicates_without_ids_or_rows(spark):
    text = "a group of copies without any id in the table at all"
    found = near_dup.near_duplicates(table(spark, [(None, text), (None, text), (3, "alone here")])).collect()
    assert sorted((str(r["component_id"]), r["kept"]) for r in found) == [("3", True), ("None", True), ("None", True)]
    mixed = near_dup.near_duplicates(table(spark, [(None, text), (7, text)])).collect()
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in mixed} == {(None, 7, False), (7, 7, True)}
    assert near_dup.near_duplicates(table(spark, [])).count() == 0


def test_first_of_each_group(spark, near_copies):
    out = near_dup.first_of_each_group(table(spark, near_copies + [(1, None), (2, "")]))
    groups = {c for _, c in brute.near(near_copies, 5).values()}
    assert {r["doc_id"] for r in out.collect()} == groups | {1, 2} and out.columns == ["doc_id", "text", "lang", "_k1", "words"]


def test_sketch_never_refuses_similar_sets(near_copies):
    import numpy as np

    sets = [near_dup.shingle_set(t, 4) for _, t in near_copies]
    for a in sets:
        for b in sets:
            n = len(np.intersect1d(a, b))
            if 100 * n >= 80 * (len(a) + len(b) - n):
                x, y = near_dup.odd_sketch(a)[1], near_dup.odd_sketch(b)[1]
                assert sum(bin(int(v)).count("1") for v in (x ^ y).view(np.uint64)) <= (len(a) + len(b)) / 9


def test_near_duplicates_in_a_large_band(spark):
    """Documents of one template share bands though they aren't similar; only a few of them are."""
    import random

    r = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    base = r.choices(words, k=70)
    rows = []
    for i in range(60):
        own = base + r.choices(words, k=40)
        rows.append((i, " ".join(own)))
        if i % 6 == 0:
            own[3] = "changed"
            rows.append((1000 - i, " ".join(own)))
    found = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near_dup.near_duplicates(table(spark, rows), k=4).collect()}
    expected = brute.near(rows, 4)
    assert found == expected and len(set(c for _, c in expected.values())) < len(rows)


def test_contamination(spark, docs):
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    items += [(900, None), (901, ""), (902, "Só lonely"), (903, "one"), (904, "one"), (905, " ".join(WORDS[:20]))]
    rows = [x for x in dict(ODD).items() if x[0] is not None] + docs
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("k1", F.lit(1))
    found = decontaminate.contamination(table(spark, rows), bench).collect()
    expected = brute.contamination(rows, items)
    assert len(found) == len(rows)
    for r in found:
        assert tuple(r[c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) == expected[r["doc_id"]], r["doc_id"]
    left = decontaminate.decontaminated(table(spark, rows), bench)
    assert {r["doc_id"] for r in left.collect()} == {i for i, x in expected.items() if not x[4]} and left.columns == ["doc_id", "text", "lang", "_k1", "words"]


def test_contamination_without_items_or_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    found = decontaminate.contamination(table(spark, ODD), none).collect()
    assert len(found) == len(ODD) and not any(r["n_hit"] or r["contaminated"] for r in found)
    some = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert decontaminate.contamination(table(spark, []), some).count() == 0


def test_line_dedup(spark, docs):
    line = "the quick brown fox jumps over the lazy dog near the river bank on a sunny day in may while birds sing in the old trees"
    rows = [(1, f"{line}\nfirst only\n\n"), (2, f"start\n{line.upper()}!\n{line}"), (3, None), (4, ""), (5, f"{line}\n{line}"), (6, "!!!\n!!!"), (7, "a\nb\na")]
    out = {r["doc_id"]: r for r in line_dedup.without_repeated_lines(table(spark, rows)).collect()}
    assert out[1]["text"] == rows[0][1] and out[1]["n_lines"] == 4 and out[1]["n_dropped"] == 0
    assert out[2]["text"] == "start" and out[2]["n_dropped"] == 2
    assert out[3]["text"] is None and out[3]["n_lines"] == 0
    assert out[4]["text"] == "" and out[4]["n_lines"] == 1
    assert out[5]["text"] == "" and out[5]["n_dropped"] == 2
    assert out[6]["text"] == "!!!\n!!!" and out[7]["text"] == "a\nb"
    assert line_dedup.without_repeated_lines(table(spark, [])).count() == 0


def test_components_state_holds_millions_of_edges(spark):
    """Sums of 44 bits of each edge's hash overflowed from about a million edges on."""
    edges = spark.range(2_200_000).select((F.col("id") + 1).alias("u"), F.col("id").alias("v"))
    state = graph._state(edges)
    assert state[0] == 2_200_000 and state == graph._state(edges.repartition(3)) != graph._state(edges.where("u <> 77"))


def test_line_dedup_against_all_pairs(spark, docs):
    """Edit similarity of all pairs of lines, without blocks: no other line goes, and nearly all of those do."""
    import random

    import duckdb
    import numpy as np

    rows = [(i, t) for i, t in docs if max(map(len, t.split("\n"))) <= 250][:100]
    r = random.Random(5)

    def changed(line):
        k = r.randrange(len(line) + 1)
        return line[:k] + r.choice("xyz") + line[k + r.randrange(4) :]

    rows += [(100_000 + i, "\n".join(map(changed, t.split("\n")))) for i, t in rows]
    out = {r["doc_id"]: r["text"] for r in line_dedup.without_repeated_lines(table(spark, rows)).collect()}
    normal = spark.createDataFrame([(i, k, x) for i, t in rows for k, x in enumerate(t.split("\n"))], "i long, k int, x string").select("i", "k", line_dedup.normalised(F.col("x")).alias("own")).collect()
    own = {(r["i"], r["k"]): r["own"] for r in normal}
    seen, places = {}, []
    for i, t in sorted(rows):
        has, keys, sizes, _ = line_dedup.line_signatures(t.encode())
        for n, k in enumerate(np.flatnonzero(has)):
            text = own[i, int(k)]
            places.append((i, int(k), text))
            seen.setdefault(text, (i, int(k)))
            assert sizes[n] == len(text) and keys[n].tobytes() == line_dedup.line_signatures(text.encode())[1][0].tobytes()
    texts = sorted(seen, key=seen.get)
    db = duckdb.connect()
    db.execute("create table t as select unnest(range(?)) as i, unnest(?) as x", [len(texts), texts])
    links = db.execute("select a.i, b.i from t a join t b on a.i < b.i and 100 * least(length(a.x), length(b.x)) >= 80 * greatest(length(a.x), length(b.x)) where 100 * levenshtein(a.x, b.x) <= 20 * greatest(length(a.x), length(b.x))").fetchall()
    group = brute.components(range(len(texts)), links)
    number = {t: k for k, t in enumerate(texts)}
    first = {g: seen[texts[g]] for g in set(group.values())}
    wrong = missed = found = 0
    for i, t in rows:
        gone = {k for d, k, x in places if d == i and first[group[number[x]]] != (i, k)}
        every, left = t.split("\n"), out[i].split("\n") if out[i] or len(gone) < t.count("\n") + 1 else []
        expected = [x for k, x in enumerate(every) if k not in gone]
        missed += max(0, len(left) - len(expected))
        wrong += len(set(expected) - set(left))
        found += len(every) - len(left)
    # Links through lines in no block but one's own may move a group's first line, never lose one.
    assert found > 50 and missed <= 0.05 * (found + missed) and wrong <= missed


def test_line_dedup_finds_what_edit_similarity_finds(spark):
    """Lines with one word changed, against edit similarity of all pairs, without any candidate keys."""
    import random

    r = random.Random(7)
    make = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 8)))
    lines = []
    for n in (6, 8, 12, 20, 30) * 8:
        own = [make() for _ in range(n)]
        other = list(own)
        other[r.randrange(n)] = make()
        lines += [" ".join(own), " ".join(other)]
    near = lambda x, y: 100 * brute.edit_distance(x, y) <= 20 * max(len(x), len(y))
    again = {k for k in range(len(lines)) if any(near(lines[j], lines[k]) for j in range(k))}
    out = line_dedup.without_repeated_lines(table(spark, list(enumerate(lines)))).where("n_dropped > 0")
    gone = {row["doc_id"] for row in out.collect()}
    assert gone <= again and len(gone) >= 0.98 * len(again) > 30


def test_line_marks_never_refuse_similar_lines():
    import random

    import numpy as np

    r = random.Random(3)
    words = ["a", "of", "die", "über", "слово", "漢字", "0000", "internationalisation", "word", "lines", "x", "été"]
    pairs = []
    for _ in range(3000):
        x = " ".join(r.choices(words, k=r.choice((1, 2, 3, 5, 9, 30, 120))))
        y = list(x)
        for _ in range(r.randrange(1 + len(x) // 4)):
            k = r.randrange(len(y) + 1)
            y[k : k + r.randrange(2)] = r.choice("ab é漢")
        if y := " ".join("".join(y).split()):
            pairs.append((x, y))
    x, y = (line_dedup.marks(list(side)) for side in zip(*pairs))
    assert x[0].tolist() == [len(a) for a, _ in pairs] and x[1].tolist() == [len(set(a.split(" "))) for a, _ in pairs]
    may = line_dedup.may_be_similar(x, y, 80)
    close = np.array([line_dedup.similar(a, b, 80) for a, b in pairs])
    assert close.sum() > 500 and may[close].all() and not may.all()


def test_line_dedup_compares_all_lines_of_a_block(spark, monkeypatch):
    """Lines that share one part with many others, and with their own copy nothing else."""
    import random

    r = random.Random(11)
    make = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    rows = []
    for i in range(70):
        a, b, c, d, e = (make() for _ in range(5))
        rows.append((i, f"{a} {b} see our annual report {c} {d} {e}"))
        rows.append((1000 + (i * 37) % 70, f"{a} {b[:3]}{b[4:]} see our annual report {c[:5]}{c[6:]} {d} {e}"))
    for tile in (2048, 16):
        monkeypatch.setattr(line_dedup, "TILE", tile)
        out = line_dedup.without_repeated_lines(table(spark, rows)).where("n_dropped > 0").collect()
        assert sorted(x["doc_id"] for x in out) == list(range(1000, 1070))


def test_line_dedup_needs_no_words_the_same(spark):
    """Lines of which most words differ by a letter are similar by their edits alone."""
    import random

    r = random.Random(17)
    make = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(10))
    rows = []
    for i in range(40):
        own = [make() for _ in range(8)]
        rows += [(i, " ".join(own)), (1000 + i, " ".join([*own[:3], *(f"{w[:4]}0{w[5:]}" for w in own[3:])]))]
    assert line_dedup.similar(rows[0][1], rows[1][1], 80)
    out = line_dedup.without_repeated_lines(table(spark, rows)).where("n_dropped > 0").collect()
    assert sorted(x["doc_id"] for x in out) == list(range(1000, 1040))


def test_line_dedup_makes_no_more_links_than_lines(spark):
    """Of lines that are all alike, a task links each once, and of those that aren't, none; edits counted side by side refuse no similar pair."""
    import random

    import numpy as np

    r = random.Random(13)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    base = [word() for _ in range(9)]
    alike = [" ".join([*base[:k % 9], word()[:6], *base[k % 9 + 1 :]]) for k in range(150)]
    apart = [" ".join([*base[:4], *(word() for _ in range(4))]) for _ in range(150)]
    lines = alike + apart
    rows = [([(7, 1), (9, 1)], i, i, *map(int, m.view(np.int64)), t) for i, (t, m) in enumerate(zip(lines, line_dedup.marks(lines).T, strict=True))]
    members = spark.createDataFrame(rows, "blocks array<struct<block: long, parts: long>>, nid long, root long, " + ", ".join(f"{m} long" for m in line_dedup.MARKS) + ", own string")
    links = line_dedup._linked(members, 80).collect()
    assert len(links) == 149 and {x for p in links for x in p} == set(range(150))
    a, b = (v.ravel() for v in np.meshgrid(np.arange(0, 300, 3), np.arange(1, 300, 3)))
    most = np.array([max(len(lines[i]), len(lines[j])) // 5 for i, j in zip(a, b, strict=True)])
    exact = [line_dedup.edit_distance(lines[i], lines[j]) <= m for i, j, m in zip(a, b, most, strict=True)]
    assert line_dedup.few_edits(lines, a, b, most).tolist() == exact and 0 < sum(exact) < len(exact)
