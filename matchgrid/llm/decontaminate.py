"""Benchmark decontamination: a prefix-filtered join of shingles, confirmed window by window.

Windows of benchmark items are sets of shingles. As a document must contain all
of a window's shingles, one of them, the rarest in the corpus, is a sufficient
prefix: only its occurrences propose the window, at one position each, which
must leave room for the whole window. There all shingles are compared.
Everything is joins, groups and expressions over columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, free_names, written

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words in a shingle.
SHINGLE = 3
#: Distinct benchmark shingles up to which they are broadcast (12 bytes each); beyond, the join shuffles.
BROADCAST_SHINGLES = 1_000_000


def _words(text: Column) -> Column:
    ascii_only = F.length(text) == F.octet_length(text)
    lower = F.when(ascii_only, F.lower(text)).otherwise(ascii_lower(text))
    return F.array_remove(F.split(lower, SEPARATORS), "")


def _shingles(words: Column, s: int) -> Column:
    """Hashes of the runs of s words of an array."""
    last = F.size(words) - s
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(s))))
    return F.when(last >= 0, hashes).otherwise(F.array().cast("array<bigint>"))


def _text_key(text: Column) -> list[Column]:
    """Two hashes that stand for a text: all results but the id follow from the text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(text, F.lit("second")).alias("k2")]


def _windows(items: DataFrame, window: int, item_id: str, text_col: str) -> DataFrame:
    """Distinct windows: s (shingle width), width (words), hashes, and the ids of the items that hold them."""
    words = F.col("words")
    rows = items.select(F.col(item_id).cast("string").alias("item"), _words(F.coalesce(F.col(text_col), F.lit(""))).alias("words")).where(F.size("words") > 0)
    rows = rows.withColumn("width", F.least(F.size("words"), F.lit(window))).withColumn("s", F.least("width", F.lit(SHINGLE)))
    by_width = F.when(F.col("s") == 1, _shingles(words, 1))
    for s in range(2, SHINGLE + 1):
        by_width = by_width.when(F.col("s") == s, _shingles(words, s))
    rows = rows.withColumn("all", by_width).withColumn("start", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("width"))))
    hashes = F.slice("all", F.col("start") + 1, F.col("width") - F.col("s") + 1)
    return rows.select("s", "width", hashes.alias("hashes"), "item").groupBy("s", "width", "hashes").agg(F.collect_set("item").alias("items"))


def contaminated_texts(docs: DataFrame, items: DataFrame, window: int, text_col: str, item_id: str, item_text: str) -> DataFrame:
    """For each distinct text with an occurring window: k1, k2, n_words, n_hit, items (ids, sorted as strings)."""
    windows = written(_windows(items, window, item_id, item_text), "windows")
    known = windows.select("s", F.explode("hashes").alias("h")).distinct()
    known = F.broadcast(known) if known.count() <= BROADCAST_SHINGLES else known
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(*_text_key(text), _words(text).alias("words"))
    found = None
    for s in (r["s"] for r in windows.select("s").distinct().collect()):  # SHINGLE values at most
        own = base.select("k1", "k2", F.size("words").alias("n_words"), F.lit(s).alias("s"), F.posexplode(_shingles(F.col("words"), s)).alias("pos", "h")).join(known, ["s", "h"])
        found = own if found is None else found.unionByName(own)
    if found is None:
        return docs.sparkSession.createDataFrame([], "k1 long, k2 long, n_words int, n_hit long, items array<string>")
    found = written(found, "shingles")

    rarity = found.groupBy("s", "h").agg(F.count("*").alias("n"))
    spread = windows.select("*", F.posexplode("hashes").alias("offset", "h")).join(rarity, ["s", "h"], "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "offset")).alias("r")
    prefix = spread.groupBy("s", "width", "hashes").agg(rarest, F.first("items").alias("items")).where("r.n > 0")
    proposal = F.struct(F.col("r.offset").alias("offset"), "width", "hashes", "items")
    prefix = prefix.select("s", F.col("r.h").alias("h"), proposal.alias("w")).groupBy("s", "h").agg(F.collect_list("w").alias("proposed"))
    prefix = written(prefix, "prefixes")

    wanted = found.join(prefix.select("s", "h"), ["s", "h"], "left_semi").select("k1", "k2", "s").distinct()
    texts = found.join(wanted, ["k1", "k2", "s"], "left_semi").join(prefix, ["s", "h"], "left")
    texts = texts.groupBy("k1", "k2", "n_words", "s").agg(F.sort_array(F.collect_set(F.struct("pos", "h", "proposed"))).alias("x"))
    gap = lambda x, j: x["pos"] - F.coalesce(F.get(F.col("x"), j - 1)["pos"], F.lit(-1)) - 1
    padded = F.flatten(F.transform("x", lambda x, j: F.concat(F.array_repeat(F.lit(None).cast("bigint"), gap(x, j)), F.array(x["h"]))))
    proposals = F.flatten(F.transform(F.filter("x", lambda x: x["proposed"].isNotNull()), lambda x: F.transform(x["proposed"], lambda w: F.struct((x["pos"] - w["offset"]).alias("start"), w["width"].alias("width"), w["hashes"].alias("hashes"), w["items"].alias("items")))))
    texts = texts.withColumn("all", padded).withColumn("p", proposals)
    fits = F.filter("p", lambda w: (w["start"] >= 0) & (w["start"] + w["width"] <= F.col("n_words")) & F.when(w["start"] >= 0, F.slice("all", w["start"] + 1, F.size(w["hashes"])) == w["hashes"]))
    texts = texts.select("k1", "k2", "n_words", fits.alias("fits")).where(F.size("fits") > 0)
    spans = F.transform("fits", lambda w: F.struct(w["start"].alias("start"), (w["start"] + w["width"]).alias("end")))
    texts = texts.select("k1", "k2", "n_words", F.array_distinct(spans).alias("spans"), F.array_distinct(F.flatten(F.transform("fits", lambda w: w["items"]))).alias("items"))
    if SHINGLE > 1:  # windows of several shingle widths may meet in a text
        texts = texts.groupBy("k1", "k2", "n_words").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    cover = lambda acc, x: F.struct(F.greatest(acc["end"], x["end"]).alias("end"), (acc["n"] + F.greatest(x["end"] - F.greatest(x["start"], acc["end"]), F.lit(0))).alias("n"))
    return written(texts.select("k1", "k2", "n_words", F.aggregate("spans", zero, cover, lambda acc: acc["n"]).alias("n_hit"), "items"), "contaminated")


def _verdict(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """For each row of docs, how much of it stands in windows of benchmark items.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased; a
    window is ``window`` consecutive words of an item, or all of a shorter one.
    Returns id, n_words, n_hit (words inside an occurrence), n_items (items with
    occurring windows), items_sha256 (of their ids, sorted as strings, joined by
    commas) and contaminated (n_hit is 5 % of n_words or more, and not 0).
    A null text, document or item, has no words and hits nothing; items without
    an id contribute hits but no name; repeated items count once, repeated rows
    each stay; empty tables give no rows or no hits. Other columns are left out.
    """
    hits = contaminated_texts(docs, items, window, text_col, item_id, item_text).drop("n_words")
    text = F.coalesce(F.col(text_col), F.lit(""))
    n_words = F.size(F.array_remove(F.split(text, SEPARATORS), "")).cast("long")
    rows = docs.select(F.col(id_col), *_text_key(text), n_words.alias("n_words")).join(hits, ["k1", "k2"], "left")
    n_hit, items_ = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return rows.select(id_col, "n_words", n_hit.alias("n_hit"), F.size(items_).cast("long").alias("n_items"), F.sha2(F.array_join(items_, ","), 256).alias("items_sha256"), _verdict(n_hit, F.col("n_words")).alias("contaminated"))


def decontaminated(docs: DataFrame, items: DataFrame, window: int = 13, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that contamination() doesn't call contaminated, with their columns."""
    k1, k2 = free_names(docs, "k1", "k2")
    bad = contaminated_texts(docs, items, window, text_col, item_id, item_text).where(_verdict(F.col("n_hit"), F.col("n_words"))).select(F.col("k1").alias(k1), F.col("k2").alias(k2))
    own = _text_key(F.coalesce(F.col(text_col), F.lit("")))
    return docs.join(bad, (own[0] == F.col(k1)) & (own[1] == F.col(k2)), "left_anti")
