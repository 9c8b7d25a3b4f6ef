"""Quality rules: base counts and the divergence of a text's histograms from its language's.

All of it is expressions over columns, and one grouped sum for the references.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import written

SEPARATORS = r"[\x20\x09-\x0D]+"
SEPARATOR_CHARS = " \t\n\x0b\x0c\r"

# Frequent function words of four languages.
COMMON = {
    "en": "the of and to in a is that for it as was with be by on not this are or from at an".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au ce avec pas".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch".split(),
    "es": "de la que el en y a los se del las por un para con no una su al lo como".split(),
}
WORDS = sorted({w for own in COMMON.values() for w in own})

#: Distances (square roots of Jensen-Shannon divergences, 0 to 1) from which a text is rejected.
CHAR_DISTANCE, WORD_DISTANCE = 0.30, 0.29
#: Texts with fewer characters in words, or fewer words, aren't judged by that histogram.
LEAST_CHARS, LEAST_WORDS = 200, 150
#: Languages up to which the references are broadcast: a row of about 1 KB each.
BROADCAST_LANGUAGES = 1000


def _only(text: Column, others: str) -> Column:
    """Number of characters of a class, given as a regular expression of all others."""
    return F.length(F.regexp_replace(text, f"{others}+", "")).cast("long")


def _words(text: Column) -> Column:
    inner = F.btrim(text, F.lit(SEPARATOR_CHARS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SEPARATORS))


def _repeated(windows: Column) -> Column:
    """Sorted positions of the windows that occur twice or more."""
    return F.when(
        F.size(F.array_distinct(windows)) < F.size(windows),
        F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )


def _covered(repeated: Column, width: int) -> Column:
    """Number of positions inside runs of this width that start at the repeated windows."""
    same = F.filter(repeated, lambda x, j: F.coalesce(F.get(repeated, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(repeated, j + 1)["h"] == x["h"], F.lit(False)))
    starts = F.sort_array(F.transform(same, lambda x: x["i"]))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, p: F.struct((p + width).alias("end"), (acc["n"] + (p + width) - F.greatest(p, acc["end"])).alias("n"))
    return F.aggregate(starts, zero, step, lambda acc: acc["n"])


def _distance(counts: Column, total: Column, shares: Column) -> Column:
    """Jensen-Shannon distance (base 2) of counts that add up to a total from shares that add up to 1; null without either."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    terms = F.zip_with(counts, shares, lambda x, q: part(x / total, (x / total + q) / 2) + part(q, (x / total + q) / 2))
    return F.when(total > 0, F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x) / 2, F.lit(0.0))))


def measured(docs: DataFrame, text_col: str, lang_col: str, name: str, keep: list[str]) -> DataFrame:
    """These columns of docs with a struct column of that name: base counts and histograms."""
    t, w = f"{name}t", f"{name}w"
    text, words = F.col(t), F.col(w)
    at = lambda i, k: F.get(words, i + k)
    windows = F.when(F.size(words) >= 5, F.transform(F.sequence(F.lit(0), F.size(words) - 5), lambda i: F.xxhash64(*(at(i, k) for k in range(5))))).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SEPARATOR_CHARS)) != "")
    out = docs.withColumn(t, F.coalesce(F.col(text_col), F.lit(""))).withColumn(w, _words(text))
    # Columns that later ones use more than once are steps of their own, so that Spark computes them once.
    out = out.withColumn(f"{name}c", F.array_join(words, "")).withColumn(f"{name}l", lines).withColumn(f"{name}h", windows)
    found = F.filter(words, lambda x: x.isin(WORDS))
    out = out.withColumn(f"{name}r", _repeated(F.col(f"{name}h"))).withColumn(f"{name}f", found)
    rest = F.regexp_replace(f"{name}c", "[a-z]+", "")
    marked = F.concat(F.lit("|"), F.array_join(f"{name}f", "||"), F.lit("|"))
    out = out.withColumn(f"{name}o", rest).withColumn(f"{name}m", marked).withColumn(f"{name}n", F.coalesce(_covered(F.col(f"{name}r"), 5), F.lit(0).cast("long")))
    o, m = F.col(f"{name}o"), F.col(f"{name}m")
    out = out.withColumns(
        {
            f"{name}1": F.length(f"{name}c").cast("long"),
            f"{name}2": _only(o, r"\P{Lu}"),
            f"{name}3": _only(o, "[^0-9]"),
            f"{name}4": _only(o, r"[^#*$%&|<>]"),
            f"{name}5": _only(o, r"[\p{L}\p{N}#*$%&|<>]"),
            f"{name}6": F.size(words).cast("long"),
        }
    )
    chars, upper, digits, symbols, marks, n_words = (F.col(f"{name}{i}") for i in range(1, 7))
    rest = F.greatest(chars - upper - digits - symbols - marks, F.lit(0))
    char_counts = F.array(*(x.cast("double") for x in (rest, upper, digits, symbols, marks, n_words)))
    size = F.octet_length(m)
    n_found = [(size - F.octet_length(F.replace(m, F.lit(f"|{x}|"), F.lit("")))) / float(len(x.encode()) + 2) for x in WORDS]
    measures = F.struct(
        n_words.alias("n_words"),
        chars.alias("word_chars"),
        symbols.alias("n_symbols"),
        (F.size(F.col(f"{name}l")) - F.size(F.array_distinct(F.col(f"{name}l")))).cast("long").alias("n_dup_lines"),
        F.col(f"{name}n").alias("n_repeat_words"),
        ((n_words < 10) | (100 * F.col(f"{name}n") > 20 * n_words)).alias("base_failed"),
        char_counts.alias("char_counts"),
        F.array(*n_found, (n_words - F.size(f"{name}f")).cast("double")).alias("word_counts"),
        (F.col(lang_col) if lang_col in docs.columns else F.lit(None)).cast("string").alias("lang"),
    )
    return out.select(*keep, measures.alias(name))


def references(rows: DataFrame, name: str) -> DataFrame:
    """For each language the shares of its summed histograms, over all texts that pass the base rules."""
    good = rows.where(~F.col(f"{name}.base_failed") & F.col(f"{name}.lang").isNotNull()).select(f"{name}.*")
    sums = [F.sum(F.col("char_counts")[i]).alias(f"c{i}") for i in range(6)] + [F.sum(F.col("word_counts")[i]).alias(f"w{i}") for i in range(len(WORDS) + 1)]
    summed = good.groupBy("lang").agg(*sums)
    shares = lambda own: F.array(*(F.try_divide(F.col(c), sum((F.col(x) for x in own), F.lit(0.0))) for c in own))
    chars, words = [f"c{i}" for i in range(6)], [f"w{i}" for i in range(len(WORDS) + 1)]
    return summed.select(F.col("lang").alias(f"{name}lang"), shares(chars).alias(f"{name}chars"), shares(words).alias(f"{name}words"))


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The id and, as columns, the measures and verdicts of quality_rules; other columns are left out."""
    rows = quality_rules(docs, text_col, lang_col, [id_col])
    return rows.select(F.col(id_col), f"{rows.columns[-1]}.*")


def quality_rules(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """All rows and columns (or those in keep) of docs, and a last column: a struct of measures and verdicts.

    The struct (named ``quality``, or with underscores before it where docs has
    such a column) holds n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, char_distance, word_distance and kept. Words
    are ``[^\\x20\\x09-\\x0D]+``. A text is kept unless the base rules fail it
    (under 10 words, or over 20 % of words in repeated 5-word windows) or a
    histogram is too far from its language's: character classes from
    CHAR_DISTANCE on, common words from WORD_DISTANCE on. Texts below
    LEAST_CHARS or LEAST_WORDS, and of null languages or ones of which no text
    passes the base rules, aren't judged by histograms (null distances). A
    null text counts as empty and fails; repeated rows stay and are counted
    each time; an empty table gives no rows. Long texts are handled whole.
    """
    name, keep = "quality", docs.columns if keep is None else keep
    while any(c.lower().startswith(name) for c in docs.columns):
        name = f"_{name}"
    rows = written(measured(docs, text_col, lang_col, name, keep), "quality")
    refs = written(references(rows, name), "references")  # a row for each language
    refs = F.broadcast(refs) if refs.count() <= BROADCAST_LANGUAGES else refs
    q = F.col(name)
    joined = rows.join(refs, q["lang"] == F.col(f"{name}lang"), "left")
    char_distance = F.when(q["word_chars"] >= LEAST_CHARS, _distance(q["char_counts"], q["word_chars"] + q["n_words"], F.col(f"{name}chars")))
    word_distance = F.when(q["n_words"] >= LEAST_WORDS, _distance(q["word_counts"], q["n_words"].cast("double"), F.col(f"{name}words")))
    joined = joined.withColumn(f"{name}1", char_distance).withColumn(f"{name}2", word_distance)
    d = {"c": F.col(f"{name}1"), "w": F.col(f"{name}2")}
    far = F.coalesce(d["c"] >= CHAR_DISTANCE, F.lit(False)) | F.coalesce(d["w"] >= WORD_DISTANCE, F.lit(False))
    base = [q[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]
    verdict = F.struct(*base, d["c"].alias("char_distance"), d["w"].alias("word_distance"), (~q["base_failed"] & ~far).alias("kept"))
    return joined.select(*keep, verdict.alias(name))
