"""Secret scans: candidates by pattern, false positives removed by a random forest.

The forest is fitted by pyspark.ml to labelled findings; its trees are then
written out as CASE expressions, so that a document is scanned in place: no
rows are exploded, joined or shuffled, and no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Tokens with a digit; values that follow = or : ; headers of private keys.
CANDIDATE = (
    r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY(?: BLOCK)?-----"
    r"|(?<![A-Za-z0-9_+/\-])(?:(?=[A-Za-z_+/\-]*[0-9])[A-Za-z0-9_+/\-]{12,}={0,2}"
    r"|(?<=[=:][\"' ]{0,2})[!-~&&[^\"',;<>()]]{8,})"
)
#: Characters of a candidate's surroundings that are looked at.
AROUND = 40
#: Frequent words of the corpus, of LEAST letters or more, in the dictionary.
DICTIONARY, LEAST = 400, 4
#: Candidates whose places are added up at a time.
BLOCK = 64
#: Votes, as a share of the trees, from which a candidate is a secret.
VOTES = 0.5

_SECRET_WORD = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|credential|auth|api[_-]?key|access[_-]?key|private[_-]?key|bearer)[\"']?\s{0,2}[=:]?\s{0,2}[\"']?$"
_OTHER_WORD = r"(?i)(commit|sha-?(1|256)?|md5|crc|checksum|digest|hash|etag|uuid|version|release|build|isbn|order|invoice|tracking|serial|card|phone|tel|img|image|page)[\"']?\s{0,2}[=:#]?\s{0,2}[\"']?$"
# Words of file names, dates and releases, whose share of a candidate speaks against a random string.
_COMMON = "the|and|for|with|from|that|this|tion|ment|ing|able|image|images|img|photo|thumb|large|small|banner|icon|logo|asset|static|page|index|article|post|news|item|product|category|user|file|data|test|example|sample|version|release|build|report|draft|final|copy|backup|january|february|march|april|may|june|july|august|september|october|november|december"

FEATURES = ("length", "digits", "upper", "signs", "transitions", "distinct_kinds", "vowels", "hex", "covered", "slashes", "dashes", "known_prefix", "path_before", "path_after", "secret_word", "other_word", "assigned", "quoted")


def corpus_words(docs: DataFrame, text_col: str = "text", n: int = DICTIONARY) -> list[str]:
    """The n most frequent words of LEAST ASCII letters or more of all texts, lower-cased: the dictionary beside the fixed words."""
    words = docs.select(F.explode(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), "[^a-z]+")).alias("w")).where(F.length("w") >= LEAST)
    counts = words.groupBy("w").agg(F.count("*").alias("n"))
    return [r["w"] for r in counts.orderBy(F.desc("n"), "w").limit(n).collect()]


def features(c: Column, before: Column, after: Column, dictionary: list[str] | tuple[str, ...] = ()) -> list[Column]:
    """FEATURES of a candidate between its surroundings, as doubles; the dictionary's words are of letters."""
    covering = "|".join([*sorted(dictionary, key=lambda w: (-len(w), w)), _COMMON])
    n = F.greatest(F.length(c), F.lit(1)).cast("double")
    left = lambda pattern: F.length(F.regexp_replace(c, pattern, "")) / n
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[0-9]+", "0"), "[A-Z]+", "A"), "[a-z]+", "a")
    flag = lambda x: F.when(x, 1.0).otherwise(0.0)
    some = lambda pattern: flag(c.rlike(pattern))
    return [
        F.least(n, F.lit(100.0)),
        left("[^0-9]"),
        left("[^A-Z]"),
        left("[A-Za-z0-9]"),
        F.length(kinds) / n,
        some("[0-9]") + some("[A-Z]") + some("[a-z]") + some("[^A-Za-z0-9]"),
        left("[^aeiouAEIOU]"),
        some("^([0-9a-f]+|[0-9A-F]+)$"),
        1 - F.length(F.regexp_replace(F.lower(c), covering, "")) / n,
        left("[^/]"),
        left("[^-_]"),
        some("^(AKIA|ASIA|ghp_|gho_|github_pat_|xox[abp]-|sk_live_|AIza|eyJ|glpat-|-----BEGIN)"),
        flag(before.rlike(r"[/\\.][A-Za-z0-9_\-]*$")),
        flag(after.rlike(r"^(/|\.[a-z]{2,5}\b)")),
        flag(before.rlike(_SECRET_WORD)),
        flag(before.rlike(_OTHER_WORD)),
        flag(before.rlike(r"[=:]\s{0,2}[\"']?$")),
        flag(before.rlike(r"[\"']$") & after.rlike(r"^[\"']")),
    ]


def example_findings(spark: SparkSession, n: int = 6000, dictionary: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Labelled findings (before, candidate, after, label) made up from hashes of 0 to n - 1.

    Stands in for reviewed findings, which the tables here don't have: known
    formats, assigned random strings and assigned passphrases of letters are
    secrets; numbers, versions, paths, digests, dates, compounds of the
    dictionary's words and plain words after a colon aren't.
    """
    entries = F.array(*(F.lit(w) for w in (dictionary or ("common", "words", "only"))))
    i = F.col("id")
    h = lambda k: F.sha2(F.concat_ws("-", i.cast("string"), F.lit(str(k))), 256)
    num = lambda k, m: (F.abs(F.xxhash64(i, F.lit(k))) % m).cast("int")
    pick = lambda k, *x: F.get(F.array(*(v if isinstance(v, Column) else F.lit(v) for v in x)), num(k, len(x)))
    alnum = F.regexp_replace(F.base64(F.unhex(h(1))), "[+/=]", "x")
    digits = F.translate(h(2), "abcdef", "012345")
    cut = lambda c, least, span: c.substr(F.lit(1), F.lit(least) + num(9, span))
    word = F.concat(pick(3, "summer", "winter", "report", "gallery", "release", "product", "annual", "banner"), pick(4, "-", "_", ""), pick(5, "image", "photo", "version", "draft", "index", "page", "large", "final"))
    letters = F.translate(alnum, "0123456789", "qWeRtYuIoP")
    entry = lambda k: F.get(entries, num(k, max(1, len(dictionary) or 3)))
    noun = lambda k: F.initcap(pick(k, "correct", "horse", "battery", "staple", "purple", "monkey", "dragon", "silver", "castle", "window"))
    keyed = pick(6, "password=", "passwd: ", 'token = "', 'secret_key="', "api_key=", "API_KEY: ", "Authorization: Bearer ", "auth_token='", 'password = "')
    plain = pick(7, "see ", "of the ", "and ", "in ", "\n", "was ")
    cases = [
        (F.lit(1.0), pick(8, keyed, plain), F.concat(F.lit("AKIA"), F.upper(alnum).substr(1, 16))),
        (F.lit(1.0), keyed, cut(h(1), 16, 40)),
        (F.lit(1.0), keyed, cut(alnum, 12, 30)),
        (F.lit(1.0), pick(8, keyed, plain), F.concat(pick(10, "ghp_", "sk_live_", "glpat-", "xoxb-"), alnum.substr(1, 32))),
        (F.lit(1.0), keyed, F.concat(alnum.substr(1, 8), pick(11, "!", "#", "$", "%"), digits.substr(1, 3))),
        (F.lit(1.0), keyed, cut(letters, 10, 30)),
        (F.lit(1.0), keyed, F.concat(noun(15), noun(16), noun(17))),
        (F.lit(1.0), plain, F.concat(F.lit("-----BEGIN "), pick(18, "PGP ", "RSA ", "EC ", ""), F.lit("PRIVATE KEY"), pick(19, "", " BLOCK"), F.lit("-----"))),
        (F.lit(0.0), pick(8, "note: ", "title=", "author: ", "subject: ", "see: ", "address: "), pick(20, "something", "different", "important", "according", "available", "President", "Department", "yesterday", "Wednesday", "information", "following", "Christopher")),
        (F.lit(0.0), pick(8, plain, "card ", "tel: ", "order #", "id="), cut(digits, 12, 8)),
        (F.lit(0.0), pick(8, "commit ", "sha1: ", "md5=", "checksum: ", "uuid=", 'etag="', "sha256:"), cut(h(1), 32, 33)),
        (F.lit(0.0), pick(8, "https://example.com/", "/static/img/", "src=/assets/", "./docs/"), F.concat(word, pick(12, "-", "_", ""), digits.substr(1, 4))),
        (F.lit(0.0), plain, F.concat(word, digits.substr(1, 6))),
        (F.lit(0.0), pick(8, plain, "name: ", "title=", "in: "), F.concat(entry(21), pick(12, "-", "_", ""), F.initcap(entry(22)), pick(23, "", digits.substr(1, 2)))),
        (F.lit(0.0), pick(8, "version ", "build=", plain), F.concat(F.lit("20"), digits.substr(1, 2), F.lit("-0"), digits.substr(3, 1), F.lit("-1"), digits.substr(4, 1), F.lit("T12-"), digits.substr(5, 2))),
        (F.lit(0.0), pick(8, "page: ", "title=", "note: "), F.concat(word, F.lit(".html"))),
        (F.lit(0.0), plain, cut(h(1), 12, 20)),
    ]
    after = pick(13, " the", "\n", '" of', ".", ", and", "' is")
    rows = F.array(*(F.struct(a.alias("label"), b.alias("before"), c.alias("candidate"), F.when(a == 0, pick(14, ".png", "/x", " the", ".")).otherwise(after).alias("after")) for a, b, c in cases))
    return spark.range(n).select(F.get(rows, (i % len(cases)).cast("int")).alias("r")).select("r.*")


def train(findings: DataFrame, trees: int = 24, depth: int = 6, seed: int = 17, dictionary: list[str] | tuple[str, ...] = ()) -> list:
    """A forest fitted to labelled findings, as nested (feature, threshold, below, above) or shares of secrets."""
    named = [f.alias(n) for f, n in zip(features(F.col("candidate"), F.col("before"), F.col("after"), dictionary), FEATURES, strict=True)]
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(findings.select("label", *named))
    return forest(RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(rows))


def forest(model: RandomForestClassificationModel) -> list:
    def node(x):
        if x.getClass().getSimpleName() == "LeafNode":
            stats = list(x.impurityStats().stats())
            return stats[1] / sum(stats) if len(stats) > 1 else 0.0
        return x.split().featureIndex(), x.split().threshold(), node(x.leftChild()), node(x.rightChild())

    return [node(t._java_obj.rootNode()) for t in model.trees]


def votes(trees: list, own: list[Column]) -> Column:
    """The mean share of secrets in the leaves that a candidate's features lead to."""

    def walk(x) -> Column:
        if not isinstance(x, tuple):
            return F.lit(float(x))
        i, threshold, below, above = x
        return F.when(own[i] <= threshold, walk(below)).otherwise(walk(above))

    return sum((walk(t) for t in trees), F.lit(0.0)) / len(trees)


def secret_scan(docs: DataFrame, trees: list, id_col: str = "doc_id", text_col: str = "text", dictionary: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Secrets in every whole text, by a forest and the dictionary that it was fitted with.

    Returns id, n_candidates, n_secrets (longs) and secrets ("start:end" of each,
    in code points, joined by commas). A null text is empty and has none;
    repeated rows and null ids stay, a row each; other columns are left out; an
    empty table gives no rows. All candidates of a text are judged, however
    many; they and the text between them stay inside the row.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), text.alias("_text"))
    rows = rows.withColumn("_found", F.regexp_extract_all("_text", F.lit(CANDIDATE), F.lit(0))).withColumn("_between", F.when(F.size("_found") > 0, F.split("_text", CANDIDATE)))
    tail = lambda x: F.substring(x, -AROUND, AROUND)
    around = F.zip_with("_found", F.sequence(F.lit(0), F.size("_found") - 1), lambda c, k: F.struct(c.alias("c"), tail(F.get(F.col("_between"), k)).alias("b"), F.substring(F.get(F.col("_between"), k + 1), 1, AROUND).alias("a"), F.length(F.get(F.col("_between"), k)).alias("gap"), F.length(c).alias("n")))
    rows = rows.withColumn("_around", F.when(F.size("_found") > 0, around))
    # Places are sums of lengths, added up in blocks, so that no long array is copied for each candidate.
    step = lambda acc, x: F.struct((acc["at"] + x["gap"] + x["n"]).alias("at"), F.concat(acc["starts"], F.array(acc["at"] + x["gap"])).alias("starts"))
    from_ = lambda at: F.struct(at.alias("at"), F.array().cast("array<int>").alias("starts"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("_around") - 1) / BLOCK).cast("int")), lambda b: F.slice("_around", b * BLOCK + 1, BLOCK))
    zero = F.struct(from_(F.lit(0)).alias("last"), F.array().cast("array<array<int>>").alias("done"))
    block = lambda acc, own: F.struct(F.aggregate(own, from_(acc["last"]["at"]), step).alias("last"), F.concat(acc["done"], F.array(acc["last"]["starts"])).alias("done"))
    starts = F.aggregate(blocks, zero, block, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["last"]["starts"]))))
    rows = rows.withColumn("_starts", F.when(F.size("_found") > 0, starts))
    names = [f"f{i}" for i in range(len(FEATURES))]
    judged = F.transform("_around", lambda x: F.struct(*(f.alias(n) for f, n in zip(features(x["c"], x["b"], x["a"], dictionary), names, strict=True))))
    rows = rows.withColumn("_features", judged)
    verdicts = F.transform("_features", lambda x: votes(trees, [x[n] for n in names]) >= VOTES)
    rows = rows.withColumn("_secret", verdicts)
    spans = F.transform("_starts", lambda s, k: F.when(F.get(F.col("_secret"), k), F.concat_ws(":", s, s + F.get(F.col("_around"), k)["n"])))
    kept = F.coalesce(F.filter(spans, lambda x: x.isNotNull()), F.array().cast("array<string>"))
    return rows.withColumn("_kept", kept).select(id_col, F.size("_found").cast("long").alias("n_candidates"), F.size("_kept").cast("long").alias("n_secrets"), F.array_join("_kept", ",").alias("secrets"))
