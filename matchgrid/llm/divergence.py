"""Source divergence audit: shards of terms counted and compared by DuckDB, merged by Spark.

1. Tasks split texts into terms and add up each (lang, source, term) in DuckDB.
2. Those sums are dealt out by a hash of (lang, term), so a shard has all counts of
   its terms: SQL in DuckDB keeps the terms of enough documents. Spark adds the
   sizes of groups and languages.
3. With those each row gets its probabilities, and shards of (lang, term) again run
   SQL: partial sums over pairs of sources, and each group's best terms. Spark
   merges sums and ranks.

For a pair (s, t) let f(p, q) be a term's value and p0 the probability of a count of
0. Over V kept terms the sum is V * f(p0s, p0t) plus, for terms that s has,
f(ps, p0t) - f(p0s, p0t), plus the same for terms that t has, plus what is left
where both have the term. The first parts follow from how many terms of a source
have each count, so shards only meet terms' own sources, never all sources.

Rules: null text, lang and source are ''. Each row is a document, repeated ids or
not. Terms are runs of ASCII letters and of anything outside ASCII; only A-Z is
lower-cased. All sums are integers (128 bits while they add up). A group without
kept terms has its pairs, with what its probabilities give; a language without kept
terms has pairs of value 0. No rows give no rows. Other columns are left alone.
A task's DuckDB works in MEMORY and spills to its temporary folder beyond.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import written

SCALE = 1_000_000_000
#: Of each task's DuckDB.
MEMORY = "350MB"
#: Bytes of text that are split at once, and sums that a task gathers before it passes them on.
PIECE, GATHERED = 12 << 20, 1_500_000

_BYTES = np.full(256, 0x20, np.uint8)
_BYTES[0x61:0x7B] = np.arange(0x61, 0x7B)
_BYTES[0x41:0x5B] = np.arange(0x61, 0x7B)
_BYTES[0x80:] = np.arange(0x80, 0x100)

_COUNTED = "lang string, source string, term string, n long, n_docs long"
_KEPT = "lang string, source string, term string, n long, lang_n long, leads boolean"
_SUMS = "part string, lang string, source string, item string, value decimal(38,0)"


@contextmanager
def _duckdb():
    import duckdb

    with tempfile.TemporaryDirectory() as spill, duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": spill}) as con:
        con.execute("set preserve_insertion_order = false")
        yield con


def _rows(con, sql: str) -> Iterator[pa.RecordBatch]:
    yield from con.sql(sql).to_arrow_reader(50_000)


def _spaced(texts: pa.Array) -> pa.Array:
    """Texts with a space for every byte outside terms, and A-Z lower-cased."""
    _, offsets, data = texts.buffers()
    raw = np.frombuffer(data if data is not None else b"", np.uint8)
    return pa.Array.from_buffers(texts.type, len(texts), [None, offsets, pa.py_buffer(_BYTES[raw])], offset=texts.offset)


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of about PIECE bytes of text, or a single longer one."""
    sizes = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(batch):
        done = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, done + PIECE)))
        yield batch.slice(start, end - start)
        start = end


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and documents of each (lang, source, term) of a task's texts."""
    with _duckdb() as con:
        con.execute("create table sums (lang varchar, source varchar, term varchar, n bigint, n_docs bigint)")
        add_up = "select lang, source, term, sum(n)::bigint as n, sum(n_docs)::bigint as n_docs from sums group by all"
        for piece in (p for b in batches for p in _pieces(b)):
            texts = pa.table({"lang": piece.column("lang"), "source": piece.column("source"), "doc": np.arange(len(piece)), "text": _spaced(piece.column("text"))})
            con.register("texts", texts)
            con.execute(
                """insert into sums select lang, source, term, sum(n), count(*) from (select lang, source, doc, term, count(*) as n
                from (select lang, source, doc, unnest(string_split(text, ' ')) as term from texts) where term <> '' group by all) group by all"""
            )
            con.unregister("texts")
            if con.sql("select count(*) from sums").fetchall()[0][0] >= GATHERED:
                yield from _rows(con, add_up)
                con.execute("truncate sums")
        yield from _rows(con, add_up)


def _shard(batches: Iterator[pa.RecordBatch], con) -> bool:
    """Gives a connection the rows of a shard as ``shard``; whether there are any."""
    first = next(batches, None)
    if first is None:
        return False

    def all_of():
        yield first
        yield from batches

    con.register("rows_in", pa.RecordBatchReader.from_batches(first.schema, all_of()))
    con.execute("create table shard as select * from rows_in")
    con.unregister("rows_in")
    return True


def _kept(least: int):
    def run(batches):
        """A shard's terms in at least so many documents of the language."""
        with _duckdb() as con:
            if _shard(batches, con):
                con.execute("create table sums as select lang, source, term, sum(n)::bigint as n, sum(n_docs)::bigint as n_docs from shard group by all")
                con.execute("drop table shard")
                yield from _rows(
                    con,
                    f"""select s.lang, s.source, s.term, s.n, k.lang_n, s.source = k.leader as leads from sums s
                        join (select lang, term, sum(n)::bigint as lang_n, min(source) as leader from sums group by all having sum(n_docs) >= {least}) k on s.lang = k.lang and s.term = k.term""",
                )

    return run


def _compared(top: int):
    def f(p: str, q: str) -> str:
        return f"(({p} - {q}) * ({p} - {q})) // {q}"

    def run(batches):
        """A shard's partial sums of pairs and each group's best terms."""
        with _duckdb() as con:
            if _shard(batches, con):
                yield from _rows(
                    con,
                    f"""select 'pair' as part, a.lang, a.source, b.source as item, sum({f("a.p", "b.p")} - {f("a.p", "b.p0")} - {f("a.p0", "b.p")} + {f("a.p0", "b.p0")})::decimal(38, 0) as value
                        from shard a join shard b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all""",
                )
                yield from _rows(
                    con,
                    f"""select 'term' as part, lang, source, term as item, value::decimal(38, 0) as value from (select lang, source, term, {f("p", "q")} as value from shard where p > q)
                        qualify row_number() over (partition by lang, source order by value desc, term) <= {top}""",
                )

    return run


def _prob(n: Column | int, total: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / total), exactly."""
    n = n if isinstance(n, Column) else F.lit(n)
    scaled = (n.cast("decimal(19,0)") + F.lit(1).cast("decimal(1,0)")) * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", scaled, total.cast("decimal(19,0)")) + 1


def _value(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def source_divergence(docs: DataFrame, least: int = 3, top: int = 200, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """How sources of a language differ: lang, source, part (``pair`` or ``term``), item, value, rank."""
    known = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    sums = known.mapInArrow(_counts, _COUNTED).repartition("lang", "term")
    kept = written(sums.mapInArrow(_kept(least), _KEPT), "kept-terms")

    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_size"), F.count_if("leads").alias("v"))
    groups = known.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    groups = written(groups.withColumn("p0", F.when(F.col("v") > 0, _prob(0, F.col("size") + F.col("v")))), "groups")

    rows = kept.join(groups, ["lang", "source"])
    rows = rows.select("lang", "source", "term", _prob(F.col("n"), F.col("size") + F.col("v")).alias("p"), "p0", _prob(F.col("lang_n"), F.col("lang_size") + F.col("v")).alias("q"))
    partial = written(rows.repartition("lang", "term").mapInArrow(_compared(top), _SUMS), "partial-sums")

    wide = lambda c: c.cast("decimal(19,0)")
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("item_p0"))
    both = groups.join(other, "lang").where(F.col("source") != F.col("item"))
    base = both.select("lang", "source", "item", F.coalesce(wide(F.col("v")) * wide(_value(F.col("p0"), F.col("item_p0"))), F.lit(0)).cast("decimal(38,0)").alias("value"))
    alike = rows.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("terms")).join(other, "lang").where(F.col("source") != F.col("item"))
    p, p0, item_p0, terms = F.col("p"), F.col("p0"), F.col("item_p0"), F.col("terms").cast("decimal(18,0)")
    first = alike.select("lang", "source", "item", (terms * wide(_value(p, item_p0) - _value(p0, item_p0))).cast("decimal(38,0)").alias("value"))
    second = alike.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (terms * wide(_value(item_p0, p) - _value(item_p0, p0))).cast("decimal(38,0)").alias("value"))
    met = partial.where(F.col("part") == "pair").drop("part")
    pairs = base.unionByName(first).unionByName(second).unionByName(met).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(order))
    best = partial.where(F.col("part") == "term").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.unionByName(best).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank")
