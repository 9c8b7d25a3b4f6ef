"""Events of a prediction market, landed as JSON pages, and their teams' prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import betting as bet, text

#: Of an event only what prices need; outcomes and prices are JSON arrays in strings.
EVENT = "title string, slug string, markets array<struct<question string, outcomes string, outcomePrices string, closed boolean>>"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """The events of all pages of a folder; a page is a JSON array."""
    return spark.read.schema(EVENT).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)


def _read(market: Column, title: Column, first: Column, second: Column) -> Column:
    """What a market says: struct(first, second: prices where it is about the whole game; yes, asked: the price of Yes and the team it is about)."""
    open_ = ~F.coalesce(market["closed"], F.lit(False))

    def row(own: Column) -> Column:
        asked = F.lower(market["question"])
        teams = F.when(asked == F.lower(title), F.transform(own["n"], text.nickname_abbreviation))
        return F.when((F.size(own["n"]) == 2) & (F.size(own["p"]) > 0), F.struct(asked.alias("q"), own["n"].alias("n"), F.transform(own["p"], lambda p: p.try_cast("double")).alias("p"), teams.alias("t")))

    def said(own: Column) -> Column:
        # Of two outcomes that are the same team the last counts.
        of = lambda t: F.when(own["t"].isNotNull(), F.get(F.filter(F.reverse(F.arrays_zip(own["t"].alias("t"), own["p"].alias("p"))), lambda x: (x["t"] == t) & x["p"].isNotNull()), F.lit(0))["p"])
        place = F.array_position(F.transform(own["n"], F.lower), F.lit("yes"))
        yes = F.when(place > 0, F.get(own["p"], place.cast("int") - 1))
        return text.bound(yes, lambda y: F.struct(of(first).alias("first"), of(second).alias("second"), y.alias("yes"), F.when(y.isNotNull(), text.nickname_among(own["q"], first, second)).alias("asked")))

    lists = F.when(open_, F.struct(text.json_list(market["outcomes"]).alias("n"), text.json_list(market["outcomePrices"]).alias("p")))
    return text.bound(text.bound(lists, row), said)


def _step(state: Column, m: Column, first: Column, second: Column) -> Column:
    """The prices found so far, (p1, p2, done), and what another market adds."""
    new = lambda p1, p2, done: F.struct(p1.alias("p1"), p2.alias("p2"), done.alias("done"))
    whole = new(F.coalesce(m["first"], state["p1"]), F.coalesce(m["second"], state["p2"]), F.lit(True))
    alone = new(F.when(m["asked"] == first, m["yes"]).otherwise(state["p1"]), F.when(m["asked"] == second, m["yes"]).otherwise(state["p2"]), F.lit(False))
    return F.when(state["done"], state).when(m["first"].isNotNull() | m["second"].isNotNull(), whole).otherwise(alone)


def event_prices(events: DataFrame) -> DataFrame:
    """(event_title, event_slug, game_date, first, second, first_price, second_price) of single games with open markets and sane prices.

    Markets count in order. One whose question is the title has a price for each
    team and ends the search if it gives any; one with Yes and No is about the
    first team its question names. A missing side is inferred from the other.
    Events whose markets are all closed, and titles of other things, are left out.
    """
    once = lambda x: F.explode(F.array_compact(F.array(x)))  # nulls go; what follows uses the value, not the expression
    own = events.repartition(2 * events.sparkSession.sparkContext.defaultParallelism)  # small to read, much to compute
    own = own.where(text.is_game_title(F.col("title"))).withColumn("_t", once(text.title_teams(F.col("title"))))
    own = own.where((F.size("markets") > 0) & F.exists("markets", lambda m: ~F.coalesce(m["closed"], F.lit(False))))
    empty = F.struct(F.lit(None).cast("double").alias("p1"), F.lit(None).cast("double").alias("p2"), F.lit(False).alias("done"))
    own = own.withColumn("_m", once(F.transform("markets", lambda m: _read(m, F.col("title"), F.col("_t.first"), F.col("_t.second")))))
    own = own.withColumn("_p", once(F.aggregate("_m", empty, lambda s, m: _step(s, m, F.col("_t.first"), F.col("_t.second")))))
    first, second = F.coalesce(F.col("_p.p1"), 1 - F.col("_p.p2")), F.coalesce(F.col("_p.p2"), 1 - F.col("_p.p1"))
    out = own.select(F.col("title").alias("event_title"), F.col("slug").alias("event_slug"), text.slug_date(F.col("slug")).alias("game_date"), F.col("_t.first").alias("first"), F.col("_t.second").alias("second"), first.alias("first_price"), second.alias("second_price"))
    return out.where(bet.sane_prices(F.col("first_price"), F.col("second_price")))
