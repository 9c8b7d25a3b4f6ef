"""Odds snapshots: lines, movements, matching and de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import moves

GAME = ["game_date", "home_team_id", "away_team_id"]


def _at() -> Column:
    """Order of snapshots; ids break ties of captures that share a time."""
    return F.struct("timestamp", "id")


def latest(value: str, when: Column) -> Column:
    return F.max_by(F.when(when, F.col(value)), F.when(when & F.col(value).isNotNull(), _at()))


def earliest(value: str, when: Column) -> Column:
    return F.min_by(F.when(when, F.col(value)), F.when(when & F.col(value).isNotNull(), _at()))


def line_movement(odds: DataFrame) -> DataFrame:
    """For each game: spread_movement, prob_movement, odds_disagreement; 0 where there is too little to tell."""
    espn, poly, every = F.col("source") == "espn", F.col("source") == "polymarket", F.lit(True)
    moved = lambda v, when: F.when(F.count(F.when(when, F.col(v))) >= 2, latest(v, when) - earliest(v, when)).otherwise(0.0)
    some = F.col("home_prob") != 0
    apart = F.abs(latest("home_prob", poly & some) - latest("home_prob", espn & some))
    return odds.where("game_date is not null").groupBy(*GAME).agg(
        moved("spread", espn).alias("spread_movement"),
        moved("home_prob", every).alias("prob_movement"),
        F.coalesce(apart, F.lit(0.0)).alias("odds_disagreement"),
    )


def movement_detail(odds: DataFrame) -> DataFrame:
    """line_movement with the number of snapshots and the opening and current lines."""
    espn, every = F.col("source") == "espn", F.lit(True)
    more = odds.groupBy(*GAME).agg(
        F.count("*").alias("n_snapshots"),
        earliest("home_prob", every).alias("opening_prob"),
        latest("home_prob", every).alias("current_prob"),
        earliest("spread", espn).alias("opening_spread"),
        latest("spread", espn).alias("current_spread"),
    )
    return more.join(line_movement(odds), GAME)


def _line(odds: DataFrame, pick) -> DataFrame:
    poly, espn = (pick("home_prob", F.col("source") == s) for s in ("polymarket", "espn"))
    both = odds.groupBy(*GAME).agg(poly.alias("_p"), espn.alias("_e"))
    source = F.when(F.col("_p").isNotNull(), "polymarket").otherwise("espn")
    return both.where("_p is not null or _e is not null").select(*GAME, F.coalesce("_p", "_e").alias("home_prob"), source.alias("source"))


def closing_line(odds: DataFrame, tipoffs: DataFrame | None = None) -> DataFrame:
    """The last probability of each game, of the prediction market where it has one, else of the sportsbook.

    With tipoffs (the key of a game and its start, ``tipoff``) later snapshots don't count.
    """
    if tipoffs is not None:
        odds = odds.join(tipoffs, GAME).where(F.col("timestamp") <= F.col("tipoff"))
    return _line(odds, latest)


def opening_line(odds: DataFrame) -> DataFrame:
    """The first probability of each game, with the same preference."""
    return _line(odds, earliest)


def distinct_snapshots(odds: DataFrame) -> DataFrame:
    """One snapshot, the first, for each natural key."""
    return odds.groupBy(*GAME, "source", "timestamp").agg(F.min_by(F.struct("id", "home_prob", "spread", "over_under"), F.col("id")).alias("r")).select(*GAME, "source", "timestamp", "r.*")


def moved_snapshots(odds: DataFrame) -> DataFrame:
    """Snapshots that aren't repeats of the last one kept of the same game and source (see moves.moved_snapshots)."""
    return moves.moved_snapshots(odds, GAME)


def match_games(slate: DataFrame, odds: DataFrame) -> DataFrame:
    """Left join of games (home, away, et_date) with odds of their unordered pair (team_a, team_b, game_date, ...).

    Odds of the game's date are taken, the first by ``ordinal`` if several; else
    a pair's only odds, if they have no date; else none.
    """
    pair = lambda a, b: F.array_sort(F.array(a, b))
    own = odds.withColumn("_pair", pair("team_a", "team_b"))
    whole = Window.partitionBy("_pair")
    own = own.withColumn("_n", F.count("*").over(whole)).withColumn("_k", F.row_number().over(Window.partitionBy("_pair", "game_date").orderBy("ordinal")))
    own = own.where("_k = 1 and (game_date is not null or _n = 1)").drop("_k", "_n").withColumnRenamed("game_date", "odds_date")
    games = slate.withColumn("_pair", pair("home", "away"))
    dated = own.where("odds_date is not null").withColumnRenamed("odds_date", "et_date")
    lone = own.where("odds_date is null").drop("odds_date")
    values = [c for c in odds.columns if c not in ("team_a", "team_b", "game_date")]
    first = games.join(dated.select("_pair", "et_date", F.struct(*values).alias("_d")), ["_pair", "et_date"], "left")
    both = first.join(lone.select("_pair", F.struct(*values).alias("_l")), "_pair", "left").withColumn("_o", F.coalesce("_d", "_l"))
    return both.select(*slate.columns, *(F.col("_o")[c].alias(c) for c in values))


def last_by_pair(odds: DataFrame) -> DataFrame:
    """The last odds (by ordinal) of each unordered pair."""
    pair = F.array_sort(F.array("team_a", "team_b"))
    return odds.groupBy(pair.alias("pair")).agg(F.max_by(F.struct(*odds.columns), F.col("ordinal")).alias("r")).select("r.*")


def readiness_counts(odds: DataFrame, injuries: DataFrame) -> DataFrame:
    """For each stream of data: rows, days seen and how far it is ready for use."""
    from ..functions.betting import readiness

    a = odds.groupBy(F.col("source").alias("stream")).agg(F.count("*").alias("n_rows"), F.countDistinct("game_date").alias("n_days"))
    b = injuries.agg(F.lit("injuries").alias("stream"), F.count("*").alias("n_rows"), F.countDistinct("snapshot_date").alias("n_days"))
    return a.unionByName(b).withColumn("tier", readiness(F.col("n_days")))
