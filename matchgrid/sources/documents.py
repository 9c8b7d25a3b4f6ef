"""Nested documents of a score feed laid flat: injury reports, rosters and summaries of games.

Schemas name only what is used. Missing parts give the defaults that each function states;
a document without entries gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text

INJURIES = "injuries array<struct<id string, displayName string, injuries array<struct<athlete struct<id string, displayName string>, status string, longComment string, shortComment string, date string>>>>"
ROSTER = (
    "athletes array<struct<id string, displayName string, position struct<abbreviation string>, jersey string, height double, weight double, age int, "
    "experience struct<years int>, contract struct<salary double>, status struct<name string>>>"
)
SUMMARY = (
    "pickcenter array<struct<provider struct<name string>, spread string, overUnder string, homeTeamOdds struct<moneyLine string>, awayTeamOdds struct<moneyLine string>>>, "
    "againstTheSpread array<struct<team struct<abbreviation string>, records array<struct<type string, summary string>>>>, "
    "header struct<competitions array<struct<series array<struct<type string, title string, summary string>>>>>"
)


def parsed(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """Rows with the fields of a JSON text in place of it; broken JSON has null fields."""
    return rows.withColumn("_d", F.from_json(column, schema)).select(*(c for c in rows.columns if c != column), "_d.*")


def flat_injuries(docs: DataFrame, teams: DataFrame) -> DataFrame:
    """A row for each reported player: player_name, player_id, team_abbr, status (``Unknown`` if missing), description, reported (its date).

    teams: feed_id, name and abbreviation of a league. A team goes by its id, else
    by its name; one that is neither has an empty abbreviation. The description is
    the long comment, else the short one.
    """
    entry = docs.select(F.explode("injuries").alias("t")).select(F.col("t.id").try_cast("long").alias("_id"), F.col("t.displayName").alias("_name"), F.explode("t.injuries").alias("i"))
    by = lambda key, name, out: F.broadcast(teams.groupBy(F.col(key).alias(name)).agg(F.min("abbreviation").alias(out)))  # a league's teams
    out = entry.join(by("feed_id", "_id", "_a"), "_id", "left").join(by("name", "_name", "_b"), "_name", "left")
    kept = lambda c, default="": F.coalesce(c, F.lit(default))
    return out.select(
        kept(F.col("i.athlete.displayName")).alias("player_name"), kept(F.col("i.athlete.id")).alias("player_id"), F.coalesce("_a", "_b", F.lit("")).alias("team_abbr"), kept(F.col("i.status"), "Unknown").alias("status"),
        F.coalesce("i.longComment", "i.shortComment", F.lit("")).alias("description"), kept(F.col("i.date")).alias("reported"),
    )


def flat_roster(docs: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each player, with columns of the document to keep: numbers that are missing are 0, texts empty, the status ``Active``."""
    a = docs.select(*keep, F.explode("athletes").alias("a"))
    word, number = (lambda c, default="": F.coalesce(F.col(c), F.lit(default))), (lambda c: F.coalesce(F.col(c), F.lit(0)))
    return a.select(
        *keep, word("a.displayName").alias("name"), word("a.id").alias("player_id"), word("a.position.abbreviation").alias("position"), word("a.jersey").alias("jersey"), number("a.height").alias("height"), number("a.weight").alias("weight"),
        number("a.age").alias("age"), number("a.experience.years").alias("experience"), number("a.contract.salary").alias("salary"), word("a.status.name", "Active").alias("status"),
    )


def _spread_record(entries: Column, place: int) -> Column:
    """What the first record of a team against the spread says."""
    return F.get(F.get(entries, F.lit(place))["records"], F.lit(0))["summary"]


def flat_summary(docs: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each document: the first provider's lines, how many there are, both teams' first record against the spread, and the last season series."""
    pick, sides = F.get("pickcenter", F.lit(0)), F.col("againstTheSpread")
    series = F.get(F.element_at(F.filter("header.competitions", lambda c: c["series"].isNotNull()), -1)["series"], F.lit(0))
    some = F.when(F.size(F.filter("header.competitions", lambda c: c["series"].isNotNull())) > 0, series["summary"])
    return docs.select(
        *keep, F.greatest(F.coalesce(F.size("pickcenter"), F.lit(0)), F.lit(0)).alias("n_providers"), pick["provider"]["name"].alias("provider"), text.number(pick["spread"]).alias("spread"), text.number(pick["overUnder"]).alias("over_under"),
        text.number(pick["homeTeamOdds"]["moneyLine"]).alias("home_moneyline"), text.number(pick["awayTeamOdds"]["moneyLine"]).alias("away_moneyline"),
        _spread_record(sides, 0).alias("first_against_spread"), _spread_record(sides, 1).alias("second_against_spread"), some.alias("season_series"),
    )
