"""Append-only odds files: one JSON object a line, a file for each UTC day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import text
from ..scratch import written
from .versioned import VersionedTable

#: All fields are read as strings, so that only broken JSON counts as such; numbers are cast afterwards.
FIELDS = ("game_date", "home_team_abbr", "away_team_abbr", "source", "timestamp", "home_prob", "spread", "over_under", "game_id")
SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in FIELDS] + [T.StructField("_corrupt_record", T.StringType())])
SOURCES = ("polymarket", "espn")
KEY = ["game_date", "home_team_id", "away_team_id", "source", "timestamp"]


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a file, or of the files of a folder, with where they come from."""
    reader = spark.read.schema(SCHEMA).option("mode", "PERMISSIVE").option("pathGlobFilter", "*.jsonl")
    return reader.json(path).withColumn("file", F.col("_metadata.file_name"))


def stream_snapshots(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """The same as a stream of new files."""
    reader = spark.readStream.schema(SCHEMA).option("pathGlobFilter", "*.jsonl").option("maxFilesPerTrigger", files_at_once)
    return reader.json(path)


def checked(rows: DataFrame, teams: DataFrame) -> DataFrame:
    """Adds typed columns and ``error``: null, or why a line can't be used, by the first reason that holds."""
    dim = teams.select(F.col("abbreviation"), F.col("id"))
    side = lambda s: F.broadcast(dim.withColumnRenamed("abbreviation", f"{s}_team_abbr").withColumnRenamed("id", f"{s}_team_id"))  # a league's teams
    own = rows.join(side("home"), "home_team_abbr", "left").join(side("away"), "away_team_abbr", "left")
    day, at = text.date_prefix(F.col("game_date")), text.naive_utc(F.col("timestamp"))
    error = (
        F.when(F.col("_corrupt_record").isNotNull(), "bad_json")
        .when(F.col("home_team_id").isNull() | F.col("away_team_id").isNull(), "unknown_team")
        .when(day.isNull() | at.isNull(), "bad_date")
        .when(~F.coalesce(F.col("source").isin(*SOURCES), F.lit(False)), "unknown_source")
    )
    values = {c: text.number(F.col(c)) for c in ("home_prob", "spread", "over_under")}
    return own.withColumn("error", error).withColumns({"game_date": day, "timestamp": at, **values, "game_id": F.nullif("game_id", F.lit(""))})


def in_order(lines: DataFrame) -> DataFrame:
    """Adds ``place`` to lines as read: their order by file, and within it by position."""
    return lines.withColumn("place", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row")))


def new_snapshots(good: DataFrame, stored: DataFrame) -> DataFrame:
    """Of usable lines those whose natural key isn't stored; of a repeated key the first by ``place``, if lines have one.

    Without places the first is the least by its values.
    """
    values = ["home_prob", "spread", "over_under", "game_id"]
    order = F.col("place") if "place" in good.columns else F.struct(*values)
    first = good.groupBy(*KEY).agg(F.min_by(F.struct(*values), order).alias("_v")).select(*KEY, "_v.*")
    return first.join(stored.select(*KEY), KEY, "left_anti")


STORED = "game_date date, home_team_id long, away_team_id long, source string, timestamp timestamp, home_prob double, spread double, over_under double, game_id string"


def snapshot_table(spark: SparkSession, path: str) -> VersionedTable:
    return VersionedTable(spark, path, STORED, ["game_date"])


def import_snapshots(spark: SparkSession, path: str, teams: DataFrame, table: str) -> dict[str, int]:
    """Adds a file or folder to a table (see snapshot_table), once however often it is run; returns counters.

    Keys are compared with the stored rows of the dates at hand only. New rows
    are staged and appear in one commit: a killed import leaves nothing behind.
    """
    lines = spark.read.schema(SCHEMA).option("mode", "PERMISSIVE").option("pathGlobFilter", "*.jsonl").json(path)
    rows = written(checked(in_order(lines), teams), "lines")
    stored, good = snapshot_table(spark, table), rows.where("error is null")
    version = stored.stage(new_snapshots(good, stored.read(good)))
    counts = rows.agg(F.countDistinct("place.file").alias("files"), F.count("*").alias("records"), F.count("error").alias("errors")).first().asDict()
    counts["imported"] = stored.staged(version).count()
    counts["skipped"] = counts["records"] - counts["errors"] - counts["imported"]
    if counts["imported"]:
        stored.commit(version)
    return counts


def append_snapshots(rows: DataFrame, path: str) -> None:
    """Appends lines under the UTC day of their capture; without rows nothing is written."""
    if not rows.isEmpty():
        day = F.to_date("timestamp")
        rows.withColumn("utc_day", day).write.mode("append").partitionBy("utc_day").option("ignoreNullFields", "false").json(path)


def replace_day(rows: DataFrame, path: str) -> None:
    """Writes reports so that each snapshot_date in rows replaces what was stored for it."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date").parquet(path)


def with_columns_of(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """rows with every column of a schema: missing ones are null (additive migration)."""
    return rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in rows.columns})


def new_games(log: DataFrame, games: DataFrame) -> DataFrame:
    """Games of a team log (a row for each team) that aren't stored and have exactly one home and one away row."""
    home, away = F.contains(F.col("matchup"), F.lit("vs.")), F.contains(F.col("matchup"), F.lit("@"))
    pick = lambda when, c: F.max(F.when(when, F.col(c)))
    rows = log.join(games.select(F.col("id").alias("game_id")), "game_id", "left_anti").groupBy("game_id")
    out = rows.agg(
        F.count("*").alias("_n"), F.count(F.when(home, 1)).alias("_h"), F.count(F.when(away, 1)).alias("_a"), F.max("date").alias("date"), F.max("season").alias("season"),
        pick(home, "team_id").alias("home_team_id"), pick(away, "team_id").alias("away_team_id"), pick(home, "pts").alias("home_score"), pick(away, "pts").alias("away_score"),
    )
    return out.where("_n = 2 and _h = 1 and _a = 1").drop("_n", "_h", "_a").withColumn("home_win", F.col("home_score") > F.col("away_score"))


def first_busy_day(schedule: DataFrame, today: str, days: int = 7) -> DataFrame:
    """Games of the first day from today on, within a number of days, that has any."""
    window = schedule.where((F.col("date") >= F.lit(today).cast("date")) & (F.datediff("date", F.lit(today).cast("date")) <= days))
    return window.join(F.broadcast(window.agg(F.min("date").alias("date"))), "date", "left_semi")


def flat_scoreboard(events: DataFrame) -> DataFrame:
    """Rows of a nested scoreboard document: events<id, date, competitions<competitors<homeAway, score, team<abbreviation>>, odds<details, spread, overUnder>>>."""
    game = events.select(F.explode("events").alias("e")).select("e.id", "e.date", F.get("e.competitions", F.lit(0)).alias("c"))
    side = lambda s: F.get(F.filter("c.competitors", lambda x: x["homeAway"] == s), F.lit(0))
    odds = F.get("c.odds", F.lit(0))
    return game.select(
        F.col("id").alias("event_id"), F.col("date").alias("game_time_utc"), text.feed_abbreviation(side("home")["team"]["abbreviation"]).alias("home"), text.feed_abbreviation(side("away")["team"]["abbreviation"]).alias("away"),
        text.number(side("home")["score"]).alias("home_score"), text.number(side("away")["score"]).alias("away_score"), text.number(odds["spread"]).alias("spread"), text.number(odds["overUnder"]).alias("over_under"),
    )


def read_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON document that is a list of records."""
    return spark.read.schema(schema).option("multiLine", True).json(path)
