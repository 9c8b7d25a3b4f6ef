"""Odds snapshots as streams: exact import, tolerance filter, running movements."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import config
from ..operators.odds import GAME, earliest, latest
from ..scratch import written
from ..sources import snapshots

KEPT = "game_date date, home_team_id long, away_team_id long, source string, timestamp timestamp, id long, home_prob double, spread double, over_under double"


def import_stream(rows: DataFrame, teams: DataFrame, table: str, checkpoint: str):
    """Adds new lines of a stream of files to a table (see snapshots.snapshot_table), exactly once by natural key.

    A batch that runs again after a failure finds its keys stored, or stages them anew.
    """

    def add(batch: DataFrame, _: int) -> None:
        stored = snapshots.snapshot_table(batch.sparkSession, table)
        good = written(snapshots.checked(batch, teams).where("error is null"), "lines")
        version = stored.stage(snapshots.new_snapshots(good, stored.read(good)))
        if not stored.staged(version).isEmpty():
            stored.commit(version)

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_stream(rows: DataFrame, delay: str = "1 day") -> DataFrame:
    """Drops repeats of a natural key that come within the delay; state is bounded by it."""
    return rows.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(snapshots.KEY)


def _alike(last: tuple, row: tuple) -> bool:
    """Whether a row (at, id, home_prob, spread, over_under) repeats the last one kept, within the tolerances."""
    close = lambda a, b, tolerance: abs(a - b) <= tolerance if a is not None and b is not None else a is b
    return row[0] - last[0] <= HOURS_MS * config.DEDUP_HOURS * 1000 and all(map(close, last[2:], row[2:], (config.DEDUP_PROB, config.DEDUP_POINTS, config.DEDUP_POINTS)))


HOURS_MS = 3_600_000  # of an hour; times of rows are in microseconds
_VALUES = "at long, id long, home_prob double, spread double, over_under double"


class Moved(StatefulProcessor):
    """The tolerance filter of a game and source, over event time.

    Rows wait until the watermark has passed them, so that they are judged in the
    order (timestamp, id) however they came in; then the last one kept stays for
    DEDUP_HOURS, after which nothing can repeat it, and is dropped.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last, self.waiting = handle.getValueState("last", _VALUES), handle.getListState("waiting", _VALUES)
        self.columns = [f.split()[0] for f in KEPT.split(", ")]

    def handleInputRows(self, key, rows, timerValues):
        passed, fresh = timerValues.getCurrentWatermarkInMs(), []
        for pdf in rows:
            at = pdf["timestamp"].astype("datetime64[us]").astype("int64")
            fresh += [tuple(None if pd.isna(x) else x for x in r) for r in zip(at, pdf["id"], *(pdf[c].astype(float) for c in ("home_prob", "spread", "over_under")))]
        fresh = [(int(r[0]), int(r[1]), *r[2:]) for r in fresh if r[0] // 1000 > passed]  # others are late
        if fresh:
            self.waiting.appendList(fresh)
            self.handle.registerTimer(min(r[0] for r in fresh) // 1000 + 1)
        yield pd.DataFrame(columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed, waiting = timerValues.getCurrentWatermarkInMs(), sorted(tuple(r) for r in self.waiting.get())
        ready, rest = [r for r in waiting if r[0] // 1000 <= passed], [r for r in waiting if r[0] // 1000 > passed]
        last = tuple(self.last.get()) if self.last.exists() else None
        kept = []
        for r in ready:
            if last is None or not _alike(last, r):
                last = r
                kept.append((*key, pd.Timestamp(r[0], unit="us"), *r[1:]))
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        else:
            self.waiting.clear()
        ends = last[0] // 1000 + HOURS_MS * config.DEDUP_HOURS + 1 if last else 0
        if last and ends > passed:
            self.last.update(last)
            self.handle.registerTimer(ends)
        else:
            self.last.clear()
        yield pd.DataFrame(kept, columns=self.columns)

    def close(self) -> None:
        pass


def moved_stream(rows: DataFrame, delay: str = "1 day") -> DataFrame:
    """Rows that aren't repeats, within the tolerances, of the last one kept of their game and source.

    The same rows as moved_snapshots of all that isn't later than the delay; a
    row comes out once the watermark has passed it. State is kept in RocksDB, as
    this kind of operator asks; it holds rows within the delay and, of games
    that had any in the last DEDUP_HOURS before, one row.
    """
    key = [*GAME, "source"]
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own = rows.select(*key, "timestamp", "id", "home_prob", "spread", "over_under").withWatermark("timestamp", delay)
    return own.groupBy(*key).transformWithStateInPandas(Moved(), KEPT, "append", "EventTime")


def movement_stream(rows: DataFrame) -> DataFrame:
    """Running prob_movement and spread_movement of each game (update mode)."""
    every, espn = F.lit(True), F.col("source") == "espn"
    move = lambda v, w: F.coalesce(latest(v, w) - earliest(v, w), F.lit(0.0))
    return rows.groupBy(*GAME).agg(move("spread", espn).alias("spread_movement"), move("home_prob", every).alias("prob_movement"), F.count("*").alias("n_snapshots"))


def windowed_activity(rows: DataFrame, width: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Snapshots and mean probability of each source by event time, of a stream or of a table.

    Probabilities are added up as whole billionths, so that the mean doesn't
    depend on their order.
    """
    billion = 1_000_000_000
    parts = F.round(F.col("home_prob") * billion).cast("long")
    own = rows.withWatermark("timestamp", delay).groupBy(F.window("timestamp", width), "source").agg(F.count("*").alias("n"), F.sum(parts).alias("_s"), F.count(parts).alias("_k"))
    return own.select("window", "source", "n", (F.expr("_s div nullif(_k, 0)") / billion).alias("mean_prob"))
