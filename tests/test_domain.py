"""Scalar rules, windows, ratings, odds, metrics and simulations on small tables."""

import datetime as dt
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F, types as T

from matchgrid import config
from matchgrid.functions import basketball as bb, betting as bet, text
from matchgrid.operators import injuries as inj, metrics as mt, models, odds as od, ratings, simulation as sim, windows as wn
from matchgrid.plans import features as ft, recommend as rec
from matchgrid.sources import markets, snapshots as sn
from matchgrid.sources.fixtures import view
from matchgrid.sources.versioned import VersionedTable
from matchgrid.streaming import odds as stream

SF = "/root/testdata/sf0.001"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(*xs):
    return [F.lit(x) for x in xs]


def test_shrink(spark):
    assert value(spark, bet.shrink(*lit(0.7, 0.55), 0.0)) == pytest.approx(0.7)
    assert value(spark, bet.shrink(*lit(0.7, 0.55), 1.0)) == pytest.approx(0.55)
    assert 0.55 < value(spark, bet.shrink(*lit(0.7, 0.55), 0.5)) < 0.7
    assert value(spark, bet.shrink(*lit(0.7, 1.0))) == value(spark, bet.shrink(*lit(0.7, 0.0))) == 0.7


def test_sizing(spark):
    assert value(spark, bet.kelly(*lit(0.5, 0.6))) == 0 and value(spark, bet.kelly(*lit(0.6, 1.0))) == 0
    assert value(spark, bet.kelly(*lit(0.9, 0.5))) == config.MAX_BET
    assert value(spark, bet.kelly(*lit(0.55, 0.5))) == pytest.approx(0.25 * 0.1)
    bad, none, good = (value(spark, bet.signal_fraction(F.lit(0.05), F.lit(t) if t is not None else None)) for t in (-2.0, None, 2.0))
    assert bad < none <= good <= 1.25 * config.KELLY_FRACTION
    assert [value(spark, bet.drawdown_multiplier(F.lit(n), F.lit(r))) for n, r in ((9, 0.02), (9, -0.03), (9, -0.07), (9, -0.12), (3, -0.5))] == [1, 1, 0.5, 0.25, 1]
    assert value(spark, bet.haircut(F.lit(4))) == pytest.approx(1 / math.sqrt(1.45)) and value(spark, bet.haircut(F.lit(1))) == 1


def test_picks(spark):
    pick = lambda m, s: value(spark, bet.spread_pick(*lit(m, s, "LAL", "BOS")))
    assert [pick(7.0, -4.0), pick(1.0, -5.0), pick(-3.5, 3.0)] == ["LAL -4.0", "BOS +5.0", "NO BET"]
    assert value(spark, bet.total_pick(*lit(230.0, 220.0))) == "OVER 220.0"
    assert [value(spark, bet.badge(F.lit(e))) for e in (0.2, 0.06, 0.03, 0.02, 0.0)] == ["SUSPECT", "STRONG", "MODERATE", "LEAN", "NO BET"]
    side = lambda *x: value(spark, bet.bet_side(*lit(*x)))
    assert [side(0.1, 0.05, 0.6, 0.4), side(0.1, 0.05, 0.2, 0.8), side(0.01, 0.0, 0.6, 0.4)] == ["HOME", "AWAY", "NO BET"]


def test_prices(spark):
    null = F.lit(None).cast("double")
    assert value(spark, bet.devig(*lit(-150.0, 130.0), null)) == pytest.approx(0.6 / (0.6 + 100 / 230))
    assert value(spark, bet.devig(null, F.lit(100.0), null)) == 0.5 and value(spark, bet.devig(null, null, F.lit(-4.0))) == pytest.approx(0.6)
    assert value(spark, bet.devig(null, null, null)) is None
    assert value(spark, bet.sane_prices(*lit(0.6, 0.42))) and not value(spark, bet.sane_prices(*lit(0.6, 0.5))) and not value(spark, bet.sane_prices(null, F.lit(0.5)))
    assert value(spark, bet.profit(*lit("AWAY", False, 0.75, 10.0))) == pytest.approx(30) and value(spark, bet.profit(*lit("HOME", False, 0.75, 10.0))) == -10
    assert value(spark, bet.closing_value(F.lit("HOME"), null, *lit(0.66, 0.6))) == pytest.approx(0.1)


def test_ratings_formulas(spark):
    f = lambda a, b: value(spark, bb.opponent_factor(*lit(a, b)))
    assert f(1500.0, 1500.0) == 0.5 and f(1700.0, 1300.0) < 0.2 and f(1300.0, 1700.0) > 0.8
    r = ratings.Ratings()
    (h0, h1), (a0, a1) = r.play(2024, 1, 2, 130, 100)
    assert h1[1] > h0[1] and a1[2] < a0[2] and h1[0] > h0[0] and h1[0] + a1[0] == pytest.approx(3000)
    r.play(2025, 3, 4, 100, 90)
    assert r.teams[1][0] == pytest.approx(1500 + 0.75 * (h1[0] - 1500))
    assert value(spark, bb.pythagorean(F.lit(None).cast("double"), F.lit(1.0))) == 0.5 and value(spark, bb.pythagorean(*lit(5.0, 0.0))) == 0.99
    assert value(spark, bb.possessions(*lit(None, 1, 1, 1))) is None and value(spark, bb.season_label(F.lit(2025))) == "2025-26"


def test_elo_history_is_the_fold_in_order(spark):
    games = view(spark, SF, "games")
    got = {(r["game_id"], r["team_id"]): r["elo_after"] for r in ratings.elo_history(games).collect()}
    own = ratings.Ratings()
    for g in sorted(games.collect(), key=lambda g: (g["date"], g["id"])):
        (_, h), (_, a) = own.play(g["season"], g["home_team_id"], g["away_team_id"], g["home_score"], g["away_score"])
        assert got[g["id"], g["home_team_id"]] == h[0] and got[g["id"], g["away_team_id"]] == a[0]
    assert len(got) == 2 * games.count() and ratings.leaderboard(ratings.elo_history(games)).count() == 25


@pytest.mark.parametrize("size", [wn.RANGE, 40])
def test_windows_match_pandas(spark, monkeypatch, size):
    """With 40, the rows of a team lie in several ranges, and means over 20 rows reach into those before."""
    if size == 40:
        monkeypatch.setattr(wn, "RANGE", 40)
        monkeypatch.setattr(wn, "HALO", 20)
    rows = wn.with_rest(wn.with_back_to_back_shooting(wn.with_venue_splits(wn.with_weighted(wn.with_rolling(wn.with_derived(view(spark, SF, "game_stats")), ["fg3_pct"]), ["fg3_pct"]))))
    pdf = rows.toPandas().sort_values(["team_id", "date", "game_id"])
    for _, t in pdf.groupby("team_id"):
        x = t["fg3_pct"].astype(float).reset_index(drop=True)
        for n in config.WINDOWS:
            np.testing.assert_allclose(t[f"fg3_pct_roll_{n}"].astype(float), x.shift(1).rolling(n, min_periods=n // 2).mean(), rtol=1e-9)
        np.testing.assert_allclose(t["fg3_pct_ewm_10"].astype(float), x.shift(1).ewm(halflife=10, min_periods=2).mean(), rtol=1e-9)
        gap = pd.to_datetime(t["date"]).reset_index(drop=True).diff().dt.days
        np.testing.assert_allclose(t["fg3_pct_b2b_roll_5"].astype(float), x.where(gap <= 1).shift(1).rolling(5, min_periods=2).mean().ffill(), rtol=1e-9)
        home = t["plus_minus"].astype(float).where(t["is_home"]).reset_index(drop=True)
        np.testing.assert_allclose(t["plus_minus_home_split_roll_10"].astype(float), home.shift(1).rolling(10, min_periods=3).mean().ffill(), rtol=1e-9)
        assert t["rest_days"].tolist() == [3] + [min(int(g), 7) for g in gap[1:]]
        days = pd.to_datetime(t["date"]).tolist()
        assert t["games_last_7"].tolist() == [sum((d - e).days <= 7 for e in days[:i]) for i, d in enumerate(days)]


def test_ranges_carry_what_the_halo_does_not_hold(spark, monkeypatch):
    monkeypatch.setattr(wn, "RANGE", 40)
    monkeypatch.setattr(wn, "HALO", 20)
    day = "date_add(date '2000-01-01', cast(id as int))"
    rows = spark.range(400).selectExpr("id as game_id", "if(id % 4 = 0, null, 1L) as team_id", f"{day} as date", "id % 2 = 0 as is_home", "if(id > 30 and id < 330, null, cast(id % 7 as double)) as plus_minus", "0.0 as net_rtg_game", "cast(null as double) as fg3_pct")
    got = wn.with_venue_splits(rows).toPandas().sort_values(["game_id"])
    for _, t in got.groupby("team_id", dropna=False):
        x = t["plus_minus"].where(~t["is_home"]).reset_index(drop=True)
        np.testing.assert_allclose(t["plus_minus_away_split_roll_10"].astype(float), x.shift(1).rolling(10, min_periods=3).mean().ffill(), rtol=1e-9)
    few = rows.withColumn("x", F.expr("if(game_id in (1, 2), 5.0, if(game_id > 350, game_id, null))"))
    ewm = wn.with_weighted(few, ["x"], half_life=0.5).where("team_id = 1").orderBy("game_id").toPandas()
    want = ewm["x"].astype(float).shift(1).ewm(halflife=0.5, min_periods=2, ignore_na=False).mean()
    late = ewm["game_id"] > 355
    np.testing.assert_allclose(ewm["x_ewm_0.5"][late].astype(float), want[late], rtol=1e-9)
    one = ewm[ewm["game_id"] == 353].iloc[0]  # two rows at the start and one just before count as three
    assert one["x_ewm_0.5"] == pytest.approx(351.0)


def test_no_partition_holds_a_whole_history(spark, monkeypatch):
    monkeypatch.setattr(wn, "RANGE", 1000)
    monkeypatch.setattr(wn, "HALO", 100)
    rows = spark.range(50_000).selectExpr("id as game_id", "1L as team_id", "date_add(date '2000-01-01', cast(id div 5 as int)) as date", "cast(id % 11 as double) as x")
    spread = wn.ranged(rows)
    sizes = spread.groupBy("_range").count().orderBy("_range").collect()
    assert len(sizes) == 51 and max(r["count"] for r in sizes) == 1100 and sum(r["count"] for r in sizes) == 50_000 + 50 * 100
    got = wn.with_rolling(rows, ["x"]).orderBy("game_id").toPandas()
    np.testing.assert_allclose(got["x_roll_20"], got["x"].shift(1).rolling(20, min_periods=10).mean(), rtol=1e-12)


def test_weights_of_long_histories(spark):
    rows = spark.range(2000).selectExpr("id as game_id", "1L as team_id", "date_add(date '2000-01-01', cast(id as int)) as date", "cast(id % 7 as double) as x")
    got = wn.with_weighted(rows, ["x"]).orderBy("game_id").toPandas()
    np.testing.assert_allclose(got["x_ewm_10"], got["x"].shift(1).ewm(halflife=10, min_periods=2).mean(), rtol=1e-12)
    short = wn.with_weighted(rows, ["x"], half_life=0.5).orderBy("game_id").toPandas()  # ranges of 480 rows
    np.testing.assert_allclose(short["x_ewm_0.5"], got["x"].shift(1).ewm(halflife=0.5, min_periods=2).mean(), rtol=1e-12)


def test_opponent_rebounds(spark):
    rows = spark.createDataFrame([("g", 1, 10, 30), ("g", 2, 12, 28), ("k", 3, 8, 32), ("k", 4, 9, 27)], "game_id string, team_id long, oreb int, dreb int")
    got = {r["team_id"]: r["opp_dreb"] for r in wn.with_rebounds(rows).collect()}
    assert got == {1: 28, 2: 30, 3: 27, 4: 32}


ODDS = "id long, game_date date, home_team_id long, away_team_id long, source string, timestamp timestamp, home_prob double, spread double, over_under double"


def odds(spark, *rows):
    t0, day = dt.datetime(2026, 4, 22, 12), dt.date(2026, 4, 22)
    return spark.createDataFrame([(i, day, 1, 2, s, t0 + dt.timedelta(hours=h), p, x, None) for i, (s, h, p, x) in enumerate(rows)], ODDS)


def test_tolerance_dedup(spark):
    rows = odds(spark, ("espn", 0, 0.6, 1.0), ("espn", 1, 0.601, 1.0), ("espn", 2, 0.604, 1.0), ("espn", 3, 0.607, 1.0), ("espn", 9, 0.607, 1.0), ("polymarket", 1, 0.6, None), ("polymarket", 2, None, None))
    assert sorted(r["id"] for r in od.moved_snapshots(rows).collect()) == [0, 3, 4, 5, 6]


def test_lines(spark):
    rows = odds(spark, ("espn", 0, 0.5, 1.0), ("espn", 2, 0.6, 3.0), ("polymarket", 1, 0.55, None), ("polymarket", 3, None, None))
    m = od.line_movement(rows).first()
    assert (m["spread_movement"], round(m["prob_movement"], 9), round(m["odds_disagreement"], 9)) == (2.0, 0.1, 0.05)
    assert od.closing_line(rows).first()["home_prob"] == 0.55 and od.opening_line(rows.where("source = 'espn'")).first()["home_prob"] == 0.5
    start = spark.createDataFrame([(dt.date(2026, 4, 22), 1, 2, dt.datetime(2026, 4, 22, 12, 30))], "game_date date, home_team_id long, away_team_id long, tipoff timestamp")
    assert od.closing_line(rows.where("source = 'espn'"), start).first()["home_prob"] == 0.5


def test_matching_by_date(spark):
    slate = spark.createDataFrame([("DET", "ORL", "2026-04-22"), ("BOS", "LAL", "2026-04-22"), ("MIA", "NYK", "2026-04-22")], "home string, away string, et_date string")
    rows = [("ORL", "DET", "2026-04-22", 1, 0.785), ("DET", "ORL", "2026-04-27", 2, 0.645), ("LAL", "BOS", None, 3, 0.4), ("MIA", "NYK", "2026-04-25", 4, 0.1)]
    got = od.match_games(slate, spark.createDataFrame(rows, "team_a string, team_b string, game_date string, ordinal int, price double"))
    assert {r["home"]: r["price"] for r in got.collect()} == {"DET": 0.785, "BOS": 0.4, "MIA": None}
    assert od.last_by_pair(spark.createDataFrame(rows, "team_a string, team_b string, game_date string, ordinal int, price double")).count() == 3


def test_text_rules(spark):
    teams = lambda t: value(spark, text.title_teams(F.lit(t)))
    assert tuple(teams("Bulls vs. Wizards")) == ("CHI", "WAS") and tuple(teams("Portland Trail Blazers vs Timberwolves tonight")) == ("POR", "MIN")
    assert teams("Bulls at Wizards") is None and teams("Bulls vs Bulls") is None
    assert value(spark, text.is_game_title(F.lit("A vs B"))) and not value(spark, text.is_game_title(F.lit("MVP: A vs B")))
    assert value(spark, text.slug_date(F.lit("game-orl-det-2026-04-22"))) == "2026-04-22" and value(spark, text.slug_date(F.lit("x"))) is None
    assert [value(spark, text.eastern_date(F.lit(t))) for t in ("2026-04-22T02:00:00Z", "2026-04-22T12:00:00", "x", None)] == ["2026-04-21", "2026-04-22", None, None]
    assert len({value(spark, text.naive_utc(F.lit(t))) for t in ("2026-04-22T12:00:00Z", "2026-04-22T12:00:00+00:00", "2026-04-22T12:00:00", "2026-04-22T14:00:00+02:00")}) == 1
    assert value(spark, text.feed_abbreviation(F.lit("GS"))) == "GSW" and value(spark, text.feed_abbreviation(F.lit("BOS"))) == "BOS"
    assert [tuple(x) for x in value(spark, text.outcome_prices(F.lit('["Yes","No"]'), F.lit('["0.6","x"]')))] == [("Yes", 0.6)]


GOOD = {"game_date": "2026-04-22", "home_team_abbr": "BOS", "away_team_abbr": "LAL", "source": "espn", "timestamp": "2026-04-21T12:00:00Z", "home_prob": 0.6, "spread": None, "over_under": None, "game_id": None}


def test_import_is_idempotent(spark, tmp_path):
    teams = spark.createDataFrame([(1, "BOS"), (2, "LAL")], "id long, abbreviation string")
    lines = [json.dumps(GOOD), json.dumps(GOOD | {"source": "polymarket"}), "{bad", json.dumps(GOOD | {"home_team_abbr": "XXX"}), json.dumps(GOOD | {"source": "other"}), json.dumps(GOOD | {"timestamp": "x"}), ""]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "2026-04-21.jsonl").write_text("\n".join(lines))
    table = str(tmp_path / "table")
    assert sn.import_snapshots(spark, str(tmp_path / "in"), teams, table) == {"files": 1, "records": 6, "errors": 4, "imported": 2, "skipped": 0}
    assert sn.import_snapshots(spark, str(tmp_path / "in"), teams, table) == {"files": 1, "records": 6, "errors": 4, "imported": 0, "skipped": 2}
    errors = sn.checked(sn.read_snapshots(spark, str(tmp_path / "in")), teams).select("error").where("error is not null").collect()
    assert sorted(r["error"] for r in errors) == ["bad_date", "bad_json", "unknown_source", "unknown_team"]
    stored = str(tmp_path / "streamed")
    for _ in range(2):
        stream.import_stream(sn.stream_snapshots(spark, str(tmp_path / "in")), teams, stored, str(tmp_path / "check")).awaitTermination(60)
    assert sn.snapshot_table(spark, stored).read().count() == 2


def test_import_keeps_the_first_line_of_a_key(spark, tmp_path, monkeypatch):
    teams = spark.createDataFrame([(1, "BOS"), (2, "LAL")], "id long, abbreviation string")
    (tmp_path / "in").mkdir()
    for name, probs in (("a", [0.9, 0.1, 0.5]), ("b", [0.2])):
        (tmp_path / "in" / f"2026-04-21{name}.jsonl").write_text("\n".join(json.dumps(GOOD | {"home_prob": p}) for p in probs))
    table = str(tmp_path / "table")
    run = lambda: sn.import_snapshots(spark, str(tmp_path / "in"), teams, table)
    stored = sn.snapshot_table(spark, table)
    commit = VersionedTable.commit
    monkeypatch.setattr(VersionedTable, "commit", lambda *_, **__: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        run()
    assert stored.read().count() == 0  # staged, but in no commit
    monkeypatch.setattr(VersionedTable, "commit", commit)
    assert run()["imported"] == 1 and run() == {"files": 2, "records": 4, "errors": 0, "imported": 0, "skipped": 4}
    assert [r["home_prob"] for r in stored.read().collect()] == [0.9]
    (tmp_path / "in" / "2026-04-22.jsonl").write_text(json.dumps(GOOD | {"game_date": "2026-04-23", "home_prob": 0.3}))
    assert run()["imported"] == 1 and {r["home_prob"] for r in stored.read().collect()} == {0.9, 0.3}
    one = spark.createDataFrame([(dt.date(2026, 4, 23),)], "game_date date")
    assert [r["home_prob"] for r in stored.read(one).collect()] == [0.3]


def test_versioned_partitions(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), "k string, x int", ["k"])
    rows = lambda *v: spark.createDataFrame(list(v), "k string, x int")
    seen = lambda: sorted(tuple(r) for r in t.read().collect())
    assert seen() == [] and t.commit(t.stage(rows(("a", 1), ("b", 2)))) == 1
    assert t.commit(t.stage(rows(("a", 3)))) == 2 and seen() == [("a", 1), ("a", 3), ("b", 2)]
    waiting = t.stage(rows(("a", 9)))
    assert seen() == [("a", 1), ("a", 3), ("b", 2)]
    t.commit(waiting, replaces=True, dropped=rows(("a", 0), ("b", 0)))
    assert seen() == [("a", 9)]
    t.commit(t.stage(rows(("b", 5))))
    assert seen() == [("a", 9), ("b", 5)]


def test_ratings_resume(spark, tmp_path, monkeypatch):
    games = view(spark, SF, "games").withColumn("lg", F.when(F.col("home_team_id") < 12, "east").otherwise("west"))
    whole = {(r["league"], r["game_id"], r["team_id"]): tuple(r)[3:] for lg in ("east", "west") for r in ratings.elo_history(games.where(F.col("lg") == lg)).select(F.lit(lg).alias("league"), "game_id", "team_id", "date", *ratings._COLUMNS).collect()}
    store = ratings.rating_store(spark, str(tmp_path / "ratings"))
    got = lambda: {(r["league"], r["game_id"], r["team_id"]): tuple(r)[3:] for r in ratings.stored_history(store).collect()}
    late = F.col("id") % 97 == 5
    early = games.where((F.col("date") < "1996-01-01") & ~late)
    first = ratings.sync_ratings(store, early.withColumn("home_score", F.when(F.col("id") % 101 == 3, 150).otherwise(F.col("home_score"))), "lg")
    assert first["fresh"] == first["rated"] == early.count()
    assert ratings.sync_ratings(store, games.where((F.col("date") < "1997-06-10") & ~late & (F.col("lg") == "west")), "lg")["rated"] > 0
    ratings.sync_ratings(store, games.where(late & (F.col("lg") == "east")), "lg")
    monkeypatch.setattr(VersionedTable, "commit", lambda *_, **__: (_ for _ in ()).throw(RuntimeError("killed")))
    before = got()
    with pytest.raises(RuntimeError):
        ratings.sync_ratings(store, games, "lg")
    monkeypatch.undo()
    assert got() == before
    ratings.sync_ratings(store, games, "lg")
    assert got() == whole and ratings.sync_ratings(store, games, "lg") == {"fresh": 0, "rated": 0}
    last = games.orderBy(F.desc("date"), F.desc("id")).limit(1)  # only its month is folded again
    again = ratings.sync_ratings(store, last.withColumn("home_score", F.lit(70)), "lg")
    month = games.join(last.select("lg", F.trunc("date", "MM").alias("m")), "lg").where(F.trunc("date", "MM") == F.col("m")).count()
    assert again == {"fresh": 1, "rated": month}


def test_streams(spark, tmp_path):
    rows = odds(spark, ("espn", 0, 0.6, 1.0), ("espn", 1, 0.601, 1.0), ("espn", 3, 0.7, 1.0), ("espn", 3, 0.7, 1.0))
    rows.write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, df, mode, n in (("distinct", stream.distinct_stream(read()), "append", 3), ("movement", stream.movement_stream(read()), "complete", 1)):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        assert spark.table(name).count() == n, name


def test_tolerance_filter_of_a_stream(spark, tmp_path):
    """Late rows, ties, a restart, and state that goes after its time."""
    r, t0, day = np.random.default_rng(8), dt.datetime(2026, 4, 22), dt.date(2026, 4, 22)
    rows = [(i, day, 1, 2, ("espn", "polymarket")[i % 2], t0 + dt.timedelta(minutes=int(r.integers(0, 2800) // 20 * 20)), float(r.choice([0.5, 0.503, 0.52])) if i % 9 else None, float(r.choice([1.0, 1.5, 3.0])), None) for i in range(300)]
    parts = [sorted((x for x in rows if n * 700 <= (x[5] - t0).total_seconds() / 60 < (n + 1) * 700), key=lambda x: r.random()) for n in range(4)]
    parts[1], parts[2] = parts[1][20:] + parts[2][:10], parts[2][10:] + parts[1][:20]  # some come a part too early or too late
    late = (900, day, 1, 2, "espn", t0 - dt.timedelta(hours=40), 0.9, 1.0, None)
    parts += [[(901, day, 3, 4, "espn", t0 + dt.timedelta(days=5), 0.5, 1.0, None)], [late, (902, day, 3, 4, "espn", t0 + dt.timedelta(days=9), 0.5, 1.0, None)]]
    parts += [[(903, day, 5, 6, "espn", t0 + dt.timedelta(days=20), 0.5, 1.0, None)], [(904, day, 5, 6, "espn", t0 + dt.timedelta(days=30), 0.5, 1.0, None)]]
    source, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    state = []
    for n, part in enumerate(parts):  # each run is a restart from the checkpoint
        spark.createDataFrame(part, ODDS).coalesce(1).write.mode("append").parquet(source)
        feed = spark.readStream.schema(ODDS).parquet(source)
        q = stream.moved_stream(feed, "1 day").writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination(120)
        state.append([sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in q.recentProgress])
    got = sorted(x["id"] for x in spark.read.schema(stream.KEPT).parquet(out).collect())
    want = sorted(x["id"] for x in od.moved_snapshots(spark.createDataFrame(rows + [parts[4][0], parts[5][1], parts[6][0]], ODDS)).collect())
    assert got == want and 0 < len(want) < 250 and 900 not in got
    assert max(map(max, state)) >= 4 and state[-1][-1] <= 2, state  # keys that state has


def test_new_games_and_upserts(spark, tmp_path):
    log = spark.createDataFrame([("g1", 1, "BOS vs. LAL", 100), ("g1", 2, "LAL @ BOS", 90), ("g2", 1, "BOS vs. NYK", 99), ("g3", 3, "A vs. B", 1), ("g3", 4, "B vs. A", 2)], "game_id string, team_id long, matchup string, pts int").withColumn("date", F.current_date()).withColumn("season", F.lit("2025-26"))
    got = sn.new_games(log, spark.createDataFrame([], "id string")).collect()
    assert [(r["game_id"], r["home_team_id"], r["away_score"], r["home_win"]) for r in got] == [("g1", 1, 90, True)]
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string"), spark.createDataFrame([(2, "z")], "k long, v string")
    assert {tuple(r) for r in inj.upserted(a, b, ["k"]).collect()} == {(1, "x"), (2, "z")}
    day = spark.createDataFrame([("2026-01-01", 1), ("2026-01-02", 2)], "snapshot_date string, v int")
    sn.replace_day(day, str(tmp_path / "days"))
    sn.replace_day(day.where("v = 2").withColumn("v", F.lit(9)), str(tmp_path / "days"))
    assert {r["v"] for r in spark.read.parquet(str(tmp_path / "days")).collect()} == {1, 9}


def test_lineups_and_overrides(spark):
    schema = "player_name string, team_abbr string, status string, impact_rating double"
    reports = spark.createDataFrame([("Al One", "BOS", "Questionable", 8.0), ("Bo Two", "BOS", "Questionable", 8.0), ("Cy", "BOS", "Doubtful", 9.0), ("Di", "LAL", "Probable", 9.0)], schema)
    starters = spark.createDataFrame([("BOS", ["al one"])], "team_abbr string, names array<string>")
    got = {r["player_name"]: (r["status"], r["impact_rating"]) for r in inj.lineup_bumps(reports, starters).collect()}
    assert got == {"Al One": ("Questionable", 8.0), "Bo Two": ("Out", 10.0), "Cy": ("Doubtful", 9.0), "Di": ("Probable", 9.0)}
    manual = spark.createDataFrame([("AL ONE", "BOS", "Out", 5.0), ("New", "BOS", "Out", 1.0)], schema)
    assert {r["player_name"] for r in inj.with_overrides(reports, manual).collect()} == {"AL ONE", "New", "Bo Two", "Cy", "Di"}
    assert value(spark, bet.impact_estimate(*lit(1, "Questionable"))) == 3.5


def test_simulation(spark):
    rows = [(i, 0.6, 0.5, i % 5 < 3) for i in range(100)]
    bets = spark.createDataFrame(rows, "idx long, model_prob double, market_prob double, won boolean")
    real, null = (sim.bankroll_paths(bets, 50, m) for m in ("empirical", "market_right"))
    mean = lambda d: d.agg(F.avg("final_bankroll")).first()[0]
    assert mean(real) > mean(null) and mean(real) == mean(sim.bankroll_paths(bets, 50, "empirical"))
    flat = bets.withColumn("model_prob", F.lit(0.5))
    assert {round(r["final_bankroll"], 6) for r in sim.bankroll_paths(flat, 5).collect()} == {config.BANKROLL}
    with pytest.raises(ValueError):
        sim.bankroll_paths(bets, 5, "other")
    assert sim.simulation_summary(real).first()["probability_of_ruin"] == 0


def test_portfolio():
    f = sim.optimal_fractions(np.full(8, 0.6), np.full(8, 0.5))
    assert 0 < f.sum() <= config.MAX_EXPOSURE and f.max() <= config.MAX_BET
    assert sim.optimal_fractions(np.array([0.4, 0.7]), np.array([0.5, 0.5]))[0] == 0


@pytest.mark.parametrize(("probs", "prices"), [([0.6], [0.5]), ([0.55, 0.7], [0.5, 0.66]), ([0.56, 0.62, 0.8], [0.5, 0.6, 0.75]), ([0.9, 0.9, 0.3], [0.5, 0.5, 0.2])])
def test_portfolio_is_best_on_a_grid(probs, prices):
    p, m, top, total = np.array(probs), np.array(prices), 0.3, 0.5
    f, growth, gap = sim.optimum(p, m, top=top, total=total)
    assert 0 <= gap <= 1e-6 and f.sum() <= total + 1e-12 and f.min() >= 0 and f.max() <= top
    steps = np.meshgrid(*[np.linspace(0, top, 61)] * len(p), indexing="ij")
    grid = np.stack([s.ravel() for s in steps], 1)
    grid = grid[grid.sum(1) <= total + 1e-12]
    b = 1 / m - 1
    won = np.concatenate(list(sim._outcomes(p, config.PORTFOLIO_RHO, 2000, 42)))
    best = max(np.log(1 + np.where(won, b, -1.0) @ g).mean() for g in grid)
    assert best - 1e-6 <= growth and growth <= best + 1e-3


def test_portfolio_of_a_large_slate(monkeypatch):
    r = np.random.default_rng(1)
    m = r.uniform(0.3, 0.7, 300)
    p = np.clip(m + r.uniform(-0.05, 0.15, 300), 0.01, 0.99)
    f, growth, gap = sim.optimum(p, m)
    monkeypatch.setattr(sim, "DRAWN", 1 << 12)
    assert gap <= 1e-6 and f.sum() <= config.MAX_EXPOSURE + 1e-9 and growth > 0
    again = sim.optimum(p[:40], m[:40])
    assert again[2] <= 1e-6  # draws in pieces
    assert sim.optimum(np.zeros(2), np.ones(2))[1:] == (0.0, 0.0)


def test_features_and_models(spark):
    history = ratings.elo_history(view(spark, SF, "games"))
    form = ft.team_form(view(spark, SF, "game_stats"), history)
    matrix = ft.game_matrix(form, history, odds=view(spark, SF, "odds_snapshots"))
    names = ft.feature_names(form.columns)
    assert len(names) == len(set(names)) and set(names) <= set(matrix.columns)
    few = ["elo_diff", "elo_home_prob", "rest_diff"]
    rows = matrix.select("game_id", "date", "home_win", "home_score", "away_score", *few).where("rest_diff is not null").persist()
    assert rows.count() == 1500
    assert models.folds(rows).count() <= 3
    fit, rest = models.split_by_date(rows)
    assert fit.agg(F.max("date")).first()[0] <= rest.agg(F.min("date")).first()[0] and (fit.count(), rest.count()) == (1200, 300)
    assert fit.join(rest, "game_id").count() == 0
    model = models.classifier(fit, few, rounds=3, depth=2, patience=None)
    p = models.scored(model, rest)
    for kind in ("isotonic", "platt"):
        c = models.Calibration.fit(p, kind=kind)
        low, high = p.select(F.min(c.apply(F.col("raw_prob"))), F.max(c.apply(F.col("raw_prob")))).first()
        assert 0 <= low <= high <= 1
    top = models.drivers(model, rest.limit(5), few, {n: 0.0 for n in few}, k=2).collect()
    assert len(top) == 5 and all(len(r["drivers"]) == 2 for r in top)
    rows.unpersist()


def test_explanations(spark):
    person = "array<struct<player_name:string,status:string>>"
    row = spark.createDataFrame([(1, "BOS", "LAL", 0.7, 0.5, 4.0, 0.06, 0.08, 3, [("X Y", "Out")], [])], f"id long, home string, away string, model_home_prob double, market_home_prob double, trend double, prob_movement double, odds_disagreement double, n_snapshots long, away_out {person}, home_out {person}")
    said = rec.explanation(rec.decided(row)).first()["explanation"]
    assert "BOS" in said and "without X Y (Out)" in said and "trending up" in said and "to the home team (+6.0%)" in said and "8.0%" in said and "(an edge of 16.8%)" in said


def explained(spark, home_bet, home, away, drivers=None, injuries=()):
    """The explanation of a bet, from forms (plus-minus 5, 10; eFG 5, 10; turnovers 5, 10; plus-minus 20) and reports."""
    columns = [f"{c}_roll_{n}" for c, widths, *_ in rec.CITED for n in widths] + ["plus_minus_roll_20"]
    form = spark.createDataFrame([(1, *home), (2, *away)], "team_id long, " + ", ".join(f"{c} double" for c in columns))
    reports = spark.createDataFrame(list(injuries), "team_abbr string, player_name string, status string, impact_rating double")
    game = spark.createDataFrame([(7, "BOS", "LAL", 1, 2, "HOME" if home_bet else "AWAY", 0.15, 0.6, 0.52, drivers)], "id long, home string, away string, home_team_id long, away_team_id long, side string, edge double, home_prob double, market_home_prob double, drivers array<struct<label:string,delta:double,value:double>>")
    return rec.explanation(rec.with_injured(rec.with_form(game, form), reports)).first()["explanation"]


def test_explanations_cite_what_supports_the_bet(spark):
    good, bad = (6.0, 9.0, 0.60, 0.55, 0.10, 0.12, 1.0), (1.0, -2.0, 0.50, 0.54, 0.15, 0.13, 0.5)
    said = explained(spark, True, good, bad)
    assert "BOS is 11.0 points a game ahead of LAL over 10 games (+9.0 to -2.0)." in said and "BOS is trending up: +6.0 over 5 games, +1.0 over 20." in said
    said = explained(spark, False, good, bad)
    assert "But form speaks for the other side: BOS is 11.0 points a game ahead" in said
    mixed = explained(spark, False, good, (1.0, 0.0, 0.50, 0.54, 0.05, 0.02, 9.0))  # only turnovers are for LAL
    assert "LAL loses the ball less (2.0% to 12.0% of possessions over 10 games)." in mixed and "LAL is in a slump: +1.0 over 5 games, +9.0 over 20." in mixed
    assert "other side" not in explained(spark, True, (None,) * 7, bad) and "ahead" not in explained(spark, True, (2.0, 2.0, 0.5, 0.5, 0.1, 0.1, 2.0), (1.0, 1.0, 0.49, 0.5, 0.1, 0.1, 1.0))


def test_explanations_cite_drivers_and_named_players(spark):
    form = (6.0, 9.0, 0.60, 0.55, 0.10, 0.12, 5.0)
    drivers = [("elo_diff", -0.2, -40.0), ("efg_pct_x", 0.004, 1.0), ("home_elo", 0.02, 1571.234), ("elo_home_prob", 0.01, 0.61)]
    said = explained(spark, True, form, form, drivers)
    assert "BOS is favoured much by home Elo (+1571.23), which moves the home team's chance by +2.0%." in said
    said = explained(spark, False, form, form, drivers)
    assert "LAL is favoured mainly by Elo differential (-40.00), which moves the home team's chance by -20.0%." in said
    assert "favoured" not in explained(spark, True, form, form, drivers[:2])
    people = [("LAL", "A", "Out", 9.0), ("LAL", "B", "Questionable", 5.0), ("LAL", "C", "Out", 7.0), ("BOS", "D", "Out", 4.9), ("BOS", "E", "GTD", 5.1)]
    said = explained(spark, True, form, form, None, people)
    assert "LAL is weakened without A (Out), C (Out)." in said and "But BOS also misses E (GTD)." in said


def test_exposure_and_curve(spark):
    rows = mt.settled(view(spark, SF, "predictions"))
    assert mt.capped_stakes(rows.withColumn("f", F.col("bet_size") / 10), "date", "f").groupBy("date").agg(F.sum("capped").alias("s")).agg(F.max("s")).first()[0] <= config.MAX_EXPOSURE + 1e-9
    assert 0 <= mt.max_drawdown(mt.bankroll_curve(rows)).first()[0]
    assert mt.calibration_error(mt.calibration_bins(rows, "model_home_prob", F.col("home_won"))).first()[0] > 0


def test_whole_simulations_take_every_settled_bet(spark, monkeypatch):
    from matchgrid import queries as q

    rows = [(i, side, 0.6, 0.5 + i / 1e5, won) for i in range(1, 2001) for side, won in [(("HOME", "AWAY", "NO BET", "HOME")[i % 4], None if i % 7 == 0 else i % 2 == 0)]]
    table = spark.createDataFrame(rows, "id long, bet_side string, model_home_prob double, market_home_prob double, home_won boolean").repartition(5)
    monkeypatch.setattr(q, "view", lambda *_: table)
    expected = [(r[3], r[4]) if r[1] == "HOME" else (1 - r[3], not r[4]) for r in rows if r[1] != "NO BET" and r[4] is not None]
    got = sorted(q._bets(spark, "").collect(), key=lambda r: r["idx"])
    assert [r["idx"] for r in got] == list(range(len(expected))) and [(r["market_prob"], r["won"]) for r in got] == expected
    asked = []
    none = spark.createDataFrame([], q.sim.PATHS)
    monkeypatch.setattr(q.sim, "bankroll_paths", lambda bets, n, mode: asked.append((bets.count(), n, mode)) or none)
    monkeypatch.setattr(q.sim, "simulation_summary", lambda paths: paths)
    for name in ("montecarlo_summary", "montecarlo_empirical", "montecarlo_market_null"):
        q.QUERIES[name](spark, "")
    assert asked == [(len(expected), 10_000, m) for m in ("empirical", "empirical", "market_right")]


def test_simulations_in_tasks_by_windows_and_by_hand(spark, monkeypatch):
    rows = [(i, 0.3 + i % 60 / 100, 0.35 + i % 31 / 100, i % 5 < 3) for i in range(70)]
    bets = spark.createDataFrame(rows, "idx long, model_prob double, market_prob double, won boolean")

    def draw(*parts):
        x = sum(p * k for p, k in zip(parts, (7919, 104729, 1299709))) + 12345
        for _ in range(3):
            x = x % sim.MODULUS * sim.FACTOR
        return x % sim.MODULUS / float(sim.MODULUS)

    stakes = {r["idx"]: r["f"] for r in bets.select("idx", bet.kelly(F.col("model_prob"), F.col("market_prob")).alias("f")).collect()}
    monkeypatch.setattr(sim, "SEGMENT", 16)
    for mode in ("empirical", "market_right"):
        monkeypatch.setattr(sim, "BROADCAST_BETS", 10**6)
        few = {r["sim"]: r for r in sim.bankroll_paths(bets, 12, mode).collect()}
        monkeypatch.setattr(sim, "BROADCAST_BETS", 1)
        many = {r["sim"]: r for r in sim.bankroll_paths(bets, 12, mode).collect()}
        for s in range(12):
            money = peak = config.BANKROLL
            fall = 0.0
            for step in range(70):
                _, _, m, won = rows[int(draw(s, step) * 70)]
                f = stakes[int(draw(s, step) * 70)]
                won = won if mode == "empirical" else draw(step, s, 7) < m
                money *= 1 + f * (1 / m - 1) if won else 1 - f
                peak = max(peak, money)
                fall = max(fall, (peak - money) / peak)
            for got in (few[s], many[s]):
                assert math.isclose(got["final_bankroll"], money, rel_tol=1e-9) and math.isclose(got["max_drawdown"], fall, abs_tol=1e-9) and got["n_bets"] == 70
    assert sim.bankroll_paths(bets.limit(0), 3).count() == 0


@pytest.mark.parametrize("few", [10**6, 1])
def test_simulations_may_grow_beyond_a_double(spark, monkeypatch, few):
    monkeypatch.setattr(sim, "BROADCAST_BETS", few)
    monkeypatch.setattr(sim, "SEGMENT", 5000)
    bets = spark.createDataFrame([(i, 0.6, 0.4, i % 10 > 0) for i in range(20)], "idx long, model_prob double, market_prob double, won boolean")
    paths = sim.bankroll_paths(bets, 3, "empirical", 20_000)
    for r in paths.collect():
        assert 710 < r["log_growth"] < 1e4 and math.isinf(r["final_bankroll"]) and 0 < r["max_drawdown"] < 1
    out = sim.simulation_summary(paths).first()
    assert math.isinf(out["pct_50"]) and 710 < out["log_pct_5"] <= out["log_pct_50"] <= out["log_pct_95"] <= out["log_max"] and math.isclose(out["log_mean"], out["log_max"], abs_tol=5)
    gap = sim.skill_gap(*(sim.simulation_summary(sim.bankroll_paths(bets, 3, m, 20_000)) for m in ("empirical", "market_right"))).first()
    assert gap["log_growth_gap"] > 0 and 710 < gap["median_log_gap"] < 1e4


def test_backtest_beyond_a_double(spark):
    rows = [(i, dt.date(2020, 1, 1) + dt.timedelta(i // 50), 0.7, 0.4, i % 10 > 0) for i in range(20_000)]
    games = spark.createDataFrame(rows, "id long, date date, model_home_prob double, market_home_prob double, home_won boolean")
    bets = rec.backtest(games)
    got = rec.backtest_summary(bets).first()
    f = bets.first()["kelly_pct"]
    money, gains, stakes, logs = 0.0, [], [], []
    for *_, won in rows:  # in units of the last bankroll
        logs.append(money)
        money += math.log(1 + f * 1.5 if won else 1 - f)
    scale = max(money, *logs)
    stakes = [f * math.exp(x - scale) for x in logs]
    gains = [s * (1.5 if won else -1) for s, (*_, won) in zip(stakes, rows)]
    assert money > 710 and got["total_bets"] == 20_000 and got["wins"] == 18_000 and math.isinf(got["total_wagered"])
    assert got["roi"] == pytest.approx(sum(gains) / sum(stakes)) and got["log_wagered"] == pytest.approx(math.log(1000) + scale + math.log(sum(stakes)))
    returns = [1.5 if won else -1.0 for *_, won in rows]
    assert got["sharpe"] == pytest.approx(np.mean(returns) / np.std(returns, ddof=1) * math.sqrt(20_000))
    small = rec.backtest_summary(rec.backtest(games.where("id < 3"))).first()
    assert small["total_profit"] == pytest.approx(1000 * ((1 - f) * (1 + 1.5 * f) ** 2 - 1))


def test_quantiles_between_logarithms(spark):
    values = [1.0, 2.0, 5.0, 9.0, 10.0, 30.0]
    got = mt.quantiles(spark.createDataFrame([(math.log(v),) for v in values], "x double"), "x", exponential=True).first()
    assert [math.exp(got[f"pct_{q}"]) for q in mt.QUANTILES] == pytest.approx(np.percentile(values, mt.QUANTILES).tolist())


def test_quantiles_of_many_few_and_no_values(spark):
    for values in ([], [3.0], [2.0, 1.0], [float(i * 7919 % 1000) for i in range(997)], [5.0] * 40):
        got = mt.quantiles(spark.createDataFrame([(v,) for v in [*values, None]], "x double").repartition(5), "x").first()
        if not values:
            assert all(v is None for v in got)
            continue
        assert [got[f"pct_{q}"] for q in mt.QUANTILES] == pytest.approx(np.percentile(values, mt.QUANTILES).tolist()) and got["max"] == max(values)


def test_confidence_of_a_bet(spark):
    got = {r["id"]: r for r in sim.confidence(spark.createDataFrame([(1, 0.6, 0.5), (2, 0.5, 0.6)], "id long, prob double, price double"), n=2000).collect()}
    assert got[1]["edge_5"] < 0.2 < got[1]["edge_95"] and abs(got[1]["edge_50"] - 0.2) < 0.02 and got[1]["positive_share"] > 0.9 > 0.1 > got[2]["positive_share"]


def test_search_stack_margins_importance_and_artifacts(spark, tmp_path):
    r = np.random.default_rng(2)
    rows, start = [], dt.date(2020, 1, 1)
    for i in range(900):
        x, y = float(r.normal()), float(r.normal())
        p = 1 / (1 + math.exp(-2 * x))
        home = 100 + int(8 * x + r.normal())
        rows.append((i, start + dt.timedelta(days=i), x, y, p, min(max(p + 0.1 * float(r.normal()), 0.01), 0.99), float(r.random() < p), home, 100))
    table = spark.createDataFrame(rows, "game_id long, date date, x double, y double, elo_home_prob double, other double, home_win double, home_score long, away_score long").repartition(3).persist()
    best, losses = models.search(table, ["x", "y"], [{"rounds": 1, "depth": 1, "rate": 0.01}, {"rounds": 8, "depth": 2, "rate": 0.3}], n=1)
    assert best["rounds"] == 8 and len(losses) == 2 and losses[1][1] < losses[0][1] < 1
    stack = models.stacked(table, "elo_home_prob", "other", ["y"])
    p = models.scored(stack, models.stack_inputs(table, "elo_home_prob", "other"))
    assert mt.probability_scores(p, F.col("raw_prob"), F.col("home_win")).first()["brier"] < 0.2
    margins = models.margin_models(table, ["x", "y"], rounds=30, rate=0.2, depth=3)
    assert margins["margin"][1] < 4 and margins["total"][1] < 4
    model = models.classifier(table, ["x", "y"], rounds=12, depth=2, rate=0.3)
    rank = models.permutation_importance(model, table, ["x", "y"], repeats=2, sample=300).collect()
    assert [v["feature"] for v in rank] == ["x", "y"] and rank[0]["importance"] > 0.05 > abs(rank[1]["importance"])

    path = f"file://{tmp_path}/artifacts"
    assert models.Artifacts.load(spark, path) is None
    kept = models.Artifacts(model, ["x", "y"], {"x": 0.5, "y": 0.0}, models.Calibration("platt", [1.0], [0.0]), 0.25)
    kept.save(spark, path)
    one = models.Artifacts.load(spark, path)
    assert one is models.Artifacts.load(spark, path) and (one.names, one.means, one.elo_weight, one.calibration) == (kept.names, kept.means, kept.elo_weight, kept.calibration)
    kept.elo_weight = 1.0
    kept.save(spark, path)
    two = models.Artifacts.load(spark, path)
    assert two is not one and two.elo_weight == 1.0
    slate = spark.createDataFrame([(1, 2.0, None, 0.9), (2, None, None, 0.3), (3, 2.0, 1.0, None)], "game_id long, x double, y double, elo_home_prob double")
    got = {v["game_id"]: v for v in models.predicted(slate, one).collect()}
    assert not got[2]["used_model"] and got[2]["model_home_prob"] == 0.3 and not got[1]["used_model"] and got[3]["used_model"] and got[3]["model_home_prob"] > 0.5
    table.unpersist()


def test_upcoming_games(spark):
    history = ratings.elo_history(view(spark, SF, "games"))
    form = ft.team_form(view(spark, SF, "game_stats"), history)
    slate = spark.createDataFrame([(-1, dt.date(2030, 1, 1), 3, 4), (-2, dt.date(2030, 1, 1), 5, 99)], "game_id long, date date, home_team_id long, away_team_id long")
    rows = ft.upcoming_matrix(form, slate, history).collect()
    last = {r["team_id"]: r["elo"] for r in ratings.leaderboard(history).collect()}
    assert len(rows) == 1 and rows[0]["game_id"] == -1 and rows[0]["home_elo"] == last[3] and rows[0]["elo_diff"] == last[3] - last[4]
    assert rows[0]["diff_pts_roll_10"] is not None and "home_win" not in rows[0].asDict()


def test_documents_lines_and_pages(spark, tmp_path):
    (tmp_path / "injuries.json").write_text(json.dumps([{"player_name": "A", "impact": 3.0}, {"player_name": "B"}]))
    got = sn.read_documents(spark, str(tmp_path / "injuries.json"), T.StructType.fromDDL("player_name string, impact double")).collect()
    assert [(r["player_name"], r["impact"]) for r in got] == [("A", 3.0), ("B", None)]
    rows = spark.createDataFrame([("2026-01-01 23:59:00", "BOS", None), ("2026-01-02 00:10:00", "LAL", 0.5)], "timestamp string, home_team_abbr string, home_prob double").withColumn("timestamp", F.to_timestamp("timestamp"))
    sn.append_snapshots(rows.limit(0), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    for _ in range(2):
        sn.append_snapshots(rows, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4 and (tmp_path / "log" / "utc_day=2026-01-02").exists()
    pages = tmp_path / "pages"
    pages.mkdir()
    event = lambda title, *markets: {"title": title, "slug": "x-2026-01-05", "markets": list(markets)}
    market = lambda q, o, p, closed=False: {"question": q, "outcomes": json.dumps(o), "outcomePrices": json.dumps(p), "closed": closed}
    (pages / "1.json").write_text(json.dumps([event("Bulls vs. Wizards", market("bulls vs. wizards", ["Bulls", "Wizards"], ["0.665", "0.335"])), event("Heat vs. Nets", market("Will the Nets win?", ["Yes", "No"], ["0.3", "0.7"])), event("Next MVP", market("?", ["Yes", "No"], ["0.5", "0.5"]))]))
    (pages / "2.json").write_text(json.dumps([event("Suns vs. Jazz", market("Suns vs. Jazz", ["Suns", "Jazz"], ["0.99", "0.01"])), event("Kings vs. Spurs"), event("Magic vs. Hawks", market("Magic vs. Hawks", ["Magic", "Hawks"], ["0.4", "0.6"], True))]))
    found = {r["event_title"]: (r["first"], r["second"], round(r["first_price"], 3), round(r["second_price"], 3), r["game_date"]) for r in markets.event_prices(markets.read_pages(spark, str(pages))).collect()}
    assert found == {"Bulls vs. Wizards": ("CHI", "WAS", 0.665, 0.335, "2026-01-05"), "Heat vs. Nets": ("MIA", "BKN", 0.7, 0.3, "2026-01-05")}
    assert sn.with_columns_of(rows, T.StructType.fromDDL("home_prob double, spread double")).first()["spread"] is None


def test_reports_without_names_stay(spark):
    reports = spark.createDataFrame([("Al", "BOS", 3.0), (None, "LAL", 9.0), ("BO", "AAA", 9.0)], "player_name string, team_abbr string, impact_rating double")
    assert {r["team_abbr"] for r in inj.without_player(reports, "AL").collect()} == {"LAL", "AAA"} and inj.cleared(reports).count() == 0
    assert [r["team_abbr"] for r in inj.by_impact(inj.with_player(reports, "al", "nyk", impact=9.5)).collect()] == ["NYK", "AAA", "LAL"]
    players = spark.createDataFrame([("x", 1, 3, None), ("y", 1, None, 5.0), ("z", 2, 1, 1.0)], "player_name string, team_id long, depth_chart_rank int, points_per_game double")
    assert [(r["player_name"], r["points_per_game"]) for r in inj.by_depth(players, 1).collect()] == [("y", 5.0), ("x", 0.0)]


def test_slate_is_ordered_and_keeps_games_without_more(spark):
    rows = rec.decided(spark.createDataFrame([(1, "A", "B", 1, 2, 0.6, 0.55), (2, "C", "D", 3, 4, 0.8, 0.5), (3, "E", "F", 5, 6, 0.5, 0.5)], "id long, home string, away string, home_team_id long, away_team_id long, model_home_prob double, market_home_prob double"))
    rows = rows.withColumns({"spread": F.lit(-3.0), "over_under": F.lit(220.0)})
    margins = spark.createDataFrame([(1, 2, 6.004, 230.0)], "home_team_id long, away_team_id long, predicted_spread double, predicted_total double")
    context = spark.createDataFrame([(3, 5.0)], "team_id long, trend double")
    moved = spark.createDataFrame([(3, 4, 0.1, 0.0, 3)], "home_team_id long, away_team_id long, prob_movement double, odds_disagreement double, n_snapshots long")
    got = rec.slate_view(rows, margins, context, moved).collect()
    assert [r["id"] for r in got] == [2, 1, 3] and "trending up" in got[0]["explanation"] and "line moves to" in got[0]["explanation"]
    assert (got[1]["spread_pick"], got[1]["total_pick"], got[1]["predicted_spread"]) == ("A -3.0", "OVER 220.0", 6.0) and got[2]["spread_pick"] == "NO BET" and got[2]["trend"] is None


def test_hourly_windows_of_a_stream(spark, tmp_path):
    rows = odds(spark, ("espn", 0, 0.6, 1.0), ("espn", 0, 0.2, 1.0), ("espn", 3, 0.7, 1.0), ("espn", 3, None, 1.0))
    rows.write.parquet(str(tmp_path / "in"))
    q = stream.windowed_activity(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r["window"]["start"], r["n"], r["mean_prob"]) for r in spark.table("hours").collect())
    assert [(n, p) for _, n, p in got] == [(2, 0.4), (2, 0.7)]
    assert sorted(map(str, stream.windowed_activity(rows).collect())) == sorted(map(str, spark.table("hours").collect()))
