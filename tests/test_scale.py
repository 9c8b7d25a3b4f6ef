"""Steps that have to stay bounded as tables grow."""

import datetime as dt
import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from matchgrid.functions import betting as bet
from matchgrid.operators import injuries as inj, ratings, simulation as sim


def test_simulations_take_no_bets_through_the_driver(spark, monkeypatch):
    rows = [(i, 0.3 + i % 60 / 100, 0.35 + i % 31 / 100, i % 5 < 3) for i in range(700)]
    bets = spark.createDataFrame(rows, "idx long, model_prob double, market_prob double, won boolean").repartition(3)
    assert sim.BROADCAST_BETS >= 36_000_000  # those of 6 GB
    whole = {m: sorted(map(tuple, sim.bankroll_paths(bets, 3, m).collect())) for m in ("empirical", "market_right")}

    def driver(*_):
        raise AssertionError("bets on the driver")

    monkeypatch.setattr(DataFrame, "toPandas", driver)
    monkeypatch.setattr(sim, "DRAWS", 64)  # steps in pieces, the last one short
    for mode, expected in whole.items():
        assert sorted(map(tuple, sim.bankroll_paths(bets, 3, mode).collect())) == expected


def test_lineups_meet_players_by_parts_of_names(spark):
    names = ["jo", "Ann Lee", "lee", "", "Al", "ALBERT", "Bo-1", "bo-10", "Zoë", "zo", "Max", None]
    reports = spark.createDataFrame([(n, t, s, r) for n in names for t in ("aa", "BB", "CC", "DD", None) for s, r in (("GTD", 8.0), ("Out", 9.0), ("GTD", 3.0), (None, 7.0))], "player_name string, team_abbr string, status string, impact_rating double")
    starters = spark.createDataFrame([("AA", ["Ann Lee", "Alb", "BO-1", "zoë x"]), ("BB", []), ("CC", ["Max", None])], "team_abbr string, names array<string>")

    def plain(name, team, status, rating):
        lineup = dict(AA=["ann lee", "alb", "bo-1", "zoë x"], BB=[], CC=["max", None]).get((team or "").upper())
        if not lineup or None in lineup or name is None or status in ("Out", None) or rating < 7:
            return (name, team, status, rating)
        listed = any(name.lower() in x or x in name.lower() for x in lineup)
        return (name, team, status, rating) if listed else (name, team, "Out", 10.0)

    out = inj.lineup_bumps(reports, starters)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, out.collect()), key=key) == sorted((plain(*r) for r in reports.collect()), key=key)


def test_leagues_are_folded_from_sorted_files(spark):
    rows = [(i, dt.date(2000, 1, 1) + dt.timedelta(i * 7 % 900), 2000 + i * 7 % 900 // 365, i % 5, (i + 1 + i // 5 % 4) % 5, 90 + i * 31 % 40, 91 + i * 17 % 37, [None, "a", "b", "c", "d", "e", "f"][i % 7]) for i in range(700)]
    games = spark.createDataFrame(rows, "id long, date date, season int, home_team_id long, away_team_id long, home_score int, away_score int, lg string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a league is in several files, a file has several leagues
    try:
        out = ratings.elo_history(games, "lg")
        got = sorted(map(tuple, out.collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    expected = []
    for lg in {r[7] for r in rows}:
        fold = ratings.Ratings()
        for i, day, season, h, a, x, y, _ in sorted((r for r in rows if r[7] == lg), key=lambda r: (r[1], r[0])):
            for team, (b, e) in zip((h, a), fold.play(season, h, a, x, y)):
                expected.append((i, team, day, b[0], e[0], b[1], e[1], b[2], e[2]))
    assert got == sorted(expected)
    assert "Sort" not in out._jdf.queryExecution().executedPlan().toString()  # no task orders a league
    board = {r["team_id"]: r["elo"] for r in ratings.leaderboard(out).collect()}
    last = {t: max((r for r in expected if r[1] == t), key=lambda r: (r[2], r[0])) for t in range(5)}
    assert board == {t: r[4] for t, r in last.items()}


def test_market_fields_are_read_once(spark):
    from matchgrid.sources import markets

    events = spark.createDataFrame([("Bulls vs. Heat", "x-2024-01-05", [("Bulls vs. Heat", '["Bulls","Heat"]', '["0.4","0.6"]', False)])], markets.EVENT)
    out = markets.event_prices(events)
    assert [tuple(r)[3:] for r in out.collect()] == [("CHI", "MIA", 0.4, 0.6)]
    assert out._jdf.queryExecution().analyzed().toString().count("from_json") == 2  # outcomes and prices


def test_results_of_a_slate_are_drawn_once(monkeypatch):
    p, m = np.linspace(0.4, 0.7, 25), np.linspace(0.35, 0.6, 25)
    drawn, outcomes = [], sim._outcomes
    monkeypatch.setattr(sim, "_outcomes", lambda *args: drawn.append(1) or outcomes(*args))
    f, growth, gap = sim.optimum(p, m)
    assert len(drawn) == 1 and gap <= sim.GAP
    monkeypatch.setattr(sim, "KEPT", 0)  # drawn again for each step
    again = sim.optimum(p, m)
    assert len(drawn) > 3 and (again[0] == f).all() and again[1:] == (growth, gap)


def test_form_of_last_games_orders_last_days_only(spark):
    from matchgrid.operators import windows as wn

    rows = [(t, i, dt.date(2000, 1, 1) + dt.timedelta(i * 7 % 40), float(i * t % 11)) for t in (1, 2, 3) for i in range(9 if t == 3 else 200)]
    rows += [(2, 500 + i, None, 1.0) for i in range(3)]
    stats = spark.createDataFrame(rows, "team_id long, game_id long, date date, plus_minus double").repartition(3)
    whole = wn.latest_rows(wn.with_rolling(stats, ["plus_minus"]))
    last = wn.last_rows(stats, 21)
    assert last.groupBy("team_id").count().orderBy("team_id").collect() == [(1, 21), (2, 21), (3, 9)]
    assert wn.latest_rows(wn.with_rolling(last, ["plus_minus"])).orderBy("team_id").collect() == whole.orderBy("team_id").collect()


def test_adjusted_ratings_join_opponents_once(spark):
    from __spark_entry__ import queries

    plan = queries()["sos_adjusted_rating"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 1


def test_simulations_share_pieces_of_draws(spark, monkeypatch):
    """Paths by pieces are those that go draw by draw, and bets are looked up once for all simulations that draw them."""
    rows = [(i, 0.3 + i % 60 / 100, 0.35 + i % 31 / 100, i % 5 < 3) for i in range(700)]
    bets = spark.createDataFrame(rows, "idx long, model_prob double, market_prob double, won boolean").repartition(3)
    model, market, won = (np.array([r[i] for r in rows]) for i in (1, 2, 3))
    stake = np.array([r["f"] for r in bets.orderBy("idx").select(bet.kelly(F.col("model_prob"), F.col("market_prob")).alias("f")).collect()])
    up, down = np.log1p(stake * (1 / market - 1)), np.log1p(-stake)
    number = lambda x: x * pow(sim.FACTOR, 3, sim.MODULUS) % sim.MODULUS / float(sim.MODULUS)
    step = np.arange(5000)
    for piece in (1 << 20, 1 << 10):
        monkeypatch.setattr(sim, "PIECE", piece)
        monkeypatch.setattr(sim, "DRAWS", 256)
        for mode in ("empirical", "market_right"):
            got = {r["sim"]: r for r in sim.bankroll_paths(bets, 6, mode, len(step)).collect()}
            for s in range(6):
                i = (number((s * 7919 + step * 104729 + 12345) % sim.MODULUS) * 700).astype(int)
                wins = won[i] if mode == "empirical" else number((step * 7919 + s * 104729 + 7 * 1299709 + 12345) % sim.MODULUS) < market[i]
                path = np.cumsum(np.where(wins, up[i], down[i]))
                fall = (np.maximum(np.maximum.accumulate(path), 0) - path).max()
                assert math.isclose(got[s]["log_growth"], path[-1], abs_tol=1e-9) and math.isclose(got[s]["max_drawdown"], -math.expm1(-fall), abs_tol=1e-9) and got[s]["n_bets"] == 5000


def test_market_limits_are_exact():
    """A state wins against a probability as its number does, next to the limit too."""
    p = np.concatenate([np.random.default_rng(4).random(2000), np.arange(0, 101) / 100, [np.nan, -1.0, 2.0]])
    limit = sim._limits(p).astype(np.int64)
    for off in (-2, -1, 0, 1):
        x = np.clip(limit + off, 0, sim.MODULUS - 1)
        assert ((x < limit) == (x / float(sim.MODULUS) < p)).all()
