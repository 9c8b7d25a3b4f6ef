"""Named queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import config
from .functions import basketball as bb, betting as bet, text
from .operators import injuries as inj, metrics as mt, models, odds as od, ratings, simulation as sim, sketches as sk, windows as wn
from .plans import features as ft, recommend as rec
from .scratch import shared_dir, written
from .sources import documents, markets, snapshots as sn
from .sources.fixtures import ctes, view
from .streaming import odds as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without negative zeros; counts as longs."""
    kinds = dict(df.dtypes)
    cast = {"double": lambda c: F.round(c, digits) + 0.0, "int": lambda c: c.cast("long")}
    return df.select(*(cast[k](F.col(n)).alias(n) if (k := kinds[n]) in cast else F.col(n) for n in df.columns))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r(x: str, name: str) -> str:
    return f"round(cast({x} as double), 6) + 0.0 as {name}"


def big(x: str, name: str) -> str:
    return f"cast({x} as bigint) as {name}"


def roll(x: str, n: int, least: int) -> str:
    w = f"over (partition by team_id order by date, game_id rows between {n} preceding and 1 preceding)"
    return f"case when count({x}) {w} >= {least} then avg(cast({x} as double)) {w} end"


GS = ctes("game_stats")
DERIVED = f"""{GS}, d as (select *, cast(pts - pts_against as double) as net_rtg_game,
 greatest(60e0, fga + 0.44e0 * fta + tov - oreb) as poss,
 (fgm + 0.5e0 * fg3m) / case when fga = 0 then 1 else fga end as efg_pct,
 tov / case when fga + 0.44e0 * fta + tov = 0 then 1 else fga + 0.44e0 * fta + tov end as tov_pct,
 cast(ftm as double) / case when fga = 0 then 1 else fga end as ft_rate,
 sum(dreb) over (partition by game_id) - dreb as opp_dreb from game_stats)"""
BY_TEAM = "over (partition by team_id order by date, game_id)"

ROLLED = ["pts", "pts_against", "net_rtg_game", "fg3_pct", "oreb", "dreb", "ast", "tov", "plus_minus", "poss"]


def _derived(spark: SparkSession, sf: str) -> DataFrame:
    return wn.with_rebounds(wn.with_derived(view(spark, sf, "game_stats")))


@query(f"{DERIVED} select game_id, team_id, " + ", ".join(r(roll(c, n, n // 2), f"{c}_roll_{n}") for n in config.WINDOWS for c in ROLLED) + " from d")
def team_rolling_form(spark, sf):
    rows = wn.with_rolling(_derived(spark, sf), ROLLED)
    return rounded(rows.select("game_id", "team_id", *(f"{c}_roll_{n}" for n in config.WINDOWS for c in ROLLED)))


_W = "pow(2e0, (rn - n / 2e0) / 10)"
_UP = "over (partition by team_id order by date, game_id rows between unbounded preceding and 1 preceding)"


@query(
    f"{DERIVED}, o as (select *, row_number() {BY_TEAM} as rn, count(*) over (partition by team_id) as n from d) select game_id, team_id, "
    + ", ".join(r(f"case when count({c}) {_UP} >= 2 then sum({c} * {_W}) {_UP} / sum(case when {c} is not null then {_W} end) {_UP} end", f"{c}_ewm_10") for c in ("net_rtg_game", "plus_minus", "fg3_pct"))
    + " from o"
)
def ewm_form(spark, sf):
    columns = ["net_rtg_game", "plus_minus", "fg3_pct"]
    return rounded(wn.with_weighted(_derived(spark, sf), columns).select("game_id", "team_id", *(f"{c}_ewm_10" for c in columns)))


_FILL = "last_value({} ignore nulls) over (partition by team_id order by date, game_id rows between unbounded preceding and current row)"


@query(
    f"{GS}, m as (select *, case when date_diff('day', lag(date) {BY_TEAM}, date) <= 1 then fg3_pct end as x from game_stats), "
    f"w as (select *, {', '.join(f'{roll('x', n, 2)} as w{n}' for n in (5, 10))} from m) select game_id, team_id, {', '.join(r(_FILL.format(f'w{n}'), f'fg3_pct_b2b_roll_{n}') for n in (5, 10))} from w"
)
def b2b_conditional_rolling(spark, sf):
    rows = wn.with_back_to_back_shooting(view(spark, sf, "game_stats"))
    return rounded(rows.select("game_id", "team_id", "fg3_pct_b2b_roll_5", "fg3_pct_b2b_roll_10"))


_SPLITS = [(c, v, n) for c in ("plus_minus", "net_rtg_game") for v in ("home", "away") for n in (10, 20)]


@query(
    f"{DERIVED}, m as (select *, {', '.join(f'case when is_home = {v == 'home'} then {c} end as {c}_{v}' for c, v, n in _SPLITS if n == 10)} from d), "
    f"w as (select *, {', '.join(f'{roll(f'{c}_{v}', n, n // 3)} as w_{c}_{v}_{n}' for c, v, n in _SPLITS)} from m) "
    f"select game_id, team_id, {', '.join(r(_FILL.format(f'w_{c}_{v}_{n}'), f'{c}_{v}_split_roll_{n}') for c, v, n in _SPLITS)} from w"
)
def venue_split_rolling(spark, sf):
    rows = wn.with_venue_splits(_derived(spark, sf))
    return rounded(rows.select("game_id", "team_id", *(f"{c}_{v}_split_roll_{n}" for c, v, n in _SPLITS)))


_DAYS = "count(*) over (partition by team_id order by date range between interval {} day preceding and current row) - count(*) over (partition by team_id, date) + row_number() over (partition by team_id, date order by game_id) - 1"


@query(
    f"{GS} select game_id, team_id, {big(f'case when lag(date) {BY_TEAM} is null then 3 else least(date_diff(\'day\', lag(date) {BY_TEAM}, date), 7) end', 'rest_days')}, "
    f"{big(f'coalesce(cast(date_diff(\'day\', lag(date) {BY_TEAM}, date) <= 1 as int), 0)', 'is_back_to_back')}, {big(_DAYS.format(7), 'games_last_7')}, {big(_DAYS.format(14), 'games_last_14')} from game_stats"
)
def rest_schedule(spark, sf):
    rows = wn.with_rest(view(spark, sf, "game_stats"))
    return rounded(rows.select("game_id", "team_id", *ft.REST))


@query(f"{DERIVED} select game_id, team_id, {r('efg_pct', 'efg_pct')}, {r('tov_pct', 'tov_pct')}, {r('ft_rate', 'ft_rate')}, {r('oreb * 1e0 / case when oreb + opp_dreb = 0 then 1 else oreb + opp_dreb end', 'orb_pct')}, {r('poss', 'poss')} from d")
def four_factors(spark, sf):
    return rounded(_derived(spark, sf).select("game_id", "team_id", "efg_pct", "tov_pct", "ft_rate", "orb_pct", "poss"))


@query(f"{DERIVED} select game_id, team_id, {big('opp_dreb', 'opp_dreb')} from d")
def opponent_rebound(spark, sf):
    return rounded(_derived(spark, sf).select("game_id", "team_id", "opp_dreb"))


@query(
    f"{GS}, w as (select game_id, team_id, {roll('pts', 10, 5)} as f, {roll('pts_against', 10, 5)} as a from game_stats) select game_id, team_id, "
    + r("case when f is null or a is null then 0.5 else least(greatest(1 / (1 + exp(14 * (ln(a) - ln(f)))), 0.01), 0.99) end", "pyth")
    + " from w"
)
def pythagorean(spark, sf):
    rows = wn.with_rolling(view(spark, sf, "game_stats"), ["pts", "pts_against"], (10,))
    return rounded(rows.select("game_id", "team_id", bb.pythagorean(F.col("pts_roll_10"), F.col("pts_against_roll_10")).alias("pyth")))


@query(f"{GS} select team_id, game_id, date, {big('pts', 'pts')} from game_stats qualify row_number() over (partition by team_id order by date desc, game_id desc) = 1")
def latest_team_rows(spark, sf):
    return rounded(wn.latest_rows(view(spark, sf, "game_stats")).select("team_id", "game_id", "date", "pts"))


@query(
    f"{ctes('games')} select h.id as game_id, s.team_id, s.is_home, {big('s.pts', 'pts')}, {big('s.pts_against', 'pts_against')} from games h, "
    "lateral (select home_team_id as team_id, true as is_home, home_score as pts, away_score as pts_against union all select away_team_id, false, away_score, home_score) s"
)
def team_game_rows(spark, sf):
    return rounded(wn.game_rows(view(spark, sf, "games")).select("game_id", "team_id", "is_home", "pts", "pts_against"))


ODDS = ctes("odds_snapshots")
ODDS_BODY = ODDS[ODDS.index("(") + 1 : -1]
_GAME = "game_date, home_team_id, away_team_id"


def _pick(f: str, v: str, when: str) -> str:
    return f"arg_{f}({v}, (timestamp, id)) filter (where {v} is not null and {when})"


_MOVES = {
    "spread_movement": f"case when count(spread) filter (where source = 'espn') >= 2 then {_pick('max', 'spread', 'source = \'espn\'')} - {_pick('min', 'spread', 'source = \'espn\'')} else 0 end",
    "prob_movement": f"case when count(home_prob) >= 2 then {_pick('max', 'home_prob', 'true')} - {_pick('min', 'home_prob', 'true')} else 0 end",
    "odds_disagreement": f"coalesce(abs({_pick('max', 'home_prob', 'source = \'polymarket\' and home_prob <> 0')} - {_pick('max', 'home_prob', 'source = \'espn\' and home_prob <> 0')}), 0)",
}


@query(f"{ODDS} select {_GAME}, {', '.join(r(x, n) for n, x in _MOVES.items())} from odds_snapshots group by {_GAME}")
def line_movement(spark, sf):
    return rounded(od.line_movement(view(spark, sf, "odds_snapshots")))


_DETAIL = {"opening_prob": _pick("min", "home_prob", "true"), "current_prob": _pick("max", "home_prob", "true"), "opening_spread": _pick("min", "spread", "source = 'espn'"), "current_spread": _pick("max", "spread", "source = 'espn'")}


@query(f"{ODDS} select {_GAME}, count(*) as n_snapshots, {', '.join(r(x, n) for n, x in (_DETAIL | _MOVES).items())} from odds_snapshots group by {_GAME}")
def line_movement_detail(spark, sf):
    return rounded(od.movement_detail(view(spark, sf, "odds_snapshots")))


def _line_sql(f: str) -> str:
    p, e = (_pick(f, "home_prob", f"source = '{s}'") for s in ("polymarket", "espn"))
    return f"{ODDS}, b as (select {_GAME}, {p} as p, {e} as e from odds_snapshots group by {_GAME}) select {_GAME}, {r('coalesce(p, e)', 'home_prob')}, case when p is not null then 'polymarket' else 'espn' end as source from b where p is not null or e is not null"


@query(_line_sql("max"))
def closing_line(spark, sf):
    return rounded(od.closing_line(view(spark, sf, "odds_snapshots")))


@query(_line_sql("min"))
def opening_line(spark, sf):
    return rounded(od.opening_line(view(spark, sf, "odds_snapshots")))


@query(f"{ODDS} select {_GAME}, source, timestamp, id, {r('home_prob', 'home_prob')}, {r('spread', 'spread')}, {r('over_under', 'over_under')} from odds_snapshots qualify row_number() over (partition by {_GAME}, source, timestamp order by id) = 1")
def snapshot_dedup_natural(spark, sf):
    odds = view(spark, sf, "odds_snapshots")
    return rounded(od.distinct_snapshots(odds.unionByName(odds.where("id % 3 = 0"))))


_CLOSE = "((o.{0} is null and s.l_{0} is null) or coalesce(abs(o.{0} - s.l_{0}) <= {1}, false))"
_REP = " and ".join(["o.timestamp - s.l_ts <= interval 4 hours", _CLOSE.format("home_prob", 0.005), _CLOSE.format("spread", 0.5), _CLOSE.format("over_under", 0.5)])


@query(
    f"with recursive {ODDS[5:]}, k as (select *, row_number() over (partition by {_GAME}, source order by timestamp, id) as rn from odds_snapshots), "
    f"s as (select {_GAME}, source, rn, id, true as kept, timestamp as l_ts, home_prob as l_home_prob, spread as l_spread, over_under as l_over_under from k where rn = 1 "
    f"union all select o.game_date, o.home_team_id, o.away_team_id, o.source, o.rn, o.id, not ({_REP}), case when {_REP} then s.l_ts else o.timestamp end, "
    f"case when {_REP} then s.l_home_prob else o.home_prob end, case when {_REP} then s.l_spread else o.spread end, case when {_REP} then s.l_over_under else o.over_under end "
    f"from s join k o on o.game_date = s.game_date and o.home_team_id = s.home_team_id and o.away_team_id = s.away_team_id and o.source = s.source and o.rn = s.rn + 1) "
    f"select {_GAME}, source, id from s where kept"
)
def snapshot_dedup_tolerance(spark, sf):
    return od.moved_snapshots(view(spark, sf, "odds_snapshots")).select(*od.GAME, "source", "id")


@query(
    f"{ctes('odds_snapshots', 'historical_injuries')}, t as (select source as stream, count(*) as n_rows, count(distinct game_date) as n_days from odds_snapshots group by source "
    "union all select 'injuries', count(*), count(distinct snapshot_date) from historical_injuries) select *, case when n_days >= 30 then 'ready' when n_days >= 5 then 'partial' else 'cold' end as tier from t"
)
def readiness_status(spark, sf):
    return od.readiness_counts(view(spark, sf, "odds_snapshots"), view(spark, sf, "historical_injuries"))


_MISS = "case status when 'Out' then 1.0 when 'Doubtful' then 0.85 when 'Day-to-Day' then 0.6 when 'Questionable' then 0.5 when 'Probable' then 0.15 else 0.5 end"


@query(f"{ctes('historical_injuries')} select snapshot_date, upper(team_abbr) as team_abbr, {r(f'sum(impact_rating * {_MISS})', 'impact_out')} from historical_injuries group by 1, 2")
def injury_impact(spark, sf):
    return rounded(inj.team_impact(view(spark, sf, "historical_injuries")))


def _players(spark, sf):
    return view(spark, sf, "historical_injuries").selectExpr("team_id", "player_name", "cast(1 + player_id % 12 as int) as depth_chart_rank", "case when team_id % 2 = 0 then cast(player_id % 36 as double) else 0e0 end as minutes_per_game", "cast(player_id % 25 as double) as points_per_game", "cast(player_id % 8 as double) as assists_per_game", "cast(player_id % 10 as double) as rebounds_per_game", "player_id")


_IMPACT = (
    "p as (select team_id, lower(player_name) as name, 1 + player_id % 12 as depth, case when team_id % 2 = 0 then cast(player_id % 36 as double) else 0e0 end as mpg, "
    "cast(player_id % 25 + player_id % 8 + player_id % 10 as double) as talent from historical_injuries), "
    "m as (select *, case when sum(mpg) over (partition by team_id) > 0 then mpg when depth <= 5 then 30 when depth <= 10 then 15 else 5 end as mins from p), "
    f"h as (select team_id, lower(player_name) as name, max({_MISS}) as miss from historical_injuries group by 1, 2), "
    "v as (select m.team_id, sum(mins * coalesce(miss, 0)) / sum(mins) as missing_pct, coalesce(bool_or(mins >= 30 and miss >= 0.5), false) as star_out, sum(talent * (1 - coalesce(miss, 0))) as available_talent "
    "from m left join h on m.team_id = h.team_id and m.name = h.name group by m.team_id)"
)


@query(f"{ctes('historical_injuries')}, {_IMPACT} select team_id, {r('missing_pct', 'missing_pct')}, star_out, {r('available_talent', 'available_talent')} from v")
def player_impact(spark, sf):
    return rounded(inj.roster_impact(_players(spark, sf), view(spark, sf, "historical_injuries")))


_BOTH = "coalesce(h.{0}, 0e0) - coalesce(a.{0}, 0e0)"


@query(
    f"{ctes('games', 'historical_injuries')}, {_IMPACT}, w as (select * from v where team_id <> 7) select id, {r('coalesce(h.missing_pct, 0)', 'home_missing_minutes_pct')}, {r('coalesce(a.missing_pct, 0)', 'away_missing_minutes_pct')}, "
    f"{r('coalesce(cast(h.star_out as int), 0)', 'home_star_out')}, {r('coalesce(cast(a.star_out as int), 0)', 'away_star_out')}, {r(_BOTH.format('missing_pct'), 'diff_missing_minutes_pct')}, {r(_BOTH.format('available_talent'), 'diff_available_talent')} "
    "from games g left join w h on h.team_id = g.home_team_id left join w a on a.team_id = g.away_team_id"
)
def matchup_impact(spark, sf):
    """What both teams of each game miss; one team has no players."""
    impact = inj.roster_impact(_players(spark, sf).where("team_id <> 7"), view(spark, sf, "historical_injuries"))
    names = [f"{s}_{c}" for c in ("missing_minutes_pct", "star_out") for s in ("home", "away")] + ["diff_missing_minutes_pct", "diff_available_talent"]
    return rounded(inj.matchup_impact(view(spark, sf, "games").select("id", "home_team_id", "away_team_id"), impact).select("id", *names))


PRED = ctes("predictions")
_PRICE = "case when bet_side = 'AWAY' then 1 - market_home_prob else market_home_prob end"
SETTLED = f"""{PRED}, s as (select *, case when bet_side = 'NO BET' then 0e0 when (bet_side = 'HOME') = home_won then bet_size * (1 / ({_PRICE}) - 1) else -bet_size end as profit,
 case bet_side when 'HOME' then closing_market_prob / market_home_prob - 1 when 'AWAY' then (1 - closing_market_prob) / (1 - market_home_prob) - 1 end as clv from predictions)"""


def _settled(spark, sf):
    return mt.settled(view(spark, sf, "predictions"))


@query(f"{SETTLED} select id, date, bet_side, {r('profit', 'profit')}, {r('clv', 'clv')} from s")
def bet_settlement(spark, sf):
    return rounded(_settled(spark, sf).select("id", "date", "bet_side", "profit", "clv"))


_B = "filter (where bet_side <> 'NO BET')"


@query(
    f"{SETTLED} select count(*) as total_predictions, count(home_won) as resolved, {r('avg(cast((model_home_prob >= 0.5) = home_won as double))', 'prediction_accuracy')}, count(*) {_B} as total_bets, "
    f"count(*) filter (where bet_side <> 'NO BET' and profit > 0) as wins, count(*) filter (where bet_side <> 'NO BET' and profit < 0) as losses, {r(f'sum(abs(bet_size)) {_B}', 'total_wagered')}, {r(f'sum(profit) {_B}', 'total_profit')}, "
    f"{r(f'sum(profit) {_B} / sum(abs(bet_size)) {_B}', 'roi')}, {r(f'cast(count(*) filter (where bet_side <> \'NO BET\' and profit > 0) as double) / count(*) {_B}', 'bet_win_rate')} from s"
)
def performance_summary(spark, sf):
    return rounded(mt.performance_summary(_settled(spark, sf)))


_BIN = " + ".join(f"case when model_home_prob >= {i / 10!r}e0 then 1 else 0 end" for i in range(1, 10))
BINS = f"{PRED}, b as (select {big(_BIN, 'bin')}, count(*) as n, avg(model_home_prob) as p, avg(cast(home_won as double)) as y from predictions group by 1)"


def _bins(spark, sf):
    return mt.calibration_bins(view(spark, sf, "predictions"), "model_home_prob", F.col("home_won"))


@query(f"{BINS} select bin, n, {r('p', 'mean_predicted')}, {r('y', 'mean_actual')}, {r('abs(p - y)', 'gap')} from b")
def calibration_bins(spark, sf):
    return rounded(_bins(spark, sf))


@query(f"{BINS} select {r('sum(n * abs(p - y)) / sum(n)', 'ece')} from b")
def calibration_error(spark, sf):
    return rounded(mt.calibration_error(_bins(spark, sf)))


@query(
    f"{PRED}, p as (select model_home_prob as p, cast(home_won as double) as y from predictions) select {r('avg((p - y) * (p - y))', 'brier')}, "
    f"{r('avg(-(y * ln(p) + (1 - y) * ln(1 - p)))', 'log_loss')}, {r('avg(cast((p >= 0.5) = (y = 1) as double))', 'accuracy')} from p"
)
def probability_scores(spark, sf):
    return rounded(mt.probability_scores(view(spark, sf, "predictions"), F.col("model_home_prob"), F.col("home_won")))


@query(f"{SETTLED}, v as (select clv from s where bet_side <> 'NO BET') select count(clv) as clv_count, {r('avg(clv)', 'avg_clv')}, {r('avg(clv) / (stddev_pop(clv) / sqrt(count(clv)))', 'clv_tstat')} from v")
def clv_tstat(spark, sf):
    return rounded(mt.clv_summary(_settled(spark, sf)))


@query(
    f"{SETTLED} select id, date, bet_side, {r(_PRICE, 'bet_price')}, {r('case when bet_side = \'HOME\' then closing_market_prob else 1 - closing_market_prob end', 'close_price')}, {r('clv', 'clv')}, "
    "case when (bet_side = 'HOME') = home_won then 'W' else 'L' end as result from s where bet_side <> 'NO BET'"
)
def clv_detail(spark, sf):
    return rounded(mt.clv_detail(_settled(spark, sf)))


CURVE = f"{SETTLED}, c as (select date, sum(profit) as day_profit from s where bet_side <> 'NO BET' group by date), k as (select date, day_profit, 1000 + sum(day_profit) over (order by date) as bankroll from c)"


@query(f"{CURVE} select date, {r('day_profit', 'day_profit')}, {r('bankroll', 'bankroll')} from k")
def bankroll_curve(spark, sf):
    return rounded(mt.bankroll_curve(_settled(spark, sf)))


@query(f"{CURVE}, p as (select bankroll, greatest(1000, max(bankroll) over (order by date)) as peak from k) select {r('greatest(max((peak - bankroll) / peak), 0)', 'max_drawdown')} from p")
def max_drawdown(spark, sf):
    return rounded(mt.max_drawdown(mt.bankroll_curve(_settled(spark, sf))))


@query(f"{SETTLED}, l as (select * from s where bet_side <> 'NO BET' order by date desc, id desc limit 10), q as (select count(*) as n, sum(profit) / sum(abs(bet_size)) as roi from l) select n, {r('roi', 'roi')}, {r('case when n < 5 then 1 when roi < -0.1 then 0.25 when roi < -0.05 then 0.5 else 1 end', 'multiplier')} from q")
def recent_roi(spark, sf):
    return rounded(mt.recent_roi(_settled(spark, sf)))


_EDGE = "model_home_prob / market_home_prob - 1"
_BADGE = "case when {0} >= 0.15 then 'SUSPECT' when {0} >= 0.05 then 'STRONG' when {0} >= 0.03 then 'MODERATE' when {0} >= 0.02 then 'LEAN' else 'NO BET' end"


@query(f"{PRED} select {_BADGE.format('(' + _EDGE + ')')} as badge, count(*) as n, count(*) filter (where home_won) as wins from predictions group by 1")
def badge_distribution(spark, sf):
    return mt.badge_distribution(view(spark, sf, "predictions"), bet.edge(F.col("model_home_prob"), F.col("market_home_prob")), F.col("home_won"))


@query(
    f"{PRED}, e as (select date, count(*) {_B} as n_bets, coalesce(sum(bet_size) {_B}, 0) as total_stake from predictions group by date) "
    f"select date, n_bets, {r('total_stake', 'total_stake')}, {r('total_stake / 1000', 'exposure')}, {r('case when n_bets > 1 then 1 / sqrt(1 + (n_bets - 1) * 0.15) else 1 end', 'haircut')} from e"
)
def slate_exposure(spark, sf):
    return rounded(mt.slate_exposure(view(spark, sf, "predictions"), "date"))


@query(f"{PRED}, f as (select id, date, bet_size / 1000 as f, sum(bet_size / 1000) over (partition by date) as t from predictions) select id, date, {r('f', 'fraction')}, {r('case when t > 0.25 then f * 0.25 / t else f end', 'capped')} from f")
def capped_stakes(spark, sf):
    rows = view(spark, sf, "predictions").selectExpr("id", "date", "bet_size / 1000 as fraction")
    return rounded(mt.capped_stakes(rows, "date", "fraction"))


_ML = "cast((o_orderkey * 37) % 901 - 450 as double)"
_MA = "cast((o_custkey * 53) % 701 - 350 as double)"


@query(
    f"with m as (select o_orderkey as id, nullif({_ML}, -450) as h, case when o_custkey % 3 = 0 then null else {_MA} end as a, case when o_orderkey % 5 = 0 then null else cast(o_orderkey % 21 - 10 as double) end as s from orders), "
    "q as (select *, case when h < 0 then -h / (100 - h) when h > 0 then 100 / (h + 100) when h = 0 then 0.5 end as hp, case when a < 0 then -a / (100 - a) when a > 0 then 100 / (a + 100) when a = 0 then 0.5 end as ap from m) "
    f"select id, {r('case when hp is not null and ap is not null and hp + ap > 0 then hp / (hp + ap) when hp is not null then hp when ap is not null then 1 - ap when s is not null then least(greatest(0.5 - 0.025 * s, 0.05), 0.95) end', 'home_prob')} from q where hp is not null or ap is not null or s is not null"
)
def devigged_prices(spark, sf):
    m = view(spark, sf, "orders").selectExpr("o_orderkey as id", f"nullif({_ML}, -450) as h", f"case when o_custkey % 3 = 0 then null else {_MA} end as a", "case when o_orderkey % 5 = 0 then null else cast(o_orderkey % 21 - 10 as double) end as s")
    out = m.select("id", bet.devig(F.col("h"), F.col("a"), F.col("s")).alias("home_prob"))
    return rounded(out.where("home_prob is not null"))


_LOGIT = "ln(least(greatest({0}, 1e-6), 1 - 1e-6) / (1 - least(greatest({0}, 1e-6), 1 - 1e-6)))"
_SHRUNK = f"1 / (1 + exp(-(0.4 * {_LOGIT.format('model_home_prob')} + 0.6 * {_LOGIT.format('market_home_prob')})))"
DECIDED = f"""{PRED}, z as (select *, {_SHRUNK} as p from predictions), e as (select *, p / market_home_prob - 1 as he, (1 - p) / (1 - market_home_prob) - 1 as ae from z),
 b as (select *, case when he > ae and he >= 0.02 and p >= 0.3 then 'HOME' when ae >= 0.02 and 1 - p >= 0.3 then 'AWAY' else 'NO BET' end as side from e),
 g as (select *, case when side = 'NO BET' then greatest(he, ae) when side = 'HOME' then he else ae end as edge, case when side = 'HOME' then p else 1 - p end as q, case when side = 'HOME' then market_home_prob else 1 - market_home_prob end as m from b),
 k as (select *, q - m as gap, least(greatest(0.25 * case when q - m < 0.02 then 0.6 when q - m <= 0.08 then 1 when q - m <= 0.12 then 0.9 when q - m <= 0.2 then 0.75 else 0.5 end
   * case when abs(q - m) >= 0.2 then 0.65 when abs(q - m) >= 0.15 then 0.85 else 1 end, 0.0625), 0.3125) as l from g),
 f as (select *, case when side = 'NO BET' or q <= m then 0 else least((q - m) / (1 - m) * l, 0.05) end as kelly from k)"""


@query(
    f"{DECIDED}, n as (select *, count(*) filter (where side <> 'NO BET') over (partition by date) as n from f), h as (select *, kelly * case when n > 1 then 1 / sqrt(1 + (n - 1) * 0.15) else 1 end as kk from n) "
    f"select id, date, side, {r('p', 'home_prob')}, {r('edge', 'edge')}, case when side = 'NO BET' then 'NO BET' else {_BADGE.format('edge')} end as badge, {r('kk', 'kelly_pct')}, {r('kk * 1000', 'bet_size')} from h"
)
def bet_recommendations(spark, sf):
    rows = rec.recommendations(view(spark, sf, "predictions").drop("bet_size"), "date")
    return rounded(rows.select("id", "date", "side", "home_prob", "edge", "badge", "kelly_pct", "bet_size"))


BACKTEST = f"""{DECIDED}, t as (select *, (side = 'HOME') = home_won as won from f where side <> 'NO BET' and kelly > 0),
 u as (select *, ln(case when won then 1 + kelly * (1 / m - 1) else 1 - kelly end) as lf from t),
 v as (select *, ln(1000) + sum(lf) over (order by date, id) as la, ln(1000) + sum(lf) over (order by date, id) - lf as lb from u)"""


def _backtest(spark, sf):
    return rec.backtest(view(spark, sf, "predictions").drop("bet_size"))


@query(f"{BACKTEST} select id, date, side, won, {r('kelly', 'kelly_pct')}, {r('la', 'log_bankroll')} from v")
def backtest_bets(spark, sf):
    return rounded(_backtest(spark, sf).select("id", "date", "side", "won", "kelly_pct", F.col("log_after").alias("log_bankroll")))


@query(
    f"{BACKTEST}, t1 as (select greatest(max(la), max(lb)) as top from v), x as (select won, edge, kelly, case when won then 1 / m - 1 else -1 end as ret, exp(lb - top) as b, exp(la - top) as a, top from v, t1) "
    f"select count(*) as n_bets, count(*) filter (where won) as wins, {r('avg(cast(won as double))', 'win_rate')}, {r('avg(edge)', 'avg_edge')}, {r('avg(kelly)', 'avg_kelly')}, {r('avg(ret) / stddev_samp(ret) * sqrt(count(*))', 'sharpe')}, "
    f"{r('sum(a - b) / sum(b * kelly)', 'roi')}, {r('max(top) + ln(sum(b * kelly))', 'log_wagered')} from x"
)
def backtest_summary(spark, sf):
    bets = written(_backtest(spark, sf), "bets")
    s, k = rec.backtest_summary(bets), bets.agg(F.avg("kelly_pct").alias("avg_kelly"))
    return rounded(s.select(F.col("total_bets").alias("n_bets"), "wins", "win_rate", "avg_edge", "sharpe", "roi", "log_wagered").crossJoin(k))


_DATES = "select distinct make_date(cast(y as int), 7, 1) as split from (select unnest(generate_series(year(lo), year(hi))) as y, lo, hi from r) where make_date(cast(y as int), 7, 1) > lo and make_date(cast(y as int), 7, 1) < hi"


@query(
    f"{PRED}, r as (select min(date) as lo, max(date) as hi from predictions), s as ({_DATES} order by split desc limit 3), "
    "f as (select split, cast(row_number() over (order by split) - 1 as bigint) as fold, lead(split) over (order by split) as until from s) "
    "select fold, split, count(*) filter (where date < split) as n_train, count(*) filter (where date >= split and (until is null or date < until)) as n_test from f, predictions group by all having n_train >= 100 and n_test >= 50"
)
def walk_forward_folds(spark, sf):
    return rounded(models.folds(view(spark, sf, "predictions")))


@query(
    f"{PRED}, w as (select unnest(generate_series(0, 10)) / 10e0 as weight), p as (select weight, cast(home_won as double) as y, 1 / (1 + exp(-(weight * {_LOGIT.format('market_home_prob')} + (1 - weight) * {_LOGIT.format('model_home_prob')}))) as p from predictions, w) "
    f"select {r('weight', 'weight')}, {r('avg(-(y * ln(p) + (1 - y) * ln(1 - p)))', 'log_loss')} from p group by p.weight"
)
def ensemble_weight_grid(spark, sf):
    return rounded(models.weight_grid(view(spark, sf, "predictions"), "market_home_prob", "model_home_prob", F.col("home_won")))


#: Paths of a simulation.
_SIMULATIONS = 10_000


def _bets(spark, sf):
    """Every settled bet, seen from its side, numbered by id from 0: places within ranges of ids, and the ranges' offsets."""
    rows = view(spark, sf, "predictions").where("bet_side in ('HOME', 'AWAY') and home_won is not null")
    home = F.col("bet_side") == "HOME"
    of = lambda p: F.when(home, F.col(p)).otherwise(1 - F.col(p))
    rows = rows.repartitionByRange("id").sortWithinPartitions("id").select(F.monotonically_increasing_id().alias("place"), of("model_home_prob").alias("model_prob"), of("market_home_prob").alias("market_prob"), (home == F.col("home_won")).alias("won"))
    rows = written(rows.withColumn("part", F.shiftright("place", 33)), "bets")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = rows.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    idx = F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("offset")
    return rows.join(F.broadcast(offsets), "part").select(idx.alias("idx"), "model_prob", "market_prob", "won")


def _paths(spark, sf, mode):
    return sim.bankroll_paths(_bets(spark, sf), _SIMULATIONS, mode)


def _logged(paths):
    return rounded(paths.select("sim", "log_growth", "max_drawdown", "n_bets"))


@query()
def montecarlo_market_null(spark, sf):
    return _logged(_paths(spark, sf, "market_right"))


@query()
def montecarlo_empirical(spark, sf):
    return _logged(_paths(spark, sf, "empirical"))


@query()
def montecarlo_summary(spark, sf):
    return rounded(sim.simulation_summary(_paths(spark, sf, "empirical")))


@query()
def montecarlo_skill_gap(spark, sf):
    return rounded(sim.skill_gap(*(sim.simulation_summary(_paths(spark, sf, m)) for m in ("empirical", "market_right"))))


@query()
def portfolio_optimum(spark, sf):
    home = "bet_side = 'HOME'"
    rows = view(spark, sf, "predictions").where("bet_side <> 'NO BET'").selectExpr("date as slate", "id", f"if({home}, model_home_prob, 1 - model_home_prob) as prob", f"if({home}, market_home_prob, 1 - market_home_prob) as price")
    return rounded(sim.optimised_slates(rows))


_NAMES = "[" + ", ".join(f"'{n}'" for n, _ in text.NICKNAMES) + "]"
_TABLE = "(values " + ", ".join(f"({i}, '{n}', '{a}')" for i, (n, a) in enumerate(text.NICKNAMES)) + ") t(i, n, a)"
_TITLE = f"concat('The ', {_NAMES}[1 + c_custkey % 35], case when c_custkey % 4 = 0 then ' vs. ' else ' vs ' end, upper({_NAMES}[1 + (c_custkey * 7 + 3) % 35]), case when c_custkey % 9 = 0 then ' Champion' else '' end)"


@query(
    f"with c as (select c_custkey as id, {_TITLE} as title from customer), p as (select id, title, regexp_split_to_array(title, '\\s+vs\\.?\\s+') as parts from c), t as (select * from {_TABLE}), "
    "m as (select p.id, p.title, arg_min(t1.a, t1.i) as first from p left join t t1 on contains(lower(trim(p.parts[1])), t1.n) group by 1, 2), "
    "q as (select p.id, arg_min(t2.a, (case when lower(trim(p.parts[2])) = t2.n then 0 else 1 end, t2.i)) as second from p left join t t2 on contains(lower(trim(p.parts[2])), t2.n) group by 1) "
    "select m.id, case when first <> second then first end as first, case when first <> second then second end as second, contains(lower(title), 'vs') and not contains(lower(title), 'champion') as is_game from m join q on m.id = q.id"
)
def name_normalize(spark, sf):
    names = F.array(*(F.lit(n) for n, _ in text.NICKNAMES))
    pick = lambda x: F.element_at(names, F.expr(x).cast("int"))
    c = view(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("The "), pick("1 + c_custkey % 35"), F.when(F.expr("c_custkey % 4 = 0"), " vs. ").otherwise(" vs "), F.upper(pick("1 + (c_custkey * 7 + 3) % 35")), F.when(F.expr("c_custkey % 9 = 0"), " Champion").otherwise("")).alias("title"))
    return c.select("id", text.title_teams(F.col("title")).alias("t"), text.is_game_title(F.col("title")).alias("is_game")).select("id", F.col("t.first").alias("first"), F.col("t.second").alias("second"), "is_game")


@query("select event_id, strftime(timezone('America/New_York', timezone('UTC', ts)), '%Y-%m-%d') as et_date, strftime(ts, '%Y%m%d') as utc_day from events")
def utc_to_et_date(spark, sf):
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return view(spark, sf, "events").select("event_id", text.eastern_date(stamp).alias("et_date"), text.compact_date(F.to_date("ts")).alias("utc_day"))


@query(
    f"{ctes('games')}, g as (select id, cast(home_score - away_score + id % 7 as double) as margin, cast(home_score + away_score as double) as total, cast(id % 25 - 12 as double) as spread, cast(195 + id % 40 as double) as line from games) "
    "select id, case when margin + spread >= 1.5 then concat('H ', printf('%+.1f', spread)) when margin + spread <= -1.5 then concat('A ', printf('%+.1f', -spread)) else 'NO BET' end as spread_pick, "
    "case when total - line >= 2.5 then concat('OVER ', printf('%.1f', line)) when total - line <= -2.5 then concat('UNDER ', printf('%.1f', line)) else 'NO BET' end as total_pick from g"
)
def spread_total_picks(spark, sf):
    g = view(spark, sf, "games").selectExpr("id", "cast(home_score - away_score + id % 7 as double) as margin", "cast(home_score + away_score as double) as total", "cast(id % 25 - 12 as double) as spread", "cast(195 + id % 40 as double) as line")
    return g.select("id", bet.spread_pick(F.col("margin"), F.col("spread"), F.lit("H"), F.lit("A")).alias("spread_pick"), bet.total_pick(F.col("total"), F.col("line")).alias("total_pick"))


@query(
    f"{ctes('games', 'odds_snapshots')}, p as (select distinct least(home_team_id, away_team_id) as a, greatest(home_team_id, away_team_id) as b, game_date, id, home_prob from odds_snapshots), "
    "d as (select a, b, game_date, arg_min(home_prob, id) as home_prob, min(id) as ordinal from p where home_prob is not null group by 1, 2, 3) "
    f"select g.id, {r('d.home_prob', 'home_prob')}, d.ordinal from games g left join d on least(g.home_team_id, g.away_team_id) = d.a and greatest(g.home_team_id, g.away_team_id) = d.b and d.game_date = cast(date '2024-01-01' + cast(g.id % 300 as int) as date)"
)
def odds_matching(spark, sf):
    slate = view(spark, sf, "games").select("id", F.col("home_team_id").alias("home"), F.col("away_team_id").alias("away"), F.expr("date_add(date '2024-01-01', cast(id % 300 as int))").alias("et_date"))
    odds = view(spark, sf, "odds_snapshots").where("home_prob is not null").select(F.col("home_team_id").alias("team_a"), F.col("away_team_id").alias("team_b"), "game_date", F.col("id").alias("ordinal"), "home_prob")
    return rounded(od.match_games(slate, odds).select("id", "home_prob", "ordinal"))


_IMPACT = f"i as (select team_id, sum(impact_rating * {_MISS}) as out_ from historical_injuries group by 1)"


@query(
    f"{ctes('predictions', 'historical_injuries')}, {_IMPACT} select p.id, "
    + r("least(greatest(model_home_prob + greatest(-0.15, -0.006 * coalesce(h.out_, 0)) - greatest(-0.15, -0.006 * coalesce(a.out_, 0)), 0.01), 0.99)", "home_prob")
    + " from predictions p left join i h on h.team_id = p.home_team_id left join i a on a.team_id = p.away_team_id"
)
def injury_adjusted_probs(spark, sf):
    hurt = view(spark, sf, "historical_injuries").groupBy("team_id").agg(F.sum(F.col("impact_rating") * bet.miss_probability(F.col("status"))).alias("out"))
    side = lambda s: hurt.select(F.col("team_id").alias(f"{s}_team_id"), F.col("out").alias(s))
    rows = view(spark, sf, "predictions").join(side("home"), "home_team_id", "left").join(side("away"), "away_team_id", "left")
    return rounded(rows.select("id", bet.adjusted_prob(F.col("model_home_prob"), F.col("home"), F.col("away")).alias("home_prob")))


@query(f"{PRED}, p as (select id, market_home_prob as h, 1 - closing_market_prob as a from predictions) select id, {r('h', 'home_price')}, {r('a', 'away_price')} from p where h > 0.01 and h < 0.99 and a > 0.01 and a < 0.99 and abs(h + a - 1) <= 0.05")
def sane_prices(spark, sf):
    rows = view(spark, sf, "predictions").select("id", F.col("market_home_prob").alias("home_price"), (1 - F.col("closing_market_prob")).alias("away_price"))
    return rounded(rows.where(bet.sane_prices(F.col("home_price"), F.col("away_price"))))


@query(
    f"{PRED} select id, {r('case when id % 3 = 0 then market_home_prob when id % 3 = 1 then closing_market_prob else 0 end', 'market_home_prob')}, "
    f"{r('case when id % 3 = 0 then 1 - market_home_prob when id % 3 = 1 then 1 - closing_market_prob else 0 end', 'market_away_prob')} from predictions"
)
def market_prices(spark, sf):
    rows = view(spark, sf, "predictions")
    prices = lambda c, when: rows.where(when).select("id", F.col(c).alias("home_price"), (1 - F.col(c)).alias("away_price"))
    out = rec.with_prices(rows.select("id"), prices("market_home_prob", "id % 3 = 0"), prices("closing_market_prob", "id % 3 < 2"), ["id"])
    return rounded(out)


@query(f"{ctes('predictions', 'games')} select p.id, g.home_score > g.away_score as home_won from predictions p join games g on p.date = g.date and p.home_team_id = g.home_team_id and p.away_team_id = g.away_team_id")
def resolved_predictions(spark, sf):
    return rec.resolved(view(spark, sf, "predictions"), view(spark, sf, "games")).select("id", "home_won")


@query(
    f"{PRED} select p.id, cast(null as double) as opening_market_prob from predictions p where not exists (select 1 from predictions q where q.id % 2 = 0 and q.date = p.date and q.home_team_id = p.home_team_id and q.away_team_id = p.away_team_id)"
)
def new_predictions(spark, sf):
    rows = view(spark, sf, "predictions")
    return rec.new_predictions(rows, rows.where("id % 2 = 0"), od.opening_line(view(spark, sf, "odds_snapshots"))).select("id", "opening_market_prob")


@query(f"{ctes('games')} select id as game_id, date, home_team_id, away_team_id, {big('home_score', 'home_score')}, {big('away_score', 'away_score')}, home_score > away_score as home_win from games where id % 7 <> 0 and id % 5 <> 0")
def new_games(spark, sf):
    games = view(spark, sf, "games")
    rows = wn.game_rows(games).where("game_id % 7 <> 0 or is_home")
    log = rows.withColumn("matchup", F.when(F.col("is_home"), "A vs. B").otherwise("B @ A")).select("game_id", "team_id", "matchup", "pts", "date", "season")
    return rounded(sn.new_games(log, games.where("id % 5 = 0")).drop("season"))


@query(
    f"{ctes('historical_injuries')} select player_name, case when player_id % 10 = 0 then 'Out' else status end as status, {r('case when player_id % 10 = 0 then 9 else impact_rating end', 'impact_rating')} from historical_injuries "
    "union all select concat('Manual ', player_name), 'Out', 9.0 from historical_injuries where player_id % 25 = 0"
)
def injury_overrides(spark, sf):
    rows = view(spark, sf, "historical_injuries").select("player_id", "player_name", "status", "impact_rating")
    manual = rows.where("player_id % 10 = 0").withColumn("player_name", F.upper("player_name"))
    manual = manual.unionByName(rows.where("player_id % 25 = 0").withColumn("player_name", F.concat(F.lit("Manual "), "player_name")))
    manual = manual.withColumn("status", F.lit("Out")).withColumn("impact_rating", F.lit(9.0)).drop("player_id")
    out = inj.with_overrides(rows.drop("player_id"), manual)
    return rounded(out.withColumn("player_name", F.regexp_replace("player_name", "^CUSTOMER", "Customer")))


_SCRATCH = "team_id % 3 <> 0 and player_id % 4 <> 0 and impact_rating >= 7 and status not in ('Out', 'Doubtful')"


@query(f"{ctes('historical_injuries')} select player_id, case when {_SCRATCH} then 'Out' else status end as status, {r(f'case when {_SCRATCH} then greatest(impact_rating, 10) else impact_rating end', 'impact_rating')} from historical_injuries")
def lineup_scratches(spark, sf):
    rows = view(spark, sf, "historical_injuries")
    starters = rows.where("team_id % 3 <> 0").groupBy("team_abbr").agg(F.concat(F.array(F.lit("nobody")), F.collect_list(F.when(F.expr("player_id % 4 = 0"), F.upper("player_name")))).alias("names"))
    return rounded(inj.lineup_bumps(rows, starters).select("player_id", "status", "impact_rating"))


@query(f"{ctes('games', 'odds_snapshots')}, c as (select distinct home_team_id, away_team_id from odds_snapshots where home_prob is not null) select {r('avg(case when c.home_team_id is null then 0e0 else 1e0 end)', 'coverage')} from games g left join c on g.home_team_id = c.home_team_id and g.away_team_id = c.away_team_id")
def odds_coverage(spark, sf):
    lines = od.closing_line(view(spark, sf, "odds_snapshots")).groupBy("home_team_id", "away_team_id").agg(F.max("home_prob").alias("price"))
    return rounded(rec.odds_coverage(view(spark, sf, "games").join(lines, ["home_team_id", "away_team_id"], "left"), "price"))


@query(f"{ctes('games')}, f as (select min(date) as d from games where date >= date '1995-03-04' and date_diff('day', date '1995-03-04', date) <= 7) select id, date from games, f where date = d")
def first_busy_day(spark, sf):
    return sn.first_busy_day(view(spark, sf, "games"), "1995-03-04").select("id", "date")


@query(f"{ODDS} select date_trunc('hour', timestamp) as hour, source, count(*) as n, cast(sum(cast(round(home_prob * 1000000000) as bigint)) as bigint) // count(home_prob) / 1000000000 as mean_prob from odds_snapshots group by 1, 2")
def hourly_activity(spark, sf):
    rows = streaming.windowed_activity(view(spark, sf, "odds_snapshots"))
    return rows.select(F.col("window.start").alias("hour"), "source", "n", "mean_prob")


@query(f"{PRED} select id, {r('1 / (1 + pow(10e0, -(1400 + id % 200 + 100 - (1450 + id % 170)) / 400e0))', 'elo_home_prob')}, {r('1500 + 0.75 * (1400 + id % 200 - 1500)', 'carried')} from predictions")
def elo_expectations(spark, sf):
    home, away = F.expr("cast(1400 + id % 200 as double)"), F.expr("cast(1450 + id % 170 as double)")
    return rounded(view(spark, sf, "predictions").select("id", bb.elo_home_prob(home, away).alias("elo_home_prob"), bb.elo_carry(home).alias("carried")))


@query(f"{SETTLED} select {r('avg(ret) / stddev_samp(ret) * sqrt(count(ret))', 'sharpe')}, count(ret) as n from (select profit / nullif(bet_size, 0) as ret from s where bet_side <> 'NO BET') t")
def sharpe_ratio(spark, sf):
    rows = _settled(spark, sf).where(mt.BETS)
    return rounded(mt.sharpe(rows, F.try_divide(F.col("profit"), F.col("bet_size"))))


@query(f"{SETTLED}, p as (select profit from s where bet_side <> 'NO BET') select " + ", ".join(r(f"quantile_cont(profit, {q})", f"pct_{n}") for n, q in ((5, 0.05), (25, 0.25), (50, 0.5), (75, 0.75), (95, 0.95))) + f", {r('avg(profit)', 'mean')}, {r('max(profit)', 'max')} from p")
def profit_quantiles(spark, sf):
    return rounded(mt.quantiles(_settled(spark, sf).where(mt.BETS), "profit"))


#: The recurrence in SQL: games in order, ratings of all teams as lists.
_RATED = f"""{ctes("games", "game_stats").replace("with ", "with recursive ", 1)},
o as (select row_number() over (order by date, id) as k, id, date, season, home_team_id + 1 as h, away_team_id + 1 as a, cast(home_score as double) as sh, cast(away_score as double) as sa from games),
s as (select *, season is distinct from lag(season) over (order by k) and k > 1 as fresh, case when sh > sa then 1e0 else 0e0 end as win from o),
z as (select cast(0 as bigint) as k, list_transform(generate_series(1, 25), lambda x: 1500e0) as e, list_transform(generate_series(1, 25), lambda x: 1500e0) as f, list_transform(generate_series(1, 25), lambda x: 1500e0) as d,
  0e0 as eh, 0e0 as ea, 0e0 as fh, 0e0 as fa, 0e0 as dh, 0e0 as da, 0e0 as up, 0e0 as oh, 0e0 as oa
 union all
 select k, [case when i = h then eh + up when i = a then ea - up else e[i] end for i in range(1, 26)], [case when i = h then fh + oh when i = a then fa + oa else f[i] end for i in range(1, 26)],
  [case when i = h then dh - oa when i = a then da - oh else d[i] end for i in range(1, 26)], eh, ea, fh, fa, dh, da, up, oh, oa from (
 select *, 20 * pow(abs(sh - sa) + 3, 0.8e0) / (7.5e0 + 0.006e0 * ew) / (1 + exp(ew / 200)) * (win - 1 / (1 + pow(10e0, -(eh + 100 - ea) / 400))) as up,
  half * (sh - 110 - 0.05e0 * (fh - da)) as oh, half * (sa - 110 - 0.05e0 * (fa - dh)) as oa from (
 select *, 10 * pow(abs(sh - sa) + 3, 0.8e0) / (7.5e0 + 0.006e0 * pw) / (1 + exp(pw / 200)) / 12 as half from (
 select *, case when win = 1 then eh - ea else ea - eh end as ew, case when win = 1 then fh + dh - fa - da else fa + da - fh - dh end as pw from (
 select *, e[h] as eh, e[a] as ea, f[h] as fh, f[a] as fa, d[h] as dh, d[a] as da from (
 select s.k, s.h, s.a, s.sh, s.sa, s.win, case when s.fresh then list_transform(z.e, lambda x: 1500 + 0.75e0 * (x - 1500)) else z.e end as e, case when s.fresh then list_transform(z.f, lambda x: 1500 + 0.75e0 * (x - 1500)) else z.f end as f,
  case when s.fresh then list_transform(z.d, lambda x: 1500 + 0.75e0 * (x - 1500)) else z.d end as d from z join s on s.k = z.k + 1) t0) t1) t2) t3) t4),
elo as (select s.id as game_id, s.h - 1 as team_id, s.date, eh as elo_before, eh + up as elo_after, fh as elo_off_before, fh + oh as elo_off_after, dh as elo_def_before, dh - oa as elo_def_after from z join s using (k)
 union all select s.id, s.a - 1, s.date, ea, ea - up, fa, fa + oa, da, da - oh from z join s using (k))"""
_ELO = ("elo_before", "elo_after", "elo_off_before", "elo_off_after", "elo_def_before", "elo_def_after")
_LAST = f"{_RATED}, last as (select team_id, arg_max(elo_after, (date, game_id)) as elo, arg_max(elo_off_after, (date, game_id)) as elo_off, arg_max(elo_def_after, (date, game_id)) as elo_def from elo group by 1)"


def _history(spark, sf):
    """Ratings before and after each game: one ordered stream of rows for a league, so one task; written once."""
    return written(ratings.elo_history(view(spark, sf, "games")), "ratings")


@query(f"{_RATED} select game_id, team_id, date, {', '.join(r(c, c) for c in _ELO)} from elo")
def elo_history(spark, sf):
    return rounded(ratings.elo_history(view(spark, sf, "games")))


@query(f"{_RATED} select game_id, team_id, date, {', '.join(r(c, c) for c in _ELO)} from elo")
def elo_sync_history(spark, sf):
    """Ratings of a store that took in most games, then the newest, then late and corrected ones: the same as of one fold."""
    games = view(spark, sf, "games")
    store = ratings.rating_store(spark, f"{shared_dir(spark)}/ratings-{uuid.uuid4().hex}")
    late = F.col("id") % 1009 == 7
    wrong = F.when(F.col("id") % 1013 == 11, 150).otherwise(F.col("home_score"))
    cut = games.agg(F.date_sub(F.max("date"), 60)).first()[0]
    ratings.sync_ratings(store, games.where(~late & (F.col("date") < F.lit(cut))).withColumn("home_score", wrong))
    ratings.sync_ratings(store, games.where(~late & (F.col("date") >= F.lit(cut))))
    ratings.sync_ratings(store, games)
    return rounded(ratings.stored_history(store).drop("league"))


@query(f"{_LAST} select team_id, {', '.join(r(c, c) for c in ('elo', 'elo_off', 'elo_def'))} from last")
def elo_leaderboard(spark, sf):
    return rounded(ratings.leaderboard(ratings.elo_history(view(spark, sf, "games"))))


@query(f"{_LAST} select count(*) as n_teams, {r('min(elo)', 'min_elo')}, {r('avg(elo)', 'mean_elo')}, {r('max(elo)', 'max_elo')} from last")
def elo_diagnosis(spark, sf):
    return rounded(ratings.rating_summary(ratings.elo_history(view(spark, sf, "games"))))


def _form(spark, sf):
    history = _history(spark, sf)
    return ft.team_form(view(spark, sf, "game_stats"), history), history


_OPPONENT = f"""{_RATED}, g as (select t.*, cast(pts - pts_against as double) as net, coalesce(o.elo_before, 1500e0) as opp from game_stats t
 left join elo o on o.game_id = t.game_id and o.team_id = case when t.team_id = t.home_team_id then t.away_team_id else t.home_team_id end),
w as (select game_id, team_id, {", ".join(f"{roll('net', n, n // 2)} as net{n}, {roll('opp', n, n // 2)} as opp{n}" for n in config.WINDOWS)} from g)"""


@query(f"{_OPPONENT} select game_id, team_id, {', '.join(r(f'net{n} / least(greatest(1 + (opp{n} - 1500) / 500, 0.5e0), 1.5e0)', f'adj_net_rtg_roll_{n}') + ', ' + r(f'opp{n}', f'opp_elo_roll_{n}') for n in config.WINDOWS)} from w")
def sos_adjusted_rating(spark, sf):
    history = _history(spark, sf)
    # Places come before ratings, which are then joined once.
    rows = wn.ranged(ratings.with_opponent_elo(wn.with_derived(wn.placed(view(spark, sf, "game_stats"))), history))
    rows = wn.unranged(wn.with_adjusted(wn.with_rolling(rows, ["net_rtg_game", "opp_elo"])))
    return rounded(rows.select("game_id", "team_id", *(f"adj_net_rtg_roll_{n}" for n in config.WINDOWS), *(f"opp_elo_roll_{n}" for n in config.WINDOWS)))


def _matrix(spark, sf):
    """The feature matrix of usable rows, written once, with the names of its features."""
    form, history = _form(spark, sf)
    matrix = ft.game_matrix(form, history, view(spark, sf, "historical_injuries"), view(spark, sf, "odds_snapshots"), view(spark, sf, "teams"))
    names = ft.feature_names(form.columns)
    return written(ft.usable_rows(matrix, names), "matrix"), names


def _matrix_sql() -> str:
    """The whole matrix in SQL: every feature from the definitions above, for home and away rows."""
    has = ["pts", "pts_against", "net_rtg_game", "fg3_pct", "oreb", "dreb", "ast", "tov", "plus_minus", *wn.FACTORS]
    rolled = [*has, "poss", "opp_elo"]
    rest = {"rest_days": f"case when lag(date) {BY_TEAM} is null then 3 else least(date_diff('day', lag(date) {BY_TEAM}, date), 7) end", "is_back_to_back": f"coalesce(cast(date_diff('day', lag(date) {BY_TEAM}, date) <= 1 as int), 0)"}
    rest |= {f"games_last_{n}": _DAYS.format(n) for n in (7, 14)}
    windows = [f"{roll(c, n, n // 2)} as {c}_roll_{n}" for c in rolled for n in config.WINDOWS] + [f"{roll('x', n, 2)} as b{n}" for n in config.B2B_WINDOWS] + [f"{roll(f'{c}_{v}', n, n // 3)} as w_{c}_{v}_{n}" for c, v, n in _SPLITS]
    windows += [f"case when count({c}) {_UP} >= 2 then sum({c} * {_W}) {_UP} / sum(case when {c} is not null then {_W} end) {_UP} end as {c}_ewm_10" for c in ("net_rtg_game", "plus_minus")]
    last = [f"{_FILL.format(f'b{n}')} as fg3_pct_b2b_roll_{n}" for n in config.B2B_WINDOWS] + [f"{_FILL.format(f'w_{c}_{v}_{n}')} as {c}_{v}_split_roll_{n}" for c, v, n in _SPLITS]
    last += [f"net_rtg_game_roll_{n} / least(greatest(1 + (opp_elo_roll_{n} - 1500) / 500, 0.5e0), 1.5e0) as adj_net_rtg_roll_{n}" for n in config.WINDOWS]
    last += [f"case when pts_roll_{n} is null or pts_against_roll_{n} is null then 0.5e0 else least(greatest(1 / (1 + exp(14 * (ln(pts_against_roll_{n}) - ln(pts_roll_{n})))), 0.01e0), 0.99e0) end as pyth_roll_{n}" for n in config.WINDOWS]
    x = {"home_elo": "h.elo_before", "away_elo": "a.elo_before", "elo_diff": "h.elo_before - a.elo_before", "elo_home_prob": "1 / (1 + pow(10e0, -(h.elo_before + 100 - a.elo_before) / 400))"}
    x |= {f"{s}_elo_{k}": f"{s[0]}.elo_{k}_before" for s in ("home", "away") for k in ("off", "def")} | {f"elo_{k}_diff": f"h.elo_{k}_before - a.elo_{k}_before" for k in ("off", "def")}
    x |= {"home_off_vs_away_def": "h.elo_off_before - a.elo_def_before", "away_off_vs_home_def": "a.elo_off_before - h.elo_def_before", "rest_diff": "h.rest_days - a.rest_days"}
    x |= {f"{s}_{c}": f"{s[0]}.{c}" for s in ("home", "away") for c in ft.REST} | {f"{s}_injury_impact_out": f"coalesce(i{s[0]}.out_, 0)" for s in ("home", "away")}
    x |= {"injury_impact_diff": "coalesce(ih.out_, 0) - coalesce(ia.out_, 0)"} | {n: f"coalesce(m.{n}, 0)" for n in _MOVES}
    for n in config.WINDOWS:
        x |= {f"diff_{c}_roll_{n}": f"h.{c}_roll_{n} - a.{c}_roll_{n}" for c in (*rolled, "pyth", "adj_net_rtg")} | {f"matchup_pace_{n}": f"(h.poss_roll_{n} + a.poss_roll_{n}) / 2"}
    x |= {f"diff_{c}_venue_roll_{n}": f"h.{c}_home_split_roll_{n} - a.{c}_away_split_roll_{n}" for n in config.SPLIT_WINDOWS for c in ("plus_minus", "net_rtg_game")}
    x |= {f"diff_fg3_pct_b2b_roll_{n}": f"h.fg3_pct_b2b_roll_{n} - a.fg3_pct_b2b_roll_{n}" for n in config.B2B_WINDOWS} | {f"diff_{c}_ewm_10": f"h.{c}_ewm_10 - a.{c}_ewm_10" for c in ("net_rtg_game", "plus_minus")}
    names = ft.feature_names([f"{c}_roll_{n}" for c in has for n in config.WINDOWS])
    known = " + ".join(f"cast({n} is not null as int)" for n in names)
    meta = f"game_id, date, {big('season', 'season')}, home_team_id, away_team_id, {big('home_score', 'home_score')}, {big('away_score', 'away_score')}"
    return f"""{_RATED}, {DERIVED[len(GS) + 2:]}, hi as (select snapshot_date, team_id, sum(impact_rating * {_MISS}) as out_ from (select c.*, case c.c_custkey % 6 when 0 then 'Out' when 1 then 'Doubtful' when 2 then 'Day-to-Day' when 3 then 'Questionable' when 4 then 'Probable' else 'GTD' end as status,
 cast(c.c_custkey % 11 as double) as impact_rating, date '1995-01-01' as snapshot_date, c.c_nationkey as team_id from customer c) t group by 1, 2),
os as ({ODDS_BODY}), mv as (select {_GAME}, {', '.join(f'{v} as {n}' for n, v in _MOVES.items())} from os group by {_GAME}),
y as (select d.*, oreb * 1e0 / case when oreb + opp_dreb = 0 then 1 else oreb + opp_dreb end as orb_pct, coalesce(o.elo_before, 1500e0) as opp_elo, row_number() over (partition by d.team_id order by d.date, d.game_id) as rn, count(*) over (partition by d.team_id) as n,
 case when date_diff('day', lag(d.date) over (partition by d.team_id order by d.date, d.game_id), d.date) <= 1 then fg3_pct end as x, {', '.join(f'case when is_home = {v == "home"} then {c} end as {c}_{v}' for c, v, n in _SPLITS if n == 10)},
 e.elo_before, e.elo_off_before, e.elo_def_before from d left join elo o on o.game_id = d.game_id and o.team_id = case when d.team_id = d.home_team_id then d.away_team_id else d.home_team_id end left join elo e on e.game_id = d.game_id and e.team_id = d.team_id),
w as (select *, {', '.join([*windows, *(f'{v} as {k}' for k, v in rest.items())])} from y), v as (select *, {', '.join(last)} from w),
f as (select h.game_id, h.date, h.season, h.home_team_id, h.away_team_id, h.pts as home_score, a.pts as away_score, case when h.pts > a.pts then 1e0 else 0e0 end as home_win, {', '.join(f'cast({x[n]} as double) as {n}' for n in names)}
 from v h join v a on h.game_id = a.game_id and h.is_home and not a.is_home left join hi ih on ih.snapshot_date = h.date and ih.team_id = h.home_team_id left join hi ia on ia.snapshot_date = h.date and ia.team_id = h.away_team_id
 left join mv m on m.game_date = h.date and m.home_team_id = h.home_team_id and m.away_team_id = h.away_team_id), u as (select * from f where {known} >= 0.7e0 * {len(names)})
select {meta}, home_win, {', '.join(r(f'coalesce({n}, avg({n}) over (), 0)', n) for n in names)} from u"""


@query(_matrix_sql())
def game_feature_matrix(spark, sf):
    return rounded(ft.imputed(*_matrix(spark, sf))[0])


def _slate(spark, sf):
    """Every game as a bet, with the lines that spread and total picks need."""
    rows = rec.decided(view(spark, sf, "predictions")).withColumn("home", F.concat(F.lit("T"), "home_team_id")).withColumn("away", F.concat(F.lit("T"), "away_team_id"))
    return rows.withColumns({"spread": F.expr("cast(id % 25 - 12 as double)"), "over_under": F.expr("cast(195 + id % 40 as double)")})


def _context(spark, sf):
    """For each team its recent less its long-run plus-minus, as of its last game."""
    own = wn.last_rows(view(spark, sf, "game_stats"), max(config.WINDOWS) + 1)  # all that the windows of the last row see
    rows = wn.latest_rows(wn.with_rolling(own, ["plus_minus"]))
    return rows.select("team_id", (F.col("plus_minus_roll_5") - F.col("plus_minus_roll_20")).alias("trend"))


def _moved(spark, sf):
    """Movements of each pair of teams at its last day with odds."""
    rows = od.movement_detail(view(spark, sf, "odds_snapshots"))
    last = rows.groupBy("home_team_id", "away_team_id").agg(F.max_by(F.struct("prob_movement", "odds_disagreement", "n_snapshots"), "game_date").alias("m"))
    return last.select("home_team_id", "away_team_id", "m.*")


_SHOWN = f"""{ctes('predictions', 'game_stats', 'odds_snapshots', 'historical_injuries')}{DECIDED[len(PRED):]},
 t as (select team_id, {roll('plus_minus', 5, 2)} - {roll('plus_minus', 20, 10)} as trend, date, game_id from game_stats qualify row_number() over (partition by team_id order by date desc, game_id desc) = 1),
 md as (select {_GAME}, count(*) as n_snapshots, {_MOVES['prob_movement']} as moved, {_MOVES['odds_disagreement']} as apart from odds_snapshots group by {_GAME}),
 ml as (select home_team_id, away_team_id, arg_max(n_snapshots, game_date) as n_snapshots, arg_max(moved, game_date) as moved, arg_max(apart, game_date) as apart from md group by 1, 2),
 mm as (select home_team_id, away_team_id, cast(max(home_score - away_score) as double) as margin, cast(max(home_score + away_score) as double) as points from games group by 1, 2),
 sl as (select f.*, concat('T', cast(f.home_team_id as varchar)) as home, concat('T', cast(f.away_team_id as varchar)) as away, case when side = 'HOME' then th.trend else ta.trend end as trend, ml.n_snapshots, moved, apart, margin, points, cast(id % 25 - 12 as double) as spread, cast(195 + id % 40 as double) as line
 from f left join t th on th.team_id = f.home_team_id left join t ta on ta.team_id = f.away_team_id left join ml on ml.home_team_id = f.home_team_id and ml.away_team_id = f.away_team_id left join mm on mm.home_team_id = f.home_team_id and mm.away_team_id = f.away_team_id),
 sn as (select *, case when side = 'HOME' then home else away end as team from sl)"""


def _last_form(spark, sf):
    """The windowed means that explanations cite, as of each team's last game."""
    own = wn.last_rows(view(spark, sf, "game_stats"), max(config.WINDOWS) + 1)  # all that the windows of the last row see
    rows = wn.latest_rows(wn.with_rolling(wn.with_derived(own), ["plus_minus", "efg_pct", "tov_pct"]))
    return rows.select("team_id", *(f"{c}_roll_{n}" for c, widths, *_ in rec.CITED for n in widths), "plus_minus_roll_20")


def _injured(spark, sf):
    """Reports by the names that the slate's teams have."""
    return view(spark, sf, "historical_injuries").withColumn("team_abbr", F.concat(F.lit("T"), "team_id"))


def _driven(spark, sf):
    """Every third game has drivers, as a model would give them: its opening price and its teams' ids against their means."""
    rows, c = _slate(spark, sf), F.col
    item = lambda label, delta, value: F.struct(F.lit(label).alias("label"), delta.alias("delta"), value.alias("value"))
    price = item("elo_home_prob", (c("market_home_prob") - 0.5) / 10, c("market_home_prob"))
    teams = item("diff_plus_minus_roll_10", (c("home_team_id") - c("away_team_id")) / 500, (c("home_team_id") - c("away_team_id")).cast("double"))
    return rows.withColumn("drivers", F.when(c("id") % 3 == 0, F.array(price, teams)))


def _explanation_sql() -> str:
    wide = [(c, n) for c, widths, *_ in rec.CITED for n in widths] + [("plus_minus", 20)]
    form = ", ".join(f"{roll(c, n, n // 2)} as {c}_{n}" for c, n in wide)
    num = lambda x, n=1, sign="": f"printf('%{sign}.{n}f', cast(round(cast({x} as decimal(20, 9)), {n}) as double))"
    pct, one = (lambda x, sign="": f"concat({num(f'100 * ({x})', 1, sign)}, '%')"), (lambda x: num(x, 1, "+"))
    found = []
    for k, (stat, widths, least, weight) in enumerate(rec.CITED):
        for j, n in enumerate(widths):
            h, a = f"hf.{stat}_{n}", f"af.{stat}_{n}"
            gap = f"({a} - {h})" if stat == "tov_pct" else f"({h} - {a})"
            pick = lambda x, y, gap=gap: f"case when {gap} > 0 then {x} else {y} end"
            better, worse, own, other = pick("home", "away"), pick("away", "home"), pick(h, a), pick(a, h)
            said = {
                "plus_minus": f"concat({better}, ' is ', {num(f'abs({gap})')}, ' points a game ahead of ', {worse}, ' over {n} games (', {one(own)}, ' to ', {one(other)}, ')')",
                "efg_pct": f"concat({better}, ' shoots ', {pct(f'abs({gap})')}, ' better by effective field goals over {n} games')",
                "tov_pct": f"concat({better}, ' loses the ball less (', {pct(own)}, ' to ', {pct(other)}, ' of possessions over {n} games)')",
            }[stat]
            found.append(f"case when abs({gap}) > {least} then {{'rank': -{weight} * abs({gap}), 'place': {2 * k + j}, 'agrees': ({gap} > 0) = (side = 'HOME'), 'said': {said}}} end")
    names = "concat(player_name, ' (', status, ')')"
    return f"""{_SHOWN}, fd as (select *, (fgm + 0.5e0 * fg3m) / case when fga = 0 then 1 else fga end as efg_pct, tov / case when fga + 0.44e0 * fta + tov = 0 then 1 else fga + 0.44e0 * fta + tov end as tov_pct from game_stats),
 fm as (select team_id, {form} from fd qualify row_number() over (partition by team_id order by date desc, game_id desc) = 1),
 ir as (select team_id, {names} as who, row_number() over (partition by team_id order by impact_rating desc, player_name, status) as k from historical_injuries where impact_rating >= 5),
 il as (select team_id, string_agg(who, ', ' order by k) as who from ir where k <= 2 group by 1),
 ex as (select sn.*, hf.plus_minus_5 as h5, hf.plus_minus_20 as h20, af.plus_minus_5 as a5, af.plus_minus_20 as a20, hi.who as home_out, ai.who as away_out,
  list_sort(list_filter([{', '.join(found)}], lambda x: x is not null)) as said,
  case when id % 3 = 0 then list_filter([{{'d': (market_home_prob - 0.5) / 10, 's': concat('Elo win probability', ' (', {pct('market_home_prob')}, ')')}}, {{'d': (home_team_id - away_team_id) / 500e0, 's': concat('10-game plus/minus differential (', {num('home_team_id - away_team_id', 2, '+')}, ')')}}],
   lambda x: x.d * case when side = 'HOME' then 1 else -1 end > 0 and abs(x.d) >= 0.005)[1] end as driver
  from sn left join fm hf on hf.team_id = sn.home_team_id left join fm af on af.team_id = sn.away_team_id left join il hi on hi.team_id = sn.home_team_id left join il ai on ai.team_id = sn.away_team_id),
 ey as (select *, case when side = 'HOME' then away_out else home_out end as foes, case when side = 'HOME' then home_out else away_out end as own, case when side = 'HOME' then away else home end as other,
  case when side = 'HOME' then h5 else a5 end as s5, case when side = 'HOME' then h20 else a20 end as s20, list_filter(said, lambda x: x.agrees)[1].said as fits, said[1].said as most from ex)
select id, side, case when side = 'NO BET' then concat('No significant edge between ', away, ' and ', home, '.') else concat_ws(' ',
 concat('Model gives ', team, ' a ', {pct('q')}, ' chance against a market price of ', {pct('m')}, ' (an edge of ', {pct('edge')}, ').'),
 case when driver is not null then concat(team, ' is favoured ', case when abs(driver.d) >= 0.03 then 'mainly by' when abs(driver.d) >= 0.01 then 'much by' else 'a little by' end, ' ', driver.s, ', which moves the home team''s chance by ', {pct('driver.d', '+')}, '.')
  when fits is not null then concat(fits, '.') when most is not null then concat('But form speaks for the other side: ', most, '; the model goes by ratings, rest and the rest of its features.') end,
 case when foes is not null then concat(other, ' is weakened without ', foes, '.') end, case when own is not null then concat('But ', team, ' also misses ', own, '.') end,
 case when s5 - s20 > 3 then concat(team, ' is trending up: ', {one('s5')}, ' over 5 games, ', {one('s20')}, ' over 20.') when s5 - s20 < -3 then concat(team, ' is in a slump: ', {one('s5')}, ' over 5 games, ', {one('s20')}, ' over 20.') end,
 case when n_snapshots >= 2 and abs(moved) > 0.03 then concat('The line moves ', case when moved > 0 then 'to' else 'away from' end, ' the home team (', {pct('moved', '+')}, ').') end,
 case when n_snapshots >= 2 and apart > 0.05 then concat('Markets disagree by ', {pct('apart')}, '.') end) end as explanation from ey"""


@query(_explanation_sql())
def bet_explanations(spark, sf):
    out = rec.slate_view(_driven(spark, sf), moved=_moved(spark, sf), form=_last_form(spark, sf), injuries=_injured(spark, sf))
    return out.select("id", "side", "explanation")


@query(
    f"{_SHOWN} select id, side, {r('edge', 'edge')}, {r('margin', 'predicted_spread')}, {r('points', 'predicted_total')}, case when margin + spread >= 1.5 then concat(home, ' ', printf('%+.1f', spread)) when margin + spread <= -1.5 then concat(away, ' ', printf('%+.1f', -spread)) else 'NO BET' end as spread_pick, "
    f"case when points - line >= 2.5 then printf('OVER %.1f', line) when points - line <= -2.5 then printf('UNDER %.1f', line) else 'NO BET' end as total_pick, {r('margin + spread', 'spread_edge')}, {r('points - line', 'total_edge')}, {r('trend', 'trend')}, {r('moved', 'prob_movement')}, n_snapshots from sn"
)
def recommendation_slate(spark, sf):
    margins = view(spark, sf, "games").groupBy("home_team_id", "away_team_id").agg(F.max(F.col("home_score") - F.col("away_score")).cast("double").alias("predicted_spread"), F.max(F.col("home_score") + F.col("away_score")).cast("double").alias("predicted_total"))
    out = rec.slate_view(_slate(spark, sf), margins, _context(spark, sf), _moved(spark, sf))
    return rounded(out.select("id", "side", "edge", "predicted_spread", "predicted_total", "spread_pick", "total_pick", "spread_edge", "total_edge", "trend", "prob_movement", "n_snapshots"))


@query()
def walk_forward_model(spark, sf):
    """Scores of walk-forward models on the whole feature matrix, by fold; models stop early, as classifier's do."""
    matrix, names = _matrix(spark, sf)
    out = models.walk_forward(matrix.select("game_id", "date", "home_win", *names), names, stored=True, patience=20)
    return rounded(out.groupBy("fold").agg(F.count("*").alias("n"), F.avg((F.col("home_prob") - F.col("home_win")) ** 2).alias("brier")))


@query(f"{PRED}, o as (select *, row_number() over (order by date, id) as k, count(*) over () as n from predictions) select k <= floor(n * 0.8e0) as fitted, count(*) as n, min(date) as first, max(date) as last from o group by 1")
def train_split(spark, sf):
    fit, rest = models.split_by_date(view(spark, sf, "predictions"), key="id")
    part = lambda d, which: d.groupBy(F.lit(which).alias("fitted")).agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))
    return part(fit, True).unionByName(part(rest, False))


@query(f"{ctes('historical_injuries')} select player_name, team_abbr, status, {r('impact_rating', 'impact_rating')} from historical_injuries where lower(player_name) <> 'customer#000000007' union all select 'CUSTOMER#000000007', 'T07', 'Out', 5e0")
def injury_list(spark, sf):
    rows = view(spark, sf, "historical_injuries").select("player_name", "team_abbr", "status", "impact_rating")
    return rounded(inj.by_impact(inj.with_player(rows, "CUSTOMER#000000007", "t07").select(*rows.columns)))


@query(f"{SETTLED} select id, date, {r('clv', 'clv')} from s where bet_side <> 'NO BET' and clv is not null order by date desc, id desc limit 20")
def recent_clv(spark, sf):
    return rounded(mt.recent_values(mt.clv_detail(_settled(spark, sf))).select("id", "date", "clv"))


@query(
    "with s as (select c_custkey as player_id, c_nationkey as team, c_custkey % 60 as age from customer where c_custkey % 3 <> 0), n as (select c_custkey as player_id, (c_nationkey + 1) % 25 as team, c_custkey % 4 as rank from customer where c_custkey % 5 <> 0) "
    "select coalesce(s.player_id, n.player_id) as player_id, cast(case when n.player_id is null or s.age < 24 then s.team else n.team end as bigint) as team_id, cast(case when n.player_id is null or s.age < 24 then 7 when n.rank = 0 then 50 else n.rank end as bigint) as depth_chart_rank, "
    f"case when s.player_id is null then 0e0 else 12e0 end as minutes_per_game, s.player_id is null or (n.player_id is not null and s.age >= 24) as updated from s full join n on s.player_id = n.player_id"
)
def roster_sync(spark, sf):
    people, season = view(spark, sf, "customer"), F.lit(2024).alias("season")
    at = F.lit("2024-01-10 00:00:00").cast("timestamp")
    stored = people.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("player_id"), season, F.col("c_name").alias("player_name"), F.col("c_nationkey").cast("long").alias("team_id"), F.lit("G").alias("position"), F.lit(7).alias("depth_chart_rank"), F.lit(12.0).alias("minutes_per_game"), (at - F.expr("make_dt_interval(0, cast(c_custkey % 60 as int))")).alias("last_updated"))
    roster = people.where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("player_id"), season, F.col("c_name").alias("player_name"), F.expr("cast((c_nationkey + 1) % 25 as bigint)").alias("team_id"), F.lit("F").alias("position"), F.expr("nullif(cast(c_custkey % 4 as int), 0)").alias("depth_chart_rank"))
    out = inj.synced_roster(stored, roster.unionByName(roster.withColumn("depth_chart_rank", F.lit(50))), "2024-01-10 00:00:00")
    return rounded(out.select("player_id", "team_id", "depth_chart_rank", "minutes_per_game", (F.col("last_updated") == at).alias("_now"), "position")).select("player_id", "team_id", "depth_chart_rank", "minutes_per_game", (F.col("position") == "F").alias("updated"))


_MARKET_SQL = f"""with n as (select {_NAMES} as names), e as (select c_custkey as id, names[1 + c_custkey % 12] as a, names[1 + (c_custkey + 5) % 12] as b, cast(5 + (c_custkey * 37) % 91 as double) / 100 as p, c_custkey % 8 as kind from customer, n),
t as (select *, (select a from {_TABLE} where n = e.a) as first, (select a from {_TABLE} where n = e.b) as second from e)"""


@query(
    f"{_MARKET_SQL}, x as (select id, first, second, case kind when 4 then null when 6 then null when 2 then 1 - p else p end as p1, case kind when 4 then null when 6 then null when 2 then p else 1 - p end as p2 from t) "
    f"select concat(cast(id as varchar), '-2024-01-05') as event_slug, '2024-01-05' as game_date, first, second, {r('p1', 'first_price')}, {r('p2', 'second_price')} from x where p1 > 0.01 and p1 < 0.99 and p2 > 0.01 and p2 < 0.99"
)
def event_market_prices(spark, sf):
    """Prices from landed events of eight kinds: moneylines, Yes/No markets of one or both teams, unreadable prices, closed markets, titles of other things."""
    names = F.array(*(F.lit(n) for n, _ in text.NICKNAMES))
    c = view(spark, sf, "customer").select(F.col("c_custkey").alias("id"), *(F.element_at(names, F.expr(f"cast({x} as int)")).alias(k) for k, x in (("a", "1 + c_custkey % 12"), ("b", "1 + (c_custkey + 5) % 12"))), F.expr("cast(5 + (c_custkey * 37) % 91 as double) / 100").alias("p"), F.expr("c_custkey % 8").alias("kind"))
    title, p, q = F.concat("a", F.lit(" vs. "), "b"), F.col("p").cast("string"), F.format_string("%.2f", 1 - F.col("p"))
    listed = lambda *x: F.to_json(F.array(*x))
    market = lambda question, outcomes, prices, closed=False: F.struct(question.alias("question"), outcomes.alias("outcomes"), prices.alias("outcomePrices"), F.lit(closed).alias("closed"))
    yes_no = listed(F.lit("Yes"), F.lit("No"))
    win = lambda team: F.concat(F.lit("Do the "), F.initcap(team), F.lit(" win?"))
    line, stale = market(F.upper(title), listed("a", "b"), listed(p, q)), market(title, listed("a", "b"), listed(F.lit("0.5"), F.lit("0.5")), True)
    one, two = market(win(F.col("a")), yes_no, listed(p, q)), market(win(F.col("b")), listed(F.lit("No"), F.lit("YES")), listed(F.lit("x"), q))
    kinds = [F.array(line, one), F.array(one, two), F.array(market(win(F.col("b")), yes_no, listed(p, q))), F.array(stale, two, one), F.array(stale), F.array(market(title, listed("a", "b"), listed(F.lit("?"), q))), F.array(line), F.array(two, market(win(F.col("a")), yes_no, listed(p, F.lit("0"))), market(F.lit("Total"), listed(F.lit("Over"), F.lit("Under")), listed(p, q)))]
    markets_ = F.element_at(F.array(*kinds), F.col("kind").cast("int") + 1)
    events = c.select(F.when(F.col("kind") == 6, F.concat(title, F.lit(" champion"))).otherwise(title).alias("title"), F.concat(F.col("id").cast("string"), F.lit("-2024-01-05")).alias("slug"), markets_.alias("markets"))
    return rounded(markets.event_prices(events).drop("event_title"))


@query(
    "with c as (select c_custkey as id, c_custkey % 6 as k from customer) select id, case k when 0 then '2024-01-05' end as slug_day, case k when 0 then timestamp '2024-01-05 03:30:00' when 1 then timestamp '2024-01-05 08:30:00' when 2 then timestamp '2024-01-05 03:30:00' end as at, "
    "case when k <> 3 then date '2024-01-05' end as day, case k when 0 then 'GSW' when 1 then 'NOP' when 2 then 'NYK' when 3 then 'SAS' when 4 then 'UTA' else 'BOS' end as feed, case k when 0 then 1.5e0 when 1 then -2e0 when 2 then 300e0 end as value, "
    "case k when 0 then 'GSW' when 1 then 'POR' when 2 then 'MIN' when 5 then 'PHI' end as nickname, case k when 0 then 2 when 1 then 0 when 2 then 1 end as n_listed, case k when 0 then '5-game scoring differential' when 1 then 'home rest days' when 2 then 'Elo differential' when 3 then 'away on back-to-back' when 4 then 'home 10-game FT rate' else 'something else' end as label, "
    "case k when 0 then '{\"a\":1,\"b\":null}' else concat('{\"a\":1,\"b\":\"', cast(k as varchar), '\"}') end as packed from c"
)
def text_fields(spark, sf):
    """The rules for loosely typed fields, over strings of six kinds."""
    pick = lambda *x: F.get(F.array(*(F.lit(v) for v in x)), F.expr("cast(c_custkey % 6 as int)"))
    c = view(spark, sf, "customer")
    slug = pick("nba-bos-lal-2024-01-05", "nba-bos-lal", "2024-01-05-x", "", None, "nba-2024-1-5")
    at = pick("2024-01-05T03:30:00Z", "2024-01-05T03:30:00-05:00", "2024-01-05T03:30:00", "yesterday", "", None)
    day = pick("2024-01-05", "2024-01-05T03:30Z", "2024-01-05 x", "5 Jan 2024", "2024-01-05", "2024-01-05T")
    names = pick("golden state warriors", "Blazers", " Timberwolves ", "nobody", "", "The 76ers")
    feature = pick("diff_pts_roll_5", "home_rest_days", "elo_diff", "away_is_back_to_back", "home_ft_rate_roll_10", "something_else")
    packed = text.compact_json(F.struct(F.lit(1).alias("a"), pick(None, "1", "2", "3", "4", "5").alias("b")))
    return rounded(
        c.select(
            F.col("c_custkey").alias("id"), text.slug_date(slug).alias("slug_day"), text.naive_utc(at).alias("at"), text.date_prefix(day).alias("day"), text.feed_abbreviation(pick("GS", "NO", "NY", "SA", "UTAH", "BOS")).alias("feed"),
            text.number(pick("1.5", " -2", "3e2", "x", "", None)).alias("value"), text.nickname_abbreviation(names).alias("nickname"), F.nullif(F.size(text.json_list(pick('["a","b"]', "[]", '["a"]', "not json", None, None))), F.lit(-1)).alias("n_listed"),
            text.feature_label(feature).alias("label"), packed.alias("packed"),
        )
    )


@query(
    f"{ODDS} select id, case when id % 13 = 0 then 'bad_json' when id % 11 = 0 then 'unknown_team' when id % 7 = 0 then 'bad_date' when id % 5 = 0 then 'unknown_source' end as error, case when id % 7 <> 0 then game_date end as game_date, case when id % 11 <> 0 then home_team_id end as home_team_id, "
    f"date_trunc('second', timestamp) as timestamp, {r('case when id % 3 <> 0 then home_prob end', 'home_prob')} from odds_snapshots"
)
def snapshot_lines(spark, sf):
    """Checks and types of lines of odds files, as read with all fields as strings."""
    rows = view(spark, sf, "odds_snapshots")
    abbr = lambda c: F.concat(F.lit("T"), F.lpad(F.col(c).cast("string"), 2, "0"))
    lines = rows.select(
        "id", F.when(F.expr("id % 7 = 0"), "tomorrow").otherwise(F.col("game_date").cast("string")).alias("game_date"), F.when(F.expr("id % 11 = 0"), "XX").otherwise(abbr("home_team_id")).alias("home_team_abbr"), abbr("away_team_id").alias("away_team_abbr"),
        F.when(F.expr("id % 5 = 0"), "paper").otherwise(F.col("source")).alias("source"), F.concat(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.expr("id % 2 = 0"), "Z").otherwise("")).alias("timestamp"),
        F.when(F.expr("id % 3 = 0"), "n/a").otherwise(F.col("home_prob").cast("string")).alias("home_prob"), F.col("spread").cast("string"), F.col("over_under").cast("string"), F.lit("").alias("game_id"), F.when(F.expr("id % 13 = 0"), "{").alias("_corrupt_record"),
    )
    return rounded(sn.checked(lines, view(spark, sf, "teams")).select("id", "error", "game_date", "home_team_id", "timestamp", "home_prob"))


@query(f"{ctes('games')} select cast(id as varchar) as event_id, case home_team_id % 3 when 0 then 'GSW' when 1 then 'NOP' else 'BOS' end as home, 'UTA' as away, {r('home_score', 'home_score')}, {r('away_score', 'away_score')}, {r('case when id % 2 = 0 then id % 9 - 4.5e0 end', 'spread')}, {r('case when id % 2 = 0 then 200 + id % 40 end', 'over_under')} from games")
def scoreboard_rows(spark, sf):
    """Score board documents, a game each, laid flat."""
    games = view(spark, sf, "games")
    code = F.get(F.array(*(F.lit(x) for x in ("GS", "NO", "BOS"))), F.expr("cast(home_team_id % 3 as int)"))
    side = lambda home, abbr, score: F.struct(F.lit(home).alias("homeAway"), F.col(score).cast("string").alias("score"), F.struct(abbr.alias("abbreviation")).alias("team"))
    odds = F.when(F.expr("id % 2 = 0"), F.array(F.struct(F.lit("x").alias("details"), F.expr("cast(id % 9 - 4.5 as double)").alias("spread"), F.expr("200 + id % 40").alias("overUnder"))))
    competition = F.struct(F.array(side("away", F.lit("UTAH"), "away_score"), side("home", code, "home_score")).alias("competitors"), odds.alias("odds"))
    events = games.select(F.array(F.struct(F.col("id").cast("string").alias("id"), F.col("date").cast("string").alias("date"), F.array(competition).alias("competitions"))).alias("events"))
    return rounded(sn.flat_scoreboard(events).drop("game_time_utc"))


@query("select concat('T', lpad(cast(c_nationkey as varchar), 2, '0')) as team_abbr, c_name as name, cast(least(1 + c_custkey % 5, 1 + c_custkey % 3) as bigint) as rank from customer")
def depth_chart_ranks(spark, sf):
    c = view(spark, sf, "customer")
    player = lambda n: F.array(F.struct(F.col("c_name").alias("name"), F.expr(f"cast(1 + c_custkey % {n} as int)").alias("rank")))
    charts = c.select(F.concat(F.lit("T"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")).alias("team_abbr"), F.create_map(F.lit("PG"), player(5), F.lit("SG"), player(3)).alias("positions"))
    return rounded(inj.depth_ranks(charts))


@query(f"{ctes('games')}, s as (select home_team_id as t, date, id, 'h' as side from games where id % 3 > 0 union all select away_team_id, date, id, 'a' from games where id % 3 > 1), l as (select t, arg_max(id, (date, id)) as id, arg_max(side, (date, id)) as side from s group by 1) select concat('T', cast(t as varchar)) as team_abbr, concat(side, cast(id as varchar), ',Bench') as names from l")
def starters_by_team(spark, sf):
    games = view(spark, sf, "games")
    named = lambda mark: F.array(F.struct(F.concat(F.lit(mark), F.col("id").cast("string")).alias("displayName"), F.lit("x").alias("shortName")), F.struct(F.lit("").alias("displayName"), F.lit("Bench").alias("shortName")), F.struct(F.lit(None).cast("string").alias("displayName"), F.lit("").alias("shortName")))
    side = lambda s, least: F.struct(F.struct(F.concat(F.lit("T"), F.col(f"{s}_team_id").cast("string")).alias("abbreviation")).alias("team"), F.when(F.expr(f"id % 3 > {least}"), named(s[0])).alias("probables"))
    events = games.select(F.concat("date", F.lpad(F.col("id").cast("string"), 19, "0")).alias("date"), F.array(F.struct(F.array(side("home", 0), side("away", 1)).alias("competitors"))).alias("competitions"))
    return inj.probable_starters(events).select("team_abbr", F.array_join("names", ",").alias("names"))


@query(f"{ODDS}, p as (select least(home_team_id, away_team_id) as a, greatest(home_team_id, away_team_id) as b, id, home_prob from odds_snapshots) select a, b, max(id) as ordinal, {r('first(home_prob order by id desc)', 'home_prob')} from p group by 1, 2")
def latest_pair_odds(spark, sf):
    odds = view(spark, sf, "odds_snapshots").select(F.col("home_team_id").alias("team_a"), F.col("away_team_id").alias("team_b"), F.col("id").alias("ordinal"), "home_prob")
    return rounded(od.last_by_pair(odds).select(F.least("team_a", "team_b").alias("a"), F.greatest("team_a", "team_b").alias("b"), "ordinal", "home_prob"))


@query(f"{ctes('historical_injuries')} select {r(f'coalesce(sum(impact_rating * {_MISS}), 0)', 'impact_out')} from historical_injuries where team_id = 7")
def injury_impact_on_day(spark, sf):
    return rounded(inj.team_impact_on(view(spark, sf, "historical_injuries"), "1995-01-01", 7))


@query(f"{ODDS}, f as (select {_GAME}, source, timestamp, min(id) as id from odds_snapshots group by all) select source, count(*) as n, sum(cast(id as bigint)) as ids from f where not exists (select 1 from odds_snapshots o where o.id % 4 = 0 and o.game_date = f.game_date and o.home_team_id = f.home_team_id and o.away_team_id = f.away_team_id and o.source = f.source and o.timestamp = f.timestamp) group by 1")
def new_snapshot_rows(spark, sf):
    rows = view(spark, sf, "odds_snapshots").withColumn("game_id", F.col("id").cast("string"))
    fresh = sn.new_snapshots(od.distinct_snapshots(rows).withColumn("game_id", F.col("id").cast("string")), rows.where("id % 4 = 0"))
    return fresh.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("game_id").cast("long")).alias("ids"))


@query(f"{PRED}, b as (select case when bet_side = 'HOME' then model_home_prob else 1 - model_home_prob end as p, (bet_side = 'HOME') = home_won as won from predictions where bet_side <> 'NO BET') select count(*) as n_bets, {r('avg(cast(won as double))', 'realised')}, {r('avg(p)', 'claimed')}, {r('avg(cast(won as double)) - avg(p)', 'gap')} from b")
def claimed_win_rate(spark, sf):
    bets = view(spark, sf, "predictions").where("bet_side <> 'NO BET'").select(F.col("bet_side").alias("side"), F.col("model_home_prob").alias("home_prob"), F.expr("(bet_side = 'HOME') = home_won").alias("won"))
    return rounded(rec.win_rate_gap(bets))


@query(f"{SETTLED} select count(*) as n, true as counts_hold, true as quantiles_hold from s")
def sketched_predictions(spark, sf):
    """Sketches of days, merged, against the exact numbers: pairs of teams within three standard errors, quantiles of profit within 1 % of ranks."""
    rows = _settled(spark, sf).withColumn("pair", F.concat_ws("-", "home_team_id", "away_team_id"))
    days = written(sk.daily_sketches(rows, "date", {"pairs": F.col("pair")}, {"profit": F.col("profit")}), "sketches")
    found = sk.merged(days).first()  # one row
    shares = {s: found[f"profit_{100 * s:g}"] for s in (0.05, 0.25, 0.5, 0.75, 0.95)}
    known = F.col("profit").isNotNull()
    share = lambda when: F.avg(F.when(known, when.cast("double")))
    inside = [(share(F.col("profit") < v) <= s + 0.01) & (share(F.col("profit") <= v) >= s - 0.01) for s, v in shares.items() if v is not None]
    held = inside[0] if inside else F.lit(True)
    for i in inside[1:]:
        held = held & i
    exact = F.count_distinct("pair")
    return rows.agg(F.count("*").alias("n"), (F.abs(exact - found["pairs"]) <= 3 * 1.04 / 2 ** (sk.LG_K / 2) * exact).alias("counts_hold"), held.alias("quantiles_hold"))


@query(
    f"{ctes('historical_injuries', 'teams')} select h.player_name, cast(player_id as varchar) as player_id, case when player_id % 7 = 0 then '' else abbreviation end as team_abbr, case when player_id % 5 = 0 then 'Unknown' else status end as status, "
    "case when player_id % 3 = 0 then 'short' else concat('rated ', cast(cast(impact_rating as int) as varchar)) end as description, cast(snapshot_date as varchar) as reported from historical_injuries h join teams t on t.id = h.team_id"
)
def injury_documents(spark, sf):
    """Injury reports, a document each, laid flat: teams by id, by name, or unknown; missing statuses and comments."""
    rows, c = view(spark, sf, "historical_injuries").join(view(spark, sf, "teams").select(F.col("id").alias("team_id"), "name"), "team_id"), F.col
    sometimes = lambda when, x: F.when(F.expr(when), x)
    player = F.struct(
        F.struct(c("player_id").cast("string").alias("id"), c("player_name").alias("displayName")).alias("athlete"), sometimes("player_id % 5 <> 0", c("status")).alias("status"),
        sometimes("player_id % 3 <> 0", F.concat(F.lit("rated "), c("impact_rating").cast("int").cast("string"))).alias("longComment"), F.lit("short").alias("shortComment"), c("snapshot_date").cast("string").alias("date"),
    )
    team = F.struct(sometimes("player_id % 7 <> 0 and player_id % 2 = 0", c("team_id").cast("string")).alias("id"), sometimes("player_id % 7 <> 0", c("name")).alias("displayName"), F.array(player).alias("injuries"))
    docs = documents.parsed(rows.select(F.to_json(F.struct(F.array(team).alias("injuries"))).alias("body")), "body", documents.INJURIES)
    return documents.flat_injuries(docs, view(spark, sf, "teams").select(F.col("id").alias("feed_id"), "name", "abbreviation"))


@query(
    f"{PRED} select id, {big('case when id % 4 = 0 then 0 else 1 + id % 2 end', 'n_providers')}, case when id % 4 <> 0 then 'book' end as provider, {r('case when id % 4 <> 0 then id % 25 - 12.5e0 end', 'spread')}, {r('case when id % 4 <> 0 then 200 + id % 40 end', 'over_under')}, "
    "concat(cast(home_team_id as varchar), '-', cast(away_team_id as varchar)) as first_against_spread, case when id % 3 <> 0 then 'level' end as season_series from predictions"
)
def summary_documents(spark, sf):
    """Summaries of games, a document each, laid flat."""
    rows, c = view(spark, sf, "predictions"), F.col
    pick = lambda name: F.struct(F.struct(F.lit(name).alias("name")).alias("provider"), F.expr("cast(id % 25 - 12.5 as string)").alias("spread"), F.expr("cast(200 + id % 40 as string)").alias("overUnder"))
    picks = F.when(F.expr("id % 4 = 0"), F.array().cast("array<struct<provider:struct<name:string>,spread:string,overUnder:string>>")).when(F.expr("id % 2 = 0"), F.array(pick("book"))).otherwise(F.array(pick("book"), pick("other")))
    record = F.struct(F.lit("total").alias("type"), F.concat_ws("-", "home_team_id", "away_team_id").alias("summary"))
    side = F.struct(F.struct(c("home_team_id").cast("string").alias("abbreviation")).alias("team"), F.array(record).alias("records"))
    series = F.when(F.expr("id % 3 <> 0"), F.array(F.struct(F.lit("level").alias("summary"))))
    body = F.to_json(F.struct(picks.alias("pickcenter"), F.array(side).alias("againstTheSpread"), F.struct(F.array(F.struct(series.alias("series"))).alias("competitions")).alias("header")))
    out = documents.flat_summary(documents.parsed(rows.select("id", body.alias("body")), "body", documents.SUMMARY), ["id"])
    return rounded(out.select("id", "n_providers", "provider", "spread", "over_under", "first_against_spread", "season_series"))
