"""From probabilities and prices to bets, back-tests and explanations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import config
from ..functions import betting as bet, text
from ..scratch import written


def decided(rows: DataFrame, live: bool = True) -> DataFrame:
    """Adds to games (model_home_prob, market_home_prob, perhaps market_away_prob) the side, edge, stake share and badge.

    With live the probability is drawn to the market and sides below the floor
    aren't taken.
    """
    c = F.col
    away_price = c("market_away_prob") if "market_away_prob" in rows.columns else 1 - c("market_home_prob")
    p = bet.shrink(c("model_home_prob"), c("market_home_prob")) if live else c("model_home_prob")
    out = rows.withColumn("home_prob", p).withColumn("away_price", away_price)
    out = out.withColumn("home_edge", bet.edge(c("home_prob"), c("market_home_prob"))).withColumn("away_edge", bet.edge(1 - c("home_prob"), c("away_price")))
    floor = (c("home_prob"), 1 - c("home_prob")) if live else (F.lit(1.0), F.lit(1.0))
    out = out.withColumn("side", bet.bet_side(c("home_edge"), c("away_edge"), *floor))
    home, none = c("side") == "HOME", c("side") == "NO BET"
    edge = F.when(none, F.greatest("home_edge", "away_edge")).when(home, c("home_edge")).otherwise(c("away_edge"))
    prob, price = F.when(home, c("home_prob")).otherwise(1 - c("home_prob")), F.when(home, c("market_home_prob")).otherwise(c("away_price"))
    out = out.withColumn("edge", edge).withColumn("kelly_pct", F.when(none, 0.0).otherwise(bet.kelly(prob, price)))
    return out.withColumn("badge", F.when(none, "NO BET").otherwise(bet.badge(c("edge"))))


def recommendations(rows: DataFrame, slate: str, bankroll: float = config.BANKROLL, drawdown: float = 1.0, live: bool = True) -> DataFrame:
    """decided() with stakes: several bets of a slate are cut for their correlation."""
    own = decided(rows, live).withColumn("kelly_pct", F.col("kelly_pct") * drawdown)
    n = F.count(F.when(F.col("side") != "NO BET", 1)).over(Window.partitionBy(slate))
    own = own.withColumn("kelly_pct", F.col("kelly_pct") * bet.haircut(n))
    return own.withColumn("bet_size", F.col("kelly_pct") * bankroll)


def slate_view(bets: DataFrame, margins: DataFrame | None = None, context: DataFrame | None = None, moved: DataFrame | None = None, form: DataFrame | None = None, injuries: DataFrame | None = None) -> DataFrame:
    """Recommendations (see recommendations; with id, home, away, home_team_id, away_team_id, spread and over_under) as they are shown, the best edge first.

    Adds, where they are given and known: predicted_spread and predicted_total
    (two places) with picks and their edges, from margins (home_team_id,
    away_team_id, predicted_spread, predicted_total); home_trend and away_trend
    from context (team_id, trend); prob_movement, odds_disagreement and
    n_snapshots from moved (by both teams); what with_form and with_injured add
    from form and injuries; and the explanation. A game that has none keeps nulls.
    """
    pair, c = ["home_team_id", "away_team_id"], F.col
    out = bets
    if margins is not None:
        out = out.join(margins.select(*pair, "predicted_spread", "predicted_total"), pair, "left")
        spread, total = c("predicted_spread"), c("predicted_total")
        out = out.withColumns({"spread_pick": bet.spread_pick(spread, c("spread"), c("home"), c("away")), "total_pick": bet.total_pick(total, c("over_under")), "spread_edge": spread + c("spread"), "total_edge": total - c("over_under")})
        out = out.withColumns({"predicted_spread": F.round(spread, 2), "predicted_total": F.round(total, 2)})
    if context is not None:
        for s in ("home", "away"):
            out = out.join(context.select(c("team_id").alias(f"{s}_team_id"), c("trend").alias(f"{s}_trend")), f"{s}_team_id", "left")
        out = out.withColumn("trend", F.when(c("side") == "HOME", c("home_trend")).otherwise(c("away_trend")))
    if moved is not None:
        out = out.join(moved.select(*pair, "prob_movement", "odds_disagreement", "n_snapshots"), pair, "left")
    out = out if form is None else with_form(out, form)
    out = out if injuries is None else with_injured(out, injuries)
    return explanation(out).orderBy(F.desc("edge"), "home", "away", "id")


def with_prices(slate: DataFrame, poly: DataFrame, book: DataFrame, on: list[str]) -> DataFrame:
    """Market prices of a slate: the prediction market's, else the sportsbook's, else 0."""
    a = poly.select(*on, F.col("home_price").alias("_ph"), F.col("away_price").alias("_pa"))
    b = book.select(*on, F.col("home_price").alias("_bh"), F.col("away_price").alias("_ba"))
    joined = slate.join(a, on, "left").join(b, on, "left")
    return joined.withColumn("market_home_prob", F.coalesce("_ph", "_bh", F.lit(0.0))).withColumn("market_away_prob", F.coalesce("_pa", "_ba", F.lit(0.0))).drop("_ph", "_pa", "_bh", "_ba")


def backtest(rows: DataFrame, live: bool = True, bankroll: float = config.BANKROLL) -> DataFrame:
    """Bets of scored games (id, date, model_home_prob, market_home_prob, home_won) with returns and the running bankroll.

    As a stake is a share of the bankroll, at most MAX_BET of it, the bankroll
    is a product of factors above 0: a sum of logarithms, in order.
    """
    bets = decided(rows, live).where("side <> 'NO BET'")  # so the edge, and with it the stake, is above 0
    home = F.col("side") == "HOME"
    price = F.when(home, F.col("market_home_prob")).otherwise(F.col("away_price"))
    bets = bets.withColumn("won", F.when(home, F.col("home_won")).otherwise(~F.col("home_won")))
    bets = bets.withColumn("win_return", 1 / price - 1)
    bets = bets.withColumn("log_factor", F.ln(F.when(F.col("won"), 1 + F.col("kelly_pct") * F.col("win_return")).otherwise(1 - F.col("kelly_pct"))))
    return compounded(bets, "log_factor", bankroll)


def compounded(bets: DataFrame, log_factor: str, bankroll: float) -> DataFrame:
    """Adds log_before and log_after, logarithms of the bankroll around each bet in the order (date, id), and bankroll_after.

    bankroll_after is infinite, or 0, where a double can't hold it; the
    logarithms are the curve.

    Days are summed first; the ordered pass over all of them has a row for each
    day, and bets of a day are ordered among themselves.
    """
    days = bets.groupBy("date").agg(F.sum(log_factor).alias("_day"))
    before = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("date", F.coalesce(F.sum("_day").over(before), F.lit(0.0)).alias("_start"))
    within = Window.partitionBy("date").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    out = bets.join(days, "date").withColumn("_log", F.col("_start") + F.sum(log_factor).over(within))
    start = math.log(bankroll)
    out = out.withColumn("log_after", start + F.col("_log")).withColumn("log_before", start + F.col("_log") - F.col(log_factor))
    return out.withColumn("bankroll_after", F.exp("log_after")).drop("_start", "_log")


def backtest_summary(bets: DataFrame) -> DataFrame:
    """One row: bets, wins, money, edge, Sharpe ratio.

    A bet's return follows from its price. Money is added up in units of the
    largest bankroll, so that roi holds whatever the bankroll has grown to;
    log_scale is that unit's logarithm, and log_wagered the logarithm of all
    stakes. total_wagered, total_profit and avg_size are in money, infinite
    where a double can't hold them.
    """
    bets = written(bets.select("won", "edge", "kelly_pct", "log_before", "log_after", F.when(F.col("won"), F.col("win_return")).otherwise(-1.0).alias("r")), "backtest")
    top = bets.agg(F.max(F.greatest("log_before", "log_after")).alias("_top"))  # one row
    before, after = (F.exp(F.col(c) - F.col("_top")) for c in ("log_before", "log_after"))
    r = F.col("r")
    out = bets.crossJoin(F.broadcast(top)).agg(
        F.count("*").alias("total_bets"), F.count(F.when(F.col("won"), 1)).alias("wins"), F.avg(F.col("won").cast("double")).alias("win_rate"),
        F.max("_top").alias("log_scale"), F.sum(before * F.col("kelly_pct")).alias("_wagered"), F.sum(after - before).alias("_profit"), F.avg("edge").alias("avg_edge"),
        F.coalesce(F.try_divide(F.avg(r), F.stddev_samp(r)) * F.sqrt(F.count(r)), F.lit(0.0)).alias("sharpe"),
    )
    money = lambda c: F.when(F.col(c) == 0, 0.0).otherwise(F.col(c) * F.exp("log_scale"))
    out = out.withColumns({"total_wagered": money("_wagered"), "total_profit": money("_profit"), "log_wagered": F.col("log_scale") + F.ln("_wagered"), "roi": F.coalesce(F.try_divide(F.col("_profit"), F.col("_wagered")), F.lit(0.0))})
    return out.withColumn("avg_size", F.try_divide(F.col("total_wagered"), F.col("total_bets"))).drop("_wagered", "_profit")


def odds_coverage(rows: DataFrame, price: str) -> DataFrame:
    return rows.agg(F.avg(F.col(price).isNotNull().cast("double")).alias("coverage"))


def win_rate_gap(bets: DataFrame) -> DataFrame:
    """One row: bets, their realised win rate, the rate the model claimed for them, and the difference."""
    claimed = F.when(F.col("side") == "HOME", F.col("home_prob")).otherwise(1 - F.col("home_prob"))
    out = bets.agg(F.count("*").alias("n_bets"), F.avg(F.col("won").cast("double")).alias("realised"), F.avg(claimed).alias("claimed"))
    return out.withColumn("gap", F.col("realised") - F.col("claimed"))


def new_predictions(rows: DataFrame, stored: DataFrame, opening: DataFrame) -> DataFrame:
    """Predictions whose key isn't stored, with the opening line."""
    key = ["date", "home_team_id", "away_team_id"]
    fresh = rows.join(stored.select(*key), key, "left_anti")
    return fresh.join(opening.select(F.col("game_date").alias("date"), "home_team_id", "away_team_id", F.col("home_prob").alias("opening_market_prob")), key, "left")


def resolved(predictions: DataFrame, games: DataFrame) -> DataFrame:
    """Predictions of finished games, with their result."""
    done = games.where("home_score is not null").select("date", "home_team_id", "away_team_id", (F.col("home_score") > F.col("away_score")).alias("home_won"))
    return predictions.drop("home_won").join(done, ["date", "home_team_id", "away_team_id"])


def number(x: Column, digits: int = 1, sign: str = "") -> Column:
    """A number as text: rounded in decimals (halves away from 0), so that it doesn't depend on the order of a sum."""
    return F.format_string(f"%{sign}.{digits}f", F.round(x.cast("decimal(20,9)"), digits).cast("double"))


def percent(x: Column, sign: str = "") -> Column:
    return F.concat(number(100 * x, 1, sign), F.lit("%"))


#: Form that an explanation cites: column, windows, least difference, how points of it weigh against points of plus-minus.
CITED = (("plus_minus", (5, 10), 3.0, 1.0), ("efg_pct", (5, 10), 0.02, 50.0), ("tov_pct", (5, 10), 0.02, 30.0))
#: Impact from which an injured player is named, and how many are.
NAMED_IMPACT, NAMED = 5.0, 2


def with_form(rows: DataFrame, form: DataFrame) -> DataFrame:
    """Adds home_form and away_form: the last windowed means of both teams (see CITED), from rows by team."""
    columns = [f"{c}_roll_{n}" for c, widths, *_ in CITED for n in widths] + ["plus_minus_roll_20"]
    for s in ("home", "away"):
        rows = rows.join(form.select(F.col("team_id").alias(f"{s}_team_id"), F.struct(*columns).alias(f"{s}_form")), f"{s}_team_id", "left")
    return rows


def with_injured(rows: DataFrame, injuries: DataFrame) -> DataFrame:
    """Adds home_out and away_out: players of impact NAMED_IMPACT or more (player_name, status) of both teams (by abbreviation), the weightiest first.

    Only as many are kept as a sentence names, so no list grows with the reports.
    """
    order = Window.partitionBy("team_abbr").orderBy(F.desc("impact_rating"), "player_name", "status")
    top = injuries.where(F.col("impact_rating") >= NAMED_IMPACT).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= NAMED)
    lists = top.groupBy("team_abbr").agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", "player_name", "status"))), lambda x: F.struct(x["player_name"].alias("player_name"), x["status"].alias("status"))).alias("_out"))
    for s in ("home", "away"):
        rows = rows.join(lists.select(F.col("team_abbr").alias(s), F.col("_out").alias(f"{s}_out")), s, "left")
    return rows


def _form_sentence(home_bet: Column) -> Column:
    """The difference in form that supports the bet most; if all speak against it, a caveat with the largest."""
    c, points = F.col, lambda x: number(x, 1, "+")
    found = []
    for k, (stat, widths, least, weight) in enumerate(CITED):
        for j, n in enumerate(widths):
            h, a = c(f"home_form.{stat}_roll_{n}"), c(f"away_form.{stat}_roll_{n}")
            gap = (a - h) if stat == "tov_pct" else (h - a)  # above 0: the home team is better
            better, worse = F.when(gap > 0, c("home")).otherwise(c("away")), F.when(gap > 0, c("away")).otherwise(c("home"))
            own, other = F.when(gap > 0, h).otherwise(a), F.when(gap > 0, a).otherwise(h)
            said = {
                "plus_minus": F.concat(better, F.lit(" is "), number(F.abs(gap)), F.lit(" points a game ahead of "), worse, F.lit(f" over {n} games ("), points(own), F.lit(" to "), points(other), F.lit(")")),
                "efg_pct": F.concat(better, F.lit(" shoots "), percent(F.abs(gap)), F.lit(f" better by effective field goals over {n} games")),
                "tov_pct": F.concat(better, F.lit(" loses the ball less ("), percent(own), F.lit(" to "), percent(other), F.lit(f" of possessions over {n} games)")),
            }[stat]
            found.append(F.when(F.abs(gap) > least, F.struct((-weight * F.abs(gap)).alias("rank"), F.lit(2 * k + j).alias("place"), ((gap > 0) == home_bet).alias("agrees"), said.alias("said"))))
    every = F.array_sort(F.filter(F.array(*found), lambda x: x.isNotNull()))
    agreeing = F.get(F.filter(every, lambda x: x["agrees"]), F.lit(0))["said"]
    return F.coalesce(F.concat(agreeing, F.lit(".")), F.concat(F.lit("But form speaks for the other side: "), F.get(every, F.lit(0))["said"], F.lit("; the model goes by ratings, rest and the rest of its features.")))


def _driver_sentence(drivers: Column, home_bet: Column, team: Column) -> Column:
    """The first of a model's drivers that supports the bet by half a point or more, with its value and what it moves."""
    first = F.get(F.filter(drivers, lambda d: (d["delta"] * F.when(home_bet, 1).otherwise(-1) > 0) & (F.abs(d["delta"]) >= 0.005)), F.lit(0))
    label, value, size = text.feature_label(first["label"]), first["value"], F.abs(first["delta"])
    strength = F.when(size >= 0.03, "mainly by").when(size >= 0.01, "much by").otherwise("a little by")
    signed = number(value, 2, "+")
    shown = F.when(label.rlike("%|probability|rate"), F.when(F.abs(value) <= 1.5, percent(value)).otherwise(signed)).when(label.rlike("differential|Elo"), signed).otherwise(number(value, 2))
    return F.concat(team, F.lit(" is favoured "), strength, F.lit(" "), label, F.coalesce(F.concat(F.lit(" ("), shown, F.lit(")")), F.lit("")), F.lit(", which moves the home team's chance by "), percent(first["delta"], "+"), F.lit("."))


def explanation(rows: DataFrame) -> DataFrame:
    """Adds ``explanation``: sentences by rule, on edge, driver, injuries, trend and lines.

    Uses side, edge, home_prob, market_home_prob, home, away, and where present
    drivers (array<struct<label, delta, value>>, the greatest first), home_form
    and away_form (see with_form), home_out and away_out (see with_injured),
    prob_movement, odds_disagreement and n_snapshots. What moves the model is
    cited before form; a sentence without its data is left out.
    """
    c = F.col
    have = lambda n, kind: c(n) if n in rows.columns else F.lit(None).cast(kind)
    home = c("side") == "HOME"
    team, other = F.when(home, c("home")).otherwise(c("away")), F.when(home, c("away")).otherwise(c("home"))
    p, price = F.when(home, c("home_prob")).otherwise(1 - c("home_prob")), F.when(home, c("market_home_prob")).otherwise(1 - c("market_home_prob"))
    edge = F.concat(F.lit(" (an edge of "), percent(c("edge")), F.lit(").")) if "edge" in rows.columns else F.lit(".")
    lead = F.when(price > 0, F.concat(F.lit("Model gives "), team, F.lit(" a "), percent(p), F.lit(" chance against a market price of "), percent(price), edge))
    formed = {"home_form", "away_form"} <= set(rows.columns)
    driver = F.coalesce(_driver_sentence(have("drivers", "array<struct<label:string,delta:double,value:double>>"), home, team), _form_sentence(home) if formed else F.lit(None).cast("string"))
    named = lambda n: F.array_join(F.transform(F.slice(have(n, "array<struct<player_name:string,status:string>>"), 1, NAMED), lambda x: F.concat(x["player_name"], F.lit(" ("), x["status"], F.lit(")"))), ", ")
    foes, own = F.when(home, named("away_out")).otherwise(named("home_out")), F.when(home, named("home_out")).otherwise(named("away_out"))
    weakened = F.when(foes != "", F.concat(other, F.lit(" is weakened without "), foes, F.lit(".")))
    missing = F.when(own != "", F.concat(F.lit("But "), team, F.lit(" also misses "), own, F.lit(".")))
    if formed:
        short, long = (F.when(home, c(f"home_form.plus_minus_roll_{n}")).otherwise(c(f"away_form.plus_minus_roll_{n}")) for n in (5, 20))
        numbers = F.concat(number(short, 1, "+"), F.lit(" over 5 games, "), number(long, 1, "+"), F.lit(" over 20."))
        trend = F.when(short - long > 3, F.concat(team, F.lit(" is trending up: "), numbers)).when(short - long < -3, F.concat(team, F.lit(" is in a slump: "), numbers))
    else:
        t = have("trend", "double")
        trend = F.when(t > 3, F.concat(team, F.lit(" is trending up."))).when(t < -3, F.concat(team, F.lit(" is in a slump.")))
    m, apart, seen = have("prob_movement", "double"), have("odds_disagreement", "double"), have("n_snapshots", "long") >= 2
    moving = F.when(seen & (F.abs(m) > 0.03), F.concat(F.lit("The line moves "), F.when(m > 0, "to").otherwise("away from"), F.lit(" the home team ("), percent(m, "+"), F.lit(").")))
    split = F.when(seen & (apart > 0.05), F.concat(F.lit("Markets disagree by "), percent(apart), F.lit(".")))
    words = F.when(c("side") == "NO BET", F.concat(F.lit("No significant edge between "), c("away"), F.lit(" and "), c("home"), F.lit("."))).otherwise(F.concat_ws(" ", lead, driver, weakened, missing, trend, moving, split))
    return rows.withColumn("explanation", words)
