"""Scalar expressions over probabilities, prices and stakes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import config
from .basketball import clip

TINY = 1e-6


def logit(p: Column) -> Column:
    p = clip(p, TINY, 1 - TINY)
    return F.ln(p / (1 - p))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def moneyline_prob(line: Column) -> Column:
    """Implied probability of an American price; null for null, 0.5 for zero."""
    line = line.cast("double")
    return F.when(line < 0, -line / (-line + 100)).when(line > 0, 100 / (line + 100)).when(line == 0, 0.5)


def devig(home_line: Column, away_line: Column, spread: Column) -> Column:
    """Home probability: both prices normalised, one filled from the other, else from the spread; null without any."""
    h, a = moneyline_prob(home_line), moneyline_prob(away_line)
    return (
        F.when(h.isNotNull() & a.isNotNull() & (h + a > 0), h / (h + a))
        .when(h.isNotNull(), h)
        .when(a.isNotNull(), 1 - a)
        .when(spread.isNotNull(), clip(0.5 - 0.025 * spread, 0.05, 0.95))
    )


def sane_prices(home: Column, away: Column) -> Column:
    inside = lambda p: (p > 0.01) & (p < 0.99)
    return F.coalesce(inside(home) & inside(away) & (F.abs(home + away - 1) <= 0.05), F.lit(False))


def edge(p: Column, price: Column) -> Column:
    """p / price - 1; 0 where the price isn't between 0 and 1."""
    return F.when((price > 0) & (price < 1), p / price - 1).otherwise(0.0)


expected_value = edge


def suspicious(e: Column) -> Column:
    return e >= config.SUSPECT_EDGE


def badge(e: Column) -> Column:
    return F.when(e >= 0.15, "SUSPECT").when(e >= 0.05, "STRONG").when(e >= 0.03, "MODERATE").when(e >= 0.02, "LEAN").otherwise("NO BET")


def shrink(p: Column, market: Column, weight: float | Column = config.SHRINK) -> Column:
    """p drawn to the market in log-odds; p itself where the market isn't between 0 and 1."""
    w = clip(F.lit(weight) if isinstance(weight, (int, float)) else weight, 0.0, 1.0)
    return F.when((market > 0) & (market < 1), sigmoid((1 - w) * logit(p) + w * logit(market))).otherwise(p)


def signal_fraction(gap: Column, clv_t: Column | None = None, base: float = config.KELLY_FRACTION) -> Column:
    """Kelly fraction by strength of signal.

    gap is probability minus price, and its size also the disagreement with the
    market; clv_t the t-statistic of past closing-line values, if known.
    """
    band = F.when(gap < 0.02, 0.6).when(gap <= 0.08, 1.0).when(gap <= 0.12, 0.9).when(gap <= 0.20, 0.75).otherwise(0.5)
    clv = F.lit(1.0) if clv_t is None else F.when(clv_t >= 1.5, 1.15).when(clv_t <= -1.5, 0.7).otherwise(1.0)
    apart = F.when(F.abs(gap) >= 0.20, 0.65).when(F.abs(gap) >= 0.15, 0.85).otherwise(1.0)
    scaled = base * band * clv * apart
    return F.when(gap <= 0, 0.5 * base).otherwise(F.least(F.greatest(scaled, F.lit(0.25 * base)), F.lit(1.25 * base)))


def kelly(p: Column, price: Column, base: float = config.KELLY_FRACTION, drawdown: Column | None = None, clv_t: Column | None = None) -> Column:
    """Share of the bankroll to stake: full Kelly (p - price) / (1 - price), scaled by signal and drawdown, capped."""
    scale = signal_fraction(p - price, clv_t, base)
    scale = scale if drawdown is None else scale * clip(drawdown, 0.0, 1.0)
    full = (p - price) / F.nullif(1 - price, F.lit(0.0))
    return F.when((price > 0) & (price < 1) & (p > price), F.least(full * scale, F.lit(config.MAX_BET))).otherwise(0.0)


def drawdown_multiplier(n: Column, roi: Column) -> Column:
    return F.when(n < 5, 1.0).when(roi < -0.10, 0.25).when(roi < -0.05, 0.5).otherwise(1.0)


def within_exposure(open_stakes: Column, stake: Column, bankroll: float = config.BANKROLL) -> Column:
    return open_stakes + stake <= config.MAX_EXPOSURE * bankroll


def bet_side(home_edge: Column, away_edge: Column, home_p: Column, away_p: Column) -> Column:
    """HOME if the better side and good enough; else AWAY if good enough; else NO BET. The order matters."""
    fit = lambda e, p: (e >= config.MIN_EDGE) & (p >= config.SIDE_FLOOR)
    return F.when((home_edge > away_edge) & fit(home_edge, home_p), "HOME").when(fit(away_edge, away_p), "AWAY").otherwise("NO BET")


def ensemble(elo: Column, model: Column, weight: float | Column = config.ELO_WEIGHT) -> Column:
    return sigmoid(weight * logit(elo) + (1 - weight) * logit(model))


def miss_probability(status: Column) -> Column:
    return F.when(status == "Out", 1.0).when(status == "Doubtful", 0.85).when(status == "Day-to-Day", 0.60).when(status == "Questionable", 0.50).when(status == "Probable", 0.15).otherwise(0.5)


def impact_estimate(rank: Column, status: Column) -> Column:
    """A player's rating from the depth chart: 7, 4 or 2 by rank, times a factor by status."""
    base = F.when(rank <= 1, 7.0).when(rank == 2, 4.0).otherwise(2.0)
    factor = F.when(status == "Out", 1.0).when(status == "Doubtful", 0.9).when(status == "Day-to-Day", 0.6).when(status == "Questionable", 0.5).when(status == "Probable", 0.2).otherwise(0.5)
    return F.round(base * factor, 1)


def injury_adjustment(missing_impact: Column) -> Column:
    return F.greatest(F.lit(-0.15), -0.006 * F.coalesce(missing_impact, F.lit(0.0)))


def adjusted_prob(p: Column, home_missing: Column, away_missing: Column) -> Column:
    return clip(p + injury_adjustment(home_missing) - injury_adjustment(away_missing), 0.01, 0.99)


def profit(side: Column, home_won: Column, home_price: Column, stake: Column) -> Column:
    """Of a settled bet; null while home_won is null."""
    price = F.when(side == "AWAY", 1 - home_price).otherwise(home_price)
    odds = F.when(price > 0, 1 / F.when(price > 0, price) - 1).otherwise(0.0)
    won = F.when(side == "HOME", home_won).otherwise(~home_won)
    return F.when(home_won.isNull(), None).when(side == "NO BET", 0.0).when(won, stake * odds).otherwise(-stake)


def closing_value(side: Column, opening: Column, closing: Column, bet_price: Column) -> Column:
    """Closing over opening price of the side taken, minus 1; the bet's price stands in for a missing opening."""
    start = F.coalesce(F.nullif(opening, F.lit(0.0)), bet_price)
    ratio = F.when(side == "HOME", F.try_divide(closing, start)).when(side == "AWAY", F.try_divide(1 - closing, 1 - start))
    return ratio - 1


def spread_pick(margin: Column, home_spread: Column, home: Column, away: Column) -> Column:
    """The side and line whose gap to the market is big enough."""
    gap = margin + home_spread
    return F.when(gap >= config.SPREAD_EDGE, F.concat_ws(" ", home, F.format_string("%+.1f", home_spread))).when(gap <= -config.SPREAD_EDGE, F.concat_ws(" ", away, F.format_string("%+.1f", -home_spread))).otherwise("NO BET")


def total_pick(total: Column, line: Column) -> Column:
    gap = total - line
    return F.when(gap >= config.TOTAL_EDGE, F.format_string("OVER %.1f", line)).when(gap <= -config.TOTAL_EDGE, F.format_string("UNDER %.1f", line)).otherwise("NO BET")


def readiness(days: Column) -> Column:
    return F.when(days >= 30, "ready").when(days >= 5, "partial").otherwise("cold")


def haircut(n_bets: Column, rho: float = config.SLATE_RHO) -> Column:
    return F.when(n_bets > 1, 1 / F.sqrt(1 + (n_bets - 1) * rho)).otherwise(1.0)
