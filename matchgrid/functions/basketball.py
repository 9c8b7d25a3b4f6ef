"""Scalar expressions over box scores and ratings. A null input gives null unless stated."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import config


def clip(x: Column, low: float, high: float) -> Column:
    """x within bounds; null stays null (least and greatest alone would skip it)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def safe_ratio(x: Column, y: Column) -> Column:
    """x / y, with 1 in place of a zero denominator."""
    return x.cast("double") / F.when(y == 0, F.lit(1.0)).otherwise(y.cast("double"))


def possessions(fga: Column, fta: Column, tov: Column, oreb: Column) -> Column:
    raw = fga + 0.44 * fta + tov - oreb
    return F.when(raw.isNotNull(), F.greatest(F.lit(60.0), raw))


def effective_fg(fgm: Column, fg3m: Column, fga: Column) -> Column:
    return safe_ratio(fgm + 0.5 * fg3m, fga)


def turnover_rate(tov: Column, fga: Column, fta: Column) -> Column:
    return safe_ratio(tov, fga + 0.44 * fta + tov)


def free_throw_rate(ftm: Column, fga: Column) -> Column:
    return safe_ratio(ftm, fga)


def pythagorean(scored: Column, allowed: Column, power: float = config.PYTHAGOREAN) -> Column:
    """Expected win share, in log space; 0.5 without data, 0.01 to 0.99 otherwise."""
    share = 1 / (1 + F.exp(power * (F.ln(allowed) - F.ln(scored))))
    return (
        F.when(scored.isNull() | allowed.isNull() | ((scored <= 0) & (allowed <= 0)), 0.5)
        .when(allowed <= 0, 0.99)
        .when(scored <= 0, 0.01)
        .otherwise(F.least(F.greatest(share, F.lit(0.01)), F.lit(0.99)))
    )


def elo_expected(own: Column, other: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), -(own - other) / 400.0))


def elo_home_prob(home: Column, away: Column) -> Column:
    return elo_expected(home + config.ELO_HOME, away)


def elo_carry(rating: Column) -> Column:
    """A rating at the start of a season."""
    return config.ELO_START + config.ELO_CARRY * (rating - config.ELO_START)


def opponent_factor(winner: Column, loser: Column) -> Column:
    return 1 / (1 + F.exp(-(loser - winner) / 200.0))


def margin_multiplier(margin: Column, winner: Column, loser: Column) -> Column:
    return F.pow(F.abs(margin) + 3, F.lit(0.8)) / (7.5 + 0.006 * (winner - loser)) * opponent_factor(winner, loser)


def schedule_adjusted(net: Column, opponent_elo: Column) -> Column:
    """A net rating over the strength of the opponent, whose factor stays within 0.5 and 1.5."""
    return net / clip(1 + (opponent_elo - config.ELO_START) / 500.0, 0.5, 1.5)


def season_label(start_year: Column) -> Column:
    """2025 as 2025-26."""
    return F.format_string("%d-%02d", start_year, (start_year + 1) % 100)
