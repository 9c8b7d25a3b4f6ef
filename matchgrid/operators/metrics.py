"""Performance of predictions and bets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import config
from ..functions import betting as bet
from ..scratch import written

BETS = "bet_side <> 'NO BET'"


def settled(predictions: DataFrame) -> DataFrame:
    """Adds profit and clv to predictions with a known result."""
    c = F.col
    won = predictions.withColumn("profit", bet.profit(c("bet_side"), c("home_won"), c("market_home_prob"), c("bet_size")))
    return won.withColumn("clv", bet.closing_value(c("bet_side"), F.lit(None).cast("double"), c("closing_market_prob"), c("market_home_prob")))


def performance_summary(rows: DataFrame) -> DataFrame:
    """One row over settled(): accuracy, bets, wins, losses, money."""
    known, own = F.col("home_won").isNotNull(), F.expr(BETS)
    right = (F.col("model_home_prob") >= 0.5) == F.col("home_won")
    count = lambda when: F.count(F.when(when, 1))
    out = rows.agg(
        F.count("*").alias("total_predictions"),
        count(known).alias("resolved"),
        F.avg(F.when(known, right.cast("double"))).alias("prediction_accuracy"),
        count(known & own).alias("total_bets"),
        count(own & (F.col("profit") > 0)).alias("wins"),
        count(own & (F.col("profit") < 0)).alias("losses"),
        F.coalesce(F.sum(F.when(known & own, F.abs("bet_size"))), F.lit(0.0)).alias("total_wagered"),
        F.coalesce(F.sum(F.when(known & own, F.col("profit"))), F.lit(0.0)).alias("total_profit"),
    )
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return out.withColumn("roi", rate("total_profit", "total_wagered")).withColumn("bet_win_rate", rate("wins", "total_bets"))


def calibration_bins(rows: DataFrame, p: str, y: Column, bins: int = 10) -> DataFrame:
    """Equal bins of a probability, the last closed above: count, means, gap."""
    edges = [i / bins for i in range(1, bins)]
    own = sum((F.when(F.col(p) >= e, 1).otherwise(0) for e in edges), F.lit(0))
    out = rows.where(F.col(p).isNotNull() & y.isNotNull()).groupBy(own.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_predicted"), F.avg(y.cast("double")).alias("mean_actual"))
    return out.withColumn("gap", F.abs(F.col("mean_predicted") - F.col("mean_actual")))


def calibration_error(bins: DataFrame) -> DataFrame:
    """Expected calibration error of calibration_bins."""
    return bins.agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"))


def probability_scores(rows: DataFrame, p: Column, y: Column, eps: float = 1e-15) -> DataFrame:
    """Brier score, log-loss and accuracy."""
    y = y.cast("double")
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return rows.agg(F.avg((p - y) * (p - y)).alias("brier"), F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q))).alias("log_loss"), F.avg(((p >= 0.5) == (y == 1)).cast("double")).alias("accuracy"))


def sharpe(rows: DataFrame, returns: Column) -> DataFrame:
    """Mean over sample deviation, times the root of the number of bets."""
    return rows.agg(F.count(returns).alias("n"), F.coalesce(F.try_divide(F.avg(returns), F.stddev_samp(returns)) * F.sqrt(F.count(returns)), F.lit(0.0)).alias("sharpe"))


def clv_summary(rows: DataFrame) -> DataFrame:
    """Mean closing-line value and its t-statistic (population deviation, from three bets on)."""
    v, n = F.when(F.expr(BETS), F.col("clv")), F.count(F.when(F.expr(BETS), F.col("clv")))
    t = F.try_divide(F.avg(v), F.stddev_pop(v) / F.sqrt(n))
    return rows.agg(n.alias("clv_count"), F.avg(v).alias("avg_clv"), F.when(n >= 3, t).alias("clv_tstat"))


def clv_detail(rows: DataFrame) -> DataFrame:
    """Price of the side bet on, at the bet and at the close, and the result."""
    own = lambda p: F.when(F.col("bet_side") == "HOME", F.col(p)).otherwise(1 - F.col(p))
    result = F.when(F.col("home_won").isNull(), "pending").when((F.col("bet_side") == "HOME") == F.col("home_won"), "W").otherwise("L")
    return rows.where(BETS).select("id", "date", "bet_side", own("market_home_prob").alias("bet_price"), own("closing_market_prob").alias("close_price"), "clv", result.alias("result"))


def recent_values(detail: DataFrame, k: int = 20) -> DataFrame:
    """The last k bets of clv_detail that have a closing price, the newest first."""
    return detail.where("clv is not null").orderBy(F.desc("date"), F.desc("id")).limit(k)


def bankroll_curve(rows: DataFrame, start: float = config.BANKROLL) -> DataFrame:
    """Running bankroll after each day of settled bets.

    Days, not bets, are rows of the ordered window: bets are summed first, so
    the one ordered pass is over the calendar, whatever their number.
    """
    days = rows.where(F.expr(BETS) & F.col("profit").isNotNull()).groupBy("date").agg(F.sum("profit").alias("day_profit"))
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return days.withColumn("bankroll", start + F.sum("day_profit").over(w))


def max_drawdown(curve: DataFrame, start: float = config.BANKROLL) -> DataFrame:
    """Largest fall of a curve (date, bankroll) from its peak, as a share of it; the start is a peak too."""
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    peak = F.greatest(F.lit(start), F.max("bankroll").over(w))
    falls = curve.select(F.when(peak > 0, (peak - F.col("bankroll")) / peak).otherwise(0.0).alias("fall"))
    return falls.agg(F.greatest(F.coalesce(F.max("fall"), F.lit(0.0)), F.lit(0.0)).alias("max_drawdown"))


def recent_roi(rows: DataFrame, k: int = 10) -> DataFrame:
    """Return on the last k settled bets, their number and the stake multiplier that follows."""
    last = rows.where(F.expr(BETS) & F.col("profit").isNotNull()).orderBy(F.desc("date"), F.desc("id")).limit(k)
    out = last.agg(F.count("*").alias("n"), F.coalesce(F.try_divide(F.sum("profit"), F.sum(F.abs("bet_size"))), F.lit(0.0)).alias("roi"))
    return out.withColumn("multiplier", bet.drawdown_multiplier(F.col("n"), F.col("roi")))


def badge_distribution(rows: DataFrame, edge: Column, won: Column) -> DataFrame:
    return rows.groupBy(bet.badge(edge).alias("badge")).agg(F.count("*").alias("n"), F.count(F.when(won, 1)).alias("wins"))


def slate_exposure(rows: DataFrame, slate: str, bankroll: float = config.BANKROLL) -> DataFrame:
    """Bets of each slate, their stakes, the share of the bankroll, and the correlation haircut."""
    own = F.expr(BETS)
    out = rows.groupBy(slate).agg(F.count(F.when(own, 1)).alias("n_bets"), F.coalesce(F.sum(F.when(own, F.col("bet_size"))), F.lit(0.0)).alias("total_stake"))
    return out.withColumn("exposure", F.col("total_stake") / bankroll).withColumn("haircut", bet.haircut(F.col("n_bets")))


def capped_stakes(rows: DataFrame, slate: str, fraction: str, cap: float = config.MAX_EXPOSURE) -> DataFrame:
    """Scales the fractions of each slate so that they add up to the cap at most."""
    total = F.sum(fraction).over(Window.partitionBy(slate))
    return rows.withColumn("capped", F.when(total > cap, F.col(fraction) * cap / total).otherwise(F.col(fraction)))


QUANTILES = (5, 25, 50, 75, 95)


def quantiles(rows: DataFrame, x: str, exponential: bool = False) -> DataFrame:
    """Quantiles of a column by linear interpolation, with mean and maximum, as one row; nulls don't count.

    With exponential the column has logarithms, and interpolation is between
    what they are logarithms of.

    Values are sorted over ranges of them and written; the counts of the ranges,
    one number each, tell which rows are wanted, so no task holds them all.
    """
    own = rows.select(F.col(x).cast("double").alias("x")).where("x is not null").repartitionByRange("x").sortWithinPartitions("x")
    own = written(own.select("x", F.monotonically_increasing_id().alias("place")), "quantiles")
    sizes = sorted((r["part"], r["n"]) for r in own.groupBy(F.shiftright("place", 33).alias("part")).agg(F.count("*").alias("n")).collect())  # a row for each range
    n = sum(size for _, size in sizes)

    def place_of(rank: int) -> int:
        for part, size in sizes:
            if rank < size:
                return (part << 33) + rank
            rank -= size
        raise IndexError(rank)

    at = {q: (int(q * (n - 1) // 100), q * (n - 1) % 100 / 100) for q in QUANTILES} if n else {}
    places = {k: place_of(k) for low, part in at.values() for k in ((low, low + 1) if part else (low,))}
    found = {r["place"]: r["x"] for r in own.where(F.col("place").isin(*places.values())).collect()} if n else {}

    def value(low: int, part: float) -> float:
        a = found[places[low]]
        step = found[places[low + 1]] - a if part else 0.0
        if not exponential:
            return a + part * step
        return a + (math.log1p(part * math.expm1(step)) if step < 700 else step + math.log(part))

    known = {f"pct_{q}": F.lit(value(*at[q]) if n else None).cast("double") for q in QUANTILES}
    return own.agg(F.avg("x").alias("mean"), F.max("x").alias("max")).select(*(v.alias(k) for k, v in known.items()), "mean", "max")
