"""Bankroll simulations and slate optimisation."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import config
from ..functions import betting as bet
from ..scratch import written
from .metrics import QUANTILES, quantiles

#: A multiplicative generator that both SQL dialects can compute exactly.
MODULUS, FACTOR = 2147483647, 48271


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that follows from integers."""
    x = sum((p.cast("long") * k for p, k in zip(parts, (7919, 104729, 1299709), strict=False)), F.lit(12345).cast("long"))
    mixed = x % MODULUS
    for _ in range(3):
        mixed = mixed * FACTOR % MODULUS
    return mixed / F.lit(float(MODULUS))


#: Bets up to which every worker reads all of them from the shared folder (8 bytes each, 20 where the market is right).
BROADCAST_BETS = 64_000_000


def bankroll_paths(bets: DataFrame, n_sims: int, mode: str = "market_right", n_bets: int | None = None) -> DataFrame:
    """Growth and largest drawdown of each simulated sequence of bets.

    Bankrolls are kept as logarithms (log_growth: of the last over the first),
    which no number of bets overflows; final_bankroll is infinite, or 0, where
    a double can't hold it. bets has idx (0 to n - 1), model_prob, market_prob and won. Each step draws a
    bet with replacement; it is won as it was (``empirical``) or with the
    market's probability (``market_right``). Draws follow from (sim, step), so a
    repeated task draws the same. Simulations are dealt out to tasks, whose workers
    read all bets from the shared folder, column by column, where they may hold them
    (see BROADCAST_BETS and _paths_in_tasks); none pass through the driver. Else draws meet bets in a
    join, and segments of a simulation's steps are ordered windows of their own,
    whose sums, tops and falls merge.
    """
    if mode not in ("empirical", "market_right"):
        raise ValueError(f"unknown mode {mode!r}")
    f = bet.kelly(F.col("model_prob"), F.col("market_prob"))
    logs = bets.select("idx", "market_prob", F.col("won").cast("boolean").alias("won"), F.ln(1 + f * (1 / F.col("market_prob") - 1)).alias("up"), F.ln(1 - f).alias("down"))
    logs = written(logs.withColumn("own", F.when(F.col("won"), F.col("up")).otherwise(F.col("down"))), "bets")
    n_source = logs.count()
    steps = n_source if n_bets is None else n_bets
    if not n_source or not steps:
        return bets.sparkSession.createDataFrame([], PATHS)
    few = n_source <= BROADCAST_BETS
    return (_paths_in_tasks if few else _paths_by_windows)(logs, n_source, n_sims, steps, mode)


PATHS = "sim long, log_growth double, final_bankroll double, max_drawdown double, n_bets long"
#: Steps of a simulation that one ordered window takes.
SEGMENT = 1 << 16


#: Draws that a task works on at a time, and consecutive draws that it takes over for all simulations that have them; steps of a path that are added up side by side with others (both are multiples of them).
DRAWS, PIECE, RUN = 1 << 16, 1 << 20, 16
#: The bets that a worker holds: those of the last simulation it took part in.
_HELD: dict[tuple, list[np.ndarray]] = {}


def _limits(p: np.ndarray) -> np.ndarray:
    """How many states uniform() gives less than p for: those below the number (none where p isn't known)."""
    t = np.clip(np.ceil(np.nan_to_num(p) * MODULUS), 0, MODULUS)
    t -= (t > 0) & ((t - 1) / MODULUS >= p)
    t += (t < MODULUS) & (t / MODULUS < p)
    return t.astype(np.uint32)


def _held(files: tuple[str, ...], names: tuple[str, ...], n: int) -> list[np.ndarray]:
    """Columns of the bets in files by idx, read in pieces once in a worker; market_prob as _limits."""
    if (files, names) not in _HELD:
        _HELD.clear()
        out = [np.zeros(n, np.uint32 if c == "market_prob" else float) for c in names]
        for uri in files:
            fs, path = FileSystem.from_uri(uri)
            with fs.open_input_file(path) as f:
                for batch in pq.ParquetFile(f).iter_batches(1 << 17, columns=["idx", *names]):
                    idx = batch.column("idx").to_numpy()
                    for own, c in zip(out, names, strict=True):
                        x = batch.column(c).to_numpy(zero_copy_only=False)
                        own[idx] = _limits(x) if c == "market_prob" else x
        _HELD[files, names] = out
    return _HELD[files, names]


def _later(first: int, steps: np.ndarray) -> np.ndarray:
    """States of uniform() that are steps (states) further on than a state."""
    x = steps + np.uint32(first)
    return np.minimum(x, x - np.uint32(MODULUS))  # a state that is too great less the modulus, others stay


def _chosen(wins: np.ndarray, up: np.ndarray, down: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """up where wins, else down, by their bits (np.where takes several times as long); wins and wide are used up."""
    bits = wins.view(np.int8)
    np.copyto(wide, np.negative(bits, out=bits))
    wide &= up.view(np.int64) ^ down.view(np.int64)
    wide ^= down.view(np.int64)
    return wide.view(float)


def _runs(steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of runs of steps (a column each), from 0 on: the end, the top, the low and the largest fall."""
    end, fall = steps[0].copy(), np.zeros(steps.shape[1])
    top, low, gap = np.maximum(end, 0), np.minimum(end, 0), np.empty_like(end)
    np.subtract(top, end, out=fall)
    for row in steps[1:]:
        end += row
        np.maximum(top, end, out=top)
        np.minimum(low, end, out=low)
        np.subtract(top, end, out=gap)
        np.maximum(fall, gap, out=fall)
    return end, top, low, fall


#: Three times FACTOR: uniform() is linear in its parts, so the states of later steps are sums.
_MIX = pow(FACTOR, 3, MODULUS)


def _paths_in_tasks(logs: DataFrame, n_source: int, n_sims: int, steps: int, mode: str) -> DataFrame:
    """Paths by pieces of the draws that simulations share.

    Step k of a simulation draws the bet of state (k + start) * 104729 * _MIX, so all
    simulations are spans of one sequence of bets, each from a start of its own. A
    task takes pieces of that sequence: it looks up a piece's bets once, and goes
    over them for each simulation whose span has them, with results of its own.
    """
    spark = logs.sparkSession
    names = ("own",) if mode == "empirical" else ("market_prob", "up", "down")
    files = tuple(sorted(logs.inputFiles()))
    # Constants are taken along, as tasks don't see what a driver has set.
    size, piece_size, back = DRAWS, PIECE, pow(104729, -1, MODULUS)
    starts = spark.range(n_sims).select(F.col("id").alias("sim"), ((F.col("id") * 7919 + 12345) % MODULUS * back % MODULUS).alias("start"))
    spans = starts.select("sim", "start", F.explode(F.sequence(F.expr(f"start div {piece_size}"), F.expr(f"(start + {steps - 1}) div {piece_size}"))).alias("piece"))
    pieces = spans.groupBy("piece").agg(F.collect_list(F.struct("sim", "start")).alias("spans")).repartition(8 * spark.sparkContext.defaultParallelism, "piece")

    def work(batches):
        bets = _held(files, names, n_source)
        along, across = (np.ascontiguousarray((np.arange(size) * (k * _MIX % MODULUS) % MODULUS).astype(np.uint32).reshape(-1, RUN).T) for k in (104729, 7919))
        wide = np.empty(along.shape, np.int64)
        for batch in batches:
            for piece, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sims = [(x["sim"], x["start"]) for x in spans]
                shift = [((s * 104729 + 7 * 1299709 + 12345 - 7919 * j) * _MIX) % MODULUS for s, j in sims]  # of the states that decide results
                total, low, n = np.zeros(len(sims)), np.zeros(len(sims)), np.zeros(len(sims), np.int64)
                top, fall = np.zeros(len(sims)), np.zeros(len(sims))  # falls are logarithms
                first, end = piece * piece_size, (piece + 1) * piece_size
                blocks = {k for _, j in sims for k in range((max(j, first) - first) // size, (min(j + steps, end) - 1 - first) // size + 1)}
                for lo in (first + k * size for k in sorted(blocks)):
                    own = [(i, max(j - lo, 0), min(j + steps - lo, size)) for i, (_, j) in enumerate(sims) if j < lo + size and j + steps > lo]
                    idx = (_later(lo * 104729 * _MIX % MODULUS, along) / float(MODULUS) * n_source).astype(np.int64)
                    held = [b.take(idx) for b in bets]
                    after = _later(lo * 7919 * _MIX % MODULUS, across)
                    for i, a, b in own:
                        part = slice(a // RUN, -(-b // RUN))
                        path = held[-1][:, part]
                        if mode == "market_right":
                            path = _chosen(_later(shift[i], after[:, part]) < held[0][:, part], held[1][:, part], path, wide[:, part])
                        if a % RUN or b % RUN:  # a span that begins or ends within a run has no steps beyond
                            path = path.copy()
                            path[: a % RUN, 0] = 0
                            path[(b - 1) % RUN + 1 :, -1] = 0
                        ends, tops, lows, falls = _runs(path)
                        ends[0] += total[i]
                        np.cumsum(ends, out=ends)
                        begins = np.append(total[i], ends[:-1])
                        tops += begins
                        lows += begins
                        peaks = np.maximum.accumulate(np.append(top[i], tops))
                        fall[i] = max(fall[i], falls.max(), (peaks[:-1] - lows).max())
                        total[i], top[i], low[i], n[i] = ends[-1], peaks[-1], min(low[i], lows.min()), n[i] + b - a
                columns = [np.array([s for s, _ in sims], np.int64), np.full(len(sims), piece), total, top, low, fall, n]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["sim", "segment", "total", "top", "low", "fall", "n"])

    parts = pieces.mapInArrow(work, "sim long, segment long, total double, top double, low double, fall double, n long")

    def joined(x, p):
        """A path, and the part that goes on from its end."""
        fall = F.greatest(x["fall"], p["fall"], x["top"] - x["total"] - p["low"])
        return F.struct((x["total"] + p["total"]).alias("total"), F.greatest(x["top"], x["total"] + p["top"]).alias("top"), fall.alias("fall"), (x["n"] + p["n"]).alias("n"))

    every = F.array_sort(F.collect_list(F.struct("segment", "total", "top", "low", "fall", "n")))
    none = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("top"), F.lit(0.0).alias("fall"), F.lit(0).cast("long").alias("n"))
    out = parts.groupBy("sim").agg(every.alias("parts")).select("sim", F.aggregate("parts", none, joined).alias("x"))
    return _as_paths(out.select("sim", F.col("x.total").alias("log_growth"), "x.fall", F.col("x.n").alias("n_bets")))


def _as_paths(paths: DataFrame) -> DataFrame:
    """PATHS of sim, log_growth, fall (the largest, as a logarithm) and n_bets."""
    return paths.select("sim", "log_growth", (config.BANKROLL * F.exp("log_growth")).alias("final_bankroll"), (-F.expm1(-F.col("fall"))).alias("max_drawdown"), "n_bets")


def _paths_by_windows(logs: DataFrame, n_source: int, n_sims: int, steps: int, mode: str) -> DataFrame:
    spark = logs.sparkSession
    draws = spark.range(n_sims * steps).select(F.expr(f"id div {steps}").alias("sim"), (F.col("id") % steps).alias("step"))  # simulations x steps is the work itself
    rows = draws.withColumn("idx", F.floor(uniform(F.col("sim"), F.col("step")) * n_source).cast("long")).join(logs, "idx")
    won = F.col("won") if mode == "empirical" else uniform(F.col("step"), F.col("sim"), F.lit(7)) < F.col("market_prob")
    rows = rows.select("sim", "step", F.expr(f"step div {SEGMENT}").alias("segment"), F.when(won, F.col("up")).otherwise(F.col("down")).alias("g"))
    within = Window.partitionBy("sim", "segment").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("path", F.sum("g").over(within))
    rows = rows.withColumn("fall", F.greatest(F.max("path").over(within), F.lit(0.0)) - F.col("path"))
    parts = rows.groupBy("sim", "segment").agg(F.sum("g").alias("total"), F.greatest(F.max("path"), F.lit(0.0)).alias("top"), F.min("path").alias("low"), F.max("fall").alias("fall"), F.count("*").alias("n"))
    before = Window.partitionBy("sim").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("start", F.coalesce(F.sum("total").over(before), F.lit(0.0)))
    parts = parts.withColumn("peak", F.greatest(F.lit(0.0), F.max(F.col("start") + F.col("top")).over(before)))
    falls = F.greatest("fall", F.col("peak") - F.col("start") - F.col("low"))
    return _as_paths(parts.groupBy("sim").agg(F.sum("total").alias("log_growth"), F.max(falls).alias("fall"), F.sum("n").alias("n_bets")))


def simulation_summary(paths: DataFrame) -> DataFrame:
    """One row: quantiles, mean and maximum of the final bankroll, as such and as logarithms, drawdowns, growth per bet.

    Quantiles lie between bankrolls, not logarithms, in equal parts. Where a
    double can't hold a bankroll it is infinite; its logarithm never is.
    """
    paths = written(paths, "paths")
    growth = F.col("log_growth") / F.col("n_bets")
    top = paths.agg(F.max("log_growth").alias("_top"))  # one row
    more = paths.crossJoin(F.broadcast(top)).agg(
        F.count("*").alias("n_simulations"),
        (F.max("_top") + F.ln(F.avg(F.exp(F.col("log_growth") - F.col("_top"))))).alias("log_mean"),
        F.avg((F.col("log_growth") > 0).cast("double")).alias("probability_of_profit"),
        F.avg((F.col("final_bankroll") <= 0).cast("double")).alias("probability_of_ruin"),
        F.percentile("max_drawdown", F.lit(0.5)).alias("median_max_drawdown"),
        F.max("max_drawdown").alias("worst_max_drawdown"),
        F.avg(growth).alias("mean_log_growth_per_bet"),
        F.percentile(growth, F.lit(0.5)).alias("median_log_growth_per_bet"),
    )
    logs = [f"pct_{q}" for q in QUANTILES] + ["max"]
    own = quantiles(paths, "log_growth", exponential=True).select(*(F.col(c).alias(f"log_{c}") for c in logs))
    out = own.crossJoin(more)  # one row each
    return out.select(*((config.BANKROLL * F.exp(f"log_{c}")).alias(c) for c in [*logs, "mean"]), "*")


def skill_gap(empirical: DataFrame, market_right: DataFrame) -> DataFrame:
    """How far simulations of what happened are above those where the market is right (one row each).

    Per bet; between the logarithms of the median bankrolls; and between the
    medians' returns, infinite where a double can't hold them.
    """
    side = lambda d, s: d.select(F.col("median_log_growth_per_bet").alias(f"g{s}"), F.col("log_pct_50").alias(f"l{s}"), F.expm1("log_pct_50").alias(f"r{s}"))
    both = side(empirical, 1).crossJoin(side(market_right, 2))
    return both.select((F.col("g1") - F.col("g2")).alias("log_growth_gap"), (F.col("l1") - F.col("l2")).alias("median_log_gap"), (F.col("r1") - F.col("r2")).alias("median_roi_gap"))


def confidence(bets: DataFrame, noise: float = 0.05, n: int = 1000) -> DataFrame:
    """Spread of the edge of single bets (id, prob, price) under Gaussian noise on the probability."""
    draws = bets.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n))))
    u, v = (F.shiftrightunsigned(F.xxhash64("id", "k", F.lit(s)), 11) / float(1 << 53) for s in (1, 2))  # independent, as linear steps aren't
    normal = F.sqrt(-2 * F.ln(F.greatest(u, F.lit(1e-12)))) * F.cos(2 * np.pi * v)
    p = F.least(F.greatest(F.col("prob") + noise * normal, F.lit(0.01)), F.lit(0.99))
    rows = draws.withColumn("e", bet.edge(p, F.col("price")))
    q = F.percentile("e", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    return rows.groupBy("id").agg(q.alias("q"), F.avg((F.col("e") > 0).cast("double")).alias("positive_share")).select("id", F.col("q")[0].alias("edge_5"), F.col("q")[1].alias("edge_50"), F.col("q")[2].alias("edge_95"), "positive_share")


def _projected(f: np.ndarray, top: float, total: float) -> np.ndarray:
    """The nearest point with 0 <= f <= top and sum(f) <= total."""
    g = np.clip(f, 0, top)
    if g.sum() <= total:
        return g
    lo, hi = 0.0, float(f.max())
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.clip(f - mid, 0, top).sum() > total else (lo, mid)
    return np.clip(f - hi, 0, top)


#: Largest gap of an optimum; results drawn at once; steps after which a slate is given up; bytes of drawn results, a bit each, that are kept for the next step.
GAP, DRAWN, STEPS, KEPT = 1e-7, 1 << 21, 5000, 64 << 20


def _outcomes(p: np.ndarray, rho: float, draws: int, seed: int):
    """Pieces of a (draws x bets) table of equally correlated results, the same each time it is asked for."""
    edges = np.array([NormalDist().inv_cdf(min(max(1 - x, 1e-9), 1 - 1e-9)) for x in p])
    step = max(1, DRAWN // max(1, len(p)))
    for k, lo in enumerate(range(0, draws, step)):
        r = np.random.default_rng([seed, k])
        n = min(step, draws - lo)
        yield np.sqrt(rho) * r.standard_normal((n, 1)) + np.sqrt(1 - rho) * r.standard_normal((n, len(p))) > edges


def _drawn(p: np.ndarray, rho: float, draws: int, seed: int):
    """A function that gives the pieces of _outcomes: kept as bits, where they take KEPT bytes at most, else drawn again."""
    if len(p) * draws > 8 * KEPT:
        return lambda: _outcomes(p, rho, draws, seed)
    kept = [np.packbits(won, axis=1) for won in _outcomes(p, rho, draws, seed)]
    return lambda: (np.unpackbits(bits, axis=1, count=len(p)).view(bool) for bits in kept)


def _growth(f: np.ndarray, b, draws: int, drawn) -> tuple[float, np.ndarray]:
    """Mean log growth over the draws, and its gradient; minus infinity where a draw loses all."""
    value, grad = 0.0, np.zeros(len(f))
    for won in drawn():
        gains = np.where(won, b, -1.0)
        money = 1 + gains @ f
        if money.min() <= 0:
            return -np.inf, grad
        value += np.log(money).sum()
        gains /= money[:, None]
        grad += gains.sum(0)
    return value / draws, grad / draws


def gap_of(grad: np.ndarray, f: np.ndarray, top: float, total: float) -> float:
    """At most by how much any allowed stakes can be better: what the gradient promises at the best corner."""
    left, corner = total, np.zeros(len(f))
    for i in np.argsort(-grad, kind="stable"):
        if grad[i] <= 0 or left <= 0:
            break
        corner[i] = min(top, left)
        left -= corner[i]
    return float(grad @ (corner - f))


def optimum(probs: np.ndarray, prices: np.ndarray, rho: float = config.PORTFOLIO_RHO, top: float = config.MAX_BET, total: float = config.MAX_EXPOSURE, draws: int = 2000, seed: int = 42) -> tuple[np.ndarray, float, float]:
    """(stakes, growth, gap) of a slate: stakes that maximise mean log growth over draws of equally correlated results.

    Projected gradient steps, each of a length that is sure to improve, until
    the gap shows that no allowed stakes are better by more than GAP. Draws are
    made in pieces, once for all steps where their bits are few (see KEPT), so a slate of
    any size needs memory for its stakes, one piece and KEPT bytes.
    """
    out = np.zeros(len(probs))
    good = np.flatnonzero((prices > 0) & (prices < 1) & (probs > prices))
    if not len(good):
        return out, 0.0, 0.0
    p, b = probs[good], 1 / prices[good] - 1
    f = _projected((p * (b + 1) - 1) / b, top, total)
    drawn = _drawn(p, rho, draws, seed)
    value, grad = _growth(f, b, draws, drawn)
    if not np.isfinite(value):
        f = f * 0.0
        value, grad = _growth(f, b, draws, drawn)
    length = 0.02
    for _ in range(STEPS):
        if gap_of(grad, f, top, total) <= GAP:
            break
        while True:
            g = _projected(f + length * grad, top, total)
            better, slope = _growth(g, b, draws, drawn)
            if better >= value + grad @ (g - f) - ((g - f) ** 2).sum() / (2 * length) - 1e-15 or length < 1e-12:
                break
            length /= 2
        move, turn = g - f, grad - slope
        f, value, grad = g, better, slope
        curve = move @ turn
        length = min(max((move @ move) / curve, length / 10), 1e3) if curve > 0 else 2 * length
    out[good] = f
    return out, value, gap_of(grad, f, top, total)


def optimal_fractions(probs: np.ndarray, prices: np.ndarray, rho: float = config.PORTFOLIO_RHO, scale: float = config.KELLY_FRACTION, top: float = config.MAX_BET, total: float = config.MAX_EXPOSURE, draws: int = 2000, seed: int = 42) -> np.ndarray:
    """The optimum's stakes, scaled down; within the limits of a bet and of the slate."""
    return scaled(optimum(probs, prices, rho, top, total, draws, seed)[0], scale, top, total)


def scaled(stakes: np.ndarray, scale: float = config.KELLY_FRACTION, top: float = config.MAX_BET, total: float = config.MAX_EXPOSURE) -> np.ndarray:
    f = np.clip(stakes * scale, 0, top)
    return f * min(1.0, total / f.sum()) if f.sum() > 0 else f


def optimised_slates(bets: DataFrame) -> DataFrame:
    """Adds fraction to bets (slate, id, prob, price), with the slate's growth and gap: each slate is optimised as a whole; a slate is one day's games."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        stakes, growth, gap = optimum(pdf["prob"].to_numpy(), pdf["price"].to_numpy())
        return pdf.assign(fraction=scaled(stakes), growth=growth, gap=gap)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in bets.select("slate", "id", "prob", "price").schema)
    return bets.select("slate", "id", "prob", "price").groupBy("slate").applyInPandas(work, f"{schema}, fraction double, growth double, gap double")
