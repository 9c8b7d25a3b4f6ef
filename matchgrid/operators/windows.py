"""Ordered statistics of teams: rolling and weighted means that never see their own row.

A team's rows are numbered by way of its days, and cut into ranges of RANGE rows; the
HALO rows before a range are copied into it. All frames share the partitioning by team and
range, so Spark computes them behind one exchange and sort, and no partition grows with
the length of a team's history. What reaches further back than the halo (last known values,
counts) comes from a summary with a row for each range.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec

from .. import config
from ..functions import basketball as bb
from ..scratch import written

#: Box-score columns whose rolling means are features, as far as a table has them.
STATS = "pts pts_against net_rtg_game fg_pct fg3_pct ft_pct oreb dreb reb ast stl blk tov plus_minus fgm fga fg3m fg3a ftm fta opp_elo poss".split()
FACTORS = ("efg_pct", "tov_pct", "orb_pct", "ft_rate")
#: Half-lives after which a row's weight counts as nothing (less than a double resolves).
SPAN = 60
#: Rows of a team in a range, and rows before it that come along: at least the widest frame, and SPAN half-lives.
RANGE, HALO = 16 * SPAN * config.HALF_LIFE, SPAN * config.HALF_LIFE


def placed(rows: DataFrame) -> DataFrame:
    """Adds what follows from the days of a team: _pos (number of the row, by date and game_id), _gap (days since the row before), _rn (number within the day), _d7 and _d14 (rows of the days before).

    The ordered pass has a row for each team and day.
    """
    days = rows.groupBy("team_id", "date").agg(F.count("*").alias("_n")).withColumn("_day", F.datediff("date", F.lit("1970-01-01").cast("date")))
    team = Window.partitionBy("team_id").orderBy("_day")
    earlier = lambda n: F.coalesce(F.sum("_n").over(team.rangeBetween(-n, -1)), F.lit(0))
    before = F.coalesce(F.sum("_n").over(team.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.select(F.col("team_id").alias("_team"), F.col("date").alias("_date"), before.alias("_before"), (F.col("_day") - F.lag("_day").over(team)).alias("_gap"), earlier(7).alias("_d7"), earlier(14).alias("_d14"))
    own = rows.join(days, F.col("team_id").eqNullSafe(F.col("_team")) & F.col("date").eqNullSafe(F.col("_date"))).drop("_team", "_date")
    own = own.withColumn("_rn", F.row_number().over(Window.partitionBy("team_id", "date").orderBy("game_id")))
    return own.withColumns({"_pos": F.col("_before") + F.col("_rn") - 1, "_gap": F.when(F.col("_rn") == 1, F.col("_gap")).otherwise(0)}).drop("_before")


def ranged(rows: DataFrame, block: int | None = None) -> DataFrame:
    """Rows with their _range, those near a range's end also as copies (_copy) in the next; a block of rows, if given, comes along whole."""
    size, halo = (RANGE, HALO) if not block or (block <= HALO and RANGE % block == 0) else (16 * block, block)
    own = rows if "_pos" in rows.columns else placed(rows)
    r = F.expr(f"_pos div {size}")
    own = own.withColumn("_range", F.explode(F.when(F.col("_pos") % size >= size - halo, F.array(r, r + 1)).otherwise(F.array(r))))
    return own.withColumn("_copy", F.col("_range") != r)


def unranged(rows: DataFrame, write: bool = True) -> DataFrame:
    """The rows without copies; values and counts that ranges before have (see filled, counted) are carried into them.

    The rows are written for that, unless they have many frames: the summary of ranges asks for few of them, so those
    are computed twice instead.
    """
    fills, counts = ([c.removeprefix(p) for c in rows.columns if c.startswith(p)] for p in ("_fill_", "_has_"))
    out = rows.where(~F.col("_copy"))
    if fills or counts:
        out = written(out, "ranges") if write else out
        c = lambda prefix, name: F.col(f"`{prefix}{name}`")
        held = [F.max_by(F.struct(*(c("_fill_", x).alias(f"f{i}") for i, x in enumerate(fills))), "_pos").alias("_held")] if fills else []
        own = out.groupBy("team_id", "_range").agg(*held, *(F.sum(c("_has_", x)).alias(f"_sum{i}") for i, x in enumerate(counts)))
        earlier = Window.partitionBy("team_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
        carried = [F.last(f"_held.f{i}", ignorenulls=True).over(earlier).alias(f"_old_{x}") for i, x in enumerate(fills)] + [F.coalesce(F.sum(f"_sum{i}").over(earlier), F.lit(0)).alias(f"_old_{x}") for i, x in enumerate(counts)]
        carry = own.select(F.col("team_id").alias("_t"), F.col("_range").alias("_r"), *carried)
        carry = written(carry, "carried")
        out = out.join(carry, F.col("team_id").eqNullSafe(F.col("_t")) & (F.col("_range") == F.col("_r")))
        out = out.withColumns({x: F.coalesce(c("_fill_", x), c("_old_", x)) for x in fills} | {x: F.when(c("_n_", x) + c("_old_", x) >= c("_least_", x), c("", x)) for x in counts})
    return out.drop(*(c for c in out.columns if c.startswith("_")))


def by_range(f):
    """For functions over ranged rows: plain rows are cut into ranges before, and put together after."""

    @wraps(f)
    def run(rows: DataFrame, *args, **kwargs) -> DataFrame:
        return f(rows, *args, **kwargs) if "_range" in rows.columns else unranged(f(ranged(rows), *args, **kwargs))

    return run


def by_team() -> WindowSpec:
    return Window.partitionBy("team_id", "_range").orderBy("_pos")


def before(width: int | None = None) -> WindowSpec:
    return by_team().rowsBetween(Window.unboundedPreceding if width is None else -width, -1)


def rolling_mean(x: Column, width: int, least: int | None = None) -> Column:
    """Mean of the ``width`` rows before, where at least ``least`` of them (half by default) aren't null."""
    least = max(1, width // 2) if least is None else least
    return F.when(F.count(x).over(before(width)) >= least, F.avg(x).over(before(width)))


def filled(x: Column) -> Column:
    """The last value within the range that isn't null, up to the row; to be named _fill_{name}, for unranged to carry."""
    return F.last(F.when(~F.col("_copy"), x), ignorenulls=True).over(by_team().rowsBetween(Window.unboundedPreceding, 0))


def counted(name: str, x: Column, least: int) -> dict[str, Column]:
    """Columns by which unranged keeps ``name`` only where at least ``least`` rows before have an x that isn't null."""
    has = F.when(~F.col("_copy"), x).isNotNull().cast("int")
    return {f"_has_{name}": has, f"_n_{name}": F.coalesce(F.sum(has).over(before()), F.lit(0)), f"_least_{name}": F.lit(least)}


def with_derived(stats: DataFrame) -> DataFrame:
    """Adds net_rtg_game, opponent_id, poss and the factors that need no other row."""
    c = F.col
    return stats.withColumns(
        {
            "net_rtg_game": (c("pts") - c("pts_against")).cast("double"),
            "opponent_id": F.when(c("team_id") == c("home_team_id"), c("away_team_id")).otherwise(c("home_team_id")),
            "poss": bb.possessions(c("fga"), c("fta"), c("tov"), c("oreb")),
            "efg_pct": bb.effective_fg(c("fgm"), c("fg3m"), c("fga")),
            "tov_pct": bb.turnover_rate(c("tov"), c("fga"), c("fta")),
            "ft_rate": bb.free_throw_rate(c("ftm"), c("fga")),
        }
    )


def with_rebounds(stats: DataFrame) -> DataFrame:
    """Adds opp_dreb (the game's defensive rebounds less the team's own) and orb_pct."""
    game = Window.partitionBy("game_id")
    out = stats.withColumn("opp_dreb", F.sum("dreb").over(game) - F.col("dreb"))
    return out.withColumn("orb_pct", bb.safe_ratio(F.col("oreb"), F.col("oreb") + F.col("opp_dreb")))


@by_range
def with_rolling(stats: DataFrame, columns: list[str], widths: tuple[int, ...] = config.WINDOWS) -> DataFrame:
    """Adds {column}_roll_{width} for the columns that the table has."""
    own = [c for c in columns if c in stats.columns]
    return stats.withColumns({f"{c}_roll_{n}": rolling_mean(F.col(c).cast("double"), n) for n in widths for c in own})


def with_adjusted(stats: DataFrame, widths: tuple[int, ...] = config.WINDOWS) -> DataFrame:
    """Adds adj_net_rtg_roll_{width} from the rolling net rating and opponents' rating."""
    return stats.withColumns({f"adj_net_rtg_roll_{n}": bb.schedule_adjusted(F.col(f"net_rtg_game_roll_{n}"), F.col(f"opp_elo_roll_{n}")) for n in widths})


def with_weighted(stats: DataFrame, columns: list[str], half_life: float = config.HALF_LIFE, least: int = 2) -> DataFrame:
    """Adds {column}_ewm_{half_life}: the exponentially weighted mean of the rows before.

    Weights are powers of two of the row number over the half-life. As these
    would overflow, rows are numbered within blocks of SPAN half-lives; the
    block before counts with what is left of its weight, older ones with
    nothing, so a team may have any number of rows.
    """
    block = int(SPAN * half_life)
    own = stats if "_range" in stats.columns else ranged(stats, block)
    if own is stats and (block > HALO or RANGE % block):
        raise ValueError(f"ranges don't hold whole blocks of {block} rows")
    out = own.withColumn("_block", F.expr(f"_pos div {block}"))
    weight = F.pow(F.lit(2.0), (F.col("_pos") - F.col("_block") * block) / half_life)
    inside = Window.partitionBy("team_id", "_range", "_block").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    last = Window.partitionBy("team_id", "_range").orderBy("_block").rangeBetween(-1, -1)
    both = lambda x: F.coalesce(F.sum(x).over(inside), F.lit(0.0)) + F.coalesce(F.sum(x).over(last), F.lit(0.0)) * 2.0**-SPAN
    for c in columns:
        x, name = F.col(c).cast("double"), f"{c}_ewm_{half_life:g}"
        mean = F.try_divide(both(x * weight), F.nullif(both(F.when(x.isNotNull(), weight)), F.lit(0.0)))
        out = out.withColumns({name: mean} | counted(name, x, least))
    return out.drop("_block") if own is stats else unranged(out.drop("_block"))


@by_range
def with_back_to_back_shooting(stats: DataFrame, widths: tuple[int, ...] = config.B2B_WINDOWS) -> DataFrame:
    """Adds fg3_pct_b2b_roll_{width}: three-point shooting on days after a game, within the rows before."""
    shot = F.when(F.col("_gap") <= 1, F.col("fg3_pct"))
    out = stats.withColumns({f"_x{n}": rolling_mean(shot, n, 2) for n in widths})
    return out.withColumns({f"_fill_fg3_pct_b2b_roll_{n}": filled(F.col(f"_x{n}")) for n in widths}).drop(*(f"_x{n}" for n in widths))


@by_range
def with_venue_splits(stats: DataFrame, columns: tuple[str, ...] = ("plus_minus", "net_rtg_game"), widths: tuple[int, ...] = config.SPLIT_WINDOWS) -> DataFrame:
    """Adds {column}_{home|away}_split_roll_{width}: means over the games at that venue among the rows before."""
    venues = {"home": F.col("is_home"), "away": ~F.col("is_home")}
    names = {f"{c}_{v}_split_roll_{n}": (c, v, n) for c in columns for v in venues for n in widths}
    out = stats.withColumns({f"_x{k}": rolling_mean(F.when(venues[v], F.col(c).cast("double")), n, max(1, n // 3)) for k, (c, v, n) in names.items()})
    return out.withColumns({f"_fill_{k}": filled(F.col(f"_x{k}")) for k in names}).drop(*(f"_x{k}" for k in names))


def with_rest(stats: DataFrame) -> DataFrame:
    """Adds rest_days (first game: 3, at most 7), is_back_to_back, games_last_7 and games_last_14 (earlier rows only)."""
    own = stats if "_pos" in stats.columns else placed(stats)
    gap = F.col("_gap")
    out = own.withColumn("rest_days", F.when(gap.isNull(), 3).otherwise(F.least(gap, F.lit(7))))
    out = out.withColumn("is_back_to_back", F.coalesce((gap <= 1).cast("int"), F.lit(0)))
    out = out.withColumns({f"games_last_{n}": F.col(f"_d{n}") + F.col("_rn") - 1 for n in (7, 14)})
    return out if own is stats else out.drop(*(c for c in out.columns if c.startswith("_")))


def latest_rows(stats: DataFrame) -> DataFrame:
    """The last row of each team."""
    last = Window.partitionBy("team_id").orderBy(F.desc("date"), F.desc("game_id"))
    return stats.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k")


def last_rows(stats: DataFrame, n: int) -> DataFrame:
    """The last n rows of each team; only rows of its last days are put in order."""
    later = F.coalesce(F.sum("_n").over(Window.partitionBy("_team").orderBy(F.desc("_date")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = stats.groupBy(F.col("team_id").alias("_team"), F.col("date").alias("_date")).agg(F.count("*").alias("_n"))
    ends = days.withColumn("_later", later).where(F.col("_later") < n)  # n days of a team at most
    own = stats.join(ends, F.col("team_id").eqNullSafe(F.col("_team")) & F.col("date").eqNullSafe(F.col("_date")), "left_semi")
    order = Window.partitionBy("team_id").orderBy(F.desc("date"), F.desc("game_id"))
    return own.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= n).drop("_k")


def game_rows(games: DataFrame) -> DataFrame:
    """Two rows for each finished game, one for each team."""
    side = lambda own, other, home: F.struct(F.col(f"{own}_team_id").alias("team_id"), F.lit(home).alias("is_home"), F.col(f"{own}_score").alias("pts"), F.col(f"{other}_score").alias("pts_against"))
    rows = games.where("home_score is not null and away_score is not null")
    return rows.select(F.col("id").alias("game_id"), "date", "season", "home_team_id", "away_team_id", F.explode(F.array(side("home", "away", True), side("away", "home", False))).alias("s")).select("*", "s.*").drop("s")
