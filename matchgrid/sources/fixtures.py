"""The domain's tables as views over the star-schema tables that tests use.

The text is the common subset of Spark SQL and DuckDB, so that an oracle can
inline the same definitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "teams": (
        ("nation",),
        """select cast(n_nationkey as bigint) as id, concat('T', lpad(cast(n_nationkey as string), 2, '0')) as abbreviation,
        n_name as name, case when n_regionkey % 2 = 0 then 'East' else 'West' end as conference from nation""",
    ),
    "games": (
        ("orders",),
        """select o_orderkey as id, cast(o_orderdate as date) as date,
        cast(year(o_orderdate) - case when month(o_orderdate) < 7 then 1 else 0 end as int) as season,
        cast(o_orderkey % 25 as bigint) as home_team_id,
        cast((o_orderkey % 25 + 1 + o_custkey % 24) % 25 as bigint) as away_team_id,
        cast(85 + (o_orderkey * 31 + o_custkey * 17) % 51
          + case when (o_orderkey * 31 + o_custkey * 17) % 51 = (o_orderkey * 13 + o_custkey * 37) % 51 then 1 else 0 end as int) as home_score,
        cast(85 + (o_orderkey * 13 + o_custkey * 37) % 51 as int) as away_score from orders""",
    ),
    "game_stats": (
        ("games",),
        """select game_id, team_id, home_team_id, away_team_id, date, season, is_home, pts, pts_against,
        cast(70 + h % 31 as int) as fga, cast(28 + h % 21 as int) as fgm, cast(20 + h % 17 as int) as fg3a,
        cast(6 + h % 13 as int) as fg3m, cast(10 + h % 19 as int) as fta, cast(6 + h % 5 as int) as ftm,
        cast(5 + h % 11 as int) as oreb, cast(25 + h % 16 as int) as dreb, cast(9 + h % 12 as int) as tov,
        cast(15 + h % 17 as int) as ast, cast(4 + h % 9 as int) as stl, cast(2 + h % 7 as int) as blk,
        cast(pts - pts_against as double) as plus_minus,
        case when h % 29 = 0 then null else cast(6 + h % 13 as double) / cast(20 + h % 17 as double) end as fg3_pct
        from (select id as game_id, home_team_id as team_id, home_team_id, away_team_id, date, season, true as is_home,
          home_score as pts, away_score as pts_against, (id * 7919 + home_team_id * 104729) % 1000003 as h from games
          union all select id, away_team_id, home_team_id, away_team_id, date, season, false, away_score, home_score,
          (id * 7919 + away_team_id * 104729) % 1000003 from games) t""",
    ),
    "odds_snapshots": (
        ("events",),
        """select event_id as id, cast(date_trunc('week', ts) as date) as game_date, cast(user_id % 25 as bigint) as home_team_id,
        cast((user_id % 25 + 7) % 25 as bigint) as away_team_id,
        case when event_id % 2 = 0 then 'polymarket' else 'espn' end as source, ts as timestamp,
        case when event_type = 'error' then null else 0.05e0 + 0.9e0 * value / 500e0 end as home_prob,
        case when event_id % 2 = 1 then cast(event_id % 41 - 20 as double) * 0.5e0 end as spread,
        case when event_id % 2 = 1 then 200e0 + cast(event_id % 60 as double) * 0.5e0 end as over_under from events""",
    ),
    "historical_injuries": (
        ("customer",),
        """select cast(date '1995-01-01' as date) as snapshot_date, c_custkey as player_id, c_name as player_name,
        concat('T', lpad(cast(c_nationkey as string), 2, '0')) as team_abbr, cast(c_nationkey as bigint) as team_id,
        case c_custkey % 6 when 0 then 'Out' when 1 then 'Doubtful' when 2 then 'Day-to-Day' when 3 then 'Questionable'
          when 4 then 'Probable' else 'GTD' end as status,
        cast(c_custkey % 11 as double) as impact_rating from customer""",
    ),
    "predictions": (
        ("games",),
        """select id, date, home_team_id, away_team_id, home_score > away_score as home_won,
        cast(5 + (id * 37) % 91 as double) / 100e0 as model_home_prob,
        cast(10 + (id * 53) % 81 as double) / 100e0 as market_home_prob,
        cast(10 + (id * 59) % 81 as double) / 100e0 as closing_market_prob,
        case id % 3 when 0 then 'HOME' when 1 then 'AWAY' else 'NO BET' end as bet_side,
        case when id % 3 = 2 then 0e0 else cast(1 + id % 50 as double) end as bet_size from games""",
    ),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS over the tables of a folder, or such a table itself."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needs, text = VIEWS[name]
    for n in needs:
        text = text.replace(f"from {n}", "from {" + n + "}")
    return spark.sql(text, **{n: view(spark, sf_dir, n) for n in needs})


def ctes(*names: str) -> str:
    """The views, with what they need, as a WITH clause."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in order:
            for n in VIEWS[name][0]:
                add(n)
            order.append(name)

    for n in names:
        add(n)
    return "with " + ",\n".join(f"{n} as ({VIEWS[n][1]})" for n in order)
