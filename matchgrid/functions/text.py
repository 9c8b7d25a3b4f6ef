"""Names, titles, dates and loosely typed fields."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

# Nicknames, the longer of two that overlap first, and their abbreviations.
NICKNAMES = [
    ("timberwolves", "MIN"), ("trail blazers", "POR"), ("cavaliers", "CLE"), ("mavericks", "DAL"), ("grizzlies", "MEM"),
    ("warriors", "GSW"), ("clippers", "LAC"), ("pelicans", "NOP"), ("hornets", "CHA"), ("celtics", "BOS"),
    ("rockets", "HOU"), ("nuggets", "DEN"), ("pistons", "DET"), ("pacers", "IND"), ("lakers", "LAL"),
    ("knicks", "NYK"), ("thunder", "OKC"), ("raptors", "TOR"), ("blazers", "POR"), ("wizards", "WAS"),
    ("sixers", "PHI"), ("wolves", "MIN"), ("magic", "ORL"), ("bucks", "MIL"), ("bulls", "CHI"),
    ("hawks", "ATL"), ("kings", "SAC"), ("spurs", "SAS"), ("heat", "MIA"), ("suns", "PHX"),
    ("nets", "BKN"), ("cavs", "CLE"), ("mavs", "DAL"), ("jazz", "UTA"), ("76ers", "PHI"),
]

# Abbreviations of one feed that differ from the other's.
FEED_ABBREVIATIONS = {"GS": "GSW", "NO": "NOP", "NY": "NYK", "SA": "SAS", "UTAH": "UTA", "WSH": "WAS"}

# Labels of statistics, and of features that aren't named by a rule.
STAT_LABELS = {
    "pts": "scoring", "pts_against": "opponent scoring", "net_rtg_game": "net rating", "fg_pct": "field-goal %", "fg3_pct": "3-point %",
    "oreb": "offensive rebounds", "dreb": "defensive rebounds", "ast": "assists", "tov": "turnovers", "plus_minus": "plus/minus",
    "efg_pct": "effective FG %", "tov_pct": "turnover rate", "orb_pct": "offensive rebound rate", "ft_rate": "FT rate", "pyth": "Pythagorean win%",
}
FEATURE_LABELS = {
    "elo_diff": "Elo differential", "elo_home_prob": "Elo win probability", "home_elo": "home Elo", "away_elo": "away Elo", "rest_diff": "rest-day differential",
    "home_injury_impact_out": "home injury impact (out/doubtful)", "away_injury_impact_out": "away injury impact (out/doubtful)", "injury_impact_diff": "injury impact differential",
    "home_missing_minutes_pct": "home missing minutes %", "away_missing_minutes_pct": "away missing minutes %", "home_star_out": "home star player out", "away_star_out": "away star player out",
    "diff_missing_minutes_pct": "missing-minutes differential", "diff_available_talent": "available-talent differential",
    "spread_movement": "spread line movement", "prob_movement": "implied-prob line movement", "odds_disagreement": "Polymarket vs ESPN odds disagreement",
    "diff_plus_minus_venue_roll_10": "10-game venue-split +/- differential", "diff_plus_minus_venue_roll_20": "20-game venue-split +/- differential",
    "diff_net_rtg_game_venue_roll_10": "10-game venue-split net rating differential", "diff_net_rtg_game_venue_roll_20": "20-game venue-split net rating differential",
    "diff_fg3_pct_b2b_roll_5": "5-game back-to-back 3PT% differential", "diff_fg3_pct_b2b_roll_10": "10-game back-to-back 3PT% differential",
}

# Words in titles of events that aren't single games.
NOT_GAMES = ["champion", "mvp", "rookie", "playoffs", "division", "record", "season", "draft", "will ", "retire", "over or under"]


def bound(x: Column, f) -> Column:
    """f(x), with x computed once however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def nickname_abbreviation(name: Column) -> Column:
    """The abbreviation of a name: an exact nickname, else the first nickname in it, else null."""
    table = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(a).alias("a")) for n, a in NICKNAMES))
    exact = lambda own: F.get(F.filter(table, lambda x: x["n"] == own), F.lit(0))["a"]
    inside = lambda own: F.get(F.filter(table, lambda x: F.contains(own, x["n"])), F.lit(0))["a"]
    return bound(F.lower(F.btrim(name)), lambda own: F.coalesce(exact(own), inside(own)))


def nickname_among(text: Column, *teams: Column) -> Column:
    """The abbreviation of the first nickname in a lower-cased text that is one of these teams; null if none is."""
    table = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(a).alias("a")) for n, a in NICKNAMES))
    return F.get(F.filter(table, lambda x: F.contains(text, x["n"]) & x["a"].isin(*teams)), F.lit(0))["a"]


def title_teams(title: Column) -> Column:
    """Struct (first, second) of the two teams of a title such as "A vs. B"; null if they can't be told apart."""
    parts = F.split(title, r"\s+vs\.?\s+", 2)
    first, second = nickname_abbreviation(F.get(parts, F.lit(0))), nickname_abbreviation(F.get(parts, F.lit(1)))
    return F.when((F.size(parts) == 2) & first.isNotNull() & second.isNotNull() & (first != second), F.struct(first.alias("first"), second.alias("second")))


def is_game_title(title: Column) -> Column:
    own = F.lower(title)
    return F.contains(own, F.lit("vs")) & ~own.rlike("|".join(NOT_GAMES))


def slug_date(slug: Column) -> Column:
    return F.nullif(F.regexp_extract(slug, r"(\d{4}-\d{2}-\d{2})$", 1), F.lit(""))


def eastern_date(utc: Column) -> Column:
    """Calendar date in the league's zone of an ISO time; one without an offset is UTC; null if it can't be read."""
    return F.date_format(F.from_utc_timestamp(F.try_to_timestamp(utc), "America/New_York"), "yyyy-MM-dd")


def naive_utc(text: Column) -> Column:
    """An ISO time with Z, an offset or neither, as UTC without a zone."""
    return F.try_to_timestamp(text).cast("timestamp_ntz")


def date_prefix(text: Column) -> Column:
    """The date that a text begins with; null if it has none."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(text, 1, 10)))


def compact_date(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd")


def feature_label(name: Column) -> Column:
    """What to call a feature in a sentence: a label of its own, else by its parts, else its name with spaces."""
    table = lambda values: F.create_map(*map(F.lit, chain.from_iterable(values.items())))
    spaced = F.replace(name, F.lit("_"), F.lit(" "))
    part = lambda n: F.regexp_extract(name, r"^(home|away|diff)_(.*)_roll_(.*?)$", n)
    side, stat, width = (part(n) for n in (1, 2, 3))
    label = F.coalesce(F.try_element_at(table(STAT_LABELS), stat), F.replace(stat, F.lit("_"), F.lit(" ")))
    own = F.concat(width, F.lit("-game "), label)
    return (
        F.coalesce(F.try_element_at(table(FEATURE_LABELS), name),
        F.when(name.rlike("^(home|away)_rest_"), spaced)
        .when(name.isin("home_is_back_to_back", "away_is_back_to_back"), F.concat(F.substring(name, 1, 4), F.lit(" on back-to-back")))
        .when(side == "diff", F.concat(own, F.lit(" differential")))
        .when(side != "", F.concat(side, F.lit(" "), own))
        .otherwise(spaced))
    )


def feed_abbreviation(abbr: Column) -> Column:
    table = F.create_map(*map(F.lit, chain.from_iterable(FEED_ABBREVIATIONS.items())))
    return F.coalesce(F.try_element_at(table, abbr), abbr)


def number(text: Column) -> Column:
    return text.cast("string").try_cast("double")


def json_list(text: Column) -> Column:
    """A JSON array of strings in a string field."""
    return F.from_json(text, "array<string>")


def outcome_prices(outcomes: Column, prices: Column) -> Column:
    """Array of (name, price) from two JSON arrays in string fields; prices that can't be read are left out."""
    both = F.arrays_zip(json_list(outcomes).alias("name"), json_list(prices).alias("price"))
    named = F.transform(both, lambda x: F.struct(x["name"].alias("name"), x["price"].try_cast("double").alias("price")))
    return F.filter(named, lambda x: x["price"].isNotNull())


def compact_json(row: Column) -> Column:
    return F.to_json(row, {"ignoreNullFields": "false"})
