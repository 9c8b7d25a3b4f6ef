"""Nested documents laid flat."""

import json

from matchgrid.sources import documents as doc


def docs(spark, schema, *contents):
    return doc.parsed(spark.createDataFrame([(i, c if isinstance(c, str) else json.dumps(c)) for i, c in enumerate(contents)], "id long, body string"), "body", schema)


def test_injuries(spark):
    teams = spark.createDataFrame([(1, "Hawks", "ATL"), (2, "Celtics", "BOS")], "feed_id long, name string, abbreviation string")
    person = lambda name, **more: {"athlete": {"displayName": name, "id": 7}, **more}
    first = {"injuries": [{"id": "1", "injuries": [person("A", status="Out", longComment="long", shortComment="short", date="2026-01-01"), person("B", shortComment="short")]}, {"displayName": "Celtics", "injuries": [{}]}]}
    second = {"injuries": [{"id": "x", "displayName": "Nobody", "injuries": [person("C")]}, {"id": "2", "injuries": []}, {"id": "2"}]}
    got = sorted(tuple(r) for r in doc.flat_injuries(docs(spark, doc.INJURIES, first, second, "{broken", {}), teams).collect())
    assert got == [("", "", "BOS", "Unknown", "", ""), ("A", "7", "ATL", "Out", "long", "2026-01-01"), ("B", "7", "ATL", "Unknown", "short", ""), ("C", "7", "", "Unknown", "", "")]


def test_rosters(spark):
    one = {"athletes": [{"displayName": "A", "id": "5", "position": {"abbreviation": "PG"}, "jersey": "0", "height": 78.0, "weight": 210, "age": 25, "experience": {"years": 3}, "contract": {"salary": 1e6}, "status": {"name": "Injured"}}, {}]}
    got = sorted(tuple(r) for r in doc.flat_roster(docs(spark, doc.ROSTER, one, {}, {"athletes": []}), ["id"]).collect())
    assert got == [(0, "", "", "", "", 0.0, 0.0, 0, 0, 0.0, "Active"), (0, "A", "5", "PG", "0", 78.0, 210.0, 25, 3, 1e6, "Injured")]


def test_summaries(spark):
    full = {
        "pickcenter": [{"provider": {"name": "book"}, "spread": -4.5, "overUnder": 221.5, "homeTeamOdds": {"moneyLine": -180}, "awayTeamOdds": {"moneyLine": 150}}, {"provider": {"name": "other"}}],
        "againstTheSpread": [{"team": {"abbreviation": "BOS"}, "records": [{"type": "total", "summary": "10-5-1"}]}, {"team": {"abbreviation": "LAL"}, "records": []}],
        "header": {"competitions": [{"series": [{"summary": "old"}]}, {"series": [{"type": "season", "summary": "BOS leads 2-1"}]}, {}]},
    }
    got = [tuple(r) for r in doc.flat_summary(docs(spark, doc.SUMMARY, full, {}, "no json"), ["id"]).orderBy("id").collect()]
    assert got == [(0, 2, "book", -4.5, 221.5, -180.0, 150.0, "10-5-1", None, "BOS leads 2-1"), (1, 0, *[None] * 8), (2, 0, *[None] * 8)]
