"""Next-kept pointers against the fold."""

import datetime as dt

import numpy as np
import pytest

from matchgrid.operators import moves
from matchgrid.operators.odds import GAME

ODDS = "id long, game_date date, home_team_id long, away_team_id long, source string, timestamp timestamp, home_prob double, spread double, over_under double"


def fold(rows):
    last, kept = {}, []
    near = lambda a, b, t: abs(a - b) <= t if a is not None and b is not None else a is b
    for r in sorted(rows, key=lambda r: (r[5], r[0])):
        key = r[1:5]
        if key in last:
            p = last[key]
            if r[5] - p[5] <= dt.timedelta(hours=4) and near(p[6], r[6], 0.005) and near(p[7], r[7], 0.5) and near(p[8], r[8], 0.5):
                continue
        last[key] = r
        kept.append(r[0])
    return sorted(kept)


@pytest.mark.parametrize(("block", "step", "levels"), [(4096, 60, 4), (7, 60, 4), (5, 1, 1), (5, 1, 2), (3, 200, 2), (8, 5, 9)])
def test_pointers_keep_what_the_fold_keeps(spark, monkeypatch, block, step, levels):
    monkeypatch.setattr(moves, "BLOCK", block)
    r, t0 = np.random.default_rng(block * 100 + step + levels), dt.datetime(2026, 4, 22)
    pick = lambda base, width: None if r.random() < 0.05 else float(base + width * r.integers(0, levels))
    rows = []
    for i in range(700):
        hot = i % 10 < 8  # most snapshots are of one game
        game = (1, 2) if hot else (int(r.integers(3, 6)), 9)
        at = t0 + dt.timedelta(minutes=int(r.integers(0, 700)) * step / 10 // 1)
        rows.append((i, t0.date(), *game, "espn" if hot or i % 3 else "polymarket", at, pick(0.5, 0.004), pick(1.0, 0.4) if levels > 1 else 1.0, None))
    got = moves.moved_snapshots(spark.createDataFrame(rows, ODDS).repartition(3), GAME)
    assert sorted(x["id"] for x in got.collect()) == fold(rows)
    assert got.columns == [*GAME, "source", "timestamp", "id", "home_prob", "spread", "over_under"]


def test_no_snapshots(spark):
    assert moves.moved_snapshots(spark.createDataFrame([], ODDS), GAME).count() == 0
