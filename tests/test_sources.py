"""Paged sources and mergeable sketches."""

import json

import pytest
from pyspark.sql import functions as F

from matchgrid.operators import sketches as sk
from matchgrid.sources import markets, paged


def land(folder, counts, size=5, skip=()):
    folder.mkdir()
    for k, n in enumerate(counts):
        if k not in skip:
            events = [{"title": f"A{k} vs. B{i}", "slug": f"s-{k}-{i}", "markets": [{"question": "q", "outcomes": "[]", "outcomePrices": "[]", "closed": False}], "more": {"x": [1]}} for i in range(n)]
            (folder / f"{k * size}.json").write_text(json.dumps(events))
    return str(folder)


@pytest.mark.parametrize(("counts", "skip", "pages"), [([5] * 9 + [2], (), 10), ([5] * 10 + [0], (), 10), ([5, 5, 3, 5], (), 3), ([5, 0, 5], (), 1), ([5, 5, 5, 5], (2,), 2), ([], (), 0), ([5] * 4, (), 4)])
def test_landed_pages(spark, tmp_path, counts, skip, pages):
    path = land(tmp_path / "pages", counts, skip=skip)
    got = paged.read_paged(spark, path, size=5, pages_per_partition=3)
    want = [(5 * k, i, f"s-{k}-{i}") for k, n in enumerate(counts[:pages]) for i in range(n)]
    assert sorted((r["offset"], r["place"], r["slug"]) for r in got.collect()) == want
    if counts and pages == len([n for n in counts if n]) and not skip:
        whole = markets.read_pages(spark, path)
        assert sorted(map(tuple, got.drop("offset", "place").collect())) == sorted(map(tuple, whole.collect()))
    if len(counts) > 9:
        spark.dataSource.register(paged.LandedPages)
        raw = spark.read.format("landed_pages").options(path=path, size=5, pages_per_partition=3).load()
        assert raw.select(F.spark_partition_id()).distinct().count() == 4


def test_sketches_merge_within_their_bounds(spark):
    rows = spark.range(60_000).select(F.expr("date_add(date '2024-01-01', cast(id % 30 as int))").alias("day"), (F.col("id") % 7001).alias("user"), F.when(F.col("id") % 10 > 0, F.pow(F.col("id") * 7919 % 60_000, F.lit(1.5))).alias("x"))
    days = sk.daily_sketches(rows, "day", {"users": F.col("user")}, {"x": F.col("x")})
    assert days.count() == 30
    got = sk.merged(days).first()
    assert got["n"] == 60_000 and got["users"] == pytest.approx(7001, rel=3 * 1.04 / 64)
    known = sorted(r["x"] for r in rows.where("x is not null").collect())
    for s in (5, 25, 50, 75, 95):
        rank = sum(v <= got[f"x_{s}"] for v in known) / len(known)
        assert abs(rank - s / 100) < 0.01
    some = sk.merged(days.withColumn("even", F.dayofmonth("day") % 2 == 0), ["even"]).collect()
    assert sorted(r["n"] for r in some) == [30_000, 30_000]
    assert sk.merged(sk.daily_sketches(rows.withColumn("x", F.lit(None).cast("double")), "day", {}, {"x": F.col("x")})).first()["x_50"] is None
