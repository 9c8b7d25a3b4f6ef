"""Sketches of days that merge: distinct counts and quantiles of any span without reading its rows again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Of distinct counts: 2 ** LG_K registers, a standard error of 1.04 / 2 ** (LG_K / 2). Of quantiles: K values a level, ranks within about 0.5 %.
LG_K, K = 12, 800


def daily_sketches(rows: DataFrame, day: str, distinct: dict[str, Column], values: dict[str, Column]) -> DataFrame:
    """A row for each day: rows (n), and for each name a sketch of its distinct values or of its values; nulls don't count."""
    return rows.groupBy(day).agg(
        F.count("*").alias("n"),
        *(F.hll_sketch_agg(c.cast("string"), LG_K).alias(f"distinct_{k}") for k, c in distinct.items()),
        *(F.kll_sketch_agg_double(c.cast("double"), K).alias(f"values_{k}") for k, c in values.items()),
    )


def merged(days: DataFrame, by: list[str] | None = None, shares: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Sketches of days (or of a grouping of them) as numbers: n, the distinct counts, and for each share a quantile: {name}_{percent}."""
    kinds = {p: [c.removeprefix(p) for c in days.columns if c.startswith(p)] for p in ("distinct_", "values_")}
    held = days.groupBy(*(by or [])).agg(F.sum("n").alias("n"), *(F.hll_union_agg(f"distinct_{k}").alias(f"_d_{k}") for k in kinds["distinct_"]), *(F.kll_merge_agg_double(f"values_{k}").alias(f"_v_{k}") for k in kinds["values_"]))
    quantile = lambda k, s: F.when(F.kll_sketch_get_n_double(f"_v_{k}") > 0, F.kll_sketch_get_quantile_double(F.col(f"_v_{k}"), F.lit(s)))
    return held.select(*(by or []), "n", *(F.hll_sketch_estimate(f"_d_{k}").alias(k) for k in kinds["distinct_"]), *(quantile(k, s).alias(f"{k}_{100 * s:g}") for k in kinds["values_"] for s in shares))
