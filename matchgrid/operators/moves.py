"""The tolerance filter over snapshots, by next-kept pointers.

Whether a snapshot is kept depends on the last one kept. But which later snapshot is the
first that isn't a repeat of a given one depends on the two alone, so a game's snapshots
are cut into blocks and the pointers within blocks found side by side: each snapshot
leads to the block's last one that its chain keeps, its exit. Few snapshots are exits;
bounds of blocks tell in which block an exit's chain goes on, and a join finds where. Only
the walk over blocks, with a step for each, is one after the other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import config
from ..scratch import written

#: Snapshots of a game in a block.
BLOCK = 4096
VALUES = ("home_prob", "spread", "over_under")
WITHIN = config.DEDUP_HOURS * 3_600_000_000  # microseconds
TOLERANCES = (config.DEDUP_PROB, config.DEDUP_POINTS, config.DEDUP_POINTS)


def _repeats(at_a, a, at_b, b):
    """Whether snapshots b, later ones, repeat snapshots a; NaN is no value, which only repeats itself."""
    out = at_b - at_a <= WITHIN
    for x, y, t in zip(a, b, TOLERANCES, strict=True):
        out = out & ((np.abs(x - y) <= t) | (np.isnan(x) & np.isnan(y)))
    return out


def pointers(at: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each snapshot of a block the next that isn't a repeat of it (their number if none is), and its exit."""
    n = len(at)
    following, open_ = np.full(n, n), np.arange(n - 1)
    for step in range(1, n):
        open_ = open_[open_ + step < n]
        if not len(open_):
            break
        far = open_ + step
        moved = ~_repeats(at[open_], [v[open_] for v in values], at[far], [v[far] for v in values])
        following[open_[moved]] = far[moved]
        open_ = open_[~moved]
    exits = np.where(following < n, following, np.arange(n))
    while not np.array_equal(exits, again := exits[exits]):
        exits = again
    return following, exits


def _placed(rows: DataFrame, key: list[str]) -> DataFrame:
    """Adds _pos, the number of a snapshot within its key by (timestamp, id); the ordered pass has a row for each hour."""
    hour = F.date_trunc("hour", "timestamp")
    hours = rows.groupBy(*key, hour.alias("_hour")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*key).orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hours = hours.select(*(F.col(c).alias(f"_k_{c}") for c in key), F.col("_hour").alias("_k_hour"), before.alias("_before"))
    on = F.col("_hour").eqNullSafe(F.col("_k_hour"))
    for c in key:
        on = on & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    own = rows.withColumn("_hour", hour).join(hours, on)
    rank = F.row_number().over(Window.partitionBy(*key, "_hour").orderBy("timestamp", "id"))
    return own.withColumn("_pos", F.col("_before") + rank - 1).select(*rows.columns, "_pos")


_PACKED = "block long, at array<long>, timestamp array<{}>, id array<long>, " + ", ".join(f"{v} array<double>" for v in VALUES) + ", first_exit int, exits array<int>"


def _packed(rows: DataFrame, key: list[str]) -> DataFrame:
    """A row for each block: its snapshots in order, the exit of its first, and all exits."""
    stamp = dict(rows.dtypes)["timestamp"]
    at = F.unix_micros("timestamp") if stamp == "timestamp" else F.expr("timestampdiff(microsecond, timestamp_ntz'1970-01-01 00:00:00', timestamp)")
    own = rows.select(F.struct(*key).alias("key"), F.expr(f"_pos div {BLOCK}").alias("block"), F.struct("_pos", at.alias("at"), "timestamp", "id", *(F.col(v).cast("double").alias(v) for v in VALUES)).alias("s"))
    blocks = own.groupBy("key", "block").agg(F.sort_array(F.collect_list("s")).alias("s"))  # at most BLOCK snapshots
    blocks = blocks.select("key", "block", *(F.col(f"s.{c}").alias(c) for c in ("at", "timestamp", "id", *VALUES)))

    def exits(batches):
        for batch in batches:
            first, every = [], []
            for at, values in _blocks(batch):
                own = pointers(at, values)[1]
                first.append(int(own[0]))
                every.append(np.unique(own).tolist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first, pa.int32()), pa.array(every, pa.list_(pa.int32()))], [*batch.schema.names, "first_exit", "exits"])

    return blocks.mapInArrow(exits, f"key {rows.select(F.struct(*key)).schema[0].dataType.simpleString()}, {_PACKED.format(stamp)}")


def _blocks(batch: pa.RecordBatch):
    for r in range(len(batch)):
        of = lambda c: batch.column(c)[r].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
        yield of("at"), [of(v).astype(float) for v in VALUES]


def _targets(group: pd.DataFrame) -> pd.DataFrame:
    """For each exit of a game the first later block that isn't all repeats of it, by the blocks' bounds."""
    blocks, exits = group[group["exit"] < 0].sort_values("block"), group[group["exit"] >= 0]
    number, out = blocks["block"].to_numpy(), []
    last = blocks["last"].to_numpy()
    low, high, nulls, size = (np.stack([blocks[f"{p}{i}"].to_numpy(float) for i in range(3)]) for p in ("low", "high", "nulls", "size"))
    for e in exits.itertuples(index=False):
        start = int(np.searchsorted(number, e.block, side="right"))
        step = 64
        for lo in range(start, len(number), step):
            part = slice(lo, lo + step)
            same = last[part] - e.at <= WITHIN
            for i, t in enumerate(TOLERANCES):
                x = getattr(e, f"x{i}")
                same &= (nulls[i, part] == size[i, part]) if x is None or np.isnan(x) else (nulls[i, part] == 0) & (np.abs(high[i, part] - x) <= t) & (np.abs(low[i, part] - x) <= t)
            if not same.all():
                out.append((e.key, e.block, e.exit, int(number[part][np.argmin(same)]), e.at, e.x0, e.x1, e.x2))
                break
    return pd.DataFrame(out, columns=["key", "block", "exit", "target", "at", "x0", "x1", "x2"])


def _walk(group: pd.DataFrame) -> pd.DataFrame:
    """The blocks that a game's chain visits, and where it enters them."""
    steps = {(r.block, r.exit): (r.target, r.entry, r.leaves) for r in group.itertuples(index=False) if r.exit >= 0}
    begin = group[group["exit"] < 0].iloc[0]
    block, out = (0, int(begin["leaves"])), [(begin["key"], 0, 0)]
    while block in steps:
        target, entry, leaves = steps[block]
        out.append((begin["key"], target, entry))
        block = (target, leaves)
    return pd.DataFrame(out, columns=["key", "block", "entry"])


def moved_snapshots(odds: DataFrame, game: list[str]) -> DataFrame:
    """Snapshots that aren't repeats of the last one kept of the same game and source, in the order (timestamp, id).

    A repeat comes within DEDUP_HOURS of it and has all three lines within the
    tolerances; a missing line only repeats a missing one.
    """
    key = [*game, "source"]
    rows = odds.select(*key, "timestamp", "id", *VALUES)
    packed = written(_packed(_placed(rows, key), key), "snapshots")
    kind = packed.select("key").schema[0].dataType.simpleString()
    several = packed.where("block = 1").select("key")
    long = packed.join(several, "key", "left_semi") if not several.isEmpty() else None
    entries = packed.select("key", "block", F.when(F.col("block") == 0, 0).alias("entry"))
    if long is not None:
        bounds = [c.alias(f"{n}{i}") for i, v in enumerate(VALUES) for n, c in (("low", F.array_min(v)), ("high", F.array_max(v)), ("nulls", F.size(F.filter(v, lambda x: x.isNull())).cast("double")), ("size", F.size(v).cast("double")))]
        none = lambda *names: [F.lit(None).cast("double").alias(n) for n in names]
        summary = long.select("key", "block", F.lit(-1).alias("exit"), F.lit(0).cast("long").alias("at"), *none("x0", "x1", "x2"), F.array_max("at").alias("last"), *bounds)
        exits = long.select("key", "block", F.explode("exits").alias("exit"), "at", *VALUES)
        exits = exits.select("key", "block", "exit", F.get("at", "exit").alias("at"), *(F.get(v, "exit").alias(f"x{i}") for i, v in enumerate(VALUES)))
        both = summary.unionByName(exits, allowMissingColumns=True)
        targets = both.groupBy("key").applyInPandas(_targets, f"key {kind}, block long, exit int, target long, at long, x0 double, x1 double, x2 double")
        meet = targets.select("key", "block", "exit", "target", F.col("at").alias("e_at"), "x0", "x1", "x2").join(long.withColumnRenamed("block", "target").drop("exits", "first_exit"), ["key", "target"])

        def enter(batches):
            for batch in batches:
                entry, leaves = [], []
                e = [batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x0", "x1", "x2")]
                e_at = batch.column("e_at").to_numpy(zero_copy_only=False)
                for r, (at, values) in enumerate(_blocks(batch)):
                    first = int(np.argmin(_repeats(e_at[r], [x[r] for x in e], at, values)))
                    entry.append(first)
                    leaves.append(int(pointers(at, values)[1][first]))
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("block"), batch.column("exit"), batch.column("target"), pa.array(entry, pa.int32()), pa.array(leaves, pa.int32())], ["key", "block", "exit", "target", "entry", "leaves"])

        steps = meet.mapInArrow(enter, f"key {kind}, block long, exit int, target long, entry int, leaves int")
        begin = long.where("block = 0").select("key", "block", F.lit(-1).alias("exit"), F.lit(0).cast("long").alias("target"), F.lit(0).alias("entry"), F.col("first_exit").alias("leaves"))
        visited = steps.unionByName(begin).groupBy("key").applyInPandas(_walk, f"key {kind}, block long, entry int")
        short = packed.join(several, "key", "left_anti").select("key", "block", F.lit(0).alias("entry"))
        entries = short.unionByName(visited)

    def kept(batches):
        for batch in batches:
            keep = []
            for entry, (at, values) in zip(batch.column("entry").to_pylist(), _blocks(batch), strict=True):
                following, own = pointers(at, values)[0], []
                while entry < len(at):
                    own.append(int(entry))
                    entry = following[entry]
                keep.append(own)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keep, pa.list_(pa.int32()))], [*batch.schema.names, "kept"])

    chosen = packed.drop("exits", "first_exit").join(entries.where("entry is not null"), ["key", "block"])
    out = chosen.mapInArrow(kept, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema) + ", kept array<int>").withColumn("i", F.explode("kept"))
    value: dict[str, Column] = {v: F.get(v, "i") for v in VALUES}
    return out.select(*(F.col(f"key.{c}").alias(c) for c in key), F.get("timestamp", "i").alias("timestamp"), F.get("id", "i").alias("id"), *(value[v].alias(v) for v in VALUES))
