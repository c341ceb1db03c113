"""The band join: pairs of events whose times differ by no more than a window.

Spark plans a join on a range of times as a nested loop.  Here the time axis is dealt to buckets
at least as wide as the reach; the left side has one bucket, the right side stands in each bucket
that its reach touches, and an equi-join on bucket (and any further keys) with the exact
condition beside it finds each pair once.  Buckets spread a busy unit over the cluster.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from eventloom.functions.stats import window_weight


def band_join(
    left: DataFrame,
    right: DataFrame,
    left_time: str,
    right_time: str,
    reach: int,
    on: Sequence[tuple[str, str]] = (),
    width: int | None = None,
) -> DataFrame:
    """All pairs with |left_time - right_time| <= reach and equal keys; column names must differ.

    reach: whole samples; further conditions (shifts within it, half-open ranges) are for the caller.
    """
    reach = max(0, int(math.ceil(reach)))
    width = width or 8 * reach + 16
    bucket = lambda c: F.floor(c / F.lit(width)).cast("bigint")
    a = left.withColumn("_bucket", bucket(F.col(left_time)))
    touched = F.sequence(bucket(F.col(right_time) - reach), bucket(F.col(right_time) + reach))
    b = right.withColumn("_bucket_r", F.explode(touched))
    condition = a["_bucket"] == b["_bucket_r"]
    for x, y in on:
        condition = condition & (a[x] == b[y])
    near = F.abs(F.col(left_time) - F.col(right_time)) <= reach
    return a.join(b, condition & near).drop("_bucket", "_bucket_r")


def _side(spikes: DataFrame, k: int, order: DataFrame | None = None) -> DataFrame:
    """Events of one side with equal ones counted: s, u, t, m."""
    return spikes.groupBy(F.col("sorting").alias(f"s{k}"), F.col("unit_id").alias(f"u{k}"), F.col("sample_index").alias(f"t{k}")).agg(F.count(F.lit(1)).alias(f"m{k}"))


def cross_pairs(spikes: DataFrame, reach: int, shifts: DataFrame | None = None, same: bool = False, both_ways: bool = False) -> DataFrame:
    """s1, u1, t1, s2, u2, t2, n, d over pairs of units, d = t1 - t2 - shift, |d| <= reach.

    Units of different sortings with s1 < s2; with ``same``, of one sorting (u1 <= u2, or all with
    ``both_ways``).  n: how many events the row stands for.  shifts: (s1, u1, s2, u2, shift); pairs
    that it lacks have shift 0.
    """
    a, b = _side(spikes, 1), _side(spikes, 2)
    most = 0
    if shifts is not None:
        most = shifts.agg(F.max(F.abs("shift"))).first()[0] or 0
    pairs = band_join(a, b, "t1", "t2", reach + most, on=[("s1", "s2")] if same else [])
    if same:
        pairs = pairs if both_ways else pairs.where("u1 <= u2")
    else:
        pairs = pairs.where("s1 < s2")
    if shifts is not None:
        pairs = pairs.join(shifts.select("s1", "u1", "s2", "u2", "shift"), ["s1", "u1", "s2", "u2"], "left").fillna({"shift": 0})
    else:
        pairs = pairs.withColumn("shift", F.lit(0))
    d = F.col("t1") - F.col("t2") - F.col("shift")
    return pairs.withColumn("d", d).withColumn("n", F.col("m1") * F.col("m2")).where(F.abs("d") <= reach)


PAIR = ("s1", "u1", "s2", "u2")


def events_of_pairs(spikes: DataFrame, wanted: DataFrame, reach: int) -> DataFrame:
    """wanted's columns, t1, t2, m1, m2, d = t1 - t2 - shift and n over the wanted pairs of units alone, |d| <= reach.

    wanted: (s1, u1, s2, u2, shift, ...), of the size of a graph, so that only its pairs' events meet.  A pair
    may be wanted with several shifts.
    """
    one = _side(spikes, 1).join(wanted, ["s1", "u1"]).withColumn("_at", F.col("t1") - F.col("shift"))
    two = _side(spikes, 2).withColumnsRenamed({"s2": "_s2", "u2": "_u2"})
    pairs = band_join(one, two, "_at", "t2", reach, on=[("s2", "_s2"), ("u2", "_u2")])
    d = F.col("_at") - F.col("t2")
    return pairs.withColumn("d", d).withColumn("n", F.col("m1") * F.col("m2")).drop("_at", "_s2", "_u2")


def weighted_coincidences_of(spikes: DataFrame, wanted: DataFrame, windows: Sequence[float]) -> DataFrame:
    """wanted with c0, c1, ...: coincidences of each wanted pair for windows of real length, borders weighted; 0 if it has none."""
    reach = max((math.ceil(w) for w in windows), default=0)
    pairs = events_of_pairs(spikes, wanted.select(*PAIR, "shift").distinct(), reach)
    weight = lambda w: window_weight(F.abs("d"), w) if w > 0 else F.lit(0.0)
    names = [f"c{k}" for k in range(len(windows))]
    found = pairs.groupBy(*PAIR, "shift").agg(*[F.sum(F.col("n") * weight(w)).alias(c) for c, w in zip(names, windows, strict=True)])
    return wanted.join(found, [*PAIR, "shift"], "left").fillna(0.0, names)


#: Up to so many bins, correlograms are counted by stretches of so many samples.
FEW_BINS, LAID_OUT = 64, 4096


def correlogram_by_stretches(spikes: DataFrame, wanted: DataFrame, max_time: int, bin_size: int) -> DataFrame:
    """``correlogram_of`` without meeting events: trains are laid out by stretches of time, and the counts of all pairs of
    units at a lag are one product of the trains and their running sums.

    The work is that of the bins, units squared and samples, however many events there are.  max_time is a multiple of bin_size; wanted is of the size of a
    graph and is sent to the tasks.
    """
    pairs = [tuple(r) for r in wanted.select(*PAIR, "shift").distinct().collect()]
    halo = max_time + max((abs(r[4]) for r in pairs), default=0)
    edges = range(-max_time, max_time + bin_size, bin_size)
    kinds = {f.name: f.dataType.simpleString() for f in wanted.select(*PAIR, "shift").schema.fields}
    schema = ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", bin int, n bigint"

    def count(group: pa.Table) -> pa.Table:
        start = group.column("stretch")[0].as_py() * LAID_OUT
        names = list(zip(group.column("sorting").to_pylist(), group.column("unit_id").to_pylist(), strict=True))
        row = {u: k for k, u in enumerate(dict.fromkeys(names))}
        trains = np.zeros((len(row), LAID_OUT + 2 * halo + 1))
        at = group.column("sample_index").to_numpy() - start + halo + 1
        np.add.at(trains, ([row[u] for u in names], at), group.column("m").to_numpy())
        upto, own = np.cumsum(trains, axis=1), trains[:, halo + 1 : halo + 1 + LAID_OUT]
        found = []
        for shift in {r[4] for r in pairs}:
            first = halo + 1 - shift
            sums = np.stack([own @ upto[:, first - e : first - e + LAID_OUT].T for e in edges])
            # Of running sums up to both ends of a bin, the difference is what lies in it.
            n = np.rint(sums[:-1] - sums[1:]).astype(np.int64)
            for s1, u1, s2, u2, _ in (r for r in pairs if r[4] == shift):
                if (s1, u1) not in row or (s2, u2) not in row:
                    continue
                counts = n[:, row[s1, u1], row[s2, u2]].copy()
                if (s1, u1) == (s2, u2) and -max_time <= -shift < max_time:
                    counts[(-shift + max_time) // bin_size] -= int(own[row[s1, u1]].sum())
                found += [(s1, u1, s2, u2, shift, k - max_time // bin_size, int(counts[k])) for k in np.flatnonzero(counts).tolist()]
        return pa.table([list(c) for c in zip(*found, strict=True)] if found else [[]] * 7, names=[*PAIR, "shift", "bin", "n"]).cast(to_arrow_schema(result))

    result = StructType.fromDDL(schema)
    counted = spikes.groupBy("sorting", "unit_id", "sample_index").agg(F.count(F.lit(1)).alias("m"))
    stretch = lambda c: F.floor(c / F.lit(LAID_OUT)).cast("bigint")
    dealt = counted.withColumn("stretch", F.explode(F.sequence(stretch(F.col("sample_index") - halo), stretch(F.col("sample_index") + halo))))
    parts = dealt.select("stretch", "sorting", "unit_id", "sample_index", "m").groupBy("stretch").applyInArrow(count, result)
    return parts.groupBy(*PAIR, "shift", "bin").agg(F.sum("n").cast("bigint").alias("n")).where("n > 0")


def correlogram_of(spikes: DataFrame, wanted: DataFrame, max_time: int, bin_size: int) -> DataFrame:
    """n per wanted pair (s1, u1, s2, u2, shift) and bin = floor(d / bin_size), for -max_time <= d < max_time.

    A unit with itself leaves out each event's pair with itself.  Few bins are counted by stretches, many by meeting events.
    """
    if max_time % bin_size == 0 and 2 * max_time // bin_size <= FEW_BINS:
        return correlogram_by_stretches(spikes, wanted, max_time, bin_size)
    pairs = events_of_pairs(spikes, wanted.select(*PAIR, "shift").distinct(), max_time).where(F.col("d") < max_time)
    own = (F.col("s1") == F.col("s2")) & (F.col("u1") == F.col("u2")) & (F.col("t1") == F.col("t2"))
    n = F.when(own, F.col("m1") * (F.col("m1") - 1)).otherwise(F.col("n"))
    binned = pairs.withColumn("bin", F.floor(F.col("d") / F.lit(bin_size)).cast("int"))
    return binned.groupBy(*PAIR, "shift", "bin").agg(F.sum(n).cast("bigint").alias("n")).where("n > 0")


def coincidences(spikes: DataFrame, window: int, shifts: DataFrame | None = None, same: bool = False) -> DataFrame:
    """n_coinc per pair of units: pairs of events at most window apart after the pair's shift."""
    return cross_pairs(spikes, window, shifts, same).groupBy(*PAIR).agg(F.sum("n").cast("bigint").alias("n_coinc"))


def weighted_coincidences(spikes: DataFrame, windows: Sequence[float], shifts: DataFrame | None = None, same: bool = False) -> DataFrame:
    """c0, c1, ... per pair: coincidences for windows of real length, borders weighted."""
    reach = max((math.ceil(w) for w in windows), default=0)
    pairs = cross_pairs(spikes, reach, shifts, same)
    weight = lambda w: window_weight(F.abs("d"), w) if w > 0 else F.lit(0.0)
    return pairs.groupBy(*PAIR).agg(*[F.sum(F.col("n") * weight(w)).alias(f"c{k}") for k, w in enumerate(windows)])


def violations(spikes: DataFrame, window: float) -> DataFrame:
    """n_violations per unit: unordered pairs of its events closer than the window, borders weighted."""
    a = spikes.groupBy("sorting", "unit_id", F.col("sample_index").alias("t1")).agg(F.count(F.lit(1)).alias("m1"))
    b = a.select(F.col("sorting").alias("s2"), F.col("unit_id").alias("u2"), F.col("t1").alias("t2"), F.col("m1").alias("m2"))
    pairs = band_join(a, b, "t1", "t2", math.ceil(window), on=[("sorting", "s2"), ("unit_id", "u2")]).where("t1 < t2 or (t1 = t2 and m1 > 1)")
    n = F.when(F.col("t1") == F.col("t2"), F.col("m1") * (F.col("m1") - 1) / 2).otherwise(F.col("m1") * F.col("m2"))
    weight = window_weight(F.col("t2") - F.col("t1"), window) if window > 0 else F.lit(0.0)
    found = pairs.groupBy("sorting", "unit_id").agg(F.sum(n * weight).alias("n_violations"))
    return found.withColumn("n_violations", F.col("n_violations").cast("double"))


def correlogram(spikes: DataFrame, max_time: int, bin_size: int, same: bool = False, shifts: DataFrame | None = None) -> DataFrame:
    """n per pair and bin = floor((t1 - t2) / bin_size), for -max_time <= t1 - t2 < max_time.

    With ``same``: pairs of units of one sorting in both directions; a unit with itself leaves out each
    event's pair with itself.
    """
    pairs = cross_pairs(spikes, max_time, shifts, same, both_ways=same).where(F.col("d") < max_time)
    n = F.col("n")
    if same:
        own = (F.col("u1") == F.col("u2")) & (F.col("d") == 0)
        n = F.when(own, F.col("m1") * (F.col("m1") - 1)).otherwise(n)
    binned = pairs.withColumn("bin", F.floor(F.col("d") / F.lit(bin_size)).cast("int"))
    out = binned.groupBy(*PAIR, "bin").agg(F.sum(n).cast("bigint").alias("n"))
    return out.where("n > 0")


def antisymmetric(shifts: DataFrame) -> DataFrame:
    """The shifts in both directions."""
    back: list[Column] = [F.col("s2").alias("s1"), F.col("u2").alias("u1"), F.col("s1").alias("s2"), F.col("u1").alias("u2"), (-F.col("shift")).alias("shift")]
    return shifts.select(*PAIR, "shift").union(shifts.select(*back))
