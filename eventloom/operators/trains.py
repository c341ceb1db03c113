"""Operators over the ordered events of each unit."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.meta import UNIT
from eventloom.operators.bandjoin import PAIR, correlogram
from eventloom.functions.stats import gaussian_kernel


#: Samples of time that one window partition holds of a train.
STRETCH = 1 << 20


def with_previous(spikes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """_before: the time of the event before in the train of the keys (null for the first), and _stretch.

    Trains are cut into stretches of time, so that a busy unit is spread over all tasks; the last time of the stretches before
    is carried over by a window over the stretches alone.
    """
    t = F.col("sample_index")
    cut = spikes.withColumn("_stretch", F.floor(t / F.lit(STRETCH)).cast("bigint"))
    ends = cut.groupBy(*keys, "_stretch").agg(F.max(t).alias("_end"))
    carried = ends.select(*keys, "_stretch", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_stretch")).alias("_carried"))
    inside = F.lag(t).over(Window.partitionBy(*keys, "_stretch").orderBy(t))
    joined = cut.withColumn("_inside", inside).join(carried, [*keys, "_stretch"], "left")
    return joined.withColumn("_before", F.coalesce("_inside", "_carried")).drop("_inside", "_carried")


def with_runs(spikes: DataFrame, keys: Sequence[str], gap: float) -> DataFrame:
    """_run: the time at which the run of the event begins; a run goes on for as long as events are at most gap apart."""
    t = F.col("sample_index")
    fresh = F.col("_before").isNull() | (t - F.col("_before") > gap)
    marked = with_previous(spikes, keys).withColumn("_start", F.when(fresh, t))
    heads = marked.groupBy(*keys, "_stretch").agg(F.max("_start").alias("_head"))
    earlier = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = heads.select(*keys, "_stretch", F.max("_head").over(earlier).alias("_carried"))
    inside = F.max("_start").over(Window.partitionBy(*keys, "_stretch").orderBy(t))
    joined = marked.withColumn("_inside", inside).join(carried, [*keys, "_stretch"], "left")
    return joined.withColumn("_run", F.coalesce("_inside", "_carried")).drop("_inside", "_carried", "_start", "_stretch", "_before")


def unit_counts(spikes: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """n_spikes of every unit, 0 for units without events."""
    counts = spikes.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("n_spikes"))
    if units is None:
        return counts
    return units.select(*UNIT).join(counts, [*UNIT], "left").fillna({"n_spikes": 0})


def intervals(spikes: DataFrame) -> DataFrame:
    """isi: the time from each event to the one before it in its train; first events have none."""
    found = with_previous(spikes, UNIT).withColumn("isi", F.col("sample_index") - F.col("_before"))
    return found.where("isi is not null").select(*spikes.columns, "isi")


def isi_histogram(spikes: DataFrame, bin_size: int, max_time: int) -> DataFrame:
    """n per unit and bin of the intervals below max_time."""
    bins = intervals(spikes).where(F.col("isi") < max_time).withColumn("bin", F.floor(F.col("isi") / F.lit(bin_size)).cast("int"))
    return bins.groupBy(*UNIT, "bin").agg(F.count(F.lit(1)).alias("n"))


def within_recording(spikes: DataFrame, t_max: int) -> DataFrame:
    return spikes.where((F.col("sample_index") >= 0) & (F.col("sample_index") < t_max))


def shift_units(spikes: DataFrame, shifts: DataFrame, t_max: int) -> DataFrame:
    """Events moved by + shift of their unit (0 if it has none) and kept within the recording."""
    moved = spikes.join(shifts.select(*UNIT, "shift"), [*UNIT], "left")
    moved = moved.withColumn("sample_index", F.col("sample_index") + F.coalesce("shift", F.lit(0))).drop("shift")
    return within_recording(moved, t_max)


def drop_duplicates(spikes: DataFrame, censored: float, method: str = "keep_first_iterative") -> DataFrame:
    """Events without those within ``censored`` samples after an earlier one of their unit.

    keep_first_iterative: after a kept event, all at a distance <= censored go.  An event depends on the last kept
    one, so each run of close events (gaps and islands) is scanned in order, in linear time and with the last kept time as its only
    state: runs are dealt to tasks, and one of any length streams through its task.
    keep_first: all with an interval <= censored go, kept or not before them.
    random: of events in a run that is linked by short intervals, one stays, by a hash of its time.
    """
    if method == "keep_first":
        kept = with_previous(spikes, UNIT).where(F.col("_before").isNull() | (F.col("sample_index") - F.col("_before") > censored))
        return kept.select(*spikes.columns)
    if method not in ("keep_first_iterative", "random"):
        raise ValueError(f"unknown method {method!r}: keep_first, keep_first_iterative or random")
    runs = with_runs(spikes.select(*UNIT, "sample_index"), UNIT, censored)
    if method == "random":
        return runs.groupBy(*UNIT, "_run").agg(F.min_by("sample_index", F.xxhash64("sample_index")).alias("sample_index")).drop("_run")

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, last = None, 0  # the run that the last batch ended in, and its last kept time
        for part in parts:
            if not len(part):
                continue
            names = list(zip(part["sorting"].tolist(), part["unit_id"].tolist(), part["_run"].tolist(), strict=True))
            t = part["sample_index"].to_numpy()
            fresh = np.r_[True, [a != b for a, b in zip(names, names[1:], strict=False)]].astype(bool)
            starts = np.flatnonzero(fresh)
            stops = np.r_[starts[1:], len(t)]
            keep = fresh.copy()
            if names[0] == run:
                at = int(np.searchsorted(t[: stops[0]], last + censored, "right"))
                keep[0] = False
                if at < stops[0]:
                    keep[at], last = True, t[at]
                first = at
            else:
                first, last = 0, t[0]
            # Only runs longer than the period hold more than their first event.
            for k in np.flatnonzero((t[stops - 1] - t[starts] > censored) | (np.arange(len(starts)) == len(starts) - 1) | (np.arange(len(starts)) == 0)).tolist():
                at, stop = (first, int(stops[k])) if k == 0 else (int(starts[k]), int(stops[k]))
                while at < stop:
                    keep[at], last = True, t[at]
                    at += int(np.searchsorted(t[at:stop], last + censored, "right"))
            run = names[-1]
            yield part.loc[keep, ["sorting", "unit_id", "sample_index"]]

    dealt = runs.repartition(*UNIT, "_run").sortWithinPartitions(*UNIT, "_run", "sample_index")
    return dealt.select(*UNIT, "_run", "sample_index").mapInPandas(scan, spikes.select(*UNIT, "sample_index").schema)


def consensus(spikes: DataFrame, keys: list[str], window: int, at_least: Column) -> DataFrame:
    """Consensus events per key: runs of events linked by gaps <= window with enough members, at their rounded mean.

    Half-way means round to the even sample.
    """
    groups = with_runs(spikes, keys, window).groupBy(*keys, "_run").agg(F.count(F.lit(1)).alias("size"), F.sum("sample_index").alias("total"), F.max(at_least).alias("least"))
    mean = F.bround(F.col("total") / F.col("size"))
    return groups.where("size >= least").select(*keys, mean.cast("bigint").alias("sample_index"), "size")


def cross_shifts(spikes: DataFrame, max_shift: int, sigma: float = 1.5, least: float = 0.05) -> DataFrame:
    """shift per pair of units of different sortings: the lag of the smoothed correlogram's first maximum.

    The correlogram of bin 1 is spread over a Gaussian kernel by a join with the kernel's offsets; a peak below
    least * min(n1, n2) gives shift 0.  Negative: the first unit is earlier.
    """
    kernel = gaussian_kernel(sigma)
    half = len(kernel) // 2
    offsets = F.explode(F.array(*[F.struct(F.lit(k - half).alias("o"), F.lit(float(w)).alias("w")) for k, w in enumerate(kernel)]))
    lags = correlogram(spikes, max_shift, 1).withColumn("_k", offsets)
    smooth = lags.groupBy(*PAIR, (F.col("bin") + F.col("_k.o")).alias("lag")).agg(F.sum(F.col("n") * F.col("_k.w")).alias("height"))
    smooth = smooth.where(F.col("lag").between(-max_shift, max_shift - 1)).withColumn("height", F.round("height", 9))
    best = smooth.groupBy(*PAIR).agg(F.max(F.struct("height", (-F.col("lag")).alias("back"))).alias("best"))
    counts = unit_counts(spikes)
    n1 = counts.toDF("s1", "u1", "n1")
    n2 = counts.toDF("s2", "u2", "n2")
    joined = best.join(n1, ["s1", "u1"]).join(n2, ["s2", "u2"])
    strong = F.col("best.height") >= least * F.least("n1", "n2")
    return joined.select(*PAIR, F.when(strong, -F.col("best.back")).otherwise(0).cast("int").alias("shift"))


def smoothed_rate(events: DataFrame, keys: list[str], start: int, stop: int, step: int, sigma: float, truncate: float = 5.0, reflect: tuple[int, int] | None = None) -> DataFrame:
    """rate on the grid start, start + step, ... < stop: a Gaussian kernel per event, cut off at truncate * sigma.

    Each event is dealt to the grid points within its reach, so no grid is joined.  reflect: mirror
    events at the margins (low, high), each only if no event of the key lies outside it.
    """
    if reflect is not None:
        low, high = reflect
        sides = Window.partitionBy(*keys)
        marked = events.withColumn("_min", F.min("sample_index").over(sides)).withColumn("_max", F.max("sample_index").over(sides))
        t = F.col("sample_index")
        copies = F.array_compact(F.array(t, F.when(F.col("_min") >= low, 2 * low - t), F.when(F.col("_max") <= high, 2 * high - t)))
        events = marked.withColumn("sample_index", F.explode(copies)).drop("_min", "_max")
    reach = truncate * sigma
    first = F.greatest(F.lit(0), F.ceil((F.col("sample_index") - F.lit(reach) - start) / F.lit(step)))
    last = F.least(F.lit((stop - start - 1) // step), F.floor((F.col("sample_index") + F.lit(reach) - start) / F.lit(step)))
    points = events.withColumn("_first", first.cast("bigint")).withColumn("_last", last.cast("bigint")).where("_first <= _last")
    points = points.withColumn("_k", F.explode(F.sequence("_first", "_last"))).withColumn("at", F.col("_k") * step + start)
    z = (F.col("sample_index") - F.col("at")) / F.lit(float(sigma))
    return points.groupBy(*keys, "at").agg((F.sum(F.exp(-z * z / 2)) / F.lit(sigma * math.sqrt(2 * math.pi))).alias("rate"))
