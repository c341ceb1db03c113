"""Operators over mean waveforms: templates(sorting, unit_id, sample, channel, value)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.stats import gaussian_kernel
from eventloom.meta import UNIT, Dataset
from eventloom.operators.bandjoin import PAIR
from eventloom.operators.graph import settle


def long_recording(chunks: DataFrame) -> DataFrame:
    """(frame, channel, value) of chunks(chunk_id, start_frame, samples)."""
    rows = chunks.select("start_frame", F.posexplode("samples").alias("at", "row"))
    return rows.select((F.col("start_frame") + F.col("at")).alias("frame"), F.posexplode("row").alias("channel", "value"))


def event_frames(events: DataFrame, chunks: DataFrame, before: int, after: int) -> DataFrame:
    """events with sample and row (the values by channel) of every frame from ``before`` before each event to ``after`` - 1 after it.

    Frames are cut into stretches as long as the longest chunk.  Chunks and the events that need their frames meet by stretch, all events of a stretch
    in one list, so the recording is shuffled once, as chunks, and only the frames around events are taken out of them.  The list of a
    stretch holds at most EVENTS_AT_ONCE events; more stand in several lists.
    """
    width = chunks.agg(F.max(F.size("samples"))).first()[0] or 1
    stretch = lambda c: F.floor(c / F.lit(width)).cast("bigint")
    t = F.col("sample_index")
    touched = F.sequence(stretch(t - before), stretch(t + (after - 1)))
    lists = events.select(F.struct(*events.columns).alias("e"), F.explode(touched).alias("_stretch"), (t - before).alias("_from"))
    lists = lists.withColumn("_list", F.pmod(F.xxhash64("e"), F.lit(LISTS)))
    count = F.count(F.lit(1)).over(Window.partitionBy("_stretch"))
    lists = lists.withColumn("_list", F.when(count > EVENTS_AT_ONCE, F.col("_list")).otherwise(0))
    lists = lists.groupBy("_stretch", "_list").agg(F.collect_list(F.struct("e", "_from")).alias("_events"))
    first, last = F.col("start_frame"), F.col("start_frame") + F.size("samples")
    dealt = chunks.withColumn("_chunk_stretch", F.explode(F.sequence(stretch(first), stretch(last - 1))))
    joined = dealt.join(lists, F.col("_chunk_stretch") == F.col("_stretch"))

    def rows(x: Column) -> Column:
        # A chunk and an event may meet in two stretches: the first of both counts.
        low, high = F.greatest(x["_from"], first), F.least(x["_from"] + (before + after), last)
        here = F.col("_stretch") == F.greatest(stretch(first), stretch(x["_from"]))
        part = F.slice("samples", (low - first + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int"))
        return F.struct(x["e"].alias("e"), (low - x["_from"]).cast("int").alias("at"), F.when(here & (high > low), part).alias("part"))

    found = joined.select(F.explode(F.filter(F.transform("_events", rows), lambda r: r["part"].isNotNull())).alias("r"))
    return found.select("r.e.*", "r.at", F.posexplode("r.part").alias("_k", "row")).select(*events.columns, (F.col("at") + F.col("_k")).alias("sample"), "row")


EVENTS_AT_ONCE, LISTS = 65_536, 64


def sampled_spikes(spikes: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """At most ``most`` events of each unit, chosen by a hash (MD5) of seed and time, so that reruns agree; ties by time."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("sample_index").cast("string")).cast("binary"))
    order = Window.partitionBy(*UNIT).orderBy("_h", "sample_index")
    return spikes.withColumn("_h", digest).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most).drop("_k", "_h")


def mean_waveforms(data: Dataset, before: int, after: int, most: int = 1000, seed: int = 0) -> DataFrame:
    """Templates: the mean of the recording around at most ``most`` events of each unit; sample 0 is ``before`` samples before.

    Events meet the chunks of the recording, and only the frames around them are laid out.
    """
    events = sampled_spikes(data.spikes, most, seed).select(*UNIT, "sample_index")
    rows = event_frames(events, data.recording, before, after)
    long = rows.select(*UNIT, "sample", F.posexplode("row").alias("channel", "value"))
    return long.groupBy(*UNIT, "sample", "channel").agg(F.avg("value").alias("value"))


def signed(sign: str) -> Column:
    """The part of value that a peak sign looks at."""
    v = F.col("value")
    return {"both": F.abs(v), "neg": -v, "pos": v}[sign]


def channel_peaks(templates: DataFrame, sign: str = "both", mode: str = "extremum") -> DataFrame:
    """peak per unit and channel: the extremum, or the range with mode peak_to_peak."""
    peak = F.max(signed(sign)) if mode == "extremum" else F.max("value") - F.min("value")
    return templates.groupBy(*UNIT, "channel").agg(peak.alias("peak"))


def top_channels(templates: DataFrame, k: int = 1, sign: str = "both", mode: str = "extremum") -> DataFrame:
    """The k channels of highest peak per unit, with their rank from 1; ties to smaller channels."""
    order = Window.partitionBy(*UNIT).orderBy(F.desc("peak"), "channel")
    ranked = channel_peaks(templates, sign, mode).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k)


def amplitudes(templates: DataFrame, sign: str = "both", mode: str = "extremum") -> DataFrame:
    """The peak on the best channel of each unit."""
    return channel_peaks(templates, sign, mode).groupBy(*UNIT).agg(F.max("peak").alias("value"))


def unit_locations(templates: DataFrame, channels: DataFrame) -> DataFrame:
    """x and y of each unit: the mean place of the channels, weighted by their peaks."""
    peaks = channel_peaks(templates).join(channels.select("channel", "x", "y"), "channel")
    total = F.sum("peak")
    weighted = lambda c: (F.sum(F.col("peak") * F.col(c)) / F.when(total != 0, total)).alias(c)
    return peaks.groupBy(*UNIT).agg(weighted("x"), weighted("y"))


def near_units(locations: DataFrame, distance: float) -> DataFrame:
    """All pairs (s1, u1, s2, u2), u1 < u2, of units of one sorting at most distance apart.

    Units are dealt to square cells as wide as the distance, and meet those of the nine cells around them; units of unknown place are near none.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(float(distance))).cast("bigint")
    around = lambda c: F.explode(F.array(c - 1, c, c + 1))
    one = locations.select(F.col("sorting").alias("s1"), F.col("unit_id").alias("u1"), F.col("x").alias("x1"), F.col("y").alias("y1"), cell("x").alias("cx"), cell("y").alias("cy"))
    two = locations.select(F.col("sorting").alias("s2"), F.col("unit_id").alias("u2"), F.col("x").alias("x2"), F.col("y").alias("y2"), cell("y").alias("_y"), around(cell("x")).alias("_x"))
    two = two.withColumn("_y", around(F.col("_y")))
    met = one.join(two, (F.col("s1") == F.col("s2")) & (F.col("cx") == F.col("_x")) & (F.col("cy") == F.col("_y")) & (F.col("u1") < F.col("u2")))
    return met.where(F.hypot(F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")) <= distance).select(*PAIR)


def near_pairs(pairs: DataFrame, locations: DataFrame, distance: float) -> DataFrame:
    """Pairs (s1, u1, s2, u2) of units at most distance apart."""
    one, two = locations.toDF("s1", "u1", "x1", "y1"), locations.toDF("s2", "u2", "x2", "y2")
    far = F.hypot(F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2"))
    return pairs.join(one, ["s1", "u1"]).join(two, ["s2", "u2"]).where(far <= distance).select(*pairs.columns)


#: Ranges that values are dealt to, and how often the range of the median is dealt to ranges again.
RANGES, DEPTH = 4096, 2


def medians(values: DataFrame, key: str, value: str) -> DataFrame:
    """(key, median) over all rows, the mean of both middle values if their number is even.

    Exact, by narrowing: values are counted in ranges between the extremes of a key (combined before the shuffle), the ranges in which the
    middle ranks lie are dealt to finer ranges, and only what is left in the last ones is sorted.
    """
    x = F.col(value).cast("double")
    rows = values.select(F.col(key).alias("k"), x.alias("x")).where("x is not null")
    ends = settle(rows.groupBy("k").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count(F.lit(1)).alias("n")), "extremes")
    # Both middle ranks of each key, from 0.
    middle = F.explode(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))
    sought = settle(ends.select("k", "low", "high", "n", middle.alias("rank"), F.lit(0).cast("bigint").alias("below")).distinct(), "sought")
    place = F.least(F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * RANGES), F.lit(RANGES - 1))
    place = F.when(F.col("high") > F.col("low"), place).otherwise(0).cast("int")
    for _ in range(DEPTH):
        bands = sought.select("k", "low", "high").distinct()
        inside = rows.join(bands, "k").where("x >= low and x <= high")
        counted = inside.groupBy("k", "low", "high", place.alias("place")).agg(F.count(F.lit(1)).alias("m"), F.min("x").alias("a"), F.max("x").alias("b"))
        order = Window.partitionBy("k", "low", "high").orderBy("place")
        upto = counted.withColumn("upto", F.sum("m").over(order))
        hit = sought.join(upto, ["k", "low", "high"]).where("below + upto > rank and below + upto - m <= rank")
        sought = settle(hit.select("k", F.col("a").alias("low"), F.col("b").alias("high"), "n", "rank", (F.col("below") + F.col("upto") - F.col("m")).alias("below")), "sought")
    bands = sought.select("k", "low", "high", "below").distinct()
    left = rows.join(bands, "k").where("x >= low and x <= high").groupBy("k", "low", "high", "below", "x").agg(F.count(F.lit(1)).alias("m"))
    upto = F.col("below") + F.sum("m").over(Window.partitionBy("k", "low", "high", "below").orderBy("x"))
    found = sought.join(left.withColumn("upto", upto), ["k", "low", "high", "below"]).where("upto > rank and upto - m <= rank")
    return found.groupBy(F.col("k").alias(key)).agg(F.avg("x").alias("median"))


def noise_levels(chunks: DataFrame) -> DataFrame:
    """noise (scaled median absolute deviation) and sd per channel."""
    long = long_recording(chunks).select("channel", F.col("value").cast("double").alias("value"))
    middle = settle(medians(long, "channel", "value"), "middle")
    spread = long.groupBy("channel").agg(F.stddev("value").alias("sd"))
    # One row per channel.
    away = long.join(F.broadcast(middle), "channel").select("channel", F.abs(F.col("value") - F.col("median")).alias("away"))
    noise = medians(away, "channel", "away").select("channel", (F.col("median") / F.lit(0.6744897501960817)).alias("noise"))
    return noise.join(spread, "channel")


def signal_to_noise(data: Dataset, sign: str = "both", mode: str = "peak_to_peak") -> DataFrame:
    """Peak over noise on the best channel."""
    best = top_channels(data.templates, 1, sign, mode)
    joined = best.join(noise_levels(data.recording), "channel")
    return joined.select(*UNIT, (F.col("peak") / F.when(F.col("noise") != 0, F.col("noise"))).alias("value"))


def spike_amplitudes(data: Dataset) -> DataFrame:
    """amplitude of every event: the recording on its unit's best channel at its time."""
    best = top_channels(data.templates, 1).select(*UNIT, "channel")
    events = data.spikes.join(best, [*UNIT]).select(*UNIT, "sample_index", "channel")
    rows = event_frames(events, data.recording, 0, 1)
    return rows.select(*UNIT, "sample_index", F.get("row", F.col("channel")).alias("amplitude"))


def sd_ratios(data: Dataset) -> DataFrame:
    """Deviation of each unit's event amplitudes over that of its best channel."""
    own = spike_amplitudes(data).groupBy(*UNIT).agg(F.stddev("amplitude").alias("own"))
    best = top_channels(data.templates, 1).select(*UNIT, "channel")
    joined = own.join(best, [*UNIT]).join(noise_levels(data.recording).select("channel", "sd"), "channel")
    return joined.select(*UNIT, (F.col("own") / F.when(F.col("sd") != 0, F.col("sd"))).alias("value"))


def peak_shifts(templates: DataFrame, before: int, threshold: float = 0.5, check_next: int = 10) -> DataFrame:
    """shift per unit: where its waveform on the best channel peaks, less ``before``.

    The first local maximum (plateaus count at their middle, the ends of the waveform don't) of at least
    threshold times the highest value, or else the highest value; then the highest within the next check_next samples.
    """
    best = top_channels(templates, 1).select(*UNIT, "channel")
    wave = templates.join(best, [*UNIT, "channel"]).select(*UNIT, "sample", F.abs("value").alias("v"))
    order = Window.partitionBy(*UNIT).orderBy("sample")
    every = Window.partitionBy(*UNIT)
    new = F.coalesce((F.col("v") != F.lag("v").over(order)), F.lit(True)).cast("int")
    flat = wave.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order)).withColumn("top", F.max("v").over(every))
    runs = flat.groupBy(*UNIT, "_run").agg(F.min("sample").alias("a"), F.max("sample").alias("b"), F.first("v").alias("v"), F.first("top").alias("top"))
    by_run = Window.partitionBy(*UNIT).orderBy("_run")
    peak = (F.col("v") > F.lag("v").over(by_run)) & (F.col("v") > F.lead("v").over(by_run)) & (F.col("v") >= threshold * F.col("top"))
    first = runs.withColumn("peak", F.coalesce(peak, F.lit(False))).groupBy(*UNIT).agg(
        F.min(F.when(F.col("peak"), F.floor((F.col("a") + F.col("b")) / 2))).alias("local"),
        F.min(F.when(F.col("v") == F.col("top"), F.col("a"))).alias("highest"),
    )
    start = first.select(*UNIT, F.coalesce("local", "highest").alias("start"))
    near = wave.join(start, [*UNIT]).where(F.col("sample").between(F.col("start"), F.col("start") + check_next))
    at = F.max(F.struct("v", (-F.col("sample")).alias("back")))
    return near.groupBy(*UNIT).agg(at.alias("at")).select(*UNIT, (-F.col("at.back") - before).cast("int").alias("shift"))


def extremum_shifts(templates: DataFrame, before: int) -> DataFrame:
    """shift per unit: the sample of the extremum on its best channel, less ``before``; ties to the first."""
    best = top_channels(templates, 1).select(*UNIT, "channel")
    wave = templates.join(best, [*UNIT, "channel"])
    at = F.max(F.struct(F.abs("value").alias("v"), (-F.col("sample")).alias("back")))
    return wave.groupBy(*UNIT).agg(at.alias("at")).select(*UNIT, (-F.col("at.back") - before).cast("int").alias("shift"))


def lagged_differences(templates: DataFrame, pairs: DataFrame, max_lag: int) -> DataFrame:
    """difference per pair: the smallest over lags of at most max_lag samples, on all channels; samples that only one template has don't count."""
    lags = F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("lag")
    one = templates.select(F.col("sorting").alias("s1"), F.col("unit_id").alias("u1"), "sample", "channel", F.col("value").alias("v1"))
    two = templates.select(F.col("sorting").alias("s2"), F.col("unit_id").alias("u2"), "sample", "channel", F.col("value").alias("v2"))
    left = pairs.select(*PAIR, lags).join(one, ["s1", "u1"])
    right = pairs.select(*PAIR, lags).join(two, ["s2", "u2"]).withColumn("sample", F.col("sample") + F.col("lag"))
    both = left.join(right, [*PAIR, "lag", "sample", "channel"])
    total = F.sum(F.abs("v1") + F.abs("v2"))
    each = both.groupBy(*PAIR, "lag").agg((F.sum(F.abs(F.col("v1") - F.col("v2"))) / F.when(total != 0, total)).alias("difference"))
    return each.groupBy(*PAIR).agg(F.min("difference").alias("difference"))


def template_differences(templates: DataFrame, pairs: DataFrame, num_channels: int = 5, crop: tuple[int, int] | None = None) -> DataFrame:
    """difference per pair (s1, u1, s2, u2[, shift]): sum |T1 - T2| over sum (|T1| + |T2|) on the channels where both are largest.

    T2 is moved by shift; samples outside crop, or that only one template has, don't count.
    """
    if "shift" not in pairs.columns:
        pairs = pairs.withColumn("shift", F.lit(0))
    one = templates.select(F.col("sorting").alias("s1"), F.col("unit_id").alias("u1"), "sample", "channel", F.col("value").alias("v1"))
    two = templates.select(F.col("sorting").alias("s2"), F.col("unit_id").alias("u2"), "sample", "channel", F.col("value").alias("v2"))
    keys = ["s1", "u1", "s2", "u2"]
    p = pairs.select(*keys, "shift")
    left = p.join(one, ["s1", "u1"])
    right = p.join(two, ["s2", "u2"]).withColumn("sample", F.col("sample") + F.col("shift")).drop("shift")
    both = left.join(right, [*keys, "sample", "channel"])
    if crop is not None:
        both = both.where(F.col("sample").between(crop[0], crop[1]))
    size = both.groupBy(*keys, "channel").agg(F.max(F.abs("v1") + F.abs("v2")).alias("size"))
    chosen = size.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("size"), "channel"))).where(F.col("_k") <= num_channels)
    kept = both.join(chosen.select(*keys, "channel"), [*keys, "channel"], "left_semi")
    total = F.sum(F.abs("v1") + F.abs("v2"))
    return kept.groupBy(*keys).agg((F.sum(F.abs(F.col("v1") - F.col("v2"))) / F.when(total != 0, total)).alias("difference"))


def correlogram_differences(
    autos: DataFrame,
    crosses: DataFrame,
    counts: DataFrame,
    max_bin: int,
    half_height: float = 0.5,
    sigma: float = 0.0,
    truncate: float = 5.0,
    censored: int = 0,
    margin: int = 0,
    censor_autos: bool = False,
) -> DataFrame:
    """difference per pair (s1, u1, s2, u2): how far the cross-correlogram is from both auto-correlograms.

    autos: (sorting, unit_id, bin, n); crosses: (s1, u1, s2, u2, shift, bin, n); bins -max_bin to max_bin - 1.  In this
    order: the bins -censored to censored - 1 of crosses (and of autos, with censor_autos) are emptied; all are spread by a Gaussian of sigma bins, cut off
    at truncate * sigma; margin bins are cropped from both ends, of crosses moved by their shift, so that bin shift is their
    middle; each is divided by its mean (empty ones stay 0).  The window of a pair is the mean of its units' own half-widths (last bin above half_height
    of the maximum), weighted by events; within it, mean |cross - auto| is weighted likewise.

    Counts are summed before this, so a row here is a pair of units with three lists of at most 2 max_bin numbers, compared in
    Arrow batches.
    """
    one = lambda df, keys: df.groupBy(*keys).agg(F.collect_list("bin").alias("bins"), F.collect_list(F.col("n").cast("double")).alias("ns"))
    own = counts.select(*UNIT, "n_spikes").join(one(autos, UNIT), [*UNIT], "left")
    pairs = one(crosses, [*PAIR, "shift"]).withColumnsRenamed({"bins": "b0", "ns": "n0"})
    joined = pairs.join(own.toDF("s1", "u1", "m1", "b1", "n1"), ["s1", "u1"]).join(own.toDF("s2", "u2", "m2", "b2", "n2"), ["s2", "u2"])
    kernel = gaussian_kernel(sigma, truncate) if sigma > 0 else np.ones(1)

    def dense(bins: np.ndarray | None, values: np.ndarray | None, censor: bool, shift: int) -> np.ndarray:
        out = np.zeros(2 * max_bin)
        if bins is not None:
            bins = np.asarray(bins, np.int64)
            inside = (bins >= -max_bin) & (bins < max_bin)
            out[bins[inside] + max_bin] = np.asarray(values)[inside]
        if censor and censored:
            out[max(0, max_bin - censored) : max_bin + censored] = 0
        out = np.convolve(out, kernel, mode="full")[len(kernel) // 2 :][: 2 * max_bin]
        out = out[margin + shift : 2 * max_bin - margin + shift]
        return out / out.mean() if out.size and out.mean() else out * 0

    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = []
            for r in part.itertuples():
                shift = int(r.shift) if margin else 0
                x, y, z = dense(r.b0, r.n0, True, shift), dense(r.b1, r.n1, censor_autos, 0), dense(r.b2, r.n2, censor_autos, 0)
                middle = len(y) // 2
                at = np.arange(len(y)) - middle
                wide = [np.abs(at[h >= half_height * h.max()]).max() if h.size else 0 for h in (y, z)]
                w = int(np.floor((wide[0] * r.m1 + wide[1] * r.m2) / (r.m1 + r.m2) + 0.5))
                # A shift beyond the margin leaves fewer bins to compare.
                inside = np.flatnonzero((np.abs(at) <= w) & (np.arange(len(y)) < len(x)))
                apart = [np.abs(x[inside] - h[inside]).mean() if len(inside) else np.nan for h in (y, z)]
                found.append((apart[0] * r.m1 + apart[1] * r.m2) / (r.m1 + r.m2))
            yield part[[*PAIR]].assign(difference=found)

    schema = pairs.select(*PAIR, F.lit(0.0).alias("difference")).schema
    found = joined.select(*PAIR, "shift", "b0", "n0", "m1", "b1", "n1", "m2", "b2", "n2").mapInPandas(compare, schema)
    return found.withColumn("difference", F.nanvl("difference", F.lit(None)))
