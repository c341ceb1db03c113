"""Pairs of units of which the second makes the first pause."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.meta import UNIT, Dataset
from eventloom.operators.bandjoin import correlogram
from eventloom.operators.metrics import firing_rates


def pausing_pairs(
    data: Dataset,
    pause: tuple[int, int],
    threshold: float = 0.4,
    fast: float = 40.0,
    slow: tuple[float, float] = (0.5, 3.0),
    max_time: int = 375,
    bin_size: int = 30,
) -> DataFrame:
    """(sorting, u1, u2) of fast and slow units of a sorting where u1 pauses after u2's events.

    On the correlogram of u1 around u2: the baseline is the median of the bins before; the pause (bins of the
    half-open range, in bins) must have a median below threshold * baseline; the pair is refused if at
    least half of the mirrored bins are below it too.
    """
    rates = firing_rates(data)
    ss = rates.where(F.col("value") >= fast).select(F.col("sorting").alias("s1"), F.col("unit_id").alias("u1"))
    cs = rates.where(F.col("value").between(*slow)).select(F.col("sorting").alias("s2"), F.col("unit_id").alias("u2"))
    n_bins = max_time // bin_size
    bins = F.explode(F.sequence(F.lit(-n_bins), F.lit(n_bins - 1))).alias("bin")
    pairs = ss.join(cs, (F.col("s1") == F.col("s2")) & (F.col("u1") != F.col("u2")))
    candidates = data.spikes.join(ss.toDF(*UNIT).union(cs.toDF(*UNIT)).distinct(), [*UNIT], "left_semi")
    counts = correlogram(candidates, n_bins * bin_size, bin_size, same=True)
    dense = pairs.select("s1", "u1", "s2", "u2", bins).join(counts, ["s1", "u1", "s2", "u2", "bin"], "left").fillna({"n": 0})
    keys = ["s1", "u1", "u2"]
    every = Window.partitionBy(*keys)
    level = dense.withColumn("base", F.median(F.when(F.col("bin") < 0, F.col("n"))).over(every))
    low = F.col("n") < threshold * F.col("base")
    inside = (F.col("bin") >= pause[0]) & (F.col("bin") < pause[1])
    mirrored = (F.col("bin") >= -pause[1]) & (F.col("bin") < -pause[0])
    judged = level.groupBy(*keys).agg(
        F.first("base").alias("base"),
        F.median(F.when(inside, F.col("n"))).alias("in_pause"),
        F.avg(F.when(mirrored, low.cast("double"))).alias("low_before"),
    )
    keep = (F.col("in_pause") < threshold * F.col("base")) & (F.col("low_before") < 0.5)
    return judged.where(keep).select(F.col("s1").alias("sorting"), "u1", "u2")

