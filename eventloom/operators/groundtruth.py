"""Comparison of sortings with known trains: metrics, labels, and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.meta import UNIT
from eventloom.operators.bandjoin import coincidences
from eventloom.operators.trains import unit_counts

MATCH_STEPS = (0.95, 0.8, 0.5)
BLOCKS = 16


def truth_metrics(spikes: DataFrame, truth: DataFrame, window: int, t_max: int, chance: bool = True) -> DataFrame:
    """accuracy, recall and precision of every unit against every true neuron.

    truth: (unit_id, sample_index).  Coincidences expected by chance are taken out unless chance is false.
    """
    known = truth.select(F.lit("\x7ftruth").alias("sorting"), "unit_id", "sample_index")
    both = spikes.select("sorting", "unit_id", "sample_index").union(known)
    pairs = coincidences(both, window).where((F.col("s2") == "\x7ftruth") & (F.col("s1") != "\x7ftruth"))
    units, neurons = unit_counts(spikes), truth.groupBy(F.col("unit_id").alias("neuron")).agg(F.count(F.lit(1)).alias("n_true"))
    # The result is a matrix by definition; its columns are dealt to BLOCKS so that its rows are spread evenly.
    blocks = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))
    grid = units.withColumn("_b", blocks).join(neurons.withColumn("_b", F.pmod(F.hash("neuron"), F.lit(BLOCKS))), "_b").drop("_b")
    found = pairs.select(F.col("s1").alias("sorting"), F.col("u1").alias("unit_id"), F.col("u2").alias("neuron"), "n_coinc")
    all_ = grid.join(found, [*UNIT, "neuron"], "left").fillna({"n_coinc": 0})
    p = (2 * window + 1) / t_max if chance else 0.0
    n, g = F.col("n_spikes"), F.col("n_true")
    tp = (F.col("n_coinc") - n * g * F.lit(p)) / (1 - g * F.lit(p))
    out = all_.withColumn("tp", tp)
    return out.select(
        *UNIT,
        "neuron",
        "n_spikes",
        "n_coinc",
        (F.col("tp") / (n + g - F.col("tp"))).alias("accuracy"),
        (F.col("tp") / g).alias("recall"),
        (F.col("tp") / n).alias("precision"),
    )


def labels(metrics: DataFrame, quality: DataFrame, agreement: DataFrame, small_rate: float = 0.4, dirty: float = 0.25, noise: float = 0.5, merged: float = 1 / 3, mua: float = 0.5, shared: float = 0.5) -> DataFrame:
    """label and matched neuron of each unit; the first that applies of Small, Contaminated, Noise, Merged, MUA, a match, Redundant, Split.

    quality: (sorting, unit_id, firing_rate, contamination); agreement: (sorting, u1, u2, agreement) within sortings, both ways.
    """
    by_recall = Window.partitionBy(*UNIT).orderBy(F.desc("recall"))
    second = metrics.withColumn("_k", F.row_number().over(by_recall)).where("_k = 2").select(*UNIT, F.col("recall").alias("second_recall"))
    sums = metrics.groupBy(*UNIT).agg(
        F.sum("precision").alias("all_precision"),
        F.max("precision").alias("best_precision"),
        F.max(F.struct("accuracy", (-F.col("neuron")).alias("back"))).alias("match"),
    )
    units = sums.join(second, [*UNIT], "left").join(quality, [*UNIT]).select("*", (-F.col("match.back")).alias("neuron"), F.col("match.accuracy").alias("accuracy"))
    best = metrics.groupBy("sorting", "neuron").agg(F.max(F.struct("accuracy", (-F.col("unit_id")).alias("back"))).alias("b"))
    units = units.join(best.select("sorting", "neuron", (-F.col("b.back")).alias("best_unit")), ["sorting", "neuron"])
    near = agreement.select("sorting", F.col("u1").alias("unit_id"), F.col("u2").alias("best_unit"), F.col("agreement").alias("to_best"))
    units = units.join(near, ["sorting", "unit_id", "best_unit"], "left")
    steps = F.lit(f"acc < {MATCH_STEPS[-1]:.0%}")
    for low in reversed(MATCH_STEPS):
        steps = F.when(F.col("accuracy") >= low, F.lit(f"acc >= {low:.0%}")).otherwise(steps)
    label = (
        F.when(F.col("firing_rate") < small_rate, "Small")
        .when(F.col("contamination") > dirty, "Contaminated")
        .when(F.col("all_precision") < noise, "Noise")
        .when(F.col("second_recall") > merged, "Merged")
        .when(F.col("best_precision") < mua, "MUA")
        .when(F.col("unit_id") == F.col("best_unit"), steps)
        .when(F.col("to_best") >= shared, "Redundant")
        .otherwise("Split")
    )
    return units.select(*UNIT, label.alias("label"), "neuron", "accuracy")


def theoretical_maximum(metrics: DataFrame, min_precision: float = 0.8) -> DataFrame:
    """The unit of best accuracy for each neuron, of those precise enough; ties to the first sorting and unit."""
    order = Window.partitionBy("neuron").orderBy(F.desc("accuracy"), *UNIT)
    good = metrics.where(F.col("precision") >= min_precision)
    return good.withColumn("_k", F.row_number().over(order)).where("_k = 1").select("neuron", *UNIT, "accuracy")


def recovered(metrics: DataFrame, types: DataFrame, least: float = 0.8) -> DataFrame:
    """(type, sorting, n): neurons of each type that a sorting recovers; the sorting ``any``: by any of them."""
    hit = metrics.where(F.col("accuracy") > least).select("sorting", "neuron").distinct()
    every = hit.select(F.lit("any").alias("sorting"), "neuron").distinct()
    return hit.union(every).join(types, "neuron").groupBy("type", "sorting").agg(F.count(F.lit(1)).alias("n"))


def survival(metrics: DataFrame, steps: int = 20) -> DataFrame:
    """(sorting, at, n): how many units have a best accuracy of at least at = 0, 1/steps, ..., 1."""
    best = metrics.groupBy(*UNIT).agg(F.max("accuracy").alias("accuracy"))
    reached = F.floor(F.least(F.col("accuracy"), F.lit(1.0)) * steps + F.lit(1e-9)).cast("int")
    rows = best.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(steps)))).withColumn("reached", reached)
    counts = F.count(F.when(F.col("k") <= F.col("reached"), 1))
    return rows.groupBy("sorting", "k").agg(counts.alias("n"))


def kernel_mean(points: DataFrame, x: str, y: str, start: float, stop: float, count: int, sigma: float) -> DataFrame:
    """(k, mean): Gaussian-weighted mean of y around count grid points of x from start to stop."""
    step = (stop - start) / (count - 1)
    rows = points.select(F.col(x).alias("x"), F.col(y).alias("y"), F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("k"))
    z = (F.col("x") - (F.lit(start) + F.col("k") * F.lit(step))) / F.lit(sigma)
    w = F.exp(-z * z / 2)
    return rows.groupBy("k").agg((F.sum(w * F.col("y")) / F.sum(w)).alias("mean"))
