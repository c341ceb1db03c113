"""Quality metrics per unit and per pair of units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.stats import binomial_tail_column, contamination
from eventloom.meta import UNIT, Dataset
from eventloom.operators import templates as T
from eventloom.operators.bandjoin import PAIR, coincidences, violations, weighted_coincidences, weighted_coincidences_of
from eventloom.operators.trains import intervals, unit_counts

BALANCE = 2.5


def firing_rates(data: Dataset) -> DataFrame:
    counts = unit_counts(data.spikes, data.units)
    return counts.select(*UNIT, (F.col("n_spikes") * F.lit(data.meta.fs) / F.lit(float(data.meta.t_max))).alias("value"))


def isi_portions(data: Dataset, low: float, high: float) -> DataFrame:
    """Share of the intervals strictly between low and high samples; null without intervals."""
    inside = (F.col("isi") > low) & (F.col("isi") < high)
    portions = intervals(data.spikes).groupBy(*UNIT).agg(F.avg(inside.cast("double")).alias("value"))
    return data.units.select(*UNIT).join(portions, [*UNIT], "left")


def contaminations(data: Dataset, censored: float, refractory: float) -> DataFrame:
    """Estimated contamination from the events that break the refractory period (in samples)."""
    counts = unit_counts(data.spikes, data.units)
    found = violations(data.spikes, refractory)
    joined = counts.join(found, [*UNIT], "left").fillna({"n_violations": 0.0})
    value = contamination(F.col("n_spikes"), F.col("n_violations"), data.meta.t_max, censored, refractory)
    return joined.select(*UNIT, "n_spikes", "n_violations", value.alias("value"))


def cross_contaminations(
    spikes: DataFrame,
    t_max: int,
    censored: float,
    refractory: float,
    limit: float,
    own: DataFrame,
    shifts: DataFrame | None = None,
    same: bool = False,
) -> DataFrame:
    """estimate and p_value per pair of units with coincident events.

    own: contamination per unit (sorting, unit_id, value).  Of each pair, the cleaner unit (the first at
    equal values) is the reference whose contamination C enters the formulas; estimate is null where C is 1.
    """
    both = weighted_coincidences(spikes, [censored, refractory], shifts, same)
    counts = unit_counts(spikes).join(own.select(*UNIT, "value"), [*UNIT])
    one, two = counts.toDF("s1", "u1", "n1", "c_1"), counts.toDF("s2", "u2", "n2", "c_2")
    joined = both.join(one, ["s1", "u1"]).join(two, ["s2", "u2"])
    return joined.select(*PAIR, *_cross_columns(F.least("c_1", "c_2"), t_max, refractory, limit))


def _cross_columns(c: Column, t_max: int, refractory: float, limit: float) -> list[Column]:
    """n_excess, n_trials, p and estimate of pairs with c0, c1, n1 and n2, given the contamination of the reference."""
    n = F.col("c1") - F.col("c0")
    trials = F.col("n1") * F.col("n2")
    estimate = (n * F.lit(float(t_max)) / (2 * trials * F.lit(float(refractory))) - c) / F.when(c != 1, 1 - c)
    rate = trials * ((1 - c) * F.lit(limit) + c)
    return [n.alias("n_excess"), rate.alias("n_trials"), F.lit(2 * refractory / t_max).alias("p"), estimate.alias("estimate")]


def cross_contaminations_of(
    spikes: DataFrame, t_max: int, censored: float, refractory: float, limit: float, own: DataFrame, wanted: DataFrame, first: bool = False
) -> DataFrame:
    """wanted with n_excess, n_trials, p, estimate and p_value of its pairs (s1, u1, s2, u2, shift), whether their events meet or not.

    The reference is the cleaner unit, or with ``first`` always unit 1.
    """
    both = weighted_coincidences_of(spikes, wanted, [censored, refractory])
    counts = unit_counts(spikes).join(own.select(*UNIT, "value"), [*UNIT])
    one, two = counts.toDF("s1", "u1", "n1", "c_1"), counts.toDF("s2", "u2", "n2", "c_2")
    joined = both.join(one, ["s1", "u1"]).join(two, ["s2", "u2"])
    c = F.col("c_1") if first else F.least("c_1", "c_2")
    return with_p_value(joined.select(*wanted.columns, *_cross_columns(c, t_max, refractory, limit)))


def with_p_value(pairs: DataFrame) -> DataFrame:
    """p_value: the chance of more excess coincidences, were the contamination at its limit."""
    return pairs.withColumn("p_value", binomial_tail_column(F.signum(F.col("n_excess") - 1) * F.floor(F.abs(F.col("n_excess") - 1)), F.col("n_trials"), F.col("p")))


def agreement(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """n1, n2 and agreement = c / (n1 + n2 - c) for pairs with n_coinc."""
    one, two = counts.select(*UNIT, "n_spikes").toDF("s1", "u1", "n1"), counts.select(*UNIT, "n_spikes").toDF("s2", "u2", "n2")
    joined = pairs.join(one, ["s1", "u1"]).join(two, ["s2", "u2"])
    c = F.col("n_coinc")
    whole = F.col("n1") + F.col("n2") - c
    return joined.withColumn("agreement", c / F.when(whole != 0, whole))


def similarity(pairs: DataFrame, t_max: int, window: float | None = None) -> DataFrame:
    """similarity: share of the smaller train that coincides, corrected for chance if a window is given."""
    m = F.least("n1", "n2")
    share = F.col("n_coinc") / F.when(m != 0, m)
    if window is None:
        return pairs.withColumn("similarity", share)
    chance = F.col("n1") * F.col("n2") * F.lit(2.0 * window + 1) / (F.lit(float(t_max)) * m)
    return pairs.withColumn("similarity", (share - chance) / F.when(chance != 1, 1 - chance))


def compared(data: Dataset, window: int, shifts: DataFrame | None = None, chance: bool = True, same: bool = False) -> DataFrame:
    """n_coinc, n1, n2, agreement and similarity of each pair of units that has coincidences."""
    pairs = coincidences(data.spikes, window, shifts, same)
    pairs = agreement(pairs, unit_counts(data.spikes))
    return similarity(pairs, data.meta.t_max, window if chance else None)


def score(rate: Column, contaminated: Column, k: float = BALANCE) -> Column:
    """Rate times one minus (k + 1) times contamination."""
    return rate * (1 - F.lit(k + 1) * contaminated)


def unit_scores(data: Dataset, censored: float, refractory: float, sd_ratio: DataFrame | None = None, k: float = BALANCE) -> DataFrame:
    """n_spikes, contamination and score of each unit; sd_ratio (sorting, unit_id, value) divides it by 1 + |1 - sd|."""
    quality = contaminations(data, censored, refractory)
    rate = F.col("n_spikes") * F.lit(data.meta.fs) / F.lit(float(data.meta.t_max))
    out = quality.select(*UNIT, "n_spikes", F.col("value").alias("contamination"), score(rate, F.coalesce("value", F.lit(0.0)), k).alias("score"))
    if sd_ratio is None:
        return out
    scaled = out.join(sd_ratio.select(*UNIT, F.col("value").alias("sd")), [*UNIT], "left")
    return scaled.withColumn("score", F.col("score") / (1 + F.abs(1 - F.coalesce("sd", F.lit(1.0))))).drop("sd")


METRICS = {
    "firing_rate": lambda data, p: firing_rates(data),
    "contamination": lambda data, p: contaminations(data, *(data.meta.samples(x) for x in p["refractory_period"])).select(*UNIT, "value"),
    "ISI_portion": lambda data, p: isi_portions(data, *(data.meta.samples(x) for x in p["range"])),
    "amplitude": lambda data, p: T.amplitudes(data.templates, p.get("peak_sign", "both"), p.get("mode", "extremum")),
    "SNR": lambda data, p: T.signal_to_noise(data, p.get("peak_sign", "both"), p.get("peak_mode", "peak_to_peak")),
    "sd_ratio": lambda data, p: T.sd_ratios(data),
}


def metric(name: str, data: Dataset, params: dict | None = None) -> DataFrame:
    """(sorting, unit_id, value) of a named metric; null where it is undefined."""
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}: one of {', '.join(METRICS)}")
    return METRICS[name](data, params or {})
