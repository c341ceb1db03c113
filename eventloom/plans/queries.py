"""One query per operator over the surrogate detectors, with the SQL that must give the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.signal import band_pass, filter_templates
from eventloom.functions.stats import border_weights, gaussian_kernel
from eventloom.meta import UNIT
from eventloom.operators import bandjoin, graph, groundtruth, merging, metrics, pauses, selection, trains
from eventloom.operators import templates as waves
from eventloom.operators.trains import unit_counts
from eventloom.plans import surrogate
from eventloom.plans.surrogate import MERGING_SQL, META, REFRACTORY_SQL, SPIKES_SQL, TEMPLATES_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
WINDOW = 3
MAX_SHIFT = 12


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# Single trains.


@query(f"WITH {SPIKES_SQL} SELECT sorting, unit_id, n_spikes::BIGINT AS n_spikes FROM counts")
def unit_spike_counts(spark: SparkSession, sf: str) -> DataFrame:
    data = surrogate.detectors(spark, sf)
    return unit_counts(data.spikes, data.units)


@query(f"WITH {SPIKES_SQL} SELECT sorting, unit_id, round(n_spikes * 30000.0::DOUBLE / 432000, 6) AS rate FROM counts")
def firing_rate(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.firing_rates(surrogate.detectors(spark, sf)).select(*UNIT, r6("value").alias("rate"))


ISI_SQL = f"{SPIKES_SQL}, isi AS (SELECT sorting, unit_id, sample_index - lag(sample_index) OVER (PARTITION BY sorting, unit_id ORDER BY sample_index) AS isi FROM spikes)"


@query(f"WITH {ISI_SQL} SELECT sorting, unit_id, round(avg((isi > 60 AND isi < 900)::INT::DOUBLE) FILTER (isi IS NOT NULL), 6) AS portion FROM isi GROUP BY ALL")
def isi_portion(spark: SparkSession, sf: str) -> DataFrame:
    data = surrogate.detectors(spark, sf)
    return metrics.isi_portions(data, META.samples(2), META.samples(30)).select(*UNIT, r6("value").alias("portion"))


@query(f"WITH {ISI_SQL} SELECT sorting, unit_id, (isi // 50)::INT AS bin, count(*)::BIGINT AS n FROM isi WHERE isi < 1000 GROUP BY ALL")
def isi_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return trains.isi_histogram(surrogate.detectors(spark, sf).spikes, 50, 1000)


@query(f"WITH {SPIKES_SQL} SELECT sorting, unit_id, count(*)::BIGINT AS n_spikes, min(sample_index)::BIGINT AS first, max(sample_index)::BIGINT AS last FROM sp WHERE sample_index >= 0 AND sample_index < 400000 GROUP BY ALL")
def out_of_range_filter(spark: SparkSession, sf: str) -> DataFrame:
    kept = trains.within_recording(surrogate.spikes(spark, sf), 400_000)
    return kept.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("n_spikes"), F.min("sample_index").alias("first"), F.max("sample_index").alias("last"))


@query(f"WITH {SPIKES_SQL}, m AS (SELECT sorting, unit_id, sample_index + unit_id * 7 - 40 AS t FROM spikes) SELECT sorting, unit_id, count(*)::BIGINT AS n_spikes, sum(t)::BIGINT AS total FROM m WHERE t >= 0 AND t < 432000 GROUP BY ALL")
def align_shift(spark: SparkSession, sf: str) -> DataFrame:
    data = surrogate.detectors(spark, sf)
    shifts = data.units.select(*UNIT, (F.col("unit_id") * 7 - 40).alias("shift"))
    moved = trains.shift_units(data.spikes, shifts, META.t_max)
    return moved.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("n_spikes"), F.sum("sample_index").alias("total"))


@query(
    f"""WITH RECURSIVE {SPIKES_SQL}, o AS (
  SELECT sorting, unit_id, sample_index AS t, row_number() OVER (PARTITION BY sorting, unit_id ORDER BY sample_index) AS k FROM spikes
), f AS (
  SELECT sorting, unit_id, k, t AS last, true AS keep FROM o WHERE k = 1
  UNION ALL
  SELECT o.sorting, o.unit_id, o.k, CASE WHEN o.t - f.last > 9 THEN o.t ELSE f.last END, o.t - f.last > 9
  FROM f JOIN o ON o.sorting = f.sorting AND o.unit_id = f.unit_id AND o.k = f.k + 1
) SELECT sorting, unit_id, last::BIGINT AS sample_index FROM f WHERE keep"""
)
def dedup_keep_first(spark: SparkSession, sf: str) -> DataFrame:
    return trains.drop_duplicates(surrogate.detectors(spark, sf).spikes, META.samples(0.3))


@query(f"WITH {ISI_SQL}, o AS (SELECT sorting, unit_id, sample_index, coalesce(sample_index - lag(sample_index) OVER (PARTITION BY sorting, unit_id ORDER BY sample_index) <= 9, false) AS close FROM spikes) SELECT sorting, unit_id, count(*)::BIGINT AS n_spikes, sum(sample_index)::BIGINT AS total FROM o WHERE NOT close GROUP BY ALL")
def dedup_keep_first_plain(spark: SparkSession, sf: str) -> DataFrame:
    kept = trains.drop_duplicates(surrogate.detectors(spark, sf).spikes, 9, "keep_first")
    return kept.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("n_spikes"), F.sum("sample_index").alias("total"))


@query(
    f"""WITH {SPIKES_SQL}, o AS (
  SELECT unit_id % 6 AS unit_id, sample_index, coalesce(sample_index - lag(sample_index) OVER (PARTITION BY unit_id % 6 ORDER BY sample_index) > 4, true)::INT AS fresh FROM spikes
), g AS (
  SELECT *, sum(fresh) OVER (PARTITION BY unit_id ORDER BY sample_index) AS run FROM o
), r AS (
  SELECT unit_id, run, count(*) AS size, round_even(avg(sample_index), 0)::BIGINT AS sample_index FROM g GROUP BY ALL
) SELECT unit_id, sample_index, size::BIGINT AS size FROM r WHERE size >= 2"""
)
def consensus_train(spark: SparkSession, sf: str) -> DataFrame:
    pooled = surrogate.detectors(spark, sf).spikes.select((F.col("unit_id") % 6).alias("unit_id"), "sample_index")
    return trains.consensus(pooled, ["unit_id"], 4, F.lit(2))


@query(
    f"""WITH {SPIKES_SQL}, g AS (SELECT unnest(range(432)) * 1000 AS x)
SELECT sorting, unit_id, x::BIGINT AS "at", round(sum(exp(-((sample_index - x) / 400.0::DOUBLE) * ((sample_index - x) / 400.0::DOUBLE) / 2)) / {400 * math.sqrt(2 * math.pi)!r}::DOUBLE, 6) AS rate
FROM spikes JOIN g ON sample_index BETWEEN x - 2000 AND x + 2000 GROUP BY ALL"""
)
def smoothed_rate(spark: SparkSession, sf: str) -> DataFrame:
    found = trains.smoothed_rate(surrogate.detectors(spark, sf).spikes, [*UNIT], 0, 432_000, 1000, 400.0)
    return found.select(*UNIT, F.col("at").cast("long").alias("at"), r6("rate").alias("rate"))


@query(
    f"""WITH {SPIKES_SQL}, ends AS (
  SELECT sorting, unit_id, min(sample_index) >= 2000 AS low, max(sample_index) <= 430000 AS high FROM spikes WHERE sample_index < 431000 GROUP BY ALL
), mirrored AS (
  SELECT sorting, unit_id, unnest([sample_index, CASE WHEN low THEN 4000 - sample_index END, CASE WHEN high THEN 860000 - sample_index END]) AS t FROM spikes JOIN ends USING (sorting, unit_id) WHERE sample_index < 431000
), g AS (SELECT unnest(range(432)) * 1000 AS x)
SELECT sorting, unit_id, x::BIGINT AS "at", round(sum(exp(-((t - x) / 400.0::DOUBLE) * ((t - x) / 400.0::DOUBLE) / 2)) / {400 * math.sqrt(2 * math.pi)!r}::DOUBLE, 6) AS rate
FROM mirrored JOIN g ON t BETWEEN x - 2000 AND x + 2000 GROUP BY ALL"""
)
def smoothed_rate_mirrored(spark: SparkSession, sf: str) -> DataFrame:
    """Rates with the events mirrored at margins beyond which a train has none."""
    early = surrogate.detectors(spark, sf).spikes.where("sample_index < 431000")
    found = trains.smoothed_rate(early, [*UNIT], 0, 432_000, 1000, 400.0, reflect=(2000, 430_000))
    return found.select(*UNIT, F.col("at").cast("long").alias("at"), r6("rate").alias("rate"))


@query(f"WITH {SPIKES_SQL} SELECT sorting, unit_id FROM counts JOIN (SELECT DISTINCT sorting, unit_id FROM spikes WHERE sample_index < 300) USING (sorting, unit_id)")
def empty_units(spark: SparkSession, sf: str) -> DataFrame:
    """The units that are left when those without events early in the recording go."""
    data = surrogate.detectors(spark, sf)
    return selection.without_empty(data.replace(spikes=data.spikes.where("sample_index < 300"))).units.select(*UNIT)


@query(f"WITH {SPIKES_SQL} SELECT sorting, unit_id FROM counts WHERE sorting = 'B' OR n_spikes * 30000.0::DOUBLE / 432000 >= 60")
def sorting_subset(spark: SparkSession, sf: str) -> DataFrame:
    """A step that is given some sortings leaves the others as they are."""
    from eventloom.pipeline import Pipeline

    steps = {"remove_bad_units": {"all": {"firing_rate": {"min": 60}, "sortings": ["A", "C"]}}}
    return Pipeline(surrogate.detectors(spark, sf), steps).run().units.select(*UNIT)


@query(
    f"""WITH {SPIKES_SQL}, a AS (SELECT unit_id, sample_index FROM spikes WHERE sorting = 'A' AND unit_id % 3 = 0), b AS (SELECT unit_id // 2 AS unit_id, sample_index FROM spikes WHERE sorting = 'A' AND unit_id % 3 = 1),
u AS (SELECT unit_id, EXISTS (FROM a WHERE a.unit_id = x.unit_id) AS clash FROM (SELECT DISTINCT unit_id FROM b) x), top AS (SELECT max(unit_id) AS m FROM (SELECT unit_id FROM a UNION ALL SELECT unit_id FROM b)),
r AS (SELECT unit_id, CASE WHEN clash THEN m + row_number() OVER (PARTITION BY clash ORDER BY unit_id) ELSE unit_id END AS new_id FROM u, top)
SELECT unit_id, sample_index FROM a UNION ALL SELECT new_id, sample_index FROM b JOIN r USING (unit_id)"""
)
def stacked_categories(spark: SparkSession, sf: str) -> DataFrame:
    """Results of two categories as one sorting: only ids that clash are new."""
    from eventloom.meta import dataset
    from eventloom.pipeline import Pipeline

    a = surrogate.detectors(spark, sf).spikes.where("sorting = 'A'")
    first = dataset(a.where("unit_id % 3 = 0"), META)
    second = dataset(a.where("unit_id % 3 = 1").withColumn("unit_id", F.floor(F.col("unit_id") / 2)), META)
    return Pipeline._stacked(first, second).spikes.select("unit_id", "sample_index")


# Pairs of trains.

PAIRS_SQL = f"""{SPIKES_SQL}, pairs AS (
  SELECT a.sorting AS s1, a.unit_id AS u1, b.sorting AS s2, b.unit_id AS u2, a.sample_index - b.sample_index AS d
  FROM spikes a JOIN spikes b ON a.sorting < b.sorting AND a.sample_index BETWEEN b.sample_index - 12 AND b.sample_index + 12
)"""
COINC_SQL = f"{PAIRS_SQL}, coinc AS (SELECT s1, u1, s2, u2, count(*)::BIGINT AS n_coinc FROM pairs WHERE abs(d) <= {WINDOW} GROUP BY ALL)"
COMPARED_SQL = f"""{COINC_SQL}, cmp AS (
  SELECT c.*, a.n_spikes AS n1, b.n_spikes AS n2, c.n_coinc / (a.n_spikes + b.n_spikes - c.n_coinc)::DOUBLE AS agreement
  FROM coinc c JOIN counts a ON a.sorting = s1 AND a.unit_id = u1 JOIN counts b ON b.sorting = s2 AND b.unit_id = u2
)"""


@query(f"WITH {COINC_SQL} SELECT * FROM coinc")
def coincidence(spark: SparkSession, sf: str) -> DataFrame:
    return bandjoin.coincidences(surrogate.detectors(spark, sf).spikes, WINDOW)


@query(f"WITH {PAIRS_SQL} SELECT s1, u1, s2, u2, count(*)::BIGINT AS n_coinc FROM pairs WHERE abs(d + CASE WHEN s2 = 'C' THEN 2 ELSE 1 END) <= {WINDOW} GROUP BY ALL")
def coincidence_shifted(spark: SparkSession, sf: str) -> DataFrame:
    data = surrogate.detectors(spark, sf)
    units = data.units.select(*UNIT)
    both = units.toDF("s1", "u1").join(units.toDF("s2", "u2"), F.col("s1") < F.col("s2"))
    shifts = both.withColumn("shift", F.when(F.col("s2") == "C", -2).otherwise(-1))
    return bandjoin.coincidences(data.spikes, WINDOW, shifts)


def _weight_sql(window: float, d: str) -> str:
    low, high, a, b = border_weights(window)
    return f"CASE WHEN {d} > {high} THEN 0 WHEN {d} = {high} THEN {b!r}::DOUBLE WHEN {d} = {low} THEN {a!r}::DOUBLE ELSE 1 END"


@query(f"WITH {PAIRS_SQL} SELECT s1, u1, s2, u2, round(sum({_weight_sql(2.4, 'abs(d)')}), 6) AS n_coinc FROM pairs WHERE abs(d) <= 3 GROUP BY ALL")
def fractional_coincidence(spark: SparkSession, sf: str) -> DataFrame:
    found = bandjoin.weighted_coincidences(surrogate.detectors(spark, sf).spikes, [2.4])
    return found.select(*bandjoin.PAIR, r6("c0").alias("n_coinc"))


VIOLATIONS_SQL = f"""{REFRACTORY_SQL}, o AS (
  SELECT unit_id, sample_index AS t, row_number() OVER (PARTITION BY unit_id ORDER BY sample_index) AS k FROM rf
), v AS (
  SELECT a.unit_id, sum({_weight_sql(5.5, '(b.t - a.t)')}) AS n_violations
  FROM o a JOIN o b ON a.unit_id = b.unit_id AND a.k < b.k AND b.t - a.t <= 6 GROUP BY ALL
), n AS (SELECT unit_id, count(*) AS n_spikes FROM rf GROUP BY ALL)"""


@query(f"WITH {VIOLATIONS_SQL} SELECT unit_id, round(n_violations, 6) AS n_violations FROM v")
def violations(spark: SparkSession, sf: str) -> DataFrame:
    found = bandjoin.violations(surrogate.refractory(spark, sf).spikes, 5.5)
    return found.select("unit_id", r6("n_violations").alias("n_violations"))


CONTAMINATION_SQL = f"""{VIOLATIONS_SQL}, q AS (
  SELECT unit_id, n_spikes, coalesce(n_violations, 0) AS nv FROM n LEFT JOIN v USING (unit_id)
), z AS (
  SELECT unit_id, n_spikes, 1 - nv * (432000 - 2 * n_spikes * 1.0::DOUBLE) / (n_spikes * n_spikes * 4.5::DOUBLE) AS left_ FROM q
), cont AS (
  SELECT unit_id, n_spikes, CASE WHEN left_ < 0 THEN 1 ELSE 1 - sqrt(greatest(left_, 0)) END AS contamination FROM z
)"""


@query(f"WITH {CONTAMINATION_SQL} SELECT unit_id, round(contamination, 6) AS contamination FROM cont")
def contamination(spark: SparkSession, sf: str) -> DataFrame:
    found = metrics.contaminations(surrogate.refractory(spark, sf), 1.0, 5.5)
    return found.select("unit_id", r6("value").alias("contamination"))


@query(f"WITH {CONTAMINATION_SQL} SELECT unit_id, round(n_spikes * 30000.0::DOUBLE / 432000 * (1 - 3.5 * contamination), 6) AS score FROM cont")
def quality_score(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.unit_scores(surrogate.refractory(spark, sf), 1.0, 5.5).select("unit_id", r6("score").alias("score"))


@query(
    f"""WITH {CONTAMINATION_SQL}, p AS (
  SELECT a.unit_id AS u1, b.unit_id AS u2,
    sum({_weight_sql(5.5, 'abs(a.sample_index - b.sample_index)')}) - sum({_weight_sql(1.0, 'abs(a.sample_index - b.sample_index)')}) AS nx
  FROM rf a JOIN rf b ON a.unit_id < b.unit_id AND a.sample_index BETWEEN b.sample_index - 6 AND b.sample_index + 6 GROUP BY ALL
) SELECT u1, u2, round(nx, 6) AS n_excess,
  round((nx * 432000 / (2 * c1.n_spikes * c2.n_spikes * 5.5::DOUBLE) - least(c1.contamination, c2.contamination))
    / CASE WHEN least(c1.contamination, c2.contamination) <> 1 THEN 1 - least(c1.contamination, c2.contamination) END, 6) AS estimate
FROM p JOIN cont c1 ON c1.unit_id = u1 JOIN cont c2 ON c2.unit_id = u2"""
)
def cross_contamination(spark: SparkSession, sf: str) -> DataFrame:
    data = surrogate.refractory(spark, sf)
    own = metrics.contaminations(data, 1.0, 5.5).select(*UNIT, "value")
    found = metrics.cross_contaminations(data.spikes, META.t_max, 1.0, 5.5, 0.1, own, same=True).where("u1 < u2")
    return found.select("u1", "u2", r6("n_excess").alias("n_excess"), r6("estimate").alias("estimate"))


def _tail_sql(x: str, n: str, p: str) -> str:
    """P(X > x) of a binomial with a real number n of trials: the incomplete beta function I_p(x + 1, n - x) as a finite sum, x being whole."""
    terms = f"list_sum(list_transform(range(0, greatest({x}, 0)::BIGINT + 1), lambda i: exp(lgamma({n} - {x} + i) - lgamma({n} - {x}) - lgamma(i + 1.0) + i * ln({p}))))"
    return f"CASE WHEN {x} < 0 THEN 1 WHEN {x} >= {n} THEN 0 ELSE greatest(0, 1 - exp(({n} - {x}) * ln(1 - {p})) * {terms}) END"


@query(
    f"""WITH {CONTAMINATION_SQL}, p AS (
  SELECT a.unit_id AS u1, b.unit_id AS u2,
    sum({_weight_sql(5.5, 'abs(a.sample_index - b.sample_index)')}) - sum({_weight_sql(1.0, 'abs(a.sample_index - b.sample_index)')}) AS nx
  FROM rf a JOIN rf b ON a.unit_id < b.unit_id AND a.sample_index BETWEEN b.sample_index - 6 AND b.sample_index + 6 GROUP BY ALL
), tried AS (
  SELECT u1, u2, (sign(nx - 1) * floor(abs(nx - 1)))::DOUBLE AS x, c1.n_spikes * c2.n_spikes * ((1 - least(c1.contamination, c2.contamination)) * 0.1::DOUBLE + least(c1.contamination, c2.contamination)) AS n
  FROM p JOIN cont c1 ON c1.unit_id = u1 JOIN cont c2 ON c2.unit_id = u2
) SELECT u1, u2, round({_tail_sql("x", "n", f"{11 / 432000!r}::DOUBLE")}, 6) AS p_value FROM tried"""
)
def cross_contamination_p_value(spark: SparkSession, sf: str) -> DataFrame:
    data = surrogate.refractory(spark, sf)
    own = metrics.contaminations(data, 1.0, 5.5).select(*UNIT, "value")
    found = metrics.with_p_value(metrics.cross_contaminations(data.spikes, META.t_max, 1.0, 5.5, 0.1, own, same=True).where("u1 < u2"))
    return found.select("u1", "u2", r6("p_value").alias("p_value"))


@query(f"WITH {PAIRS_SQL} SELECT s1, u1, s2, u2, floor(d / 4.0)::INT AS bin, count(*)::BIGINT AS n FROM pairs WHERE d < 12 GROUP BY ALL")
def cross_correlogram(spark: SparkSession, sf: str) -> DataFrame:
    return bandjoin.correlogram(surrogate.detectors(spark, sf).spikes, 12, 4)


@query(
    f"""WITH {SPIKES_SQL}, o AS (SELECT *, row_number() OVER () AS id FROM spikes)
SELECT a.sorting, a.unit_id, floor((a.sample_index - b.sample_index) / 50.0)::INT AS bin, count(*)::BIGINT AS n
FROM o a JOIN o b ON a.sorting = b.sorting AND a.unit_id = b.unit_id AND a.id <> b.id AND a.sample_index - b.sample_index >= -200 AND a.sample_index - b.sample_index < 200 GROUP BY ALL"""
)
def autocorrelogram(spark: SparkSession, sf: str) -> DataFrame:
    found = bandjoin.correlogram(surrogate.detectors(spark, sf).spikes, 200, 50, same=True).where("u1 = u2")
    return found.select(F.col("s1").alias("sorting"), F.col("u1").alias("unit_id"), "bin", "n")


KERNEL = ", ".join(f"({k - len(gaussian_kernel(1.5)) // 2}, {float(w)!r}::DOUBLE)" for k, w in enumerate(gaussian_kernel(1.5)))
SHIFT_SQL = f"""{PAIRS_SQL}, kern(o, w) AS (VALUES {KERNEL}), lags AS (
  SELECT s1, u1, s2, u2, d, count(*) AS n FROM pairs WHERE d < 12 GROUP BY ALL
), smooth AS (
  SELECT s1, u1, s2, u2, d + o AS lag, round(sum(n * w), 9) AS height FROM lags, kern WHERE d + o BETWEEN -12 AND 11 GROUP BY ALL
), top AS (
  SELECT *, row_number() OVER (PARTITION BY s1, u1, s2, u2 ORDER BY height DESC, lag) AS k FROM smooth
), shifts AS (
  SELECT s1, u1, s2, u2, CASE WHEN height >= 0.05 * least(a.n_spikes, b.n_spikes) THEN lag ELSE 0 END::INT AS shift
  FROM top JOIN counts a ON a.sorting = s1 AND a.unit_id = u1 JOIN counts b ON b.sorting = s2 AND b.unit_id = u2 WHERE k = 1
)"""


@query(f"WITH {SHIFT_SQL} SELECT * FROM shifts")
def cross_shift(spark: SparkSession, sf: str) -> DataFrame:
    return trains.cross_shifts(surrogate.detectors(spark, sf).spikes, MAX_SHIFT)


@query(f"WITH {COMPARED_SQL} SELECT s1, u1, s2, u2, round(agreement, 6) AS agreement FROM cmp")
def agreement(spark: SparkSession, sf: str) -> DataFrame:
    found = metrics.compared(surrogate.detectors(spark, sf), WINDOW)
    return found.select(*bandjoin.PAIR, r6("agreement").alias("agreement"))


@query(
    f"""WITH {COMPARED_SQL}, e AS (
  SELECT *, n_coinc / least(n1, n2)::DOUBLE AS s, n1 * n2 * 7.0::DOUBLE / (432000.0::DOUBLE * least(n1, n2)) AS e FROM cmp
) SELECT s1, u1, s2, u2, round((s - e) / (1 - e), 6) AS similarity FROM e"""
)
def similarity(spark: SparkSession, sf: str) -> DataFrame:
    found = metrics.compared(surrogate.detectors(spark, sf), WINDOW)
    return found.select(*bandjoin.PAIR, r6("similarity").alias("similarity"))


# Graphs.

GRAPH_SQL = f"""{COMPARED_SQL}, edges AS (SELECT * FROM cmp WHERE agreement >= 0.3), ways AS (
  SELECT s1 || u1 AS a, s2 || u2 AS b FROM edges UNION SELECT s2 || u2, s1 || u1 FROM edges
), reach AS (
  SELECT sorting || unit_id AS a, sorting || unit_id AS b FROM counts UNION SELECT r.a, w.b FROM reach r JOIN ways w ON r.b = w.a
), nodes AS (
  SELECT n.sorting, n.unit_id, min(m.sorting || '/' || lpad(m.unit_id::VARCHAR, 4, '0')) AS component, count(DISTINCT m.sorting) AS n_sortings
  FROM reach r JOIN counts n ON r.a = n.sorting || n.unit_id JOIN counts m ON r.b = m.sorting || m.unit_id GROUP BY ALL
)"""


def _component() -> Column:
    return F.concat_ws("/", F.col("component.sorting"), F.lpad(F.col("component.unit_id").cast("string"), 4, "0"))


@query(f"WITH RECURSIVE {GRAPH_SQL} SELECT s1, u1, s2, u2, round(agreement, 6) AS agreement FROM edges JOIN nodes n ON n.sorting = s1 AND n.unit_id = u1 WHERE n_sortings >= 2")
def similarity_graph(spark: SparkSession, sf: str) -> DataFrame:
    data = surrogate.detectors(spark, sf)
    _, edges = graph.similarity_graph(data.units.select(*UNIT), metrics.compared(data, WINDOW), 0.3, 2)
    return edges.select(*bandjoin.PAIR, r6("agreement").alias("agreement"))


@query(f"WITH RECURSIVE {GRAPH_SQL} SELECT sorting, unit_id, component FROM nodes")
def components(spark: SparkSession, sf: str) -> DataFrame:
    data = surrogate.detectors(spark, sf)
    found = graph.components(data.units, metrics.compared(data, WINDOW).where("agreement >= 0.3"))
    return found.select(*UNIT, _component().alias("component"))


@query(
    f"""WITH {COMPARED_SQL}, edges AS (SELECT * FROM cmp WHERE agreement >= 0.3), ways AS (
  SELECT s1 AS s, u1 AS u, s2 AS os, u2 AS ou FROM edges UNION ALL SELECT s2, u2, s1, u1 FROM edges
) SELECT a.s AS s, a.u AS u, a.os AS other_s, a.ou AS v1, b.ou AS v2 FROM ways a JOIN ways b ON a.s = b.s AND a.u = b.u AND a.os = b.os AND a.ou < b.ou"""
)
def merged_unit_candidates(spark: SparkSession, sf: str) -> DataFrame:
    edges = graph.settle(metrics.compared(surrogate.detectors(spark, sf), WINDOW).where("agreement >= 0.3"))
    return graph.neighbour_pairs(edges).select("s", "u", "other_s", "v1", "v2")


def _dirt_sql(name: str, censored: float, refractory: float) -> str:
    """CTEs that give name(sorting, unit_id, n_spikes, c): the contamination of every unit of spikes."""
    return f"""{name}_o AS (
  SELECT *, row_number() OVER (PARTITION BY sorting, unit_id ORDER BY sample_index) AS k FROM spikes
), {name}_v AS (
  SELECT a.sorting, a.unit_id, sum({_weight_sql(refractory, '(b.sample_index - a.sample_index)')}) AS nv FROM {name}_o a JOIN {name}_o b
  ON a.sorting = b.sorting AND a.unit_id = b.unit_id AND a.k < b.k AND b.sample_index - a.sample_index <= {math.ceil(refractory)} GROUP BY ALL
), {name}_l AS (
  SELECT sorting, unit_id, n_spikes, 1 - coalesce(nv, 0) * (432000 - 2 * n_spikes * {censored!r}::DOUBLE) / (n_spikes * n_spikes * {refractory - censored!r}::DOUBLE) AS left_
  FROM counts LEFT JOIN {name}_v USING (sorting, unit_id)
), {name} AS (
  SELECT sorting, unit_id, n_spikes, CASE WHEN left_ < 0 THEN 1 ELSE 1 - sqrt(greatest(left_, 0)) END AS c FROM {name}_l
)"""


def _cross_sql(name: str, wanted: str, censored: float, refractory: float, limit: float, dirt: str, reference: str) -> str:
    """CTEs that give name(s1, u1, s2, u2, shift, estimate, p_value) of wanted pairs; reference: the contamination that counts, of a (unit 1) and b."""
    p, d = f"{2 * refractory / 432000!r}::DOUBLE", "abs(x.sample_index - shift - y.sample_index)"
    return f"""{name}_n AS (
  SELECT s1, u1, s2, u2, shift, sum({_weight_sql(refractory, d)}) - sum({_weight_sql(censored, d)}) AS nx
  FROM {wanted} JOIN spikes x ON x.sorting = s1 AND x.unit_id = u1 JOIN spikes y ON y.sorting = s2 AND y.unit_id = u2
    AND x.sample_index - shift BETWEEN y.sample_index - {math.ceil(refractory)} AND y.sample_index + {math.ceil(refractory)} GROUP BY ALL
), {name}_q AS (
  SELECT w.*, coalesce(nx, 0) AS nx, {reference} AS c, a.n_spikes * b.n_spikes AS trials FROM {wanted} w LEFT JOIN {name}_n USING (s1, u1, s2, u2, shift)
  JOIN {dirt} a ON a.sorting = s1 AND a.unit_id = u1 JOIN {dirt} b ON b.sorting = s2 AND b.unit_id = u2
), {name}_x AS (
  SELECT *, (sign(nx - 1) * floor(abs(nx - 1)))::DOUBLE AS x, trials * ((1 - c) * {limit!r}::DOUBLE + c) AS n FROM {name}_q
), {name} AS (
  SELECT s1, u1, s2, u2, shift, (nx * 432000 / (2 * trials * {refractory!r}::DOUBLE) - c) / CASE WHEN c <> 1 THEN 1 - c END AS estimate, {_tail_sql("x", "n", p)} AS p_value FROM {name}_x
)"""


MERGED_SQL = f"""{COMPARED_SQL.replace(SPIKES_SQL, MERGING_SQL)}, edges AS (SELECT * FROM cmp WHERE agreement >= 0.3), {_dirt_sql("dirt", 1.0, 30.0)}, {_dirt_sql("longer", 12.0, 54.0)}, ways AS (
  SELECT s1 AS s, u1 AS u, s2 AS os, u2 AS ou FROM edges UNION ALL SELECT s2, u2, s1, u1 FROM edges
), trio AS (
  SELECT a.s, a.u, a.os, a.ou AS v1, b.ou AS v2, CASE WHEN a.s = 'M' THEN 2 WHEN a.os = 'M' THEN -2 ELSE 0 END AS shift FROM ways a JOIN ways b ON a.s = b.s AND a.u = b.u AND a.os = b.os AND a.ou < b.ou
), two AS (
  SELECT DISTINCT os AS s1, v1 AS u1, os AS s2, v2 AS u2, 0 AS shift FROM trio
), each AS (
  SELECT DISTINCT s AS s1, u AS u1, os AS s2, v1 AS u2, shift FROM trio UNION SELECT s, u, os, v2, shift FROM trio
), {_cross_sql("inside", "two", 1.0, 30.0, 0.1, "dirt", "least(a.c, b.c)")}, {_cross_sql("near", "each", 12.0, 54.0, 0.1, "longer", "a.c")}, j AS (
  SELECT t.*, i.p_value, x.c, 1 + (t.u % 4) * 0.1::DOUBLE AS sd, a.c AS c1, 1 + (v1 % 4) * 0.1::DOUBLE AS sd1, b.c AS c2, 1 + (v2 % 4) * 0.1::DOUBLE AS sd2,
    CASE WHEN b.c < a.c THEN n2.p_value ELSE n1.p_value END AS pa, CASE WHEN b.c < a.c THEN n1.p_value ELSE n2.p_value END AS pb,
    CASE WHEN b.c < a.c THEN n2.estimate ELSE n1.estimate END AS ea, CASE WHEN b.c < a.c THEN n1.estimate ELSE n2.estimate END AS eb
  FROM trio t JOIN inside i ON i.s1 = os AND i.u1 = v1 AND i.u2 = v2
  JOIN near n1 ON n1.s1 = s AND n1.u1 = u AND n1.s2 = os AND n1.u2 = v1 JOIN near n2 ON n2.s1 = s AND n2.u1 = u AND n2.s2 = os AND n2.u2 = v2
  JOIN dirt x ON x.sorting = s AND x.unit_id = u JOIN dirt a ON a.sorting = os AND a.unit_id = v1 JOIN dirt b ON b.sorting = os AND b.unit_id = v2
), k AS (
  SELECT *, CASE WHEN p_value > 5e-3 THEN 'split' WHEN c > greatest(c1, c2) AND (p_value < 1e-8 OR (p_value < 5e-3 AND sd > greatest(sd1, sd2))) THEN 'node'
    WHEN pa < 5e-3 AND eb < 0.1 AND c1 > c + 0.03::DOUBLE THEN 'neighbour 1' WHEN pb < 5e-3 AND ea < 0.1 AND c2 > c + 0.03::DOUBLE THEN 'neighbour 2' ELSE 'unclear' END AS verdict FROM j
), f AS (
  SELECT *, coalesce(max((verdict = 'node')::INT) OVER (PARTITION BY s, u ORDER BY os, v1, v2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS late FROM k
)"""


def _merging_graph(spark: SparkSession, sf: str):
    data = surrogate.merging_detectors(spark, sf)
    units = graph.settle(data.units.select(*UNIT))
    shifts = units.toDF("s1", "u1").join(units.toDF("s2", "u2"), F.col("s1") < F.col("s2")).withColumn("shift", F.when(F.col("s1") == "M", 2).otherwise(0))
    edges = graph.settle(metrics.compared(data, WINDOW).where("agreement >= 0.3"))
    nodes = metrics.contaminations(data, 1.0, 30.0).select(*UNIT, F.col("value").alias("contamination"), (1 + (F.col("unit_id") % 4) * F.lit(0.1)).alias("sd_ratio"))
    return graph.merged_units(data, edges, nodes, graph.settle(shifts), 1.0, 30.0, 0.1)


@query(f"WITH {MERGED_SQL} SELECT s, u, os AS other_s, v1, v2, verdict FROM f WHERE late = 0")
def merged_unit_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """What is said of each node with two neighbours of one sorting: split, node, neighbour 1 or 2, unclear."""
    return _merging_graph(spark, sf)[1].select("s", "u", "other_s", "v1", "v2", "verdict")


@query(f"WITH {MERGED_SQL} SELECT s AS sorting, u AS unit_id FROM f WHERE late = 0 AND verdict = 'node' UNION SELECT os, v1 FROM f WHERE late = 0 AND verdict = 'neighbour 1' UNION SELECT os, v2 FROM f WHERE late = 0 AND verdict = 'neighbour 2'")
def merged_units(spark: SparkSession, sf: str) -> DataFrame:
    """The units that go from the graph because they merge two neurons, or because their like shows them to be dirty."""
    return _merging_graph(spark, sf)[0]


CLEAN_SQL = f"""{COMPARED_SQL}, nodes AS (
  SELECT sorting, unit_id, (unit_id % 5) * 0.05::DOUBLE AS contamination, 1 + (unit_id % 4) * 0.1::DOUBLE AS sd_ratio FROM counts
), edges AS (
  SELECT s1, u1, s2, u2, agreement, n_coinc / least(n1, n2)::DOUBLE AS similarity, ((u1 + u2) % 6) * 0.06::DOUBLE AS temp_diff, ((u1 * u2) % 7) * 0.03::DOUBLE AS corr_diff, ((u1 + 2 * u2) % 10) * 0.1::DOUBLE AS p_value
  FROM cmp WHERE agreement >= 0.1
), j AS (
  SELECT e.*, a.contamination AS c1, a.sd_ratio AS sd1, b.contamination AS c2, b.sd_ratio AS sd2,
    (p_value < 5e-3 AND temp_diff > 0.10 AND corr_diff > 0.12) OR (p_value < 0.8 AND similarity < 0.6 AND temp_diff > 0.05 AND corr_diff > 0.05) OR temp_diff > 0.25 AS problem
  FROM edges e JOIN nodes a ON a.sorting = s1 AND a.unit_id = u1 JOIN nodes b ON b.sorting = s2 AND b.unit_id = u2
), k AS (
  SELECT *, CASE WHEN problem AND sd1 - sd2 > (c2 - c1) * {0.2 / 0.08!r}::DOUBLE + 0.2::DOUBLE AND sd1 > 1.05::DOUBLE THEN 'node1'
    WHEN problem AND sd2 - sd1 > (c1 - c2) * {0.2 / 0.08!r}::DOUBLE + 0.2::DOUBLE AND sd2 > 1.05::DOUBLE THEN 'node2' WHEN problem THEN 'edge' ELSE 'keep' END AS action FROM j
), gone AS (
  SELECT s1 AS s, u1 AS u FROM k WHERE action = 'node1' OR (agreement < 0.5 AND c1 > 0.15::DOUBLE)
  UNION SELECT s2, u2 FROM k WHERE action = 'node2' OR (agreement < 0.5 AND c2 > 0.15::DOUBLE)
)"""


@query(f"WITH {CLEAN_SQL} SELECT s1, u1, s2, u2 FROM k WHERE action = 'keep' AND NOT EXISTS (FROM gone WHERE s = s1 AND u = u1) AND NOT EXISTS (FROM gone WHERE s = s2 AND u = u2)")
def clean_edges(spark: SparkSession, sf: str) -> DataFrame:
    data = surrogate.detectors(spark, sf)
    nodes = data.units.select(*UNIT, ((F.col("unit_id") % 5) * F.lit(0.05)).alias("contamination"), (1 + (F.col("unit_id") % 4) * F.lit(0.1)).alias("sd_ratio"))
    e = metrics.compared(data, WINDOW, chance=False).where("agreement >= 0.1")
    e = e.withColumn("temp_diff", ((F.col("u1") + F.col("u2")) % 6) * F.lit(0.06)).withColumn("corr_diff", ((F.col("u1") * F.col("u2")) % 7) * F.lit(0.03))
    e = e.withColumn("p_value", ((F.col("u1") + 2 * F.col("u2")) % 10) * F.lit(0.1))
    _, edges, _ = graph.clean_edges(nodes, e)
    return edges.select(*bandjoin.PAIR)


@query(
    f"""WITH RECURSIVE {GRAPH_SQL}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY component ORDER BY n_spikes DESC, sorting, unit_id) AS k FROM nodes JOIN counts USING (sorting, unit_id)
) SELECT component, sorting, unit_id, n_spikes::DOUBLE AS score FROM ranked WHERE k = 1"""
)
def best_unit_per_component(spark: SparkSession, sf: str) -> DataFrame:
    data = surrogate.detectors(spark, sf)
    members = graph.components(data.units, metrics.compared(data, WINDOW).where("agreement >= 0.3"))
    scores = unit_counts(data.spikes).select(*UNIT, F.col("n_spikes").cast("double").alias("score"))
    return graph.best_per_component(members, scores).select(_component().alias("component"), *UNIT, "score")


SELF_SQL = f"""{SPIKES_SQL}, self AS (
  SELECT a.sorting AS s1, a.unit_id AS u1, b.unit_id AS u2, count(*) AS n_coinc
  FROM spikes a JOIN spikes b ON a.sorting = b.sorting AND a.unit_id < b.unit_id AND a.sample_index BETWEEN b.sample_index - {WINDOW} AND b.sample_index + {WINDOW} GROUP BY ALL
), near AS (
  SELECT s1, u1, u2, n_coinc / least(a.n_spikes, b.n_spikes)::DOUBLE AS similarity, n_coinc / (a.n_spikes + b.n_spikes - n_coinc)::DOUBLE AS agreement
  FROM self JOIN counts a ON a.sorting = s1 AND a.unit_id = u1 JOIN counts b ON b.sorting = s1 AND b.unit_id = u2
)"""


@query(f"WITH {SELF_SQL} SELECT s1, u1, u2, round(similarity, 6) AS similarity FROM near WHERE similarity >= 0.02")
def redundant_pairs(spark: SparkSession, sf: str) -> DataFrame:
    data = surrogate.detectors(spark, sf)
    rank = unit_counts(data.spikes).withColumnRenamed("n_spikes", "value")
    _, pairs = merging.redundant_units(data, WINDOW, 0.02, rank)
    return pairs.select("s1", "u1", "u2", r6("similarity").alias("similarity"))


@query(
    f"""WITH RECURSIVE {REFRACTORY_SQL}, spikes AS (
  SELECT unit_id, sample_index FROM rf UNION ALL SELECT unit_id + 100, sample_index FROM rf WHERE unit_id < 4 AND sample_index % 5 <> 0
  UNION ALL SELECT unit_id + 200, sample_index FROM rf WHERE unit_id BETWEEN 4 AND 7 AND sample_index % 4 = 0
), o AS (
  SELECT unit_id, sample_index AS t, row_number() OVER (PARTITION BY unit_id ORDER BY sample_index) AS k FROM spikes
), v AS (
  SELECT a.unit_id, sum({_weight_sql(5.5, '(b.t - a.t)')}) AS nv FROM o a JOIN o b ON a.unit_id = b.unit_id AND a.k < b.k AND b.t - a.t <= 6 GROUP BY ALL
), n AS (
  SELECT unit_id, count(*) AS n_spikes FROM spikes GROUP BY ALL
), z AS (
  SELECT unit_id, n_spikes, 1 - coalesce(nv, 0) * (432000 - 2 * n_spikes * 1.0::DOUBLE) / (n_spikes * n_spikes * 4.5::DOUBLE) AS left_ FROM n LEFT JOIN v USING (unit_id)
), scores AS (
  SELECT unit_id, n_spikes, n_spikes * (1 - 3.5 * CASE WHEN left_ < 0 THEN 1 ELSE 1 - sqrt(greatest(left_, 0)) END) AS score FROM z
), near AS (
  SELECT a.unit_id AS u1, b.unit_id AS u2, count(*) AS nc FROM spikes a JOIN spikes b ON a.unit_id < b.unit_id AND a.sample_index BETWEEN b.sample_index - {WINDOW} AND b.sample_index + {WINDOW} GROUP BY ALL
), pairs AS (
  SELECT u1, u2, nc / (a.n_spikes + b.n_spikes - nc)::DOUBLE AS agreement, nc / least(a.n_spikes, b.n_spikes)::DOUBLE AS similarity, a.score AS score1, b.score AS score2
  FROM near JOIN scores a ON a.unit_id = u1 JOIN scores b ON b.unit_id = u2
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY u2, u1) AS k FROM pairs WHERE agreement > 0.5
), g AS (
  SELECT 0::BIGINT AS k, []::BIGINT[] AS gone
  UNION ALL SELECT r.k, CASE WHEN list_contains(gone, u1) OR list_contains(gone, u2) THEN gone ELSE list_append(gone, CASE WHEN score2 > score1 THEN u1 ELSE u2 END) END FROM g JOIN ranked r ON r.k = g.k + 1
), left_ AS (
  SELECT unit_id, score FROM scores WHERE NOT list_contains((SELECT gone FROM g ORDER BY k DESC LIMIT 1), unit_id)
), links AS (
  SELECT u1 AS a, u2 AS b FROM pairs WHERE similarity > 0.75 AND u1 IN (SELECT unit_id FROM left_) AND u2 IN (SELECT unit_id FROM left_)
), reach AS (
  SELECT unit_id AS a, unit_id AS b FROM left_ UNION SELECT r.a, w.b FROM reach r JOIN (FROM links UNION ALL SELECT b, a FROM links) w(a, b) ON r.b = w.a
), groups AS (
  SELECT a AS unit_id, min(b) AS component FROM reach GROUP BY ALL
) SELECT 'V' AS sorting, unit_id FROM groups JOIN left_ USING (unit_id) QUALIFY row_number() OVER (PARTITION BY component ORDER BY score DESC, unit_id) = 1"""
)
def remove_redundant(spark: SparkSession, sf: str) -> DataFrame:
    return merging.remove_redundant(graph.settled(surrogate.redundant_sorting(spark, sf)), WINDOW, 1.0, 5.5)


@query(
    f"""WITH RECURSIVE {REFRACTORY_SQL}, spikes AS (
  SELECT unit_id, sample_index FROM rf UNION ALL SELECT unit_id + 100, sample_index FROM rf WHERE unit_id < 4 AND sample_index % 5 <> 0
  UNION ALL SELECT unit_id + 200, sample_index FROM rf WHERE unit_id BETWEEN 4 AND 7 AND sample_index % 4 = 0
), n AS (
  SELECT unit_id, count(*) AS n FROM spikes GROUP BY ALL
), near AS (
  SELECT a.unit_id AS u1, b.unit_id AS u2, count(*) AS nc FROM spikes a JOIN spikes b ON a.unit_id < b.unit_id AND a.sample_index BETWEEN b.sample_index - {WINDOW} AND b.sample_index + {WINDOW} GROUP BY ALL
), ranked AS (
  SELECT u1, u2, a.n AS n1, b.n AS n2, row_number() OVER (ORDER BY u2, u1) AS k FROM near JOIN n a ON a.unit_id = u1 JOIN n b ON b.unit_id = u2
  WHERE nc / least(a.n, b.n)::DOUBLE >= 0.7 AND nc / (a.n + b.n - nc)::DOUBLE >= 0.3
), g AS (
  SELECT 0::BIGINT AS k, []::BIGINT[] AS gone
  UNION ALL SELECT r.k, CASE WHEN list_contains(gone, u1) OR list_contains(gone, u2) THEN gone ELSE list_append(gone, CASE WHEN n2 > n1 THEN u1 ELSE u2 END) END FROM g JOIN ranked r ON r.k = g.k + 1
) SELECT 'V' AS sorting, unnest((SELECT gone FROM g ORDER BY k DESC LIMIT 1)) AS unit_id"""
)
def redundant_units(spark: SparkSession, sf: str) -> DataFrame:
    """The units that go because a larger one of their sorting has most of their events."""
    data = graph.settled(surrogate.redundant_sorting(spark, sf))
    rank = unit_counts(data.spikes).withColumnRenamed("n_spikes", "value")
    return merging.redundant_units(data, WINDOW, 0.7, rank, 0.3)[0]


@query()
def communities(spark: SparkSession, sf: str) -> DataFrame:
    data = surrogate.detectors(spark, sf)
    edges = graph.settle(metrics.compared(data, WINDOW).where("agreement >= 0.05"))
    _, kept, _ = graph.separate_communities(data.units.select(*UNIT), edges, 1)
    return kept.select(*bandjoin.PAIR, r6("agreement").alias("agreement"))


@query(
    f"""WITH RECURSIVE {REFRACTORY_SQL}, o AS (
  SELECT unit_id % 6 AS p, sample_index AS t, row_number() OVER (PARTITION BY unit_id % 6 ORDER BY sample_index) AS k FROM rf
), f AS (
  SELECT p, k, t AS last, true AS keep FROM o WHERE k = 1
  UNION ALL SELECT o.p, o.k, CASE WHEN o.t - f.last > 2 THEN o.t ELSE f.last END, o.t - f.last > 2 FROM f JOIN o ON o.p = f.p AND o.k = f.k + 1
), trains AS (
  SELECT unit_id % 6 AS p, unit_id AS name, sample_index AS t FROM rf UNION ALL SELECT p, -1, last FROM f WHERE keep
), n AS (
  SELECT p, name, count(*) AS n FROM trains GROUP BY ALL
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY p, name ORDER BY t) AS k FROM trains
), v AS (
  SELECT a.p, a.name, sum({_weight_sql(5.5, '(b.t - a.t)')}) AS nv FROM numbered a JOIN numbered b ON a.p = b.p AND a.name = b.name AND a.k < b.k AND b.t - a.t <= 6 GROUP BY ALL
), z AS (
  SELECT p, name, n, 1 - coalesce(nv, 0) * (432000 - 2 * n * 1.0::DOUBLE) / (n * n * 4.5::DOUBLE) AS left_ FROM n LEFT JOIN v USING (p, name)
), best AS (
  SELECT p, name FROM z QUALIFY row_number() OVER (PARTITION BY p ORDER BY n * (1 - 3.5 * CASE WHEN left_ < 0 THEN 1 ELSE 1 - sqrt(greatest(left_, 0)) END) DESC, name = -1, name) = 1
) SELECT 'V' AS sorting, CASE WHEN name = -1 THEN p ELSE name END AS unit_id, t AS sample_index FROM best JOIN trains USING (p, name)"""
)
def merge_split_units(spark: SparkSession, sf: str) -> DataFrame:
    data = surrogate.refractory(spark, sf)
    units = data.units.select(*UNIT)
    pairs = units.toDF("s1", "u1").join(units.toDF("s2", "u2"), (F.col("s1") == F.col("s2")) & (F.col("u2") == F.col("u1") + 6))
    return merging.merge_split_units(data, graph.settle(pairs), 1.0, 5.5, 2.0)[0]


@query(f"WITH {SPIKES_SQL}, s AS (SELECT sorting, unit_id, n_spikes, (unit_id * 7) % 5 AS m FROM counts), p AS (SELECT a.sorting AS s1, a.unit_id AS u1, b.unit_id AS u2, a.n_spikes AS n1, b.n_spikes AS n2, (a.n_spikes + b.n_spikes) // 2 AS merged FROM s a JOIN s b ON a.sorting = b.sorting AND b.unit_id = a.unit_id + 1) SELECT DISTINCT s1 AS sorting, CASE WHEN n1 < n2 THEN u1 ELSE u2 END AS unit_id FROM p WHERE merged < greatest(n1, n2)")
def remove_splits(spark: SparkSession, sf: str) -> DataFrame:
    counts = unit_counts(surrogate.detectors(spark, sf).spikes)
    scores = counts.select(*UNIT, F.col("n_spikes").alias("score"))
    one, two = counts.toDF("s1", "u1", "n1"), counts.toDF("s2", "u2", "n2")
    pairs = one.join(two, (F.col("s1") == F.col("s2")) & (F.col("u2") == F.col("u1") + 1))
    return merging.remove_splits(pairs.select("s1", "u1", "s2", "u2", F.floor((F.col("n1") + F.col("n2")) / 2).alias("merged_score")), scores)


@query(
    f"""WITH RECURSIVE {REFRACTORY_SQL}, three AS (
  SELECT 'V' AS sorting, unit_id, sample_index FROM rf UNION ALL SELECT 'W', unit_id, sample_index + sample_index % 2 FROM rf WHERE sample_index % 10 <> 0
  UNION ALL SELECT 'X', unit_id, sample_index + 2 FROM rf WHERE sample_index % 7 <> 0
), spikes AS (
  SELECT *, sample_index - CASE WHEN sorting = 'X' THEN 2 ELSE 0 END AS t FROM three WHERE sample_index BETWEEN 0 AND 431999
), counts AS (
  SELECT sorting, unit_id, count(*) AS n_spikes FROM spikes GROUP BY ALL
), {_dirt_sql("dirt", 2.0, 5.5)}, ways AS (
  SELECT a.sorting AS s1, a.unit_id AS u1, b.sorting AS s2, b.unit_id AS u2, count(*) AS n FROM spikes a JOIN spikes b ON a.sorting <> b.sorting AND a.t BETWEEN b.t - {WINDOW} AND b.t + {WINDOW} GROUP BY ALL
), links AS (
  SELECT s1 || '/' || u1 AS a, s2 || '/' || u2 AS b FROM ways JOIN counts x ON x.sorting = s1 AND x.unit_id = u1 JOIN counts y ON y.sorting = s2 AND y.unit_id = u2 WHERE n / (x.n_spikes + y.n_spikes - n)::DOUBLE >= 0.3
), reach AS (
  SELECT sorting || '/' || unit_id AS a, sorting || '/' || unit_id AS b FROM counts UNION SELECT r.a, w.b FROM reach r JOIN links w ON r.b = w.a
), members AS (
  SELECT c.sorting, c.unit_id, min(m.sorting || '/' || lpad(m.unit_id::VARCHAR, 4, '0')) AS component, count(*) AS size
  FROM reach r JOIN counts c ON r.a = c.sorting || '/' || c.unit_id JOIN counts m ON r.b = m.sorting || '/' || m.unit_id GROUP BY ALL HAVING count(*) >= 2
), clocked AS (
  -- On the clock of the component's first unit, which may itself be of X.
  SELECT component, size, sorting, unit_id, t + CASE WHEN component LIKE 'X%' THEN 2 ELSE 0 END AS t FROM spikes JOIN members USING (sorting, unit_id)
), gaps AS (
  SELECT component, size, t, coalesce(t - lag(t) OVER (PARTITION BY component ORDER BY t) > 1, true)::INT AS fresh FROM clocked
), runs AS (
  SELECT component, size, t, sum(fresh) OVER (PARTITION BY component ORDER BY t) AS run FROM gaps
), common AS (
  SELECT component, round_even(avg(t), 0)::BIGINT AS t FROM runs GROUP BY component, size, run HAVING count(*) >= ceil(sqrt(size))
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY component ORDER BY t) AS k FROM common
), broken AS (
  SELECT a.component, sum({_weight_sql(5.5, '(b.t - a.t)')}) AS nv FROM numbered a JOIN numbered b ON a.component = b.component AND a.k < b.k AND b.t - a.t <= 6 GROUP BY ALL
), pooled AS (
  SELECT component, count(*) AS n, 1 - coalesce(any_value(nv), 0) * (432000 - 2 * count(*) * 2.0::DOUBLE) / (count(*) * count(*) * 3.5::DOUBLE) AS left_ FROM common LEFT JOIN broken USING (component) GROUP BY component
), candidates AS (
  SELECT component, sorting, unit_id, n_spikes * 30000.0::DOUBLE / 432000 * (1 - 3.5 * c) AS score FROM members JOIN dirt USING (sorting, unit_id)
  UNION ALL SELECT component, NULL, NULL, n * 30000.0::DOUBLE / 432000 * (1 - 3.5 * CASE WHEN left_ < 0 THEN 1 ELSE 1 - sqrt(greatest(left_, 0)) END) FROM pooled
), best AS (
  SELECT * FROM candidates QUALIFY row_number() OVER (PARTITION BY component ORDER BY score DESC, sorting IS NULL, sorting, unit_id) = 1
)
SELECT component, b.sorting || ':' || b.unit_id AS label, t AS sample_index FROM best b JOIN clocked USING (component, sorting, unit_id)
UNION ALL SELECT component, 'consensus', t FROM best b JOIN common USING (component) WHERE b.sorting IS NULL"""
)
def best_trains(spark: SparkSession, sf: str) -> DataFrame:
    """The train of each component of three detectors: its best unit's on the clock of its first unit, or the consensus."""
    data = graph.settled(surrogate.refractory_detectors(spark, sf))
    units = data.units.select(*UNIT)
    shifts = graph.settle(units.toDF("s1", "u1").join(units.toDF("s2", "u2"), F.col("s1") < F.col("s2")).withColumn("shift", F.when(F.col("s2") == "X", -2).otherwise(0)))
    edges = graph.settle(metrics.compared(data, WINDOW, shifts).where("agreement >= 0.3"))
    scores = graph.settle(metrics.unit_scores(data, 2.0, 5.5))
    trains_, choice = merging.merge_components(data, graph.components(data.units, edges), shifts, scores, 2.0, 5.5, 2)
    return trains_.join(choice, "component").select(_component().alias("component"), "label", "sample_index")


@query()
def merged_sorting(spark: SparkSession, sf: str) -> DataFrame:
    """The whole linkage of three detectors by the pipeline."""
    from eventloom.pipeline import Pipeline

    steps = {"remove_duplicated_spikes": {"all": {"censored_period": 0.05}}, "merge_sortings": {"all": {"refractory_period": [0.05, 0.2], "similarity": {"window": 0.1}, "max_shift": 0.4}}}
    return Pipeline(surrogate.refractory_detectors(spark, sf), steps).run().spikes


# Rules, tags and ids.


def _tagged(spark: SparkSession, sf: str):
    data = surrogate.detectors(spark, sf)
    tag = F.when(F.col("unit_id") % 3 == 0, "x").when(F.col("unit_id") % 3 == 1, "y")
    return data.replace(units=data.units.withColumn("category", tag))


@query(f"WITH {SPIKES_SQL} SELECT sorting, unit_id FROM counts WHERE unit_id % 3 <> 1")
def category_select(spark: SparkSession, sf: str) -> DataFrame:
    return _tagged(spark, sf).units.where(selection.category_filter("rest+x")).select(*UNIT)


@query(f"WITH {SPIKES_SQL} SELECT unit_id % 3 = 1 AS selected, sorting, count(*)::BIGINT AS n_spikes FROM spikes GROUP BY ALL")
def sorting_split(spark: SparkSession, sf: str) -> DataFrame:
    inside, outside = selection.split_dataset(_tagged(spark, sf), selection.category_filter("y"))
    both = inside.spikes.withColumn("selected", F.lit(True)).union(outside.spikes.withColumn("selected", F.lit(False)))
    return both.groupBy("selected", "sorting").agg(F.count(F.lit(1)).alias("n_spikes"))


RATES_SQL = f"{ISI_SQL}, m AS (SELECT sorting, unit_id, n_spikes * 30000.0::DOUBLE / 432000 AS rate, (SELECT avg((isi > 60 AND isi < 900)::INT::DOUBLE) FILTER (isi IS NOT NULL) FROM isi i WHERE i.sorting = c.sorting AND i.unit_id = c.unit_id) AS portion FROM counts c)"


@query(f"WITH {RATES_SQL} SELECT sorting, unit_id, CASE WHEN unit_id % 3 = 0 THEN 'x' WHEN unit_id % 3 = 1 THEN 'y' WHEN rate > 60 AND portion > 0.1::DOUBLE AND portion < 0.9::DOUBLE THEN 'busy' WHEN rate < 60 THEN 'calm' END AS category FROM m")
def categorize_units(spark: SparkSession, sf: str) -> DataFrame:
    rules = {"busy": {"firing_rate": {"min": 60}, "ISI_portion": {"min": 0.1, "max": 0.9, "range": [2, 30]}}, "calm": {"firing_rate": {"max": 60}}}
    return selection.categorise(_tagged(spark, sf), rules).select(*UNIT, "category")


@query(f"WITH {RATES_SQL}, b AS (SELECT sorting, unit_id, concat_ws(' ; ', CASE WHEN rate > 60 THEN 'firing_rate > 60' END, CASE WHEN portion < 0.5::DOUBLE THEN 'ISI_portion < 0.5' END) AS reasons FROM m) SELECT * FROM b WHERE reasons <> ''")
def bad_units(spark: SparkSession, sf: str) -> DataFrame:
    return selection.bad_units(surrogate.detectors(spark, sf), {"firing_rate": {"max": 60}, "ISI_portion": {"min": 0.5, "range": [2, 30]}})


@query(
    f"""WITH {SPIKES_SQL}, a AS (SELECT unit_id FROM counts WHERE sorting = 'A'), b AS (SELECT unit_id + 4 AS unit_id FROM counts WHERE sorting = 'B'),
top AS (SELECT max(unit_id) AS m FROM (FROM a UNION ALL FROM b)), c AS (SELECT b.unit_id, a.unit_id IS NOT NULL AS clash FROM b LEFT JOIN a USING (unit_id))
SELECT unit_id, unit_id AS new_unit_id, 1 AS side FROM a
UNION ALL SELECT unit_id, CASE WHEN clash THEN m + row_number() OVER (PARTITION BY clash ORDER BY unit_id) ELSE unit_id END, 2 FROM c, top"""
)
def union_renumber(spark: SparkSession, sf: str) -> DataFrame:
    units = surrogate.detectors(spark, sf).units
    first = units.where("sorting = 'A'").select("unit_id")
    second = units.where("sorting = 'B'").select((F.col("unit_id") + 4).alias("unit_id"))
    return selection.union_renumbered(first, second)


@query(f"WITH {SPIKES_SQL} SELECT sorting, unit_id, row_number() OVER (ORDER BY sorting, unit_id) - 1 AS new_id FROM counts")
def aggregate_ids(spark: SparkSession, sf: str) -> DataFrame:
    return selection.dense_ids(surrogate.detectors(spark, sf).units)


@query(
    f"""WITH {SPIKES_SQL} SELECT violation, n FROM (SELECT unnest(['no sorting', 'no unit', 'no time', 'before the recording', 'after the recording']) AS violation,
  unnest([count(*) FILTER (sorting IS NULL), count(*) FILTER (unit_id IS NULL), count(*) FILTER (sample_index IS NULL), count(*) FILTER (sample_index < 0), count(*) FILTER (sample_index >= 432000)]) AS n FROM sp)"""
)
def sanity_check(spark: SparkSession, sf: str) -> DataFrame:
    return selection.sanity_check(surrogate.detectors(spark, sf).replace(spikes=surrogate.spikes(spark, sf)))


# Waveforms.


@query(f"WITH {TEMPLATES_SQL} SELECT unit_id, sample, channel, round(value, 6) AS value FROM templates")
def template_mean(spark: SparkSession, sf: str) -> DataFrame:
    return surrogate.templates(spark, sf).select("unit_id", "sample", "channel", r6("value").alias("value"))


@query(f"WITH {TEMPLATES_SQL}, p AS (SELECT unit_id, channel, max(abs(value)) AS peak, max(value) - min(value) AS swing FROM templates GROUP BY ALL) SELECT unit_id, round(max(peak), 6) AS amplitude, round(max(swing), 6) AS peak_to_peak FROM p GROUP BY ALL")
def template_amplitude(spark: SparkSession, sf: str) -> DataFrame:
    found = surrogate.templates(spark, sf)
    peak = waves.amplitudes(found).withColumnRenamed("value", "peak")
    both = peak.join(waves.amplitudes(found, mode="peak_to_peak"), [*UNIT])
    return both.select("unit_id", r6("peak").alias("amplitude"), r6("value").alias("peak_to_peak"))


PEAKS_SQL = f"{TEMPLATES_SQL}, p AS (SELECT unit_id, channel, max(abs(value)) AS peak FROM templates GROUP BY ALL), ranked AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY peak DESC, channel)::INT AS rank FROM p)"


@query(f"WITH {PEAKS_SQL} SELECT unit_id, channel, rank FROM ranked WHERE rank <= 3")
def topk_channels(spark: SparkSession, sf: str) -> DataFrame:
    return waves.top_channels(surrogate.templates(spark, sf), 3).select("unit_id", "channel", "rank")


@query(
    f"""WITH {PEAKS_SQL}, w AS (
  SELECT unit_id, sample, abs(value) AS v FROM templates JOIN ranked USING (unit_id, channel) WHERE rank = 1
), l AS (
  SELECT *, max(v) OVER (PARTITION BY unit_id) AS top, lag(v) OVER (PARTITION BY unit_id ORDER BY sample) AS a, lead(v) OVER (PARTITION BY unit_id ORDER BY sample) AS b FROM w
), s AS (
  SELECT unit_id, coalesce(min(sample) FILTER (v > a AND v > b AND v >= 0.5 * top), min(sample) FILTER (v = top)) AS start FROM l GROUP BY ALL
) SELECT unit_id, (arg_max(sample, (v, -sample)) - 3)::INT AS shift FROM w JOIN s USING (unit_id) WHERE sample BETWEEN start AND start + 2 GROUP BY ALL"""
)
def peak_shift(spark: SparkSession, sf: str) -> DataFrame:
    return waves.peak_shifts(surrogate.templates(spark, sf), 3, 0.5, 2).select("unit_id", "shift")


@query(
    f"""WITH {TEMPLATES_SQL}, b AS (
  SELECT x.unit_id AS u1, y.unit_id AS u2, x.sample, x.channel, x.value AS v1, y.value AS v2 FROM templates x JOIN templates y ON x.unit_id < y.unit_id AND x.channel = y.channel AND x.sample = y.sample + 1
), c AS (
  SELECT u1, u2, channel, row_number() OVER (PARTITION BY u1, u2 ORDER BY max(abs(v1) + abs(v2)) DESC, channel) AS k FROM b GROUP BY u1, u2, channel
) SELECT u1, u2, round(sum(abs(v1 - v2)) / sum(abs(v1) + abs(v2)), 6) AS difference FROM b JOIN c USING (u1, u2, channel) WHERE k <= 5 GROUP BY ALL"""
)
def template_diff(spark: SparkSession, sf: str) -> DataFrame:
    found = graph.settle(surrogate.templates(spark, sf))
    units = found.select(*UNIT).distinct()
    pairs = units.toDF("s1", "u1").join(units.toDF("s2", "u2"), F.col("u1") < F.col("u2")).withColumn("shift", F.lit(1))
    return waves.template_differences(found, pairs).select("u1", "u2", r6("difference").alias("difference"))


@query(
    f"""WITH {TEMPLATES_SQL}, b AS (
  SELECT x.unit_id AS u1, y.unit_id AS u2, lag, x.value AS v1, y.value AS v2 FROM templates x JOIN templates y ON x.unit_id < y.unit_id AND x.channel = y.channel, range(-2, 3) AS g(lag) WHERE x.sample = y.sample + lag
), l AS (
  SELECT u1, u2, lag, sum(abs(v1 - v2)) / sum(abs(v1) + abs(v2)) AS difference FROM b GROUP BY ALL
) SELECT u1, u2, round(min(difference), 6) AS difference FROM l GROUP BY ALL"""
)
def lagged_template_diff(spark: SparkSession, sf: str) -> DataFrame:
    found = graph.settle(surrogate.templates(spark, sf))
    return waves.lagged_differences(found, merging.pairs_within(found.select(*UNIT).distinct()), 2).select("u1", "u2", r6("difference").alias("difference"))


@query(f"WITH {PEAKS_SQL} SELECT unit_id, (arg_max(sample, (abs(value), -sample)) - 3)::INT AS shift FROM templates JOIN ranked USING (unit_id, channel) WHERE rank = 1 GROUP BY ALL")
def extremum_shift(spark: SparkSession, sf: str) -> DataFrame:
    return waves.extremum_shifts(surrogate.templates(spark, sf), 3).select("unit_id", "shift")


@query(
    f"""WITH {SPIKES_SQL}, o AS (
  SELECT *, row_number() OVER () AS id FROM spikes
), raw AS (
  SELECT a.sorting AS s1, a.unit_id AS u1, b.sorting AS s2, b.unit_id AS u2, floor((a.sample_index - b.sample_index) / 20.0)::INT AS bin, count(*) AS n
  FROM o a JOIN o b ON (a.sorting < b.sorting OR (a.sorting = b.sorting AND a.unit_id = b.unit_id AND a.id <> b.id))
    AND a.sample_index - b.sample_index >= -200 AND a.sample_index - b.sample_index < 200 GROUP BY ALL
), wanted AS (
  SELECT DISTINCT s1, u1, s2, u2 FROM raw WHERE s1 <> s2 UNION SELECT sorting, unit_id, sorting, unit_id FROM counts
), dense AS (
  SELECT w.*, b::INT AS bin, coalesce(n, 0) AS n FROM wanted w CROSS JOIN range(-10, 10) AS g(b) LEFT JOIN raw r ON r.s1 = w.s1 AND r.u1 = w.u1 AND r.s2 = w.s2 AND r.u2 = w.u2 AND r.bin = b
), flat AS (
  SELECT *, coalesce(n / nullif(avg(n) OVER (PARTITION BY s1, u1, s2, u2), 0), 0) AS h FROM dense
), auto AS (
  SELECT s1 AS s, u1 AS u, bin, h, max(h) OVER (PARTITION BY s1, u1) AS top FROM flat WHERE s1 = s2
), wide AS (
  SELECT s, u, max(abs(bin)) AS w, any_value(n_spikes) AS n FROM auto JOIN counts ON sorting = s AND unit_id = u WHERE h >= 0.5 * top GROUP BY ALL
)
SELECT f.s1, f.u1, f.s2, f.u2, round((avg(abs(f.h - x.h)) * any_value(a.n) + avg(abs(f.h - y.h)) * any_value(b.n)) / (any_value(a.n) + any_value(b.n)), 6) AS difference
FROM flat f JOIN wide a ON a.s = f.s1 AND a.u = f.u1 JOIN wide b ON b.s = f.s2 AND b.u = f.u2
JOIN auto x ON x.s = f.s1 AND x.u = f.u1 AND x.bin = f.bin JOIN auto y ON y.s = f.s2 AND y.u = f.u2 AND y.bin = f.bin
WHERE f.s1 <> f.s2 AND abs(f.bin) <= round((a.w * a.n + b.w * b.n) / (a.n + b.n)::DOUBLE) GROUP BY f.s1, f.u1, f.s2, f.u2"""
)
def correlogram_diff(spark: SparkSession, sf: str) -> DataFrame:
    data = surrogate.detectors(spark, sf)
    units = graph.settle(data.units.select(*UNIT))
    every = units.toDF("s1", "u1").join(units.toDF("s2", "u2"), F.col("s1") < F.col("s2")).withColumn("shift", F.lit(0))
    pairs = graph.settle(bandjoin.correlogram_of(data.spikes, every, 200, 20).select(*bandjoin.PAIR).distinct())
    found = merging.pair_correlogram_differences(data.spikes, pairs, unit_counts(data.spikes), 10, 20, 0.5, 0.0)
    return found.select(*bandjoin.PAIR, r6("difference").alias("difference"))


EDGE_BINS, EDGE_MARGIN = 210, MAX_SHIFT + 1
EDGE_KERNEL = ", ".join(f"({k - len(gaussian_kernel(3.0)) // 2}, {float(w)!r}::DOUBLE)" for k, w in enumerate(gaussian_kernel(3.0)))


@query(
    f"""WITH {SHIFT_SQL}, edge AS (
  SELECT c.s1, c.u1, c.s2, c.u2, coalesce(shift, 0) AS shift
  FROM (SELECT s1, u1, s2, u2, count(*) AS n FROM pairs WHERE abs(d) <= {WINDOW} GROUP BY ALL) c JOIN counts a ON a.sorting = s1 AND a.unit_id = u1 JOIN counts b ON b.sorting = s2 AND b.unit_id = u2
  LEFT JOIN shifts USING (s1, u1, s2, u2) WHERE n / (a.n_spikes + b.n_spikes - n)::DOUBLE >= 0.1
), ends AS (
  SELECT s1 AS s, u1 AS u FROM edge UNION SELECT s2, u2 FROM edge
), wanted AS (
  SELECT s1, u1, s2, u2, shift, true AS crossing FROM edge UNION ALL SELECT s, u, s, u, 0, false FROM ends
), o AS (
  SELECT *, row_number() OVER () AS id FROM spikes
), raw AS (
  SELECT s1, u1, s2, u2, (a.sample_index - b.sample_index)::INT AS bin, count(*)::DOUBLE AS n
  FROM wanted JOIN o a ON a.sorting = s1 AND a.unit_id = u1 JOIN o b ON b.sorting = s2 AND b.unit_id = u2 AND a.id <> b.id
    AND a.sample_index - b.sample_index >= -{EDGE_BINS} AND a.sample_index - b.sample_index < {EDGE_BINS} GROUP BY ALL
), ek(o, w) AS (VALUES {EDGE_KERNEL}), soft AS (
  SELECT s1, u1, s2, u2, bin + o AS bin, sum(n * w) AS v FROM raw JOIN wanted USING (s1, u1, s2, u2), ek
  WHERE NOT (crossing AND bin >= -{WINDOW} AND bin < {WINDOW}) AND bin + o >= -{EDGE_BINS} AND bin + o < {EDGE_BINS} GROUP BY ALL
), dense AS (
  SELECT w.*, g.r::INT AS r, coalesce(v, 0) AS v FROM wanted w CROSS JOIN range(-{EDGE_BINS - EDGE_MARGIN}, {EDGE_BINS - EDGE_MARGIN}) AS g(r)
  LEFT JOIN soft f ON f.s1 = w.s1 AND f.u1 = w.u1 AND f.s2 = w.s2 AND f.u2 = w.u2 AND f.bin = g.r + w.shift
), flat AS (
  SELECT *, coalesce(v / nullif(avg(v) OVER (PARTITION BY s1, u1, s2, u2), 0), 0) AS h FROM dense
), auto AS (
  SELECT s1 AS s, u1 AS u, r, h, max(h) OVER (PARTITION BY s1, u1) AS top FROM flat WHERE NOT crossing
), wide AS (
  SELECT s, u, max(abs(r)) AS w, any_value(n_spikes) AS n FROM auto JOIN counts ON sorting = s AND unit_id = u WHERE h >= 0.5 * top GROUP BY ALL
)
SELECT f.s1, f.u1, f.s2, f.u2, round((avg(abs(f.h - x.h)) * any_value(a.n) + avg(abs(f.h - y.h)) * any_value(b.n)) / (any_value(a.n) + any_value(b.n)), 6) AS difference
FROM flat f JOIN wide a ON a.s = f.s1 AND a.u = f.u1 JOIN wide b ON b.s = f.s2 AND b.u = f.u2
JOIN auto x ON x.s = f.s1 AND x.u = f.u1 AND x.r = f.r JOIN auto y ON y.s = f.s2 AND y.u = f.u2 AND y.r = f.r
WHERE f.crossing AND abs(f.r) <= floor((a.w * a.n + b.w * b.n) / (a.n + b.n)::DOUBLE + 0.5) GROUP BY f.s1, f.u1, f.s2, f.u2"""
)
def edge_correlogram_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Correlograms of the edges of a graph: emptied around lag 0, smoothed, cropped about the shift of the edge."""
    data = surrogate.detectors(spark, sf)
    shifts = graph.settle(trains.cross_shifts(data.spikes, MAX_SHIFT))
    edges = metrics.compared(data, WINDOW).where("agreement >= 0.1").select(*bandjoin.PAIR).join(shifts, list(bandjoin.PAIR), "left").fillna({"shift": 0})
    found = merging.edge_correlogram_differences(data.spikes, graph.settle(edges), unit_counts(data.spikes), META, EDGE_BINS / 30, None, 0.1, 5.0, WINDOW, MAX_SHIFT)
    return found.select(*bandjoin.PAIR, r6("difference").alias("difference"))


@query(
    """WITH r AS (SELECT vec_id, unnest(range(64)) AS k, unnest(embedding)::DOUBLE AS v FROM embeddings), l AS (SELECT (k % 8)::INT AS channel, v FROM r),
m AS (SELECT channel, median(v) AS m, stddev(v) AS sd FROM l GROUP BY ALL)
SELECT channel, round(median(abs(v - m)) / 0.6744897501960817::DOUBLE, 6) AS noise, round(any_value(sd), 6) AS sd FROM l JOIN m USING (channel) GROUP BY ALL"""
)
def noise_level(spark: SparkSession, sf: str) -> DataFrame:
    chunks = surrogate.recording(spark, sf)
    wide = chunks.withColumn("samples", chunks["samples"].cast("array<array<double>>"))
    return waves.noise_levels(wide).select("channel", r6("noise").alias("noise"), r6("sd").alias("sd"))


@query(
    """WITH f AS (SELECT vec_id * 8 + k // 8 AS frame, (k % 8)::INT AS channel, v FROM (SELECT vec_id, unnest(range(64)) AS k, unnest(embedding)::DOUBLE AS v FROM embeddings)),
e AS (SELECT label::BIGINT AS unit_id, vec_id * 8 + 3 AS t FROM embeddings)
SELECT unit_id, s::INT AS sample, channel, round(avg(v), 6) AS value FROM e, range(6) AS g(s) JOIN f ON f.frame = t - 2 + s GROUP BY ALL"""
)
def recording_template(spark: SparkSession, sf: str) -> DataFrame:
    from eventloom.meta import RecordingMeta, dataset

    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    events = rows.select(F.lit("T").alias("sorting"), F.col("label").cast("long").alias("unit_id"), (F.col("vec_id") * 8 + 3).alias("sample_index"))
    data = dataset(events, RecordingMeta(30_000.0, 1 << 40), recording=surrogate.recording(spark, sf))
    found = waves.mean_waveforms(data, 2, 4, most=1 << 30)
    return found.select("unit_id", "sample", "channel", r6("value").alias("value"))


def _circular(band: tuple[float, float]) -> str:
    """(o, w): the band-pass of templates as weights of a circular convolution."""
    impulse = np.zeros(surrogate.SAMPLES)
    impulse[0] = 1.0
    return ", ".join(f"({k}, {float(w)!r}::DOUBLE)" for k, w in enumerate(band_pass(impulse, band, META.fs)))


@query(
    f"""WITH {TEMPLATES_SQL}, weights(o, w) AS (VALUES {_circular((300.0, 6000.0))})
SELECT unit_id, ((sample + o) % 8)::INT AS sample, channel, round(sum(value * w), 6) AS value FROM templates, weights GROUP BY ALL"""
)
def filtered_template(spark: SparkSession, sf: str) -> DataFrame:
    found = filter_templates(surrogate.templates(spark, sf), (300.0, 6000.0), META.fs)
    return found.select("unit_id", "sample", "channel", r6("value").alias("value"))


FRAMES_SQL = """f AS (
  SELECT vec_id * 8 + k // 8 AS frame, (k % 8)::INT AS channel, v FROM (SELECT vec_id, unnest(range(64)) AS k, unnest(embedding)::DOUBLE AS v FROM embeddings)
), e AS (
  SELECT label::BIGINT AS unit_id, vec_id * 8 + 3 AS t FROM embeddings
), middle AS (
  SELECT channel, median(v) AS m, stddev(v) AS sd FROM f GROUP BY ALL
), noise AS (
  SELECT channel, any_value(sd) AS sd, median(abs(v - m)) / 0.6744897501960817::DOUBLE AS noise FROM f JOIN middle USING (channel) GROUP BY ALL
)"""
BEST_SQL = f"""{PEAKS_SQL}, {FRAMES_SQL}, best AS (SELECT unit_id, channel FROM ranked WHERE rank = 1), amp AS (
  SELECT e.unit_id, t, v AS amplitude FROM e JOIN best USING (unit_id) JOIN f ON f.frame = t AND f.channel = best.channel
)"""


def _recorded(spark: SparkSession, sf: str):
    from eventloom.meta import RecordingMeta, dataset

    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    events = rows.select(F.lit("T").alias("sorting"), F.col("label").cast("long").alias("unit_id"), (F.col("vec_id") * 8 + 3).alias("sample_index"))
    chunks = surrogate.recording(spark, sf)
    chunks = chunks.withColumn("samples", F.col("samples").cast("array<array<double>>"))
    return dataset(events, RecordingMeta(30_000.0, 1 << 40), recording=chunks, templates=graph.settle(surrogate.templates(spark, sf), "templates"))


@query(f"WITH {BEST_SQL} SELECT unit_id, t::BIGINT AS sample_index, round(amplitude, 6) AS amplitude FROM amp")
def spike_amplitude(spark: SparkSession, sf: str) -> DataFrame:
    return waves.spike_amplitudes(_recorded(spark, sf)).select("unit_id", "sample_index", r6("amplitude").alias("amplitude"))


@query(f"WITH {BEST_SQL} SELECT unit_id, round(stddev(amplitude) / any_value(sd), 6) AS sd_ratio FROM amp JOIN best USING (unit_id) JOIN noise USING (channel) GROUP BY ALL")
def sd_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return waves.sd_ratios(_recorded(spark, sf)).select("unit_id", r6("value").alias("sd_ratio"))


@query(
    f"""WITH {BEST_SQL}, swing AS (SELECT unit_id, channel, max(value) - min(value) AS swing FROM templates GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY swing DESC, channel) AS k FROM swing)
SELECT unit_id, round(swing / noise, 6) AS snr FROM top JOIN noise USING (channel) WHERE k = 1"""
)
def signal_to_noise(spark: SparkSession, sf: str) -> DataFrame:
    return waves.signal_to_noise(_recorded(spark, sf)).select("unit_id", r6("value").alias("snr"))


@query(
    f"""WITH {TEMPLATES_SQL}, p AS (SELECT unit_id, channel, max(abs(value)) AS peak FROM templates GROUP BY ALL)
SELECT unit_id, round(sum(peak * (channel % 2) * 20) / sum(peak), 6) AS x, round(sum(peak * channel * 10) / sum(peak), 6) AS y FROM p GROUP BY ALL"""
)
def unit_location(spark: SparkSession, sf: str) -> DataFrame:
    channels = spark.range(surrogate.CHANNELS).select(F.col("id").cast("int").alias("channel"), (F.col("id") % 2 * 20.0).alias("x"), (F.col("id") * 10.0).alias("y"))
    return waves.unit_locations(surrogate.templates(spark, sf), channels).select("unit_id", r6("x").alias("x"), r6("y").alias("y"))


@query(f"WITH {SPIKES_SQL} SELECT sorting, unit_id, sample_index FROM spikes QUALIFY row_number() OVER (PARTITION BY sorting, unit_id ORDER BY md5('0:' || sample_index), sample_index) <= 50")
def sampled_spikes(spark: SparkSession, sf: str) -> DataFrame:
    return waves.sampled_spikes(surrogate.detectors(spark, sf).spikes, 50)


@query(f"WITH {FRAMES_SQL} SELECT unit_id, t AS sample_index, s::INT AS sample, channel, round(v, 6) AS value FROM e, range(12) AS g(s) JOIN f ON f.frame = t - 5 + s")
def event_waveforms(spark: SparkSession, sf: str) -> DataFrame:
    """The frames around every event, which reach into the chunks before and after its own."""
    data = _recorded(spark, sf)
    rows = waves.event_frames(data.spikes, data.recording, 5, 7)
    return rows.select("unit_id", "sample_index", "sample", F.posexplode("row").alias("channel", "value")).withColumn("value", r6("value"))


@query(f"WITH {FRAMES_SQL}, m AS (SELECT median(noise) AS m FROM noise) SELECT channel FROM noise, m WHERE noise <= 1.01 * m AND noise * 1.01 >= m")
def good_channels(spark: SparkSession, sf: str) -> DataFrame:
    """The channels whose noise is within 1% of the median channel's."""
    from eventloom.sources.tables import remove_bad_channels

    chunks, kept = remove_bad_channels(_recorded(spark, sf).recording, META, 1.01)
    places = waves.long_recording(chunks).select("channel").distinct()
    return places.select(F.get(F.array(*map(F.lit, kept)).cast("array<int>"), F.col("channel")).alias("channel"))


@query(
    """WITH f AS (SELECT vec_id * 8 + k // 8 AS frame, (k % 8)::INT AS channel, v FROM (SELECT vec_id, unnest(range(64)) AS k, unnest(embedding)::DOUBLE AS v FROM embeddings))
SELECT frame, CASE channel WHEN 6 THEN 0 WHEN 1 THEN 1 ELSE 2 END::INT AS channel, round(v, 6) AS value FROM f WHERE channel IN (1, 3, 6)"""
)
def channel_slice(spark: SparkSession, sf: str) -> DataFrame:
    part = selection.channel_slice(_recorded(spark, sf), [6, 1, 3])
    return waves.long_recording(part.recording).select("frame", "channel", r6("value").alias("value"))


@query(
    """WITH f AS (SELECT vec_id * 8 + k // 8 AS frame, (k % 8)::INT AS channel, v FROM (SELECT vec_id, unnest(range(64)) AS k, unnest(embedding)::DOUBLE AS v FROM embeddings))
SELECT frame, channel, round(v - median(v) OVER (PARTITION BY frame), 4) AS value FROM f"""
)
def common_reference(spark: SparkSession, sf: str) -> DataFrame:
    from eventloom.sources.tables import common_reference as centred

    chunks = _recorded(spark, sf).recording
    return waves.long_recording(centred(chunks, META)).select("frame", "channel", F.round(F.col("value").cast("double"), 4).alias("value"))


@query(f"WITH {SPIKES_SQL} SELECT sorting, unit_id, count(*)::BIGINT AS n_spikes, sum(sample_index - 100000)::BIGINT AS total FROM spikes WHERE sample_index >= 100000 AND sample_index < 300000 GROUP BY ALL")
def frame_slice(spark: SparkSession, sf: str) -> DataFrame:
    part = selection.frame_slice(surrogate.detectors(spark, sf), 100_000, 300_000)
    return part.spikes.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("n_spikes"), F.sum("sample_index").alias("total"))


@query(
    f"""WITH {SELF_SQL}, p AS (SELECT s1, u1, u2, row_number() OVER (PARTITION BY s1 ORDER BY u1, u2) AS k FROM near), w AS (SELECT s1, k, u1 AS unit_id, u2 AS o FROM p UNION ALL SELECT s1, k, u2, u1 FROM p)
SELECT s1 AS sorting, w.unit_id, string_agg(o::VARCHAR, ',' ORDER BY k) AS partners FROM w JOIN counts c ON c.sorting = s1 AND c.unit_id = w.unit_id
WHERE n_spikes < (SELECT avg(n_spikes) FROM counts m WHERE m.sorting = s1) GROUP BY ALL"""
)
def redundancies(spark: SparkSession, sf: str) -> DataFrame:
    """The partners of units that have fewer events than their sorting's mean, as if those had been removed."""
    from pyspark.sql import Window

    data = surrogate.detectors(spark, sf)
    ids = graph.settle(selection.dense_ids(data.units))
    pairs = bandjoin.coincidences(data.spikes, WINDOW, same=True).where("u1 < u2")
    for k in ("1", "2"):
        pairs = pairs.join(ids.toDF(f"s{k}", f"u{k}", f"id{k}"), [f"s{k}", f"u{k}"])
    numbered = pairs.select(F.row_number().over(Window.orderBy("id1", "id2")).alias("position"), F.col("id1").alias("a"), F.col("id2").alias("b"))
    mean = F.avg("n_spikes").over(Window.partitionBy("sorting"))
    few = unit_counts(data.spikes).withColumn("few", F.col("n_spikes") < mean).where("few").join(ids, [*UNIT])
    found = graph.redundancies(few.select(F.col("new_id").alias("unit_id")), numbered).withColumnRenamed("unit_id", "new_id")
    names = F.transform("partners", lambda x: F.element_at("names", x).cast("string"))
    every = ids.agg(F.map_from_entries(F.collect_list(F.struct("new_id", "unit_id"))).alias("names"))  # one row, of the size of the units
    return found.join(ids, "new_id").join(every).select(*UNIT, F.concat_ws(",", names).alias("partners"))


@query()
def merge_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """The whole merge_units step on one detector."""
    from eventloom.pipeline import Pipeline

    steps = {"merge_units": {"all": {"refractory_period": [0.05, 0.2], "correlograms": {"window_ms": 20.0, "bin_ms": 1.0}, "auto_merge_params": {"steps_params": {"correlogram": {"corr_diff_thresh": 0.5}}}}}}
    return Pipeline(surrogate.merging_detectors(spark, sf), steps).run().spikes


PAUSE_SQL = f"""{SPIKES_SQL}, rates AS (
  SELECT sorting, unit_id, n_spikes * 30000.0::DOUBLE / 432000 AS rate, avg(n_spikes) OVER () * 30000.0::DOUBLE / 432000 AS mean FROM counts
), grid AS (
  SELECT f.sorting, f.unit_id AS u1, s.unit_id AS u2, b::INT AS bin FROM rates f JOIN rates s ON f.sorting = s.sorting AND f.unit_id <> s.unit_id, range(-12, 12) AS g(b)
  WHERE f.rate >= round(f.mean, 3) AND s.rate BETWEEN round(0.5 * f.mean, 3) AND round(f.mean, 3)
), lags AS (
  SELECT a.sorting, a.unit_id AS u1, b.unit_id AS u2, floor((a.sample_index - b.sample_index) / 30.0)::INT AS bin, count(*) AS n
  FROM spikes a JOIN spikes b ON a.sorting = b.sorting AND a.sample_index - b.sample_index >= -360 AND a.sample_index - b.sample_index < 360 GROUP BY ALL
), d AS (
  SELECT sorting, u1, u2, bin, coalesce(n, 0) AS n, median(coalesce(n, 0)) FILTER (bin < 0) OVER (PARTITION BY sorting, u1, u2) AS base FROM grid LEFT JOIN lags USING (sorting, u1, u2, bin)
)"""


@query(
    f"""WITH {PAUSE_SQL}, j AS (
  SELECT sorting, u1, u2, any_value(base) AS base, median(n) FILTER (bin >= 0 AND bin < 8) AS in_pause, avg((n < 0.98 * base)::INT) FILTER (bin >= -8 AND bin < 0) AS low FROM d GROUP BY ALL
) SELECT sorting, u1, u2 FROM j WHERE in_pause < 0.98 * base AND low < 0.5"""
)
def purkinje_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Units at or above the mean rate are fast, those from half of it up to it slow; at the surrogate's even rates a pause is a dip of 2%."""
    data = surrogate.detectors(spark, sf)
    mean = round(metrics.firing_rates(data).agg(F.avg("value")).first()[0], 3)
    half = round(0.5 * metrics.firing_rates(data).agg(F.avg("value")).first()[0], 3)
    return pauses.pausing_pairs(data, (0, 8), 0.98, mean, (half, mean), 360, 30)


# Comparison with known trains: B and C against A.

TRUTH_SQL = f"""{SPIKES_SQL}, c AS (
  SELECT a.sorting, a.unit_id, b.unit_id AS neuron, count(*) AS n FROM spikes a JOIN spikes b
  ON a.sorting <> 'A' AND b.sorting = 'A' AND a.sample_index BETWEEN b.sample_index - {WINDOW} AND b.sample_index + {WINDOW} GROUP BY ALL
), g AS (
  SELECT u.sorting, u.unit_id, t.unit_id AS neuron, u.n_spikes AS n, t.n_spikes AS g, coalesce(c.n, 0) AS nc
  FROM counts u JOIN counts t ON u.sorting <> 'A' AND t.sorting = 'A' LEFT JOIN c ON c.sorting = u.sorting AND c.unit_id = u.unit_id AND c.neuron = t.unit_id
), tp AS (
  SELECT *, (nc - n * g * {7 / 432000!r}::DOUBLE) / (1 - g * {7 / 432000!r}::DOUBLE) AS tp FROM g
), truth AS (
  SELECT sorting, unit_id, neuron, tp / (n + g - tp) AS accuracy, tp / g AS recall, tp / n AS "precision" FROM tp
)"""


def _truth(spark: SparkSession, sf: str) -> DataFrame:
    known = surrogate.detectors(spark, sf, "A").spikes.select("unit_id", "sample_index")
    found = surrogate.detectors(spark, sf, "BC").spikes
    return graph.settle(groundtruth.truth_metrics(found, known, WINDOW, META.t_max), "truth")


@query(f'WITH {TRUTH_SQL} SELECT sorting, unit_id, neuron, round(accuracy, 6) AS accuracy, round(recall, 6) AS recall, round("precision", 6) AS prec FROM truth')
def gt_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _truth(spark, sf).select(*UNIT, "neuron", r6("accuracy").alias("accuracy"), r6("recall").alias("recall"), r6("precision").alias("prec"))


@query(
    f"""WITH {TRUTH_SQL}, second AS (
  SELECT sorting, unit_id, recall AS r2 FROM (SELECT *, row_number() OVER (PARTITION BY sorting, unit_id ORDER BY recall DESC) AS k FROM truth) WHERE k = 2
), u AS (
  SELECT sorting, unit_id, sum("precision") AS ps, max("precision") AS pb, max(accuracy) AS accuracy, min(neuron) FILTER (accuracy = m) AS neuron
  FROM (SELECT *, max(accuracy) OVER (PARTITION BY sorting, unit_id) AS m FROM truth) GROUP BY ALL
), best AS (
  SELECT sorting, neuron, min(unit_id) AS best_unit FROM (SELECT *, max(accuracy) OVER (PARTITION BY sorting, neuron) AS m FROM truth) WHERE accuracy = m GROUP BY ALL
), near AS (
  SELECT a.sorting, a.unit_id AS u1, b.unit_id AS u2, count(*) AS n FROM spikes a JOIN spikes b ON a.sorting = b.sorting AND a.sample_index BETWEEN b.sample_index - {WINDOW} AND b.sample_index + {WINDOW} GROUP BY ALL
), share AS (
  SELECT near.sorting, u1, u2, n / (a.n_spikes + b.n_spikes - n)::DOUBLE AS agreement FROM near JOIN counts a ON a.sorting = near.sorting AND a.unit_id = u1 JOIN counts b ON b.sorting = near.sorting AND b.unit_id = u2
) SELECT u.sorting, u.unit_id, u.neuron, CASE WHEN n_spikes * 30000.0::DOUBLE / 432000 < 0.4 THEN 'Small' WHEN (u.unit_id % 4) * 0.1::DOUBLE > 0.25::DOUBLE THEN 'Contaminated' WHEN ps < 0.5 THEN 'Noise' WHEN r2 > {1 / 3!r}::DOUBLE THEN 'Merged' WHEN pb < 0.5 THEN 'MUA'
  WHEN u.unit_id = best_unit THEN CASE WHEN accuracy >= 0.95 THEN 'acc >= 95%' WHEN accuracy >= 0.8 THEN 'acc >= 80%' WHEN accuracy >= 0.5 THEN 'acc >= 50%' ELSE 'acc < 50%' END
  WHEN agreement >= 0.5 THEN 'Redundant' ELSE 'Split' END AS label
FROM u JOIN second USING (sorting, unit_id) JOIN counts USING (sorting, unit_id) JOIN best USING (sorting, neuron) LEFT JOIN share s ON s.sorting = u.sorting AND s.u1 = u.unit_id AND s.u2 = best_unit"""
)
def gt_labels(spark: SparkSession, sf: str) -> DataFrame:
    data = surrogate.detectors(spark, sf, "BC")
    quality = metrics.firing_rates(data).select(*UNIT, F.col("value").alias("firing_rate"), ((F.col("unit_id") % 4) * F.lit(0.1)).alias("contamination"))
    both = bandjoin.cross_pairs(data.spikes, WINDOW, same=True, both_ways=True).groupBy(*bandjoin.PAIR).agg(F.sum("n").alias("n_coinc"))
    near = metrics.agreement(both, unit_counts(data.spikes)).select(F.col("s1").alias("sorting"), "u1", "u2", "agreement")
    return groundtruth.labels(_truth(spark, sf), quality, near).select(*UNIT, "neuron", "label")


@query(f'WITH {TRUTH_SQL} SELECT neuron, sorting, unit_id, round(accuracy, 6) AS accuracy FROM (SELECT *, row_number() OVER (PARTITION BY neuron ORDER BY accuracy DESC, sorting, unit_id) AS k FROM truth WHERE "precision" >= 0.2) WHERE k = 1')
def theoretical_maximum(spark: SparkSession, sf: str) -> DataFrame:
    return groundtruth.theoretical_maximum(_truth(spark, sf), 0.2).select("neuron", *UNIT, r6("accuracy").alias("accuracy"))


@query(
    f"""WITH {TRUTH_SQL}, h AS (SELECT DISTINCT sorting, neuron FROM truth WHERE accuracy > 0.3), a AS (FROM h UNION ALL SELECT DISTINCT 'any', neuron FROM h)
SELECT CASE WHEN neuron % 2 = 0 THEN 'even' ELSE 'odd' END AS type, sorting, count(*)::BIGINT AS n FROM a GROUP BY ALL"""
)
def recovered_by_type(spark: SparkSession, sf: str) -> DataFrame:
    found = _truth(spark, sf)
    types = found.select("neuron").distinct().withColumn("type", F.when(F.col("neuron") % 2 == 0, "even").otherwise("odd"))
    return groundtruth.recovered(found, types, 0.3)


@query(f"WITH {TRUTH_SQL}, b AS (SELECT sorting, unit_id, max(accuracy) AS accuracy FROM truth GROUP BY ALL) SELECT sorting, k::INT AS k, count(*) FILTER (k <= floor(least(accuracy, 1.0) * 20 + 1e-9))::BIGINT AS n FROM b, range(21) AS g(k) GROUP BY ALL")
def survival_curve(spark: SparkSession, sf: str) -> DataFrame:
    return groundtruth.survival(_truth(spark, sf))


@query(
    f"""WITH {TRUTH_SQL} SELECT k::INT AS k, round(sum(exp(-((recall - (0.0 + k * 0.1::DOUBLE)) / 0.4::DOUBLE) * ((recall - (0.0 + k * 0.1::DOUBLE)) / 0.4::DOUBLE) / 2) * accuracy)
  / sum(exp(-((recall - (0.0 + k * 0.1::DOUBLE)) / 0.4::DOUBLE) * ((recall - (0.0 + k * 0.1::DOUBLE)) / 0.4::DOUBLE) / 2)), 6) AS mean FROM truth, range(11) AS g(k) GROUP BY ALL"""
)
def kernel_mean(spark: SparkSession, sf: str) -> DataFrame:
    return groundtruth.kernel_mean(_truth(spark, sf), "recall", "accuracy", 0.0, 1.0, 11, 0.4).select("k", r6("mean").alias("mean"))
