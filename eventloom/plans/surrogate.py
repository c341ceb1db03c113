"""Detectors and waveforms read into the test tables, for queries and benchmarks.

events give three detectors on a time axis of 6-second samples: A has all events, B most of them with jitter, C
pairs of units merged, later by 2 samples.  V is A with a refractory period that a few events break.
embeddings of 64 values are waveforms of 8 samples by 8 channels, their label is the unit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.meta import Dataset, RecordingMeta, dataset

META = RecordingMeta(fs=30_000.0, t_max=432_000, n_channels=8)
SAMPLES, CHANNELS = 8, 8

SPIKES_SQL = """
ev AS (
  SELECT event_id, user_id, (epoch_us(ts) - 1704067200000000) // 6000000 AS t FROM events
), sp AS (
  SELECT 'A' AS sorting, user_id % 12 AS unit_id, t AS sample_index FROM ev
  UNION ALL SELECT 'B', user_id % 12, t + event_id % 3 FROM ev WHERE event_id % 10 <> 0
  UNION ALL SELECT 'C', (user_id % 12) // 2, t + 2 FROM ev WHERE event_id % 4 <> 0
), spikes AS (
  SELECT * FROM sp WHERE sample_index BETWEEN 0 AND 431999
), counts AS (
  SELECT sorting, unit_id, count(*) AS n_spikes FROM spikes GROUP BY ALL
)"""

REFRACTORY_SQL = """
rf0 AS (
  SELECT user_id % 12 AS unit_id, (epoch_us(ts) - 1704067200000000) // 6000000 AS t, event_id FROM events
), rf1 AS (
  SELECT unit_id, t, t - lag(t) OVER w AS gap, row_number() OVER w AS k FROM rf0 WINDOW w AS (PARTITION BY unit_id ORDER BY t, event_id)
), rf AS (
  SELECT 'V' AS sorting, unit_id, t AS sample_index FROM rf1 WHERE (gap IS NULL OR gap > 5 OR k % 20 = 0) AND t BETWEEN 0 AND 431999
)"""

MERGING_SQL = """
mb0 AS (
  SELECT user_id % 12 AS unit_id, (epoch_us(ts) - 1704067200000000) // 6000000 AS t, event_id FROM events
), mb1 AS (
  SELECT unit_id, t, t - lag(t) OVER w AS gap, row_number() OVER w AS k FROM mb0 WINDOW w AS (PARTITION BY unit_id ORDER BY t, event_id)
), mb AS (
  SELECT unit_id, t FROM mb1 WHERE gap IS NULL OR gap > 60 OR k % 40 = 0
), sp AS (
  SELECT 'V' AS sorting, unit_id, t AS sample_index FROM mb
  UNION ALL SELECT 'M', CASE WHEN unit_id < 6 THEN unit_id // 2 ELSE unit_id END, t + 2 FROM mb
  UNION ALL SELECT 'Y', 2 * unit_id + t % 2, t FROM mb
  UNION ALL SELECT 'Y', 2 * ((unit_id + 7) % 12) + CASE WHEN (unit_id + 7) % 3 = 0 THEN 1 ELSE 0 END, t FROM mb WHERE (unit_id + 7) % 3 < 2 AND t % 3 = 0
), spikes AS (
  SELECT * FROM sp WHERE sample_index BETWEEN 0 AND 431999
), counts AS (
  SELECT sorting, unit_id, count(*) AS n_spikes FROM spikes GROUP BY ALL
)"""

TEMPLATES_SQL = """
tp0 AS (
  SELECT label::BIGINT AS unit_id, unnest(range(64)) AS k, unnest(embedding)::DOUBLE AS v FROM embeddings
), templates AS (
  SELECT unit_id, (k // 8)::INT AS sample, (k % 8)::INT AS channel, avg(v) AS value FROM tp0 GROUP BY ALL
)"""


def _timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz))")
    return events.select("event_id", "user_id", F.floor(micros / F.lit(6_000_000)).cast("long").alias("t"))


def spikes(spark: SparkSession, sf_dir: str, sortings: str = "ABC") -> DataFrame:
    ev = _timed(spark, sf_dir)
    unit = (F.col("user_id") % 12).cast("long")
    parts = {
        "A": ev.select(F.lit("A").alias("sorting"), unit.alias("unit_id"), F.col("t").alias("sample_index")),
        "B": ev.where("event_id % 10 <> 0").select(F.lit("B").alias("sorting"), unit.alias("unit_id"), (F.col("t") + F.col("event_id") % 3).alias("sample_index")),
        "C": ev.where("event_id % 4 <> 0").select(F.lit("C").alias("sorting"), F.floor(unit / 2).alias("unit_id"), (F.col("t") + 2).alias("sample_index")),
    }
    first, *rest = sortings
    out = parts[first]
    for s in rest:
        out = out.union(parts[s])
    return out


def detectors(spark: SparkSession, sf_dir: str, sortings: str = "ABC") -> Dataset:
    return dataset(spikes(spark, sf_dir, sortings), META)


def refractory(spark: SparkSession, sf_dir: str) -> Dataset:
    ev = _timed(spark, sf_dir).withColumn("unit_id", (F.col("user_id") % 12).cast("long"))
    order = Window.partitionBy("unit_id").orderBy("t", "event_id")
    kept = ev.withColumn("gap", F.col("t") - F.lag("t").over(order)).withColumn("k", F.row_number().over(order)).where("gap is null or gap > 5 or k % 20 = 0")
    return dataset(kept.select(F.lit("V").alias("sorting"), "unit_id", F.col("t").alias("sample_index")), META)


def refractory_detectors(spark: SparkSession, sf_dir: str) -> Dataset:
    """V seen by three detectors: V itself, W with jitter and losses, X later by 2 samples with other losses."""
    v = refractory(spark, sf_dir).spikes
    t = F.col("sample_index")
    w = v.where(t % 10 != 0).select(F.lit("W").alias("sorting"), "unit_id", (t + t % 2).alias("sample_index"))
    x = v.where(t % 7 != 0).select(F.lit("X").alias("sorting"), "unit_id", (t + 2).alias("sample_index"))
    return dataset(v.union(w).union(x), META)


def merging_detectors(spark: SparkSession, sf_dir: str) -> Dataset:
    """V has a long refractory period that a few events break; M, later by 2 samples, takes pairs of the first six units for one; Y
    splits every unit in two halves and adds events of other units to one of them (to the second half of every third
    unit, to the first half of the ones after those)."""
    ev = _timed(spark, sf_dir).withColumn("unit_id", (F.col("user_id") % 12).cast("long"))
    order = Window.partitionBy("unit_id").orderBy("t", "event_id")
    base = ev.withColumn("gap", F.col("t") - F.lag("t").over(order)).withColumn("k", F.row_number().over(order)).where("gap is null or gap > 60 or k % 40 = 0")
    u, t = F.col("unit_id"), F.col("t")
    other = F.pmod(u + 7, F.lit(12))
    parts = [
        base.select(F.lit("V").alias("sorting"), "unit_id", t.alias("sample_index")),
        base.select(F.lit("M"), F.when(u < 6, F.floor(u / 2)).otherwise(u), t + 2),
        base.select(F.lit("Y"), 2 * u + t % 2, t),
        base.where((other % 3 < 2) & (t % 3 == 0)).select(F.lit("Y"), 2 * other + F.when(other % 3 == 0, 1).otherwise(0), t),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return dataset(out, META)


def redundant_sorting(spark: SparkSession, sf_dir: str) -> Dataset:
    """V with most events of its first four units a second time (ids 100 and up), and a few of the next four (200 and up)."""
    v = refractory(spark, sf_dir).spikes
    t = F.col("sample_index")
    again = v.where((F.col("unit_id") < 4) & (t % 5 != 0)).withColumn("unit_id", F.col("unit_id") + 100)
    part = v.where((F.col("unit_id") >= 4) & (F.col("unit_id") < 8) & (t % 4 == 0)).withColumn("unit_id", F.col("unit_id") + 200)
    return dataset(v.union(again).union(part), META)


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("label").cast("long").alias("unit_id"), F.posexplode("embedding").alias("k", "v"))
    sample, channel = F.floor(F.col("k") / CHANNELS).cast("int"), (F.col("k") % CHANNELS).cast("int")
    return rows.groupBy(F.lit("T").alias("sorting"), "unit_id", sample.alias("sample"), channel.alias("channel")).agg(F.avg(F.col("v").cast("double")).alias("value"))


def recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 8 frames, one per embedding, in the order of the ids."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    frames = F.transform(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), lambda s: F.slice("embedding", s * CHANNELS + 1, CHANNELS))
    return rows.select(F.col("vec_id").cast("long").alias("chunk_id"), (F.col("vec_id") * SAMPLES).cast("long").alias("start_frame"), frames.alias("samples"))
