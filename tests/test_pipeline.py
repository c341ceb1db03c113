import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom import pipeline, registry
from eventloom.meta import RecordingMeta, dataset
from eventloom.operators import merging
from eventloom.operators.selection import category_filter
from eventloom.sources import sinks, tables

SPIKES = "sorting string, unit_id long, sample_index long"
STEPS = {"remove_duplicated_spikes": {"all": {}}, "remove_bad_units": {"all": {"firing_rate": {"min": 0.1}}}, "merge_sortings": {"all": {}}}


@pytest.fixture(scope="module")
def planted(spark):
    rng, rows, t_max = np.random.default_rng(0), [], 300_000
    truth = {u: np.cumsum(rng.integers(60, 900, 400)) for u in range(3)}
    for name, jitter, loss, shift in (("a", 0, 0.0, 0), ("b", 3, 0.1, 0), ("c", 1, 0.2, 7)):
        for u, t in truth.items():
            t = t[(t < t_max - 50) & (rng.random(len(t)) >= loss)]
            rows += [(name, u, int(x) + int(rng.integers(0, jitter + 1)) + shift) for x in t]
    return dataset(spark.createDataFrame(rows, SPIKES), RecordingMeta(30_000.0, t_max))


def counts(data):
    return sorted((r["sorting"], r["unit_id"], r["count"]) for r in data.spikes.groupBy("sorting", "unit_id").count().collect())


def test_merges_planted_units_and_resumes(spark, planted, tmp_path):
    logs = str(tmp_path / "logs")
    steps = STEPS | {"merge_sortings": {"all": {"graph_folder": str(tmp_path / "graphs")}}}
    first = pipeline.Pipeline(planted, steps, logs).run()
    assert [(s, u) for s, u, _ in counts(first)] == [("merged_sorting", u) for u in range(3)]
    assert all(n > 380 for _, _, n in counts(first))
    assert spark.read.parquet(f"{tmp_path}/graphs/final_graph/edges").count() == 9
    again = pipeline.Pipeline(planted.replace(spikes=planted.spikes.limit(0)), STEPS, logs).run()
    assert counts(again) == counts(first)


def test_categories_and_splits(planted):
    steps = {"units_categorization": {"all": {"big": {"firing_rate": {"min": 38}}}}, "remove_bad_units_2": {"rest": {"all": {}}}}
    out = pipeline.Pipeline(planted, steps).run()
    kept = {(r["sorting"], r["category"]) for r in out.units.collect()}
    assert kept <= {("a", "big"), ("b", "big"), ("c", "big")} and ("a", "big") in kept and ("c", "big") not in kept
    some = pipeline.Pipeline(planted, {"remove_bad_units": {"all": {"all": {}, "sortings": ["a"]}}}).run()
    assert {s for s, _, _ in counts(some)} == {"b", "c"}


def test_selector(spark):
    df = spark.createDataFrame([(0, "CS"), (1, "MF"), (2, None), (3, ""), (4, "G")], "unit_id long, category string")
    got = lambda c: sorted(r["unit_id"] for r in df.where(category_filter(c)).collect())
    assert [got(c) for c in ("CS", "MF+G", "rest", "rest+CS", "all", "none")] == [[0], [1, 4], [2, 3], [0, 2, 3], [0, 1, 2, 3, 4], []]


def test_registry():
    assert registry.find("remove_bad_units_12").name == "remove_bad_units"
    with pytest.raises(ValueError):
        registry.find("fly")
    assert set(registry.STEPS) == {"align_units", "export_to_phy", "export_to_sigui", "find_purkinje_cells", "merge_sortings", "merge_units", "remove_bad_units", "remove_duplicated_spikes", "remove_redundant_units", "units_categorization"}


def test_empty_inputs(spark):
    meta = RecordingMeta(30_000.0, 100_000)
    none = dataset(spark.createDataFrame([], SPIKES), meta)
    assert counts(pipeline.Pipeline(none, STEPS).run()) == []
    one = dataset(spark.createDataFrame([("a", 0, t) for t in (100, 300)], SPIKES), meta)
    out = pipeline.Pipeline(one, {"merge_sortings": {"all": {"min_num_sortings": 1}}}).run()
    assert counts(out) == [("merged_sorting", 0, 2)]


def test_merge_and_redundant_units(spark):
    rng, t_max = np.random.default_rng(2), 600_000
    whole = np.cumsum(rng.integers(60, 900, 900))
    whole = whole[whole < t_max]
    half = rng.random(len(whole)) < 0.5
    other = np.cumsum(rng.integers(60, 1200, 700))
    rows = [("a", 0, int(t)) for t in whole[half]] + [("a", 1, int(t)) for t in whole[~half]] + [("a", 2, int(t)) for t in other if t < t_max]
    rows += [("a", 3, int(t) + 1) for t in other if t < t_max]
    data = dataset(spark.createDataFrame(rows, SPIKES), RecordingMeta(30_000.0, t_max))
    left = pipeline.Pipeline(data, {"remove_redundant_units": {"all": {"arguments": {"remove_strategy": "max_spikes"}}}}).run()
    assert [u for _, u, _ in counts(left)] in ([0, 1, 2], [0, 1, 3])
    pairs = spark.createDataFrame([("a", 0, "a", 1)], "s1 string, u1 long, s2 string, u2 long")
    merged, gone = merging.merge_split_units(left, pairs, 6.0, 30.0, 6.0)
    assert [tuple(r) for r in gone.collect()] == [("a", 1)]
    merged = merged.groupBy("unit_id").count().collect()
    assert sorted(r["count"] for r in merged) == sorted([len(whole), int((other < t_max).sum())])
    again = pipeline.Pipeline(left, {"merge_units": {"all": {}}}).run()
    assert again.spikes.count() <= left.spikes.count()


def test_readers_and_writers(spark, tmp_path):
    folder = tmp_path / "phy"
    folder.mkdir()
    np.save(folder / "spike_times.npy", np.array([5, 9, 11, 40]))
    np.save(folder / "spike_clusters.npy", np.array([1, 0, 1, 1], "int32"))
    spikes = tables.read_sortings(spark, {"one": str(folder), "two": str(folder)})
    assert sorted((r["unit_id"], r["sample_index"]) for r in spikes.where("sorting = 'one'").collect()) == [(0, 9), (1, 5), (1, 11), (1, 40)]
    with pytest.raises(FileNotFoundError):
        tables.read_sorting(spark, "x", str(tmp_path / "none"))
    data = dataset(spikes, RecordingMeta(30_000.0, 100))
    data = data.replace(units=data.units.withColumn("category", F.when(F.col("unit_id") == 0, "x")))
    out = sinks.export_phy(data, str(tmp_path / "out"))
    assert out == [str(tmp_path / "out" / n) for n in ("one", "two")]
    assert np.load(f"{out[1]}/spike_times.npy").tolist() == [5, 9, 11, 40]
    assert np.load(f"{out[1]}/spike_clusters.npy").tolist() == [1, 0, 1, 1]
    assert open(f"{out[0]}/cluster_category.tsv").read() == "cluster_id\tcategory\n0\tx\n1\t"
    assert sinks.output_path("p", "s", 1) == "p" and sinks.output_path("p/", "s", 2) == "p/s"
    with pytest.raises(AssertionError):
        sinks.write_tsv(str(tmp_path / "a.tsv"), "a", [1], [])


def test_places(spark):
    from eventloom.operators import templates

    rows = [("a", u, 0, c, v) for u, peaks in enumerate(([4, 0, 0], [3, 1, 0], [0, 0, 5])) for c, v in enumerate(map(float, peaks))]
    waves = spark.createDataFrame(rows, "sorting string, unit_id long, sample int, channel int, value double")
    channels = spark.createDataFrame([(c, 0.0, 20.0 * c) for c in range(3)], "channel int, x double, y double")
    places = templates.unit_locations(waves, channels)
    assert {r["unit_id"]: r["y"] for r in places.collect()} == {0: 0.0, 1: 5.0, 2: 40.0}
    pairs = spark.createDataFrame([("a", 0, "a", 1), ("a", 0, "a", 2)], "s1 string, u1 long, s2 string, u2 long")
    assert [r["u2"] for r in templates.near_pairs(pairs, places, 10).collect()] == [1]
    rng = np.random.default_rng(2)
    spots = [(s, u, *map(float, rng.uniform(-60, 60, 2))) for s in "ab" for u in range(40)] + [("a", 99, None, None), ("a", 100, 0.0, 0.0), ("a", 101, 20.0, 0.0)]
    found = templates.near_units(spark.createDataFrame(spots, "sorting string, unit_id long, x double, y double"), 20.0)
    want = {(s, u, r, v) for s, u, x, y in spots for r, v, p, q in spots if s == r and u < v and x is not None and p is not None and np.hypot(x - p, y - q) <= 20.0}
    assert {tuple(r) for r in found.collect()} == want and ("a", 100, "a", 101) in want


def test_raw_recording_and_templates(spark, tmp_path):
    from eventloom.functions.signal import band_pass, filter_recording
    from eventloom.operators import templates

    rng = np.random.default_rng(1)
    frames = rng.normal(0, 10, (4000, 3)).astype("int16")
    at = list(range(100, 3900, 97))
    for t in at:
        frames[t - 2 : t + 3, 1] += np.array([-20, -90, -200, -90, -20], "int16")
    (tmp_path / "rec.raw").write_bytes(frames.tobytes())
    meta, chunks = tables.read_recording(spark, {"fs": 30_000, "t_max": 4000, "n_channels": 3, "path": str(tmp_path / "rec.raw"), "dtype": "int16", "chunk_frames": 700, "preprocessing": {"cache": {}}})
    data = dataset(spark.createDataFrame([("a", 0, t) for t in at], SPIKES), meta, recording=chunks)
    found = templates.mean_waveforms(data, 5, 5)
    data = data.replace(templates=found)
    best = templates.top_channels(found, 1).first()
    assert best["channel"] == 1 and templates.peak_shifts(found, 5).first()["shift"] == 0
    assert templates.signal_to_noise(data).first()["value"] > 10 and templates.sd_ratios(data).count() == 1
    whole = band_pass(frames.astype(float), (None, 3000.0), 30_000.0)
    smooth = filter_recording(chunks, (None, 3000.0), 30_000.0, 100).orderBy("start_frame").collect()
    joined = np.concatenate([np.array(r["samples"]) for r in smooth])
    assert np.abs(joined - whole)[50:-50].max() < 0.5


def test_command_line(spark, tmp_path):
    from eventloom.__main__ import main

    rows = spark.createDataFrame([(0, t) for t in range(100, 90_000, 300)], "unit_id long, sample_index long")
    rows.write.parquet(str(tmp_path / "one"))
    params = {"recording": {"fs": 30_000, "t_max": 100_000}, "sortings": {"one": "$PARAMS_FOLDER/one"}, "logs_folder": "$PARAMS_FOLDER/logs", "pipeline": {"remove_duplicated_spikes": {"all": {}}}}
    (tmp_path / "p.json").write_text("// comment\n" + json.dumps(params))
    assert main([str(tmp_path / "p.json")]) == 0
    assert spark.read.parquet(str(tmp_path / "logs/remove_duplicated_spikes/spikes")).count() == 300
    with pytest.raises(SystemExit):
        main([])


def test_streams(spark, tmp_path):
    from eventloom.streaming import trains

    rows = [("a", 0, t, f"2024-01-01 00:00:{t // 1000:02d}") for t in (1000, 1006, 1012, 9000, 40_000)]
    df = spark.createDataFrame(rows, "sorting string, unit_id long, sample_index long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = trains.drop_duplicates(stream, 9).writeStream.format("memory").queryName("kept").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["sample_index"] for r in spark.table("kept").collect()) == [1000, 1012, 9000, 40_000]
    query = trains.consensus(stream, ["unit_id"], "3 seconds", 2, "1 second").writeStream.format("memory").queryName("groups").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r["size"], r["sample_index"]) for r in spark.table("groups").collect()] == [(3, 1006)]


# Merging of split units.


def brute_score(times, t_max, censored, refractory, k=2.5):
    """The score of a train from all its pairs, in plain Python (whole periods: pairs at the border count half)."""
    n = len(times)
    broken = 0.0
    for i, x in enumerate(times):
        for y in times[i + 1 :]:
            if y - x > refractory:
                break
            broken += 0.5 if y - x == refractory else 1.0
    left = 1 - broken * (t_max - 2 * n * censored) / (n * n * (refractory - censored))
    c = 1.0 if left < 0 else 1 - left**0.5
    return n * 30_000.0 / t_max * (1 - (k + 1) * c)


def brute_merging(trains, pairs, t_max, censored, refractory, duplicates):
    """unit -> train after greedy contraction of each component, in plain Python."""

    def joined(x, y):
        kept = []
        for t in sorted([*x, *y]):
            if not kept or t - kept[-1] > duplicates:
                kept.append(t)
        return kept

    trains, edges, out = {u: sorted(t) for u, t in trains.items()}, {tuple(sorted(p)) for p in pairs}, {}
    label = {u: u for u in trains}
    for _ in trains:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    for root in set(label.values()):
        own = {u: t for u, t in trains.items() if label[u] == root}
        near = {e for e in edges if label[e[0]] == root}
        while near:
            best = max(sorted(near), key=lambda e: brute_score(joined(own[e[0]], own[e[1]]), t_max, censored, refractory))
            merged = joined(own[best[0]], own[best[1]])
            if brute_score(merged, t_max, censored, refractory) <= max(brute_score(t, t_max, censored, refractory) for t in own.values()):
                top = max(sorted(own), key=lambda u: brute_score(own[u], t_max, censored, refractory))
                own, near = {top: own[top]}, set()
                break
            own[best[0]] = merged
            del own[best[1]]
            near = {tuple(sorted(best[0] if u == best[1] else u for u in e)) for e in near}
            near = {e for e in near if e[0] != e[1]}
        out |= own
    return out


def split_trains(seed, t_max=200_000):
    """Three neurons, dealt to units 0-2, 3-5 and 6-8; units 9 and 10 are apart, 10 being a mixture."""
    rng, trains = np.random.default_rng(seed), {}
    for n in range(3):
        whole = np.cumsum(rng.integers(45, 700, 500))
        whole = whole[whole < t_max]
        part = rng.integers(0, 3, len(whole))
        for k in range(3):
            trains[3 * n + k] = sorted({int(t) for t in whole[part == k]} | {int(t) + 2 for t in whole[part == (k + 1) % 3][:15]})
    trains[9] = sorted(int(t) for t in np.cumsum(rng.integers(45, 900, 200)) if t < t_max)
    trains[10] = sorted(int(t) for t in rng.integers(0, t_max, 500))
    return trains, [(0, 1), (1, 2), (3, 4), (4, 5), (3, 5), (6, 7), (7, 8), (5, 10), (9, 9)]


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_contraction_event_by_event(spark, seed):
    t_max = 200_000
    trains, pairs = split_trains(seed, t_max)
    rows = [("a", u, t) for u, x in trains.items() for t in x] + [("b", u, t) for u, x in trains.items() if u < 3 for t in x]
    data = dataset(spark.createDataFrame(rows, SPIKES), RecordingMeta(30_000.0, t_max))
    edges = spark.createDataFrame([("a", *p) for p in pairs] + [("b", 1, 0)], "s1 string, u1 long, u2 long").selectExpr("s1", "u1", "s1 as s2", "u2")
    merged, gone = merging.merge_split_units(data, edges, 4.0, 40.0, 4.0)
    for name, own, links in (("a", trains, pairs), ("b", {u: t for u, t in trains.items() if u < 3}, [(0, 1)])):
        want = brute_merging(own, links, t_max, 4.0, 40.0, 4.0)
        got = {}
        for r in merged.where(F.col("sorting") == name).collect():
            got.setdefault(r["unit_id"], []).append(r["sample_index"])
        assert {u: sorted(t) for u, t in got.items()} == want
        assert {r["unit_id"] for r in gone.where(F.col("sorting") == name).collect()} == set(own) - set(want)
    assert len(brute_merging(trains, pairs, t_max, 4.0, 40.0, 4.0)) < len(trains) - 3


def test_merge_units_step(spark, tmp_path):
    """Splits are merged, and a contaminated split that lowers the score goes."""
    rng, t_max = np.random.default_rng(5), 400_000
    whole = np.cumsum(rng.integers(60, 500, 1500))
    whole = whole[whole < t_max - 10]
    half = rng.random(len(whole)) < 0.5
    noise = rng.integers(0, t_max, 900)
    units = {0: whole[half], 1: whole[~half], 2: np.r_[whole[::3], noise], 3: np.cumsum(rng.integers(60, 3000, 200))}
    rows = [("a", u, int(t)) for u, x in units.items() for t in x if t < t_max]
    data = dataset(spark.createDataFrame(rows, SPIKES), RecordingMeta(30_000.0, t_max))
    shape = {0: 1.0, 1: 1.02, 2: 1.05, 3: -1.0}
    waves = [("a", u, k, c, float(f * v * (1 + c))) for u, f in shape.items() for k, v in enumerate([0, -1, -6, -2, 1, 0]) for c in range(3)]
    data = data.replace(templates=spark.createDataFrame(waves, "sorting string, unit_id long, sample int, channel int, value double"))
    # Bins of 2 ms: so few events say little in bins of 0.04 ms.
    params = {"correlograms": {"window_ms": 100, "bin_ms": 2.0}, "auto_merge_params": {"steps_params": {"correlogram": {"corr_diff_thresh": 0.4}}}}
    out = pipeline.Pipeline(data, {"merge_units": {"all": params}}).run()
    assert sorted(r["unit_id"] for r in out.units.collect()) == [0, 3]
    assert sorted(r["sample_index"] for r in out.spikes.where("unit_id = 0").collect()) == whole.tolist()
    assert {(r["unit_id"], r["reason"][:5]) for r in out.audit[-1].collect()} == {(1, "merge"), (2, "split")}
    # With places known, and differences kept; units too far apart aren't compared.
    placed = data.replace(channels=spark.createDataFrame([(c, 0.0, 20.0 * c) for c in range(3)], "channel int, x double, y double"))
    near = pipeline.Pipeline(placed, {"merge_units": {"all": params | {"differences_folder": str(tmp_path)}}}).run()
    assert sorted(r["unit_id"] for r in near.units.collect()) == [0, 3]
    kept = spark.read.parquet(f"{tmp_path}/differences")
    assert {(r["u1"], r["u2"]) for r in kept.collect()} == {(0, 1), (0, 2), (1, 2)} and kept.where("corr_diff is null or temp_diff > 0.25").count() == 0


def test_merged_units_gives_every_verdict(spark):
    from eventloom.plans import queries

    found = queries.merged_unit_verdicts(spark, "/root/testdata/sf0.01").groupBy("verdict").count().collect()
    assert {"node", "neighbour 2", "split", "unclear"} <= {r["verdict"] for r in found}
    gone = {(r["sorting"], r["unit_id"]) for r in queries.merged_units(spark, "/root/testdata/sf0.01").collect()}
    assert {("M", 0), ("M", 1), ("M", 2)} <= gone and all(s in "MY" for s, _ in gone)


def test_binomial_tail_where_doubles_of_the_finite_sum_overflow():
    from decimal import Decimal, localcontext

    from eventloom.functions.stats import binomial_tail

    # The SQL's sum for these gives infinity times zero; in decimals it is exact.
    for x, n in ((13954, 81005717.42466305), (13414, 97461141.0), (1984, 6331444.340163529)):
        with localcontext(prec=400) as context:
            context.Emin, p, whole, term = -999_999, Decimal(60 / 432_000), Decimal(1), Decimal(1)
            for i in range(x):
                term *= (Decimal(n) - x + i) / (i + 1) * p
                whole += term
            want = 1 - ((Decimal(n) - x) * (1 - p).ln()).exp() * whole
        assert binomial_tail(x, n, 60 / 432_000) == pytest.approx(float(want), rel=1e-6)


# Redundant units.


def test_strategies_for_redundant_units(spark):
    rng, t_max = np.random.default_rng(8), 300_000
    base = np.cumsum(rng.integers(60, 900, 500))
    base = base[base < t_max - 100]
    rows = [("a", 0, int(t)) for t in base] + [("a", 1, int(t) + 20) for t in base[: len(base) * 9 // 10]] + [("a", 2, int(t)) for t in rng.integers(0, t_max, 300)]
    data = dataset(spark.createDataFrame(rows, SPIKES), RecordingMeta(30_000.0, t_max))
    # Unit 0 peaks 3 samples early, unit 1 (larger) 23 samples early: the same spikes once they are aligned.
    def wave(peak, size):
        return [size if k == peak else 0.0 for k in range(75)]

    waves = [("a", u, k, 0, float(v)) for u, x in {0: wave(27, 5.0), 1: wave(7, 9.0), 2: wave(30, 4.0)}.items() for k, v in enumerate(x)]
    data = data.replace(templates=spark.createDataFrame(waves, "sorting string, unit_id long, sample int, channel int, value double"))

    def left(**args):
        return sorted(r["unit_id"] for r in pipeline.Pipeline(data, {"remove_redundant_units": {"all": {"arguments": args}}}).run().units.collect())

    assert left() == [1, 2]
    assert left(remove_strategy="minimum_shift") == [0, 2]
    assert left(remove_strategy="max_spikes") == [0, 2]
    assert left(align=False) == [0, 1, 2]
    assert left(agreement_threshold=0.95) == [0, 1, 2]
    with pytest.raises(ValueError):
        left(remove_strategy="luck")


# Readers, parameters and resuming.


def test_several_raw_files_count_on(spark, tmp_path):
    frames = np.random.default_rng(0).integers(-900, 900, (95, 4)).astype("<i2")
    (tmp_path / "whole").mkdir()
    (tmp_path / "parts").mkdir()
    (tmp_path / "whole" / "a.raw").write_bytes(frames.tobytes())
    for k, (a, b) in enumerate(((0, 20), (20, 61), (61, 95))):
        (tmp_path / "parts" / f"rec{k}.raw").write_bytes(frames[a:b].tobytes())

    def read(path):
        rows = sorted(tables.read_raw(spark, str(path), "<i2", 4, 10).collect(), key=lambda r: r["start_frame"])
        assert [r["chunk_id"] for r in rows] == list(range(len(rows)))
        assert [r["start_frame"] for r in rows] == np.cumsum([0, *[len(r["samples"]) for r in rows]])[:-1].tolist()
        return np.concatenate([np.array(r["samples"]) for r in rows])

    assert (read(tmp_path / "whole") == frames).all() and (read(tmp_path / "parts") == frames).all()
    (tmp_path / "whole" / "b.raw").write_bytes(b"123")
    with pytest.raises(ValueError):
        read(tmp_path / "whole")


def test_common_reference_is_the_median(spark):
    rng = np.random.default_rng(4)
    for n in (1, 2, 4, 5):
        rows = rng.integers(-50, 50, (30, n)).astype(float)
        chunks = spark.createDataFrame([(0, 0, rows.tolist())], "chunk_id long, start_frame long, samples array<array<float>>")
        got = np.array(tables.common_reference(chunks, RecordingMeta(1.0, 30)).first()["samples"])
        assert np.allclose(got, rows - np.median(rows, axis=1, keepdims=True))


PROBE = {"probes": [{"contact_positions": [[0.0, 10.0 * k] for k in range(4)], "device_channel_indices": [0, 1, 2, 3]}]}


def test_parameter_files_with_probe_detectors_and_bad_channels(spark, tmp_path):
    rng = np.random.default_rng(1)
    frames = rng.normal(0, 10, (5000, 4))
    frames[:, 2] *= 100
    (tmp_path / "rec.raw").write_bytes(frames.astype("<f4").tobytes())
    (tmp_path / "probe.json").write_text(json.dumps(PROBE))
    runs = []

    @pipeline.detector("every_hundredth")
    def every_hundredth(recording, params):
        runs.append(recording.selectExpr("size(samples[0]) AS n").first()["n"])
        return recording.sparkSession.range(0, 6000, params["step"]).selectExpr("0L AS unit_id", "id AS sample_index")

    params = {
        "recording": {
            "recording_extractor": "binary",
            "extractor_params": {"file_paths": "$PARAMS_FOLDER/rec.raw", "sampling_frequency": 30_000, "num_channels": 4, "dtype": "<f4"},
            "probe_file": "$PARAMS_FOLDER/probe.json",
            "preprocessing": {"remove_bad_channels": {}, "common_reference": {"operator": "median"}},
        },
        "spike_sorting": {"one": {"sorter_name": "every_hundredth", "preprocessing": {"common_reference": {}}, "sorter_params": {"output_folder": "$PARAMS_FOLDER/one", "step": 100}}},
        "analyses": {},
        "steps": {"logs_folder": "$PARAMS_FOLDER/logs", "overwrite_logs": False, "pipeline": {"remove_duplicated_spikes": {"all": {}}}},
    }
    from eventloom import config

    text = json.dumps(params)
    for _ in range(2):
        made = pipeline.from_params(spark, config.loads(text, str(tmp_path)))
        assert [(r["channel"], r["y"]) for r in made.data.channels.orderBy("channel").collect()] == [(0, 0.0), (1, 10.0), (2, 30.0)]
        assert made.data.meta == RecordingMeta(30_000.0, 5000, 3) and len(made.data.recording.first()["samples"][0]) == 3
        assert counts(made.run()) == [("one", 0, 50)]
    assert runs == [3]  # the second time it is read back
    with pytest.raises(ValueError):
        pipeline.from_params(spark, {"recording": {"fs": 1, "t_max": 9}, "spike_sorting": {"x": {"sorter_name": "none"}}, "pipeline": {}})
    with pytest.raises(ValueError):
        pipeline.from_params(spark, {"recording": {"fs": 1, "t_max": 9}})
    with pytest.raises(ValueError):
        tables.read_recording(spark, {"recording_extractor": "none"})


def test_unknown_parameters_are_warned_of():
    with pytest.warns(UserWarning, match="corr_diff_thresh"):
        registry.find("merge_units").params({"corr_diff_thresh": 0.2})
    with pytest.warns(UserWarning, match="arguments:delta"):
        registry.find("remove_redundant_units").params({"arguments": {"delta": 1}})
    registry.find("remove_bad_units").params({"firing_rate": {"min": 1}, "sortings": ["a"]})


def test_audits_survive_a_resume(spark, planted, tmp_path):
    logs = str(tmp_path / "logs")
    first = pipeline.Pipeline(planted, STEPS, logs).run()
    again = pipeline.Pipeline(planted, STEPS, logs).run()
    rows = lambda data: [sorted(map(str, a.collect())) for a in data.audit]
    assert len(first.audit) >= 3 and rows(again) == rows(first)


def test_categories_are_stacked_without_clashes(spark):
    rows = [("a", u, 1000 * k + u) for u in (0, 1, 5) for k in range(50)]
    data = dataset(spark.createDataFrame(rows, SPIKES), RecordingMeta(30_000.0, 100_000))
    second = data.replace(spikes=data.spikes.where("unit_id > 0"), units=data.units.where("unit_id > 0"))
    out = pipeline.Pipeline._stacked(data.replace(spikes=data.spikes.where("unit_id < 5"), units=data.units.where("unit_id < 5")), second)
    assert sorted(r["unit_id"] for r in out.units.collect()) == [0, 1, 5, 6]
    assert [n for _, _, n in counts(out)] == [50] * 4


def test_tables_for_curation(spark, tmp_path):
    frames = np.random.default_rng(3).normal(0, 10, (3000, 2)).astype("float32")
    chunks = spark.createDataFrame([(k, 500 * k, frames[500 * k : 500 * k + 500].tolist()) for k in range(6)], "chunk_id long, start_frame long, samples array<array<float>>")
    data = dataset(spark.createDataFrame([("a", u, 90 * k + 100 + u) for u in range(2) for k in range(30)], SPIKES), RecordingMeta(30_000.0, 3000, 2), recording=chunks)
    wvf = {"ms_before": 0.2, "ms_after": 0.3, "max_spikes_per_unit": 10, "filter_band": None}
    pipeline.Pipeline(data, {"export_to_sigui": {"all": {"path": str(tmp_path), "wvf_extraction": wvf, "spike_amplitudes": True, "principal_components": 2}}}).run()
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}")
    assert read("random_spikes").count() == 20 and read("waveforms").count() == 20 * 15 and read("amplitudes").count() == 60
    r = read("waveforms").where("unit_id = 1 and sample = 0").first()
    assert np.allclose(r["row"], frames[r["sample_index"] - 6])
    assert read("templates").count() == 2 * 15 * 2 and read("components").count() == 4


def test_phy_files_come_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "BLOCK", 7)
    rng = np.random.default_rng(2)
    rows = [("a", int(u), int(t)) for u, t in zip(rng.integers(3, 6, 200), rng.integers(0, 900, 200), strict=True)]
    data = dataset(spark.createDataFrame(rows, SPIKES), RecordingMeta(30_000.0, 1000))
    waves = [("a", u, k, c, float(100 * u + 10 * k + c)) for u in (3, 5) for k in range(4) for c in range(2)]
    data = data.replace(templates=spark.createDataFrame(waves, "sorting string, unit_id long, sample int, channel int, value double"))
    (folder,) = sinks.export_phy(data, str(tmp_path))
    want = sorted((t, u - 3) for _, u, t in rows)
    assert list(zip(np.load(f"{folder}/spike_times.npy").tolist(), np.load(f"{folder}/spike_clusters.npy").tolist(), strict=True)) == want
    cube = np.load(f"{folder}/templates.npy")
    assert cube.shape == (3, 4, 2) and cube[2, 3, 1] == 531 and not cube[1].any()


# Streams.


def stream_of(spark, rows, path):
    df = spark.createDataFrame(rows, "sorting string, unit_id long, sample_index long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    for k, part in enumerate(df.randomSplit([1.0], 1)):
        part.coalesce(1).write.parquet(f"{path}/{k}")
    return spark.readStream.schema(df.schema).option("recursiveFileLookup", True).parquet(str(path))


def test_rates_of_a_stream(spark, tmp_path):
    from eventloom.streaming import trains

    rows = [("a", 0, t, f"2024-01-01 00:00:{t:02d}") for t in (1, 2, 7, 11, 50)]
    found = trains.rates(stream_of(spark, rows, tmp_path / "in"), ["unit_id"], "10 seconds", "5 seconds", "1 second")
    query = found.writeStream.format("memory").queryName("rates").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((r["start"].minute * 60 + r["start"].second, r["n"]) for r in spark.table("rates").collect())
    # The watermark has passed all windows that end by 49 s.
    assert got == [(0, 3), (5, 2), (10, 1), (3595, 2)]


def test_stream_forgets_units_that_ended(spark, tmp_path):
    from eventloom.streaming import trains

    rows = lambda unit, times: [("a", unit, t, f"2024-01-01 00:{t // 60000:02d}:{t // 1000 % 60:02d}") for t in times]
    schema = "sorting string, unit_id long, sample_index long, ts string"
    for k, part in enumerate((rows(0, [1000, 1004]) + rows(1, [2000]), rows(1, [900_000, 900_003]), rows(1, [960_000]))):
        spark.createDataFrame(part, schema).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    source = spark.createDataFrame([], schema).withColumn("ts", F.col("ts").cast("timestamp")).schema
    stream = spark.readStream.schema(source).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = trains.drop_duplicates(stream, 9, "10 seconds").writeStream.format("memory").queryName("alive").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r["unit_id"], r["sample_index"]) for r in spark.table("alive").collect()) == [(0, 1000), (1, 2000), (1, 900_000), (1, 960_000)]
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) == 2 and held[-1] <= 1


# Shipping.


def test_entry_without_the_corpus_part(tmp_path):
    """With the subpackage and its pipeline taken out, the entry module imports and serves the other queries; a fault in the subpackage shows."""
    root = Path(__file__).resolve().parents[1]
    for name in ("eventloom", "__spark_entry__.py"):
        source = root / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    llm = tmp_path / "eventloom" / "llm"
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()))"
    run = lambda: subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": os.environ.get("PYTHONPATH", "")}, capture_output=True, text=True)
    had = llm.exists()
    shutil.rmtree(llm, ignore_errors=True)
    done = run()
    assert done.returncode == 0 and done.stdout.split()[1] == "False" and int(done.stdout.split()[0]) > 60, done.stderr
    if had:
        llm.mkdir()
        (llm / "__init__.py").write_text("import no_such_module\n")
        (tmp_path / "corpus_pipeline.py").write_text("import eventloom.llm\n")
        assert run().returncode != 0


def test_workers_get_the_package_from_any_folder(tmp_path):
    code = """
import sys
sys.path.insert(0, ROOT)
from pyspark.sql import SparkSession
from eventloom import ship
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
ship(spark)
def run(parts):
    import eventloom.functions.signal as s
    for p in parts:
        yield p.assign(where=s.__file__)
print(spark.range(1).mapInPandas(run, "id long, where string").first()["where"])
"""
    root = str(Path(__file__).resolve().parents[1])
    done = subprocess.run([sys.executable, "-c", code.replace("ROOT", repr(root))], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True)
    assert "eventloom.zip" in done.stdout, done.stderr[-2000:]


@pytest.mark.parametrize("name", ["synthetic", "cerebellar_cortex", "quick"])
def test_bundled_parameters_are_known(name):
    import warnings

    from eventloom import config

    with warnings.catch_warnings():
        warnings.simplefilter("error")
        for key, categories in config.fan_out(config.load_default(name, "/x")["pipeline"]).items():
            for given in categories.values():
                assert registry.find(key).params(given).keys() >= given.keys()


def test_merged_trains_are_those_of_the_planted_neurons(spark, planted):
    """Event by event: each merged unit has nearly all events of one neuron (as detector a found them), and no others."""
    out = pipeline.Pipeline(planted, STEPS).run()
    truth, got = {}, {}
    for r in planted.spikes.where("sorting = 'a'").collect():
        truth.setdefault(r["unit_id"], []).append(r["sample_index"])
    for r in out.spikes.collect():
        got.setdefault(r["unit_id"], []).append(r["sample_index"])
    matched = set()
    for times in got.values():
        found = np.array(sorted(times))
        near = {u: np.abs(found[:, None] - np.array(t)[None, :]).min(axis=1) <= 3 for u, t in truth.items()}
        (best,) = [u for u, hit in near.items() if hit.mean() > 0.99]
        assert len(found) >= 0.95 * len(truth[best])
        matched.add(best)
    assert matched == set(truth)
