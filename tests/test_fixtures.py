"""Small cases with known answers.  Those that the contract gives are marked as fixed values; the others are worked out by hand or by brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom import config
from eventloom.functions import stats
from eventloom.meta import RecordingMeta, dataset
from eventloom.operators import bandjoin, graph, metrics, selection, trains
from eventloom.operators import templates as waves

SPIKES = "sorting string, unit_id long, sample_index long"
PAIR = ("s1", "u1", "s2", "u2")


def events(spark, trains_):
    rows = [(s, u, t) for s, units in trains_.items() for u, times in units.items() for t in times]
    return spark.createDataFrame(rows, SPIKES)


def test_coincidence_of_two_sortings(spark):
    # Trains and their coincidences by the contract.
    df = events(spark, {"a": {0: [18, 163, 622, 1197], 1: [161, 300, 894]}, "b": {0: [120, 298, 303, 628], 1: [84, 532, 1092]}})
    got = {(r["u1"], r["u2"]): r["n_coinc"] for r in bandjoin.coincidences(df, 8).collect()}
    assert got == {(0, 0): 1, (1, 0): 2}


def test_coincidence_with_shift(spark):
    df = events(spark, {"a": {0: [100, 200, 400]}, "b": {0: [106, 206, 406]}})
    shift = spark.createDataFrame([("a", 0, "b", 0, -6)], "s1 string, u1 long, s2 string, u2 long, shift int")
    assert bandjoin.coincidences(df, 2).count() == 0
    assert bandjoin.coincidences(df, 2, shift).first()["n_coinc"] == 3


@pytest.mark.parametrize("width", [None, 3, 7, 50])
def test_band_join_against_brute_force(spark, width):
    rng = np.random.default_rng(1)
    a, b = rng.integers(-60, 200, 150).tolist(), rng.integers(-60, 200, 150).tolist()
    left = spark.createDataFrame([(int(x), k) for k, x in enumerate(a)], "ta long, ka long")
    right = spark.createDataFrame([(int(x), k) for k, x in enumerate(b)], "tb long, kb long")
    got = sorted((r["ka"], r["kb"]) for r in bandjoin.band_join(left, right, "ta", "tb", 3, width=width).collect())
    assert got == sorted((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if abs(x - y) <= 3)


def test_weights_and_violations(spark):
    # Border weights of the contract.
    want = {0.02: (0, 1, 0.0396, 0.0002), 0.4: (0, 1, 0.64, 0.08), 1: (1, 1, 0.5, 0.5), 3.5: (3, 4, 0.875, 0.125), 4.73: (4, 5, 0.96355, 0.26645)}
    for window, values in want.items():
        assert stats.border_weights(window) == pytest.approx(values)
    train = [0, 0, 3, 4, 9, 9, 9, 30, 34]
    df = events(spark, {"a": {0: train}})
    for window in (0.4, 1, 3, 3.5, 4.73, 6):
        low, high, at_low, at_high = stats.border_weights(window)
        w = lambda d: 0 if d > high else at_high if d == high else at_low if d == low else 1  # noqa: B023, E731
        brute = sum(w(y - x) for i, x in enumerate(train) for y in train[i + 1 :])
        found = bandjoin.violations(df, window).first()
        assert (found["n_violations"] if found else 0) == pytest.approx(brute)


def test_binomial_tail():
    assert stats.binomial_tail(3, 30.5, 0.1) == pytest.approx(1 - 0.635629357849, abs=1e-5)
    exact = lambda x, n, p: sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(x + 1, n + 1))
    for x, n, p in ((0, 5, 0.2), (4, 9, 0.5), (30, 60, 0.3), (55, 60, 0.3)):
        assert stats.binomial_tail(x, n, p) == pytest.approx(exact(x, n, p), rel=1e-9)
    assert (stats.binomial_tail(-1, 5, 0.5), stats.binomial_tail(5, 5, 0.5)) == (1, 0)


def test_similarity(spark):
    df = events(spark, {"a": {0: [18, 163, 622, 1197], 1: [161, 300, 894]}, "b": {0: [155, 304, 628], 1: [17, 164, 622]}})
    data = dataset(df, RecordingMeta(30_000.0, 27_000_000))
    got = {(r["u1"], r["u2"]): r["similarity"] for r in metrics.compared(data, 5).collect()}
    want = {(0, 1): 1, (1, 0): 1 / 3, (1, 1): 1 / 3}
    assert {k: v for k, v in got.items() if abs(v) > 1e-4} == pytest.approx(want, abs=1e-4)


def test_consensus(spark):
    pooled = sorted([18, 164, 304, 1197, 155, 304, 630, 156, 304, 628])
    df = spark.createDataFrame([(0, t) for t in pooled], "k int, sample_index long")
    for least, n in ((2, 3), (3, 1)):
        assert trains.consensus(df, ["k"], 6, F.lit(least)).count() == n
    even = spark.createDataFrame([(0, 2), (0, 3), (1, 3), (1, 4)], "k int, sample_index long")
    assert sorted(r["sample_index"] for r in trains.consensus(even, ["k"], 1, F.lit(2)).collect()) == [2, 4]


def test_cross_shift(spark):
    # Trains of the contract, of which one pair is shifted.
    one = [(t, k % 2) for k, t in enumerate(range(2000, 100_000, 2000))]
    two = [(t, 0) for t in range(1, 13)] + [(2006, 1), (6006, 1), (10005, 1), (14007, 1), (18006, 1), (22006, 1), (24006, 0), (25648, 2), (30006, 1), (31578, 2)]
    df = spark.createDataFrame([("a", u, t) for t, u in one] + [("b", u, t) for t, u in two], SPIKES)
    got = {(r["u1"], r["u2"]): r["shift"] for r in trains.cross_shifts(df, 30, 1.5).collect()}
    assert {k: v for k, v in got.items() if v} == {(0, 1): -6}


def test_smoothed_rate(spark):
    for times, sigma, reflect, total in (([3, 10, 20], 0.5, None, 2.5), ([3, 10, 19.8], 1.0, (0, 20), 3.0), ([-40, 3, 10, 20, 50], 0.5, (0, 20), 2.5)):
        df = spark.createDataFrame([(0, float(t)) for t in times], "k int, sample_index double")
        step = 0.1
        scaled = df.withColumn("sample_index", F.col("sample_index") * 10)
        reflected = None if reflect is None else tuple(10 * x for x in reflect)
        rate = trains.smoothed_rate(scaled, ["k"], 0, 201, 1, sigma * 10, reflect=reflected).agg(F.sum("rate")).first()[0]
        # Half of the grid's last point lies outside the interval.
        assert rate == pytest.approx(total, abs=0.06), (times, step)


# Waveforms and the shifts that the contract gives for them.
WAVES = [[0, 0, 0, 0, 0, 0, -20, 0], [50, 20, 10, 0, -10, -15, 0, 0], [0, 0, -20, -40, -30, -50, -10, 0], [0, -20, -40, 0, -10, -20, -50, -40]]


@pytest.mark.parametrize("check_next, want", [(0, (3, -3, 0, -1)), (2, (3, -3, 2, -1)), (10, (3, -3, 2, 3))])
def test_peak_shift(spark, check_next, want):
    rows = [("a", u, k, 0, float(v)) for u, w in enumerate(WAVES) for k, v in enumerate(w)]
    df = spark.createDataFrame(rows, "sorting string, unit_id long, sample int, channel int, value double")
    got = {r["unit_id"]: r["shift"] for r in waves.peak_shifts(df, 3, 0.5, check_next).collect()}
    assert tuple(got[u] for u in range(4)) == want


def test_plateau_peaks_at_its_middle(spark):
    rows = [("a", 0, k, 0, float(v)) for k, v in enumerate([0, 1, 5, 5, 5, 1, 0, 0])]
    df = spark.createDataFrame(rows, "sorting string, unit_id long, sample int, channel int, value double")
    assert waves.peak_shifts(df, 0, 0.5, 0).first()["shift"] == 3


def test_shift_keeps_the_recording(spark):
    df = events(spark, {"a": {0: [5, 995], 1: [5, 995]}})
    shifts = spark.createDataFrame([("a", 0, -2), ("a", 1, -10)], "sorting string, unit_id long, shift int")
    got = sorted((r["unit_id"], r["sample_index"]) for r in trains.shift_units(df, shifts, 1000).collect())
    assert got == [(0, 3), (0, 993), (1, 985)]


def test_duplicates(spark):
    df = events(spark, {"a": {0: [200, 850, 851, 852, 936, 2587], 1: [250, 853, 1287]}})
    got = trains.drop_duplicates(df, 9).groupBy("unit_id").count().collect()
    assert {r["unit_id"]: r["count"] for r in got} == {0: 4, 1: 3}
    chain = events(spark, {"a": {0: [0, 6, 12, 18, 24, 100]}})
    kept = lambda m: sorted(r["sample_index"] for r in trains.drop_duplicates(chain, 9, m).collect())
    assert kept("keep_first_iterative") == [0, 12, 24, 100]
    assert kept("keep_first") == [0, 100]
    assert len(kept("random")) == 2
    with pytest.raises(ValueError):
        trains.drop_duplicates(chain, 9, "other")


def test_union_renumbers_clashes(spark):
    ids = lambda x: spark.createDataFrame([(i, k) for k, i in enumerate(x)], "unit_id long, k int")
    got = lambda a, b: sorted(r["new_unit_id"] for r in selection.union_renumbered(ids(a), ids(b), "k").collect())
    assert got([0, 1, 3], [5, 2, 9]) == [0, 1, 2, 3, 5, 9]
    assert {(r["unit_id"], r["new_unit_id"]) for r in selection.union_renumbered(ids([0, 1, 3]), ids([1, 0, 6]), "k").collect()} == {(0, 0), (1, 1), (3, 3), (1, 7), (0, 8), (6, 6)}


# Agreements of the contract's example graph.
GRAPH = {("1", 0, "2", 1): 0.9, ("1", 1, "2", 2): 0.8, ("2", 1, "3", 0): 0.7, ("1", 0, "3", 0): 0.6, ("2", 0, "3", 1): 0.5, ("1", 2, "2", 2): 0.45, ("1", 2, "3", 1): 0.2}


def test_similarity_graph(spark):
    nodes = spark.createDataFrame([(s, u) for s, n in (("1", 3), ("2", 3), ("3", 2)) for u in range(n)] + [("3", 9)], "sorting string, unit_id long")
    pairs = spark.createDataFrame([(*k, v) for k, v in GRAPH.items()], "s1 string, u1 long, s2 string, u2 long, agreement double")
    for least, n in ((1, 9), (2, 8), (3, 3)):
        kept, edges = graph.similarity_graph(nodes, pairs, 0.4, least)
        assert (kept.count(), edges.count()) == (n, {1: 6, 2: 6, 3: 3}[least])


@pytest.mark.parametrize("one_task", [1 << 20, 0])
def test_components_of_long_paths(spark, monkeypatch, one_task):
    monkeypatch.setattr(graph, "ONE_TASK", one_task)
    path = [("a", k, "a", k + 1) for k in range(200) if k % 50 != 49]
    edges = spark.createDataFrame(path, "s1 string, u1 long, s2 string, u2 long")
    nodes = spark.createDataFrame([("a", k) for k in range(202)], "sorting string, unit_id long")
    got = {r["unit_id"]: r["component"]["unit_id"] for r in graph.components(nodes, edges).collect()}
    assert got == {k: k // 50 * 50 if k < 200 else k for k in range(202)} | {200: 200, 201: 201}


def test_clean_edges(spark):
    nodes = spark.createDataFrame([("a", 0, 0.0, 1.0), ("b", 0, 0.0, 1.5), ("c", 0, 0.0, 1.0), ("d", 0, 0.0, 1.0), ("e", 0, 0.3, 1.0)], "sorting string, unit_id long, contamination double, sd_ratio double")
    rows = [
        ("a", 0, "b", 0, 0.9, 0.9, 0.3, 0.3, 0.9),  # problematic, b varies too much
        ("a", 0, "c", 0, 0.9, 0.9, 0.01, 0.01, 0.9),  # good
        ("c", 0, "d", 0, 0.9, 0.9, 0.2, 0.13, 1e-4),  # problematic without a culprit, d is left alone
        ("a", 0, "e", 0, 0.4, 0.9, 0.01, 0.01, 0.9),  # weak with a dirty end
    ]
    edges = spark.createDataFrame(rows, "s1 string, u1 long, s2 string, u2 long, agreement double, similarity double, temp_diff double, corr_diff double, p_value double")
    kept, left, why = graph.clean_edges(nodes, edges)
    assert sorted(r["sorting"] for r in kept.collect()) == ["a", "c"]
    assert [(r["s1"], r["s2"]) for r in left.collect()] == [("a", "c")]
    assert why.count() == 3


def test_communities(spark):
    clique = lambda names: [(a, 0, b, 0, 0.9) for i, a in enumerate(names) for b in names[i + 1 :]]
    rows = [*clique("abcd"), *clique("efgh"), ("d", 0, "e", 0, 0.3), ("x", 0, "y", 0, 0.9)]
    edges = spark.createDataFrame(rows, "s1 string, u1 long, s2 string, u2 long, agreement double")
    nodes = spark.createDataFrame([(s, 0) for s in "abcdefghxyz"], "sorting string, unit_id long")
    kept, left, why = graph.separate_communities(nodes, edges, 2)
    assert left.count() == 13 and kept.count() == 11
    assert [(r['reason'], r['s1'], r['s2']) for r in why.collect()] == [('edge between communities', 'd', 'e')]
    small = [*clique("abcd"), ("d", 0, "e", 0, 0.2), ("e", 0, "f", 0, 0.9)]
    kept, left, why = graph.separate_communities(nodes.where("sorting < 'g'"), spark.createDataFrame(small, edges.schema), 2)
    assert sorted(r["sorting"] for r in kept.collect()) == list("abcd") and left.count() == 6
    assert sorted(r["s1"] for r in why.where("reason = 'small community'").collect()) == ["e", "f"]


def test_redundancies(spark):
    # Removed units, pairs in their order, and the partners that the contract gives.
    removed = spark.createDataFrame([(1,), (2,)], "unit_id long")
    pairs = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate([(1, 5), (2, 8), (8, 13), (2, 7), (3, 4)])], "position int, a long, b long")
    got = {r["unit_id"]: r["partners"] for r in graph.redundancies(removed, pairs).collect()}
    assert got == {1: [5], 2: [8, 7]}


def test_rules_keep_unknown_values(spark):
    df = events(spark, {"a": {0: [1], 1: [1, 40, 90], 2: [1, 5, 9, 400]}})
    data = dataset(df, RecordingMeta(1000.0, 1000))
    bad = selection.bad_units(data, {"ISI_portion": {"max": 0.5, "range": [0, 10]}, "firing_rate": {"max": 4}})
    assert {r["unit_id"]: r["reasons"] for r in bad.collect()} == {2: "ISI_portion > 0.5"}
    tagged = selection.categorise(data, {"x": {"firing_rate": {"min": 1}}, "y": {"firing_rate": {"max": 2}}})
    assert {r["unit_id"]: r["category"] for r in tagged.collect()} == {0: "y", 1: "x", 2: "x"}
    assert selection.bad_units(data, {"all": {}}).count() == 3
    with pytest.raises(ValueError):
        selection.bad_units(data, {"beauty": {"min": 1}})


def test_contamination_of_a_simulated_unit(spark):
    rng = np.random.default_rng(7)
    t_max, clean = 3_000_000, np.cumsum(60 + rng.exponential(900, 4000).astype(int))
    clean = clean[clean < t_max]
    foreign = rng.integers(0, t_max, len(clean) // 9)
    df = events(spark, {"a": {0: [int(x) for x in np.concatenate([clean, foreign])]}})
    value = metrics.contaminations(dataset(df, RecordingMeta(30_000.0, t_max)), 0.0, 50.0).first()["value"]
    assert value == pytest.approx(0.1, abs=0.03)


def test_config(tmp_path):
    # The times are fixed values of the contract.
    text = '{"a": "x//y", /* c */ "b": {"c": 1, "e": {}}, // z\n "p": "$PARAMS_FOLDER/q"}'
    got = config.loads(text, "/home")
    assert got == {"a": "x//y", "b": {"c": 1, "e": {}}, "p": "/home/q"}
    assert config.flatten(got) == {"a": "x//y", "b:c": 1, "b:e": {}, "p": "/home/q"}
    assert config.unflatten(config.flatten(got)) == got
    assert config.merged({"a": 1, "d": {"x": 1}}, {"d": {"y": 2, "x": 3}, "e": 5}) == {"a": 1, "d": {"x": 1, "y": 2}, "e": 5}
    out = config.fan_out({"s": {"c1": {"v": [1]}, "c2;c3": {"v": [2]}}})
    assert out == {"s": {"c1": {"v": [1]}, "c2": {"v": [2]}, "c3": {"v": [2]}}}
    assert out["s"]["c2"]["v"] is not out["s"]["c3"]["v"]
    with pytest.raises(TypeError):
        config.fan_out({"s": 3})
    times = {0.0022: "2ms", 3.7: "3s 700ms", 60.8: "1m 0s", 3700.6: "1h 1m 40s", 99750.9: "1d 3h 42m 30s"}
    assert {t: config.elapsed(t) for t in times} == times
    assert "pipeline" in config.load_default("synthetic", str(tmp_path)) and "pipeline" in config.load_default("params_quick.json", "/x")
    with pytest.raises(ValueError):
        config.load_default("none", "/x")
    assert config.accepted(lambda a, b=1: a, {"a": 1, "c": 2}) == {"a": 1}


def brute_iterative(times, censored):
    kept = []
    for t in sorted(times):
        if not kept or t - kept[-1] > censored:
            kept.append(t)
    return kept


@pytest.mark.parametrize("stretch, batch", [(1 << 20, 10_000), (37, 5), (3, 1)])
def test_sequences_across_stretches_and_batches(spark, monkeypatch, stretch, batch):
    monkeypatch.setattr(trains, "STRETCH", stretch)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        rng = np.random.default_rng(stretch)
        units = {u: sorted(int(t) for t in rng.integers(-50, 400 if u else 120, 150)) for u in range(3)}
        df = events(spark, {"a": units, "b": {0: [5], 1: []}})
        got = {}
        for r in trains.drop_duplicates(df, 2.5).collect():
            got.setdefault((r["sorting"], r["unit_id"]), []).append(r["sample_index"])
        assert {k: sorted(v) for k, v in got.items()} == {("a", u): brute_iterative(t, 2.5) for u, t in units.items()} | {("b", 0): [5]}
        plain = trains.drop_duplicates(df, 2, "keep_first").where("sorting = 'a'").groupBy("unit_id").count().collect()
        assert {r["unit_id"]: r["count"] for r in plain} == {u: 1 + sum(y - x > 2 for x, y in zip(t, t[1:], strict=False)) for u, t in units.items()}
        isi = sorted((r["unit_id"], r["isi"]) for r in trains.intervals(df.where("sorting = 'a'")).collect())
        assert isi == sorted((u, y - x) for u, t in units.items() for x, y in zip(t, t[1:], strict=False))
        want = []
        for u, t in units.items():
            run = [t[0]]
            for x in [*t[1:], 10**9]:
                if x - run[-1] > 3:
                    if len(run) >= 2:
                        want.append((u, round(sum(run) / len(run)), len(run)))
                    run = []
                run.append(x)
        found = trains.consensus(df.where("sorting = 'a'"), ["unit_id"], 3, F.lit(2)).collect()
        assert sorted((r["unit_id"], r["sample_index"], r["size"]) for r in found) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("lengths", [[10] * 12, [7, 13, 3, 20, 1, 16], [60]])
def test_frames_around_events(spark, monkeypatch, lengths):
    rng = np.random.default_rng(len(lengths))
    data = rng.normal(size=(sum(lengths), 2)).round(3)
    chunks, at = [], 0
    for k, n in enumerate(lengths):
        chunks.append((k, at, data[at : at + n].tolist()))
        at += n
    frame = spark.createDataFrame(chunks, "chunk_id long, start_frame long, samples array<array<double>>")
    times = [int(t) for t in rng.integers(-3, at + 3, 40)]
    df = events(spark, {"a": {0: times[:25], 1: times[25:]}})
    for most in (65_536, 3):
        monkeypatch.setattr(waves, "EVENTS_AT_ONCE", most)
        got = sorted((r["unit_id"], r["sample_index"], r["sample"], tuple(r["row"])) for r in waves.event_frames(df, frame, 4, 9).collect())
        want = [(0 if k < 25 else 1, t, s, tuple(data[t - 4 + s])) for k, t in enumerate(times) for s in range(13) if 0 <= t - 4 + s < at]
        assert got == sorted(want)


def test_medians(spark, monkeypatch):
    rng = np.random.default_rng(3)
    sets = {0: rng.normal(0, 5, 501), 1: rng.normal(3, 1e-3, 400), 2: np.array([4.0]), 3: np.array([1.0, 2.0]), 4: np.repeat([0.0, 7.0], 50), 5: np.r_[rng.normal(size=99), 1e12]}
    df = spark.createDataFrame([(k, float(x)) for k, v in sets.items() for x in v] + [(0, None)], "channel int, value double")
    for ranges in (4096, 4):
        monkeypatch.setattr(waves, "RANGES", ranges)
        got = {r["channel"]: r["median"] for r in waves.medians(df, "channel", "value").collect()}
        assert got == {k: pytest.approx(float(np.median(v)), abs=0) for k, v in sets.items()}
    assert waves.medians(df.limit(0), "channel", "value").count() == 0


@pytest.mark.parametrize("one_task", [1 << 20, 0])
def test_components_of_random_graphs(spark, monkeypatch, one_task):
    monkeypatch.setattr(graph, "ONE_TASK", one_task)
    rng = np.random.default_rng(6)
    names = [(s, int(u)) for s in "ba" for u in range(60)]
    pairs = [(*names[i], *names[j]) for i, j in rng.integers(0, 120, (70, 2))]
    label = {x: x for x in names}
    for _ in names:
        for a, b, c, d in pairs:
            label[a, b] = label[c, d] = min(label[a, b], label[c, d])
    edges = spark.createDataFrame(pairs, "s1 string, u1 long, s2 string, u2 long")
    nodes = spark.createDataFrame(names, "sorting string, unit_id long")
    got = {(r["sorting"], r["unit_id"]): tuple(r["component"]) for r in graph.components(nodes, edges).collect()}
    assert got == label
    assert graph.components(nodes, edges.limit(0)).where("component.unit_id <> unit_id").count() == 0


def test_correlogram_by_stretches_counts_what_meeting_events_do(spark, monkeypatch):
    from eventloom.operators import bandjoin

    events = [(s, u, (t * 37 + 11 * u) % 900 - 40) for s in "AB" for u in (0, 1) for t in range(60)] + [("A", 0, 7)] * 3 + [("B", 1, 10_000)]
    spikes = spark.createDataFrame(events, "sorting string, unit_id long, sample_index long")
    wanted = spark.createDataFrame([("A", 0, "B", 0, 0), ("A", 0, "B", 1, 3), ("A", 0, "B", 1, -25), ("A", 0, "A", 0, 0), ("B", 1, "B", 1, 0), ("A", 9, "B", 0, 0)], "s1 string, u1 long, s2 string, u2 long, shift int")
    monkeypatch.setattr(bandjoin, "FEW_BINS", 0)
    want = sorted(map(tuple, bandjoin.correlogram_of(spikes, wanted, 60, 20).collect()))
    monkeypatch.setattr(bandjoin, "LAID_OUT", 128)
    assert sorted(map(tuple, bandjoin.correlogram_by_stretches(spikes, wanted, 60, 20).collect())) == want
