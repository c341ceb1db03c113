"""The ten steps: cleaning single sortings, linking them, and exports.

Times in parameters are in ms.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions.signal import filter_templates
from eventloom.meta import UNIT, Dataset
from eventloom.operators import graph, merging, metrics, pauses, selection, templates, trains
from eventloom.operators.bandjoin import PAIR
from eventloom.registry import step
from eventloom.sources import sinks

WAVEFORMS = {"ms_before": 1.0, "ms_after": 1.0, "max_spikes_per_unit": 500, "filter_band": [150, 9000]}


def with_templates(data: Dataset, wvf: dict) -> Dataset:
    """The dataset with templates, computed from the recording where there are none."""
    if data.templates is not None or data.recording is None:
        return data
    before, after = (max(1, round(data.meta.samples(wvf[k]))) for k in ("ms_before", "ms_after"))
    found = templates.mean_waveforms(data, before, after, wvf.get("max_spikes_per_unit", 500))
    if wvf.get("filter_band"):
        found = filter_templates(found, tuple(wvf["filter_band"]), data.meta.fs)
    return data.replace(templates=found)


def _rules(params: dict) -> dict:
    return {k: v for k, v in params.items() if k != "wvf_extraction"}


def _needs_templates(rules: dict) -> bool:
    return bool({"amplitude", "SNR", "sd_ratio"} & set(rules))


@step("remove_bad_units", {"wvf_extraction": WAVEFORMS}, more=("*",))
def remove_bad_units(data: Dataset, params: dict) -> Dataset:
    rules = _rules(params)
    source = with_templates(data, params["wvf_extraction"]) if _needs_templates(rules) else data
    bad = graph.settle(selection.bad_units(source, rules), "bad")
    return data.without(bad).replace(audit=(*data.audit, bad))


@step("units_categorization", {"wvf_extraction": WAVEFORMS}, more=("*",))
def units_categorization(data: Dataset, params: dict) -> Dataset:
    rules = _rules(params)
    names = {m for c, r in rules.items() if c != "clear" for m in r}
    source = with_templates(data, params["wvf_extraction"]) if _needs_templates(names) else data
    return data.replace(units=selection.categorise(source, rules))


@step("align_units", {"wvf_extraction": {"ms_before": 2.0, "ms_after": 2.0, "max_spikes_per_unit": 1000, "filter_band": [200, 6000]}, "threshold": 0.5, "check_next": 10})
def align_units(data: Dataset, params: dict) -> Dataset:
    source = with_templates(data, params["wvf_extraction"])
    if source.templates is None:
        raise ValueError("align_units needs templates or a recording")
    before = max(1, round(data.meta.samples(params["wvf_extraction"]["ms_before"])))
    shifts = templates.peak_shifts(source.templates, before, params["threshold"], params["check_next"])
    return data.replace(spikes=trains.shift_units(data.spikes, shifts, data.meta.t_max))


@step("remove_duplicated_spikes", {"censored_period": 0.3, "method": "keep_first_iterative"})
def remove_duplicated_spikes(data: Dataset, params: dict) -> Dataset:
    return data.replace(spikes=trains.drop_duplicates(data.spikes, data.meta.samples(params["censored_period"]), params["method"]))


@step(
    "remove_redundant_units",
    {
        "wvf_extraction": {"ms_before": 1.0, "ms_after": 1.5, "max_spikes_per_unit": 500, "filter_band": None},
        "arguments": {"align": True, "delta_time": 0.3, "agreement_threshold": 0.1, "duplicate_threshold": 0.7, "remove_strategy": "highest_amplitude"},
    },
)
def remove_redundant_units(data: Dataset, params: dict) -> Dataset:
    """Of two units that share their events, one goes.

    With align, units are first moved onto their template's peak (where there are templates), as duplicates may be found at different
    parts of a spike; only the comparison uses the moved times.  A pair counts if its agreement reaches agreement_threshold and the
    share of the smaller train duplicate_threshold.  The strategy keeps the larger amplitude, the smaller move (minimum_shift, which
    needs templates), or the larger train (max_spikes).
    """
    args = params["arguments"]
    strategy = args["remove_strategy"]
    if strategy not in ("highest_amplitude", "minimum_shift", "max_spikes"):
        raise ValueError(f"unknown remove_strategy {strategy!r}")
    wanted = args["align"] or strategy != "max_spikes"
    source = with_templates(data, params["wvf_extraction"]) if wanted else data
    if strategy != "max_spikes" and source.templates is None:
        raise ValueError(f"{strategy} needs templates or a recording")
    before = max(1, round(data.meta.samples(params["wvf_extraction"]["ms_before"])))
    moves = graph.settle(templates.extremum_shifts(source.templates, before), "moves") if source.templates is not None else None
    if strategy == "max_spikes":
        rank = trains.unit_counts(data.spikes, data.units).withColumnRenamed("n_spikes", "value")
    elif strategy == "minimum_shift":
        rank = moves.select(*UNIT, (-F.abs("shift")).alias("value"))
    else:
        rank = templates.amplitudes(source.templates)
    seen = data
    if args["align"] and moves is not None:
        seen = data.replace(spikes=trains.shift_units(data.spikes, moves, data.meta.t_max))
    gone, pairs = merging.redundant_units(seen, round(data.meta.samples(args["delta_time"])), args["duplicate_threshold"], rank, args["agreement_threshold"])
    gone = graph.settle(gone, "redundant")
    return data.without(gone).replace(audit=(*data.audit, pairs))


@step(
    "merge_units",
    # Fixed values of the parameter contract.
    {
        "refractory_period": [0.2, 1.0],
        "wvf_extraction": {"ms_before": 1.0, "ms_after": 1.5, "max_spikes_per_unit": 2000, "filter_band": [150, 7000]},
        "correlograms": {"window_ms": 150, "bin_ms": 0.04},
        "auto_merge_params": {
            "steps_params": {
                "correlogram": {"corr_diff_thresh": 0.16, "censor_correlograms_ms": 0.2, "sigma_smooth_ms": 0.6, "adaptive_window_thresh": 0.5},
                "template_similarity": {"template_diff_thresh": 0.25, "max_lag_ms": 0.3},
                "unit_locations": {"max_distance_um": 150.0},
            },
            "firing_contamination_balance": 2.5,
            "resolve_graph": False,
        },
        "differences_folder": None,
    },
)
def merge_units(data: Dataset, params: dict) -> Dataset:
    """Splits of one neuron are merged.

    Pairs of a sorting are candidates if their units are near (where channels are known), their templates and then their correlograms
    alike.  Of a candidate whose merged train scores less than its better unit, the worse unit goes; the others are merged
    for as long as that raises the score.
    """
    auto = params["auto_merge_params"]
    if auto.get("resolve_graph"):
        raise ValueError("merge_units: resolve_graph isn't supported, pairs are resolved by greedy contraction")
    rules = auto["steps_params"]
    balance = auto["firing_contamination_balance"]
    counts = graph.settle(trains.unit_counts(data.spikes, data.units), "counts")
    source = with_templates(data, params["wvf_extraction"])
    pairs = merging.pairs_within(counts.where("n_spikes > 0"))
    if source.templates is not None:
        waves = graph.settle(source.templates, "templates")
        if source.channels is not None:
            places = graph.settle(templates.unit_locations(waves, source.channels), "places")
            pairs = templates.near_units(places.join(counts.where("n_spikes > 0").select(*UNIT), [*UNIT]), rules["unit_locations"]["max_distance_um"])
        lag = int(round(data.meta.samples(rules["template_similarity"].get("max_lag_ms", 0.0))))
        alike = templates.lagged_differences(waves, graph.settle(pairs, "near"), lag)
        pairs = alike.where(F.col("difference") <= rules["template_similarity"]["template_diff_thresh"]).withColumnRenamed("difference", "temp_diff")
    else:
        pairs = pairs.withColumn("temp_diff", F.lit(None).cast("double"))
    pairs = graph.settle(pairs, "alike")
    corr = rules["correlogram"]
    bin_size = max(1, round(data.meta.samples(params["correlograms"]["bin_ms"])))
    bins = max(1, round(data.meta.samples(params["correlograms"]["window_ms"]) / 2 / bin_size))
    censor = int(round(data.meta.samples(corr["censor_correlograms_ms"]) / bin_size))
    differ = merging.pair_correlogram_differences(
        data.spikes, pairs, counts, bins, bin_size, corr["adaptive_window_thresh"], data.meta.samples(corr["sigma_smooth_ms"]) / bin_size, censored=censor, censor_autos=True
    )
    pairs = graph.settle(pairs.join(differ.withColumnRenamed("difference", "corr_diff"), list(PAIR), "left"), "differences")
    if params["differences_folder"]:
        sinks.save_differences(pairs, params["differences_folder"])
    candidates = graph.settle(pairs.where(F.col("corr_diff") <= corr["corr_diff_thresh"]).select(*PAIR), "candidates")
    t_c, t_r = (data.meta.samples(x) for x in params["refractory_period"])
    scores = graph.settle(metrics.unit_scores(data, t_c, t_r, k=balance), "scores")
    tried = graph.settle(merging.merged_scores(data, candidates, t_c, t_r, balance), "tried")
    gone = graph.settle(merging.remove_splits(tried, scores), "splits")
    better = merging.raising(tried, scores)
    rest = data.without(gone)
    left = graph.settle(graph.drop_nodes(better, gone).select(*PAIR), "left")
    spikes, removed = merging.merge_split_units(rest, left, t_c, t_r, t_c, balance)
    why = gone.withColumn("reason", F.lit("split that lowers the score")).union(removed.withColumn("reason", F.lit("merged, or beaten by the best of its group")))
    out = rest.without(removed)
    return out.replace(spikes=spikes, audit=(*data.audit, graph.settle(why, "merge_units")))


@step(
    "merge_sortings",
    # Fixed values of the parameter contract; bin_ms is by default one sample for each 100 ms of max_time begun.
    {
        "refractory_period": [0.2, 1.0],
        "max_shift": 1.33,
        "min_num_sortings": 2,
        "similarity": {"min_similarity": 0.3, "window": 0.2},
        "correlogram_validation": {"max_time": 70.0, "gaussian_std": 0.6, "gaussian_truncate": 5.0},
        "waveform_validation": {"wvf_extraction": {"ms_before": 1.0, "ms_after": 2.0, "max_spikes_per_unit": 1000, "filter_band": [250, 6000]}, "num_channels": 5},
        "merge_check": {"cross_cont_threshold": 0.10},
        "clean_edges": {"template_diff_threshold": 0.10, "corr_diff_threshold": 0.12, "cross_cont_threshold": 0.06},
        "graph_folder": None,
    },
    multi=True,
)
def merge_sortings(data: Dataset, params: dict) -> Dataset:
    """One sorting of consensus units from several: shifts, graph, cleaning, communities, best trains, redundancy."""
    meta = data.meta
    if "require_multiple_sortings_match" in params:
        params = params | {"min_num_sortings": 2 if params["require_multiple_sortings_match"] else 1}
    t_c, t_r = (meta.samples(x) for x in params["refractory_period"])
    window = max(0, round(meta.samples(params["similarity"]["window"])))
    max_shift = max(1, round(meta.samples(params["max_shift"])))
    spikes = graph.settle(trains.drop_duplicates(data.spikes, t_c), "spikes")
    data = selection.without_empty(data.replace(spikes=spikes))
    shifts = graph.settle(trains.cross_shifts(spikes, max_shift), "shifts")
    compared = graph.settle(metrics.compared(data, window, shifts), "compared").join(shifts, list(PAIR), "left").fillna({"shift": 0})

    # Waveforms reach max_shift further on both sides, so that one can be moved onto the other.
    wvf = params["waveform_validation"]["wvf_extraction"]
    wider = wvf | {k: wvf[k] + params["max_shift"] for k in ("ms_before", "ms_after")}
    source = with_templates(data, wider)
    quality = metrics.contaminations(data, t_c, t_r)
    nodes = quality.select(*UNIT, F.col("value").alias("contamination"))
    if source.templates is not None and source.recording is not None:
        nodes = nodes.join(templates.sd_ratios(source).withColumnRenamed("value", "sd_ratio"), [*UNIT], "left")
    else:
        nodes = nodes.withColumn("sd_ratio", F.lit(None).cast("double"))
    nodes = graph.settle(nodes, "nodes")
    kept, edges = graph.similarity_graph(nodes, compared, params["similarity"]["min_similarity"], params["min_num_sortings"])
    kept, edges = graph.settle(kept.drop("component"), "kept"), graph.settle(edges, "edges")
    members = data.only(kept)

    # How different are the ends of each edge?
    corr = params["correlogram_validation"]
    differ = merging.edge_correlogram_differences(
        members.spikes, edges, trains.unit_counts(members.spikes), meta, corr["max_time"], corr.get("bin_ms"), corr["gaussian_std"], corr["gaussian_truncate"], window, max_shift
    )
    edges = edges.join(differ.withColumnRenamed("difference", "corr_diff"), list(PAIR), "left")
    if source.templates is not None:
        margin = max_shift if data.templates is None else 0
        crop = None
        if margin:
            before, after = (max(1, round(meta.samples(wider[k]))) for k in ("ms_before", "ms_after"))
            crop = (margin, before + after - 1 - margin)
        waves = templates.template_differences(source.templates, edges, params["waveform_validation"]["num_channels"], crop)
        edges = edges.join(waves.withColumnRenamed("difference", "temp_diff"), list(PAIR), "left")
    else:
        edges = edges.withColumn("temp_diff", F.lit(None).cast("double"))
    clean = params["clean_edges"]
    values = quality.select(*UNIT, F.coalesce("value", F.lit(0.0)).alias("value"))
    p = metrics.cross_contaminations_of(members.spikes, meta.t_max, t_c, t_r, clean["cross_cont_threshold"], values, edges.select(*PAIR, "shift"))
    edges = graph.settle(edges.join(p.select(*PAIR, "p_value"), list(PAIR), "left"), "edges")
    if params["graph_folder"]:
        sinks.save_graph(kept, edges, f"{params['graph_folder']}/similarity_graph")
    audit = [*data.audit]

    check = params["merge_check"]
    if check:
        bad, judged = graph.merged_units(members, edges, kept, shifts, t_c, t_r, check["cross_cont_threshold"])
        kept, edges = kept.join(bad.select(*UNIT), [*UNIT], "left_anti"), graph.drop_nodes(edges, bad)
        audit.append(judged)
    kept, edges, why = graph.clean_edges(kept, edges, clean["template_diff_threshold"], clean["corr_diff_threshold"])
    kept, edges = graph.settle(kept, "kept"), graph.settle(edges, "edges")
    audit.append(why)
    if data.units.select("sorting").distinct().count() >= 4:
        kept, edges, why = graph.separate_communities(kept, edges, params["min_num_sortings"])
        kept, edges = graph.settle(kept, "kept"), graph.settle(edges, "edges")
        audit.append(why)

    if params["graph_folder"]:
        sinks.save_graph(kept, edges, f"{params['graph_folder']}/final_graph")
    scores = metrics.unit_scores(data, t_c, t_r, nodes.select(*UNIT, F.col("sd_ratio").alias("value")))
    chosen, choice = merging.merge_components(data, graph.components(kept, edges), shifts, scores, t_c, t_r, params["min_num_sortings"])
    merged = graph.settle(merging.renumbered(chosen), "merged")
    out_units = merged.select(*UNIT).distinct().withColumn("category", F.lit(None).cast("string"))
    out = data.replace(spikes=merged, units=out_units, templates=None, audit=(*audit, choice))
    stay = graph.settle(merging.remove_redundant(out, window, t_c, t_r), "stay")
    return out.only(stay)


@step("find_purkinje_cells", {"cross_corr_pause": [0, 8], "threshold": 0.4, "ss_min_fr": 40.0, "cs_min_fr": 0.5, "cs_max_fr": 3.0})
def find_purkinje_cells(data: Dataset, params: dict) -> Dataset:
    """Units of a pausing pair get a note with the pairs they are in."""
    first, last = params["cross_corr_pause"]
    if not -12 <= first < last <= 12:
        raise ValueError("cross_corr_pause must be an increasing pair within 12 ms")
    ms = max(1, round(data.meta.samples(1.0)))
    pairs = pauses.pausing_pairs(data, (first, last), params["threshold"], params["ss_min_fr"], (params["cs_min_fr"], params["cs_max_fr"]), 12 * ms, ms)
    one = F.concat_ws("-", F.col("u1").cast("string"), F.col("u2").cast("string"))
    rows = pairs.select("sorting", F.col("u1").alias("unit_id"), one.alias("pair")).union(pairs.select("sorting", "u2", one))
    notes = rows.groupBy(*UNIT).agg(F.array_join(F.array_sort(F.collect_list("pair")), " ; ").alias("pausing"))
    return data.replace(units=data.units.drop("pausing").join(notes, [*UNIT], "left"))


@step("export_to_phy", {"wvf_extraction": {"ms_before": 1.0, "ms_after": 3.0, "max_spikes_per_unit": 1000, "filter_band": None}, "export_sortings": False}, exports=True, more=("path", "estimate_contamination"))
def export_to_phy(data: Dataset, params: dict) -> Dataset:
    source = with_templates(data, params["wvf_extraction"])
    contaminated = None
    for category, periods in params.get("estimate_contamination", {}).items():
        part, _ = selection.split_dataset(data, selection.category_filter(category))
        found = metrics.contaminations(part, *(data.meta.samples(x) for x in periods)).select(*UNIT, "value")
        contaminated = found if contaminated is None else contaminated.union(found)
    sinks.export_phy(source, params["path"], contamination=contaminated)
    return data


@step("export_to_sigui", {"wvf_extraction": {"ms_before": 1.0, "ms_after": 3.0, "max_spikes_per_unit": 1000, "filter_band": None}, "spike_amplitudes": False, "principal_components": 0, "export_sortings": False}, exports=True, more=("path",))
def export_to_sigui(data: Dataset, params: dict) -> Dataset:
    """Tables of spikes, units, templates, the random events that templates are made of and their waveforms, and if asked for amplitudes and components."""
    wvf = params["wvf_extraction"]
    source = with_templates(data, wvf)
    recorded = source.recording is not None
    chosen = graph.settle(templates.sampled_spikes(data.spikes, wvf.get("max_spikes_per_unit", 500)), "random_spikes")
    waves = None
    if recorded:
        before, after = (max(1, round(data.meta.samples(wvf[k]))) for k in ("ms_before", "ms_after"))
        waves = templates.event_frames(chosen.select(*UNIT, "sample_index"), source.recording, before, after)
    amps = templates.spike_amplitudes(source) if params["spike_amplitudes"] and recorded and source.templates is not None else None
    sinks.export_tables(source, params["path"], amps, int(params["principal_components"]) or None, chosen, waves)
    return data
