"""From a graph of similar units to one train per neuron, and merging of split units."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.stats import contamination
from eventloom.meta import UNIT, Dataset, RecordingMeta
from eventloom.operators.bandjoin import PAIR, antisymmetric, coincidences, correlogram_of, violations
from eventloom.operators.graph import best_per_component, components, greedy_removal, settle
from eventloom.operators.metrics import BALANCE, agreement, contaminations, score, similarity, unit_scores
from eventloom.operators.templates import correlogram_differences
from eventloom.operators.trains import consensus, drop_duplicates, unit_counts


def on_one_clock(data: Dataset, members: DataFrame, shifts: DataFrame | None) -> DataFrame:
    """Events of the members with the time of their component's first unit (by sorting, then id)."""
    first = members.groupBy("component").agg(F.min(F.struct(*UNIT)).alias("ref"))
    placed = members.join(first, "component")
    if shifts is None:
        placed = placed.withColumn("shift", F.lit(0))
    else:
        ways = antisymmetric(shifts)
        link = (placed["ref.sorting"] == ways["s1"]) & (placed["ref.unit_id"] == ways["u1"]) & (placed["sorting"] == ways["s2"]) & (placed["unit_id"] == ways["u2"])
        placed = placed.join(ways, link, "left").select(*members.columns, F.coalesce("shift", F.lit(0)).alias("shift"))
    events = data.spikes.join(placed.select(*UNIT, "component", "shift"), [*UNIT])
    return events.withColumn("sample_index", F.col("sample_index") + F.col("shift")).drop("shift")


def merge_components(
    data: Dataset,
    members: DataFrame,
    shifts: DataFrame | None,
    scores: DataFrame,
    censored: float,
    refractory: float,
    min_sortings: int = 2,
) -> tuple[DataFrame, DataFrame]:
    """(component, sample_index) of the best train of each component, and (component, label, score) of the choice.

    Candidates are the member trains and their consensus (runs within censored // 2 samples found by at least
    sqrt(members) of them); components of fewer than min_sortings units are skipped.
    """
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= min_sortings)
    members = settle(members.join(sizes, "component"), "members")
    events = settle(on_one_clock(data, members, shifts).join(sizes, "component"), "clocked")
    window = int(round(censored)) // 2
    common = consensus(events.where("size > 1"), ["component"], window, F.ceil(F.sqrt(F.col("size"))))
    common = settle(common.select("component", "sample_index"), "consensus")
    as_units = common.select(F.lit("consensus").alias("sorting"), F.to_json("component").alias("unit_id"), "component", "sample_index")
    counts = as_units.groupBy("sorting", "unit_id", "component").agg(F.count(F.lit(1)).alias("n_spikes"))
    broken = violations(as_units, refractory)
    judged = counts.join(broken, ["sorting", "unit_id"], "left").fillna({"n_violations": 0.0})
    c = contamination(F.col("n_spikes"), F.col("n_violations"), data.meta.t_max, censored, refractory)
    rate = F.col("n_spikes") * F.lit(data.meta.fs) / F.lit(float(data.meta.t_max))
    candidates = judged.select("component", F.lit(None).cast("string").alias("sorting"), F.lit(None).cast("long").alias("unit_id"), score(rate, F.coalesce(c, F.lit(0.0))).alias("score"))
    own = members.join(scores.select(*UNIT, "score"), [*UNIT]).select("component", "sorting", F.col("unit_id").cast("long").alias("unit_id"), "score")
    order = Window.partitionBy("component").orderBy(F.desc("score"), F.col("sorting").isNull(), "sorting", "unit_id")
    best = own.union(candidates).withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")
    best = settle(best, "best")
    from_units = events.join(best.select("component", *UNIT), ["component", *UNIT], "left_semi").select("component", "sample_index")
    from_common = common.join(best.where("sorting is null").select("component"), "component", "left_semi")
    label = F.coalesce(F.concat_ws(":", "sorting", F.col("unit_id").cast("string")), F.lit(""))
    choice = best.select("component", F.when(F.col("sorting").isNull(), "consensus").otherwise(label).alias("label"), "score")
    return from_units.union(from_common), choice


def renumbered(trains: DataFrame, name: str = "merged_sorting") -> DataFrame:
    """(sorting, unit_id, sample_index) of trains by component; unit ids 0, 1, ... by component."""
    ids = trains.select("component").distinct()
    ids = ids.withColumn("unit_id", (F.row_number().over(Window.orderBy("component")) - 1).cast("long"))
    return trains.join(ids, "component").select(F.lit(name).alias("sorting"), "unit_id", "sample_index")


def remove_redundant(data: Dataset, window: int, censored: float, refractory: float) -> DataFrame:
    """Units of a merged sorting that stay.

    Of pairs of agreement above 0.5, in order, the lower score goes; of what is left, groups joined by a similarity above
    0.75 keep their best.
    """
    quality = contaminations(data, censored, refractory)
    scores = quality.select(*UNIT, score(F.col("n_spikes"), F.coalesce("value", F.lit(0.0))).alias("score"))
    scores = settle(scores, "scores")
    pairs = coincidences(data.spikes, window, same=True).where("u1 < u2")
    pairs = settle(similarity(agreement(pairs, unit_counts(data.spikes)), data.meta.t_max), "pairs")
    # In row order of the lower triangle, the larger id comes first.
    lower = pairs.where("agreement > 0.5").select(F.col("s2").alias("s1"), F.col("u2").alias("u1"), F.col("s1").alias("s2"), F.col("u1").alias("u2"))
    gone = settle(greedy_removal(lower, scores), "gone")
    left = scores.join(gone, [*UNIT], "left_anti")
    close = pairs.where("similarity > 0.75")
    for k in ("1", "2"):
        close = close.join(gone.toDF(f"s{k}", f"u{k}"), [f"s{k}", f"u{k}"], "left_anti")
    groups = components(left, close.select("s1", "u1", "s2", "u2"))
    return best_per_component(groups, left).select(*UNIT)


def redundant_units(data: Dataset, window: int, threshold: float, rank: DataFrame, min_agreement: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(removed, pairs): in each pair of units of a sorting that shares at least threshold of the smaller train, the lower rank goes.

    rank: (sorting, unit_id, value), the higher stays; ties keep the smaller id.  Pairs of an agreement below min_agreement don't
    count.  Pairs are judged in order.
    """
    pairs = coincidences(data.spikes, window, same=True).where("u1 < u2")
    pairs = similarity(agreement(pairs, unit_counts(data.spikes)), data.meta.t_max)
    pairs = settle(pairs.where((F.col("similarity") >= threshold) & (F.col("agreement") >= min_agreement)), "redundant")
    scores = settle(rank.select(*UNIT, F.coalesce("value", F.lit(0.0)).alias("score")), "rank")
    ordered = pairs.select(F.col("s2").alias("s1"), F.col("u2").alias("u1"), F.col("s1").alias("s2"), F.col("u1").alias("u2"))
    return greedy_removal(ordered, scores), pairs.select("s1", "u1", "s2", "u2", "similarity")


def pairs_within(units: DataFrame) -> DataFrame:
    """All pairs (s1, u1, s2, u2), u1 < u2, of units of one sorting; rows are units, never events."""
    one, two = units.select(*UNIT).toDF("s1", "u1"), units.select(*UNIT).toDF("s2", "u2")
    return one.join(two, F.col("s1") == F.col("s2")).where("u1 < u2")


def pair_correlogram_differences(
    spikes: DataFrame, pairs: DataFrame, counts: DataFrame, bins: int, bin_size: int, half_height: float, sigma: float, truncate: float = 5.0, censored: int = 0, margin: int = 0, censor_autos: bool = False
) -> DataFrame:
    """difference per pair (s1, u1, s2, u2[, shift]) of ``correlogram_differences``: correlograms are counted for these pairs and their units alone."""
    pairs = pairs if "shift" in pairs.columns else pairs.withColumn("shift", F.lit(0))
    pairs = pairs.select(*PAIR, "shift")
    units = settle(pairs.select("s1", "u1").union(pairs.select("s2", "u2")).distinct().toDF(*UNIT), "ends")
    diagonal = units.select(F.col("sorting").alias("s1"), F.col("unit_id").alias("u1"), F.col("sorting").alias("s2"), F.col("unit_id").alias("u2"))
    wanted = pairs.select(*PAIR).union(diagonal).withColumn("shift", F.lit(0))
    lags = settle(correlogram_of(spikes.join(units, [*UNIT], "left_semi"), wanted, bins * bin_size, bin_size), "correlograms").drop("shift")
    autos = lags.where("s1 = s2 and u1 = u2").select(F.col("s1").alias("sorting"), F.col("u1").alias("unit_id"), "bin", "n")
    crosses = pairs.withColumn("shift", F.round(F.col("shift") / bin_size).cast("int")).join(lags, list(PAIR), "left").fillna({"bin": 0, "n": 0})
    return correlogram_differences(autos, crosses, counts, bins, half_height, sigma, truncate, censored, margin, censor_autos)


def edge_correlogram_differences(
    spikes: DataFrame, edges: DataFrame, counts: DataFrame, meta: RecordingMeta, max_time: float, bin_ms: float | None, std: float, truncate: float, censored: int, max_shift: int
) -> DataFrame:
    """difference per edge (s1, u1, s2, u2, shift): correlograms over max_time ms on both sides, those of edges emptied around lag 0, all
    smoothed, and cropped by max_shift (censored and max_shift in samples), crosses about their shift."""
    bin_ms = 1e3 / meta.fs * (1 + max_time // 100) if bin_ms is None else bin_ms
    bin_size = max(1, round(meta.samples(bin_ms)))
    bins = max(1, round(meta.samples(max_time) / bin_size))
    margin = min(max_shift // bin_size + 1, max(0, bins - 1))
    return pair_correlogram_differences(
        spikes, edges, counts, bins, bin_size, 0.5, meta.samples(std) / bin_size, truncate, max(1, censored // bin_size) if censored else 0, margin
    )


def _together(data: Dataset, pairs: DataFrame, duplicates: float) -> DataFrame:
    """(sorting, unit_id, sample_index, s1, u1, u2): the events of both units of each pair as one train, without duplicates.

    unit_id here is a hash of the pair.
    """
    ends = pairs.select(*PAIR, F.xxhash64(*PAIR).alias("pair")).distinct()
    ends = ends.select("s1", "u1", "u2", "pair", F.explode(F.array("u1", "u2")).alias("unit_id"))
    events = data.spikes.join(ends, (data.spikes["sorting"] == ends["s1"]) & (data.spikes["unit_id"] == ends["unit_id"]))
    train = events.select(F.col("s1").alias("sorting"), F.col("pair").alias("unit_id"), "sample_index")
    return drop_duplicates(train, duplicates)


def merged_scores(data: Dataset, pairs: DataFrame, censored: float, refractory: float, k: float = BALANCE, duplicates: float | None = None) -> DataFrame:
    """merged_score per pair (s1, u1, s2, u2): the score of both trains as one.  Pairs' trains stay DataFrames."""
    pairs = pairs.select(*PAIR).distinct()
    train = settle(_together(data, pairs, censored if duplicates is None else duplicates), "together")
    both = data.replace(spikes=train, units=train.select(*UNIT).distinct(), templates=None)
    scores = unit_scores(both, censored, refractory, k=k).select(F.col("unit_id").alias("pair"), F.col("score").alias("merged_score"))
    return pairs.withColumn("pair", F.xxhash64(*PAIR)).join(scores, "pair").drop("pair")


def _with_scores(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    one, two = scores.select(*UNIT, "score").toDF("s1", "u1", "score1"), scores.select(*UNIT, "score").toDF("s2", "u2", "score2")
    return pairs.join(one, ["s1", "u1"]).join(two, ["s2", "u2"])


def raising(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """The pairs whose merged score isn't below that of their better unit."""
    return _with_scores(pairs, scores).where(F.col("merged_score") >= F.greatest("score1", "score2")).select(*pairs.columns)


def remove_splits(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """Units that lower the score when merged: of each pair whose merged score is below its better one, the lower goes (ties: the second).

    pairs: (s1, u1, s2, u2, merged_score).
    """
    worse = _with_scores(pairs, scores).where(F.col("merged_score") < F.greatest("score1", "score2"))
    gone = F.when(F.col("score1") < F.col("score2"), F.struct(F.col("s1").alias("sorting"), F.col("u1").alias("unit_id"))).otherwise(
        F.struct(F.col("s2").alias("sorting"), F.col("u2").alias("unit_id"))
    )
    return worse.select(gone.alias("g")).select("g.*").distinct()


def merge_split_units(data: Dataset, candidates: DataFrame, censored: float, refractory: float, duplicates: float, k: float = BALANCE) -> tuple[DataFrame, DataFrame]:
    """(sorting, unit_id, sample_index) after merging, and the units that are gone.

    candidates: pairs (s1, u1, s2, u2) of one sorting.  Each component of candidates is contracted greedily: of all its edges the merge of
    highest score (ties: the first by ids) is made if it beats every single unit of the component, under the smaller id; else the best unit stays (ties: the
    smallest id) and the others go.  Ids and edges of merged units are the smaller one's.

    All components take a step a round; trains stay DataFrames, and only edges of units that changed are scored again, so a round costs the
    changed trains.  The rounds are as many as the largest component has units.
    """
    schema = data.spikes.schema
    u1, u2 = F.least("u1", "u2").alias("u1"), F.greatest("u1", "u2").alias("u2")
    edges = settle(candidates.where("s1 = s2 and u1 <> u2").select("s1", u1, "s2", u2).distinct(), "edges")
    comps = components(data.units, edges).withColumn("c", F.xxhash64("component")).select(*UNIT, "c")
    several = edges.select("s1", "u1").union(edges.select("s2", "u2")).toDF(*UNIT).distinct()
    members = settle(comps.join(several, [*UNIT], "left_semi"), "members")
    single = settle(unit_scores(data.only(members), censored, refractory, k=k).select(*UNIT, "score").join(members, [*UNIT]), "single")
    edges = edges.join(members.toDF("s1", "u1", "c"), ["s1", "u1"])
    train = settle(data.spikes.select("sorting", "unit_id", "sample_index").join(members.select(*UNIT), [*UNIT], "left_semi"), "train")
    scored = settle(edges.join(merged_scores(data.replace(spikes=train), edges, censored, refractory, k, duplicates), list(PAIR)), "scored")
    while not scored.isEmpty():
        best = scored.groupBy("c").agg(F.max_by(F.struct("u1", "u2", "merged_score"), F.struct("merged_score", (-F.col("u1")).alias("a"), (-F.col("u2")).alias("b"))).alias("b"))
        top = single.groupBy("c").agg(F.max("score").alias("top"), F.max_by("unit_id", F.struct("score", (-F.col("unit_id")).alias("a"))).alias("winner"))
        step = settle(best.join(top, "c").select("c", "b.*", "top", "winner").withColumn("raises", F.col("merged_score") > F.col("top")), "step")
        done = step.where("not raises").select("c", "winner")
        made = step.where("raises").select("c", "u1", "u2", "merged_score")
        # Components that are done keep their best unit.
        lost = single.join(done, "c").where("unit_id <> winner").select(*UNIT)
        gone_now = made.join(single.select("c", F.col("unit_id").alias("u2"), "sorting"), ["c", "u2"]).select("sorting", F.col("u2").alias("unit_id"), F.col("u1").alias("into"))
        lost, gone_now = settle(lost, "lost"), settle(gone_now, "joined")
        kept_unit = gone_now.select("sorting", F.col("into").alias("unit_id"))
        touched = kept_unit.union(gone_now.select(*UNIT)).distinct()
        same = train.join(touched.union(lost), [*UNIT], "left_anti")
        moved = train.join(gone_now, [*UNIT]).select("sorting", F.col("into").alias("unit_id"), "sample_index")
        moved = drop_duplicates(moved.union(train.join(kept_unit, [*UNIT], "left_semi")), duplicates)
        train = settle(same.union(moved), "train")
        scores = made.select("c", F.col("u1").alias("unit_id"), F.col("merged_score").alias("new"))
        single = single.join(done.select("c"), "c", "left_anti").join(gone_now.select(*UNIT), [*UNIT], "left_anti").join(scores, ["c", "unit_id"], "left")
        single = settle(single.select(*UNIT, F.coalesce("new", "score").alias("score"), "c"), "single")
        # Edges of the unit that went are its partner's; those of a changed unit are scored again.
        next_edges = scored.join(done.select("c"), "c", "left_anti")
        into = gone_now.select(F.col("sorting").alias("s1"), F.col("unit_id").alias("old"), "into")
        for x in ("u1", "u2"):
            next_edges = next_edges.join(into.withColumnsRenamed({"old": x, "into": f"_{x}"}), ["s1", x], "left")
        changed = F.col("_u1").isNotNull() | F.col("_u2").isNotNull()
        next_edges = next_edges.withColumn("_changed", changed).withColumns({"u1": F.coalesce("_u1", "u1"), "u2": F.coalesce("_u2", "u2")})
        next_edges = next_edges.where("u1 <> u2").select("s1", u1, "s2", u2, "c", "merged_score", "_changed")
        fresh = kept_unit.select(F.col("sorting").alias("s1"), F.col("unit_id").alias("_k")).distinct()
        for x in ("u1", "u2"):
            next_edges = next_edges.join(fresh.withColumnRenamed("_k", x).withColumn(f"_f_{x}", F.lit(True)), ["s1", x], "left")
        again = F.col("_changed") | F.coalesce("_f_u1", F.lit(False)) | F.coalesce("_f_u2", F.lit(False))
        next_edges = settle(next_edges.withColumn("_again", again).groupBy(*PAIR, "c").agg(F.max("_again").alias("_again"), F.max("merged_score").alias("merged_score")), "edges")
        todo = next_edges.where("_again").select(*PAIR, "c")
        new = todo.join(merged_scores(data.replace(spikes=train), todo, censored, refractory, k, duplicates), list(PAIR))
        columns = [*PAIR, "c", "merged_score"]
        scored = settle(next_edges.where("not _again").select(*columns).union(new.select(*columns)), "scored")
    gone = settle(members.select(*UNIT).join(train.select(*UNIT).distinct(), [*UNIT], "left_anti"), "gone")
    others = data.spikes.join(members.select(*UNIT), [*UNIT], "left_anti").select(*schema.names)
    return settle(others.union(train.select(*schema.names)), "merged"), gone
