"""Graph operators: nodes are units (sorting, unit_id), edges are pairs (s1, u1, s2, u2).

Graphs are of the size of the units, not of the events, but stay DataFrames: whatever follows an edge is a
join; components of large graphs are found by contraction in a number of rounds that grows with the logarithm of the size.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.meta import UNIT, Dataset
from eventloom.operators.bandjoin import PAIR, antisymmetric


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in a new folder below the cluster's shared one (spark.checkpoint.dir), removed when the application ends.

    Where none is set, a temporary folder of this machine does for a local master; a cluster needs the shared one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="eventloom-"))
        base = spark.sparkContext.getCheckpointDir()
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/eventloom-{name}-{uuid.uuid4().hex}")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    fs.deleteOnExit(folder)
    return f"{folder.toString()}/table"


def settle(df: DataFrame, name: str = "step") -> DataFrame:
    """df written to the shared folder and read back: its lineage ends there and a lost executor costs nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(data: Dataset) -> Dataset:
    """The dataset with its events and units written down."""
    return data.replace(spikes=settle(data.spikes, "spikes"), units=settle(data.units, "units"))


def node(k: int) -> Column:
    return F.struct(F.col(f"s{k}").alias("sorting"), F.col(f"u{k}").alias("unit_id"))


#: Links that one task may join; a graph of more is contracted by rounds.
ONE_TASK = 1 << 20


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(sorting, unit_id, component): component is the smallest node (a struct) that can be reached.

    Links are counted first: up to ONE_TASK of them (some 100 MB) are joined in one task, more by rounds of contraction.
    """
    key = nodes.select(F.struct(*UNIT).alias("node")).distinct()
    links = settle(edges.select(node(1).alias("a"), node(2).alias("b")).where("a <> b").distinct(), "links")
    n = links.count()
    up = _joined(links) if n <= ONE_TASK else _contracted(links)
    rooted = key.join(up, "node", "left").select("node", F.coalesce("to", "node").alias("root"))
    if n <= ONE_TASK:
        return rooted.select("node.sorting", "node.unit_id", F.col("root").alias("component"))
    names = rooted.groupBy("root").agg(F.min("node").alias("component"))
    return rooted.join(names, "root").select("node.sorting", "node.unit_id", "component")


def _joined(links: DataFrame) -> DataFrame:
    """(node, to): the smallest node that each node of links can reach, found in one task."""
    flat = links.select(F.col("a.sorting").alias("s1"), F.col("a.unit_id").alias("u1"), F.col("b.sorting").alias("s2"), F.col("b.unit_id").alias("u2"))

    def join(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = [p for p in parts if len(p)]
        if not every:
            return
        rows = pd.concat(every)
        ends = pd.concat([rows[["s1", "u1"]].set_axis([*UNIT], axis=1), rows[["s2", "u2"]].set_axis([*UNIT], axis=1)])
        names = ends.drop_duplicates().sort_values([*UNIT]).reset_index(drop=True)
        place = pd.Series(np.arange(len(names)), index=pd.MultiIndex.from_frame(names))
        at = place.reindex(pd.MultiIndex.from_frame(ends)).to_numpy()
        a, b, label = at[: len(rows)], at[len(rows) :], np.arange(len(names))
        while (label[a] != label[b]).any():
            x, y = label[a], label[b]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := label[label], label):
                label = up
        yield names.assign(to_sorting=names["sorting"].to_numpy()[label], to_unit=names["unit_id"].to_numpy()[label])

    kind = flat.schema["u1"].dataType.simpleString()
    found = flat.repartition(1).mapInPandas(join, f"sorting string, unit_id {kind}, to_sorting string, to_unit {kind}")
    return found.select(F.struct(*UNIT).alias("node"), F.struct(F.col("to_sorting").alias("sorting"), F.col("to_unit").alias("unit_id")).alias("to"))


def _contracted(links: DataFrame) -> DataFrame:
    """(node, to): one node of its component for each node of links.

    Rounds of contraction: every node joins the neighbour (or itself) of the smallest hash; the hash changes from
    round to round, so that no order of names is a bad one.
    """
    levels: list[DataFrame] = []
    while not links.isEmpty():
        turn = F.lit(len(levels))
        h = lambda c: F.struct(F.xxhash64(c, turn).alias("h"), F.col(c).alias("to"))  # noqa: B023, E731
        both = links.union(links.select("b", "a")).toDF("node", "other")
        up = both.groupBy("node").agg(F.min(h("other")).alias("best"))
        up = settle(up.select("node", F.least("best", h("node"))["to"].alias("to")))
        levels.append(up)
        joined = links.join(up.toDF("a", "ra"), "a").join(up.toDF("b", "rb"), "b").where("ra <> rb")
        links = settle(joined.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())

    def then(later: DataFrame, earlier: DataFrame) -> DataFrame:
        moved = earlier.join(later.toDF("to", "next"), "to", "left")
        return moved.select("node", F.coalesce("next", "to").alias("to"))

    return reduce(then, reversed(levels)) if levels else links.toDF("node", "to")


def drop_nodes(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges of which neither end is gone."""
    g = gone.select(*UNIT).distinct()
    return edges.join(g.toDF("s1", "u1"), ["s1", "u1"], "left_anti").join(g.toDF("s2", "u2"), ["s2", "u2"], "left_anti")


def both_ways(edges: DataFrame) -> DataFrame:
    """(s, u, other_s, other_u) of each edge in both directions."""
    one = edges.select(*PAIR).toDF("s", "u", "other_s", "other_u")
    return one.union(edges.select("s2", "u2", "s1", "u1"))


def similarity_graph(nodes: DataFrame, compared: DataFrame, min_agreement: float, min_sortings: int) -> tuple[DataFrame, DataFrame]:
    """Nodes with their component, and edges of at least min_agreement; components of too few sortings go."""
    edges = settle(compared.where(F.col("agreement") >= min_agreement), "edges")
    comps = settle(components(nodes, edges), "components")
    sizes = comps.groupBy("component").agg(F.count_distinct("sorting").alias("n")).where(F.col("n") >= min_sortings)
    kept = settle(comps.join(sizes.select("component"), "component", "left_semi"), "nodes")
    ends = kept.select(*UNIT)
    kept_edges = edges.join(ends.toDF("s1", "u1"), ["s1", "u1"], "left_semi").join(ends.toDF("s2", "u2"), ["s2", "u2"], "left_semi")
    return nodes.join(kept, [*UNIT]), kept_edges


def neighbour_pairs(edges: DataFrame) -> DataFrame:
    """(s, u, other_s, v1, v2): nodes with two neighbours of one other sorting, v1 < v2."""
    ways = both_ways(edges)
    a = ways.toDF("s", "u", "other_s", "v1")
    b = ways.toDF("s", "u", "other_s", "v2")
    return a.join(b, ["s", "u", "other_s"]).where("v1 < v2")


#: Periods in ms and limit of the test of a node against single neighbours (fixed values of the contract).
NEIGHBOUR_PERIODS, NEIGHBOUR_LIMIT = (0.4, 1.8), 0.10


def merged_units(data: Dataset, edges: DataFrame, nodes: DataFrame, shifts: DataFrame, censored: float, refractory: float, limit: float) -> tuple[DataFrame, DataFrame]:
    """(sorting, unit_id) of the nodes to remove, and the judged pairs (audit).

    nodes: (sorting, unit_id, contamination, sd_ratio); shifts as of ``cross_shifts``.  A node with two neighbours of one
    sorting either merges two neurons or they are splits of one.  Both neighbours are put on the node's clock, and the p-value of
    their cross-contamination decides:

    * above 5e-3 they may be splits: nothing happens;
    * the node is removed if it is dirtier than both, and p < 1e-8 or it also varies more than both; its further pairs aren't looked at;
    * else the node is tested against each neighbour.  The neighbour tested first is the cleaner one, the other is the second
      (the first by id if they are equally clean), while the removals go by id: neighbour 1 goes if the node's p with the first is below 5e-3, the estimate with the
      second below 0.1, and neighbour 1 is dirtier than the node by more than 0.03; or else neighbour 2 likewise.

    Pairs of a node are judged in the order of sorting and ids.  Comparisons with unknown values are false.
    """
    from eventloom.operators.metrics import contaminations, cross_contaminations_of

    ways = antisymmetric(shifts)
    on_clock = lambda k: ways.select(F.col("s1").alias("s"), F.col("u1").alias("u"), F.col("s2").alias("other_s"), F.col("u2").alias(f"v{k}"), F.col("shift").alias(f"shift{k}"))
    pairs = neighbour_pairs(edges).distinct()
    for k in (1, 2):
        pairs = pairs.join(on_clock(k), ["s", "u", "other_s", f"v{k}"], "left").fillna(0, [f"shift{k}"])
    own = nodes.select(*UNIT, "contamination", "sd_ratio")
    pairs = pairs.join(own.toDF("s", "u", "c", "sd"), ["s", "u"])
    for k in (1, 2):
        pairs = pairs.join(own.toDF("other_s", f"v{k}", f"c{k}", f"sd{k}"), ["other_s", f"v{k}"])
    pairs = settle(pairs, "neighbour_pairs")
    if pairs.isEmpty():
        return nodes.select(*UNIT).limit(0), pairs

    members = data.spikes
    quality = nodes.select(*UNIT, F.coalesce("contamination", F.lit(0.0)).alias("value"))
    two = pairs.select(F.col("other_s").alias("s1"), F.col("v1").alias("u1"), F.col("other_s").alias("s2"), F.col("v2").alias("u2"), (F.col("shift2") - F.col("shift1")).alias("shift"))
    inside = cross_contaminations_of(members, data.meta.t_max, censored, refractory, limit, quality, two.distinct())
    inside = inside.select(F.col("s1").alias("other_s"), F.col("u1").alias("v1"), F.col("u2").alias("v2"), F.col("shift").alias("between"), F.col("estimate").alias("cross"), "p_value")
    judged = pairs.withColumn("between", F.col("shift2") - F.col("shift1")).join(inside, ["other_s", "v1", "v2", "between"])

    # The node against each neighbour, by longer periods; the node is the reference.
    near = [data.meta.samples(x) for x in NEIGHBOUR_PERIODS]
    dirt = contaminations(data, *near).select(*UNIT, F.coalesce("value", F.lit(0.0)).alias("value"))
    each = pairs.select("s", "u", "other_s", F.explode(F.array(*[F.struct(F.col(f"v{k}").alias("v"), F.col(f"shift{k}").alias("shift")) for k in (1, 2)])).alias("n"))
    each = each.select(F.col("s").alias("s1"), F.col("u").alias("u1"), F.col("other_s").alias("s2"), F.col("n.v").alias("u2"), "n.shift").distinct()
    tested = settle(cross_contaminations_of(members, data.meta.t_max, *near, NEIGHBOUR_LIMIT, dirt, each, first=True), "tested")
    for k in (1, 2):
        judged = judged.join(tested.select(F.col("s1").alias("s"), F.col("u1").alias("u"), F.col("s2").alias("other_s"), F.col("u2").alias(f"v{k}"), F.col("estimate").alias(f"cross{k}"), F.col("p_value").alias(f"p{k}")), ["s", "u", "other_s", f"v{k}"])

    sure = lambda c: F.coalesce(c, F.lit(False))
    swapped = sure(F.col("c2") < F.col("c1"))
    first = {x: F.when(swapped, F.col(f"{x}2")).otherwise(F.col(f"{x}1")) for x in ("p", "cross")}
    second = {x: F.when(swapped, F.col(f"{x}1")).otherwise(F.col(f"{x}2")) for x in ("p", "cross")}
    worse = lambda x: sure((F.col(x) > F.col(f"{x}1")) & (F.col(x) > F.col(f"{x}2")))
    apart = sure(F.col("p_value") <= 5e-3)
    merged = worse("c") & sure((F.col("p_value") < 1e-8) | ((F.col("p_value") < 5e-3) & worse("sd")))
    one_bad = sure((first["p"] < 5e-3) & (second["cross"] < 0.1) & (F.col("c1") > F.col("c") + 0.03))
    two_bad = sure((second["p"] < 5e-3) & (first["cross"] < 0.1) & (F.col("c2") > F.col("c") + 0.03))
    verdict = F.when(~apart, "split").when(merged, "node").when(one_bad, "neighbour 1").when(two_bad, "neighbour 2").otherwise("unclear")
    judged = judged.withColumn("verdict", verdict)
    order = Window.partitionBy("s", "u").orderBy("other_s", "v1", "v2")
    earlier = F.max(F.col("verdict") == "node").over(order.rowsBetween(Window.unboundedPreceding, -1))
    judged = settle(judged.withColumn("_late", F.coalesce(earlier, F.lit(False))).where("not _late").drop("_late"), "judged")
    gone = judged.where("verdict = 'node'").select("s", "u")
    for k in (1, 2):
        gone = gone.union(judged.where(f"verdict = 'neighbour {k}'").select("other_s", f"v{k}"))
    return settle(gone.toDF(*UNIT).distinct(), "merged"), judged


def clean_edges(
    nodes: DataFrame,
    edges: DataFrame,
    template_threshold: float = 0.10,
    correlogram_threshold: float = 0.12,
    sd_step: float = 0.20,
    contamination_step: float = 0.08,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges that stay, and what was done to which edge (audit).

    nodes: (sorting, unit_id, contamination, sd_ratio).  edges: agreement, similarity, temp_diff, corr_diff and
    p_value of cross-contamination.  Weak edges (agreement below 0.5) take contaminated ends (above 0.15) with
    them.  A problematic edge takes the end that varies more than its contamination explains, or else goes alone; nodes
    that lose their last edge that way go too.  Conditions on unknown values are false.
    """
    own = nodes.select(*UNIT, "contamination", "sd_ratio")
    e = edges.join(own.toDF("s1", "u1", "c_1", "sd_1"), ["s1", "u1"]).join(own.toDF("s2", "u2", "c_2", "sd_2"), ["s2", "u2"])
    sure = lambda c: F.coalesce(c, F.lit(False))
    weak = F.col("agreement") < 0.5
    problem = (
        sure((F.col("p_value") < 5e-3) & (F.col("temp_diff") > template_threshold) & (F.col("corr_diff") > correlogram_threshold))
        | sure((F.col("p_value") < 0.80) & (F.col("similarity") < 0.60) & (F.col("temp_diff") > 0.05) & (F.col("corr_diff") > 0.05))
        | sure(F.col("temp_diff") > 0.25)
    )
    step = sd_step / contamination_step
    first = sure((F.col("sd_1") - F.col("sd_2") > (F.col("c_2") - F.col("c_1")) * step + sd_step) & (F.col("sd_1") > 1.05))
    second = sure((F.col("sd_2") - F.col("sd_1") > (F.col("c_1") - F.col("c_2")) * step + sd_step) & (F.col("sd_2") > 1.05))
    action = F.when(problem & first, "node1").when(problem & second, "node2").when(problem, "edge").otherwise("keep")
    judged = settle(
        e.withColumn("action", action).withColumn("weak1", weak & sure(F.col("c_1") > 0.15)).withColumn("weak2", weak & sure(F.col("c_2") > 0.15)),
        "judged",
    )
    one = judged.where((F.col("action") == "node1") | F.col("weak1")).select("s1", "u1")
    two = judged.where((F.col("action") == "node2") | F.col("weak2")).select("s2", "u2")
    gone = settle(one.union(two).toDF(*UNIT).distinct(), "gone")
    left = drop_nodes(judged, gone)
    kept_edges = left.where("action <> 'edge'")
    cut_ends = both_ways(left.where("action = 'edge'")).select("s", "u").toDF(*UNIT).distinct()
    held = both_ways(kept_edges).select("s", "u").toDF(*UNIT).distinct()
    alone = cut_ends.join(held, [*UNIT], "left_anti")
    kept_nodes = nodes.join(gone.union(alone), [*UNIT], "left_anti")
    return kept_nodes, kept_edges.select(*edges.columns), judged.select(*PAIR, "action", "weak1", "weak2").where("action <> 'keep' or weak1 or weak2")


def louvain(edges: list[tuple[int, int, float]], n: int, resolution: float = 0.95) -> list[int]:
    """Community of each node 0..n-1: Louvain with sweeps in the order of the nodes, so that reruns agree."""
    weights: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        weights[a][b] = weights[a].get(b, 0.0) + w
        if a != b:
            weights[b][a] = weights[b].get(a, 0.0) + w
    member = list(range(n))
    while True:
        size = len(weights)
        degree = [sum(w.values()) + w.get(i, 0.0) for i, w in enumerate(weights)]
        total = sum(degree) / 2
        if not total:
            return member
        home, load = list(range(size)), degree[:]
        moved = any_move = True
        any_move = False
        while moved:
            moved = False
            for i in range(size):
                into: dict[int, float] = {}
                for j, w in weights[i].items():
                    if j != i:
                        into[home[j]] = into.get(home[j], 0.0) + w
                load[home[i]] -= degree[i]
                gain = lambda c: into.get(c, 0.0) - resolution * degree[i] * load[c] / (2 * total)  # noqa: B023, E731
                best = home[i]
                for c in sorted(into):
                    if gain(c) > gain(best) + 1e-12:
                        best = c
                moved |= best != home[i]
                home[i] = best
                load[best] += degree[i]
            any_move |= moved
        names = {c: k for k, c in enumerate(sorted(set(home)))}
        member = [names[home[m]] for m in member]
        if not any_move or len(names) == size:
            return member
        merged: list[dict[int, float]] = [{} for _ in names]
        for i, w in enumerate(weights):
            for j, x in w.items():
                if j >= i:
                    a, b = names[home[i]], names[home[j]]
                    merged[a][b] = merged[a].get(b, 0.0) + x
                    if a != b:
                        merged[b][a] = merged[b].get(a, 0.0) + x
        weights = merged


def separate_communities(nodes: DataFrame, edges: DataFrame, min_sortings: int, resolution: float = 0.95) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges after cutting between the communities of each component, and what went (audit: cut edges and removed units).

    Communities are weighted by agreement.  Of a component with several, those of min_sortings nodes or fewer go.
    """
    comps = settle(components(nodes, edges), "components")
    labelled = edges.join(comps.select(F.col("sorting").alias("s1"), F.col("unit_id").alias("u1"), "component"), ["s1", "u1"])

    def split(part: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*zip(part["s1"], part["u1"], strict=True), *zip(part["s2"], part["u2"], strict=True)})
        at = {x: k for k, x in enumerate(names)}
        rows = [(at[s1, u1], at[s2, u2], w) for s1, u1, s2, u2, w in zip(*(part[c] for c in (*PAIR, "agreement")), strict=True)]
        found = louvain(sorted(rows), len(names), resolution)
        return pd.DataFrame({"sorting": [x[0] for x in names], "unit_id": [x[1] for x in names], "community": found})

    unit = comps.schema["unit_id"].dataType.simpleString()
    split_up = labelled.select(*PAIR, "agreement", F.col("component").alias("c")).groupBy("c").applyInPandas(split, f"sorting string, unit_id {unit}, community int")
    found = comps.join(split_up, [*UNIT], "left").fillna({"community": 0})
    several = F.max("community").over(Window.partitionBy("component")) > 0
    size = F.count(F.lit(1)).over(Window.partitionBy("component", "community"))
    found = settle(found.withColumn("_keep", ~several | (size > min_sortings)), "communities")
    kept = found.where("_keep").drop("_keep")
    ends = kept.select(*UNIT, "component", "community")
    joined = edges.join(ends.toDF("s1", "u1", "k1", "m1"), ["s1", "u1"]).join(ends.toDF("s2", "u2", "k2", "m2"), ["s2", "u2"])
    labels = found.select(*UNIT, "community")
    across = edges.join(labels.toDF("s1", "u1", "m1"), ["s1", "u1"]).join(labels.toDF("s2", "u2", "m2"), ["s2", "u2"]).where("m1 <> m2")
    nothing = lambda c: F.lit(None).cast(edges.schema[c].dataType).alias(c)
    small = found.where("not _keep").select(F.lit("small community").alias("reason"), F.col("sorting").alias("s1"), F.col("unit_id").alias("u1"), nothing("s2"), nothing("u2"))
    why = across.select(F.lit("edge between communities").alias("reason"), *PAIR).union(small)
    return nodes.join(kept.select(*UNIT), [*UNIT], "left_semi"), joined.where("m1 = m2").select(*edges.columns), why


def redundancies(removed: DataFrame, pairs: DataFrame) -> DataFrame:
    """(unit_id, partners) of removed units, partners in the order of pairs (position, a, b)."""
    ways = pairs.select("position", F.col("a").alias("unit_id"), F.col("b").alias("other")).union(pairs.select("position", "b", "a"))
    kept = ways.join(removed.select("unit_id"), "unit_id", "left_semi")
    ordered = F.array_sort(F.collect_list(F.struct("position", "other")))
    return kept.groupBy("unit_id").agg(F.transform(ordered, lambda x: x["other"]).alias("partners"))


def greedy_removal(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """Units that go when pairs (row order) are judged one by one: of two units still there the lower score goes, ties the first.

    The choice depends on all earlier ones within a component, so each component is judged in one task; a
    component is a group of units that share events, far smaller than the data.
    """
    comps = components(scores, pairs).select(F.col("sorting").alias("s1"), F.col("unit_id").alias("u1"), F.to_json("component").alias("component"))
    one, two = scores.select(*UNIT, "score").toDF("s1", "u1", "score1"), scores.select(*UNIT, "score").toDF("s2", "u2", "score2")
    rows = pairs.select(*PAIR).join(one, ["s1", "u1"]).join(two, ["s2", "u2"]).join(comps, ["s1", "u1"])

    def judge(part: pd.DataFrame) -> pd.DataFrame:
        gone: dict[tuple, None] = {}
        for s1, u1, s2, u2, x, y in part.sort_values(["s1", "u1", "s2", "u2"])[["s1", "u1", "s2", "u2", "score1", "score2"]].itertuples(index=False):
            if (s1, u1) not in gone and (s2, u2) not in gone:
                gone[(s2, u2) if x > y else (s1, u1)] = None
        return pd.DataFrame(list(gone), columns=[*UNIT])

    return rows.groupBy("component").applyInPandas(judge, scores.select(*UNIT).schema)


def best_per_component(members: DataFrame, scores: DataFrame) -> DataFrame:
    """The unit of highest score of each component; ties to the smallest node."""
    order = Window.partitionBy("component").orderBy(F.desc("score"), *UNIT)
    return members.join(scores.select(*UNIT, "score"), [*UNIT]).withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")
