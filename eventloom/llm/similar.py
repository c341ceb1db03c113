"""Near-dedup by SimHash at a similarity of shingle sets, for links that differ in more bits than blocks can bear.

Two sets of Jaccard similarity s have the cosine 2s / (1 + s), so each bit of their SimHash differs with odds
q = acos(2s / (1 + s)) / pi: 0.15 at 0.8, 10 of 64 bits.  So fingerprints are wide here, ``BITS`` bits from
as many bits of hashes of the distinct shingles, and are linked in three steps:

1. The pivot table.  As in ``simhash``, the distances to the zero and the one-bit references are the
   coordinates; each run of ``BAND`` coordinates is one band, and fingerprints meet where all coordinates of a
   band are equal.  A pair of similarity s meets with odds 1 - (1 - (1 - q)^BAND)^(BITS / BAND): 0.992 at
   0.8, 0.9999 at 0.85.  (Bands of b bits let chance pairs meet with odds 2^-b each; at many more than 10^8
   distinct texts, take wider bands and more bits.)
2. Of the pairs that meet, those whose coordinates over mixed references (distances of the first ``CHECK`` bits)
   differ by more than ``CHECK_MOST`` are discarded, then those whose bits themselves do: chance pairs (64 +- 6 of
   128), hardly a pair of similarity 0.8 (19 +- 4).  Only a forest leaves a
   task, whose components are clusters of candidates.  Clusters of more than ``GROUP`` nodes are loose chains that grow
   with the corpus: in them, whole fingerprints are compared, and only pairs that differ in at most ``WIDE_MOST`` of
   ``BITS`` bits (154 +- 11 at 0.8, so one pair in 10^9 is beyond) stay together.
3. Survivors are verified on their whole sets: within a cluster, a link is a Jaccard similarity of ``least``
   or more.  Clusters of more than ``GROUP`` sets are dealt to parts, each with the cluster's first set (its
   hub); what a part links to its hub is one component at once, and only pairs of different components
   meet in a second round, in cells of the nodes that are apart from the hub by those of the cluster.  A task holds
   at most about twice GROUP sets.

Sets that are equal are one node throughout, so copies, however many, are never compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm._common import cut, give_back, passing, salted_join
from eventloom.llm.simhash import MIXED, SEED, _merge, _mixed, _words, components

BITS, BAND = 1024, 16
WORDS = BITS // 64
CHECK, CHECK_MOST = 128, 38
WIDE_MOST = 224
GROUP = 128
#: Fingerprints of one side of a cell in which large clusters are refined.
CELL = 2048
#: Buckets of more rows than this are compared block by block.
SMALL = 64
#: Rows of a bucket that a task holds.
LIMIT = 16_384


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles: a shorter text is one shingle, one without words none."""
    import xxhash

    found, tail = [], []
    for words in _words((text or "").encode("utf-8", "surrogatepass").lower()):
        words = tail + words
        if len(words) >= shingle:
            parts = map(b" ".join, zip(*(islice(words, k, None) for k in range(shingle)), strict=False))
            found.append(np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64)))
            tail = words[len(words) - shingle + 1 :]
        else:
            tail = words
    if not found:
        return np.array([xxhash.xxh64_intdigest(b" ".join(tail), SEED)] if tail else [], np.uint64)
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def wide_print(hashes: np.ndarray) -> np.ndarray:
    """The BITS bits of a set's SimHash as 64-bit words; zero for an empty set."""
    salts, counts = _mixed(WORDS), np.zeros(BITS, np.int64)
    for s in range(0, len(hashes), 255):
        z = hashes[s : s + 255, None] ^ salts[None, :]
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        bits = np.unpackbits(z.astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8").astype(np.uint64)


def body_of(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """id, body (a hash of the text), node (one of the shingle set; 0 if empty) and the words w0, w1, ... of each row."""
    words = [f"w{k}" for k in range(WORDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            sets = [shingles(t.as_py(), shingle) for t in batch.column(2)]
            nodes = np.array([xxhash.xxh3_64_intdigest(x.tobytes(), SEED) if len(x) else 0 for x in sets], np.uint64)
            prints = np.array([wide_print(x) for x in sets], np.uint64).reshape(len(sets), WORDS)
            columns = [pa.array(c.view(np.int64)) for c in (nodes, *np.ascontiguousarray(prints.T))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["id", "body", "node", *words])
        give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), body_of(text_col).alias("body"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, body bigint, node bigint, " + ", ".join(f"{w} bigint" for w in words))


def apart_by(words: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits of the words the rows a[i] and b[i] differ."""
    return sum(np.bitwise_count(c[a] ^ c[b]).astype(np.int16) for c in words)


def within_reach(check: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those pairs whose largest coordinate difference over mixed references is at most CHECK_MOST, as it is for all that differ in no more bits."""
    for reference in MIXED.reshape(-1, CHECK // 64)[:2]:
        at = sum(np.bitwise_count(c ^ p).astype(np.int16) for c, p in zip(check, reference, strict=True))
        keep = np.abs(at[a] - at[b]) <= CHECK_MOST
        a, b = a[keep], b[keep]
    return a, b


def close(check: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those pairs (a[i], b[i]) of rows whose check words differ in few enough bits."""
    a, b = within_reach(check, a, b)
    keep = apart_by(check, a, b) <= CHECK_MOST
    return a[keep], b[keep]


def alike(words: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those pairs of ``close`` whose whole fingerprints differ in few enough bits, too."""
    a, b = close(words[: CHECK // 64], a, b)
    keep = apart_by(words, a, b) <= WIDE_MOST
    return a[keep], b[keep]


def compared(label: np.ndarray, check: list[np.ndarray], low: int, high: int, test: Callable = close) -> np.ndarray:
    """Labels after linking the close ones of the rows low to high - 1, of which only pairs of different labels are looked at, block by block."""
    for k in range(low, high, 256):
        rows = np.arange(k, min(k + 256, high))
        for c in range(k, high, 4096):
            cols = np.arange(c, min(c + 4096, high))
            a, b = np.nonzero(label[rows][:, None] != label[cols][None, :])
            if len(a):
                label = _merge(label, *test(check, rows[a], cols[b]))
    return label


def met(key: np.ndarray, check: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A forest (row, other row) of the rows of equal key whose check words differ in few enough bits; keys are sorted."""
    n = len(key)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, n])
    label = np.arange(n)
    small = np.repeat(sizes <= SMALL, sizes)
    for d in range(1, int(sizes[sizes <= SMALL].max(initial=1))):
        a = np.flatnonzero((key[d:] == key[:-d]) & small[d:])
        label = _merge(label, *close(check, a, a + d))
    for s, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        label = compared(label, check, s, s + size)
    linked = np.flatnonzero(label != np.arange(n))
    return linked, label[linked]


def _batch(a: np.ndarray, b: np.ndarray, key: np.ndarray | None = None) -> pa.RecordBatch:
    keys = pa.nulls(len(a), pa.int32()) if key is None else pa.array(key, pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), keys], names=["a", "b", "key"])


def candidates(prints: DataFrame) -> DataFrame:
    """a, b: edges whose components are the clusters of nodes that may be similar; prints: distinct (node, w0, w1, ...).

    A bucket of more than LIMIT rows isn't held: its rows stream past its first one, the hub, and are linked with it if they are close.  The rows that aren't
    meet all rows of their bucket afterwards, in cells of at most about twice LIMIT rows, where only pairs that aren't in one component yet are compared.
    So no pair is lost, and a bucket that one large cluster fills costs a comparison a row.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = BITS // BAND
        for batch in batches:
            for s in range(0, batch.num_rows, 1024):
                part = batch.slice(s, 1024)
                node = part.column(0).to_numpy(zero_copy_only=False)
                wide = np.stack([part.column(k + 1).to_numpy(zero_copy_only=False) for k in range(WORDS)], axis=1)
                lanes = np.ascontiguousarray(wide).astype("<i8", copy=False).view("<u2").reshape(len(node), bands)
                keys = lanes.astype(np.int32) + (np.arange(bands, dtype=np.int32) << BAND)
                columns = [keys.reshape(-1), *(np.repeat(c, bands) for c in (node, wide[:, 0], wide[:, 1]))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "node", "c0", "c1"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int32), *(np.zeros(0, np.int64) for _ in range(3))]
        hub: list | None = None

        def edges(key: np.ndarray, node: np.ndarray, *check: np.ndarray) -> pa.RecordBatch:
            a, b = met(key, [c.view(np.uint64) for c in check])
            return _batch(node[a], node[b])

        def past(key: np.ndarray, node: np.ndarray, *check: np.ndarray) -> list[pa.RecordBatch]:
            bits = sum(np.bitwise_count(c.view(np.uint64) ^ np.uint64(int(h) & (2**64 - 1))).astype(np.int16) for c, h in zip(check, hub[2:], strict=True))
            near = (bits <= CHECK_MOST) & (node != hub[1])
            far = bits > CHECK_MOST
            name = np.int64(hub[1])
            return [_batch(node[near], np.full(near.sum(), name)), _batch(node[far], np.full(far.sum(), name), key[far])]

        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if hub is not None:
                n = int(np.searchsorted(now[0], hub[0], "right"))
                yield from past(*(c[:n] for c in now))
                now = [c[n:] for c in now]
            if not len(now[0]):
                continue
            hub = None
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            last = int(np.searchsorted(now[0], now[0][-1]))
            if last:
                yield edges(*(c[:last] for c in now))
            held = [c[last:].copy() for c in now]
            if len(held[0]) > LIMIT:
                hub = [c[0] for c in held]
                yield from past(*held)
                held = [c[:0] for c in held]
        yield edges(*held)

    dealt = prints.mapInArrow(deal, "key int, node bigint, c0 bigint, c1 bigint")
    found = dealt.repartition("key").sortWithinPartitions("key", "node").mapInArrow(link, "a bigint, b bigint, key int")
    found = cut(found, "found")
    edges, apart = found.where("key is null").select("a", "b"), found.where("key is not null").select("key", F.col("a").alias("node"))
    if apart.isEmpty():
        return edges

    hot = apart.groupBy("key").agg(F.count(F.lit(1)).alias("n_apart"))
    rows = cut(dealt.join(hot, "key"), "hot_rows")
    sizes = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / LIMIT).cast("int").alias("columns"), F.ceil(F.first("n_apart") / LIMIT).cast("int").alias("lines"))
    tree = components(edges).toDF("node", "label")
    rows = rows.drop("n_apart").join(sizes, "key").join(tree, "node", "left").withColumn("label", F.coalesce("label", "node"))
    at = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    names = ["key", "line", "column", "node", "label", "c0", "c1"]
    every = rows.withColumn("column", at("columns")).withColumn("line", upto("lines")).select(*names)
    some = rows.join(apart, ["key", "node"]).withColumn("line", at("lines")).withColumn("column", upto("columns")).select(*names)

    def cell(group: pa.Table) -> pa.Table:
        node, label, c0, c1 = (group.column(c).to_numpy() for c in ("node", "label", "c0", "c1"))
        # Labels become the first row that has them.
        _, first, place = np.unique(label, return_index=True, return_inverse=True)
        before = first[place]
        after = compared(_merge(np.arange(len(node)), np.arange(len(node)), before), [c0.view(np.uint64), c1.view(np.uint64)], 0, len(node))
        new = np.flatnonzero(after != before)
        return pa.table({"a": pa.array(node[new]), "b": pa.array(node[after[new]])})

    more = every.union(some).distinct().groupBy("key", "line", "column").applyInArrow(cell, "a bigint, b bigint")
    return edges.union(more)


def refined(clusters: DataFrame, prints: DataFrame) -> DataFrame:
    """clusters (node, root) with those of more than GROUP nodes parted by ``alike``; nodes that it leaves alone go.

    Each pair of a cluster meets in a cell of at most about twice CELL fingerprints, which are a fraction of the sets that are verified later.
    """
    sizes = clusters.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP)
    large = cut(sizes.select("root", F.ceil(F.col("n") / CELL).cast("int").alias("parts")), "loose")
    if large.isEmpty():
        return clusters
    words = [f"w{k}" for k in range(WORDS)]

    def cell(group: pa.Table) -> pa.Table:
        node = group.column("node").to_numpy()
        label = compared(np.arange(len(node)), [group.column(w).to_numpy().view(np.uint64) for w in words], 0, len(node), alike)
        linked = np.flatnonzero(label != np.arange(len(node)))
        return pa.table({"a": pa.array(node[linked]), "b": pa.array(node[label[linked]])})

    inside = prints.join(clusters.join(large, "root"), "node").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    inside = inside.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = inside.select("root", F.least("part", "other").alias("line"), F.greatest("part", "other").alias("column"), "node", *words)
    edges = cut(cells.groupBy("root", "line", "column").applyInArrow(cell, "a bigint, b bigint"), "alike")
    return clusters.join(large, "root", "left_anti").select("node", "root").union(components(edges).toDF("node", "root"))


def verified(nodes: np.ndarray, label: np.ndarray, sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the pairs of nodes of different labels whose sets have a similarity of least or more.

    Sets are taken by falling size, and each meets the later ones it isn't linked with yet.
    """
    order = np.argsort([-len(x) for x in sets], kind="stable")
    nodes, sets = nodes[order], [sets[i] for i in order]
    _, label = np.unique(label[order], return_inverse=True)
    sizes, a, b = np.array([len(x) for x in sets]), [], []
    for i in range(len(sets) - 1):
        later = i + 1 + np.flatnonzero((label[i + 1 :] != label[i]) & (sizes[i + 1 :] >= least * sizes[i]))
        if not len(later) or not sizes[i]:
            continue
        every = np.concatenate([sets[j] for j in later])
        at = np.minimum(np.searchsorted(sets[i], every), sizes[i] - 1)
        common = np.bincount(np.repeat(np.arange(len(later)), sizes[later])[sets[i][at] == every], minlength=len(later))
        for j in later[common >= least * (sizes[i] + sizes[later] - common)]:
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                a.append(nodes[i])
                b.append(nodes[j])
    return np.array(a, np.int64), np.array(b, np.int64)


def _compared(groups: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """a, b: links within groups (group, node, label)."""

    def link(group: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(x.as_py(), np.uint64) for x in group.column("hashes")]
        a, b = verified(group.column("node").to_numpy(), group.column("label").to_numpy(), hashes, least)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return groups.join(sets, "node").groupBy("group").applyInArrow(link, "a bigint, b bigint")


def links(docs: DataFrame, rows: DataFrame, text_col: str, shingle: int, least: float) -> DataFrame:
    """a, b: edges whose components are those of the verified pairs; rows: what fingerprints gave."""
    prints = rows.where("node <> 0").select("node", *[f"w{k}" for k in range(WORDS)]).distinct()
    clusters = cut(refined(cut(components(candidates(prints)).toDF("node", "root"), "loose_clusters"), prints), "clusters")

    # One text a node, and its set made again: only candidates' texts are read.
    bodies = passing(rows.select("node", "body"), F.col("node"), clusters, "node").join(clusters, "node", "left_semi")
    bodies = cut(bodies.groupBy("node").agg(F.min("body").alias("_body")), "bodies")
    texts = passing(docs.select(body_of(text_col).alias("body"), F.col(text_col).alias("text")), F.col("body"), bodies, "_body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([shingles(t.as_py(), shingle).tobytes() for t in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], names=["node", "hashes"])
        give_back()

    # Copies of a text become one row before they meet, so that no text is hot.
    texts = texts.dropDuplicates(["body"]).join(bodies, F.col("body") == F.col("_body")).dropDuplicates(["node"]).select("node", "text")
    sets = cut(texts.mapInArrow(run, "node bigint, hashes binary"), "sets")

    # First round: every part of a cluster with the cluster's hub.
    sizes = clusters.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    parts = sizes.select("root", F.ceil(F.col("n") / GROUP).cast("int").alias("parts"))
    large = cut(parts.where("parts > 1"), "large")
    dealt = clusters.join(large, "root", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    hub = F.col("node") == F.col("root")
    first = dealt.withColumn("part", F.explode(F.when(hub, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(part))))
    found = cut(_compared(first.select(F.xxhash64("root", "part").alias("group"), "node", F.col("node").alias("label")), sets, least), "found")
    if large.isEmpty():
        return found

    # Second round, of large clusters: nodes apart from their hub's component meet the cluster part by part.
    tree = cut(components(found), "parts_tree").toDF("node", "label")
    inside = clusters.join(large, "root").join(tree, "node", "left").withColumn("label", F.coalesce("label", "node"))
    hubs = inside.where("node = root").select("root", F.col("label").alias("hub_label"))
    inside = cut(inside.join(hubs, "root"), "inside")
    apart = inside.where("label <> hub_label")
    lines = cut(apart.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("lines")), "lines")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    line = F.pmod(F.xxhash64("node"), F.col("lines")).cast("int")
    names = ["root", "line", "column", "node", "label"]
    cells = inside.join(lines, "root").withColumn("column", part).withColumn("line", upto("lines")).select(*names)
    own = apart.join(lines, "root").withColumn("line", line).withColumn("column", upto("parts")).select(*names)
    second = cells.union(own).distinct().select(F.xxhash64("root", "line", "column").alias("group"), "node", "label")
    return found.union(_compared(second, sets, least))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """id, body (xxhash64 of the text, null as empty), component (a node) of each row.

    Words and shingles are as in ``simhash``, each distinct shingle once.  Texts without a word, null and empty ones too, are one
    component; texts of fewer words than a shingle are one shingle.  Null and repeated ids and repeated rows give a
    row each, other columns are ignored, and an empty table gives no rows.
    """
    rows = cut(fingerprints(docs, id_col, text_col, shingle), "prints")
    tree = cut(components(links(docs, rows, text_col, shingle, least)), "tree").toDF("_node", "root")
    # Only nodes that a bitmap of the linked ones lets through need the join.
    alone = passing(rows, F.col("node"), tree, "_node", how="left_anti").select("id", "body", F.col("node").alias("component"))
    maybe = passing(rows, F.col("node"), tree, "_node").join(tree, F.col("node") == F.col("_node"), "left")
    out = alone.unionByName(maybe.select("id", "body", F.coalesce("root", "node").alias("component")))
    return out.withColumnRenamed("id", id_col)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of docs that stay when one row of each component of ``near_duplicates`` does.

    It is the one of the smallest id (null last), then the smallest hash of the text; of rows that agree in both, the
    smallest by all its columns.  Rows, not ids, are decided on: a row of a repeated id goes only if its own text has a near copy
    that stays.
    """
    groups = cut(near_duplicates(docs, id_col, text_col, shingle, least).withColumnRenamed(id_col, "id"), "groups")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "body")
    names = groups.groupBy("component").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    names = cut(names.select(F.col("component").alias("_component"), F.col("first.id").alias("_id"), F.col("first.body").alias("_first")), "names")
    # Few rows share a component: the others stay as they are, and only what a bitmap of bodies lets through is joined.
    shared = salted_join(passing(groups, F.col("component"), names, "_component"), names, "component", "_component", F.col("id"))
    keeps = F.col("id").eqNullSafe(F.col("_id")) & (F.col("body") == F.col("_first"))
    shared = cut(shared.select(F.col("id").alias("_id"), F.col("body").alias("_body"), keeps.alias("_keeps")).distinct(), "shared")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("id"), body_of(text_col).alias("body"))
    sure = passing(rows, F.col("body"), shared, "_body", how="left_anti").select("_row")
    maybe = passing(rows, F.col("body"), shared, "_body")
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("body") == F.col("_body"))
    maybe = maybe.join(shared.hint("merge"), same, "left")
    free = maybe.where("_keeps is null").select("_row")
    kept = maybe.where("_keeps").groupBy("id", "body").agg(F.min("_row").alias("_row")).select("_row")
    return sure.union(free).union(kept).select(*[F.col("_row")[c].alias(c) for c in docs.columns])
