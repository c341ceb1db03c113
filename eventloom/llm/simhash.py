"""Near-dedup by SimHash fingerprints, linked through a table of pivot distances.

Fingerprints: each 64-bit SimHash bit is the majority of that bit over the XXH64 (seed
42) of all word shingles, repeats included.

Linking fingerprints at Hamming distance at most k by the triangle inequality: for any
reference ("pivot") p, |d(x, p) - d(y, p)| <= d(x, y).  The pivot table holds the
distances of every distinct fingerprint to 81 references: the zero fingerprint, the
64 fingerprints of one bit, and 16 mixed ones.  Distances to mixed pivots alone
cannot restrict a join (they scatter by 4 around 32, so a window of +-2 keeps a third
of all pairs), but the first 65 can: d(x, 0) - d(x, e_i) is +1 or -1, and each unit of
distance changes one of these 64 coordinates.  Dealt to ``blocks`` groups of coordinates,
two linked fingerprints agree on all groups but k, so they meet in one of the
C(blocks, k) buckets of equal coordinates.  A bucket holds at most
2^(64 k / blocks) distinct fingerprints (65,536 with the defaults), however many
documents or near copies there are, since copies of a fingerprint are merged first.  In every bucket,
pairs whose largest coordinate difference over the mixed pivots exceeds k are discarded, the
survivors verified, and only a forest of the links leaves the task, never all pairs.

``similar.py`` links texts by the similarity of their shingle sets instead, on wider fingerprints.

Components come from randomised contraction: each node is merged into the neighbour of
smallest hash, which shrinks the links by a constant factor a round.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm._common import cut, give_back, passing, salted_join

SEED = 42
PART_BYTES = 1 << 20


def _mixed(n: int) -> np.ndarray:
    """n fixed 64-bit numbers by SplitMix64 from state 0."""
    z = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


UNITS = np.uint64(1) << np.arange(64, dtype=np.uint64)
MIXED = _mixed(16)
PIVOTS = np.concatenate([np.zeros(1, np.uint64), UNITS, MIXED])


def pivot_table(fingerprints: np.ndarray, pivots: np.ndarray = PIVOTS) -> np.ndarray:
    """Hamming distances, one row per fingerprint and one column per pivot."""
    return np.bitwise_count(fingerprints[:, None] ^ pivots[None, :])


def _words(data: bytes) -> Iterator[list[bytes]]:
    """The words of data in order, in lists of bounded size."""
    at = 0
    while len(data) - at > PART_BYTES:
        end = at + PART_BYTES
        while end < len(data) and data[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield data[at:end].split()
        at = end
    yield data[at:].split()


def fingerprint(text: str | None, shingle: int) -> int:
    """The 64-bit SimHash of a whole text; 0 if it has no word."""
    import xxhash

    counts, total, tail = np.zeros(64, np.int64), 0, []
    for words in _words((text or "").encode("utf-8", "surrogatepass").lower()):
        words = tail + words
        if len(words) >= shingle:
            parts = map(b" ".join, zip(*(islice(words, k, None) for k in range(shingle)), strict=False))
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64)
            for k in range(0, len(hashes), 1 << 16):
                bits = np.unpackbits(hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8), bitorder="little")
                counts += bits.reshape(-1, 64).sum(axis=0, dtype=np.int32)
            total += len(hashes)
            tail = words[len(words) - shingle + 1 :]
        else:
            tail = words
    if not total:
        if not tail:
            return 0
        h = xxhash.xxh64_intdigest(b" ".join(tail), SEED)
        return h
    return int((UNITS[2 * counts > total]).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """id, fp (the 64 bits as a long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])
        give_back()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


def _bucket_keys(fps: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Per fingerprint and bucket family, the pivot coordinates outside the free groups as one number."""
    table = pivot_table(fps, PIVOTS[:65]).astype(np.int16)
    coordinates = ((table[:, :1] - table[:, 1:] + 1) >> 1).astype(np.uint64)
    return coordinates @ weights


def _family_weights(k: int, blocks: int) -> np.ndarray:
    edges = np.linspace(0, 64, blocks + 1).round().astype(int)
    out = []
    for free in combinations(range(blocks), k):
        w = UNITS.copy()
        for b in free:
            w[edges[b] : edges[b + 1]] = 0
        out.append(w)
    return np.stack(out, axis=1)


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the sets of a[i] and b[i]; the smallest member names a set."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return label
        np.minimum.at(label, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        while not np.array_equal(up := label[label], label):
            label = up


def survivors(fps: np.ndarray, a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a[i], b[i]) of places in fps at distance at most k.

    Pairs whose largest coordinate difference over the mixed pivots exceeds k are discarded, the others verified.
    """
    for some in (MIXED[:1], MIXED[1:4], MIXED[4:]):
        apart = np.abs(pivot_table(fps[a], some).astype(np.int16) - pivot_table(fps[b], some))
        keep = apart.max(axis=1, initial=0) <= k
        a, b = a[keep], b[keep]
    keep = np.bitwise_count(fps[a] ^ fps[b]) <= k
    return a[keep], b[keep]


def forest(fps: np.ndarray, k: int, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, smallest member) of the link components of one bucket's fingerprints."""
    fps = np.sort(fps)
    near = pivot_table(fps, MIXED[:2]).astype(np.int16)
    order = np.argsort(near[:, 0], kind="stable")
    first = near[order, 0]
    label = np.arange(len(fps))
    for s in range(0, len(fps), block):
        rows = order[s : s + block]
        stop = int(np.searchsorted(first, first[min(s + block, len(fps)) - 1] + k, "right"))
        cols = order[s:stop]
        a, b = np.nonzero(np.abs(near[rows, 1][:, None] - near[cols, 1][None, :]) <= k)
        label = _merge(label, *survivors(fps, rows[a], cols[b], k))
    linked = np.flatnonzero(label != np.arange(len(fps)))
    return fps[linked], fps[label[linked]]


def links(distinct: DataFrame, max_distance: int, blocks: int | None = None) -> DataFrame:
    """a, b: edges whose components are those of all pairs of fps at most max_distance apart.

    distinct: a column fp of distinct fingerprints.
    """
    blocks = blocks or max(1, 4 * max_distance)
    weights = _family_weights(max_distance, blocks) if max_distance else UNITS[:, None]
    families = weights.shape[1]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 1024):
                fps = batch.column(0).slice(s, 1024).to_numpy(zero_copy_only=False).view(np.uint64)
                keys = _bucket_keys(fps, weights)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.tile(np.arange(families, dtype=np.int32), len(fps))),
                        pa.array(keys.reshape(-1).view(np.int64)),
                        pa.array(np.repeat(fps, families).view(np.int64)),
                    ],
                    names=["family", "key", "fp"],
                )

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def edges(family: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.r_[True, (family[1:] != family[:-1]) | (key[1:] != key[:-1])]) if len(fp) else np.zeros(0, int)
            sizes = np.diff(np.r_[starts, len(fp)])
            pair = survivors(fp, starts[sizes == 2], starts[sizes == 2] + 1, max_distance)[0]
            parts = [(fp[pair + 1], fp[pair])]
            parts += [forest(fp[s : s + n], max_distance) for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True)]
            a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if held:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            family, key, fp = now[0], now[1], now[2].view(np.uint64)
            last = int(np.flatnonzero((family != family[-1]) | (key != key[-1]))[-1]) + 1 if (family[0] != family[-1] or key[0] != key[-1]) else 0
            if last:
                yield edges(family[:last], key[:last], fp[:last])
            held = [family[last:].copy(), key[last:].copy(), now[2][last:].copy()]
        if held:
            yield edges(held[0], held[1], held[2].view(np.uint64))

    dealt = distinct.select("fp").mapInArrow(deal, "family int, key bigint, fp bigint")
    return dealt.repartition("family", "key").sortWithinPartitions("family", "key", "fp").mapInArrow(link, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (a, b), by randomised contraction."""
    levels: list[DataFrame] = []
    edges = cut(edges.where("a <> b").distinct(), "edges")
    while not edges.isEmpty():
        turn = F.lit(len(levels))
        both = edges.union(edges.select("b", "a")).toDF("node", "other")
        pick = F.min(F.struct(F.xxhash64("other", turn).alias("h"), F.col("other").alias("to")))
        up = both.groupBy("node").agg(pick.alias("best"))
        own = F.struct(F.xxhash64("node", turn).alias("h"), F.col("node").alias("to"))
        up = cut(up.select("node", F.least("best", own)["to"].alias("to")), "contraction")
        levels.append(up)
        a, b = up.toDF("a", "ra"), up.toDF("b", "rb")
        joined = edges.join(a, "a").join(b, "b").where("ra <> rb")
        edges = cut(joined.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")

    def then(later: DataFrame, earlier: DataFrame) -> DataFrame:
        moved = earlier.join(later.toDF("to", "next"), "to", "left")
        return moved.select("node", F.coalesce("next", "to").alias("to"))

    if not levels:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return reduce(then, reversed(levels)).select("node", F.col("to").alias("root"))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    max_distance: int = 2,
    blocks: int | None = None,
) -> DataFrame:
    """id, fingerprint (16 hex digits), component_id (smallest id reachable, own included) of each row.

    Null, empty and wordless texts have fingerprint zero and are linked like any other;
    texts of fewer words than a shingle are one shingle.  Repeated rows each give a row,
    null ids never name a component unless all ids in it are null, other columns are
    ignored, and an empty table gives no rows.
    """
    prints = cut(fingerprints(docs, id_col, text_col, shingle), "prints")
    distinct = cut(prints.groupBy("fp").agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("n")), "distinct")
    tree = cut(components(links(distinct, max_distance, blocks)), "tree")
    linked = cut(distinct.join(tree, distinct["fp"] == tree["node"]).select("fp", "root", "least_id"), "linked")
    names = cut(linked.groupBy("root").agg(F.min("least_id").alias("name")), "names")
    named = salted_join(linked, names.withColumnRenamed("root", "_root"), "root", "_root", F.col("fp")).select(F.col("fp").alias("_fp"), "name")
    # Fingerprints of one row that are linked with none need no join: the row is its own component.
    copies = distinct.join(named, distinct["fp"] == named["_fp"], "left").where("n > 1 or _fp is not null")
    shared = cut(copies.select(F.col("fp").alias("_fp"), F.coalesce("name", "least_id").alias("_name")), "components")
    alone = passing(prints, F.col("fp"), shared, "_fp", how="left_anti").select("id", "fp", F.col("id").alias("component_id"))
    maybe = salted_join(passing(prints, F.col("fp"), shared, "_fp"), shared.withColumn("_met", F.lit(True)), "fp", "_fp", F.col("id"), "left")
    maybe = maybe.select("id", "fp", F.when(F.col("_met"), F.col("_name")).otherwise(F.col("id")).alias("component_id"))
    out = alone.union(maybe)
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
