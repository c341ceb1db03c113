"""Near duplicates against all pairs of whole shingle sets."""

import random
import re

import numpy as np
import pytest

from eventloom.llm import similar


def brute_set(text, k=5):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode("utf-8", "surrogatepass").lower())
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or {tuple(words)}


def brute(rows, least=0.8):
    """rows: (id, text); the smallest id reachable over pairs of similarity least or more, per id."""
    sets = [(i, brute_set(t)) for i, t in rows]
    near = [(i, j) for i, a in sets for j, b in sets if i < j and len(a & b) >= least * len(a | b)]
    label = {i: i for i, _ in rows}
    while any(label[i] != label[j] for i, j in near):
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
    return label


def planted():
    rng = random.Random(3)
    texts = []
    for g in range(12):
        words = [f"w{g}x{rng.randrange(9000)}" for _ in range(rng.randint(30, 300))]
        texts.append(" ".join(words))
        for share in (0.005, 0.01, 0.02, 0.03, 0.05, 0.1):
            texts.append(" ".join(f"y{rng.randrange(9000)}" if rng.random() < share else w for w in words))
    return list(enumerate([*texts, "a b", "A  b", "a c", "a", texts[0]]))


def groups(docs):
    names = {}
    for r in similar.near_duplicates(docs).collect():
        names.setdefault(r["component"], []).append(r["doc_id"])
    return {i: min(x) for x in names.values() for i in x}


def test_against_all_pairs(make_docs):
    rows = planted()
    assert groups(make_docs(rows)) == brute(rows)


def test_groups_dealt_to_parts(make_docs, monkeypatch):
    monkeypatch.setattr(similar, "GROUP", 2)
    rows = planted()
    assert groups(make_docs(rows)) == brute(rows)


def test_documents(sf_docs):
    assert groups(sf_docs) == brute([(r["doc_id"], r["text"]) for r in sf_docs.collect()])


def test_large_clusters_apart_from_their_hub(make_docs, monkeypatch):
    """A chain of texts, each near the next alone, and a cluster whose members are nearer to each other than to the hub."""
    monkeypatch.setattr(similar, "GROUP", 3)
    words = [f"c{i}" for i in range(400)]
    rows = [(k, " ".join(words[8 * k : 8 * k + 200])) for k in range(20)]
    assert groups(make_docs(rows)) == brute(rows) == {k: 0 for k in range(20)}


@pytest.mark.parametrize("limit, batch", [(4, 10_000), (4, 3), (1, 1)])
def test_buckets_that_are_not_held(spark, make_docs, monkeypatch, limit, batch):
    monkeypatch.setattr(similar, "LIMIT", limit)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        rows = planted()[:49]
        assert groups(make_docs(rows)) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_hot_buckets_lose_no_pair(spark, monkeypatch):
    """Two clusters, and rows between them, agree in whole bands: candidates are those of all pairs that meet."""
    rng = np.random.default_rng(4)
    centre = rng.integers(0, 1 << 63, similar.WORDS).astype(np.uint64)
    prints = []
    for flips in (0, 60, 90, 330):
        base = centre.copy()
        for bit in rng.choice(similar.BITS - 512, flips, replace=False):
            base[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        for _ in range(40):
            own = base.copy()
            for bit in rng.choice(similar.BITS - 512, 25, replace=False):
                own[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
            prints.append(own)
    table = np.array(prints)
    rows = [(k, *(int(x) - (1 << 64) if x >> np.uint64(63) else int(x) for x in p)) for k, p in enumerate(prints)]
    frame = spark.createDataFrame(rows, "node long, " + ", ".join(f"w{k} long" for k in range(similar.WORDS)))
    lanes = table.view("<u2")
    near = sum(np.bitwise_count(table[:, None, k] ^ table[None, :, k]).astype(int) for k in (0, 1)) <= similar.CHECK_MOST
    meet = np.array([[(x == y).any() for y in lanes] for x in lanes]) & near
    label = np.arange(len(rows))
    while (new := np.array([label[meet[i]].min() for i in range(len(rows))])).tolist() != label.tolist():
        label = new
    for limit in (16_384, 30, 7):
        monkeypatch.setattr(similar, "LIMIT", limit)
        from eventloom.llm.simhash import components

        got = {r["node"]: r["root"] for r in components(similar.candidates(frame)).collect()}
        sets = {}
        for k in range(len(rows)):
            sets.setdefault(got.get(k, ("alone", k)), set()).add(int(label[k]))
        assert all(len(x) == 1 for x in sets.values()) and len(sets) == len(set(label.tolist()))


def test_one_row_of_each_group_stays(spark, make_docs):
    rows = planted()
    left = similar.one_of_each(make_docs(rows)).collect()
    assert sorted(r["doc_id"] for r in left) == sorted(set(brute(rows).values()))


def test_rows_not_ids_are_decided_on(make_docs):
    x, y = "a b c d e f g h i j", "k l m n o p q r s t"
    rows = [(1, x), (5, x), (5, y), (None, x), (None, "u v w"), (7, "z z z"), (7, "z z z")]
    docs = make_docs(rows).selectExpr("*", *[f"{k} as {c}" for k, c in enumerate(("_id", "_body", "_row", "id", "body", "component", "node"))])
    left = similar.one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted([(1, x), (5, y), (None, "u v w"), (7, "z z z")], key=str)


def test_recall_by_similarity():
    """How often a pair of given similarity meets in a band and passes the check, against the stated odds."""
    rng = np.random.default_rng(7)
    hits = 0
    for _ in range(150):
        both, one, two = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (160, 20, 20))
        a, b = (similar.wide_print(np.unique(np.concatenate([both, x]))) for x in (one, two))
        meets = (a.view("<u2") == b.view("<u2")).any()
        hits += bool(meets and np.bitwise_count(a[:2] ^ b[:2]).sum() <= similar.CHECK_MOST)
    assert hits >= 144


def test_met_in_large_and_small_buckets(monkeypatch):
    rng = np.random.default_rng(2)
    key = np.sort(rng.integers(0, 12, 900)).astype(np.int32)
    check = [rng.integers(0, 1 << 63, 900).astype(np.uint64) for _ in range(2)]
    for c in check:
        c[::3] = c[0]
    for small in (64, 4, 1000):
        monkeypatch.setattr(similar, "SMALL", small)
        a, b = similar.met(key, check)
        near = (sum(np.bitwise_count(c[:, None] ^ c[None, :]).astype(int) for c in check) <= similar.CHECK_MOST) & (key[:, None] == key[None, :])
        label = np.arange(900)
        while (new := np.array([label[near[i]].min() for i in range(900)])).tolist() != label.tolist():
            label = new
        got = np.arange(900)
        got[a] = b
        assert got.tolist() == label.tolist()


def test_empty_and_wordless(make_docs):
    assert similar.near_duplicates(make_docs([])).count() == 0
    found = similar.near_duplicates(make_docs([None, "", " \t", "a"])).collect()
    assert len({r["component"] for r in found if r["doc_id"] < 3}) == 1 and len({r["component"] for r in found}) == 2


@pytest.mark.parametrize("part", [40, 1 << 20])
def test_shingles_of_parts(monkeypatch, part):
    from eventloom.llm import simhash

    monkeypatch.setattr(simhash, "PART_BYTES", part)
    text = " ".join(f"w{i % 90}x{i % 7}" for i in range(1200))
    assert len(similar.shingles(text, 5)) == len(brute_set(text)) and np.all(np.diff(similar.shingles(text, 5).astype(float)) >= 0)


def loose_cluster():
    """Fingerprints that differ in a third of the bits, but for two close pairs; one cluster."""
    rng = np.random.default_rng(5)
    base = rng.random(similar.BITS) < 0.5
    bits = base ^ (rng.random((300, similar.BITS)) < 0.2)
    bits[1] = bits[0] ^ (rng.random(similar.BITS) < 0.1)
    bits[201] = bits[200] ^ (rng.random(similar.BITS) < 0.1)
    return np.packbits(bits, axis=1, bitorder="little").view("<i8")


@pytest.mark.parametrize("cell", [64, 2048])
def test_loose_clusters_are_refined(spark, monkeypatch, cell):
    monkeypatch.setattr(similar, "CELL", cell)
    words = [f"w{k}" for k in range(similar.WORDS)]
    prints = spark.createDataFrame([(i, *map(int, row)) for i, row in enumerate(loose_cluster())], ["node", *words])
    clusters = spark.createDataFrame([(i, 0) for i in range(300)] + [(1000, 1000), (1001, 1000)], "node long, root long")
    got = {}
    for r in similar.refined(clusters, prints).collect():
        got.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(sorted, got.values())) == [[0, 1], [200, 201], [1000, 1001]]


def test_references_discard_before_bits_are_counted():
    words = loose_cluster().view(np.uint64)
    check = [words[:, 0].copy(), words[:, 1].copy()]
    reference = similar.MIXED[:2]
    for c, p in zip(check, reference, strict=True):
        c[2], c[3] = p, ~p
    a, b = similar.within_reach(check, np.array([0, 2, 2]), np.array([1, 3, 2]))
    assert (a.tolist(), b.tolist()) == ([0, 2], [1, 2])
    a, b = (x.ravel() for x in np.meshgrid(np.arange(300), np.arange(300)))
    near = similar.apart_by(check, a, b) <= similar.CHECK_MOST
    assert [x.tolist() for x in similar.close(check, a, b)] == [a[near].tolist(), b[near].tolist()]
