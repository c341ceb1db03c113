import random
import re

import numpy as np
import xxhash

from eventloom.llm import simhash


def brute_print(text, k=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, distance):
    """rows: (id, fp); the smallest id reachable, per row."""
    label = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for i, a in rows:
            for j, b in rows:
                if (a ^ b).bit_count() <= distance and label[j] < label[i]:
                    label[i] = label[j]
                    changed = True
    return label


def check(docs, rows, k=3, distance=2):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs, shingle=k, max_distance=distance).collect()}
    prints = [(i, brute_print(t, k)) for i, t in rows]
    label = brute_components(prints, distance)
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints}
    assert {i: r["component_id"] for i, r in got.items()} == label


def test_against_brute_force_on_documents(sf_docs):
    rows = [(r["doc_id"], r["text"]) for r in sf_docs.collect()]
    check(sf_docs, rows)


def test_edges_of_texts(make_docs):
    texts = [None, "", " \t\n", "One", "one two", "ONE two", "a b c", "É b c d", "x " * 5000, "a\x0bb\x0cc", "a\xa0b c d", "a b c"]
    check(make_docs(texts), list(enumerate(texts)))


def test_empty_table_extra_columns_and_repeated_rows(spark, make_docs):
    assert simhash.near_duplicates(make_docs([])).count() == 0
    docs = make_docs([(4, "a b c"), (4, "a b c"), (2, "a b c"), (None, "a b c")]).selectExpr("*", "1 as fp", "2 as a", "3 as root")
    got = simhash.near_duplicates(docs, shingle=3).collect()
    assert len(got) == 4 and {r["component_id"] for r in got} == {2}
    lone = simhash.near_duplicates(make_docs([(None, "p q r s")])).collect()
    assert lone[0]["component_id"] is None


def test_links_find_every_near_pair(spark):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(30)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(30)}
    frame = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    tree = simhash.components(simhash.links(frame, 2)).collect()
    root = {r["node"] % (1 << 64): r["root"] for r in tree}
    label = brute_components([(x, x) for x in fps], 2)
    ours, theirs = {}, {}
    for x in fps:
        ours.setdefault(root.get(x, ("alone", x)), set()).add(x)
        theirs.setdefault(label[x], set()).add(x)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_forest_of_a_dense_bucket():
    rng = np.random.default_rng(1)
    flips = rng.integers(0, 1 << 12, 1500).astype(np.uint64)
    fps = np.unique(np.uint64(0xDEADBEEF00000000) | (flips << np.uint64(7)))
    a, b = simhash.forest(fps, 2)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    label = np.arange(len(fps))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(fps))])
        if (new == label).all():
            break
        label = new
    got = dict(zip(a.tolist(), b.tolist(), strict=True))
    assert all(got.get(int(x), int(x)) == int(fps[label[i]]) for i, x in enumerate(fps))


def test_long_text_in_parts(monkeypatch):
    text = " ".join(f"w{i % 97}x{i % 31}" for i in range(3000))
    whole = simhash.fingerprint(text, 3)
    monkeypatch.setattr(simhash, "PART_BYTES", 200)
    assert simhash.fingerprint(text, 3) == whole == brute_print(text)
