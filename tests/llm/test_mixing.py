import hashlib
import math
import random
import re
from collections import defaultdict

from eventloom.llm import mixing


def targets(sizes, weights=(5, 2, 1), most=3):
    """Share out the total by weight again and again until no source is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return {s: float(most * sizes[s]) if s in capped else share[s] for s in names}
        capped |= over


def uniform(i, seed=7):
    return (int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)


def probabilities(docs, rest):
    """id -> p of docs (id, size): min(1, c * class), with c so that p * size sums to rest."""
    kind = {i: 1 << (n.bit_length() - 1) for i, n in docs if n}
    size = dict(docs)
    sure = set()
    while True:
        free = [i for i in kind if i not in sure]
        c = (rest - sum(size[i] for i in sure)) / sum(kind[i] * size[i] for i in free)
        top = max(kind[i] for i in free)
        if c * top < 1:
            return {i: 1 if i in sure else c * kind[i] for i in kind}
        sure |= {i for i in free if kind[i] == top}


def brute(rows):
    """(id, taken) of rows (id, text, source)."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    per = defaultdict(list)
    for i, t, s in rows:
        per[s].append((i, size(t)))
    total = {s: sum(n for _, n in x) for s, x in per.items()}
    goal, out = targets(total), []
    for s, docs in per.items():
        r = goal[s] / total[s] if total[s] else 0
        certain, taken = math.floor(r + 1e-12), {}
        if r - certain > 1e-12:
            p = probabilities(docs, goal[s] - certain * total[s])
            taken = {i: 1 for i in p if p[i] == 1}
            rest = goal[s] - certain * total[s] - sum(n for i, n in docs if i in taken)
            ranked = sorted(((uniform(i) / (1 - uniform(i))) / (p[i] / (1 - p[i])), n, i) for i, n in docs if n and i not in taken)
            used, k = 0, 0
            while k < len(ranked) and used + ranked[k][1] <= rest:
                used += ranked[k][1]
                taken[ranked[k][2]] = 1
                k += 1
            more = [(abs(n - (rest - used)), q, n, i) for q, n, i in ranked[k:] if abs(n - (rest - used)) < rest - used]
            if more:
                taken[min(more)[3]] = 1
        out += [(i, n, total[s], goal[s], (certain + taken.get(i, 0)) * n) for i, n in docs]
    return sorted(out, key=str)


def run(docs):
    got = mixing.mix(docs).collect()
    return sorted(((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in got), key=str)


def rounded(rows):
    return [(a, b, c, round(d, 6), e) for a, b, c, d, e in rows]


def test_against_brute_force(make_docs):
    rng = random.Random(3)
    rows = [(i, "w " * rng.choice([0, 1, 3, 50, 200, 1000]), rng.choice(["a", "a", "a", "b", "c", "d", "é", None])) for i in range(300)]
    got = run(make_docs([(i, t, "en", s) for i, t, s in rows]))
    assert rounded(got) == rounded(brute(rows))
    sums = defaultdict(int)
    for i, _, _, _, taken in got:
        sums[rows[i][2]] += taken
    goal = {s: t for (_, _, s), t in zip(rows, [r[3] for r in sorted(got)], strict=True)}
    assert all(abs(sums[s] - goal[s]) <= 1000 for s in sums)


def test_documents(sf_docs):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in sf_docs.collect()]
    assert rounded(run(sf_docs)) == rounded(brute(rows))


def test_edges(make_docs):
    assert run(make_docs([])) == []
    one = run(make_docs([(1, "a b", "en", None)]))
    assert one == [(1, 2, 2, 2.0, 2)]
    empty = run(make_docs([(1, None, "en", "x"), (2, "", "en", "y")]))
    assert [r[4] for r in empty] == [0, 0]
    twice = run(make_docs([(1, "a", "en", "x"), (1, "a", "en", "x"), (None, "b", "en", "y"), (2, "c d e", "en", "z")]).selectExpr("*", "1 as size", "2 as target"))
    assert len(twice) == 4 and all(taken <= 3 * size for _, size, _, _, taken in twice)


def test_mixed_documents_repeat_rows(make_docs):
    rows = [(i, "w " * (1 + i % 5), "en", "abc"[i % 3]) for i in range(60)]
    docs = make_docs(rows)
    taken = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect()}
    got = [r["doc_id"] for r in mixing.mixed_documents(docs).collect()]
    assert {i: got.count(i) for i in taken} == taken


def test_probabilities_differ_within_a_source(make_docs):
    """Ranks follow odds, not the random numbers alone, and large documents are taken more often."""
    rng = random.Random(11)
    rows = [(i, "w " * rng.choice([3, 20, 150]), rng.choice("aab")) for i in range(400)]
    got = {r["doc_id"]: r for r in mixing.mix(make_docs([(i, t, "en", s) for i, t, s in rows])).collect()}
    half = next(s for s in "ab" if got[next(i for i, _, x in rows if x == s)]["target"] < got[next(i for i, _, x in rows if x == s)]["source_size"])
    own = [(i, got[i]["size"], got[i]["copies"]) for i, _, s in rows if s == half]
    taken = {n: [c for _, m, c in own if m == n] for n in (3, 20, 150)}
    shares = [sum(x) / len(x) for x in taken.values()]
    assert shares[0] < shares[1] < shares[2]
    by_u = sorted(own, key=lambda x: uniform(x[0]))
    drawn = [c for _, _, c in by_u]
    assert drawn != sorted(drawn, reverse=True)
    p = probabilities([(i, n) for i, n, _ in own], got[own[0][0]]["target"])
    assert abs(sum(p[i] * n for i, n, _ in own) - got[own[0][0]]["target"]) < 1e-6 * got[own[0][0]]["target"]


def test_large_documents_become_certain(make_docs):
    rows = [(0, "w " * 5000, "en", "a")] + [(i, "w " * 5, "en", "a") for i in range(1, 400)] + [(1000 + i, "w " * 4, "en", "b") for i in range(900)]
    got = {r["doc_id"]: r for r in mixing.mix(make_docs(rows)).collect()}
    plain = [(i, t, s) for i, t, _, s in rows]
    assert rounded(sorted(((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in got.values()), key=str)) == rounded(brute(plain))


def test_very_long_text_and_ties(make_docs):
    rows = [(0, "word " * 300_000, "en", "a"), (1, "w", "en", "a"), (2, None, "en", "a")]
    rows += [(7, "x y", "en", "b")] * 5 + [(8, "x y z", "en", "b")] * 3
    got = mixing.mix(make_docs(rows)).collect()
    assert len(got) == len(rows) and max(r["size"] for r in got) == 300_000
    assert all(len({r["copies"] for r in got if r["doc_id"] == i}) <= 2 and r["taken"] <= 3 * r["size"] for i in (7, 8) for r in got)


def test_clashing_columns_stay(make_docs):
    names = ["_id", "_source", "_size", "_rank", "_copies", "_copy", "_p", "_salt", "_row", "_target"]
    docs = make_docs([(i, "w " * (1 + i % 5), "en", "abc"[i % 3]) for i in range(30)]).selectExpr("*", *[f"{100 + k} as {c}" for k, c in enumerate(names)])
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    assert got.count() and all([r[c] for c in names] == list(range(100, 110)) for r in got.collect())
    assert mixing.mix(docs).count() == 30
