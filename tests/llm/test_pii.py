import hashlib
import random
import re
from collections import Counter, defaultdict

from eventloom.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ORDER = ["email", "ip", "card", "phone", "term"]


def luhn(digits):
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else sum(map(int, str(2 * d)))
    return total % 10 == 0


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    return {
        "email": True,
        "ip": all(int(x) <= 255 for x in m.split(".")) if kind == "ip" else False,
        "card": 14 <= len(digits) <= 19 and luhn(digits),
        "phone": 10 <= len(digits) <= 15,
    }[kind]


def base(text):
    found = [(m.start(), ORDER.index(k), m.end(), k, m[0]) for k, p in BASE.items() for m in re.finditer(p, text or "") if valid(k, m[0])]
    return sorted(found)


WORD = re.compile(r"(?<![^\W_])[^\W\d_][^\W_]{3,}(?![^\W_])|(?<![^\W_])\d{4,}(?![^\W_])")


def places(text):
    return [(m[0].lower(), m.start(), m.end()) for m in WORD.finditer(text or "")]


def brute(rows, generalise_at=0.8, min_texts=1, context=64):
    """id -> all spans, of rows (id, text); rows may repeat, but no id has two texts."""
    spans = {i: base(t) for i, t in rows}
    texts, copies, n = dict(rows), Counter(i for i, _ in rows), len(rows)
    near, owners = defaultdict(set), defaultdict(set)
    for i, t in texts.items():
        for s, _, e, k, v in spans[i]:
            name = v.lower() if k == "email" else v if k == "ip" else re.sub("[^0-9]", "", v)
            owners[name].add(i)
            a = max(0, s - context)
            before, after = t[a:s], t[e : e + context]
            if a and re.match(r"[^\W_]", t[a - 1]):
                before = re.sub(r"^[^\W_]+", "", before)
            if re.match(r"[^\W_]", t[e + context : e + context + 1]):
                after = re.sub(r"[^\W_]+$", "", after)
            for side in (before, after):
                for m in WORD.finditer(side):
                    near[name, m[0].lower()].add(t)
    has = {i: {w for w, _, _ in places(t)} for i, t in texts.items()}
    count = lambda ids: sum(copies[i] for i in ids)
    out = {i: [(s, o, e, k) for s, o, e, k, _ in x] for i, x in spans.items()}
    for (name, term), where in near.items():
        own = owners[name]
        both = {i for i in own if term in has[i]}
        if len(where) < min_texts or count(own) == n or not both:
            continue
        n_term = count(i for i in texts if term in has[i])
        if pii.risk_of(n, count(own), count(both), n_term) >= generalise_at:
            for i in both:
                for w, s, e in places(texts[i]):
                    if w == term and all(e <= x or y <= s for x, _, y, _, _ in spans[i]) and (s, 4, e, "term") not in out[i]:
                        out[i].append((s, 4, e, "term"))
    return {i: sorted(x) for i, x in out.items()}


def run(docs):
    return {r["doc_id"]: r for r in pii.detect(docs).collect()}


def check(docs, rows):
    got, want = run(docs), brute(rows)
    assert len(got) == len(rows)
    for i, spans in want.items():
        line = lambda x: ",".join(f"{k}:{s}:{e}" for s, _, e, k in x)
        own = [s for s in spans if s[3] != "term"]
        assert got[i]["spans"] == line(spans), i
        assert got[i]["base_sha256"] == hashlib.sha256(line(own).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in ORDER[:4]] == [sum(s[3] == k for s in own) for k in ORDER[:4]]


def test_documents(sf_docs):
    check(sf_docs, [(r["doc_id"], r["text"]) for r in sf_docs.collect()])


def test_base_patterns_on_noise(make_docs):
    rng = random.Random(6)
    pieces = ["a@b.c", "@", ".", "1.2.3.4", "256", "4111 1111 1111 1111", "+1 (555) 010-9999", "-", " ", "0", "+", "x_y%", "é", "\n", "4111111111111111", "00001.2.3.255", "a.b@c-d.e.f", "(", "7"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(1, 40)))) for i in range(300)]
    got, want = run(make_docs(rows)), {i: base(t) for i, t in rows}
    for i, spans in want.items():
        assert [x for x in got[i]["spans"].split(",") if x and not x.startswith("term")] == [f"{k}:{s}:{e}" for s, _, e, k, _ in spans], rows[i]


def test_terms_near_a_repeated_entity(make_docs):
    rows = [(i, f"note {i} about Marlowe and others: call +1 555 010 99{i % 10}0 or write to jm@corp.example today please") for i in range(4)]
    rows += [(10 + i, f"plain text {i} about others today please write") for i in range(40)]
    docs = make_docs(rows)
    check(docs, rows)
    got = run(docs)
    at = rows[0][1].index("Marlowe")
    assert f"term:{at}:{at + 7}" in got[0]["spans"] and all(not got[10 + i]["spans"] for i in range(40))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert "Marlowe" not in clean[0] and "[EMAIL]" in clean[0] and "[PHONE]" in clean[0] and clean[10] == rows[4][1]


def test_numbers_between_do_not_hide_a_term(make_docs):
    texts = ["Marlowe lives at 12 High Street 4111 1111 1111 1111", "Marlowe lives here 4111 1111 1111 1111", "Marlowe " + "12, 34; " * 6 + "4111 1111 1111 1111"]
    for text in texts:
        rows = [(0, text)] + [(1 + i, f"other people live at High Street {i}, here or elsewhere; each one lives") for i in range(60)]
        check(make_docs(rows), rows)
        assert "term:0:7" in run(make_docs(rows))[0]["spans"]


def test_terms_are_marked_anywhere_in_documents_of_the_entity(make_docs):
    far = "word " * 100
    rows = [(0, f"Marlowe said so. {far}Write to Marlowe, jm@corp.example. {far}Marlowe")]
    rows += [(1, f"{far} jm@corp.example {far}Marlowe"), (2, "nobody said word or write")]
    rows += [(3 + i, f"plain word {i} said write") for i in range(60)] + [(100, "Marlowe")]
    check(make_docs(rows), rows)
    got = run(make_docs(rows))
    assert got[0]["n_term"] == 3 and got[1]["n_term"] == 1 and got[100]["spans"] == ""


def test_rows_that_repeat_count_as_documents(make_docs):
    rows = [(0, "Marlowe jm@corp.example")] * 3 + [(1, "Marlowe of old")] + [(2 + i, f"text {i}") for i in range(50)]
    check_rows = dict(rows)
    got = pii.detect(make_docs(rows)).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        assert r["spans"] == ",".join(f"{k}:{s}:{e}" for s, _, e, k in want[r["doc_id"]]), check_rows[r["doc_id"]]


def test_random_documents(make_docs):
    rng = random.Random(9)
    people = [f"Name{chr(97 + i)}{chr(98 + i)}" for i in range(12)]
    words = [f"word{chr(97 + i)}" for i in range(20)] + ["12", "4111", "a.b", "x@", "é", "99999"]
    rows = []
    for i in range(120):
        parts = [rng.choice(words) for _ in range(rng.randint(0, 40))]
        for k in rng.sample(range(12), rng.choice([0, 0, 0, 1, 2])):
            parts.insert(rng.randint(0, len(parts)), people[k])
            parts.insert(rng.randint(0, len(parts)), f"p{k}@corp.example")
        rows.append((i, " ".join(parts)))
    check(make_docs(rows), rows)
    check_floor = {r["doc_id"]: r["spans"] for r in pii.detect(make_docs(rows), min_texts=3).collect()}
    for i, spans in brute(rows, min_texts=3).items():
        assert check_floor[i] == ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)


def test_sanitise_keeps_clashing_columns(make_docs):
    docs = make_docs([(1, "Ann writes: a@b.cc, 4111 1111 1111 1111!"), (2, None), (2, None), (3, "plain")])
    docs = docs.selectExpr("*", *[f"{k} as {c}" for k, c in enumerate(("_id", "_body", "_spans", "_row", "_key", "_text", "body", "spans"))])
    got = pii.sanitise(docs).orderBy("doc_id").collect()
    assert pii.sanitise(docs).columns == docs.columns and [r["text"] for r in got][1:] == [None, None, "plain"]
    assert got[0]["text"].endswith(": [EMAIL], [CARD]!") and got[0]["_spans"] == 2 and got[0]["_key"] == 4
    # What the spans don't cover stays as it was.
    assert re.sub(r"\[(EMAIL|CARD|REMOVED|NAME|WORD|NUMBER)\]", "", got[0]["text"]) in (" : , !", "Ann : , !", "Ann writes: , !")


def test_risk_by_hand():
    assert pii.risk_of(1000, 10, 10, 10) == 1.0 and pii.risk_of(1000, 10, 1, 100) == 0.0


def test_edges(make_docs):
    rows = [(0, None), (1, ""), (2, "a" * 30_000), (3, "1" * 30_000), (4, "1." * 9_000), (5, "1 " * 9_000), (6, "+1" + "(" * 20_000), (7, "x@y." * 3_000), (8, "a@b.cc " * 2_000), (None, "q@r.st")]
    docs = make_docs(rows).selectExpr("*", "1 as id", "2 as body", "3 as spans", "4 as start")
    got = run(docs)
    assert len(got) == len(rows) and got[8]["n_email"] == 2_000 and got[None]["spans"].startswith("email:0:6")
    for i, t in rows:
        if i not in (2, 3, 4):
            assert [x for x in got[i]["spans"].split(",") if x and "term" not in x] == [f"{k}:{s}:{e}" for s, _, e, k, _ in base(t)]
    assert pii.detect(make_docs([])).count() == 0
    twice = pii.detect(make_docs([(1, "q@r.st"), (1, "q@r.st")])).collect()
    assert [r["n_email"] for r in twice] == [1, 1]
