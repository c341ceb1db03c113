import random
import re

from eventloom.llm import linededup


def brute(rows):
    """id -> (text, lines, removed) of rows (id, text) with distinct ids."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = re.split(r"\r?\n", t) if t is not None else []
        gone = set()
        for k in range(len(lines) - 2):
            w = tuple(x if x.strip(" ") else None for x in lines[k : k + 3])
            if w == (None, None, None):
                continue
            if w in seen:
                gone |= {k, k + 1, k + 2}
            seen.add(w)
        text = "\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else t
        out[i] = (text, len(lines), len(gone))
    return out


def run(docs):
    return {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in linededup.line_dedup(docs).collect()}


def test_documents(sf_docs):
    assert run(sf_docs) == brute([(r["doc_id"], r["text"]) for r in sf_docs.collect()])


def test_random_lines(make_docs):
    rng = random.Random(8)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", "", "  "]) for _ in range(rng.randint(0, 25)))) for i in range(150)]
    assert run(make_docs(rows)) == brute(rows)


def test_edges(make_docs):
    rows = [(0, None), (1, ""), (2, "a\nb"), (3, "a\nb\nc"), (4, "x\r\na\r\nb\r\nc\r\n"), (None, "a\nb\nc\nd"), (5, "\n\n\n\n"), (6, "\n\n\n\n"), (7, "p\n" * 3000 + "q\nr\ns"), (8, "z\nq\nr\ns")]
    docs = make_docs(rows).selectExpr("*", "1 as id", "2 as body", "3 as covered", "4 as at")
    assert run(docs) == brute(rows)
    assert linededup.line_dedup(make_docs([])).count() == 0


def test_repeated_rows_change_alike(make_docs):
    rows = [(1, "a\nb\nc"), (2, "z\na\nb\nc"), (2, "z\na\nb\nc")]
    got = [(r["doc_id"], r["text"]) for r in linededup.line_dedup(make_docs(rows)).collect()]
    assert sorted(got) == [(1, "a\nb\nc"), (2, "z"), (2, "z")]


def test_clashing_columns_stay(make_docs):
    names = ["_id", "_body", "_covered", "_row", "_own_id", "_own_body", "covered", "w", "fresh"]
    docs = make_docs([(1, "a\nb\nc"), (2, "z\na\nb\nc"), (3, None)]).selectExpr("*", *[f"{k} as {c}" for k, c in enumerate(names)])
    got = linededup.line_dedup(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed", "removed"]
    rows = {r["doc_id"]: r for r in got.collect()}
    assert [rows[i]["text"] for i in (1, 2, 3)] == ["a\nb\nc", "z", None]
    assert all([r[c] for c in names] == list(range(9)) for r in rows.values())


def test_a_passage_that_most_documents_share(make_docs):
    rows = [(i, f"own {i}\np\nq\nr\ns\nend {i}") for i in range(500)] + [(1000 + i, f"x{i}\ny{i}\nz{i}") for i in range(200)]
    assert run(make_docs(rows)) == brute(rows)
