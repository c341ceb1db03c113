import zlib
from collections import Counter

import numpy as np

from eventloom.llm import langid


def brute_counts(text):
    out, word = Counter(), ""
    for c in text.lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            padded, word = f" {word} ", ""
            for n in (1, 2, 3):
                out.update(g for g in (padded[i : i + n] for i in range(len(padded) - n + 1)) if g.strip())
    return out


def code(gram):
    value = 0
    for c in gram:
        value = value << 21 | ord(c)
    return value


def test_counts_against_brute_force(monkeypatch):
    text = "Déjà vu, l'été 2024... ÀB  x--y 漢字 I'm\nABC"
    for t in (text, "", "123", text * 30):
        codes, counts = langid.ngram_counts(t)
        assert dict(zip(codes.tolist(), counts.tolist(), strict=True)) == {code(g): n for g, n in brute_counts(t).items()}
    monkeypatch.setattr(langid, "CHUNK", 40)
    codes, counts = langid.ngram_counts(text * 30)
    assert dict(zip(codes.tolist(), counts.tolist(), strict=True)) == {code(g): n for g, n in brute_counts(text * 30).items()}


def test_distance_against_brute_force():
    texts = {"a": "the cat sat on the mat " * 9, "b": "le chat est sur la table " * 9}
    size = 25
    profiles = {k: langid.profile(*langid.ngram_counts(t), size) for k, t in texts.items()}
    judge = langid.Judge(profiles, size)
    for text in ("the dog sat", "la table", "zzz qqq", "a"):
        top = langid.profile(*langid.ngram_counts(text), size).tolist()
        far = {}
        for k, p in profiles.items():
            ranks = {c: r for r, c in enumerate(p.tolist())}
            far[k] = sum(abs(ranks[c] - r) if c in ranks else size for r, c in enumerate(top))
        best = min(far, key=lambda k: (far[k], k))
        assert judge(text) == (best, 1 - far[best] / (size * len(top)))


def test_profile_breaks_ties_by_code():
    codes, counts = np.array([5, 7, 9, 11]), np.array([2, 3, 2, 2])
    assert langid.profile(codes, counts, 3).tolist() == [7, 5, 9]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs, langid.learnable()).where("lang is not null").collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["lang_pred"] != "und"]
    assert len(held) > 100 and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_edges(make_docs):
    rows = [(i, "the cat and the dog", "en", "s") for i in range(30)] + [(30 + i, "le chat et le chien", "fr", None) for i in range(30)]
    rows += [(100, None, "en", "s"), (101, "", None, "s"), (102, "12 34!", "fr", "s"), (None, "the cat", None, "s"), (103, "the dog " * 50_000, None, "s"), (5, "le chat", "en", "s")]
    got = langid.identify(make_docs(rows).selectExpr("*", "1 as score", "2 as may"), langid.learnable()).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert by[100] == by[101] == by[102] == ("und", 0.0)
    assert by[None][0] == "en" and by[103][0] == "en" and by[31][0] == "fr"
    assert langid.identify(make_docs([]), langid.learnable()).count() == 0
    assert {r["lang_pred"] for r in langid.identify(make_docs([(1, "abc", None, "s")]), langid.learnable()).collect()} == {"und"}


def brute_predictions(rows, size=langid.PROFILE):
    """id -> (language, score) of rows (id, text, lang), learning from those whose remainder isn't 0."""
    top = lambda counts: [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[:size]]
    total = {}
    for i, t, lang in rows:
        if i is not None and t is not None and lang is not None and zlib.crc32(str(i).encode()) % 5:
            total.setdefault(lang, Counter()).update(brute_counts(t))
    profiles = {lang: {g: r for r, g in enumerate(top(n))} for lang, n in total.items()}
    out = {}
    for i, t, _ in rows:
        own = top(brute_counts(t or ""))
        far = {lang: sum(abs(p[g] - r) if g in p else size for r, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(far, key=lambda k: (far[k], k), default=None)
        out[i] = (best, 1 - far[best] / (size * len(own))) if own and best else ("und", 0.0)
    return out


def test_whole_result_against_brute_force(sf_docs):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in sf_docs.collect()]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(sf_docs, langid.learnable(), keep=["doc_id"]).collect()}
    want = brute_predictions(rows)
    assert got.keys() == want.keys()
    assert all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-12 for i in want)


def test_bound_on_training_rows_and_a_large_group(make_docs):
    """One text in most rows, more rows than the bound: whole counts, and about the bound's rows to learn from."""
    rows = [(i, "the cat and the dog ran", "en", "s") for i in range(4000)] + [(5000 + i, f"le chat et le chien {'a' * (i % 7)}", "fr", "s") for i in range(300)]
    docs = make_docs(rows)
    n = langid.training_rows(docs, langid.learnable(), "doc_id", "text", "lang", 500).groupBy("lang").count().collect()
    assert {r["lang"] for r in n} == {"en", "fr"} and all(150 <= r["count"] <= 700 for r in n)
    got = langid.identify(docs, langid.learnable(), train_docs=500, keep=["lang"]).groupBy("lang", "lang_pred").count().collect()
    assert {(r["lang"], r["lang_pred"], r["count"]) for r in got} == {("en", "en", 4000), ("fr", "fr", 300)}
