"""The pipeline against brute force, stage by stage and as a whole."""

import sys
from collections import Counter
from pathlib import Path

import public_tokenizers

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline  # noqa: E402
import test_linededup  # noqa: E402
import test_mixing  # noqa: E402
import test_packing  # noqa: E402
import test_similar  # noqa: E402
from eventloom.llm import tokencount  # noqa: E402

SF = "/root/testdata/sf0.001"


def brute(rows):
    """rows: (doc_id, text, source); (doc_id, text, copies) that are packed."""
    rows = [r for r in rows if r[1] is not None and any(c.isalpha() for c in r[1])]
    cleaned = test_linededup.brute([(i, t) for i, t, _ in rows])
    rows = [(i, cleaned[i][0], s) for i, _, s in rows if not (cleaned[i][2] and not cleaned[i][0].strip(" "))]
    name = test_similar.brute([(i, t) for i, t, _ in rows])
    rows = [r for r in rows if name[r[0]] == r[0]]
    size = {r[0]: (r[1], r[4]) for r in test_mixing.brute(rows)}
    texts = {i: t for i, t, _ in rows}
    return {i: (texts[i], taken // n) for i, (n, taken) in size.items() if n and taken}


def check(spark, got, want):
    tokenizer = tokencount.load(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, (t, _) in want.items()}
    tokens = Counter()
    for r in got:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and r["ids_crc32"] == test_packing.zlib.crc32(test_packing.np.asarray(part, "<u4").tobytes())
        tokens[r["doc_id"]] += r["length"]
    assert {i: n // len(ids[i]) for i, n in tokens.items()} == {i: c for i, (_, c) in want.items()}
    assert all(n % len(ids[i]) == 0 for i, n in tokens.items())


def test_run_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(spark, corpus_pipeline.run(spark, SF).collect(), brute(rows))


def test_stages_keep_columns_and_take_edges(spark, make_docs, tmp_path):
    rows = [(1, "the cat sat on the mat", "en", "a"), (1, "the cat sat on the mat", "en", "a"), (2, None, None, None), (3, "", "en", "b"), (4, "123", "en", "b")]
    rows += [(5, "p\nq\nr s t u v", "fr", None), (6, "p\nq\nr s t u v", "fr", "c"), (None, "le chat est la", "fr", "c")]
    for k, given in enumerate((rows, [])):
        docs = make_docs(given).selectExpr("*", "1 as _extra")
        for name, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{name}{k}")
            stage(spark, docs, SF).write.parquet(path)
            docs = spark.read.parquet(path)
            if name != "pack":
                assert docs.columns == list(corpus_pipeline.COLUMNS)
                assert all(r["doc_id"] not in (2, 3, 4) for r in docs.collect())
        assert (docs.count() > 0) == bool(given)


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "mix_sources", "pack"]
    assert corpus_pipeline.ORACLE_SQL is None
