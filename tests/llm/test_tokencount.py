import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from eventloom.llm import tokencount

PATHS = [public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json")]
WORDS = st.text(st.sampled_from("ab é1,'s<|>\n\t\r  \x0b endoftext…漢"), max_size=12)


def whole(path, text):
    return tokencount.load(path).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", PATHS)
@settings(max_examples=150, deadline=None)
@given(st.lists(WORDS | st.sampled_from(["<|endoftext|>", " ", "don't ", "x" * 40]), max_size=60))
def test_spliced_ids_equal_the_whole(path, parts):
    text = "".join(parts)
    got = [i for run in tokencount.spliced_ids(tokencount.load(path), text, 24, 6) for i in run]
    assert got == whole(path, text)


@pytest.mark.parametrize("path", PATHS)
def test_overlaps_widen_over_text_without_boundaries(path):
    tokenizer = tokencount.load(path)
    for text in ("a" * 900, "ab " + "q" * 500 + " cd " * 50, " " * 700 + "x", "x" + " \n" * 300, "<|endoftext|>" * 60):
        got = [i for run in tokencount.spliced_ids(tokenizer, text, 64, 8) for i in run]
        assert got == whole(path, text)


def test_counts_of_documents(spark, make_docs, sf_docs):
    rows = {r["doc_id"]: r["text"] for r in sf_docs.collect()}
    got = tokencount.count_tokens(sf_docs, PATHS[0], chunk_chars=600, overlap_chars=40).collect()
    assert len(got) == len(rows)
    for r in got:
        n = len(whole(PATHS[0], rows[r["doc_id"]]))
        assert (r["n_tokens"], r["over_limit"], r["n_bytes"]) == (n, n > 1024, len(rows[r["doc_id"]].encode()))


def test_edges(make_docs):
    docs = make_docs([None, "", "a", (None, "b"), (7, "é<|endoftext|>"), (7, "é<|endoftext|>")]).selectExpr("*", "1 as n_tokens", "2 as id")
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in tokencount.count_tokens(docs, PATHS[0]).collect()), key=str)
    assert got == sorted([(0, 0, 0), (1, 0, 0), (2, 1, 1), (None, 1, 1), (7, 15, 2), (7, 15, 2)], key=str)
    assert tokencount.count_tokens(make_docs([]), PATHS[0]).count() == 0


def test_sentencepiece(make_docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = tokencount.count_tokens(make_docs(["Hello  world", None]), path).collect()
    assert sorted(r["n_tokens"] for r in got) == [0, len(tokencount.load(path).encode("Hello  world"))]
