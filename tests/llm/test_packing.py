import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from eventloom.llm import packing, tokencount

PATH = public_tokenizers.path("word_bpe_49k.json")


def verify(pieces, ids_of, capacity):
    """pieces: (doc, start, length, crc, total, sequence, offset); ids_of: ids of each document."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for doc, start, length, crc, total, sequence, offset in pieces:
        ids = ids_of[doc][start : start + length]
        assert len(ids) == length > 0 and total == len(ids_of[doc])
        assert crc == zlib.crc32(np.asarray(ids, "<u4").tobytes())
        by_doc[doc].append((start, length))
        by_sequence[sequence].append((offset, length))
    for doc, ids in ids_of.items():
        at = 0
        for start, length in sorted(by_doc[doc]):
            assert start == at
            at += length
        assert at == len(ids)
    padding = 0
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=80), st.integers(2, 20))
def test_packer_loses_nothing(sizes, max_open):
    packer = packing.Packer(0, 32, max_open)
    ids = {k: list(range(k, k + n)) for k, n in enumerate(sizes)}
    for k, x in ids.items():
        packer.add(k, np.asarray(x, "<u4").tobytes())
        assert packer.open == packer.level.sum() <= max_open
    packer.settle()
    pieces = [(p[0], p[1], len(p[2]) // 4, zlib.crc32(p[2]), p[3], s, o) for p, s, o in packer.out]
    assert verify(pieces, ids, 32) == 0


def test_level_minimises_the_sum_of_squares():
    rng = np.random.default_rng(3)
    packer = packing.Packer(0, 16, 10**6)
    for size in rng.integers(1, 16, 300).tolist():
        best = {}
        for h in [0, *[h for h in range(1, 16) if packer.level[h]]]:
            if h + size <= 16:
                after = packer.level.copy()
                after[h] -= h > 0
                after[h + size] += h + size < 16
                best[h] = int((after[1:16] ** 2).sum())
        h = packer.best_level(size)
        assert best[h] == min(best.values()) and h == max(k for k, v in best.items() if v == best[h])
        packer.add(0, b"\0" * (4 * size))


def test_word_ids_equal_the_library(sf_docs):
    tokenizer = tokencount.load(PATH)
    texts = [r["text"] for r in sf_docs.collect()] + ["", "Don't  STOṔ ́x <|endoftext|>A b\x1cc ΣAΣ ΑΣ.", "it 's\n\n'S"]
    got = packing.WordIds(PATH).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aBÉé'sΣσς<|>endoftx \n\t\x1c\x85\xa0 .,1漢ﬁİ"), max_size=60))
def test_word_ids_of_any_text(text):
    tokenizer = tokencount.load(PATH)
    assert np.frombuffer(packing.WordIds(PATH).encode([text])[0], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_query_against_the_library(sf_docs):
    tokenizer = tokencount.load(PATH)
    ids = {r["doc_id"]: [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 1] for r in sf_docs.collect()}
    rows = packing.pack(sf_docs, PATH).collect()
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    assert verify([tuple(r[n] for n in names) for r in rows], ids, 2048) == 0


def test_settling_early_and_very_long_texts(sf_docs, make_docs):
    tokenizer = tokencount.load(PATH)
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    ids = {r["doc_id"]: [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 1] for r in sf_docs.collect()}
    rows = packing.pack(sf_docs.coalesce(1), PATH, max_open=5).collect()
    assert verify([tuple(r[n] for n in names) for r in rows], ids, 2048) == 0
    texts = ["long words, all of them. " * 60_000, "a", "x" * 200_000, " " * 100_000, "short"]
    ids = {k: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for k, t in enumerate(texts)}
    rows = packing.pack(make_docs(texts), PATH).collect()
    assert verify([tuple(r[n] for n in names) for r in rows], ids, 2048) == 0


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError, match="pre-tokenizer"):
        packing.WordIds(public_tokenizers.path("byte_bpe_50k.json"))


def test_edges(make_docs):
    docs = make_docs([None, "", (None, "a"), (5, "b"), (5, "b")]).selectExpr("*", "1 as start", "2 as id")
    rows = packing.pack(docs, PATH).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["doc_tokens"]) for r in rows) == [(False, 0, 1), (False, 1, 1), (False, 5, 2), (False, 5, 2), (True, 0, 2)]
    assert packing.pack(make_docs([]), PATH).count() == 0


def test_forms_of_words_do_not_fill_the_memo():
    words = packing.WordIds(PATH)
    base = [f"{a}{b}{c}" for a in "abcdefgh" for b in "aeiou" for c in "klmnrst"]
    texts = [" ".join(base), " ".join(f"{w.title()}, {w.upper()}. {w}." for w in base)]
    got = words.encode(texts)
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokencount.load(PATH).encode(text, add_special_tokens=False).ids
    assert len(words.known) <= len(base) + 2
    assert [x.tobytes() if hasattr(x, "tobytes") else x for x in words.encode(texts)] == got
