import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from eventloom.llm import exactdedup


def brute(rows):
    body = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[body(t)].append(i)
    out = set()
    for b, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out |= {(i, keep, len(ids), i == keep, hashlib.sha256(b.encode()).hexdigest()) for i in ids}
    return sorted(out, key=str)


def run(docs, **options):
    got = exactdedup.exact_dedup(docs, **options).collect()
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got), key=str)


@pytest.mark.parametrize("options", [{}, {"batches": 5}, {"digest_bytes": 1}])
def test_documents(sf_docs, options):
    rows = [(r["doc_id"], r["text"]) for r in sf_docs.collect()]
    rows += []
    assert run(sf_docs, **options) == brute(rows)


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_collisions_and_edges(make_docs, digest_bytes):
    rows = [(i, f"t{i % 400}") for i in range(900)]
    rows += [(1000, None), (1001, ""), (1002, " "), (1003, "\t\n"), (1004, "a  b"), (1005, "a\x0b\r b"), (1006, "a\xa0b"), (None, "a b"), (None, "zz"), (1007, "x" * 100_000)]
    rows += [(3, "t3"), (3, "t3")]
    docs = make_docs(rows).selectExpr("*", "1 as id", "2 as digest", "3 as keep_id")
    assert run(docs, digest_bytes=digest_bytes) == brute(rows)


def test_empty(make_docs):
    assert run(make_docs([])) == []


def entries(index):
    return {r["digest"][0]: (r["keep_id"], r["n_rows"]) for r in index.entries().collect()}


def test_index_merges_levels_reopens_and_keeps_smallest(spark):
    index, want, names = exactdedup.DigestIndex(spark, fanout=3), {}, set()
    for k in range(7):
        rows = spark.createDataFrame([(bytes([d]), 10 * (6 - k) + d, 1) for d in range(k, k + 5)], "digest binary, id long, n_rows long")
        before = {r[0] for r in index.runs}
        index.flush(rows)
        # A batch writes one run; others go only when their level is full.
        gone = before - {r[0] for r in index.runs}
        assert len(gone) in (0, 2) and all(sum(r[1] == n for r in index.runs) < 3 for n in range(4))
        names |= {r[0] for r in index.runs}
        for d in range(k, k + 5):
            i, n = want.get(d, (10**9, 0))
            want[d] = (min(i, 10 * (6 - k) + d), n + 1)
        again = exactdedup.DigestIndex(spark, index.path, fanout=3)
        assert again.runs == sorted(index.runs) and entries(again) == want
    assert [r[1] for r in sorted(index.runs, key=lambda r: r[1])] == [0, 1, 1]
    index.compact()
    assert len(index.runs) == 1 and entries(exactdedup.DigestIndex(spark, index.path)) == want


def test_lookups_read_only_runs_whose_filter_says_maybe(spark):
    make = lambda digests: spark.createDataFrame([(hashlib.sha256(str(d).encode()).digest(), d, 1) for d in digests], "digest binary, id long, n_rows long")
    index = exactdedup.DigestIndex(spark, fanout=10)
    for k in range(4):
        index.flush(make(range(1000 * k, 1000 * k + 200)))
    found = index.lookup(make([5, 2007, 2008, 99_999]))
    assert sorted(r["keep_id"] for r in found.collect()) == [5, 2007, 2008]
    assert index.read == [index.runs[0][0], index.runs[2][0]]
    again = exactdedup.DigestIndex(spark, index.path, fanout=10)
    assert again.lookup(make([777_777])).count() == 0 and again.read == []
    again.flush(make([5, 6]))
    assert sorted(r["n_rows"] for r in again.entries().where("keep_id in (5, 6, 7)").collect()) == [1, 2, 2]


def test_a_writer_that_fails_leaves_the_version_before(spark):
    make = lambda digests: spark.createDataFrame([(bytes([d]), d, 1) for d in digests], "digest binary, id long, n_rows long")
    index = exactdedup.DigestIndex(spark)
    index.flush(make([1, 2]))
    lost = exactdedup.DigestIndex(spark, index.path)
    lost._commit = lambda: None
    lost.flush(make([3]))
    again = exactdedup.DigestIndex(spark, index.path)
    assert set(entries(again)) == {1, 2}
    again.flush(make([4]))
    assert set(entries(exactdedup.DigestIndex(spark, index.path))) == {1, 2, 4}


def test_large_group_and_filter_without_room(make_docs, monkeypatch):
    from eventloom.llm import _common

    rows = [(i, "same text" if i % 3 else f"other {i % 50}") for i in range(3000)]
    want = brute(rows)
    assert run(make_docs(rows)) == want
    monkeypatch.setattr(_common, "MOST_BITS", 64)
    assert run(make_docs(rows)) == want


def test_the_operator_fills_memtables_and_merges_levels(make_docs, monkeypatch):
    built = []

    class Watched(exactdedup.DigestIndex):
        def __init__(self, *args, **options):
            super().__init__(*args, **options)
            built.append(self)

    monkeypatch.setattr(exactdedup, "DigestIndex", Watched)
    rows = [(i, f"t{i % 150}") for i in range(600)]
    assert run(make_docs(rows)) == brute(rows)
    # Four runs filled level 0 and were merged; memtables were looked up in the runs before them.
    assert built[0].version == 4 and [r[1:3] for r in built[0].runs] == [(1, 150)] and len(set(built[0].read)) == 4
    monkeypatch.setattr(exactdedup, "MEMTABLE", 600 // (6 * make_docs([]).sparkSession.sparkContext.defaultParallelism))
    assert run(make_docs(rows)) == brute(rows)
    assert built[1].version == 6 and sorted(r[1] for r in built[1].runs) == [0, 0, 1]


def test_a_run_is_sorted_over_its_files(spark):
    index = exactdedup.DigestIndex(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index.flush(spark.range(400).selectExpr("unhex(sha2(string(id), 256)) as digest", "id", "1L as n_rows"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ends = index.data(index.runs[0][0]).selectExpr("input_file_name() as f", "hex(digest) as d").groupBy("f").agg(F.min("d").alias("low"), F.max("d").alias("high"))
    found = [d for r in ends.orderBy("f").collect() for d in (r["low"], r["high"])]
    assert len(found) > 2 and found == sorted(found)
