"""Language identification by rank-order profiles (out-of-place distance).

A text's letters, lower-cased, form words parted by whatever isn't a letter; each word is
padded with a blank on both sides, and n-grams of 1 to 3 characters are counted (no
blanks alone).  The profile of a text or a language is its ``PROFILE`` most frequent
n-grams, ties by code.  The distance to a language sums |rank in the text - rank in the language| over
the text's profile, PROFILE for an n-gram which the language's profile lacks; the nearest
language wins, ties to the smaller name.

Language profiles are learned from at most about ``train_docs`` documents a language, those of smallest
hash of id and text: a documented bound, as labelled rows beyond it don't change the top ranks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm._common import give_back


PROFILE = 400
TRAIN_DOCS = 3000
#: Profiles of all languages stand in every worker, so their number is checked.
MOST_LANGUAGES = 1000
CHUNK = 1 << 20
BLANK = 32
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _codes(text: str) -> np.ndarray:
    """Codes of all n-grams of a text: up to three code points of 21 bits."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    points = np.where(_letters()[points], points, BLANK).astype(np.int64)
    points = np.concatenate([[BLANK], points, [BLANK]])
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != BLANK) | (points[:-1] != BLANK)
    p = points[keep]
    two = (p[:-1] << 21) | p[1:]
    three = (two[:-1] << 21) | p[2:]
    # A trigram with a blank in its middle joins two words.
    return np.concatenate([p[p != BLANK], two, three[p[1:-1] != BLANK]])


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes and their counts over the whole text; long texts are cut at non-letters."""
    if len(text) <= CHUNK:
        return np.unique(_codes(text), return_counts=True)
    codes, counts, at = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    while at < len(text):
        end = min(len(text), at + CHUNK)
        while end < len(text) and text[end].isalpha():
            end += 1
        c, n = np.unique(_codes(text[at:end]), return_counts=True)
        codes, where = np.unique(np.concatenate([codes, c]), return_inverse=True)
        counts = np.bincount(where, np.concatenate([counts, n]), len(codes)).astype(np.int64)
        at = end
    return codes, counts


def profile(codes: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent codes in order of rank."""
    if len(counts) > size:
        floor = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= floor
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))[:size]]


def training_rows(docs: DataFrame, may_learn: Column, id_col: str, text_col: str, lang_col: str, train_docs: int) -> DataFrame:
    """(lang, text) of the documents that profiles are learned from."""
    rows = docs.select(
        F.col(lang_col).alias("lang"),
        F.col(text_col).alias("text"),
        may_learn.alias("may"),
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"),
    ).where("may and lang is not null and text is not null")
    many = docs.where(may_learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    many = many.groupBy(F.col(lang_col).alias("_lang")).agg(F.count(F.lit(1)).alias("n"))
    share = F.least(F.lit(1.0), F.lit(float(train_docs)) / F.col("n"))
    cuts = many.select("_lang", share.alias("share")).limit(MOST_LANGUAGES + 1).collect()
    if len(cuts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} labels: {lang_col!r} doesn't look like a language")
    chosen = F.lit(False)
    for r in cuts:  # one row per language
        below = F.pmod(F.col("h"), F.lit(1 << 30)) < int(r["share"] * (1 << 30))
        chosen = chosen | ((F.col("lang") == r["_lang"]) & below)
    return rows.where(chosen).select("lang", "text")


def learn(rows: DataFrame, size: int = PROFILE) -> dict[str, np.ndarray]:
    """The profile of each language of rows (lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes, counts = ngram_counts(text)
                known = total.setdefault(lang, [])
                known.append((codes, counts))
                if len(known) >= 64:
                    total[lang] = [_added(known)]
        for lang, known in total.items():
            codes, counts = _added(known)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], names=["lang", "code", "n"]
            )

    counted = rows.mapInArrow(count, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    best = counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).collect()  # PROFILE rows a language
    out: dict[str, list[tuple[int, int]]] = {}
    for r in best:
        out.setdefault(r["lang"], []).append((r["rank"], r["code"]))
    return {lang: np.array([c for _, c in sorted(rows_)], np.int64) for lang, rows_ in sorted(out.items())}


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, where = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(where, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)


class Judge:
    """Distances of a text to all learned languages."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE):
        self.names, self.size = sorted(profiles), size
        self.codes = np.unique(np.concatenate([np.zeros(0, np.int64), *profiles.values()]))
        self.ranks = np.full((len(self.codes) + 1, len(self.names)), -1, np.int64)
        for k, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.codes, profiles[name]), k] = np.arange(len(profiles[name]))

    def __call__(self, text: str | None) -> tuple[str, float]:
        """Language and score, 1 - distance / largest distance, of a whole text."""
        codes, counts = ngram_counts(text or "")
        top = profile(codes, counts, self.size)
        if not len(top) or not self.names:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.codes, top)
        at[at == len(self.codes)] = 0
        at = np.where(self.codes[at] == top, at, len(self.codes))
        ranks = self.ranks[at]
        apart = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(top))[:, None]))
        distance = np.minimum(apart, self.size).sum(axis=0)
        k = int(np.argmin(distance))
        return self.names[k], 1.0 - float(distance[k]) / (self.size * len(top))


def identify(
    docs: DataFrame,
    may_learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    train_docs: int = TRAIN_DOCS,
    size: int = PROFILE,
    keep: list[str] | None = None,
) -> DataFrame:
    """The rows of docs with lang_pred and score (0 to 1) added.

    keep: the columns of docs that are wanted; all of them if not given, but for former lang_pred and score.  Texts
    that aren't wanted don't come back from the workers.

    may_learn: which rows profiles may be learned from; of those, rows of null label or text
    are left out.  Null texts and texts of no letters are ``und`` with score 0, as is everything
    if there is nothing to learn from.  Predictions read the text alone.  Repeated rows each give a
    row; an empty table gives none; other columns are kept.
    """
    judge = Judge(learn(training_rows(docs, may_learn, id_col, text_col, lang_col, train_docs), size), size)

    keep = [c for c in docs.columns if c not in ("lang_pred", "score")] if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [judge(x.as_py()) for x in batch.column(0)]
            columns = [*batch.columns[1:], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[1:], "lang_pred", "score"])
        give_back()

    kept = docs.select(*keep)
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(F.col(text_col).alias("_text"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(keep)]).mapInArrow(run, _numbered(schema, len(keep))).toDF(*keep, "lang_pred", "score")


def _numbered(schema: T.StructType, n: int) -> T.StructType:
    """The schema with its first n fields called c0, c1, ..."""
    return T.StructType([T.StructField(f"c{k}", f.dataType) if k < n else f for k, f in enumerate(schema.fields)])


def learnable(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Rows whose crc32(id as text) mod folds is not 0; null ids can't be told and aren't learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds != 0, F.lit(False))
