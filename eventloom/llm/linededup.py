"""Line dedup by overlapping windows of three lines.

Every three consecutive lines of a text form a window, overlapping with the next; a window
is known by 128 bits of hashes of its lines.  The first occurrence of a window in the
corpus, by (id, hash of the text, line number), stays; each later one covers its three
lines, and the covered lines of a document, merged over all its windows, are removed.

Nothing is lost: a covered line stands, word for word, in the window's first occurrence, which comes
strictly earlier, so the earliest copy of any line is never covered.

Windows of three blank lines don't count.  Lines are compared as they are, but for a
carriage return at the end.  Texts of fewer than three lines have no windows and never change.

The repeated windows are found by an aggregation (combined before the shuffle, so a window that a
third of all documents share costs a row per task) and written down; occurrences are then
looked up by a join that adaptive execution broadcasts if the written table is small and
otherwise splits where a key is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm._common import bound, cut, passing

LINES = 3


def _key(id_col: str, text_col: str) -> list[Column]:
    """What tells documents apart: rows that repeat both are one document."""
    return [F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("body")]


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines: int = LINES) -> DataFrame:
    """id, body, at, h1, h2 of each window; at is the number of its first line, from 0."""
    split = F.split(F.col("text"), "\r?\n", -1)
    rows = docs.select(*_key(id_col, text_col), F.col(text_col).alias("text")).where(F.col("text").contains("\n"))
    rows = rows.select("id", "body", split.alias("lines")).where(F.size("lines") >= lines)
    rows = rows.select("id", "body", F.transform("lines", lambda x: F.when(F.trim(x) != "", x)).alias("lines"))
    hashed = rows.select(
        "id",
        "body",
        F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), x.isNull().alias("blank"))).alias("h"),
    )
    parts = hashed.select("id", "body", F.posexplode(F.arrays_zip(*[F.slice("h", k + 1, F.size("h") - (lines - 1)).alias(f"w{k}") for k in range(lines)])).alias("at", "w"))
    names = [f"w{k}" for k in range(lines)]
    blank = F.lit(True)
    for n in names:
        blank = blank & F.col(f"w.{n}.blank")
    return parts.where(~blank).select(
        "id",
        "body",
        "at",
        F.xxhash64(*[F.col(f"w.{n}.a") for n in names]).alias("h1"),
        F.xxhash64(*[F.col(f"w.{n}.b") for n in names]).alias("h2"),
    )


def covered_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines: int = LINES) -> DataFrame:
    """id, body, covered: the merged spans (from, to) of lines to remove, of documents that have any."""
    every = windows(docs, id_col, text_col, lines)
    place = F.struct("id", "body", "at")
    repeated = (
        every.groupBy("h1", "h2")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where("first <> last")
        .select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "first")
    )
    repeated = cut(repeated, "repeated")
    again = every.join(repeated, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))).where(~place.eqNullSafe(F.col("first")))
    # Merge the covered positions of each document: a span ends where the next start is past it.
    doc = Window.partitionBy("id", "body").orderBy("at")
    again = again.select("id", "body", "at")
    fresh = F.coalesce(F.col("at") > F.lag("at").over(doc) + lines, F.lit(True)).cast("int")
    islands = again.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(doc))
    spans = islands.groupBy("id", "body", "island").agg(F.min("at").alias("from"), (F.max("at") + lines).alias("to"))
    return cut(spans.groupBy("id", "body").agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("covered")), "covered")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines: int = LINES) -> DataFrame:
    """The rows of docs with the text cleaned, and n_lines, n_removed and removed added.

    removed: the spans (from, to) of removed lines, from 0 and exclusive at the end, or null.  n_lines: lines of the original text (null
    text: 0; it stays null).  Rows that repeat id and text are one document and change alike; ids may be
    null (they come first).  The lines left are joined by a newline; a text of which no line
    is removed stays as it is.  Other columns, whatever their names, are kept, but for former n_lines, n_removed and
    removed; an empty table gives no rows.

    Only texts that may be covered, by a Bloom filter of the covered ones, meet their spans in a join; the others stay in place.
    """
    covered = covered_lines(docs, id_col, text_col, lines).select(F.col("id").alias("_id"), F.col("body").alias("_body"), F.col("covered").alias("_covered"))
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed", "removed")]
    rows = docs.select(F.struct(*kept).alias("_row"), *[c.alias(n) for c, n in zip(_key(id_col, text_col), ("_own_id", "_own_body"), strict=True)])
    none = F.lit(None).cast(covered.schema["_covered"].dataType).alias("_covered")
    alone = passing(rows, F.col("_own_body"), covered, "_body", how="left_anti").select("_row", none)
    same = F.col("_own_id").eqNullSafe(F.col("_id")) & (F.col("_own_body") == F.col("_body"))
    maybe = passing(rows, F.col("_own_body"), covered, "_body").join(covered.hint("merge"), same, "left").select("_row", "_covered")
    text = F.col("_row")[text_col]
    split, cover = F.split(text, "\r?\n", -1), F.col("_covered")

    def left(lines_: Column) -> Column:
        edge = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(cover, i - 1)["to"])
        upto = lambda i: F.when(i == F.size(cover), F.size(lines_)).otherwise(F.get(cover, i)["from"])
        runs = F.transform(F.sequence(F.lit(0), F.size(cover)), lambda i: F.slice(lines_, edge(i) + 1, upto(i) - edge(i)))
        return F.array_join(F.flatten(runs), "\n")

    n_lines = F.when(text.isNull(), F.lit(0)).otherwise(F.size(split)).cast("bigint")
    gone = F.aggregate(cover, F.lit(0), lambda n, x: n + x["to"] - x["from"])
    out = {c: F.col("_row")[c] for c in kept}
    out[text_col] = F.when(cover.isNull(), text).otherwise(bound(split, left))
    out |= {"n_lines": n_lines, "n_removed": F.coalesce(gone, F.lit(0)).cast("bigint"), "removed": cover}
    return alone.union(maybe).select(*[v.alias(k) for k, v in out.items()])
