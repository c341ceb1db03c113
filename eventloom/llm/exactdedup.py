"""Exact dedup with a log-structured merge index over text digests.

Documents are digested and collected by key in memtables of bounded size (Spark's map-side hash
aggregation).  Before a memtable is flushed, its digests are looked up in the runs that are there: a run's Bloom
filter passes the digests that it may hold, and only a run that has such digests is read.  The flush then
writes a run: a Parquet table whose files are ranges of digests in order, with the smallest identifier and the number of rows of
each digest, and beside it its filter.  Runs are never changed.  When a level has ``fanout`` runs,
they are merged into one run of the next level, which keeps the smallest identifiers (an input fills at least one level); a manifest names the
runs of each version, so that an index can be opened again and added to.

A digest that more than one row has, in a memtable or across runs, is only a hit: its rows are compared byte for
byte with the row that stays, and rows which differ (a digest collision) form groups by their bytes.  Documents
of no hit take no part in any of this: the filter of the hits lets them past the join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm._common import SPACES, bloom, bloom_words, cut, let_through, new_path, passing, salted_join


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


#: Rows (digest, id) that a memtable holds for each core, some 200 MB.
MEMTABLE = 1 << 22


class DigestIndex:
    """Levels of sorted digest runs below one folder; opens what is there.

    Columns of a run: digest binary, keep_id (smallest identifier), n_rows long.
    A null identifier counts as larger than every other one.  A writer that fails before its manifest is written leaves the
    version before it; there may be one writer at a time.
    """

    FANOUT = 4

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = FANOUT):
        self.spark, self.path, self.fanout = spark, path or new_path(spark, "index"), fanout
        #: name, level, digests and words of the filter of each run; the names of runs that lookups have read.
        self.runs: list[tuple[str, int, int, int]] = []
        self.read: list[str] = []
        self.version = 0
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        whole = [n for n in names if n.startswith("manifest-") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        if whole:
            self.version = int(max(whole).split("-")[1])
            rows = spark.read.parquet(f"{self.path}/{max(whole)}").collect()  # one row per run
            self.runs = sorted((r["name"], r["level"], r["digests"], r["words"]) for r in rows if r["name"])

    def _write(self, rows: DataFrame, level: int) -> tuple[str, int, int, int]:
        # A failed writer may have left a run of this number.
        name = f"run-{self.version:06d}-{level:02d}"
        data = f"{self.path}/{name}/data"
        merged = rows.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n_rows").alias("n_rows"))
        merged.sort("digest").write.mode("overwrite").parquet(data)
        written = self.spark.read.parquet(data)
        digests = written.count()
        words = bloom_words(digests)
        bloom(written, "digest", words).write.mode("overwrite").parquet(f"{self.path}/{name}/filter")
        return name, level, digests, words

    def _commit(self) -> None:
        row = lambda r: F.struct(F.lit(r[0]).alias("name"), *[F.lit(v).cast("bigint").alias(n) for n, v in zip(("level", "digests", "words"), r[1:], strict=True)])
        rows = [row(r) for r in self.runs] or [row(("", 0, 0, 0))]
        self.spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest-{self.version:06d}")

    def data(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}/data")

    def flush(self, rows: DataFrame) -> None:
        """Add rows (digest, id, n_rows) as one sorted run; runs that are there stay, but that a full level is merged."""
        self.version += 1
        self.runs.append(self._write(rows.withColumnRenamed("id", "keep_id"), 0))
        level = 0
        while len(full := [r for r in self.runs if r[1] == level]) >= self.fanout:
            merged = self._write(self._union(full), level + 1)
            self.runs = [r for r in self.runs if r[1] != level] + [merged]
            level += 1
        self._commit()

    def compact(self) -> None:
        """Merge all runs into one of the highest level."""
        if len(self.runs) > 1:
            self.version += 1
            self.runs = [self._write(self._union(self.runs), max(r[1] for r in self.runs) + 1)]
            self._commit()

    def _union(self, runs: list[tuple[str, int, int, int]]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{r[0]}/data" for r in runs])

    def lookup(self, keys: DataFrame) -> DataFrame:
        """digest, keep_id, n_rows of every run's entry for the digests of keys; runs whose filter has none of them aren't read."""
        found = []
        for name, _, _, words in self.runs:
            filter_ = self.spark.read.parquet(f"{self.path}/{name}/filter")
            maybe = cut(let_through(keys.select("digest"), F.col("digest"), filter_, words), "maybe")
            if not maybe.isEmpty():
                self.read.append(name)
                found.append(passing(self.data(name), F.col("digest"), maybe, "digest").join(maybe, "digest", "left_semi"))
        return reduce(DataFrame.union, found) if found else self.entries().limit(0)

    def entries(self) -> DataFrame:
        """One row per digest over all runs."""
        if not self.runs:
            return self.spark.createDataFrame([], "digest binary, keep_id bigint, n_rows bigint")
        rows = self._union(self.runs)
        if len(self.runs) == 1:
            return rows
        return rows.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n_rows").alias("n_rows"))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    batches: int | None = None,
    digest_bytes: int = 32,
) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after ``normalised``; null is empty.  Of equal
    texts the smallest id stays.  Rows that repeat an id with an equal text are one
    document and give one row, as an identifier can't be both kept and dropped; group_size counts all rows.
    A null id is larger than every other.  An empty table gives no rows; other columns are ignored.

    batches: number of memtable flushes the input is dealt to, by a hash of the id.  By default as many as memtables of MEMTABLE
    rows a core need, and no fewer than fill a level, so that runs are merged whatever the size.
    digest_bytes: length of the digests; short ones only serve to test collisions.
    """
    source = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("body"))
    rows = cut(
        source.select("id", F.unhex(F.sha2("body", 256)).alias("full"))
        .groupBy("id", "full")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .select("id", "full", F.substring("full", 1, digest_bytes).alias("digest"), "n_rows"),
        "digests",
    )
    index = DigestIndex(docs.sparkSession)
    if batches is None:
        room = MEMTABLE * docs.sparkSession.sparkContext.defaultParallelism
        batches = max(index.fanout, -(-rows.count() // room))
    met = []
    for k in range(batches):
        memtable = rows.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == k).select("digest", "id", "n_rows")
        if index.runs:
            met.append(cut(index.lookup(memtable).select("digest"), "met"))
        index.flush(memtable)
    # Hits: digests of more than one row, within a memtable or, by the lookups, across runs.
    inside = [index.data(r[0]).where("n_rows > 1").select("digest") for r in index.runs]
    suspects = cut(reduce(DataFrame.union, [*inside, *met]).distinct(), "suspects")
    entries = index.lookup(suspects).groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n_rows").alias("n_rows"))
    entries = cut(entries, "entries")

    # Only texts of hits are read again.  Where the smallest and the largest of a digest are the same bytes, all are; the
    # aggregation combines copies before the shuffle, so a hot digest costs two texts a task.
    hits = entries.select("digest", "keep_id")
    bodies = source.withColumn("full", F.unhex(F.sha2("body", 256)))
    bodies = bodies.withColumn("digest", F.substring("full", 1, digest_bytes))
    bodies = passing(bodies, F.col("digest"), hits, "digest")
    mixed = bodies.groupBy("digest").agg(F.min("body").alias("low"), F.max("body").alias("high")).where("low <> high").select("digest")
    mixed = cut(mixed, "mixed")
    # Of the others (digest collisions), each text is held against that of the row that stays.
    differ = None
    if not mixed.isEmpty():
        copies = cut(bodies.join(mixed, "digest", "left_semi").join(hits.hint("merge"), "digest"), "copies")
        keepers = copies.where(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.min("body").alias("keep_body"))
        differ = copies.join(cut(keepers, "keepers"), "digest").where(F.col("body") != F.col("keep_body"))
        differ = cut(differ.select("digest", "full", "body", "id"), "differ")
    own = rows.select("digest", "full", "id", "n_rows")
    alone = passing(own, F.col("digest"), hits, "digest", how="left_anti")
    alone = alone.select("digest", "full", "id", F.col("id").alias("keep_id"), F.col("n_rows").alias("group_size"))
    groups = entries.select(F.col("digest").alias("_digest"), "keep_id", F.col("n_rows").alias("group_size"), F.lit(True).alias("_met"))
    out = salted_join(passing(own, F.col("digest"), hits, "digest"), groups, "digest", "_digest", F.col("id"), "left")
    out = out.select(
        "digest",
        "full",
        "id",
        # What the filter let through by chance is alone, too.
        F.when(F.col("_met"), F.col("keep_id")).otherwise(F.col("id")).alias("keep_id"),
        F.coalesce("group_size", "n_rows").alias("group_size"),
    )
    if differ is not None:
        # Groups by bytes of the rows that only share a digest with the one that stays.
        others = cut(
            differ.groupBy("digest", "full", "body")
            .agg(F.min("id").alias("other_id"), F.count(F.lit(1)).alias("other_rows"))
            .drop("body"),
            "others",
        )
        lost = others.groupBy("digest").agg(F.sum("other_rows").alias("lost_rows"))
        out = (
            out.join(others, ["digest", "full"], "left")
            .join(lost, "digest", "left")
            .withColumn("keep_id", F.when(F.col("other_rows").isNotNull(), F.col("other_id")).otherwise(F.col("keep_id")))
            .withColumn(
                "group_size",
                F.coalesce("other_rows", F.col("group_size") - F.coalesce("lost_rows", F.lit(0))),
            )
        )
    return out.select("id", "keep_id", "group_size", "full").union(alone.select("id", "keep_id", "group_size", "full")).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("full")).alias("text_sha256"),
    )
