"""Mixing sources to target weights by Pareto order sampling.

Every source has a target number of words.  With r = target / words of the source,
each of its documents is taken floor(r) times for certain, and the rest of the
target is drawn without replacement, with unequal probabilities: a document of size class g (the largest
power of two that isn't above its number of words) is included with probability p = min(1, c * g), where c
is such that p times size sums to the rest over the source.  Documents whose p reaches 1 are one more
certain whole copy.  Of the others, one with random number u gets
the rank (u / (1 - u)) / (p / (1 - p)), and the lowest ranks are taken until the
sample has its fixed size.  That size is a number of words, so ranks are taken while
their words fit, and one further document is added if that brings the source
nearer to its target: the one whose size is nearest to what is missing.  Probabilities that grow with size
keep such a sample near its size in words with few documents cut off by chance.

The random numbers come from MD5 of the seed and the id, so reruns agree on any
cluster.  A source may hold any share of the rows: words are summed first into size classes and
ranges of ranks (twice), and single ranks are compared only within the one range per source
in which the sample ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm._common import WORD, cut

WEIGHTS = (5, 2, 1)
#: Most times that a document is taken.
MOST = 3
#: Ranges that ranks are dealt to, and how often the range in which a sample ends is dealt to ranges again.
RANGES = 1024
DEPTH = 2
SALTS = 64


def uniform(id_col: Column, seed: int) -> Column:
    """A number in (0, 1) from 52 bits of MD5 of seed and id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target from rows (source, size).

    Sources in the order of their code points, null last, weigh ``weights``, repeating.
    No target exceeds ``most`` times its source's size; the excess goes to the others by
    weight.  With c = most * source_size / weight ascending, the sources before the
    first that satisfies (total - capped sizes before) / (weights from here on) <= c
    are capped, and that quotient times its weight is the target of each other source.
    One row per source is windowed here, never one per document.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = per_source.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    every = Window.partitionBy()
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levels = (
        ranked.withColumn("total", F.sum("source_size").over(every))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("heft", F.sum("weight").over(after))
    )
    fits = F.col("left") * F.col("weight") <= F.col("cap") * F.col("heft")
    first = F.min(F.when(fits, F.struct(F.col("cap") / F.col("weight"), F.col("left"), F.col("heft")))).over(every)
    chosen = levels.withColumn("level", first)
    shared = F.col("level.left").cast("double") * F.col("weight") / F.col("level.heft")
    return chosen.select(
        "source",
        "source_size",
        F.when(F.col("level").isNull() | (F.col("cap") <= shared), F.col("cap").cast("double")).otherwise(shared).alias("target"),
    )


def _join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """left with the row of right of its source, whatever share of left one source has: sources are salted."""
    left = left.withColumn("_salt", F.pmod(F.hash("_id"), F.lit(SALTS)))
    right = right.withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("_source", "_source2")
    on = (F.col("_salt") == F.col("_salt2")) & F.col("_source").eqNullSafe(F.col("_source2"))
    return left.join(right, on, how).drop("_salt", "_salt2", "_source2")


def size_class(size: Column) -> Column:
    """The largest power of two that isn't above a positive size."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.length(F.bin(size)) - 1)


def inclusion(classes: DataFrame) -> DataFrame:
    """_source, _factor, _sure_from, _left of each source that draws, from rows (_source, _class, _words, _rest).

    With classes falling, the first class at which (rest - words before) / (sum of class * words from here on)
    times the class is below 1 has the factor c; the classes before it are taken whole, which leaves the words _left to
    draw.  A source has at most 63 classes, so the window holds that many rows of it.
    """
    falling = Window.partitionBy("_source").orderBy(F.desc("_class"))
    heft = (F.col("_class").cast("decimal(38,0)") * F.col("_words")).cast("decimal(38,0)")
    before = F.coalesce(F.sum("_words").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = classes.withColumn("_left", F.col("_rest") - before).withColumn(
        "_tail", F.sum(heft).over(falling.rowsBetween(Window.currentRow, Window.unboundedFollowing)).cast("double")
    )
    steps = steps.withColumn("_above", F.lag("_class").over(falling)).withColumn("_factor", F.col("_left") / F.col("_tail"))
    fits = steps.where(F.col("_factor") * F.col("_class") < 1)
    first = F.max_by(F.struct("_factor", "_above", "_left"), "_class").alias("f")
    return fits.groupBy("_source").agg(first).select("_source", "f._factor", F.col("f._above").alias("_sure_from"), "f._left")


def _ranked(rows: DataFrame, plans: DataFrame, seed: int) -> DataFrame:
    """rows (_id, _source, _size, ...) with the plan of their source, _sure (one more certain copy) and their rank, null if they aren't drawn."""
    u = uniform(F.col("_id"), seed)
    kind = F.when(F.col("_size") > 0, size_class(F.col("_size")))
    planned = _join(rows, plans).withColumn("_class", kind)
    sure = F.coalesce(F.col("_class") >= F.col("_sure_from"), F.lit(False))
    planned = planned.withColumn("_sure", sure).withColumn("_p", F.when(~sure, F.col("_factor") * F.col("_class")))
    rank = (u / (1 - u)) / (F.col("_p") / (1 - F.col("_p")))
    return planned.withColumn("_rank", F.when(F.col("_p").isNotNull() & (F.col("_p") > 0), rank)).drop("_class", "_p")


def _ends(ranked: DataFrame, depth: int) -> DataFrame:
    """Per source, the range of ranks in which its sample ends, and the words before it.

    Ranges are narrowed depth times by a factor RANGES, so no window has more than RANGES rows of a source.
    """
    place = F.col("_rank") / (1 + F.col("_rank"))
    part = ranked.where("_rank is not null").withColumn("_before", F.lit(0).cast("bigint"))
    for level in range(1, depth + 1):
        part = part.withColumn("_range", F.floor(place * float(RANGES**level)))
        sums = part.groupBy("_source", "_range").agg(F.sum("_size").alias("_words"), F.first("_rest").alias("_rest"), F.first("_before").alias("_before"))
        run = Window.partitionBy("_source").orderBy("_range")
        sums = sums.withColumn("_upto", F.col("_before") + F.sum("_words").over(run)).where("_upto > _rest")
        end = F.min_by(F.struct("_range", (F.col("_upto") - F.col("_words")).alias("before")), "_range").alias("end")
        ends = cut(sums.groupBy("_source").agg(end).select("_source", F.col("end._range").alias("_end"), F.col("end.before").alias("_from")), "ends")
        part = _join(part, ends).where("_range = _end").withColumn("_before", F.col("_from")).drop("_end", "_from")
    return part


KEY = ("_rank", "_size", "_id")


def _plan(sized: DataFrame, weights: tuple[int, ...], most: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per source: target, certain copies and inclusion; the key at which its sample stops; the one further document."""
    kind = F.when(F.col("_size") > 0, size_class(F.col("_size"))).alias("_class")
    classes = cut(sized.groupBy("_source", kind).agg(F.sum("_size").alias("_words")), "classes")
    targets = cut(source_targets(classes.select(F.col("_source").alias("source"), F.col("_words").alias("size")), weights, most), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # A ratio that rounding left just beside a whole number is that whole number.
    whole = F.abs(ratio - F.round(ratio)) < 1e-12
    plans = targets.withColumn("_certain", F.when(whole, F.round(ratio)).otherwise(F.floor(ratio)).cast("bigint"))
    plans = plans.withColumn("_rest", F.when(~whole, F.col("target") - F.col("_certain") * F.col("source_size")))
    plans = plans.select(F.col("source").alias("_source"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), "_certain", "_rest")
    names = plans.where("_rest is not null").select(F.col("_source").alias("_name"), "_rest")
    drawing = classes.where("_class is not null").join(names, F.col("_source").eqNullSafe(F.col("_name")))
    factors = inclusion(drawing).withColumnRenamed("_source", "_name")
    plans = cut(plans.drop("_rest").join(factors, F.col("_source").eqNullSafe(F.col("_name")), "left").drop("_name"), "plans")

    ranked = _ranked(sized, plans, seed).withColumnRenamed("_left", "_rest")
    order = Window.partitionBy("_source").orderBy(*KEY)
    upto = F.col("_before") + F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    last = _ends(ranked, DEPTH).withColumn("_upto", upto).groupBy("_source").agg(
        F.min(F.when(F.col("_upto") > F.col("_rest"), F.struct(*KEY))).alias("_stop"),
        F.max(F.when(F.col("_upto") <= F.col("_rest"), F.col("_upto"))).alias("reached"),
        F.first("_before").alias("before"),
        F.first("_rest").alias("rest"),
    )
    stops = cut(last.select("_source", "_stop", (F.col("rest") - F.coalesce("reached", "before")).alias("_gap")), "stops")

    # One more document where it brings the source nearer to its target.
    miss = F.abs(F.col("_size") - F.col("_gap"))
    left = _join(ranked, stops).where("_rank is not null").where(~(F.struct(*KEY) < F.col("_stop"))).where(miss < F.col("_gap"))
    extra = cut(left.groupBy("_source").agg(F.min(F.struct(miss.alias("miss"), *KEY)).alias("_extra")), "extra")
    return plans, stops, extra


def _copies(rows: DataFrame, plan: tuple[DataFrame, DataFrame, DataFrame], seed: int) -> DataFrame:
    """rows (_id, _source, _size, ...) with _source_size, _target and _copies, by joins with one row per source alone."""
    plans, stops, extra = plan
    done = _join(_join(_ranked(rows, plans, seed), stops, "left"), extra, "left")
    sampled = F.col("_rank").isNotNull() & (F.col("_stop").isNull() | (F.struct(*KEY) < F.col("_stop")))
    hit = (F.col("_extra._rank") == F.col("_rank")) & (F.col("_extra._size") == F.col("_size")) & F.col("_extra._id").eqNullSafe(F.col("_id"))
    drawn = F.col("_sure") | sampled | F.coalesce(hit, F.lit(False))
    return done.withColumn("_copies", F.col("_certain") + drawn.cast("bigint"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> dict[str, Column]:
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint")
    return {"_id": F.col(id_col), "_source": F.col(source_col), "_size": size}


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
    seed: int = 7,
) -> DataFrame:
    """One row per row of docs: id, source, size, source_size, target, copies, taken.

    size: number of words; null texts have none and are never drawn (taken 0).  A
    source of no words has target 0.  Rows that repeat an id each count, with equal
    random numbers; ties of rank go by size, then id (rows that tie in all three are taken together).  Null ids share one random number; null sources
    form a source of their own, the last.  An empty table gives no rows.
    """
    sized = cut(docs.select(*[c.alias(n) for n, c in _sized(docs, id_col, text_col, source_col).items()]), "sizes")
    done = _copies(sized, _plan(sized, weights, most, seed), seed)
    return done.select(
        F.col("_id").alias(id_col),
        F.col("_source").alias(source_col),
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        F.col("_copies").alias("copies"),
        (F.col("_copies") * F.col("_size")).alias("taken"),
    )


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
    seed: int = 7,
) -> DataFrame:
    """The rows of docs, each as many times as ``mix`` takes it; rows that it doesn't take, and rows of no words, go.

    Texts pass through joins with one row per source and aren't shuffled unless sources outgrow a broadcast.
    Columns of any name are kept as they are.
    """
    columns = _sized(docs, id_col, text_col, source_col)
    sized = cut(docs.select(*[c.alias(n) for n, c in columns.items()]), "sizes")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), *[c.alias(n) for n, c in columns.items()])
    done = _copies(rows, _plan(sized, weights, most, seed), seed).where("_copies > 0 and _size > 0")
    copies = done.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy"))
    return copies.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
