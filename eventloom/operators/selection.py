"""Choosing, tagging, splitting and joining units."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.meta import UNIT, Dataset
from eventloom.operators.metrics import metric


def category_filter(category: str, column: str = "category") -> Column:
    """A condition from a selector: terms joined by +, each ``all``, ``rest`` (no category) or a name."""

    def term(name: str) -> Column:
        if name == "all":
            return F.lit(True)
        if name == "rest":
            return F.coalesce(F.col(column), F.lit("")) == ""
        return F.coalesce(F.col(column) == name, F.lit(False))

    return reduce(lambda a, b: a | b, [term(x) for x in category.split("+")])


def split_dataset(data: Dataset, condition: Column) -> tuple[Dataset, Dataset]:
    """The units that meet the condition, and the others."""
    flagged = data.units.withColumn("_in", F.coalesce(condition, F.lit(False)))
    inside, outside = flagged.where("_in").drop("_in"), flagged.where("not _in").drop("_in")
    return data.only(inside), data.only(outside)


def without_empty(data: Dataset) -> Dataset:
    """The dataset without units that have no events."""
    return data.replace(units=data.units.join(data.spikes.select(*UNIT).distinct(), [*UNIT], "left_semi"))


def _measured(data: Dataset, rules: dict[str, dict]) -> DataFrame:
    """Units with a column m0, m1, ... for each metric of the rules."""
    out = data.units
    for k, (name, rule) in enumerate(rules.items()):
        values = metric(name, data, rule).select(*UNIT, F.col("value").alias(f"m{k}"))
        out = out.join(values, [*UNIT], "left")
    return out


def bad_units(data: Dataset, rules: dict[str, dict]) -> DataFrame:
    """(sorting, unit_id, reasons) of units with a metric below min or above max.

    Unknown metrics remove nothing.  The rule ``all`` takes every unit.
    """
    if "all" in rules:
        return data.units.select(*UNIT, F.lit("all").alias("reasons"))
    reasons = []
    measured = _measured(data, rules)
    for k, (name, rule) in enumerate(rules.items()):
        v = F.col(f"m{k}")
        for bound, broken in (("min", lambda x, b: x < b), ("max", lambda x, b: x > b)):
            if bound in rule:
                said = F.format_string(f"{name} %s {rule[bound]:g}", F.lit("<" if bound == "min" else ">"))
                reasons.append(F.when(broken(v, F.lit(float(rule[bound]))), said))
    if not reasons:
        return measured.select(*UNIT, F.lit("").alias("reasons")).where(F.lit(False))
    return measured.select(*UNIT, F.concat_ws(" ; ", *reasons).alias("reasons")).where("reasons <> ''")


def categorise(data: Dataset, categories: dict[str, dict[str, dict]], column: str = "category") -> DataFrame:
    """The units with a category given to those that have none: the first whose conditions all hold strictly.

    The key ``clear`` empties the category of all units first.
    """
    units = data.units
    if "clear" in categories:
        units = units.withColumn(column, F.lit(None).cast("string"))
    rules = {c: r for c, r in categories.items() if c != "clear"}
    every: dict[str, dict] = {}
    where: dict[tuple[str, str], int] = {}
    for c, r in rules.items():
        for name, rule in r.items():
            same = next((k for k, (n, p) in enumerate(every.values()) if n == name and _params(p) == _params(rule)), None)
            if same is None:
                same = len(every)
                every[str(same)] = (name, rule)
            where[c, name] = same
    measured = units
    for k, (name, rule) in enumerate(every.values()):
        measured = measured.join(metric(name, data, rule).select(*UNIT, F.col("value").alias(f"m{k}")), [*UNIT], "left")
    chain = F.lit(None).cast("string")
    for c, r in reversed(rules.items()):
        holds = F.lit(True)
        for name, rule in r.items():
            v = F.col(f"m{where[c, name]}")
            if "min" in rule:
                holds = holds & F.coalesce(v > float(rule["min"]), F.lit(False))
            if "max" in rule:
                holds = holds & F.coalesce(v < float(rule["max"]), F.lit(False))
        chain = F.when(holds, F.lit(c)).otherwise(chain)
    own = F.when(F.col(column) != "", F.col(column))
    return measured.withColumn(column, F.coalesce(own, chain)).select(*units.columns)


def _params(rule: dict) -> dict:
    return {k: v for k, v in rule.items() if k not in ("min", "max")}


def union_renumbered(first: DataFrame, second: DataFrame, order: str | None = None) -> DataFrame:
    """(unit_id, new_unit_id, side) of the union of two lists of units of one sorting.

    Ids of the second that the first has too become max(all ids) + 1, + 2, ... in the order of ``order`` or of the id.
    """
    a = first.select("unit_id", F.col("unit_id").alias("new_unit_id"), F.lit(1).alias("side"))
    clash = second.join(first.select(F.col("unit_id").alias("_id")), F.col("unit_id") == F.col("_id"), "left").withColumn("_clash", F.col("_id").isNotNull())
    top = first.select("unit_id").union(second.select("unit_id")).agg(F.max("unit_id").alias("_top"))
    rank = F.sum(F.col("_clash").cast("long")).over(Window.partitionBy("_clash").orderBy(order or "unit_id").rowsBetween(Window.unboundedPreceding, 0))
    b = clash.join(top).withColumn("_rank", rank)
    b = b.select("unit_id", F.when(F.col("_clash"), F.col("_top") + F.col("_rank")).otherwise(F.col("unit_id")).alias("new_unit_id"), F.lit(2).alias("side"))
    return a.union(b)


def dense_ids(units: DataFrame) -> DataFrame:
    """(sorting, unit_id, new_id): ids 0, 1, ... over all sortings, by name, then id."""
    return units.select(*UNIT, (F.row_number().over(Window.orderBy(*UNIT)) - 1).cast("long").alias("new_id"))


def frame_slice(data: Dataset, start: int, stop: int) -> Dataset:
    """The events from start on and before stop, on a clock that begins at start; units stay."""
    inside = data.spikes.where((F.col("sample_index") >= start) & (F.col("sample_index") < stop))
    meta = replace(data.meta, t_max=stop - start)
    return data.replace(spikes=inside.withColumn("sample_index", F.col("sample_index") - start), meta=meta)


def channel_slice(data: Dataset, channels: list[int]) -> Dataset:
    """The dataset of some channels, numbered anew in the order given."""
    wanted = F.array(*map(F.lit, channels)).cast("array<int>")
    out = {"meta": replace(data.meta, n_channels=len(channels))}
    if data.recording is not None:
        out["recording"] = data.recording.withColumn("samples", F.transform("samples", lambda row: F.transform(wanted, lambda c: F.get(row, c))))
    place = F.array_position(wanted, F.col("channel").cast("int")) - 1
    if data.templates is not None:
        out["templates"] = data.templates.where(F.col("channel").isin(channels)).withColumn("channel", place.cast("int"))
    if data.channels is not None:
        out["channels"] = data.channels.where(F.col("channel").isin(channels)).withColumn("channel", place.cast("int"))
    return data.replace(**out)


def sanity_check(data: Dataset) -> DataFrame:
    """(violation, n): how many events break which invariant of a dataset."""
    t = F.col("sample_index")
    rules = {
        "no sorting": F.col("sorting").isNull(),
        "no unit": F.col("unit_id").isNull(),
        "no time": t.isNull(),
        "before the recording": t < 0,
        "after the recording": t >= data.meta.t_max,
    }
    counts = data.spikes.agg(*[F.count(F.when(c, 1)).alias(name) for name, c in rules.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("violation"), F.col(f"`{n}`").alias("n")) for n in rules])).alias("r")).select("r.*")
