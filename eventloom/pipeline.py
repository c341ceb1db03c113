"""Pipelines: ordered steps over a dataset, each written down so that a later run resumes after it."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.config import fan_out
from eventloom.meta import UNIT, Dataset, RecordingMeta, dataset
from eventloom.operators.graph import settle
from eventloom.operators.selection import category_filter, split_dataset, union_renumbered
from eventloom.registry import Step, find
from eventloom.sources.tables import exists, prepared, read_recorded, read_sortings


class Pipeline:
    """steps: {key: {category: params}}; logs_folder: where finished steps are kept, if anywhere."""

    def __init__(self, data: Dataset, steps: dict, logs_folder: str | None = None, overwrite: bool = False):
        self.data, self.steps, self.logs, self.overwrite = data, fan_out(steps), logs_folder, overwrite

    def run(self) -> Dataset:
        for key, categories in self.steps.items():
            step = find(key)
            folder = f"{self.logs}/{key}" if self.logs else None
            if folder and not self.overwrite and exists(self.spark, f"{folder}/units/_SUCCESS"):
                self.data = self._read(folder)
                continue
            self.data = self._run_step(step, categories)
            keep = not step.exports or any(p.get("export_sortings") for p in categories.values())
            if folder and keep:
                self._write(folder)
            else:
                self.data = self.data.replace(spikes=settle(self.data.spikes, "spikes"), units=settle(self.data.units, "units"))
        return self.data

    @property
    def spark(self) -> SparkSession:
        return self.data.spikes.sparkSession

    def _write(self, folder: str) -> None:
        self.data.spikes.write.mode("overwrite").parquet(f"{folder}/spikes")
        for k, table in enumerate(self.data.audit):
            table.write.mode("overwrite").parquet(f"{folder}/audit_{k}")
        self.data.units.write.mode("overwrite").parquet(f"{folder}/units")
        self.data = self._read(folder)

    def _read(self, folder: str) -> Dataset:
        read = self.spark.read.parquet
        audit = []
        while exists(self.spark, f"{folder}/audit_{len(audit)}/_SUCCESS"):
            audit.append(read(f"{folder}/audit_{len(audit)}"))
        return self.data.replace(spikes=read(f"{folder}/spikes"), units=read(f"{folder}/units"), audit=tuple(audit))

    def _run_step(self, step: Step, categories: dict) -> Dataset:
        if step.multi:
            return self._run_multi(step, categories)
        data = self.data
        for category, given in categories.items():
            params = step.params(given)
            condition = category_filter(category)
            if "sortings" in params:
                condition = condition & F.col("sorting").isin(params.pop("sortings"))
            inside, outside = split_dataset(data, condition)
            done = step.run(inside, params)
            data = self._joined(done, outside)
        return data

    def _run_multi(self, step: Step, categories: dict) -> Dataset:
        """Results of the categories together replace all sortings; units in none of them go."""
        out: Dataset | None = None
        for category, given in categories.items():
            params = step.params(given)
            condition = category_filter(category)
            if "sortings" in params:
                condition = condition & F.col("sorting").isin(params.pop("sortings"))
            inside, _ = split_dataset(self.data, condition)
            done = step.run(inside, params)
            label = None if category == "all" else category
            done = done.replace(units=done.units.withColumn("category", F.lit(label).cast("string")))
            out = done if out is None else self._stacked(out, done)
        return out if out is not None else self.data

    @staticmethod
    def _joined(done: Dataset, outside: Dataset) -> Dataset:
        units = done.units.unionByName(outside.units, allowMissingColumns=True)
        return done.replace(spikes=done.spikes.unionByName(outside.spikes), units=units)

    @staticmethod
    def _stacked(first: Dataset, second: Dataset) -> Dataset:
        """Both; ids of the second that the first has too become new ones, the others stay."""
        ids = union_renumbered(first.units.select("unit_id").distinct(), second.units.select("unit_id").distinct()).where("side = 2")
        ids = settle(ids.select("unit_id", F.col("new_unit_id").cast("long").alias("_new")), "ids")
        move = lambda df: df.join(ids, "unit_id").withColumn("unit_id", F.col("_new")).drop("_new")
        return first.replace(
            spikes=first.spikes.unionByName(move(second.spikes)),
            units=first.units.unionByName(move(second.units), allowMissingColumns=True),
            audit=(*first.audit, *second.audit),
        )


#: Detectors by name: callables (recording chunks, params) -> (unit_id, sample_index).
DETECTORS: dict[str, Callable] = {}


def detector(name: str) -> Callable:
    """Registers a detector for the ``spike_sorting`` section of parameters."""

    def put(function: Callable) -> Callable:
        DETECTORS[name] = function
        return function

    return put


def from_params(spark: SparkSession, params: dict) -> Pipeline:
    """The pipeline of a parameter set (see ``config.load``).

    recording: see ``read_recorded``.  sortings (or analyses): paths by name.  spike_sorting: {name: {sorter_name, preprocessing,
    sorter_params: {folder or output_folder, ...}}}, registered detectors whose results are kept in their folder and read back from there.
    pipeline, logs_folder, overwrite_logs: at the top or together in a section of any name.
    """
    section = params if "pipeline" in params else next((v for v in params.values() if isinstance(v, dict) and "pipeline" in v), None)
    if section is None:
        raise ValueError("the parameters have no pipeline")
    known = {"recording", "sortings", "analyses", "spike_sorting", "pipeline", "logs_folder", "overwrite_logs", "logs_level", "tmp_folder"}
    if strange := [k for k, v in params.items() if k not in known and v is not section]:
        warnings.warn(f"unknown parameters: {', '.join(strange)}", stacklevel=2)
    meta, chunks, channels = read_recorded(spark, params["recording"])
    spikes = read_sortings(spark, (params.get("analyses") or {}) | (params.get("sortings") or {}))
    more = {"recording": chunks, "channels": channels}
    data = dataset(spikes, meta, **{k: v for k, v in more.items() if v is not None})
    for name, given in (params.get("spike_sorting") or {}).items():
        own = dict(given.get("sorter_params") or {})
        folder = own.pop("folder", own.pop("output_folder", None))
        data = add_sorting(data, name, DETECTORS.get(given["sorter_name"], given["sorter_name"]), own, folder, given.get("preprocessing") or {})
    return Pipeline(data, section["pipeline"], section.get("logs_folder"), bool(section.get("overwrite_logs")))


def add_sorting(data: Dataset, name: str, detector: Callable | str, params: dict, folder: str | None = None, preprocessing: dict | None = None) -> Dataset:
    """data with the events of a detector: a callable (recording, params) -> (unit_id, sample_index); read back from folder if it ran before."""
    spark = data.spikes.sparkSession
    if folder and exists(spark, f"{folder}/_SUCCESS"):
        found: DataFrame = spark.read.parquet(folder)
    else:
        if isinstance(detector, str):
            raise ValueError(f"sorting {name!r}: there is no detector {detector!r} and no result in its folder; register the detector")
        recording = data.recording
        if recording is not None and preprocessing:
            recording = prepared(recording, data.meta, None, preprocessing)[1]
        found = detector(recording, params).select("unit_id", "sample_index").where(F.col("sample_index").between(0, data.meta.t_max - 1))
        if folder:
            found.write.mode("overwrite").parquet(folder)
            found = spark.read.parquet(folder)
    rows = found.select(F.lit(name).alias("sorting"), "unit_id", "sample_index")
    units = rows.select(*UNIT).distinct()
    return data.replace(spikes=data.spikes.unionByName(rows), units=data.units.unionByName(units, allowMissingColumns=True))


__all__ = ["Pipeline", "RecordingMeta", "add_sorting", "dataset", "detector", "from_params"]
