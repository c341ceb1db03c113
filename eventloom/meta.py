"""What the engine works on: labelled point events over one shared time axis."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = ("sorting", "unit_id")
SPIKE_COLUMNS = ("sorting", "unit_id", "sample_index")


@dataclass(frozen=True)
class RecordingMeta:
    """Sampling frequency in Hz, length in samples, and channel count of the recording."""

    fs: float
    t_max: int
    n_channels: int = 0

    def samples(self, ms: float) -> float:
        return ms * 1e-3 * self.fs


@dataclass(frozen=True)
class Dataset:
    """DataFrames of one analysis.

    spikes(sorting, unit_id, sample_index); units(sorting, unit_id, category, ...), which keeps units
    without spikes; templates(sorting, unit_id, sample, channel, value); recording as chunks
    (chunk_id, start_frame, samples); channels(channel, x, y, shank).  The last three are optional.
    """

    spikes: DataFrame
    units: DataFrame
    meta: RecordingMeta
    templates: DataFrame | None = None
    recording: DataFrame | None = None
    channels: DataFrame | None = None
    audit: tuple[DataFrame, ...] = field(default=())

    def replace(self, **changes: object) -> Dataset:
        return replace(self, **changes)

    def only(self, units: DataFrame) -> Dataset:
        """The part of the dataset that belongs to the given units."""
        keys = units.select(*UNIT).distinct()
        kept = {"spikes": self.spikes.join(keys, [*UNIT], "left_semi"), "units": self.units.join(keys, [*UNIT], "left_semi")}
        if self.templates is not None:
            kept["templates"] = self.templates.join(keys, [*UNIT], "left_semi")
        return self.replace(**kept)

    def without(self, units: DataFrame) -> Dataset:
        """The dataset without the given units."""
        keys = units.select(*UNIT).distinct()
        kept = {"spikes": self.spikes.join(keys, [*UNIT], "left_anti"), "units": self.units.join(keys, [*UNIT], "left_anti")}
        if self.templates is not None:
            kept["templates"] = self.templates.join(keys, [*UNIT], "left_anti")
        return self.replace(**kept)


def dataset(spikes: DataFrame, meta: RecordingMeta, **more: DataFrame) -> Dataset:
    """A dataset of the events within the recording; events without a sorting are refused by ``sanity_check``."""
    spikes = spikes.select(*SPIKE_COLUMNS).where(F.col("sample_index").between(0, meta.t_max - 1))
    units = spikes.select(*UNIT).distinct().withColumn("category", F.lit(None).cast("string"))
    return Dataset(spikes, units, meta, **more)
