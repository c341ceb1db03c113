"""Readers of events and recordings."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.meta import SPIKE_COLUMNS, RecordingMeta
from eventloom.operators.graph import settle

PREPROCESSING: dict[str, Callable] = {}


def preprocessing(name: str) -> Callable:
    """Registers a function (chunks, meta, **options) -> chunks under a name for recording parameters."""

    def put(function: Callable) -> Callable:
        PREPROCESSING[name] = function
        return function

    return put


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever file system it names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def files_of(spark: SparkSession, paths: str | list[str]) -> list[tuple[str, int]]:
    """(path, bytes) of the files at paths, those of a folder or pattern in the order of their names."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf, out = spark.sparkContext._jsc.hadoopConfiguration(), []
    for path in [paths] if isinstance(paths, str) else paths:
        fs = hadoop.Path(path).getFileSystem(conf)
        found = []
        for status in fs.globStatus(hadoop.Path(path)) or []:
            found += list(fs.listStatus(status.getPath())) if status.isDirectory() else [status]
        names = [(f.getPath().toString(), f.getLen()) for f in found if f.isFile() and not f.getPath().getName().startswith(("_", "."))]
        out += sorted(names)
    return out


def _read_at(path: str, offset: int, size: int) -> bytes:
    """A range of bytes of a file, read where this runs."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    with system.open_input_file(inner) as f:
        return f.read_at(size, offset)


def read_ranges(spark: SparkSession, files: list[tuple[str, int, int]], item: int, items: int) -> DataFrame:
    """(part, path, at, first, n): files (path, offset of the data, number of items of ``item`` bytes) one after the other, cut into parts of
    at most ``items`` items.  first: the item that a part begins with, over all files; at: its place in the file, in bytes."""
    rows, first_part, first_item = [], 0, 0
    for path, offset, n in files:
        parts = -(-n // items)
        rows.append((path, offset, n, first_part, first_part + parts, first_item))
        first_part, first_item = first_part + parts, first_item + n
    table = spark.createDataFrame(rows, "path string, offset long, total long, low long, high long, before long")
    # One row per file is broadcast.
    parts = spark.range(first_part).withColumnRenamed("id", "part")
    placed = parts.join(F.broadcast(table), (F.col("part") >= F.col("low")) & (F.col("part") < F.col("high")))
    skip = (F.col("part") - F.col("low")) * items
    return placed.select("part", "path", (F.col("offset") + skip * item).alias("at"), (F.col("before") + skip).alias("first"), F.least(F.col("total") - skip, F.lit(items)).alias("n"))


def read_npy(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(position, one column per path) of one-dimensional .npy files of one length, read side by side, by ranges, on the executors."""
    heads = {}
    for column, path in paths.items():
        (name, size), *_ = files_of(spark, path)
        head = io.BytesIO(_read_at(name, 0, min(size, 1 << 16)))
        version = np.lib.format.read_magic(head)
        shape, _, dtype = np.lib.format.read_array_header_1_0(head) if version == (1, 0) else np.lib.format.read_array_header_2_0(head)
        heads[column] = (name, head.tell(), dtype.str, int(np.prod(shape)))
    sizes = {n for _, _, _, n in heads.values()}
    if len(sizes) != 1:
        raise ValueError(f"{', '.join(paths.values())} differ in length")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples():
                out = {"position": np.arange(r.first, r.first + r.n)}
                for column, (name, offset, kind, _) in heads.items():
                    width = np.dtype(kind).itemsize
                    out[column] = np.frombuffer(_read_at(name, offset + r.first * width, r.n * width), kind).astype("int64")
                yield pd.DataFrame(out)

    (name, offset, kind, count), *_ = heads.values()
    ranges = read_ranges(spark, [(name, offset, count)], np.dtype(kind).itemsize, 1 << 20)
    return ranges.mapInPandas(run, ", ".join(["position bigint", *(f"{c} bigint" for c in heads)]))


def read_sorting(spark: SparkSession, name: str, path: str) -> DataFrame:
    """Events of one sorting: a folder with spike_times.npy and spike_clusters.npy, or a Parquet or CSV table (unit_id, sample_index)."""
    if not exists(spark, path):
        raise FileNotFoundError(f"sorting {name!r}: there is no {path}")
    if exists(spark, f"{path}/spike_times.npy"):
        rows = read_npy(spark, {"sample_index": f"{path}/spike_times.npy", "unit_id": f"{path}/spike_clusters.npy"})
    elif path.endswith(".csv"):
        rows = spark.read.csv(path, header=True, schema="unit_id bigint, sample_index bigint")
    else:
        rows = spark.read.parquet(path)
    return rows.select(F.lit(name).alias("sorting"), F.col("unit_id").cast("long").alias("unit_id"), F.col("sample_index").cast("long").alias("sample_index"))


def read_sortings(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """The events of all sortings, by name."""
    out = spark.createDataFrame([], "sorting string, unit_id bigint, sample_index bigint")
    for name, path in paths.items():
        out = out.unionByName(read_sorting(spark, name, path))
    return out.select(*SPIKE_COLUMNS)


EXTRACTORS: dict[str, Callable] = {}


def extractor(name: str) -> Callable:
    """Registers a function (spark, **extractor_params) -> recording parameters (fs, t_max, n_channels, path, ...) under a name."""

    def put(function: Callable) -> Callable:
        EXTRACTORS[name] = function
        return function

    return put


@extractor("binary")
def binary(spark: SparkSession, file_paths: str | list[str], sampling_frequency: float, num_channels: int, dtype: str, **_: object) -> dict:
    """Raw interleaved files, one after the other."""
    size = sum(n for _, n in files_of(spark, file_paths))
    return {"fs": sampling_frequency, "t_max": size // (num_channels * np.dtype(dtype).itemsize), "n_channels": num_channels, "path": file_paths, "dtype": dtype}


def read_recording(spark: SparkSession, params: dict, channels: DataFrame | None = None) -> tuple[RecordingMeta, DataFrame | None]:
    """Meta data and chunks (chunk_id, start_frame, samples) of recording parameters; see ``read_recorded``."""
    return read_recorded(spark, params, channels)[:2]


def read_recorded(spark: SparkSession, params: dict, channels: DataFrame | None = None) -> tuple[RecordingMeta, DataFrame | None, DataFrame | None]:
    """Meta data, chunks (chunk_id, start_frame, samples) and channels of recording parameters.

    fs, t_max, n_channels, and path: a Parquet table of chunks, or with ``dtype`` raw files (a path, a folder, a pattern or a list) of frames of n_channels values, cut into
    chunks of chunk_frames.  Or recording_extractor and extractor_params, for a registered extractor.  probe_file: the places of the
    channels.  preprocessing: {name: options}, applied in order; channels that it leaves out leave the channels, too, which are numbered anew.
    """
    if "recording_extractor" in params:
        name = params["recording_extractor"]
        if name not in EXTRACTORS:
            raise ValueError(f"unknown recording_extractor {name!r}: one of {', '.join(EXTRACTORS)}, or register one")
        params = EXTRACTORS[name](spark, **params.get("extractor_params", {})) | {k: v for k, v in params.items() if k not in ("recording_extractor", "extractor_params")}
    meta = RecordingMeta(float(params["fs"]), int(params["t_max"]), int(params.get("n_channels", 0)))
    if meta.fs <= 0 or meta.t_max <= 0:
        raise ValueError("a recording needs a sampling frequency and frames")
    if channels is None and params.get("probe_file"):
        channels = read_channels(spark, params["probe_file"])
    path = params.get("path")
    if path is None or not files_of(spark, path):
        return meta, None, channels
    if "dtype" in params:
        chunks = read_raw(spark, path, params["dtype"], meta.n_channels, int(params.get("chunk_frames", 30_000)))
    else:
        chunks = spark.read.parquet(path)
    return prepared(chunks, meta, channels, params.get("preprocessing") or {})


def prepared(chunks: DataFrame, meta: RecordingMeta, channels: DataFrame | None, steps: dict[str, dict]) -> tuple[RecordingMeta, DataFrame, DataFrame | None]:
    """Meta data, chunks and channels after the named preprocessing steps."""
    for name, options in steps.items():
        if name not in PREPROCESSING:
            raise ValueError(f"unknown preprocessing {name!r}: one of {', '.join(PREPROCESSING)}")
        done = PREPROCESSING[name](chunks, meta, **(options if isinstance(options, dict) else {}))
        if isinstance(done, tuple):
            chunks, kept = done
            meta = replace(meta, n_channels=len(kept))
            if channels is not None:
                place = F.array_position(F.array(*map(F.lit, kept)).cast("array<int>"), F.col("channel")) - 1
                channels = channels.where(F.col("channel").isin(kept)).withColumn("channel", place.cast("int"))
        else:
            chunks = done
    return meta, chunks, channels


def read_raw(spark: SparkSession, path: str | list[str], dtype: str, n_channels: int, chunk_frames: int) -> DataFrame:
    """Chunks of raw interleaved files, one after the other in the order of their names; frames count on from file to file.

    Files are read by ranges of bytes, a chunk at a time, so a file of any size is spread over all tasks.
    """
    item = n_channels * np.dtype(dtype).itemsize
    files = files_of(spark, path)
    if bad := [f for f, n in files if n % item]:
        raise ValueError(f"{bad[0]} isn't whole frames of {n_channels} channels")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples():
                frames = np.frombuffer(_read_at(r.path, r.at, r.n * item), dtype).reshape(-1, n_channels).astype("float32")
                yield pd.DataFrame({"chunk_id": [r.part], "start_frame": [r.first], "samples": [frames.tolist()]})

    ranges = read_ranges(spark, [(f, 0, n // item) for f, n in files], item, chunk_frames)
    return ranges.mapInPandas(run, "chunk_id long, start_frame long, samples array<array<float>>")


@preprocessing("cache")
def cache(chunks: DataFrame, meta: RecordingMeta, **_: object) -> DataFrame:
    """Written once to the shared folder, so that steps before it aren't done again."""
    return settle(chunks, "recording")


@preprocessing("filter")
def band_filter(chunks: DataFrame, meta: RecordingMeta, band: tuple[float | None, float | None], margin: int = 300) -> DataFrame:
    from eventloom.functions.signal import filter_recording

    return filter_recording(chunks, tuple(band), meta.fs, margin)


@preprocessing("common_reference")
def common_reference(chunks: DataFrame, meta: RecordingMeta, operator: str = "median") -> DataFrame:
    """Each frame without its median over channels (the mean of both middle values if their number is even)."""
    if operator != "median":
        raise ValueError(f"common_reference: unknown operator {operator!r}, only median")

    def centred(row: Column) -> Column:
        # The row is sorted once: the inner lambda gets the sorted row as an argument.
        n = F.size(row)
        low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
        middle = F.transform(F.array(F.array_sort(row)), lambda s: (F.get(s, low) + F.get(s, high)) / 2)
        return F.flatten(F.transform(middle, lambda m: F.transform(row, lambda v: v - m)))

    return chunks.withColumn("samples", F.transform("samples", centred).cast("array<array<float>>"))


@preprocessing("remove_bad_channels")
def remove_bad_channels(chunks: DataFrame, meta: RecordingMeta, ratio: float = 5.0) -> tuple[DataFrame, list[int]]:
    """Channels whose noise is more than ratio times, or less than 1 / ratio of, the median channel's are left out; (chunks, channels that stay)."""
    from eventloom.operators.templates import noise_levels

    noise = sorted((r["noise"], r["channel"]) for r in noise_levels(chunks).collect())  # one row per channel
    middle = (noise[(len(noise) - 1) // 2][0] + noise[len(noise) // 2][0]) / 2 if noise else 0.0
    good = sorted(c for v, c in noise if v <= ratio * middle and v * ratio >= middle)
    kept = F.array(*map(F.lit, good)).cast("array<int>")
    return chunks.withColumn("samples", F.transform("samples", lambda row: F.transform(kept, lambda c: F.get(row, c)))), good


def read_channels(spark: SparkSession, path: str) -> DataFrame:
    """(channel, x, y, shank) of a probe file: {probes: [{contact_positions, shank_ids, device_channel_indices}]}."""
    probes = spark.read.option("multiLine", True).json(path).select(F.explode("probes").alias("p"))
    rows = probes.select(F.posexplode("p.contact_positions").alias("at", "xy"), "p")
    names = probes.schema["p"].dataType.fieldNames()
    index = F.get(F.col("p.device_channel_indices"), F.col("at")) if "device_channel_indices" in names else F.col("at")
    shank = F.get(F.col("p.shank_ids"), F.col("at")).cast("string") if "shank_ids" in names else F.lit("0")
    return rows.select(index.cast("int").alias("channel"), F.get("xy", F.lit(0)).cast("double").alias("x"), F.get("xy", F.lit(1)).cast("double").alias("y"), shank.alias("shank"))
