"""Signal filters in NumPy, applied by chunk or by template through Arrow."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gaussian_response(n: int, cutoff: float, fs: float) -> np.ndarray:
    """Frequency response of a Gaussian low-pass of n samples.

    Up to a cutoff of fs / 8 this is exp(-f^2 / 2 cutoff^2); above, where that would be cut off at the Nyquist
    frequency, the transform of the Gaussian sampled in time.
    """
    f = np.fft.fftfreq(n, 1 / fs)
    if cutoff <= fs / 8:
        return np.exp(-0.5 * (f / cutoff) ** 2)
    sigma = fs / (2 * math.pi * cutoff)
    half = max(1, math.ceil(6 * sigma))
    x = np.arange(-half, half + 1)
    kernel = np.exp(-0.5 * (x / sigma) ** 2)
    placed = np.zeros(n)
    np.add.at(placed, x % n, kernel / kernel.sum())
    return np.fft.fft(placed).real


def band_pass(data: np.ndarray, band: tuple[float | None, float | None], fs: float, axis: int = 0) -> np.ndarray:
    """data with frequencies in the band: low-pass at its end times one minus low-pass at its start."""
    low, high = band
    n = data.shape[axis]
    response = np.ones(n)
    if high is not None:
        response = response * gaussian_response(n, high, fs)
    if low is not None:
        response = response * (1 - gaussian_response(n, low, fs))
    shape = [1] * data.ndim
    shape[axis] = n
    return np.fft.ifft(np.fft.fft(data, axis=axis) * response.reshape(shape), axis=axis).real


def filter_templates(templates: DataFrame, band: tuple[float | None, float | None], fs: float) -> DataFrame:
    """templates(sorting, unit_id, sample, channel, value), each channel filtered along its samples."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["channel", "sample"])
        wide = part.pivot(index="sample", columns="channel", values="value").fillna(0.0)
        out = pd.DataFrame(band_pass(wide.to_numpy(), band, fs), index=wide.index, columns=wide.columns)
        long = out.stack().rename("value").reset_index()
        return long.assign(sorting=part["sorting"].iloc[0], unit_id=part["unit_id"].iloc[0])[["sorting", "unit_id", "sample", "channel", "value"]]

    return templates.groupBy("sorting", "unit_id").applyInPandas(run, templates.select("sorting", "unit_id", "sample", "channel", F.col("value").cast("double")).schema)


def filter_recording(chunks: DataFrame, band: tuple[float | None, float | None], fs: float, margin: int) -> DataFrame:
    """chunks(chunk_id, start_frame, samples array<array<float>>), filtered with the neighbours' margins.

    Margins come from the neighbouring chunks by a join on chunk_id, so no task holds more than three chunks' edges.
    """
    head = chunks.select((F.col("chunk_id") - 1).alias("chunk_id"), F.slice("samples", 1, margin).alias("after"))
    tail = chunks.select((F.col("chunk_id") + 1).alias("chunk_id"), F.slice("samples", F.greatest(F.size("samples") - margin + 1, F.lit(1)), margin).alias("before"))
    wide = chunks.join(head, "chunk_id", "left").join(tail, "chunk_id", "left")

    def run(parts):
        for part in parts:
            out = []
            for before, own, after in zip(part["before"], part["samples"], part["after"], strict=True):
                pieces = [np.array([np.asarray(r) for r in x]) for x in (before, own, after) if x is not None and len(x)]
                skip = 0 if before is None else len(before)
                clean = band_pass(np.concatenate(pieces).astype(float), band, fs)[skip : skip + len(own)]
                out.append(clean.astype("float32").tolist())
            yield pd.DataFrame({"chunk_id": part["chunk_id"], "start_frame": part["start_frame"], "samples": out})

    return wide.select("chunk_id", "start_frame", "before", "samples", "after").mapInPandas(run, chunks.select("chunk_id", "start_frame", "samples").schema)
