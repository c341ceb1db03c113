"""Writers: folders for manual curation tools, TSV files, graphs, and audit trails."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.meta import UNIT, Dataset
from eventloom.operators.selection import dense_ids


def output_path(path: str, sorting: str, n_sortings: int) -> str:
    """The folder of one sorting: a subfolder of its name if there are several sortings."""
    return path if n_sortings <= 1 else f"{path.rstrip('/')}/{sorting}"


def write_tsv(path: str, name: str, keys: list, values: list) -> None:
    """``cluster_id<TAB>name`` and a line per key, without a newline at the end."""
    if len(keys) != len(values):
        raise AssertionError("as many keys as values are needed")
    if not path.endswith(".tsv"):
        raise AssertionError(f"{path} isn't a .tsv file")
    with open(path, "w") as out:
        out.write("\n".join([f"cluster_id\t{name}", *(f"{k}\t{'' if v is None else v}" for k, v in zip(keys, values, strict=True))]))


#: Events that come to the driver at a time.
BLOCK = 1 << 18


def _save_events(events: DataFrame, folder: str) -> None:
    """spike_times.npy and spike_clusters.npy of (sample_index, cluster), by time, then cluster."""
    n = events.count()
    times = np.lib.format.open_memmap(f"{folder}/spike_times.npy", "w+", "int64", (n,))
    clusters = np.lib.format.open_memmap(f"{folder}/spike_clusters.npy", "w+", "int32", (n,))

    def packed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for s in range(0, len(part), BLOCK):
                block = part.iloc[s : s + BLOCK]
                yield pd.DataFrame({"t": [block["sample_index"].to_numpy("int64").tobytes()], "c": [block["cluster"].to_numpy("int32").tobytes()]})

    at = 0
    for row in events.orderBy("sample_index", "cluster").mapInPandas(packed, "t binary, c binary").toLocalIterator():
        t, c = np.frombuffer(row["t"], "int64"), np.frombuffer(row["c"], "int32")
        times[at : at + len(t)], clusters[at : at + len(c)] = t, c
        at += len(t)
    if at != n:
        raise RuntimeError(f"{at} events of {n} were written")
    times.flush()
    clusters.flush()


def _save_templates(waves: DataFrame, n_units: int, folder: str) -> None:
    """templates.npy (unit, sample, channel) of (u, sample, channel, value)."""
    size = waves.agg(F.max("sample").alias("s"), F.max("channel").alias("c")).first()
    if size["s"] is None:
        return
    cube = np.lib.format.open_memmap(f"{folder}/templates.npy", "w+", "float32", (n_units, size["s"] + 1, size["c"] + 1))
    one = waves.groupBy("u").agg(F.collect_list(F.struct("sample", "channel", F.col("value").cast("double"))).alias("w"))
    for row in one.toLocalIterator():
        w = np.array([tuple(x) for x in row["w"]])
        cube[row["u"], w[:, 0].astype(int), w[:, 1].astype(int)] = w[:, 2]
    cube.flush()


def export_phy(data: Dataset, path: str, properties: tuple[str, ...] = ("category",), contamination: DataFrame | None = None) -> list[str]:
    """Folders with spike_times.npy, spike_clusters.npy, templates.npy (if there are any) and a TSV per property.

    The format is one file per sorting, so each sorting's events, in order of time, stream through the driver to its files, a
    block at a time; templates likewise, a unit at a time.
    Sortings without events write nothing.
    """
    names = sorted(r["sorting"] for r in data.spikes.select("sorting").distinct().collect())
    ids = dense_ids(data.units)
    folders = []
    for name in names:
        folder = output_path(path, name, len(names))
        os.makedirs(folder, exist_ok=True)
        own = ids.where(F.col("sorting") == name)
        base = own.agg(F.min("new_id")).first()[0]
        events = data.spikes.join(own, [*UNIT]).select("sample_index", (F.col("new_id") - base).alias("cluster"))
        _save_events(events, folder)
        units = data.units.join(own, [*UNIT]).orderBy("new_id")
        if contamination is not None:
            units = units.join(contamination.select(*UNIT, F.round(F.col("value") * 100, 1).alias("contamination")), [*UNIT], "left").orderBy("new_id")
        table = units.toPandas()
        keys = (table["new_id"] - base).tolist()
        wanted = [*[p for p in properties if p in table.columns], *(["contamination"] if contamination is not None else [])]
        for p in wanted:
            write_tsv(f"{folder}/cluster_{p}.tsv", p, keys, [None if v is None or v != v else v for v in table[p].tolist()])
        if data.templates is not None:
            _save_templates(data.templates.join(own, [*UNIT]).select((F.col("new_id") - base).alias("u"), "sample", "channel", "value"), len(keys), folder)
        folders.append(folder)
    return folders


def export_tables(
    data: Dataset, path: str, amplitudes: DataFrame | None = None, components: int | None = None, random_spikes: DataFrame | None = None, waveforms: DataFrame | None = None
) -> None:
    """A folder of Parquet tables by sorting: spikes, units, templates, and what else is given; waveforms have a row per frame of an event (sample, row by channel)."""
    for name, table in (("random_spikes", random_spikes), ("waveforms", waveforms)):
        if table is not None:
            table.write.partitionBy("sorting").mode("overwrite").parquet(f"{path}/{name}")
    data.spikes.write.partitionBy("sorting").mode("overwrite").parquet(f"{path}/spikes")
    data.units.write.mode("overwrite").parquet(f"{path}/units")
    if data.templates is not None:
        data.templates.write.partitionBy("sorting").mode("overwrite").parquet(f"{path}/templates")
        if components:
            principal_components(data.templates, components).write.mode("overwrite").parquet(f"{path}/components")
    if amplitudes is not None:
        amplitudes.write.partitionBy("sorting").mode("overwrite").parquet(f"{path}/amplitudes")


def principal_components(templates: DataFrame, k: int) -> DataFrame:
    """(sorting, unit_id, channel, components): waveforms by channel on their first k principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    ordered = F.transform(F.array_sort(F.collect_list(F.struct("sample", "value"))), lambda x: x["value"].cast("double"))
    waves = templates.groupBy(*UNIT, "channel").agg(ordered.alias("wave")).withColumn("v", array_to_vector("wave"))
    model = PCA(k=k, inputCol="v", outputCol="c").fit(waves)
    return model.transform(waves).select(*UNIT, "channel", vector_to_array("c").alias("components"))


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def save_differences(pairs: DataFrame, path: str) -> None:
    """The differences of templates and correlograms of all compared pairs (s1, u1, s2, u2, temp_diff, corr_diff)."""
    pairs.write.mode("overwrite").parquet(f"{path}/differences")
