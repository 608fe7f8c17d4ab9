"""Waveforms of whole archives: multiplex groups, their samples by channel, and chunks of whole sample sets."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import waveformdata as W

GROUP, CHANNELS, SAMPLES, FREQUENCY, INTERPRETATION, DATA = "54000100", "003A0005", "003A0010", "003A001A", "54001006", "54001010"
SCHEMA = pa.schema([("file", pa.string()), ("group_ix", pa.int32()), ("channel_ix", pa.int32()), ("first_sample", pa.int64()), ("samples", pa.list_(pa.int64())), ("error", pa.string())])
DDL = "file string, group_ix int, channel_ix int, first_sample bigint, samples array<bigint>, error string"


def _numbers(values: list) -> pa.ListArray:
    """Samples as they lie in memory, null where there are none."""
    flat = [np.zeros(0, np.int64) if v is None else v.astype(np.int64) for v in values]
    ends = np.cumsum([0] + [len(f) for f in flat]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64)), mask=pa.array([v is None for v in values], pa.bool_()))


def chunks(elements: DataFrame, size: int = 4_096) -> DataFrame:
    """Samples per file, group and channel, in chunks of ``size`` sample sets; what cannot be read has an error."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        file = rows[0]["file"]
        groups: dict[int, dict[str, dict]] = {}
        for r in rows:
            if len(r["path"]) == 1 and r["path"][0]["tag"] == GROUP:
                groups.setdefault(r["path"][0]["item"], {})[r["tag"]] = r
        out: list[tuple] = []
        for ix, g in sorted(groups.items()):
            first = lambda tag, g=g: (json.loads(g[tag]["values_json"]) or [None])[0] if tag in g and g[tag]["values_json"] else None
            data = g.get(DATA, {}).get("inline_binary")
            if data is None:
                continue
            try:
                x = W.decode(bytes(data), first(INTERPRETATION) or "SS", int(first(CHANNELS) or 0))
            except ValueError as e:
                out.append((file, ix, None, None, None, str(e)))
                continue
            for channel in range(x.shape[0]):
                for start in range(0, x.shape[1], size):
                    out.append((file, ix, channel, start, x[channel, start : start + size], None))
        columns = list(zip(*out, strict=True)) if out else [[] for _ in SCHEMA]
        arrays = [pa.array(list(c), t) for c, t in zip(columns, SCHEMA.types, strict=True) if t != SCHEMA.types[4]]
        return pa.table([*arrays[:4], _numbers(list(columns[4])), arrays[4]], schema=SCHEMA)

    wanted = elements.where((F.size("path") == 1) & (F.get("path", F.lit(0))["tag"] == GROUP) & F.col("tag").isin(CHANNELS, SAMPLES, FREQUENCY, INTERPRETATION, DATA))
    return wanted.select("file", "path", "tag", "values_json", "inline_binary").groupBy("file").applyInArrow(run, DDL)


def samples(elements: DataFrame) -> DataFrame:
    """One row per sample: (file, group_ix, channel_ix, sample_ix, value)."""
    rows = chunks(elements).where("error is null").select("file", "group_ix", "channel_ix", "first_sample", F.posexplode("samples").alias("at", "value"))
    return rows.select("file", "group_ix", "channel_ix", (F.col("first_sample") + F.col("at")).alias("sample_ix"), "value")


def encoded(samples: DataFrame, interpretation: str = "SS") -> DataFrame:
    """Elements of the groups in ``samples`` (file, group_ix, channel_ix, first_sample, samples): the counterpart of ``chunks``.

    Chunks may come in any order and size, those of a group fit a task; (file, path, tag, vr, values_json, inline_binary, error).  Missing samples and values that
    do not fit the interpretation are an error of the group, which then has no data.
    """
    bits = W.np.dtype(W.TYPES[interpretation]).itemsize * 8
    kinds = pa.schema([("file", pa.string()), ("path", pa.list_(pa.struct([("tag", pa.string()), ("item", pa.int32())]))), ("tag", pa.string()), ("vr", pa.string()), ("values_json", pa.string()), ("inline_binary", pa.binary()), ("error", pa.string())])

    def run(table: pa.Table) -> pa.Table:
        file, ix = table.column("file")[0].as_py(), table.column("group_ix")[0].as_py()
        held: dict[int, dict[int, np.ndarray]] = {}
        for channel, start, values in zip(table.column("channel_ix").to_pylist(), table.column("first_sample").to_pylist(), table.column("samples"), strict=True):
            held.setdefault(channel, {})[start] = values.values.to_numpy(zero_copy_only=False)
        data, error = None, None
        try:
            rows = [np.concatenate([part for _, part in sorted(held[c].items())]) for c in sorted(held)]
            for c in held:
                ends = np.cumsum([0] + [len(p) for _, p in sorted(held[c].items())])
                if sorted(held[c]) != ends[:-1].tolist():
                    raise ValueError(f"samples of channel {c} are missing or there twice")
            if sorted(held) != list(range(len(held))) or len({len(r) for r in rows}) > 1:
                raise ValueError("channels are missing or differ in length")
            data = W.encode(np.stack(rows), interpretation)
        except ValueError as e:
            error = str(e)
        path = [{"tag": GROUP, "item": ix}]
        n = len(next(iter(held.values()))) and sum(len(p) for p in held[min(held)].values())
        values = [(CHANNELS, "US", [len(held)], None), (SAMPLES, "UL", [n], None), ("54001004", "US", [bits], None), (INTERPRETATION, "CS", [interpretation], None), (DATA, "OB" if bits == 8 else "OW", None, data)]
        out = [(file, path, tag, vr, None if v is None else json.dumps(v), b, error) for tag, vr, v, b in values if error is None or tag != DATA]
        return pa.table([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), kinds.types, strict=True)], schema=kinds)

    ddl = "file string, path array<struct<tag:string,item:int>>, tag string, vr string, values_json string, inline_binary binary, error string"
    return samples.select("file", "group_ix", "channel_ix", "first_sample", "samples").groupBy("file", "group_ix").applyInArrow(run, ddl)


def in_range(samples: DataFrame, interpretation: str) -> DataFrame:
    """(file, group_ix, fits): whether all samples of a group can be written in an interpretation; aggregated in the tasks first."""
    info = np.iinfo(np.dtype(W.TYPES[interpretation]))
    low, high = F.min(F.array_min("samples")), F.max(F.array_max("samples"))
    return samples.groupBy("file", "group_ix").agg((F.coalesce(low >= int(info.min), F.lit(True)) & F.coalesce(high <= int(info.max), F.lit(True))).alias("fits"))
