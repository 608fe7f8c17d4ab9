"""Modules of the standard as typed views: one row per file, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.operators import elements as E

# Fixed values of the standard: elements of the modules, by name and Spark type.
MODULES = {
    "sop_common": {"sop_class_uid": ("00080016", "string"), "sop_instance_uid": ("00080018", "string"), "character_set": ("00080005", "string"), "time_zone_offset": ("00080201", "string")},
    "image_pixel": {
        "samples_per_pixel": ("00280002", "int"), "photometric_interpretation": ("00280004", "string"), "planar_configuration": ("00280006", "int"), "n_rows": ("00280010", "int"), "n_columns": ("00280011", "int"),
        "bits_allocated": ("00280100", "int"), "bits_stored": ("00280101", "int"), "high_bit": ("00280102", "int"), "pixel_representation": ("00280103", "int"),
    },
    "image_plane": {"pixel_spacing": ("00280030", "array<double>"), "image_orientation": ("00200037", "array<double>"), "image_position": ("00200032", "array<double>"), "slice_thickness": ("00180050", "double"), "slice_location": ("00201041", "double")},
    "multi_frame": {"number_of_frames": ("00280008", "int"), "frame_increment_pointer": ("00280009", "string")},
    "cine": {
        "frame_time": ("00181063", "double"), "frame_time_vector": ("00181065", "array<double>"), "start_trim": ("00082142", "int"), "stop_trim": ("00082143", "int"), "display_frame_rate": ("00082144", "double"),
        "cine_rate": ("00180040", "double"), "frame_delay": ("00181066", "double"), "number_of_frames": ("00280008", "int"),
    },
    "modality_lut": {"rescale_intercept": ("00281052", "double"), "rescale_slope": ("00281053", "double"), "rescale_type": ("00281054", "string")},
    "voi_lut": {"window_center": ("00281050", "array<double>"), "window_width": ("00281051", "array<double>"), "voi_function": ("00281056", "string")},
    "presentation": {"presentation_lut_shape": ("20500020", "string")},
    "overlay": {"overlay_rows": ("60000010", "int"), "overlay_columns": ("60000011", "int"), "overlay_type": ("60000040", "string"), "overlay_origin": ("60000050", "array<int>"), "overlay_bit_position": ("60000102", "int")},
    "palette": {"red_descriptor": ("00281101", "array<int>"), "green_descriptor": ("00281102", "array<int>"), "blue_descriptor": ("00281103", "array<int>")},
}


def _typed(values: Column, kind: str) -> Column:
    if kind.startswith("array"):
        item = kind[6:-1]
        return F.transform(F.from_json(values, "array<string>"), lambda v: v.try_cast(item))
    return F.get(F.from_json(values, "array<string>"), F.lit(0)).try_cast(kind)


def module(elements: DataFrame, name: str | dict[str, tuple[str, str]]) -> DataFrame:
    """A module as typed columns; absent and unreadable values are null, of many the first counts unless the column is an array.

    Instead of a name it may be a module of one's own: column to (tag, Spark type).
    """
    fields = MODULES[name] if isinstance(name, str) else name
    wide = E.pivot(elements, {n: tag for n, (tag, _) in fields.items()})
    return wide.select("file", *[_typed(F.col(n), kind).alias(n) for n, (_, kind) in fields.items()])


# Fixed values of the standard: elements of the items of a waveform's groups, by name and Spark type.
WAVEFORM_GROUP = {
    "originality": ("003A0004", "string"), "n_channels": ("003A0005", "int"), "n_samples": ("003A0010", "bigint"), "sampling_frequency": ("003A001A", "double"), "group_label": ("003A0020", "string"),
    "bits_allocated": ("54001004", "int"), "interpretation": ("54001006", "string"),
}


def sequence_items(elements: DataFrame, sequence: str, fields: dict[str, tuple[str, str]] = WAVEFORM_GROUP) -> DataFrame:
    """(file, item_ix, fields…): the items of a root sequence as rows of typed columns, those without any of the fields left out."""
    step = F.get("path", F.lit(0))
    wanted = elements.where((F.size("path") == 1) & (step["tag"] == sequence) & F.col("tag").isin([t for t, _ in fields.values()]))
    wide = wanted.groupBy("file", step["item"].alias("item_ix")).agg(*[F.min(F.when(F.col("tag") == tag, F.col("values_json"))).alias(n) for n, (tag, _) in fields.items()])
    return wide.select("file", "item_ix", *[_typed(F.col(n), kind).alias(n) for n, (_, kind) in fields.items()])


def first_required(column: str) -> Column:
    """A value that must be there: raises where it is null."""
    return F.when(F.col(column).isNull(), F.raise_error(F.lit(f"{column} is missing"))).otherwise(F.col(column))


def frame_times(cine: DataFrame, default_rate: float = 1.0) -> DataFrame:
    """(file, frame_index, duration_ms, at_ms, trimmed) of every frame.

    The vector of frame times counts first, then the frame time, the recommended rate, the cine rate and the default; frames outside
    the trim are marked.
    """
    n = F.greatest(F.coalesce("number_of_frames", F.lit(1)), F.lit(0))
    each = cine.where(n > 0).select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("frame_index"))
    rate = lambda c: F.when(F.col(c) > 0, 1000 / F.col(c))
    vector = F.get("frame_time_vector", F.col("frame_index"))
    duration = F.coalesce(vector, F.when(F.col("frame_time") > 0, F.col("frame_time")), rate("display_frame_rate"), rate("cine_rate"), F.lit(1000 / default_rate))
    inside = (F.col("frame_index") + 1).between(F.coalesce("start_trim", F.lit(1)), F.coalesce("stop_trim", n))
    order = Window.partitionBy("file").orderBy("frame_index").rowsBetween(Window.unboundedPreceding, -1)
    timed = each.withColumns({"duration_ms": duration, "trimmed": ~inside})
    return timed.select("file", "frame_index", "duration_ms", (F.coalesce("frame_delay", F.lit(0.0)) + F.coalesce(F.sum("duration_ms").over(order), F.lit(0.0))).alias("at_ms"), "trimmed")
