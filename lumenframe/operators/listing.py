"""Listing of archives: path filters, summaries, hierarchy indexes and names of exported files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.operators.numbering import numbered


def has_extension(path: Column, extension: str) -> Column:
    """Case does not count; the extension of dotless names is empty."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1)) == extension.lower().lstrip(".")


def glob_pattern(glob: str) -> str:
    """A glob (* within a folder, ** across, ?, [a-z], {a,b}) as a regular expression over lower-cased paths."""
    out, i, glob = [], 0, glob.lower()
    depth = 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 2
        elif glob.startswith("**", i):
            out.append(".*")
            i += 1
        elif c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 1)
            body = glob[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[:1] == "!" else body) + "]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def list_files(files: DataFrame, extension: str | None = None, ignore: list[str] | None = None) -> DataFrame:
    """Files by extension, without those whose path matches an ignored glob."""
    found = files if extension is None else files.where(has_extension(F.col("path"), extension))
    for glob in ignore or []:
        found = found.where(~F.lower("path").rlike(glob_pattern(glob)))
    return found


def cube(files: DataFrame, by: list[str], size: str) -> DataFrame:
    """(by…, level, n_files, n_bytes) at every combination of the columns; ``level`` has a bit for each column that is summed up."""
    return files.cube(*by).agg(F.grouping_id().alias("level"), F.count("*").alias("n_files"), F.sum(size).alias("n_bytes"))


def summary(files: DataFrame, by: Column, size: Column) -> DataFrame:
    """(class, n_files, n_bytes, file_share, byte_share) per class, most files first."""
    counted = files.groupBy(by.alias("class")).agg(F.count("*").alias("n_files"), F.sum(F.coalesce(size, F.lit(0))).cast("bigint").alias("n_bytes"))
    whole = Window.partitionBy()
    share = lambda c: F.round(F.col(c) * 100.0 / F.sum(c).over(whole), 6)
    return counted.withColumns({"file_share": share("n_files"), "byte_share": share("n_bytes")}).orderBy(F.desc("n_files"), "class")


def totals(files: DataFrame, size: str, study: str, path: str) -> DataFrame:
    """One row: count, bytes, integer mean, largest file (ties by path) and exact number of studies."""
    largest = F.max_by(path, F.struct(F.col(size), F.col(path)))
    return files.agg(
        F.count("*").alias("n_files"),
        F.coalesce(F.sum(size), F.lit(0)).alias("n_bytes"),
        F.coalesce(F.expr(f"sum({size}) div count(*)"), F.lit(0)).alias("mean_bytes"),
        largest.alias("largest_path"),
        F.max(size).alias("largest_bytes"),
        F.countDistinct(study).alias("n_studies"),
    )


def hierarchy_records(instances: DataFrame, levels: list[tuple[str, str]]) -> DataFrame:
    """Directory records of a hierarchy: (level, key, record_ix, parent_key, next_key, child_key).

    ``levels`` are (name, column) from the top; keys are joined by /; children are ordered by key.
    """
    rows = None
    for i, (name, _) in enumerate(levels):
        columns = [c for _, c in levels[: i + 1]]
        key = F.concat_ws("/", *[F.col(c).cast("string") for c in columns])
        parent = F.concat_ws("/", *[F.col(c).cast("string") for c in columns[:-1]]) if i else F.lit("")
        level = instances.dropna(subset=columns).select(F.lit(i).alias("depth"), F.lit(name).alias("level"), key.alias("key"), parent.alias("parent_key")).distinct()
        rows = level if rows is None else rows.unionByName(level)
    siblings = Window.partitionBy("depth", "parent_key").orderBy("key")
    linked = rows.withColumn("next_key", F.lead("key").over(siblings))
    first = rows.where("depth > 0").groupBy(F.col("parent_key").alias("key"), (F.col("depth") - 1).alias("depth")).agg(F.min("key").alias("child_key"))
    return linked.join(first, ["key", "depth"], "left").select("level", "key", F.nullif("parent_key", F.lit("")).alias("parent_key"), "next_key", "child_key")


def first_seen(df: DataFrame, key: str, order: list[str], name: str, within: list[str] | None = None) -> DataFrame:
    """(within…, key, name, _at): the number of each key by the order in which keys first appear, from 0, and where it does.

    Only one row per key is numbered, by ranges of the whole order where nothing is numbered within.
    """
    held = df.groupBy(*(within or []), key).agg(F.min(F.struct(*order)).alias("_at"))
    if not within:
        return numbered(held, ["_at", key], name)
    return held.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy("_at", key)) - 1)


def archive_names(instances: DataFrame, patient: str, study: str, series: str, order: list[str], layout: str = "series", upper: bool = True) -> DataFrame:
    """Names PA…/ST…/SE…/IM… of exported files, numbered by first appearance within their folder.

    First places are aggregated per series, and patients, studies and series are numbered from these small tables; only the files of
    one series are numbered together.  ``layout`` is ``series``, ``study`` (files lie in the folder of their study) or ``flat`` (all in one).
    Files without one of the keys get no name and are left out.
    """
    rows = instances.dropna(subset=[patient, study, series])
    width = lambda c, p: F.concat(F.lit(p if upper else p.lower()), F.lpad(F.col(c).cast("string"), 6, "0"))
    if layout == "flat":
        return numbered(rows, order, "_im").withColumn("name", width("_im", "IM")).drop("_im")
    at_series = rows.groupBy(patient, study, series).agg(F.min(F.struct(*order)).alias("_first"))
    patients = first_seen(at_series, patient, ["_first"], "_pa").select(patient, "_pa")
    studies = first_seen(at_series, study, ["_first"], "_st", [patient]).select(patient, study, "_st")
    folders = first_seen(at_series, series, ["_first"], "_se", [patient, study]).select(patient, study, series, "_se")
    folders = folders.join(studies, [patient, study]).join(patients, patient)
    keys = [patient, study] if layout == "study" else [patient, study, series]
    parts = [("_pa", "PA"), ("_st", "ST"), *([] if layout == "study" else [("_se", "SE")]), ("_im", "IM")]
    df = rows.withColumn("_im", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).join(folders, [patient, study, series])
    return df.withColumn("name", F.concat_ws("/", *[width(c, p) for c, p in parts])).select(*instances.columns, "name")


def selected_frames(frames: DataFrame, selection: str, index: str = "frame_index", count: str = "n_frames") -> DataFrame:
    """Frames of a selection such as ``0,2,-1``, ``1..3``, ``-2..`` (inclusive, negative from the end, open end)."""
    verdict = F.lit(False)
    at, n = F.col(index), F.col(count)
    place = lambda i: F.lit(i) if i >= 0 else n + i
    for part in selection.split(","):
        part = part.strip()
        found = re.fullmatch(r"(-?\d+)(?:(\.\.)(-?\d+)?)?", part)
        if not found:
            raise ValueError(f"not a frame selection: {part!r}")
        low = int(found[1])
        if not found[2]:
            verdict = verdict | (at == place(low))
        else:
            high = at >= place(low)
            verdict = verdict | (high if found[3] is None else high & (at <= place(int(found[3]))))
    return frames.where(verdict)
