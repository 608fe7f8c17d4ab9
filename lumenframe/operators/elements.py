"""Operators on the long table of data elements: one row per element, addressed by file, path and tag.

Canonical columns: file, path ``array<struct<tag,item>>``, tag (eight hexadecimal digits), vr, and value columns that
are carried along.  A rejected sequence takes its whole subtree with it; that closure is an equi anti-join on
exploded path prefixes, never a nested loop.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from lumenframe.functions import scalars as S

# The public elements that identify people, institutions, places or instances; removed from files that leave.
IDENTIFYING = [
    "00080014", "00080050", "00080080", "00080081", "00080082", "00080090", "00080092", "00080094", "00080096", "00080201",
    "00080420", "00080421", "00081000", "00081010", "00081030", "00081032", "0008103E", "0008103F", "00081040", "00081041",
    "00081048", "00081049", "00081050", "00081052", "00081060", "00081062", "00081070", "00081072", "00081080", "00081084",
    "00181030", "00200010", "00321033", "00400009", "00400275", "00401102", "00401103", "00401104", "0040A124", "00880140",
    "30060024",
]


def path_key(path: Column, tag: Column) -> Column:
    return S.path_text(path, tag)


def _ancestors() -> Column:
    """Keys of the sequences that an element lies in."""
    n = F.size("path")
    steps = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda i: S.path_text(F.slice("path", F.lit(1), i), F.get("path", i)["tag"]))


def keep(elements: DataFrame, predicate: Column) -> DataFrame:
    """Elements that the predicate accepts and that lie in no rejected sequence; a null verdict rejects.

    Only nested elements take part in the join, so that flat data sets are filtered without a shuffle.
    """
    fine = F.coalesce(predicate, F.lit(False))
    rejected = elements.where(~fine & (F.col("vr") == "SQ")).select("file", path_key(F.col("path"), F.col("tag")).alias("_above")).distinct()
    accepted = elements.where(fine)
    flat = accepted.where(F.size("path") == 0)
    nested = accepted.where(F.size("path") > 0).withColumn("_at", S.path_text(F.col("path")))
    lost = nested.select("file", "_at", F.explode(_ancestors()).alias("_above")).distinct().join(rejected, ["file", "_above"], "left_semi").select("file", "_at").distinct()
    return flat.unionByName(nested.join(lost, ["file", "_at"], "left_anti").select(*elements.columns))


def delete_tags(elements: DataFrame, tags: list[str]) -> DataFrame:
    """Without the tags, at any depth, and what lies in them."""
    return keep(elements, ~F.col("tag").isin([t.upper() for t in tags]))


def delete_private(elements: DataFrame) -> DataFrame:
    return keep(elements, ~S.is_private(S.tag_int(F.col("tag"))))


def anonymous(tag: Column, vr: Column) -> Column:
    """Whether an element may stay: no AE, no private group, no patient group, none of the identifying elements."""
    number = S.tag_int(tag)
    return (F.coalesce(vr, F.lit("UN")) != "AE") & ~S.is_private(number) & (S.tag_group(number) != 0x10) & ~F.upper(tag).isin(IDENTIFYING)


def anonymize(elements: DataFrame, recursive: bool = True) -> DataFrame:
    """Identifying elements removed, at every depth or, like a filter of the outer data set, at the root only."""
    verdict = anonymous(F.col("tag"), F.col("vr"))
    return keep(elements, verdict if recursive else (F.size("path") > 0) | verdict)


def insert(elements: DataFrame, new: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Root elements of ``new`` (file or for all files: tag, vr, …) replace those of the same tag, with what lay in them.

    ``new`` may hold nested elements with their ``path``.  Without a column ``file`` it is one data set for all files, a table by
    itself small enough to lie in one array; its rows are exploded for each file.
    """
    path_type = elements.schema["path"].dataType
    if "path" not in new.columns:
        new = new.withColumn("path", F.array().cast(path_type))
    if "file" not in new.columns:
        targets = (elements if files is None else files).select("file").distinct()
        one = new.agg(F.collect_list(F.struct(*new.columns)).alias("_rows"))
        new = targets.join(one, how="cross").select("file", F.inline("_rows"))
    root = F.when(F.size("path") > 0, F.get("path", F.lit(0))["tag"]).otherwise(F.col("tag"))
    keys = new.select("file", root.alias("_root")).distinct()
    kept = elements.withColumn("_root", root).join(keys, ["file", "_root"], "left_anti").select(*elements.columns)
    return kept.unionByName(new.select(*[c for c in new.columns if c in elements.columns]), allowMissingColumns=True)


def insert_module(elements: DataFrame, values: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """A module written into data sets: ``values`` has one row per file, ``columns`` maps its columns to (tag, vr).

    Null columns leave what is there; arrays are multiple values.  The counterpart of ``pivot``.
    """
    kinds = dict(values.dtypes)
    each = []
    for name, (tag, vr) in columns.items():
        held = F.col(name) if kinds[name].startswith("array") else F.array(F.col(name))
        if vr == "PN":
            held = F.transform(held, lambda v: F.struct(v.alias("Alphabetic")))
        each.append(F.when(F.col(name).isNotNull(), F.struct(F.lit(tag).alias("tag"), F.lit(vr).alias("vr"), F.to_json(held).alias("values_json"))))
    return insert(elements, values.select("file", F.inline(F.array_compact(F.array(*each)))))


def merge(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Full outer join in which the right side wins, column by column of a row that it has."""
    names = [c for c in left.columns if c not in key]
    a = left.select(*key, F.struct(*names).alias("_a"))
    b = right.select(*key, F.struct(*names).alias("_b"))
    return a.join(b, key, "full_outer").select(*key, F.coalesce("_b", "_a").alias("_v")).select(*key, *[F.col(f"_v.{c}").alias(c) for c in names])


def pivot(elements: DataFrame, columns: dict[str, str], value: str = "values_json") -> DataFrame:
    """One row per file with a column per root tag; absent tags are null, of repeated ones the smallest value counts."""
    wanted = elements.where((F.size("path") == 0) & F.col("tag").isin(list(columns.values())))
    return wanted.groupBy("file").agg(*[F.min(F.when(F.col("tag") == tag, F.col(value))).alias(name) for name, tag in columns.items()])


def derived(elements: DataFrame, tags: dict[str, str], make: Callable[[dict[str, list]], dict], ddl: str) -> DataFrame:
    """A type of one's own: ``make`` gets the values of the named root tags of each file as lists and returns the columns in ``ddl``.

    Files for which it raises ValueError, KeyError, TypeError or IndexError have nulls and the reason in ``error``.
    """
    wide, names = pivot(elements, tags), list(tags)
    fields = [f.name for f in wide.sparkSession.createDataFrame([], ddl).schema]
    out = "file string, " + ddl + ", error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                try:
                    found = make({n: json.loads(r[n]) if r[n] else [] for n in names})
                    rows.append({"file": r["file"], **{f: found.get(f) for f in fields}, "error": None})
                except (ValueError, KeyError, TypeError, IndexError) as e:
                    rows.append({"file": r["file"], **dict.fromkeys(fields), "error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    kinds = to_arrow_schema(wide.sparkSession.createDataFrame([], out).schema)
    return wide.mapInArrow(run, out)


def select(files: DataFrame, elements: DataFrame, required: dict[str, str], optional: dict[str, str]) -> DataFrame:
    """Files with the selected tags as columns; ``missing`` names the required ones that a file lacks."""
    wide = files.join(pivot(elements, required | optional), "file", "left")
    absent = F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(t)) for n, t in required.items()])) if required else F.array().cast("array<string>")
    return wide.withColumn("missing", absent)


def presence(elements: DataFrame, tags: list[str]) -> DataFrame:
    """(file, tag, present, has_value) of the root tags that are asked for, for every file."""
    asked = F.explode(F.array(*[F.lit(t.upper()) for t in tags])).alias("tag")
    root = elements.where((F.size("path") == 0) & F.col("tag").isin([t.upper() for t in tags]))
    filled = F.col("values_json").isNotNull() | F.col("inline_binary").isNotNull()
    found = root.groupBy("file", "tag").agg(F.bool_or(filled).alias("_filled"))
    every = elements.select("file").distinct().select("file", asked)
    return every.join(found, ["file", "tag"], "left").select("file", "tag", F.col("_filled").isNotNull().alias("present"), F.coalesce("_filled", F.lit(False)).alias("has_value"))


def value_at(elements: DataFrame, path: str) -> DataFrame:
    """The elements at one path TAG/[i]/TAG, per file."""
    return elements.where(path_key(F.col("path"), F.col("tag")) == path.upper())


def private_blocks(elements: DataFrame) -> DataFrame:
    """Private elements with the creator that reserves their block in the same data set, null if none does."""
    number = S.tag_int(F.col("tag"))
    named = elements.withColumns({"_at": S.path_text(F.col("path")), "_creator": S.private_creator_tag(number)})
    creators = named.where(S.is_private_creator(number)).select("file", "_at", number.alias("_creator"), F.get(F.from_json("values_json", "array<string>"), F.lit(0)).alias("private_creator"))
    one = creators.groupBy("file", "_at", "_creator").agg(F.min("private_creator").alias("private_creator"))
    return named.where(F.col("_creator").isNotNull()).join(one, ["file", "_at", "_creator"], "left").drop("_at", "_creator")


def infer_vr(elements: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``vr`` completed from a dictionary (tag, vr, name); unknown tags are UN, creators LO, group lengths UL.

    Where the dictionary allows several, the pixel representation of the same data set, else of the file's root, says whether numbers
    are signed, and words stand for bytes or words.
    """
    number = S.tag_int(F.col("tag"))
    known = dictionary.groupBy("tag").agg(F.min("vr").alias("_vr"), F.min("name").alias("name"))
    implied = F.when(S.is_private_creator(number), "LO").when(S.tag_element(number) == 0, "UL").otherwise(F.coalesce("_vr", F.lit("UN")))
    df = elements.join(known, "tag", "left").withColumn("vr", F.coalesce("vr", implied)).drop("_vr")
    df = df.withColumn("vr", F.when(F.col("vr").isin("OB or OW", "US or OW", "US or SS or OW"), "OW").otherwise(F.col("vr")))
    clear, open_ = df.where(~F.col("vr").eqNullSafe("US or SS")), df.where("vr = 'US or SS'")
    told = elements.where("tag = '00280103'").select("file", S.path_text(F.col("path")).alias("_at"), F.get(F.from_json("values_json", "array<int>"), F.lit(0)).alias("_sign"))
    signs = told.groupBy("file").agg(F.map_from_entries(F.collect_set(F.struct("_at", F.coalesce("_sign", F.lit(0)).alias("_sign")))).alias("_signs"))
    found = open_.join(signs, "file", "left").withColumn("_own", F.coalesce(F.try_element_at("_signs", S.path_text(F.col("path"))), F.try_element_at("_signs", F.lit("")), F.lit(0)))
    return clear.unionByName(found.withColumn("vr", F.when(F.col("_own") == 1, "SS").otherwise("US")).drop("_signs", "_own"))


def order_violations(elements: DataFrame) -> DataFrame:
    """Elements that come after a greater tag of the same data set, in the order of ``element_id``."""
    before = Window.partitionBy("file", S.path_text(F.col("path"))).orderBy("element_id").rowsBetween(Window.unboundedPreceding, -1)
    return elements.withColumn("late", F.coalesce(F.max("tag").over(before) > F.col("tag"), F.lit(False)))


def file_meta(elements: DataFrame) -> DataFrame:
    """Group 2, completed by the media storage identifiers from the data set where they are missing."""
    root = elements.where(F.size("path") == 0)
    copied = root.where(F.col("tag").isin("00080016", "00080018")).withColumn("tag", F.when(F.col("tag") == "00080016", "00020002").otherwise("00020003"))
    own = root.where(F.col("tag").startswith("0002"))
    return own.unionByName(copied.join(own.select("file", "tag"), ["file", "tag"], "left_anti"))


def value_bytes(vr: Column, values_json: Column, inline_binary: Column) -> Column:
    """Octets of a value as a file holds it: numbers by their width, text with its separators, padded to an even number."""
    n = F.coalesce(F.json_array_length(values_json), F.lit(0))
    width = F.when(vr.isin("US", "SS"), 2).when(vr.isin("UL", "SL", "FL", "AT"), 4).when(vr.isin("FD", "UV", "SV"), 8)
    groups = F.transform(F.from_json(values_json, "array<struct<Alphabetic:string,Ideographic:string,Phonetic:string>>"), lambda p: F.rtrim(F.concat_ws("=", F.coalesce(p["Alphabetic"], F.lit("")), F.coalesce(p["Ideographic"], F.lit("")), F.coalesce(p["Phonetic"], F.lit(""))), F.lit("=")))
    strings = F.transform(F.from_json(values_json, "array<string>"), lambda v: F.coalesce(v, F.lit("")))
    text = F.octet_length(F.array_join(F.when(vr == "PN", groups).otherwise(strings), "\\"))
    size = F.coalesce(F.octet_length(inline_binary), F.when(vr == "SQ", 0), width * n, text, F.lit(0))
    return (size + size % 2).cast("bigint")


def byte_sizes(elements: DataFrame) -> DataFrame:
    """(file, n_elements, n_bytes): size of the values at all depths, eight bytes of header each."""
    size = value_bytes(F.col("vr"), F.col("values_json"), F.col("inline_binary"))
    return elements.groupBy("file").agg(F.count("*").alias("n_elements"), F.sum(size + 8).alias("n_bytes"))
