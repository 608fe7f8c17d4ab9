"""Command line: ``python -m lumenframe.cli COMMAND INPUT… [OUTPUT]`` over files, folders, globs and any file system that Spark reads.

Commands: list, print, modify, rewrite, dcm-to-json, json-to-dcm, get-pixel-data, archive.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenframe.functions import printing
from lumenframe.operators import archive, elements, listing, pixels
from lumenframe.session import session
from lumenframe.sources import datasource, dicom_json, p10

LISTED = {"sop_class": "00080016", "instance": "00080018", "study": "0020000D", "series": "0020000E", "patient": "00100020", "patient_name": "00100010", "study_date": "00080020", "modality": "00080060", "syntax": "00020010"}


WRITING = ("modify", "rewrite", "dcm-to-json", "json-to-dcm", "get-pixel-data", "archive")


def _read(spark: SparkSession, paths: list[str], tags: list[str] | None = None, extension: str | None = None) -> DataFrame:
    """Elements of local files by the data source, those of other file systems through Spark's own reader of bytes."""
    remote = [p for p in paths if "://" in p and not p.startswith("file://")]
    local = [p for p in paths if p not in remote]
    found = None
    if local:
        reader = spark.read.format("dicom").option("path", "\n".join(local))
        reader = reader.option("extension", extension) if extension else reader
        found = (reader.option("tags", ",".join(tags)) if tags else reader).load()
    if remote:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        more = datasource.parsed((reader.option("pathGlobFilter", f"*.{extension}") if extension else reader).load(remote), **({"tags": ",".join(tags)} if tags else {}))
        found = more if found is None else found.unionByName(more)
    return found


def _base(paths: list[str]) -> str | None:
    """The folder that output names are relative to: the only input, or the one above all inputs."""
    if len(paths) == 1 and not os.path.isdir(paths[0]):
        return os.path.dirname(datasource.split_glob(paths[0])[0] + "/x") if datasource.split_glob(paths[0])[1] else None
    return os.path.commonpath([os.path.abspath(datasource.split_glob(p)[0] if os.path.isdir(datasource.split_glob(p)[0]) else os.path.dirname(p)) for p in paths])


def _whole(spark: SparkSession, paths: list[str], tags: list[str] | None = None) -> DataFrame:
    """Elements of the files that can be read to their end; the others are named on standard error."""
    rows = _read(spark, paths, tags)
    for r in rows.where("error is not null").select("file", "error").toLocalIterator():
        print(f"{r.file}: {r.error}", file=sys.stderr)
    return dicom_json.whole(rows)


def _first(column: str) -> F.Column:  # type: ignore[name-defined]
    return F.get(F.from_json(column, "array<string>"), F.lit(0))


def _wide(spark: SparkSession, paths: list[str]) -> DataFrame:
    wide = elements.pivot(_read(spark, paths, list(LISTED.values())).where("error is null"), LISTED)
    named = F.coalesce(F.get_json_object("patient_name", "$[0].Alphabetic"), F.lit(""))
    return wide.select("file", *[(named if n == "patient_name" else _first(n)).alias(n) for n in LISTED])


def run(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lumenframe")
    parser.add_argument("command", choices=["list", "print", "modify", "rewrite", "dcm-to-json", "json-to-dcm", "get-pixel-data", "archive"])
    parser.add_argument("paths", nargs="*", help="inputs, and for commands that write their output last")
    parser.add_argument("--file-list", help="file with one input a line, - for standard input")
    parser.add_argument("--select", action="append", default=[], help="tag that a listed file must have")
    parser.add_argument("--summarize", action="store_true")
    parser.add_argument("--extension")
    parser.add_argument("--ignore", action="append", default=[])
    parser.add_argument("--delete", action="append", default=[])
    parser.add_argument("--delete-private", action="store_true")
    parser.add_argument("--anonymize", action="store_true")
    parser.add_argument("--merge-json")
    parser.add_argument("--transfer-syntax", default=p10.EXPLICIT)
    parser.add_argument("--width", type=int, default=100)
    parser.add_argument("--pretty", action="store_true")
    parser.add_argument("--select-frames", default="0..")
    parser.add_argument("--crop")
    parser.add_argument("--orientation", default="identity")
    parser.add_argument("--format", choices=["png", "raw", "parquet"], default="png")
    parser.add_argument("--overlays", action="store_true")
    parser.add_argument("--colours", help="palette of the standard for grey images")
    args = parser.parse_args(argv)
    args.output = args.paths.pop() if args.command in WRITING and args.paths else None
    args.inputs = datasource.inputs(args.paths, args.file_list)
    if not args.inputs or args.command in WRITING and not args.output:
        parser.error("inputs and, for commands that write, an output are needed")
    spark = spark or session("local[*]")
    datasource.register(spark)
    if args.command == "list":
        _list(spark, args)
    elif args.command == "print":
        for path, _, _ in datasource.walk("\n".join(args.inputs)):
            with open(path, "rb") as f:
                print("\n".join(printing.lines(p10.Walker(f).elements(), args.width)))
    elif args.command in ("modify", "rewrite"):
        rows = _whole(spark, args.inputs)
        if args.merge_json:
            with open(args.merge_json) as f:
                new = list(dicom_json.rows("", dicom_json.read(f.read())))
            rows = elements.insert(rows, spark.createDataFrame(new, dicom_json.DDL).drop("file", "ordinal"))
        # Merged elements are themselves subject to what follows.
        if args.delete:
            rows = elements.delete_tags(rows, args.delete)
        if args.delete_private:
            rows = elements.delete_private(rows)
        if args.anonymize:
            rows = elements.anonymize(rows)
        datasource.save(rows, args.output, args.transfer_syntax, _base(args.inputs))
    elif args.command == "dcm-to-json":
        texts = dicom_json.elements_to_json(_whole(spark, args.inputs))
        texts.select("text").write.mode("overwrite").text(args.output)
    elif args.command == "json-to-dcm":
        texts = spark.read.option("recursiveFileLookup", "true").text(args.inputs, wholetext=True).select(F.regexp_replace(F.input_file_name(), "^file:/*", "/").alias("file"), F.col("value").alias("text"))
        datasource.save(dicom_json.whole(dicom_json.json_to_elements(texts)), args.output, args.transfer_syntax)
    elif args.command == "get-pixel-data":
        crop = tuple(int(x) for x in args.crop.split(",")) if args.crop else None
        options = {"crop": crop, "orientation": args.orientation, "overlays": args.overlays, "colours": args.colours}
        rows = _read(spark, args.inputs, pixels.TAGS).where("error is null")
        images = pixels.rendered(rows, together=True, **options) if args.format == "parquet" else pixels.image_files(rows, args.format, together=True, **options)
        counted = images.withColumn("n_frames", F.count("*").over(Window.partitionBy("file")))
        chosen = listing.selected_frames(counted, args.select_frames).drop("n_frames")
        if args.format == "parquet":
            chosen.write.mode("overwrite").parquet(args.output)
        else:
            print(pixels.write_files(chosen, args.output, _base(args.inputs)))
    else:
        _archive(spark, args)


def _list(spark: SparkSession, args: argparse.Namespace) -> None:
    wide = _wide(spark, args.inputs)
    # Spark lists the files with their sizes; a glob has its own pattern above.
    folders = [datasource.split_glob(p)[0] for p in args.inputs]
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folders).select(F.regexp_replace("path", "^file:/*", "/").alias("file"), "length")
    files = listing.list_files(wide.join(listed, "file").withColumn("path", F.col("file")), args.extension, args.ignore)
    if args.summarize:
        listing.summary(files, F.coalesce("syntax", F.lit(p10.IMPLICIT)), F.col("length")).show(100, False)
        listing.totals(files, "length", "study", "path").show(1, False)
        return
    tags = {t.lower(): t.upper() for t in args.select}
    shown = files.select("path", "length")
    if tags:
        chosen = elements.pivot(_read(spark, args.inputs, list(tags.values())).where("error is null"), tags).withColumnRenamed("file", "path")
        shown = shown.join(chosen, "path", "left")
    for row in shown.orderBy("path").toLocalIterator():
        print(json.dumps(row.asDict(), ensure_ascii=False))


def _archive(spark: SparkSession, args: argparse.Namespace) -> None:
    wide = _wide(spark, args.inputs).where("instance is not null").fillna("")
    named = listing.archive_names(wide, "patient", "study", "series", ["file"]).withColumn("file_id", F.col("name"))
    index = archive.dicomdirs(named.withColumn("file_set_id", F.lit(os.path.basename(args.output)[:16]))).select(F.lit("DICOMDIR").alias("name"), "content")
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([datasource.split_glob(p)[0] for p in args.inputs])
    files = named.join(content.select(F.regexp_replace("path", "^file:/*", "/").alias("file"), "content"), "file").select("name", "content")
    print(archive.write_zip(index.unionByName(files), args.output))


if __name__ == "__main__":
    run()
