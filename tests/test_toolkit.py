"""Printing, archives, streams, elements on small hand-made cases, and the command line."""

import json
import os
import struct
import zipfile

from lumenframe import cli
from lumenframe.functions import printing
from lumenframe.operators import archive
from lumenframe.operators import elements as E
from lumenframe.operators import listing as L
from lumenframe.operators import modules
from lumenframe.sources import dicom_json, p10
from lumenframe.streaming import streams

DDL = "file string, path array<struct<tag:string,item:int>>, tag string, vr string, values_json string"


def test_print_has_columns_items_and_ellipsis():
    text = json.dumps({"00080060": {"vr": "CS", "Value": ["CT"]}, "00081030": {"vr": "LO", "Value": ["x" * 64]}, "00400275": {"vr": "SQ", "Value": [{"00400007": {"vr": "LO", "Value": ["y"]}}]}})
    got = list(printing.lines(dicom_json.read(text), 100))
    assert got[0] == '(0008,0060) CS Modality                             [     2 bytes] "CT" (Computed Tomography)'
    assert got[1].endswith(" …") and len(got[1]) <= 100
    assert got[3] == "  (FFFE,E000) Item" and got[-1] == "(FFFE,E0DD) Sequence Delimitation Item"


def test_dicomdir_offsets_point_at_records():
    rows = [dict(patient=p, patient_name="A^B", study=f"1.{s}", series=f"1.{s}.1", instance=f"1.{s}.1.{i}", file_id=f"PA/{p}/{s}/{i}") for p in ("p1", "p2") for s in (1, 2) for i in (1, 2)]
    data = archive.dicomdir(rows, "SET")
    got = p10.tree(p10.Walker(data).elements())
    number = lambda ds, t: struct.unpack("<I", ds[t][1])[0]
    records = got[archive.SEQUENCE][1]
    assert len(records) == 2 + 4 + 4 + 8

    def at(offset):
        assert data[offset : offset + 4] == b"\xfe\xff\x00\xe0"
        return p10.tree(p10.Walker([b"\0" * 128, b"DICM", p10.write([])[132:], data[offset + 8 :].split(b"\xfe\xff\x0d\xe0")[0]]).elements())

    first = number(got, archive.FIRST)
    assert at(first)[0x00041430][1].strip() == b"PATIENT"
    second = number(at(first), archive.NEXT)
    assert second == number(got, archive.LAST) and at(second)[0x00041430][1].strip() == b"PATIENT"
    study = at(number(at(first), archive.CHILD))
    assert study[0x00041430][1].strip() == b"STUDY" and at(number(study, archive.NEXT))[0x00041430][1].strip() == b"STUDY"
    assert archive.dicomdir([]) and number(p10.tree(p10.Walker(archive.dicomdir([])).elements()), archive.FIRST) == 0


def _rows(spark):
    sq, inner = [{"tag": "00400275", "item": 0}], [{"tag": "00400275", "item": 0}, {"tag": "00091010", "item": 1}]
    return spark.createDataFrame(
        [
            ("f", [], "00080060", "CS", '["CT"]'), ("f", [], "00090010", "LO", '["ACME"]'), ("f", [], "00091001", "LO", '["x"]'), ("f", [], "00092001", "LO", '["y"]'), ("f", [], "00400275", "SQ", None),
            ("f", sq, "00400007", "LO", '["s"]'), ("f", sq, "00091010", "SQ", None), ("f", inner, "00080060", "CS", '["MR"]'), ("g", [], "00080060", None, None), ("g", sq, "00400007", "LO", '["kept"]'),
        ],
        DDL,
    )


def test_rejected_sequences_take_their_items_with_them(spark):
    df = _rows(spark)
    left = lambda d: sorted((r.file, len(r.path), r.tag) for r in d.collect())
    assert left(E.delete_private(df)) == [("f", 0, "00080060"), ("f", 0, "00400275"), ("f", 1, "00400007"), ("g", 0, "00080060"), ("g", 1, "00400007")]
    assert left(E.delete_tags(df, ["00400275"])) == [("f", 0, "00080060"), ("f", 0, "00090010"), ("f", 0, "00091001"), ("f", 0, "00092001"), ("g", 0, "00080060"), ("g", 1, "00400007")]
    assert E.keep(df.limit(0), E.anonymous(df.tag, df.vr)).count() == 0
    once = E.anonymize(df)
    assert left(E.anonymize(once)) == left(once)


def test_identifying_elements_go_at_every_depth(spark):
    step = [("00081111", 0)]
    gone = ["00081030", "0008103E", "00080201", "00081000", "00081080", "00081084", "00081032", "00400009", "00401102", "00880140"]
    stay = ["00081120", "00081155", "00181000", "00200052", "00200200", "00321032", "00380010"]
    rows = [("f", path, tag, "LO", "x") for path in ([], step) for tag in gone + stay] + [("f", [], "00081111", "SQ", None), ("f", [], "00080054", "AE", "x"), ("f", [], "00100010", "PN", "x"), ("f", [], "00091001", "LO", "x")]
    df = spark.createDataFrame(rows, "file string, path array<struct<tag:string,item:int>>, tag string, vr string, values_json string")
    left = [(r.tag, len(r.path)) for r in E.anonymize(df).collect()]
    assert sorted(left) == sorted([(t, n) for t in stay for n in (0, 1)] + [("00081111", 0)]) and len(set(E.IDENTIFYING)) == 41
    assert {(r.tag, len(r.path)) for r in E.anonymize(df, recursive=False).collect()} == set(left) | {(t, 1) for t in gone}


def test_private_creators_are_found_by_block(spark):
    got = {r.tag: r.private_creator for r in E.private_blocks(_rows(spark)).where("size(path) = 0").collect()}
    assert got == {"00091001": "ACME", "00092001": None}


def test_insert_replaces_root_elements_only(spark):
    new = spark.createDataFrame([("00400275", "LO", '["n"]')], "tag string, vr string, values_json string")
    got = E.insert(_rows(spark), new)
    assert got.where("tag = '00400275'").count() == 2 and got.where("size(path) > 0").count() == 0


def test_vr_from_the_dictionary(spark):
    words = spark.createDataFrame([("00080060", "CS", "Modality")], "tag string, vr string, name string")
    got = {(r.tag, r.vr) for r in E.infer_vr(_rows(spark).withColumn("vr", E.F.lit(None).cast("string")), words).collect()}
    assert {("00080060", "CS"), ("00090010", "LO"), ("00091001", "UN")} <= got


def test_vr_by_context_and_presence(spark):
    rows = [("f", [], "00280103", None, "[1]"), ("f", [], "00280106", None, "[0]"), ("f", [("00400275", 0)], "00280106", None, None), ("g", [], "00280106", None, "[0]"), ("g", [], "7FE00010", None, None), (None, [], "00280106", None, None)]
    df = spark.createDataFrame(rows, DDL).withColumns({"name_clash": E.F.lit("x"), "inline_binary": E.F.lit(None).cast("binary")})
    words = spark.createDataFrame([("00280103", "US", "a"), ("00280106", "US or SS", "b"), ("7FE00010", "OB or OW", "c")], "tag string, vr string, name string")
    got = sorted((r.file or "", len(r.path), r.tag, r.vr) for r in E.infer_vr(df, words).collect())
    assert got == [("", 0, "00280106", "US"), ("f", 0, "00280103", "US"), ("f", 0, "00280106", "SS"), ("f", 1, "00280106", "SS"), ("g", 0, "00280106", "US"), ("g", 0, "7FE00010", "OW")]
    assert E.infer_vr(df.limit(0), words).count() == 0 and E.infer_vr(df, words.limit(0)).count() == 6
    seen = {(r.file, r.tag): (r.present, r.has_value) for r in E.presence(df.where("file is not null"), ["7fe00010", "00280103"]).collect()}
    assert seen == {("f", "7FE00010"): (False, False), ("f", "00280103"): (True, True), ("g", "7FE00010"): (True, False), ("g", "00280103"): (False, False)}
    assert E.presence(df.limit(0), ["00280103"]).count() == 0


def test_own_types_and_modules(spark):
    rows = [("f", [], "00280010", "US", "[3]"), ("g", [], "00280010", "US", None), ("h", [], "00280010", "US", '["x"]')]
    df = spark.createDataFrame(rows, DDL)
    got = {r.file: (r.twice, r.error) for r in E.derived(df, {"rows": "00280010"}, lambda v: {"twice": 2 * int(v["rows"][0])}, "twice bigint").collect()}
    assert got["f"] == (6, None) and got["g"] == (None, "IndexError: list index out of range") and got["h"][0] is None and got["h"][1].startswith("ValueError")
    assert E.derived(df.limit(0), {"rows": "00280010"}, lambda v: {}, "twice bigint").count() == 0
    own = {r.file: r.height for r in modules.module(df, {"height": ("00280010", "int")}).collect()}
    assert own == {"f": 3, "g": None, "h": None}
    values = spark.createDataFrame([("f", "Doe^J", [1, 2], None), ("new", None, None, "k")], "file string, name string, sizes array<int>, other string")
    out = E.insert_module(df, values, {"name": ("00100010", "PN"), "sizes": ("00280010", "US"), "other": ("00081030", "LO")})
    assert {(r.file, r.tag): r.values_json for r in out.collect()} == {("f", "00100010"): '[{"Alphabetic":"Doe^J"}]', ("f", "00280010"): "[1,2]", ("g", "00280010"): None, ("h", "00280010"): '["x"]', ("new", "00081030"): '["k"]'}
    sequence = spark.createDataFrame([([], "00400275", "SQ", None), ([("00400275", 0)], "00400007", "LO", '["s"]')], "path array<struct<tag:string,item:int>>, tag string, vr string, values_json string")
    assert E.insert(df, sequence).count() == 3 + 2 * 3 and E.insert(df.limit(0), sequence).count() == 0


def test_sizes_and_lengths_of_values(spark):
    from lumenframe.functions import scalars as S

    cases = [("US", "[1, 2, 3]", None, 6, True), ("FD", "[1.5]", None, 8, True), ("LO", '["ab", null, "c"]', None, 6, True), ("PN", '[{"Alphabetic": "a", "Phonetic": "é"}]', None, 6, True), ("SQ", None, None, 0, True), ("OW", None, b"abc", 4, True),
             ("DA", '["2024-01-01"]', None, 10, False), ("CS", '["ABCDEFGHIJKLMNOPQ"]', None, 18, False), ("UT", None, None, 0, True), ("??", '["x"]', None, 2, None), (None, None, None, 0, None)]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, vr string, values_json string, inline_binary binary")
    size = E.value_bytes(E.F.col("vr"), E.F.col("values_json"), E.F.col("inline_binary"))
    longest = E.F.array_max(E.F.transform(E.F.from_json("values_json", "array<string>"), E.F.length))
    got = {r.i: (r.n, r.fits) for r in df.select("i", size.alias("n"), S.length_fits(E.F.col("vr"), size, longest).alias("fits")).collect()}
    assert got == {i: c[3:] for i, c in enumerate(cases)}


def test_getters_by_type(spark):
    from lumenframe.functions import getters as G

    cases = [("IS", "[3]", None), ("IS", "[3, 4]", None), ("US", '["x"]', None), ("UV", '["18446744073709551615"]', None), ("DS", "[1.5, null]", None), ("AT", '["00280010"]', None), ("PN", None, None), ("TM", '["1200"]', None), ("DT", '["2024"]', None),
             ("OW", None, b"ab"), ("US", "[0, 5, 16]", None), (None, "[1]", None), ("LO", "{broken", None)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, vr string, values_json string, inline_binary binary")
    r = df.select("i", G.int_().alias("int"), G.ints().alias("ints"), G.big_int().alias("big"), G.floats().alias("floats"), G.attribute_tag().alias("at"), G.person_names().alias("pn"), G.time().alias("tm"), G.date_time().alias("dt"), G.bytes_().alias("raw"), G.lut_descriptor().alias("lut"), G.strings().alias("text")).orderBy("i").collect()
    assert (r[0].int, r[1].int, r[1].ints, r[2].ints, int(r[3].big), r[4].floats, r[5]["at"]) == (3, None, [3, 4], None, 2**64 - 1, [1.5], 0x00280010)
    assert r[6].pn == [] and (r[7].tm.hour, r[8].dt.year, bytes(r[9].raw)) == (12, 2024, b"ab") and tuple(r[10].lut) == (65_536, 5, 16)
    assert (r[11].ints, r[11].text, r[0].text, r[12].text) == (None, None, None, [])


def test_numbers_by_first_appearance(spark):
    rows = [("p1", "s1", "a", 5), ("p2", "s9", "b", 1), ("p1", "s2", "a", 3), ("p1", "s1", "c", 6), (None, "s1", "a", 0)]
    df = spark.createDataFrame(rows, "patient string, study string, series string, at int")
    names = lambda **more: {r.at: r.name for r in L.archive_names(df, "patient", "study", "series", ["at"], **more).collect()}
    assert names() == {1: "PA000000/ST000000/SE000000/IM000000", 3: "PA000001/ST000000/SE000000/IM000000", 5: "PA000001/ST000001/SE000000/IM000000", 6: "PA000001/ST000001/SE000001/IM000000"}
    assert names(layout="flat", upper=False) == {1: "im000000", 3: "im000001", 5: "im000002", 6: "im000003"} and names(layout="study")[6] == "PA000001/ST000001/IM000001"
    assert L.archive_names(df.limit(0), "patient", "study", "series", ["at"]).count() == 0


def test_frame_selection(spark):
    frames = spark.range(5).selectExpr("cast(id as int) frame_index", "5 n_frames")
    pick = lambda s: [r.frame_index for r in L.selected_frames(frames, s).orderBy("frame_index").collect()]
    assert pick("0,-1") == [0, 4] and pick("1..-2") == [1, 2, 3] and pick("-2..") == [3, 4] and pick("9") == []


def test_globs():
    import re

    assert re.match(L.glob_pattern("**/*.DCM"), "/a/b/c.dcm") and not re.match(L.glob_pattern("*.dcm"), "a/b.dcm")
    assert re.match(L.glob_pattern("/x/[ab]?/{c,d}.dcm"), "/x/a1/d.dcm")


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, f"2024-01-0{1 + i % 3} 0{i % 7}:30:00", i % 3, "view" if i % 2 else "click", float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id bigint, ts string, user_id int, event_type string, value double").withColumn("ts", E.F.col("ts").cast("timestamp"))
    df.repartition(6).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))
    for name, make in (("tumbling", streams.tumbling), ("sliding", streams.sliding), ("sessions", streams.sessions)):
        q = make(stream, lateness="30 days").writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, make(df).collect())), name


def test_modules_come_out_once_complete(spark, tmp_path):
    a = [("a", [], "00080060", "CS", '["CT"]'), ("a", [], "00100010", "PN", '["x"]'), ("b", [], "00080060", "CS", '["MR"]')]
    b = [("a", [], "00200010", "SH", '["late"]'), ("b", [], "00080070", "LO", '["y"]')]
    for i, rows in enumerate((a, b)):
        spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(str(tmp_path / "m"))
    stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "m"))
    q = streams.modules(stream, {"modality": "00080060", "patient": "00100010"}).writeStream.format("memory").queryName("mods").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("mods").collect()] == [("a", '["CT"]', '["x"]')]


def test_quiet_files_are_given_out(spark, tmp_path):
    import time

    rows = [("a", [], "00080060", "CS", '["CT"]'), ("b", [], "00080060", "CS", '["MR"]'), ("b", [], "00080070", "LO", '["y"]')]
    spark.createDataFrame(rows, DDL).coalesce(1).write.parquet(str(tmp_path / "m"))
    stream = spark.readStream.schema(DDL).parquet(str(tmp_path / "m"))
    made = streams.modules(stream, {"modality": "00080060"}, quiet_minutes=0.02)
    q = made.writeStream.format("memory").queryName("quiet").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    end = time.monotonic() + 60
    while spark.table("quiet").count() < 2 and time.monotonic() < end:
        time.sleep(1)
    q.stop()
    assert sorted(tuple(r) for r in spark.table("quiet").collect()) == [("a", '["CT"]'), ("b", '["MR"]')]


def test_command_line(spark, tmp_path, capsys):
    text = json.dumps({"00080018": {"vr": "UI", "Value": ["1.2.3"]}, "00080060": {"vr": "CS", "Value": ["CT"]}, "0020000D": {"vr": "UI", "Value": ["1.2"]}, "0020000E": {"vr": "UI", "Value": ["1.2.1"]}, "00100020": {"vr": "LO", "Value": ["P1"]}})
    os.makedirs(tmp_path / "in")
    for i in range(2):
        (tmp_path / "in" / f"{i}.dcm").write_bytes(p10.write(dicom_json.read(text.replace("1.2.3", f"1.2.3.{i}"))))
    cli.run(["list", str(tmp_path / "in"), "--select", "00080060"], spark)
    assert [json.loads(x)["00080060"] for x in capsys.readouterr().out.splitlines()] == ['["CT"]'] * 2
    cli.run(["list", str(tmp_path / "in"), "--summarize"], spark)
    cli.run(["print", str(tmp_path / "in" / "0.dcm")], spark)
    assert "Computed Tomography" in capsys.readouterr().out
    cli.run(["modify", str(tmp_path / "in"), str(tmp_path / "out"), "--anonymize"], spark)
    kept = p10.tree(p10.Walker((tmp_path / "out" / "0.dcm").read_bytes()).elements())
    assert 0x00100020 not in kept and 0x00080060 in kept
    cli.run(["dcm-to-json", str(tmp_path / "in"), str(tmp_path / "json")], spark)
    assert spark.read.text(str(tmp_path / "json")).count() == 2
    (tmp_path / "more.json").write_text(json.dumps({"00400275": {"vr": "SQ", "Value": [{"00400007": {"vr": "LO", "Value": ["step"]}}]}, "00100020": {"vr": "LO", "Value": ["P2"]}}))
    (tmp_path / "in" / "cut.dcm").write_bytes(p10.write(dicom_json.read(text))[:-3])
    cli.run(["modify", str(tmp_path / "in"), str(tmp_path / "merged"), "--merge-json", str(tmp_path / "more.json")], spark)
    merged = p10.tree(p10.Walker((tmp_path / "merged" / "1.dcm").read_bytes()).elements())
    assert merged[0x00100020][1].strip() == b"P2" and merged[0x00400275][1][0][0x00400007][1].strip() == b"step"
    assert sorted(os.listdir(tmp_path / "merged")) == ["0.dcm", "1.dcm"] and "cut.dcm" in capsys.readouterr().err
    os.remove(tmp_path / "in" / "cut.dcm")
    image = {"00280010": {"vr": "US", "Value": [1]}, "00280011": {"vr": "US", "Value": [2]}, "00280100": {"vr": "US", "Value": [8]}, "7FE00010": {"vr": "OB", "InlineBinary": "AP8="}}
    os.makedirs(tmp_path / "img" / "x")
    (tmp_path / "img" / "x" / "i.dcm").write_bytes(p10.write(dicom_json.read(json.dumps(image))))
    cli.run(["get-pixel-data", str(tmp_path / "img"), str(tmp_path / "png")], spark)
    assert (tmp_path / "png" / "x" / "i.dcm.0000.png").read_bytes()[:4] == b"\x89PNG"
    cli.run(["get-pixel-data", str(tmp_path / "img" / "*" / "*.dcm"), str(tmp_path / "raw"), "--format", "raw"], spark)
    assert (tmp_path / "raw" / "x" / "i.dcm.0000.bin").read_bytes() == b"\0\xff"
    cli.run(["archive", str(tmp_path / "in"), str(tmp_path / "a.zip")], spark)
    assert len(zipfile.ZipFile(tmp_path / "a.zip").namelist()) == 3
