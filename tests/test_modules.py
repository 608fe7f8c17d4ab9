"""Typed views of modules and the timing of frames."""

import pytest

from lumenframe.operators import modules

DDL = "file string, path array<struct<tag:string,item:int>>, tag string, vr string, values_json string"


def test_modules_and_frame_times(spark):
    rows = [("a", [], "00280008", "IS", "[4]"), ("a", [], "00181063", "DS", "[40.0]"), ("a", [], "00082142", "IS", "[2]"), ("a", [], "00082143", "IS", "[3]"), ("b", [], "00280008", "IS", "[2]"), ("b", [], "00181065", "DS", "[0, 25.5]"), ("b", [], "00180040", "IS", "[10]"), ("c", [], "00180040", "IS", '["x"]')]
    df = spark.createDataFrame(rows, DDL)
    got = {(r.file, r.frame_index): (r.duration_ms, r.at_ms, r.trimmed) for r in modules.frame_times(modules.module(df, "cine")).collect()}
    assert got["a", 3] == (40.0, 120.0, True) and got["a", 1] == (40.0, 40.0, False)
    assert got["b", 1] == (25.5, 0.0, False) and got["c", 0] == (1000.0, 0.0, False)
    voi = spark.createDataFrame([("a", [], "00281050", "DS", "[40, 50.5]"), ("a", [{"tag": "00400275", "item": 0}], "00281051", "DS", "[1]")], DDL)
    row = modules.module(voi, "voi_lut").collect()[0]
    assert row.window_center == [40.0, 50.5] and row.window_width is None
    for name in modules.MODULES:
        assert modules.module(df.limit(0), name).count() == 0
    with pytest.raises(Exception, match="is missing"):
        modules.module(voi, "voi_lut").select(modules.first_required("window_width")).collect()
