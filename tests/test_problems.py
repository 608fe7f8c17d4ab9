"""The general data problems against brute force and on awkward rows."""

import datetime as dt
import json
import random
import zoneinfo

import pytest

from lumenframe.operators import hierarchy as H
from lumenframe.operators import rejects as R
from lumenframe.operators import shred as N
from lumenframe.operators import timestamps as T
from lumenframe.operators import units as U

STAMPS = "stamp_id bigint, file string, station_id int, origin string, da string, tm string, dt string, time_zone_offset string, received_at timestamp_ntz, date_order string"


def _instants(spark, rows):
    at = dt.datetime(2024, 1, 1)
    stations = spark.createDataFrame([(1, "Europe/Berlin", "DMY"), (2, "America/New_York", "MDY"), (3, None, "YMD"), (4, "Nowhere/Else", None)], "station_id int, zone_id string, date_order string")
    df = spark.createDataFrame([(i, "f", s, o, da, tm, d, z, at, "clash") for i, (s, o, da, tm, d, z) in enumerate(rows)], STAMPS)
    out = T.normalise(df, stations)
    assert out.columns[: len(df.columns)] == df.columns
    return {r.stamp_id: r.instant_us for r in out.collect()}


def test_notations_and_zones(spark):
    us = lambda *a: int(dt.datetime(*a, tzinfo=dt.UTC).timestamp()) * 1_000_000
    noon = us(2024, 6, 1, 12)
    cases = [
        ((1, "gateway", None, None, "2024-06-01T14:00:00", None), noon),
        ((1, "gateway", None, None, "2024-06-01 12:00z", None), noon),
        ((1, "gateway", None, None, "2024-06-01T14:00+0200", "-0500"), noon),
        ((1, "gateway", None, None, "2024-06-01T08:00:00[America/New_York]", None), noon),
        ((1, "gateway", None, None, "2024-06-01T08:00:00[No/Where]", None), None),
        ((1, "modality", "20240601", "070000.000001", None, "-0500"), noon + 1),
        ((1, "modality", "2024.06.01", "14:00", None, None), noon),
        ((1, "modality", None, None, "20240601140000.5\x00", None), noon + 500_000),
        ((1, "modality", None, None, "2024060114", None), None),
        ((1, "modality", "20240601", None, None, None), None),
        ((1, "ris", None, None, "01/06/2024 14:00", None), noon),
        ((2, "ris", None, None, "06/01/2024 08:00:00 AM", None), noon),
        ((2, "ris", None, None, "06/01/2024 12:00:00 AM", None), us(2024, 6, 1, 4)),
        ((2, "ris", None, None, "31/01/2024 08:00", None), None),
        ((1, "ris", None, None, "2024-06-01 14:00 CEST", None), noon),
        ((1, "ris", None, None, "2024-06-01 14:00 QQT", None), None),
        ((1, "archive", None, None, "1717243200", None), noon),
        ((1, "archive", None, None, "1717243200.25", None), noon + 250_000),
        ((1, "archive", None, None, "1717243200000", None), noon),
        ((1, "archive", None, None, "1717243200000000", None), noon),
        ((1, "archive", None, None, "Sat, 01 Jun 2024 14:00:00 +0200", None), noon),
        ((1, "modality", None, None, "20241027023000", None), None),  # twice
        ((1, "modality", None, None, "20240331023000", None), None),  # never
        ((1, "modality", None, None, "20241027023000", "+0200"), us(2024, 10, 27, 0, 30)),
        ((1, "modality", None, None, "20240230120000", None), None),
        ((1, None, None, None, None, None), None),
        ((1, "modality", None, None, "  ", None), None),
        ((4, "gateway", None, None, "2024-06-01T14:00:00", None), None),
        ((None, "gateway", None, None, "2024-06-01T12:00:00Z", None), noon),
    ]
    got = _instants(spark, [c[0] for c in cases])
    for i, (row, want) in enumerate(cases):
        assert got[i] == want, (row, got[i], want)


def test_a_missing_zone_is_estimated_from_arrivals(spark):
    zone, rows = zoneinfo.ZoneInfo("America/New_York"), []
    rng = random.Random(5)
    for i in range(80):
        at = dt.datetime(2024, 1 + i % 12, 1 + i % 27, rng.randrange(24), rng.randrange(60), tzinfo=zone)
        seen = at.astimezone(dt.UTC).replace(tzinfo=None) + (dt.timedelta(days=40) if i % 20 == 0 else dt.timedelta(minutes=rng.uniform(1, 20)))
        rows.append((i, f"f{i}", 3, "gateway", None, None, at.strftime("%Y-%m-%dT%H:%M"), None, seen, "x"))
    stations = spark.createDataFrame([(1, "Europe/Berlin", "DMY"), (2, "America/New_York", "MDY"), (3, None, "YMD")], "station_id int, zone_id string, date_order string")
    out = T.normalise(spark.createDataFrame(rows, STAMPS), stations).collect()
    assert {r.zone_used for r in out} == {"America/New_York"} and {r.zone_source for r in out} == {"estimate"}
    # A history that no station is registered with is found as well, under one of its names.
    elsewhere = T.normalise(spark.createDataFrame(rows, STAMPS), stations.where("station_id = 1")).collect()
    want = {r.stamp_id: r.instant_us for r in out}
    assert {r.stamp_id: r.instant_us for r in elsewhere} == want and {r.zone_source for r in elsewhere} == {"estimate"}


def test_same_instants_pairs(spark):
    df = spark.createDataFrame([(3, "a", 5), (1, "a", 5), (1, "a", 5), (2, "a", 6), (4, "b", 5), (5, None, 5), (6, "a", None)], "stamp_id bigint, file string, instant_us bigint")
    assert [tuple(r) for r in T.same_instants(df).collect()] == [(1, 3)]
    assert T.same_instants(df.limit(0)).count() == 0


def _brute(records, starts):
    first = {}
    for r, n, c in records:
        first.setdefault(r, (n, c))
    ids = set(first)
    nxt = {i: n for i, (n, _) in first.items() if n in ids}
    child = {i: c for i, (_, c) in first.items() if c in ids}
    out = {i: [x for x in (nxt.get(i), child.get(i)) if x is not None] for i in ids}

    def reach(s):
        seen, todo = set(), list(s)
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out[x]
        return seen

    loops = {i for i in ids if i in reach(out[i])}
    pairs = set()
    for s in starts:
        chain, x = [], s
        while x in ids and x not in chain:
            chain.append(x)
            x = nxt.get(x)
        for root in chain:
            if root in loops:
                continue
            seen, todo = set(), [child[root]] if root in child else []
            while todo:
                y = todo.pop()
                if y not in seen and y not in loops:
                    seen.add(y)
                    todo += out[y]
            pairs |= {(root, y) for y in seen}
    return pairs, loops


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_hierarchies_with_damaged_links(spark, seed):
    rng = random.Random(seed)
    ids = list(range(10, 70))
    records = []
    for i in ids:
        n = rng.choice([i + 1, i + 1, 0, None, rng.choice(ids) if rng.random() < 0.3 else i + 1, 999])
        c = rng.choice([0, None, 0, min(i + rng.randrange(1, 9), 69), rng.choice(ids) if rng.random() < 0.2 else 0])
        records.append((i, n, c))
    records += [(10, *records[0][1:]), (None, 11, 12)]
    starts = [10, 40, 12345]
    df = spark.createDataFrame([(i, "s", n, c, None) for i, n, c in records], "record_id bigint, file_set_id string, next_sibling bigint, first_child bigint, received_at timestamp_ntz")
    sets = spark.createDataFrame([(s,) for s in starts] + [(None,)], "first_root_record bigint")
    built = H.build(df, sets)
    pairs, loops = _brute([r for r in records if r[0] is not None], starts)
    assert {tuple(r) for r in built.descendants().collect()} == pairs
    rows = built.records.collect()
    assert {r.record_id for r in rows if r.status == "loop"} == loops and len(rows) == len(ids)


def test_hierarchy_of_a_clean_tree_and_of_nothing(spark):
    links = [(1, 2, 3), (2, 0, None), (3, 4, 5), (4, None, 0), (5, 6, 0), (6, None, 7), (7, 0, 0)]
    ddl = "record_id bigint, file_set_id string, next_sibling bigint, first_child bigint, received_at timestamp_ntz"
    df = spark.createDataFrame([(i, "s", n, c, None) for i, n, c in links], ddl)
    rows = {r.record_id: r for r in H.build(df, spark.createDataFrame([(1,)], "first_root_record bigint")).records.collect()}
    assert (rows[7].path, rows[7].depth, rows[7].parent_id, rows[7].root_id) == ("1/3/6/7", 3, 6, 1)
    assert [rows[i].n_descendants for i in range(1, 8)] == [5, 0, 3, 0, 0, 1, 0] and rows[2].status == "root"
    empty = H.build(df.limit(0), spark.createDataFrame([], "first_root_record bigint"))
    assert empty.descendants().count() == 0 and empty.records.count() == 0


def test_value_without_known_unit_takes_the_unit_of_the_text(spark):
    ddl = "channel_id bigint, sensitivity double, sensitivity_units_code string, sensitivity_units_meaning string, derivation_description string"
    rows = [
        (1.25, None, None, "gain 1,25 mV/LSB", "mV"), (1.25, "arb", None, "all values in millivolts per step", "mV"), (1.25, None, None, "stored in mm Hg", "mm[Hg]"),
        (1.25, None, None, "LSB = 3.5 mV", None), (1.25, None, None, "mV or uV", None), (1.25, None, None, "lead V, a second one", None), (1.25, "uV", None, "in mV", "uV"), (1.25, None, None, "12 bit at 500 Hz", None), (1.25, None, None, "mV/mm", None), (1.25, None, None, None, None),
    ]
    df = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(rows)], ddl)
    got = {r.channel_id: (r.found_value, r.found_unit) for r in U.channel_values(df).collect()}
    assert got == {i: (1.25, r[4]) for i, r in enumerate(rows)}


def test_units_in_labels_and_rates_in_texts(spark):
    ddl = "channel_id bigint, device_model string, source_code_value string, label string, sensitivity double, sensitivity_units_code string, sensitivity_units_meaning string, sensitivity_correction_factor double, derivation_description string"
    rows = [
        ("Lead II [V]", 1.25e-6, None, None, None, 1.25), ("Lead [mm[Hg]]", 1.25, None, None, None, None), ("Lead (milli-volt) ", 0.00125, "arb", None, "re-sampled to 500 Hz", 1.25), ("Lead [V]", 1.25, "uV", None, None, 1.25),
        ("Lead [x] V", 1.25, None, None, None, None), ("Lead", None, None, None, "re-sampled to 500 Hz, gain 1.25 uV/LSB", 1.25), ("Lead", None, None, None, "gain 1.25 uV/LSB at 500 Hz", 1.25), ("Lead", None, None, None, "re-sampled to 500 Hz", None), (None, 1.25, None, None, None, None),
    ]
    df = spark.createDataFrame([(i, "M", "S", *r[:4], None, r[4]) for i, r in enumerate(rows)], ddl)
    nominals = spark.createDataFrame([("M", "S", 1.25, "uV")], "device_model string, source_code_value string, nominal double, nominal_unit string")
    got = {r.channel_id: (r.common_value, r.found_unit) for r in U.to_nominal_units(df, nominals).collect()}
    for i, r in enumerate(rows):
        assert got[i][0] == (None if r[5] is None else pytest.approx(r[5])), r
    assert got[7] == (None, None)


def test_unit_graph_and_rows(spark):
    pairs = U.compositions()
    a, b = pairs["[degF]", "Cel"]
    assert a * 212 + b == pytest.approx(100) and pairs["kPa", "mm[Hg]"][0] == pytest.approx(7.50062)
    with pytest.raises(ValueError, match="disagree"):
        U.compositions([("a", "b", 2.0, 0.0), ("b", "c", 2.0, 0.0), ("a", "c", 5.0, 0.0)])
    ddl = "channel_id bigint, device_model string, source_code_value string, sensitivity double, sensitivity_units_code string, sensitivity_units_meaning string, sensitivity_correction_factor double, derivation_description string, nominal_unit_clash string"
    rows = [
        (0.00125, "mV", None, None, None, 1.25), (1250.0, None, "nanovolt", 1.0, None, 1.25), (None, None, None, 2.0, "LSB=0,000625 milli-volt", 1.25), (None, None, None, None, "calibrated, 1 step = 1.25E-3 mV", 1.25),
        (None, None, None, None, "derived, 12 bit at 500 Hz", None), (5.0, "arb", None, None, None, None), (5.0, "kPa", None, None, None, None), (None, "uV", None, None, None, None), (float("nan"), "uV", None, None, None, None),
        (None, None, None, None, "gain 1.25 μV/LSB", 1.25), (1.25, " UV ", None, None, None, 1.25),
    ]
    df = spark.createDataFrame([(i, "M", "S", *r[:5], "x") for i, r in enumerate(rows)] + [(99, None, "S", 1.0, "uV", None, None, None, "x")], ddl)
    nominals = spark.createDataFrame([("M", "S", 1.25, "uV")], "device_model string, source_code_value string, nominal double, nominal_unit string")
    got = {r.channel_id: r.common_value for r in U.to_nominal_units(df, nominals).collect()}
    for i, r in enumerate(rows):
        assert got[i] == (None if r[5] is None else pytest.approx(r[5])), r
    assert got[99] is None and U.off_nominal(U.to_nominal_units(df.limit(0), nominals)).count() == 0


def test_shredding_rebuilds_items(spark):
    rng = random.Random(6)

    def item(depth):
        out = {f"0040{i:04x}": {"vr": "LO", "Value": [str(rng.random())]} for i in range(rng.randrange(3))}
        for t in ("00400275", "0040a730", "54000100"):
            if depth and rng.random() < 0.6:
                kind = rng.random()
                out[t] = {"vr": "SQ"} if kind < 0.15 else {"vr": "SQ", "Value": [rng.choice([{}, None, 5, item(depth - 1), item(depth - 1)]) for _ in range(rng.randrange(4))]}
        return out

    def brute(o, pre=""):
        for k, v in o.items():
            for i, x in enumerate((v.get("Value") or []) if v.get("vr") == "SQ" else []):
                if isinstance(x, dict):
                    yield f"{pre}{k.upper()}/[{i}]"
                    yield from brute(x, f"{pre}{k.upper()}/[{i}]/")

    texts = [json.dumps(item(4)) for _ in range(60)]
    texts[0] = json.dumps(texts[0])
    rows = [("o", i, t) for i, t in enumerate(texts)] + [("o", 100, None), ("o", 101, " "), ("o", 102, "{SQ"), ("o", 103, '["SQ"]'), ("o", 0, texts[0]), ("o", None, texts[1])]
    df = spark.createDataFrame(rows, "origin string, parent_id bigint, text string")
    want = {(i, p) for i, t in enumerate(texts) for p in brute(N.data_set(t))}
    found = N.nested_items(df).collect()
    assert {(r.parent_id, r.item_path) for r in found} == want and len(found) == len(want)
    known = {(r.parent_id, r.item_path) for r in found}
    assert all(r.parent_path is None or (r.parent_id, r.parent_path) in known for r in found)
    deep = "[]"
    for _ in range(300):
        deep = json.dumps([{"00400275": {"vr": "SQ", "Value": json.loads(deep)}}])
    assert len(list(N.items(*(lambda c: (c, set(c)))(N.shred(json.loads(deep)[0]))))) == 299


def test_depth_and_wrapping_have_no_limit(spark):
    n = 3000
    deep = '{"00400275": {"vr": "SQ", "Value": [' * n + "{}" + "]}}" * n
    assert sum(1 for _ in N.items(*(lambda c: (c, set(c)))(N.shred(N.data_set(deep))))) == n
    leaf = '{"00081030": {"vr": "UN", "Value": ' + "[" * 100_000 + "1" + "]" * 100_000 + "}}"
    assert N.shred(N.data_set(leaf), True)["00081030"][0][2].count("[") == 100_000
    wrapped = '{"00400275": {"vr": "SQ", "Value": [{}]}}'
    for _ in range(7):
        wrapped = json.dumps(wrapped)
    escaped = '{"00400275": {"vr": "S\\u0051", "Value": [{}]}}'
    rows = [("o", 1, wrapped), ("o", 2, None), ("o", 3, ""), ("o", 4, "{SQ"), ("o", 5, "[1]"), ("o", 6, '"null"'), ("o", 7, escaped)]
    df = spark.createDataFrame(rows, "origin string, parent_id bigint, text string")
    assert {(r.parent_id, r.item_path) for r in N.nested_items(df).collect()} == {(1, "00400275/[0]"), (7, "00400275/[0]")}
    assert {(r.parent_id, r.reason.split(":")[0]) for r in N.unreadable(df).collect()} == {(2, "null"), (3, "blank"), (4, "not JSON"), (5, "no object"), (6, "null")}


@pytest.mark.parametrize("text", ['{"a": [1, -2.5e3, true, null, "x\\n\\u00e9"], "b": {}, "c": [], "a": 3}', " [ ] ", "1", '"s"', "[1,", '{"a" 1}', "[1 2]", '{"a": 1,}', "tru", "1 1", "", "{,}"])
def test_deep_reader_agrees_with_the_plain_one(text):
    try:
        want = json.loads(text)
    except ValueError:
        with pytest.raises(ValueError):
            N.deep_loads(text)
        return
    assert N.deep_loads(text) == want and N.deep_dumps(want) == json.dumps(want, ensure_ascii=False)


def test_field_tables_keep_parents(spark):
    text = json.dumps({"54000100": {"vr": "SQ", "Value": [{}, {"003A0004": {"vr": "CS", "Value": ["ORIGINAL"]}, "003A0200": {"vr": "SQ", "Value": [{"003A0202": {"vr": "IS", "Value": [3]}}, {}]}}]}})
    df = spark.createDataFrame([("w", 1, text)], "origin string, parent_id bigint, text string")
    got = N.field_table(df, "54000100/003A0200", {"number": "003A0202"}).orderBy("item_path").collect()
    assert [(r.item_path, r.parent_path, r.number) for r in got] == [("54000100/[1]/003A0200/[0]", "54000100/[1]", "[3]"), ("54000100/[1]/003A0200/[1]", "54000100/[1]", None)]


def test_lines_are_judged(spark):
    ok, bad = "f,00100010,PN,4,12,Name", [
        ("f,00100010,PN,4,12", "columns"), ("f,00100010,PN,4,12,a,b", "columns"), ("", "columns"), (None, "null_line"), ('f,00100010,PN,4,12,a"b', "quoting"), ('f,00100010,PN,4,12,"a', "quoting"), ('f,00100010,PN,4,12,"a"b', "quoting"),
        ("f,00100010,PN,4,12,a\nb", "quoting"), ("f,00100010,PN,4,12,a\n", "quoting"), ("f,0010001a,PN,4,12,x", "tag"), ("f,00100010,XX,4,12,x", "vr"), ("f,00100010,,4,12,x", "vr"), ("f,00100010,PN,65536,12,x", "length"),
        ("f,00100010,UT,4294967295,12,x", "length"), ("f,00100010,PN,１２,12,x", "length"), ("f,00100010,PN,4,-1,x", "offset"), ("f,00100010,PN,4, 1,x", "offset"), ("f,00100010,UT,99999999999999999999999,1,x", "length"),
    ]
    good = [ok, 'f,00100010,PN,4,12,"a ""q"" b, c"', '"f","00100010","PN","4","12","two\nlines"', "f,FFFEE000,,4294967294,12,", "f,FFFEE000,SQ,4294967295,12,", "f,00100010,UT,4294967294,0,x", "f,00100010,PN,00004,123456789012345678901234567890,x", ",00100010,PN,4,12,", "f,00100010,PN,4,12," + "x" * 100_000]
    lines = [(i, r) for i, (r, _) in enumerate(bad)] + [(100 + i, r) for i, r in enumerate(good)]
    got = {r.line_id: r for r in R.parse_lines(spark.createDataFrame(lines, "line_id bigint, raw string")).collect()}
    for i, (r, why) in enumerate(bad):
        assert got[i].reason == why, r
    for i, r in enumerate(good):
        assert got[100 + i].valid, (r[:60], got[100 + i].reason)
    assert got[101].keyword == 'a "q" b, c' and got[106].length == 4 and R.parse_lines(spark.createDataFrame([], "line_id bigint, raw string")).count() == 0
