import datetime as dt
import json
import time
import zipfile
from io import BytesIO

import numpy as np
import pytest
from pyspark.sql import functions as F

from darkslide import cli
from darkslide.functions import nested as N
from darkslide.functions import temporal as T
from darkslide.operators import checks, rules, zones
from darkslide.sources import records as R
from darkslide.streaming.checks import severity_counts, write_findings

A, O = "ExifIFD:DateTimeOriginal", "ExifIFD:OffsetTimeOriginal"


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if v is None else {str: 'string', int: 'bigint', float: 'double', dt.datetime: 'timestamp_ntz'}[type(v)]}" for k, v in values.items()))
    return row.select(column).first()[0]


@pytest.mark.parametrize(
    ("zone", "wall", "hours"),
    [
        ("Europe/Paris", "2024-01-15 12:00", 1), ("Europe/Paris", "2024-07-15 12:00", 2), ("America/New_York", "2024-01-15 12:00", -5), ("America/New_York", "2024-07-15 12:00", -4), ("Asia/Tokyo", "2024-07-15 12:00", 9), ("Australia/Sydney", "2024-01-15 12:00", 11),
        ("Australia/Sydney", "2024-07-15 12:00", 10), ("Europe/Paris", "2024-03-31 02:30", 2), ("Europe/Paris", "2024-10-27 02:30", 1), ("America/New_York", "2024-03-10 02:30", -4), ("America/New_York", "2024-11-03 01:30", -5),
    ],
)
def test_wall_offsets(spark, zone, wall, hours):
    assert one(spark, T.wall_offset(F.col("z"), F.col("w")), z=zone, w=dt.datetime.fromisoformat(wall)) == hours * 3600


@pytest.mark.parametrize(("utc", "zone", "local"), [(1721001600, "Europe/Paris", "02:00"), (1704888000, "America/New_York", "07:00"), (1721044800, "Europe/Budapest", "14:00")])
def test_local_times(spark, utc, zone, local):
    at = dt.datetime.fromtimestamp(utc, dt.timezone.utc).replace(tzinfo=None)
    assert one(spark, F.date_format(T.local_time(F.col("z"), F.col("u")), "HH:mm"), z=zone, u=at) == local


def test_offset_texts(spark):
    normal = {"+01:00": "+01:00", "-0730": "-07:30", "UTC+2": "+02:00", "gmt-5:30": "-05:30", "UTC-0:30": "-00:30", "-0:30": "+00:30", "7": "+07:00", "[-7": None, "+1": "+01:00", "-7": "-07:00", "x": None}
    for text, expected in normal.items():
        assert one(spark, T.normalize_offset(F.col("t")), t=text) == expected, text
    assert [one(spark, T.parse_offset(F.col("t")), t=t) for t in ("Z", "-05:30", "5:30")] == [0, -19_800, None]
    assert [one(spark, f(F.col("s")), s=-4_530) for f in (T.format_offset_floor, T.format_offset)] == ["-01:16", "-01:15"]


def test_datetimes(spark):
    cases = {"2024:01:15 12:00:00": "2024-01-15 12:00:00", "2024-01-15T12:00:00Z": "2024-01-15 12:00:00", "20240715T120000": "2024-07-15 12:00:00", "2024-01-15 12:00:00.25+01:00": "2024-01-15 12:00:00.25", "2024:01:15 12:00:60": None, "2024:02:30 12:00:00": None, "": None, "2024-01-15": "2024-01-15 00:00:00"}
    for text, expected in cases.items():
        assert one(spark, T.parse_naive(F.col("t")).cast("string"), t=text) == expected, text
    w = dt.datetime(2025, 10, 27, 15, 22, 36, 615000)
    assert [one(spark, f(F.col("w")), w=w) for f in (T.stringify_datetime, lambda c: T.stringify_datetime(c, True), T.stringify_time)] == ["2025-10-27 15:22:36.615", "2025:10:27 15:22:36.615", "15:22:36.615000"]


def test_paths_of_variants(spark):
    put = lambda text, path, value: one(spark, N.set_path(F.col("t"), path, value), t=text)
    assert put("{}", "a.b", 1) == '{"a":{"b":1}}' and put('{"a":{"c":2},"k":"é"}', "a.b", [1, None]) == '{"a":{"b":[1,null],"c":2},"k":"é"}'
    assert put('{"a":5}', "a.b", 1) is None and put("broken", "a", 1) is None and put(None, "a", 1) is None
    with pytest.raises(ValueError):
        N.set_path(F.col("t"), [], 1)
    text = '{"r":{"l":[{"x":1},{"x":2,"y":3}]},"k":1}'
    pop = lambda text, path, items=True: one(spark, N.pop_path(F.col("t"), path, items), t=text)
    assert pop(text, "r.l.[].x") == '{"k":1,"r":{"l":[{"y":3}]}}' and pop('{"k":1,"r":{"l":[{"y":3}]}}', "r.l.[].y") == '{"k":1}'
    assert pop('{"k":1}', "none.x") == '{"k":1}' and pop('{"k":1}', "k.x") == '{"k":1}' and pop('{"k":1}', "k") == "{}" and pop('{"[]":{"a":1,"b":2}}', "[].a", False) == '{"[]":{"b":2}}'
    taken = lambda text, path: one(spark, F.to_json(N.dropped(F.try_parse_json("t"), path, True)), t=text)
    assert taken(text, "r.l.[].x") == "[1,2]" and taken(text, "none.x") is None and taken(text, "k") == "1"
    spared = N.drop_path(F.try_parse_json("t"), "l.[].x", True, [{"x": 1}])
    assert one(spark, F.to_json(spared), t='{"l":[{"x":1},{"x":2,"y":3}]}') == '{"l":[{"x":1},{"y":3}]}'
    listed = lambda text: one(spark, F.to_json(N.listed(F.parse_json("t"))), t=text)
    assert [listed(x) for x in ("[1]", '"ab"', "null", '{"a":1}')] == ["[1]", '["ab"]', "[null]", '[{"a":1}]']


def test_nested_rules(spark):
    rule = rules.Rules(delete=("R.Box", "R.List.[].Area", "Gone.x"), floats=("L.[].c", "field2"), ints=("L.[].a", "field1"), convert={"x_separated": ("S.size",), "flatten_if_not_multiple": ("single",)})
    record = {"R": {"Box": {"H": 1}, "List": [{"Area": 1, "Name": "n"}, {"Area": 2}]}, "Gone": {"x": 1}, "L": [{"a": "1", "b": "b"}, {"c": "3.14"}], "S": {"size": "1920 1080"}, "field1": "42", "field2": "3.14", "single": ["only_one"]}
    row = spark.createDataFrame([(json.dumps(v), k, i) for i, (k, v) in enumerate(record.items())], "v string, k string, i int")
    tags = row.groupBy().agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "k", "v"))), lambda x: F.struct(x["k"].alias("key"), F.parse_json(x["v"]).alias("value"))).alias("tags"))
    done = rules.transform_records(tags, rule, ["simple_out", "cool_out"]).select(F.transform("tags", lambda t: F.struct(t["key"], F.to_json(t["value"]).alias("v"))).alias("t")).first().t
    assert {t.key: json.loads(t.v) for t in done} == {"R": {"List": [{"Name": "n"}]}, "L": [{"a": 1, "b": "b"}, {"c": 3.14}], "S": {"size": "1920x1080"}, "field1": 42, "field2": 3.14, "single": "only_one"}


def test_nested():
    assert N.get({"a": {"b": 1}}, ["a", "b"]) == 1 and N.get({"a": 1}, ["a", "b"], None) is None and N.get(5, []) == 5
    with pytest.raises(KeyError):
        N.get({}, ["a"])
    assert N.mapped({1: 2, 3: [4]}, str, keys=True) == {"1": "2", "3": ["4"]} and N.mapped([1, (2, {3})], lambda x: x * 10) == [10, (20, {30})]
    with pytest.raises(ValueError):
        N.mapped({}, str, values=False)


def test_numbers(spark):
    floats = {"21.3": 21.3, "21.3d": None, " 1e3 ": 1000.0, ".5": 0.5, "x": None, "": None}
    assert {t: one(spark, N.to_float(F.col("t")), t=t) for t in floats} == floats
    assert [one(spark, N.to_int(F.col("t")), t=t) for t in ("12", "3.7", "99999999999999999999", "-4")] == [12, None, None, -4]
    assert one(spark, N.x_join(F.col("t")), t=" 384  512 ") == "384x512"
    assert [one(spark, N.signed8(F.col("t")), t=t) for t in ("47.5 -19.25", "47.5, 19")] == ["+47.50000000, -19.25000000", None]
    assert one(spark, N.keywords(F.col("t")), t=" a,\xa0b ;;\tc\n") == ["a", "b", "c"]


def tags(spark, **values):
    return spark.createDataFrame([(1, json.dumps(values))], "id int, j string").select("id", F.expr("transform(map_entries(from_json(j, 'map<string,string>')), e -> struct(e.key as key, cast(e.value as variant) as value))").alias("tags"))


def test_pipeline(spark):
    rule = rules.Rules.load("_del: {SourceFile: null}\n_type: {float: [E:F], int: [E:I]}\n_convert: {x_separated: [C:S], flatten_if_not_multiple: [IPTC:Keywords]}\n_eq: [[Q:A, Q:B]]")
    df = tags(spark, **{"SourceFile": "x", "Composite:GPSPosition": "47.5; 19", "IPTC:Keywords": " one ", "E:F": "1.5", "E:I": "7", "C:S": "3 4", "Q:A": "1", "Q:B": "2"})
    done = rules.transform_records(df, rule, ["check", "cool_out", "cool_in", "simple_out", "unknown"])
    found = {t.key: json.loads(t.v) for t in done.select(F.explode(F.transform("tags", lambda t: F.struct(t["key"].alias("key"), F.to_json(t["value"]).alias("v")))).alias("t")).select("t.*").collect()}
    assert found == {"Composite:GPSLatitude": 47.5, "Composite:GPSLongitude": 19, "IPTC:Keywords": "one", "E:F": 1.5, "E:I": 7, "C:S": "3x4", "Q:A": "1", "Q:B": "2"}
    assert done.first().unequal == ["Q:A=1, Q:B=2"]
    assert [one(spark, rules.rename_groups(F.col("k")), k=k) for k in ("ExifIFD:X", "IFD1:Compression", "XMP-dc:Title", "None")] == ["EXIF:X", "IFD1:Compression", "XMP-dc:Title", "None"]


CASES = [
    ({}, []), ({"x": "y"}, []),
    ({A: "2002:12:15 11:37:45", O: "+01:00", "ExifIFD:CreateDate": "2002:12:15 11:37:45"}, [("fixable", "ExifIFD:OffsetTime", "+01:00")]),
    ({"SourceFile": "photos/2024/05/06/x.jpg", O: "+01:00"}, [("fixable", A, "2024:05:06 00:00:00")]), ({A: " " * 19, "SourceFile": "photos/2024/05/06/x.jpg"}, [("fixable", A, "2024:05:06 00:00:00")]),
    ({A: "2024:01:01 10:00:00", "ExifIFD:OffsetTime": "+01:00"}, [("deletable", "ExifIFD:OffsetTime", "Missing ExifIFD:CreateDate")]),
    ({A: "2024:01:01 10:00:00", O: "+01:00", "EXIF:GPSDateStamp": "2024:01:01", "EXIF:GPSTimeStamp": "10:00:00"}, [("deletable", "EXIF:GPSDateStamp", "EXIF:GPSDateStamp utc=2024:01:01 10:00:00 vs. ExifIFD:DateTimeOriginal 2024:01:01 09:00:00 diff_secs=3600 tolerance_secs=1799")]),
    ({A: "2024:01:01 10:00:00", O: "+01:00", "EXIF:GPSDateStamp": "2024:01:01", "EXIF:GPSTimeStamp": "09:20:00"}, []),
    ({A: "2024:01:01 10:00:00+01:00", "XMP-exif:GPSDateTime": "2024:01:01 09:00:00Z"}, [("deletable", "XMP-exif:GPSDateTime", "XMP-exif:GPSDateTime offset=+00:00 != ExifIFD:DateTimeOriginal +01:00")]),
    ({A: "2024:01:01 10:00:00", O: "+01:00", "IPTC:DateCreated": "2024:01:01", "IPTC:TimeCreated": "10:00:00"}, [("fixable", "IPTC:TimeCreated", "10:00:00+01:00")]),
    ({A: "2024:01:01 10:00:00", "XMP:CreateDate": "2024:01:01 10:00:00+02:00"}, []), ({A: "0000:00:00 00:00:00"}, [("error", A, "ValueError")]),
    ({A: "2024:01:01 10:00:00", "ExifIFD:CreateDate": "2024:01:01 11:00:00", "ExifIFD:SubSecTime": "5"}, [("deletable", t, f"ExifIFD:CreateDate dt_naive=2024:01:01 11:00:00 vs. {A} 2024:01:01 10:00:00 diff_secs=3600 tolerance_secs=0") for t in ("ExifIFD:CreateDate", "ExifIFD:SubSecTime")]),
    ({A: "2024:01:01 10:00:00", O: "+01:00", "MakerNotes:DateTimeUTC": "2024:01:01 09:00:09"}, []),
]


def test_datetime_findings(spark):
    df = spark.createDataFrame([(i, c, "z") for i, (c, _) in enumerate(CASES)] + [(99, None, None)], "id int, tags map<string,string>, findings string")
    found = {r.id: [tuple(f) for f in r.findings] for r in checks.datetime_findings(df, keep=["id"]).collect()}
    assert found == {i: e for i, (_, e) in enumerate(CASES)} | {99: []}
    fatal = checks.datetime_findings(spark.createDataFrame([(1, {"XMP:DateCreated": "x", O: "+01:00"})], "id int, tags map<string,string>"), keep=["id"]).first().findings[0]
    assert (fatal.severity, fatal.tag) == ("fatal", f"{A}+{O}") and "KeyError" in fatal.detail
    assert checks.job_failed(checks.datetime_findings(df, keep=["id"])).first()[0] and not checks.job_failed(checks.datetime_findings(df.limit(0), keep=["id"])).first()[0]


def square(pos, tz, x, y, size=10.0):
    return (pos, tz, f"id-{pos}", x + size / 2, [[(x, y), (x + size, y), (x + size, y + size), (x, y + size), (x, y)]])


def zone_frame(spark):
    rows = [square(0, "Europe/Paris", 0.0, 40.0), square(1, "Europe/London", -10.0, 40.0), square(2, "Asia/Tokyo", 135.0, 30.0), square(3, "Europe/Rome", 5.0, 45.0)]
    return spark.createDataFrame(rows, "pos int, tz_name string, geo_id string, centroid_lon double, rings array<array<struct<lon:double,lat:double>>>")


def test_zones_and_offset_check(spark, monkeypatch):
    zone = zone_frame(spark)
    points = spark.createDataFrame([(1, 45.0, 5.0), (2, 47.0, 7.0), (3, 38.0, 3.0), (4, 0.0, -170.0), (5, None, 1.0), (6, 39.9, -1.0)], "id int, lat double, lon double")
    found = {r.id: r.tz for r in zones.zone_of_points(points, "id", zone).collect()}
    assert found == {1: "Europe/Paris", 2: "Europe/Paris", 3: "Europe/Paris", 4: "Europe/London", 5: None, 6: "Europe/London"} | {4: found[4]}
    monkeypatch.setattr(zones, "MOST_EDGES", 9)  # two blocks of zones
    assert {r.id: r.tz for r in zones.zone_of_points(points, "id", zone).collect()} == found
    exact = {r.id: r.tz for r in zones.zone_of_points(points, "id", zone, tolerance=0).collect()}
    assert (exact[2], exact[3], exact[6]) == ("Europe/Paris", None, None)
    w = dt.datetime(2024, 1, 15, 12)
    rows = [(1, 43.0, 3.0, w, "+01:00"), (2, 43.0, 3.0, w, "+00:00"), (3, 43.0, 0.0005, w, "+00:00"), (4, None, 3.0, w, "+01:00"), (5, 43.0, 3.0, None, "+01:00"), (6, 43.0, 3.0, w, None)]
    checked = zones.check_offsets(spark.createDataFrame(rows, "id int, lat double, lon double, wall timestamp_ntz, declared string"), "id", zone)
    assert {r.id: r.error_class for r in checked.collect()} == {1: None, 2: "TzMismatchError", 3: None, 4: "NoGpsError", 5: "NoCaptureDateTimeError", 6: "TzMismatchError"}


def test_offset_check_classes(spark):
    tags = [{"Composite:GPSLatitude": "43.0", "Composite:GPSLongitude": "3.0", "EXIF:OffsetTimeOriginal": "+01:00", "EXIF:DateTimeOriginal": text} for text in ("2024:01:15 12:00:00", "", "15/01/2024 noon", "2024:02:30 12:00:00", "2024-01-15T12:00:00Z")]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*tags, {"EXIF:OffsetTimeOriginal": "+01:00"}, {**tags[0], "EXIF:OffsetTimeOriginal": "here"}])], "id int, t map<string,string>").select("id", F.inline(F.array(checks.offset_facts(F.col("t")))))
    found = {r.id: (r.error_class, r.error) for r in zones.check_offsets(rows, "id", zone_frame(spark)).collect()}
    assert {k: v[0] for k, v in found.items()} == {0: None, 1: "NoCaptureDateTimeError", 2: "TzMismatchError", 3: "ValueError", 4: None, 5: "NoGpsError", 6: "TzMismatchError"}
    assert found[2][1] == "Unrecognized datetime format: '15/01/2024 noon'" and found[6][1] == "Missing timezone offset"
    strict = {r.id: (r.error_class, r.error) for r in zones.check_offsets(rows, "id", zone_frame(spark), strict=True).collect()}
    assert strict == {**found, 1: ("TzMismatchError", found[1][1]), 5: ("TzMismatchError", found[5][1])}


def test_date_of_whole_stamp_without_time_tag(spark):
    tags = {A: "2024:01:15 12:00:00", O: "+01:00", "IPTC:DateCreated": "2024:01:15 12:00:00"}
    found = checks.datetime_findings(spark.createDataFrame([("a", tags)], "source_file string, tags map<string,string>")).first().findings
    assert [tuple(f) for f in found] == [("error", "IPTC:DateCreated", "KeyError: 'IPTC:TimeCreated'")]


def test_extraction(spark):
    df = spark.createDataFrame([({"EXIF:GPSLatitude": "1", "EXIF:GPSLongitude": "2", "Composite:GPSLatitude": "x", "Composite:GPSLongitude": "2", "EXIF:TimeZoneOffset": "[-7,-7]", "EXIF:DateTimeOriginal": "", "EXIF:CreateDate": "2024:01:01 00:00:00"},), ({"Foo": "+1"},)], "t map<string,string>")
    lat, lon = checks.place_of(F.col("t"))
    rows = df.select(lat.alias("lat"), lon.alias("lon"), checks.declared_offset(F.col("t")).alias("o"), checks.capture_time(F.col("t")).cast("string").alias("w")).collect()
    assert [tuple(r) for r in rows] == [(1.0, 2.0, "-07:00", "2024-01-01 00:00:00"), (None, None, "+01:00", None)]


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"SourceFile": "a.jpg", "z": 1, "b": [1, 2]}, 5]))
    (tmp_path / "b.json").write_text('{"SourceFile": "b.jpg", "x": null}\n{broken\n')
    rows = {r.source_file: [(t.key, t.v) for t in r.tags] for r in R.read_json_records(spark, str(tmp_path)).select("source_file", F.transform("tags", lambda t: F.struct(t["key"].alias("key"), F.to_json(t["value"]).alias("v"))).alias("tags")).collect()}
    assert rows == {"a.jpg": [("SourceFile", '"a.jpg"'), ("z", "1"), ("b", "[1,2]")], "b.jpg": [("SourceFile", '"b.jpg"'), ("x", "null")]}
    text = R.read_json_records(spark, str(tmp_path / "a.json")).select(R.ordered_json(F.col("tags"))).first()[0]
    assert list(json.loads(text)) == ["SourceFile", "z", "b"]
    (tmp_path / "y").mkdir()
    (tmp_path / "y" / "c.yaml").write_text("- SourceFile: c.jpg\n  n: 1\n")
    assert [r.source_file for r in R.read_yaml_records(spark, str(tmp_path / "y")).collect()] == ["c.jpg"]
    with pytest.raises(RuntimeError, match="none.yaml"):
        R.read_yaml(str(tmp_path / "none.yaml"))
    buffer = BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("in/x-tz.json", "{}")
        z.writestr("in/readme.txt", "")
    assert [(r.name, bytes(r.content)) for r in R.zip_members(spark.createDataFrame([(buffer.getvalue(),)], "content binary"), "-tz.json", "in/").collect()] == [("x-tz.json", b"{}")]
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "p-tz.json").write_text('{"type": "Polygon", "coordinates": [[[0,0],[1,0],[1,1],[0,0]]]}')
    (tmp_path / "g" / "m-tz.json").write_text('{"type": "MultiPolygon", "coordinates": [[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]]]]}')
    assert {r.id: len(r.rings) for r in R.read_geojson_zones(spark, str(tmp_path / "g")).collect()} == {"p-tz": 1, "m-tz": 2}
    page = '<a href="/rel/1/data.zip">'
    assert one(spark, R.asset_links(F.col("h"), F.col("u"), "data[.]zip"), h=page, u="https://example.org/rel") == "https://example.org/rel/1/data.zip"
    assert one(spark, R.yaml_text(F.col("t")), t='{"b": 1, "a": "é"}') == "b: 1\na: é"
    files = spark.createDataFrame([("a",), ("a",)], "source_file string")
    assert [tuple(r) for r in R.change_set(files, {"K": [1]}).collect()] == [("a", "K", "[1]")]
    assert R.expand([str(tmp_path / "*.json"), "none*.jpg"], ".jpg") == ["none*.jpg"]
    spark.dataSource.register(R.MediaMetadata)
    assert spark.read.format("mediameta").load(str(tmp_path / "*.json")).count() == 2


def test_id_table(spark):
    mapping = spark.createDataFrame([("A", ["1", "2"], 0), ("B", ["2"], 1)], "tz string, ids array<string>, pos int")
    polygons = spark.createDataFrame([(i, [[(0.0, 0.0), (1.0, 2.0), (0.0, 0.0)]]) for i in ("1", "2", "3")], "id string, rings array<array<struct<lon:double,lat:double>>>")
    assert {r.geo_id: (r.tz_name, r.max_lat) for r in zones.zone_table(mapping, polygons).collect()} == {"1": ("A", 2.0), "2": ("B", 2.0)}
    now = dt.datetime(2024, 1, 1)
    for rows, stale in (([("polygon", now)], True), ([("index", now), ("mapping", now)], False), ([("index", now), ("polygon", now + dt.timedelta(1))], True)):
        assert zones.needs_rebuild(spark.createDataFrame(rows, "kind string, mtime timestamp_ntz")).first()[0] is stale


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([(f"f{i}", c) for i, (c, _) in enumerate(CASES)], "source_file string, tags map<string,string>")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    for _ in range(2):
        write_findings(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == sum(len(e) for _, e in CASES)
    timed = checks.datetime_findings(df.withColumn("at", F.lit("2024-01-01 00:10:00").cast("timestamp")), keep=["at"])
    assert sum(r.findings for r in severity_counts(timed, "at").collect()) == sum(len(e) for _, e in CASES)


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "x.json").write_text(json.dumps([{"SourceFile": "a.jpg", A: "2002:12:15 11:37:45", O: "+01:00", "ExifIFD:CreateDate": "2002:12:15 11:37:45"}, {"SourceFile": "b.JPG", A: "x"}]))
    path = str(tmp_path / "x.json")
    assert cli.main(["chk", path], spark) == 1
    assert capsys.readouterr().out.strip() == "a.jpg:\n  fixable:\n    ExifIFD:OffsetTime: +01:00"
    assert cli.main([path], spark) == 0 and "SourceFile: a.jpg" in capsys.readouterr().out
    assert cli.main(["set", "--tags", '{"K": "v"}', "a.jpg"], spark) == 0 and json.loads(capsys.readouterr().out) == {"source_file": "a.jpg", "key": "K", "value": '"v"'}


def test_command_line_zones_and_transformations(spark, tmp_path, capsys):
    from unittest import mock

    ring = [[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]]
    zone = spark.createDataFrame([(1, "Europe/Paris", "1", 0.0, 0.0, 10.0, 10.0, 5.0, ring)], "pos int, tz_name string, geo_id string, min_lon double, min_lat double, max_lon double, max_lat double, centroid_lon double, rings array<array<struct<lon double, lat double>>>")
    zones.store_zones(zone, f"{tmp_path}/z", "u")
    place = {"Composite:GPSLatitude": 5.0, "Composite:GPSLongitude": 5.0, "EXIF:DateTimeOriginal": "2002:12:15 11:37:45"}
    (tmp_path / "x.json").write_text(json.dumps([{"SourceFile": "a.jpg", **place, "EXIF:OffsetTimeOriginal": "+05:00"}, {"SourceFile": "b.jpg", **place, "EXIF:OffsetTimeOriginal": "+01:00"}]))
    path = str(tmp_path / "x.json")
    assert cli.main(["chk", "--geotz", "--zones", f"{tmp_path}/z", path], spark) == 1
    said = capsys.readouterr().out
    assert said.startswith("a.jpg:\n  TzMismatchError:") and "expected=''+01:00''" in said and "b.jpg" not in said
    with mock.patch.object(cli.zones, "check_offsets", wraps=zones.check_offsets) as called:
        cli.main(["chk", "-m", "300", "--zones", f"{tmp_path}/z", path], spark)
    assert called.call_args.args[3] == 300
    given = json.dumps({"XMP:Subject": "x"})
    steps = {"cool_in": lambda t, r: F.transform(t, lambda x: F.struct(F.concat(F.lit("In:"), x["key"]).alias("key"), x["value"].alias("value")))}
    capsys.readouterr()
    with mock.patch.dict(cli.rules.TRANSFORMATIONS, steps):
        assert cli.main(["set", "-t", "cool_in", "--tags", given, "a.jpg"], spark) == 0
    assert json.loads(capsys.readouterr().out) == {"source_file": "a.jpg", "key": "In:XMP:Subject", "value": '"x"'}


def test_typed_texts(spark, tmp_path):
    df = spark.sql("select timestamp_ntz'2024-01-02 03:04:05.5' as w, date'2024-01-02' as d, interval '-5:30' hour to minute as i, 'x' as s")
    assert tuple(T.cozy(df, exif=True).first()) == ("2024:01:02 03:04:05.5", "2024:01:02", "-05:30", "x")
    with pytest.raises(TypeError):
        T.stringify(df, "s")


def test_stored_zones(spark, tmp_path):
    zone = zone_frame(spark)
    zones.store_zones(zone, f"{tmp_path}/z", "u1")
    assert zones.load_zones(spark, f"{tmp_path}/z").count() == 4
    ids = zone.select(F.col("geo_id").alias("id"))
    assert not zones.needs_refresh(ids, ids, "id", "u1", "u1")
    assert zones.needs_refresh(ids, ids, "id", "u1", "u2") and zones.needs_refresh(ids, ids.limit(2), "id", "u1", "u1")


def test_helpers():
    from darkslide.functions import helpers as H

    def f(self, a, b=2, **more):
        return H.caller()

    assert f(None, "x", c=3) == "f('x', 2, c=3)"
    assert H.describe_error(ValueError("y")) == "ValueError: y" and (H.percent(1, 3), H.percent(None, 3), H.percent(1, 0)) == (33.3, None, None)
    assert H.root_path("darkslide/cli.py", module=True) == "darkslide.cli" and H.root_path().endswith(H.root_path(relative=True).strip("."))


def test_nearest_by_bounds_equals_all_edges():
    rng = np.random.default_rng(3)
    start, region = rng.uniform(-60, 60, (3_000, 2)), np.sort(rng.integers(0, 12, 3_000))
    edges = np.concatenate([start, start + rng.normal(0, 0.5, (3_000, 2))], axis=1)
    centre = np.arange(-60, 60, 10.0)[region]
    x, y = rng.uniform(-170, 170, 400), rng.uniform(-80, 80, 400)
    distance = zones.segment_distances(x, y, np.broadcast_to(edges, (400, *edges.shape)))
    for i, (found, beyond, least) in enumerate(zip(*zones.EdgeBlocks(edges, region, centre).nearest(x, y))):
        away = np.minimum(abs(x[i] - centre), 360 - abs(x[i] - centre))
        own = np.where(away <= zones.BAND_DEG, distance[i], np.inf) if (away <= zones.BAND_DEG).any() else distance[i]
        assert (beyond, least) == (not (away <= zones.BAND_DEG).any(), own.min()) and found == region[own == own.min()].min()


def test_nearest_among_a_million_edges():
    rng = np.random.default_rng(4)
    start, region = rng.uniform(-180, 180, (1_000_000, 2)), np.sort(rng.integers(0, 400, 1_000_000))
    blocks = zones.EdgeBlocks(np.concatenate([start, start + 0.01], axis=1), region, np.linspace(-180, 180, 400)[region])
    began = time.time()
    blocks.nearest(rng.uniform(-180, 180, 100), rng.uniform(-90, 90, 100))
    assert time.time() - began < 10


def test_zone_command_and_local_times(spark, tmp_path, capsys):
    zones.store_zones(zone_frame(spark), str(tmp_path / "z"), "test")
    assert cli.main(["zone", "43.0", "3.0", "--zones", str(tmp_path / "z"), "--time", "2024-07-15 10:00:00"], spark) == 0
    assert cli.main(["zone", "43.0", "3.0", "--zones", str(tmp_path / "z")], spark) == 0
    assert capsys.readouterr().out.splitlines()[-2:] == ["Europe/Paris 7200 2024-07-15 12:00:00", "Europe/Paris"]


def test_iso_zip_and_messages(spark):
    iso = lambda text: tuple(one(spark, F.struct(T.parse_iso(F.col("t"))["wall"].cast("string"), T.parse_iso(F.col("t"))["offset_s"]), t=text))
    assert iso("2024-01-15T12:00:00-03:30") == ("2024-01-15 12:00:00", -12600) and iso("20240715T120000Z") == ("2024-07-15 12:00:00", 0) and iso("2024-01-15") == ("2024-01-15 00:00:00", None)
    assert iso("2024:01:15 12:00:00") == (None, None) and iso(None) == (None, None) and iso("2024-02-30T12:00:00Z") == (None, None)
    zipped = spark.range(1).select(F.to_json(N.zip_positions(a=F.array(F.lit(1), F.lit(2)), b=F.array(F.lit("x"))))).first()[0]
    assert zipped == '[{"a":1,"b":"x"}]'
    rows = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, None)], "g int, o int, t string")
    assert [tuple(r) for r in checks.joined_messages(rows, ["g"], ["o"], "t").collect()] == [(1, "a; b")]
