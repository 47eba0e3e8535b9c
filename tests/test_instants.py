import datetime as dt

import pytest

from darkslide.functions.stamps import clock_micros, instant, offset_minutes, read_stamp, utc_instant, written_day
from darkslide.operators.instants import StampField, normalise_instants, with_home_zone


def us(*parts, micros=0):
    return int(dt.datetime(*parts, tzinfo=dt.timezone.utc).timestamp()) * 1_000_000 + micros


@pytest.mark.parametrize(
    ("text", "companion", "zone", "expected"),
    [
        ("2009:01:03 10:03:15+01:00", "+05:00", None, us(2009, 1, 3, 9, 3, 15)), ("2009:01:03 10:03:15", "UTC+1", None, us(2009, 1, 3, 9, 3, 15)), ("2009:01:03 10:03:15", "local", "Europe/Paris", us(2009, 1, 3, 9, 3, 15)),
        ("2009-01-03T10:03:15.5Z", None, None, us(2009, 1, 3, 10, 3, 15, micros=500_000)), ("20090103T100315Z", None, None, us(2009, 1, 3, 10, 3, 15)), ("1231176813", None, None, 1231176813 * 10**6), ("1233219364783", None, None, 1233219364783 * 1000),
        ("04.01.2009 12:12:57", "−05:00", None, us(2009, 1, 4, 17, 12, 57)), ("Wed, 07 Mar 2012 18:02:42 +0100", None, None, us(2012, 3, 7, 17, 2, 42)), ("Aug 14, 2011 7:49:33 PM", "Z", None, us(2011, 8, 14, 19, 49, 33)),
        ("2009:01:03 12:00:00 AM", "Z", None, us(2009, 1, 3)), ("2009:07:28 13:28:27 JST", "+01:00", None, us(2009, 7, 28, 4, 28, 27)), ("2015-03-29T02:50:49+01:00[Europe/Budapest]", None, None, us(2015, 3, 29, 1, 50, 49)),
        ("2009-01-03T11:01", "+1", None, us(2009, 1, 3, 10, 1)), ("2024:10:27 02:30:00", None, "Europe/Paris", None), ("2024:03:31 02:30:00", None, "Europe/Paris", None), ("2024:03:31 02:30:00", "+02:00", "Europe/Paris", us(2024, 3, 31, 0, 30)),
        ("2009:01:03", "Z", None, None), ("2009:02:30 10:00:00", "Z", None, None), ("2009:01:03 25:00:00", "Z", None, None), ("0000:00:00 00:00:00", "Z", None, None), ("    :  :     :  :  ", "Z", None, None), (None, "Z", None, None),
        ("2009:01:03 10:03:15", "+99:99", None, None), ("2009:01:03 10:03:15", None, None, None), ("2009:01:03 10:03:15", None, "No/Where", None), ("2009:01:03 10:03:15 XYZ", "Z", None, None),
    ],
)
def test_instant(text, companion, zone, expected):
    assert instant(text, companion, zone) == expected


def test_utc_and_parts():
    assert utc_instant("2009:01:03", "23/1 58/1 4850/100") == us(2009, 1, 3, 23, 58, 48, micros=500_000)
    assert utc_instant("2009:01:03 08:54:03Z", "01:00:00") == us(2009, 1, 3, 8, 54, 3)
    assert utc_instant("20090104", "8 36 11") == us(2009, 1, 4, 8, 36, 11)
    assert utc_instant("2009:01:03", "25:61:00") is utc_instant("2009:01:03", None) is utc_instant("0000:00:00", "10:00:00") is None
    assert clock_micros("1/0 1/1 1/1") is None
    assert [offset_minutes(x) for x in ("+5:45", " -07:00 ", "GMT+0", "+0930", "+13", "local", None, "+14:30")] == [345, -420, 0, 570, 780, None, None, None]
    assert [written_day(x) for x in ("04.01.2009 12:12:57", "1231176813", "2009:13:01 00:00:00", " ")] == ["2009-01-04", "", None, None]
    assert read_stamp("x" * 100_000) is None


def test_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, "2009:01:03 10:00:00", "+01:00", 7, "x"), (1, "2009:01:03 10:00:00", "+01:00", 7, "y"), (2, "2009:01:03 10:00:00", None, 7, "x"), (3, None, None, None, None), (None, "2009:01:03 10:00:00Z", None, 9, None)], "id bigint, t string, o string, camera_id int, tag string")
    cameras = spark.createDataFrame([(7, "Europe/Paris"), (8, None), (None, "Asia/Tokyo")], "camera_id int, home_zone string")
    zoned = with_home_zone(df, cameras, "id")
    assert zoned.count() == df.count()
    fields = [StampField("T", "t", "o")]
    expected = {(1, "T", us(2009, 1, 3, 9)), (2, "T", us(2009, 1, 3, 9)), (None, "T", us(2009, 1, 3, 10))}
    found = normalise_instants(zoned, fields, "id", "home_zone").collect()
    assert len(found) == 3 and set(map(tuple, found)) == expected
    store = f"file://{tmp_path}/store"
    for _ in range(2):
        assert set(map(tuple, normalise_instants(zoned, fields, "id", "home_zone", store=store).collect())) == expected
    assert spark.read.parquet(store).count() == 3
    assert normalise_instants(zoned.limit(0), fields, "id", "home_zone").count() == 0
