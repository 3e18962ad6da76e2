import datetime as dt

import pytest

from recordloom.operators import instants
from tests.conftest import rows


def ms(*parts):
    return int(dt.datetime(*parts, tzinfo=dt.timezone.utc).timestamp() * 1000)


@pytest.mark.parametrize("text,month_first,zone,expected", [
    ("1425972500", True, None, ms(2015, 3, 10, 7, 28, 20)), ("1425972500.25", True, None, ms(2015, 3, 10, 7, 28, 20) + 250), ("1425972500123456", True, None, ms(2015, 3, 10, 7, 28, 20) + 123),
    ("2015-03-10T07:28:20Z", True, "Europe/Berlin", ms(2015, 3, 10, 7, 28, 20)), ("2015-03-10T07:28:20.5+05:30", True, None, ms(2015, 3, 10, 1, 58, 20) + 500), ("20150310T072820Z", True, None, ms(2015, 3, 10, 7, 28, 20)),
    ("2015-03-10 07:28:20 EDT", True, "America/New_York", ms(2015, 3, 10, 11, 28, 20)), ("2015-07-10T07:28:20[Europe/London]", True, "America/New_York", ms(2015, 7, 10, 6, 28, 20)), ("2015-07-10 07:28 Europe/Berlin", True, None, ms(2015, 7, 10, 5, 28)),
    ("Tue, 10 Mar 2015 07:28:20 -0400", True, None, ms(2015, 3, 10, 11, 28, 20)), ("Tue Mar 10 07:28:20 -04:00 2015", True, None, ms(2015, 3, 10, 11, 28, 20)),
    ("03/04/2015 1:05 pm", True, "UTC", ms(2015, 3, 4, 13, 5)), ("03/04/2015 13:05", False, "UTC", ms(2015, 4, 3, 13, 5)), ("25/04/2015 13:05", True, "UTC", ms(2015, 4, 25, 13, 5)), ("03.04.2015 13:05 Uhr", True, "Europe/Berlin", ms(2015, 4, 3, 11, 5)),
    ("10. März 2015, 07:28", False, "Europe/Berlin", ms(2015, 3, 10, 6, 28)), ("November 14, 2023 at 12:00:01 AM", True, "UTC", ms(2023, 11, 14, 0, 0, 1)), ("Mar 1, 2015, 12:30 PM", True, "Asia/Kolkata", ms(2015, 3, 1, 7, 0)),
    ("10 March 2015 07:28:20", False, "America/Phoenix", ms(2015, 3, 10, 14, 28, 20)), ("2015-02-30 10:00:00", True, None, None), ("no date", True, None, None), ("null", True, None, None), (None, True, None, None), ("0", True, None, None), ("", True, None, None),
])
def test_forms(text, month_first, zone, expected):
    got, _ = instants._stamps(text, None, month_first, zone)
    assert got == expected


def test_repeated_and_skipped_hours():
    zone = "America/New_York"
    early, late = ms(2015, 11, 1, 5, 30), ms(2015, 11, 1, 6, 30)
    assert instants._stamps("2015-11-01 01:30:00", None, True, zone)[0] == early
    assert instants._stamps("2015-11-01 01:30:00", "Nov 1, 2015 1:30:00 AM EST", True, zone) == (late, late)
    assert instants._stamps(str(late), "Nov 1, 2015, 1:30 AM", True, zone)[1] == late
    assert instants._stamps("2015-03-08 02:30:00", None, True, zone)[0] == ms(2015, 3, 8, 7, 30)


def _tables(spark, imports, devices):
    return (
        spark.createDataFrame(imports, "import_id bigint, device_id int, imported_at timestamp, date string, readable_date string, zone string, locale string, utc_ms string"),
        spark.createDataFrame(devices, "device_id int, zone_id string, locale string, date string"),
    )


def test_zones_are_estimated_where_they_are_missing(spark):
    at = dt.datetime(2020, 1, 1)
    known = [(i, 1, at, str(ms(2015, 1 + i, 10, 12)), f"{dt.datetime(2015, 1 + i, 10, 12) + dt.timedelta(hours=2 if 3 <= 1 + i - 1 < 10 else 1):%b %d, %Y %I:%M:%S %p}", "x", "y", "z") for i in range(1, 10)]
    bare = [(100, 1, at, "2015-07-01 12:00:00", None, None, None, None), (101, 2, at, "2015-07-01 12:00:00", None, None, None, None), (102, None, None, "2015-07-01 12:00:00", None, None, None, None), (102, None, None, "2015-07-01 12:00:00", None, None, None, None)]
    i, d = _tables(spark, known + bare, [(1, None, "en_US", "q"), (2, "America/New_York", "en_US", "q"), (3, "Europe/Berlin", "de_DE", None)])
    got = {(r[0], r[1]): r[2] for r in instants.utc_instants(i, d).collect()}
    assert got[100, "date"] == ms(2015, 7, 1, 10) and got[101, "date"] == ms(2015, 7, 1, 16) and got[102, "date"] == ms(2015, 7, 1, 12)
    assert instants.utc_instants(i, d).where("import_id = 102").count() == 2
    assert (1, "date") not in got and got[1, "readable_date"] == ms(2015, 2, 10, 12)


def test_empty_and_null(spark):
    i, d = _tables(spark, [], [])
    assert instants.utc_instants(i, d).count() == 0
    i, d = _tables(spark, [(1, 1, None, None, None, None, None, None), (2, None, None, "x" * 100_000, "null", None, None, None)], [(1, None, None, None)])
    assert rows(instants.utc_instants(i, d)) == []


def test_undeclared_zones_by_offsets_and_by_ingestion(spark):
    """A device whose zone no device declares, one that only ingestion times tell about, and a declared zone that is wrong."""
    from zoneinfo import ZoneInfo

    tokyo, kolkata, berlin = (ZoneInfo(z) for z in ("Asia/Tokyo", "Asia/Kolkata", "Europe/Berlin"))
    rows_, truth = [], {}
    base = dt.datetime(2019, 1, 5, 9, 0, tzinfo=dt.timezone.utc)
    for i in range(60):
        at = base + dt.timedelta(days=6 * i, minutes=7 * i)
        local = lambda z, form="%Y-%m-%d %H:%M:%S": at.astimezone(z).strftime(form)
        ms_ = str(int(at.timestamp() * 1000))
        late = (at + dt.timedelta(days=400)).replace(tzinfo=None)
        rows_.append((i, 1, late, ms_, local(kolkata), None, None, None))  # pairs, no zone declared
        rows_.append((100 + i, 2, (at + dt.timedelta(minutes=3)).replace(tzinfo=None) if i % 3 else late, local(tokyo), None, None, None, None))  # imported at once, no pairs
        rows_.append((200 + i, 3, late, ms_, local(berlin), None, None, None))  # declared as New York
        truth |= {(i, "readable_date"): int(ms_), (100 + i, "date"): int(ms_), (200 + i, "readable_date"): int(ms_)}
    i, d = _tables(spark, rows_, [(1, None, "en_GB", None), (2, None, "ja_JP", None), (3, "America/New_York", "en_GB", None), (4, "America/New_York", "en_US", None)])
    got = {(r[0], r[1]): r[2] for r in instants.utc_instants(i, d).collect()}
    assert got == truth


def test_ingestion_beside_a_declared_zone(spark):
    """Times that seem to lie after their ingestion don't overturn a declared zone by themselves."""
    at = dt.datetime(2020, 6, 1, 11)
    i, d = _tables(spark, [(k, 1, at, "2020-06-01 14:00:00", None, None, None, None) for k in range(3)], [(1, "UTC", "en_GB", None)])
    assert {r[2] for r in instants.utc_instants(i, d).collect()} == {ms(2020, 6, 1, 14)}
