"""Stamps against single cases and against an independent reader built on zoneinfo."""

import calendar
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from siltstone.operators import timestamps as ts

UTC = timezone.utc
READERS = [("kolkata", "Asia/Kolkata", "dmy"), ("york", "America/New_York", "mdy"), ("london", "Europe/London", "dmy"), ("nowhere", None, "dmy"), ("bad", "Mars/Base", "dmy")]


def at(y, mo, d, h=0, mi=0, s=0, tz=UTC):
    return int(datetime(y, mo, d, h, mi, s, tzinfo=tz).timestamp())


IST = timezone(timedelta(hours=5, minutes=30))
CASES = [
    ("2023-09-16T00:05:41Z", "nowhere", at(2023, 9, 16, 0, 5, 41)), ("2023-09-16 00:05:41", "kolkata", at(2023, 9, 16, 0, 5, 41, IST)), ("2023-09-16 00:05:41", "nowhere", None),
    ("2023-09-16 00:05:41", None, None), ("2023-09-16 00:05:41", "bad", None), ("2023-09-16 00:05:41 Mars/Base", "kolkata", None), ("D:20091103045120-05'00'", "kolkata", at(2009, 11, 3, 9, 51, 20)),
    ("D:200907302102", "kolkata", at(2009, 7, 30, 21, 2, 0, IST)), ("D:20220810045122Z00'00'", None, at(2022, 8, 10, 4, 51, 22)), ("D:20220810045122+05'30", None, at(2022, 8, 9, 23, 21, 22)),
    ("20110308T172025Z", None, at(2011, 3, 8, 17, 20, 25)), ("2025-09-14 21:18:16 Europe/London", None, at(2025, 9, 14, 20, 18, 16)), ("2011-10-22 05:19:17 America/New_York", None, at(2011, 10, 22, 9, 19, 17)),
    ("19. Januar 2012, 05:20:20", "kolkata", at(2012, 1, 19, 5, 20, 20, IST)), ("3. März 2016, 21:45:48", "london", at(2016, 3, 3, 21, 45, 48)), ("29 mars 2015 à 01:31:25", "london", None),
    ("29 août 2015 à 01:31:25", "london", at(2015, 8, 29, 0, 31, 25)), ("06 Jan 2024 15:13:39 IST", None, at(2024, 1, 6, 15, 13, 39, IST)), ("01 Oct 2011 17:55:51 BST", None, at(2011, 10, 1, 16, 55, 51)),
    ("Wed, 26 Apr 2017 09:18:46 +0000", None, at(2017, 4, 26, 9, 18, 46)), ("2018-05-01T10:00:00.999999-04:00[America/New_York]", None, at(2018, 5, 1, 14)),
    ("06/12/2016 22:11:02", "kolkata", at(2016, 12, 6, 22, 11, 2, IST)), ("06/12/2016 22:11:02", "york", at(2016, 6, 13, 2, 11, 2)), ("31/12/2016 22:11:02", "york", None),
    ("27/3/2016 2:34:59 AM", "kolkata", at(2016, 3, 27, 2, 34, 59, IST)), ("1/1/2023 12:30:50 PM", "london", at(2023, 1, 1, 12, 30, 50)), ("1/1/2023 12:30:50 AM", "london", at(2023, 1, 1, 0, 30, 50)),
    ("1/1/2023 13:30:50 PM", "london", None), ("1538197856", None, 1538197856), ("1641706374778", None, 1641706374), ("12345678", None, None), ("2019-02-30T10:00:00Z", None, None), ("2020-02-29T10:00:00Z", None, at(2020, 2, 29, 10)),
    ("2019-00-10T25:61:00", "london", None), ("0000-00-00 00:00:00", "london", None), ("2019-01-13 03:41", "kolkata", at(2019, 1, 13, 3, 41, 0, IST)), ("2018-08-13", "london", None), ("D:20180813", "london", None), ("May 2020", "london", None),
    ("2021-03-14 02:30:00", "york", None), ("2021-11-07 01:30:00", "york", None), ("2021-11-07T01:30:00-05:00", "york", at(2021, 11, 7, 6, 30)), ("2021-03-28 01:30:00 Europe/London", "kolkata", None), ("2021-07-02 19:26:30.966607-04:00", "kolkata", at(2021, 7, 2, 23, 26, 30)),
    ("yesterday", "london", None), ("", "london", None), ("   ", "london", None), ("--", "london", None), (None, "london", None), ("x" * 5000, "london", None), ("2018-01-01T10:00:00Z|9", "london", None), ("\u0001|||", "london", None),
]


@pytest.fixture(scope="module")
def readers(spark):
    return spark.createDataFrame(READERS, "reader string, home_zone string, day_order string")


def normalised(spark, readers, rows, precision=None):
    df = spark.createDataFrame([(f"d{i}", i, v, r) for i, (v, r) in enumerate(rows)], "document_id string, row_id long, v string, reader string")
    df = df.withColumn("parsed", F.lit("clash")).withColumn("key", F.lit("clash")).withColumn("home_zone", F.lit("clash"))
    values = ts.stated_values(df, [("f", F.col("v"), F.lit(precision) if precision else None)], "document_id", "row_id")
    return {r["row_id"]: r["key"] for r in ts.normalise_stamps(values, readers).collect()}


def test_cases(spark, readers):
    got = normalised(spark, readers, [(v, r) for v, r, _ in CASES])
    for i, (v, r, want) in enumerate(CASES):
        assert got.get(i) == (None if want is None else str(want)), (v, r, want, got.get(i))


@pytest.mark.parametrize("zone", ["Europe/London", "America/New_York", "Australia/Lord_Howe", "Asia/Kathmandu"])
def test_local_times_around_changes(spark, zone):
    """Every quarter hour around the changes of a year, against zoneinfo."""
    z, rows, want = ZoneInfo(zone), [], []
    day = datetime(2021, 1, 1)
    changes = [d for d in (day + timedelta(days=i) for i in range(366)) if (d.replace(tzinfo=z).utcoffset() != (d + timedelta(days=1)).replace(tzinfo=z).utcoffset())] or [day]
    for d in changes:
        for q in range(0, 6 * 4):
            t = d + timedelta(minutes=15 * q)
            found = {u for f in (0, 1) if (u := t.replace(tzinfo=z, fold=f).astimezone(UTC)).astimezone(z).replace(tzinfo=None) == t}
            rows.append((t.strftime("%Y-%m-%d %H:%M:%S"), "here"))
            want.append(str(calendar.timegm(found.pop().timetuple())) if len(found) == 1 else None)
    got = normalised(spark, spark.createDataFrame([("here", zone, "dmy")], "reader string, home_zone string, day_order string"), rows)
    assert [got.get(i) for i in range(len(rows))] == want


def test_periods(spark, readers):
    rows = [("2022-01-01T00:00:00+00:00", None), ("2018-01-01", None), ("20230308", None), ("28.01.2018", None), ("Juni 2019", None), ("11 May 2014", None), ("2015", None), ("D:2018", None), ("06/2011", None), ("2017-07", None), ("31.02.2018", None)]
    assert list(normalised(spark, readers, rows, "day").values()) == ["day 2022-01-01", "day 2018-01-01", "day 2023-03-08", "day 2018-01-28", None, "day 2014-05-11", None, None, None, None, None]
    assert list(normalised(spark, readers, rows, "month").values()) == ["month 2022-01", "month 2018-01", "month 2023-03", "month 2018-01", "month 2019-06", "month 2014-05", None, None, "month 2011-06", "month 2017-07", None]
    assert list(normalised(spark, readers, rows, "year").values())[:9] == [f"year {y}" for y in (2022, 2018, 2023, 2018, 2019, 2014, 2015, 2018, 2011)]


def test_pairs_ignore_copies_nulls_and_other_groups(spark, readers):
    rows = [("a", 1, "2023-01-01T00:00:00Z"), ("a", 1, "2023-01-01T00:00:00Z"), ("a", 2, "20230101T000000Z"), ("a", 3, "2023-01-01T05:30:00+0530"), ("b", 4, "2023-01-01T00:00:00Z"), (None, 5, "2023-01-01T00:00:00Z"), (None, 6, "2023-01-01T00:00:00Z"), ("a", 7, None)]
    df = spark.createDataFrame([(*r, None) for r in rows], "document_id string, row_id long, v string, reader string")
    pairs = ts.same_meaning_pairs(ts.normalise_stamps(ts.stated_values(df, [("f", F.col("v"), None)], "document_id", "row_id"), readers))
    assert sorted((r.id_low, r.id_high) for r in pairs.collect()) == [(1, 2), (1, 3), (2, 3)]
    empty = ts.same_meaning_pairs(ts.normalise_stamps(ts.stated_values(df.limit(0), [("f", F.col("v"), None)], "document_id", "row_id"), readers))
    assert empty.count() == 0


def test_days_from_civil(spark):
    days = [datetime(1, 1, 1), datetime(1969, 12, 31), datetime(1970, 1, 1), datetime(2000, 2, 29), datetime(2100, 3, 1), datetime(9998, 12, 31)]
    df = spark.createDataFrame([(d.year, d.month, d.day) for d in days], "y long, m long, d long")
    got = [r["n"] for r in df.select(ts.days_from_civil(F.col("y"), F.col("m"), F.col("d")).alias("n")).collect()]
    assert got == [(d - datetime(1970, 1, 1)).days for d in days]
