from datetime import datetime, timedelta

from pyspark.sql import functions as F

from presswork.functions import dates
from presswork.session import ntz

# Each text with the wall-clock moment that is written in it; None where there is none.
DATES = [
    ("Mon, 01 Jan 2024 10:20:30 +0900", datetime(2024, 1, 1, 10, 20, 30)),
    ("Tue, 2 Feb 2021 00:00:00 GMT", datetime(2021, 2, 2)),
    ("01 Mar 2024 23:59:59 -0500", datetime(2024, 3, 1, 23, 59, 59)),
    ("Wed, 31 Dec 1999 12:30 +0000", datetime(1999, 12, 31, 12, 30)),
    ("Wed, 31 Dec 99 12:30:01 +0000", datetime(1999, 12, 31, 12, 30, 1)),
    ("Wed, 31 Dec 24 12:30:01 +0000", datetime(2024, 12, 31, 12, 30, 1)),
    ("Thu, 29 Feb 2024 08:00:00 +0900", datetime(2024, 2, 29, 8)),
    ("Thu, 29 Feb 2023 08:00:00 +0900", None),
    ("Fri, 31 Apr 2024 08:00:00 +0900", None),
    ("Fri, 12 Xyz 2024 08:00:00 +0900", None),
    ("Fri, 12 anf 2024 08:00:00 +0900", None),
    ("Fri, 12 Jan 2024 25:00:00 +0900", None),
    ("2024-01-01T00:00:00Z", None),
    ("yesterday", None),
    ("", None),
    (None, None),
]


def test_parse_feed_date(spark):
    df = spark.createDataFrame([(i, d) for i, (d, _) in enumerate(DATES)], "i int, d string")
    got = df.select("i", dates.parse_feed_date(F.col("d")).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == [moment for _, moment in DATES]


def test_published_ago(spark):
    now = datetime(2024, 5, 1, 12)
    ages = {
        timedelta(seconds=59): "방금 전",
        timedelta(seconds=60): "1분 전",
        timedelta(minutes=59, seconds=59): "59분 전",
        timedelta(minutes=60): "1시간 전",
        timedelta(minutes=1439): "23시간 전",
        timedelta(minutes=1440): "1일 전",
        timedelta(days=3, hours=5): "3일 전",
        timedelta(minutes=-90): "방금 전",
    }
    rows = [(str(now - age), label) for age, label in ages.items()]
    df = spark.createDataFrame(rows, "t string, label string")
    got = df.select("label", dates.published_ago(F.col("t").cast("timestamp_ntz"), now).alias("ago"))
    assert all(r.label == r.ago for r in got.collect())
    empty = spark.range(1).select(dates.published_ago(F.lit(None).cast("timestamp_ntz"), now))
    assert empty.first()[0] == ""


def test_iso_text(spark):
    moments = [datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2, 3, 4, 5, 120000)]
    got = spark.range(1).select(*[dates.iso_text(ntz(m)) for m in moments]).first()
    assert list(got) == [m.isoformat() for m in moments]
