"""Written dates against the common parsing library, over random dates in many forms."""

import datetime
import random

import pytest

from folioloom.functions.coerce import to_date, written_date

parser = pytest.importorskip("dateutil.parser")

FORMS = (
    "%d %B %Y", "%B %d, %Y", "%b %d %Y", "%a, %d %b %Y", "%d-%b-%Y", "%d/%b/%y", "%m/%d/%y", "%Y %B %d", "%B %Y %d", "%d %Y %B", "%y %d %B", "%d %m %Y", "%m %d %Y", "%d.%m.%y", "%A %d of %B %y",
    "%b. %d %y %H:%M", "%I:%M %p %d %B %Y", "%d %B %Y at %H:%M:%S", "%Y-%m-%d %H:%M", "%y-%m-%d", "%b-%d-%y", "%d%b%Y", "%B %dth, %Y", "%Y/%d/%m", "%d nonsense %B %Y",
)


def test_written_dates(spark):
    rng = random.Random(1)
    texts = []
    for _ in range(700):
        d = datetime.datetime(rng.randint(1980, 2069), rng.randint(1, 12), rng.randint(1, 28), rng.randint(0, 23), rng.randint(0, 59))
        texts.append(d.strftime(rng.choice(FORMS)))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", written_date(df["t"]).alias("d")).collect():
        try:
            want = parser.parse(r["t"], dayfirst=False).strftime("%Y-%m-%d")
        except (ValueError, OverflowError):
            want = None
        assert r["d"] == want, r["t"]


def test_missing_parts(spark):
    """What the library fills up from today's date is no date here."""
    texts = ["August 16", "00:57", "2024", "March", "", "  ", "12 March March 2024", "1 2 3 4", None, "99999999999 March 1"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r["d"] for r in df.select(written_date(df["t"]).alias("d")).collect()] == [None] * len(texts)
    df = spark.createDataFrame([("2024年3月5日",), ("5 May 2021",), ("2024-02-30",), ("31/31/2020",)], "t string")
    assert [r["d"] for r in df.select(to_date(df["t"]).alias("d")).collect()] == ["2024-03-05", "2021-05-05", "2024-02-30", None]
