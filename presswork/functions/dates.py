"""Feed dates, age labels and ISO text."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from presswork.session import ntz

# The age labels shown to readers, smallest unit first.
LABEL_NOW = "방금 전"
LABEL_MINUTES = "분 전"
LABEL_HOURS = "시간 전"
LABEL_DAYS = "일 전"

_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_FEED_DATE = (
    r"(\d{1,2})\s+([A-Za-z]{3})[a-z]*\.?\s+(\d{4}|\d{2})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?"
)


def parse_feed_date(text: Column) -> Column:
    """RFC 2822 date as naive local time: the zone is dropped, not converted.

    Anything unreadable, or a day that does not exist, is NULL.
    """

    def part(i):
        return F.regexp_extract(text, _FEED_DATE, i)

    def number(i):
        return part(i).try_cast("int")

    month = F.when(
        part(2) != "", (F.instr(F.lit(_MONTHS), F.lower(part(2))) + 2) / 3
    )
    short_year = F.length(part(3)) == 2
    year = number(3) + F.when(~short_year, 0).when(number(3) > 68, 1900).otherwise(2000)
    seconds = F.coalesce(number(6), F.lit(0))
    return F.when(
        month == F.floor(month),
        F.try_make_timestamp_ntz(
            year, month.cast("int"), number(1), number(4), number(5), seconds
        ),
    )


def published_ago(published_at: Column, as_of: datetime | str) -> Column:
    """How long ago, in the largest whole unit; a future time counts as just now."""
    minutes = F.timestamp_diff("MINUTE", published_at, ntz(as_of))
    return (
        F.when(published_at.isNull(), F.lit(""))
        .when(minutes < 1, F.lit(LABEL_NOW))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit(LABEL_MINUTES)))
        .when(
            minutes < 1440,
            F.concat(F.floor(minutes / 60).cast("string"), F.lit(LABEL_HOURS)),
        )
        .otherwise(F.concat(F.floor(minutes / 1440).cast("string"), F.lit(LABEL_DAYS)))
    )


def iso_text(moment: Column) -> Column:
    """ISO 8601 text; the fraction shows only when it is not zero, then in full."""
    text = F.replace(moment.cast("string"), F.lit(" "), F.lit("T"))
    return F.when(F.instr(text, ".") > 0, F.rpad(text, 26, "0")).otherwise(text)
