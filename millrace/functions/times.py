"""Times: parsing, day windows and zones."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_ZONE = "Asia/Shanghai"
#: Words for days as distances from today.
DAYS = {"今天": 0, "昨天": -1, "前天": -2, "today": 0, "yesterday": -1, "今日": 0, "昨日": -1, "一昨日": -2, "きょう": 0, "きのう": -1, "おととい": -2}
FORMATS = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm:ss", "d MMM yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "MMM d, yyyy")


def parse(text: Column) -> Column:
    """A timestamp of an ISO or mail-style date; names of weekdays aren't read, a time without a zone is UTC; null if it is none.

    The session's time zone must be UTC.
    """
    x = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3,9},\s*", "")
    x = F.regexp_replace(x, r"\s*(GMT|UTC|UT)$", " +0000")
    x = F.regexp_replace(x, r"([+-]\d{2}):(\d{2})$", "$1$2")
    iso = F.regexp_replace(x, r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.coalesce(F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(iso)), *(F.try_to_timestamp(x, F.lit(f)) for f in FORMATS))


def zone(name: str | None) -> ZoneInfo:
    """A zone by IANA name, UTC+N or +HH:00 (12 hours at most); anything else is the default zone."""
    name = (name or DEFAULT_ZONE).strip()
    try:
        return ZoneInfo(name)
    except (ZoneInfoNotFoundError, ValueError, OSError):
        pass
    if (m := re.fullmatch(r"(?i:UTC)([+-]\d{1,2})", name)) or (m := re.fullmatch(r"([+-]\d{2}):00", name)):
        hours = int(m[1])
        limit = 14 if m[0][:1].isalpha() else 12
        try:
            if -12 <= hours <= limit:
                return ZoneInfo(f"Etc/GMT{-hours:+d}" if hours else "UTC")
        except ZoneInfoNotFoundError:
            pass
    return ZoneInfo(DEFAULT_ZONE)


def day_window(text: str, tz: str | None = None, now: datetime | None = None) -> tuple[datetime, datetime]:
    """The first and the last second of the day that a word or YYYY-MM-DD names in a zone."""
    where = zone(tz)
    word = text.strip()
    if word.lower() in DAYS:
        day = (now or datetime.now(where)).astimezone(where).date() + timedelta(days=DAYS[word.lower()])
    elif re.fullmatch(r"\d{4}-\d{2}-\d{2}", word):
        day = date.fromisoformat(word)
    else:
        raise ValueError(f"not a day: {text!r}")
    start = datetime(day.year, day.month, day.day, tzinfo=where)
    return start, start.replace(hour=23, minute=59, second=59)


def inside(ts: Column, since: datetime | None, until: datetime | None) -> Column:
    """Inside both ends; unknown times are inside, and so is everything without a window."""
    if since is None or until is None:
        return F.lit(True)
    return ts.isNull() | ts.between(F.lit(since), F.lit(until))


def gmt8_date(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, "GMT+8"))


def gmt8_clock(ts: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, "GMT+8"), "HH:mm")


def on_gmt8_day(ts: Column, day: str) -> Column:
    """A predicate on UTC times that lie on a day of GMT+8, half open, so that it reaches the scan."""
    start = datetime.fromisoformat(day) - timedelta(hours=8)
    return (ts >= F.lit(start)) & (ts < F.lit(start + timedelta(days=1)))


def close(a: Column, b: Column, hours: float) -> Column:
    """Whether two times lie within so many hours; unknown times are close to all."""
    return F.coalesce(F.abs(F.unix_micros(a) - F.unix_micros(b)) <= hours * 3.6e9, F.lit(True))


def age_hours(ts: Column, reference: Column) -> Column:
    return (F.unix_micros(reference) - F.unix_micros(ts)) / 3.6e9
