"""Calendar periods as text keys: yyyy-MM-dd, yyyy-Www, yyyy-MM, yyyy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
LEVELS = ("day", "week", "month", "year")


def day_key(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def week_key(c: Column) -> Column:
    """ISO week; its year is that of its Thursday."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), c).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(c).cast("string"), 2, "0"))


def month_key(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")


def year_key(c: Column) -> Column:
    return F.date_format(c, "yyyy")


def level(key: Column) -> Column:
    return F.when(key.rlike(DAY), "day").when(key.rlike(r"^[0-9]{4}-W[0-9]{2}$"), "week").when(key.rlike(r"^[0-9]{4}-[0-9]{2}$"), "month").when(key.rlike(r"^[0-9]{4}$"), "year")


def level_rank(key: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LEVELS)), level(key))


def week_monday(key: Column) -> Column:
    """Monday of an ISO week: that of the week of January 4th, and so many weeks on."""
    jan4 = F.to_date(F.concat(key.substr(1, 4), F.lit("-01-04")))
    return F.date_add(F.trunc(jan4, "week"), (key.substr(7, 2).cast("int") - 1) * 7)


def last_day_of(key: Column) -> Column:
    """The last day of a period."""
    return (
        F.when(level(key) == "day", F.to_date(key))
        .when(level(key) == "week", F.date_add(week_monday(key), 6))
        .when(level(key) == "month", F.last_day(F.to_date(F.concat(key, F.lit("-01")))))
        .when(level(key) == "year", F.to_date(F.concat(key, F.lit("-12-31"))))
    )


def ancestors(day: Column) -> Column:
    """Week, month and year of a date."""
    return F.array(week_key(day), month_key(day), year_key(day))


def complete(key: Column, today: Column) -> Column:
    """Whether a period lies wholly before a date."""
    return last_day_of(key) < today


def local_instant(date: Column, time: Column, zone: Column) -> Column:
    """The instant (UTC) of a local date and HH:mm in an IANA zone; null unless date, time and zone have the right form."""
    ok = date.rlike(r"^\d{4}-\d{2}-\d{2}$") & time.rlike(r"^([01]\d|2[0-3]):[0-5]\d$") & zone.rlike(r"^(UTC|[A-Za-z_]+(/[A-Za-z0-9_+-]+)+)$")
    return F.when(ok, F.to_utc_timestamp(F.try_to_timestamp(F.concat_ws(" ", date, time), F.lit("yyyy-MM-dd HH:mm")), zone))


def day_start(date: Column, zone: Column) -> Column:
    return local_instant(date, F.lit("00:00"), zone)


def safe_timestamp(value: Column, now: Column) -> Column:
    """A time from text, and ``now`` for what isn't one."""
    return F.coalesce(F.try_to_timestamp(value), now)
