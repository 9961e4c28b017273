"""ISO-8601 texts: instants, wall clocks and duration labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE = r"\d{4}-\d{2}-\d{2}"
ISO = rf"^{DATE}(?:.\d{{2}}(?::\d{{2}}(?::\d{{2}}(?:[.,]\d+)?)?)?(?:Z|[+-]\d{{2}}(?::?\d{{2}})?)?)?$"


#: A date by week and day of the week, with separators or without; the day may be left out.
WEEK = r"^(\d{4})(?:-W(\d{2})(?:-(\d))?|W(\d{2})(\d)?)(?=\D|$)"


def _by_calendar(text: Column) -> Column:
    """A text that begins with a week date with the calendar's date instead, null if there is no such day; others as they are."""
    part = lambda k: F.regexp_extract(text, WEEK, k)
    number = lambda *ks: F.concat(*map(part, ks)).try_cast("int")
    year, week, day = number(1), number(2, 4), F.coalesce(number(3, 5), F.lit(1))
    monday = F.date_add(F.to_date(F.date_trunc("week", F.make_date(year, F.lit(1), F.lit(4)))), (week - 1) * 7)
    there = (year >= 1) & week.between(1, 53) & day.between(1, 7) & (F.year(F.date_add(monday, 3)) == year)  # a week is of the year of its Thursday
    written = F.concat(F.date_format(F.date_add(monday, day - 1), "yyyy-MM-dd"), F.regexp_replace(text, WEEK, ""))
    return F.when(text.contains("W") & text.rlike(WEEK), F.when(there, written)).otherwise(text)


def _extended(text: Column) -> Column:
    """Trimmed, basic forms (20260606T100000Z) written with separators, week dates as days; null if it is no ISO date or time."""
    t = _by_calendar(F.trim(text))
    dated = F.regexp_replace(t, r"^(\d{4})(\d{2})(\d{2})(?=\D|$)", "$1-$2-$3")
    timed = F.regexp_replace(dated, rf"^({DATE}.\d{{2}})(\d{{2}})(\d{{2}})?", "$1:$2:$3")
    tidy = F.regexp_replace(timed, r":(?=Z|[+-]|$)", "")
    return F.when(tidy.rlike(ISO), F.regexp_replace(F.regexp_replace(tidy, ",", "."), rf"^({DATE}).", "$1T"))


def _whole(text: Column) -> Column:
    """With minutes and seconds after the hour."""
    minutes = F.regexp_replace(_extended(text), r"(T\d{2})(Z|[+-].*)?$", "$1:00$2")
    return F.regexp_replace(minutes, r"(T\d{2}:\d{2})(Z|[+-].*)?$", "$1:00$2")


def instant(text: Column) -> Column:
    """The moment; texts without an offset count as UTC (the session's time zone must be UTC). Null where it cannot be read."""
    colons = F.regexp_replace(_whole(text), r"(T.*[+-]\d{2})(\d{2})$", "$1:$2")
    return F.regexp_replace(colons, r"(T.*[+-]\d{2})$", "$1:00").try_cast("timestamp")


def wall(text: Column) -> Column:
    """'yyyy-MM-dd HH:mm:ss' as the text itself says it, in its own offset; null where it cannot be read."""
    local = F.regexp_replace(_whole(text), r"(T[^Z+-]*)(?:Z|[+-].*)$", "$1")
    clock = F.substring(local, 12, 8)
    whole = F.concat(clock, F.substring(F.lit("00:00:00"), F.length(clock) + 1, F.lit(8)))
    return F.when(instant(text).isNotNull(), F.concat(F.substring(local, 1, 10), F.lit(" "), whole))


def duration_label(start: Column, end: Column) -> Column:
    """'12s', '3m 4s' or '5h 6m' between two texts; 'unknown' if one is missing, unreadable or they are out of order."""
    text = lambda x: F.floor(x).cast("long").cast("string")

    def label(micros: Column) -> Column:
        s = micros / 1_000_000
        hours = F.concat(text(s / 3600), F.lit("h "), text(F.floor(s / 60) % 60), F.lit("m"))
        return F.when(s < 60, F.concat(text(s), F.lit("s"))).when(s < 3600, F.concat(text(s / 60), F.lit("m "), text(F.floor(s) % 60), F.lit("s"))).otherwise(hours)

    # within an array, so that reading the two texts is not written out for every use of their difference
    between = F.array(F.unix_micros(instant(end)) - F.unix_micros(instant(start)))
    return F.coalesce(F.get(F.transform(F.filter(between, lambda m: m >= 0), label), 0), F.lit("unknown"))
