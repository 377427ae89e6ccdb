"""Date recognition and schedules; every function takes its instant."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats in the order in which they are tried (months, days and hours may have one digit), whole months, and shapes of dates.
FORMATS = (
    "yyyy-M-d", "yyyy-M-d'T'H:m:s", "yyyy-M-d'T'H:m:s'Z'", "yyyy-M-d'T'H:m:s.SSSSSS'Z'", "yyyy-M-d H:m:s", "yyyy/M/d", "yyyy/M/d H:m:s", "MMMM d, yyyy", "MMM d, yyyy",
    "M/d/yyyy", "M-d-yyyy", "d MMMM yyyy", "d MMM yyyy", "d/M/yyyy", "d.M.yyyy", "d-M-yyyy", "yyyy-M-d H:m", "d.M.yyyy H:m",
)
#: Whole months, which stand for their first day.
MONTHS = (("MMMM yyyy d", " 1"), ("yyyy-M-d", "-1"))
TEXT_PATTERNS = (
    r"(?i)Published:?\s*([A-Za-z]+\s+\d{1,2},?\s+\d{4})", r"(?i)Date:?\s*([A-Za-z]+\s+\d{1,2},?\s+\d{4})", r"(?i)(\d{1,2}\s+[A-Za-z]+\s+\d{4})", r"(?i)([A-Za-z]+\s+\d{1,2},?\s+\d{4})",
    r"(\d{4}-\d{2}-\d{2})", r"(\d{2}/\d{2}/\d{4})", r"(\d{1,2}/\d{1,2}/\d{4})",
)
DATE_SHAPE = r"\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}/\d{1,2}/\d{4}|[A-Za-z]+\s+\d{1,2},?\s+\d{4}|\d{1,2}\s+[A-Za-z]+\s+\d{4}"


def _instant(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def looks_like_date(text: Column) -> Column:
    return F.coalesce((F.length(text) >= 8) & text.rlike(DATE_SHAPE), F.lit(False))


def date_in_text(text: Column) -> Column:
    """The first date in a text by the patterns in order, as it is written."""
    found = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in TEXT_PATTERNS]
    return F.coalesce(*[F.when(looks_like_date(x), x) for x in found])


def parse_date(text: Column, as_of: str) -> Column:
    """The first format that gives an instant from 730 days before `as_of` to one day after; else a relative date."""
    value, now = F.trim(text), _instant(as_of)
    tries = [F.try_to_timestamp(value, F.lit(f)).cast("timestamp_ntz") for f in FORMATS]
    tries += [F.try_to_timestamp(F.concat(value, F.lit(end)), F.lit(f)).cast("timestamp_ntz") for f, end in MONTHS]
    inside = [F.when((t <= now + F.expr("interval 1 day")) & (t >= now - F.expr("interval 730 days")), t) for t in tries]
    return F.coalesce(*inside, relative_date(text, as_of))


def relative_date(text: Column, as_of: str) -> Column:
    """'3 days ago', 'yesterday' and the like; a month has 30 days, a year 365. Numbers of more than six digits are no dates."""
    low, now = F.lower(F.trim(text)), _instant(as_of)
    pattern = r"(?<!\d)(\d{1,6})\s+(second|minute|hour|day|week|month|year)s?\s+ago"
    number, unit = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(low, pattern, 1), F.lit("")), F.lit("999999")).cast("int"), F.lit(0)), F.regexp_extract(low, pattern, 2)
    zero = F.lit(0)
    days = F.when(unit == "day", number).when(unit == "week", number * 7).when(unit == "month", number * 30).when(unit == "year", number * 365).otherwise(zero)
    hours, minutes, seconds = (F.when(unit == u, number).otherwise(zero) for u in ("hour", "minute", "second"))
    ago = now - F.make_dt_interval(days, hours, minutes, seconds.cast("decimal(18,6)"))
    word = lambda w: F.contains(low, F.lit(w))
    return (
        F.when(unit != "", ago).when(word("yesterday"), now - F.expr("interval 1 day")).when(word("today") | word("just now"), now)
        .when(word("last week"), now - F.expr("interval 7 days")).when(word("last month"), now - F.expr("interval 30 days"))
    )


def feed_date(columns: list[Column], as_of: str) -> Column:
    """The first of a feed's date strings that parses (RFC 822 or ISO, any offset), in UTC; else `as_of`."""
    formats = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")
    utc = lambda t: F.convert_timezone(F.current_timezone(), F.lit("UTC"), t.cast("timestamp_ntz"))
    tries = [utc(F.try_to_timestamp(F.regexp_replace(c, r"^[A-Za-z]{3},\s*", ""), F.lit(f))) for c in columns for f in formats]
    return F.coalesce(*tries, _instant(as_of))


def override_date(current: Column, found: Column, always: bool = False) -> Column:
    """A found publication date counts where none is known, or one before 2020."""
    return F.coalesce(found, current) if always else F.when(found.isNotNull() & (current.isNull() | (F.year(current) < 2020)), found).otherwise(current)


def next_run(kind: Column, hour: Column, minute: Column, weekdays: Column, zone: str, interval: Column, as_of: str) -> Column:
    """When a task runs next, in UTC: daily at a local time on ISO weekdays, hourly at a minute, or after an interval."""
    now = F.convert_timezone(F.lit("UTC"), F.lit(zone), _instant(as_of))
    day = F.date_trunc("day", now).cast("timestamp_ntz")
    at = F.make_dt_interval(F.lit(0), hour, minute)
    allowed = lambda t: (F.coalesce(F.size(weekdays), F.lit(0)) <= 0) | F.array_contains(weekdays, F.weekday(t) + 1)
    plus = lambda t, n: t + F.make_dt_interval(n)
    ahead = F.sequence(F.lit(0), F.lit(7))
    daily = F.try_element_at(F.filter(F.transform(ahead, lambda n: plus(day, n) + at), lambda t: (t > now) & allowed(t)), F.lit(1))
    this_hour = F.date_trunc("hour", now).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), minute)
    coming = F.when(this_hour <= now, this_hour + F.expr("interval 1 hour")).otherwise(this_hour)
    later = F.try_element_at(F.filter(F.transform(F.sequence(F.lit(1), F.lit(7)), lambda n: plus(F.date_trunc("day", coming).cast("timestamp_ntz"), n) + F.make_dt_interval(F.lit(0), F.lit(0), minute)), allowed), F.lit(1))
    hourly = F.when(allowed(coming), coming).otherwise(later)
    after = now + F.make_dt_interval(F.lit(0), F.lit(0), F.greatest(F.lit(1), F.least(interval, F.lit(1440))))
    local = F.when(kind == "daily", daily).when(kind == "hourly", hourly).when(kind == "interval", after)
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), local)
