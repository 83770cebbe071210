"""Dates and clocks as Columns. A missing clock stays missing: no hour is made up."""

from __future__ import annotations

import functools

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F


MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"


@functools.cache
def zone_names() -> tuple[str, ...]:
    """The zone names that Spark resolves, as its machine lists them."""
    jvm = SparkContext._active_spark_context._jvm
    return tuple(sorted(jvm.java.lang.String.join(",", jvm.java.time.ZoneId.getAvailableZoneIds()).split(",")))


def month_number(name: Column) -> Column:
    """1 to 12 of an English month name, by its first three letters in any case; null for others."""
    at = F.lit(0)
    three = F.lower(F.substring(name, 1, 3))
    for i, m in reversed(list(enumerate(MONTHS.lower().split("|"), 1))):
        at = F.when(three == m[:3], i).otherwise(at)
    return F.nullif(at, F.lit(0))


def utc_stamp(raw: Column, zone: Column) -> Column:
    """A calendar stamp (yyyyMMdd, yyyyMMddTHHmmss with or without Z, in `zone`) as ISO text: a day stays a day, an hour goes to UTC; null if unreadable.

    An hour without Z in a zone that no machine knows, or in none, is taken as UTC.
    """
    day = F.try_to_date(raw, "yyyyMMdd")
    instant = F.try_to_timestamp(F.rtrim(raw, F.lit("Z")), F.lit("yyyyMMdd'T'HHmmss"))
    known = F.coalesce(zone.isin(*zone_names()), F.lit(False)) & ~raw.endswith("Z")
    at = F.to_utc_timestamp(instant, F.when(known, zone).otherwise("UTC"))
    return F.when(raw.rlike("^[0-9]{8}$"), F.date_format(day, "yyyy-MM-dd")).when(raw.rlike("^[0-9]{8}T[0-9]{6}Z?$"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def stated_night(raw: Column, zone: str) -> Column:
    """struct night, reason of a printed moment: a bare date as it is, an instant with an offset in `zone`, a naive one by its own date."""
    bare, naive, aware = (raw.rlike(p) for p in (r"^\d{4}-\d\d-\d\d$", r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d)?$", r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d)?(Z|[+-]\d\d:\d\d)$"))
    own = F.try_to_date(F.substring(raw, 1, 10), "yyyy-MM-dd")
    night = F.when(bare | naive, own).when(aware, F.to_date(F.from_utc_timestamp(F.try_to_timestamp(raw), zone)))
    return F.struct(night.alias("night"), F.when(raw.isNull(), "no_text").when(night.isNull(), "unreadable").alias("reason"))


def printed_day(text: Column) -> Column:
    """The first day printed in a text as 1998-06-05, June 5, 1998 or 5 June 1998 (months by name or three letters); null if none is a day."""
    name = "((?:" + "|".join(m[:3] + f"(?:{m[3:]})?" if m[3:] else m for m in MONTHS.split("|")) + ")\\.?)"
    get = lambda p, i: F.regexp_extract(text, p, i)
    iso, mdy, dmy = r"\b(\d{4}-\d\d-\d\d)", rf"(?i)\b{name} (\d{{1,2}}),? (\d{{4}})\b", rf"(?i)\b(\d{{1,2}}) {name} (\d{{4}})\b"

    def day(pattern: str, y: int, m: int, d: int) -> Column:
        parts = F.concat_ws("-", get(pattern, y), F.lpad(month_number(get(pattern, m)).cast("string"), 2, "0"), F.lpad(get(pattern, d), 2, "0"))
        return F.try_to_date(parts, "yyyy-MM-dd")

    return F.coalesce(F.try_to_date(F.nullif(get(iso, 1), F.lit("")), "yyyy-MM-dd"), day(mdy, 3, 1, 2), day(dmy, 3, 2, 1))


def printed_clock(text: Column) -> Column:
    """Minutes since midnight of the first clock such as 8pm, 8:30 pm or 20:30; null if none."""
    half = r"(?i)\b(1[0-2]|[1-9])(?::([0-5]\d))? ?([ap])\.?m\b"
    full = r"(?:^|[^0-9:T])([01]?\d|2[0-3]):([0-5]\d)(?:[^0-9:]|$)"
    number = lambda p, i: F.coalesce(F.try_to_number(F.regexp_extract(text, p, i), F.lit("99")).cast("int"), F.lit(0))
    twelve = (number(half, 1) % 12 + F.when(F.lower(F.regexp_extract(text, half, 3)) == "p", 12).otherwise(0)) * 60 + number(half, 2)
    return F.when(text.rlike(half), twelve).when(text.rlike(full), number(full, 1) * 60 + number(full, 2))


def aged(r: Column, elapsed: Column, tau: float) -> Column:
    """Evidence that fades by exp(-elapsed / tau)."""
    return r * F.exp(-elapsed / tau)


def local_night(instant: Column, zone: str) -> Column:
    """The local date of an instant (UTC)."""
    return F.to_date(F.from_utc_timestamp(instant, zone))


def precision(start: Column) -> Column:
    """none, date (midnight) or minute."""
    return F.when(start.isNull(), "none").when((F.hour(start) == 0) & (F.minute(start) == 0) & (F.second(start) == 0), "date").otherwise("minute")


def same_minute(a: Column, b: Column) -> Column:
    return F.date_trunc("minute", a) == F.date_trunc("minute", b)


def weekend(day: Column) -> Column:
    """struct friday, sunday: of the weekend at hand or the next one."""
    friday = F.date_add(day, 4 - F.weekday(day))
    return F.struct(friday.alias("friday"), F.date_add(friday, 2).alias("sunday"))


def pinned_year(month: Column, day: Column, weekday: Column, as_of: Column) -> Column:
    """The only date within [as_of - 7, as_of + 365] with this month, day and ISO weekday; null if none or several."""
    years = F.sequence(F.year(as_of) - 1, F.year(as_of) + 1)
    text = lambda y: F.concat_ws("-", y, F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
    dates = F.transform(years, lambda y: F.try_to_date(text(y), "yyyy-MM-dd"))
    fit = F.filter(dates, lambda d: d.isNotNull() & d.between(F.date_sub(as_of, 7), F.date_add(as_of, 365)) & (F.weekday(d) + 1 == weekday))
    return F.when(F.size(fit) == 1, F.element_at(fit, 1))


def stated_date(text: Column) -> Column:
    """struct value, reason: an ISO or day-first-proof date in the text; ambiguous numeric dates are refused."""
    iso = F.regexp_extract(text, r"(?:^|[^0-9])([0-9]{4}-[0-9]{2}-[0-9]{2})(?:[^0-9]|$)", 1)
    a, b = F.regexp_extract(text, r"(?:^|[^0-9])([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})", 1), F.regexp_extract(text, r"(?:^|[^0-9])([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})", 2)
    year = F.regexp_extract(text, r"(?:^|[^0-9])([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})", 3)
    first, second = F.try_to_number(a, F.lit("99")).cast("int"), F.try_to_number(b, F.lit("99")).cast("int")
    mdy = F.try_to_date(F.concat_ws("-", year, F.lpad(a, 2, "0"), F.lpad(b, 2, "0")), "yyyy-MM-dd")
    dmy = F.try_to_date(F.concat_ws("-", year, F.lpad(b, 2, "0"), F.lpad(a, 2, "0")), "yyyy-MM-dd")
    value = F.when(iso != "", F.try_to_date(iso, "yyyy-MM-dd")).when((a != "") & (second > 12), mdy).when((a != "") & (first > 12), dmy).when((a != "") & (first == second), mdy)
    reason = F.when(text.isNull(), "no_text").when(value.isNotNull(), None).when((iso == "") & (a == ""), "no_full_date").when((first <= 12) & (second <= 12), "ambiguous").otherwise("unparseable")
    return F.struct(value.alias("value"), reason.alias("reason"))


def due_date(text: Column) -> Column:
    """Last day of what a phrase such as "Q3 2025", "H1 2024", "March 2025" or "end of 2026" names, in this order; null for fiscal ones."""
    quarter = F.regexp_extract(text, r"(?i)\bQ([1-4]) ?([0-9]{4})\b", 1)
    q_year = F.regexp_extract(text, r"(?i)\bQ([1-4]) ?([0-9]{4})\b", 2)
    month, m_year = F.regexp_extract(text, rf"(?i)\b({MONTHS}) ([0-9]{{4}})\b", 1), F.regexp_extract(text, rf"(?i)\b({MONTHS}) ([0-9]{{4}})\b", 2)
    half, h_year = F.regexp_extract(text, r"(?i)\bH([12]) ?([0-9]{4})\b", 1), F.regexp_extract(text, r"(?i)\bH([12]) ?([0-9]{4})\b", 2)
    year = F.regexp_extract(text, r"(?i)end of ([0-9]{4})\b", 1)
    number = lambda c: F.try_to_number(c, F.lit("9999")).cast("int")
    fiscal = text.rlike(r"(?i)\b(fiscal|FY)")
    return (
        F.when(fiscal, None).when(quarter != "", F.last_day(F.make_date(number(q_year), number(quarter) * 3, F.lit(1))))
        .when(half != "", F.last_day(F.make_date(number(h_year), number(half) * 6, F.lit(1))))
        .when(month != "", F.last_day(F.make_date(number(m_year), month_number(month), F.lit(1)))).when(year != "", F.make_date(number(year), F.lit(12), F.lit(31)))
    )


# what houses print ---------------------------------------------------------------

_MONTH = "(" + "|".join(m[:3] + (f"(?:{m[3:]})?" if m[3:] else "") + ("|sept" if m == "September" else "") for m in MONTHS.split("|")) + r")\.?"
_WEEKDAY = r"(mon|tue|wed|thu|fri|sat|sun)(?:day|s|sday|nesday|rs|rsday|urday)?\.?,?"
WEEKDAYS = ("mondays", "tuesdays", "wednesdays", "thursdays", "fridays", "saturdays", "sundays")


def _number(text: Column) -> Column:
    return text.try_cast("int")


def printed_years(text: Column) -> Column:
    """The years 20xx that a text prints, each once, in order of size."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b(20\d{2})\b"), 1), lambda y: y.cast("int"))))


def _day(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year.cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")), "yyyy-MM-dd")


def completed(month: Column, day: Column, years: Column, as_of: Column) -> Column:
    """The date of a month and day: in the least of the printed `years`, else this year if it is no more than 14 days gone, else the next; null if there is none."""
    this = _day(F.year(as_of), month, day)
    near = F.when(this >= F.date_sub(as_of, 14), this).otherwise(_day(F.year(as_of) + 1, month, day))
    return F.when(month.isNotNull() & day.isNotNull(), F.when(F.size(years) > 0, _day(F.get(years, F.lit(0)), month, day)).otherwise(near))


def translated_when(text: Column, as_of: Column, page: Column) -> Column:
    """The day that a text prints, in whatever form: 2026-08-01 at its start, Aug 1st (a weekday before it says nothing), 1 August, 8/1, 13/8, 8/1/2026, 8/1/26.

    A range is its first day. The year is that of the text, else the least that `page` prints, else the
    one nearest to `as_of` (completed). No hour is made up. Null for a text without a day, or with one that no calendar has.
    """
    raw = F.trim(text)
    get = lambda p, i: F.regexp_extract(raw, p, i)
    iso, mdy, dmy = r"^(20\d{2}-\d{2}-\d{2})(?:[T ].+)?$", rf"(?i)\b{_MONTH}\s+(\d{{1,2}})(?:st|nd|rd|th)?\b(?!\d)", rf"(?i)\b(\d{{1,2}})(?:st|nd|rd|th)?\s+(?:of\s+)?{_MONTH}(?![a-z])"
    slash = r"\b(\d{1,2})/(\d{1,2})(?:/(20\d{2}|\d{2}))?\b"
    years = F.when(F.size(printed_years(raw)) > 0, printed_years(raw)).otherwise(printed_years(page))
    a, b, y = _number(get(slash, 1)), _number(get(slash, 2)), get(slash, 3)
    swap = (a > 12) & (b <= 12)
    own = F.when(y != "", F.array(_number(F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)))).otherwise(years)
    return (
        F.when(raw.rlike(iso), F.try_to_date(get(iso, 1), "yyyy-MM-dd")).when(raw.rlike(mdy), completed(month_number(get(mdy, 1)), _number(get(mdy, 2)), years, as_of))
        .when(raw.rlike(dmy), completed(month_number(get(dmy, 2)), _number(get(dmy, 1)), years, as_of)).when(raw.rlike(slash), completed(F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b), own, as_of))
    )


def _clocks(window: Column) -> Column:
    """struct start, stop: minutes since midnight of the first range such as 7-9:30 pm, or of the first clock; null where none is printed."""
    span, one = r"(?i)\b(\d{1,2})(?::(\d{2}))?\s*(?:-|–|to)\s*(\d{1,2})(?::(\d{2}))?\s*([ap])\.?m\.?", r"(?i)\b(\d{1,2})(?::(\d{2}))?\s*([ap])\.?m\.?"
    get = lambda p, i: F.regexp_extract(window, p, i)
    minutes = lambda p, h, m, ap: (_number(get(p, h)) % 12 + F.when(F.lower(get(p, ap)) == "p", 12).otherwise(0)) * 60 + F.coalesce(_number(get(p, m)), F.lit(0))
    return F.struct(
        F.when(window.rlike(span), minutes(span, 1, 2, 5)).when(window.rlike(one), minutes(one, 1, 2, 3)).alias("start"), F.when(window.rlike(span), minutes(span, 3, 4, 5)).alias("stop"))


def house_nights(card: Column, page: Column, as_of: Column) -> Column:
    """The nights that a card prints, by date: structs of day, start and stop (minutes since midnight, null where no clock is near).

    A night is a weekday with a month and day, in every year that the card (else the title and headings of its page, else
    `as_of`) prints and in which that day is that weekday; its clock is printed within 48 characters
    behind it, and before the next night. "Continues through Sep 5" with weekdays in the plural
    gives each such weekday from `as_of` to that day. Equal nights count once.
    """
    hit = rf"(?i)\b{_WEEKDAY}\s+{_MONTH}\s+(\d{{1,2}})(?:st|nd|rd|th)?\b"
    heads = F.regexp_replace(F.array_join(F.regexp_extract_all(F.coalesce(page, F.lit("")), F.lit(r"(?is)<(?:title|h[1-3])\b[^>]*>(.*?)</(?:title|h[1-3])>"), 1), " "), "<[^>]+>", " ")
    own = printed_years(card)
    years = F.when(F.size(own) > 0, own).when(F.size(printed_years(heads)) > 0, printed_years(heads)).otherwise(F.array(F.year(as_of)))
    pieces = F.filter(F.split(card, f"(?={hit})"), lambda p: p.rlike(f"^{hit}"))
    weekday = lambda name: F.array_position(F.array(*(F.lit(w[:3]) for w in WEEKDAYS)), F.lower(F.substring(name, 1, 3))) - 1

    def nights(piece: Column) -> Column:
        get = lambda i: F.regexp_extract(piece, f"^{hit}", i)
        clock = _clocks(F.substr(F.regexp_replace(piece, f"^{hit}", ""), F.lit(1), F.lit(48)))
        days = F.filter(F.transform(years, lambda y: _day(y, month_number(get(2)), _number(get(3)))), lambda d: d.isNotNull() & (F.weekday(d) == weekday(get(1))))
        return F.transform(days, lambda d: F.struct(d.alias("day"), clock["start"].alias("start"), clock["stop"].alias("stop")))

    until = rf"(?i)Continues through\s+{_MONTH}\s+(\d{{1,2}})"
    last = _day(F.element_at(years, -1), month_number(F.regexp_extract(card, until, 1)), _number(F.regexp_extract(card, until, 2)))
    named = F.transform(F.regexp_extract_all(card, F.lit(rf"(?i)\b({'|'.join(WEEKDAYS)})\b"), 1), weekday)
    # before the first dated night
    general = _clocks(F.get(F.split(card, f"(?={hit})"), F.lit(0)))
    run = F.when((last >= as_of) & (F.size(named) > 0), F.filter(F.sequence(as_of, last), lambda d: F.array_contains(named, F.weekday(d))))
    runs = F.transform(F.coalesce(run, F.array().cast("array<date>")), lambda d: F.struct(d.alias("day"), general["start"].alias("start"), general["stop"].alias("stop")))
    return F.array_sort(F.array_distinct(F.concat(F.flatten(F.transform(pieces, nights)), runs)))
