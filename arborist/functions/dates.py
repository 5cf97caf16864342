"""Dates, times and durations of XPath as Column expressions.

A moment is STRUCT<micros BIGINT, tz INT>: local fields as microseconds since 1970 and the time zone in minutes, null
where there is none. Durations are months (yearMonthDuration) or microseconds (dayTimeDuration) as BIGINT.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from arborist.xdm import XdmError

SECOND = 1_000_000
DAY = 86_400 * SECOND
_TZ = r"(Z|[+-](?:0[0-9]|1[0-3]):[0-5][0-9]|[+-]14:00)?"
_YMD = r"(-?(?:[1-9][0-9]{3,}|0[0-9]{3}))-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])"
_HMS = r"((?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]+)?|24:00:00(?:\.0+)?)"

#: Lexical forms, anchored.
DATE = rf"^\s*{_YMD}{_TZ}\s*$"
DATETIME = rf"^\s*{_YMD}T{_HMS}{_TZ}\s*$"
TIME = rf"^\s*{_HMS}{_TZ}\s*$"
YEAR_MONTH = r"^\s*(-)?P(?=[0-9])(?:([0-9]+)Y)?(?:([0-9]+)M)?\s*$"
DAY_TIME = r"^\s*(-)?P(?=[0-9T])(?:([0-9]+)D)?(?:T(?=[0-9.])(?:([0-9]+)H)?(?:([0-9]+)M)?(?:([0-9]+(?:\.[0-9]+)?)S)?)?\s*$"
DURATION = r"^\s*-?P(?=.)(?:[0-9]+Y)?(?:[0-9]+M)?(?:[0-9]+D)?(?:T(?=.)(?:[0-9]+H)?(?:[0-9]+M)?(?:[0-9]+(?:\.[0-9]+)?S)?)?\s*$"


def moment(micros: Column, tz: Column | int | None = None) -> Column:
    zone = tz if isinstance(tz, Column) else F.lit(tz)
    return F.when(micros.isNotNull(), F.struct(micros.cast("bigint").alias("micros"), zone.cast("int").alias("tz")))


def now() -> Column:
    """The moment of the query in UTC, the same for all rows."""
    return moment(F.unix_micros(F.current_timestamp()), 0)


def from_timestamp(c: Column, tz: int | None = None) -> Column:
    """A moment of a TIMESTAMP_NTZ or DATE column."""
    return moment(_micros(c), tz)


def _micros(c: Column) -> Column:
    """Microseconds since 1970 of a timestamp without a zone (exact, in the JVM)."""
    t = c.cast("timestamp_ntz")
    days = F.datediff(t.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    inside = F.hour(t) * 3_600_000_000 + F.minute(t) * 60_000_000 + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("bigint")
    return days * DAY + inside


def timestamp(m: Column) -> Column:
    """The local fields of a moment as TIMESTAMP_NTZ."""
    days = F.floor((m["micros"] - F.pmod(m["micros"], F.lit(DAY))) / DAY)
    inside = F.pmod(m["micros"], F.lit(DAY))
    base = F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int")).cast("timestamp_ntz")
    return base + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (inside.cast("decimal(20,0)") / SECOND).cast("decimal(18,6)"))


def _zone(text: Column) -> Column:
    sign = F.when(F.substr(text, F.lit(1), F.lit(1)) == "-", -1).otherwise(1)
    minutes = F.substr(text, F.lit(2), F.lit(2)).try_cast("int") * 60 + F.substr(text, F.lit(5), F.lit(2)).try_cast("int")
    return F.when(text == "Z", 0).when(text != "", sign * minutes)


def parse_date(c: Column) -> Column:
    """xs:date of a string; null where it is none."""
    ok = F.rlike(c, F.lit(DATE))
    day = F.regexp_extract(c, r"(-?\d{4,}-\d\d-\d\d)", 1).try_cast("date")
    return F.when(ok, moment(F.datediff(day, F.lit("1970-01-01").cast("date")).cast("bigint") * DAY, _zone(F.regexp_extract(c, DATE, 4))))


def parse_datetime(c: Column) -> Column:
    ok = F.rlike(c, F.lit(DATETIME))
    day = F.regexp_extract(c, r"(-?\d{4,}-\d\d-\d\d)", 1).try_cast("date")
    inside = _time_micros(F.regexp_extract(c, DATETIME, 4))
    return F.when(ok, moment(F.datediff(day, F.lit("1970-01-01").cast("date")).cast("bigint") * DAY + inside, _zone(F.regexp_extract(c, DATETIME, 5))))


def _time_micros(t: Column) -> Column:
    part = lambda a, n: F.substr(t, F.lit(a), F.lit(n)).try_cast("int")
    seconds = F.substr(t, F.lit(7)).try_cast("decimal(18,6)")
    return part(1, 2).cast("bigint") * 3_600_000_000 + part(4, 2) * 60_000_000 + (seconds * SECOND).cast("bigint")


def parse_time(c: Column) -> Column:
    ok = F.rlike(c, F.lit(TIME))
    return F.when(ok, moment(F.pmod(_time_micros(F.regexp_extract(c, TIME, 1)), F.lit(DAY)), _zone(F.regexp_extract(c, TIME, 2))))


def parse_year_month(c: Column) -> Column:
    """Months of an xs:yearMonthDuration; null where it is none."""
    part = lambda k: F.coalesce(F.regexp_extract(c, YEAR_MONTH, k).try_cast("bigint"), F.lit(0))
    sign = F.when(F.regexp_extract(c, YEAR_MONTH, 1) == "-", -1).otherwise(1)
    return F.when(F.rlike(c, F.lit(YEAR_MONTH)), sign * (part(2) * 12 + part(3)))


def parse_day_time(c: Column) -> Column:
    """Microseconds of an xs:dayTimeDuration; null where it is none."""
    part = lambda k: F.coalesce(F.regexp_extract(c, DAY_TIME, k).try_cast("bigint"), F.lit(0))
    seconds = F.coalesce((F.regexp_extract(c, DAY_TIME, 5).try_cast("decimal(24,6)") * SECOND).cast("bigint"), F.lit(0))
    sign = F.when(F.regexp_extract(c, DAY_TIME, 1) == "-", -1).otherwise(1)
    return F.when(F.rlike(c, F.lit(DAY_TIME)), sign * (part(2) * DAY + part(3) * 3_600_000_000 + part(4) * 60_000_000 + seconds))


# components

def year(m: Column) -> Column:
    return F.year(timestamp(m))


def month(m: Column) -> Column:
    return F.month(timestamp(m))


def day(m: Column) -> Column:
    return F.dayofmonth(timestamp(m))


def hours(m: Column) -> Column:
    return F.hour(timestamp(m))


def minutes(m: Column) -> Column:
    return F.minute(timestamp(m))


def seconds(m: Column) -> Column:
    """Seconds with their fraction, DECIMAL(8,6)."""
    return (F.pmod(m["micros"], F.lit(60 * SECOND)).cast("decimal(20,0)") / SECOND).cast("decimal(8,6)")


def timezone(m: Column) -> Column:
    """Microseconds of the time zone; null where there is none."""
    return m["tz"].cast("bigint") * 60 * SECOND


def years_from_months(months: Column) -> Column:
    return _quotient(months, 12)


def months_from_months(months: Column) -> Column:
    return months % 12


def _quotient(a: Column, b: int) -> Column:
    return ((a - a % b) / b).cast("bigint")


def days_from_duration(micros: Column) -> Column:
    return _quotient(micros, DAY)


def hours_from_duration(micros: Column) -> Column:
    return _quotient(micros % DAY, 3_600_000_000)


def minutes_from_duration(micros: Column) -> Column:
    return _quotient(micros % 3_600_000_000, 60_000_000)


def seconds_from_duration(micros: Column) -> Column:
    return ((micros % 60_000_000).cast("decimal(20,0)") / SECOND).cast("decimal(8,6)")


def adjust(m: Column, to: Column | int | None) -> Column:
    """adjust-*-to-timezone: attach, shift or (to None) take away; minutes beyond 14 hours raise FODT0003."""
    if to is None:
        return moment(m["micros"], None)
    zone = to if isinstance(to, Column) else F.lit(to)
    if isinstance(to, int) and abs(to) > 840:
        raise XdmError("FODT0003", "time zone beyond 14 hours")
    shifted = F.when(m["tz"].isNull(), m["micros"]).otherwise(m["micros"] + (zone - m["tz"]).cast("bigint") * 60 * SECOND)
    return moment(shifted, zone)


def adjust_date(m: Column, to: int | None) -> Column:
    moved = adjust(m, to)
    return moment(moved["micros"] - F.pmod(moved["micros"], F.lit(DAY)), moved["tz"])


def adjust_time(m: Column, to: int | None) -> Column:
    moved = adjust(m, to)
    return moment(F.pmod(moved["micros"], F.lit(DAY)), moved["tz"])


def instant(m: Column, implicit: int = 0) -> Column:
    """Microseconds in UTC, with the implicit time zone where there is none."""
    return m["micros"] - F.coalesce(m["tz"], F.lit(implicit)).cast("bigint") * 60 * SECOND


def combine(d: Column, t: Column) -> Column:
    """fn:dateTime: FORG0008 where both have time zones that differ."""
    clash = (d["tz"] != t["tz"]) & d["tz"].isNotNull() & t["tz"].isNotNull()
    micros = F.when(clash, F.raise_error(F.lit("FORG0008: time zones differ")).cast("bigint")).otherwise(d["micros"] + t["micros"])
    return moment(micros, F.coalesce(d["tz"], t["tz"]))


def add_months(m: Column, months: Column) -> Column:
    """A moment plus a yearMonthDuration; days beyond the month's end are cut to it."""
    inside = F.pmod(m["micros"], F.lit(DAY))
    moved = F.add_months(timestamp(m).cast("date"), months.cast("int"))
    return moment(F.datediff(moved, F.lit("1970-01-01").cast("date")).cast("bigint") * DAY + inside, m["tz"])


def add_micros(m: Column, micros: Column) -> Column:
    return moment(m["micros"] + micros, m["tz"])


def difference(a: Column, b: Column) -> Column:
    """Microseconds of a dayTimeDuration between two moments; no time zone counts as UTC."""
    return instant(a) - instant(b)


def canonical(m: Column, kind: str = "dateTime") -> Column:
    """Text of a moment."""
    t = timestamp(m)
    whole = F.pmod(m["micros"], F.lit(SECOND))
    fraction = F.when(whole == 0, "").otherwise(F.concat(F.lit("."), F.rtrim(F.lpad(whole.cast("string"), 6, "0"), F.lit("0"))))
    z = m["tz"]
    sign = F.when(z < 0, "-").otherwise("+")
    pad = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
    zone = F.when(z.isNull(), "").when(z == 0, "Z").otherwise(F.concat(sign, pad(F.floor(F.abs(z) / 60)), F.lit(":"), pad(F.abs(z) % 60)))
    pattern = {"dateTime": "yyyy-MM-dd'T'HH:mm:ss", "date": "yyyy-MM-dd", "time": "HH:mm:ss"}[kind]
    return F.concat(F.date_format(t, pattern), fraction if kind != "date" else F.lit(""), zone)


_MONTHS = "January February March April May June July August September October November December".split()
_DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()


def _named(names: list[str], k: Column, style: str, width: int | None) -> Column:
    words = [{"N": n.upper(), "n": n.lower(), "Nn": n}[style] for n in names]
    words = [w[:width] if width and width < len(w) else w for w in words]
    return F.get(F.array(*map(F.lit, words)), k - 1)


def format_moment(m: Column, text: str) -> Column:
    """format-dateTime, -date and -time: components Y M D d F H h m s f P Z z of a picture; others raise FOFD1340."""
    parts: list[Column] = []
    at = 0
    t = timestamp(m)
    for x in re.finditer(r"\[\[|\]\]|\[([^\[\]]*)\]|[^\[\]]+|[\[\]]", text):
        if x[0] in ("[[", "]]"):
            parts.append(F.lit(x[0][0]))
        elif x[1] is None:
            if x[0] in "[]":
                raise XdmError("FOFD1340", f"bad picture {text!r}")
            parts.append(F.lit(x[0]))
        else:
            parts.append(_component(m, t, re.sub(r"\s+", "", x[1]), text))
        at = x.end()
    if at != len(text):
        raise XdmError("FOFD1340", f"bad picture {text!r}")
    return F.concat(*parts) if parts else F.lit("")


def format_in(m: Column, text: str, language: str | None, calendar: str | None) -> Column:
    """format_moment for a language and calendar: English and the Gregorian calendar; others are named before what is used instead."""
    made = format_moment(m, text)
    calendar = (calendar or "AD").rpartition(":")[2]
    if not re.fullmatch(r"[A-Za-z][\w.\-]*", calendar):
        raise XdmError("FOFD1340", f"bad calendar {calendar!r}")
    said = "" if calendar in ("AD", "ISO", "CE") else "[Calendar: AD]"
    if language and not re.match(r"en(-|$)", language, re.I):
        said = "[Language: en]" + said
    return F.concat(F.lit(said), made) if said else made


def _component(m: Column, t: Column, spec: str, text: str) -> Column:
    found = re.fullmatch(r"([YMDdFHhmsfPZz])([0-9]+|Nn|N|n|I|i)?(?:o|t)?(?:,(\*|[0-9]+)(?:-(\*|[0-9]+))?)?", spec)
    if found is None:
        raise XdmError("FOFD1340", f"bad component [{spec}] in {text!r}")
    what, style, low, high = found.groups()
    least = len(style) if style and style.isdigit() else {"m": 2, "s": 2}.get(what, 1)
    if low and low != "*":
        least = int(low)
    most = int(high) if high and high != "*" else None
    if what in "Zz":
        z = m["tz"]
        sign = F.when(z < 0, "-").otherwise("+")
        pad = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
        zone = F.concat(sign, pad(F.floor(F.abs(z) / 60)), F.lit(":"), pad(F.abs(z) % 60))
        return F.coalesce(F.concat(F.lit("GMT" if what == "z" else ""), zone), F.lit(""))
    if what == "P":
        return F.when(F.hour(t) < 12, "AM" if style == "N" else "am").otherwise("PM" if style == "N" else "pm")
    if what == "M" and style in ("N", "n", "Nn"):
        return _named(_MONTHS, F.month(t), style, most)
    if what == "F" and (style in ("N", "n", "Nn") or style is None):
        return _named(_DAYS, F.weekday(t) + 1, style or "n", most)
    if what == "f":
        digits = F.lpad(F.pmod(m["micros"], F.lit(SECOND)).cast("string"), 6, "0")
        return F.substr(digits, F.lit(1), F.lit(max(least, 1)))
    value = {
        "Y": F.year(t), "M": F.month(t), "D": F.dayofmonth(t), "d": F.dayofyear(t), "F": F.weekday(t) + 1, "H": F.hour(t),
        "h": (F.hour(t) + 11) % 12 + 1, "m": F.minute(t), "s": F.second(t),
    }[what]
    digits = value.cast("string")
    if style in ("I", "i"):
        from arborist.operators.numbering import roman

        return roman(value, style)
    padded = F.lpad(digits, least, "0") if least > 1 else digits
    shown = F.when(F.char_length(digits) >= least, digits).otherwise(padded)
    if what == "Y" and (most or style == "01"):
        shown = F.substr(shown, -F.lit(most or 2))
    return shown
