"""Dates, times, UTC offsets and zones of metadata tags as Column expressions.

Wall times are TIMESTAMP_NTZ and offsets seconds as BIGINT, so nothing depends on the session's time zone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EXIF = r"^([0-9]{4}):([0-9]{2}):([0-9]{2}) ([0-9]{2}):([0-9]{2}):([0-9]{2})$"
_ZONE = r"(?:Z|[+-][0-9]{2}(?::?[0-9]{2})?(?::?[0-9]{2})?)?"
_ISO = rf"^([0-9]{{4}})-([0-9]{{2}})-([0-9]{{2}})(?:.([0-9]{{2}}):([0-9]{{2}})(?::([0-9]{{2}})(?:[.,]([0-9]+))?)?{_ZONE})?$"
_ISO_BASIC = rf"^([0-9]{{4}})([0-9]{{2}})([0-9]{{2}})(?:.([0-9]{{2}})([0-9]{{2}})(?:([0-9]{{2}})(?:[.,]([0-9]+))?)?{_ZONE})?$"


def seconds_of(interval: Column) -> Column:
    """Whole seconds of a day-time interval. timestampdiff on NTZ would go by the session's zone."""
    return interval.cast("interval second").cast("bigint")


def wall_time(y: Column, mo: Column, d: Column, h: Column, mi: Column, s: Column, micros: Column | None = None) -> Column:
    """TIMESTAMP_NTZ of text parts, null where they are no date or time of day; empty ones are 0."""
    number = lambda c: F.coalesce(F.nullif(c, F.lit("")).try_cast("int"), F.lit(0))
    day = F.concat_ws("-", y, mo, d).try_cast("date")
    fits = (number(h) < 24) & (number(mi) < 60) & (number(s) < 60) & (number(y) > 0)
    within = F.make_dt_interval(F.lit(0), number(h), number(mi), number(s).cast("decimal(18,6)") + (F.lit(0) if micros is None else micros))
    return F.when(fits, day.cast("timestamp_ntz") + within)


def _parts(text: Column, form: str, n: int) -> list[Column]:
    return [F.regexp_extract(text, form, i + 1) for i in range(n)]


def parse_naive(text: Column) -> Column:
    """Wall time of an EXIF or ISO 8601 text; a zone in it is dropped, not applied. Null for anything else."""
    fraction = lambda t, form: (F.rpad(F.substring(F.regexp_extract(t, form, 7), 1, 6), 6, "0").try_cast("decimal(18,6)") / 1_000_000).cast("decimal(18,6)")
    iso = lambda form: wall_time(*_parts(text, form, 6), F.coalesce(fraction(text, form), F.lit(0)))
    return F.when(text.rlike(_EXIF), wall_time(*_parts(text, _EXIF, 6))).when(text.rlike(_ISO), iso(_ISO)).when(text.rlike(_ISO_BASIC), iso(_ISO_BASIC))


def parse_iso(text: Column) -> Column:
    """A struct (wall, offset_s) of an ISO 8601 text: its wall time, and the seconds of its zone, null without one. Null wall for anything else."""
    zone = F.regexp_extract(F.substring(text, 9, 100), r"(Z|[+-][0-9]{2}(?::?[0-9]{2})?(?::?[0-9]{2})?)$", 1)
    part = lambda at: F.coalesce(F.substring(F.regexp_replace(zone, "[^0-9]", ""), at, 2).try_cast("bigint"), F.lit(0))
    size = part(1) * 3600 + part(3) * 60 + part(5)
    wall = F.when(~text.rlike(_EXIF), parse_naive(text))
    return F.struct(wall.alias("wall"), F.when(wall.isNotNull() & (zone != ""), F.when(zone.startswith("-"), -size).otherwise(size)).alias("offset_s"))


def has_exif_form(text: Column) -> Column:
    """Whether a text has the form of an EXIF date and time, whatever its numbers."""
    return text.rlike(_EXIF)


def path_date(path: Column) -> Column:
    """The date that a path .../photos/YYYY/MM/DD... proposes, as an EXIF text; null without one. The parts are taken as they are."""
    form = r"photos/(....)/(..)/(..)"
    return F.when(path.rlike(form), F.concat(F.concat_ws(":", *_parts(path, form, 3)), F.lit(" 00:00:00")))


def parse_offset(text: Column) -> Column:
    """Seconds of ±HH:MM or Z; null for anything else."""
    form = r"^([+-])([0-9]{2}):([0-9]{2})$"
    sign, h, mi = _parts(text, form, 3)
    value = h.try_cast("bigint") * 3600 + mi.try_cast("bigint") * 60
    return F.when(text == "Z", F.lit(0).cast("bigint")).when(text.rlike(form), F.when(sign == "-", -value).otherwise(value))


def normalize_offset(text: Column) -> Column:
    """±HH:MM of an offset in any of its spellings, else null. The sign of a plain negative zero hour is lost, that after UTC or GMT isn't."""
    t = F.trim(text)
    compact, named, plain = r"^([+-])([0-9]{2})([0-9]{2})$", r"^(?i)(?:UTC|GMT)\s*([+-]?)([0-9]{1,2})(?::?([0-9]{2}))?$", r"^([+-]?)([0-9]{1,2})(?::([0-9]{2}))?$"
    two = lambda form, i: F.lpad(F.coalesce(F.nullif(F.regexp_extract(t, form, i), F.lit("")), F.lit("0")), 2, "0")
    whole = lambda form, sign: F.concat(sign, two(form, 2), F.lit(":"), two(form, 3))
    minus = lambda form: F.regexp_extract(t, form, 1) == "-"
    return (
        F.when(t.rlike(r"^[+-][0-9]{2}:[0-9]{2}$"), t)
        .when(t.rlike(compact), whole(compact, F.regexp_extract(t, compact, 1)))
        .when(t.rlike(named), whole(named, F.when(minus(named), "-").otherwise("+")))
        .when(t.rlike(plain), whole(plain, F.when(minus(plain) & (F.regexp_extract(t, plain, 2).try_cast("int") > 0), "-").otherwise("+")))
    )


def _hhmm(minutes: Column, negative: Column) -> Column:
    size = F.abs(minutes)
    return F.format_string("%s%02d:%02d", F.when(negative, "-").otherwise("+"), F.floor(size / 60).cast("bigint"), F.pmod(size, F.lit(60)).cast("bigint"))


def format_offset_floor(seconds: Column) -> Column:
    """±HH:MM, minutes rounded down."""
    minutes = F.floor(seconds / 60).cast("bigint")
    return _hhmm(minutes, minutes < 0)


def format_offset(seconds: Column) -> Column:
    """±HH:MM, seconds dropped."""
    return _hhmm(F.floor(F.abs(seconds) / 60).cast("bigint"), seconds < 0)


def to_utc(wall: Column, seconds: Column) -> Column:
    return wall - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def stringify_datetime(wall: Column, exif: bool = False) -> Column:
    """YYYY-MM-DD HH:MM:SS[.f] without trailing zeros; every hyphen becomes a colon for EXIF."""
    text = wall.cast("string")
    return F.translate(text, "-", ":") if exif else text


def stringify_date(day: Column, exif: bool = False) -> Column:
    return F.date_format(day, "yyyy:MM:dd" if exif else "yyyy-MM-dd")


def stringify_time(wall: Column) -> Column:
    """HH:MM:SS, with six digits of a fraction if there is one."""
    whole = F.date_format(wall, "HH:mm:ss")
    fraction = F.date_format(wall, "SSSSSS")
    return F.when(fraction == "000000", whole).otherwise(F.concat_ws(".", whole, fraction))


def local_time(zone: Column, utc: Column) -> Column:
    """Wall time of a zone at an instant given as TIMESTAMP_NTZ in UTC."""
    return F.convert_timezone(F.lit("UTC"), zone, utc)


def _after(wall: Column, seconds: int) -> Column:
    return wall + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds).cast("decimal(18,6)"))


def wall_offset(zone: Column, wall: Column) -> Column:
    """UTC offset in seconds of a wall time in a zone: after the change where the wall time is ambiguous or skipped, and up to an hour before a change.

    Evaluated over arrays and lambdas, so that each zone conversion stands once in the plan.
    """
    utc = lambda w: F.convert_timezone(zone, F.lit("UTC"), w)
    at = lambda u: seconds_of(local_time(zone, u) - u)
    # Offsets as before a change, of the wall time, an hour later and an hour earlier; a lambda's variable holds them once.
    early = F.transform(F.array(wall, _after(wall, 3600), _after(wall, -3600)), lambda w: seconds_of(w - utc(w)))
    states = F.transform(F.array(early), lambda e: F.struct(e[0].alias("here"), e[1].alias("later"), e[2].alias("earlier"), at(to_utc(wall, e[0])).alias("kept"), at(_after(to_utc(wall, e[0]), 86_400)).alias("next")))

    def choose(s: Column) -> Column:
        in_gap = s["kept"] != s["here"]
        twice = (s["next"] < s["here"]) & (at(to_utc(wall, s["next"])) == s["next"])
        post = F.when(in_gap, s["kept"]).when(twice, s["next"]).otherwise(s["here"])
        return F.when(post != s["here"], post).when(s["later"] != s["earlier"], s["later"]).otherwise(s["here"])

    return F.transform(states, choose)[0]


def first_of(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return reduce(lambda a, b: F.coalesce(a, b), [F.nullif(c, F.lit("")) for c in columns])


def stringify(df: DataFrame, name: str, exif: bool = False) -> Column:
    """The text of a column of wall times, days, times of day or durations, by the type it has in df; other types are refused."""
    kind = df.schema[name].dataType.simpleString()
    column = F.col(name)
    if kind in ("timestamp_ntz", "timestamp"):
        return stringify_datetime(column, exif)
    if kind == "date":
        return stringify_date(column, exif)
    if kind.startswith("time("):
        return column.cast("string")
    if kind.startswith("interval day") or kind.startswith("interval hour"):
        return format_offset(seconds_of(column))
    raise TypeError(f"{name} is {kind}")


def cozy(df: DataFrame, exif: bool = False) -> DataFrame:
    """df with every column of a temporal type as text, others as they are."""
    temporal = ("timestamp", "timestamp_ntz", "date", "time(", "interval day", "interval hour")
    return df.select(*[stringify(df, c, exif).alias(c) if kind.startswith(temporal) else F.col(c) for c, kind in df.dtypes])
