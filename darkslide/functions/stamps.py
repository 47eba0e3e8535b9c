"""Reading one time stamp as written: its day, its time of day, and the zone it states."""

from __future__ import annotations

import datetime as dt
import re
from fractions import Fraction
from functools import lru_cache
from typing import NamedTuple
from zoneinfo import ZoneInfo

# Zone abbreviations with one meaning in cameras' texts, in minutes east of UTC. Those with several meanings (IST, CST, BST in Bangladesh's sense) are absent but for BST.
ZONE_MINUTES = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180, "EAT": 180,
    "NPT": 345, "JST": 540, "KST": 540, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
#: Offsets in use reach from 12 hours west to 14 hours east.
WEST, EAST = -12 * 60, 14 * 60

_TIME = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?(?:\s*(?P<half>[AaPp][Mm]))?"
_ZONE = r"\s*(?P<zone>[A-Za-z]{1,5}|(?:[A-Za-z]{3})?\s*[+\-−]\d{1,2}(?::?\d{2})?)?(?:\[(?P<name>[^\]]+)\])?"
_FORMS = [
    re.compile(rf"(?P<y>\d{{4}})(?P<sep>[:/.\-])(?P<mo>\d{{1,2}})(?P=sep)(?P<d>\d{{1,2}})(?:[T\s]\s*{_TIME}{_ZONE})?", re.ASCII),
    re.compile(rf"(?P<y>\d{{4}})(?P<mo>\d{{2}})(?P<d>\d{{2}})(?:T?(?P<h>\d{{2}})(?P<mi>\d{{2}})(?:(?P<s>\d{{2}})(?:[.,](?P<f>\d+))?)?{_ZONE})?", re.ASCII),
    re.compile(rf"(?P<d>\d{{1,2}})\.(?P<mo>\d{{1,2}})\.(?P<y>\d{{4}})(?:\s+{_TIME}{_ZONE})?", re.ASCII),
    re.compile(rf"(?:[A-Za-z]{{3,9}},?\s+)?(?P<d>\d{{1,2}})\s+(?P<mon>[A-Za-z]{{3,9}})\.?\s+(?P<y>\d{{4}})(?:,?\s+{_TIME}{_ZONE})?", re.ASCII),
    re.compile(rf"(?P<mon>[A-Za-z]{{3,9}})\.?\s+(?P<d>\d{{1,2}}),?\s+(?P<y>\d{{4}})(?:,?\s+{_TIME}{_ZONE})?", re.ASCII),
]
_EPOCH = re.compile(r"\d{9,10}|\d{12,13}|\d{15,16}", re.ASCII)
_OFFSET = re.compile(r"(?:UTC|GMT)?\s*([+\-−])(\d{1,2})(?::?(\d{2}))?", re.ASCII | re.IGNORECASE)
_CLOCK = re.compile(r"(\d{1,2}):(\d{1,2})(?::(\d{1,2}(?:\.\d+)?))?|(\d{1,2}) (\d{1,2})(?: (\d{1,2}(?:\.\d+)?))?", re.ASCII)
_RATIONAL = re.compile(r"(\d+)/(\d+)[ ,]+(\d+)/(\d+)(?:[ ,]+(\d+)/(\d+))?", re.ASCII)
_START = dt.datetime(1970, 1, 1)


class Stamp(NamedTuple):
    """day is None where the text states no day of the calendar; micros, of the day, where it states no possible time of day."""

    day: dt.date | None
    micros: int | None = None
    minutes: int | None = None  # stated offset
    name: str | None = None  # stated zone, where no offset is
    unknown_zone: bool = False
    instant: int | None = None  # numbers of seconds


def offset_minutes(text: str | None) -> int | None:
    """Minutes east of UTC that an offset text states, in any of its spellings; None for other texts and offsets that no clock has."""
    if text is None:
        return None
    text = text.strip()
    if text.upper() in ("Z", "UTC", "GMT"):
        return 0
    if not (m := _OFFSET.fullmatch(text)):
        return None
    minutes = int(m[2]) * 60 + int(m[3] or 0)
    if int(m[3] or 0) > 59:
        return None
    minutes = minutes if m[1] == "+" else -minutes
    return minutes if WEST <= minutes <= EAST else None


def _micros(h: int, mi: int, s: int, fraction: str | None) -> int | None:
    if h > 23 or mi > 59 or s > 59:
        return None
    return ((h * 60 + mi) * 60 + s) * 1_000_000 + (int((fraction + "000000")[:6]) if fraction else 0)


def read_stamp(text: str | None) -> Stamp | None:
    """What text states, or None for nulls, blanks, placeholders and anything that is no date."""
    text = (text or "").strip()
    if not text or not any(c.isdigit() for c in text):
        return None
    if _EPOCH.fullmatch(text):
        return Stamp(None, instant=int(text) * {9: 10**6, 10: 10**6, 12: 10**3, 13: 10**3}.get(len(text), 1))
    for form in _FORMS:
        if m := form.fullmatch(text):
            break
    else:
        return None
    g = m.groupdict()
    month = int(g["mo"]) if g.get("mo") else MONTHS.index(g["mon"][:3].lower()) + 1 if g["mon"][:3].lower() in MONTHS else 0
    try:
        day = dt.date(int(g["y"]), month, int(g["d"]))
    except ValueError:
        return Stamp(None)
    if not g.get("h"):
        return Stamp(day)
    hour, half = int(g["h"]), (g.get("half") or "").lower()
    if half:
        hour = hour % 12 + 12 * (half == "pm") if 1 <= hour <= 12 else 99
    micros = _micros(hour, int(g["mi"]), int(g["s"] or 0), g.get("f"))
    zone, name = g.get("zone"), g.get("name")
    if zone:
        minutes = ZONE_MINUTES.get(zone.upper(), None)
        minutes = offset_minutes(zone) if minutes is None else minutes
        return Stamp(day, micros, minutes, unknown_zone=minutes is None)
    return Stamp(day, micros, name=name)


@lru_cache(1_000)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except (KeyError, ValueError, OSError):
        return None


def zone_minutes(wall: dt.datetime, name: str) -> float | None:
    """Offset that zone name has at the wall time; None where the zone is unknown, or has that wall time twice or never."""
    if (zone := _zone(name)) is None:
        return None
    early, late = wall.replace(tzinfo=zone).utcoffset(), wall.replace(tzinfo=zone, fold=1).utcoffset()
    return early.total_seconds() / 60 if early == late else None


def instant(text: str | None, companion: str | None, zone: str | None) -> int | None:
    """Microseconds since 1970 UTC of a wall-clock text: its own zone decides, then the companion's offset, then the named zone."""
    stamp = read_stamp(text)
    if stamp is None:
        return None
    if stamp.instant is not None:
        return stamp.instant
    if stamp.day is None or stamp.micros is None or stamp.unknown_zone:
        return None
    wall = dt.datetime.combine(stamp.day, dt.time()) + dt.timedelta(microseconds=stamp.micros)
    minutes: float | None = stamp.minutes
    if minutes is None and stamp.name:
        minutes = zone_minutes(wall, stamp.name)
        if minutes is None:
            return None
    if minutes is None:
        minutes = offset_minutes(companion)
    if minutes is None and zone:
        minutes = zone_minutes(wall, zone)
    if minutes is None:
        return None
    since = wall - _START
    return (since.days * 86_400 + since.seconds) * 1_000_000 + since.microseconds - round(minutes * 60_000_000)


def clock_micros(text: str | None) -> int | None:
    """Microseconds of the day of a UTC time stamp: colons, spaces or three fractions."""
    text = (text or "").strip()
    if m := _RATIONAL.fullmatch(text):
        parts = [int(x) if x else None for x in m.groups()]
        if 0 in (parts[1], parts[3], parts[5]):
            return None
        h, mi, s = Fraction(parts[0], parts[1]), Fraction(parts[2], parts[3]), Fraction(parts[4] or 0, parts[5] or 1)
        if h >= 24 or mi >= 60 or s >= 60:
            return None
        return round((h * 3600 + mi * 60 + s) * 1_000_000)
    if not (m := _CLOCK.fullmatch(text)):
        return None
    h, mi, s = (m[1], m[2], m[3]) if m[1] else (m[4], m[5], m[6])
    whole, _, fraction = (s or "0").partition(".")
    return _micros(int(h), int(mi), int(whole), fraction or None)


def utc_instant(text: str | None, companion: str | None) -> int | None:
    """As instant, of a date in UTC: its time is its own, or else the companion's time of day."""
    stamp = read_stamp(text)
    if stamp is None or stamp.day is None:
        return None if stamp is None else stamp.instant
    if stamp.micros is not None:
        return instant(text, "Z", None)
    clock = clock_micros(companion)
    if clock is None:
        return None
    return (stamp.day - _START.date()).days * 86_400_000_000 + clock


def written_day(text: str | None) -> str | None:
    """The calendar day a text states, as YYYY-MM-DD, or "" for a number of seconds, which states none but isn't missing."""
    stamp = read_stamp(text)
    if stamp is None:
        return None
    if stamp.instant is not None:
        return ""
    return stamp.day.isoformat() if stamp.day else None


def offset_text(minutes: int) -> str:
    return f"{'-' if minutes < 0 else '+'}{abs(minutes) // 60:02d}:{abs(minutes) % 60:02d}"
