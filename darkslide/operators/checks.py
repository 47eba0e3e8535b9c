"""Consistency of the date, time and offset tags of a record, as findings instead of exceptions.

A record is a MAP<STRING, STRING>. The registry of tags is an array of structs in the plan and one lambda reads
them all, so the plan doesn't grow with the registry; nothing shuffles, and the check runs on streams as it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from darkslide.functions.nested import to_float
from darkslide.functions.temporal import format_offset, normalize_offset, parse_naive, parse_offset, path_date

# Fixed values, in this order: tag, companion of the time, of fractions, of the offset, fixed offset, forms allowed
# (f fraction, z offset, u zero offset required), tolerance in seconds, whether the tag is about UTC by itself.
ANCHOR = "ExifIFD:DateTimeOriginal"
REGISTRY = (
    ("ExifIFD:DateTimeOriginal", None, "ExifIFD:SubSecTimeOriginal", "ExifIFD:OffsetTimeOriginal", None, "fz", 0, False),
    ("ExifIFD:CreateDate", None, "ExifIFD:SubSecTime", "ExifIFD:OffsetTime", None, "fz", 0, False),
    ("ExifIFD:DateTimeDigitized", None, "ExifIFD:SubSecTimeDigitized", "ExifIFD:OffsetTimeDigitized", None, "fz", 0, False),
    ("XMP:DateTimeOriginal", None, None, None, None, "fz", 0, False),
    ("XMP:CreateDate", None, None, None, None, "fz", 0, False),
    ("XMP:DateCreated", None, None, None, None, "fz", 0, False),
    ("XMP:DateTimeDigitized", None, None, None, None, "fz", 0, False),
    ("XMP-exif:GPSDateTime", None, None, None, None, "fu", 0, True),
    ("IPTC:DateCreated", "IPTC:TimeCreated", None, None, None, "z", 0, False),
    ("QuickTime:CreateDate", None, None, None, None, "z", 0, False),
    ("MakerNotes:DateTimeUTC", None, None, None, "Z", "", 10, False),
    ("MakerNotes:TimeStamp", None, None, None, None, "fz", 10, False),
    ("EXIF:GPSDateStamp", "EXIF:GPSTimeStamp", None, None, "Z", "", 1799, True),
)
_FIELDS = ("tag", "time_tag", "subsec_tag", "offset_tag", "fixed", "form", "tolerance", "aware")
#: Companions after all tags, in the order of time, offset and fraction.
COMPANIONS = tuple((c, r[0]) for r in REGISTRY for c in (r[1], r[3], r[2]) if c)
KNOWN = tuple(r[0] for r in REGISTRY) + tuple(c for c, _ in COMPANIONS)

_WHOLE = r"^([0-9]{4}):([0-9]{2}):([0-9]{2}) ([0-9]{2}):([0-9]{2}):([0-9]{2})([.][0-9]*)?([+-][0-9]{2}:[0-9]{2}|Z)?$"


def _registry() -> Column:
    kinds = ("string",) * 6 + ("bigint", "boolean")
    return F.array(*[F.struct(*[F.lit(v).cast(k).alias(n) for n, v, k in zip(_FIELDS, row, kinds)]) for row in REGISTRY])


def _value(tags: Column, name: Column) -> Column:
    return F.when(name.isNotNull(), F.try_element_at(tags, name))


def _joined(tags: Column, r: Column) -> Column:
    """A registry entry with its tag's value, that and its companions' as one text, and the names of those."""
    own = _value(tags, r["tag"])
    said = [(r[c], F.lit(before), F.nullif(_value(tags, r[c]), F.lit(""))) for c, before in (("time_tag", " "), ("subsec_tag", "."), ("offset_tag", ""))]
    text = F.when(own.isNotNull(), F.concat(own, *[F.coalesce(F.concat(before, v), F.lit("")) for _, before, v in said]))
    names = F.concat_ws("+", r["tag"], *[F.when(v.isNotNull(), name) for name, _, v in said])
    return F.struct(*[r[n].alias(n) for n in _FIELDS], own.alias("own"), text.alias("text"), names.alias("names"), F.array_contains(F.map_keys(tags), r["tag"]).alias("present"))


def assembled(df: DataFrame, tags: str = "tags", keep: Sequence[str] = ("source_file",)) -> DataFrame:
    """Rows (keep, tag, names, text): for every date tag that a record has, the tag and its companions that are there, and their values as one text."""
    tag_map = F.col(tags)
    joined = F.filter(F.transform(_registry(), lambda r: _joined(tag_map, r)), lambda r: r["own"].isNotNull())
    return df.select(*keep, F.inline(F.transform(joined, lambda r: F.struct(r["tag"].alias("tag"), r["names"].alias("names"), r["text"].alias("text")))))


def joined_messages(df: DataFrame, by: Sequence[str], order: Sequence[str], text: str, between: str = "; ") -> DataFrame:
    """Rows (by, messages): texts of each group in order, as one; null texts are left out."""
    held = df.where(F.col(text).isNotNull()).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("_text")))).alias("_all"))
    return held.select(*by, F.array_join("_all._text", between).alias("messages"))


def _read(r: Column) -> Column:
    """A joined entry with what it says: seconds since 1970 as a wall time, offset, and errors."""
    # Once the form fits, all but the fraction and offset stand at fixed places.
    part = lambda at, n=2: F.substring(r["text"], at, n)
    zone = F.regexp_extract(F.substring(r["text"], 20, 40), r"(?:[+-][0-9]{2}:[0-9]{2}|Z)$", 0)
    fits = r["own"].isNotNull() & r["text"].rlike(_WHOLE) & ((part(20, 1) != ".") | r["form"].contains("f")) & F.when(r["form"].contains("u"), zone.isin("Z", "+00:00", "-00:00")).otherwise((zone == "") | r["form"].contains("z"))
    day = F.unix_date(F.concat_ws("-", part(1, 4), part(6), part(9)).try_cast("date")).cast("bigint")
    clock = F.when((part(12) < "24") & (part(15) < "60") & (part(18) < "60"), part(12).try_cast("bigint") * 3600 + part(15).try_cast("bigint") * 60 + part(18).try_cast("bigint"))
    return F.struct(
        *[r[n].alias(n) for n in (*_FIELDS, "own", "text", "names", "present")], fits.alias("fits"),
        F.when(fits & (part(1, 4) != "0000"), day * 86_400 + clock).alias("seconds"), F.when(fits, parse_offset(F.coalesce(r["fixed"], F.nullif(zone, F.lit(""))))).alias("offset"),
    )


def _judged(r: Column) -> Column:
    """A read entry with its UTC, and the error of one that is missing or doesn't fit."""
    missing = F.concat(F.lit("DateTimeParseError: Cannot parse "), r["tag"], F.lit(" KeyError: '"), r["tag"], F.lit("'"))
    unfit = F.concat(F.lit("DateTimeParseError: Cannot parse "), r["names"], F.lit(" DateTimeParseError: '"), r["text"], F.lit("' does not match the form of a date and time"))
    error = F.when(r["own"].isNull(), missing).when(~r["fits"], unfit)
    return F.struct(*[r[n].alias(n) for n in (*_FIELDS, "own", "present", "seconds", "offset")], (r["seconds"] - r["offset"]).alias("utc"), error.alias("error"), (r["fits"] & r["seconds"].isNull()).alias("impossible"))


def _exif(seconds: Column) -> Column:
    day = F.date_format(F.date_from_unix_date(F.floor(seconds / 86_400).cast("int")), "yyyy:MM:dd")
    rest = F.pmod(seconds, F.lit(86_400))
    return F.format_string("%s %02d:%02d:%02d", day, F.floor(rest / 3600).cast("bigint"), F.floor(F.pmod(rest, F.lit(3600)) / 60).cast("bigint"), F.pmod(rest, F.lit(60)).cast("bigint"))


def _finding(severity: str, tag: Column, detail: Column) -> Column:
    return F.struct(F.lit(severity).alias("severity"), tag.alias("tag"), detail.alias("detail"))


def _nothing() -> Column:
    return F.array().cast("array<struct<severity:string,tag:string,detail:string>>")


def _fan(tags: Column, r: Column) -> Column:
    """The tag and those of its fraction and offset companions that the record has."""
    return F.filter(F.array(r["tag"], F.when(_value(tags, r["subsec_tag"]).isNotNull(), r["subsec_tag"]), F.when(_value(tags, r["offset_tag"]).isNotNull(), r["offset_tag"])), lambda x: x.isNotNull())


def _deletable(tags: Column, r: Column, when: Column, detail: Column) -> Column:
    """Findings for the tag and its companions, none where when isn't true."""
    own = F.transform(_fan(tags, r), lambda t: _finding("deletable", t, detail))
    return F.when(F.coalesce(when, F.lit(False)), own).otherwise(_nothing())


def _single(finding: Column, when: Column) -> Column:
    return F.filter(F.array(F.when(F.coalesce(when, F.lit(False)), finding)), lambda x: x.isNotNull())


def datetime_findings(df: DataFrame, tags: str = "tags", keep: Sequence[str] = ("source_file",), source_file: str = "SourceFile") -> DataFrame:
    """Rows (keep, findings): arrays of (severity, tag, detail), severity fatal, fixable, deletable or error.

    Every date tag is read with its companions and held against the anchor. Without any known tag there are no
    findings; without a readable anchor there is one only: fixable, if the anchor is missing or blank and the path has a date, else fatal. Well-formed
    but impossible dates give an error finding, alone. deletable details of one tag are joined by "; ". A null map has no findings.
    """
    tag_map = F.col(tags)
    # Each stage goes through inline, which keeps the optimiser from copying its expressions into the next; nested lambdas hold what a later one uses more than once.
    staged = df.select(*keep, tags, F.inline(F.array(F.struct(F.transform(F.transform(F.transform(_registry(), lambda r: _joined(tag_map, r)), _read), _judged).alias("_read")))))
    anchor = F.col("_read")[0]
    others = F.filter(F.slice("_read", 2, len(REGISTRY) - 1), lambda r: r["present"])
    good = F.filter(others, lambda r: r["error"].isNull() & r["seconds"].isNotNull())
    first = lambda array, c: F.get(array, F.lit(0))[c]
    staged = staged.select(*keep, tags, F.inline(F.array(F.struct(
        anchor.alias("_a"), others.alias("_others"), good.alias("_good"),
        F.coalesce(anchor["offset"], first(F.filter(good, lambda r: r["offset"].isNotNull() & r["fixed"].isNull()), "offset")).alias("_offset"),
        F.coalesce(anchor["utc"], first(F.filter(good, lambda r: r["utc"].isNotNull()), "utc")).alias("_utc"),
    ))))
    offset, utc, a = F.col("_offset"), F.col("_utc"), F.col("_a")
    offset_text = format_offset(offset)

    def compared(r: Column) -> Column:
        apart = lambda x, y: F.abs(x - y)
        versus = lambda name, x, y: F.concat(r["tag"], F.lit(f" {name}="), _exif(x), F.lit(f" vs. {ANCHOR} "), _exif(y), F.lit(" diff_secs="), apart(x, y).cast("string"), F.lit(" tolerance_secs="), r["tolerance"].cast("string"))
        naive = F.concat(_deletable(tag_map, r, r["fixed"].isNull() & ~r["aware"] & (apart(r["seconds"], a["seconds"]) > r["tolerance"]), versus("dt_naive", r["seconds"], a["seconds"])))
        differs = r["fixed"].isNull() & r["offset"].isNotNull() & (r["offset"] != offset)
        mendable = r["offset_tag"].isNull() & ~r["aware"]
        own_text = format_offset(r["offset"])
        timeless = r["offset_tag"].isNull() & r["time_tag"].isNotNull() & _value(tag_map, r["time_tag"]).isNull()
        bare = F.when(F.endswith(r["own"], own_text), F.substring(r["own"], F.lit(1), F.length(r["own"]) - F.length(own_text))).otherwise(r["own"])
        return F.concat(
            naive,
            _single(_finding("fixable", r["tag"], F.concat(bare, offset_text)), differs & mendable),
            _deletable(tag_map, r, differs & ~mendable, F.concat(r["tag"], F.lit(" offset="), own_text, F.lit(f" != {ANCHOR} "), offset_text)),
            _deletable(tag_map, r, r["utc"].isNotNull() & (apart(r["utc"], utc) > r["tolerance"]), versus("utc", r["utc"], utc)),
            _single(
                _finding("fixable", F.coalesce(r["offset_tag"], r["time_tag"], r["tag"]), F.when(r["offset_tag"].isNotNull(), offset_text).when(r["time_tag"].isNotNull(), F.concat(_value(tag_map, r["time_tag"]), offset_text)).otherwise(F.concat(r["own"], offset_text))),
                r["utc"].isNull() & utc.isNotNull() & offset.isNotNull() & ~timeless,
            ),
            # Whole date and time in a date's tag: there is no time tag that the offset could be added to.
            _single(_finding("error", r["tag"], F.concat(F.lit("KeyError: '"), r["time_tag"], F.lit("'"))), r["utc"].isNull() & utc.isNotNull() & offset.isNotNull() & timeless),
            _deletable(tag_map, r, r["utc"].isNull() & utc.isNotNull() & offset.isNull(), F.lit("could not determine UTC datetime for comparison")),
        )

    unread = F.flatten(F.transform(F.col("_others"), lambda r: _deletable(tag_map, r, r["error"].isNotNull(), r["error"])))
    keys = F.map_keys(tag_map)
    orphans = F.flatten(F.array(*[_single(_finding("deletable", F.lit(c), F.lit(f"Missing {p}")), F.array_contains(keys, c) & ~F.array_contains(keys, p)) for c, p in COMPANIONS]))
    events = F.concat(unread, orphans, F.flatten(F.transform(F.col("_good"), compared)))
    blank = a["own"].isNull() | (a["own"] == " " * 19)
    proposal = path_date(_value(tag_map, F.lit(source_file)))
    one = lambda f: F.array(f)
    impossible = a["impossible"] | F.exists(F.col("_others"), lambda r: r["impossible"])
    found = (
        F.when(~F.coalesce(F.arrays_overlap(keys, F.array(*[F.lit(k) for k in KNOWN])), F.lit(False)), _nothing())
        .when(a["error"].isNotNull() & blank & proposal.isNotNull(), one(_finding("fixable", a["tag"], proposal)))
        .when(a["error"].isNotNull(), one(_finding("fatal", F.array_join(_fan(tag_map, a), "+"), a["error"])))
        .when(impossible, one(_finding("error", F.lit(ANCHOR), F.lit("ValueError"))))
        .otherwise(events)
    )
    staged = staged.select(*keep, F.inline(F.array(F.struct(F.coalesce(found, _nothing()).alias("_events")))))
    return staged.select(*keep, merge_findings(F.col("_events")).alias("findings"))


def merge_findings(events: Column) -> Column:
    """One finding by severity and tag, in the order of their first: details joined by "; ", of fixable ones the last."""
    named = F.array_distinct(F.transform(events, lambda e: F.struct(e["severity"].alias("severity"), e["tag"].alias("tag"))))

    def merged(n: Column) -> Column:
        details = F.transform(F.filter(events, lambda e: (e["severity"] == n["severity"]) & (e["tag"] == n["tag"])), lambda e: e["detail"])
        return F.struct(n["severity"].alias("severity"), n["tag"].alias("tag"), F.when(n["severity"] == "fixable", F.element_at(details, -1)).otherwise(F.array_join(details, "; ")).alias("detail"))

    return F.transform(named, merged)


def findings_by_severity(findings: Column) -> Column:
    """MAP of severity to MAP of tag to detail."""
    severities = F.array_distinct(F.transform(findings, lambda f: f["severity"]))
    return F.map_from_entries(F.transform(severities, lambda s: F.struct(s, F.map_from_entries(F.transform(F.filter(findings, lambda f: f["severity"] == s), lambda f: F.struct(f["tag"], f["detail"]))))))


# Where places, capture times and offsets are looked for, in this order.
PLACE_TAGS = (("Composite:GPSLatitude", "Composite:GPSLongitude"), ("EXIF:GPSLatitude", "EXIF:GPSLongitude"))
CAPTURE_TAGS = ("EXIF:DateTimeOriginal", "EXIF:CreateDate", "EXIF:DateTimeDigitized", "XMP:DateTimeOriginal", "QuickTime:CreateDate")
OFFSET_TAGS = ("EXIF:OffsetTimeOriginal", "EXIF:OffsetTimeDigitized", "EXIF:OffsetTime")
HOURS_TAG = "EXIF:TimeZoneOffset"
MORE_OFFSET_TAGS = ("XMP:TimeZone", "XMP:Timezone", "XMP:TimeZoneOffset", "XMP:TimezoneOffset", "QuickTime:TimeZone", "QuickTime:Timezone")


def place_of(tags: Column) -> tuple[Column, Column]:
    """Latitude and longitude of the first pair of tags that are both numbers."""
    found = F.coalesce(*[F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon"))) for a, b in PLACE_TAGS for lat, lon in [(to_float(F.try_element_at(tags, F.lit(a))), to_float(F.try_element_at(tags, F.lit(b))))]])
    return found["lat"], found["lon"]


def capture_text(tags: Column) -> Column:
    """Text of the first capture tag that isn't empty."""
    return F.coalesce(*[F.nullif(F.try_element_at(tags, F.lit(t)), F.lit("")) for t in CAPTURE_TAGS])


def capture_time(tags: Column) -> Column:
    """Wall time of the first capture tag that isn't empty; null if that one can't be read."""
    return parse_naive(capture_text(tags))


def offset_facts(tags: Column, ordered_values: Column | None = None) -> Column:
    """What check_offsets needs of a record: a struct (lat, lon, taken, wall, declared)."""
    lat, lon = place_of(tags)
    return F.struct(lat.alias("lat"), lon.alias("lon"), capture_text(tags).alias("taken"), capture_time(tags).alias("wall"), declared_offset(tags, ordered_values).alias("declared"))


def declared_offset(tags: Column, ordered_values: Column | None = None) -> Column:
    """±HH:MM of the first offset tag that states one; at last, of the first of all values in record order that looks like one."""
    of = lambda t: normalize_offset(F.try_element_at(tags, F.lit(t)))
    hours = F.try_element_at(tags, F.lit(HOURS_TAG))
    hours = normalize_offset(F.when(hours.startswith("["), F.get_json_object(hours, "$[0]")).otherwise(hours))
    values = F.map_values(tags) if ordered_values is None else ordered_values
    return F.coalesce(*[of(t) for t in OFFSET_TAGS], hours, *[of(t) for t in MORE_OFFSET_TAGS], F.get(F.filter(F.transform(values, normalize_offset), lambda v: v.isNotNull()), F.lit(0)))


def failing(df: DataFrame, findings: str = "findings") -> DataFrame:
    """The rows with any finding."""
    return df.where(F.size(findings) > 0)


def job_failed(df: DataFrame, findings: str = "findings") -> DataFrame:
    """One row (failed): whether any row has a finding."""
    return df.agg(F.coalesce(F.bool_or(F.size(findings) > 0), F.lit(False)).alias("failed"))
