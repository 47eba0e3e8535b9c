"""Rules over records of tags: deletions, casts, conversions, renames and equality groups.

A record is an ordered ARRAY<STRUCT<key STRING, value VARIANT>>, since a VARIANT object doesn't keep the order of its keys.
The rules are data, read from a YAML file of four sections: _del (paths), _type (kind -> paths), _convert (name -> paths) and _eq (lists of paths).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from darkslide.functions.nested import change_path, drop_path, flatten_single, keywords, signed8, split_position, to_float, to_int, x_join

KEYWORD_TAGS = ("XMP:Subject", "IPTC:Keywords", "Composite:Keywords")
# Names of a group in the finer naming and in the coarser one, and two tags that keep theirs.
GROUPS = {
    "ExifIFD": "EXIF", "System": "File", "IFD0": "EXIF", "IFD1": "EXIF", "InteropIFD": "EXIF", "GPS": "EXIF", "XMP-dc": "XMP", "XMP-xmp": "XMP", "XMP-x": "XMP", "XMP-exif": "XMP", "MWG": "Composite",
    "IFD1:Compression": "IFD1:Compression", "IFD1:XResolution": "IFD1:XResolution", "IFD1:YResolution": "IFD1:YResolution",
}


@dataclass(frozen=True)
class Rules:
    delete: tuple[str, ...] = ()
    floats: tuple[str, ...] = ()
    ints: tuple[str, ...] = ()
    convert: dict[str, tuple[str, ...]] = field(default_factory=dict)
    equal: tuple[tuple[str, ...], ...] = ()

    @classmethod
    def load(cls, text: str) -> Rules:
        """From a YAML text. The values of _del play no part: what is listed goes."""
        said = yaml.safe_load(text) or {}
        kinds = said.get("_type") or {}
        return cls(tuple(said.get("_del") or {}), tuple(kinds.get("float") or ()), tuple(kinds.get("int") or ()), {k: tuple(dict.fromkeys(v)) for k, v in (said.get("_convert") or {}).items()}, tuple(tuple(g) for g in said.get("_eq") or ()))


def _text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _nested(path: str) -> list[str]:
    """The steps of a path below its tag; none of a tag's own name, which may hold dots in the part before a colon only."""
    return path.split(".")[1:]


def delete_tags(tags: Column, names: Iterable[str]) -> Column:
    """tags without those of these names. Paths such as A.B and A.[].B are taken out of the tag's value; a tag of which nothing is left goes, too."""
    names = list(names)
    whole, within = [n for n in names if not _nested(n)], [n for n in names if _nested(n)]
    if whole:
        tags = F.filter(tags, lambda t: ~t["key"].isin(*whole))
    for path in within:
        tags = F.filter(_within(tags, path, lambda v, below: drop_path(v, below, items=True)), _not_emptied(path.split(".")[0]))
    return tags


def _within(tags: Column, path: str, change: Callable[[Column, list[str]], Column]) -> Column:
    """tags with change applied to the value of a path's tag and the steps below it."""
    tag, *below = path.split(".")
    return F.transform(tags, lambda t: F.struct(t["key"].alias("key"), F.when(t["key"] == tag, change(t["value"], below)).otherwise(t["value"]).alias("value")))


def _not_emptied(tag: str) -> Callable[[Column], Column]:
    return lambda t: (t["key"] != tag) | ~F.coalesce(F.to_json(t["value"]).isin("{}", "[]"), F.lit(False))


def rename_groups(key: Column) -> Column:
    """A key with its group's coarser name. Groups with a hyphen have no rule that applies, since a name of letters, digits and _ is looked for."""
    names = F.create_map(*[F.lit(x) for pair in GROUPS.items() for x in pair])
    form = r"^(\w+):(\w+)"
    group = F.try_element_at(names, F.regexp_extract(key, form, 1))
    return F.when(key.rlike(form), F.coalesce(F.try_element_at(names, key), F.concat(group, F.lit(":"), F.regexp_extract(key, form, 2)), key)).otherwise(key)


def _changed(tags: Column, names: Iterable[str], change: Callable[[Column], Column]) -> Column:
    """tags with change applied to the values of these names, and to what is at these paths within values."""
    names = list(names)
    if whole := [n for n in names if not _nested(n)]:
        tags = F.transform(tags, lambda t: F.struct(t["key"].alias("key"), F.when(t["key"].isin(*whole), change(t["value"])).otherwise(t["value"]).alias("value")))
    for path in names:
        if _nested(path):
            tags = _within(tags, path, lambda v, below: change_path(v, below, change))
    return tags


def cast_tags(tags: Column, rules: Rules) -> Column:
    """Numbers of the texts that are some, under the rules' names; other texts and values stay."""
    number = lambda read: lambda v: F.when(_kind(v) == "STRING", F.coalesce(read(_text(v)).cast("variant"), v)).otherwise(v)
    whole = lambda v: F.when(_kind(v).rlike("^(DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, "$", "double").cast("bigint").cast("variant")).otherwise(number(to_int)(v))
    wide = lambda v: F.when(_kind(v).rlike("^(BIGINT|INT|DECIMAL)"), F.try_variant_get(v, "$", "double").cast("variant")).otherwise(number(to_float)(v))
    return _changed(_changed(tags, rules.floats, wide), rules.ints, whole)


#: Conversions by name, of VARIANT values. What can't be converted stays as it is.
CONVERTERS: dict[str, Callable[[Column], Column]] = {
    "x_separated": lambda v: F.coalesce(x_join(_text(v)).cast("variant"), v),
    "signed_8f_comma_separated": lambda v: F.coalesce(signed8(_text(v)).cast("variant"), v),
    "flatten_if_not_multiple": flatten_single,
}


def convert_tags(tags: Column, rules: Rules) -> Column:
    for name, change in CONVERTERS.items():
        tags = _changed(tags, rules.convert.get(name, ()), change)
    return tags


def _split_position(prefix: str) -> Callable[[Column], Column]:
    """A prefix's position tag as latitude and longitude tags, nothing where it can't be read; other tags as they are."""
    pair = lambda tag, v: F.struct(F.lit(prefix + tag).alias("key"), v.cast("variant").alias("value"))

    def parts(t: Column) -> Column:
        lat, lon = split_position(_text(t["value"]))
        return F.when(t["key"] != f"{prefix}GPSPosition", F.array(t)).when(lat.isNull(), F.filter(F.array(t), lambda x: F.lit(False))).otherwise(F.array(pair("GPSLatitude", lat), pair("GPSLongitude", lon)))

    return parts


def _cool_in(tags: Column, rules: Rules) -> Column:
    """Positions split in two tags, and keyword texts in lists; keywords that aren't text are dropped."""
    for prefix in ("Composite:", "EXIF:"):
        tags = F.flatten(F.transform(tags, _split_position(prefix)))
    listed = _changed(tags, KEYWORD_TAGS, lambda v: F.when(_kind(v) == "STRING", keywords(_text(v)).cast("variant")))
    return F.filter(listed, lambda t: ~t["key"].isin(*KEYWORD_TAGS) | t["value"].isNotNull())


def _simple_out(tags: Column, rules: Rules) -> Column:
    return delete_tags(tags, rules.delete)


def _cool_out(tags: Column, rules: Rules) -> Column:
    return convert_tags(cast_tags(tags, rules), rules)


#: In the order in which they apply, whatever order they are asked in.
TRANSFORMATIONS: dict[str, Callable[[Column, Rules], Column]] = {"cool_in": _cool_in, "simple_out": _simple_out, "cool_out": _cool_out}


def _of_group(group: tuple[str, ...]) -> Callable[[Column], Column]:
    return lambda t: t["key"].isin(*group) & ~F.is_variant_null(t["value"])


def unequal_groups(tags: Column, rules: Rules) -> Column:
    """Texts "path=value, ..." of the equality groups whose members there are differ, by type or value."""
    found = []
    for group in rules.equal:
        own = F.filter(tags, _of_group(group))
        shown = F.transform(own, lambda t: F.concat(_kind(t["value"]), F.lit(":"), F.to_json(t["value"])))
        found.append(F.when(F.size(F.array_distinct(shown)) > 1, F.array_join(F.transform(own, lambda t: F.concat(t["key"], F.lit("="), _text(t["value"]))), ", ")))
    return F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array().cast("array<string>")


def transform_records(df: DataFrame, rules: Rules, names: Iterable[str], tags: str = "tags") -> DataFrame:
    """df with its tags transformed by the named steps, in their fixed order; "check" adds the column unequal. Unknown names are ignored."""
    names = set(names)
    for name, step in TRANSFORMATIONS.items():
        if name in names:
            # inline keeps the optimiser from copying one step's expressions into the next.
            df = df.select(*[c for c in df.columns if c != tags], F.inline(F.array(F.struct(step(F.col(tags), rules).alias(tags)))))
    return df.withColumn("unequal", unequal_groups(F.col(tags), rules)) if "check" in names else df


def record_tags(**values: Column) -> Column:
    """A record from columns by tag, null ones left out."""
    return F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.cast("variant").alias("value")) for k, v in values.items()]), lambda t: t["value"].isNotNull())


def as_map(tags: Column) -> Column:
    """A record's texts by tag; the last of equal tags counts."""
    last = F.filter(tags, lambda t, i: ~F.exists(F.slice(tags, i + 2, F.size(tags)), lambda x: x["key"] == t["key"]))
    return F.map_from_entries(F.transform(last, lambda t: F.struct(t["key"], _text(t["value"]))))


def merge_right(left: Column, right: Column) -> Column:
    """Two maps as one, the right one's values first."""
    kept = F.map_filter(left, lambda k, v: ~F.coalesce(F.array_contains(F.map_keys(right), k), F.lit(False)))
    return F.map_concat(kept, right)
