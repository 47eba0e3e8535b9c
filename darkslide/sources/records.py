"""Metadata records from files, and back to them."""

from __future__ import annotations

import glob
import json
import os
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from io import BytesIO

import pandas as pd
import pyarrow as pa
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from darkslide.functions.schematree import record_of
from darkslide.session import ship

#: Options of a reading session; the caller's come over them.
DEFAULTS = {"group": "G1", "struct": True}
CONFIG_PREFIX = "spark.darkslide."


def options(**given: object) -> dict[str, object]:
    return DEFAULTS | given


def config(spark: SparkSession, path: str, default: str | None = None) -> str | None:
    """A setting by dotted path."""
    return spark.conf.get(CONFIG_PREFIX + path, default)


def expand(patterns: Iterable[str], ending: str | None = None) -> list[str]:
    """Files of glob patterns; a pattern without a match stays as it is. With an ending, letter case counts, only names that have it."""
    found = [name for pattern in patterns for name in sorted(glob.glob(pattern)) or [pattern]]
    return [name for name in found if ending is None or name.endswith(ending)]


def _tags(record: dict) -> list[dict]:
    return [{"pos": i, "key": str(k), "value": json.dumps(v, ensure_ascii=False)} for i, (k, v) in enumerate(record.items())]


def read_json_records(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Rows (source_file, tags) from extracted JSON: lists of objects, or an object a line. tags keeps the order: pos, key, value (VARIANT).

    Broken texts and entries that are no objects give no rows.
    """
    ship(spark)
    lines = spark.read.text(paths if isinstance(paths, str) else list(paths), wholetext=True)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            records = [r for text in b.column(0).to_pylist() for r in _objects(text)]
            if records:
                kind = pa.list_(pa.struct([("pos", pa.int32()), ("key", pa.string()), ("value", pa.string())]))
                yield pa.RecordBatch.from_arrays([pa.array([r.get("SourceFile") if isinstance(r.get("SourceFile"), str) else None for r in records], pa.string()), pa.array([_tags(r) for r in records], kind)], names=["source_file", "tags"])

    raw = lines.mapInArrow(parse, "source_file string, tags array<struct<pos int, key string, value string>>")
    return raw.select("source_file", F.transform("tags", lambda t: F.struct(t["pos"].alias("pos"), t["key"].alias("key"), F.try_parse_json(t["value"]).alias("value"))).alias("tags"))


def _objects(text: str) -> list[dict]:
    try:
        value = json.loads(text)
    except ValueError:
        return [r for line in text.splitlines() if (r := record_of(line))]
    return [x for x in (value if isinstance(value, list) else [value]) if isinstance(x, dict)]


def read_yaml(path: str) -> object:
    """A YAML file; what goes wrong is raised with the file's name."""
    try:
        with open(path, encoding="utf-8") as f:
            return yaml.safe_load(f)
    except Exception as e:
        raise RuntimeError(f"{path}: {e}") from e


def read_yaml_records(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """As read_json_records, from YAML files of one map, a list of maps, or maps by file name; each file is parsed by a task."""
    ship(spark)
    files = spark.read.format("binaryFile").load(paths if isinstance(paths, str) else list(paths)).select("content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("pos", pa.int32()), ("key", pa.string()), ("value", pa.string())]))
        for b in batches:
            records = []
            for content in b.column(0).to_pylist():
                value = yaml.safe_load(content)
                each = value if isinstance(value, list) else list(value.values()) if isinstance(value, dict) and value and all(isinstance(v, dict) for v in value.values()) else [value]
                records += [json.loads(json.dumps(r, default=str)) for r in each if isinstance(r, dict)]
            if records:
                yield pa.RecordBatch.from_arrays([pa.array([r.get("SourceFile") for r in records], pa.string()), pa.array([_tags(r) for r in records], kind)], names=["source_file", "tags"])

    raw = files.mapInArrow(parse, "source_file string, tags array<struct<pos int, key string, value string>>")
    return raw.select("source_file", F.transform("tags", lambda t: F.struct(t["pos"].alias("pos"), t["key"].alias("key"), F.try_parse_json(t["value"]).alias("value"))).alias("tags"))


def read_geojson_zones(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (id, rings) of the files *-tz.json of a folder, ids their names without the ending."""
    from darkslide.operators.zones import geojson_rings

    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*-tz.json").select("value", F.input_file_name().alias("path"))
    return files.select(F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("id"), geojson_rings(F.col("value")).alias("rings"))


def zip_members(files: DataFrame, suffix: str = ".json", prefix: str = "") -> DataFrame:
    """Rows (name, content) of the members of ZIP archives, rows (content), with such an end and beginning; names lose their folders."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0).to_pylist():
                with zipfile.ZipFile(BytesIO(content)) as archive:
                    for name in archive.namelist():
                        if name.lower().endswith(suffix) and name.startswith(prefix):
                            yield pa.RecordBatch.from_arrays([pa.array([os.path.basename(name)]), pa.array([archive.read(name)], pa.binary())], names=["name", "content"])

    return files.select("content").mapInArrow(unpack, "name string, content binary")


def asset_links(html: Column, base: Column, ending: str) -> Column:
    """The first link of a page to a file with such an ending, made absolute; null without one."""
    link = F.regexp_extract(html, rf'href="([^"]+{ending})"', 1)
    site = F.regexp_extract(base, r"^(https?://[^/]+)", 1)
    return F.when(link != "", F.when(link.rlike("^https?://"), link).otherwise(F.concat(site, F.lit("/"), F.regexp_replace(link, "^/+", ""))))


def change_set(files: DataFrame, tags: dict[str, object]) -> DataFrame:
    """Rows (source_file, key, value): tags to set in each file; staged as a table, since writing into files isn't transactional. A file and tag occur once."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(json.dumps(v, ensure_ascii=False)).alias("value")) for k, v in tags.items()])
    return files.select("source_file").distinct().select("source_file", F.inline(pairs))


def yaml_text(record: Column) -> Column:
    """YAML of a JSON text, keys in order and characters as they are."""
    @F.pandas_udf("string")
    def dump(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: yaml.safe_dump(json.loads(t), sort_keys=False, allow_unicode=True).strip(), na_action="ignore").astype(object)

    return dump(record)


def ordered_json(tags: Column) -> Column:
    """A record's tags as a JSON text in their order, which a VARIANT object wouldn't keep."""
    pairs = F.transform(tags, lambda t: F.concat(F.to_json(t["key"].cast("variant")), F.lit(": "), F.to_json(t["value"])))
    return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))


class _Part(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self._paths = expand(options.get("path", "").split(","), options.get("ending"))
        self._batch = int(options.get("batch", 100))

    def partitions(self) -> list[_Part]:
        return [_Part(self._paths[i : i + self._batch]) for i in range(0, len(self._paths), self._batch)] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for path in partition.paths:
            with open(path, encoding="utf-8") as f:
                for record in _objects(f.read()):
                    yield record.get("SourceFile", path), json.dumps(record, ensure_ascii=False)


class MediaMetadata(DataSource):
    """spark.read.format("mediameta").load(patterns): rows (source_file, record_json) of sidecar JSON files, a batch of files a task."""

    @classmethod
    def name(cls) -> str:
        return "mediameta"

    def schema(self) -> str:
        return "source_file string, record_json string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)
