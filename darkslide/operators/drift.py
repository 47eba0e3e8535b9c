"""Schemas that drift between files: each change reported, and all files read into one table."""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from darkslide.functions.schematree import STEP, edit_script, kind_of, nodes, record_of, rendered
from darkslide.operators.skew import lookup_join
from darkslide.session import ship, written

#: Distinct renames up to which names are united on the driver; beyond, the same is done by joins.
DRIVER_LINKS = 10_000


def with_previous(files: DataFrame, group: str, order: tuple[str, ...], key: str) -> DataFrame:
    """files' key and prev_key, the file before it in its group by order, null for the first of a group.

    Sorted by range over all groups, so a group with a third of all files is spread; only the last row of each partition goes by the driver.
    """
    spark = files.sparkSession
    ranged = files.select(group, *order, key).where(F.col(group).isNotNull()).distinct().repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), group, *order, key)
    ranged = written(ranged.withColumn("part", F.spark_partition_id()), "file-order")
    by = Window.partitionBy("part").orderBy(group, *order, key)
    lasts = ranged.groupBy("part").agg(F.max(F.struct(group, *order, key)).alias("last")).select("part", F.col(f"last.{group}").alias("g"), F.col(f"last.{key}").alias("k")).collect()
    before, newest = {}, None
    for row in sorted(lasts):
        before[row.part] = newest
        newest = row
    carried = spark.createDataFrame([(p, r.g, r.k) for p, r in before.items() if r is not None], f"part int, g {dict(files.dtypes)[group]}, k {dict(files.dtypes)[key]}")
    lagged = ranged.select("*", F.lag(group).over(by).alias("g1"), F.lag(key).over(by).alias("k1"), F.row_number().over(by).alias("nth")).join(F.broadcast(carried), "part", "left")
    prev_group, prev_key = F.when(F.col("nth") == 1, F.col("g")).otherwise(F.col("g1")), F.when(F.col("nth") == 1, F.col("k")).otherwise(F.col("k1"))
    return lagged.select(group, key, F.when(prev_group == F.col(group), prev_key).alias(f"prev_{key}"))


def file_schemas(records: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, fields): the distinct (path, JSON type) of each file's records, met once per batch before they are gathered."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            met = {(k, path, kind_of(x)): None for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for path, x in nodes(record_of(t))}
            if met:
                k, path, kind = zip(*met)
                yield pa.RecordBatch.from_arrays([pa.array(k, b.schema.field(0).type), pa.array(path), pa.array(kind)], names=[key, "path", "kind"])

    ship(records.sparkSession)
    rows = records.select(key, text).mapInArrow(read, f"{key} {dict(records.dtypes)[key]}, path string, kind string").distinct()
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("path", "kind"))).alias("fields"))


def _values(records: DataFrame, lookup: DataFrame, key: str, photo: str, text: str, paths: str, name: str) -> DataFrame:
    """Distinct rows (pair, photo, name, value) of the wanted paths, an array per file in lookup (key, pair, paths, n)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for pair, who, t, wanted in zip(*(b.column(c).to_pylist() for c in ("pair", photo, text, paths))):
                own = set(wanted)
                out += [(pair, who, p, rendered(x)) for p, x in nodes(record_of(t)) if p in own and x is not None]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (b.schema.field("pair").type, b.schema.field(photo).type, pa.string(), pa.string()))], names=["pair", photo, name, "value"])

    kinds = dict(records.dtypes)
    met = lookup_join(records.select(key, photo, text).where(F.col(photo).isNotNull()), lookup, key, "n").select("pair", photo, text, paths)
    return met.mapInArrow(read, f"pair {kinds[key]}, {photo} {kinds[photo]}, {name} string, value string").distinct()


def schema_changes(records: DataFrame, files: DataFrame, key: str = "dump_id", group: str = "station_id", order: tuple[str, ...] = ("dumped_at",), photo: str = "file_key", text: str = "record_json") -> DataFrame:
    """Rows (key, group, prev_key, kind, path, new_path, cost): the cheapest edit script from each file's schema to that of the next file of its group, under the key of the later.

    kind is added, removed, renamed, moved or retyped; labels of nested paths are joined by U+001F. A rename or move
    needs the same value in over half of the photos that are in both files and have both values. Null, broken and non-object records have no fields; a file
    without records has an empty schema; records of unlisted files are in no change; repeated lines count once; a file's first in its group has no changes. An empty table gives no rows.
    """
    pairs = with_previous(files, group, order, key).where(f"prev_{key} is not null")
    schemas = written(file_schemas(records, key, text), "schemas")
    none = F.array().cast(schemas.schema["fields"].dataType)
    both = pairs.join(schemas.withColumnRenamed("fields", "now"), key, "left").join(schemas.select(F.col(key).alias(f"prev_{key}"), F.col("fields").alias("was")), f"prev_{key}", "left")
    both = both.select(group, key, f"prev_{key}", *[F.coalesce(c, none).alias(c) for c in ("was", "now")])
    both = both.withColumn("lost", F.array_except("was.path", "now.path")).withColumn("come", F.array_except("now.path", "was.path"))
    both = written(both.where("was <> now"), "schema-pairs")
    renamable = both.where("size(lost) > 0 and size(come) > 0")
    lines = records.groupBy(key).agg(F.count("*").alias("n"))
    side = lambda at, paths: written(renamable.select(F.col(at).alias(key), F.col(key).alias("pair"), paths).join(lines, key), "sides")
    old = _values(records, side(f"prev_{key}", "lost"), key, photo, text, "lost", "path")
    new = _values(records, side(key, "come"), key, photo, text, "come", "new_path")
    old, new = written(old, "old-values"), written(new, "new-values")
    agreed = old.join(new, ["pair", photo, "value"]).groupBy("pair", "path", "new_path").agg(F.countDistinct(photo).alias("same"))
    # Photos by the sets of names they have values of, of which a file has few: so no photo makes a row for each pair of names.
    names_of = lambda values, name, sets: values.groupBy("pair", photo).agg(F.sort_array(F.collect_set(name)).alias(sets))
    alike = names_of(old, "path", "paths").join(names_of(new, "new_path", "new_paths"), ["pair", photo]).groupBy("pair", "paths", "new_paths").agg(F.count("*").alias("n"))
    both_there = alike.select("pair", F.explode("paths").alias("path"), "new_paths", "n").select("pair", "path", F.explode("new_paths").alias("new_path"), "n").groupBy("pair", "path", "new_path").agg(F.sum("n").alias("photos"))
    shares = agreed.join(both_there, ["pair", "path", "new_path"]).withColumn("share", F.col("same") / F.col("photos")).where("share > 0.5")
    shares = shares.groupBy("pair").agg(F.collect_list(F.struct("path", "new_path", "share")).alias("shares")).withColumnRenamed("pair", key)

    def script(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for g, k, p, was, now, agreed in zip(*(b.column(c).to_pylist() for c in (group, key, f"prev_{key}", "was", "now", "shares"))):
                trees = []
                for fields in (was, now):
                    tree: dict[str, set[str]] = defaultdict(set)
                    for x in fields:
                        tree[x["path"]].add(x["kind"])
                    trees.append(tree)
                agreement = {(x["path"], x["new_path"]): x["share"] for x in agreed or []}
                out += [(k, g, p, *edit) for edit in edit_script(*trees, agreement)]
            if out:
                types = (b.schema.field(key).type, b.schema.field(group).type, b.schema.field(f"prev_{key}").type, pa.string(), pa.string(), pa.string(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[key, group, f"prev_{key}", "kind", "path", "new_path", "cost"])

    kinds = dict(files.dtypes)
    return both.join(shares, key, "left").select(group, key, f"prev_{key}", "was", "now", "shares").mapInArrow(script, f"{key} {kinds[key]}, {group} {kinds[group]}, prev_{key} {kinds[key]}, kind string, path string, new_path string, cost double")


def common_names(changes: DataFrame, schemas: DataFrame) -> DataFrame:
    """Rows (name, common): the name in the common table of every name that a file uses at the top of its records, written.

    Names linked by renames are one field, called as most files call it. Compiled from the edit scripts' distinct names, not from records.
    """
    top_level = ~F.col("path").contains(STEP) & ~F.coalesce(F.col("new_path"), F.lit("")).contains(STEP)
    links = written(changes.where(F.col("kind").isin("renamed", "moved") & top_level).select(F.col("path").alias("a"), F.col("new_path").alias("b")).distinct(), "links")
    used = written(schemas.select(F.explode(F.array_distinct("fields.path")).alias("name")).where(~F.col("name").contains(STEP)).groupBy("name").agg(F.count("*").alias("n")), "names")
    labels = _united(links)
    named = used.join(labels, "name", "left").withColumn("label", F.coalesce("label", "name"))
    first = named.groupBy("label").agg(F.min_by("name", F.struct(-F.col("n"), F.col("name"))).alias("common"))
    return written(named.join(first, "label").select("name", "common"), "common-names")


def _united(links: DataFrame) -> DataFrame:
    """Rows (name, label): names joined by links (a, b) share the least name among them."""
    spark = links.sparkSession
    if links.count() <= DRIVER_LINKS:
        above: dict[str, str] = {}

        def top(x: str) -> str:
            while above.get(x, x) != x:
                above[x] = above.get(above[x], above[x])
                x = above[x]
            return x

        for r in links.collect():
            low, high = sorted((top(r.a), top(r.b)))
            above.setdefault(low, low)
            above[high] = low
        return spark.createDataFrame([(x, top(x)) for x in above], "name string, label string")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = written(both.select(F.col("a").alias("name")).distinct().withColumn("label", F.col("name")), "labels")
    while True:
        # The least label among neighbours, then that label's own: distances halve with each round.
        near = both.join(labels.withColumnRenamed("name", "b"), "b").groupBy(F.col("a").alias("name")).agg(F.min("label").alias("near"))
        least = labels.join(near, "name").select("name", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        next_ = least.join(labels.select(F.col("name").alias("label"), F.col("label").alias("further")), "label", "left")
        labels = written(next_.select("name", F.least("label", F.coalesce("further", "label")).alias("label"), "was"), "labels")
        changed = labels.where("label <> was").isEmpty()
        labels = labels.drop("was")
        if changed:
            return labels


def projections(schemas: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Rows (key, renames): each file's own projection, an array of (name, common) of the names in it that the common table calls otherwise."""
    own = schemas.select(key, F.explode(F.array_distinct("fields.path")).alias("name"))
    return own.join(names.where("name <> common"), "name").groupBy(key).agg(F.collect_list(F.struct("name", "common")).alias("renames"))


def plain_text(value: object) -> str | None:
    """A value as one text: lists of one and objects of one field are opened, 14 digits are a time of day."""
    while isinstance(value, (list, dict)) and len(value) == 1:
        value = value[0] if isinstance(value, list) else next(iter(value.values()))
    if value is None or value == []:
        return None
    text = rendered(value)
    if isinstance(value, int) and not isinstance(value, bool) and len(text) == 14:
        return f"{text[:4]}:{text[4:6]}:{text[6:8]} {text[8:10]}:{text[10:12]}:{text[12:]}"
    return text


def one_table(records: DataFrame, names: DataFrame, files: DataFrame, columns: Mapping[str, str], key: str = "dump_id", keep: tuple[str, ...] = ("line_no", "file_key"), text: str = "record_json") -> DataFrame:
    """Every record as one row: key, keep, one text column for each field of columns (column -> any name of the field), and fields, the rest as a JSON text by common name.

    names are of common_names and files of projections: each record goes through its file's projection. Nulls and absent keys give nulls; a record that is no JSON object has null columns and no fields. Where a record holds two names of one field,
    the one called as the common table calls it counts, else the first by name, and the others stay in fields under their own names. Repeated lines stay.
    """
    ship(records.sparkSession)
    asked = {r.name: r.common for r in names.where(F.col("name").isin(*columns.values())).collect()}
    wanted = {asked.get(field, field): column for column, field in columns.items()}
    order = list(columns)
    lines = records.groupBy(key).agg(F.count("*").alias("n"))
    known = written(files.join(lines, key), "projections")
    carried = lookup_join(records.select(key, *keep, text), known, key, "n", "left", spread_by=text)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[str, list[str | None]] = {c: [] for c in [*order, "fields"]}
            for t, renames in zip(b.column(text).to_pylist(), b.column("renames").to_pylist()):
                own = {x["name"]: x["common"] for x in renames or []}
                given = {name: x for name, x in sorted(record_of(t).items()) if x is not None}
                record = {name: x for name, x in given.items() if name not in own}
                for name, x in given.items():
                    if name in own:
                        record[own[name] if own[name] not in record else name] = x
                for common, column in wanted.items():
                    found[column].append(plain_text(record.pop(common, None)))
                found["fields"].append(json.dumps(record, sort_keys=True, ensure_ascii=False))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (key, *keep)), *(pa.array(found[c], pa.string()) for c in [*order, "fields"])], names=[key, *keep, *order, "fields"])

    kinds = dict(records.dtypes)
    return carried.mapInArrow(read, ", ".join([*(f"{c} {kinds[c]}" for c in (key, *keep)), *(f"{c} string" for c in [*order, "fields"])]))
