"""Time stamps in mixed formats and zones, as one instant in UTC each.

Distinct (kind, text, companion, zone) combinations form a dictionary: each is read once, however many rows hold it; a
stored dictionary is only added to; the instants are joined back to the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkslide.functions.stamps import instant, utc_instant
from darkslide.operators.skew import lookup_join
from darkslide.session import ship, small_enough, written


class StampField(NamedTuple):
    tag: str
    column: str
    companion: str | None = None
    #: The text and its companion, a time of day, are in UTC; else the companion is an offset.
    utc: bool = False


_DICTIONARY = "key string, n bigint, utc_us bigint"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kind, text, companion, zone = (batch.column(c).to_pylist() for c in ("kind", "raw", "companion", "zone"))
        found = [utc_instant(t, c) if k == "utc" else instant(t, c, z) for k, t, c, z in zip(kind, text, companion, zone)]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), pa.array(found, pa.int64())], names=["key", "n", "utc_us"])


def normalise_instants(df: DataFrame, fields: Sequence[StampField], id_column: str, zone_column: str | None = None, store: str | None = None) -> DataFrame:
    """Rows (id, tag, utc_us) of the values that state exactly one instant.

    store names a folder in which the dictionary is kept: a later run reads only texts that are new. Nulls, blanks,
    placeholders, impossible dates and times, unknown zones, and wall times which their zone has twice or never give no
    row; rows of one id with the same instant give one row. A null id is an id like others. Other columns are dropped.
    """
    spark = df.sparkSession
    ship(spark)
    values = F.array(*[F.struct(F.lit(f.tag).alias("tag"), F.lit("utc" if f.utc else "wall").alias("kind"), F.trim(f.column).alias("raw"), (F.trim(f.companion) if f.companion else F.lit(None).cast("string")).alias("companion")) for f in fields])
    zone = F.col(zone_column) if zone_column else F.lit(None).cast("string")
    long = df.select(F.col(id_column).alias("_id"), zone.alias("zone"), F.inline(values)).where("raw <> ''")
    long = long.withColumn("zone", F.when(F.col("kind") == "wall", F.col("zone")))
    key = F.concat_ws("\u0001", "kind", "raw", F.coalesce("companion", F.lit("")), F.coalesce("zone", F.lit("")))
    found = long.groupBy("kind", "raw", "companion", "zone").agg(F.count("*").alias("n")).withColumn("key", key)
    if store is None:
        dictionary = written(found.mapInArrow(_read, _DICTIONARY), "instants")
    else:
        known = spark.read.schema(_DICTIONARY).parquet(store) if _exists(spark, store) else spark.createDataFrame([], _DICTIONARY)
        found.join(known, "key", "left_anti").mapInArrow(_read, _DICTIONARY).write.mode("append").parquet(store)
        dictionary = spark.read.schema(_DICTIONARY).parquet(store)
    rows = lookup_join(long.select("_id", "tag", key.alias("key")), dictionary.where("utc_us is not null"), "key", "n")
    return rows.select(F.col("_id").alias(id_column), "tag", "utc_us").distinct()


def _exists(spark, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def with_home_zone(records: DataFrame, cameras: DataFrame, id_column: str = "rec_id", key: str = "camera_id", zone: str = "home_zone") -> DataFrame:
    """records with the zone of their camera; null where the camera is null, unknown or has none. The first by name counts, were a camera listed twice."""
    zones = cameras.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(zone).alias(zone))
    if small_enough(cameras.count()):
        return records.join(F.broadcast(zones), key, "left")
    weighed = written(records.groupBy(key).count().join(zones, key), "zones")
    return lookup_join(records, weighed, key, "count", "left", spread_by=id_column)
