"""The queries pN_... of the general problems, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from darkslide.functions.coordinates import positions
from darkslide.operators.drift import common_names, file_schemas, one_table, projections, schema_changes
from darkslide.operators.impute import chained_imputation, days_and_offsets
from darkslide.operators.instants import StampField, normalise_instants, with_home_zone
from darkslide.operators.packed import split_packed
from darkslide.operators.spatial import containing_regions, near_pairs
from darkslide.functions.schematree import STEP
from darkslide.session import table, written

STAMPS = (
    StampField("ExifIFD:DateTimeOriginal", "exififd_date_time_original", "exififd_offset_time_original"),
    StampField("EXIF:GPSDateStamp", "exif_gps_date_stamp", "exif_gps_time_stamp", utc=True),
    StampField("XMP:DateCreated", "xmp_date_created", "exififd_offset_time_original"),
)
KEYWORDS = {"IPTC:Keywords": "iptc_keywords", "XMP:Subject": "xmp_subject"}
NEAR_M = 75.0


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    records = with_home_zone(table(spark, folder, "photo_record"), table(spark, folder, "camera"))
    return normalise_instants(records, STAMPS, "rec_id", "home_zone")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return split_packed(table(spark, folder, "photo_record"), KEYWORDS, ["rec_id"])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    photos = table(spark, folder, "photo_record").select("rec_id", "composite_gps_latitude", "composite_gps_longitude")
    points = written(positions(photos, "composite_gps_latitude", "composite_gps_longitude").select("rec_id", "lat", "lon").distinct(), "positions")
    near = near_pairs(points, "rec_id", NEAR_M).select(F.col("a").alias("rec_id"), F.lit("record").alias("kind"), F.col("b").alias("other_id"))
    within = containing_regions(points, "rec_id", table(spark, folder, "tz_zone")).select(F.col("id").alias("rec_id"), F.lit("zone").alias("kind"), F.col("region").alias("other_id"))
    return near.unionByName(within)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    seen = days_and_offsets(table(spark, folder, "photo_record"), "rec_id", "source_file", "exififd_date_time_original", "exififd_offset_time_original")
    filled = chained_imputation(seen, "rec_id", ["directory"], ["day", "offset"])
    each = F.array(*[F.struct(F.lit(tag).alias("tag"), F.col(f).alias("filled"), F.col(f"{f}_level").alias("level")) for tag, f in (("ExifIFD:DateTimeOriginal", "day"), ("ExifIFD:OffsetTimeOriginal", "offset"))])
    return filled.select("rec_id", F.inline(each)).where("level = 'directory'").select("rec_id", "tag", "filled")


def p6_chained(spark: SparkSession, folder: str) -> DataFrame:
    """Aperture, rating, width and exposure compensation by chained equations, with their marks."""
    photos = table(spark, folder, "photo_record").select(
        "rec_id", F.col("album_id").cast("string").alias("album"), F.col("camera_id").cast("string").alias("camera"),
        F.col("exififd_exposure_compensation").alias("compensation"), F.col("exififd_aperture_value").alias("aperture"), F.col("xmp_rating").alias("rating"), F.col("file_image_width").alias("width"),
    ).distinct()
    return chained_imputation(photos, "rec_id", ["album", "camera"], ["compensation"], ["aperture", "rating", "width"])


def _changes(spark: SparkSession, folder: str) -> DataFrame:
    return schema_changes(table(spark, folder, "raw_dump"), table(spark, folder, "dump_file"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    changes = _changes(spark, folder).where(~F.col("path").contains(STEP))
    # A field moved into another one is gone from the record itself.
    kind = F.when(F.col("kind") == "moved", "removed").otherwise(F.col("kind"))
    return changes.select("dump_id", kind.alias("change_kind"), F.col("path").alias("field_name"), F.when(kind == "renamed", F.col("new_path")).otherwise("").alias("new_name"))


def p7_table(spark: SparkSession, folder: str) -> DataFrame:
    records = table(spark, folder, "raw_dump")
    schemas = written(file_schemas(records, "dump_id", "record_json"), "schemas")
    names = common_names(written(_changes(spark, folder), "changes"), schemas)
    return one_table(records, names, projections(schemas, names, "dump_id"), {"date_time_original": "ExifIFD:DateTimeOriginal", "source_file": "SourceFile"})


QUERIES = {f.__name__: f for f in (p1_found, p3_found, p5_found, p6_found, p6_chained, p7_found, p7_table)}
