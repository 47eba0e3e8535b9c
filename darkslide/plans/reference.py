"""Queries of the metadata operators, each over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from darkslide.functions import nested as N
from darkslide.functions import temporal as T
from darkslide.operators import checks, rules, zones
from darkslide.operators.spatial import region_edges
from darkslide.session import table

# Zones to which customers and events are dealt, all with whole-hour changes.
ZONES = ("Europe/Paris", "America/New_York", "Asia/Tokyo", "Australia/Sydney", "Europe/Budapest", "America/Denver", "Asia/Kolkata", "Africa/Nairobi")

RULES = rules.Rules(
    delete=("System:FileModifyDate", "SourceFile"),
    floats=("ExifIFD:ExposureCompensation", "Composite:GPSLatitude"),
    ints=("XMP-xmp:Rating", "File:ImageWidth"),
    equal=(("IPTC:Keywords", "XMP:Subject"),),
)


def _zone(key: Column) -> Column:
    return F.array(*[F.lit(z) for z in ZONES])[(key % len(ZONES)).cast("int")]


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with a wall time and a zone."""
    wall = F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(0), ((F.col("o_orderkey") % 96) * 15).cast("int"))
    return table(spark, folder, "orders").select("o_orderkey", wall.alias("wall"), _zone(F.col("o_custkey")).alias("tz"))


def _points(spark: SparkSession, folder: str) -> DataFrame:
    """Events with a place each, all over the world."""
    lat = (F.col("event_id") * 7919 % 17000) / 100.0 - 85
    lon = (F.col("event_id") * 104729 % 36000) / 100.0 - 180
    return table(spark, folder, "events").select("event_id", "ts", lat.alias("lat"), lon.alias("lon"))


def _tags(spark: SparkSession, folder: str) -> DataFrame:
    """Photo records, copies once, as ordered tags."""
    photos = table(spark, folder, "photo_record").drop("received_at").distinct()
    tags = rules.record_tags(**{
        "SourceFile": F.col("source_file"), "ExifIFD:DateTimeOriginal": F.col("exififd_date_time_original"), "ExifIFD:OffsetTimeOriginal": F.col("exififd_offset_time_original"), "EXIF:GPSDateStamp": F.col("exif_gps_date_stamp"),
        "EXIF:GPSTimeStamp": F.col("exif_gps_time_stamp"), "XMP:DateCreated": F.col("xmp_date_created"), "IPTC:Keywords": F.col("iptc_keywords"), "XMP:Subject": F.col("xmp_subject"), "Composite:GPSLatitude": F.col("composite_gps_latitude"),
        "Composite:GPSLongitude": F.col("composite_gps_longitude"), "File:ImageWidth": F.col("file_image_width").cast("string"), "ExifIFD:ExposureCompensation": F.col("exififd_exposure_compensation"),
        "XMP-xmp:Rating": F.col("xmp_rating").cast("string"), "System:FileModifyDate": F.col("system_file_modify_date"),
    })
    return photos.select("rec_id", tags.alias("tags"))


def _text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def zone_offsets(spark: SparkSession, folder: str) -> DataFrame:
    points = _points(spark, folder)
    found = zones.zone_of_points(points, "event_id", table(spark, folder, "tz_zone")).join(points.select("event_id", "ts"), "event_id")
    return found.groupBy("tz", T.format_offset_floor(T.wall_offset(F.col("tz"), F.col("ts"))).alias("utc_offset")).agg(F.count("*").alias("events"))


def tz_from_point(spark: SparkSession, folder: str) -> DataFrame:
    return zones.zone_of_points(_points(spark, folder), "event_id", table(spark, folder, "tz_zone"))


def tz_exact_only(spark: SparkSession, folder: str) -> DataFrame:
    return zones.zone_of_points(_points(spark, folder), "event_id", table(spark, folder, "tz_zone"), tolerance=0)


def local_offset(spark: SparkSession, folder: str) -> DataFrame:
    return _orders(spark, folder).select("o_orderkey", T.wall_offset(F.col("tz"), F.col("wall")).alias("offset_s"))


def local_time(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    return events.select("event_id", F.date_format(T.local_time(_zone(F.col("event_id")), F.col("ts")), "yyyy-MM-dd HH:mm:ss").alias("local"))


def _seconds() -> Column:
    return F.col("o_orderkey") * 37 % 100_000 - 50_000


def offset_format(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select("o_orderkey", T.format_offset_floor(_seconds()).alias("rounded_down"), T.format_offset(_seconds()).alias("seconds_dropped"))


def offset_parse(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select("o_orderkey", T.parse_offset(T.format_offset(_seconds())).alias("offset_s"))


def offset_normalize(spark: SparkSession, folder: str) -> DataFrame:
    photos = table(spark, folder, "photo_record").select("rec_id", F.col("exififd_offset_time_original").alias("raw")).distinct()
    return photos.select("rec_id", "raw", T.normalize_offset(F.col("raw")).alias("normal"))


def exif_parse(spark: SparkSession, folder: str) -> DataFrame:
    photos = table(spark, folder, "photo_record").select("rec_id", F.col("exififd_date_time_original").alias("raw")).distinct()
    return photos.select("rec_id", "raw", F.date_format(T.parse_naive(F.col("raw")), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("wall"))


def to_utc(spark: SparkSession, folder: str) -> DataFrame:
    return _orders(spark, folder).select("o_orderkey", F.date_format(T.to_utc(F.col("wall"), _seconds()), "yyyy-MM-dd HH:mm:ss").alias("utc"))


def stringify_dt(spark: SparkSession, folder: str) -> DataFrame:
    ts = F.col("ts")
    return table(spark, folder, "events").select("event_id", T.stringify_datetime(ts).alias("iso"), T.stringify_datetime(ts, exif=True).alias("exif"), T.stringify_date(ts).alias("day"), T.stringify_date(ts, exif=True).alias("exif_day"), T.stringify_time(ts).alias("clock"))


def path_date(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "photo_record").select("rec_id", "source_file").distinct().select("rec_id", T.path_date(F.col("source_file")).alias("proposed"))


def zone_bounds(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "tz_zone").select(F.col("pos").cast("bigint").alias("pos"), *zones.ring_bounds(F.col("rings")))


def ring_centroids(spark: SparkSession, folder: str) -> DataFrame:
    rings = table(spark, folder, "tz_zone").select(F.col("pos").cast("bigint").alias("pos"), F.posexplode("rings").alias("ring_no", "ring"))
    return rings.select("pos", F.col("ring_no").cast("bigint").alias("ring_no"), F.round(zones.centroid_lon(F.col("ring")), 4).alias("centroid_lon"))


def zone_edges(spark: SparkSession, folder: str) -> DataFrame:
    return region_edges(table(spark, folder, "tz_zone")).groupBy("region").agg(F.count("*").alias("edges"))


def lon_deltas(spark: SparkSession, folder: str) -> DataFrame:
    return _points(spark, folder).select("event_id", F.round(zones.lon_delta(F.col("lon"), -F.col("lat") * 2), 6).alias("delta"))


def neighbour_points(spark: SparkSession, folder: str) -> DataFrame:
    around = zones.neighbours(_points(spark, folder), "event_id", 200)
    return around.select("event_id", F.col("k").cast("bigint").alias("k"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def offset_check(spark: SparkSession, folder: str) -> DataFrame:
    """Photo records' offsets against their places; 200 m tolerance."""
    photos = table(spark, folder, "photo_record").select("rec_id", "composite_gps_latitude", "composite_gps_longitude", "exififd_date_time_original", "exififd_offset_time_original").distinct()
    tags = F.create_map(*[F.lit(x) if i % 2 == 0 else F.col(x) for i, x in enumerate(["Composite:GPSLatitude", "composite_gps_latitude", "Composite:GPSLongitude", "composite_gps_longitude", "EXIF:DateTimeOriginal", "exififd_date_time_original", "EXIF:OffsetTimeOriginal", "exififd_offset_time_original"])])
    rows = photos.select("rec_id", tags.alias("tags")).select("rec_id", F.inline(F.array(checks.offset_facts(F.col("tags")))))
    return zones.check_offsets(rows, "rec_id", table(spark, folder, "tz_zone")).select("rec_id", "expected", "declared", "error_class")


def datetime_check(spark: SparkSession, folder: str) -> DataFrame:
    records = _tags(spark, folder).select("rec_id", rules.as_map(F.col("tags")).alias("tags"))
    found = checks.datetime_findings(records, keep=["rec_id"])
    return found.select("rec_id", F.inline("findings"))


def failing_files(spark: SparkSession, folder: str) -> DataFrame:
    """Findings by severity, of failing records whose file ends in .jpg."""
    records = _tags(spark, folder).select("rec_id", rules.as_map(F.col("tags")).alias("tags"))
    jpg = records.where(F.try_element_at("tags", F.lit("SourceFile")).endswith(".jpg"))
    found = checks.failing(checks.datetime_findings(jpg, keep=["rec_id"]))
    return found.select("rec_id", F.to_json(checks.findings_by_severity(F.col("findings"))).alias("findings"))


def any_failure(spark: SparkSession, folder: str) -> DataFrame:
    records = _tags(spark, folder).select("rec_id", rules.as_map(F.col("tags")).alias("tags"))
    return checks.job_failed(checks.datetime_findings(records, keep=["rec_id"]))


def path_get(spark: SparkSession, folder: str) -> DataFrame:
    props = F.try_parse_json("props")
    return table(spark, folder, "events").select("event_id", N.get_path(props, "k", "bigint").alias("k"), N.get_path(props, "a.b", "string", F.lit("none")).alias("missing"))


def path_set(spark: SparkSession, folder: str) -> DataFrame:
    """Each event's value and user put at paths: a new one, and one within an object that is there for every other event."""
    text = F.when(F.col("event_id") % 2 == 0, '{"a":{"c":1}}').otherwise(F.col("props"))
    return table(spark, folder, "events").select("event_id", N.set_path(text, "a.b", F.col("user_id")).alias("made"), N.set_path(text, "k", F.col("event_type")).alias("replaced"))


def path_pop(spark: SparkSession, folder: str) -> DataFrame:
    """Paths taken out of objects made of each event: one that empties its object for every third, and one in every item of a list, some left empty."""
    event = F.concat(F.lit('{"m":{"x":'), "user_id", F.when(F.col("event_id") % 3 == 0, "").otherwise(',"y":2'), F.lit('},"l":[{"id":'), "event_id", F.lit('},{"id":1,"t":"'), "event_type", F.lit('"}]}'))
    taken = F.to_json(N.dropped(F.parse_json(event), "l.[].id", items=True))
    return table(spark, folder, "events").select("event_id", N.pop_path(event, "m.x").alias("pruned"), N.pop_path(event, "l.[].id", items=True).alias("fanned"), taken.alias("taken"))


def listify(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers, lists and nulls as lists."""
    value = F.parse_json(F.when(F.col("n_nationkey") % 3 == 0, F.col("n_nationkey").cast("string")).when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit("["), "n_nationkey", F.lit(","), "n_regionkey", F.lit("]"))).otherwise("null"))
    return table(spark, folder, "nation").select("n_nationkey", F.to_json(N.listed(value)).alias("items"))


def map_values_keys(spark: SparkSession, folder: str) -> DataFrame:
    change = lambda x: x * 10 if isinstance(x, int) else x.upper()
    return table(spark, folder, "events").select("event_id", N.over_json(F.col("props"), lambda d: N.mapped(d, change, keys=True)).alias("props"))


def keyword_split(spark: SparkSession, folder: str) -> DataFrame:
    photos = table(spark, folder, "photo_record").select("rec_id", "iptc_keywords").where("iptc_keywords is not null").distinct()
    return photos.select("rec_id", F.array_join(N.keywords(F.col("iptc_keywords")), "|").alias("keywords"))


def position_split(spark: SparkSession, folder: str) -> DataFrame:
    photos = table(spark, folder, "photo_record").select("rec_id", "composite_gps_latitude", "composite_gps_longitude").distinct()
    lat, lon = N.split_position(F.concat_ws("; ", "composite_gps_latitude", "composite_gps_longitude"))
    return photos.select("rec_id", lat.alias("lat"), lon.alias("lon"))


def x_join(spark: SparkSession, folder: str) -> DataFrame:
    photos = table(spark, folder, "photo_record").select("rec_id", "file_image_width", "file_image_height").distinct()
    return photos.select("rec_id", N.x_join(F.concat_ws(" ", "file_image_width", "file_image_height")).alias("size"))


def signed8(spark: SparkSession, folder: str) -> DataFrame:
    place = F.concat_ws(" ", F.format_string("%.2f", "lat"), F.format_string("%.2f", "lon"))
    return _points(spark, folder).select("event_id", N.signed8(place).alias("position"))


def flatten_singleton(spark: SparkSession, folder: str) -> DataFrame:
    """The nation keys of each region as a list, of one nation as itself."""
    lists = table(spark, folder, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_nationkey")).alias("keys"))
    flat = lambda keys: F.to_json(N.flatten_single(keys.cast("variant")))
    return lists.select("n_regionkey", flat(F.slice("keys", 1, 1)).alias("first"), flat(F.col("keys")).alias("all_keys"))


def typed_cast(spark: SparkSession, folder: str) -> DataFrame:
    photos = table(spark, folder, "photo_record").select("rec_id", "exififd_exposure_compensation", "composite_gps_latitude", F.col("xmp_rating").cast("string").alias("rating")).distinct()
    return photos.select("rec_id", N.to_float(F.col("exififd_exposure_compensation")).alias("compensation"), N.to_float(F.col("composite_gps_latitude")).alias("lat"), N.to_int(F.col("rating")).alias("rating"))


def delete_tags(spark: SparkSession, folder: str) -> DataFrame:
    records = _tags(spark, folder).select("rec_id", F.explode(rules.delete_tags(F.col("tags"), ["SourceFile", "System:FileModifyDate", "IPTC:Keywords"])).alias("t"))
    return records.groupBy(F.col("t.key").alias("tag")).agg(F.count("*").alias("records"))


def rename_group(spark: SparkSession, folder: str) -> DataFrame:
    records = _tags(spark, folder).select(F.explode("tags").alias("t"))
    return records.groupBy(rules.rename_groups(F.col("t.key")).alias("tag")).agg(F.count("*").alias("records"))


def equality_groups(spark: SparkSession, folder: str) -> DataFrame:
    found = _tags(spark, folder).select("rec_id", rules.unequal_groups(F.col("tags"), RULES).alias("u"))
    return found.where(F.size("u") > 0).select("rec_id", F.size("u").cast("bigint").alias("unequal"))


def pipeline_all(spark: SparkSession, folder: str) -> DataFrame:
    """All transformations, counted by tag and type of value."""
    done = rules.transform_records(_tags(spark, folder), RULES, ["check", "cool_out", "simple_out", "cool_in"])
    kind = F.when(F.schema_of_variant("t.value").startswith("ARRAY"), "list").when(F.schema_of_variant("t.value") == "STRING", "text").otherwise("number")
    return done.select(F.explode("tags").alias("t")).groupBy(F.col("t.key").alias("tag"), kind.alias("kind")).agg(F.count("*").alias("records"))


def missing_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Customers without an urgent order."""
    urgent = table(spark, folder, "orders").where(F.col("o_orderpriority").startswith("1"))
    return zones.missing_ids(table(spark, folder, "customer").select(F.col("c_custkey").alias("id")), urgent.select(F.col("o_custkey").alias("id")), "id")


def distinct_ids(spark: SparkSession, folder: str) -> DataFrame:
    return zones.distinct_ids(table(spark, folder, "tz_zone"), "geo_id")


def needs_rebuild(spark: SparkSession, folder: str) -> DataFrame:
    """For each station, whether an index made with its shortest dump is stale; every fifth station has no index."""
    dumps = table(spark, folder, "dump_file")
    index = dumps.groupBy("station_id").agg(F.min_by("received_at", F.struct("line_count", "dump_id")).alias("mtime"))
    files = index.select("station_id", F.lit("index").alias("kind"), "mtime").where(F.col("station_id") % 5 != 0).unionByName(dumps.select("station_id", F.lit("polygon").alias("kind"), F.col("received_at").alias("mtime")))
    return zones.needs_rebuild(files, "station_id")


def id_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Zone names by id from the inverted mapping; the last one listed has the id."""
    zone = table(spark, folder, "tz_zone")
    mapping = zone.groupBy(F.col("tz_name").alias("tz")).agg(F.sort_array(F.collect_list("geo_id")).alias("ids"), F.min("pos").alias("pos"))
    found = zones.zone_table(mapping, zone.select(F.col("geo_id").alias("id"), "rings"))
    return found.select("geo_id", "tz_name", "min_lon", "max_lat")


def merge_maps(spark: SparkSession, folder: str) -> DataFrame:
    left = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"))
    right = F.when(F.col("o_custkey") % 2 == 0, F.create_map(F.lit("priority"), F.concat(F.lit("of "), F.col("o_custkey").cast("string")))).otherwise(F.create_map(F.lit("customer"), F.col("o_custkey").cast("string")))
    merged = rules.merge_right(left, right)
    value = lambda k: F.try_element_at(merged, F.lit(k)).alias(k)
    return table(spark, folder, "orders").select("o_orderkey", value("status"), value("priority"), value("customer"), F.size(merged).cast("bigint").alias("entries"))


def positional_zip(spark: SparkSession, folder: str) -> DataFrame:
    """The longitudes of each ring zipped with its first five latitudes."""
    rings = table(spark, folder, "tz_zone").select(F.col("pos").cast("bigint").alias("pos"), F.posexplode("rings").alias("ring_no", "ring"))
    zipped = rings.select("pos", F.col("ring_no").cast("bigint").alias("ring_no"), F.posexplode(N.zip_positions(lon=F.col("ring.lon"), lat=F.slice("ring.lat", 1, 5))).alias("k", "p"))
    return zipped.select("pos", "ring_no", F.col("k").cast("bigint").alias("k"), F.col("p.lon").alias("lon"), F.col("p.lat").alias("lat"))


def severity_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Messages of lines joined in order, by order and status."""
    lines = table(spark, folder, "lineitem").withColumn("text", F.concat_ws(":", "l_linenumber", "l_partkey"))
    return checks.joined_messages(lines, ["l_orderkey", "l_linestatus"], ["l_linenumber", "l_partkey"], "text")


def iso_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Photo records' dates in ISO form, with the seconds of their zones."""
    photos = table(spark, folder, "photo_record").select("rec_id", F.regexp_replace("exififd_date_time_original", r"^([0-9]{4}):([0-9]{2}):([0-9]{2}) ", "$1-$2-$3T").alias("raw")).distinct()
    read = photos.select("rec_id", "raw", F.inline(F.array(T.parse_iso(F.col("raw")))))
    return read.select("rec_id", "raw", F.date_format("wall", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("wall"), "offset_s")


def assemble_datetime(spark: SparkSession, folder: str) -> DataFrame:
    records = _tags(spark, folder).select("rec_id", rules.as_map(F.col("tags")).alias("tags"))
    return checks.assembled(records, keep=["rec_id"])


def local_at_point(spark: SparkSession, folder: str) -> DataFrame:
    """Events' zones, offsets and wall times by their places."""
    found = zones.local_times(_points(spark, folder).withColumnRenamed("ts", "utc"), "event_id", table(spark, folder, "tz_zone"))
    return found.select("event_id", "tz", "offset_s", F.date_format("local", "yyyy-MM-dd HH:mm:ss").alias("local"))


QUERIES = {f.__name__: f for f in (
    zone_offsets, tz_from_point, tz_exact_only, local_offset, local_time, offset_format, offset_parse, offset_normalize, exif_parse, to_utc, stringify_dt, path_date, zone_bounds, ring_centroids, zone_edges, lon_deltas, neighbour_points,
    iso_parse, assemble_datetime, local_at_point, offset_check, datetime_check, failing_files, any_failure, path_get, path_set, path_pop, listify, map_values_keys, keyword_split, position_split, x_join, signed8, flatten_singleton, typed_cast, delete_tags, rename_group, equality_groups,
    pipeline_all, missing_ids, distinct_ids, needs_rebuild, id_lookup, merge_maps, positional_zip, severity_messages,
)}
