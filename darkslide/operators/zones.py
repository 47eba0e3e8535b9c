"""Time zones of places: exact region, else the nearest one; and upkeep of the zone table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from darkslide.functions.temporal import format_offset_floor, has_exif_form, local_time, seconds_of, wall_offset
from darkslide.operators.spatial import containing_regions, region_edges
from darkslide.session import small_enough, written

#: A zone whose centroid is within so many degrees of longitude beats any nearer one.
BAND_DEG = 7.5
#: Metres of a degree of latitude, and the least share of it that a degree of longitude keeps near the poles.
DEGREE_M, LEAST_SHARE = 111_320.0, 1e-6
#: Edges that are broadcast at a time in the search for the nearest zone.
MOST_EDGES = 500_000
POINTS_A_TASK = 100_000


def lon_delta(a: Column, b: Column) -> Column:
    """Least difference of two longitudes in degrees, over the date line if that is shorter."""
    d = F.abs(a - b)
    return F.when(d > 180, 360 - d).otherwise(d)


def metres_to_degrees(lat: Column, metres: Column) -> tuple[Column, Column]:
    """metres as degrees of latitude and of longitude at lat."""
    return metres / DEGREE_M, metres / F.greatest(F.lit(LEAST_SHARE), DEGREE_M * F.cos(F.radians(lat)))


def ring_bounds(rings: Column) -> list[Column]:
    """min_lon, min_lat, max_lon, max_lat of an array of rings."""
    points = F.flatten(rings)
    of = lambda f, c: f(F.transform(points, lambda p: p[c]))
    return [of(F.array_min, "lon").alias("min_lon"), of(F.array_min, "lat").alias("min_lat"), of(F.array_max, "lon").alias("max_lon"), of(F.array_max, "lat").alias("max_lat")]


def centroid_lon(ring: Column) -> Column:
    """Longitude of the area's centroid of one closed ring, null for one without area."""
    n = F.size(ring) - 1
    pairs = F.zip_with(F.slice(ring, 1, n), F.slice(ring, 2, n), lambda p, q: F.struct((p["lon"] * q["lat"] - q["lon"] * p["lat"]).alias("c"), (p["lon"] + q["lon"]).alias("s")))
    sums = F.aggregate(pairs, F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("m")), lambda t, e: F.struct((t["a"] + e["c"]).alias("a"), (t["m"] + e["c"] * e["s"]).alias("m")))
    return sums["m"] / F.nullif(3 * sums["a"], F.lit(0.0))


def segment_distances(x: np.ndarray, y: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Planar distance of each point to each edge of its own block: edges are (x0, y0, x1, y1) along the last axis, blocks along the first."""
    x0, y0, x1, y1 = np.moveaxis(edges, -1, 0)
    dx, dy = x1 - x0, y1 - y0
    length = np.where(dx * dx + dy * dy == 0, 1, dx * dx + dy * dy)
    along = np.clip(((x[:, None] - x0) * dx + (y[:, None] - y0) * dy) / length, 0, 1)
    return np.hypot(x[:, None] - x0 - along * dx, y[:, None] - y0 - along * dy)


class EdgeBlocks:
    """Edges in blocks of neighbours of one region, with the bounds of each: a point is held only against the blocks that may be nearest."""

    SIZE = 64

    def __init__(self, edges: np.ndarray, region: np.ndarray, centre: np.ndarray) -> None:
        blocks, regions, centres = [], [], []
        for r in np.unique(region):
            own = edges[region == r]
            x, y = own[:, 0] + own[:, 2], own[:, 1] + own[:, 3]
            # Stripes of about as many blocks across as along.
            stripe = np.argsort(np.argsort(x, kind="stable"), kind="stable") // (self.SIZE * max(1, int(np.sqrt(len(own) / self.SIZE))))
            own = own[np.lexsort((y, stripe))]
            filled = np.concatenate([own, np.repeat(own[-1:], -len(own) % self.SIZE, axis=0)]).reshape(-1, self.SIZE, 4)
            blocks.append(filled)
            regions.append(np.full(len(filled), r))
            centres.append(np.full(len(filled), centre[np.argmax(region == r)]))
        self.edges, self.region, self.centre = np.concatenate(blocks), np.concatenate(regions), np.concatenate(centres)
        self.low = np.minimum(self.edges[:, :, :2], self.edges[:, :, 2:]).min(1)
        self.high = np.maximum(self.edges[:, :, :2], self.edges[:, :, 2:]).max(1)

    def nearest(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each point the nearest region, the lowest of equally near ones, whether it is beyond the band, and its distance."""
        away = np.abs(x[:, None] - self.centre)
        inside = np.where(away > 180, 360 - away, away) <= BAND_DEG
        beyond = ~inside.any(1)
        gap = lambda v, i: np.maximum(np.maximum(self.low[:, i] - v[:, None], v[:, None] - self.high[:, i]), 0)
        least = np.where(inside | beyond[:, None], np.hypot(gap(x, 0), gap(y, 1)), np.inf)
        # The distance to the block whose bounds are nearest limits which others have to be looked at.
        first = least.argmin(1)
        limit = segment_distances(x, y, self.edges[first]).min(1)
        point, block = np.nonzero(least <= limit[:, None] * (1 + 1e-12))
        distance = np.empty(len(point))
        for k in range(0, len(point), 20_000):
            at = slice(k, k + 20_000)
            distance[at] = segment_distances(x[point[at]], y[point[at]], self.edges[block[at]]).min(1)
        order = np.lexsort((self.region[block], distance, point))
        chosen = order[np.searchsorted(point[order], np.arange(len(x)))]
        return self.region[block[chosen]], beyond, distance[chosen]


def _seek(held: Broadcast):
    """Reader of points that gives each its nearest zone among those held, whether that is beyond the band, and the distance."""

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        blocks = EdgeBlocks(np.column_stack([table.column(c).to_numpy() for c in ("x0", "y0", "x1", "y1")]), table.column("region").to_numpy(), table.column("centroid_lon").to_numpy())
        step = max(1, 2_000_000 // len(blocks.region))
        for b in batches:
            lon, lat = b.column("lon").to_numpy(), b.column("lat").to_numpy()
            if len(lon):
                found = [blocks.nearest(lon[k : k + step], lat[k : k + step]) for k in range(0, len(lon), step)]
                region, beyond, distance = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(region), pa.array(beyond), pa.array(distance)], names=["id", "region", "beyond", "distance"])

    return seek


def _nearest(points: DataFrame, zones: DataFrame) -> DataFrame:
    """Rows (id, region) for points outside of all zones: the nearest in the band of longitude, else the nearest; ties go to the lowest pos.

    The zones' edges are broadcast, at most MOST_EDGES of them at a time; were there more, blocks of zones follow each other and each point keeps its best.
    """
    edges = written(region_edges(zones).join(zones.select(F.col("pos").cast("bigint").alias("region"), "centroid_lon"), "region"), "zone-edges")
    rows = points.count()
    # Each task has at most POINTS_A_TASK of them, and all cores have some.
    tasks = max(-(-rows // POINTS_A_TASK), min(points.sparkSession.sparkContext.defaultParallelism, -(-rows // 1_000)), 1)
    spread_out = points.select("id", "lat", "lon").repartition(tasks)
    kind = points.schema["id"].dataType.simpleString()
    parts, block, size = [], [], 0
    for region, number in [*sorted(map(tuple, edges.groupBy("region").count().collect())), (None, 0)]:
        if block and (region is None or size + number > MOST_EDGES):
            held = points.sparkSession.sparkContext.broadcast(edges.where(F.col("region").between(block[0], block[-1])).orderBy("region").toArrow())
            parts.append(spread_out.mapInArrow(_seek(held), f"id {kind}, region bigint, beyond boolean, distance double"))
            block, size = [], 0
        block.append(region)
        size += number
    if not parts:
        return points.select("id", F.lit(None).cast("bigint").alias("region"))
    if len(parts) == 1:
        return parts[0].select("id", "region")
    best = parts[0]
    for part in parts[1:]:
        best = best.unionByName(part)
    return best.groupBy("id").agg(F.min(F.struct("beyond", "distance", "region"))["region"].alias("region"))


def zone_of_points(points: DataFrame, id_column: str, zones: DataFrame, tolerance: float = BAND_DEG) -> DataFrame:
    """Rows (id, tz): the zone of each distinct (id, lat, lon). The first zone by pos that contains the point, else the nearest one; a tolerance of 0 leaves it null, its size otherwise doesn't matter.

    Points with a null coordinate and, with 0, those outside of all zones have a null tz.
    """
    rows = written(points.select(F.col(id_column).alias("id"), "lat", "lon").distinct(), "zone-points")
    inside = containing_regions(rows, "id", zones).groupBy("id").agg(F.min("region").alias("region"))
    exact = written(rows.join(inside, "id", "left"), "zone-found")
    if tolerance:
        outside = exact.where("region is null and lat is not null and lon is not null")
        found = exact.where("region is not null").select("id", "region").unionByName(_nearest(outside, zones)).unionByName(exact.where("lat is null or lon is null").select("id", F.lit(None).cast("bigint").alias("region")))
    else:
        found = exact.select("id", "region")
    names = zones.select(F.col("pos").cast("bigint").alias("region"), F.col("tz_name").alias("tz"))
    names = F.broadcast(names) if small_enough(zones.count()) else names
    return found.join(names, "region", "left").select(F.col("id").alias(id_column), "tz")


def local_times(points: DataFrame, id_column: str, zones: DataFrame, instant: str = "utc") -> DataFrame:
    """Rows (id, tz, offset_s, local) of points (id, lat, lon, instant in UTC without zone): the zone there, its offset at the instant and the wall time; null where there is none. ids are unique."""
    found = zone_of_points(points, id_column, zones).join(points.select(id_column, instant), id_column, "left")
    local = local_time(F.col("tz"), F.col(instant))
    return found.select(id_column, "tz", seconds_of(local - F.col(instant)).alias("offset_s"), local.alias("local"))


def distinct_ids(df: DataFrame, key: str) -> DataFrame:
    """The ids that are neither null nor empty, once each, in order."""
    return df.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).select(key).distinct().orderBy(key)


def neighbours(points: DataFrame, id_column: str, metres: float) -> DataFrame:
    """Rows (id, k, lat, lon) of the eight points at metres to the sides and corners of each point."""
    dlat, dlon = metres_to_degrees(F.col("lat"), F.lit(float(metres)))
    around = F.array(*[F.struct(F.lit(k).alias("k"), (F.col("lat") + a * dlat).alias("lat"), (F.col("lon") + b * dlon).alias("lon")) for k, (a, b) in enumerate([(1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (1, -1), (-1, 1), (-1, -1)])])
    return points.select(F.col(id_column), F.inline(around))


def check_offsets(records: DataFrame, id_column: str, zones: DataFrame, tolerance_m: float = 200, strict: bool = False) -> DataFrame:
    """Rows (id, expected, declared, error_class, error) for records (id, lat, lon, wall, declared) and, if they have it, taken: the text of the capture time.

    expected is ±HH:MM of the zone at the place and wall time. Where it isn't the declared one, the eight neighbours at
    tolerance_m are tried, only then. error_class is null where all agrees, else the first of: NoGpsError without a place; TzMismatchError without a declared
    offset; NoCaptureDateTimeError without a capture time (taken is null or empty; without taken, wall is null); ValueError where taken has the form of a date and time
    that the calendar or clock doesn't have; TzMismatchError where taken has no such form, where the place has no zone, and where offsets differ. With strict,
    missing data is a TzMismatchError, too, with the same text. ids are unique.
    """
    has_text = "taken" in records.columns
    rows = written(records.select(F.col(id_column).alias("id"), "lat", "lon", "wall", "declared", *(["taken"] if has_text else [])), "offset-rows")
    known = rows.where("lat is not null and lon is not null and wall is not null and declared is not null")
    tz = zone_of_points(known, "id", zones)
    expected = written(known.join(tz, "id").withColumn("expected", format_offset_floor(wall_offset(F.col("tz"), F.col("wall")))), "expected")
    wrong = expected.where("expected <> declared")
    around = neighbours(wrong, "id", tolerance_m).select(F.struct("id", "k").alias("at"), "lat", "lon")
    nearby = zone_of_points(around, "at", zones).select(F.col("at.id").alias("id"), "tz").distinct()
    near = nearby.join(wrong.select("id", "wall", "declared"), "id").where(format_offset_floor(wall_offset(F.col("tz"), F.col("wall"))) == F.col("declared")).select("id").distinct().withColumn("near", F.lit(True))
    out = rows.join(expected.select("id", "expected"), "id", "left").join(near, "id", "left")
    taken = F.coalesce("taken", F.lit("")) if has_text else F.lit("")
    place = F.concat(F.lit("("), F.col("lat").cast("string"), F.lit(", "), F.col("lon").cast("string"), F.lit(")"))
    error = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    mismatch, absent = "TzMismatchError", "TzMismatchError" if strict else None
    found = (
        F.when(F.col("lat").isNull() | F.col("lon").isNull(), error(absent or "NoGpsError", F.lit("No GPS coordinates in metadata (latitude/longitude missing)")))
        .when(F.col("declared").isNull(), error(mismatch, F.lit("Missing timezone offset")))
        .when(F.col("wall").isNull() & (taken == ""), error(absent or "NoCaptureDateTimeError", F.lit("Missing capture datetime (e.g., EXIF:DateTimeOriginal)")))
        .when(F.col("wall").isNull() & has_exif_form(taken), error("ValueError", F.concat(F.lit("Impossible date or time: "), taken)))
        .when(F.col("wall").isNull(), error(mismatch, F.concat(F.lit("Unrecognized datetime format: '"), taken, F.lit("'"))))
        .when(F.col("expected").isNull(), error(mismatch, F.concat(F.lit("Cannot resolve timezone at coords "), place)))
        .when((F.col("expected") != F.col("declared")) & F.col("near").isNull(), error(mismatch, F.concat(F.lit("Timezone offset mismatch: declared='"), "declared", F.lit("', expected='"), "expected", F.lit("' at "), place, F.lit(" for "), F.col("wall").cast("string"))))
    )
    return out.select(F.col("id").alias(id_column), "expected", "declared", found["kind"].alias("error_class"), found["text"].alias("error"))


def zone_table(mapping: DataFrame, polygons: DataFrame) -> DataFrame:
    """The zone table from rows (tz, ids: array of file ids, pos) and (id, rings): files without a zone are left out, the last zone listed for an id has it."""
    of_id = mapping.select(F.posexplode("ids").alias("k", "id"), "tz", "pos").groupBy("id").agg(F.max_by("tz", F.struct("pos", "k")).alias("tz_name"))
    of_id = written(of_id, "zone-ids")
    joined = polygons.join(F.broadcast(of_id) if small_enough(of_id.count()) else of_id, "id")
    return joined.select(F.col("id").alias("geo_id"), "tz_name", *ring_bounds(F.col("rings")), "rings")


def geojson_rings(geometry: Column) -> Column:
    """Rings of a GeoJSON geometry text, of a Polygon or MultiPolygon, as arrays of (lon, lat) structs."""
    ring = lambda r: F.transform(r, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))
    single = F.from_json(F.get_json_object(geometry, "$.coordinates"), "array<array<array<double>>>")
    several = F.from_json(F.get_json_object(geometry, "$.coordinates"), "array<array<array<array<double>>>>")
    return F.when(F.get_json_object(geometry, "$.type") == "Polygon", F.transform(single, ring)).otherwise(F.transform(F.flatten(several), ring))


def missing_ids(expected: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Distinct non-empty expected ids that aren't present, in order; complete if there are none."""
    return distinct_ids(expected, key).join(present.select(key), key, "left_anti").orderBy(key)


def needs_rebuild(files: DataFrame, *by: str) -> DataFrame:
    """One row (stale), or one (by, stale) for each set of files: they are (kind, mtime) with kind index, mapping or polygon; stale without an index, or with any file newer than it."""
    index = F.max(F.when(F.col("kind") == "index", F.col("mtime")))
    newest = F.max(F.when(F.col("kind") != "index", F.col("mtime")))
    return files.groupBy(*by).agg((index.isNull() | F.coalesce(newest > index, F.lit(False))).alias("stale"))


#: Of the layout of a stored zone table; one with another version is stale.
TABLE_VERSION = 1


def store_zones(zones: DataFrame, path: str, source: str) -> None:
    """Writes the zone table with its version and where its data came from."""
    zones.withColumn("version", F.lit(TABLE_VERSION)).withColumn("source", F.lit(source)).write.mode("overwrite").parquet(path)


def load_zones(spark: SparkSession, path: str) -> DataFrame:
    """A stored zone table of the present version; none of its rows, were it of another."""
    return spark.read.parquet(path).where(F.col("version") == TABLE_VERSION)


def needs_refresh(expected: DataFrame, present: DataFrame, key: str, stored_source: str | None, latest_source: str) -> bool:
    """Whether zone data has to be fetched: the source has changed, or an expected file isn't there."""
    return stored_source != latest_source or not missing_ids(expected, present, key).isEmpty()
