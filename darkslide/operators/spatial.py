"""Points near other points, and the regions that contain them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkslide.functions.coordinates import EARTH_RADIUS_M, haversine_m
from darkslide.functions.slabs import Slabs
from darkslide.session import written

#: Side of a cell in metres, at least.
CELL_M = 300.0
#: A cell with more points than this, and more than a 2,000th of all, is split over several tasks; there can't be over 2,000 such cells.
HOT_CELL, HOT_SHARE = 20_000, 2_000
#: Edges up to which the decomposition is built once and broadcast; above it, strips of it are distributed with their points.
BROADCAST_EDGES = 5_000
#: Edges and points of a strip, about: the strips become more with the edges, and busy ones are split.
STRIP_EDGES = 2_000
STRIP_POINTS = 200_000


def near_pairs(points: DataFrame, id_column: str, metres: float) -> DataFrame:
    """Rows (a, b), a < b: ids of points (lat, lon in degrees) at most metres apart on the sphere.

    Each point stands in its cell of a grid in space, and in the cells that its surroundings touch; a pair meets once, in
    the cell of a. So the date line and the poles need nothing special. Points with a null id or position have no
    pairs; several rows of one id and place count once, an id isn't paired with itself. Cells with very many points are
    split over tasks, never cut off.
    """
    side = max(CELL_M, 4 * metres)
    lat, lon = F.radians("lat"), F.radians("lon")
    xyz = (F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat))
    placed = points.select(F.col(id_column).alias("id"), "lat", "lon").where("id is not null and lat is not null and lon is not null").distinct()
    placed = written(placed.select("*", *[(v * EARTH_RADIUS_M).alias(c) for c, v in zip("xyz", xyz)]), "points")
    part = lambda c, by: F.floor((F.col(c) + by) / side).cast("bigint")
    pack = lambda i, j, k: (i + F.lit(1 << 20)) * F.lit(1 << 42) + (j + F.lit(1 << 20)) * F.lit(1 << 21) + (k + F.lit(1 << 20))
    home = placed.select(F.col("id").alias("a"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), pack(*[part(c, 0) for c in "xyz"]).alias("cell"))
    reach = metres * 1.000001
    touched = placed
    for c in "xyz":
        touched = touched.withColumn(f"c{c}", F.explode(F.array_distinct(F.array(part(c, -reach), part(c, reach)))))
    touched = touched.select(F.col("id").alias("b"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"), pack(F.col("cx"), F.col("cy"), F.col("cz")).alias("cell"))
    cells = written(home.groupBy("cell").count(), "cells")
    total = cells.agg(F.sum("count")).first()[0] or 0
    hot = cells.where(F.col("count") > max(HOT_CELL, total // HOT_SHARE)).select("cell", F.ceil(F.col("count") / HOT_CELL).cast("int").alias("salts"))
    if total > HOT_CELL:
        salts = F.coalesce("salts", F.lit(1))
        home = home.join(F.broadcast(hot), "cell", "left").withColumn("salt", F.pmod(F.xxhash64("a"), salts).cast("int")).drop("salts")
        touched = touched.join(F.broadcast(hot), "cell", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
        on = ["cell", "salt"]
    else:
        on = ["cell"]
    met = home.join(touched, on).where("a < b")
    return met.where(haversine_m(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")) <= metres).select("a", "b").distinct()


def region_edges(regions: DataFrame, region_column: str = "pos", rings: str = "rings") -> DataFrame:
    """Rows (region, x0, y0, x1, y1) of the edges of closed rings of (lon, lat); null rings and points have none."""
    each = regions.select(F.col(region_column).cast("bigint").alias("region"), F.explode(rings).alias("ring")).where("size(ring) > 1")
    ends = F.arrays_zip(F.slice("ring", 1, F.size("ring") - 1).alias("p"), F.slice("ring", 2, F.size("ring") - 1).alias("q"))
    edge = each.select("region", F.explode(ends).alias("e"))
    return edge.select("region", *[F.col(f"e.{p}.{c}").cast("double").alias(n) for p, c, n in (("p", "lon", "x0"), ("p", "lat", "y0"), ("q", "lon", "x1"), ("q", "lat", "y1"))]).dropna()


def _slabs(table: pa.Table, low: float = -np.inf, high: float = np.inf) -> Slabs:
    return Slabs(np.column_stack([table.column(c).to_numpy() for c in ("x0", "y0", "x1", "y1")]) if table.num_rows else np.zeros((0, 4)), table.column("region").to_numpy(), low, high)


def _found(ids: pa.Array, slabs: Slabs, lon: np.ndarray, lat: np.ndarray) -> tuple[pa.Array, pa.Array]:
    point, region = slabs.locate(lon, lat)
    return ids.take(pa.array(point)), pa.array(region)


def containing_regions(points: DataFrame, id_column: str, regions: DataFrame, region_column: str = "pos", broadcast_edges: int = BROADCAST_EDGES) -> DataFrame:
    """Rows (id, region) of every region whose rings contain the point (lat, lon) an odd number of times, planar in degrees.

    Regions may overlap, have holes and pieces; a point on an edge is inside on the lower and left sides. Points with a null position are in no region; repeated
    rows give one; no regions or no points give no rows.
    """
    spark = points.sparkSession
    edges = written(region_edges(regions, region_column), "edges")
    placed = points.select(F.col(id_column).alias("id"), "lat", "lon").where("lat is not null and lon is not null").distinct()
    schema = f"id {placed.schema['id'].dataType.simpleString()}, region bigint"
    if edges.count() <= broadcast_edges:
        slabs = spark.sparkContext.broadcast(_slabs(edges.toArrow()))

        def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, found = _found(b.column("id"), slabs.value, b.column("lon").to_numpy(), b.column("lat").to_numpy())
                if len(ids):
                    yield pa.RecordBatch.from_arrays([ids, found], names=["id", "region"])

        return placed.mapInArrow(locate, schema)

    # Strips with about as many edges each; beyond the outermost bounds there is no region.
    strips = -(-edges.count() // STRIP_EDGES)
    inner = edges.stat.approxQuantile("x0", [i / strips for i in range(strips + 1)], min(0.0005, 0.1 / strips))
    bounds = np.array(sorted(set(inner) | set(edges.agg(F.min(F.least("x0", "x1")), F.max(F.greatest("x0", "x1"))).first())))
    last = len(bounds) - 2

    @F.pandas_udf("int")
    def strip_of(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, x.to_numpy(), side="right") - 1, dtype="int32")

    placed = written(placed.withColumn("strip", strip_of("lon")).where(f"strip between 0 and {last}"), "strips")
    salts = np.ones(len(bounds), np.int64)
    for strip, number in placed.groupBy("strip").count().collect():
        salts[strip] = -(-number // STRIP_POINTS)

    @F.pandas_udf("int")
    def salts_of(strip: pd.Series) -> pd.Series:
        return pd.Series(salts[strip.to_numpy()], dtype="int32")

    placed = placed.withColumn("salt", F.pmod(F.xxhash64("id"), salts_of("strip")).cast("int"))
    ends = edges.withColumn("from", F.greatest(strip_of(F.least("x0", "x1")), F.lit(0))).withColumn("to", F.least(strip_of(F.greatest("x0", "x1")), F.lit(last)))
    spread = ends.withColumn("strip", F.explode(F.sequence("from", "to"))).withColumn("salts", salts_of("strip")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("from", "to", "salts")

    def join(key: tuple[pa.Scalar, ...], own: pa.Table, sides: pa.Table) -> pa.Table:
        k = key[0].as_py()
        ids, found = _found(own.column("id").combine_chunks(), _slabs(sides, float(bounds[k]), float(bounds[k + 1])), own.column("lon").to_numpy(), own.column("lat").to_numpy())
        return pa.table([ids, found], names=["id", "region"])

    return placed.groupBy("strip", "salt").cogroup(spread.groupBy("strip", "salt")).applyInArrow(join, schema)
