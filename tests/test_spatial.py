import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from darkslide.functions.coordinates import EARTH_RADIUS_M, degrees, positions
from darkslide.functions.slabs import Slabs
from darkslide.operators.spatial import containing_regions, near_pairs


def odd(rings, x, y):
    inside = False
    for ring in rings:
        for (x0, y0), (x1, y1) in zip(ring, ring[1:]):
            if min(x0, x1) <= x < max(x0, x1) and y0 + (x - x0) * (y1 - y0) / (x1 - x0) < y:
                inside = not inside
    return inside


def random_rings(rng, n):
    out = []
    for _ in range(n):
        cx, cy = rng.uniform(-5, 5), rng.uniform(-5, 5)
        ring = [(cx + rng.uniform(0.2, 4) * math.cos(a), cy + rng.uniform(0.2, 4) * math.sin(a)) for a in np.linspace(0, 6, rng.randrange(3, 9))]
        out.append([*ring, ring[0]])
    return out


def test_slabs_equal_ray_casting():
    rng = random.Random(3)
    for _ in range(15):
        regions = [random_rings(rng, rng.randrange(1, 4)) for _ in range(4)]
        edges = [(x0, y0, x1, y1, i) for i, rings in enumerate(regions) for ring in rings for (x0, y0), (x1, y1) in zip(ring, ring[1:])]
        slabs = Slabs(np.array([e[:4] for e in edges]), np.array([e[4] for e in edges]))
        x, y = np.array([rng.uniform(-9, 9) for _ in range(400)]), np.array([rng.uniform(-9, 9) for _ in range(400)])
        found = set(zip(*(a.tolist() for a in slabs.locate(x, y))))
        assert found == {(k, i) for k in range(400) for i, rings in enumerate(regions) if odd(rings, x[k], y[k])}


def test_no_edges():
    assert len(Slabs(np.zeros((0, 4)), np.zeros(0, int)).locate(np.array([1.0]), np.array([1.0]))[0]) == 0


@pytest.mark.parametrize(("text", "value"), [("+50.10318636", 50.10318636), (" -30.5 ", -30.5), ("+41,40538311", 41.40538311), ("38.5 N", 38.5), ("33.5 S", -33.5), ("3.3897 W", -3.3897), ("31 deg 17' 36.63\" S", -(31 + 17 / 60 + 36.63 / 3600)), ("unknown", None), ("", None), (None, None), ("1 2", None)])
def test_degrees(spark, text, value):
    found = spark.createDataFrame([(text,)], "t string").select(degrees(F.col("t"))).first()[0]
    assert found == pytest.approx(value) if value is not None else found is None


def test_positions(spark):
    df = spark.createDataFrame([("1", "2"), ("0", "0"), ("91", "2"), ("1", None), ("1", "181"), ("0", "5")], "a string, b string")
    assert sorted((r.lat, r.lon) for r in positions(df, "a", "b").collect()) == [(0, 5), (1, 2)]


def haversine(p, q):
    a, b, c, d = map(math.radians, (*p, *q))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * EARTH_RADIUS_M * math.asin(math.sqrt(h))


def test_near_pairs_everywhere(spark):
    rng = random.Random(5)
    points = []
    for lat, lon in ((47, 19), (0, 179.9999), (0, -179.9999), (89.9999, 10), (-89.9995, -170), (0.0001, 0.0001)):
        points += [(lat + rng.uniform(-0.001, 0.001) * (abs(lat) < 89), lon + rng.uniform(-0.001, 0.001) * (1 if abs(lat) < 89 else 100_000)) for _ in range(40)]
    points = [(i, a, (b + 180) % 360 - 180) for i, (a, b) in enumerate(points)]
    rows = [*points, points[0], (900, None, 1.0), (None, 47.0, 19.0), (901, points[0][1], points[0][2])]
    found = [tuple(r) for r in near_pairs(spark.createDataFrame(rows, "id bigint, lat double, lon double"), "id", 75).collect()]
    real = [*points, (901, points[0][1], points[0][2])]
    expected = {(p[0], q[0]) for p in real for q in real if p[0] < q[0] and haversine(p[1:], q[1:]) <= 75}
    assert len(found) == len(expected) and set(found) == expected


def test_regions_broadcast_and_in_strips(spark):
    rng = random.Random(7)
    regions = [random_rings(rng, 2) for _ in range(5)]
    struct = [(i, [[{"lon": x, "lat": y} for x, y in ring] for ring in rings]) for i, rings in enumerate(regions)]
    zones = spark.createDataFrame([*struct, (9, None), (10, [])], "pos int, rings array<array<struct<lon double, lat double>>>")
    points = [(k, rng.uniform(-9, 9), rng.uniform(-9, 9)) for k in range(300)]
    df = spark.createDataFrame([*points, points[0], (999, None, None)], "id bigint, lat double, lon double")
    expected = {(k, i) for k, lat, lon in points for i, rings in enumerate(regions) if odd(rings, lon, lat)}
    for most in (5_000, 0):
        found = [tuple(r) for r in containing_regions(df, "id", zones, broadcast_edges=most).collect()]
        assert len(found) == len(expected) and set(found) == expected
    assert containing_regions(df.limit(0), "id", zones).count() == containing_regions(df, "id", zones.limit(0)).count() == 0
