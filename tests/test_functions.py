import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayfold.functions import activity, geo, names, notes, num, s2


def value(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


@pytest.mark.parametrize(("x", "places", "want"), [(0.123456789, 4, 0.1234), (1.23456789, 0, 1.0), (-4.359, 2, -4.35), (4.35, 2, 4.35), (0.29, 2, 0.29), (12.3456789, 3, 12.345)])
def test_truncation(spark, x, places, want):
    assert value(spark, num.truncate(F.lit(x), places)) == want


def test_speed_tables(spark):
    table = [(0.1, "Stationary"), (1.0, "Walking"), (2.0, "Running"), (5.0, "Bike"), (13.0, "Automotive"), (70.0, "Fly")]
    for speed, want in table:
        assert value(spark, activity.from_speed_max(F.lit(speed))) == want
    assert value(spark, activity.from_speed_closest(F.lit(500.0))) == "Stationary"
    for name in ("Stationary", "Walking", "Running", "Bike", "Automotive", "Fly", "Unknown"):
        for v in (-1.0, 0.0, 0.2, 0.23, 1.2, 1.78, 5.56, 25.29, 44.7, 90.0):
            assert value(spark, activity.reasonable(F.lit(name), F.lit(v))) == activity.reasonable_py(name, v)


def test_names(spark):
    assert value(spark, names.subject_id(F.lit("QP1A_191005_007_A3_Pixel_XL"))) == "ric"
    assert value(spark, names.subject_id(F.lit("a b\\c.d"))) == "a_b_c_d"
    assert value(spark, names.sanitized(F.lit(""))) == "_"


def test_heart_rate(spark):
    for text, want in (("76 count/min", 76.0), ("", -1.0), ("x", -2.0), (None, -1.0)):
        assert value(spark, notes.heart_rate(F.lit(text).cast("string"))) == want


def test_known_cells():
    # Face centres, and the level-0 tokens.
    ids = s2.leaf_ids(np.array([0.0, 0.0, 90.0, 0.0, 0.0, -90.0]), np.array([0.0, 90.0, 0.0, 180.0, -90.0, 0.0]))
    assert [int(i) >> 61 for i in ids] == [0, 1, 2, 3, 4, 5]
    assert f"{int(s2.leaf_ids(np.array([0.0]), np.array([0.0]))[0]):016x}" == "1000000000000001"


@settings(max_examples=60, deadline=None)
@given(st.floats(-89.9, 89.9), st.floats(-179.9, 179.9), st.integers(2, 20))
def test_cell_holds_its_point(lat, lon, level):
    leaf = int(s2.leaf_ids(np.array([lat]), np.array([lon]))[0])
    lsb = 1 << 2 * (30 - level)
    ring = s2.ring_of(leaf & -lsb & (1 << 64) - 1 | lsb)
    vector = lambda x, y: np.array([math.cos(math.radians(y)) * math.cos(math.radians(x)), math.cos(math.radians(y)) * math.sin(math.radians(x)), math.sin(math.radians(y))])
    p, corners = vector(lon, lat), [vector(*c) for c in ring]
    sides = [float(np.dot(np.cross(a, b), p)) for a, b in zip(corners, [*corners[1:], corners[0]], strict=True)]
    assert all(x > -1e-9 for x in sides) or all(x < 1e-9 for x in sides)


def test_parents_nest(spark):
    df = spark.createDataFrame([(47.1, -112.9), (-33.0, 151.0), (71.0, 25.0)], "lat double, lon double").withColumn("leaf", s2.leaf_id("lat", "lon"))
    assert df.where(s2.parent(s2.parent(F.col("leaf"), 12), 5) != s2.parent(F.col("leaf"), 5)).count() == 0
    assert all(set(r.t) <= set("0123456789abcdef") for r in df.select(s2.token(s2.parent(F.col("leaf"), 9)).alias("t")).collect())


def test_polygons():
    hole = [[(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (3, 1), (3, 3), (1, 3)]]
    got = geo.in_rings(np.array([0.5, 2.0, 5.0]), np.array([0.5, 2.0, 0.5]), hole)
    assert got.tolist() == [True, False, False]
    assert geo.segments_cross((0, 0), (2, 2), (0, 2), (2, 0)) and not geo.segments_cross((0, 0), (1, 0), (0, 1), (1, 1))


def test_simplify_keeps_ends_and_corners():
    lon = np.array([0.0, 1.0, 2.0, 2.0, 2.0])
    lat = np.array([0.0, 0.0, 0.0, 1.0, 2.0])
    assert geo.simplify(lon, lat, 0.1).tolist() == [0, 2, 4]
    assert geo.simplify(np.array([]), np.array([]), 0.1).tolist() == []


def test_distances_agree(spark):
    rng = random.Random(3)
    for _ in range(20):
        a = [rng.uniform(-170, 170), rng.uniform(-80, 80), rng.uniform(-170, 170), rng.uniform(-80, 80)]
        want = geo.distance_py(*a)
        assert math.isclose(float(geo.distance_np(*map(np.float64, a))), want, rel_tol=1e-9)
    assert math.isclose(value(spark, geo.distance_m(*map(F.lit, a))), want, rel_tol=1e-9)
