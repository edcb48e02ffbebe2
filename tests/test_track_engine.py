"""Long subjects over many buckets, areas against plain geometry, ingest end to end, streams against batches."""

import base64
import json
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wayfold.config import SPARSE, Settings
from wayfold.functions import activity, geo, notes, num, s2
from wayfold.operators import admin, cells, clean, improve, modes, ordered, paths, quality, segments
from wayfold.operators.offsets import with_time_offset
from wayfold.plans import job, pipeline, queries
from wayfold.plans.tracks import tracks
from wayfold.scratch import materialize, scratch_dir
from wayfold.sources import ingest, sinks, versions
from wayfold.streaming import indexes, layers
from wayfold.streaming import pipeline as streaming

SF = "/root/testdata/sf0.001"
BY_TIME = ("unix_s", "event_id")


@pytest.fixture(scope="module")
def points(spark):
    return with_time_offset(tracks(spark, SF)).persist()


def rows_of(df, *columns):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect())


# Buckets do not change results.


@pytest.mark.parametrize("width", [3_600, 86_400, 1 << 40])
def test_modes_over_any_bucket(points, width):
    names = [f"am_{a.lower()}" for a in modes.TALLY_ORDER]
    whole = Window.partitionBy("subject_id").orderBy("unix_s").rangeBetween(-86_400, 0)
    name = F.when(F.col("activity") == "", "Unknown").otherwise(F.col("activity"))
    plain = points.select("event_id", *(F.sum(F.when(name == a, F.col("time_offset")).otherwise(0)).over(whole).alias(n) for a, n in zip(modes.TALLY_ORDER, names, strict=True)))
    assert rows_of(modes.with_modes(points, 86_400, width=width), "event_id", *names) == rows_of(plain, "event_id", *names)


@pytest.mark.parametrize("width", [7_200, 500_000])
def test_lent_rows_make_whole_frames(points, width):
    w = Window.partitionBy("subject_id").orderBy(*BY_TIME)
    frame = lambda w: [F.collect_list("event_id").over(w.rowsBetween(a, b)).cast("string").alias(n) for n, a, b in (("x", -5, -1), ("y", 1, 3), ("z", -4, 2))]
    plain = points.select("event_id", *frame(w))
    lent = ordered.lent_by_rows(points, ["subject_id"], BY_TIME, 5, 3, width=width)
    own = ordered.own_rows(lent.select("event_id", ordered.BUCKET, ordered.LENT, *frame(Window.partitionBy("subject_id", ordered.BUCKET).orderBy(*BY_TIME))))
    assert rows_of(own, "event_id", "x", "y", "z") == rows_of(plain, "event_id", "x", "y", "z")


@pytest.mark.parametrize("current", [True, False])
def test_running_folds(points, current):
    w = Window.partitionBy("subject_id").orderBy(*BY_TIME).rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    folds = {"total": ("sum", F.col("elevation")), "least": ("min", F.col("elevation")), "most": ("max", F.col("elevation"))}
    plain = points.select("event_id", F.coalesce(F.sum("elevation").over(w), F.lit(0.0)).alias("total"), F.min("elevation").over(w).alias("least"), F.max("elevation").over(w).alias("most"))
    key = lambda df: sorted(map(str, rows_of(df, "event_id", F.round("total", 3), "least", "most")))
    assert key(ordered.with_running(points, ["subject_id"], BY_TIME, folds, width=50_000, current=current)) == key(plain)


def test_unbacktracked_over_any_width(points):
    known = clean.device_windows(points.where(F.col("unix_s") < queries.SPLIT))
    got = [rows_of(clean.unbacktracked(points, known, width=w), "event_id") for w in (10, 1_000_000)]
    assert got[0] == got[1]
    # Plain: one pass a device in the order of arrival.
    stored = {(r.subject_id, r.device_id): (r.first_s, r.last_s) for r in known.collect()}
    pushed, keep = {}, []
    for r in sorted(points.collect(), key=lambda r: r.event_id):
        d = (r.subject_id, r.device_id)
        low, high = stored.get(d, (1, 0))
        inside = low < r.unix_s < high
        if d in pushed and pushed[d][0] < r.unix_s < pushed[d][1]:
            continue
        if d not in pushed:
            pushed[d] = (r.unix_s, r.unix_s)
        if not inside:
            pushed[d] = (min(pushed[d][0], r.unix_s), max(pushed[d][1], r.unix_s))
            keep.append((r.event_id,))
    assert got[0] == sorted(keep)


def test_average_is_the_fold(points):
    alpha = num.ewma_alpha(1.0)
    rates = {}
    for r in sorted(points.collect(), key=lambda r: (r.unix_s, r.event_id)):
        rates[r.subject_id] = rates[r.subject_id] + alpha * (r.speed - rates[r.subject_id]) if r.subject_id in rates else r.speed
    got = {r.subject_id: r.rate for r in modes.ewma(points, F.col("speed"), width=100_000).collect()}
    assert got.keys() == rates.keys() and all(math.isclose(got[k], rates[k], rel_tol=1e-9, abs_tol=1e-9) for k in got)


def test_meter_decays_as_pinned(spark):
    df = spark.createDataFrame([("a", t) for t in (0, 1, 2)], "subject_id string, unix_s long")
    at = lambda s: modes.meters(df, F.lit(s)).first()
    assert math.isclose(at(4).rate_1m, 0.6) and math.isclose(at(64).rate_1m, 0.22072766470286553) and at(64)["count"] == 3
    for minutes, one in ((1, 0.22072766470286553), (5, 0.6 * math.exp(-1 / 5)), (15, 0.6 * math.exp(-1 / 15))):
        assert math.isclose(at(64)[f"rate_{minutes}m"], one)


# Cells.


@pytest.mark.parametrize("width", [3_600, 86_400 * 30])
def test_runs_keep_visits_exact(points, width):
    levels = (3, 8, 17)
    direct = cells.accumulate(cells.with_s2(points, levels), ["subject_id", "level", "cell_id"], 3_600).withColumn("cell_key", s2.token(F.col("cell_id")))
    columns = ["subject_id", "level", "cell_key", "count", "visit_count", "first_s", "last_s", "total_offset_s", *cells.AM, "activity_mode"]
    assert rows_of(cells.s2_index(points, levels, 3_600, width), *columns) == rows_of(direct, *columns)


def test_level_keys_and_own_aggregates(spark):
    df = spark.range(1_000).select(F.lit("s").alias("subject_id"), F.col("id"))
    levels = {n: (lambda n=n: F.when(F.col("id") != 7, F.col("id") % n)) for n in (100, 10, 2)}
    got = cells.level_index(df, levels, {"n": F.count("*")}, {10: {"top": F.max("id")}})
    found = {r.level: r["count"] for r in got.groupBy("level").count().collect()}
    assert found == {100: 100, 10: 10, 2: 2} and got.where("level = 10 and (n is not null or top is null)").count() == 0 and got.agg(F.sum("n")).first()[0] == 2 * 999


def test_stored_totals_count_in_full(points):
    once = points.limit(5).withColumn("total_time_offset", F.lit(100))
    assert cells.accumulate(once, ["subject_id"], 0).agg(F.sum("total_offset_s")).first()[0] == 500


def test_rings_close_around_their_points(spark):
    lat, lon = np.array([47.1, -33.2, 80.0, 0.1]), np.array([-112.9, 151.1, 10.0, 179.9])
    leaf = s2.leaf_ids(lat, lon)
    for level in (1, 5, 13, 30):
        lsb = np.uint64(1 << 2 * (30 - level))
        rings = s2.rings_of(leaf & (~lsb + np.uint64(1)) | lsb)
        assert rings.shape == (4, 4, 2)
        for ring, x, y in zip(rings.tolist(), lon.tolist(), lat.tolist(), strict=True):
            far = max(geo.distance_py(*p, x, y) for p in ring)
            assert far <= 1.01 * max(geo.distance_py(*p, *q) for p in ring for q in ring) + 0.1
    df = spark.createDataFrame([(1 << 60,), (None,)], "c long")
    assert [r.r is None for r in df.select(s2.cell_ring("c").alias("r")).collect()] == [False, True]


# Areas.


def star(rng, x, y, size, corners):
    return [(x + math.cos(a) * size * r, y + math.sin(a) * size * r) for k in range(corners) for a, r in [(2 * math.pi * k / corners, rng.uniform(0.3, 1.0))]]


def test_areas_against_plain_polygons(spark):
    rng = random.Random(4)
    shapes = {}
    for k in range(12):
        x, y, size = rng.uniform(-30, 30), rng.uniform(-30, 30), rng.choice([0.1, 1.0, 8.0, 25.0])
        rings = [star(rng, x, y, size, rng.randint(5, 40))]
        if k % 3 == 0:
            rings.append(star(rng, x, y, size / 5, 7))  # a hole, or an island
        shapes[f"a{k}"] = rings
    box = lambda rings: [f(p[i] for r in rings for p in r) for i in (0, 1) for f in (min, max)]
    kind = f"dataset string, area_key string, min_lon double, max_lon double, min_lat double, max_lat double, rings {admin.RINGS}"
    areas = spark.createDataFrame([("cities", k, *box(r), [[{"lon": p[0], "lat": p[1]} for p in ring] for ring in r]) for k, r in shapes.items()], kind)
    places = [(i, rng.uniform(-35, 35), rng.uniform(-35, 35)) for i in range(3_000)] + [(3_000 + i, x, y) for i, (x, y) in enumerate(p for r in shapes.values() for p in [(r[0][0][0] * 0.999 + r[0][2][0] * 0.001, r[0][0][1] * 0.999 + r[0][2][1] * 0.001)])]
    df = spark.createDataFrame(places, "event_id long, lon double, lat double")
    got = {(r.event_id, r.area_key) for r in admin.locate(df, areas).collect()}
    lon, lat = (np.array([p[i] for p in places]) for i in (1, 2))
    want = {(places[i][0], k) for k, rings in shapes.items() for i in np.nonzero(geo.in_rings(lon, lat, rings))[0]}
    assert got == want and len(want) > 300
    tiles = admin.cover(areas)
    assert tiles.where(F.size("edges") > admin.MOST_EDGES).count() == 0 and tiles.where("edges is null").count() > 0


def test_long_borders_are_split(spark):
    """A coast of 20,000 edges and a fan whose edges all meet in one place, across the equator and the prime meridian."""
    rng = random.Random(9)
    turn = [2 * math.pi * k / 20_000 for k in range(20_000)]
    coast = [(0.3 + r * math.cos(a), r * math.sin(a) - 0.2) for a in turn for r in [9 + math.sin(7 * a) + rng.uniform(-0.01, 0.01)]]
    fan = [p for k in range(300) for p in ((5.0, 5.0), *((5.0 + math.cos(a), 5.0 + math.sin(a)) for a in (k / 50, (k + 0.5) / 50)))]
    shapes = {"coast": [coast], "fan": [fan]}
    kind = f"dataset string, area_key string, {', '.join(f'{c} double' for c in admin.BOX)}, rings {admin.RINGS}"
    rows = [("countries", k, *(f(p[i] for p in r[0]) for i in (0, 1) for f in (min, max)), [[{"lon": x, "lat": y} for x, y in r[0]]]) for k, r in shapes.items()]
    areas = spark.createDataFrame([*rows, ("countries", "box", -1.0, 1.0, -1.0, 1.0, None)], kind)
    tiles = admin.cover(areas)
    sizes = {r.area_key: r for r in tiles.groupBy("area_key").agg(F.max(F.size("edges")).alias("edges"), F.max("size").alias("size"), F.count("*").alias("n")).collect()}
    assert sizes["coast"].edges <= admin.MOST_EDGES and sizes["coast"].n < 10_000
    assert sizes["fan"].size == len(admin.TILES) - 1  # what no split can part is kept whole
    lon, lat = np.array([rng.uniform(-13, 13) for _ in range(4_000)] + [5 + rng.uniform(-1.2, 1.2) for _ in range(1_000)]), np.array([rng.uniform(-13, 13) for _ in range(4_000)] + [5 + rng.uniform(-1.2, 1.2) for _ in range(1_000)])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(lon, lat, strict=True))] + [(9_000, None, 1.0), (9_001, 400.0, 1.0)], "event_id long, lon double, lat double")
    got = {(r.event_id, r.area_key) for r in admin.locate(df, areas).collect()}
    want = {(int(i), k) for k, rings in shapes.items() for i in np.nonzero(geo.in_rings(lon, lat, rings))[0]}
    assert got == want | {(int(i), "box") for i in np.nonzero((lon >= -1) & (lon < 1) & (lat >= -1) & (lat < 1))[0]}
    assert {k for _, k in want} == {"coast", "fan"}


def test_areas_are_read_and_looked_up(spark, tmp_path):
    square = lambda x: [[[x, 0.0], [x + 1, 0.0], [x + 1, 1.0], [x, 1.0], [x, 0.0]]]
    feature = lambda kind, xy, **names: json.dumps({"type": "Feature", "geometry": {"type": kind, "coordinates": xy}, "properties": names})
    lines = [feature("Polygon", square(0.0), country_code3="USA", province_code="MT", county="West"), feature("MultiPolygon", [square(2.0), square(4.0)], country_code3="USA", province_code="MT", county="East"), feature("Polygon", square(8.0), country_code3="FRA", province_code="X", county="Y"), "broken"]
    (tmp_path / "areas.json").write_text("\n".join(lines))
    areas = admin.read_areas(spark, str(tmp_path / "areas.json"), "counties")
    assert sorted(r.area_key for r in areas.collect()) == ["USA-MT-East", "USA-MT-West"]  # counties exist in the USA only
    df = spark.createDataFrame([(1, 0.5, 0.5), (2, 4.5, 0.5), (3, 3.5, 0.5), (4, 8.5, 0.5)], "event_id long, lon double, lat double")
    got = {r.event_id: (r.area_key, r.rings and len(r.rings)) for r in admin.geometry(df, areas, "counties").collect()}
    assert got == {1: ("USA-MT-West", 1), 2: ("USA-MT-East", 2), 3: (None, None), 4: (None, None)}
    index = spark.createDataFrame([("counties", "USA-MT-West", 3)], "dataset string, area_key string, count int")
    assert admin.enrich(index, areas).first().rings is not None


# Ingest.

FEATURE = {"type": "Feature", "geometry": {"type": "Point", "coordinates": [10.5, 50.25]}, "properties": {"Name": "tester", "UUID": "x", "Time": "2024-01-01T00:00:00Z", "UnixTime": 1704067200, "Accuracy": 5.9, "Odd": None, "GyroscopeX": 0.001, "GyroscopeY": -0.002, "GyroscopeZ": 0.003}}


def messages(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


@pytest.mark.parametrize("depth", [1, 2, 9, 200])
def test_collections_in_collections(spark, depth):
    now = FEATURE
    for _ in range(depth):
        now = {"type": "FeatureCollection", "features": [now, FEATURE]}
    df = messages(spark, [json.dumps(now), json.dumps([now])])
    # Every level adds a point.
    assert ingest.decode(df).count() == 2 * (depth + 1) and ingest.rejected(df).count() == 0


def test_collections_without_features_and_odd_types(spark):
    texts = ['{"type":"FeatureCollection"}', json.dumps([{"type": "FeatureCollection", "features": None}, {"type": "FeatureCollection", "features": FEATURE}]), "[" * 100_000, '{"type":"Feature\\u0043ollection","features":[]}', '{"type":"Feature","geometry":"x","properties":5}']
    texts.append(json.dumps(dict(FEATURE, properties=dict(FEATURE["properties"], UnixTime="1704067200"))))
    df = messages(spark, texts)
    assert sorted(r.invalid_reason for r in ingest.rejected(df).collect()) == [ingest.TOO_DEEP, ingest.TOO_DEEP, ingest.NO_FEATURES]
    points = quality.validate(ingest.decode(df))
    assert sorted(str(r.invalid_reason) for r in points.collect()) == ["None", "empty", "times differ"]


def test_every_element_is_accounted_for(spark):
    texts = [json.dumps(FEATURE), json.dumps([FEATURE, {"type": "Other"}, {"uuid": "x"}]), "", "  ", "[]", "nope", json.dumps({"type": "FeatureCollection", "features": []}), "7", json.dumps([[FEATURE]])]
    df = messages(spark, texts)
    refused = sorted(r.invalid_reason for r in ingest.rejected(df).collect())
    assert ingest.decode(df).count() == 2 and refused == sorted(["unknown type", "no place", "not readable", "no place", "no place"])
    assert ingest.rejected(df.where("false")).count() == 0


def test_admitted_points(spark):
    texts = [json.dumps(FEATURE)] * 3 + [json.dumps(dict(FEATURE, properties=dict(FEATURE["properties"], imgB64="")))]
    stored, images, bad = pipeline.admit(ingest.decode(messages(spark, texts)), F.lit(9).cast("long"))
    first = stored.where("img_b64 is null").first()
    assert stored.count() == 2 and images.count() == 1 and bad.count() == 0
    assert (first.accuracy, first.received_at, first.extras, round(first.gyro_sum, 6)) == (5.0, 9, {}, 0.006) and "wrong_types" not in stored.columns


def test_windowed_improver_by_hand(spark):
    """A walk reported as such, a leap of the leader, a stillness that moves, points too close, a silence, another subject."""
    rows = [(k, "a", 1_000 + 10 * k, "Walking" if k < 8 else "Bike", 1.0, 0.0) for k in range(16)]
    rows += [(20, "a", 1_151, "Fly", 300.0, 0.0), (30, "a", 2_000, "", 3.0, 0.0), (31, "a", 2_010, "", 3.0, 0.0)]
    rows += [(40 + k, "b", 1_000 + 20 * k, "Stationary", 0.0, 0.001 * k) for k in range(5)] + [(50, "c", 5, None, None, 0.0)]
    df = spark.createDataFrame([(i, s, t, name, speed, 10.0 + east, 0.0) for i, s, t, name, speed, east in rows], "event_id long, subject_id string, unix_s long, activity string, speed double, lon double, lat double")
    got = {r.event_id: r.activity for r in improve.improve_by_windows(df).collect()}
    # Looked at 0, 40, 80 and 120 s after the start; the window of the third still holds more of walking.
    assert [got[k] for k in range(16)] == ["Walking"] * 12 + ["Bike"] * 4
    assert got[20] == "Bike" and got[30] == got[31] == "Running"  # within a second; after the reset its speed alone decides
    assert [got[40 + k] for k in range(5)] == ["Stationary", "Stationary", "Running", "Running", "Running"]  # 111 m in 20 s, reported as none
    assert got[50] == "Stationary"
    assert improve.improve_by_windows(df.where("false")).count() == 0


def test_gyro_stills_the_improver(spark):
    rows = [(i, "u1", "d1", i * 10, 0.0, i * 1e-5, 5.0, 0.1, 10.0, 100.0, "Walking", 0.001 if i else None) for i in range(20)]
    kind = "event_id long, subject_id string, device_id string, unix_s long, lon double, lat double, accuracy double, speed double, heading double, elevation double, activity string, gyro_sum double"
    with_gyro = with_time_offset(spark.createDataFrame(rows, kind))
    last = lambda df: improve.improve(df).where("event_id = 19").first().activity
    assert last(with_gyro) == "Stationary" != last(with_gyro.drop("gyro_sum"))


def test_snaps_are_decoded_and_stripped(spark):
    jpeg = base64.b64encode(b"\xff\xd8\xff\xe0rest").decode()
    rows = [(1, "u", "d", 5, jpeg, None), (2, "u", "d", 6, "!!", None), (3, "u", "d", 7, None, "b/k"), (4, "u", "d", 8, None, None), (5, "u", "d", 9, base64.b64encode(b"text").decode(), None)]
    df = spark.createDataFrame(rows, "event_id long, subject_id string, device_id string, unix_s long, img_b64 string, img_s3 string")
    got = {r.event_id: r for r in quality.decoded_snaps(df, "store").collect()}
    assert set(got) == {1, 2, 3, 5} and bytes(got[1].image).endswith(b"rest") and got[2].image is None is got[5].image
    assert got[1].img_s3 == "store/u_d_0000000005" and got[3].img_s3 == "b/k" and "img_b64" not in got[1].asDict()


def test_small_helpers(spark):
    df = spark.createDataFrame([("u", 0, 1.0, 2.0, None, 3.0, "Bike", {"a": "1"})], "subject_id string, unix_s long, lon double, lat double, speed double, accuracy double, activity string, extras map<string,string>")
    set_, gone = quality.with_property(df, "b", F.lit(2)).first().extras, quality.without_property(df, "a").first().extras
    assert set_ == {"a": "1", "b": "2"} and gone == {} and quality.with_property(df, "a", F.lit(9)).first().extras == {"a": "9"}
    assert df.select(quality.pretty(df)).first()[0] == "u 1970-01-01T00:00:00Z [1.000000,2.000000] -1.00m/s +-3m Bike"
    assert df.select(activity.emoji(F.col("activity"))).first()[0] == "\N{BICYCLIST}" and df.select(activity.from_code(activity.code(F.col("activity")))).first()[0] == "Bike"
    back = ingest.to_legacy(df.withColumn("device_id", F.lit("d")).withColumn("name", F.lit("u")).withColumn("heading", F.lit(1.0)).withColumn("elevation", F.lit(4.0)))
    again = ingest.decode(back.select(F.to_json(F.struct("*")).alias("value"))).first()
    assert (again.subject_id, again.unix_s, again.lon, again.lat, again.activity) == ("u", 0, 1.0, 2.0, "Bike")


def test_notes(spark):
    visit = {"uuid": "v", "arrivalDate": "2024-01-01", "place": "home", "validVisit": True}
    text = json.dumps({"visit": json.dumps(visit), "networkInfo": json.dumps({"ssid": "net"}), "fingerprintHash": "", "fingerprintHashMD5": "m"})
    n = notes.parsed(F.col("t"))
    row = spark.createDataFrame([(text,), ("{}",)], "t string").select(notes.visit(n)["place"].alias("place"), notes.has_valid_visit(n).alias("ok"), notes.network(n)["ssid"].alias("net"), notes.fingerprint(n).alias("print")).collect()
    assert tuple(row[0]) == ("home", True, "net", "m") and not row[1].ok


def test_bearings_and_boxes(spark):
    one = spark.range(1)
    at = lambda *c: one.select(geo.bearing_deg(*map(F.lit, c))).first()[0]
    assert math.isclose(at(0.0, 0.0, 1.0, 0.0), 90.0) and math.isclose(at(0.0, 0.0, 0.0, 1.0), 0.0, abs_tol=1e-9) and math.isclose(at(0.0, 0.0, -1.0, 0.0), -90.0)
    area = one.select(geo.box_area_m2(*map(F.lit, (0.0, 0.0, 1.0, 1.0)))).first()[0]
    assert math.isclose(area, (geo.RADIUS * math.pi / 180) ** 2, rel_tol=1e-4)


def test_sinks_and_layers(spark, tmp_path):
    t = tracks(spark, SF)
    sinks.store_pushed(t, str(tmp_path / "all"), str(tmp_path / "last"))
    sinks.store_pushed(t.limit(10), str(tmp_path / "all"), str(tmp_path / "last"))
    assert spark.read.parquet(str(tmp_path / "all")).count() == t.count() + 10 and spark.read.parquet(str(tmp_path / "last")).count() == 10
    raw = messages(spark, ["one", "two"])
    sinks.raw_log(raw, str(tmp_path / "log"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "log")).collect()) == ["one", "two"]
    sinks.store_monthly(t, str(tmp_path / "monthly"), 4)
    own = sinks.stored_points(spark, str(tmp_path / "monthly"), "u7", 4)
    assert sinks.stored_points(spark, str(tmp_path / "monthly")).count() == t.count() and rows_of(own, "event_id") == rows_of(t.where("subject_id = 'u7'"), "event_id")
    filters = own._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert "subject_bucket" in filters
    wide = sinks.metrics(with_time_offset(t).withColumn("alias", F.lit("a")).withColumn("pressure", F.lit(1.0)))
    assert {"measurement", "alias", "pressure", "time_offset", "battery_state"} <= set(wide.columns)


def test_compaction_loses_and_doubles_nothing(spark, tmp_path, monkeypatch):
    t = tracks(spark, SF)
    edge, whole = str(tmp_path / "edge"), str(tmp_path / "whole")
    push = lambda: t.select(sinks.feature_json(t).alias("value")).repartition(4).write.mode("append").text(edge)
    count = lambda: sinks.layer_lines(spark, whole, edge).count()
    push()
    assert not sinks.compact_layer(spark, edge, whole, files=9) and count() == t.count()
    stop = lambda *a: (_ for _ in ()).throw(RuntimeError("crash"))
    with monkeypatch.context() as m:
        m.setattr(versions, "commit", stop)
        with pytest.raises(RuntimeError):
            sinks.compact_layer(spark, edge, whole, files=2)
    assert count() == t.count() and sinks.layer_lines(spark, whole).count() == 0
    assert sinks.compact_layer(spark, edge, whole, files=2) and not sinks.compact_layer(spark, edge, whole, files=2)
    # The edge files are still there, and no line counts twice.
    assert count() == sinks.layer_lines(spark, whole).count() == t.count() and len(sinks.layer_lines(spark, whole).inputFiles()) == 1
    push()
    assert count() == 2 * t.count() and sinks.compact_layer(spark, edge, whole, files=2) and count() == 2 * t.count()


def test_visits_of_any_batches_unite_to_the_index(points):
    """Batches that overlap in time, and in any order, give the index of all points."""
    some = materialize(points.where("event_id < 400"), "some")
    part = F.pmod(F.hash("event_id"), F.lit(3))
    keys = list(cells.S2_KEYS)
    united = None
    for k in range(3):
        new = cells.s2_visits(some.where(part == k), (5, 10), 3_600)
        united = materialize(new if united is None else cells.visits(united.unionByName(new), keys, 3_600), "united")
    wanted = cells.s2_index(some, (5, 10), 3_600)
    columns = [*keys, "count", "visit_count", "first_s", "last_s", "total_offset_s", *cells.AM, "activity_mode"]
    assert rows_of(cells.of_visits(united, keys), *columns) == rows_of(wanted, *columns)


def test_indexed_pushes_survive_crash_and_replay(spark, points, tmp_path, monkeypatch):
    some, folder = materialize(points.where("event_id < 300"), "some"), str(tmp_path)
    pushes = [some.where(F.pmod(F.hash("event_id"), F.lit(2)) == k) for k in range(2)]
    go = lambda k: indexes.index_push(spark, folder, pushes[k], k, levels=(5, 8))
    go(0)
    with monkeypatch.context() as m:
        m.setattr(versions, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("crash")))
        with pytest.raises(RuntimeError):
            go(1)
    visits = cells.s2_visits(some, (5, 8))
    before = indexes.stored_visits(spark, f"{folder}/cells", visits)
    assert before.agg(F.sum("count")).first()[0] == 2 * pushes[0].count()
    go(1)
    go(1)
    keys = list(cells.S2_KEYS)
    columns = [*keys, "count", "visit_count", "first_s", "last_s", "total_offset_s", "activity_mode"]
    assert rows_of(cells.of_visits(indexes.stored_visits(spark, f"{folder}/cells", visits), keys), *columns) == rows_of(cells.s2_index(some, (5, 8)), *columns)
    subjects = indexes.stored_visits(spark, f"{folder}/subjects", indexes.visits_of(some, ["subject_id"], 0))
    assert rows_of(cells.of_visits(subjects, ["subject_id"]), "subject_id", "count", "visit_count") == rows_of(cells.subject_index(some), "subject_id", "count", "visit_count")
    first = indexes.read_feed(spark, f"{folder}/first_seen")
    # Every cell is first seen once, and the last change of each is its accumulator.
    assert rows_of(first, *keys) == rows_of(visits.select(*keys).distinct(), *keys)
    last = indexes.read_feed(spark, f"{folder}/changed").where("batch = 1")
    assert last.join(cells.s2_index(some, (5, 8)).select(*keys, F.col("count").alias("n")), keys).where("count <> n").count() == 0 and last.count() > 0


def test_state_by_key(spark, tmp_path):
    rows = spark.createDataFrame([("u1", 1, "x"), ("u2", 2, None)], "key string, n int, s string")
    sinks.put_state(rows, str(tmp_path), "last")
    sinks.put_state(rows.limit(1), str(tmp_path), "other")
    assert {r.key: json.loads(r.value) for r in sinks.get_state(spark, str(tmp_path), "last").collect()} == {"u1": {"n": 1, "s": "x"}, "u2": {"n": 2}}
    assert [r.key for r in sinks.get_state(spark, str(tmp_path), "last", ["u2"]).collect()] == ["u2"] and sinks.get_state(spark, str(tmp_path), "other").count() == 1


def test_width_follows_the_busiest_subject(spark):
    df = spark.createDataFrame([("a", i) for i in range(1_000)] + [("b", 0)], "subject_id string, unix_s long")
    assert ordered.bucket_width(df, 5_000) == 5 * 3_600 and ordered.bucket_width(df, 10) == 3_600
    assert ordered.bucket_width(df.where("false")) == Settings.bucket_s


def test_job_from_text_to_tables(spark, tmp_path):
    (tmp_path / "in").mkdir()
    still = {k: v for k, v in FEATURE["properties"].items() if not k.startswith("Gyro")}
    texts = [json.dumps(dict(FEATURE, properties=dict(still, UnixTime=1704067200 + 10 * i, Time=None, Speed=1.0, Elevation=10.0, Activity="Walking", Accuracy=5, Name=name), geometry={"type": "Point", "coordinates": [10 + i * 1e-4, 50.0]})) for i in range(40) for name in ("tester", "other")]
    (tmp_path / "in" / "a.json").write_text("\n".join([*texts, "broken"]))
    job.main(["--input", str(tmp_path / "in"), "--output", str(tmp_path / "out"), "--whitelist", "tester"], spark)
    read = lambda n: spark.read.parquet(str(tmp_path / "out" / n))
    assert read("tracks").count() == 40 and read("moves").count() == 1 and read("subjects").first()["count"] == 40
    assert spark.read.json(str(tmp_path / "out" / "quarantine")).count() == 1 and spark.read.text(str(tmp_path / "out" / "raw")).count() == 81
    assert pipeline.s2_dump(read("cells"), "tester", 5).count() >= 1


def test_paths_against_plain_recursion(points):
    def plain(path, tolerance):
        if len(path) < 3:
            return path
        (x1, y1), (x2, y2) = path[0], path[-1]
        length = math.hypot(x2 - x1, y2 - y1)
        away = [math.hypot(x - x1, y - y1) if not length else abs((x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)) / length for x, y in path]
        k = max(range(len(path)), key=lambda i: (away[i], -i))
        return [path[0], path[-1]] if away[k] <= tolerance else plain(path[: k + 1], tolerance)[:-1] + plain(path[k:], tolerance)

    active = segments.act_split(points)[0]
    by = {}
    for r in segments.move_segments(active, SPARSE).orderBy("subject_id", *BY_TIME).collect():
        by.setdefault((r.subject_id, r.segment), []).append((r.lon, r.lat))
    got = {(r.subject_id, r.segment): [(p.lon, p.lat) for p in r.path] for r in segments.move_paths(active, SPARSE).collect()}
    for key, path in by.items():
        if len(path) < 2:
            assert key not in got
            continue
        length = sum(geo.distance_py(*a, *b) for a, b in zip(path, path[1:], strict=False))
        assert got[key] == plain(path, SPARSE.simplify_degrees * (0.5 if length < 500 else 1.0))


@pytest.mark.parametrize("seed", [1, 2])
def test_path_rates_against_every_pair(spark, seed):
    rng, lon, lat, rows = random.Random(seed), 0.0, 0.0, []
    for k in range(400):
        far = 10 ** rng.uniform(-6, -3) * rng.choice([0, 1, 1, 1])
        lon, lat = lon + rng.gauss(0, far), lat + rng.gauss(0, far)
        rows.append((k, "u", "d", k // 200 * 1000 + k, lon, lat, "Walking", 5.0, 1.0, 1.0, 1))
    df = spark.createDataFrame(rows, "event_id long, subject_id string, device_id string, unix_s long, lon double, lat double, activity string, accuracy double, elevation double, speed double, time_offset long")
    got = {r.segment: r for r in paths.path_rates(df).collect()}
    for number, part in ((1, rows[:200]), (2, rows[200:])):
        ends = [((a[4], a[5]), (b[4], b[5])) for a, b in zip(part, part[1:], strict=False)]
        metres = [geo.distance_py(*a, *b) for a, b in ends]
        crossed = sum(metres[i] + metres[j] for i in range(len(ends)) for j in range(i) if geo.segments_cross(*ends[j], *ends[i]))
        assert crossed > 0 and math.isclose(got[number].self_crossing_rate, crossed / sum(metres), rel_tol=1e-9)


def test_path_rates_of_a_long_path(spark):
    i = F.col("id")
    df = spark.range(100_000).select(i.alias("event_id"), F.lit("u").alias("subject_id"), F.lit("d").alias("device_id"), i.alias("unix_s"), (i * 1e-5 * F.cos(i * 0.01)).alias("lon"), (i * 1e-5 * F.sin(i * 0.01)).alias("lat"), F.lit("Walking").alias("activity"), F.lit(5.0).alias("accuracy"), F.lit(1.0).alias("elevation"), F.lit(1.0).alias("speed"), F.lit(1).alias("time_offset"))
    began = time.time()
    row = paths.path_rates(df).first()
    # A spiral turns all the way and never crosses itself.
    assert row.self_crossing_rate == 0 and row.bearing_delta_rate > 0 and time.time() - began < 90


def test_segments_as_points(points):
    active, idle = segments.act_split(points)
    both = segments.as_tracks(segments.moves(active, idle, SPARSE)).unionByName(segments.as_tracks(segments.stays(idle, SPARSE)))
    assert both.where("unix_s is null or activity is null").count() == 0 and both.count() > 0


def test_scratch_refuses_a_local_folder_on_a_cluster():
    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

        def set(self, key, value):
            self[key] = value

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(ValueError):
        scratch_dir(Session())
    Session.conf["spark.checkpoint.dir"] = "hdfs:///scratch/"
    assert scratch_dir(Session()) == "hdfs:///scratch"


# Streams.


def in_pieces(spark, df, folder, order="unix_s", pieces=3):
    """A stream that brings df in so many files, in order."""
    cuts = df.approxQuantile(order, [k / pieces for k in range(1, pieces)], 0.0)
    bounds = [float("-inf"), *cuts, float("inf")]
    for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        df.where((F.col(order) > a) & (F.col(order) <= b)).coalesce(1).write.mode("append").parquet(str(folder / f"part{k}"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def result(spark, stream, name, tmp_path):
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    query.stop()
    return spark.table(name)


FLUSH = 10**10


def shuffled_pieces(spark, df, folder, bound, pieces=4):
    """A stream whose rows arrive up to bound seconds late, followed by two far later rows of every subject."""
    arrival = F.col("unix_s") + F.abs(F.hash("event_id")) % bound
    rows = df.withColumn("__arrival", arrival)
    first = df.groupBy("subject_id").agg(*(F.first(c).alias(c) for c in df.columns if c not in ("subject_id", "unix_s")))
    for time_s in (FLUSH, 2 * FLUSH):
        rows = rows.unionByName(first.withColumns({"unix_s": F.lit(time_s), "__arrival": F.lit(time_s), "event_id": -F.abs("event_id") - time_s}))
    return in_pieces(spark, rows, folder, "__arrival", pieces)


def alike(got, wanted, columns):
    a, b = (sorted(tuple(None if x is None else round(x, 6) if isinstance(x, float) else x for x in (r[c] for c in columns)) for r in df.collect()) for df in (got, wanted))
    assert [r[:4] for r in a] == [r[:4] for r in b] and a
    for x, y in zip(a, b, strict=True):
        # Sums in another order can fall on the other side of a truncation.
        assert all(p == q or isinstance(p, float) and abs(p - q) <= 1.0 for p, q in zip(x, y, strict=True)), (x, y)
    assert sum(x != y for x, y in zip(a, b, strict=True)) <= len(a) // 50


@pytest.mark.parametrize("kind", ["move", "stay"])
def test_stream_segments_equal_batch_though_shuffled(spark, points, tmp_path, kind):
    active, idle = segments.act_split(points)
    rows = active if kind == "move" else idle
    stream = shuffled_pieces(spark, rows, tmp_path / "in", 3 * queries.DAY)
    got = result(spark, streaming.stream_segments(stream, kind, SPARSE, bound_s=3 * queries.DAY), f"{kind}_out", tmp_path)
    full = segments.moves(active, None, SPARSE) if kind == "move" else segments.stays(idle, SPARSE)
    quantities = segments.MOVE_QUANTITIES if kind == "move" else segments.STAY_QUANTITIES
    own = ("duration_s", "activity", "distance_traversed_m", "distance_absolute_m", "elevation_gain_m", "elevation_loss_m") if kind == "move" else ("duration_s", "area_m2", "lon", "lat")
    columns = ("subject_id", "start_s", "end_s", "raw_point_count", "device_id", *own, *(f"{q}_{s}" for q in quantities for s in ("mean", "median", "min", "max")))
    assert got.where("late").count() == 0
    alike(got, full, columns)


def test_stream_rows_beyond_the_bound_are_counted(spark, tmp_path):
    rows = [(k, "u", "d", t, 0.0, 0.0, 5.0, 1.0, 1.0, 1) for k, t in enumerate((100, 200, 300, 150, 290, 400))]
    df = spark.createDataFrame(rows, "event_id long, subject_id string, device_id string, unix_s long, lon double, lat double, accuracy double, speed double, heading double, time_offset long")
    got = result(spark, streaming.stream_teleports(in_pieces(spark, df, tmp_path / "in", "event_id", 6), SPARSE, bound_s=20), "bound_out", tmp_path)
    # 150 came after 300 had released up to 280; 290 came in time; 400 still waits.
    assert sorted((r.event_id, r.late) for r in got.collect()) == [(0, False), (1, False), (2, False), (3, True), (4, False)]


def test_silent_subject_is_closed_once(spark, points, tmp_path):
    rows = [(k, s, "d", t, 0.0, k * 1e-5, "Walking", 5.0, 10.0, 1.0, 1) for k, (s, t) in enumerate([("a", 0), ("a", 10), ("a", 20), ("b", 5)])]
    kind = "event_id long, subject_id string, device_id string, unix_s long, lon double, lat double, activity string, accuracy double, elevation double, speed double, time_offset long"
    folder, schema = tmp_path / "in", spark.createDataFrame(rows, kind).schema
    found = []

    def push(more):
        spark.createDataFrame(more, kind).coalesce(1).write.mode("append").parquet(str(folder))

    def wait_for(subject):
        end = time.time() + 90
        while time.time() < end and not any(r.subject_id == subject and not r.late for r in found):
            time.sleep(0.2)

    push(rows)
    stream = streaming.stream_segments(spark.readStream.schema(schema).parquet(str(folder)), "move", Settings(), bound_s=15, silence_s=2)
    # Timers need a trigger that goes on; one that ends with the data waits for them.
    query = stream.writeStream.foreachBatch(lambda df, n: found.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    try:
        wait_for("a")
        assert [(r.subject_id, r.start_s, r.end_s, r.raw_point_count) for r in found if not r.late] == [("a", 0, 20, 3)]
        # Its state is gone: an earlier time is not late, and what was closed does not come again.
        push([(10 + k, s, "d", 2 + k, 0.0, 0.0, "Walking", 5.0, 10.0, 1.0, 1) for k, s in enumerate("amm")])
        wait_for("m")
        assert sorted((r.subject_id, r.raw_point_count, r.late) for r in found) == [("a", 3, False), ("m", 2, False)]
    finally:
        query.stop()


def test_stream_teleports_equal_batch(spark, points, tmp_path):
    columns = ["event_id", "subject_id", "unix_s", "lon", "lat", "speed", "time_offset"]
    stream = shuffled_pieces(spark, points.select(*columns), tmp_path / "in", queries.DAY)
    got = result(spark, streaming.stream_teleports(stream, SPARSE, bound_s=queries.DAY), "teleports_out", tmp_path)
    assert rows_of(got.where("accepted and event_id >= 0"), "event_id") == rows_of(clean.without_teleports(points, SPARSE), "event_id")


def test_stream_improver_equals_batch(spark, points, tmp_path):
    kept = clean.stateless(points).withColumn("gyro_sum", F.when(F.col("event_id") % 5 > 0, (F.col("event_id") % 3) * 0.005))
    columns = ["event_id", "subject_id", "device_id", "unix_s", "lon", "lat", "time_offset", "accuracy", "speed", "heading", "activity", "gyro_sum"]
    stream = shuffled_pieces(spark, kept.select(*columns), tmp_path / "in", queries.DAY)
    got = result(spark, streaming.stream_improved(stream, SPARSE, bound_s=queries.DAY), "improved_out", tmp_path).withColumn("acceleration", F.round("acceleration", 9))
    wanted = improve.improve(kept, SPARSE).withColumn("acceleration", F.round("acceleration", 9))
    assert rows_of(got.where("event_id >= 0"), "event_id", "activity", "acceleration") == rows_of(wanted, "event_id", "activity", "acceleration")
    assert rows_of(wanted, "event_id", "activity") != rows_of(improve.improve(kept.drop("gyro_sum"), SPARSE), "event_id", "activity")


def test_stream_of_device_windows(spark, points, tmp_path):
    late = points.select("event_id", "subject_id", "device_id", "unix_s")
    got = result(spark, streaming.stream_unbacktracked(in_pieces(spark, late, tmp_path / "in", "event_id", 2)), "windows_out", tmp_path)
    # Points in order of time, in one push or many: none is lost.
    assert rows_of(got, "event_id") == rows_of(late, "event_id")


def stored_keys(rows):
    return sorted((r.subject_id, r.unix_s, r.accuracy, r.speed, r.lon) for r in rows)


def test_stream_accounts_for_generated_faults(spark, tmp_path):
    """Messages in = stored + repeats + refused, in one push or several, as in the batch form."""
    texts = [r.value for r in queries.message_texts(spark, SF).collect()]
    unlike = [dict(FEATURE, properties=dict(FEATURE["properties"], Accuracy=a, Speed=v)) for a, v in ((5.0, 1.0), (5.0, 2.0), (6.0, 1.0))]
    texts += [json.dumps(unlike), json.dumps(unlike[0]), json.dumps({"type": "FeatureCollection", "features": unlike[:2]})]
    (tmp_path / "in").mkdir()
    for k in range(3):
        again = texts if k == 0 else texts[k::3]
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(again))
    every = spark.read.text(str(tmp_path / "in"))
    stored, refused = [], []
    stream = streaming.arriving(spark, str(tmp_path / "in"), 1)
    query = streaming.run_batches(stream, str(tmp_path / "cp"), lambda df, n: stored.extend(df.collect()), lambda df, n: refused.extend(df.collect()))
    query.awaitTermination(240)
    query.stop()
    batch, _, bad = pipeline.admit(ingest.decode(every))
    assert stored_keys(stored) == stored_keys(batch.collect())
    plain = sorted([r.invalid_reason for r in bad.collect()] + [r.invalid_reason for r in ingest.rejected(every).collect()])
    assert sorted(r.invalid_reason for r in refused) == plain and all(r.object for r in refused)
    assert len([r for r in stored if r.subject_id == "tester"]) == 3


def test_stream_drops_repeats_within_the_watermark(spark, points, tmp_path):
    rows = points.select("event_id", "subject_id", "unix_s").withColumn("ts", F.timestamp_seconds("unix_s"))
    stream = in_pieces(spark, rows.unionByName(rows), tmp_path / "in", pieces=2)
    got = result(spark, quality.dedupe_stream(stream, ["event_id"]), "unique_out", tmp_path)
    assert rows_of(got, "event_id") == rows_of(rows, "event_id")


def test_burst_of_requests_gives_one(spark, tmp_path):
    schema, folder, found = "layer string, requested_at long, request string", tmp_path / "in", []
    push = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    push([("a", 1, "first"), ("a", 3, "last"), ("a", 2, "mid"), ("b", 1, "only")])
    out = layers.debounced(spark.readStream.schema(schema).parquet(str(folder)), 3)
    query = out.writeStream.foreachBatch(lambda df, n: found.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    try:
        end = time.time() + 90
        while len(found) < 2 and time.time() < end:
            time.sleep(0.2)
    finally:
        query.stop()
    assert sorted((r.layer, r.requested_at, r.request, r.requests) for r in found) == [("a", 3, "last", 3), ("b", 1, "only", 1)]


def test_meters_of_a_running_query(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.json").write_text("\n".join(["é234"] * (k + 1)))
    listener = layers.Throughput("points-meter")
    spark.streams.addListener(listener)
    try:
        stream = layers.metered(streaming.arriving(spark, str(folder), 1), "points-meter")
        query = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        end = time.time() + 30
        while listener.meters["rows"].total < 6 and time.time() < end:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    rows, size = listener.meters["rows"], listener.meters["bytes"]
    assert (rows.total, size.total) == (6, 30) and rows.mean > 0 and set(rows.rates) == {1, 5, 15}
    one = layers.Meter()
    for n in (10, 20):
        one.add(n, 60)
    assert math.isclose(one.rates[1], 10 / 60 + (1 - math.exp(-1)) * 10 / 60) and math.isclose(one.mean, 0.25)


def test_settings_are_values():
    assert Settings() == Settings() and SPARSE != Settings()
