"""Stateful operators against plain simulators, edge cases of ingest, streams against batches."""

import json

import pytest
from pyspark.sql import functions as F

from wayfold.config import SPARSE, Settings
from wayfold.operators import cells, clean, improve, ordered, quality, segments
from wayfold.operators.offsets import with_time_offset
from wayfold.plans import pipeline
from wayfold.plans.tracks import tracks
from wayfold.sources import ingest, sinks
from wayfold.streaming import pipeline as streaming

SF = "/root/testdata/sf0.001"
TRACK = "event_id long, subject_id string, device_id string, unix_s long, lon double, lat double, accuracy double, speed double, heading double, elevation double, activity string"


def make(spark, rows):
    """rows: (unix_s, lon, lat, speed, activity) of one subject."""
    full = [(i, "u1", "d1", t, lon, lat, 5.0, speed, 10.0, 100.0, activity) for i, (t, lon, lat, speed, activity) in enumerate(rows)]
    return with_time_offset(spark.createDataFrame(full, TRACK))


def test_previous_and_sums_cross_buckets(spark):
    rows = [("a", i * 7, i) for i in range(50)] + [("b", 1, 100)]
    df = spark.createDataFrame(rows, "subject_id string, unix_s long, event_id long")
    got = ordered.with_previous(df, ["subject_id"], ["unix_s", "event_id"], ["event_id"], "prev", width=20)
    got = ordered.with_running_sum(got, ["subject_id"], ["unix_s", "event_id"], F.lit(1), "n", width=20)
    for r in got.collect():
        if r.subject_id == "a":
            assert (r.prev.event_id if r.prev else -1) == r.event_id - 1 and r.n == r.event_id + 1
        else:
            assert r.prev is None and r.n == 1


@pytest.mark.parametrize(("step", "visits"), [(1, 1), (2, 20)])
def test_visits_are_strict(spark, step, visits):
    df = make(spark, [(1000 + step * i, 0.0, 0.0, 1.0, "Walking") for i in range(20)])
    row = cells.accumulate(df, ["subject_id"], 1, width=7).first()
    assert (row["count"], row.visit_count) == (20, visits)


def test_merge_equals_whole(spark):
    df = make(spark, [(1000 + 50 * i * (1 + i % 3), 0.0, 0.0, 1.0, "Walking") for i in range(40)])
    index = lambda part: cells.accumulate(part, ["subject_id"], 100)
    both = cells.merge(index(df.where("unix_s < 3000")), index(df.where("unix_s >= 3000")), ["subject_id"], 100)
    assert both.first().asDict() == index(df).select(*both.columns).first().asDict()


def test_teleport_branches(spark):
    far = 0.01  # about 1.1 km of longitude at the equator
    df = make(spark, [(0, 0.0, 0.0, 1.0, ""), (10, far, 0.0, 1.0, ""), (11, 0.0, 0.0, 1.0, ""), (100, far, 0.0, 1.0, ""), (110, 2 * far, 0.0, 500.0, "")])
    kept = {r.event_id for r in clean.without_teleports(df).collect()}
    assert kept == {0, 2, 3, 4}


def test_teleport_zero_interval_and_offset():
    state = clean.LastAccepted(Settings())
    assert state.accept(0, 0.0, 0.0, 1.0, 1)
    assert not state.accept(0, 1.0, 0.0, 1.0, 1)
    assert state.accept(0, 1.0, 0.0, 1.0, 0)
    assert not state.accept(1, 0.0, 0.0, -1.0, 0)


def test_improver_on_a_still_and_a_moving_device(spark):
    still = make(spark, [(i * 10, 0.0, 0.0, 0.0, "Unknown") for i in range(12)])
    assert {r.activity for r in improve.improve(still).collect()} == {"Stationary"}
    drive = make(spark, [(i, i * 0.0002, 0.0, 20.0, "Walking") for i in range(60)])
    assert improve.improve(drive).where("event_id > 40 and activity = 'Walking'").count() == 0


def test_ewma_first_tick_and_decay():
    rate = improve.Ewma(100)
    rate.tick(10.0, 2)
    assert rate.value == 5.0
    rate.tick(10.0, 1)
    assert abs(rate.value - (5 + improve.ALPHA * 5)) < 1e-9


def test_sliding_modes_hold_a_closed_interval():
    modes = improve.Modes(60)
    for t in range(120):
        modes.push(t, list(improve.CODES)[t % 7], 1)
    assert sum(w for _, w in modes.ranked()) == 61


def test_move_break_rules(spark):
    names = ["Walking", "Running", "Automotive", "Fly", "Walking", "Bike", "Automotive", "Walking"]
    df = make(spark, [(i * 10, i * 0.001, 0.0, 5.0, a) for i, a in enumerate(names)])
    got = [r.segment for r in segments.move_segments(df).orderBy("event_id").collect()]
    assert got == [1, 1, 1, 1, 2, 2, 2, 3]


def test_stays_break_by_distance_and_cap(spark):
    df = make(spark, [(i * 60, 0.0, 0.0, 0.0, "") for i in range(5)] + [(300 + i * 60, 0.01, 0.0, 0.0, "") for i in range(5)])
    found = segments.stays(df).orderBy("start_s").collect()
    assert [(r.raw_point_count, r.is_open) for r in found] == [(5, False), (5, True)]
    counter = segments.StayCounter(Settings(stay_cap=2))
    for x in (0.0, 0.002, 0.1):
        counter.add(0, x, 0.0)
    assert counter.n == 1 and counter.stay == 1


FEATURE = {"type": "Feature", "geometry": {"type": "Point", "coordinates": [10.5, 50.25]}, "properties": {"Name": "tester", "UUID": "x", "Time": "2024-01-01T00:00:00Z", "UnixTime": 1704067200, "Accuracy": 5, "Odd": 1}}
LEGACY = {"uuid": "x", "name": "tester", "lat": 50.25, "long": 10.5, "accuracy": 5.129, "speed": 1.23456, "time": "2024-01-01T00:00:00Z", "notes": json.dumps({"activity": "Walking", "heartRateS": "76 count/min"})}
COLLECTION = {"type": "FeatureCollection", "features": [FEATURE, FEATURE]}


@pytest.mark.parametrize(
    ("messages", "points"),
    [
        ([json.dumps(FEATURE)] * 2, 2), ([json.dumps(LEGACY)] * 2, 2), ([json.dumps([FEATURE, FEATURE])], 2), ([json.dumps([LEGACY, LEGACY], indent=1)], 2),
        ([json.dumps(COLLECTION, indent=1)], 2), ([json.dumps([COLLECTION, COLLECTION])], 4), ([""], 0), (["malformed"], 0), ([json.dumps({"type": "Other"})], 0),
    ],
)
def test_decode_shapes(spark, messages, points):
    got = ingest.decode(spark.createDataFrame([(m,) for m in messages], "value string")).collect()
    assert len(got) == points
    assert all((r.subject_id, r.unix_s, r.lon, r.lat) == ("tester", 1704067200, 10.5, 50.25) for r in got)


def test_decode_details(spark):
    df = spark.createDataFrame([(json.dumps(FEATURE),), (json.dumps(LEGACY),), ("nope",)], "value string")
    feature, legacy = sorted(ingest.decode(df).collect(), key=lambda r: r.speed is not None)
    assert feature.extras == {"Odd": "1"}
    assert (legacy.speed, legacy.accuracy, legacy.activity, legacy.heart_rate) == (1.234, 5.12, "Walking", 76.0)
    assert ingest.malformed(df).count() == 1
    assert quality.validate(ingest.decode(df)).where("invalid_reason is not null").count() == 0


def test_invalid_rows(spark):
    def but(**change):
        f = json.loads(json.dumps(FEATURE))
        for path, v in change.items():
            at = f
            *front, last = path.split("__")
            for key in front:
                at = at[key]
            at[last] = v
        return json.dumps(f)

    bad = {
        "no properties": but(properties={}), "no name": but(properties__Name=""), "device not text": but(properties__UUID=42), "times differ": but(properties__Time="bad"), "not a point": but(geometry__type="LineString"),
        "no device": but(properties__UUID=None), "name not text": but(properties__Name=7), "accuracy not a number": but(properties__Accuracy="5"), "no accuracy": but(properties__Accuracy=None), "bad latitude": but(geometry__coordinates=[1, 91]),
        "no geometry": but(geometry=None), "bad longitude": but(geometry__coordinates=["x", 1]),
    }
    legacy = dict(LEGACY, uuid=7)
    texts = [json.dumps(FEATURE), *bad.values(), json.dumps(legacy), json.dumps(dict(LEGACY, accuracy="5"))]
    got = quality.validate(ingest.decode(spark.createDataFrame([(m,) for m in texts], "value string")))
    valid, invalid = quality.split_valid(got)
    assert valid.count() == 1 and sorted(r.invalid_reason for r in invalid.collect()) == sorted([*bad, "device not text", "accuracy not a number"])
    # An empty device is text.
    assert quality.split_valid(quality.validate(ingest.decode(spark.createDataFrame([(but(properties__UUID=""),)], "value string"))))[0].count() == 1


def test_sinks_round_trip(spark, tmp_path):
    t = tracks(spark, SF)
    sinks.store_monthly(t, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == t.count()
    sinks.write_json(t, str(tmp_path / "j"))
    assert spark.read.schema(t.schema).json(str(tmp_path / "j")).count() == t.count()
    sinks.push_layer(t.withColumnRenamed("subject_id", "Name"), str(tmp_path / "l"), "s", "tracks")
    text = ingest.read_messages(spark, str(tmp_path / "l" / "s" / "tracks"))
    assert ingest.decode(text).count() == t.count()


def test_invariants(spark):
    out = pipeline.process(tracks(spark, SF), SPARSE)
    low = out.improved.where(clean.grounded()).count()
    per_level = {r.level: r.n for r in out.s2.groupBy("level").agg(F.sum("count").alias("n")).collect()}
    assert set(per_level.values()) == {low}
    tally = sum(F.col(c) for c in cells.AM)
    assert out.s2.where((F.col("visit_count") < 1) | (F.col("visit_count") > F.col("count")) | (F.col("first_s") > F.col("last_s")) | (tally != F.col("total_offset_s"))).count() == 0
    assert {r.cell_key for r in out.s2.where("level = 0").collect()} <= set("13579b")
    with pytest.raises(ValueError):
        pipeline.s2_dump(out.s2, "u1", 12, collectable=True)


def test_empty_tables(spark):
    none = tracks(spark, SF).where("false")
    out = pipeline.process(none, SPARSE)
    assert out.moves.count() == out.stays.count() == out.s2.count() == out.subjects.count() == 0


def test_stream_segments_equal_batch(spark, tmp_path):
    idle = segments.act_split(with_time_offset(tracks(spark, SF)))[1]
    src = tmp_path / "in"
    for k, (a, b) in enumerate(((0, 1_705_000_000), (1_705_000_000, 1 << 40))):
        idle.where((F.col("unix_s") >= a) & (F.col("unix_s") < b)).coalesce(1).write.mode("append").parquet(str(src / f"part{k}"))
    stream = spark.readStream.schema(idle.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(src))
    query = streaming.stream_segments(stream, "stay", SPARSE).writeStream.format("memory").queryName("stays_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    query.stop()
    names = ("subject_id", "start_s", "end_s", "raw_point_count")
    got = {tuple(r) for r in spark.table("stays_out").select(*names).collect()}
    closed = segments.stays(idle, SPARSE).where("not is_open")
    assert got == {tuple(r) for r in closed.select(*names).collect()}


def test_stream_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    other = json.dumps(dict(FEATURE, properties=dict(FEATURE["properties"], UUID=42)))
    lines = [json.dumps(FEATURE)] * 2 + ["bad", '{"type":"Other"}', '{"uuid":"x","name":"n"}', other]
    (tmp_path / "in" / "a.json").write_text("\n".join(lines))
    seen, refused = [], []
    query = streaming.run_batches(streaming.arriving(spark, str(tmp_path / "in")), str(tmp_path / "cp"), lambda df, n: seen.append(df.count()), lambda df, n: refused.extend(df.collect()))
    query.awaitTermination(120)
    query.stop()
    # Rows in are kept, refused or the repeat of a kept one.
    assert sum(seen) == 1 and sorted(r.invalid_reason for r in refused) == ["device not text", "no place", "not readable", "unknown type"] and all(r.object for r in refused)
