import datetime

import numpy as np
from pyspark.sql import functions as F

from mapweave.streaming.monitors import edit_log, job_feed, vehicle_events
from mapweave.streaming.poses import tile_visits
from mapweave.functions import geo as G
from mapweave.streaming.route import advance, follow_routes, nearest_progress, standings_writer

START = datetime.datetime(2024, 1, 1)


def stream(spark, tmp_path, rows, schema, name):
    """Rows written as two files and read back as a stream, one file per batch."""
    folder = str(tmp_path / name)
    half = len(rows) // 2
    for part in (rows[:half], rows[half:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drain(df, tmp_path, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").option(
        "checkpointLocation", str(tmp_path / f"{name}-checkpoint")
    ).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return df.sparkSession.table(name)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def test_job_feed(spark, tmp_path):
    log = [(1, at(i), i, s, p) for i, (s, p) in enumerate([("queued", 0), ("queued", 0), ("running", 10), ("complete", 100), ("running", 5)])]
    got = drain(job_feed(stream(spark, tmp_path, log, "job_id long, ts timestamp, event_id long, status string, progress int", "jobs")), tmp_path, "job_rows")
    assert [r.event_id for r in got.orderBy("event_id").collect()] == [0, 2, 3]


def test_edit_log(spark, tmp_path):
    log = [("p", "b", i, e) for i, e in enumerate([0, 0, 1, 1, 2])]
    got = drain(edit_log(stream(spark, tmp_path, log, "provider string, source_id string, seq long, expected_revision int", "edits")), tmp_path, "edit_rows")
    assert {r.seq: r.revision for r in got.collect()} == {0: 1, 1: None, 2: 2, 3: None, 4: 3}


def test_vehicle_events(spark, tmp_path):
    rows = [(1, at(0.5 * i), 1.0, 1.0, True, 30.0, 1.0) for i in range(4)] + [(1, at(2 + 0.5 * i), 0.1, 1.0, True, 0.0, 1.0) for i in range(8)]
    got = drain(vehicle_events(stream(spark, tmp_path, rows, "trace_id long, ts timestamp, upright double, height double, inside boolean, speed_kph double, throttle double", "cars")), tmp_path, "car_rows")
    assert {r.event for r in got.collect()} == {"saved", "recover", "stuck"}


def test_route_rules():
    course = {"xs": np.array([0.0, 400.0]), "zs": np.array([0.0, 0.0]), "ds": np.array([0.0, 400.0]), "checkpoints": np.array([120.0, 400.0]), "road_width": 7.0}
    assert nearest_progress(course, 50.0, 3.0, 0.0) == 50.0 and nearest_progress(course, 10.0, 0.0, 200.0) == 200.0
    run = {"progress": 0.0, "checkpoint": 0, "wrong": 0.0, "off": 0.0, "last": None, "started": 0.0, "px": None, "pz": None, "finish": None}
    splits = [advance(course, run, {"time": float(t), "x": 10.0 * t, "z": 0.0, "fx": 1.0, "fz": 0.0})["split"] for t in range(41)]
    assert [t for t, s in enumerate(splits) if s is not None] == [12, 40] and run["checkpoint"] == 2 and run["finish"] == 40
    before = dict(run)
    assert advance(course, run, {"time": 41.0, "x": 0.0, "z": 90.0, "fx": -1.0, "fz": 0.0}) is None and run == before


def test_follow_routes(spark, tmp_path):
    # The trace goes on after the finish, off the course: nothing more is told of it.
    rows = [(7, 1, at(t), 10.0 * t, 0.0, 90.0) for t in range(41)] + [(7, 1, at(41 + t), 400.0, 30.0 + 5 * t, 270.0) for t in range(20)]
    courses = spark.createDataFrame([(7, 1, [0.0, 400.0], [0.0, 0.0], [0.0, 400.0], [120.0, 400.0], 7.0)], "area_id long, trace_id long, xs array<double>, zs array<double>, ds array<double>, checkpoints array<double>, road_width double")
    poses = stream(spark, tmp_path, rows, "area_id long, trace_id long, ts timestamp, x double, z double, heading double", "poses")
    told = drain(follow_routes(poses, courses), tmp_path, "route_rows")
    got = told.where("split IS NOT NULL").orderBy("ts").collect()
    assert [round(r.split) for r in got] == [12, 40] and got[-1].finish == 40
    assert told.count() == 41 and not told.where("wrong_way OR off_course OR returned").count()


def test_standings_keep_silent_and_finished_traces(spark, tmp_path):
    race = spark.createDataFrame([(7, t, 1) for t in (1, 2, 3)], "area_id long, trace_id long, race_id long")
    write = standings_writer(str(tmp_path), race)
    schema = "area_id long, trace_id long, ts timestamp, progress double, finish double, late boolean"
    write(spark.createDataFrame([(7, 1, at(1), 400.0, 40.0, False), (7, 2, at(1), 90.0, None, False)], schema), 0)
    for _ in range(2):  # an epoch may be repeated
        write(spark.createDataFrame([(7, 3, at(2), 120.0, None, False)], schema), 1)
    rows = spark.read.parquet(f"{tmp_path}/standings/epoch=1").collect()
    assert {r.trace_id: r.position for r in rows} == {1: 1, 3: 2, 2: 3}


def test_tile_stream_equals_batch(spark, tmp_path):
    rows = [(1, 1, at(t), 30.0 * t, 5.0, 0.0, -0.70710678, 0.0, 0.70710678) for t in range(20)]
    schema = "area_id long, trace_id long, ts timestamp, x double, z double, qx double, qy double, qz double, qw double"
    areas = spark.range(1).select(F.lit(1).cast("long").alias("area_id"), G.anchor_frame(F.lit(-75.0), F.lit(40.0)).alias("frame"),
                                  F.lit(-75.1).alias("west"), F.lit(39.9).alias("south"), F.lit(-74.9).alias("east"), F.lit(40.1).alias("north"))
    live = drain(tile_visits(stream(spark, tmp_path, rows, schema, "tiles"), areas), tmp_path, "tile_rows")
    batch = tile_visits(spark.createDataFrame(rows, schema), areas)
    key = ("tile_x", "tile_north")
    assert {tuple(r[k] for k in key) for r in live.collect()} == {tuple(r[k] for k in key) for r in batch.collect()}


def drained(df, tmp_path, name):
    """The rows and the number of state rows that are left."""
    query = df.writeStream.format("memory").queryName(name).outputMode("append").option(
        "checkpointLocation", str(tmp_path / f"{name}-checkpoint")
    ).trigger(availableNow=True).start()
    query.awaitTermination(180)
    return df.sparkSession.table(name).collect(), [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def batches(spark, tmp_path, parts, schema, name):
    """One file, and so one batch, for each part."""
    folder = str(tmp_path / name)
    for number, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/part={number}")
    files = spark.readStream.schema(f"{schema}, part int").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(folder)
    return files.drop("part")


def test_idle_vehicles_are_forgotten_and_late_poses_told_of(spark, tmp_path):
    safe = lambda area, seconds: (area, 1, at(seconds), 1.0, 1.0, True, 30.0, 1.0)
    parts = [
        [safe(1, 0.0), safe(1, 0.5), safe(2, 0.4)], [safe(1, 0.2)],  # late: area 1 is at 0.5 already
        [safe(3, 7200.0)], [safe(3, 7201.0)],  # the watermark passes the idle time of areas 1 and 2
        [safe(1, 7202.0)],  # 0.5 safe seconds of area 1 are forgotten: no safe point yet
        [safe(1, 7202.5)], [safe(1, 7202.75)],
    ]
    schema = "area_id long, trace_id long, ts timestamp, upright double, height double, inside boolean, speed_kph double, throttle double"
    rows, left = drained(vehicle_events(batches(spark, tmp_path, parts, schema, "idle"), "1 hour", 600.0), tmp_path, "idle_rows")
    assert {(r.area_id, r.event, r.ts) for r in rows} == {(1, "late", at(0.2)), (3, "saved", at(7201.0)), (1, "saved", at(7202.75))}
    assert max(left) > left[-1]


def test_jobs_are_forgotten_and_late_events_told_of(spark, tmp_path):
    parts = [[(1, at(10), 1, "queued", 0)], [(1, at(5), 0, "running", 1)], [(2, at(9000), 2, "queued", 0)], [(2, at(9001), 3, "running", 5)], [(1, at(9002), 4, "queued", 0)]]
    feed = job_feed(batches(spark, tmp_path, parts, "job_id long, ts timestamp, event_id long, status string, progress int", "late_jobs"), "1 hour", 60.0)
    rows, _ = drained(feed, tmp_path, "late_job_rows")
    # The same status is told of again only because the job was forgotten in between.
    assert {(r.event_id, r.late) for r in rows} == {(1, False), (0, True), (2, False), (3, False), (4, False)}


def test_poses_without_a_course_are_told_of(spark, tmp_path):
    rows = [(7, 1, at(t), 10.0 * t, 0.0, 90.0) for t in range(4)] + [(8, 1, at(t), 10.0 * t, 0.0, 90.0) for t in range(4)]
    courses = spark.createDataFrame([(7, 1, [0.0, 400.0], [0.0, 0.0], [0.0, 400.0], [120.0, 400.0], 7.0)], "area_id long, trace_id long, xs array<double>, zs array<double>, ds array<double>, checkpoints array<double>, road_width double")
    told = drain(follow_routes(stream(spark, tmp_path, rows, "area_id long, trace_id long, ts timestamp, x double, z double, heading double", "no_course"), courses), tmp_path, "no_course_rows")
    assert {(r.area_id, r.progress is None): r["count"] for r in told.groupBy("area_id", "progress").count().groupBy("area_id", F.col("progress").isNull().alias("n")).agg(F.sum("count").alias("count")).select("area_id", F.when(F.col("n"), None).otherwise(1).alias("progress"), "count").collect()} == {(7, False): 4, (8, True): 4}
