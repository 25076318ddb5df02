"""Snapshots, jobs, races and saved edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from mapweave.derived import duck, places_sql, table, view
from mapweave.functions import geo as G
from mapweave.functions import geometry as Y
from mapweave.functions.text import content_hash, derived_hash, places, request_key
from mapweave.operators import customizations as C
from mapweave.operators import jobs as J
from mapweave.operators import races
from mapweave.operators import ranking as K
from mapweave.operators import snapshots as S
from mapweave.operators.ordered import hot_keys
from mapweave.operators.spatial import covering_area
from mapweave.registry.catalog import Topic
from mapweave.registry.elevation import building_corners

topic = Topic()


@topic.query(duck("""
SELECT provider, query_version, snapshot_id, retrieved_ordinal, rank FROM (SELECT *, row_number() OVER (PARTITION BY provider, query_version ORDER BY retrieved_ordinal DESC) AS rank
 FROM v_snapshots WHERE NOT is_derived) WHERE rank <= 5""", "v_snapshots"))
def recent_originals(spark, sf_dir):
    return S.recent_originals(view(spark, sf_dir, "v_snapshots"), time="retrieved_ordinal").select(
        "provider", "query_version", "snapshot_id", "retrieved_ordinal", "rank"
    )


@topic.query("SELECT o_custkey AS snapshot_id, count(*) AS feature_count FROM orders GROUP BY 1")
def feature_counts(spark, sf_dir):
    return S.feature_counts(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("snapshot_id")))


@topic.query(duck("""
WITH rq AS (SELECT s_suppkey AS request_id, c.provider, 1 AS query_version, s_suppkey % 50 AS bounds_key FROM supplier, (SELECT DISTINCT provider FROM v_snapshots) c),
n AS (SELECT provider, query_version, bounds_key, arg_max(snapshot_id, retrieved_ordinal) AS snapshot_id FROM v_snapshots GROUP BY 1, 2, 3),
f AS (SELECT o_custkey AS snapshot_id, count(*) AS feature_count FROM orders GROUP BY 1)
SELECT rq.*, n.snapshot_id, CASE WHEN n.snapshot_id IS NOT NULL THEN coalesce(feature_count, 0) END AS feature_count FROM rq LEFT JOIN n USING (provider, query_version, bounds_key) LEFT JOIN f USING (snapshot_id)""", "v_snapshots"))
def exact_reuse(spark, sf_dir):
    snapshots = view(spark, sf_dir, "v_snapshots")
    # Five market segments stand for providers, a fixed list of the source: a request asks each of them.
    providers = sorted(row.provider for row in snapshots.select("provider").distinct().collect())
    requests = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("request_id"), F.lit(1).alias("query_version"), (F.col("s_suppkey") % 50).alias("bounds_key"),
        F.explode(F.array(*[F.lit(p) for p in providers])).alias("provider"),
    )
    features = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("snapshot_id"))
    return S.exact_reuse(
        requests, snapshots, features, ["provider", "query_version", "bounds_key"], "retrieved_ordinal"
    ).select("request_id", "provider", "query_version", "bounds_key", "snapshot_id", "feature_count")


@topic.query(duck("""
WITH b AS (SELECT snapshot_id, provider, query_version, is_derived, retrieved_ordinal, bounds_key % 10 AS w, bounds_key // 10 AS s, 1 + snapshot_id % 7 AS size FROM v_snapshots),
o AS (SELECT * FROM b WHERE NOT is_derived QUALIFY row_number() OVER (PARTITION BY provider, query_version ORDER BY retrieved_ordinal DESC) <= 5)
SELECT r.snapshot_id AS request_id, r.provider, arg_max(o.snapshot_id, o.retrieved_ordinal) AS parent_id
FROM b r LEFT JOIN o ON o.provider = r.provider AND o.w <= r.w AND o.s <= r.s AND o.w + o.size >= r.w + r.size AND o.s + o.size >= r.s + r.size GROUP BY 1, 2""", "v_snapshots"))
def reuse_parents(spark, sf_dir):
    """Requests served from one of the five latest originals that cover them."""
    west, south = F.col("bounds_key") % 10, F.floor(F.col("bounds_key") / 10)
    size = 1 + F.col("snapshot_id") % 7
    sides = [side.cast("double") for side in (west, south, west + size, south + size)]
    areas = view(spark, sf_dir, "v_snapshots").withColumn("ring", G.bounds_ring(*sides))
    originals = S.recent_originals(areas, time="retrieved_ordinal").select(
        "snapshot_id", "provider", "query_version", F.col("ring").alias("original_ring"), F.col("retrieved_ordinal").alias("retrieved_at")
    )
    requests = areas.select(F.col("snapshot_id").alias("request_id"), "provider", "query_version", "ring")
    return covering_area(requests, originals).select("request_id", "provider", "parent_id")


@topic.query(duck("""
WITH h AS (SELECT *, sha256(concat_ws(':', provider, cast(bounds_key AS varchar))) AS content_hash FROM v_snapshots),
e AS (SELECT * FROM h WHERE is_derived), i AS (SELECT * FROM h WHERE NOT is_derived),
f AS (SELECT provider, content_hash, min(snapshot_id) AS snapshot_id FROM i GROUP BY 1, 2)
SELECT f.provider, f.content_hash, f.snapshot_id FROM f WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.provider = f.provider AND e.content_hash = f.content_hash)""", "v_snapshots"))
def snapshot_inserts(spark, sf_dir):
    """New snapshots after insert-ignore on provider and content hash; stored ones are the derived half."""
    hashed = view(spark, sf_dir, "v_snapshots").withColumn(
        "content_hash", content_hash(F.col("provider"), F.col("bounds_key").cast("string"))
    ).select("provider", "content_hash", "snapshot_id", "is_derived")
    stored, incoming = hashed.where("is_derived").select("provider", "content_hash").distinct(), hashed.where("NOT is_derived")
    return S.insert_ignore(stored, incoming, ["provider", "content_hash"], "snapshot_id").select(
        "provider", "content_hash", "snapshot_id"
    )


@topic.query(duck("""
SELECT snapshot_id, sha256(concat_ws(':', sha256(provider), concat('{"k":', bounds_key, '}'), CASE WHEN snapshot_id % 3 = 0 THEN concat('{"s":', snapshot_id, '}') ELSE 'null' END)) AS derived_hash,
 concat_ws(':', provider, cast(query_version AS varchar), cast(bounds_key AS varchar), CASE WHEN snapshot_id % 3 = 0 THEN cast(snapshot_id AS varchar) ELSE '' END) AS request_key FROM v_snapshots""", "v_snapshots"))
def snapshot_identity(spark, sf_dir):
    picked = F.when(F.col("snapshot_id") % 3 == 0, F.to_json(F.struct(F.col("snapshot_id").alias("s"))))
    return view(spark, sf_dir, "v_snapshots").select(
        "snapshot_id",
        derived_hash(F.sha2("provider", 256), F.to_json(F.struct(F.col("bounds_key").alias("k"))), picked).alias("derived_hash"),
        request_key(F.col("provider"), F.col("query_version"), F.col("bounds_key"), F.when(F.col("snapshot_id") % 3 == 0, F.col("snapshot_id"))).alias("request_key"),
    )


@topic.query(duck("""
WITH o AS (SELECT area_id, source_id, concat_ws('|', cx, cz, half_x, half_z) AS h FROM v_buildings WHERE half_x <> 7),
n AS (SELECT area_id, source_id, concat_ws('|', cx, cz, CASE WHEN half_z = 5 THEN half_x + 1 ELSE half_x END, half_z) AS h FROM v_buildings WHERE half_x <> 9)
SELECT coalesce(o.area_id, n.area_id) AS area_id, coalesce(o.source_id, n.source_id) AS source_id,
 CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' WHEN o.h = n.h THEN 'same' ELSE 'changed' END AS status
FROM o FULL JOIN n ON o.area_id = n.area_id AND o.source_id = n.source_id""", "v_buildings"))
def snapshot_diff(spark, sf_dir):
    """Two editions of the buildings: some were absent before, some are gone, some grew."""
    houses = view(spark, sf_dir, "v_buildings")
    def hashed(df, half_x):
        return df.select("area_id", "source_id", content_hash(F.col("cx").cast("string"), F.col("cz").cast("string"), half_x.cast("string"), F.col("half_z").cast("string")).alias("geometry_hash"))
    before = hashed(houses.where("half_x <> 7"), F.col("half_x"))
    after = hashed(houses.where("half_x <> 9"), F.when(F.col("half_z") == 5, F.col("half_x") + 1).otherwise(F.col("half_x")))
    return S.refresh_diff(before, after, ["area_id", "source_id"])


@topic.query(duck("""
SELECT area_id, ordinal, target_id FROM v_overrides o WHERE NOT EXISTS (SELECT 1 FROM v_road_tags t WHERE t.area_id = o.area_id AND t.source_id = o.target_id)""",
    "v_overrides", "v_road_tags"))
def orphaned_overrides(spark, sf_dir):
    return S.orphaned(view(spark, sf_dir, "v_overrides"), view(spark, sf_dir, "v_road_tags"), "target_id", "source_id").select(
        "area_id", "ordinal", "target_id"
    )


@topic.query(duck("""
SELECT area_id, ordinal, target_id FROM v_overrides o WHERE NOT EXISTS (SELECT 1 FROM v_road_tags t WHERE t.area_id = o.area_id AND t.source_id = o.target_id AND t.way_id % 3 <> 0)""",
    "v_overrides", "v_road_tags"))
def lost_overrides(spark, sf_dir):
    """Overrides that are left over when every third road is gone from the source."""
    left = view(spark, sf_dir, "v_road_tags").where("way_id % 3 <> 0")
    return S.orphaned(view(spark, sf_dir, "v_overrides"), left, "target_id", "source_id").select("area_id", "ordinal", "target_id")


@topic.query(duck("""
WITH d AS (SELECT job_id % 20 AS user_id, job_id, status, arg_max(event_id, ts) AS event_id, max(ts) AS ts FROM v_job_events GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, job_id, status) AS rank FROM d)
SELECT user_id, job_id, status, event_id, ts, rank FROM r WHERE rank <= 10""", "v_job_events"))
def latest_distinct(spark, sf_dir):
    log = view(spark, sf_dir, "v_job_events").select((F.col("job_id") % 20).alias("user_id"), "job_id", "status", "event_id", "ts")
    return K.latest_distinct(log, ["user_id"], ["job_id", "status"], "ts").select(
        "user_id", "job_id", "status", "event_id", "ts", "rank"
    )


@topic.query(duck("""
WITH e AS (SELECT *, min(CASE WHEN status IN ('complete', 'failed', 'cancelled') THEN event_id END) OVER (PARTITION BY job_id) AS stop FROM v_job_events),
l AS (SELECT *, lag(status) OVER w AS ps, lag(progress) OVER w AS pp, row_number() OVER w AS rn FROM e WHERE stop IS NULL OR event_id <= stop WINDOW w AS (PARTITION BY job_id ORDER BY event_id))
SELECT job_id, event_id, status, progress FROM l WHERE rn = 1 OR status IS DISTINCT FROM ps OR progress IS DISTINCT FROM pp""", "v_job_events"))
def job_changes(spark, sf_dir):
    log = view(spark, sf_dir, "v_job_events")
    return J.status_changes(log, "event_id", ["status", "progress"], hot_keys(log, ["job_id"])).select(
        "job_id", "event_id", "status", "progress"
    )


@topic.query(duck("""
SELECT job_id, arg_max(status, ts) AS status, arg_max(progress, ts) AS progress, min(ts) FILTER (WHERE status = 'running') AS started_at,
 max(ts) FILTER (WHERE status IN ('complete', 'failed', 'cancelled')) AS completed_at, count(*) AS events FROM v_job_events GROUP BY 1""", "v_job_events"))
def job_lifecycle(spark, sf_dir):
    return J.lifecycle(view(spark, sf_dir, "v_job_events"), ["ts", "event_id"])


@topic.query(duck("""
WITH j AS (SELECT event_id AS job_id, status, status AS stage, progress, cast(event_id % 5 AS int) AS attempts, cast(NULL AS varchar) AS error_code FROM v_job_events),
c AS (SELECT *, CASE WHEN progress > 95 THEN 'progress' END AS error FROM j)
SELECT job_id, CASE WHEN status = 'running' AND attempts >= 3 THEN 'failed' WHEN status = 'running' THEN 'queued' ELSE status END AS status,
 CASE WHEN status = 'running' AND attempts >= 3 THEN 'failed' WHEN status = 'running' THEN 'queued-after-restart' ELSE stage END AS stage,
 CASE WHEN status = 'running' THEN 0 ELSE progress END AS progress, attempts,
 CASE WHEN error IS NOT NULL THEN 'INVALID_IMPORT' WHEN status = 'running' AND attempts >= 3 THEN 'IMPORT_INTERRUPTED' END AS error_code FROM c""", "v_job_events"))
def job_recovery(spark, sf_dir):
    jobs = view(spark, sf_dir, "v_job_events").select(
        F.col("event_id").alias("job_id"), "status", F.col("status").alias("stage"), "progress",
        (F.col("event_id") % 5).cast("int").alias("attempts"), F.lit(None).cast("string").alias("error_code"),
    )
    good, bad = J.quarantine(jobs, F.when(F.col("progress") > 95, "progress"))
    return J.recover_interrupted(good).unionByName(
        J.recover_interrupted(bad.drop("error")).withColumn("error_code", F.lit("INVALID_IMPORT"))
    )


ENTRY_SQL = """
en AS (SELECT o_custkey AS race_id, o_orderkey AS entrant, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS time, floor(o_totalprice / 1000) AS progress FROM orders)"""


def entries(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("race_id"), F.col("o_orderkey").alias("entrant"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("time"),
        F.floor(F.col("o_totalprice") / 1000).cast("double").alias("progress"),
    )


@topic.query(duck(f"WITH {ENTRY_SQL.strip()} SELECT race_id, entrant, rank() OVER (PARTITION BY race_id ORDER BY progress DESC) AS position FROM en"))
def race_positions(spark, sf_dir):
    rows = entries(spark, sf_dir)
    return races.positions(rows, ["race_id"], hot_keys(rows, ["race_id"])).select("race_id", "entrant", "position")


@topic.query(duck(f"""
WITH {ENTRY_SQL.strip()} SELECT race_id, entrant, time IS NOT NULL AS finished, row_number() OVER (PARTITION BY race_id ORDER BY time ASC NULLS LAST, progress DESC, entrant) AS position FROM en"""))
def race_standings(spark, sf_dir):
    rows = entries(spark, sf_dir)
    return races.standings(rows, ["race_id"], "entrant", hot_keys(rows, ["race_id"])).select(
        "race_id", "entrant", "finished", "position"
    )


@topic.query(duck("""
WITH p AS (SELECT user_id AS entrant, event_id AS tick, cast(floor(value) AS bigint) % 6 + 1 AS position FROM events),
l AS (SELECT *, lag(position) OVER (PARTITION BY entrant ORDER BY tick) AS previous FROM p)
SELECT entrant, tick, previous, position FROM l WHERE previous <> position"""))
def position_changes(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("entrant"), F.col("event_id").alias("tick"), (F.floor("value") % 6 + 1).alias("position")
    )
    return races.position_changes(log, ["entrant"], "tick", hot_keys(log, ["entrant"])).select(
        "entrant", "tick", "previous", "position"
    )


@topic.query(duck(f"""
WITH s AS (SELECT user_id AS entrant, event_id AS checkpoint, event_id * 2.5 + value AS time FROM events),
d AS (SELECT entrant, time - coalesce(lag(time) OVER (PARTITION BY entrant ORDER BY checkpoint), 0) AS split FROM s)
SELECT entrant, {places_sql('min(split)', 6)} AS fastest FROM d GROUP BY 1"""))
def fastest_splits(spark, sf_dir):
    splits = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("entrant"), F.col("event_id").alias("checkpoint"), (F.col("event_id") * F.lit(2.5) + F.col("value")).alias("time")
    )
    best = races.fastest_splits(splits, ["entrant"], "checkpoint", hot_keys(splits, ["entrant"]))
    return best.withColumn("fastest", places(F.col("fastest"), 6))


@topic.query(duck(f"""
WITH s AS (SELECT event_id % 40 AS race_id, event_id % 7 AS checkpoint, event_id AS entrant, value AS time, event_type = 'click' AS player FROM events),
r AS (SELECT race_id, checkpoint, min(time) AS best FROM s WHERE NOT player GROUP BY 1, 2)
SELECT s.race_id, s.checkpoint, entrant, {places_sql('time - best', 6)} AS delta FROM s LEFT JOIN r USING (race_id, checkpoint) WHERE player"""))
def split_deltas(spark, sf_dir):
    splits = table(spark, sf_dir, "events").select(
        (F.col("event_id") % 40).alias("race_id"), (F.col("event_id") % 7).alias("checkpoint"), F.col("event_id").alias("entrant"),
        F.col("value").alias("time"), (F.col("event_type") == "click").alias("player"),
    )
    return races.split_deltas(splits.where("player"), splits.where("NOT player"), ["race_id", "checkpoint"]).select(
        "race_id", "checkpoint", "entrant", places(F.col("delta"), 6).alias("delta")
    )


@topic.query(duck("""
WITH f AS (SELECT user_id % 30 AS course, event_id AS finish, value AS time FROM events),
p AS (SELECT *, min(time) OVER (PARTITION BY course ORDER BY finish ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_best FROM f)
SELECT course, finish, time, previous_best, previous_best IS NULL OR time < previous_best AS personal_best, least(time, coalesce(previous_best, time)) AS best FROM p"""))
def personal_bests(spark, sf_dir):
    finishes = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 30).alias("course"), F.col("event_id").alias("finish"), F.col("value").alias("time")
    )
    return races.personal_bests(finishes, ["course"], "finish", hot_keys(finishes, ["course"]))


FOLLOW_SQL = """
ps AS (SELECT user_id % 25 AS race_id, event_id // 500 AS tick, event_id AS entrant, cast((event_id * 7919) % 61 AS double) AS x, cast((event_id * 6151) % 67 AS double) AS z,
 CASE event_id % 2 WHEN 0 THEN 0.6e0 ELSE 0.8e0 END AS fx, CASE event_id % 2 WHEN 0 THEN 0.8e0 ELSE -0.6e0 END AS fz FROM events),
pq AS (SELECT a.race_id, a.tick, a.entrant, b.entrant AS rival, b.x - a.x AS dx, b.z - a.z AS dz, a.fx, a.fz FROM ps a JOIN ps b ON a.race_id = b.race_id AND a.tick = b.tick AND a.entrant <> b.entrant),
ob AS (SELECT *, sqrt(dx * dx + dz * dz) AS away, dx * fx + dz * fz AS ahead, abs(dz * fx - dx * fz) AS aside FROM pq)"""


def close_poses(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 25).alias("race_id"), F.floor(e / 500).alias("tick"), e.alias("entrant"),
        ((e * 7919) % 61).cast("double").alias("x"), ((e * 6151) % 67).cast("double").alias("z"),
        F.when(e % 2 == 0, 0.6).otherwise(0.8).alias("fx"), F.when(e % 2 == 0, 0.8).otherwise(-0.6).alias("fz"),
    )


@topic.query(duck(f"""
WITH {FOLLOW_SQL.strip()} SELECT race_id, tick, entrant, min(rival) AS rival, {places_sql('arg_min(0.12e0 * (1 - (ahead - 5) / 20), rival)', 6)} AS boost
FROM ob WHERE ahead > 5 AND ahead < 18 AND aside < 2.1 GROUP BY 1, 2, 3"""))
def drafting(spark, sf_dir):
    return races.drafting(close_poses(spark, sf_dir)).withColumn("boost", places(F.col("boost"), 6))


@topic.query(duck(f"""
WITH {FOLLOW_SQL.strip()}, br AS (SELECT race_id, tick, entrant, CASE WHEN away <= 2.2 THEN 1 WHEN ahead <= 0 OR ahead >= 11 OR aside > 2.15 THEN 0 WHEN ahead <= 4.8 THEN 1 ELSE (11 - ahead) / (11 - 4.8e0) END AS b FROM ob)
SELECT race_id, tick, entrant, {places_sql('max(b)', 6)} AS brake FROM br WHERE b > 0 GROUP BY 1, 2, 3"""))
def proximity_brakes(spark, sf_dir):
    return races.proximity_brakes(close_poses(spark, sf_dir)).where("brake > 0").withColumn("brake", places(F.col("brake"), 6))


LOG_SQL = "lg AS (SELECT event_type AS provider, concat('osm:way:b', user_id) AS source_id, event_id AS seq, cast((event_id * 7) % 11 AS int) AS expected_revision FROM events)"


def write_log(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("provider"), F.concat(F.lit("osm:way:b"), F.col("user_id").cast("string")).alias("source_id"),
        F.col("event_id").alias("seq"), ((F.col("event_id") * 7) % 11).cast("int").alias("expected_revision"),
        F.when(F.col("event_id") % 4 != 0, F.col("event_id")).alias("payload"),
    )


@topic.query(duck(f"""
WITH RECURSIVE {LOG_SQL},
ch AS (SELECT provider, source_id, 0 AS k, min(seq) AS seq FROM lg WHERE expected_revision = 0 GROUP BY 1, 2
 UNION ALL SELECT c.provider, c.source_id, c.k + 1, min(l.seq) FROM ch c JOIN lg l ON l.provider = c.provider AND l.source_id = c.source_id AND l.expected_revision = c.k + 1 AND l.seq > c.seq GROUP BY c.provider, c.source_id, c.k)
SELECT lg.provider, lg.source_id, lg.seq, ch.seq IS NOT NULL AS accepted, cast(ch.k + 1 AS int) AS revision FROM lg LEFT JOIN ch ON ch.provider = lg.provider AND ch.source_id = lg.source_id AND ch.seq = lg.seq"""))
def customization_writes(spark, sf_dir):
    return C.accept_writes(write_log(spark, sf_dir)).select("provider", "source_id", "seq", "accepted", "revision")


@topic.query(duck("""
WITH sv AS (SELECT source_id, area_id, 'saved' AS origin FROM v_buildings WHERE half_x % 2 = 0), pr AS (SELECT source_id, area_id, 'proposal' AS origin FROM v_buildings WHERE half_z % 3 = 0),
au AS (SELECT source_id, area_id, 'automatic' AS origin FROM v_buildings WHERE half_x > 5)
SELECT * FROM pr UNION ALL SELECT * FROM sv WHERE source_id NOT IN (SELECT source_id FROM pr)
UNION ALL SELECT * FROM au WHERE source_id NOT IN (SELECT source_id FROM pr) AND source_id NOT IN (SELECT source_id FROM sv)""", "v_buildings"))
def merged_previews(spark, sf_dir):
    houses = view(spark, sf_dir, "v_buildings").select("area_id", "source_id", "half_x", "half_z")
    part = lambda rule, name: houses.where(rule).select("area_id", "source_id", F.lit(name).alias("origin"))
    return C.merge_previews(
        part("half_x % 2 = 0", "saved"), part("half_z % 3 = 0", "proposal"), part("half_x > 5", "automatic"), ["area_id", "source_id"]
    )


def map_rings(spark, sf_dir):
    """Building rings in degrees, as polygons of positions."""
    def position(p):
        return F.struct(
            (-75.0 + p["x"] / F.lit(85000.0)).alias("lon"), (40.0 - p["z"] / F.lit(111320.0)).alias("lat"),
            F.lit(None).cast("double").alias("h"),
        )

    return building_corners(spark, sf_dir).withColumn(
        "polygons", F.array(F.array(F.transform("ring", position)))
    )


def openings(spark, sf_dir):
    """Three openings per building on its first wall, the last one seen from the other end."""
    number = F.substring("source_id", 10, 20).cast("bigint")
    wall = Y.edges(F.col("polygons")[0][0])[0]
    base = map_rings(spark, sf_dir).select("source_id", number.alias("n"), wall.alias("w"))
    each = base.withColumn("ordinal", F.explode(F.sequence(F.lit(0), F.lit(2))))
    shift = F.when(F.col("n") % 17 == 0, 0.001).otherwise(0.0)
    back = F.col("ordinal") == 2
    return each.select(
        "source_id", "ordinal",
        F.when((F.col("n") + F.col("ordinal")) % 3 == 0, "window").when((F.col("n") + F.col("ordinal")) % 3 == 1, "garage")
        .otherwise("front-door").alias("kind"),
        (1 + F.col("n") % 3).cast("int").alias("cars"), F.lit(1.0).alias("width"), F.col("ordinal").cast("double").alias("sill"),
        (((F.col("n") * 3 + F.col("ordinal") * 4) % 10).cast("double") / 10).alias("fraction"),
        (F.when(back, F.col("w.b.lon")).otherwise(F.col("w.a.lon")) + shift).alias("a_lon"), F.when(back, F.col("w.b.lat")).otherwise(F.col("w.a.lat")).alias("a_lat"),
        (F.when(back, F.col("w.a.lon")).otherwise(F.col("w.b.lon")) + shift).alias("b_lon"), F.when(back, F.col("w.a.lat")).otherwise(F.col("w.b.lat")).alias("b_lat"),
    )


@topic.query(duck("""
WITH b AS (SELECT source_id, cast(substring(source_id, 10) AS bigint) AS n, half_x, 40e0 - (cz - half_z) / 111320e0 AS lat FROM v_buildings),
o AS (SELECT b.*, i AS ordinal, CASE (n + i) % 3 WHEN 0 THEN 'window' WHEN 1 THEN 'garage' ELSE 'front-door' END AS kind, ((n * 3 + i * 4) % 10) / 10e0 AS fraction,
 2 * half_x / 85000e0 * 111320e0 * cos(radians(lat)) AS len FROM b, range(3) r(i)),
s AS (SELECT *, CASE kind WHEN 'garage' THEN 2.7e0 * (1 + n % 3) ELSE 1e0 END AS w, CASE kind WHEN 'window' THEN ordinal ELSE 0 END AS low, CASE kind WHEN 'window' THEN 1.3e0 WHEN 'garage' THEN 2.3e0 ELSE 2.1e0 END AS tall,
 CASE WHEN ordinal = 2 THEN 1 - fraction ELSE fraction END AS at FROM o),
f AS (SELECT source_id, 0 AS stage, ordinal, CASE WHEN n % 17 = 0 THEN 'detached' WHEN fraction < (w / 2 + 0.1) / len OR fraction > 1 - (w / 2 + 0.1) / len THEN 'does-not-fit' END AS failure FROM s),
v AS (SELECT a.source_id, 1 AS stage, a.ordinal, 'overlap' AS failure FROM s a JOIN s b ON a.source_id = b.source_id AND a.ordinal < b.ordinal
 WHERE abs(a.at - b.at) * a.len < (a.w + b.w) / 2 + 0.1 AND a.low < b.low + b.tall AND b.low < a.low + a.tall),
u AS (SELECT * FROM f WHERE failure IS NOT NULL UNION ALL SELECT * FROM v)
SELECT source_id, cast(ordinal AS int) AS ordinal, failure FROM u QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY stage, ordinal) = 1""", "v_buildings"))
def opening_errors(spark, sf_dir):
    walls = C.wall_rows(map_rings(spark, sf_dir).select("source_id", "polygons"))
    return C.opening_errors(openings(spark, sf_dir), walls)


@topic.query(duck("""
WITH v AS (SELECT area_id, source_id, sx, sz, printf('%.7f,%.7f', -75e0 + (cx + half_x * sx) / 85000e0, 40e0 - (cz + half_z * sz) / 111320e0) AS p, i FROM v_buildings,
 (VALUES (0, -1, -1), (1, 1, -1), (2, 1, 1), (3, -1, 1), (4, -1, -1)) AS k(i, sx, sz)),
e AS (SELECT area_id, source_id, CASE WHEN p <= n THEN concat(p, ':', n) ELSE concat(n, ':', p) END AS e FROM (SELECT *, lead(p) OVER (PARTITION BY area_id, source_id ORDER BY i) AS n FROM v) WHERE n IS NOT NULL)
SELECT area_id, source_id, concat('[[["', string_agg(e, '","' ORDER BY e), '"]]]') AS signature FROM e GROUP BY 1, 2""", "v_buildings"))
def footprint_signatures(spark, sf_dir):
    return map_rings(spark, sf_dir).select("area_id", "source_id", Y.footprint_signature(F.col("polygons")).alias("signature"))


@topic.query(duck("""
WITH m AS (SELECT area_id, min(-75e0 + (cx - half_x) / 85000e0) AS west, max(-75e0 + (cx + half_x) / 85000e0) AS east, min(40e0 - (cz + half_z) / 111320e0) AS south, max(40e0 - (cz - half_z) / 111320e0) AS north, count(*) AS buildings FROM v_buildings GROUP BY 1),
o AS (SELECT area_id, count(*) AS overrides, max(ordinal) AS last_change FROM v_overrides GROUP BY 1)
SELECT m.area_id, round(west, 7) AS west, round(south, 7) AS south, round(east, 7) AS east, round(north, 7) AS north, buildings, coalesce(overrides, 0) AS overrides, last_change FROM m LEFT JOIN o USING (area_id)""", "v_buildings", "v_overrides"))
def world_list(spark, sf_dir):
    """One world per area with its bounds, latest change first."""
    box = G.ring_bounds(F.col("polygons")[0][0])
    worlds = map_rings(spark, sf_dir).withColumn("box", box).groupBy("area_id").agg(
        *[agg(f"box.{side}").alias(side) for side, agg in (("west", F.min), ("south", F.min), ("east", F.max), ("north", F.max))],
        F.count("*").alias("buildings"),
    )
    changes = view(spark, sf_dir, "v_overrides").groupBy("area_id").agg(
        F.count("*").alias("overrides"), F.max("ordinal").alias("last_change")
    )
    return worlds.join(changes, "area_id", "left").select(
        "area_id", *[F.round(c, 7).alias(c) for c in ("west", "south", "east", "north")], "buildings",
        F.coalesce("overrides", F.lit(0)).alias("overrides"), "last_change",
    ).orderBy(F.col("last_change").desc_nulls_last(), "area_id")
