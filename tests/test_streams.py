"""Streams give what the batch forms give."""

import time
from pathlib import Path

from pyspark.sql import functions as F

from ridgelens.operators import raster, sight
from ridgelens.plans import jobs
from ridgelens.plans.fixtures import fixture
from ridgelens.plans.queries import QUERIES
from ridgelens.sources import sinks
from ridgelens.streaming import pose

DATA = "/root/testdata/sf0.001"


def run(stream, name, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def samples(spark, tmp_path):
    batch = fixture(spark, DATA, "fx_orientation").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.repartitionByRange(2, "ts").write.parquet(str(tmp_path / "o"))
    return batch, pose.read_stream(spark, str(tmp_path / "o"))


def test_changes(spark, tmp_path):
    batch, stream = samples(spark, tmp_path)
    run(pose.changes_stream(stream), "changed")
    assert sorted(r.event_id for r in spark.table("changed").collect()) == sorted(r.event_id for r in pose.changes(batch).collect())


def feed(stream, out, check, rows):
    """Runs a stream that appends to a folder until it has taken so many rows; with a time to live, batches never end by themselves."""
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(processingTime="200 milliseconds").start()
    end = time.time() + 60
    while sum(p["numInputRows"] for p in q.recentProgress) < rows and time.time() < end:
        time.sleep(0.2)
    q.stop()


def sample(spark, path, *rows):
    spark.createDataFrame(rows, "event_id bigint, device_id bigint, ts string, alpha double, beta double, gamma double, screen double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)


def test_a_restart_goes_on_and_idle_devices_are_forgotten(spark, tmp_path):
    src, first = str(tmp_path / "src"), str(tmp_path / "first")
    sample(spark, first, (1, 5, "2024-01-01 00:00:00", 1.0, 90.0, 0.0, 0.0), (2, 5, "2024-01-01 00:00:01", 2.0, 90.0, 0.0, 0.0), (3, 6, "2024-01-01 00:00:00", 1.0, 90.0, None, 0.0))
    initial = spark.read.schema(pose.ORIENTATION).parquet(first)
    for idle in (None, 3000):
        out, check = str(tmp_path / f"out{idle}"), str(tmp_path / f"check{idle}")
        src = str(tmp_path / f"src{idle}")
        # device 5 and 6 repeat the sample they start from, 7 is new
        sample(spark, src, (4, 5, "2024-01-01 00:00:02", 2.0, 90.0, 0.0, 0.0), (5, 6, "2024-01-01 00:00:02", 1.0, 90.0, None, 0.0), (6, 7, "2024-01-01 00:00:02", 1.0, 90.0, 0.0, 0.0), (7, 5, "2024-01-01 00:00:00", 9.0, 90.0, 0.0, 0.0))
        stream = lambda: pose.changes_stream(pose.read_stream(spark, src), idle=idle, initial=initial)  # noqa: B023, E731
        feed(stream(), out, check, 4)
        ids = lambda: sorted(r.event_id for r in spark.read.parquet(out).collect())  # noqa: B023, E731
        assert ids() == [6]  # and 7 is late
        if idle:
            time.sleep(4)
        sample(spark, src, (8, 5, "2024-01-01 00:00:03", 2.0, 90.0, 0.0, 0.0), (9, 7, "2024-01-01 00:00:03", 1.5, 90.0, 0.0, 0.0), (10, 7, "2024-01-01 00:00:03", 1.5, 90.0, 0.0, 0.0))
        feed(stream(), out, check, 3)
        assert ids() == ([6, 8, 9] if idle else [6, 9])


def test_keys_start_from_a_table(spark, tmp_path):
    path = str(tmp_path / "k")
    spark.createDataFrame([(1, 3, "ArrowUp"), (2, 3, "ArrowUp"), (3, 4, "ArrowLeft")], "seq bigint, device_id bigint, code string").withColumn("ts", F.timestamp_seconds("seq")).write.parquet(path)
    spark.createDataFrame([(3, 10.0, 115.0)], "device_id bigint, alpha double, beta double").write.parquet(str(tmp_path / "p"))
    stream = pose.from_keys_stream(pose.read_stream(spark, path, pose.KEYS), initial=spark.read.parquet(str(tmp_path / "p")))
    run(stream, "begun")
    assert sorted(map(tuple, spark.table("begun").collect())) == [(3, 1, 10.0, 120.0), (3, 2, 10.0, 120.0), (4, 3, 5.0, 90.0)]


def test_frames(spark, tmp_path):
    batch, stream = samples(spark, tmp_path)
    run(pose.frames(stream, late="1 day"), "frames", "update")
    assert sorted(map(tuple, spark.table("frames").collect())) >= sorted(map(tuple, pose.frames(batch).collect()))


def test_batches_that_run_twice_stand_once(spark, tmp_path):
    path, label = str(tmp_path / "labels"), "vp_id bigint, poi_id bigint, text string, shown boolean"
    one = spark.createDataFrame([(1, 1, "a", True), (1, 2, "b", False)], label)
    two = spark.createDataFrame([(2, 1, "a", True)], label)
    sinks.write_labels(one, path, 0)
    sinks.write_labels(two, path, 1)
    sinks.write_labels(one.where("shown"), path, 0)  # the batch again, with less
    rows = lambda: sorted(map(tuple, sinks.read_batches(spark, path, label).select("vp_id", "poi_id", "text", "shown").collect()))
    assert rows() == [(1, 1, "a", True), (2, 1, "a", True)]
    sinks.write_labels(two.limit(0), path, 1)
    assert rows() == [(1, 1, "a", True)]


def test_clustered_blocks_stay_where_they_lie(spark):
    """Joins with a clustered table shuffle the other side alone, give the same rows, and read the bands they need."""
    dem, poi, vp = (fixture(spark, DATA, f"fx_{n}") for n in ("dem", "poi", "vp"))
    poi, blocks = jobs.clean_landmarks(poi), raster.to_blocks(dem)
    table = sinks.write_clustered(blocks, "dem_clustered", buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        pairs = jobs.pairs_in_view(vp, poi, 64, "exact", blocks).select(*sight.ENDS).cache()
        pairs.count()
        points = poi.select("poi_id", F.floor(F.col("lat") * 3600).cast("int").alias("ilat"), F.floor(F.col("lon") * 3600).cast("int").alias("ilon"))
        for of, depth in ((lambda b: raster.sample_heights(points, b), 1), (lambda b: sight.line_of_sight(pairs, b), 3), (lambda b: raster.window_mosaic(vp, b, 32), 1)):
            have, want = of(table), of(blocks)
            assert sorted(map(str, have.collect())) == sorted(map(str, want.collect()))
            plan = have._jdf.queryExecution().executedPlan().toString()
            assert "Bucketed: true" in plan
            # an exchange never has the heights of blocks among its columns
            below = [x for x in plan.split("Exchange hashpartitioning")[1:] if "FileScan parquet spark_catalog.default.dem_clustered[bi" in x.split("\n\n")[0][:400]]
            assert len(below) <= depth - 1  # the pyramid's few numbers a block, not its pixels
        near = raster.held_near(table, vp.where("vp_id < 3"), 32)
        plan = raster.window_mosaic(vp.where("vp_id < 3"), near, 32)._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(band" in plan or "PartitionFilters: [band" in plan
        assert sorted(map(str, raster.window_mosaic(vp.where("vp_id < 3"), near, 32).collect())) == sorted(map(str, raster.window_mosaic(vp.where("vp_id < 3"), blocks, 32).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table dem_clustered")


def test_latest(spark, tmp_path):
    batch, stream = samples(spark, tmp_path)
    run(pose.latest(stream), "latest", "complete")
    assert sorted(map(tuple, spark.table("latest").collect())) == sorted(map(tuple, pose.latest(batch).collect()))


def test_keys(spark, tmp_path):
    batch = fixture(spark, DATA, "fx_key").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.write.parquet(str(tmp_path / "k"))
    run(pose.from_keys_stream(pose.read_stream(spark, str(tmp_path / "k"), pose.KEYS)), "pressed")
    assert sorted(map(tuple, spark.table("pressed").collect())) == sorted(map(tuple, pose.from_keys(batch).collect()))


def test_relabel(spark, tmp_path):
    batch, stream = samples(spark, tmp_path)
    blocks, poi = raster.to_blocks(fixture(spark, DATA, "fx_dem")), jobs.clean_landmarks(fixture(spark, DATA, "fx_poi"))
    seen = jobs.seen_from(fixture(spark, DATA, "fx_vp").where("vp_id < 4"), poi, blocks, size=64)
    seen = seen.join(batch.select("device_id").distinct().withColumn("vp_id", F.col("device_id") % 7), "vp_id").cache()
    got = []
    q = jobs.relabel(stream, seen, lambda d, n: got.extend(d.collect())).trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda rows: sorted((r.event_id, r.poi_id, r.text, r.nth, round(r.u, 9), round(r.v, 9), r.shown) for r in rows)
    assert key(got) == key(jobs.device_labels(pose.changes(batch), seen).collect()) and got


def views_again(spark, stream, seen, tmp_path):
    """What relabel_views() leaves: samples with their views, labels of the views."""
    looks, found = str(tmp_path / "looks"), str(tmp_path / "found")
    q = jobs.relabel_views(stream, seen, F.col("device_id") % 7, looks, found).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    held = "view string, poi_id bigint, text string, nth int, u double, v double, sx double, sy double, shown boolean"
    return sinks.read_batches(spark, looks, "event_id bigint, view string", numbered=True), sinks.read_batches(spark, found, held, numbered=True)


def test_relabel_views(spark, tmp_path):
    """Labels kept once for each view of a batch are those of each sample; views that differ in a sign or a null are two."""
    batch = fixture(spark, DATA, "fx_orientation").withColumn("ts", F.col("ts").cast("timestamp"))
    odd = spark.createDataFrame([(10**6 + i, 700 + i % 7, a, b, c, 0.0) for i in range(28) for a, b, c in [((0.0, 90.0, 0.0), (0.0, 90.0, None), (-0.0, 90.0, 0.0), (30.5, 75.0, -0.0))[i // 7]]], "event_id bigint, device_id bigint, alpha double, beta double, gamma double, screen double")
    odd = odd.withColumn("ts", F.timestamp_seconds(F.lit(2 * 10**9) + F.col("event_id"))).select(*batch.columns)
    middle = batch.selectExpr("timestamp_micros(bigint(avg(unix_micros(ts))))").first()[0]
    for part in (batch.where(F.col("ts") < middle), batch.where(F.col("ts") >= middle), odd):  # one after the other, as a stream takes files by age
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "o"))
    stream, batch = pose.read_stream(spark, str(tmp_path / "o"), maxFilesPerTrigger="1"), spark.read.schema(pose.ORIENTATION).parquet(str(tmp_path / "o"))
    blocks, poi = raster.to_blocks(fixture(spark, DATA, "fx_dem")), jobs.clean_landmarks(fixture(spark, DATA, "fx_poi"))
    seen = jobs.seen_from(fixture(spark, DATA, "fx_vp").where("vp_id < 4"), poi, blocks, size=64).cache()
    each, found = views_again(spark, stream, seen, tmp_path)
    key = lambda rows: sorted((r.event_id, r.poi_id, r.text, r.nth, repr(r.u), repr(r.v), repr(r.sx), repr(r.sy), r.shown) for r in rows)
    at = batch.select("device_id").distinct().withColumn("vp_id", F.col("device_id") % 7)
    changed = each.join(batch, "event_id")
    assert each.count() == pose.changes(batch).count() and each.select(sinks.BATCH).distinct().count() > 1
    want = jobs.device_labels(changed, seen.join(at, "vp_id")).collect()
    assert key(jobs.labels_of(each, found).collect()) == key(want) and want
    assert found.count() == found.select(sinks.BATCH, "view", "poi_id").distinct().count() < len(want) / 2
    views = [r.view for r in each.where("event_id >= 1000000").select("view").distinct().collect()]
    assert len(views) == 28  # four poses at each of seven places


def test_labels_of_a_stream_are_not_written_for_each_sample(spark):
    """What labels_stream leaves on disk are samples and labels of views, fewer rows than it returns."""
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.glob("*"))
    rows = QUERIES["labels_stream"](spark, DATA).count()
    kept = [spark.read.parquet(str(p)).count() for p in set(shared.glob("*")) - before if not p.name.startswith("stream-")]
    assert rows and kept and sum(kept) < rows / 2
