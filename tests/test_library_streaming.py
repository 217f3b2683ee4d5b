"""Track files, library listings, report formats, and streaming against batch."""

import datetime
import json
import os
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from conftest import SMALL, rows
from trackloom.functions import report
from trackloom.operators import blocks, cleaning, library, quality, roads, search, stats
from trackloom.operators.blocks import NO_HOT_KEYS, HotKeys
from trackloom.plans import importing
from trackloom.session import durable
from trackloom.sources import derived, files, index_store, tracks
from trackloom.streaming import live


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


# --- track documents ------------------------------------------------------------------------------

SAMPLE = {"t": 0.0, "time": "2024-01-01T08:00:00+02:00", "lat": 49.8, "lon": 24.0, "kmh": 30, "status": "ok",
          "raw": "30 KM/H N49.8 E24.0 | 2024/01/01 | 08:00:00", "scores": [0.9, 0.8]}
HEADER = {"video_filename": "a.mp4", "fingerprint": "1:a", "video_size": 1, "video_mtime": 1.5, "extraction_status": "ok",
          "extracted_at": "x", "extractor_version": 1, "cleaning_version": 2,
          "video": {"width": 2560, "height": 1440, "duration_s": 60.0},
          "overrides": {"bad_ranges_s": [[1, 2]], "good_ranges_s": []}, "streets": []}
BROKEN = {
    "status": {"status": "fine"}, "raw": {"raw": "no separator"}, "zone": {"time": "2024-01-01T08:00:00"},
    "text lat": {"lat": "49.8"}, "bool lat": {"lat": True}, "no lat": {"lat": None}, "scores": {"scores": [0.9]},
}


def test_reading_and_validating_documents(spark):
    path = folder()
    def write(name, header=None, samples=(SAMPLE,), text=None, bom=""):
        document = {**HEADER, "video_filename": f"{name}.mp4", **(header or {}), "samples": list(samples)}
        with open(f"{path}/{name}.json", "w", encoding="utf-8") as out:
            out.write(bom + (text or json.dumps(document, indent=2, ensure_ascii=False)))

    write("good", samples=[SAMPLE, {**SAMPLE, "t": 1.0, "status": "no_fix", "lat": None, "lon": None, "time": None, "time_estimated": True}])
    write("bom", bom="﻿")
    write("empty", samples=[])
    write("not json", text="{")
    write("ranges", header={"overrides": {"bad_ranges_s": [[2, 1]]}})
    write("pair", header={"overrides": {"bad_ranges_s": [[1]]}})
    write("field", header={"fingerprint": None})
    for name, change in BROKEN.items():
        write(name, samples=[SAMPLE, {**SAMPLE, **change}])
    headers, samples, quarantine = tracks.read_tracks(tracks.read_documents(spark, path))
    assert {r.stem for r in headers.collect()} == {"good", "bom", "empty"}
    assert {r.file_stem: r.sample_number for r in quarantine.collect()} == {
        "not json": None, "ranges": None, "pair": None, "field": None, **{name: 2 for name in BROKEN}
    }
    first, second = samples.where("trip_id = 'good'").orderBy("seq").collect()
    assert (first.gps_text, first.clock_text) == ("30 KM/H N49.8 E24.0", "2024/01/01 | 08:00:00")
    assert first.time == datetime.datetime(2024, 1, 1, 6) and second.time_estimated and second.lat is None
    assert rows(tracks.overrides_table(headers), "kind", "start_s", "end_s") == [("bad", 1.0, 2.0)] * 3
    assert headers.where("enrichment is null and size(localities) = 0 and size(streets) = 0").count() == 3


def test_samples_are_one_document_per_trip_and_survive_being_written(spark, samples):
    whole = tracks.sample_documents(samples)
    assert whole.count() == whole.select("trip_id").distinct().count() == 15
    assert sum(len(json.loads(r.samples_json)) for r in whole.collect()) == samples.count()
    path = folder()
    tracks.write_samples(samples, path)
    assert spark.read.parquet(path).count() == samples.count()


# --- files ------------------------------------------------------------------------------------------


def test_scanning_folders(spark):
    import os

    root = folder()
    for path in ("b.MP4", "a.mov", ".hidden.mp4", "x.txt", "Movie/20240101080000_000001.MP4", "Movie/RO/20240101080000_000001.MP4",
                 ".trash/20240101080100_000002.MP4", "Movie/20240101080100_000002P.MP4"):
        os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
        with open(f"{root}/{path}", "w") as out:
            out.write(path)
    assert [r.name for r in files.scan_library(spark, root).collect()] == ["a.mov", "b.MP4"]
    clips = library.one_per_name(files.list_files(spark, root))
    found = {r.name: (r.path, r.copies) for r in clips.collect()}
    assert found["20240101080000_000001.MP4"] == ("Movie/RO/20240101080000_000001.MP4", 2)
    assert "20240101080100_000002.MP4" not in found and ".hidden.mp4" not in found
    assert {r.name for r in library.parse_clips(clips).collect()} == {"20240101080000_000001.MP4"}
    import hashlib

    with open(f"{root}/Movie/b.MP4", "wb") as out:  # larger than one array may be, but sparse
        out.write(b"head")
        out.truncate(3 << 30)
        out.seek(-4, 2)
        out.write(b"tail")
    prints = {r.path: r.fingerprint for r in files.fingerprint_files(spark, root).collect()}
    mega = 1 << 20
    ends = b"head" + bytes(mega - 4) + bytes(mega - 4) + b"tail"
    assert prints["Movie/b.MP4"] == f"{3 << 30}:{hashlib.sha256(ends).hexdigest()[:16]}"
    assert prints["b.MP4"] == f"5:{hashlib.sha256(b'b.MP4').hexdigest()[:16]}"
    wanted = spark.createDataFrame([("b.MP4",)], "path string")
    assert rows(files.fingerprint_files(spark, root, wanted), "path", "name") == [("b.MP4", "b.MP4")]


def test_extraction_plan_with_several_copies_of_an_orphan(spark):
    videos = spark.createDataFrame([("b.mp4", 1, 1.0, "f"), ("a.mp4", 1, 1.0, "f"), ("c.mp4", 1, 1.0, "g"), ("d.mp4", 1, 2.0, "h")],
                                   "name string, size bigint, mtime double, fingerprint string")
    known = spark.createDataFrame([("old", 1, 1.0, "f"), ("d", 1, 1.0, "h")], "stem string, video_size bigint, video_mtime double, fingerprint string")
    none = known.select("stem").where("false")
    plan = {r.name: (r.action, r.known_as) for r in library.plan_extraction(videos, known, none).collect()}
    assert plan == {"a.mp4": ("renamed", "old"), "b.mp4": ("duplicate", "a"), "c.mp4": ("new", None), "d.mp4": ("touch", None)}
    forced = {r.name: r.action for r in library.plan_extraction(videos, known, none, force=True).collect()}
    assert forced["d.mp4"] == "forced"


def test_output_names(spark):
    df = spark.createDataFrame([("Sea", datetime.datetime(2024, 5, 6, 7, 8)), (None, datetime.datetime(2024, 5, 6, 7, 8)),
                                ("2024-01-01 Sea", datetime.datetime(2024, 5, 6, 7, 8)), (".x", None), ("a:b", None), ("é" * 80, None)],
                               "name string, start timestamp")
    got = [r[0] for r in df.select(library.dated_output_name(F.col("name"), F.col("start"))).limit(3).collect()]
    assert got == ["2024-05-06 Sea", "2024-05-06 Trip 07-08", "2024-01-01 Sea"]
    problems = [r[0] for r in df.where("start is null").select(library.output_name_problem(F.col("name"))).collect()]
    assert problems[0].startswith("must not") and problems[1].startswith("must not") and problems[2] == "use at most 142 bytes in UTF-8 (164 now)"


def test_report_texts(spark):
    df = spark.createDataFrame([(0.0, 0.25), (1.65, 59.5), (99.96, 3599.6), (123.5, 90061.0), (None, None)], "km double, s double")
    got = [tuple(r) for r in df.select(report.distance(F.col("km")), report.duration(F.col("s")), report.status_duration(F.col("s"))).collect()]
    assert got == [("0.0 km", "0:00", "0:00:00"), ("1.6 km", "1:00", "0:00:59"), ("100.0 km", "1:00:00", "0:59:59"),
                   ("124 km", "25:01:01", "25:01:01"), ("-", "-", "-")]


def test_search_terms_and_date_filters(spark):
    assert search.query_terms(" Main Street ,, kyiv ") == ["main street", "kyiv"]
    asked = [("2024-01-01", "2025-01-01"), ("2024-05-01", "2024-02-01"), (None, ""), ("2024-05-01", None), ("2025-05-01", "2023-01-01")]
    df = spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "i int, s string, e string")
    out = search.normalize_date_filter(F.col("s"), F.col("e"), F.lit("2024-01-01"), F.lit("2024-12-31"))
    got = [tuple(r)[1:] for r in df.select("i", *out).orderBy("i").collect()]
    assert got == [("", ""), ("2024-02-01", "2024-05-01"), ("", ""), ("2024-05-01", ""), ("2023-01-01", "2025-05-01")]


def test_places_in_the_list(spark):
    trips = [(f"t{i}", None if i % 4 == 0 else datetime.datetime(2024, 1, 1 + i % 3, 8), None if i % 8 == 0 else datetime.date(2024, 1, 2)) for i in range(60)]
    df = spark.createDataFrame(trips, "id string, start_time timestamp, date date")
    key = lambda t: t[1].isoformat() if t[1] else t[2].isoformat() if t[2] else ""
    order = sorted(sorted(t[0] for t in trips), key=lambda i: key(trips[int(i[1:])]), reverse=True)
    got = {r.id: r.place for r in search.ranked_newest_first(df.repartition(5)).collect()}
    assert got == {i: place for place, i in enumerate(order, 1)}


def test_stored_index_is_replaced_by_bucket(spark):
    path = folder()
    index = spark.range(300).select(F.format_string("trip %d", "id").alias("id"), F.col("id").alias("n"), F.struct(F.lit(1.5).alias("lat")).alias("box"))
    assert index_store.write_index(index, path) == 1
    assert rows(index_store.read_index(spark, path)) == rows(index)
    one = index.where("n = 7")
    new = one.withColumns({"id": F.lit("trip new"), "n": F.lit(7).cast("long")})
    assert index_store.replace_entries(spark, path, one.select("id"), new) == 2
    rebuilt = index.where("n <> 7").unionByName(new)
    assert rows(index_store.read_index(spark, path)) == rows(rebuilt)
    # readers of the old version still see it, and only the buckets of the two names were written
    assert rows(index_store.read_index(spark, path, 1)) == rows(index)
    written = [f for f in spark.read.parquet(f"{path}/entries").where("generation = 2").inputFiles() if "generation=2" in f]
    assert 1 <= len({f.split("bucket=")[1].split("/")[0] for f in written}) <= 2
    # a version that was not finished is not seen
    os.makedirs(f"{path}/versions/v-3")
    assert rows(index_store.read_index(spark, path)) == rows(rebuilt)
    assert index_store.versions(spark, folder()) == []


def test_stored_map_reads_only_cells_of_the_box(spark):
    path = folder()
    chunks = spark.range(400).select(
        F.col("id").alias("way_id"), (F.lit(-1.0) + F.col("id") * 0.01).alias("min_lat"), (F.lit(-1.0) + F.col("id") * 0.01 + F.col("id") % 7 * 0.05).alias("max_lat"),
        (F.lit(24.0) - F.col("id") % 5 * 0.1).alias("min_lon"), (F.lit(24.03) - F.col("id") % 5 * 0.1).alias("max_lon"),
    )
    files.write_map(chunks.select("way_id"), chunks, chunks.select("way_id"), path, 0.1)
    box = (0.33, 0.41, 23.7, 23.9)
    got = files.read_chunks_in_box(spark, path, *box)
    assert rows(got) == rows(roads.chunks_in_box(chunks, *box)) and got.count() > 0
    filters = got._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: ")[1].split("PushedFilters")[0]
    assert "cell_lat" in filters and "cell_lon" in filters
    assert rows(files.read_map(spark, path)[1]) == rows(chunks)


def test_reclean_keeps_other_tracks(spark, samples, readings):
    headers = derived.trip_tracks(spark, SMALL)
    again, after = importing.reclean(headers, samples, include=["2024-01-01 *"], timezone=derived.TIMEZONE)
    chosen = headers.where("video_filename like '2024-01-01%' and extraction_status = 'ok'").select("trip_id")
    same = samples.join(chosen, "trip_id", "left_semi")
    columns = ("trip_id", "seq", "status", "lat", "time")
    assert rows(again, *columns) == rows(same, *columns)
    assert after.where("cleaning_version = 2").count() == chosen.count()


def test_names_are_searched_once_per_trip(spark, samples):
    headers = derived.trip_tracks(spark, SMALL)
    found = headers.where(F.col("video_filename").rlike("Trip 0"))
    # the pattern is matched on the trips, not on the events that they are derived from
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()
    trips = {r.trip_id for r in samples.select("trip_id").distinct().collect()}
    assert {r.trip_id for r in headers.collect()} == trips and headers.count() == len(trips)


def test_import_hashes_the_samples_once_and_stores_what_the_rename_plan_reads(spark, readings, monkeypatch):
    digest, planned, hashed = importing.roads.samples_digest, [], []
    monkeypatch.setattr(importing.roads, "samples_digest", lambda samples: hashed.append(samples) or digest(samples))
    monkeypatch.setattr(importing.naming, "plan_renames", lambda trips, *rest, **options: planned.append(trips))
    ways, nodes = derived.road_ways(spark, SMALL), derived.road_nodes(spark, SMALL)
    tables = tuple(durable(t) for t in roads.load_map(nodes, ways, on_globe=False))
    headers, videos = derived.trip_tracks(spark, SMALL), derived.library_files(spark, SMALL)
    done = importing.import_all(readings, headers, videos, tables, timezone=derived.TIMEZONE)
    assert len(hashed) == 1
    # read from a table: neither samples nor digests are computed again whenever the plan reads its trips
    assert "Exchange" not in planned[0]._jdf.queryExecution().executedPlan().toString()
    enriched = headers.join(done["trips"].select("trip_id", "enrichment"), "trip_id", "left")
    expected = importing.rename_inputs(enriched, done["samples"], digest(done["samples"]), derived.TIMEZONE)
    assert rows(planned[0], *expected.columns) == rows(expected, *expected.columns)
    assert planned[0].where("enrichment_status = 'current'").count() == done["trips"].count()


# --- streaming --------------------------------------------------------------------------------------


def stream_of(spark, df, parts=3):
    """A file stream of a table, in several files."""
    path = folder()
    df.repartition(parts).write.mode("overwrite").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(stream, mode="append"):
    out, checkpoint = folder(), folder()
    live.catch_up(stream, out, checkpoint, mode).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


@pytest.fixture(scope="module")
def clips(spark):
    return durable(library.parse_clips(library.one_per_name(derived.clips(spark, SMALL), "camera_id")))


TRIP_COLUMNS = ("camera_id", "clips", "start_time", "first_idx", "last_idx")


def live_revisions(spark, parts, **options):
    """Revisions that a live stream writes while parts arrive, each caught up from the checkpoint."""
    path, out, checkpoint = folder(), folder(), folder()
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)
        stream = spark.readStream.schema(part.schema).parquet(path)
        live.catch_up_batches(live.live_trips(stream, **options), live.write_batches(out), checkpoint).awaitTermination()
    return spark.read.parquet(out)


@pytest.mark.parametrize("keep_days", [7, 0.01])
def test_live_trips_agree_with_batch_grouping(spark, clips, keep_days):
    """Clips come late and out of order; with a short memory they are joined when the trips are settled."""
    few = clips.where("camera_id % 3 = 0").select("camera_id", "start_time", "idx")
    batch = library.describe_trips(library.group_trips(clips.where("camera_id % 3 = 0"), hot=NO_HOT_KEYS))
    revisions = live_revisions(spark, [few.where(F.col("idx") % 3 == i) for i in (1, 2, 0)], keep_days=keep_days)
    got = durable(live.settled_trips(revisions))
    assert rows(got, *TRIP_COLUMNS) == rows(batch, *TRIP_COLUMNS)
    newest = got.groupBy("camera_id").agg(F.max("last_start").alias("last_start")).join(got, ["camera_id", "last_start"])
    assert newest.where("is_open").count() == newest.count()
    every = HotKeys(few.select("camera_id").distinct())
    assert rows(live.settled_trips(revisions, hot=every), *TRIP_COLUMNS) == rows(batch, *TRIP_COLUMNS)


def test_idle_trips_close_by_timer(spark):
    start = datetime.datetime(2024, 1, 1, 8)
    clips = spark.createDataFrame([(1, start, 1), (1, start + datetime.timedelta(seconds=1), 2)], "camera_id bigint, start_time timestamp, idx int")
    path, out, checkpoint = folder(), folder(), folder()
    clips.coalesce(1).write.mode("append").parquet(path)
    trips = live.live_trips(spark.readStream.schema(clips.schema).parquet(path), gap_hours=2 / 3600, closes_idle=True)
    writer = trips.writeStream.foreachBatch(live.write_batches(out)).option("checkpointLocation", checkpoint).outputMode("update")
    query = writer.trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            time.sleep(1)
            done = spark.read.schema(trips.schema).option("recursiveFileLookup", True).parquet(out) if os.listdir(out) else clips.limit(0)
            if done.count() == 2:
                break
    finally:
        query.stop()
    assert [(r.revision, r.clips, r.is_open) for r in done.orderBy("revision").collect()] == [(1, 2, True), (2, 2, False)]
    assert [r.is_open for r in live.settled_trips(done, 2 / 3600).collect()] == [False]


def test_seen_clips_are_dropped(spark, clips):
    twice = clips.unionByName(clips.where("idx % 2 = 0"))
    got = run(live.drop_seen(stream_of(spark, twice, 1)))
    assert rows(got, "name") == rows(clips, "name")


def test_logged_clips_are_left_out_and_restarts_add_nothing(spark, clips):
    log, out, checkpoint = folder(), folder(), folder()
    live.append_log(clips.where("idx % 4 = 0"), log)
    stream = stream_of(spark, clips.unionByName(clips.where("idx % 5 = 0")))
    for _ in range(2):
        live.catch_up_batches(stream, live.write_unlogged(spark, log, out), checkpoint, "append").awaitTermination()
    got = spark.read.option("recursiveFileLookup", True).schema(clips.schema).parquet(out)
    assert rows(got, "name") == rows(clips.where("idx % 4 <> 0"), "name")
    logged = live.read_log(spark, log)
    assert logged.count() == logged.dropDuplicates(["camera_id", "name", "size"]).count() == clips.count()
    # a batch that is repeated after a failure writes the same rows again
    again, lost = folder(), folder()
    live.append_log(clips.where("idx % 4 = 0"), lost)
    for _ in range(2):
        live.write_unlogged(spark, lost, again)(clips, 3)
    assert spark.read.schema(clips.schema).parquet(f"{again}/batch=3").count() == clips.where("idx % 4 <> 0").count()
    assert live.read_log(spark, lost).count() == clips.count()
    # only the folders of the buckets asked for are read
    some = live.read_log(spark, log, [3, 5])
    assert "bucket" in plan_of(some).split("PartitionFilters: ")[1].split("]")[0]
    assert {f.split("bucket=")[1].split("/")[0] for f in some.inputFiles()} >= {"3", "5"} and some.where("bucket not in (3, 5)").count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_live_segments_agree_with_batch(spark, readings):
    parsed = durable(cleaning.parse_readings(cleaning.attach_overrides(readings, None), blocks.trips()))
    fixes = durable(parsed.where("initial_status = 'ok'").select("trip_id", "seq", "t", "gps.lat", "gps.lon", "segment"))
    path = folder()
    for part, condition in enumerate(("seq < 25", "seq >= 25 and seq < 50", "seq >= 50")):
        fixes.where(condition).drop("segment").coalesce(1).write.mode("overwrite").parquet(f"{path}/p{part}")
    stream = spark.readStream.schema(fixes.drop("segment").schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(path)
    # Files arrive in the order of their modification time.
    got = run(live.live_segments(stream))
    assert rows(got, "trip_id", "seq", "segment") == rows(fixes, "trip_id", "seq", "segment")


def test_segments_of_one_batch_and_of_single_fixes(spark):
    fixes = spark.createDataFrame([(1, i, float(i), 49 + (i // 3) * 0.5, 24.0) for i in range(12)] + [(2, 0, 0.0, 49.0, 24.0)], "trip_id int, seq int, t double, lat double, lon double")
    got = run(live.live_segments(stream_of(spark, fixes, 1)))
    assert rows(got, "trip_id", "seq", "segment") == sorted([(1, i, i // 3 + 1) for i in range(12)] + [(2, 0, 1)], key=lambda r: tuple((v is None, str(v)) for v in r))


def test_states_of_many_trips_travel_together(spark):
    """Every trip used to make its own calls to the state store; many short trips took seconds each thousand."""
    many = spark.range(3000).select(
        "id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("seq")
    ).select(
        F.col("id").alias("trip_id"), "seq", F.col("seq").cast("double").alias("t"),
        (F.lit(49.0) + F.floor(F.col("seq") / 2) * 0.5).alias("lat"), F.lit(24.0).alias("lon"),
    )
    path = folder()
    for part in ("seq < 1", "seq >= 1"):
        many.where(part).coalesce(1).write.mode("append").parquet(path)
    found = live.live_segments(spark.readStream.schema(many.schema).option("maxFilesPerTrigger", 1).parquet(path))
    assert "FlatMapGroupsInPandasWithState" in found._jdf.queryExecution().logical().toString()
    got = run(found).groupBy("trip_id").agg(F.sort_array(F.collect_list(F.struct("seq", "segment"))).alias("s"))
    assert [list(map(tuple, r.s)) for r in got.select("s").distinct().collect()] == [[(0, 1), (1, 1), (2, 2), (3, 2)]]


def test_closed_trips_are_cleaned(spark, readings, samples):
    path, out, checkpoint = folder(), folder(), folder()
    # three dates beside each other; the clock texts keep theirs
    dated = durable(readings.withColumn("trip_date", F.date_add("trip_date", (F.col("trip_id") % 3).cast("int") - 1)))
    live.store_readings(dated, path)
    closed = dated.select("trip_id", "trip_date").distinct()
    stream = stream_of(spark, closed, 2)
    live.catch_up_batches(stream, live.clean_closed_trips(spark, path, out, dated.schema), checkpoint, "append").awaitTermination()
    got = spark.read.option("recursiveFileLookup", True).schema(samples.schema).parquet(out)
    assert rows(got, "trip_id", "seq", "status", "lat", "time") == rows(cleaning.clean_tracks(dated), "trip_id", "seq", "status", "lat", "time")
    one_day = closed.where("trip_id % 3 = 0")
    read = live.readings_of(spark, path, one_day, dated.schema)
    assert "trip_date" in plan_of(read).split("PartitionFilters: ")[1].split("]")[0]
    assert rows(read) == rows(dated.where("trip_id % 3 = 0"))
    dateless = live.readings_of(spark, path, one_day.select("trip_id", F.lit(None).cast("date").alias("trip_date")), dated.schema)
    assert dateless.count() == 0


def test_activity_stream_agrees_with_batch(spark, samples):
    steps = durable(stats.with_steps(samples, blocks.trips()).where("time is not null").select("trip_id", "seq", "time", "kmh", F.round("_step_m", 2).cast("decimal(12,2)").alias("step_m")))
    sizes, path, out, checkpoint = ("10 minutes", "5 minutes"), folder(), folder(), folder()
    for part in ("seq < 30", "seq >= 30"):
        steps.where(part).coalesce(1).write.mode("append").parquet(path)
        activity = live.trip_activity(spark.readStream.schema(steps.schema).parquet(path), *sizes, late="1 hour")
        live.catch_up_batches(activity, live.write_batches(out), checkpoint).awaitTermination()
    got = live.latest_rows(spark.read.parquet(out), ("trip_id", "window_start"))
    assert rows(got) == rows(live.trip_activity(steps, *sizes))


def test_recordings_with_long_numbers_are_told_apart(spark):
    """Names hold six digits; two recordings of a second used to become one clip with a cut index."""
    events = spark.sql(
        "SELECT * FROM VALUES (1234567, 7, TIMESTAMP '2024-01-01 08:00:00', 'view'), "
        "(1234568, 7, TIMESTAMP '2024-01-01 08:00:00', 'view') t(event_id, user_id, ts, event_type)"
    )
    listed = derived.clips_of(events)
    assert {r.name for r in listed.collect()} == {"20240101080000_123456.MP4"}
    parsed = library.parse_clips(library.one_per_name(listed, "camera_id"))
    assert sorted((r.idx, r.copies) for r in parsed.collect()) == [(1234567, 1), (1234568, 1)]


def test_large_maps_are_stored_in_few_folders(spark):
    path = folder()
    chunks = spark.range(500).select(
        F.col("id").alias("way_id"), *[(F.col("id") * 0.1 + 0.01).alias(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon")]
    )
    files.write_map(chunks.select("way_id"), chunks, chunks.select("way_id"), path, 0.1, most_folders=50)
    stored = spark.read.parquet(f"{path}/road_chunks")
    assert 25 <= stored.select("cell_lat", "cell_lon").distinct().count() <= 50 and stored.count() == 500
    got = files.read_chunks_in_box(spark, path, 1.95, 2.05, 1.95, 2.05)
    assert [r.way_id for r in got.collect()] == [20]


def test_documents_are_written_many_to_a_file(spark, tmp_path):
    texts = spark.range(3000).select(
        F.col("id").cast("string").alias("file_stem"), F.concat(F.lit('{"a":\n'), F.col("id").cast("string"), F.lit("}")).alias("text")
    ).unionByName(spark.createDataFrame([("bad", "{")], "file_stem string, text string"))
    tracks.write_documents(texts, f"{tmp_path}/docs")
    assert len(list((tmp_path / "docs").rglob("*.parquet"))) <= 20
    read = tracks.read_documents(spark, f"{tmp_path}/docs", bundled=True)
    got = {r.file_stem: r.v for r in read.select("file_stem", F.expr("variant_get(document, '$.a', 'int')").alias("v")).collect()}
    assert got == {**{str(i): i for i in range(3000)}, "bad": None}


def test_tokens_of_frames_are_shuffled_once(spark):
    token = "trip_id int, frame_t double, kind string, text string, x int, min_score double, mean_score double"
    found = spark.createDataFrame([
        (1, 0.0, "date", "2024/01/01", 1000, 0.9, 0.9), (1, 0.0, "date", "2023/01/01", 0, 0.5, 0.5),
        (1, 0.0, "time", "08:00:00", 1216, 0.8, 0.9), (1, 0.0, "speed", "30 KM/H", 0, 0.7, 0.8),
        (1, 0.0, "speed", "8 KM/H", 1010, 0.99, 0.99),
        (1, 0.0, "lat-prefix", "N49.8", 200, 0.9, 0.9), (1, 0.0, "lon-prefix", "E24.0", 400, 0.9, 0.9),
        (1, 0.0, "lat-suffix", "50.0N", 218, 0.99, 0.99),
        # a frame without a clock covers nothing, whatever its neighbours show
        (1, 1.0, "speed", "8 KM/H", 1010, 0.99, 0.99), (2, 0.0, "date", "2024/01/01", 1000, 0.9, 0.9),
    ], token)
    composed = quality.compose_readings(found)
    assert rows(composed, "trip_id", "t", "gps_text", "clock_text", "gps_score", "clock_score") == [
        (1, 0.0, "30 KM/H N49.8 E24.0", "2024/01/01 08:00:00", 0.7, 0.8), (1, 1.0, "8 KM/H", "", 0.99, -1.0),
        (2, 0.0, "", "2024/01/01", -1.0, 0.9),
    ]
    plan = composed._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1 and plan.count("+- Sort [") == 1


def test_closed_trips_with_negative_numbers_are_cleaned(spark, tmp_path):
    from trackloom.catalog.queries import QUERIES

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("user_id", -F.col("user_id") - 1)
    events.write.parquet(f"{tmp_path}/events.parquet")
    assert QUERIES["t4_cleaned_closed_trips"](spark, str(tmp_path)).count() == events.count()
