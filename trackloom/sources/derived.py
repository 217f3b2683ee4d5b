"""Trip tables derived by Spark from the generic benchmark tables.

Only whole numbers and string concatenation are used, so other engines build the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from trackloom.functions import text
from trackloom.operators.blocks import Ordering, RunningSum, by_group, scan
from trackloom.session import durable

TRIP_DATE = "2024-01-01"
TIMEZONE = "Europe/Kyiv"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _degrees(micro: Column, width: int = 6) -> Column:
    """Micro-degrees as text with six decimals."""
    return F.concat(
        F.floor(micro / 1_000_000).cast("string"), F.lit("."),
        F.lpad((micro % 1_000_000).cast("string"), width, "0"),
    )


def readings(spark: SparkSession, folder: str, hot=None) -> DataFrame:
    """Raw readings: one trip per user, one reading per event, with typical disturbances."""
    events = table(spark, folder, "events").select("event_id", "ts", "user_id")
    # Users are ordered by time; a block of a very active user is one day of events.
    by_user = Ordering(
        ("user_id",), ("ts", "event_id"), "unix_micros(cast(ts as timestamp)) / 86400000000", 1.0
    )
    df = by_group(
        events, by_user, lambda d, o: scan(d, o, _number=RunningSum(F.lit(1))), hot
    )
    user, seq = F.col("user_id"), F.col("seq")
    df = df.withColumn("seq", (F.col("_number") - 1).cast("int"))
    spoof = ((user % 5 == 0) & seq.between(20, 34)) | ((user % 10 == 3) & (seq >= 30))
    no_fix = (user % 7 == 0) & seq.between(40, 45)
    gap = F.when((user % 11 == 0) & (seq >= 50), 600).otherwise(0)
    gps = F.concat(
        F.lit("108 KM/H N"), _degrees(49_800_000 + user * 1000 + seq * 270),
        F.lit(" E"), _degrees(24_000_000 + user * 100),
    )
    spoof_gps = F.concat(
        F.lit("200 KM/H S12."), F.lpad((45_000 + seq * 500).cast("string"), 6, "0"),
        F.lit(" W77.030000"),
    )
    day = (
        F.when(spoof, F.lit("2023/12/20")).when(user % 3 == 0, F.lit("01/01/2024"))
        .otherwise(F.lit("2024/01/01"))
    )
    second = 8 * 3600 + seq + gap
    clock = F.concat(
        day, F.lit(" "),
        *[
            part
            for unit, after in ((3600, ":"), (60, ":"), (1, ""))
            for part in (
                F.lpad((F.floor(second / unit) % (24 if unit == 3600 else 60)).cast("string"), 2, "0"),
                F.lit(after),
            )
        ],
    )
    return df.select(
        user.alias("trip_id"), "seq", seq.cast("double").alias("t"),
        F.when(no_fix, F.lit("")).when(spoof, spoof_gps).otherwise(gps).alias("gps_text"),
        clock.alias("clock_text"),
        F.when(F.col("event_id") % 53 == 0, 0.4).otherwise(0.95).alias("gps_score"),
        F.lit(0.95).alias("clock_score"),
        F.lit(TRIP_DATE).cast("date").alias("trip_date"),
        F.lit(TIMEZONE).alias("timezone"),
    )


def overrides(spark: SparkSession, folder: str) -> DataFrame:
    """Hand-typed ranges: some trips have a bad one, some a good one."""
    users = table(spark, folder, "events").select(F.col("user_id").alias("trip_id")).distinct()
    def typed(condition, kind, start, end):
        return users.where(condition).select(
            "trip_id", F.lit(kind).alias("kind"), F.lit(float(start)).alias("start_s"),
            F.lit(float(end)).alias("end_s"),
        )

    return typed(F.col("trip_id") % 9 == 0, "bad", 5, 7).unionByName(
        typed(F.col("trip_id") % 10 == 3, "good", 30, 31)
    )


def frame_readings(raw: DataFrame) -> DataFrame:
    """Two frames per reading; every 17th second frame lost its GPS text, some show a wrong speed."""
    frames = raw.select(
        "*", F.explode(F.array(F.lit(0), F.lit(1))).alias("_half")
    )
    lost = (F.col("_half") == 1) & (F.col("seq") % 17 == 0)
    shown = F.when(F.col("seq") % 29 == 7, F.regexp_replace("gps_text", "^[0-9]+ KM", "300 KM")).otherwise(F.col("gps_text"))
    return frames.select(
        "trip_id", (F.col("seq") * 2 + F.col("_half")).alias("seq"),
        (F.col("t") + F.col("_half") * 0.5).alias("t"),
        F.when(lost, F.lit("")).otherwise(shown).alias("gps_text"),
        "clock_text", "gps_score", "clock_score",
    )


def clips(spark: SparkSession, folder: str) -> DataFrame:
    """Camera clips: one per event, of one camera per user."""
    return clips_of(table(spark, folder, "events"))


def clips_of(events: DataFrame) -> DataFrame:
    """Clips of a table or stream of events.

    A name has room for six digits of the number of its recording, so that longer numbers are cut in it; the
    whole number stands beside it.
    """
    start = F.date_trunc("second", F.col("ts").cast("timestamp"))
    event = F.col("event_id")
    parking = (F.col("event_type") == "signup") & (event % 10 == 0)
    name = F.concat(
        F.date_format(start, "yyyyMMddHHmmss"), F.lit("_"), F.lpad(event.cast("string"), 6, "0"),
        F.when(parking, F.lit("P")).otherwise(F.lit("")), F.lit(".MP4"),
    )
    folder_name = F.when(F.col("event_type") == "error", F.lit("RO")).otherwise(F.lit("Movie"))
    return events.select(
        F.col("user_id").alias("camera_id"), event.alias("number"), folder_name.alias("folder"), name.alias("name"),
        F.concat(folder_name, F.lit("/"), name).alias("path"),
        (event % 1000 + 1).alias("size"), start.alias("mtime"),
    )


def encoded_log(spark: SparkSession, folder: str) -> DataFrame:
    """Every fourth clip has been encoded already."""
    return clips(spark, folder).where("number % 4 = 0").select("camera_id", "number", "name", "size")


def road_ways(spark: SparkSession, folder: str) -> DataFrame:
    """One straight northbound way per part, with its node references and tags."""
    key = F.col("p_partkey")
    no_name = key % 13 == 0
    highway = F.element_at(
        F.array(*[F.lit(c) for c in ("trunk", "primary", "residential", "footway")]),
        (F.col("p_size") % 4 + 1).cast("int"),
    )
    name = F.concat(F.lit("Street "), (key % 40).cast("string"))
    ref = F.concat(F.lit("M-"), (key % 10).cast("string"))
    tags = F.map_filter(
        F.create_map(
            F.lit("highway"), highway,
            F.lit("name"), F.when(~no_name, name),
            F.lit("ref"), F.when(no_name, ref),
        ),
        lambda k, v: v.isNotNull(),
    )
    return table(spark, folder, "part").select(
        key.alias("id"), tags.alias("tags"),
        F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: key * 100 + i).alias("nodes"),
    )


def road_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """The way points, and the localities as tagged nodes."""
    ways = table(spark, folder, "part").select(
        F.col("p_partkey").alias("key"), F.explode(F.sequence(F.lit(0), F.lit(20))).alias("i")
    )
    no_tags = F.expr("cast(map() as map<string,string>)")
    points = ways.select(
        (F.col("key") * 100 + F.col("i")).alias("id"),
        ((49_800_000 + F.col("key") * 1000 + F.col("i") * 1000) / 1_000_000).alias("lat"),
        ((24_000_000 + F.col("key") * 100) / 1_000_000).alias("lon"),
        no_tags.alias("tags"),
    )
    key = F.col("s_suppkey")
    place = F.element_at(
        F.array(*[F.lit(p) for p in ("city", "town", "village", "hamlet")]),
        (F.col("s_nationkey") % 4 + 1).cast("int"),
    )
    # Every seventh locality has no population tag.
    population = F.when(key % 7 != 0, F.floor(F.abs("s_acctbal")).cast("string"))
    places = table(spark, folder, "supplier").select(
        (-key - 1).alias("id"),
        ((49_800_000 + key * 10_000) / 1_000_000).alias("lat"),
        ((24_000_000 + (key % 20) * 5000) / 1_000_000).alias("lon"),
        F.map_filter(
            F.create_map(
                F.lit("place"), place, F.lit("name"), F.col("s_name"),
                F.lit("population"), population,
            ),
            lambda k, v: v.isNotNull(),
        ).alias("tags"),
    )
    return points.unionByName(places)


def library_files(spark: SparkSession, folder: str) -> DataFrame:
    """Videos of a library: one per document, with its text as content.

    Real copies among the documents become copies of videos. Some names differ only in case.
    """
    doc, pair = F.col("doc_id"), F.floor(F.col("doc_id") / 2).cast("int")
    day = F.date_format(F.date_add(F.lit(TRIP_DATE).cast("date"), pair % 365), "yyyy-MM-dd")
    name = F.concat(
        day, F.when(doc % 2 == 0, " Trip ").otherwise(" TRIP "),
        F.lpad((pair % 24).cast("string"), 2, "0"), F.lit("-"), F.lpad((pair % 60).cast("string"), 2, "0"),
        F.when(doc % 3 == 0, F.concat(F.lit(" no "), doc.cast("string"))).otherwise(F.lit("")),
        F.when(doc % 5 == 0, ".MOV").otherwise(".mp4"),
    )
    return table(spark, folder, "documents").select(
        doc.alias("doc_id"), name.alias("name"), F.col("text").cast("binary").alias("content"),
        F.octet_length("text").cast("long").alias("size"),
        (F.lit(1_704_067_200) + doc % 1000).cast("double").alias("mtime"),
    )


def library_videos(spark: SparkSession, folder: str) -> DataFrame:
    """Library videos with their content fingerprint."""
    return library_files(spark, folder).select(
        "doc_id", "name", "size", "mtime", text.content_fingerprint(F.col("content")).alias("fingerprint")
    )


def unreadable_tracks(spark: SparkSession, folder: str) -> DataFrame:
    """Track files of some videos that cannot be read."""
    return library_files(spark, folder).where("doc_id % 41 = 0").select(
        text.stem(F.col("name")).alias("stem"), F.lit("invalid JSON").alias("reason")
    )


def library_tracks(spark: SparkSession, folder: str) -> DataFrame:
    """Tracks of most library videos, with all the ways in which they can disagree."""
    doc = F.col("doc_id")
    stem, extension = text.stem(F.col("name")), text.suffix(F.col("name"))
    moved, misnamed, changed = doc % 17 == 0, (doc % 29 == 0) & (doc % 17 != 0), doc % 23 == 0
    videos = library_videos(spark, folder).where("doc_id % 4 <> 1 and doc_id % 41 <> 0")
    declared = F.when(moved, F.concat(stem, F.lit(" old"))).otherwise(stem)
    return videos.select(
        "doc_id",
        F.when(misnamed, F.concat(stem, F.lit(" copy"))).otherwise(declared).alias("file_stem"),
        declared.alias("stem"), F.concat(declared, extension).alias("video_filename"),
        F.when(changed, F.lit("0:changed")).otherwise(F.col("fingerprint")).alias("fingerprint"),
        (F.col("size") + F.when(changed, 1).otherwise(0)).alias("video_size"),
        (F.col("mtime") + F.when(doc % 19 == 0, 5).otherwise(0)).alias("video_mtime"),
        F.when(doc % 37 == 0, "no_overlay").otherwise("ok").alias("extraction_status"),
        F.when(doc % 31 == 0, 0).otherwise(1).alias("extractor_version"),
        F.when(doc % 11 == 0, 1).otherwise(2).alias("cleaning_version"),
    )


def previews(spark: SparkSession, folder: str) -> DataFrame:
    """Previews of some videos, and some of videos long gone."""
    stem = text.stem(F.col("name"))
    kept = F.when(F.col("doc_id") % 13 == 0, F.concat(stem, F.lit(" gone"))).otherwise(stem)
    return library_files(spark, folder).where("doc_id % 3 <> 2").select(
        F.concat(kept, F.lit(".mp4")).alias("name")
    )


def leftovers(spark: SparkSession, folder: str) -> DataFrame:
    """Temporary files left behind, with their age."""
    return table(spark, folder, "documents").where("doc_id % 50 = 7").select(
        F.concat(F.lit("tracks/.tmp-"), F.col("doc_id").cast("string"), F.lit(".partial")).alias("path"),
        (F.col("doc_id") * 20).cast("double").alias("age_s"),
    )


def trip_tracks(spark: SparkSession, folder: str) -> DataFrame:
    """One track per trip of the readings, named by a placeholder; a few have no overlay.

    The trips are stored: a filter on names would be pushed below the distinct and be evaluated for every event.
    """
    users = durable(table(spark, folder, "events").select(F.col("user_id").alias("trip_id")).distinct())
    trip = F.col("trip_id")
    day = F.date_format(F.date_add(F.lit(TRIP_DATE).cast("date"), (trip % 3).cast("int")), "yyyy-MM-dd")
    return users.select(
        "trip_id",
        F.concat(day, F.lit(" Trip "), F.lpad((trip % 24).cast("string"), 2, "0"), F.lit("-"),
                 F.lpad((trip % 60).cast("string"), 2, "0"), F.lit(" "), trip.cast("string"),
                 F.lit(".mp4")).alias("video_filename"),
        F.when(trip % 25 == 24, "no_overlay").otherwise("ok").alias("extraction_status"),
        F.lit(1).alias("cleaning_version"),
    )


def tokens(raw: DataFrame) -> DataFrame:
    """Token detections of one frame per reading, with a weaker reading in the other style, and
    a speed-like token found inside the clock."""
    raw = raw.where("gps_text <> ''")
    part = F.split("gps_text", " ")
    clock = F.split("clock_text", " ")
    trip = F.col("trip_id")

    def suffix_style(i: int) -> Column:
        return F.concat(F.substring(F.get(part, i), 2, 20), F.substring(F.get(part, i), 1, 1))

    def token(kind, value, x, score):
        return F.struct(F.lit(kind).alias("kind"), value.alias("text"), F.lit(x).alias("x"), score.alias("min_score"),
                        (score + 0.01).alias("mean_score"))

    good, weak = F.col("gps_score"), F.lit(0.65)
    # Every fourth trip is read in the suffix style.
    prefix, other = F.when(trip % 4 == 0, weak).otherwise(good), F.when(trip % 4 == 0, good).otherwise(weak)
    found = F.array(
        token("date", F.get(clock, 0), 1000, F.col("clock_score")),
        token("time", F.get(clock, 1), 1216, F.lit(0.9)),
        token("speed", F.concat(F.get(part, 0), F.lit(" KM/H")), 0, good),
        token("speed", F.lit("8 KM/H"), 1010, F.lit(0.99)),
        token("lat-prefix", F.get(part, 2), 200, prefix), token("lon-prefix", F.get(part, 3), 400, prefix),
        token("lat-suffix", suffix_style(2), 218, other), token("lon-suffix", suffix_style(3), 418, other),
    )
    return raw.select("trip_id", F.col("t").alias("frame_t"), F.explode(found).alias("_t")).select(
        "trip_id", "frame_t", "_t.*"
    )


def probe_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Ten probe frames per trip: too narrow videos, missing frames and weak clocks among them."""
    trips = table(spark, folder, "events").select(F.col("user_id").alias("video")).distinct()
    video, frame = F.col("video"), F.col("frame")
    return trips.select("video", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("frame")).select(
        "video", F.when(video % 7 == 0, 1024).otherwise(2560).alias("width"),
        ((video % 3 == 0) & (frame >= 8)).alias("is_missing"), F.lit("2024/01/01 08:00:00").alias("clock_text"),
        F.when(frame < video % 6, 0.9).otherwise(0.3).alias("clock_score"),
    )
