"""Quality of overlay readings: consistency checks and composition from tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from trackloom import constants as C
from trackloom.functions import geo, text
from trackloom.operators import blocks
from trackloom.operators.blocks import Following, Ordering, Previous, by_group, scan


def is_isolated_outlier(before: Column, value: Column, after: Column, tolerance: float) -> Column:
    """A value that disagrees with both neighbors while they agree with each other."""
    return F.coalesce(
        (F.abs(before - after) <= tolerance)
        & (F.abs(value - before) > tolerance) & (F.abs(value - after) > tolerance),
        F.lit(False),
    )


def with_values(frames: DataFrame) -> DataFrame:
    """Frames with parsed GPS, clock and clock offset."""
    df = frames.withColumns({
        "_gps_parts": text.gps_parts(F.col("gps_text")), "_clock_parts": text.clock_parts(F.col("clock_text")),
    })
    df = df.withColumns({
        "gps": text.gps_from_parts(F.col("_gps_parts")),
        "clock": text.clock_from_parts(F.col("_clock_parts")),
    }).drop("_gps_parts", "_clock_parts")
    return df.withColumn("clock_offset_s", F.unix_timestamp("clock") - F.col("t"))


def flagged_readings(frames: DataFrame, ordering: Ordering | None = None, hot=None) -> DataFrame:
    """Readings that look like reading errors, one row per reason. The first and last are not
    judged."""

    def work(df, o):
        near = F.struct("clock_offset_s", "gps", (F.col("gps_text") != "").alias("present"))
        return scan(df, o, _a=Previous(near), _b=Following(near))

    df = by_group(with_values(frames), ordering or blocks.trips(), work, hot)
    df = df.where(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    present = F.col("gps_text") != ""
    clock = F.when(F.col("clock_text") == "", F.lit("clock unreadable")).when(
        is_isolated_outlier(
            F.col("_a.clock_offset_s"), F.col("clock_offset_s"), F.col("_b.clock_offset_s"),
            C.QUALITY_CLOCK_DRIFT_S,
        ),
        F.lit("clock outlier"),
    )
    flicker = (F.col("_a.present") == F.col("_b.present")) & (F.col("_a.present") != present)
    unparseable = present & F.col("gps").isNull()

    def coordinate(name: str) -> Column:
        return F.when(
            ~flicker & ~unparseable & is_isolated_outlier(
                F.col(f"_a.gps.{name}"), F.col(f"gps.{name}"), F.col(f"_b.gps.{name}"),
                C.QUALITY_COORDINATE_STEP_DEG,
            )
            & F.col("_a.gps").isNotNull() & F.col("_b.gps").isNotNull(),
            F.lit(f"{name} outlier"),
        )

    gps = F.when(flicker, F.lit("GPS presence flicker")).when(
        unparseable, F.lit("GPS text unparseable")
    )
    reasons = F.filter(
        F.array(clock, gps, coordinate("lat"), coordinate("lon")), lambda r: r.isNotNull()
    )
    return df.select("trip_id", "seq", "t", F.explode(reasons).alias("reason"))


def speed_mismatches(frames: DataFrame) -> DataFrame:
    """Displayed against implied speed of readings whose clocks are one second apart."""
    read = with_values(frames).where("gps is not null and clock is not null")
    first = read.groupBy("trip_id", "clock").agg(
        F.min_by(F.struct("seq", "t", "gps"), F.struct("t", "seq")).alias("r")
    )
    following = first.select(
        "trip_id", (F.col("clock") - F.expr("INTERVAL 1 SECOND")).alias("clock"), F.col("r").alias("n")
    )
    pairs = first.join(following, ["trip_id", "clock"]).where(
        F.col("r.gps.speed_kmh").isNotNull() & F.col("n.gps.speed_kmh").isNotNull()
    )
    implied = geo.haversine_m(
        F.col("r.gps.lat"), F.col("r.gps.lon"), F.col("n.gps.lat"), F.col("n.gps.lon")
    ) * 3.6
    displayed = (F.col("r.gps.speed_kmh") + F.col("n.gps.speed_kmh")) / 2
    return pairs.withColumn("implied_kmh", implied).where(
        F.abs(F.col("implied_kmh") - displayed) > C.QUALITY_SPEED_MISMATCH_KMH
    ).select("trip_id", F.col("r.seq").alias("seq"), F.col("r.t").alias("t"), "implied_kmh",
             F.col("r.gps.speed_kmh").alias("displayed_kmh"))


def reported_mismatches(mismatches: DataFrame, limit: int = C.QUALITY_MAX_REPORTED) -> DataFrame:
    """The first mismatches of each video, for the report (a top-k)."""
    order = Window.partitionBy("trip_id").orderBy("t", "seq")
    return mismatches.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def quality_report(frames: DataFrame, ordering: Ordering | None = None, hot=None) -> DataFrame:
    """Counts per video: frames, flagged, unreliable, reliable GPS and speed mismatches."""
    gps_ok = text.is_reliable(F.col("gps_text"), F.col("gps_score"))
    clock_ok = text.is_reliable(F.col("clock_text"), F.col("clock_score"))
    base = frames.groupBy("trip_id").agg(
        F.count(F.lit(1)).alias("frames"),
        F.count(F.when(((F.col("gps_text") != "") & ~gps_ok) | ~clock_ok, 1)).alias("unreliable"),
        F.count(F.when(gps_ok, 1)).alias("reliable_gps"),
    )
    flagged = flagged_readings(frames, ordering, hot).groupBy("trip_id").agg(
        F.count(F.lit(1)).alias("flagged")
    )
    mismatches = speed_mismatches(frames).groupBy("trip_id").agg(
        F.count(F.lit(1)).alias("speed_mismatches")
    )
    return base.join(flagged, "trip_id", "left").join(mismatches, "trip_id", "left").select(
        "trip_id", "frames", F.coalesce("flagged", F.lit(0)).alias("flagged"), "unreliable",
        "reliable_gps", F.coalesce("speed_mismatches", F.lit(0)).alias("speed_mismatches"),
    )


# --- tokens ----------------------------------------------------------------------------------------


def choose_tokens(tokens: DataFrame) -> DataFrame:
    """The best token of every kind per frame, without GPS tokens that overlap date or time.

    ``tokens``: ``trip_id, frame_t, kind, text, x, min_score, mean_score`` with the kinds date,
    time, speed, lat-prefix, lon-prefix, lat-suffix, lon-suffix. Coordinates are taken in the
    style with more tokens, then the larger sum of mean scores (prefix on a tie).
    """
    # As text, because Spark normalizes a fractional key in every step anew, and shuffles it again.
    tokens = tokens.withColumn("_frame", (F.col("frame_t") + F.lit(0.0)).cast("string"))
    frame = ["trip_id", "_frame"]
    token = F.struct("text", "x", "min_score", "mean_score")
    order = F.struct("mean_score", "min_score", -F.col("x"))

    def best(kind: str) -> Column:
        return F.max_by(token, F.when(F.col("kind") == kind, order))

    # One shuffle and one sort by frame serve this window and the grouping below.
    whole = Window.partitionBy(*frame)
    joined = tokens.withColumns({kind: best(kind).over(whole) for kind in ("date", "time")})

    def covered(name: str) -> Column:
        start = F.col(f"{name}.x") - (C.CELL_WIDTH_PX - 1)
        end = F.col(f"{name}.x") + F.length(F.col(f"{name}.text")) * C.CELL_PITCH_PX
        return F.coalesce((F.col("x") >= start) & (F.col("x") < end), F.lit(False))

    usable = joined.where(
        F.col("kind").isin("date", "time") | (~covered("date") & ~covered("time"))
    )
    kinds = ("date", "time", "speed", "lat-prefix", "lon-prefix", "lat-suffix", "lon-suffix")
    wide = usable.groupBy(*frame).agg(
        F.max("frame_t").alias("frame_t"), *[best(kind).alias(kind) for kind in kinds]
    )

    def style_rank(style: str) -> Column:
        parts = [F.col(f"`{c}-{style}`") for c in ("lat", "lon")]
        found = sum((F.when(p.isNotNull(), 1).otherwise(0) for p in parts), F.lit(0))
        score = sum((F.coalesce(p["mean_score"], F.lit(0.0)) for p in parts), F.lit(0.0))
        return F.struct(found.alias("n"), score.alias("s"))

    wide = wide.withColumn("_prefix", style_rank("prefix") >= style_rank("suffix"))
    return wide.select("trip_id", "frame_t", "date", "time", "speed", *[
        F.when(F.col("_prefix"), F.col(f"`{c}-prefix`")).otherwise(F.col(f"`{c}-suffix`")).alias(c)
        for c in ("lat", "lon")
    ])


def compose_readings(tokens: DataFrame) -> DataFrame:
    """Frame readings from token detections: GPS and clock text with their lowest scores."""
    chosen = choose_tokens(tokens)
    speed = F.concat(F.trim(F.regexp_replace(F.col("speed.text"), "KM/H", "")), F.lit(" KM/H"))
    gps = F.concat_ws(" ", speed, *[
        text.normalize_coordinate(F.col(f"{c}.text")) for c in ("lat", "lon")
    ])
    clock = F.concat_ws(" ", F.col("date.text"), F.col("time.text"))

    def lowest(*names: str) -> Column:
        return F.coalesce(
            F.array_min(F.array(*[F.col(f"{n}.min_score") for n in names])), F.lit(-1.0)
        )

    return chosen.select(
        "trip_id", F.col("frame_t").alias("t"), gps.alias("gps_text"), clock.alias("clock_text"),
        lowest("speed", "lat", "lon").alias("gps_score"), lowest("date", "time").alias("clock_score"),
    )
