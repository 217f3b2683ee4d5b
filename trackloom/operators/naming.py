"""Suggested trip names from the streets driven."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trackloom import constants as C
from trackloom.functions import names, text
from trackloom.operators import blocks
from trackloom.operators.blocks import Ordering, Previous, RunningSum, by_group, scan
from trackloom.operators.digests import changes
from trackloom.session import durable

# Digits of collision numbers that names are fitted for, unless a plan counts more names.
SUFFIX_DIGITS = 6
# A name that more trips want is numbered in blocks of trips.
MAX_LANE_TRIPS = 20_000


def merge_repeats(labels: DataFrame, hot=None) -> DataFrame:
    """Join consecutive stretches ``(trip_id, pos, label, distance_m)`` with the same label."""
    by_pos = Ordering(("trip_id",), ("pos",), "pos", 50_000)

    def work(df, o):
        df = scan(df, o, _before=Previous(F.col("label")))
        same = F.col("_before").eqNullSafe(F.col("label"))
        df = df.withColumn("_starts", F.when(same, 0).otherwise(1))
        return scan(df, o, _n=RunningSum(F.col("_starts")))

    return by_group(labels, by_pos, work, hot).groupBy("trip_id", "_n", "label").agg(
        F.sum("distance_m").alias("distance_m")
    ).select("trip_id", F.col("_n").alias("pos"), "label", "distance_m")


def label_streets(streets: DataFrame) -> DataFrame:
    """Labels of the street entries of trips; entries without a label are left out."""
    label = names.street_label(*(F.col(c) for c in ("name", "name_en", "ref", "highway")))
    return streets.select(
        "trip_id", "pos", label.alias("label"),
        F.coalesce(F.col("distance_m").cast("double"), F.lit(0.0)).alias("distance_m"),
    ).where("label is not null")


def named_stretches(streets: DataFrame, hot=None) -> DataFrame:
    """The stretches a trip is named after: merged, long enough, merged again."""
    merged = merge_repeats(durable(label_streets(streets)), hot)
    # A stretch list is tiny beside the samples; writing it keeps the plans of later steps small.
    return durable(merge_repeats(merged.where(F.col("distance_m") >= C.MIN_NAMED_STRETCH_M), hot))


def _suffix_length(digits: int) -> int:
    return digits + len(" ()") if digits else 0


def candidate_names(
    trips: DataFrame, stretches: DataFrame, car_model: str = "", max_digits: int = SUFFIX_DIGITS
) -> DataFrame:
    """The name text of each trip for every length of the collision number.

    ``trips`` has ``trip_id, filename, start_time`` (and ``timezone``). Element 0 of ``texts``
    is for the name without a number.
    """
    lists = stretches.groupBy("trip_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("pos", "label", "distance_m"))),
            lambda s: F.struct(s["label"].alias("label"), s["distance_m"].alias("distance_m")),
        ).alias("_stretches")
    )
    df = trips.join(lists, "trip_id", "left")
    df = df.withColumns({
        "date": text.trip_date(F.col("filename")),
        "extension": text.suffix(F.col("filename")),
        "own_stem": text.stem(F.col("filename")),
        "car": F.lit(_clean_car_model(car_model)),
    })
    fallback = F.date_format(
        F.from_utc_timestamp("start_time", F.col("timezone")), "'Trip' HH-mm"
    )
    car_length = F.when(F.col("car") == "", 0).otherwise(F.length("car") + 3)

    # One expression for all lengths: the room left beside date, suffixes and extension.
    fixed = F.lit(len("2024-01-01 ")) + car_length + F.length("extension")
    rooms = F.transform(
        F.array(*[F.lit(_suffix_length(d)) for d in range(max_digits + 1)]),
        lambda suffix: F.lit(C.MAX_FILENAME_LENGTH) - fixed - suffix,
    )
    fitted = F.transform("_rooms", lambda room: names.fit_street_labels(F.col("_stretches"), room))
    return df.withColumns({"_rooms": rooms, "_fallback": fallback}).withColumn(
        "texts",
        F.when(F.col("_stretches").isNotNull(), fitted).otherwise(
            F.transform("_rooms", lambda room: F.col("_fallback"))
        ),
    ).drop("_stretches", "_rooms", "_fallback")


def _clean_car_model(model: str) -> str:
    """Car model as ASCII text that is allowed in file names."""
    import unicodedata

    ascii_text = unicodedata.normalize("NFKD", model).encode("ascii", "ignore").decode("ascii")
    return " ".join(re.sub(C.FORBIDDEN_FILENAME_REGEX, " ", ascii_text).split())


def assemble_name(date: Column, body: Column, number: Column, car: Column, extension: Column) -> Column:
    """``<date> <streets>[ (<n>)][ (<car>)]<extension>``."""
    def in_brackets(value: Column, given: Column) -> Column:
        return F.when(given, F.concat(F.lit(" ("), value.cast("string"), F.lit(")"))).otherwise(F.lit(""))

    return F.concat(
        F.date_format(date, "yyyy-MM-dd"), F.lit(" "), body,
        in_brackets(number, number > 0), in_brackets(car, car != ""), extension,
    )


def _lanes(candidates: DataFrame, digits: int, car: str) -> DataFrame:
    """Add the lane of each trip for collision numbers of so many digits, and its own number in it.

    A lane is all that the names of one date, text and car share; trips of other street lists are in the
    same lane if their texts, fitted for these digits, are the same. ``_own`` is the number a trip has now.
    """
    prefix = F.lower(F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit(" "), F.col("texts")[digits]))
    number = _numbers(F.lower("own_stem"), car, digits)
    return candidates.withColumn("_lane", prefix).withColumn(
        "_own", F.when(number["prefix"] == F.col("_lane"), number["number"])
    )


def _numbers(stem: Column, car: str, digits: int) -> Column:
    """``(prefix, number)`` of a lowercase name, null where it has no number of so many digits."""
    tail = f" ({car.lower()})" if car else ""
    body = F.when(stem.endswith(tail), F.substring(stem, F.lit(1), F.length(stem) - len(tail)))
    if digits == 0:
        return F.when(body.isNotNull(), F.struct(body.alias("prefix"), F.lit(0).cast("long").alias("number")))
    pattern = r"^([\s\S]*) \(([1-9][0-9]{%d})\)$" % (digits - 1)
    return F.when(body.rlike(pattern), F.struct(
        F.regexp_extract(body, pattern, 1).alias("prefix"), F.regexp_extract(body, pattern, 2).cast("long").alias("number")
    ))


def _count_used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add how many free numbers are gone at each trip of a lane, null where the trip keeps its own.

    Rows ``(lane, trip, below)`` come by lane and trip order; ``below`` is the number of free numbers
    below a trip's own. A count per lane is all that is kept from row to row.
    """
    used, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = changes([batch.column(0)])
        new[0] = batch.column(0)[0] != last
        last, gone = batch.column(0)[-1], []
        for starts, below in zip(new, batch.column(2).to_pylist()):
            used = 0 if starts else used
            keeps = below is not None and used >= below
            gone.append(None if keeps else used)
            used += not keeps
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(gone, pa.int64())], ["trip_id", "_gone"])


def _fill_lanes(
    waiting: DataFrame, taken: DataFrame, digits: int, car: str, blocked: DataFrame | None, most_trips: int
) -> DataFrame:
    """Give the free numbers of each lane to its trips in trip order.

    Adds ``number``, null where a lane has no free number of so many digits left. Trips are ranked and
    met with the free numbers by scans, so a lane of any size is spread over tasks.
    """
    first, size = (10 ** (digits - 1), 9 * 10 ** (digits - 1)) if digits else (0, 1)
    trips = durable(_lanes(waiting, digits, car))
    used = taken.select(_numbers(F.col("stem"), car, digits).alias("_n")).where("_n is not null").select(
        F.col("_n.prefix").alias("_lane"), F.col("_n.number").alias("_own")
    )
    if blocked is not None:
        used = used.union(blocked.where(F.col("digits") == digits).select("_lane", "_own"))
    used = used.distinct().join(trips.select("_lane").distinct(), "_lane", "left_semi")
    hot = blocks.find_hot_keys(trips.select("_lane").unionAll(used.select("_lane")), ("_lane",), most_trips)
    # free numbers below each used one
    by_number = Ordering(("_lane",), ("_own",), "_own", 50_000)
    used = durable(by_group(used, by_number, lambda df, o: scan(df, o, _rank=RunningSum(F.lit(1))), hot).select(
        "_lane", "_own", (F.col("_own") - first - F.col("_rank") + 1).alias("_below")
    ))
    # trips without a number of their own have nothing to find: their keys are spread
    spread = -1 - F.pmod(F.xxhash64("trip_id"), F.lit(1024))
    trips = trips.withColumn("_key", F.coalesce("_own", spread)).join(
        used.select("_lane", F.col("_own").alias("_key"), "_below"), ["_lane", "_key"], "left"
    ).drop("_key")
    by_trip = Ordering(("_lane",), ("start_time", "filename"), "unix_seconds(start_time)", 1)

    def others_before(df, o):
        # those that surely need a free number; one that has its own keeps it once no free one is below
        df = scan(df, o, _gone=RunningSum(F.when(F.col("_below").isNull(), 1).otherwise(0)))
        return df.withColumn("_gone", F.when(F.col("_below").isNull(), F.col("_gone") - 1).otherwise(F.col("_gone")))

    trips = durable(by_group(trips, by_trip, others_before, hot))
    open_lanes = trips.where(F.col("_below") > F.col("_gone")).select("_lane").distinct()
    trip_type = dict(trips.dtypes)["trip_id"]
    # only where a free number lies below a trip's own does its choice change what later trips find
    counted = trips.join(open_lanes, "_lane", "left_semi").repartition("_lane").sortWithinPartitions(
        "_lane", "start_time", "filename"
    ).select("_lane", "trip_id", F.col("_below").cast("long")).mapInArrow(_count_used, f"trip_id {trip_type}, _gone long")
    counted = counted.withColumn("_counted", F.lit(True)).withColumnRenamed("_gone", "_exact")
    gone = F.when(F.col("_counted"), F.col("_exact")).when(F.col("_below").isNull(), F.col("_gone"))
    room = used.groupBy("_lane").agg(F.count(F.lit(1)).alias("_full"))
    trips = trips.join(counted, "trip_id", "left").join(room, "_lane", "left").withColumn("_gone", gone)
    keeps, fits = F.col("_gone").isNull(), F.col("_gone") < size - F.coalesce("_full", F.lit(0))
    takers = trips.where(~keeps & fits).select("_lane", F.col("_gone").alias("_place"), F.lit(1).alias("_kind"), "trip_id")
    steps = used.select("_lane", F.col("_below").alias("_place"), F.lit(0).alias("_kind"), F.lit(None).cast(trip_type).alias("trip_id"))
    by_place = Ordering(("_lane",), ("_place", "_kind"), "_place", 50_000)
    met = by_group(
        takers.unionByName(steps), by_place,
        lambda df, o: scan(df, o, _skipped=RunningSum(F.lit(1) - F.col("_kind"))), hot,
    ).where("_kind = 1").select("trip_id", (F.col("_place") + F.col("_skipped") + first).alias("_given"))
    trips = trips.join(met, "trip_id", "left")
    return trips.withColumn("number", F.when(keeps, F.col("_own")).otherwise(F.col("_given")))


def number_collisions(candidates: DataFrame, taken: DataFrame, most_trips: int = MAX_LANE_TRIPS) -> DataFrame:
    """Names without collisions: ``trip_id, filename, new_filename``, unchanged names left out.

    ``taken(stem)`` are the lowercase names in use; the car is the same for all. In trip order, every trip takes its first name that
    nobody has, or its own. Numbers of equally many digits are given to all trips at once, lane by lane:
    first all trips without a number, then with one digit those that found no name, and so on. So there
    are as many rounds as digits, and no group of names is walked as a whole.

    A street may itself end in a number in brackets; two trips can then want one name by different
    numbers. The first such claim of a date that comes too late is taken back and the round repeated.
    """
    columns = ["trip_id", "filename", "date", "start_time", "texts", "extension", "own_stem", "car"]
    candidates = durable(candidates.select(*columns))
    taken = durable(taken.select("stem").distinct())
    most, car = candidates.select(F.max(F.size("texts")), F.max("car")).first()
    most, car = most or 1, car or ""
    blocked = None
    while True:
        waiting, given = candidates, []
        for digits in range(most):
            filled = durable(_fill_lanes(waiting, taken, digits, car, blocked, most_trips).withColumn("digits", F.lit(digits)))
            given.append(filled.where(F.col("number").isNotNull()))
            waiting = filled.where(F.col("number").isNull()).select(*columns)
            if waiting.isEmpty():
                break
        named = functools.reduce(DataFrame.unionByName, given).withColumn("_stem", assemble_name(
            F.col("date"), F.col("texts")[F.col("digits")], F.col("number"), F.col("car"), F.lit("")
        ))
        order = F.struct("start_time", "filename")
        claims = named.select("date", "_lane", "digits", F.col("number").alias("_own"), order.alias("_order"), F.lower("_stem").alias("_claim"))
        clashes = claims.groupBy("_claim").agg(F.min("_order").alias("_winner"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
        late = claims.join(clashes, "_claim").where(F.col("_order") != F.col("_winner"))
        first = late.groupBy("date").agg(F.min_by(F.struct("_lane", "_own", "digits"), "_order").alias("_late")).select("_late.*")
        first = durable(first)
        if first.isEmpty():
            break
        blocked = first if blocked is None else durable(blocked.unionByName(first))
    names = named.select("trip_id", "filename", F.concat("_stem", "extension").alias("new_filename"))
    return names.where(F.col("new_filename") != F.col("filename"))


def is_rename_target(filename: Column, include_all: bool = False) -> Column:
    """Whether a trip still has a placeholder name, or all trips are renamed."""
    return F.lit(include_all) | text.trip_name(filename).rlike(C.PLACEHOLDER_NAME_REGEX)


def has_usable_street_list(status: Column, has_located: Column, enrichment_status: Column) -> Column:
    """Whether a track can be named: streets are current, or it has no positions at all."""
    return (status != C.EXTRACTION_OK) | ~has_located | (enrichment_status == "current")


def taken_stems(videos: DataFrame, tracks: DataFrame) -> DataFrame:
    """Lowercase names used by videos ``(name)`` and tracks ``(stem)``."""
    return videos.select(F.lower(text.stem(F.col("name"))).alias("stem")).union(
        tracks.select(F.lower("stem"))
    ).distinct()


def plan_renames(
    trips: DataFrame, streets: DataFrame, taken: DataFrame, car_model: str = "",
    include_all: bool = False, hot=None,
) -> DataFrame:
    """Suggested new names of the trips.

    ``trips``: ``trip_id, filename, start_time, timezone, extraction_status, has_located,
    enrichment_status``. Undated trips, other targets and outdated street lists are skipped.
    """
    targets = trips.where(
        text.trip_date(F.col("filename")).isNotNull()
        & is_rename_target(F.col("filename"), include_all)
        & has_usable_street_list(
            F.col("extraction_status"), F.col("has_located"), F.col("enrichment_status")
        )
    )
    hot = hot or blocks.find_hot_keys(streets, ("trip_id",))
    stretches = named_stretches(streets.join(targets.select("trip_id"), "trip_id", "left_semi"), hot)
    # no number can be larger than the count of names that there are
    digits = len(str(targets.count() + taken.count() + 1))
    candidates = candidate_names(targets, stretches, car_model, max(digits, 1))
    # Without streets and any time a trip keeps its name.
    return number_collisions(durable(candidates.where(F.col("texts")[0].isNotNull())), taken)
