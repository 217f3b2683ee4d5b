"""Findings about a library: one query per rule, all with the same columns.

Tables: ``tracks`` has ``file_stem, stem`` (declared), ``video_filename, fingerprint, video_size,
video_mtime, extraction_status, extractor_version, cleaning_version``, the ``enrichment_status`` that
``roads.enrichment_status`` finds, and the flags of ``with_fixes``; ``videos`` has ``name, size, mtime, fingerprint``; ``unreadable``
has ``stem, reason``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from trackloom import constants as C
from trackloom.functions import text
from trackloom.operators import library

ERROR, WARNING, INFO = "error", "warning", "info"


def _finding(df: DataFrame, rule: str, severity: str | Column, subject, detail, fix=None) -> DataFrame:
    def column(value):
        return value if isinstance(value, Column) else F.lit(value).cast("string")

    return df.select(
        F.lit(rule).alias("rule"), column(severity).alias("severity"), column(subject).alias("subject"),
        column(detail).alias("detail"), column(fix).alias("fix"),
    )


def with_fixes(tracks: DataFrame, samples: DataFrame) -> DataFrame:
    """Add whether the samples of each track (by ``trip_id``) have any GPS text, and any accepted fix.

    One map-side combined pass over two columns of the samples.
    """
    flags = samples.groupBy("trip_id").agg(
        F.max(F.coalesce(F.col("gps_text") != "", F.lit(False))).alias("has_gps_text"),
        F.max(F.col("status") == C.OK).alias("has_good_fix"),
    )
    return tracks.join(flags, "trip_id", "left").withColumns({
        name: F.coalesce(name, F.lit(False)) for name in ("has_gps_text", "has_good_fix")
    })


def check_tracks(tracks: DataFrame, unreadable: DataFrame, has_map: bool = True) -> dict[str, DataFrame]:
    """Format, names, versions, street lists and suspicious results of the tracks."""
    stem, extracted = F.col("file_stem"), F.col("extraction_status") == C.EXTRACTION_OK
    old_extractor = F.col("extractor_version") < C.EXTRACTOR_VERSION
    names = tracks.select(F.col("file_stem").alias("_target")).distinct().withColumn("_taken", F.lit(True))
    misnamed = tracks.where(F.col("file_stem") != F.col("stem")).join(
        names, F.col("stem") == F.col("_target"), "left"
    )
    rename = F.when(F.col("_taken").isNull(), F.concat(F.lit("rename to "), "stem", F.lit(".json")))
    rules = {
        "R1": _finding(unreadable, "R1", ERROR, F.col("stem"), F.col("reason")),
        "R2": _finding(misnamed, "R2", ERROR, stem, F.col("video_filename"), rename),
        "R3": _finding(tracks.where(old_extractor), "R3", INFO, stem, "older extractor"),
        "R4": _finding(
            tracks.where(~old_extractor & extracted & (F.col("cleaning_version") < C.CLEANING_VERSION)),
            "R4", INFO, stem, "older cleaning",
        ),
        "R6": _finding(
            tracks.where(F.col("has_gps_text") & ~F.col("has_good_fix")),
            "R6", WARNING, stem, "GPS text but no accepted fix",
        ),
        "R7": _finding(
            library.same_content(tracks, "file_stem"), "R7", WARNING, F.col("name"),
            F.concat(F.lit("shares content "), "fingerprint"),
        ),
    }
    if has_map:
        outdated = tracks.where(extracted & (F.col("enrichment_status") != "current"))
        detail = F.when(F.col("enrichment_status") == "missing", "no street list").otherwise(
            "outdated street list"
        )
        rules["R5"] = _finding(outdated, "R5", INFO, stem, detail)
    return rules


def check_videos(tracks: DataFrame, unreadable: DataFrame, videos: DataFrame) -> dict[str, DataFrame]:
    """Match videos and tracks: missing tracks, renames, changed content, unreachable videos."""
    shared = library.shared_names(videos)
    named = library.with_stems(videos)
    in_conflict = named.join(
        shared.select(F.col("key").alias("_key")).distinct(), F.lower("stem") == F.col("_key"), "left_semi"
    ).select("stem").distinct()
    checked = named.join(in_conflict, "stem", "left_anti").withColumn(
        "_too_long", text.filename_length_problem(F.col("name"))
    )
    usable = checked.where("_too_long is null").join(unreadable.select("stem"), "stem", "left_anti")
    own = tracks.select(
        F.col("file_stem").alias("stem"), "video_size", "video_mtime", F.col("fingerprint").alias("_print")
    )
    differs = (F.col("size") != F.col("video_size")) | (F.col("mtime") != F.col("video_mtime"))
    changed = usable.join(own, "stem").where(differs & (F.col("fingerprint") != F.col("_print")))

    # Videos without a track of their own name, and not declared by a misnamed track file.
    alone = usable.join(own.select("stem"), "stem", "left_anti").join(
        tracks.select("stem").distinct(), "stem", "left_anti"
    )
    orphans = tracks.join(named.select("stem").distinct(), "stem", "left_anti").select(
        F.col("file_stem").alias("_orphan")
    )
    by_content = tracks.groupBy("fingerprint").agg(F.max("file_stem").alias("old_stem"))
    known = alone.join(by_content, "fingerprint", "left").join(
        orphans.withColumn("_is_orphan", F.lit(True)), F.col("old_stem") == F.col("_orphan"), "left"
    )
    renamed = known.where(F.col("_is_orphan"))
    copied = known.where(F.col("old_stem").isNotNull() & F.col("_is_orphan").isNull())
    unreachable = orphans.join(
        renamed.select(F.col("old_stem").alias("_orphan")), "_orphan", "left_anti"
    )
    return {
        "R8": _finding(shared, "R8", ERROR, F.col("name"), "would share a track with another video"),
        "R9": _finding(checked.where("_too_long is not null"), "R9", ERROR, F.col("name"), F.col("_too_long")),
        "R10": _finding(changed, "R10", WARNING, F.col("name"), "changed since extraction"),
        "R11": _finding(
            renamed, "R11", WARNING, F.col("name"), F.col("old_stem"), "rename its track and preview"
        ),
        "R12": _finding(copied, "R12", WARNING, F.col("name"), F.col("old_stem")),
        "R13": _finding(known.where("old_stem is null"), "R13", INFO, F.col("name"), "no track"),
        "R14": _finding(unreachable, "R14", INFO, F.col("_orphan"), "unreachable"),
    }


def index_differences(current: DataFrame, expected: DataFrame) -> DataFrame:
    """Entries that are missing from an index, or no longer expected in it."""
    columns = [c for c in expected.columns if c in current.columns]
    def hashed(df):
        return df.select("id", F.xxhash64(F.to_json(F.struct(*columns))).alias("_hash"))

    now, wanted = hashed(current), hashed(expected)
    return wanted.join(now, ["id", "_hash"], "left_anti").select("id", F.lit("missing").alias("problem")).unionByName(
        now.join(wanted, ["id", "_hash"], "left_anti").select("id", F.lit("outdated").alias("problem"))
    )


def check_files(
    tracks: DataFrame, previews: DataFrame, leftovers: DataFrame,
    index: DataFrame | None = None, expected_index: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Index, previews ``(name)`` without a track, and leftover files ``(path, age_s)``."""
    orphans = previews.where(~F.col("name").startswith(".")).join(
        tracks.select("file_stem"), text.stem(F.col("name")) == F.col("file_stem"), "left_anti"
    )
    is_old = F.col("age_s") >= C.MIN_LEFTOVER_AGE_S
    rules = {
        "R16": _finding(orphans, "R16", WARNING, F.col("name"), "preview without a track", "delete it").unionByName(
            _finding(
                leftovers, "R16", F.when(is_old, WARNING).otherwise(INFO), F.col("path"),
                F.when(is_old, "leftover file").otherwise("recent temporary file"),
                F.when(is_old, "delete it"),
            )
        )
    }
    if expected_index is not None:
        spark = tracks.sparkSession
        if index is None:
            stale = spark.range(1)
        else:
            differences = index_differences(index, expected_index).agg(F.count(F.lit(1)).alias("n"))
            stale = differences.where("n > 0")
        rules["R15"] = _finding(
            stale, "R15", WARNING, "trip index", "missing or out of date", "rebuild it"
        )
    return rules


def audit(rules: dict[str, DataFrame]) -> DataFrame:
    """All findings in one table."""
    return reduce(DataFrame.unionByName, (rules[name] for name in sorted(rules)))
