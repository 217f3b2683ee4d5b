"""Structured Streaming over arriving clips and readings, agreeing with the batch operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trackloom import constants as C
from trackloom.operators import cleaning, library
from trackloom.operators.blocks import Ordering, RunningMax, RunningSum, by_group, scan
from trackloom.session import durable

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Folders of a log of seen clips.
LOG_BUCKETS = 64
# Dates of closed trips that a batch names one by one; more are read as a range.
MAX_DATES = 2000


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Keep state in RocksDB while the streams inside run; the session's own store comes back afterwards."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


# --- trips of arriving clips ---------------------------------------------------------------------------


@dataclass
class Session:
    """Clips of one camera without a longer gap between them. Times are microseconds."""

    number: int | None
    revision: int
    clips: int
    start: int
    first_idx: int
    last: int
    last_idx: int
    is_open: bool = False
    changed: bool = False

    def absorb(self, other: Session) -> None:
        self.start, self.first_idx = min((self.start, self.first_idx), (other.start, other.first_idx))
        self.last, self.last_idx = max((self.last, self.last_idx), (other.last, other.last_idx))
        self.clips, self.changed = self.clips + other.clips, True


class LiveTrips(StatefulProcessor):
    """Sessions of each camera, corrected whenever a clip arrives, however late.

    A clip opens a session, extends one, or joins two. Every session that changes is written again with
    a higher revision; one that was joined to another is written with no clips. The newest session of a
    camera is open; it closes when a newer one begins, or when nothing has arrived for the gap.

    The state holds the sessions of the last days of a camera's own time. A clip older than those makes
    a session of its own, which ``settled_trips`` joins with what was written before: nothing is dropped.
    """

    def __init__(self, gap_us: int, keep_us: int, closes_idle: bool) -> None:
        self.gap_us, self.keep_us, self.closes_idle = gap_us, keep_us, closes_idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sessions = handle.getListState(
            "sessions", "number bigint, revision bigint, clips bigint, start bigint, first_idx bigint, last bigint, last_idx bigint, is_open boolean"
        )
        self.next = handle.getValueState("next", "number bigint, timer bigint")

    def runs(self, rows: Iterator[pd.DataFrame]) -> Iterator[Session]:
        """Clips of a batch as sessions of their own, a part of the batch at a time."""
        for part in rows:
            part = part.sort_values(["start_us", "idx"])
            start, idx = part["start_us"].to_numpy(), part["idx"].to_numpy()
            begins = np.flatnonzero(np.diff(start, prepend=start[0] - self.gap_us - 1) > self.gap_us)
            for a, b in zip(begins, [*begins[1:], len(start)]):
                yield Session(None, 0, int(b - a), int(start[a]), int(idx[a]), int(start[b - 1]), int(idx[b - 1]), False, True)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = [Session(*row) for row in self.sessions.get()]
        number, timer = self.next.get() if self.next.exists() else (0, None)
        merged: list[Session] = []
        gone: list[Session] = []
        for session in sorted([*known, *self.runs(rows)], key=lambda s: (s.start, s.first_idx)):
            if merged and session.start - merged[-1].last <= self.gap_us:
                head = merged[-1]
                if head.number is None:
                    head.number, head.revision = session.number, session.revision
                elif session.number is not None:
                    gone.append(Session(session.number, session.revision + 1, 0, 0, 0, 0, 0))
                head.absorb(session)
            else:
                merged.append(session)
        newest = max(merged, key=lambda s: s.last)
        for session in merged:
            if session.number is None:
                session.number, number = number, number + 1
            is_open = session is newest and (session.changed or session.is_open)
            session.changed |= session.is_open != is_open
            session.is_open = is_open
            session.revision += session.changed
        kept = [s for s in merged if s.last >= newest.last - self.keep_us]
        self.sessions.put([(s.number, s.revision, s.clips, s.start, s.first_idx, s.last, s.last_idx, s.is_open) for s in kept])
        if timer is not None:
            self.handle.deleteTimer(timer)
        if self.closes_idle:
            timer = int(timerValues.getCurrentProcessingTimeInMs() + self.gap_us // 1000)
            self.handle.registerTimer(timer)
        self.next.update((number, timer))
        yield self.rows(key, [*gone, *(s for s in merged if s.changed)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        sessions = [Session(*row) for row in self.sessions.get()]
        ended = [s for s in sessions if s.is_open]
        for session in ended:
            session.is_open, session.revision = False, session.revision + 1
        self.sessions.put([(s.number, s.revision, s.clips, s.start, s.first_idx, s.last, s.last_idx, s.is_open) for s in sessions])
        yield self.rows(key, ended)

    def rows(self, key, sessions: list[Session]) -> pd.DataFrame:
        columns = ["number", "revision", "clips", "start", "first_idx", "last", "last_idx", "is_open"]
        out = pd.DataFrame([[getattr(s, c) for c in columns] for s in sessions], columns=columns)
        out.insert(0, "camera_id", key[0])
        return out

    def close(self) -> None:
        pass


def live_trips(
    clips: DataFrame, gap_hours: float = C.TRIP_GAP_HOURS, keep_days: float = 7, closes_idle: bool = False
) -> DataFrame:
    """Trips of arriving clips ``(camera_id, start_time, idx)``, as revisions of sessions.

    Clips exactly the gap apart stay in one trip, as in the batch grouping. Needs the RocksDB state
    store and the update output mode. ``settled_trips`` makes the trips of what was written.
    ``closes_idle`` sets timers that close the open trip of a camera from which nothing has come for the
    gap; a stream with timers runs until it is stopped, so a catch-up run has none.
    """
    kinds = dict(clips.dtypes)
    rows = clips.select("camera_id", F.unix_micros("start_time").alias("start_us"), F.col("idx").cast("long").alias("idx"))
    out = rows.groupBy("camera_id").transformWithStateInPandas(
        statefulProcessor=LiveTrips(round(gap_hours * 3600e6), round(keep_days * 86400e6), closes_idle),
        outputStructType=f"camera_id {kinds['camera_id']}, number bigint, revision bigint, clips bigint, start bigint, "
        "first_idx bigint, last bigint, last_idx bigint, is_open boolean",
        outputMode="Update", timeMode="ProcessingTime" if closes_idle else "None",
    )
    return out.select(
        "camera_id", "number", "revision", "clips", F.timestamp_micros("start").alias("start_time"),
        F.timestamp_micros("last").alias("last_start"), "first_idx", "last_idx", "is_open",
    )


def settled_trips(revisions: DataFrame, gap_hours: float = C.TRIP_GAP_HOURS, hot=None) -> DataFrame:
    """Trips as they stand after all revisions written so far, open ones marked.

    Only the last revision of a session counts. Sessions of clips that came after their neighbours had
    left the state are joined with those here.
    """
    values = ("clips", "start_time", "last_start", "first_idx", "last_idx", "is_open")
    last = revisions.groupBy("camera_id", "number").agg(F.max_by(F.struct(*values), "revision").alias("_s"))
    sessions = last.select("camera_id", "number", "_s.*").where("clips > 0")
    order = Ordering(("camera_id",), ("start_time", "number"), "unix_micros(start_time) / 86400000000", 1.0)
    gap_us = round(gap_hours * 3600e6)

    def work(df, o):
        df = scan(df, o, _reach=RunningMax(F.unix_micros("last_start")))
        apart = F.unix_micros("start_time") - F.col("_reach") > gap_us
        df = df.withColumn("_starts", F.when(F.col("_reach").isNull() | apart, 1).otherwise(0))
        return scan(df, o, trip_seq=RunningSum(F.col("_starts")))

    return by_group(sessions, order, work, hot).groupBy("camera_id", "trip_seq").agg(
        F.sum("clips").alias("clips"), F.min("start_time").alias("start_time"), F.max("last_start").alias("last_start"),
        F.min_by("first_idx", F.struct("start_time", "first_idx")).alias("first_idx"),
        F.max_by("last_idx", F.struct("last_start", "last_idx")).alias("last_idx"), F.max("is_open").alias("is_open"),
    )


# --- clips seen before ---------------------------------------------------------------------------------


def drop_seen(clips: DataFrame, late: str = "1 hour") -> DataFrame:
    """Drop clips whose name and size have been seen within the watermark."""
    return clips.withWatermark("start_time", late).dropDuplicatesWithinWatermark(
        ["camera_id", "name", "size"]
    )


def _bucket() -> Column:
    return F.pmod(F.xxhash64("name"), F.lit(LOG_BUCKETS)).cast("int").alias("bucket")


LOG_SCHEMA = "camera_id bigint, name string, size bigint, bucket int, batch bigint"


def append_log(clips: DataFrame, log_path: str, batch: int = -1) -> None:
    """Log clips ``(camera_id, name, size)`` by hash of their name; a batch that is repeated replaces itself."""
    rows = clips.select("camera_id", "name", "size", _bucket(), F.lit(batch).cast("bigint").alias("batch"))
    # a bucket is written by one task, so a batch adds one file to it at most
    rows.repartition("bucket").write.partitionBy("bucket", "batch").option(
        "partitionOverwriteMode", "dynamic"
    ).mode("overwrite").parquet(log_path)


def read_log(spark: SparkSession, log_path: str, buckets: list[int] | None = None) -> DataFrame:
    """Logged clips, of some buckets only: no other folder is listed or read."""
    log = spark.read.schema(LOG_SCHEMA).parquet(log_path)
    return log if buckets is None else log.where(F.col("bucket").isin(buckets))


def write_unlogged(spark: SparkSession, log_path: str, out_path: str) -> Callable[[DataFrame, int], None]:
    """Micro-batch writer that leaves out logged clips, then logs the new ones.

    The log is laid out by hash of the name, and a batch reads the buckets of its own clips. Each batch
    has its own folders and replaces them when it is repeated, so a restart neither loses nor doubles
    clips, and a clip that comes again after any time is known.
    """
    # An empty log to start with; an existing one is kept.
    spark.createDataFrame([], LOG_SCHEMA).write.partitionBy("bucket", "batch").mode("append").parquet(log_path)

    def write(batch: DataFrame, batch_id: int) -> None:
        fresh = durable(batch.dropDuplicates(["camera_id", "name", "size"]))
        # at most as many numbers as there are buckets
        buckets = [row.bucket for row in fresh.select(_bucket()).distinct().collect()]
        earlier = read_log(spark, log_path, buckets).where(F.col("batch") < batch_id)
        library.new_clips(fresh, earlier, "camera_id").write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
        append_log(spark.read.schema(fresh.schema).parquet(f"{out_path}/batch={batch_id}"), log_path, batch_id)

    return write


# --- segments and cleaning -----------------------------------------------------------------------------


def _number_segments(key: tuple, batches: Iterator[pd.DataFrame], last: GroupState) -> Iterator[pd.DataFrame]:
    """Number the reachable segments of a trip while its fixes arrive in order; the state is its last fix."""
    parts = list(batches)
    fixes = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
    seq, t, lat, lon = (fixes[c].to_numpy() for c in ("seq", "t", "lat", "lon"))
    order = np.lexsort((seq, t))
    seq, t, lat, lon = (values[order] for values in (seq, t, lat, lon))
    # the fix before the batch stands before its first; without one that is the first itself
    segment, *before = last.get if last.exists else (1, t[0], lat[0], lon[0])
    far = _speeds(*(np.concatenate([[a], b]) for a, b in zip(before, (t, lat, lon)))) > C.MAX_SPEED_KMH
    numbers = segment + np.cumsum(far)
    last.update((int(numbers[-1]), float(t[-1]), float(lat[-1]), float(lon[-1])))
    yield pd.DataFrame({"trip_id": key[0], "seq": seq, "t": t, "segment": numbers})


def _speeds(t: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Implied speed in km/h of each step; readings come once per second at most."""
    phi, turn = np.radians(lat), np.radians(lon)
    a = np.sin(np.diff(phi) / 2) ** 2 + np.cos(phi[:-1]) * np.cos(phi[1:]) * np.sin(np.diff(turn) / 2) ** 2
    return 2 * C.EARTH_RADIUS_M * np.arcsin(np.sqrt(np.minimum(1.0, a))) / np.maximum(1.0, np.diff(t)) * 3.6


def live_segments(fixes: DataFrame) -> DataFrame:
    """Segment number of each arriving fix ``(trip_id, seq, t, lat, lon)``.

    The states of many trips travel with their fixes in the same Arrow batches, so a trip costs no calls
    of its own between Python and the state store.
    """
    trip_type = dict(fixes.dtypes)["trip_id"]
    return fixes.groupBy("trip_id").applyInPandasWithState(
        _number_segments, f"trip_id {trip_type}, seq int, t double, segment bigint",
        "segment bigint, t double, lat double, lon double", "append", GroupStateTimeout.NoTimeout,
    )


def store_readings(readings: DataFrame, path: str) -> None:
    """Append readings to a table laid out by the date of their trip."""
    readings.repartition("trip_date", F.pmod(F.xxhash64("trip_id"), F.lit(32))).write.partitionBy("trip_date").mode("append").parquet(path)


def readings_of(spark: SparkSession, path: str, trips: DataFrame, schema: T.StructType) -> DataFrame:
    """Stored readings of trips ``(trip_id, trip_date)``; only the folders of their dates are read."""
    dates = [row.trip_date for row in trips.select("trip_date").distinct().limit(MAX_DATES + 1).collect()]
    known = [d for d in dates if d is not None]
    if len(dates) <= MAX_DATES:
        wanted = F.col("trip_date").isin(known)
    else:
        wanted = F.col("trip_date").between(*trips.agg(F.min("trip_date"), F.max("trip_date")).first())
    if None in dates or len(dates) > MAX_DATES:
        wanted = wanted | F.col("trip_date").isNull()
    rows = spark.read.schema(schema).parquet(path).where(wanted)
    return rows.join(trips.select("trip_id").distinct(), "trip_id", "left_semi")


def clean_closed_trips(
    spark: SparkSession, readings_path: str, out_path: str, schema: T.StructType
) -> Callable[[DataFrame, int], None]:
    """Micro-batch writer that cleans trips ``(trip_id, trip_date)`` once their session is closed.

    Cleaning needs the fixes after a sample, so it runs on whole trips, read from the table the
    readings arrive in (``store_readings``). A batch folder is overwritten when the batch is repeated.
    """
    def write(closed: DataFrame, batch_id: int) -> None:
        done = readings_of(spark, readings_path, durable(closed.select("trip_id", "trip_date").distinct()), schema)
        cleaning.clean_tracks(done).write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return write


# --- activity and running ------------------------------------------------------------------------------


def trip_activity(fixes: DataFrame, size: str = "1 hour", slide: str = "15 minutes", late: str | None = None) -> DataFrame:
    """Fixes, highest speed and box per trip and sliding window of time. Works on streams too."""
    if late is not None:
        fixes = fixes.withWatermark("time", late)
    return fixes.groupBy("trip_id", F.window("time", size, slide)).agg(
        F.count(F.lit(1)).alias("fixes"), F.max("kmh").alias("max_kmh"),
        F.sum("step_m").alias("distance_m"),
    ).select("trip_id", F.col("window.start").alias("window_start"), "fixes", "max_kmh", "distance_m")


def write_batches(out_path: str) -> Callable[[DataFrame, int], None]:
    """Micro-batch writer of updated rows: one folder per batch, replaced when the batch is repeated."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return write


def latest_rows(updates: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """What ``write_batches`` wrote last for each key (``updates`` has the number of the ``batch``)."""
    values = [c for c in updates.columns if c not in (*keys, "batch")]
    last = updates.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_last"))
    return last.select(*keys, "_last.*")


def catch_up_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update"):
    """Hand everything that arrived since the last run to a micro-batch writer, then stop."""
    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .outputMode(mode).trigger(availableNow=True).start()
    )


def catch_up(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append"):
    """Process everything that arrived since the last run, then stop."""
    return (
        stream.writeStream.format("parquet").option("path", sink)
        .option("checkpointLocation", checkpoint).outputMode(mode)
        .trigger(availableNow=True).start()
    )
