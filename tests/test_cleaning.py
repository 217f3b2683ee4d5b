"""Cleaning rules on small literal trips."""

import datetime
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows
from trackloom.functions import text
from trackloom.operators import blocks, chains, cleaning

RAW = (
    "trip_id string, seq int, t double, gps_text string, clock_text string, gps_score double, "
    "clock_score double, trip_date date, timezone string"
)
DAY = datetime.date(2026, 9, 25)
START = datetime.datetime(2026, 9, 25, 10, 0, 0)


def reading(seq, lat, lon=24.0, clock=None, speed="108 KM/H ", t=None, **changes):
    clock = START + datetime.timedelta(seconds=seq) if clock is None else clock
    letters = ("S" if lat < 0 else "N", "W" if lon < 0 else "E")
    row = {
        "trip_id": "a", "seq": seq, "t": float(seq if t is None else t),
        "gps_text": f"{speed}{letters[0]}{abs(lat):.6f} {letters[1]}{abs(lon):.6f}",
        "clock_text": clock if isinstance(clock, str) else f"{clock:%Y/%m/%d %H:%M:%S}",
        "gps_score": 0.9, "clock_score": 0.9, "trip_date": DAY, "timezone": "Europe/Kyiv",
    }
    return {**row, **changes}


def drive(count, seq=0, lat=49.8, **changes):
    """A steady drive north at 108 km/h."""
    return [reading(seq + i, lat + 0.00027 * i, **changes) for i in range(count)]


def changed(data, **by_index):
    for key, change in by_index.items():
        data[int(key[1:])].update(change)
    return data


def repeated_hour(zone, start):
    import zoneinfo

    data = []
    for i in range(40):
        utc = (start + datetime.timedelta(seconds=i)).replace(tzinfo=datetime.UTC)
        local = utc.astimezone(zoneinfo.ZoneInfo(zone))
        data.append(reading(i, 49.8 + 0.00027 * i, clock=local.replace(tzinfo=None),
                            trip_date=local.date(), timezone=zone))
    return data


KYIV_CHANGE = datetime.datetime(2026, 10, 25, 0, 59, 50)
LORD_HOWE_CHANGE = datetime.datetime(2026, 4, 4, 14, 59, 50)
MERGED = [
    reading(20 + i, 50.8 + 0.00027 * i, clock=START + datetime.timedelta(hours=2, seconds=20 + i))
    for i in range(20)
]
TRIPS = {
    "steady": drive(20),
    "short gap": drive(10) + [reading(i, 0, gps_text="") for i in range(10, 15)] + drive(10, 15, 49.8 + 0.00027 * 15),
    "long gap": drive(10) + [reading(i, 0, gps_text="") for i in range(10, 90)] + drive(10, 90, 49.8 + 0.00027 * 90),
    "spoof": drive(80) + [
        reading(i, -12.0 - i / 1e5, -77.0, clock=f"2026/09/01 10:00:{i % 60:02d}") for i in range(80, 160)
    ],
    "unreachable": drive(40) + [reading(i, 50.9 + 0.00027 * i) for i in range(40, 50)] + drive(40, 50, 49.8 + 0.00027 * 50),
    "slow": drive(30, speed="20 KM/H "), "no speed": drive(30, speed=""), "few pairs": drive(9, speed="20 KM/H "),
    "merged": drive(20) + MERGED, "overrides": drive(12),
    "broken": changed(
        drive(12), i3={"gps_score": 0.5}, i4={"gps_text": "108 KM/H N49.8"}, i5={"clock_text": "2026/02/30 10:00:05"}
    ),
    "month first": changed(drive(12), **{f"i{i}": {"clock_text": f"09/25/2026 10:00:{i:02d}"} for i in range(12)}),
    "ambiguous": changed(drive(12), **{
        f"i{i}": {"clock_text": f"05/04/2026 10:00:{i:02d}", "trip_date": datetime.date(2026, 5, 4)} for i in range(12)
    }),
    "no date": drive(12, trip_date=None),
    "only spoofed": [reading(i, -12.0 - i / 1e5, -77.0, clock=f"2026/09/01 10:00:{i:02d}") for i in range(10)],
    "Kyiv": repeated_hour("Europe/Kyiv", KYIV_CHANGE),
    # A half-hour change.
    "Lord Howe": repeated_hour("Australia/Lord_Howe", LORD_HOWE_CHANGE),
}
COLUMNS = [c.split()[0] for c in RAW.split(", ")]


def frame(spark, trips):
    data = [tuple({**r, "trip_id": name}[c] for c in COLUMNS) for name, rows_ in trips.items() for r in rows_]
    return spark.createDataFrame(data, RAW)


@pytest.fixture(scope="module")
def cleaned(spark):
    overrides = spark.createDataFrame(
        [("overrides", "bad", 3.0, 5.0), ("overrides", "good", 4.0, 4.0)],
        "trip_id string, kind string, start_s double, end_s double",
    )
    result = cleaning.clean_tracks(frame(spark, TRIPS), overrides, hot=blocks.NO_HOT_KEYS)
    by_trip = {}
    for row in result.orderBy("trip_id", "t").collect():
        by_trip.setdefault(row.trip_id, []).append(row)
    return by_trip


def statuses(result):
    return [r.status for r in result]


def test_every_sample_has_one_status_and_a_place_only_when_located(cleaned):
    for name, result in cleaned.items():
        assert len(result) == len(TRIPS[name])
        for r in result:
            assert (r.lat is not None) == (r.status in ("ok", "interpolated"))


def test_steady_drive_is_ok_with_utc_times(cleaned):
    result = cleaned["steady"]
    assert statuses(result) == ["ok"] * 20
    assert result[3].time == datetime.datetime(2026, 9, 25, 7, 0, 3)
    assert not any(r.time_estimated for r in result)
    assert result[0].kmh == 108
    assert statuses(cleaned["no date"]) == ["ok"] * 12


def test_short_gap_is_interpolated_and_long_gap_is_not(cleaned):
    result = cleaned["short gap"]
    assert statuses(result) == ["ok"] * 10 + ["interpolated"] * 5 + ["ok"] * 10
    assert result[12].lat == pytest.approx(49.8 + 0.00027 * 12, abs=1e-9) and result[12].kmh is None
    assert statuses(cleaned["long gap"]) == ["ok"] * 10 + ["no_fix"] * 80 + ["ok"] * 10


def test_spoof_with_wrong_date_is_rejected(cleaned):
    result = cleaned["spoof"]
    assert statuses(result) == ["ok"] * 80 + ["spoofed"] * 80
    assert result[100].time == datetime.datetime(2026, 9, 25, 7, 1, 40) and result[100].time_estimated


def test_without_any_good_fix_there_is_no_time_from_an_implausible_clock(cleaned):
    assert {(r.status, r.time, r.time_estimated) for r in cleaned["only spoofed"]} == {("spoofed", None, True)}


def test_unreachable_stretch_loses_to_the_longer_one(cleaned):
    result = cleaned["unreachable"]
    assert set(statuses(result)[:40]) == {"ok"} and set(statuses(result)[40:50]) == {"interpolated"}


def test_speed_mismatch_rejects_a_segment(cleaned):
    assert statuses(cleaned["slow"]) == ["spoofed"] * 30
    assert statuses(cleaned["no speed"]) == ["ok"] * 30
    # With fewer than five pairs nothing can be said.
    assert statuses(cleaned["few pairs"]) == ["ok"] * 9


def test_merge_gap_shifts_times_and_keeps_both_parts(cleaned):
    result = cleaned["merged"]
    assert statuses(result) == ["ok"] * 40
    assert result[25].time == datetime.datetime(2026, 9, 25, 9, 0, 25)


def test_overrides_apply_before_and_after_the_chain(cleaned):
    assert statuses(cleaned["overrides"]) == ["ok"] * 3 + ["interpolated", "ok", "interpolated"] + ["ok"] * 6


def test_unreliable_and_broken_texts(cleaned):
    result = cleaned["broken"]
    assert statuses(result)[3:6] == ["interpolated", "interpolated", "ok"]
    assert result[5].time == datetime.datetime(2026, 9, 25, 7, 0, 5) and result[5].time_estimated


def test_day_and_month_order(cleaned):
    assert cleaned["month first"][2].time == datetime.datetime(2026, 9, 25, 7, 0, 2)
    assert cleaned["ambiguous"][0].time == datetime.datetime(2026, 5, 4, 7)


def test_repeated_hour_is_resolved_by_the_step_back(cleaned):
    for name, start in (("Kyiv", KYIV_CHANGE), ("Lord Howe", LORD_HOWE_CHANGE)):
        assert [r.time for r in cleaned[name]] == [start + datetime.timedelta(seconds=i) for i in range(40)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_parsed_once(spark, readings):
    samples = cleaning.clean_tracks(readings, hot=blocks.NO_HOT_KEYS)
    assert "RLIKE" in _plan(cleaning.parse_readings(cleaning.attach_overrides(readings, None), blocks.trips()))
    assert "RLIKE" not in _plan(samples)


def test_votes_and_scans_of_a_trip_share_one_sort(readings):
    parsed = cleaning.parse_readings(cleaning.attach_overrides(readings, None), blocks.trips())
    assert _plan(parsed).count("Sort [") == 1


def test_clock_texts_of_every_layout(spark):
    texts = ["2024/01/02 03:04:05", "2024.1/2 3:04:05", "02/01/2024 03:04:05", "1.2.2024 23:59:59", "02/01/202 03:04:05",
             "2024/01/2024 03:04:05", "2024/02/30 03:04:05", "2024/01/02 24:00:00", "2024-01-02 03:04:05", "123/1/24 03:04:05", ""]
    df = spark.createDataFrame([(t,) for t in texts], "c string").withColumn("p", text.clock_parts(F.col("c")))
    found = df.select(text.clock_from_parts(F.col("p")).cast("string"), text.clock_from_parts(F.col("p"), False).cast("string")).collect()
    year_first = ("2024-01-02 03:04:05",) * 2
    assert [tuple(r) for r in found] == [
        year_first, year_first, ("2024-01-02 03:04:05", "2024-02-01 03:04:05"), ("2024-02-01 23:59:59", "2024-01-02 23:59:59"),
        *[(None, None)] * 7,
    ]


def test_positions_outside_the_allowed_areas_are_spoofed(spark):
    df = frame(spark, {"a": drive(12)})
    parsed = cleaning.parse_readings(cleaning.attach_overrides(df, None), blocks.trips(), [(0, 0, 1, 1)])
    assert {r.initial_status for r in parsed.collect()} == {"spoofed"}


def test_ticks_take_their_last_reliable_gps_text(spark):
    frames = spark.createDataFrame(
        [("a", 0, 0.0, "x", "c1", 0.9, 0.9), ("a", 1, 0.5, "y", "c1", 0.9, 0.8), ("a", 2, 1.0, "z", "c2", 0.1, 0.9),
         ("a", 3, 1.5, "w", "c2", 0.2, 0.7), ("a", 4, 2.0, "v", "c1", 0.9, 0.9)],
        "trip_id string, seq int, t double, gps_text string, clock_text string, gps_score double, clock_score double",
    )
    got = rows(cleaning.collapse_frames(frames, hot=blocks.NO_HOT_KEYS), "t", "gps_text", "clock_score")
    assert got == [(0.0, "y", 0.8), (1.0, "w", 0.7), (2.0, "v", 0.9)]


def brute_force_chain(segments):
    """Heaviest chain by trying every predecessor, as plain Python."""
    def meters(a, b):
        p1, p2 = math.radians(a["lat"]), math.radians(b["lat"])
        h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b["lon"] - a["lon"]) / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(min(1, h)))

    total, before = [], []
    for i, s in enumerate(segments):
        best, at = 0, None
        for j in range(i):
            duration = max(1.0, s["first"]["t"] - segments[j]["last"]["t"])
            if total[j] > best and meters(segments[j]["last"], s["first"]) / duration * 3.6 <= 250:
                best, at = total[j], j
        total.append(best + s["weight"])
        before.append(at)
    i, out = total.index(max(total)), []
    while i is not None:
        out.append(segments[i]["segment"])
        i = before[i]
    return sorted(out)


@pytest.mark.parametrize("block_segments", [1024, 3, 1])
def test_chain_agrees_with_brute_force(spark, block_segments):
    rng = random.Random(7)
    data, expected = [], []
    for trip in range(12):
        segments, t = [], 0.0
        for number in range(1, 9):
            def point(t):
                return {"t": t, "instant": None, "lat": 49 + rng.random() / 20, "lon": 24 + rng.random() / 20}

            first, last = point(t), point(t + rng.randint(1, 60))
            segments.append({"segment": number, "weight": rng.randint(1, 5), "first": first, "last": last})
            # Some trips are long enough for everything to become reachable.
            t = last["t"] + rng.randint(1, 120) + (300_000 if trip % 4 == 0 and number == 4 else 0)
        data += [(f"t{trip}", s["segment"], s["weight"], tuple(s["first"].values()), tuple(s["last"].values())) for s in segments]
        expected += [(f"t{trip}", n) for n in brute_force_chain(segments)]
    point_type = "struct<t:double,instant:timestamp,lat:double,lon:double>"
    df = spark.createDataFrame(data, f"trip_id string, segment bigint, weight bigint, first {point_type}, last {point_type}")
    assert rows(cleaning.select_chain(df, block_segments), "trip_id", "segment") == sorted(expected)


def test_chain_of_a_noisy_trip_in_many_tasks(spark):
    """Thousands of segments, half of them far away for a moment, against the plain fold over all."""
    rng, count = np.random.default_rng(3), 6000
    far = rng.random(count) < 0.5
    t = np.arange(count) * 12.0
    lat = np.where(far, -20 + rng.random(count) * 3, 49 + t * 0.00002)
    lon = np.where(far, rng.random(count) * 90, 24 + rng.random(count) * 0.001)
    weight = rng.integers(1, 6, count)
    ends = {"t": t + 5, "s": np.full(count, np.nan), "lat": lat, "lon": lon}
    total, before = weight.copy(), np.full(count, -1)
    for i in range(1, count):
        one = {k: v[i : i + 1] for k, v in {**ends, "t": t}.items()}
        can = chains.reachable({k: v[:i] for k, v in ends.items()}, one)[0]
        found = np.where(can, total[:i], 0)
        if found.max() > 0:
            total[i], before[i] = weight[i] + found.max(), found.argmax()
    want, at = [], int(total.argmax())
    while at >= 0:
        want.append(at)
        at = int(before[at])
    fix = "struct<t:double,instant:timestamp,lat:double,lon:double>"
    data = [(7, i, int(weight[i]), (float(t[i]), None, float(lat[i]), float(lon[i])), (float(t[i] + 5), None, float(lat[i]), float(lon[i]))) for i in range(count)]
    df = spark.createDataFrame(data, f"trip_id int, segment bigint, weight bigint, first {fix}, last {fix}")
    kept = chains.select_chain(df, 512)
    assert sorted(r.segment for r in kept.collect()) == sorted(want) and len(want) > 500
    # the pairs of this one trip are dealt to all tasks
    spread = spark.createDataFrame([(7, b, a) for b in range(12) for a in range(b + 1)], "trip_id int, block bigint, before bigint")
    assert chains.deal_pairs(spread).select(F.spark_partition_id()).distinct().count() > 1


@pytest.mark.parametrize("values", [[1, 2, 31, 32], [31], [30], [29, 31.5], [29, 30.5], [1, 2, 40], [1, 40, 50], [30, 30, 31]])
def test_median_is_decided_exactly_without_collecting(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    over = df.agg(*[c.alias(n) for n, c in cleaning.is_median_over(F.col("v"), 30.0).items()])
    assert over.select(cleaning.median_over(30.0)).first()[0] == (pd.Series(values).median() > 30)
