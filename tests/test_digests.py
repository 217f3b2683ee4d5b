"""Digests of trips of any length."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from trackloom.operators import digests, roads
from trackloom.operators.digests import hash_lines


def test_digests_of_mixed_groups(spark, monkeypatch):
    rng = random.Random(6)
    data = [(trip, n, rng.choice(["", "é\n", "x" * rng.randint(1, 9000), "line\n"])) for trip in [*range(40), None] for n in range(rng.randint(1, 60))]
    data += [(99, n, None) for n in range(3)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "trip_id bigint, n int, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = rows(hash_lines(df, "trip_id", ("n",), F.col("text"), F.floor(F.col("n") / 8)), "trip_id", "digest")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for trip, _, text in sorted(data, key=lambda r: r[1]):
        want.setdefault(trip, hashlib.sha256()).update((text or "").encode())
    assert dict(got) == {trip: h.hexdigest() for trip, h in want.items()}


def test_trip_of_thirty_million_lines(spark):
    """No list, row or batch grows with the trip: the largest piece stays below its bound."""
    count = 30_000_000
    lines = spark.range(count).select(
        F.lit(1).alias("trip_id"), "id", F.concat(F.col("id").cast("string"), F.lit(".00 49.800000 24.000000\n")).alias("line"),
        F.floor(F.col("id") / 16384).alias("block"),
    )
    got = hash_lines(lines, "trip_id", ("id",), F.col("line"), F.col("block")).first()
    want = hashlib.sha256()
    for begin in range(0, count, 100_000):
        want.update("".join([f"{i}.00 49.800000 24.000000\n" for i in range(begin, begin + 100_000)]).encode())
    assert got.digest == want.hexdigest()
    made = lines.where("id < 200000").select("trip_id", "block", "line").sortWithinPartitions("trip_id", "block", "id")
    pieces = made.mapInArrow(digests._join_lines, "group int, block long, piece long, text binary")
    assert pieces.agg(F.max(F.length("text"))).first()[0] <= digests.PIECE_BYTES


def test_digest_of_a_trip_without_positions(spark):
    df = spark.createDataFrame([(1, 0, 0.0, None, None, "no_fix"), (2, 0, 0.0, 1.0, 2.0, "ok")], "trip_id int, seq int, t double, lat double, lon double, status string")
    got = dict(rows(roads.samples_digest(df), "trip_id", "samples_digest"))
    assert got == {1: hashlib.sha256().hexdigest()[:16], 2: hashlib.sha256(b"0.00 1.000000 2.000000\n").hexdigest()[:16]}


@pytest.mark.parametrize("span_s", [16, 100_000])
def test_digest_does_not_depend_on_blocks(spark, samples, span_s):
    assert rows(roads.samples_digest(samples, span_s=span_s)) == rows(roads.samples_digest(samples))
