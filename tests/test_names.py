"""Trip names: labels, fitting, numbering."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from trackloom.functions import names, text
from trackloom.operators import naming
from trackloom.operators.blocks import NO_HOT_KEYS
from trackloom.session import durable


def one(spark, values, column, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_transliteration(spark):
    pairs = {
        "Хрещатик": "Khreshchatyk", "Згурський": "Zghurskyi", "Юлія": "Yuliia", "Єнакієве": "Yenakiieve",
        "Їжакевич": "Yizhakevych", "Знам'янка": "Znamianka", "Знам’янка": "Znamianka", "ЩАСТЯ": "SHCHASTIa",
        "Щастя": "Shchastia", "Подъезд": "Podezd", "Йосипівка": "Yosypivka", "Гоща": "Hoshcha", "М-06": "M-06",
        "Main 5": "Main 5", "згода": "zghoda", "Розгін": "Rozghin",
    }
    assert one(spark, list(pairs), names.transliterate(F.col("x"))) == list(pairs.values())


def test_refs_and_labels(spark):
    refs = {"М-06": "M06", "М 06;Е40": "M06", "Р-03": "R03", "A1": "A1", "Ü 7": "U7"}
    assert one(spark, list(refs), names.normalize_ref(F.col("x"))) == list(refs.values())
    streets = [
        ("вулиця Івана Франка", None, None, "primary", "Ivana Franka"),
        ("вулиця Івана Франка", "Ivana Franka Street", None, "primary", "Ivana Franka"),
        ("Київське шосе", None, "М-06", "trunk", "M06"),
        ("Київське шосе", None, "М-06", "primary", "Kyivske"),
        ("М-06", None, "М-06", "primary", "M06"),
        (None, None, "Т-1402", "tertiary", "T1402"),
        ("вулиця", None, None, "primary", None),
        ("площа Ринок: 1/2", None, None, "primary", "Rynok 1 2"),
        (None, None, None, "primary", None),
    ]
    df = spark.createDataFrame([(i, *s) for i, s in enumerate(streets)], "i int, name string, name_en string, ref string, highway string, want string")
    label = names.street_label(*(F.col(c) for c in ("name", "name_en", "ref", "highway")))
    for r in df.select("want", label.alias("got")).collect():
        assert r.got == r.want


def fit(stretches, length):
    """Plain reference of fitting labels."""
    def cut(s):
        if len(s) <= length:
            return s
        s = s[:length]
        return (s.rsplit(" ", 1)[0] if " " in s else s).rstrip(" ,-")

    labels = [s[0] for s in stretches]
    if len(", ".join(labels)) <= length or len(labels) <= 1:
        return cut(", ".join(labels))
    kept = {0, len(labels) - 1}
    if len(", ".join([labels[0], labels[-1]])) > length:
        return cut(labels[0])
    for i in sorted(range(1, len(labels) - 1), key=lambda i: -stretches[i][1]):
        if len(", ".join(labels[j] for j in sorted(kept | {i}))) <= length:
            kept.add(i)
    return ", ".join(labels[i] for i in sorted(kept))


def test_fitting_labels(spark):
    rng = random.Random(1)
    cases = [
        [("x" * rng.randint(1, 12) + " " + "y" * rng.randint(1, 9), float(rng.randint(1, 9))) for _ in range(rng.randint(1, 9))]
        for _ in range(40)
    ]
    for length in (8, 30, 60):
        column = names.fit_street_labels(F.col("x"), F.lit(length))
        got = one(spark, cases, column, "array<struct<label:string,distance_m:double>>")
        assert got == [fit(c, length) for c in cases]


def test_named_stretches(spark):
    streets = [("Main", 200), ("Main", 200), ("Short", 100), ("Main", 400), ("Other", 299), ("Last", 300), ("Last", None)]
    df = spark.createDataFrame(
        [("t", i, n, None, None, "primary", d) for i, (n, d) in enumerate(streets)],
        "trip_id string, pos int, name string, name_en string, ref string, highway string, distance_m bigint",
    )
    got = naming.named_stretches(df, NO_HOT_KEYS).orderBy("pos").collect()
    assert [(r.label, r.distance_m) for r in got] == [("Main", 800.0), ("Last", 300.0)]


def number_by_hand(trips, taken):
    """Names in trip order, counting up while one is taken: plain reference."""
    taken, plans = set(taken), {}
    for date, start, filename, street, car in sorted(trips, key=lambda t: (t[0], t[1] or "", t[2])):
        own, n = filename.rsplit(".", 1)[0].lower(), 0
        suffix = f" ({car})" if car else ""
        while True:
            stem = f"{date} {street}" + (f" ({n})" if n else "") + suffix
            if stem.lower() not in taken - {own}:
                break
            n += 1
        if stem + ".mp4" != filename:
            taken.add(stem.lower())
            plans[filename] = stem + ".mp4"
    return plans


@pytest.mark.parametrize("car", ["", "Zoe"])
def test_numbering_agrees_with_a_sequential_plan(spark, car):
    rng = random.Random(5)
    trips = []
    for i in range(60):
        date = f"2024-01-0{rng.randint(1, 2)}"
        name = rng.choice([f"Trip 10-{i:02d}", f"Main ({i % 4})", f"Main ({i % 4}) (Zoe)", "Main"]) + ("" if i % 3 else f" {i}")
        trips.append((date, f"{date}T0{rng.randint(1, 9)}:00:00", f"{date} {name}.mp4", rng.choice(["Main", "MAIN", "Main, Cross", "Unique%d" % i]), car))
    trips = list({t[2].lower(): t for t in trips}.values())
    taken = {t[2][:-4].lower() for t in trips} | {"2024-01-01 main, cross"}
    df = spark.createDataFrame(
        [(t[2], t[2], datetime.datetime.fromisoformat(t[1]), "UTC", "ok", True, "current") for t in trips],
        "trip_id string, filename string, start_time timestamp, timezone string, extraction_status string, has_located boolean, enrichment_status string",
    )
    streets = spark.createDataFrame(
        [(t[2], i, s, None, None, "primary", 500) for t in trips for i, s in enumerate(t[3].split(", "))],
        "trip_id string, pos int, name string, name_en string, ref string, highway string, distance_m bigint",
    )
    used = spark.createDataFrame([(s,) for s in taken], "stem string")
    plan = naming.plan_renames(df, streets, used, car, include_all=True, hot=NO_HOT_KEYS)
    assert {r.filename: r.new_filename for r in plan.collect()} == number_by_hand(trips, taken)


@pytest.mark.parametrize("most_trips", [1_000_000, 3])
def test_numbers_in_blocks_streets_with_numbers_and_gaps(spark, most_trips):
    """Many trips of one name with free numbers between theirs, and streets that end in a number themselves."""
    rng = random.Random(9)
    day = datetime.date(2024, 1, 1)
    trips = []
    for i in range(70):
        own = rng.choice([f"2024-01-01 Main ({rng.randint(1, 40)})", f"2024-01-01 Old {i}", "2024-01-01 Main"])
        trips.append((own + ".mp4", f"2024-01-01T0{rng.randint(0, 3)}:00:{rng.randint(0, 59):02d}", rng.choice(["Main", "main", "Main (3)", "Main (12)", "Main"])))
    trips = list({t[0].lower(): t for t in trips}.values())
    taken = {t[0][:-4].lower() for t in trips} | {"2024-01-01 main (2)", "2024-01-01 main (05)", "2024-01-01 main (11)"}
    df = spark.createDataFrame(
        [(n, n, day, datetime.datetime.fromisoformat(at), [street] * 4, ".mp4", n[:-4], "") for n, at, street in trips],
        "trip_id string, filename string, date date, start_time timestamp, texts array<string>, extension string, own_stem string, car string",
    )
    plan = naming.number_collisions(df, spark.createDataFrame([(s,) for s in taken], "stem string"), most_trips)
    want = number_by_hand([("2024-01-01", at, n, street, "") for n, at, street in trips], taken)
    assert {r.filename: r.new_filename for r in plan.collect()} == want


def test_one_name_for_a_hundred_thousand_trips(spark):
    """A fallback minute that every trip wants: numbered by seconds in many tasks, not by one group."""
    count = 100_000
    df = spark.range(count).select(
        F.col("id").alias("trip_id"), F.format_string("2024-01-01 Clip %06d.mp4", "id").alias("filename"),
        F.lit(datetime.date(2024, 1, 1)).alias("date"), F.timestamp_seconds(F.lit(1704106800) + F.col("id") % 60).alias("start_time"),
        F.array_repeat(F.lit("Trip 11-00"), 7).alias("texts"), F.lit(".mp4").alias("extension"),
        F.format_string("2024-01-01 Clip %06d", "id").alias("own_stem"), F.lit("").alias("car"),
    )
    taken = spark.createDataFrame([("2024-01-01 trip 11-00 (1)",), ("2024-01-01 trip 11-00 (77)",)], "stem string")
    plan = naming.number_collisions(df, taken).withColumn("n", F.nullif(F.regexp_extract("new_filename", r"\((\d+)\)", 1), F.lit("")).cast("long"))
    order = sorted(range(count), key=lambda i: (i % 60, i))
    numbers = [None, *(n for n in range(2, count + 3) if n != 77)][:count]
    assert {r.trip_id: r.n for r in plan.collect()} == dict(zip(order, numbers))


def test_trips_that_cannot_be_named_are_left_out(spark):
    rows_ = [
        ("a", "2024-01-01 Trip 10-00.mp4", datetime.datetime(2024, 1, 1, 9, 5), "ok", True, "current"),
        ("b", "2024-01-02 Trip 10-00.mp4", None, "ok", False, "missing"),
        ("c", "Trip 10-00.mp4", datetime.datetime(2024, 1, 1, 9, 5), "ok", True, "current"),
        ("d", "2024-01-03 Trip 10-00.mp4", datetime.datetime(2024, 1, 1, 9, 5), "ok", True, "outdated"),
        ("e", "2024-01-04 Sea.mp4", datetime.datetime(2024, 1, 1, 9, 5), "ok", True, "current"),
    ]
    df = spark.createDataFrame(rows_, "trip_id string, filename string, start_time timestamp, extraction_status string, has_located boolean, enrichment_status string").withColumn("timezone", F.lit("Europe/Kyiv"))
    none = spark.createDataFrame([], "trip_id string, pos int, name string, name_en string, ref string, highway string, distance_m bigint")
    taken = spark.createDataFrame([(r[1][:-4].lower(),) for r in rows_], "stem string")
    plan = naming.plan_renames(df, none, taken, hot=NO_HOT_KEYS)
    assert rows(plan, "filename", "new_filename") == [("2024-01-01 Trip 10-00.mp4", "2024-01-01 Trip 11-05.mp4")]


def test_file_names(spark):
    suffixes = {"a.mp4": ".mp4", ".hidden": "", "a": "", "a.b.MOV": ".MOV", "a.": ""}
    assert one(spark, list(suffixes), text.suffix(F.col("x"))) == list(suffixes.values())
    trips = {"2024-02-30 A.mp4": "2024-02-30 A", "2024-02-03 A.mp4": "A", "2024-02-03.mp4": "2024-02-03", "A.mp4": "A"}
    assert one(spark, list(trips), text.trip_name(F.col("x"))) == list(trips.values())
    globs = {"a[1]*.mp4": [True, False], "A*": [False, False], "*": [True, True], "?1.*": [True, False]}
    for glob, want in globs.items():
        assert one(spark, ["a1.mp4", "b2.mov"], text.matches_globs(F.col("x"), [glob])) == want


def test_fingerprint_of_small_and_large_content(spark):
    import hashlib

    mb = 1 << 20
    contents = [b"", b"abc", b"a" * mb + b"b", b"a" * mb + b"b" * (mb + 7) + b"c"]
    def want(data):
        digest = hashlib.sha256(data[:mb])
        if len(data) > mb:
            digest.update(data[max(mb, len(data) - mb):])
        return f"{len(data)}:{digest.hexdigest()[:16]}"

    got = one(spark, [bytearray(c) for c in contents], text.content_fingerprint(F.col("x")), "binary")
    assert got == [want(c) for c in contents]
