"""Geometry, heatmap and street matching against brute force and small maps."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import SMALL, rows
from trackloom import constants as C
from trackloom.catalog.oracles import hav
from trackloom.operators import blocks, geometry, roads, stats
from trackloom.operators.blocks import NO_HOT_KEYS
from trackloom.plans import enriching
from trackloom.session import durable
from trackloom.sources import derived

M = C.METERS_PER_DEGREE
LAT, LON = 49.8, 24.0


def place(east, north):
    return LAT + north / M, LON + east / (M * math.cos(math.radians(LAT)))


# --- Douglas-Peucker and heat cells ---------------------------------------------------------------


def keep_far_points(points):
    """Recursive reference for the simplification."""
    if len(points) <= 2:
        return points
    scale = math.cos(math.radians(keep_far_points.lat))
    xy = [(p[1] * scale * M, p[0] * M) for p in points]
    (ax, ay), (bx, by) = xy[0], xy[-1]
    length = math.hypot(bx - ax, by - ay)
    def off(p):
        if length == 0:
            return math.hypot(p[0] - ax, p[1] - ay)
        return abs((by - ay) * (p[0] - ax) - (bx - ax) * (p[1] - ay)) / length

    far = [off(p) for p in xy[1:-1]]
    if max(far) <= 5:
        return [points[0], points[-1]]
    i = 1 + far.index(max(far))
    return keep_far_points(points[: i + 1])[:-1] + keep_far_points(points[i:])


def test_simplifying_agrees_with_recursion(spark):
    points = [(round(LAT + 0.00004 * i, 5), round(LON + 0.0004 * math.sin(i / 11) * math.cos(i / 5), 5)) for i in range(300)]
    df = spark.createDataFrame([(1, 1, float(i), i, *p) for i, p in enumerate(points)],
                               "trip_id bigint, run bigint, t double, seq int, lat double, lon double")
    keep_far_points.lat = points[0][0]
    got = [(r.lat, r.lon) for r in geometry.simplify_points(df, hot=NO_HOT_KEYS).orderBy("t").collect()]
    assert got == keep_far_points(points) and 10 < len(got) < 300


def test_heat_cells_agree_with_a_walk(spark, samples):
    routes = durable(geometry.simplify_routes(samples, hot=NO_HOT_KEYS))
    lat = geometry.reference_lat(routes)
    trips = {}
    for r in routes.orderBy("trip_id", "run", "pos").collect():
        trips.setdefault(r.trip_id, {}).setdefault(r.run, []).append((r.lat, r.lon))
    cell_lat = 10 / 111320
    cell_lon = cell_lat / math.cos(lat * math.pi / 180)
    counts = {}
    for runs in trips.values():
        seen = set()
        for points in runs.values():
            for (a, b), (c, d) in zip(points, points[1:]):
                n = max(1, math.ceil(max(abs(c - a) / cell_lat, abs(d - b) / cell_lon) * 2))
                for step in range(n + 1):
                    seen.add((math.floor((a + (c - a) * (step / n)) / cell_lat), math.floor((b + (d - b) * (step / n)) / cell_lon)))
        for cell in seen:
            counts[cell] = counts.get(cell, 0) + 1
    cells = durable(geometry.heat_cells(routes, lat))
    assert {(r.row, r.column): r.trips for r in cells.collect()} == counts
    assert max(counts.values()) <= len(trips)
    points = geometry.heat_points(cells, 18, lat).collect()
    assert len(points) == len(counts)
    for p in points:
        level = 0.25 + 0.75 * math.log(p.trips) / math.log(max(10, max(counts.values())))
        assert p.opacity == pytest.approx(1 - (1 - level) ** 0.25)


# --- a small map ----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def small_map(spark):
    ways = [
        ("main west", {"highway": "primary", "name": "Main"}, [(-2000, 0), (0, 0)]),
        ("main east", {"highway": "secondary", "name": "Main", "name:en": "Main Street"}, [(0, 0), (2000, 0)]),
        ("cross", {"highway": "residential", "name": "Cross"}, [(0, -1000), (0, 1000)]),
        ("parallel", {"highway": "residential", "name": "Parallel"}, [(-2000, 80), (2000, 80)]),
        ("ref only", {"highway": "trunk", "ref": "М-06"}, [(0, 3000), (4000, 3000)]),
        ("foot", {"highway": "footway", "name": "Path"}, [(-2000, 10), (2000, 10)]),
        ("no name", {"highway": "residential"}, [(-2000, -10), (2000, -10)]),
    ]
    nodes, way_rows = [], []
    for i, (_, tags, points) in enumerate(ways):
        refs = []
        for j, (e, n) in enumerate(points):
            refs.append(i * 10 + j)
            nodes.append((i * 10 + j, *place(e, n), {}))
        way_rows.append((i, tags, refs))
    nodes += [
        (900, *place(0, 0), {"place": "city", "name": "Kyiv", "population": "2 950 000;x"}),
        (901, *place(0, -12000), {"place": "village", "name": "Village"}),
        (902, *place(500, 0), {"place": "suburb", "name": "Suburb"}),
        (903, 95.0, 24.0, {"place": "town", "name": "Nowhere"}),
    ]
    n = spark.createDataFrame(nodes, "id bigint, lat double, lon double, tags map<string,string>")
    w = spark.createDataFrame(way_rows, "id bigint, tags map<string,string>, nodes array<bigint>")
    return tuple(durable(t) for t in roads.load_map(n, w))


def path(*corners, step=10):
    points = [corners[0]]
    for (e1, n1), (e2, n2) in zip(corners, corners[1:]):
        count = round(math.hypot(e2 - e1, n2 - n1) / step)
        points += [(e1 + (e2 - e1) * i / count, n1 + (n2 - n1) * i / count) for i in range(1, count + 1)]
    return points


DRIVES = {
    "one street": path((-500, 3), (500, 3)),
    "turn": path((-500, 0), (0, 0), (0, 500)),
    "crossing": path((-500, 0), (500, 0)),
    "ref": path((500, 3000), (1500, 3000)),
    "nowhere": path((0, 20000), (500, 20000)),
    "gap": path((-900, 0), (-400, 0)) + [None] * 20 + path((100, 0), (600, 0)),
    "noisy": [(e, 25 * (-1) ** i) for i, (e, _) in enumerate(path((-500, 0), (500, 0)))],
    "between": path((-500, 55), (500, 55)),
}


@pytest.fixture(scope="module")
def matched(spark, small_map):
    data = []
    for name, points in DRIVES.items():
        for i, p in enumerate(points):
            lat, lon = place(*p) if p else (None, None)
            data.append((name, i, float(i), None, lat, lon, 36, "ok" if p else "no_fix", False))
    df = spark.createDataFrame(data, "trip_id string, seq int, t double, time timestamp, lat double, lon double, kmh int, status string, time_estimated boolean")
    streets, trips = enriching.enrich(durable(df), small_map, "now", "map", hot=NO_HOT_KEYS)
    by_trip = {name: [] for name in DRIVES}
    for r in streets.orderBy("trip_id", "pos").collect():
        by_trip[r.trip_id].append(r)
    return by_trip, {r.trip_id: r for r in trips.collect()}


def test_streets_of_drives(matched):
    streets = {name: [r.name for r in found] for name, found in matched[0].items()}
    assert streets == {
        "one street": ["Main"], "turn": ["Main", "Cross"], "crossing": ["Main"], "ref": ["М-06"], "nowhere": [],
        "gap": ["Main"], "noisy": ["Main"], "between": ["Parallel"],
    }


def test_street_entries(matched):
    main = matched[0]["one street"][0]
    assert (main.name_en, main.distance_m, main.start_t, main.end_t) == ("Main Street", 1000, 0.0, 100.0)
    assert matched[0]["ref"][0].ref == "М-06" and matched[0]["ref"][0].highway == "trunk"
    # The gap itself is not driven distance.
    assert matched[0]["gap"][0].distance_m == 1000


def test_localities_and_provenance(matched):
    trip = matched[1]["one street"]
    assert trip.localities["start"].name == "Kyiv" and trip.localities["end"].place == "city"
    assert trip.enrichment.osm_timestamp == "now" and len(trip.enrichment.samples_digest) == 16
    assert matched[1]["nowhere"].localities["start"] is None or matched[1]["nowhere"].localities["start"].name == "Kyiv"


def test_map_tables(small_map):
    roads_table, chunks, places = small_map
    assert {r.name or r.ref for r in roads_table.collect()} == {"Main", "Cross", "Parallel", "М-06"}
    assert {r.name: r.population for r in places.where("lat < 90").collect()} == {"Kyiv": 2950000, "Village": None}
    assert chunks.count() == 5


def test_viterbi_agrees_with_all_paths(spark):
    """Cheapest total over every assignment of streets, on a short random run."""
    import itertools
    import random

    rng = random.Random(3)
    for case in range(5):
        costs = [{s: rng.random() * 6 for s in rng.sample(["a", "b", "c"], rng.randint(0, 3))} for _ in range(6)]
        data = [(case, 1, i, s, None, c, hash(s) % 1000) for i, step in enumerate(costs) for s, c in step.items()]
        runs = spark.createDataFrame([(case, 1, i, float(i)) for i in range(6)], "trip_id bigint, run bigint, seq int, t double")
        candidates = spark.createDataFrame(data, "trip_id bigint, run bigint, seq int, name string, ref string, cost double, road_id bigint")
        found = {r.seq: r.street for r in roads.match_streets(runs, candidates, NO_HOT_KEYS).collect()}
        keys = {r.k: r.name for r in candidates.select("name", F.xxhash64("name", "ref").alias("k")).distinct().collect()}
        got = [keys.get(found[i]) for i in range(6)]
        def total(states):
            emission = sum(3.0 if s is None else costs[i][s] for i, s in enumerate(states))
            return emission + 4.0 * sum(a != b for a, b in zip(states, states[1:]))

        best = min(total(s) for s in itertools.product(*[[None, *step] for step in costs]))
        assert total(got) == pytest.approx(best, abs=1e-6)


def test_nearest_sample_and_digest_of_long_trips(spark, samples):
    short = roads.samples_digest(samples)
    assert rows(roads.samples_digest(samples, span_s=100_000)) == rows(short)
    assert rows(roads.samples_digest(samples, span_s=16)) == rows(short)


# --- maps and localities of any size ----------------------------------------------------------------


def test_no_map_table_is_collected_by_the_driver(spark):
    """Exploded sides look small to Spark, so it used to broadcast all nodes of a map."""
    ways = derived.road_ways(spark, SMALL)
    points = roads.resolve_points(roads.named_roads(ways), derived.road_nodes(spark, SMALL))
    assert "Broadcast" not in points._jdf.queryExecution().executedPlan().toString()
    large = roads._broadcast_if_small(points, 0)
    joined = ways.select(F.col("id").alias("way_id")).join(large, "way_id")
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()


def test_the_nodes_of_a_map_are_joined_once(spark):
    """Roads and chunks used to join all nodes each for themselves."""
    tables = roads.load_map(derived.road_nodes(spark, SMALL), derived.road_ways(spark, SMALL), on_globe=False)
    for table in tables[:2]:
        assert "Join" not in table._jdf.queryExecution().executedPlan().toString()


def test_flat_maps_go_on_beyond_the_poles(spark):
    ways = spark.createDataFrame(
        [(1, {"highway": "primary", "name": "Main"}, [1, 2, 3])], "id bigint, tags map<string,string>, nodes array<bigint>"
    )
    nodes = spark.createDataFrame(
        [(1, 89.9, 24.0, {}), (2, 90.0, 24.0, {}), (3, 90.1, 24.0, {})], "id bigint, lat double, lon double, tags map<string,string>"
    )
    named = roads.named_roads(ways)
    assert [len(r.points) for r in roads.resolve_points(named, nodes).collect()] == [2]
    assert [len(r.points) for r in roads.resolve_points(named, nodes, on_globe=False).collect()] == [3]


def test_localities_anywhere_agree_with_brute_force(spark):
    """Near a pole, beyond it, across the antimeridian and a turn further round."""
    spots = [(89.995, 24.0), (90.004, 10.0), (-89.99, 100.0), (49.8, 179.999), (409.8, 24.0), (49.8, 24.1), (130.201, -150.0)]
    asked = [(89.995, 28.0), (89.999, -120.0), (-89.991, -70.0), (49.8, -179.999), (49.801, 24.001), (49.8, 30.0), (10.0, 10.0)]
    places = spark.createDataFrame(
        [(f"p{i}", None, "hamlet", None, *s) for i, s in enumerate(spots)],
        "name string, name_en string, place string, population bigint, lat double, lon double",
    )
    points = spark.createDataFrame([(i, *s) for i, s in enumerate(asked)], "point_id int, lat double, lon double")

    def meters(a, b):
        (p, q), (r, s) = (tuple(map(math.radians, x)) for x in (a, b))
        h = math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2
        return 2 * C.EARTH_RADIUS_M * math.asin(math.sqrt(min(1, h)))

    want = {}
    for i, a in enumerate(asked):
        near = [(meters(a, s), f"p{n}") for n, s in enumerate(spots) if meters(a, s) <= C.LOCALITY_RADII_M["hamlet"]]
        want[i] = min(near)[1] if near else None
    got = {r.point_id: r.locality and r.locality.name for r in roads.find_localities(points, places).collect()}
    assert got == want and sum(v is not None for v in want.values()) >= 4


def test_localities_a_turn_apart_agree_with_sql(spark):
    """On a long flat map two places are equally far but for the last digit, which used to be another than in SQL."""
    con = duckdb.connect()
    asked = [(49.91, 24.004), (50.55, 24.0), (50.63, 24.002), (50.71, 24.004), (51.45, 24.0), (51.53, 24.002)]
    con.execute("CREATE TABLE points (point_id INTEGER, lat DOUBLE, lon DOUBLE)")
    con.executemany("INSERT INTO points VALUES (?, ?, ?)", [(i, *p) for i, p in enumerate(asked)])
    con.execute("""CREATE TABLE places AS SELECT CASE t WHEN 0 THEN 'b' ELSE 'a' END || k AS name,
        (4980 + k) / 100 + t AS lat, 24 + k % 2 / 200 AS lon FROM range(180) r(k), (VALUES (0), (360)) s(t)""")
    meters = hav("e.lat", "e.lon", "p.lat", "p.lon")
    want = dict(con.execute(f"""SELECT point_id, p.name FROM points e JOIN places p ON {meters} <= 500
        QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY {meters} / 500, p.name) = 1""").fetchall())
    points = spark.createDataFrame(con.execute("FROM points").fetchall(), "point_id int, lat double, lon double")
    places = spark.createDataFrame(con.execute("FROM places").fetchall(), "name string, lat double, lon double")
    hamlets = places.selectExpr(
        "name", "cast(null as string) name_en", "'hamlet' place", "cast(null as bigint) population", "lat", "lon"
    )
    got = {r.point_id: r.locality.name for r in roads.find_localities(points, hamlets).collect()}
    assert got == want and {v[0] for v in want.values()} == {"a", "b"}


def test_roads_beyond_the_poles_take_no_cells(spark):
    """No sample can be there, and beyond a pole the margin of longitudes used to be at its widest."""
    leg = "array(named_struct('lat', {0}, 'lon', 24.0), named_struct('lat', {0} + 0.001, 'lon', 24.0))"
    chunks = spark.sql(f"SELECT 1L road_id, {leg.format('130.0D')} points UNION ALL SELECT 2L, {leg.format('49.8D')}")
    named = spark.sql("SELECT id road_id, 'x' name, cast(null as string) ref FROM range(1, 3)")
    cells = roads.road_cells(chunks, named).groupBy("road_id").count().collect()
    assert [r.road_id for r in cells] == [2] and cells[0]["count"] < 10
