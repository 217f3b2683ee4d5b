import numpy as np
import pytest

from trackloom.llm import hamming, neighbours
from trackloom.llm.hamming import MultiIndex
from trackloom.llm.neighbours import hilbert_keys


def table(n=300, width=12, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, rng.standard_normal(width).astype(np.float32).tolist()) for i in range(n)]


def odd(width=12):
    one = [1.0] + [0.0] * (width - 1)
    return [
        (1000, None), (1020, [0.0] * width), (1001, [float("nan")] * width), (1002, [float("inf")] + one[1:]), (1003, [None] + one[1:]),
        (1004, [1.0, 2.0]), (None, one), (1005, one), (1005, one), *((2000 + i, one) for i in range(60)),
    ]


def brute(rows, k, measure):
    seen = {}
    for i, v in rows:
        if i is not None and v and len(v) == 12 and None not in v and np.isfinite(v).all() and any(v):
            seen[i] = np.asarray(v, np.float64)
    ids = np.array(sorted(seen))
    matrix = np.stack([seen[i] for i in ids])
    out = {}
    for place, q in enumerate(ids):
        if q % 20 == 0:
            value = measure(matrix, matrix[place])
            order = [j for j in np.lexsort((ids, value)) if j != place][:k]
            out[int(q)] = [int(ids[j]) for j in order]
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


@pytest.mark.parametrize("window", [1024, 16])
def test_nearest_vectors_equal_brute_force(vectors, monkeypatch, window):
    monkeypatch.setattr(neighbours, "WINDOW", window)
    rows = table() + odd()
    want = brute(rows, 20, lambda m, q: -np.round([sum(a * b for a, b in zip(q, x)) for x in m], 12))
    assert result(neighbours.search(vectors(rows), 20, 20)) == want


@pytest.mark.parametrize("block", [16_384, 32])
def test_nearest_codes_equal_brute_force(vectors, monkeypatch, block):
    monkeypatch.setattr(hamming, "BLOCK", block)
    rows = table() + odd()
    assert result(hamming.search(vectors(rows), 20, 20)) == brute(rows, 20, lambda m, q: ((m > 0) != (q > 0)).sum(axis=1))


def test_vectors_of_each_length_are_searched(vectors):
    rng = np.random.default_rng(7)
    short = [(5000 + i, rng.standard_normal(3).tolist()) for i in range(45)]
    got = result(neighbours.search(vectors(table() + short), 20, 20))
    codes = result(hamming.search(vectors(table() + short), 20, 20))
    assert {q for q in got if q >= 5000} == {q for q in codes if q >= 5000} == {5000, 5020, 5040}
    ids, matrix = np.array([i for i, _ in short]), np.array([v for _, v in short])
    for q in (5000, 5020, 5040):
        own = matrix[q - 5000]
        for measure, lists in ((-(matrix @ own), got), (((matrix > 0) != (own > 0)).sum(axis=1), codes)):
            assert lists[q] == [int(ids[j]) for j in np.lexsort((ids, measure)) if ids[j] != q][:20]
    assert all(i < 5000 for q, found in got.items() if q < 5000 for i in found)


def test_many_blocks_meet_in_many_tasks_and_settings_stay(spark, vectors, monkeypatch):
    monkeypatch.setattr(hamming, "BLOCK", 32)
    monkeypatch.setattr(hamming, "QUERY_BLOCK", 8)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, rows = spark.conf.get(key), table()
    want = brute(rows, 20, lambda m, q: ((m > 0) != (q > 0)).sum(axis=1))
    for tasks in (8_192, 3):
        monkeypatch.setattr(hamming, "TASKS", tasks)
        assert result(hamming.search(vectors(rows), 20, 20)) == want
    neighbours.search(vectors(rows), 20, 20)
    assert spark.conf.get(key) == before


@pytest.mark.parametrize("rows", [[], [(20, [1.0, 2.0])], [(20, None), (40, [0.0])]])
def test_too_few_vectors(vectors, rows):
    assert neighbours.search(vectors(rows), 20, 20).count() == 0 and hamming.search(vectors(rows), 20, 20).count() == 0


def test_index_meets_each_code_once_and_covers_the_radius():
    rng = np.random.default_rng(1)
    codes = np.unique(rng.integers(0, 1 << 63, 500, np.uint64))
    index, queries = MultiIndex(codes), codes[:20]
    met = set()
    for radius in range(24):
        for q, c, d in zip(*index.step(queries, radius)):
            assert (q, c) not in met and d == bin(int(queries[q]) ^ int(codes[c])).count("1")
            met.add((q, c))
        near = {(q, c) for q in range(20) for c in range(len(codes)) if bin(int(queries[q]) ^ int(codes[c])).count("1") <= radius}
        assert near <= met


def test_neighbours_on_the_curve_are_neighbours_in_space():
    side = 16
    cells = np.array([(x, y) for x in range(side) for y in range(side)])
    keys = hilbert_keys(cells, 4)
    assert sorted(keys.tolist()) == list(range(side * side))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
    cube = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    path = cube[np.argsort(hilbert_keys(cube, 3))]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
