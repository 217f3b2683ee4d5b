import random

import numpy as np
import pytest

from trackloom.llm import similarity
from trackloom.llm.similarity import components, join_near_duplicates, keep_one, similar, spanning, stop_depth

WORDS = [f"w{i}" for i in range(400)]


def sets(text):
    words = (text or "").lower().split()
    n = min(5, len(words))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if words else set()


def brute(rows):
    """(class, links) per row number."""
    own = [sets(t) for _, t in rows]
    links = {
        a: {b for b in range(len(rows)) if a != b and own[a] and own[b] and None not in (rows[a][0], rows[b][0])
            and len(own[a] & own[b]) >= 0.8 * len(own[a] | own[b])}
        for a in range(len(rows))
    }
    classes = {}
    for a in range(len(rows)):
        group, edge = {a}, [a]
        while edge:
            new = links[edge.pop()] - group
            group |= new
            edge += new
        ids = [rows[b][0] for b in group if rows[b][0] is not None]
        classes[a] = min(ids) if ids and rows[a][0] is not None else None
    return sorted(((rows[a][0], classes[a], len(links[a])) for a in range(len(rows))), key=str)


def corpus():
    random.seed(4)
    rows = []
    for group in range(12):
        base = random.choices(WORDS, k=random.choice((3, 7, 60, 150)))
        for _ in range(random.choice((1, 2, 9))):
            text = list(base)
            for _ in range(random.choice((0, 0, 1, 2, 4))):
                text[random.randrange(len(text))] = random.choice(WORDS)
            rows.append(" ".join(text))
    rows += [rows[0], rows[0].upper(), None, "", "  \n", "one two", "one two"]
    rows = list(enumerate(rows)) + [(None, "one two"), (None, None)]
    return rows + [rows[3]] * 2  # repeated rows


@pytest.mark.parametrize("block, runs", [(512, 400_000), (3, 400_000), (512, 150)])
def test_join_equals_brute_force(documents, monkeypatch, block, runs):
    monkeypatch.setattr(similarity, "BLOCK", block)
    monkeypatch.setattr(similarity, "BLOCK_RUNS", runs)
    rows = corpus()
    out = join_near_duplicates(documents([(i, t, None, None) for i, t in rows])).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in out), key=str) == brute(rows)


def test_a_group_of_many_different_copies(documents):
    random.seed(5)
    base = random.choices(WORDS, k=300)
    rows = [(i, " ".join([*base, f"tail{i}"]), None, None) for i in range(1300)]
    out = join_near_duplicates(documents(rows)).collect()
    assert {r.class_id for r in out} == {0} and {r.n_links for r in out} == {1299}


def test_stage_keeps_one_of_each_group(documents):
    rows = corpus()
    docs = documents([(i, t, None, None) for i, t in rows])
    kept = keep_one(docs)
    classes = [c for i, c, _ in brute(rows) if i is not None]
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(classes)) and ids.count(None) == 2


def test_a_very_long_text(documents):
    text = " ".join(f"w{i}" for i in range(100_000))
    out = join_near_duplicates(documents([(1, text, None, None), (2, text + " x", None, None), (3, text[:100], None, None)])).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in out) == [(1, 1, 1), (2, 1, 1), (3, 3, 0)]


def test_empty_table(documents):
    assert join_near_duplicates(documents([])).count() == 0 and keep_one(documents([])).count() == 0


def test_depth_reaches_the_target_recall():
    depth = stop_depth()
    assert 1 - (1 - 0.8**depth) ** 20 >= 0.9999 > 1 - (1 - 0.8 ** (depth + 1)) ** 20


def test_similar_counts_exactly():
    rng = np.random.default_rng(2)
    own = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(20)]
    got = similar(own, own, 0.5)
    for a in range(20):
        for b in range(20):
            x, y = set(own[a].tolist()), set(own[b].tolist())
            assert got[a, b] == (len(x & y) >= 0.5 * len(x | y))


def test_spanning_links_connect_what_the_matrix_connects():
    links = np.zeros((6, 6), bool)
    for a, b in ((0, 2), (2, 4), (0, 4), (1, 5)):
        links[a, b] = links[b, a] = True
    assert len(spanning(links)) == 3


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "src long, dst long")
    got = {r.id: r.root for r in components(chain).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
