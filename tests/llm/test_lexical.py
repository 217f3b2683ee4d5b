import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from trackloom.llm import lexical

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORDS = [f"w{i}" for i in range(120)] + ["É", "é", "ß", "K", "MIT", "mit", "١"]


def terms(text):
    return [w.translate(UPPER) for w in WORD.findall(text or "")]


def ranked(docs, items, k):
    """The contract by plain loops over all pairs."""
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    held = {}
    for item, text in items:
        held.setdefault(item, set()).update(terms(text))
    out = []
    for item, own in held.items():
        scores = []
        for doc, c in counted:
            m = 50 + (50 * sum(c.values()) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if s > 0:
                scores.append((-s, doc is not None, doc or 0, doc))
        scores.sort()
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(scores[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def fixture():
    rng = random.Random(8)
    weights = [1 / (i + 1) for i in range(len(WORDS))]
    docs = [(i, " ".join(rng.choices(WORDS, weights, k=rng.randint(1, 60)))) for i in range(700)]
    docs += [(1000 + i, "copied text w1 w2 w119") for i in range(40)]
    docs += [(2000, None), (2001, ""), (2002, "!!!"), (2003, "w7 " * 200_000), (None, "w118 w3"), (2004, "w118 w3"), (2005, "w90"), (2005, "w90")]
    items = [(i, " ".join(rng.choices(WORDS, k=rng.randint(1, 25)))) for i in range(60)]
    items += [(100, None), (101, "?"), (102, "nowhere"), (103, "W118, w118; w3"), (104, "w90"), (105, "w5"), (105, "w6"), (None, "w9 w10")]
    return docs, items


def tables(spark, fixture):
    docs, items = fixture
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "doc_id AS n", "text AS terms", "doc_id AS item", "1 AS score")
    return d.repartition(5), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "text AS term")


def rows(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


@pytest.mark.parametrize("k", [1, 5, 50, 2000])
def test_ranks_equal_all_pairs(spark, fixture, k):
    assert rows(lexical.search(*tables(spark, fixture), k=k)) == ranked(*fixture, k)


def test_blocks_of_items_change_nothing(spark, fixture, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 25)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 90)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert rows(lexical.search(*tables(spark, fixture), k=7)) == ranked(*fixture, 7)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_empty_tables(spark, fixture):
    docs, items = tables(spark, fixture)
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(docs.where("doc_id between 2000 and 2002"), items).count() == 0


def test_bounds_cover_scores_and_prune():
    rng = np.random.default_rng(1)
    width, topics = 400, 8
    starts, own = [0], []
    for i in range(480):
        own.append(np.unique(rng.integers(0, 50, 20) + 50 * (i % topics)))
        starts.append(starts[-1] + len(own[-1]))
    flat, starts = np.concatenate(own), np.asarray(starts)
    docs = lexical.Documents(starts, flat, rng.integers(1, 900_000, len(flat)), width)
    items = lexical.item_tree(list(range(64)), [np.unique(rng.integers(0, 50, 9) + 50 * (i % topics)) for i in range(64)], rng.integers(1, 9000, width))

    def leaves(node):
        return [leaf for child in node.children for leaf in leaves(child)] if node.children else [node]

    def check(mine, other):
        parts = [lexical.score(items, a, docs, b).max() for a in leaves(mine) for b in leaves(other)]
        assert lexical.bound(mine, other) >= max(parts)
        for child in mine.children:
            check(child, other)

    check(items.root, docs.root)
    every = [np.concatenate([lexical.score(items, a, docs, b) for b in leaves(docs.root)], axis=1) for a in leaves(items.root)]
    best = lexical.Best(64, 5, np.ones(64, np.int64))
    scored, pairs = lexical.walk(items, docs, best, np.arange(480), np.zeros(480, bool), False)
    assert pairs == 64 * 480 and scored < pairs / 3
    want = np.sort(np.concatenate(every), axis=1)[:, ::-1][:, :5]
    assert [best.cut(i)[0].tolist() for i in range(64)] == want.tolist()


def test_long_documents_do_not_overflow():
    lengths = np.asarray([1, 3_000_000_000])
    got = lexical.measure(np.asarray([1, 7]), lengths, 10**11, 10**14)
    assert got.tolist() == [10**9 // (1000 + 20 * (50 + 50 * 10**11 // 10**14)), 7 * 10**9 // (7000 + 20 * (50 + 50 * 3 * 10**9 * 10**11 // 10**14))]
