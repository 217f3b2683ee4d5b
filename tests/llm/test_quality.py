import numpy as np
import pytest

from trackloom.llm.quality import BUCKETS, classify, features, keep_good, train
from trackloom.llm.common import letters

WORDS = "river stone light water garden window paper summer winter music letter bread cloud forest road".split()


def good(i):
    rng = np.random.default_rng(i)
    return " ".join(rng.choice(WORDS, 40)) + "."


def bad(i):
    rng = np.random.default_rng(i)
    return ["!!! ".join(w.upper() for w in rng.choice(WORDS, 30)), f"{WORDS[i % len(WORDS)]} " * 30][i % 2]


@pytest.fixture(scope="module")
def corpus(documents):
    texts = [(i, bad(i) if i % 4 == 0 else good(i)) for i in range(240)]
    rows = [(i, t, "en", "s") for i, t in texts]
    odd = [(900, None, None, None), (901, "", None, None), (902, good(5) * 20_000, None, None), (903, good(7), None, None), (903, good(7), None, None), (None, good(8), None, None)]
    return rows, odd, documents(rows + odd)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(i % 4 != 0), "x") for i in range(240)] + [(5, None, "x"), (None, 1, "x"), (7, 9, "x")]
    return spark.createDataFrame(rows, "doc_id long, quality int, label string")


def test_held_out_accuracy_and_odd_rows(corpus, labels):
    rows, odd, docs = corpus
    out = classify(docs, labels).collect()
    assert len(out) == len(rows) + len(odd)
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 240]
    assert held and all(r.predicted == (r.doc_id % 4 != 0) for r in held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    by_id = {r.doc_id: r.score for r in out}
    assert by_id[900] == by_id[901] and len({r.score for r in out if r.doc_id == 903}) == 1
    assert out != [] and [(r.doc_id, r.score) for r in classify(docs, labels).collect() if r.doc_id == 902] == [(902, by_id[902])]


def test_stage_keeps_columns_and_good_documents(corpus, labels):
    rows, _, docs = corpus
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert {i for i, *_ in rows if i % 4} <= ids and not {i for i, *_ in rows if i % 4 == 0} & ids


def test_without_labels_or_rows(documents, labels):
    docs = documents([(1, "some text", None, None)])
    assert [r.score for r in classify(docs, labels.where("false")).collect()] == [0.5]
    assert classify(documents([]), labels).count() == 0


def test_repeated_words_share_a_feature_and_texts_do_not_mix():
    def buckets(texts):
        codes, owners = next(letters(texts, 4))
        out = [set() for _ in texts]
        for of, found in features(codes, owners):
            for o, b in zip(of, found):
                out[o].add(int(b))
        return out

    a, b = buckets(["alpha alpha", "omega omega"])
    assert a & b and buckets(["alpha alpha"])[0] == a and buckets(["omega omega"])[0] == b


def test_training_is_repeatable():
    rng = np.random.default_rng(0)
    texts = [(np.sort(rng.choice(BUCKETS, 20, False)), np.ones(20, np.int64), i % 2) for i in range(30)]
    assert np.array_equal(train(texts).table, train(texts).table)


def test_labelled_texts_are_learned_whole(spark):
    from trackloom.llm import quality

    text = " ".join(f"w{i}" for i in range(20_000)) + " a" * 70_000
    want = np.zeros(BUCKETS, np.int64)
    for codes, owners in letters([text], 4):
        for _, bucket in features(codes, owners):
            want += np.bincount(bucket, minlength=BUCKETS)
    assert (want > 0).sum() > 8_192 and want.max() > 65_535
    rows = spark.createDataFrame([(text, 1, 5), ("short one", 0, 3), ("", 0, 4), ("short one", 0, 3)], "text string, label int, number long")
    found = quality.FiledTexts(quality.labelled_features(rows).toLocalIterator())
    assert [t[2] for t in found] == [0, 0, 0, 1] == found.labels
    buckets, counts, _ = found[3]
    assert np.array_equal(buckets, np.flatnonzero(want)) and np.array_equal(counts, want[want > 0])
    assert np.array_equal(found[0][0], found[1][0]) and len(found[0][0]) > 0
