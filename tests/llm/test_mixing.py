import random
import re
from fractions import Fraction

import pytest

from trackloom.llm.mixing import mix, resample, schedule, target_shares


def test_targets_share_all_tokens_and_stop_at_three_times_the_size():
    assert target_shares([("a", 100), ("b", 100), ("c", 100)]) == [187.5, 75.0, 37.5]
    got = target_shares([("a", 10), ("b", 1000), ("c", 1000), ("d", 1000)])
    assert got[0] == 30 and sum(got) == pytest.approx(3010) and all(t <= 3 * s for t, s in zip(got, (10, 1000, 1000, 1000)))
    assert target_shares([]) == [] and target_shares([("a", 0), ("b", 0)]) == [0, 0]


def test_schedule_ranks_every_slot_of_a_source_and_keeps_proportions(spark):
    sources = [("a", 0, 500.0), ("b", 0, 200.0), ("c", 0, 0.0), ("d", 0, 100.0)]
    rows = schedule(spark, sources, 120_000).toPandas()
    assert len(rows) == 120_000 and set(rows["source_no"]) == {0, 1, 3}
    for source, share in ((0, 5 / 8), (1, 2 / 8), (3, 1 / 8)):
        part = rows[rows["source_no"] == source].sort_values("number")
        assert part["rank"].tolist() == list(range(len(part))) and abs(len(part) - share * 120_000) < 10
        early = (part["number"] < 1000).sum()
        assert abs(early - share * 1000) < 10  # every stretch holds the proportions


def test_taken_words_meet_targets(documents):
    rows = [(i, " ".join(["w"] * (i % 17)), None, f"s{i % 4}" if i % 4 else None) for i in range(4000)]
    rows += [(5000, None, None, "s1"), (5001, "", None, "s1"), (5002, "long " * 3000, None, "s2"), (5003, "a b", None, "s3"), (5003, "a b", None, "s3"), (None, "x y z", None, "s3")]
    out = mix(documents(rows)).toPandas()
    assert len(out) == len(rows)
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows}
    assert all(sizes[None if i != i else int(i)] == s for i, s in zip(out["doc_id"], out["size"]))
    assert (out["taken"] <= 3 * out["size"]).all() and (out["taken"] >= 0).all()
    total = out["size"].sum()
    for _, part in out.groupby("source", dropna=False):
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= 0.01 * total
        assert part["source_size"].iloc[0] == part["size"].sum()
    again = mix(documents(rows)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert out[key].fillna(-1).sort_values(key).values.tolist() == again[key].fillna(-1).sort_values(key).values.tolist()


def test_stage_repeats_documents_with_all_columns(documents):
    docs = documents([(i, "one two three four", None, f"s{i % 3}") for i in range(300)])
    out = resample(docs)
    assert out.columns == docs.columns
    counts = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert counts["s0"] == pytest.approx(187, abs=2) and counts["s1"] == pytest.approx(75, abs=2) and counts["s2"] == pytest.approx(37, abs=2)


def taken_by_hand(rows, weights=(5, 2, 1)):
    """Words per source by the contract, with exact fractions."""
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: Fraction(weights[i % 3]) for i, s in enumerate(names)}
    capped, total = {}, Fraction(sum(sizes.values()))
    while True:
        open_ = [s for s in names if s not in capped]
        share = {s: (total - sum(capped.values())) * weight[s] / sum(weight[o] for o in open_) for s in open_}
        above = {s: Fraction(3 * sizes[s]) for s in open_ if share[s] > 3 * sizes[s]}
        if not above:
            return {**capped, **share}
        capped |= above


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_sources_of_any_size_meet_their_targets_to_the_word(documents, block):
    rng = random.Random(1)
    sizes = {"a": 1, "b": 300, "c": 5000, "d": 400_000, "e": 0, None: 3}
    rows = []
    for source, left in sizes.items():
        while left > 0 or source == "e":
            n = min(left, rng.randint(1, 900))
            rows.append((len(rows), " ".join(["w"] * n), None, source))
            left -= n
            if source == "e":
                break
    out = mix(documents(rows), block_tokens=block if block > 1 else 50).toPandas()
    want = taken_by_hand(rows)
    assert (out["taken"] <= 3 * out["size"]).all()
    assert sum(want.values()) == out["taken"].sum()
    for source, part in out.groupby("source", dropna=False):
        key = None if source != source else source
        assert abs(part["taken"].sum() - want[key]) < 1 and part["target"].iloc[0] == pytest.approx(float(want[key]))
        # every document of a source is taken equally often, but for the one where its line ends
        times = {t // s for t, s in zip(part["taken"], part["size"]) if s}
        assert len(times) <= 2 and (not times or max(times) - min(times) <= 1)


@pytest.mark.parametrize("rows", [[], [(1, None, None, None), (2, " \n", None, "s")]])
def test_nothing_to_take(documents, rows):
    assert [(r.size, r.taken) for r in mix(documents(rows)).collect()] == [(0, 0)] * len(rows)
    assert resample(documents(rows)).count() == 0
