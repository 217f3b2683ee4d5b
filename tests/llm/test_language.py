import numpy as np
import pytest

from trackloom.llm.language import LanguageFilter, count_grams, grams, identify
from trackloom.llm.common import letters

EN = "the quick brown fox jumps over the lazy dog and then sleeps all day in the warm sun "
DE = "der schnelle braune fuchs springt über den faulen hund und schläft dann den ganzen tag "


def test_counts_cover_whole_texts(spark):
    text = EN * 30_000  # longer than a piece
    got = {r["gram"]: r["n"] for r in count_grams(spark.createDataFrame([(text, "en"), (None, "en")], "text string, lang string")).collect()}
    plain = f" {text.lower()} "
    want = {}
    for i in range(len(plain) - 2):
        a, b, c = plain[i : i + 3]
        if b != " ":
            key = ord(a) << 32 | ord(b) << 16 | ord(c)
            want[key] = want.get(key, 0) + 1
    assert got == want


def test_filter_returns_every_language_that_contains_a_gram():
    keys = np.arange(1, 2000, dtype=np.int64) * 7919
    model = LanguageFilter.build({"a": keys, "b": keys[:500]})
    hits = model.hits(keys.astype(np.uint64), np.zeros(len(keys), np.int64), 1)
    assert hits[0, 0] == len(keys) and hits[0, 1] >= 500 and hits[0, 2] == len(keys)
    best, score = model.decide(hits)
    assert model.langs[best[0]] == "a" and 0.99 <= score[0] <= 1
    false = hits[0, 1] - 500
    assert false <= (len(keys) - 500) * model.fill[1] ** 3 * 3 + 10


def test_more_languages_than_a_word_has_bits():
    model = LanguageFilter.build({f"l{i:03}": np.array([i * 1000 + k for k in range(50)]) for i in range(70)})
    keys = np.array([69_000 + k for k in range(50)], np.uint64)
    assert model.langs[model.decide(model.hits(keys, np.zeros(50, np.int64), 1))[0][0]] == "l069"


def test_predictions_and_odd_rows(spark, documents):
    rows = [(i, EN[i % 20 :] * 3, "en", "s") for i in range(40)] + [(100 + i, DE[i % 20 :] * 3, "de", "s") for i in range(40)]
    odd = [(500, None, "en", "s"), (501, "", None, None), (502, "12 34 !!", "de", "s"), (503, EN * 10_000, None, None), (503, EN * 10_000, None, None), (None, DE, None, None)]
    out = [(r.doc_id, r.lang_pred, r.score) for r in identify(documents(rows + odd)).collect()]
    by_id = {i: (la, s) for i, la, s in out}
    assert len(out) == len(rows) + len(odd)
    assert all(by_id[i][0] == la for i, _, la, _ in rows) and all(0 <= s <= 1 for _, _, s in out)
    assert by_id[500] == by_id[501] == by_id[502] == ("und", 0.0) and by_id[503][0] == "en" and by_id[None][0] == "de"


@pytest.mark.parametrize("rows", [[], [(1, EN, None, None)]])
def test_nothing_to_learn_from(documents, rows):
    assert [r.lang_pred for r in identify(documents(rows)).collect()] == ["und"] * len(rows)


def test_pieces_of_a_long_text_lose_no_gram():
    text = "".join(chr(97 + i * 7 % 26) for i in range(1000))
    parts = [grams(c, o)[0] for c, o in letters([text], 2, 100)]
    whole = grams(*next(letters([text], 2)))[0]
    assert np.array_equal(np.sort(np.concatenate(parts)), np.sort(whole))


def test_symbols_beyond_the_basic_plane_are_no_letters(documents):
    known = lambda text: grams(*next(letters([text], 2)))[0]
    assert len(known("\U0001f600\U0001f44d \U0001d7d8")) == 0 and len(known("\U00010330\U00020000")) == 2
    assert np.array_equal(known("fox\U0001f600den"), known("fox den"))
    rows = [(i, EN[i % 20 :] * 3, "en", "s") for i in range(8)] + [(50, "\U0001f600\U0001f44d \U0001f680", "en", "s")]
    by_id = {r.doc_id: (r.lang_pred, r.score) for r in identify(documents(rows)).collect()}
    assert by_id[50] == ("und", 0.0) and by_id[1][0] == "en"
