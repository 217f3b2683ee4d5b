import random
import re

import pytest

from trackloom.llm import notices
from trackloom.llm.notices import NOTICES, PHRASES, Notice, places_of, settled

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def base(text):
    own, out = words(text), []
    for phrase, label in PHRASES:
        parts = phrase.split()
        out += [(i, label) for i in range(len(own) - len(parts) + 1) if own[i : i + len(parts)] == parts]
    return len(own), sorted(out)


def least_edits(notice, text):
    """Fewest edits between the notice and any part of the text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(notice, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def mutated(rng, text, edits):
    for _ in range(edits):
        at = rng.randrange(len(text))
        text = rng.choice([text[:at] + text[at + 1 :], text[:at] + rng.choice("aexyz ") + text[at:], text[:at] + rng.choice("aexyz") + text[at + 1 :]])
    return text


PIECES = ["MIT", "License", "mit license", "Apache\nLicense,", "GNU General Public License", "the", "éa", "İ", "K", "under", "-", "~", "{", "2.0", "Mit", "license."]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = [" ".join(rng.choices(PIECES, k=rng.randint(0, 12))) for _ in range(300)]
    texts += ["mit license " * 30_000, "x" * 3_000_000, "the mit" * 20_000, "a mit license b " * 3 + "w " * 900_000 + "Apache-License", None, "", "same mit license", "same mit license"]
    return list(enumerate(texts)) + [(None, "null id MIT License")]


def test_base_places_equal_a_plain_scan(documents, rows):
    out = {r.doc_id: r for r in notices.digest(notices.find_notices(documents([(i, t, None, None) for i, t in rows]))).collect()}
    assert len(out) == len(rows)
    for doc_id, text in rows:
        n, want = base(text)
        got = out[doc_id]
        assert (got.n_words, got.n_base) == (n, len(want)), repr((text or "")[:60])
        assert (got.first_word, got.last_word) == ((want[0][0], want[-1][0]) if want else (None, None))
        assert got.base_labels == ",".join(sorted({label for _, label in want}))
        assert set(got.base_labels.split(",")) <= set(got.labels.split(",")) | {""} and 0 <= got.score <= 1
        assert got.score == 1 if want else True


def test_notices_are_found_up_to_their_edits_and_no_further():
    rng = random.Random(11)
    filler = ["ond", "thre", "license", "under", "the", "of", "permitted", "use", "public"]
    seen = set()
    for round_number in range(400):
        chosen = rng.choice(NOTICES)
        part = mutated(rng, chosen.text, rng.randint(0, 5))
        text = " ".join([*rng.choices(filler, k=rng.randint(0, 8)), part, *rng.choices(filler, k=rng.randint(0, 8))])
        folded = " ".join(words(text))
        got = {p.label for p in places_of(text.encode())[1] if not p.base}
        want = {n.label for n in NOTICES if least_edits(n.text, folded) <= n.edits}
        assert got == want, text
        seen.add(chosen.label in want)
    assert seen == {True, False}


def test_pieces_of_long_texts_lose_nothing():
    rng = random.Random(3)
    parts = []
    for _ in range(60):
        parts += rng.choices(["lorem", "é", "mit license", "the"], k=rng.randint(3, 30)) + [mutated(rng, rng.choice(NOTICES).text, rng.randint(0, 2))]
    data = " ".join(parts).encode()
    whole, cut = places_of(data, piece=1 << 20), places_of(data, piece=700)
    assert whole[0] == cut[0]
    assert sorted((p.label, p.first, p.last) for p in whole[1] if p.base) == sorted((p.label, p.first, p.last) for p in cut[1] if p.base)
    key = lambda places: sorted((p.label, p.first, p.last, p.edits) for p in settled(places))
    assert key(whole[1]) == key(cut[1])


def test_spans_point_at_the_words(documents):
    text = "Ünder 😀\nRelesed  under the\tMIT   Licence. Then all rights reserved, or CC BY-NC 4.0: licensed under CC BY-NC 4.0"
    row = notices.find_notices(documents([(1, text, None, None)])).first()
    spans = [(s.label, text[s.start : s.end], s.edits) for s in row.notices]
    assert spans == [("mit-notice", "Relesed  under the\tMIT   Licence", 2), ("reserved", "all rights reserved", 0), ("cc-by-nc-notice", "licensed under CC BY-NC 4.0", 0)]
    assert row.phrases == [] and row.score == 1.0


def test_every_notice_keeps_a_seed_whole():
    for notice in NOTICES:
        assert len(notice.seeds()) == notice.edits + 1 and "".join(s for _, s in notice.seeds()) == notice.text
        assert min(len(s) for _, s in notice.seeds()) >= 7


def test_empty_table_and_own_notices(documents):
    assert notices.find_notices(documents([])).count() == 0
    own = (Notice("house", "property of the house of cards"),)
    row = notices.digest(notices.find_notices(documents([(1, "PROPERTY of the hause of cards", None, None)]), notices=own)).first()
    assert row.labels == "house" and row.base_labels == "" and 0.9 < row.score < 1
