import hashlib
import random
import re

import pytest

from trackloom.llm import infilling
from trackloom.llm.infilling import Container, emit, rebuild, split_parts

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_way(doc_id, text):
    """The contract, over the whole text in memory."""
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, sha(text), sha(text), text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, None)))
    form = "spm" if h4 % 100 < 20 else "psm"
    output = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return len(units), form, len(prefix), len(middle), sha(output), sha(text), output


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    pieces = ["ab", "Zed", " ", "\n", "é", "😀", "<", ">", "P", "<S", "S>", "İ", "123", "", "\x00", "K"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 30))) for _ in range(400)]
    texts += ["a" * 300_000, "word " * 60_000, "é" * 150_000, "x<M>y", "<P>", None, "", "same", "same"]
    return list(enumerate(texts)) + [(None, "null id text")]


@pytest.fixture(scope="module")
def frames(documents, rows):
    return infilling.store_frames(documents([(i, t, None, None) for i, t in rows]))


def test_digests_equal_the_plain_way(frames, rows):
    out = {r.doc_id: r for r in infilling.digests(frames).collect()}
    assert len(out) == len(rows)
    for doc_id, text in rows:
        got = out[doc_id]
        assert (got.n, got.form, got.prefix_chars, got.middle_chars, got.output_sha256, got.restored_sha256) == plain_way(doc_id, text)[:6], repr((text or "")[:50])
    assert {r.form for r in out.values()} == {"plain", "psm", "spm"}


def test_outputs_and_restored_texts(frames, rows):
    made = infilling.outputs(frames)
    out = {r.doc_id: r.output for r in made.collect()}
    back = {r.doc_id: r.text for r in infilling.restore(made).collect()}
    for doc_id, text in rows:
        assert out[doc_id] == plain_way(doc_id, text)[6] and back[doc_id] == (text or "")


def test_frames_of_any_size_give_the_same_places():
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choices(["abc", "d", " ", "é", "\n", "Zz"], k=rng.randint(0, 60)))
        units = UNIT.findall(text)
        container = Container.of(text, rng.randint(1, 9))
        assert container.units[-1] == len(units) and container.chars[-1] == len(text)
        assert [container.place(i) for i in range(len(units) + 1)] == [len("".join(units[:i])) for i in range(len(units) + 1)]
        a, b = sorted(rng.randint(0, len(text)) for _ in range(2))
        assert "".join(container.stream(a, b)) == text[a:b]
        for form in ("psm", "spm", "plain"):
            assert "".join(rebuild(emit(container, form, (a, b)), form)) == text


def test_a_cut_opens_one_frame(monkeypatch):
    container, opened = Container.of("word " * 1000, 50), []
    plain = Container.frame
    monkeypatch.setattr(Container, "frame", lambda self, number: opened.append(number) or plain(self, number))
    # 777 units: 388 words with their blanks, and one word more
    assert container.place(777) == 388 * 5 + 4 and len(opened) == 1


def test_marks_across_pieces_and_missing_marks():
    output = "<P>a<<S>bc<M><"
    want = {0: "a<", 2: "bc", 1: "<"}
    for size in range(1, 8):
        pieces, got = [output[i : i + size] for i in range(0, len(output), size)], {0: "", 1: "", 2: ""}
        for part, text in split_parts(pieces, "psm"):
            got[part] += text
        assert got == want
        assert "".join(rebuild(pieces, "psm")) == "a<<bc"
    with pytest.raises(ValueError):
        list(split_parts(["<P>abc"], "psm"))


def test_empty_table(documents):
    frames = infilling.store_frames(documents([]))
    assert infilling.digests(frames).count() == 0 and infilling.restore(infilling.outputs(frames)).count() == 0
