import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trackloom.llm.catalog import tokenizer_path
from trackloom.llm.packing import WordEncoder, pack, pattern_slots, shortest_pack_first


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=20))
@settings(max_examples=60, deadline=None)
def test_patterns_hold_every_piece_once_and_slots_cover_all_ranks(histogram):
    patterns = shortest_pack_first(histogram, 64)
    held = Counter()
    for count, runs in patterns:
        assert sum(length * copies for length, copies in runs) <= 64
        for length, copies in runs:
            held[length] += count * copies
    assert held == Counter(histogram)
    for length, n in histogram.items():
        ranges = sorted((first, end) for size, first, end, *_ in pattern_slots(patterns) if size == length)
        assert ranges[0][0] == 0 and ranges[-1][1] == n and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))


def test_little_padding():
    sizes = Counter(np.random.default_rng(1).integers(1, 2049, 20_000).tolist())
    used = sum(count for count, _ in shortest_pack_first(sizes))
    assert used <= 1.01 * sum(length * n for length, n in sizes.items()) / 2048


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    return lambda t: whole.encode(t, add_special_tokens=False).ids


ODD = [
    "", "  ", "it's I'LL don't <|endoftext|> x", "a\x1cb\x85c   d", "İSTANBUL Σας ΣΑΣ", "é café ½ ² x²y 12.5 ́a", "日本語 テスト🙂👍",
    "___ a_b __init__", "ªº µ × ÷ ÿÿ", "naïve ßß STRASSE", "!'s ''s x'S 's's", "\x00a\x7fb", "tab\tnew\nline\r\nend", "<|ENDOFTEXT|> <|endoftext|>",
]


@pytest.mark.parametrize("text", ODD)
def test_word_ids_are_the_ids_of_the_text(encode, text):
    words = WordEncoder(tokenizer_path())
    assert words.encode(text).tolist() == encode(text) and words.encode(text).tolist() == encode(text)


@given(st.text(max_size=60))
@settings(max_examples=150, deadline=None)
def test_word_ids_of_any_text(encode, text):
    assert WORDS.encode(text).tolist() == encode(text)


WORDS = WordEncoder(tokenizer_path())


def test_a_full_memory_forgets_only_new_words(encode, monkeypatch):
    monkeypatch.setattr("trackloom.llm.packing.REMEMBERED_WORDS", 3)
    words = WordEncoder(tokenizer_path())
    for text in ("one two three four five", "five six one", "four, five! one"):
        assert words.encode(text).tolist() == encode(text)
    assert len(words) == 3


def test_pieces_lie_gapless_and_round_trip(documents, encode):
    texts = {1: "a few words here", 2: None, 3: "", 4: "word " * 5000, 5: "same text", 6: "same text"}
    rows = [(i, t, None, None) for i, t in texts.items()] + [(6, "same text", None, None), (None, "no id", None, None)]
    out = pack(documents(rows), tokenizer_path()).toPandas()
    for _, part in out.sort_values("offset").groupby("sequence_id"):
        assert (part["length"].cumsum() - part["length"]).tolist() == part["offset"].tolist() and part["length"].sum() <= 2048
    for doc_id, text in texts.items():
        ids = np.array([*encode(text or ""), 1], "<u4")
        pieces = out[out["doc_id"] == doc_id].drop_duplicates("start").sort_values("start")
        assert pieces["length"].sum() == len(ids) == pieces["doc_tokens"].iloc[0]
        for p in pieces.itertuples():
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    assert (out["doc_id"] == 6).sum() == 2 and out["doc_id"].isna().sum() == 1
    assert pack(documents([]), tokenizer_path()).count() == 0
