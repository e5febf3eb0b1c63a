"""Word hashing and the encoder against plain Python and the library."""
import random
import re

import numpy as np
import pyarrow as pa

from ledgerlens.llm import bpe
from ledgerlens.llm.common import text_slices
from ledgerlens.llm.words import shingle_hashes, word_bounds, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_words_and_shingles_equal_exactly_where_texts_do(monkeypatch):
    from ledgerlens.llm import words
    monkeypatch.setattr(words, "_SEG", 64)  # many segments
    r = random.Random(5)
    texts = ["".join(r.choice("ab Aé\n\t中") for _ in range(r.randint(0, 90))) for _ in range(200)] + [None, "", "  ", "x" * 500]
    seen, back = {}, {}
    for rows, data, off in text_slices(pa.RecordBatch.from_pydict({"text": texts})):
        s, e, wo = word_bounds(data, off)
        h = word_hashes(data, s, e)
        win, so = shingle_hashes(h, wo, 3)
        for i, t in enumerate(rows.column(0).to_pylist()):
            plain = WORD.findall(t or "")
            assert wo[i + 1] - wo[i] == len(plain)
            grams = [tuple(plain[j:j + 3]) for j in range(max(1, len(plain) - 2))] if plain else []
            assert so[i + 1] - so[i] == len(grams)
            for key, value in [*zip(plain, h[wo[i]:wo[i + 1]].tolist()), *zip(grams, win[so[i]:so[i + 1]].tolist())]:
                assert seen.setdefault(key, value) == value and back.setdefault(value, key) == key


def test_lower_case_concerns_ascii_only():
    def one(text, lower):
        data = np.frombuffer(text.encode(), np.uint8)
        s, e, _ = word_bounds(data, np.array([0, len(data)]))
        return word_hashes(data, s, e, lower).tolist()

    assert one("ABC é", True) == one("abc é", True)
    assert one("É", True) != one("é", True)


def test_encoder_equals_the_library(monkeypatch):
    r = random.Random(1)
    alphabet = "ab 'sé\n\t  \x1c\x85  中😀1.,\0\xad²ªß|"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 16))) for _ in range(4000)]
    texts += ["x <|endoftext|> y", "", " ", "I'll we've don't", "a" * 300]
    every = "".join(chr(c) for c in range(0x20, 0x250)) + " ".join(chr(c) for c in range(0x20, 0x250))
    enc = bpe.Encoder(bpe.default_vocabulary())
    for _ in range(2):  # cold and warm memo
        for t, got in zip([*texts, every], enc.encode([*texts, every])):
            assert got == enc.library(t), repr(t)
    monkeypatch.setattr(bpe, "PIECE_CHARS", 7)
    big = " ".join(t for t in texts if "<|" not in t)
    parts = list(bpe.pieces(big, 7))
    assert "".join(parts) == big and len(parts) > 100
    assert b"".join(enc.encode(parts)) == enc.library(big) == enc.encode([big])[0]
