"""Ids and decoded texts against the sentencepiece library."""
import hashlib
import random

import pytest
from llm_fixtures import edge, edge_rows, empty, sf  # noqa: F401

from ledgerlens.llm import prefix_table


@pytest.fixture(scope="module")
def table():
    return prefix_table.PrefixTable(prefix_table.default_vocabulary())


def expected(table, rows):
    out = []
    for doc_id, text in rows:
        ids = [*table.library.encode(text or ""), 2]
        out.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                    hashlib.sha256(table.library.decode(ids).encode()).hexdigest()))
    return sorted(out, key=str)


def test_awkward_rows(table, edge, edge_rows):
    got = sorted(map(tuple, prefix_table.round_trip(edge).collect()), key=str)
    assert got == expected(table, [(r[0], r[1]) for r in edge_rows])


def test_whole_documents(table, spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted(map(tuple, prefix_table.round_trip(docs).collect()), key=str)
    assert got == expected(table, [(r.doc_id, r.text) for r in docs.collect()])


def test_empty_table(empty):
    assert prefix_table.round_trip(empty).collect() == [] and prefix_table.encoded(empty).collect() == []


def test_ids_come_back(table, edge, edge_rows):
    texts = {r[0]: r[1] or "" for r in edge_rows if r[0] in (6, 9, 11, 14)}
    for r in prefix_table.encoded(edge, end_id=None).collect():
        if r.doc_id in (9, 11, 14):
            assert r.ids == table.library.encode(texts[r.doc_id]) and table.decode(r.ids) == texts[r.doc_id].replace("▁", " ")


PARTS = [" ", "▁", "a", "b", "e", "th", "the", "ing", "\n", "\t", "é", "中", "文", "字", "😀", "́", "0", "12", "ß", "\x00", "<s>", "</s>", "<unk>",
         "<0x0A>", "  ", "    ", "A", "ó", "я", "при", "the ", "한", "어", "️", "﻿"]


@pytest.mark.parametrize("seed", range(4))
def test_random_texts(table, seed):
    r = random.Random(seed)
    for _ in range(400):
        text = "".join(r.choice(PARTS) for _ in range(r.randint(0, 60)))
        assert table.encode(text) == table.library.encode(text)
    for _ in range(60):
        text = "".join(chr(r.choice([r.randint(1, 0xD7FF), r.randint(0xE000, 0x10FFFF), r.randint(32, 126)])) for _ in range(120))
        assert table.encode(text) == table.library.encode(text)


@pytest.mark.parametrize("unit", [" ", "a", "▁", "=", "-", "\n", "中", "ab", " a", "the"])
def test_repeated_characters(table, unit):
    """Ties between equal scores (runs of spaces) and long parts without a cut."""
    for n in [*range(1, 70), 1000]:
        assert table.encode(unit * n) == table.library.encode(unit * n)


def test_long_texts_are_cut_where_nothing_merges(table, monkeypatch):
    monkeypatch.setattr(prefix_table, "PIECE_CHARS", 7)
    monkeypatch.setattr(prefix_table, "DIGEST_IDS", 5)
    text = "  one two   three" * 30 + "x" * 100 + " é 中文"
    ids = table.encode(text)
    assert ids == table.library.encode(text)
    assert prefix_table.ids_digest(ids) == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_small_memos(table, monkeypatch):
    monkeypatch.setattr(prefix_table, "MEMO_WORDS", 3)
    monkeypatch.setattr(prefix_table, "MEMO_PAIRS", 5)
    t = prefix_table.PrefixTable(prefix_table.default_vocabulary())
    text = "several different words in a row, some different words again"
    assert t.encode(text) == table.library.encode(text) and t.n_pairs <= 5


def test_pairs_have_one_answer(table):
    """Exactly one piece that ends at a place fits what stands before it."""
    text = "▁reinterpretations"
    last = [None]
    for end in range(1, len(text) + 1):
        fit = []
        for start in range(end):
            t = table.number.get(text[start:end])
            if t is not None and (table.fits(last[start], t) if start else table.is_token(t)):
                fit.append(t)
        assert len(fit) == 1
        last.append(fit[0])
