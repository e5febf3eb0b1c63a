"""SentencePiece BPE ids by a table of each prefix's last token.

Every prefix of a text has one encoding, so one last token. A piece t that ends
at position i is the last token of that prefix exactly if merging the two pieces
(last token before t, t) alone gives these two back: merges inside a piece do not
depend on its neighbours, so a sequence whose neighbours all fit together is what
the merges make of the whole. An Aho-Corasick automaton lists the pieces ending at
each position, the pair test keeps the one that fits, and the ids are read from
the end of the text backwards. Pairs are tested by their merges once a worker and
remembered (a bounded memo).

Two characters that stand beside each other in no piece are never merged; there a
text may be cut. Words (the mark of a space with what follows) are such parts where
no piece holds a mark behind another character; a bounded memo keeps their ids. Long
words, and those with characters without a piece, are cut further at such pairs.

The merge order is the library's: the highest score, of equal scores the leftmost
pair. A character without a piece becomes its UTF-8 bytes' pieces.

Only models of merges (BPE) with byte pieces, a space put in front and no other
change of the text are accepted; pieces that the model's maker declared as
indivisible (user-defined) are not known to this table.

Rules: null and empty texts have no ids but the end id; spaces and marks are kept as
they are (both decode to a space); special names in a text are ordinary text; rows
without or with a repeated doc_id are rows like all others; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column

MARK = "▁"
MEMO_WORDS, MEMO_CHARS = 400_000, 48
MEMO_PAIRS = 1_000_000
#: Characters of a text that are cut into words at a time.
PIECE_CHARS = 1 << 20
#: Ids whose text is made at a time.
DIGEST_IDS = 1 << 20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PrefixTable:
    """``encode(text)`` gives the ids without an end id, ``decode(ids)`` the text."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.normalize("Ａ  b ") != f"{MARK}Ａ{MARK}{MARK}b{MARK}":
            raise ValueError("the model changes texts beyond the mark for spaces")
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(sp.is_byte(i) for i in self.bytes):
            raise ValueError("the model has no byte pieces")
        self.pieces: list[str] = []  # by number: a piece's own id, beyond the vocabulary characters without a piece
        self.score: dict[str, float] = {}
        self.number: dict[str, int] = {}
        for i in range(sp.get_piece_size()):
            self.pieces.append(sp.id_to_piece(i))
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
                self.score[self.pieces[i]] = sp.get_score(i)
                self.number[self.pieces[i]] = i
        for c in sorted({c for p in self.score for c in p} - self.number.keys()):
            self.number[c] = len(self.pieces)
            self.pieces.append(c)
        self.size = [len(p) for p in self.pieces]
        self.n_numbers = len(self.pieces)
        self.n_ids = sp.get_piece_size()
        self.steps: list[list | None] = [None] * self.n_numbers
        # Pieces that their own merges do not make are no token of any text.
        self.automaton = ahocorasick.Automaton()
        for p, t in self.number.items():
            if self.is_token(t):
                self.automaton.add_word(p, (t, len(p)))
        self.automaton.make_automaton()
        self.beside = {a + b for p in self.score for a, b in zip(p, p[1:])}
        inside = any(b == MARK != a for a, b in self.beside)
        self.words = re.compile(r"(?s).+" if inside else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.cuttable = not inside
        self.pairs: list[dict[int, bool]] = [{} for _ in self.pieces]  # piece -> piece behind it -> whether they stay cut
        self.n_pairs = 0
        self.memo: dict[str, list[int]] = {}

    # -- the pair test

    def merges(self, t: int) -> list[tuple[float, str, str]]:
        """The merges that a piece's characters go through: (score, last symbol then, first symbol then)."""
        done = self.steps[t]
        if done is None:
            symbols, score = list(self.pieces[t]), self.score
            done = []
            while len(symbols) > 1:
                best, at = None, 0
                for i in range(len(symbols) - 1):
                    s = score.get(symbols[i] + symbols[i + 1])
                    if s is not None and (best is None or s > best):
                        best, at = s, i
                if best is None:
                    break
                symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
                done.append((best, symbols[-1], symbols[0]))
            self.steps[t] = done
        return done

    def is_token(self, t: int) -> bool:
        """Whether a piece's own merges make it."""
        return len(self.merges(t)) == self.size[t] - 1

    def stays_cut(self, left: int, right: int) -> bool:
        """Whether no merge of the two pieces' characters crosses their border.

        The merges on each side follow each other as if it stood alone; the pair at the border is merged as soon
        as it has the best score (of equal ones the leftmost pair goes first)."""
        a, b, score = self.merges(left), self.merges(right), self.score
        i = j = 0
        x, y = self.pieces[left][-1], self.pieces[right][0]
        while True:
            cross = score.get(x + y)
            while True:
                s, t = a[i][0] if i < len(a) else None, b[j][0] if j < len(b) else None
                if cross is not None and (s is None or cross > s) and (t is None or cross >= t):
                    return False
                if s is not None and (t is None or s >= t):
                    now, i = a[i][1], i + 1
                    if now != x:
                        x = now
                        break
                elif t is not None:
                    now, j = b[j][2], j + 1
                    if now != y:
                        y = now
                        break
                else:
                    return True

    def fits(self, before: int, t: int) -> bool:
        known = self.stays_cut(before, t)
        if self.n_pairs >= MEMO_PAIRS:
            for row in self.pairs:
                row.clear()
            self.n_pairs = 0
        self.pairs[before][t] = known
        self.n_pairs += 1
        return known

    # -- texts

    def part(self, text: str) -> list[int] | None:
        """Numbers of the tokens of a text; None if a character has no number."""
        last = [-1] * len(text)  # by the place of the prefix's last character
        pairs, done = self.pairs, -1
        for end, (t, size) in self.automaton.iter(text):
            if end == done:  # the longest pieces come first
                continue
            if end >= size:
                before = last[end - size]
                if before < 0:
                    return None
                known = pairs[before].get(t)
                if known is None:
                    known = self.fits(before, t)
                if not known:
                    continue
            last[end] = t
            done = end
        out, at, size_of = [], len(text) - 1, self.size
        while at >= 0:
            t = last[at]
            if t < 0:
                return None
            out.append(t)
            at -= size_of[t]
        out.reverse()
        return out

    def word(self, word: str) -> list[int]:
        """Ids of a word, cut where two characters never merge."""
        if len(word) <= MEMO_CHARS:
            numbers = self.part(word)
            if numbers is not None:
                return self.ids(numbers)
        beside = self.beside
        cuts = [i for i in range(1, len(word)) if word[i - 1:i + 1] not in beside]
        out: list[int] = []
        for a, b in zip([0, *cuts], [*cuts, len(word)]):
            if b - a > 1:
                out += self.ids(self.part(word[a:b]))
            else:
                t = self.number.get(word[a], self.n_ids)
                out += [t] if t < self.n_ids else [self.bytes[x] for x in word[a].encode()]
        return out

    def ids(self, numbers: list[int]) -> list[int]:
        """Numbers beyond the vocabulary become their bytes' ids."""
        if self.n_numbers == self.n_ids:
            return numbers
        out: list[int] = []
        for t in numbers:
            out += [t] if t < self.n_ids else [self.bytes[x] for x in self.pieces[t].encode()]
        return out

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        out: list[list[int]] = []
        memo = self.memo
        for part in self.cut(MARK + text.replace(" ", MARK)):
            words = self.words.findall(part)
            got = list(map(memo.get, words))
            if None in got:
                if len(memo) > MEMO_WORDS:
                    memo.clear()
                for i, ids in enumerate(got):
                    if ids is None:
                        ids = memo.get(words[i])
                        if ids is None:
                            ids = self.word(words[i])
                            if len(words[i]) <= MEMO_CHARS:
                                memo[words[i]] = ids
                        got[i] = ids
            out += got
        return list(chain.from_iterable(out))

    def cut(self, text: str) -> Iterator[str]:
        """Long texts go part by part, cut in front of a mark that follows another character."""
        at = 0
        while self.cuttable and len(text) - at > PIECE_CHARS:
            to = text.find(MARK, at + PIECE_CHARS)
            while to > 0 and text[to - 1] == MARK:
                to = text.find(MARK, to + 1)
            if to < 0:
                break
            yield text[at:to]
            at = to
        yield text[at:]

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


_tables: dict[str, PrefixTable] = {}


def table(path: str) -> PrefixTable:
    """The worker's table for a vocabulary; kept between tasks."""
    if path not in _tables:
        _tables[path] = PrefixTable(path)
    return _tables[path]


_DECIMAL: list[str] = []


def ids_digest(ids: list[int]) -> str:
    """SHA-256 of the decimal ids joined by one space."""
    if len(_DECIMAL) <= max(ids, default=0):
        _DECIMAL.extend(map(str, range(len(_DECIMAL), max(ids) + 1)))
    name = _DECIMAL.__getitem__
    h = hashlib.sha256()
    for a in range(0, len(ids), DIGEST_IDS):
        h.update(((" " if a else "") + " ".join(map(name, ids[a:a + DIGEST_IDS]))).encode())
    return h.hexdigest()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("string").alias("text"))


def encoded(docs: DataFrame, vocabulary: str | None = None, end_id: int | None = 2) -> DataFrame:
    """doc_id and the ids of every row, with an end id unless that is None."""
    path = vocabulary or default_vocabulary()
    end = [] if end_id is None else [end_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table(path)
        for b in batches:
            for i in range(0, len(b), 64):
                rows = b.slice(i, 64)
                ids = [t.encode(x.as_py() or "") + end for x in column(rows, "text")]
                yield pa.RecordBatch.from_arrays([column(rows, "doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _texts(docs).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def round_trip(docs: DataFrame, vocabulary: str | None = None, end_id: int = 2) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text encoded with an end id and decoded again."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table(path)
        for b in batches:
            counts, digests, texts = [], [], []
            for x in column(b, "text"):
                ids = t.encode(x.as_py() or "")
                ids.append(end_id)
                counts.append(len(ids))
                digests.append(ids_digest(ids))
                texts.append(hashlib.sha256(t.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [column(b, "doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs).mapInArrow(
        run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")
