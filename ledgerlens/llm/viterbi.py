"""Token counts of a unigram tokenizer, without making the tokens.

An Aho-Corasick automaton over the vocabulary finds every piece in a pre-token;
for each end position the best score so far and its number of pieces are kept,
for as many positions back as the longest piece has. No path is stored.

The tokenizer is the ``tokenizers`` library's Unigram model over the pieces and
scores of a vocabulary file, with Metaspace pre-tokens (a word with the mark for
the space before it) and byte fallback. Its tie rule is kept: of equal scores the
piece that starts first wins; a character without a piece of its own costs the
least score less ten, and counts as many pieces as it has bytes. Neighbouring unknowns are
one run; the unknown piece's own name in a text is such an unknown, one piece if it stands
alone and its bytes within a longer run.

Pre-tokens repeat, so each worker keeps a bounded memo of their counts.

Rules: null and empty texts have no tokens; repeated rows agree; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column

MARK = "▁"
MEMO_ENTRIES, MEMO_CHARS = 500_000, 64
PIECE_CHARS = 1 << 20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) in the order of their ids."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


def library_tokenizer(vocabulary: list[tuple[str, float]]):
    """The same tokenizer in the library, for comparison."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=MARK, prepend_scheme="always")
    return t


class Counter:
    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        name = vocabulary[0][0]
        self.name_bytes = len(name.encode())
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score, piece == name))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in vocabulary) - 10.0
        longest = max(len(piece) for piece, _ in vocabulary)
        self.mask = (1 << longest.bit_length()) - 1  # positions kept: a power of two beyond the longest piece
        self.memo: dict[str, tuple[int, float]] = {}

    def word(self, word: str) -> tuple[int, float]:
        """(pieces, score) of the best segmentation of a pre-token."""
        mask, unknown = self.mask, self.unknown
        best, count, run = [0.0] * (mask + 1), [0] * (mask + 1), [0] * (mask + 1)
        name = self.name_bytes
        done = 0  # positions whose best is known
        # Of position done + 1. kind: 0 ends in a piece, 1 in the unknown piece's name alone, 2 in another run of unknowns.
        top, n, kind, single = None, 0, 0, False

        def close() -> None:
            nonlocal done, top, n, kind, single
            if not single:
                at = done & mask
                s = best[at] + unknown
                if top is None or s > top:
                    top, n, kind = s, count[at] + len(word[done].encode("utf-8", "surrogatepass")) + (name - 1 if run[at] == 1 else 0), 2
            done += 1
            at = done & mask
            best[at], count[at], run[at] = top, n, kind
            top, n, kind, single = None, 0, 0, False

        for end, (length, score, is_name) in self.automaton.iter(word):
            while done < end:
                close()
            start = end + 1 - length  # longer pieces come first
            s = score + best[start & mask]
            if top is None or s > top:
                top, n, kind = s, count[start & mask] + 1, 0
                if is_name:
                    before = run[start & mask]
                    n += (0, 2 * name - 2, name - 1)[before]
                    kind = 2 if before else 1
            single |= length == 1
        while done < len(word):
            close()
        return count[done & mask], best[done & mask]

    def text(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        total, score = 0, 0.0
        at = 0
        first = True
        while at < len(text):  # a very long text goes piece by piece, cut before a space
            to = len(text)
            if to - at > PIECE_CHARS:
                hits = [i for i in (text.find(" ", at + PIECE_CHARS), text.find(MARK, at + PIECE_CHARS)) if i > 0]
                to = min(hits, default=to)
            words = text[at:to].replace(MARK, " ").split(" ")
            if not words[0] and (not first or len(words) > 1):
                del words[0]  # the text begins with its own mark
            at, first = to, False
            got = list(map(self.memo.get, words))
            if None in got:
                if len(self.memo) > MEMO_ENTRIES:
                    self.memo.clear()
                for i, known in enumerate(got):
                    if known is None:
                        got[i] = self.word(MARK + words[i])
                        if len(words[i]) <= MEMO_CHARS:
                            self.memo[words[i]] = got[i]
            total += sum(g[0] for g in got)
            score += sum(g[1] for g in got)
        return total, score


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(read_vocabulary(path))
    return _counters[path]


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_chars, n_tokens and the segmentations' total score of every row."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            chars, got = [], []
            for t in column(b, "text"):
                text = t.as_py() or ""
                chars.append(len(text))
                got.append(c.text(text))
            yield pa.RecordBatch.from_arrays(
                [column(b, "doc_id"), pa.array(chars, pa.int64()), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.float64())],
                names=["doc_id", "n_chars", "n_tokens", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_chars long, n_tokens long, score double")
