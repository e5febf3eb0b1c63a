"""Byte-level BPE ids by the ``tokenizers`` library, with a memo of pre-tokens.

The vocabulary's pre-tokenizer cuts a text into pre-tokens that are encoded one
by one, and the same ones come again and again. Each Python worker keeps a
bounded memo pre-token -> ids; new ones go to the library, many in one call.
Plain Latin text is cut here by the vocabulary's own pattern; a text with other
characters is split where a space precedes a plain visible character (there a
pre-token always begins), and its unusual parts go to the library as they are.
Texts that hold the string of a special token go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np

#: Letters, numbers and visible characters of plain text (Basic Latin to Latin Extended-B).
_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_VISIBLE = "\x21-\x7e\xa1-\xac\xae-ɏ"
#: Fixed value: the vocabulary's pre-tokenizer pattern, with its classes written out for plain text.
PRE_TOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
_PLAIN = re.compile(rf"[{_VISIBLE} \n\r\t]*")
_SAFE_SPLIT = re.compile(rf" (?=[{_VISIBLE}])")
MEMO_ENTRIES = 900_000
MEMO_CHARS = 48
PIECE_CHARS = 1 << 20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Cut a very long text where a pre-token surely begins, so that memory stays bounded."""
    at = 0
    while len(text) - at > size and (m := _SAFE_SPLIT.search(text, at + size)):
        yield text[at:m.start()]
        at = m.start()
    yield text[at:] if at else text


_UNKNOWN = b""


class _Memo(dict):
    """pre-token -> ids; what is looked up in vain is noted in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        self.new[word] = _UNKNOWN
        return _UNKNOWN


class Encoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit integers in bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, models

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["merges"]]
        # The same model without the library's own cache: what comes here was not seen before.
        self.bare = Tokenizer(models.BPE(vocab=spec["vocab"], merges=merges, cache_capacity=0))
        self.chars = _byte_chars()
        self.size = np.zeros(max(spec["vocab"].values()) + 1, np.int64)
        for token, i in spec["vocab"].items():
            self.size[i] = len(token)
        self.memo = _Memo()
        self.seen = self.missed = 0

    def library(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | list] = []
        holes: list[tuple[int, int, str]] = []
        get, new = self.memo.__getitem__, self.memo.new
        for text in texts:
            if not text:
                out.append(b"")
                continue
            if any(s in text for s in self.special):
                out.append(self.library(text))
                continue
            words: list[str] = []
            for piece in pieces(text):
                words += PRE_TOKEN.findall(piece) if _PLAIN.fullmatch(piece) else self._mixed(piece)
            got = list(map(get, words))
            self.seen += len(words)
            gaps = [i for i, ids in enumerate(got) if ids is _UNKNOWN] if new else []
            holes += [(len(out), i, words[i]) for i in gaps]
            out.append(got if gaps else b"".join(got))
        if new:
            self._learn(new)
            for k, i, word in holes:
                out[k][i] = new[word]
            out = [b"".join(x) if type(x) is list else x for x in out]
            self._keep(new)
        return out

    def _mixed(self, text: str) -> list[str]:
        """Pre-tokens of the plain parts; each unusual part stays whole (the library cuts it)."""
        cuts = [0, *(m.start() for m in _SAFE_SPLIT.finditer(text)), len(text)]
        words: list[str] = []
        for a, b in zip(cuts, cuts[1:]):
            if part := text[a:b]:
                words += PRE_TOKEN.findall(part) if _PLAIN.fullmatch(part) else [part]
        return words

    def _learn(self, new: dict[str, bytes]) -> None:
        """Ids of new pre-tokens, in one call; a word's ids cover exactly its bytes, which tells where it ends."""
        plain = [w for w in new if _PLAIN.fullmatch(w)]
        for word in new.keys() - set(plain):
            new[word] = self.library(word)
        if not plain:
            return
        mapped = "\0".join(plain).encode().decode("latin-1").translate(self.chars).split(self.chars[0])
        ids = np.asarray(self.bare.encode_batch_fast([mapped], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
        ends = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum([len(w) for w in mapped])) + 1
        raw, a = ids.tobytes(), 0
        for word, b in zip(plain, (ends * 4).tolist()):
            new[word] = raw[a:b]
            a = b

    def _keep(self, new: dict[str, bytes]) -> None:
        """Keep the memo bounded: it fills up once and stays while it serves; when the text has changed it begins anew."""
        self.missed += len(new)
        if len(self.memo) < MEMO_ENTRIES:
            self.memo.update((w, v) for w, v in new.items() if len(w) <= MEMO_CHARS)
        elif self.seen > 2_000_000:
            if self.missed > 0.25 * self.seen:
                self.memo.clear()
            self.seen = self.missed = 0
        new.clear()


def _byte_chars() -> dict[int, str]:
    """Byte -> character of byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary; kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget() -> None:
    """Give back the worker's encoders; called where a worker goes on to work that needs its memory."""
    _encoders.clear()
