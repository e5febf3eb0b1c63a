"""A minimal acyclic automaton over sorted byte strings that numbers them.

Built from strictly ascending terms: equal states are merged as soon as no later
term can change them. Every transition carries how many terms come before those
behind it, so the sum along a path is the term's lexicographic ordinal, and the
way back, from an ordinal to its term, follows the same numbers.

A state's transitions are a 256-bit set of bytes; the place of a transition is the
state's first place plus the number of smaller bytes, so ``ordinals`` walks many
terms at once, one byte a step, with a few array reads each.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable

import numpy as np

from .words import U

_HEAD = struct.Struct("<4sQQQ")
MAGIC = b"MAT1"


class Transducer:
    def __init__(self, bits: np.ndarray, first: np.ndarray, target: np.ndarray, before: np.ndarray, final: np.ndarray, n_terms: int):
        self.bits, self.first, self.target, self.before, self.final, self.n_terms = bits, first, target, before, final, n_terms
        self.root = len(final) - 1

    # -- building

    @classmethod
    def build(cls, terms: Iterable[bytes]) -> Transducer:
        """From terms in strictly ascending order."""
        register: dict[tuple, int] = {}
        labels: list[bytes] = []
        targets: list[tuple[int, ...]] = []
        final: list[bool] = []
        path: list[list] = [[False, bytearray(), []]]  # the states that a later term may still change

        def close(depth: int) -> None:
            while len(path) - 1 > depth:
                ends, out, to = path.pop()
                key = (ends, bytes(out), tuple(to))
                state = register.get(key)
                if state is None:
                    state = register[key] = len(final)
                    final.append(ends)
                    labels.append(key[1])
                    targets.append(key[2])
                path[-1][2].append(state)

        last: bytes | None = None
        n_terms = 0
        for term in terms:
            if last is not None and term <= last:
                raise ValueError("terms must ascend")
            same = 0
            if last is not None:
                limit = min(len(last), len(term))
                while same < limit and last[same] == term[same]:
                    same += 1
            close(same)
            for c in term[same:]:
                path[-1][1].append(c)
                path.append([False, bytearray(), []])
            path[-1][0] = True
            last = term
            n_terms += 1
        close(0)
        ends, out, to = path[0]
        final.append(ends)
        labels.append(bytes(out))
        targets.append(tuple(to))
        return cls._layout(labels, targets, final, n_terms)

    @classmethod
    def _layout(cls, labels: list[bytes], targets: list[tuple[int, ...]], final: list[bool], n_terms: int) -> Transducer:
        n = len(final)
        size = np.array([len(x) for x in labels], np.int64)
        start = np.concatenate(([0], np.cumsum(size)))
        byte = np.frombuffer(b"".join(labels), np.uint8)
        target = np.array([t for ts in targets for t in ts], np.int32)
        state = np.repeat(np.arange(n), size)
        bits = np.zeros((n, 4), np.uint64)
        np.bitwise_or.at(bits, (state, byte >> 6), U(1) << (byte & 63).astype(np.uint64))
        ones = np.bitwise_count(bits).astype(np.int64)
        first = (start[:-1, None] + np.cumsum(ones, axis=1) - ones).astype(np.int32)
        # Terms behind each state: targets have smaller numbers than their states.
        behind = np.zeros(n, np.int64)
        before = np.zeros(len(target), np.int64)
        for s in range(n):
            got = int(final[s])
            for k in range(start[s], start[s + 1]):
                before[k] = got
                got += int(behind[target[k]])
            behind[s] = got
        return cls(bits, first, target, before.astype(np.int32), np.array(final, bool), n_terms)

    # -- as bytes

    def to_bytes(self) -> bytes:
        return _HEAD.pack(MAGIC, len(self.final), len(self.target), self.n_terms) + b"".join(
            x.tobytes() for x in (self.bits, self.first, self.target, self.before, self.final))

    @classmethod
    def from_bytes(cls, raw: bytes) -> Transducer:
        magic, n, m, n_terms = _HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a transducer")
        at, parts = _HEAD.size, []
        for kind, k in ((np.uint64, 4 * n), (np.int32, 4 * n), (np.int32, m), (np.int32, m), (bool, n)):
            parts.append(np.frombuffer(raw, kind, k, at))
            at += parts[-1].nbytes
        return cls(parts[0].reshape(n, 4), parts[1].reshape(n, 4), *parts[2:], n_terms)

    # -- reading

    def ordinals(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The ordinal of each term ``data[start:end]``, -1 for what is no term."""
        out = np.full(len(starts), -1, np.int64)
        act = np.arange(len(starts))
        at, end = starts.astype(np.int64), ends.astype(np.int64)
        state = np.full(len(starts), self.root, np.int64)
        number = np.zeros(len(starts), np.int64)
        bits, first = self.bits.reshape(-1), self.first.reshape(-1)
        while len(act):
            done = at == end
            if done.any():
                hit = done & self.final[state]
                out[act[hit]] = number[hit]
                go = ~done
                act, at, end, state, number = act[go], at[go], end[go], state[go], number[go]
                if not len(act):
                    break
            byte = data[at]
            cell = state * 4 + (byte >> 6)
            word = bits[cell]
            low = (byte & 63).astype(np.uint64)
            known = (word >> low) & U(1) != 0
            if not known.all():
                act, at, end, number = act[known], at[known], end[known], number[known]
                cell, word, low = cell[known], word[known], low[known]
            k = first[cell] + np.bitwise_count(word & ((U(1) << low) - U(1)))
            number = number + self.before[k]
            state = self.target[k].astype(np.int64)
            at = at + 1
        return out

    def term(self, ordinal: int) -> bytes:
        """The term with this ordinal."""
        if not 0 <= ordinal < self.n_terms:
            raise IndexError(ordinal)
        out = bytearray()
        state = self.root
        while True:
            if self.final[state] and ordinal == 0:
                return bytes(out)
            bytes_of = [b for b in range(256) if int(self.bits[state, b >> 6]) >> (b & 63) & 1]
            a = int(self.first[state, 0])
            k = a + int(np.searchsorted(self.before[a:a + len(bytes_of)], ordinal, "right")) - 1
            out.append(bytes_of[k - a])
            ordinal -= int(self.before[k])
            state = int(self.target[k])
