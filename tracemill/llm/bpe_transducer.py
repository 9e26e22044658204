"""Byte-pair merges as a lazily determinised transducer over bytes.

A merge table fixes, for every prefix of a word, the last token of that prefix's
encoding: the one vocabulary entry that ends there and stays next to the token
before it when the two are merged together. A state is the last emitted token
and the bytes read since. Reading a byte finds that last token, then
emits every token that all continuations agree on: only starts from
which the unread text could still complete a longer vocabulary entry keep
tokens back, so lookahead is bounded by the longest entry. States and
transitions are made when first needed and forgotten when there are too many.
"""

from __future__ import annotations

import base64

import numpy as np

_BYTES = [bytes((k,)) for k in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Transducer:
    def __init__(self, ranks: dict[bytes, int], most_states: int = 250_000):
        self.ranks, self.most_states = ranks, most_states
        self.token_bytes = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.prefixes = {token[:k] for token in ranks for k in range(1, len(token))}
        self.adjacent: dict[int, bool] = {}
        self.split: dict[int, tuple[int, int] | None] = {}
        self.reset()

    def reset(self) -> None:
        self.ids: dict[tuple[int, bytes], int] = {}
        #: last emitted token, bytes held, last token of each held prefix, and its token bounds as bits
        self.states: list[tuple[int, bytes, tuple[int, ...], tuple[int, ...]]] = []
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.ends: dict[int, tuple[int, ...]] = {}
        self.state(-1, b"", (), (1,))

    def state(self, before: int, held: bytes, last: tuple[int, ...], bounds: tuple[int, ...]) -> int:
        key = (before, held)
        found = self.ids.get(key)
        if found is None:
            found = self.ids[key] = len(self.states)
            self.states.append((before, held, last, bounds))
        return found

    def merged(self, parts: list[bytes], below: int = 1 << 60) -> list[bytes]:
        """Merge neighbours in order of rank, leftmost first, while a rank is under `below`."""
        ranks = self.ranks
        while len(parts) > 1:
            best, at = min((ranks.get(parts[k] + parts[k + 1], 1 << 60), k) for k in range(len(parts) - 1))
            if best >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens of the last merge that makes `token`; None for a byte or a token that merges never make."""
        if token not in self.split:
            held = self.token_bytes[token]
            parts = self.merged([held[k : k + 1] for k in range(len(held))], token)
            self.split[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.split[token]

    def stays(self, left: int, right: int) -> bool:
        """Whether `right` may follow `left` (-1: the start) in an encoding.

        Undoes merges on both sides of the bound, latest first, and looks for a merge
        across it that would have come before the one undone.
        """
        if self.halves(right) is None and len(self.token_bytes[right]) > 1:
            return False
        if left < 0:
            return True
        key = left << 32 | right
        found = self.adjacent.get(key)
        if found is None:
            found = self.adjacent[key] = self._stays(left, right)
        return found

    def _stays(self, left: int, right: int) -> bool:
        ranks, text = self.ranks, self.token_bytes
        bound = 1 << 60  # merges across the bound that rank under this come first
        while True:
            if ranks.get(text[left] + text[right], 1 << 60) < bound:
                return False
            a, b = self.halves(left), self.halves(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                bound, left = left, a[1]
            else:
                bound, right = right + 1, b[0]

    def move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        before, held, last, bounds = self.states[state]
        held += _BYTES[byte]
        n = len(held)
        ranks, prefixes = self.ranks, self.prefixes
        for start in range(max(0, n - self.longest), n):
            token = ranks.get(held[start:])
            if token is not None and self.stays(last[start - 1] if start else before, token):
                break
        else:
            raise ValueError("the vocabulary lacks a single byte")
        last += (token,)
        shared = bounds[start] | 1 << n
        bounds += (shared,)
        for start in range(max(0, n - self.longest), n):
            if held[start:] in prefixes:  # a longer token may begin here
                shared &= bounds[start]
                if shared == 1:
                    found = self.moves[state << 8 | byte] = (self.state(before, held, last, bounds), ())
                    return found
        cut = shared.bit_length() - 1
        out, at = [], cut
        while at:
            out.append(last[at - 1])
            at -= len(self.token_bytes[last[at - 1]])
        rest = tuple(b >> cut for b in bounds[cut:])
        to = self.state(out[0] if cut else before, held[cut:], last[cut:], rest)
        found = self.moves[state << 8 | byte] = (to, tuple(reversed(out)))
        return found

    def end(self, state: int) -> tuple[int, ...]:
        _, held, last, _ = self.states[state]
        out, at = [], len(held)
        while at:
            out.append(last[at - 1])
            at -= len(self.token_bytes[last[at - 1]])
        found = self.ends[state] = tuple(reversed(out))
        return found

    def encode(self, word: bytes) -> tuple[int, ...]:
        token = self.ranks.get(word)
        if token is not None:
            return (token,)
        if len(self.states) > self.most_states:
            self.reset()
        moves, state, out = self.moves, 0, ()
        for byte in word:
            step = moves.get(state << 8 | byte) or self.move(state, byte)
            state = step[0]
            if step[1]:
                out += step[1]
        return out + (self.ends.get(state) or self.end(state))


#: States of the UTF-8 machine: 0 between characters, 1-3 that many plain continuation bytes to come, then the narrower second bytes after E0, ED, F0 and F4; 8 rejects.
REJECT = 8
_SECOND = {0xE0: 4, 0xED: 5, 0xF0: 6, 0xF4: 7}
_NEXT = {1: (0x80, 0xBF, 0), 2: (0x80, 0xBF, 1), 3: (0x80, 0xBF, 2), 4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1), 6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2)}


def utf8_step(state: int, byte: int) -> int:
    if state == 0:
        if byte < 0x80:
            return 0
        if byte in _SECOND:
            return _SECOND[byte]
        return 1 if 0xC2 <= byte <= 0xDF else 2 if 0xE1 <= byte <= 0xEF else 3 if 0xF1 <= byte <= 0xF3 else REJECT
    if state == REJECT:
        return REJECT
    low, high, then = _NEXT[state]
    return then if low <= byte <= high else REJECT


class StreamDecoder:
    """Token ids to bytes, following the UTF-8 state across tokens.

    A token's effect on every state is computed once; runs of tokens that lead from a character's
    end to a character's end are skipped in one vector operation.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.after = np.full((REJECT + 1, len(self.tokens)), REJECT, np.int8)
        for rank, token in enumerate(self.tokens):
            if token.isascii():
                self.after[0, rank] = 0
                continue
            for state in range(REJECT):
                at = state
                for byte in token:
                    at = utf8_step(at, byte)
                self.after[state, rank] = at

    def decode(self, ids: np.ndarray) -> tuple[bytes, bool]:
        """The bytes, and whether they are whole, valid UTF-8."""
        state, after = 0, self.after
        odd = np.flatnonzero(after[0, ids] != 0)
        k = 0
        while k < len(odd):
            at = int(odd[k])
            state = int(after[0, ids[at]])
            at += 1
            while state not in (0, REJECT) and at < len(ids):
                state = int(after[state, ids[at]])
                at += 1
            if state:
                break
            k = int(np.searchsorted(odd, at)) if k + 1 < len(odd) and odd[k + 1] < at else k + 1
        return b"".join(map(self.tokens.__getitem__, ids.tolist())), state == 0
