"""A deterministic transducer for the merges of a byte-pair vocabulary.

It reads the bytes of a piece one by one; each transition is annotated with the tokens that it emits, that is by how much the
token count of the longer prefix exceeds that of the shorter one (it may be less by some, as tokens merge). The sum over a
piece is its token count.

States come from the vocabulary. Its tokens form a trie. After some bytes, what matters for all that may follow are the
places where a token that is not complete yet may have started: those whose bytes since then are a node of the trie with
children. A state holds, for each such place, the node, the last token of the encoding up to the place, and how many tokens
were emitted since. A token that a byte completes is the last token of the longer prefix exactly if the merges keep it apart
from the token before it. So states and transitions are finitely many; they are compiled from the merges when first needed.
"""

from __future__ import annotations

import struct

import numpy as np

from .bpe import Bpe, _byte_chars

#: The token before the first byte of a piece.
START = -1
State = tuple[tuple[int, int, int], ...]
FIRST: State = ((0, START, 0),)


class Arcs:
    """Transitions by key (state << 8 | byte), open-addressed so that whole columns are looked up at once."""

    def __init__(self, bits: int = 16):
        self.bits, self.size = bits, 0
        self.keys = np.full(1 << bits, -1, np.int64)
        self.after, self.emitted = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int16)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or a free one."""
        at, mask = self._slot(keys), (1 << self.bits) - 1
        found = self.keys[at]
        todo = np.flatnonzero((found != keys) & (found != -1))
        while len(todo):
            at[todo] = (at[todo] + 1) & mask
            found = self.keys[at[todo]]
            todo = todo[(found != keys[todo]) & (found != -1)]
        return at

    def add(self, keys: np.ndarray, after: np.ndarray, emitted: np.ndarray) -> None:
        """Distinct keys that are not there yet."""
        if 2 * (self.size + len(keys)) > 1 << self.bits:
            full = self.keys != -1
            old = self.keys[full], self.after[full], self.emitted[full]
            self.__init__(max(self.bits + 1, (4 * (self.size + len(keys))).bit_length()))
            self.add(*old)
        self.size += len(keys)
        todo = np.arange(len(keys))
        while len(todo):
            at = self.find(keys[todo])
            first = np.unique(at, return_index=True)[1]
            put, at = todo[first], at[first]
            self.keys[at], self.after[at], self.emitted[at] = keys[put], after[put], emitted[put]
            todo = np.delete(todo, first)


class Transducer:
    """States are numbered when first met, 0 is the start of a piece. Beyond `most` states the table is begun anew."""

    def __init__(self, bpe: Bpe, most: int = 250_000):
        self.bpe, self.most = bpe, most
        self.rank = {m: (r, a, b) for (a, b), (r, m) in bpe.ranks.items()}  # of the merge that makes a token, and its halves
        byte_of = {c: b for b, c in enumerate(_byte_chars())}
        self.child: dict[int, int] = {}  # node * 256 + byte: node
        self.token = [START]  # of each node
        self.inner = bytearray(1)  # whether a node has children
        for i in sorted(bpe.strings):
            s = bpe.strings[i]
            if i in bpe.special.values():
                continue
            node = 0
            for b in map(byte_of.__getitem__, s):
                self.inner[node] = 1
                nxt = self.child.get(node << 8 | b)
                if nxt is None:
                    nxt = self.child[node << 8 | b] = len(self.token)
                    self.token.append(START)
                    self.inner.append(0)
                node = nxt
            self.token[node] = i
        self.apart: dict[tuple[int, int], bool] = {}
        self.clear()

    def clear(self) -> None:
        self.states: list[bytes] = []
        self.number: dict[bytes, int] = {}
        self.arcs = Arcs()
        self.single: dict[int, tuple[int, int]] = {}  # the same for single runs
        self.numbered(FIRST)

    def numbered(self, state: State) -> int:
        packed = struct.pack(f"{3 * len(state)}i", *(x for entry in state for x in entry))
        k = self.number.get(packed)
        if k is None:
            k = self.number[packed] = len(self.states)
            self.states.append(packed)
        return k

    def state(self, k: int) -> State:
        return tuple(struct.iter_unpack("3i", self.states[k]))

    def keeps(self, last: int, token: int) -> bool:
        """Whether the merges leave a token as it is after the token before it, or as a whole piece."""
        found = self.apart.get((last, token))
        if found is None:
            if len(self.apart) > 300_000:
                self.apart.clear()
            found = self.apart[last, token] = self.bpe._plain(list(self.bpe.parts(token))) == [token] if last == START else self.stays_apart(last, token)
        return found

    def stays_apart(self, a: int, b: int) -> bool:
        """Undoes the merges that made a and b, the latest first. What then stands at their border was there until the undone
        merge; a merge across the border that came before it would have been made instead. Of equal merges the left one is made
        first, so one across the border comes before one on the right, and after one on the left."""
        until, none = 1 << 60, (-1, 0, 0)
        while True:
            across = self.bpe.ranks.get((a, b))
            if across is not None and 2 * across[0] < until:
                return False
            (ra, _, right), (rb, left, _) = self.rank.get(a, none), self.rank.get(b, none)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                a, until = right, 2 * ra
            else:
                b, until = left, 2 * rb + 1

    def step(self, state: State, byte: int) -> tuple[State, int]:
        """The state after one more byte, and the tokens emitted."""
        grown, made, emitted = [], START, 0
        for node, last, since in state:
            child = self.child.get(node << 8 | byte)
            if child is None:
                continue
            if made == START and self.token[child] != START and self.keeps(last, self.token[child]):
                made, emitted = self.token[child], 1 - since
            if self.inner[child]:
                grown.append((child, last, since))
        return (*((n, t, s + emitted) for n, t, s in grown), (0, made, 0)), emitted

    def compile(self, keys: list[int]) -> None:
        """Adds transitions, by state << 8 | byte, to the table."""
        made = [self.step(self.state(key >> 8), key & 255) for key in keys]
        self.arcs.add(np.array(keys, np.int64), np.array([self.numbered(s) for s, _ in made], np.int32), np.array([n for _, n in made], np.int16))

    def advance(self, state: State, data: bytes) -> tuple[State, int]:
        """The state after data, and the tokens emitted on the way. For single long runs."""
        total, k = 0, self.numbered(state)
        for b in data:
            found = self.single.get(k << 8 | b)
            if found is None:
                if len(self.states) >= self.most or len(self.single) >= self.most:
                    state = self.state(k)
                    self.clear()
                    k = self.numbered(state)
                state, n = self.step(self.state(k), b)
                found = self.single[k << 8 | b] = (self.numbered(state), n)
            k = found[0]
            total += found[1]
        return self.state(k), total

    def starts(self, data: bytes, at: set[int]) -> list[State]:
        """The states after data on all paths that start at one of these places. Paths that meet go on as one."""
        states: dict[State, None] = {}
        for i, b in enumerate(data):
            if i in at:
                states[FIRST] = None
            states = {self.step(s, b)[0]: None for s in states}
        return list(states)

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """Tokens of each piece (not empty). All pieces take their steps together, byte by byte."""
        out = np.zeros(len(pieces), np.int64)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(-sizes, kind="stable")  # those that still have bytes are the first ones
        for at in range(0, len(order), 50_000):
            part = order[at : at + 50_000]
            if len(self.states) >= self.most:
                self.clear()
            size = sizes[part]
            data = np.frombuffer(b"".join([pieces[i] for i in part.tolist()]), np.uint8)
            start = np.cumsum(size) - size
            state, n = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
            live = len(part)
            for k in range(int(size[0])):
                while size[live - 1] <= k:
                    live -= 1
                keys = state[:live] << 8 | data[start[:live] + k]
                at = self.arcs.find(keys)
                new = self.arcs.keys[at] != keys
                if new.any():
                    self.compile(np.unique(keys[new]).tolist())
                    at = self.arcs.find(keys)
                n[:live] += self.arcs.emitted[at]
                state[:live] = self.arcs.after[at]
            out[part] = n
        return out
