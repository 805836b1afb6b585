"""Byte-pair merges for public tokenizer files: batches of words at once, and very long words by tree concatenation."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Closes a word where merges are ranks of byte strings. Runs that hold it take another way.
END = b"\x01"
#: Words of a batch are padded to one of these widths; longer ones go through encode_long.
WIDTHS = (4, 8, 12, 16, 24, 32, 64)
NONE = np.int32(2**31 - 1)
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Bpe:
    """Merges of one vocabulary file. end: what the last symbol of a word carries, or an empty string."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        if max(vocab.values(), default=0) >= 1 << 16 or any(x["id"] >= 1 << 16 for x in spec["added_tokens"]):
            raise ValueError("ids of more than two bytes")
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        chars = _byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.last = np.array([vocab[c + self.end] for c in chars], np.int32)
        self.strings = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self._table(left << 20 | right)
        self.known_parts: dict[int, tuple[int, ...]] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.ranks = {(int(a), int(b)): (r, int(m)) for r, (a, b, m) in enumerate(zip(left, right, self.made, strict=True))}

    def _table(self, keys: np.ndarray, bits: int = 19) -> None:
        """An open-addressing table from pair to rank, so that whole columns of pairs are looked up at once."""
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots, self.rank_of = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.slots[at[todo]] == -1
            put = todo[free]
            first = np.unique(at[put], return_index=True)[1]
            put = put[first]
            self.slots[at[put]], self.rank_of[at[put]] = keys[put], put
            todo = np.setdiff1d(todo, put)
            at[todo] = (at[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, NONE where they do not merge (a or b may be -1)."""
        keys = (a.astype(np.int64) << 20) | b.astype(np.int64)
        keys[(a < 0) | (b < 0)] = -2
        at = self._slot(keys)
        found = self.slots[at]
        out = np.where(found == keys, self.rank_of[at], NONE)
        todo = np.flatnonzero((found != keys) & (found != -1))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            found = self.slots[at[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.rank_of[at[todo[hit]]]
            todo = todo[~hit & (found != -1)]
        return out

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Token ids of each word (UTF-8 bytes, not empty), two bytes an id."""
        out: list = [None] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        lower = 0
        for width in WIDTHS:
            pick = np.flatnonzero((sizes > lower) & (sizes <= width))
            lower = width
            for k in range(0, len(pick), 20_000):
                part = pick[k : k + 20_000]
                rows, n = self._merge([words[i] for i in part], width)
                flat = rows[np.arange(width) < n[:, None]].astype("<u2").tobytes()
                ends = (2 * np.cumsum(n)).tolist()
                start = 0
                for i, end in zip(part.tolist(), ends, strict=True):
                    out[i] = flat[start:end]
                    start = end
        for i in np.flatnonzero(sizes > WIDTHS[-1]):
            out[i] = np.array(self.encode_long(self.symbols(words[i])), "<u2").tobytes()
        return out

    def symbols(self, word: bytes) -> list[int]:
        ids = self.inner[np.frombuffer(word, np.uint8)]
        ids[-1] = self.last[word[-1]]
        return ids.tolist()

    def _merge(self, words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Merges the lowest rank of every word, the leftmost first, until no word changes."""
        count = len(words)
        n = np.fromiter(map(len, words), np.int64, count)
        raw = np.zeros((count, width), np.uint8)
        raw[np.arange(width) < n[:, None]] = np.frombuffer(b"".join(words), np.uint8)
        sym = self.inner[raw]
        rows = np.arange(count)
        sym[rows, n - 1] = self.last[raw[rows, n - 1]]
        sym[np.arange(width) >= n[:, None]] = -1
        ranks = np.full((count, width), NONE, np.int32)
        if width > 1:
            ranks[:, :-1] = self.pair_ranks(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(count, width - 1)
        out, live, cols = np.full((count, width), -1, np.int32), rows, np.arange(width)
        while len(live):
            j = ranks.argmin(1)
            r = np.arange(len(live))
            best = ranks[r, j]
            done = best == NONE
            if done.any():
                out[live[done]] = sym[done]
                keep = ~done
                live, sym, ranks, j, best = live[keep], sym[keep], ranks[keep], j[keep], best[keep]
                if not len(live):
                    break
                r = np.arange(len(live))
            sym[r, j] = self.made[best]
            take = np.minimum(cols + (cols > j[:, None]), width - 1)
            sym = np.take_along_axis(sym, take, 1)
            ranks = np.take_along_axis(ranks, take, 1)
            sym[:, -1], ranks[:, -1] = -1, NONE
            n[live] -= 1
            right = np.where(j + 1 < width, sym[r, np.minimum(j + 1, width - 1)], -1)
            left = np.where(j > 0, sym[r, np.maximum(j - 1, 0)], -1)
            mid = sym[r, j]
            both = self.pair_ranks(np.concatenate([mid, left]), np.concatenate([right, mid]))
            ranks[r, j] = both[: len(r)]
            has = j > 0
            ranks[r[has], j[has] - 1] = both[len(r) :][has]
        return out, n

    def _plain(self, sym: list[int]) -> list[int]:
        """The same merges for one list of symbols."""
        sym = list(sym)
        while len(sym) > 1:
            best = min(((self.ranks[p][0], i) for i, p in enumerate(zip(sym, sym[1:], strict=False)) if p in self.ranks), default=None)
            if best is None:
                break
            i = best[1]
            sym[i : i + 2] = [self.ranks[sym[i], sym[i + 1]][1]]
        return sym

    def encode_long(self, sym: list[int], leaf: int = 64) -> list[int]:
        """Tree concatenation: each half on its own, then growing windows around the join, encoded anew, until the tokens
        at both ends of the window are those that the halves have there."""
        if len(sym) <= leaf:
            return self._plain(sym)
        mid = len(sym) // 2
        return self.join(self.encode_long(sym[:mid], leaf), self.encode_long(sym[mid:], leaf))

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """Tokens of the concatenation of two encoded parts of one word."""
        k = 4
        while True:
            left, right = a[max(0, len(a) - k) :], b[:k]
            window = self._plain([s for t in left + right for s in self.parts(t)]) if len(left) + len(right) <= 32 else self.encode_long([s for t in left + right for s in self.parts(t)], 1 << 30)
            whole_a, whole_b = len(left) == len(a), len(right) == len(b)
            if (whole_a or window[:2] == left[:2]) and (whole_b or window[-2:] == right[-2:]):
                return a[: len(a) - len(left)] + window + b[len(right) :]
            k *= 2

    def parts(self, token: int) -> tuple[int, ...]:
        """The single-byte symbols of a token."""
        if token not in self.known_parts:
            if not self.halves:
                self.halves = {int(m): p for p, (_, m) in self.ranks.items()}
            if len(self.known_parts) > 100_000:
                self.known_parts.clear()
            self.known_parts[token] = self.parts(self.halves[token][0]) + self.parts(self.halves[token][1]) if token in self.halves else (token,)
        return self.known_parts[token]


@lru_cache(maxsize=1)
def load(path: str) -> Bpe:
    return Bpe(path)


def _class(*kinds: str) -> str:
    """A character class with all code points whose general category begins so, from the Unicode tables at hand."""
    out, start = [], None
    for c in range(0x110000 + 1):
        inside = c < 0x110000 and unicodedata.category(chr(c))[0] in kinds
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


@lru_cache(maxsize=1)
def classes() -> tuple[str, str, str]:
    """Letters, numbers and white space as class contents."""
    space = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
    return _class("L"), _class("N"), space


@lru_cache(maxsize=1)
def word_pattern() -> re.Pattern:
    """Pieces of lower-cased text for vocabularies with word ends."""
    letter, number, space = classes()
    return re.compile(f"{_CONTRACTIONS}|[{letter}]+|[{number}]|[^{space}{letter}{number}]+")


@lru_cache(maxsize=1)
def byte_pattern() -> re.Pattern:
    """Pieces of raw text for byte-level vocabularies."""
    letter, number, space = classes()
    return re.compile(f"{_CONTRACTIONS}| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


def byte_string(s: str) -> bytes:
    """The bytes that a token's string of stand-ins is for."""
    back = _stand_ins()
    return bytes(map(back.__getitem__, s))


@lru_cache(maxsize=1)
def _stand_ins() -> dict[str, int]:
    return {c: b for b, c in enumerate(_byte_chars())}


def rust_class(content: str) -> str:
    """A class content of `classes` as the tokenizer library's expressions write it."""
    return re.sub(r"\\(?:U([0-9a-f]{8})|u([0-9a-f]{4})|x([0-9a-f]{2}))", lambda m: f"\\x{{{m[1] or m[2] or m[3]}}}", content)


def cut_at(ids: np.ndarray, mark: int) -> pa.Array:
    """Runs of ids (two bytes each) between marks, as binary values; as many as there are marks, and one."""
    inside = ids != mark
    ends = np.append(np.flatnonzero(~inside), len(ids))
    offsets = np.concatenate([[0], 2 * (ends - np.arange(len(ends)))]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(ids[inside].astype("<u2").tobytes())])


def joined_strings(values: pa.Array, mark: str) -> str:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values), mark)[0].as_py()


def looked_up(runs: pa.ListArray, simple: str, many, one) -> tuple[list[bytes], np.ndarray]:
    """(values of the runs of each list, joined; which lists have a run without a value). Each distinct run is looked up once:
    those that match `simple` by one call of many(array) -> binary array, the others by one(strings) -> list of bytes or None."""
    found = runs.flatten().dictionary_encode()
    own = pc.match_substring_regex(found.dictionary, simple)
    easy, hard = found.dictionary.filter(own), found.dictionary.filter(pc.invert(own)).to_pylist()
    values = pa.concat_arrays([many(easy) if len(easy) else pa.array([], pa.binary()), pa.array(one(hard), pa.binary())])
    own = own.to_numpy(zero_copy_only=False)
    place = np.where(own, np.cumsum(own) - 1, len(easy) + np.cumsum(~own) - 1)
    flat = values.take(pa.array(place[found.indices.to_numpy()]))
    at = runs.offsets.to_numpy() - runs.offsets[0].as_py()
    bounds, data = np.frombuffer(flat.buffers()[1], np.int32)[at].tolist() if len(flat) else [0] * len(at), memoryview(flat.buffers()[2] or b"")
    missing = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])[at]
    return [bytes(data[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], np.diff(missing) > 0


_ODD_SPACE = re.compile("[\x1c-\x1f]")


def units(text: str) -> list[str]:
    """Runs without white space."""
    if _ODD_SPACE.search(text):
        return [x for x in re.split(f"[{classes()[2]}]+", text) if x]
    return text.split()


def fold(text: str) -> str:
    """Canonical composition, then lower case letter by letter."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:
            text = text.replace("Σ", "σ")
    return text.lower()


class WordCoder:
    """Token ids for texts in a vocabulary with word ends. Units seen before come from a table of up to `most`
    units, or those of one call of `learn`."""

    def __init__(self, path: str, most: int = 200_000):
        self.bpe, self.most, self.known, self.pieces = load(path), most, {}, {}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.bpe.special, key=len, reverse=True))) + ")")

    def value(self, ids: bytes):
        """What is kept for a piece: its ids, two bytes each."""
        return ids

    def learn(self, seen: set[str]) -> None:
        """Makes sure that all these units are known. Where the tables would outgrow `most`, only what is in use stays."""
        new = list(seen.difference(self.known))
        if not new:
            return
        full = len(self.known) + len(new) > self.most
        if full:
            self.known = {u: self.known[u] for u in seen if u in self.known}
        find, whole, split = word_pattern().findall, {}, {}
        # Units have no line ends, and folding makes none. Letters alone are one piece, and a stop after them is another.
        for u, f in zip(new, fold("\n".join(new)).split("\n"), strict=True):
            if f.isalpha():
                whole[u] = f
            elif f[-1] in ".,;:!?" and f[:-1].isalpha():
                split[u] = (f[:-1], f[-1])
            else:
                split[u] = find(f)
        wanted = set(whole.values()).union(*split.values())
        if full:
            self.pieces = {p: self.pieces[p] for p in wanted if p in self.pieces}
        missing = list(wanted.difference(self.pieces))
        coded = self.bpe.encode_words([p.encode("utf-8", "surrogatepass") for p in missing])
        self.pieces.update(zip(missing, map(self.value, coded), strict=True))
        get = self.pieces.__getitem__
        self.known.update(zip(whole, map(get, whole.values()), strict=True))
        for u, ps in split.items():
            self.known[u] = self.joined(list(map(get, ps)))

    def joined(self, values: list):
        return b"".join(values)

    @cached_property
    def fast(self):
        """The merges as ranks of byte strings in which END closes a word, if the ids are in their order; else None. And the id
        for each rank: single bytes, those that end a word, merges."""
        made = self.bpe.made
        if not (np.diff(made) > 0).all() or not self.bpe.end:
            return None
        import tiktoken

        ranks = {bytes([b]): b for b in range(256)} | {bytes([b]) + END: 256 + b for b in range(256)}
        for k, i in enumerate(made.tolist()):
            s = self.bpe.strings[i]
            ranks[byte_string(s.removesuffix(self.bpe.end)) + END * s.endswith(self.bpe.end)] = 512 + k
        if len(ranks) < 512 + len(made):
            return None
        return tiktoken.Encoding("words", pat_str=r"\n|[^\x01\n]*\x01", mergeable_ranks=ranks, special_tokens={}), np.concatenate([self.bpe.inner, self.bpe.last, made])

    def encode_column(self, texts: pa.Array) -> list[bytes]:
        """Ids of all texts of a column, as encode_all gives them. Nothing is kept from call to call: of a large vocabulary
        most words are rare, and looking for them among those that were kept takes longer than merging them again."""
        if not self.fast or not len(texts):
            return self.encode_all(texts.to_pylist())
        texts = pc.fill_null(texts, "")
        encoding, ids = self.fast
        mark = ord("\n")

        def many(runs: pa.Array) -> pa.Array:
            words = word_pattern().sub("\\g<0>\x01", fold(joined_strings(runs, "\n")))
            got = encoding.encode_to_numpy(words)
            return cut_at(np.where(got == mark, 1 << 16, ids[got]), 1 << 16)

        def one(runs: list[str]) -> list[bytes]:
            own = [units(r) for r in runs]
            self.learn(set().union(*own))
            return [b"".join(map(self.known.__getitem__, x)) for x in own]

        out, _ = looked_up(pc.ascii_split_whitespace(texts), f"^[^\\x01{rust_class(classes()[2])}]+$", many, one)
        for i in np.flatnonzero(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)).tolist():
            out[i] = self.encode_all([texts[i].as_py()])[0]
        return out

    def encode(self, text: str):
        """The value of a text whose units are known."""
        return self.joined(list(map(self.known.__getitem__, units(text))))

    def encode_all(self, texts: list[str]) -> list:
        """Texts of any kind; marks such as an end-of-text string count as the single token they name."""
        texts = [t or "" for t in texts]
        marked = {i: self.marks.split(t) for i, t in enumerate(texts) if "<|" in t and self.marks.search(t)}
        runs = [units(" ".join(marked[i][::2]) if i in marked else t) for i, t in enumerate(texts)]
        self.learn(set().union(*runs))
        out = []
        for i, own in enumerate(runs):
            if i in marked:
                out.append(self.joined([self.value(np.array([self.bpe.special[x]], "<u2").tobytes()) if k % 2 else self.encode(x) for k, x in enumerate(marked[i])]))
            else:
                out.append(self.joined(list(map(self.known.__getitem__, own))))
        return out
