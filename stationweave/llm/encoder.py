"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece of bytes there is exactly one token that can end its
encoding. `PrefixTable` stores that token per prefix: the encoding is read off
backwards, appended bytes extend the table without looking at what stands before,
and after an edit only the prefixes from the edit on are redone, until they agree
with the old ones again.

A token may follow another if the merges that build both leave the border
between them alone; that is decided by walking down the two merge trees along
the border.

Texts are cut into pieces before, by the classes of their characters, for a whole
batch of texts at once; pieces that were met before come from a bounded memory.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator, Sequence
from functools import lru_cache
from pathlib import Path

import numpy as np

#: Where the public vocabulary files lie; the folder is a parameter of every operator here.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"
#: Pieces that a worker remembers before it starts afresh.
REMEMBERED = 300_000
#: Characters that are cut at once.
CHUNK = 1 << 20


def _byte_symbols() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """Tokens of a byte-level BPE and which token may follow which."""

    def __init__(self, path: str):
        self.ids: dict[bytes, int] = {}
        if path.endswith(".json"):
            model = json.loads(Path(path).read_text())["model"]
            of = _byte_symbols()
            raw = {t: bytes(of[ch] for ch in t) for t in model["vocab"] if all(ch in of for ch in t)}
            self.ids = {raw[t]: i for t, i in model["vocab"].items() if t in raw}
            pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
            order = [(raw[a], raw[b]) for a, b in pairs]
        else:
            for line in Path(path).read_bytes().splitlines():
                token, rank = line.split()
                self.ids[base64.b64decode(token)] = int(rank)
            order = self._merges_from_ranks()
        n = max(self.ids.values()) + 1
        self.token = [b""] * n
        for b, i in self.ids.items():
            self.token[i] = b
        #: (left, right) -> time of the merge; token -> its two halves and the time it is made, single bytes first of all
        self.time: dict[tuple[int, int], int] = {}
        self.left, self.right, self.made = list(range(n)), list(range(n)), [-1] * n
        for t, (a, b) in enumerate(order):
            whole = self.ids.get(a + b)
            if whole is None:
                continue
            x, y = self.ids[a], self.ids[b]
            self.time[x, y] = t
            if self.made[whole] < 0:
                self.left[whole], self.right[whole], self.made[whole] = x, y, t
        self.longest = max(map(len, self.ids))
        #: last bytes of longer tokens, so that a search can stop early
        self.tails = {b[i:] for b in self.ids for i in range(len(b))}
        self._may: dict[tuple[int, int], bool] = {}
        # a token that its own bytes don't give can never stand anywhere
        self.sound = [False] * n
        for b, i in self.ids.items():
            self.sound[i] = len(b) == 1 or (self.made[i] >= 0 and self.may_follow(self.left[i], self.right[i], self.made[i]))

    def _merges_from_ranks(self) -> list[tuple[bytes, bytes]]:
        out = []
        for whole, rank in sorted(self.ids.items(), key=lambda x: x[1]):
            if len(whole) < 2:
                continue
            parts = [whole[i : i + 1] for i in range(len(whole))]
            while len(parts) > 2:
                best = min(
                    range(len(parts) - 1),
                    key=lambda i: r if (r := self.ids.get(parts[i] + parts[i + 1], rank)) < rank else 1 << 40,
                )
                if self.ids.get(parts[best] + parts[best + 1], rank) >= rank:
                    break
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            if len(parts) == 2:
                out.append((parts[0], parts[1]))
        return out

    def may_follow(self, a: int, b: int, before: int = 1 << 60) -> bool:
        """Whether the encoding of the bytes of a and b together keeps the border between a and b.

        The border is crossed if at any time the token that then ends at it and
        the one that then begins there merge. `before`: only merges earlier than
        this time count.
        """
        key = (a, b)
        if before == 1 << 60 and (known := self._may.get(key)) is not None:
            return known
        made, time = self.made, self.time
        x, y = a, b
        # x stands from its making until `x_until`, when its parent is made; so does y
        x_until = y_until = before
        ok = True
        while True:
            t = time.get((x, y))
            # both stand at time t and neither has been taken by its parent. Of equal merges the
            # left one goes first: a parent of x made at t is earlier, a parent of y is not.
            if t is not None and max(made[x], made[y]) < t < x_until and t <= y_until:
                ok = False
                break
            if made[x] < 0 and made[y] < 0:
                break
            if made[x] > made[y]:
                x_until = made[x]
                x = self.right[x]
            else:
                y_until = made[y]
                y = self.left[y]
        if before == 1 << 60:
            if len(self._may) > 2_000_000:
                self._may.clear()
            self._may[key] = ok
        return ok


class PrefixTable:
    """The unique valid last token of every prefix of some bytes."""

    __slots__ = ("vocabulary", "data", "last")

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = bytearray()
        self.last: list[int] = []
        self.append(data)

    def _ending(self, i: int) -> int:
        v, data, last = self.vocabulary, self.data, self.last
        ids, tails, sound, may = v.ids, v.tails, v.sound, v.may_follow
        found = -1
        for k in range(i - 1, max(-1, i - 1 - v.longest), -1):
            piece = bytes(data[k:i])
            if piece not in tails:
                break
            t = ids.get(piece)
            if t is None or not sound[t]:
                continue
            if k == 0 or may(last[k - 1], t):
                found = t  # valid last tokens of one prefix are unique, so any will do
                break
        if found < 0:
            raise ValueError("the vocabulary lacks a byte")
        return found

    def append(self, more: bytes) -> None:
        """Exact: nothing before the new bytes is looked at again."""
        for byte in more:
            self.data.append(byte)
            self.last.append(self._ending(len(self.data)))

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replace data[start:end]; gives how many prefixes were redone.

        Behind the new bytes, prefixes are redone until as many in a row as the
        longest token has bytes agree with what was there.
        """
        tail_data, tail_last = self.data[end:], self.last[end:]
        del self.data[start:], self.last[start:]
        self.append(new)
        redone, agree = len(new), 0
        for j, byte in enumerate(tail_data):
            if agree >= self.vocabulary.longest:
                self.data += tail_data[j:]
                self.last += tail_last[j:]
                break
            self.append(bytes([byte]))
            redone += 1
            agree = agree + 1 if self.last[-1] == tail_last[j] else 0
        return redone

    def ids(self) -> list[int]:
        out, i = [], len(self.data)
        token = self.vocabulary.token
        while i:
            t = self.last[i - 1]
            out.append(t)
            i -= len(token[t])
        return out[::-1]


# ---------------------------------------------------------------- pieces of a text

SPACE, LETTER, NUMBER, OTHER = range(4)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point: white space, letter, number, anything else."""
    import regex

    table = np.full(0x110000, OTHER, dtype=np.uint8)
    every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    for pattern, k in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(pattern, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            table[a : b + 1] = k
    return table


def code_points(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The code points of a text, and whether each is white space."""
    c = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    return c, _classes()[c] == SPACE


#: What may follow an apostrophe as a piece of its own.
_SHORT, _LONG = "stmd", ("re", "ve", "ll")


def piece_starts(text: str, ends: np.ndarray) -> np.ndarray:
    """Where pieces begin in a text that is several texts in a row; ends: where each of them ends.

    Pieces: an apostrophe ending ('s 't 're 've 'm 'll 'd); a run of letters, of
    numbers or of other signs, each with one plain blank before it; white space,
    of which the last character before a run stands alone unless it is that
    plain blank.
    """
    c = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    n = len(c)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    k = _classes()[c]
    first = np.zeros(n + 1, dtype=bool)
    first[0] = True
    first[ends[ends < n]] = True
    start = first[:n].copy()
    start[1:] |= k[1:] != k[:-1]
    # a run after white space of the same text
    run = np.flatnonzero(start[1:] & ~first[1:n] & (k[1:] != SPACE) & (k[:-1] == SPACE)) + 1
    start[run - 1] = True
    start[run[c[run - 1] == 0x20]] = False
    # apostrophe endings
    p = np.flatnonzero((c[:-1] == 0x27) & start[:-1] & (k[1:] == LETTER) & ~first[1:n])
    if len(p):
        one = np.isin(c[p + 1], [ord(x) for x in _SHORT])
        two = np.zeros(len(p), dtype=bool)
        q = p + 2 < n
        inside = np.zeros(len(p), dtype=bool)
        inside[q] = ~first[p[q] + 2]
        for w in _LONG:
            hit = inside & (c[p + 1] == ord(w[0]))
            hit[hit] = c[p[hit] + 2] == ord(w[1])
            two |= hit
        length = np.where(two, 2, np.where(one, 1, 0))
        p, length = p[length > 0], length[length > 0]
        start[p + 1] = False
        after = p + 1 + length
        ok = after < n
        start[after[ok]] = True
    return np.flatnonzero(start)


class _Rows:
    """An array that grows at its end; its space doubles, so growth costs what is added."""

    def __init__(self, kind):
        self.space, self.n = np.empty(1024, dtype=kind), 0

    def extend(self, more: np.ndarray) -> None:
        end = self.n + len(more)
        if end > len(self.space):
            self.space = np.concatenate([self.space[: self.n], np.empty(max(end, 2 * len(self.space)) - self.n, dtype=self.space.dtype)])
        self.space[self.n : end] = more
        self.n = end

    def rows(self) -> np.ndarray:
        return self.space[: self.n]


class Encoder:
    """Token ids and token counts of texts, remembering the pieces met."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self._forget()

    def _forget(self) -> None:
        self._place: dict[str, int] = {}
        # what was learnt since the arrays were last looked at
        self._new_flat: list[int] = []
        self._new_lengths: list[int] = []
        self._held = _Rows(np.int64), _Rows(np.int64), _Rows(np.int32)

    def _learn(self, piece: str) -> int:
        ids = PrefixTable(self.vocabulary, piece.encode()).ids()
        at = self._place[piece] = len(self._place)
        self._new_flat += ids
        self._new_lengths.append(len(ids))
        return at

    def _known(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all pieces met: the number of ids, where they begin, and the ids in a row."""
        lengths, offsets, flat = self._held
        if self._new_lengths:
            new = np.array(self._new_lengths, dtype=np.int64)
            offsets.extend(flat.n + np.cumsum(new) - new)
            lengths.extend(new)
            flat.extend(np.array(self._new_flat, dtype=np.int32))
            self._new_flat, self._new_lengths = [], []
        return lengths.rows(), offsets.rows(), flat.rows()

    def _places(self, text: str, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts of the pieces, their places in memory)."""
        if len(self._place) > REMEMBERED:
            self._forget()
        starts = piece_starts(text, ends)
        cut = [*starts.tolist(), len(text)]
        pieces = list(map(text.__getitem__, map(slice, cut, cut[1:])))
        get = self._place.get
        places = list(map(get, pieces))
        if None in places:
            for i, at in enumerate(places):
                if at is None:
                    at = get(pieces[i])
                    places[i] = self._learn(pieces[i]) if at is None else at
        return starts, np.array(places, dtype=np.int64)

    def _batches(self, texts: Sequence[str | None]):
        """Joined texts of about CHUNK characters: (index of the first, joined text, where each text ends)."""
        i = 0
        while i < len(texts):
            j, size, held = i, 0, []
            while j < len(texts) and (size < CHUNK or j == i):
                t = texts[j] or ""
                held.append(t)
                size += len(t)
                j += 1
            yield i, "".join(held), np.cumsum([len(t) for t in held])
            i = j

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each). NULL and empty texts have none."""
        flats, counts = [], []
        for _, text, ends in self._batches(texts):
            starts, places = self._places(text, ends)
            lengths, offsets, pool = self._known()
            n = lengths[places]
            total = int(n.sum())
            at = np.repeat(offsets[places] - (np.cumsum(n) - n), n) + np.arange(total)
            flats.append(pool[at] if total else np.zeros(0, dtype=np.int32))
            counts.append(self._per_text(starts, n, ends))
        if not flats:
            return np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int64)
        return np.concatenate(flats), np.concatenate(counts)

    @staticmethod
    def _per_text(starts: np.ndarray, n: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(n)])
        at = sums[np.searchsorted(starts, ends, side="left")]
        return np.diff(np.concatenate([[0], at]))

    def count(self, texts: Sequence[str | None]) -> np.ndarray:
        """Number of ids of each text."""
        out = []
        for _, text, ends in self._batches(texts):
            starts, places = self._places(text, ends)
            out.append(self._per_text(starts, self._known()[0][places], ends))
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)

    def pieces(self, texts: Sequence[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each text: its number of ids, the starts of its pieces, and the number of ids of each."""
        for _, text, ends in self._batches(texts):
            starts, places = self._places(text, ends)
            n = self._known()[0][places]
            totals = self._per_text(starts, n, ends).tolist()
            bounds = [0, *np.searchsorted(starts, ends, side="left").tolist()]
            for k, base in enumerate([0, *ends[:-1].tolist()]):
                a, b = bounds[k], bounds[k + 1]
                yield totals[k], starts[a:b] - base, n[a:b]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary file."""
    return Encoder(path)
