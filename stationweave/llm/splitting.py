"""Texts beyond a number of tokens, cut into pieces at their own boundaries.

Separators form a hierarchy: section, paragraph, sentence, word, character. A
stretch too long for a piece is split by the highest separator that it has, its
parts again by the next, until all are short enough; neighbouring parts are then
packed greedily up to the limit, each piece beginning with the end of the one
before as overlap: whole words, or characters where there are none.

A cut falls before white space or between characters of different class, where a
piece of the tokenizer's own pattern begins. There token counts add up exactly,
so they come from one running sum over the text. Inside a single run longer than
a piece (a word of thousands of letters) counts are taken from the encoder's
prefix table, which knows the number of tokens of every prefix; pieces that begin
inside a run, or hold a place where one was broken, are counted anew.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .encoder import TOKENIZERS, VOCABULARY, Encoder, PrefixTable, code_points, encoder

LIMIT, OVERLAP = 512, 64

#: What the line after a section's border begins with: a heading's signs, a numbered title, a rule.
HEADING = re.compile(r"#{1,6}\s|\d+(?:\.\d+)*[.)]\s+\S[^\n]{0,80}(?:\n|$)|[=\-*_~]{4,}[ \t]*(?:\n|$)")
#: Signs that end a sentence if white space follows; signs that end one in any case; what may close after either.
STOPS, FULL_STOPS, CLOSERS = ".!?…", "。！？", "\"'”’)]」』）"
_codes = lambda signs: np.array([ord(ch) for ch in signs], dtype=np.uint32)
_STOPS, _FULL_STOPS, _CLOSERS = map(_codes, (STOPS, FULL_STOPS, CLOSERS))
_HEADS = _codes("#0123456789=-*_~")
LEVELS = ("section", "paragraph", "sentence", "word", "character")


@dataclass(frozen=True)
class Piece:
    start: int
    end: int
    tokens: int
    overlap: int
    cut: str


class _Text:
    """Places where a text may be cut, and the running sum of its tokens."""

    def __init__(self, text: str, starts: np.ndarray, counts: np.ndarray, enc: Encoder, most: int):
        self.text = text
        whole = starts
        starts, counts = self._break_long(text, enc, starts, counts, most)
        self.at = np.append(starts, len(text))
        self.breaks = np.zeros(0, dtype=np.int64) if starts is whole else np.flatnonzero(~np.isin(starts, whole))
        self.sum = np.concatenate([[0], np.cumsum(counts)])
        self._level: dict[int, np.ndarray] = {}
        self._blank, self._found = self._places()

    @staticmethod
    def _break_long(text, enc, starts, counts, most):
        """Runs of more than `most` tokens cut between characters, by the token counts of their prefixes."""
        long = np.flatnonzero(counts > most)
        if not len(long):
            return starts, counts
        ends = np.append(starts, len(text))
        s, c = starts.tolist(), counts.tolist()
        for i in reversed(long.tolist()):
            run, new_s, new_c, a = text[starts[i] : ends[i + 1]], [], [], 0
            while a < len(run):
                # no token spans more bytes than the longest, so `most` tokens end within this stretch
                part = run[a : a + most * enc.vocabulary.longest]
                raw = part.encode()
                table = PrefixTable(enc.vocabulary, raw)
                n, token = np.zeros(len(raw) + 1, dtype=np.int64), enc.vocabulary.token
                for j, t in enumerate(table.last, 1):
                    n[j] = n[j - len(token[t])] + 1
                widths = np.cumsum([len(ch.encode()) for ch in part])
                # the last character whose prefix still fits; at least one
                fits = np.flatnonzero(n[widths] <= most)
                k = int(fits[-1]) + 1 if len(fits) else 1
                new_s.append(int(starts[i]) + a)
                new_c.append(int(n[widths[k - 1]]))
                a += k
            s[i : i + 1], c[i : i + 1] = new_s, new_c
        return np.array(s, dtype=np.int64), np.array(c, dtype=np.int64)

    def broken(self, a: int, b: int) -> bool:
        """Whether a place between a and b lies inside a run of the pattern."""
        return bool(np.searchsorted(self.breaks, a, side="right") < np.searchsorted(self.breaks, b, side="left"))

    def _places(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """Which characters are white space, and those before which the first three levels may cut."""
        c, blank = code_points(self.text)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], blank, [False]])))
        a, b = edge[::2], edge[1::2]
        lines = np.concatenate([[0], np.cumsum(c == 10)])
        pages = np.concatenate([[0], np.cumsum(c == 12)])
        n = lines[b] - lines[a]
        # a heading may follow any line's end
        heads = np.zeros(len(a), dtype=bool)
        maybe = np.flatnonzero((n > 0) & (b < len(c)))
        maybe = maybe[np.isin(c[b[maybe]], _HEADS)]
        heads[maybe] = [HEADING.match(self.text, i) is not None for i in b[maybe].tolist()]
        section = a[heads | (pages[b] > pages[a])]
        # the last sign before a run that closes nothing
        before = a - 1
        closing = np.isin(c, _CLOSERS)
        while (more := (before >= 0) & closing[before]).any():
            before = np.where(more, before - 1, before)
        ends = (before >= 0) & np.isin(c[before], _STOPS)
        full = np.flatnonzero(np.isin(c, _FULL_STOPS)) + 1
        while (more := (full < len(c)) & closing[np.minimum(full, len(c) - 1)]).any():
            full = np.where(more, full + 1, full)
        return blank, [section, a[n > 1], np.union1d(a[ends | (n > 0)], full)]

    def cuts(self, level: int) -> np.ndarray:
        """Indices of the starts at which a level may cut."""
        if level not in self._level:
            last = len(self.at) - 1
            if level == 4:
                found = np.arange(1, last)
            elif level == 3:
                found = np.flatnonzero(self._blank[self.at[:-1]])
            else:
                places = self._found[level]
                found = np.searchsorted(self.at, places)
                found = found[(found > 0) & (found < last) & (self.at[np.minimum(found, last)] == places)]
            self._level[level] = found
        return self._level[level]

    def atoms(self, a: int, b: int, level: int, most: int, out: list[tuple[int, str]]) -> None:
        """Ends of the parts of [a, b), none above `most` tokens where that can be, with the level of each cut."""
        c = self.cuts(level)
        inner = c[np.searchsorted(c, a, side="right") : np.searchsorted(c, b, side="left")]
        bounds = np.concatenate([[a], inner, [b]])
        sizes = np.diff(self.sum[bounds])
        ends = bounds[1:].tolist()
        for k, (end, size) in enumerate(zip(ends, sizes.tolist())):
            if size > most and level < 4 and end - bounds[k] > 1:
                self.atoms(int(bounds[k]), end, level + 1, most, out)
                out[-1] = (end, LEVELS[level])
            else:
                out.append((end, LEVELS[level]))


def _begin(t: _Text, count, lo: int, end: int, overlap: int) -> tuple[int, int, int]:
    """Where the overlap before place `end` begins if no word does: (place, character, tokens from that to the place).

    The earliest place within the overlap, if that holds half of it; else a
    character inside the run before, as far back as the overlap allows.
    """
    held = int(t.sum[end] - t.sum[lo])
    if 2 * held >= overlap or lo == 0:
        return lo, int(t.at[lo]), 0
    a, b = int(t.at[lo - 1]), int(t.at[lo])
    best, near, far = (b, 0), 1, min(b - a, 2 * overlap)
    while far < b - a and count(b - far, b) <= overlap - held:
        far = min(2 * far, b - a)
    while near <= far:
        size = (near + far) // 2
        n = count(b - size, b)
        if n <= overlap - held:
            best, near = (b - size, n), size + 1
        else:
            far = size - 1
    first = best[0]
    # a mark stays with the character that it belongs to
    while first < b and (unicodedata.combining(t.text[first]) or t.text[first] in "\u200d\ufe0e\ufe0f"):
        first += 1
    while first < b and count(first, int(t.at[end])) > overlap:
        first += 1
    return lo, first, count(first, b) if first < b else 0


def split_text(
    text: str | None, enc: Encoder, limit: int = LIMIT, overlap: int = OVERLAP, pieces: tuple[int, np.ndarray, np.ndarray] | None = None
) -> list[Piece]:
    """The pieces of a text in order. A text within the limit is one piece; NULL and empty texts are one of no tokens.

    Consecutive pieces overlap by the longest run of whole words at the end of
    the earlier one that has at most `overlap` tokens. Where no word begins there,
    as in Japanese or base64, the overlap begins at a change of character class,
    or inside a long run at a character. No piece exceeds the limit.

    pieces: the text's tokens as Encoder.pieces gives them, where they are known.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be below the limit")
    total, starts, counts = pieces or next(enc.pieces([text]))
    if total <= limit:
        return [Piece(0, len(text or ""), total, 0, "end")]
    t = _Text(text, starts, counts, enc, limit - overlap)
    last = len(t.at) - 1
    atoms: list[tuple[int, str]] = []
    t.atoms(0, last, 0, limit - overlap, atoms)
    ends = np.array([e for e, _ in atoms])
    sums = t.sum[ends]
    words = t.cuts(3)
    count = lambda i, j: int(enc.count([text[i:j]])[0])
    # a piece begins at character `first`, `head` tokens before place `start`
    out, start, done, first, head = [], 0, 0, 0, 0
    while done < last:
        k = int(np.searchsorted(sums, t.sum[start] + limit - head, side="right")) - 1
        n = head + int(t.sum[ends[k]] - t.sum[start])
        if first < t.at[start] or t.broken(start, int(ends[k])):  # sums hold only between places of the pattern
            while ends[k] > done and (n := count(first, int(t.at[ends[k]]))) > limit:
                k -= 1
            if ends[k] <= done and (start, head) != (done, 0):
                start, first, head = done, int(t.at[done]), 0
                continue
            k = max(k, int(np.searchsorted(ends, done, side="right")))
            shared = count(first, int(t.at[done])) if first < t.at[done] else 0
        else:
            shared = int(t.sum[done] - t.sum[start])
        end = int(ends[k])
        out.append(Piece(first, int(t.at[end]), n, shared, atoms[k][1] if end < last else "end"))
        done = start = end
        first, head = int(t.at[end]), 0
        if overlap and end < last:
            lo = int(np.searchsorted(t.sum, t.sum[end] - overlap, side="left"))
            w = words[np.searchsorted(words, lo, side="left") : np.searchsorted(words, end, side="left")]
            if len(w):
                start = int(w[0])
                first = int(t.at[start])
            else:
                start, first, head = _begin(t, count, lo, end, overlap)
    return out


def split_corpus(
    docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP,
    tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY,
) -> DataFrame:
    """(key, piece_no, char_from, char_to, n_tokens, overlap_tokens, cut, piece): all pieces of all texts.

    char_from and char_to count characters from 0; the pieces of a text cover it
    without a gap. cut is the separator level at a piece's end, `end` at the
    text's. NULL and empty texts give one row with 0 tokens and that text.
    Repeated rows give repeated pieces. No shuffle; other columns are never
    looked at.
    """
    path = f"{tokenizers.rstrip('/')}/{vocabulary}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            row, pieces, cut = [], [], []
            for i, (t, known) in enumerate(zip(texts, list(e.pieces(texts)))):
                for n, p in enumerate(split_text(t, e, limit, overlap, known)):
                    row.append(i)
                    pieces.append((n, p.start, p.end, p.tokens, p.overlap, p.cut))
                    cut.append(t if t is None else t[p.start : p.end])
            columns = list(zip(*pieces)) if pieces else [[] for _ in range(6)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(row, type=pa.int64())),
                    pa.array(columns[0], type=pa.int32()),
                    *[pa.array(columns[i], type=pa.int64()) for i in (1, 2)],
                    *[pa.array(columns[i], type=pa.int32()) for i in (3, 4)],
                    pa.array(columns[5], type=pa.string()),
                    pa.array(cut, type=pa.string()),
                ],
                names=["key", "piece_no", "char_from", "char_to", "n_tokens", "overlap_tokens", "cut", "piece"],
            )

    kind = dict(docs.dtypes)[key]
    schema = f"key {kind}, piece_no int, char_from bigint, char_to bigint, n_tokens int, overlap_tokens int, cut string, piece string"
    return docs.select(key, text).mapInArrow(run, schema).withColumnRenamed("key", key)
