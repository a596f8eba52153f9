"""Periodic runs of words: maximal repetitions by difference-cover extension queries.

A run of smallest period q and length L >= max(MIN_LENGTH, MIN_POWER * q) holds, for a
stretch of at least max(MIN_LENGTH, MIN_POWER * q) - q positions i, the same word at i and
i + q.  So a grid of that spacing (a harmonic series over all q: n log n points) meets
every run, and a grid point with equal words is extended to both sides by a query for the
longest common extension of two positions.

Extensions compare a few words up to a shift that takes both positions into a difference
cover: a set of residues that contains, for any two positions, a common shift less than its
modulus.  Only the suffixes at cover positions are sorted, by doubling over windows of one
modulus; a sparse table over the common prefixes of neighbours answers the rest of a query.
Both structures are built only for the texts with a query that the few words leave open.

All of it is arithmetic over whole blocks of texts inside Arrow batches: no shuffle.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from isoscope.llm.arrays import NOT_SPACE, Block, Words, blocks, extended, find_words

MIN_LENGTH, MIN_POWER = 6, 4
FEW = 3  # words that every extension compares before it looks for the cover
MAX_PAIRS = 1 << 20  # grid points tested at once
# perfect difference sets: every residue is exactly one difference of two members
SMALL_COVER = (13, (0, 1, 3, 9))
LARGE_COVER = (57, (0, 1, 3, 13, 32, 36, 43, 52))
LARGE_FROM = 1 << 18  # words from which the sparser cover saves more memory than it costs time


# -- longest common extensions ---------------------------------------------------------
def cover_shifts(modulus: int, cover: tuple[int, ...], least: int) -> np.ndarray:
    """[a, b] -> smallest shift >= `least` that takes residues a and b into the cover."""
    inside = np.zeros(modulus, bool)
    inside[list(cover)] = True
    out = np.full((modulus, modulus), -1)
    a, b = np.meshgrid(np.arange(modulus), np.arange(modulus), indexing="ij")
    for shift in range(least, least + modulus):
        new = (out < 0) & inside[(a + shift) % modulus] & inside[(b + shift) % modulus]
        out[new] = shift
    return out


class CoverSuffixes:
    """Longest common prefixes of suffixes of `ids` at cover positions.  No two suffixes
    may share an end: the caller ends every text with a value that occurs once."""

    def __init__(self, ids: np.ndarray, modulus: int, cover: tuple[int, ...]):
        self.modulus, self.width = modulus, len(cover)
        rows = len(ids) // modulus + 2
        # what follows the text occurs once, so no two suffixes are equal
        padded = int(ids.max(initial=0)) + 1 + np.arange((rows + 1) * modulus, dtype=np.int64)
        padded[:len(ids)] = ids
        self.padded = padded
        self.place = np.full(modulus, -1)
        self.place[list(cover)] = np.arange(len(cover))
        at = (np.arange(rows)[:, None] * modulus + np.array(cover)).ravel()
        self.at, m = at, len(at)
        bits = int(padded.max()).bit_length()
        per, keys = max(63 // bits, 1), []
        for lo in range(0, modulus, per):
            key = np.zeros(m, np.int64)
            for j in range(lo, min(lo + per, modulus)):
                key = (key << bits) | padded[at + j]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.zeros(m, bool)
        for key in keys:
            new[1:] |= key[order][1:] != key[order][:-1]
        ranks = np.empty(m, np.int64)
        ranks[order] = np.cumsum(new)
        self.levels = [ranks]
        step = self.width  # entries of `at` that lie one modulus apart
        while ranks.max() < m - 1:
            ahead = np.full(m, -1, np.int64)
            ahead[:max(m - step, 0)] = ranks[step:]
            pair = ranks * (m + 1) + ahead + 1
            order = np.argsort(pair, kind="stable")
            new = np.concatenate(([False], pair[order][1:] != pair[order][:-1]))
            ranks = np.empty(m, np.int64)
            ranks[order] = np.cumsum(new)
            self.levels.append(ranks)
            step *= 2
        self.rank = ranks
        self.table, half = [self._neighbours(order).astype(np.int32)], 1
        while 2 * half <= len(self.table[0]):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-half], last[half:]))
            half *= 2

    def _neighbours(self, order: np.ndarray) -> np.ndarray:
        """Common prefix of each suffix in order with the next one, from the levels."""
        a, b = order[:-1].copy(), order[1:].copy()
        m, total = len(order), np.zeros(max(len(order) - 1, 0), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            ranks = np.append(self.levels[level], -1)
            same = (ranks[np.minimum(a, m)] == ranks[np.minimum(b, m)]) & (a < m) & (b < m)
            span = self.width << level
            total += np.where(same, self.modulus << level, 0)
            a, b = a + same * span, b + same * span
        start, end = order[:-1], order[1:]
        return total + compared(self.padded, self.at[start] + total, self.at[end] + total,
                                np.full(len(total), self.modulus))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common prefix of the suffixes at cover positions i != j."""
        entry = lambda p: p // self.modulus * self.width + self.place[p % self.modulus]
        a, b = self.rank[entry(i)], self.rank[entry(j)]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((hi - lo).astype(float))[1] - 1
        out = np.zeros(len(i), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            row = self.table[k]
            out[at] = np.minimum(row[lo[at]], row[hi[at] - (1 << int(k))])
        return out


def compared(ids: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Equal words from i and j on, counted one by one, at most `most`.  Positions past
    the end, where nothing is equal, stop the count."""
    out = np.zeros(len(i), np.int64)
    open_, n = np.flatnonzero(most > 0), len(ids)
    while len(open_):
        a, b = i[open_] + out[open_], j[open_] + out[open_]
        inside = (a < n) & (b < n)
        same = inside & (ids[np.minimum(a, n - 1)] == ids[np.minimum(b, n - 1)])
        open_ = open_[same]
        out[open_] += 1
        open_ = open_[out[open_] < most[open_]]
    return out


class Extender:
    """Forward extensions over the texts of a block, each ended by its own separator."""

    def __init__(self, ids: np.ndarray, first: np.ndarray):
        self.ids, self.first, self.made = ids, first, None
        longest = int(np.diff(first).max(initial=0))
        self.modulus, self.cover = LARGE_COVER if longest >= LARGE_FROM else SMALL_COVER
        self.shift = cover_shifts(self.modulus, self.cover, FEW)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words from i and from j on.  i, j: positions of one text, i != j."""
        shift = self.shift[i % self.modulus, j % self.modulus]
        out = compared(self.ids, i, j, shift)
        left = np.flatnonzero(out == shift)
        if len(left):
            text = np.searchsorted(self.first, i[left], "right") - 1
            out[left] += self._beyond(i[left] + shift[left], j[left] + shift[left], text)
        return out

    def _beyond(self, i: np.ndarray, j: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Rest of the extension from cover positions.  Texts that need it are copied
        side by side, each at the residue it had; the copy serves later calls as well."""
        chosen = np.unique(text)
        if self.made is None or (self.made[0][chosen] < 0).any():
            self.made = self._structure(chosen)
        move, suffixes = self.made
        return suffixes.common(i + move[text] - self.first[text], j + move[text] - self.first[text])

    def _structure(self, chosen: np.ndarray) -> tuple[np.ndarray, CoverSuffixes]:
        """Place of each copied text (-1: not copied) and the sorted suffixes."""
        m = self.modulus
        size = self.first[chosen + 1] - self.first[chosen]
        at, places = 0, []
        for t, n in zip(chosen, size, strict=True):
            at += int(self.first[t] - at) % m
            places.append(at)
            at += int(n)
        places = np.array(places)
        packed = -1 - np.arange(at, dtype=np.int64)  # what no text fills differs everywhere
        for t, p, n in zip(chosen, places, size, strict=True):
            packed[p:p + n] = self.ids[self.first[t]:self.first[t] + n]
        _, packed = np.unique(packed, return_inverse=True)
        place = np.full(len(self.first) - 1, -1, np.int64)
        place[chosen] = places
        return place, CoverSuffixes(packed, m, self.cover)


# -- runs --------------------------------------------------------------------------------
class Runs(NamedTuple):
    text: np.ndarray
    start: np.ndarray  # word of its text
    length: np.ndarray
    period: np.ndarray


def find_runs(ids: np.ndarray, counts: np.ndarray) -> Runs:
    """All runs of each text; `ids` are word numbers, text after text, `counts` their
    numbers.  Ordered by text, start, period."""
    first = np.concatenate(([0], np.cumsum(counts)))
    # a separator after each text, so that no extension leaves it
    ends = first[1:] + np.arange(len(counts))
    spaced = np.zeros(len(ids) + len(counts), np.int64)
    of = np.repeat(np.arange(len(counts)), counts)
    spaced[np.arange(len(ids)) + of] = ids
    spaced[ends] = (int(ids.max(initial=0)) + 1) + np.arange(len(counts))
    cuts = np.concatenate(([0], ends + 1))
    forward = Extender(spaced, cuts)
    # mirrored, each text is ended by the separator of the one before it, the first by nothing
    mirror = spaced[::-1]
    backward = Extender(mirror, np.concatenate(([0], (len(spaced) - ends)[::-1], [len(spaced)])))

    found = [np.zeros((4, 0), np.int64)]
    for i, q, text in _grid(spaced, cuts, counts):
        ahead = forward(i, i + q)
        # positions before i and i + q; at the start of a text the extension is 0
        open_ = i > cuts[text]
        back = np.zeros(len(i), np.int64)
        back[open_] = backward(len(spaced) - i[open_], len(spaced) - i[open_] - q[open_])
        length = ahead + back + q
        long_enough = length >= np.maximum(MIN_LENGTH, MIN_POWER * q)
        found.append(np.unique(np.stack(
            [text, i - back - cuts[text], length, q])[:, long_enough], axis=1))
    text, start, length, period = np.concatenate(found, axis=1)
    # one stretch with several periods has the smallest one; it was found with that too
    order = np.lexsort((period, length, start, text))
    text, start, length, period = text[order], start[order], length[order], period[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    order = np.flatnonzero(new)
    order = order[np.lexsort((period[order], start[order], text[order]))]
    return Runs(text[order], start[order], length[order], period[order])


def _grid(ids: np.ndarray, cuts: np.ndarray, counts: np.ndarray):
    """Grid points (position, period, text) with equal words, a bounded number at a time."""
    most = np.where(counts >= MIN_LENGTH, counts // MIN_POWER, 0)
    text = np.repeat(np.arange(len(counts)), most)
    q = 1 + np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most)
    step = np.maximum(MIN_LENGTH, MIN_POWER * q) - q
    points = (counts[text] - 1 - q) // step + 1
    total = np.concatenate(([0], np.cumsum(points)))
    lo = 0
    while lo < len(text):
        hi = max(int(np.searchsorted(total, total[lo] + MAX_PAIRS, "right")) - 1, lo + 1)
        n = points[lo:hi]
        row = np.repeat(np.arange(lo, hi), n)
        i = cuts[text[row]] + step[row] * (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))
        same = np.flatnonzero(ids[i] == ids[i + q[row]])
        if len(same):
            yield i[same], q[row[same]], text[row[same]]
        lo = hi


# -- words ---------------------------------------------------------------------------------
def word_numbers(block: Block, words: Words) -> np.ndarray:
    """A number per word, equal for equal words (exactly: by their bytes)."""
    size = words.end - words.start
    if not len(size):
        return np.zeros(0, np.int64)
    cuts = np.concatenate(([0], np.cumsum(size)))
    data = block.data[NOT_SPACE[block.data]]
    column = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(size), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)])
    return column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def planted_order(doc_id: int | None, n: int) -> np.ndarray | None:
    """Word numbers of the text that the query plants a run into, None for the others: a
    hash of the id picks a tenth of the texts, start and period."""
    g, pick = divmod(zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), 10)
    if pick or not n:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    out = np.arange(n)
    out[a:] = a + (out[a:] - a) % p
    return out


def collapsed_text(block: Block, words: Words, at: np.ndarray) -> bytes:
    """The given words, joined by single spaces."""
    size = words.end[at] - words.start[at] + 1
    if not len(at):
        return b""
    ends = np.cumsum(size)
    source = np.repeat(words.start[at] - (ends - size), size) + np.arange(ends[-1])
    out = block.data[np.minimum(source, len(block.data) - 1)].copy()
    out[ends - 1] = 0x20
    return out[:-1].tobytes()


RUN_COLUMNS = (
    "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
    "runs array<struct<start bigint, length bigint, period bigint>>, collapsed string, "
    "runs_sha256 string, collapsed_sha256 string"
)
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def with_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
              reorder: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """The columns of `docs` (those named like a result column excepted) plus all runs of
    each text, its longest run, and the text with every run cut to its first period.

    Words are `[^\\x20\\x09-\\x0D]+`.  A null or empty text has no word and no run.  The
    longest run is null where there is none; ties go to the smallest start, then period.
    Texts of any length are taken whole: a block of half a megabyte of texts, or one
    longer text, is in memory at a time.  Repeated rows and ids each get their own result;
    an empty table gives an empty result.  `reorder` (doc_id, n words) may give another
    order of a text's words before runs are sought.
    """
    names = ["n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed",
             "runs_sha256", "collapsed_sha256"]
    docs = docs.drop(*[n for n in names if n not in (text, doc_id)])
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(doc_id).to_pylist(), batch.column(text)
            out: list[list] = [[] for _ in names]
            for block in blocks(column):
                for row in _rows(block, ids[block.first:block.first + block.n], reorder):
                    for into, value in zip(out, row, strict=True):
                        into.append(value)
            types = [pa.int64()] * 5 + [pa.list_(_RUN)] + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in schema]
                + [pa.array(v, t) for v, t in zip(out, types, strict=True)],
                [f.name for f in schema] + names)

    return docs.mapInArrow(run, extended(schema, RUN_COLUMNS))


def _rows(block: Block, ids: list, reorder) -> Iterator[tuple]:
    words = find_words(block, NOT_SPACE)
    source = np.arange(len(words.start))
    for d, i in enumerate(ids):
        order = reorder(i, int(words.counts[d])) if reorder else None
        if order is not None:
            source[words.first[d]:words.first[d + 1]] = words.first[d] + order
    found = find_runs(word_numbers(block, words)[source], words.counts)
    cuts = np.searchsorted(found.text, np.arange(block.n + 1))
    for d in range(block.n):
        a, b = cuts[d], cuts[d + 1]
        start, length, period = found.start[a:b], found.length[a:b], found.period[a:b]
        # every run marks the words after its first period
        steps = np.zeros(words.counts[d] + 1, np.int64)
        np.add.at(steps, start + period, 1)
        np.add.at(steps, start + length, -1)
        kept = source[words.first[d]:words.first[d + 1]][np.cumsum(steps[:-1]) == 0]
        collapsed = collapsed_text(block, words, kept)
        listed = list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
        best = min(listed, key=lambda r: (-r[1], r[0], r[2]), default=None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in listed)
        yield (
            len(listed), *(best or (None, None, None)),
            1000 * best[1] // best[2] if best else None,
            [{"start": s, "length": n, "period": q} for s, n, q in listed],
            collapsed.decode("utf-8", "replace"),
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest())
