"""Byte-pair encoding and decoding from a vocabulary file of ranked merges.

A piece (one pre-token) becomes a doubly linked list of symbols; a priority queue of
(rank, position) yields the next merge, and entries whose symbols have changed since
are skipped.  Decoding concatenates the vocabulary's strings.

The file is a `tokenizers` JSON: NFC, white space collapsed, lower case, a splitting
pattern, byte-level symbols, and an end-of-word suffix on the last symbol of a piece.
Its special tokens are matched in the raw text.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from isoscope.llm.arrays import extended, worker_state

CACHE_PIECES = 300_000  # words and pieces a worker remembers; each memory then starts afresh
GROUP_CHARS = 2_000_000  # texts whose new pieces are merged together
VOCABULARY = "word_bpe_49k.json"


def byte_symbols() -> list[str]:
    """The printable character standing for each byte: printable Latin-1 characters
    for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str | None = None):
        import regex
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank_of = {vocab[a] << 20 | vocab[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.last = [vocab[s + self.suffix] for s in symbols]
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"]
                       if p["type"] == "Split")
        self.pieces = regex.compile(pattern).findall
        self.spaces = regex.compile(r"\s+")
        self.library = Tokenizer.from_file(path)
        self.specials = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        self.byte_of = {c: b for b, c in enumerate(symbols)}
        raw = self.byte_of if spec["decoder"] else None
        self.between = b"" if raw else b" "  # a file without decoder sets tokens apart
        table: dict[int, bytes] = {}
        for token, number in (*vocab.items(), *self.special.items()):
            known = [raw.get(c) for c in token] if raw else [None]
            table[number] = token.encode() if None in known else bytes(known)
        self.strings = [table.get(i, b"") for i in range(max(table) + 1)]
        self.known: dict[str, bytes] = {}
        self.known_pieces: dict[bytes, bytes] = {}

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token, given in UTF-8."""
        ids = [self.inner[b] for b in data]
        ids[-1] = self.last[data[-1]]
        n, rank_of, made = len(ids), self.rank_of.get, self.made
        # an entry is rank and position in one number, so equal ranks go left to right
        queue = [rank << 32 | i for i in range(n - 1)
                 if (rank := rank_of(ids[i] << 20 | ids[i + 1])) is not None]
        if not queue:
            return ids
        heapq.heapify(queue)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        while queue:
            entry = heapq.heappop(queue)
            rank, i = entry >> 32, entry & 0xFFFFFFFF
            j = after[i]
            if ids[i] < 0 or j < 0 or rank_of(ids[i] << 20 | ids[j]) != rank:
                continue  # stale: one of its symbols has changed
            ids[i] = merged = made[rank]
            ids[j] = -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (found := rank_of(merged << 20 | ids[k])) is not None:
                    heapq.heappush(queue, found << 32 | i)
            h = before[i]
            if h >= 0 and (found := rank_of(ids[h] << 20 | merged)) is not None:
                heapq.heappush(queue, found << 32 | h)
        return [t for t in ids if t >= 0]

    def _piece(self, data: bytes) -> bytes:
        packed = np.array(self.merge(data), "<u4").tobytes()
        if len(self.known_pieces) >= CACHE_PIECES:
            self.known_pieces.clear()
        self.known_pieces[data] = packed
        return packed

    def _word(self, word: str) -> bytes:
        """Packed ids of a chunk without white space."""
        pieces = [p.encode() for p in self.pieces(word)]
        if not word.isprintable() and any(unicodedata.category(c) == "Cn" for c in word):
            # characters newer than this Python's Unicode tables: normalised and cut by
            # the library's, which are newer
            found = self.library.pre_tokenizer.pre_tokenize_str(
                self.library.normalizer.normalize_str(word))
            pieces = [bytes([self.byte_of[c] for c in piece]) for piece, _ in found]
        known = self.known_pieces.get
        packed = b"".join([known(p) or self._piece(p) for p in pieces])
        self.known[word] = packed
        return packed

    def _plain(self, text: str) -> bytes:
        if len(self.known) >= CACHE_PIECES:
            self.known.clear()
        known, word = self.known.get, self._word
        return b"".join([known(w) or word(w) for w in self._normal(text)])

    def _normal(self, text: str) -> list[str]:
        """Normalised chunks without white space."""
        text = unicodedata.normalize("NFC", text)
        # character by character: no final sigma
        text = text.replace("Σ", "σ").lower()
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # space to Python, not to the pattern
            return [w for w in self.spaces.split(text) if w]
        return text.split()

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit numbers."""
        if "<|" not in text:
            return self._plain(text)
        out, at = [], 0
        for found in self.specials.finditer(text):
            out += [self._plain(text[at:found.start()]),
                    np.uint32(self.special[found[0]]).tobytes()]
            at = found.end()
        return b"".join([*out, self._plain(text[at:])])

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """As `encode` for each text; the new pieces of some million characters are
        merged together."""
        out, first, size = [], 0, 0
        collecting = gc.isenabled()
        gc.disable()  # a group makes many small objects and no cycles
        try:
            for i, text in enumerate(texts, 1):
                size += len(text)
                if size >= GROUP_CHARS or i == len(texts):
                    out += self._encode_group(texts[first:i])
                    first, size = i, 0
        finally:
            if collecting:
                gc.enable()
        return out

    def _encode_group(self, texts: list[str]) -> list[bytes]:
        chunks = [self._normal(t) if "<|" not in t else None for t in texts]
        seen = set().union(*(c for c in chunks if c is not None))
        if len(self.known) + len(seen) > CACHE_PIECES:
            self.known.clear()  # nothing below clears it before this group is packed
        fresh = seen.difference(self.known)
        letters = [w for w in fresh if w.isalpha()]  # a piece as it is
        whole = [w.encode() for w in letters]
        mixed = [w for w in fresh if not w.isalpha() and w.isprintable()]
        cut = [[p.encode() for p in self.pieces(w)] for w in mixed]
        pieces = {p for own in cut for p in own}.union(whole)
        if len(self.known_pieces) + len(pieces) > CACHE_PIECES:
            self.known_pieces.clear()
        known = self.known_pieces
        unknown = list(pieces.difference(known))
        known |= zip(unknown, merge_together(self, unknown), strict=True)
        self.known |= zip(letters, [known[p] for p in whole], strict=True)
        self.known |= zip(mixed, [b"".join([known[p] for p in own]) for own in cut], strict=True)
        for word in seen.difference(self.known):
            self._word(word)
        of = self.known.__getitem__
        packed = [None if c is None else b"".join(map(of, c)) for c in chunks]
        return [self.encode(t) if p is None else p for t, p in zip(texts, packed, strict=True)]

    def decode(self, ids: bytes) -> str:
        strings = self.strings
        numbers = np.frombuffer(ids, "<u4").tolist()
        return self.between.join([strings[i] for i in numbers]).decode("utf-8", "replace")


class MergeTable:
    """The merges as arrays: an open-addressing hash of pairs."""

    SLOTS = 1 << 19

    def __init__(self, own: Codec):
        self.key = np.full(self.SLOTS, -1, np.int64)
        self.rank = np.zeros(self.SLOTS, np.int64)
        for key, rank in own.rank_of.items():
            at = self._slot(key)
            while self.key[at] >= 0:
                at = (at + 1) % self.SLOTS
            self.key[at], self.rank[at] = key, rank
        self.made = np.array(own.made, np.int64)
        self.inner, self.last = np.array(own.inner, np.int64), np.array(own.last, np.int64)

    def _slot(self, key):
        return ((key * 0x9E3779B1) >> 13) % self.SLOTS

    def ranks(self, key: np.ndarray) -> np.ndarray:
        """Rank of each pair, or a number above all ranks."""
        out = np.full(len(key), len(self.made), np.int64)
        left, at = np.arange(len(key)), self._slot(key)
        while len(left):
            found = self.key[at]
            same = found == key[left]
            out[left[same]] = self.rank[at[same]]
            on = (found >= 0) & ~same
            left, at = left[on], (at[on] + 1) % self.SLOTS
        return out


def merge_together(own: Codec, pieces: list[bytes]) -> list[bytes]:
    """Packed ids of many pieces at once: in each step every unfinished piece merges the
    pair of its least rank, wherever it stands, from left to right.  (A pair that a merge
    creates always has a greater rank, so this is the order of the queue.)"""
    table = worker_state(f"merges:{id(own)}", lambda: MergeTable(own), "bpe")
    if not pieces:
        return []
    sizes = np.array([len(p) for p in pieces])
    ids = table.inner[np.frombuffer(b"".join(pieces), np.uint8)]
    ends = np.cumsum(sizes)
    ids[ends - 1] = table.last[np.frombuffer(b"".join([p[-1:] for p in pieces]), np.uint8)]
    word, none = np.repeat(np.arange(len(pieces)), sizes), len(table.made)
    done_ids, done_word = [], []
    while len(ids):
        rank = np.full(len(ids), none)
        inside = np.flatnonzero(word[1:] == word[:-1])
        rank[inside] = table.ranks(ids[inside] << 20 | ids[inside + 1])
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        counts = np.diff(np.append(first, len(ids)))
        best = np.repeat(np.minimum.reduceat(rank, first), counts)
        over = best == none
        done_ids.append(ids[over])
        done_word.append(word[over])
        hit = (rank == best) & ~over
        # of neighbouring hits (a pair of equal symbols) every second one stands
        at = np.flatnonzero(hit)
        opens = np.concatenate(([True], np.diff(at) > 1))
        place = np.arange(len(at)) - np.maximum.accumulate(np.where(opens, np.arange(len(at)), 0))
        at = at[place % 2 == 0]
        ids[at] = table.made[rank[at]]
        keep = ~over
        keep[at + 1] = False
        ids, word = ids[keep], word[keep]
    ids, word = np.concatenate(done_ids), np.concatenate(done_word)
    order = np.argsort(word, kind="stable")
    packed = ids[order].astype("<u4").tobytes()
    cuts = (4 * np.concatenate(([0], np.cumsum(np.bincount(word, minlength=len(pieces)))))).tolist()
    return [packed[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def codec(path: str | None = None) -> Codec:
    """This worker's codec for the file."""
    return worker_state(f"bpe:{path}", lambda: Codec(path), "bpe")


def encoded(docs: DataFrame, path: str | None = None, text: str = "text",
            out: str = "ids") -> DataFrame:
    """All columns plus `out`: the token ids as packed little-endian 32-bit numbers.

    Null text counts as empty, an existing column `out` is replaced.  `path` names the
    vocabulary file as the executors see it (default: the installed public one).
    """
    docs = docs.drop(out)
    schema = extended(docs.schema, f"`{out}` binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(path).encode
        for batch in batches:
            ids = [encode(t or "") for t in batch.column(text).to_pylist()]
            yield batch.append_column(out, pa.array(ids, pa.binary()))

    return docs.mapInArrow(run, schema)


def decoded(tokens: DataFrame, path: str | None = None, ids: str = "ids",
            out: str = "decoded") -> DataFrame:
    """All columns plus `out`: the text of the packed ids (null counts as none)."""
    tokens = tokens.drop(out)
    schema = extended(tokens.schema, f"`{out}` string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = codec(path).decode
        for batch in batches:
            texts = [decode(x or b"") for x in batch.column(ids).to_pylist()]
            yield batch.append_column(out, pa.array(texts, pa.string()))

    return tokens.mapInArrow(run, schema)


DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def round_trip_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document the number of tokens and the digests of its ids and of the decoded
    text; ids and texts stay in the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            ids = [own.encode(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                pa.array([hashlib.sha256(own.decode(x).encode()).hexdigest() for x in ids]),
            ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, DIGESTS)
