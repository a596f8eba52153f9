"""Secret scans with a recursive decoding worklist.

A text is scanned by the base rules; then every encoded run in it (percent escapes,
Unicode escapes, base64, and compressed data inside base64) is unwrapped into a layer
of its own, which is scanned and searched for encoded runs in turn, until no new layer
appears.  Base64 may go on over line ends, and compressed data may be compressed again or
have several members.  Layers already seen in the text are not entered again, so self-reproducing
data ends.  A layer keeps, for each of its characters, the span of the original text it
came from, so every finding is reported in code points of the original text.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from isoscope.llm.arrays import extended, release_memory

KINDS = ["assign", "access", "hex", "oversize"]

# fixed patterns of the base rules
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = re.compile(r"passw|secret|token|api_?key", re.ASCII | re.IGNORECASE)
MIN_ASSIGNED, MIN_ACCESS = 6, 20

# encoded runs
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPES = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\U[0-9A-Fa-f]{8})+")
ONE_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|\\U([0-9A-Fa-f]{8})")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
# a run that goes on over line ends (the lookbehind keeps the search linear)
WRAPPED = re.compile(
    r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
ONE_LINE = re.compile(r"[A-Za-z0-9+/_=-]+")
LAYER_LIMIT = 1 << 26  # bytes; a larger layer is reported as `oversize`, not entered
XZ_MEMORY = 1 << 27  # preset 9 needs 65 MiB; a stream that asks for more is `oversize` too


class Refused(Exception):
    """A stream that needs more memory than is allowed."""


class Span(NamedTuple):
    kind: str
    start: int
    end: int


class Layer(NamedTuple):
    text: str
    start: list[int] | range  # original span of each character
    end: list[int] | range


def base_spans(text: str) -> list[Span]:
    out = []
    if WORDS.search(text):
        out += [Span("assign", *m.span()) for m in ASSIGN.finditer(text)
                if len(m[2]) >= MIN_ASSIGNED]
    if "AKIA" in text:
        out += [Span("access", *m.span()) for m in ACCESS.finditer(text)
                if m.end() - m.start() >= MIN_ACCESS]
    out += [Span("hex", *m.span()) for m in HEX.finditer(text)]
    return out


def _readable(data: bytes) -> str | None:
    """UTF-8 text with hardly any control characters."""
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    control = sum(c < " " and c not in "\t\n\r" for c in text)
    return text if text and control * 20 <= len(text) else None


def _inflater(data: bytes):
    if data[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if data[:1] == b"\x78":
        return zlib.decompressobj()
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor(memlimit=XZ_MEMORY)
    return None


def _unpacked(data: bytes) -> bytes | None:
    """Inflated data of all members of a gzip, zlib, bzip2 or xz stream, cut off just
    past the limit; None if there is no such stream."""
    out, size = [], 0
    while size <= LAYER_LIMIT:
        stream = _inflater(data)
        if stream is None:
            break
        try:
            out.append(stream.decompress(data, LAYER_LIMIT + 1 - size))
        except lzma.LZMAError as error:
            if "emory" in str(error):
                raise Refused from error
            break
        except (zlib.error, OSError, ValueError, EOFError):
            break
        size += len(out[-1])
        if not stream.eof:
            break
        data = stream.unused_data.lstrip(b"\0")  # padding may stand between members
    return b"".join(out) or None


def _innermost(data: bytes) -> bytes | None:
    """What is left when no compressed stream is left to inflate; None if `data` is none
    or brings itself forth.  More than the limit is given back as it is."""
    inflated, seen = _unpacked(data), set()
    if inflated is None:
        return None
    while len(inflated) <= LAYER_LIMIT and _readable(inflated) is None:
        digest = hashlib.sha256(inflated).digest()
        if digest in seen:
            return None
        seen.add(digest)
        deeper = _unpacked(inflated)
        if deeper is None:
            break
        inflated = deeper
    return inflated


def _spelled_out(layer: Layer, runs: re.Pattern, decode) -> Layer | None:
    """The layer with every encoded run replaced by its text, or None if none decodes.
    The rest stays, so a finding may reach from plain into decoded text.  `decode` gives
    (text, number of characters behind each of its characters) or None."""
    parts, start, end, at = [], [], [], 0
    for m in runs.finditer(layer.text):
        found = decode(m[0])
        if found is None:
            continue
        a, b = m.span()
        text, sizes = found
        parts += [layer.text[at:a], text]
        start += layer.start[at:a]
        end += layer.end[at:a]
        for size in sizes:
            start.append(layer.start[a])
            a += size
            end.append(layer.end[a - 1])
        at = b
    if not at:
        return None
    return Layer("".join([*parts, layer.text[at:]]), [*start, *layer.start[at:]],
                 [*end, *layer.end[at:]])


def _percent(run: str) -> tuple[str, list[int]] | None:
    text = _readable(bytes.fromhex(run.replace("%", "")))
    return text and (text, [3 * len(c.encode()) for c in text])


def _escapes(run: str) -> tuple[str, list[int]] | None:
    chars, sizes = [], []
    for m in ONE_ESCAPE.finditer(run):
        number, size = int(next(g for g in m.groups() if g), 16), len(m[0])
        if number > 0x10FFFF:
            return None
        if chars and 0xDC00 <= number < 0xE000 and "\ud800" <= chars[-1] < "\udc00":
            # two halves of one character
            number = 0x10000 + ((ord(chars.pop()) - 0xD800) << 10) + number - 0xDC00
            size += sizes.pop()
        chars.append(chr(number))
        sizes.append(size)
    text = "".join(chars)
    return None if re.search("[\ud800-\udfff]", text) else (text, sizes)


def _by_characters(text: str, start: list[int], end: list[int]) -> Layer:
    """From spans per byte to spans per character."""
    if len(text) == len(start):
        return Layer(text, start, end)
    first, last, at = [], [], 0
    for c in text:
        n = len(c.encode())
        first.append(start[at])
        last.append(end[at + n - 1])
        at += n
    return Layer(text, first, last)


def _base64(layer: Layer, at: range | list[int]) -> list[Layer]:
    """The layer behind the characters at the given places."""
    run = "".join([layer.text[i] for i in at]) if isinstance(at, list) else layer.text[at.start:at.stop]
    run = run.rstrip("=")
    run = run[:len(run) - (len(run) % 4 == 1)]
    try:
        data = base64.b64decode(run.replace("-", "+").replace("_", "/") + "=" * (-len(run) % 4))
    except binascii.Error:
        return []
    text = _readable(data)
    if text is not None:
        # three bytes come from four characters
        start = [layer.start[at[i // 3 * 4 + i % 3]] for i in range(len(data))]
        end = [layer.end[at[min(i // 3 * 4 + i % 3 + 1, len(at) - 1)]] for i in range(len(data))]
        return [_by_characters(text, start, end)]
    start, end = layer.start[at[0]], layer.end[at[-1]]
    try:
        inflated = _innermost(data)
    except Refused:
        return [Layer("", [start], [end])]
    if not inflated:
        return []
    if len(inflated) > LAYER_LIMIT:
        return [Layer("", [start], [end])]
    text = inflated.decode("utf-8", "replace")
    return [Layer(text, [start] * len(text), [end] * len(text))]


def _wrapped(layer: Layer, a: int, b: int) -> Iterator[list[int]]:
    """Places of the characters of runs over several lines: all lines together, and each
    block of equally long lines with and without the shorter line that ends it."""
    lines = [range(*m.span()) for m in ONE_LINE.finditer(layer.text, a, b)]
    places = lambda part: [i for line in part for i in line]
    yield places(lines)
    first = 0
    while first < len(lines):
        last = first + 1
        while last < len(lines) and len(lines[last]) == len(lines[first]):
            last += 1
        if last - first > 1:
            yield places(lines[first:last])
        if last < len(lines) and len(lines[last]) < len(lines[first]):
            yield places(lines[first:last + 1])
        first = last


def unwrapped(layer: Layer) -> Iterator[Layer]:
    for mark, runs, decode in (("%", PERCENT, _percent), ("\\", ESCAPES, _escapes)):
        if mark in layer.text:
            inner = _spelled_out(layer, runs, decode)
            if inner is not None:
                yield inner
    for m in BASE64.finditer(layer.text):
        yield from _base64(layer, range(*m.span()))
    if "\n" in layer.text:
        for m in WRAPPED.finditer(layer.text):
            for at in _wrapped(layer, *m.span()):
                yield from _base64(layer, at)


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, base and decoded spans), each sorted by start, kind, end."""
    rank = {k: i for i, k in enumerate(KINDS)}
    order = lambda s: (s.start, rank[s.kind], s.end)
    base = sorted(base_spans(text), key=order)
    found, seen = set(base), {hashlib.sha256(text.encode()).digest()}
    work = [Layer(text, range(len(text)), range(1, len(text) + 1))]
    while work:
        layer = work.pop()
        for inner in unwrapped(layer):
            if not inner.text and inner.start:
                found.add(Span("oversize", inner.start[0], inner.end[0]))
                continue
            key = hashlib.sha256(
                f"{inner.start[0]}:{inner.end[-1]}:{inner.text}".encode())
            if key.digest() in seen:
                continue
            seen.add(key.digest())
            found |= {Span(s.kind, inner.start[s.start], inner.end[s.end - 1])
                      for s in base_spans(inner.text)}
            work.append(inner)
    return base, sorted(found, key=order)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


SCANNED = ("n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, "
           "base_spans string, spans string")


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns (those named like a result column replaced) plus counts and spans.

    Null text counts as empty; equal rows get equal results; an empty table gives an
    empty result.
    """
    names = [c.split()[0] for c in SCANNED.split(", ")]
    docs = docs.drop(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(text).to_pylist():
                base, found = all_spans(value or "")
                kinds = [s.kind for s in base]
                line = joined(base)
                rows.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"),
                             hashlib.sha256(line.encode()).hexdigest(), line, joined(found)))
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            types = [pa.int64()] * 3 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays(
                batch.columns + [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                batch.schema.names + names)

    return docs.mapInArrow(run, extended(docs.schema, SCANNED))


MARK = "[secret]"
ROWS = 1000  # texts of a batch that are masked at once


def masked(text: str, mark: str = MARK) -> str:
    """The text with every found span, merged where they overlap, replaced."""
    out, at = [], 0
    for span in all_spans(text)[1]:
        if span.start >= at:
            out += [text[at:span.start], mark]
        at = max(at, span.end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, text: str = "text", mark: str = MARK) -> DataFrame:
    """The same rows and columns with secrets masked; null text stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()  # of the stages that this worker has served
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                batch = whole.slice(first, ROWS)
                clean = pa.array(
                    [None if t is None else masked(t, mark) for t in batch.column(text).to_pylist()],
                    pa.string())
                at = batch.schema.names.index(text)
                yield pa.RecordBatch.from_arrays(
                    [clean if i == at else c for i, c in enumerate(batch.columns)],
                    batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
