"""Quality rules: a repetition rule plus a calibrated hashed n-gram classifier.

Features are hashed byte n-grams (2 and 4 bytes) and word n-grams (1 and 2 words) of
the whole text, as relative frequencies per family.  A logistic regression over them
is fitted on labelled rows, its scores are calibrated on held-out labelled rows (Platt)
and compared with fixed thresholds.  Scoring is a gather and a segmented sum over Arrow
batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoscope.llm.arrays import (
    NOT_SPACE,
    Block,
    U,
    Words,
    blocks,
    extended,
    find_words,
    mix,
    span_hashes,
    window_hashes,
)

BITS = 18
FAMILIES = 4
SCALE = 30.0  # relative frequencies are small; this puts them near one
SAMPLE_ROWS = 2000  # labelled rows the fit sees at most; chosen by a hash of doc_id
KEEP_AT = 0.5  # calibrated probability of good quality from which a text is kept
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
STARTS_CHAR = (np.arange(256) & 0xC0) != 0x80
BLANKS = " \t\n\x0b\x0c\r"


# -- rules ---------------------------------------------------------------------------
def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(lines) - len(set(lines))


def repeated_words(hashes: np.ndarray, words: Words) -> np.ndarray:
    """Words inside 5-word windows that occur twice or more in their document."""
    wide = window_hashes(hashes, WINDOW)
    if not len(wide):
        return np.zeros(len(words.counts), np.int64)
    last = np.arange(len(wide)) + WINDOW - 1
    inside = words.doc[:len(wide)] == words.doc[last]
    at = np.flatnonzero(inside)
    with np.errstate(over="ignore"):
        own = mix(wide[at] + words.doc[at].astype(U) * U(0x9E3779B97F4A7C15))
    order = np.argsort(own, kind="stable")
    same = own[order][1:] == own[order][:-1]
    again = np.zeros(len(own), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    step = np.zeros(len(hashes) + 1, np.int64)
    step[at[again]] += 1
    np.subtract.at(step, at[again] + WINDOW, 1)
    covered = np.cumsum(step[:-1]) > 0
    return np.bincount(words.doc[covered], minlength=len(words.counts))


def per_document(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(mask)))
    return total[offsets[1:]] - total[offsets[:-1]]


# -- features ------------------------------------------------------------------------
def _slots(hashes: np.ndarray, family: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        salted = (hashes + U(family)) * U(0x9E3779B97F4A7C15)
    return (salted >> U(64 - BITS)).astype(np.int64)


def features(block: Block, words: Words, hashes: np.ndarray):
    """Per family: (slot of each n-gram, document of each n-gram)."""
    data, offsets = block.data, block.offsets
    wide = data.astype(np.uint32)
    doc = np.repeat(np.arange(block.n), np.diff(offsets))
    two = wide[:-1] | (wide[1:] << np.uint32(8))
    four = two[:-2] | (two[2:] << np.uint32(16)) if len(two) > 2 else two[:0]
    for family, (values, size) in enumerate(((two, 2), (four, 4))):
        inside = doc[:len(values)] == doc[size - 1:size - 1 + len(values)]
        yield _slots(values[inside].astype(U), family), doc[:len(values)][inside]
    yield _slots(hashes, 2), words.doc
    pairs = window_hashes(hashes, 2)
    inside = words.doc[:len(pairs)] == words.doc[1:len(pairs) + 1]
    yield _slots(pairs[inside], 3), words.doc[:len(pairs)][inside]


class Model(NamedTuple):
    weights: np.ndarray  # float32, 2 ** BITS
    bias: float
    slope: float  # calibration: p = 1 / (1 + exp(-(slope * score + shift)))
    shift: float

    def probability(self, score):
        return 1 / (1 + np.exp(-np.clip(self.slope * score + self.shift, -40, 40)))


def scores(model: Model, block: Block, words: Words, hashes: np.ndarray) -> np.ndarray:
    out = np.full(block.n, model.bias)
    for slots, doc in features(block, words, hashes):
        total = np.bincount(doc, weights=model.weights[slots], minlength=block.n)
        out += SCALE * total / np.maximum(np.bincount(doc, minlength=block.n), 1)
    return out


# -- fitting -------------------------------------------------------------------------
def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, quality, text) of at most `rows` labelled documents: those whose hashed
    doc_id is smallest, so the choice does not depend on order or partitions."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    # at most `rows` short rows: small by construction
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for block in blocks(batch.column("text")):
            words = find_words(block, NOT_SPACE)
            hashes = span_hashes(block.data, words.start, words.end)
            slots, values = [[] for _ in range(block.n)], [[] for _ in range(block.n)]
            for found, doc in features(block, words, hashes):
                key, n = np.unique(doc * (1 << BITS) + found, return_counts=True)
                of = key >> BITS
                total = np.bincount(of, weights=n, minlength=block.n)
                cuts = np.searchsorted(of, np.arange(block.n + 1))
                for d in range(block.n):
                    a, b = cuts[d], cuts[d + 1]
                    slots[d].append(key[a:b] & ((1 << BITS) - 1))
                    values[d].append(SCALE * n[a:b] / max(total[d], 1))
            out += [(np.concatenate(s).astype(np.int32).tobytes(),
                     np.concatenate(v).astype(np.float32).tobytes())
                    for s, v in zip(slots, values, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("quality").cast(pa.int32()),
             pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.binary())],
            ["doc_id", "quality", "slots", "values"])


def _descend(slots, values, cuts, y, steps: int = 120, ridge: float = 1e-4):
    """Logistic regression by Adam over sparse rows; both classes weigh the same."""
    w, b = np.zeros(1 << BITS), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    row = np.repeat(np.arange(len(y)), np.diff(cuts))
    share = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))
    for t in range(1, steps + 1):
        z = np.bincount(row, weights=w[slots] * values, minlength=len(y)) + b
        err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * share
        g = np.bincount(slots, weights=err[row] * values, minlength=1 << BITS) + ridge * w
        gb = err.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.05 * np.sqrt(1 - 0.999 ** t) / (1 - 0.9 ** t)
        w -= rate * m / (np.sqrt(v) + 1e-9)
        b -= rate * mb / (np.sqrt(vb) + 1e-9)
    return w, b


def _platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps, with Platt's smoothed targets."""
    good, bad = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.stack([score, np.ones_like(score)])
    theta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(theta @ x, -30, 30)))
        hess = (x * np.maximum(p * (1 - p), 1e-9)) @ x.T + 1e-6 * np.eye(2)
        theta = theta - np.linalg.solve(hess, x @ (p - target))
    return float(theta[0]), float(theta[1])


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model | None:
    """The calibrated model, or None where the labelled rows lack one of the classes.

    Every fifth sampled row is held out for the calibration.
    """
    table = (
        labelled_sample(docs, labels, rows)
        .mapInArrow(_sparse, "doc_id bigint, quality int, slots binary, values binary")
        .toPandas().sort_values("doc_id", kind="stable")
    )
    y = table["quality"].to_numpy()
    if len(np.unique(y)) < 2:
        return None
    held = np.arange(len(y)) % 5 == 4
    if len(np.unique(y[held])) < 2 or len(np.unique(y[~held])) < 2:
        held[:] = False

    def stacked(rows: np.ndarray):
        s = [np.frombuffer(x, np.int32) for x in table["slots"].to_numpy()[rows]]
        v = [np.frombuffer(x, np.float32) for x in table["values"].to_numpy()[rows]]
        cuts = np.concatenate(([0], np.cumsum([len(x) for x in s])))
        return np.concatenate(s), np.concatenate(v), cuts

    fitted = ~held
    w, b = _descend(*stacked(fitted), y[fitted])
    tested = held if held.any() else fitted
    slots, values, cuts = stacked(tested)
    row = np.repeat(np.arange(tested.sum()), np.diff(cuts))
    score = np.bincount(row, weights=w[slots] * values, minlength=int(tested.sum())) + b
    slope, shift = _platt(score, y[tested])
    return Model(w.astype(np.float32), b, slope, shift)


# -- the operator --------------------------------------------------------------------
RULE_COLUMNS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, base_failed boolean, p_quality double, kept boolean"
)


def judged(docs: DataFrame, model: Model | None, text: str = "text",
           keep_at: float = KEEP_AT, min_words: int = MIN_WORDS,
           max_repeat_percent: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """The columns of `docs` (those named like a result column excepted) plus counts,
    rule outcome, calibrated probability and verdict.

    Null text counts as empty and fails the base rule.  Without a model every
    probability is 1.  An empty table gives an empty result.
    """
    names = [c.split()[0] for c in RULE_COLUMNS.split(", ")]
    docs = docs.drop(*names)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text)
            found: list[list] = [[] for _ in names]
            for block in blocks(column):
                words = find_words(block, NOT_SPACE)
                hashes = span_hashes(block.data, words.start, words.end)
                is_word = NOT_SPACE[block.data]
                chars = per_document(is_word & STARTS_CHAR[block.data], block.offsets)
                symbols = per_document(SYMBOLS[block.data], block.offsets)
                repeat = repeated_words(hashes, words)
                lines = [repeated_lines(t or "")
                         for t in column.slice(block.first, block.n).to_pylist()]
                failed = (words.counts < min_words) | (
                    100 * repeat > max_repeat_percent * words.counts)
                p = np.ones(block.n) if model is None else model.probability(
                    scores(model, block, words, hashes))
                for into, values in zip(found, (words.counts, chars, symbols, lines, repeat,
                                                failed, p, ~failed & (p >= keep_at)), strict=True):
                    into.extend(values)
            arrays = [pa.array(v, t) for v, t in zip(
                found, [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in schema] + arrays,
                [f.name for f in schema] + names)

    return docs.mapInArrow(run, extended(schema, RULE_COLUMNS))
