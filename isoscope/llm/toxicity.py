"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text is the set of its character 3-, 4- and 5-grams (code points, A-Z lower-cased),
hashed to 2 ** BITS slots.  From labelled rows each slot gets the naive Bayes log-count
ratio of its smoothed shares among toxic and clean texts; a present slot has that ratio as
its value.  A logistic regression over these values is fitted on the same rows, its score
is calibrated on every fifth of them (Platt, with the class rates of all labelled rows)
and compared with a fixed threshold.  Scoring is a gather and a sum per document in Arrow
batches: no shuffle, no state but the weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isoscope.llm.arrays import Block, U, blocks, extended

BITS = 18
SIZES = (3, 4, 5)
SAMPLE_ROWS = 1500  # labelled rows of each class that the fit sees at most
TOXIC_AT = 0.7
SMOOTHING = 1.0
WEAK = 1.0
FOLDS, HELD_FOLD = 3, 1
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD1B54A32D192ED03,
               0xA0761D6478BD642F)
STARTS_CHAR = (np.arange(256) & 0xC0) != 0x80


def held_out(doc_id) -> F.Column:
    """Whether no label of the document may be learned; a null id counts as an empty one."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_FOLD


# -- features ------------------------------------------------------------------------
def code_points(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the block with A-Z lowered, and the documents' offsets into them."""
    points = np.frombuffer(block.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    upper = (points >= 0x41) & (points <= 0x5A)
    before = np.concatenate(([0], np.cumsum(STARTS_CHAR[block.data])))
    return points + upper * np.uint32(32), before[block.offsets]


def slots_of(block: Block) -> Iterator[np.ndarray]:
    """Per document the distinct slots of its character n-grams, ascending.  A text of
    fewer characters than the shortest n-gram has none."""
    points, cuts = code_points(block)
    terms = [points.astype(U) * U(m) for m in MULTIPLIERS[:max(SIZES)]]
    grams = []
    with np.errstate(over="ignore"):
        for size in SIZES:
            n = max(len(points) - size + 1, 0)
            total = np.full(n, U(size) * U(0xE7037ED1A0B428DB))
            for j in range(size):
                total += terms[j][j:j + n]
            total ^= total >> U(29)
            grams.append(((total * U(MULTIPLIERS[0])) >> U(64 - BITS)).astype(np.int32))
    seen = np.zeros(1 << BITS, bool)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = [g[a:max(b - size + 1, a)] for g, size in zip(grams, SIZES, strict=True)]
        for slots in own:
            seen[slots] = True
        yield np.flatnonzero(seen)
        for slots in own:
            seen[slots] = False


class Model(NamedTuple):
    weights: np.ndarray  # float32, 2 ** BITS: regression weight times log-count ratio
    bias: float
    slope: float  # calibration: p = 1 / (1 + exp(-(slope * score + shift)))
    shift: float

    def probability(self, score):
        return 1 / (1 + np.exp(-np.clip(self.slope * score + self.shift, -40, 40)))


def raw_score(weights: np.ndarray, slots: np.ndarray) -> float:
    """Sum of the present slots' weights, over the square root of their number: long texts
    have more noise to sum."""
    return float(weights[slots].sum()) / max(len(slots), 1) ** 0.5


# -- fitting -------------------------------------------------------------------------
def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, toxic, rate, text): at most `rows` documents of each class, those whose hashed
    doc_id is smallest, never held-out ones.  `rate` is the class's number of labels.

    Of several labels of one document the larger counts, of several texts the least.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    )
    first = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = known.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= rows)
    # two rows of counts, at most 2 * `rows` short rows: small by construction
    rates = known.groupBy("toxic").agg(F.count(F.lit(1)).alias("rate"))
    few = chosen.drop("_n").join(F.broadcast(rates), "toxic")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(few), "doc_id").groupBy("doc_id", "toxic", "rate").agg(
        F.min("text").alias("text"))


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [s.astype(np.int32).tobytes()
                 for block in blocks(batch.column("text")) for s in slots_of(block)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("toxic"), batch.column("rate"),
             pa.array(found, pa.binary())], ["doc_id", "toxic", "rate", "slots"])


def log_count_ratios(slots: np.ndarray, row: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Naive Bayes: log of the smoothed share of each slot among the slots of toxic texts
    over that among the slots of clean ones.  Slots of a single text, and slots whose ratio
    is nearer to 0 than WEAK, have no say: they carry noise and most of the work."""
    toxic = np.bincount(slots[y[row] == 1], minlength=1 << BITS)
    clean = np.bincount(slots[y[row] == 0], minlength=1 << BITS)
    p, q = toxic + SMOOTHING, clean + SMOOTHING
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    return np.where((toxic + clean > 1) & (np.abs(ratio) >= WEAK), ratio, 0.0)


def _descend(slots, row, values, y, steps: int = 150, ridge: float = 1e-4):
    """Logistic regression by Adam over sparse rows; both classes weigh the same."""
    w, b = np.zeros(1 << BITS), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    share = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    for t in range(1, steps + 1):
        z = np.bincount(row, weights=w[slots] * values, minlength=len(y)) + b
        err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * share
        g = np.bincount(slots, weights=err[row] * values, minlength=1 << BITS) + ridge * w
        gb = err.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate = 0.02 * np.sqrt(1 - 0.999 ** t) / (1 - 0.9 ** t)
        w -= rate * m / (np.sqrt(v) + 1e-9)
        b -= rate * mb / (np.sqrt(vb) + 1e-9)
    return w, b


def _platt(score: np.ndarray, y: np.ndarray, rates: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton steps with Platt's smoothed targets; `rates` weighs the
    rows so that the classes stand as among all labelled rows."""
    good, bad = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    weight = rates / np.where(y == 1, good, bad)
    weight = weight / weight.mean()
    x = np.stack([score, np.ones_like(score)])
    theta = np.array([0.0, np.log(weight[y == 1].sum() / weight[y == 0].sum())])

    def loss(t):
        z = np.clip(t @ x, -40, 40)
        return (weight * (np.logaddexp(0, z) - target * z)).sum() + 1e-4 * t[0] ** 2

    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(theta @ x, -40, 40)))
        hess = (x * (weight * p * (1 - p))) @ x.T + np.diag([2e-4, 1e-9])
        step = np.linalg.solve(hess, x @ (weight * (p - target)) + np.array([2e-4 * theta[0], 0]))
        while loss(theta - step) > loss(theta) and np.abs(step).max() > 1e-9:
            step = step / 2
        theta = theta - step
    return float(theta[0]), float(theta[1])


def fitted(doc_slots: list[np.ndarray], y: np.ndarray, rates: np.ndarray) -> Model | None:
    """The calibrated model of sampled rows, or None where they lack one of the classes.
    Every fifth row of each class is kept from the weights and used to calibrate; where
    that leaves a class empty, all rows serve both."""
    if len(np.unique(y)) < 2:
        return None
    kept = np.zeros(len(y), bool)
    for c in (0, 1):
        at = np.flatnonzero(y == c)
        kept[at[4::5]] = True
    if len(np.unique(y[kept])) < 2:
        kept[:] = False

    def stacked(which):
        rows = [doc_slots[i] for i in np.flatnonzero(which)]
        return np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(s) for s in rows])

    slots, row = stacked(~kept)
    ratio = log_count_ratios(slots, row, y[~kept])
    size = np.sqrt(np.maximum(np.bincount(row, minlength=int((~kept).sum())), 1))
    telling = ratio[slots] != 0
    slots, row = slots[telling], row[telling]
    w, b = _descend(slots, row, ratio[slots] / size[row], y[~kept])
    weights = (w * ratio).astype(np.float32)
    tested = kept if kept.any() else ~kept
    score = np.array([raw_score(weights, doc_slots[i]) + b for i in np.flatnonzero(tested)])
    slope, shift = _platt(score, y[tested], rates[tested].astype(float))
    return Model(weights, b, slope, shift)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model | None:
    """The model of a bounded sample of labelled documents outside the held-out fold."""
    table = (
        labelled_sample(docs, labels, rows)
        .mapInArrow(_sparse, "doc_id bigint, toxic int, rate bigint, slots binary")
        .toPandas().sort_values("doc_id", kind="stable")
    )
    return fitted([np.frombuffer(s, np.int32) for s in table["slots"]],
                  table["toxic"].to_numpy(), table["rate"].to_numpy())


# -- the operator --------------------------------------------------------------------
def scored(docs: DataFrame, model: Model | None, text: str = "text",
           toxic_at: float = TOXIC_AT) -> DataFrame:
    """The columns of `docs` (those named like a result column excepted) plus `score`, the
    calibrated probability that the text is toxic, and `predicted`, 1 from `toxic_at` on.

    Null and empty texts have no n-gram and the score of the bias alone.  Without a model
    every score is 0.  An empty table gives an empty result; texts are scored whole,
    whatever their length; equal texts get equal scores.
    """
    docs = docs.drop("score", "predicted")
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = [
                0.0 if model is None else model.probability(
                    raw_score(model.weights, slots) + model.bias)
                for block in blocks(batch.column(text)) for slots in slots_of(block)]
            p = np.array(p, float)
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in schema] + [pa.array(p), pa.array(
                    (p >= toxic_at).astype(np.int32))],
                [f.name for f in schema] + ["score", "predicted"])

    return docs.mapInArrow(run, extended(schema, "score double, predicted int"))


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; see `fit` and `scored`."""
    plain = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return scored(plain, fit(docs, labels)).drop("text")
