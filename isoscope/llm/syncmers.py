"""Document fingerprints from closed syncmers.

A k-mer (k bytes of UTF-8) is chosen when the smallest of its inner s-mers, in hash
order, is its first or its last one.  The choice depends on the k-mer alone, so an
edit disturbs only the k-mers that touch it, and any run of 2k - s - 1 equal bytes
holds the same anchors at the same relative positions.

In a text of 2k - s bytes or more one is always chosen; of a shorter one (SURE) all k-mers
are anchors.  A text shorter than k bytes is a single anchor; an empty one (or null) has none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoscope.llm.arrays import Block, U, blocks, extended, mix, sliding_min, span_hashes

K, S = 32, 8
SURE = 2 * K - S - 1  # bytes from which on a text has a closed syncmer
BUCKETS_PER_PARTITION = 4


def _octets(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one number."""
    out = data.astype(U)
    for step in (1, 2, 4):
        out = out[:len(out) - step] | (out[step:] << U(8 * step))
    return out


def anchors_of_block(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte positions (inside their document), 32-bit hashes, and n + 1 offsets."""
    data, offsets = block.data, block.offsets
    size = np.diff(offsets)
    at, value = np.zeros(0, np.int64), np.zeros(0, np.uint32)
    if len(data) >= K:
        octets = _octets(data)
        order = mix(octets)
        least = sliding_min(order, K - S + 1)
        brief = np.repeat(size < SURE, size)[:len(least)]
        chosen = np.flatnonzero((least == order[:len(least)]) | (least == order[K - S:]) | brief)
        doc = np.searchsorted(offsets, chosen, "right") - 1
        inside = chosen + K <= offsets[doc + 1]
        at = chosen[inside]
        with np.errstate(over="ignore"):
            hashed = order[at]
            for j in range(S, K, S):
                hashed = mix(hashed * U(0x2545F4914F6CDD1D) + octets[at + j])
        value = (hashed >> U(32)).astype(np.uint32)
    short = np.flatnonzero((size > 0) & (size < K))
    if len(short):
        whole = span_hashes(data, offsets[short], offsets[short + 1])
        at = np.concatenate((at, offsets[short]))
        value = np.concatenate((value, (whole >> U(32)).astype(np.uint32)))
        order = np.argsort(at, kind="stable")
        at, value = at[order], value[order]
    cuts = np.searchsorted(at, offsets)
    return at - np.repeat(offsets[:-1], np.diff(cuts)), value, cuts


def anchors_of(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(positions, hashes) of each text."""
    out = []
    for block in blocks(pa.array(texts, pa.large_string())):
        at, value, cuts = anchors_of_block(block)
        out += [(at[a:b], value[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return out


def as_text(hashes: np.ndarray) -> str:
    return hashes.astype(">u4").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared anchors (with multiplicity) over the mean number of anchors; two empty
    fingerprints are alike."""
    if not len(a) and not len(b):
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if len(a) == len(b) and (a == b).all():
        return 1.0
    both = np.sort(np.concatenate((a.astype(U) << U(1), (b.astype(U) << U(1)) | U(1))))
    # inside a run of equal hashes the entries of `a` come first
    value, side = both >> U(1), (both & U(1)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
    total = np.diff(np.append(starts, len(value)))
    of_b = np.add.reduceat(side, starts)
    return float(2 * np.minimum(of_b, total - of_b).sum() / (len(a) + len(b)))


def aligned(a: tuple, b: tuple) -> tuple[int, int]:
    """Positional match: the most frequent shift between equal anchors that are unique
    in both texts, and how many anchors agree on it (0, 0 if none)."""
    (pos_a, hash_a), (pos_b, hash_b) = a, b
    ua, ia, ca = np.unique(hash_a, return_index=True, return_counts=True)
    ub, ib, cb = np.unique(hash_b, return_index=True, return_counts=True)
    ua, ia, ub, ib = ua[ca == 1], ia[ca == 1], ub[cb == 1], ib[cb == 1]
    _, x, y = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    if not len(x):
        return 0, 0
    shifts, votes = np.unique(pos_b[ib[y]] - pos_a[ia[x]], return_counts=True)
    best = int(np.argmax(votes))
    return int(shifts[best]), int(votes[best])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """All columns plus `out`: the anchors' hashes in text order, 8 hex digits each."""
    docs = docs.drop(out)
    schema = extended(docs.schema, f"`{out}` string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for block in blocks(batch.column(text)):
                _, value, cuts = anchors_of_block(block)
                found += [as_text(value[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield batch.append_column(out, pa.array(found, pa.string()))

    return docs.mapInArrow(run, schema)


def with_successors(docs: DataFrame) -> DataFrame:
    """Rows (bucket, kind, sort_id, doc_id, text) such that in the order (bucket, kind,
    sort_id, text) the row after a row of kind 0 is the next document of the table;
    the last document is followed by the first.  Texts are shuffled once.

    Buckets are ranges of doc_id.  The first document of a bucket is also sent to the
    bucket before it (kind 1), the first of all to the last bucket (kind 2).  What the
    driver sees is one number per bucket, a fixed multiple of the shuffle partitions.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("sort_id"), "doc_id",
        F.coalesce("text", F.lit("")).alias("text"))
    n = parts * BUCKETS_PER_PARTITION
    cuts = keyed.agg(F.percentile_approx("sort_id", [i / n for i in range(1, n)], 10 * n)).first()[0]
    cuts = sorted(set(cuts or []))
    bounds = F.array(*[F.lit(c).cast("bigint") for c in cuts])
    bucket = F.size(F.filter(bounds, lambda c: c <= F.col("sort_id"))) if cuts else F.lit(0)
    keyed = keyed.withColumn("bucket", bucket.cast("int"))
    firsts = sorted(keyed.groupBy("bucket").agg(F.min("sort_id")).collect())
    copies = [F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("kind"))]
    if firsts:
        before = {f[0]: p[0] for p, f in zip(firsts, firsts[1:], strict=False)}
        first = F.create_map(*[F.lit(x).cast(t) for f in firsts
                               for x, t in ((f[0], "int"), (f[1], "bigint"))])
        if before:
            prior = F.create_map(*[F.lit(x).cast("int") for pair in before.items() for x in pair])
            copies.append(F.when(
                (F.col("sort_id") == first[F.col("bucket")]) & prior[F.col("bucket")].isNotNull(),
                F.struct(prior[F.col("bucket")].alias("bucket"), F.lit(1).alias("kind"))))
        copies.append(F.when(
            F.col("sort_id") == F.lit(firsts[0][1]).cast("bigint"),
            F.struct(F.lit(firsts[-1][0]).cast("int").alias("bucket"), F.lit(2).alias("kind"))))
    sent = F.filter(F.array(*copies), lambda c: c.isNotNull())
    return (
        keyed.withColumn("to", F.explode(sent))
        .select("to.bucket", "to.kind", "sort_id", "doc_id", "text")
        .repartition(parts, "bucket")
        .sortWithinPartitions("bucket", "kind", "sort_id", "text")
    )


EDIT_SCHEMA = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double, edited_shift bigint, "
    "edited_aligned bigint"
)


def edited(text: str, following: str) -> str:
    """The last floor(n / 2) code points give way to as many first ones of `following`."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def edit_robustness(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they are.

    Null text counts as empty; null doc_id sorts first; rows with one doc_id are
    ordered by text.  An empty table gives an empty result; a single document is its
    own successor.  Other columns are ignored.
    """

    def compare(rows: list[tuple]) -> pa.RecordBatch:
        """Rows (bucket, kind, doc_id, text), each followed by its successor."""
        out = []
        changed = [edited(a[3], b[3]) for a, b in zip(rows, rows[1:], strict=False)]
        own, other = anchors_of([r[3] for r in rows]), anchors_of(changed)
        for i, text in enumerate(changed):
            bucket, kind, doc_id, before = rows[i]
            if kind or rows[i + 1][0] != bucket:
                continue
            shift, votes = aligned(own[i], other[i])
            out.append((
                doc_id, len(before), hashlib.sha256(text.encode()).hexdigest(),
                as_text(own[i][1]), as_text(other[i][1]), likeness(own[i][1], other[i][1]),
                likeness(own[i][1], own[i + 1][1]), shift, votes))
        names = [f.split()[0] for f in EDIT_SCHEMA.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(),
                 pa.float64(), pa.int64(), pa.int64()]
        columns = list(zip(*out, strict=True)) or [[] for _ in names]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            columns = [batch.column(c) for c in ("bucket", "kind", "doc_id", "text")]
            for i in range(batch.num_rows):
                held.append(tuple(c[i].as_py() for c in columns))
                size += len(held[-1][3])
                if size > 4_000_000 and len(held) > 1:
                    yield compare(held)
                    held = held[-1:]
                    size = len(held[0][3])
        if len(held) > 1:
            yield compare(held)

    return with_successors(docs).mapInArrow(run, EDIT_SCHEMA)
