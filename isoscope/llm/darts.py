"""Near-duplicate documents by weighted min-hash from thrown darts.

A document is the multiset of its 5-word shingles.  Every shingle owns a region of
(weight x rank); darts are thrown into unit cells of it by a hash of shingle and cell,
each with a coordinate and a rank, and a coordinate keeps its earliest dart.  Two
documents agree in a coordinate with a probability equal to their weighted Jaccard
similarity (sum of minima over sum of maxima of the shingle counts).  About
k log k darts fill all k coordinates however long the document is.

Bands of the signature are joined as keys.  In each bucket the members are tied to its
least and its largest document, so a bucket costs links in proportion to its size.
What these links leave in different classes is compared pair by pair in small buckets;
members of crowded ones are tied to central and drawn pivots, in rounds, and meet again
in the buckets of their shingles.  So the number of these pairs stays in proportion to
the rows.  What the rounds leave in different classes of one shingle bucket is compared
in full, but for pairs whose sizes and places there rule the threshold out.  Signatures
decide clear cases; a pair that is not clear is compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoscope.llm.arrays import U, blocks, mix, shingles, window_hashes
from isoscope.llm.graphs import components
from isoscope.llm.packed import slot_counts
from isoscope.plans.lineage import discard, materialize

BANDS, ROWS = 48, 8
COORDINATES = BANDS * ROWS
SIMILARITY = 0.8
# five standard errors of the signature's estimate around the threshold
MARGIN = 5 * math.sqrt(SIMILARITY * (1 - SIMILARITY) / COORDINATES)
CROWD = 8  # members of a bucket up to which all of its pairs are compared at once
PART = 1000  # members of a bucket that meet others in one task
SLOTS = 1 << 20  # counters that order the shingles from rare to common
DYADIC = 12  # rank bands below 1: [0, 2^-12), [2^-12, 2^-11) ... [1/2, 1); then unit bands


def _band_table() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Low end, width and Poisson distribution of the bands below 1 and of a unit band."""
    low = np.array([0.0] + [2.0 ** (i - DYADIC) for i in range(DYADIC)])
    width = np.array([2.0 ** -DYADIC] + [2.0 ** (i - DYADIC) for i in range(DYADIC)])
    area = np.append(width, 1.0)
    terms = np.stack([np.exp(-area) * area ** j / math.factorial(j) for j in range(14)], axis=1)
    return low, width, np.cumsum(terms, axis=1)


LOW, WIDTH, CDF = _band_table()


def _throw(cells: np.ndarray, bands: np.ndarray, k: int):
    """All darts of the cells in the given rank bands: (coordinate, rank, identity)."""
    kind = np.minimum(bands, DYADIC + 1)
    with np.errstate(over="ignore"):
        drawn = mix(cells[:, None] + (bands.astype(U) + U(1)) * U(0xD1B54A32D192ED03)).ravel()
        kinds = np.tile(kind, len(cells))
        share = (drawn >> U(11)).astype(np.float64) * 2.0 ** -53
        hit = np.flatnonzero(share >= CDF[kinds, 0])
        n = (share[hit][:, None] >= CDF[kinds[hit]]).sum(axis=1)
        of = np.repeat(hit, n)
        number = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        dart = mix(drawn[of] + (number.astype(U) + U(1)) * U(0x9E3779B97F4A7C15))
    band = np.tile(bands, len(cells))[of]
    low = np.where(band > DYADIC, band - DYADIC, LOW[np.minimum(band, DYADIC)])
    width = np.where(band > DYADIC, 1.0, WIDTH[np.minimum(band, DYADIC)])
    rank = low + width * ((mix(dart) >> U(11)).astype(np.float64) * 2.0 ** -53)
    coordinate = (((dart >> U(32)) * U(k)) >> U(32)).astype(np.int64)
    return coordinate, rank, dart


def signature(elements: np.ndarray, weights: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """Identity of the earliest dart in each coordinate, for hashed elements with whole
    weights of one or more."""
    copy = np.arange(int(weights.sum())) - np.repeat(np.cumsum(weights) - weights, weights)
    with np.errstate(over="ignore"):
        cells = mix(np.repeat(elements, weights) + copy.astype(U) * U(0xA0761D6478BD642F))
    best, out = np.full(k, np.inf), np.zeros(k, U)
    reach = k * (math.log(k) + 4) / len(cells)  # ranks that hold enough darts
    done = 0
    while True:
        # bands 0..DYADIC end at 2^(band - DYADIC), later ones at band - DYADIC + 1
        stop = (max(0, math.ceil(math.log2(reach)) + DYADIC) + 1 if reach <= 1
                else DYADIC + math.ceil(reach))
        if stop > done:
            coordinate, rank, dart = _throw(cells, np.arange(done, stop), k)
            least = np.full(k, np.inf)
            np.minimum.at(least, coordinate, rank)
            first = rank == least[coordinate]
            new = np.zeros(k, U)
            new[coordinate[first]] = dart[first]
            earlier = least < best
            best[earlier], out[earlier] = least[earlier], new[earlier]
            done = stop
        if np.isfinite(best).all():
            return out
        reach *= 2


SKETCH = "doc_id bigint, sha string, bands array<bigint>, bytes binary"


def sketches(docs: DataFrame) -> DataFrame:
    """Per row its text digest, band keys and one signature byte per coordinate; the
    last two are null for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands, marks = [], []
            for block in blocks(batch.column("text")):
                hashes, cuts, _ = shingles(block)
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if a == b:
                        bands.append(None)
                        marks.append(None)
                        continue
                    sig = signature(*np.unique(hashes[a:b], return_counts=True))
                    keys = window_hashes(sig, ROWS)[::ROWS]
                    with np.errstate(over="ignore"):
                        keys = mix(keys + np.arange(BANDS, dtype=U) * U(0xE7037ED1A0B428DB))
                    bands.append(keys.view(np.int64))
                    marks.append((sig & U(255)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("sha"),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(marks, pa.binary())],
                ["doc_id", "sha", "bands", "bytes"])

    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.md5(text.cast("binary")).alias("sha"), text.alias("text")
                       ).mapInArrow(run, SKETCH)


def shared_buckets(reps: DataFrame) -> DataFrame:
    """(key, doc_id, lo, hi): members of buckets of two or more, with the bucket's least
    and largest document."""
    rows = reps.select(F.explode("bands").alias("key"), "doc_id")
    groups = rows.groupBy("key").agg(
        F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    return rows.join(groups, "key")


def bucket_links(shared: DataFrame) -> DataFrame:
    """Distinct (a, b), a > b: each member of a bucket with its least and its largest."""
    ends = F.explode(F.array(
        F.struct(F.col("doc_id").alias("a"), F.col("lo").alias("b")),
        F.struct(F.col("hi").alias("a"), F.col("doc_id").alias("b"))))
    return shared.select(ends.alias("e")).select("e.a", "e.b").where("a > b").distinct()


def _side(rows: DataFrame, c: str, *more: Column) -> DataFrame:
    """Members of buckets as one side of a join, the document named `c`."""
    placed = [F.col(x).alias(f"{x}_{c}") for x in ("rest", "half") if x in rows.columns]
    return rows.select("key", F.col("doc_id").alias(c), F.col("class").alias(f"c{c}"), *placed, *more)


def _may_link(rows: DataFrame) -> Column:
    """Whether a > b that meet in a bucket are of different classes and, where the rows have
    places, can be similar at all.

    All texts order their shingles alike.  In the bucket of the first one that a pair shares,
    all it shares lies in the `rest` of both, which so holds the sum of their `half`s if the
    pair is similar.
    """
    differ = F.expr("a > b AND ca <> cb")
    if "rest" not in rows.columns:
        return differ
    return differ & (F.least("rest_a", "rest_b") >= F.col("half_a") + F.col("half_b") - 1e-9)


def meeting_pairs(rows: DataFrame, crowd: int = CROWD, salt: int = 0) -> DataFrame:
    """Distinct (a, b), a > b, of different classes that meet in a bucket, from rows
    (key, doc_id, class, n) with n members in the row's bucket.

    Buckets of at most `crowd` members give all their pairs.  Members of larger ones are
    tied to three pivots: the member that sits in the largest buckets, which is the most
    central one of a family, and the least and the largest by a hash of the document.  No
    choice depends on the key, so the buckets of a family name the same few pivots.
    """
    few = rows.where(F.col("n") <= crowd)
    small = _side(few, "a").join(_side(few, "b"), "key").where(_may_link(rows)).select(
        "a", "b").distinct()
    large = rows.where(F.col("n") > crowd)
    weight = F.sum("n").over(Window.partitionBy("doc_id"))
    drawn = F.xxhash64("doc_id", F.lit(salt))
    pivots = large.withColumn("weight", weight).groupBy("key").agg(
        F.max(F.struct("weight", "doc_id", "class")).alias("centre"),
        F.min(F.struct(drawn, "doc_id", "class")).alias("least"),
        F.max(F.struct(drawn, "doc_id", "class")).alias("most"),
    ).select("key", *[F.struct(f"{p}.doc_id", f"{p}.class").alias(p)
                      for p in ("centre", "least", "most")])
    tied = large.join(pivots, "key").select(
        "doc_id", "class", F.explode(F.array("centre", "least", "most")).alias("p")
    ).where("class <> p.class").select(
        F.greatest("doc_id", "p.doc_id").alias("a"), F.least("doc_id", "p.doc_id").alias("b"))
    return small.unionByName(tied.distinct()).distinct()


def remaining_pairs(rows: DataFrame) -> DataFrame:
    """Distinct (a, b), a > b, of ALL members of different classes that meet in a bucket and
    that their places do not rule out, from rows (key, doc_id, class, n): the exact way for
    crowded buckets, once pivots find no more.

    Members are dealt to parts of about PART.  Each two parts meet under a key of their own,
    so the pairs of a large bucket are spread over tasks.
    """
    parts = F.ceil(F.col("n") / PART)
    own, every = F.pmod(F.xxhash64("doc_id"), parts), F.sequence(F.lit(0).cast("bigint"), parts - 1)
    a = _side(rows, "a", own.alias("i"), F.explode(every).alias("j"))
    b = _side(rows, "b", F.explode(every).alias("i"), own.alias("j"))
    return a.join(b, ["key", "i", "j"]).where(_may_link(rows)).select("a", "b").distinct()


def mixed(rows: DataFrame) -> DataFrame:
    """The rows (key, doc_id, class, ...) of buckets that hold several classes, with their
    number `n` of members.  Written."""
    several = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("class").alias("lo"), F.max("class").alias("hi")
    ).where("lo < hi").select("key", "n")
    return materialize(rows.join(several, "key").select(*rows.columns, "n"), "mixed-buckets")


def open_buckets(shared: DataFrame, label: DataFrame) -> DataFrame:
    """Members of the band buckets that hold several classes: (key, doc_id, class, n)."""
    member = shared.select("key", "doc_id").join(
        label.select(F.col("id").alias("doc_id"), "label"), "doc_id", "left"
    ).select("key", "doc_id", F.coalesce("label", "doc_id").alias("class"))
    return mixed(member)


def open_pairs(shared: DataFrame, label: DataFrame) -> DataFrame:
    """Distinct (a, b), a > b, of different classes in one bucket: all pairs of buckets of
    up to CROWD members, and members of larger buckets with the bucket's pivots."""
    return meeting_pairs(open_buckets(shared, label))


def _counted_shingles(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per block the keys of all shingles, each with the number of its copy, and the offsets
    of the documents; keys of a document stand together."""
    for block in blocks(column):
        hashes, cuts, _ = shingles(block)
        of = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        hashes = hashes[np.lexsort((hashes, of))]
        first = np.ones(len(of), bool)
        first[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
        start = np.flatnonzero(first)
        copy = np.arange(len(of)) - np.repeat(start, np.diff(np.append(start, len(of))))
        with np.errstate(over="ignore"):
            yield mix(hashes + copy.astype(U) * U(0xA0761D6478BD642F)), np.asarray(cuts)


def shingle_counts(crowded: DataFrame, docs: DataFrame) -> np.ndarray:
    """How common shingles are in all the documents `crowded`: SLOTS counters, by hash.  Any
    counters give an order that is right; good ones put the rare first."""
    texts = docs.select("doc_id", "text").join(crowded.select("doc_id"), "doc_id").select("text")
    return slot_counts(texts, lambda column: (keys for keys, _ in _counted_shingles(column)), SLOTS)


def content_buckets(crowded: DataFrame, docs: DataFrame, similarity: float = SIMILARITY,
                    counts: np.ndarray | None = None) -> DataFrame:
    """Buckets (key, doc_id, class, rest, half, n) of the shingles, counted by copy, of the
    documents (doc_id, class): members of one bucket share that shingle at least so many times.

    A document of m shingles takes the buckets of its first m - ceil(similarity m) + 1, from
    rare to common: two texts of that similarity share more than what both could leave out,
    so they meet in at least one of them.  `rest` is the number of its shingles from this one
    on, `half` its share in the number that a similar pair has in common.
    """
    counts = shingle_counts(crowded, docs) if counts is None else counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, kinds = (batch.column(c).to_numpy() for c in ("doc_id", "class"))
            at = 0
            for keys, cuts in _counted_shingles(batch.column("text")):
                m = np.diff(cuts)
                of = np.repeat(np.arange(len(m)), m)
                order = np.lexsort((keys, counts[(keys & U(SLOTS - 1)).astype(np.int64)], of))
                rank = np.arange(len(of)) - np.repeat(cuts[:-1], m)
                taken = (m - np.ceil(similarity * m - 1e-9) + 1).astype(np.int64)
                kept = np.flatnonzero(rank < taken[of])
                keys, of, rest = keys[order[kept]], of[kept], (m[of] - rank)[kept]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(ids[at + of]), pa.array(kinds[at + of]),
                     pa.array(rest.astype(np.int32)), pa.array(m[of] * (similarity / (1 + similarity)))],
                    ["key", "doc_id", "class", "rest", "half"])
                at += len(m)

    texts = docs.select("doc_id", "text").join(crowded, "doc_id")
    return mixed(texts.mapInArrow(
        run, "key bigint, doc_id bigint, class bigint, rest int, half double"))


def further_links(shared: DataFrame, known: DataFrame, worded: DataFrame, docs: DataFrame,
                  similarity: float, margin: float) -> DataFrame:
    """Classes (id, label) of the links `known` and of the links that ties to the ends of
    a bucket left open.

    Texts of a crowded bucket are those of a family, alike but mostly below the
    threshold.  Two of them that are near duplicates share content that few others
    have, or are both close to the family's centre.  So they are looked for in the
    buckets of their shingles as well, by the same rule.  Rounds end when one finds no
    link.  By then most links are known and their ends in one class; a last step compares
    every pair of different classes that still shares a shingle bucket, so that no link
    depends on the choice of pivots.  No pair is compared twice.
    """
    links, tried, salt, counts = known, None, 0, None
    untried = lambda pairs: pairs if tried is None else pairs.join(
        tried, ["a", "b"], "left_anti")
    while True:
        label = components(links)
        rows = open_buckets(shared, label)
        crowded = materialize(
            rows.where(F.col("n") > CROWD).select("doc_id", "class").distinct(), "crowded")
        counts = shingle_counts(crowded, docs) if counts is None else counts
        content = content_buckets(crowded, docs, similarity, counts)
        pairs = materialize(untried(meeting_pairs(rows, salt=salt).unionByName(
            meeting_pairs(content, salt=salt)).distinct()), "further-pairs")
        found = linked(pairs, worded, docs, similarity, margin)
        tried = pairs if tried is None else tried.unionByName(pairs)
        discard(rows, crowded)
        if found.isEmpty():
            break
        discard(content)
        links = links.unionByName(found)
        salt += 1
    rest = materialize(untried(remaining_pairs(content)), "remaining-pairs")
    discard(content)
    found = linked(rest, worded, docs, similarity, margin)
    discard(rest)
    return label if found.isEmpty() else components(links.unionByName(found))


def estimated(links: DataFrame, reps: DataFrame) -> DataFrame:
    """Links with `estimate`: the share of agreeing signature bytes, corrected for bytes
    that agree by chance."""
    of = lambda c: reps.select(F.col("doc_id").alias(c), F.col("bytes").alias(f"s{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = np.frombuffer(b"".join(batch.column("sa").to_pylist()), np.uint8)
            b = np.frombuffer(b"".join(batch.column("sb").to_pylist()), np.uint8)
            same = (a == b).reshape(batch.num_rows, -1).mean(axis=1) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"),
                 pa.array([(s - 1 / 256) / (1 - 1 / 256) for s in same], pa.float64())],
                ["a", "b", "estimate"])

    return links.join(of("b"), "b").join(of("a"), "a").select("a", "b", "sa", "sb").mapInArrow(
        run, "a bigint, b bigint, estimate double")


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two arrays of shingle hashes with repetitions."""
    if not len(a) and not len(b):
        return 1.0
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, x, y = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    shared = int(np.minimum(ca[x], cb[y]).sum())
    return shared / (len(a) + len(b) - shared)


def compared(links: DataFrame, docs: DataFrame) -> DataFrame:
    """Distinct links with their exact `similarity`, from whole texts.

    Both ends ask for their texts in one join on doc_id: the texts are read once, and
    only those that are asked for move on to their link.
    """

    def split(column: pa.Array) -> list[np.ndarray]:
        out = []
        for block in blocks(column):
            hashes, cuts, _ = shingles(block)
            out += [hashes[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [weighted_jaccard(x, y) for x, y in zip(
                split(batch.column("ta")), split(batch.column("tb")), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(found, pa.float64())],
                ["a", "b", "similarity"])

    asked = links.select("a", "b", F.explode(F.array("a", "b")).alias("doc_id"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(asked, "doc_id")
    end = lambda c: F.max(F.when(F.col("doc_id") == F.col(c), F.col("text"))).alias(f"t{c}")
    return texts.groupBy("a", "b").agg(end("a"), end("b")).mapInArrow(
        run, "a bigint, b bigint, similarity double")


def linked(pairs: DataFrame, reps: DataFrame, docs: DataFrame, similarity: float,
           margin: float) -> DataFrame:
    """The pairs (a, b) of at least `similarity`: what the signature does not rule out is
    compared exactly.  Written, so a later step does not compare again."""
    unclear = materialize(
        estimated(pairs, reps).where(F.col("estimate") >= similarity - margin)
        .select("a", "b"), "open-links")
    return materialize(
        compared(unclear, docs).where(F.col("similarity") >= similarity).select("a", "b"),
        "tested")


def classes(docs: DataFrame, similarity: float = SIMILARITY, margin: float = MARGIN) -> DataFrame:
    """(doc_id, class_id) of every row: class_id is the least doc_id of its class.

    Texts of one class are equal or joined by links of at least `similarity`.  Equal
    texts are collapsed first.  Then the least bucket partner of each document is tried;
    what is clearly alike by signature forms first classes, and the bucket links that
    still run between classes are compared exactly.  Last, what is still in different
    classes of one bucket is compared: all pairs of small buckets, the members of crowded
    ones with pivots, and with all who share their content (`further_links`).

    A null doc_id gets a null class; rows with one doc_id are one document; texts
    without words (null, empty, symbols) are linked only where they are equal.
    """
    sketch = materialize(sketches(docs.where(F.col("doc_id").isNotNull())), "sketches")
    copies = sketch.groupBy("sha").agg(
        F.min(F.struct("doc_id", "bands", "bytes")).alias("rep"))
    reps = materialize(copies.select("sha", "rep.*"), "texts")
    worded = reps.where("bands IS NOT NULL").dropDuplicates(["doc_id"])
    shared = materialize(shared_buckets(worded), "shared-buckets")
    links = materialize(bucket_links(shared), "links")
    nearest = links.groupBy("a").agg(F.min("b").alias("b"))
    clear = materialize(
        estimated(nearest, worded).where(F.col("estimate") >= similarity + margin)
        .select("a", "b"), "clear")
    first = components(clear)
    of = lambda c: first.select(F.col("id").alias(c), F.col("label").alias(f"l{c}"))
    between = (
        links.join(of("a"), "a", "left").join(of("b"), "b", "left")
        .where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")
    )
    tested = linked(between, worded, docs, similarity, margin)
    discard(links)
    label = further_links(
        shared, clear.unionByName(tested), worded, docs, similarity, margin
    ).withColumnRenamed("id", "doc_id")
    discard(shared)
    by_text = reps.select("sha", "doc_id").join(label, "doc_id", "left").select(
        "sha", F.coalesce("label", "doc_id").alias("class_id"))
    known = sketch.select("doc_id", "sha").join(by_text, "sha").select("doc_id", "class_id")
    unknown = docs.where(F.col("doc_id").isNull()).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.lit(None).cast("bigint").alias("class_id"))
    return known.unionByName(unknown)


def one_per_class(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of the least document of each class, and rows without doc_id."""
    gone = classes(docs, similarity).where("class_id < doc_id").select("doc_id").distinct()
    return docs.join(materialize(gone, "dropped"), "doc_id", "left_anti").select(docs.columns)
