"""Phrases whose words keep company, counted on a weighted de Bruijn graph.

A node is a phrase of `longest` - 1 words, an edge a phrase of `longest` words from the node
of its first words to the node of its last ones; its weight is how often it occurs.  Only
edges are counted in the texts.  What a shorter phrase counts is the flow out of its node:
the weights of its edges, and a correction for the pieces of text that end in it.  Phrases
of still fewer words follow by the same step from the counts of the longer ones.

Edges are counted per block of text, then summed by one shuffle on their first node, so the
flow of a node is summed where its edges are.  A node with too large a share of all edges is
dealt over several tasks by the edges' last word, and its parts are summed afterwards.  Only
phrases that are frequent, and one row per word, leave that shuffle.

Frequent edges are compacted along unary paths: a node with one edge in, one edge out and no
piece that starts or ends there has the count of its edges, so a path of them is one phrase
with one weight.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoscope.llm.arrays import LOWER, U, mix, span_hashes, text_buffers
from isoscope.plans.lineage import discard, materialize

LONGEST = 3
MIN_COUNT = 10
COVERED_PERCENT = 50  # share of a phrase's places inside a longer one that drops the phrase
TOP = 2000
SCALE = 1_000_000
CHUNK_BYTES = 2 << 20
PARTS = 64  # tasks over which a hot node's edges are dealt
BUCKET_ROWS = 500_000  # counted edges that are summed at once
HOT_SAMPLE = 1 / 16  # share of the texts that hot nodes are looked for in
NO_LANG = "und"
MARK, LINE = "\t", "\n"  # stand in no word

IN_WORD = np.ones(256, bool)
IN_WORD[[0x20, 0x09]] = False
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
IN_WORD &= ~SEPARATOR


# -- counting edges in blocks of text ---------------------------------------------------
def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, cuts, row of each part) of texts, about `limit` bytes at a time.  A longer
    text is cut behind a piece, where nothing is counted across; only a single piece of
    more than `limit` bytes stays whole."""
    data, offsets = text_buffers(column)
    parts, rows = [], []
    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        while b - a > limit:
            ends = np.flatnonzero(SEPARATOR[data[a:a + limit]])
            if not len(ends):
                ends = limit + np.flatnonzero(SEPARATOR[data[a + limit:b]])[:1]
            cut = a + int(ends[-1]) + 1 if len(ends) else b
            parts.append((a, cut))
            rows.append(row)
            a = cut
        if b > a:
            parts.append((a, b))
            rows.append(row)
    lo = 0
    while lo < len(parts):
        hi, start = lo + 1, parts[lo][0]
        while hi < len(parts) and parts[hi][1] - start <= limit:
            hi += 1
        # parts follow one another without a gap
        cuts = np.array([p[0] for p in parts[lo:hi]] + [parts[hi - 1][1]]) - start
        yield data[start:parts[hi - 1][1]], cuts, np.array(rows[lo:hi])
        lo = hi


def _named(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each value's equals, and one position for each number."""
    _, at, names = np.unique(values, return_index=True, return_inverse=True)
    return names.ravel(), at


class Pieces:
    """Words of a chunk, numbered per language, and how many words of its piece each one
    has from itself on (`left`) and before itself (`before`)."""

    def __init__(self, data: np.ndarray, cuts: np.ndarray, lang: np.ndarray):
        inside = IN_WORD[data]
        edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
        starts = np.zeros(len(data) + 1, bool)
        starts[:-1] = edge[:-1] == 1
        ends = edge == -1
        # words never cross parts
        inner = cuts[1:-1]
        joined = inner[inside[inner] & inside[inner - 1]]
        starts[joined] = ends[joined] = True
        start, end = np.flatnonzero(starts), np.flatnonzero(ends)
        self.n = n = len(start)
        part = np.searchsorted(cuts, start, "right") - 1
        size = end - start
        letters = LOWER[data[inside]]
        offsets = np.concatenate(([0], np.cumsum(size)))
        column = pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(letters))
        coded = column.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        langs = lang[part] if n else np.zeros(0, np.int64)
        self.ids, at = _named(langs * max(len(coded.dictionary), 1) + codes)
        self.words = coded.dictionary.take(pa.array(codes[at])).cast(pa.string())  # of each number
        text, bounds = text_buffers(self.words)
        self.hashes = span_hashes(text, bounds[:-1], bounds[1:])
        self.lang_of = langs[at]
        breaks = np.concatenate(([0], np.cumsum(SEPARATOR[data])))
        first = np.ones(n, bool)
        if n:
            first[1:] = (part[1:] != part[:-1]) | (breaks[start[1:]] != breaks[end[:-1]])
        heads = np.flatnonzero(first)
        length = np.diff(np.concatenate((heads, [n])))
        self.before = np.arange(n) - np.repeat(heads, length)
        self.left = np.repeat(length, length) - self.before

    def nodes(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Name of the phrase of so many words from each word on (where its piece has
        them), and a position of each name."""
        names, at = self.ids, None
        v = int(self.ids.max(initial=0)) + 1
        for j in range(1, words):
            ahead = self.ids[np.minimum(np.arange(self.n) + j, max(self.n - 1, 0))]
            names, at = _named(names * v + ahead)
        if at is None:
            at = np.unique(names, return_index=True)[1] if self.n else np.zeros(0, np.int64)
        return names, at

    def phrase(self, at: np.ndarray, words: int) -> pa.Array:
        if not words:
            return pa.array([""] * len(at), pa.string())
        parts = [self.words.take(pa.array(self.ids[at + j])) for j in range(words)]
        return pc.binary_join_element_wise(*parts, " ") if words > 1 else parts[0]


def _edges(pieces: Pieces, longest: int):
    """(position of the node, position of the edge's last word, count) of distinct edges."""
    k = longest - 1
    names, _ = pieces.nodes(k)
    v = int(pieces.ids.max(initial=0)) + 1
    place = np.flatnonzero(pieces.left >= longest)
    _, at, count = np.unique(names[place] * v + pieces.ids[np.minimum(place + k, pieces.n - 1)],
                             return_index=True, return_counts=True)
    return place[at], place[at] + k, count


def _flows(pieces: Pieces, longest: int):
    """(words, position, count) of what a block adds to phrases of fewer words than an edge.

    To a node its piece ends alone, since its edges travel to it; to each shorter phrase
    what flows out of its node: all that the phrases of one word more that start with it
    count here, and the pieces that end in it.
    """
    k = longest - 1
    names, first = pieces.nodes(k)
    here = np.flatnonzero(pieces.left >= k)
    f = np.bincount(names[here], minlength=len(first))
    ends = np.bincount(names[pieces.left == k], minlength=len(first))
    yield k, first[ends > 0], ends[ends > 0]
    for words in range(k - 1, 0, -1):
        wide, wide_f = first[f > 0], f[f > 0]  # positions of the longer phrases, their counts
        names, first = pieces.nodes(words)
        ends = np.bincount(names[pieces.left == words], minlength=len(first))
        f = ends + np.bincount(names[wide], weights=wide_f, minlength=len(first)).astype(np.int64)
        yield words, first[f > 0], f[f > 0]


def _pieces_of(batch: pa.RecordBatch) -> Iterator[tuple[Pieces, pa.Array]]:
    lang = batch.column("lang").dictionary_encode()
    codes = lang.indices.to_numpy(zero_copy_only=False)
    for data, cuts, rows in chunks(batch.column("text")):
        yield Pieces(data, cuts, codes[rows].astype(np.int64)), lang.dictionary


def _keys(pieces: Pieces, langs: pa.Array, at: np.ndarray, words: int) -> pa.Array:
    """Language and phrase in one string."""
    lang = langs.take(pa.array(pieces.lang_of[pieces.ids[at]])).cast(pa.string())
    return pc.binary_join_element_wise(lang, pieces.phrase(at, words).cast(pa.string()), MARK)


def _places(pieces: Pieces, langs: pa.Array, at: np.ndarray, words: int) -> np.ndarray:
    """Hashes of language and phrase, the same in every block."""
    own = np.array([zlib.crc32(x.encode()) for x in langs.to_pylist()], U)
    place = own[pieces.lang_of[pieces.ids[at]]]
    with np.errstate(over="ignore"):
        for j in range(words):
            place = mix(place * U(0x2545F4914F6CDD1D) + pieces.hashes[pieces.ids[at + j]])
    return place


def _dealt(key: pa.Array, word: pa.Array, place: np.ndarray, hot: pa.Array) -> pa.Array:
    """Keys with a part number behind those of hot nodes, whose places change with it."""
    at = np.flatnonzero(pc.is_in(key, hot).to_numpy(zero_copy_only=False)) if len(hot) else []
    if not len(at):
        return key
    out = key.to_pylist()
    for i, w in zip(at.tolist(), word.take(pa.array(at)).to_pylist(), strict=True):
        part = zlib.crc32(w.encode()) % PARTS
        out[i] += f"{MARK}{part}"
        place[i] ^= mix(np.array([part + 1], U))[0]
    return pa.array(out, pa.string())


def _packed(key: pa.Array, word: pa.Array, count: np.ndarray, place: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One row per bucket of places: the keys and the words in lines, and the counts."""
    bucket = (place % U(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
    order, lists = pa.array(order), pa.array(cuts.astype(np.int32))
    lines = lambda column: pc.binary_join(
        pa.ListArray.from_arrays(lists, column.take(order)), LINE)
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[cuts[:-1]]), lines(key), lines(word),
         pa.ListArray.from_arrays(lists, pa.array(count).take(order))], ["bucket", "node", "word", "n"])


PACKED = "bucket int, node string, word string, n array<bigint>"


def edges(texts: DataFrame, buckets: int, longest: int = LONGEST, hot: list[str] | None = None) -> DataFrame:
    """What blocks of (lang, text) count, packed in one row per block and bucket of nodes.

    `node` is language, phrase and, for `hot` ones, a part number.  With a word it is an
    edge; without, n is what pieces that end in a node add to it, what a shorter phrase
    counts in the block, or, for the empty phrase, the number of all words.
    """
    hot = pa.array(hot or [], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pieces, langs in _pieces_of(batch):
                if not pieces.n:
                    continue
                at, last, count = _edges(pieces, longest)
                word = pieces.words.take(pa.array(pieces.ids[last]))
                places = [_places(pieces, langs, at, longest - 1)]
                keys = [_dealt(_keys(pieces, langs, at, longest - 1), word, places[0], hot)]
                counts = [count]
                for words, at, count in _flows(pieces, longest):
                    places.append(_places(pieces, langs, at, words))
                    keys.append(_keys(pieces, langs, at, words))
                    counts.append(count)
                # one word of each language stands for the number of its words
                _, at, total = np.unique(
                    pieces.lang_of[pieces.ids], return_index=True, return_counts=True)
                places.append(_places(pieces, langs, at, 0))
                keys.append(_keys(pieces, langs, at, 0))
                counts.append(total)
                counts = np.concatenate(counts).astype(np.int64)
                no_word = pa.array([""] * (len(counts) - len(word)), pa.string())
                yield _packed(pa.concat_arrays(keys), pa.concat_arrays([word, no_word]), counts,
                              np.concatenate(places), buckets)

    return texts.mapInArrow(run, PACKED)


def hot_nodes(texts: DataFrame, longest: int, share: float) -> tuple[list[str], int]:
    """Nodes with at least twice the `share` of the distinct edges of all blocks, and the
    number of these.  None has less than `share`, so there are at most 1 / `share`.

    Each block names the nodes that reach the share inside it: what a node has in other
    blocks is less than `share` of those.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pieces, langs in _pieces_of(batch):
                at, _, _ = _edges(pieces, longest)
                names, first = pieces.nodes(longest - 1)
                size = np.bincount(names[at], minlength=len(first))
                high = np.flatnonzero(size >= max(share * len(at), 2))
                # the empty key carries the number of all edges
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([pa.array([""]), _keys(pieces, langs, first[high], longest - 1)]),
                     pa.array([len(at), *size[high].tolist()], pa.int64())], ["node", "n"])

    found = materialize(texts.mapInArrow(run, "node string, n bigint").groupBy("node").agg(
        F.sum("n").alias("n")), "hot-nodes")
    total = found.where("node = ''").agg(F.sum("n")).first()[0] or 0
    # at most 1 / share rows
    rows = found.where((F.col("node") != "") & (F.col("n") >= share * total)).collect()
    discard(found)
    return [r["node"] for r in rows], total


# -- flows ------------------------------------------------------------------------------
def _frequent(min_count: int):
    """Sums the edges of the nodes of one bucket, and each node's flow; what is frequent, or
    must be added up with other parts, leaves the task."""

    def chosen(table: pa.Table) -> pa.Table:
        dealt = pc.greater(pc.count_substring(table["node"], MARK), 1).to_numpy(zero_copy_only=False)
        return table.take(pa.array(np.flatnonzero(dealt | (table["n"].to_numpy() >= min_count))))

    def run(packed: pa.Table) -> pa.Table:
        lines = lambda c: pc.list_flatten(pc.split_pattern(packed[c], LINE))
        table = pa.table([lines("node"), lines("word"), pc.list_flatten(packed["n"])], ["node", "word", "n"])
        named = lambda t: t.rename_columns([c.removesuffix("_sum") for c in t.column_names])
        sums = named(table.group_by(["node", "word"], use_threads=False).aggregate([("n", "sum")]))
        strong = chosen(sums.filter(pc.not_equal(sums["word"], "")))
        flow = chosen(named(sums.group_by("node", use_threads=False).aggregate([("n", "sum")])))
        flow = flow.append_column("word", pa.array([""] * flow.num_rows, pa.string()))
        return pa.concat_tables([t.select(["node", "word", "n"]) for t in (strong, flow)]).combine_chunks()

    return run


ESCAPES = [("%", "%25"), (MARK, "%09"), (LINE, "%0A")]


def _escaped(lang: Column) -> Column:
    for plain, code in ESCAPES:
        lang = F.replace(lang, F.lit(plain), F.lit(code))
    return lang


def _plain(lang: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        lang = F.replace(lang, F.lit(code), F.lit(plain))
    return lang


def graph(docs: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT) -> DataFrame:
    """(lang, phrase, words, f): every phrase of one to `longest` words that occurs at least
    `min_count` times, and the empty phrase with the number of all words (whatever it is).
    Written to the shared folder.

    A null language is NO_LANG, a null text is empty.
    """
    texts = docs.select(
        _escaped(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG))).alias("lang"), F.col("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a sample decides only how nodes are dealt to buckets, as for a range partitioning
    hot, rows = hot_nodes(texts.sample(HOT_SAMPLE, 1), longest, 1 / (4 * parts))
    buckets = max(4 * parts, math.ceil(rows / HOT_SAMPLE / BUCKET_ROWS))
    found = edges(texts, buckets, longest, hot).groupBy("bucket").applyInArrow(
        _frequent(min_count), "node string, word string, n bigint")
    part = F.split("node", MARK)
    whole = found.select(
        part[0].alias("lang"), F.concat_ws(" ", part[1], F.nullif("word", F.lit(""))).alias("phrase"),
        F.col("n").alias("f")
    ).groupBy("lang", "phrase").agg(F.sum("f").alias("f")).select(
        _plain(F.col("lang")).alias("lang"), "phrase",
        F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " "))).alias("words"), "f")
    return materialize(whole.where((F.col("words") == 0) | (F.col("f") >= min_count)), "phrase-graph")


# -- unary paths --------------------------------------------------------------------------
def _ends_of(edges_: DataFrame, longest: int) -> DataFrame:
    """Edges with the phrases of their first and of their last node."""
    w = F.split("phrase", " ")
    return edges_.select(
        "lang", F.col("phrase").alias("edge"), "f", F.array_join(F.slice(w, 1, longest - 1), " ").alias("from"),
        F.array_join(F.slice(w, 2, longest - 1), " ").alias("to"), w[longest - 1].alias("last"))


def unary_links(counts: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, node, before, after, f): nodes with one edge in and one edge out, where no piece
    starts or ends.  All three have one count: an edge with the count of its node is its only
    one, and leaves nothing for the ends of pieces."""
    nodes = counts.where(F.col("words") == longest - 1).select("lang", F.col("phrase").alias("node"), "f")
    ends = _ends_of(counts.where(F.col("words") == longest), longest)
    into = ends.select("lang", F.col("to").alias("node"), "f", F.col("edge").alias("before"))
    out = ends.select("lang", F.col("from").alias("node"), "f", F.col("edge").alias("after"))
    return nodes.join(into, ["lang", "node", "f"]).join(out, ["lang", "node", "f"])


def paths(counts: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, words, f) of the compacted graph: every maximal path over unary nodes
    as one phrase, every other edge as itself.  A closed ring stays a set of edges.

    Each round doubles the distance that an edge knows its path back, so the rounds grow
    with the logarithm of the longest path; every round is one equi-join, written.
    """
    ends = materialize(_ends_of(counts.where(F.col("words") == longest), longest), "path-edges")
    links = unary_links(counts, longest).select("lang", F.col("after").alias("edge"), F.col("before").alias("back"))
    known = materialize(ends.select("lang", "edge").join(links, ["lang", "edge"], "left").select(
        "lang", "edge", F.coalesce("back", "edge").alias("head"),
        F.col("back").isNotNull().cast("int").alias("steps")), "path-heads")
    heads = ends.select("lang", F.col("edge").alias("head")).join(
        links.select("lang", F.col("edge").alias("head")), ["lang", "head"], "left_anti")
    most, before = ends.count(), None
    while True:
        total, longest_path = known.agg(F.sum("steps"), F.max("steps")).first()
        if total == before or (longest_path or 0) > most:
            break
        before = total
        further = known.select(
            "lang", F.col("edge").alias("head"), F.col("head").alias("next"), F.col("steps").alias("more"))
        following = materialize(known.join(further, ["lang", "head"]).select(
            "lang", "edge", F.col("next").alias("head"), (F.col("steps") + F.col("more")).alias("steps")),
            "path-heads")
        discard(known)
        known = following
    # the head of a path has no way back; what still has one lies on a ring
    on_ring = known.join(heads, ["lang", "head"], "left_anti").select(
        "lang", "edge", F.col("edge").alias("head"), F.lit(0).alias("steps"))
    steps = known.join(heads, ["lang", "head"]).select("lang", "edge", "head", "steps").unionByName(on_ring)
    # a group is one path: as many words as the phrase it becomes
    tail = F.array_sort(F.collect_list(F.when(F.col("steps") > 0, F.struct("steps", "last"))))
    return steps.join(ends, ["lang", "edge"]).groupBy("lang", "head").agg(
        tail.alias("tail"), F.max("f").alias("f")).select(
        "lang", F.array_join(F.concat(F.array("head"), F.col("tail.last")), " ").alias("phrase"),
        (F.size("tail") + longest).alias("words"), "f")


# -- the operator -------------------------------------------------------------------------
def scored(counts: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of phrases of two words or more: of all cuts into
    a first and a last part the one that scores least, SCALE * a * a / (l * r) rounded down;
    of equal ones the first.  Exact: 38 digits."""
    phrases = counts.where(F.col("words") > 1).select("lang", "phrase", "words", F.col("f").alias("a"))
    w = F.split("phrase", " ")
    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1))
    cuts = phrases.withColumn("k", cut).withColumns({
        "left": F.array_join(F.slice(w, F.lit(1), F.col("k")), " "),
        "right": F.array_join(F.slice(w, F.col("k") + 1, F.col("words")), " ")})
    of = lambda side, name: counts.where("words > 0").select(
        "lang", F.col("phrase").alias(side), F.col("f").alias(name))
    both = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    wide = lambda c: f"CAST({c} AS DECIMAL(16,0))"
    score = F.expr(f"({wide('a')} * {wide('a')} * {SCALE}) DIV ({wide('l')} * {wide('r')})")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r"))
    return both.groupBy("lang", "phrase", "words", "a").agg(best.alias("b")).select(
        "lang", "phrase", "words", "a", "b.l", "b.r", F.col("b.score").cast("bigint").alias("score"))


def uncovered(phrases: DataFrame, counts: DataFrame, longest: int = LONGEST,
              percent: int = COVERED_PERCENT) -> DataFrame:
    """The phrases that no longer phrase contains in `percent` of their places.  Nodes inside
    a unary path are covered by its edges; the others are compared with every longer phrase
    around them."""
    inner = unary_links(counts, longest).select("lang", F.col("node").alias("phrase"))
    left = phrases.join(inner, ["lang", "phrase"], "left_anti") if percent <= 100 else phrases
    w = F.split("phrase", " ")
    inside = F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("words") - 1),
        lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1),
                              lambda i: F.array_join(F.slice(w, i, m), " "))))
    around = counts.where(F.col("words") > 2).select("lang", F.explode(inside).alias("phrase"), "f").groupBy(
        "lang", "phrase").agg(F.max("f").alias("longer"))
    return left.join(around, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a"))).drop("longer")


def collocations(docs: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT, top: int = TOP,
                 percent: int = COVERED_PERCENT) -> DataFrame:
    """Each language's first `top` phrases of 2 to `longest` words: (lang, rank, phrase, a, l,
    r, n, score), best score first, then more places, then the phrase in byte order.

    `docs` needs the columns lang and text; others are not read.  A-Z are lowered; words are
    `[^\\x20\\x09]+` inside pieces cut at `[.,;:!?\\x0A-\\x0D]`.  A null language is NO_LANG, a
    null or empty text has no word; repeated rows count repeatedly; texts of any length are
    counted whole, several megabytes at a time; an empty table gives an empty result.
    """
    counts = graph(docs, longest, min_count)
    found = uncovered(scored(counts, longest), counts, longest, percent)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = found.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)
    words = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return first.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
