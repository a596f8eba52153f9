"""Column functions over nucleotide strings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from isoscope.functions.catalogue import COMPLEMENT_FROM, COMPLEMENT_TO

# fixed values: 7-mer YNYTRAY, branch adenosine at index 5, 18..44 nt before the exon
BRANCH_A_INDEX = 5
BRANCH_MIN_DISTANCE = 18
BRANCH_MAX_DISTANCE = 44
BRANCH_MIN_SCORE = 5
PPT_OFFSET_TO_EXON = 3


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, COMPLEMENT_FROM, COMPLEMENT_TO))


def oriented(seq: Column, strand: Column) -> Column:
    """Transcript orientation: reverse-complemented on the minus strand only."""
    return F.when(strand == "-", reverse_complement(seq)).otherwise(seq)


def donor_is_gt(seq: Column) -> Column:
    """Three-valued: null when the window is too short to read the dinucleotide."""
    return F.when(F.length(seq) >= 5, F.substring(F.upper(seq), 4, 2) == "GT")


def acceptor_is_ag(seq: Column) -> Column:
    return F.when(F.length(seq) >= 20, F.substring(F.upper(seq), 19, 2) == "AG")


def base_fraction(seq: Column, bases: str) -> Column:
    """Share of the given bases; 0 for an empty sequence."""
    hits = F.length(seq) - F.length(F.translate(F.upper(seq), bases, ""))
    return F.when(F.length(seq) > 0, hits / F.length(seq)).otherwise(F.lit(0.0))


def _pyrimidine_runs(seq: Column) -> Column:
    return F.transform(F.split(F.upper(seq), "[^CT]+"), F.length)


def longest_pyrimidine_run(seq: Column) -> Column:
    return F.array_max(_pyrimidine_runs(seq))


def longest_pyrimidine_run_start(seq: Column) -> Column:
    """0-based start of the first longest C/T run; 0 when there is none."""
    marked = F.regexp_replace(F.upper(seq), "[CT]", "Y")
    run = longest_pyrimidine_run(seq)
    # instr over the uniform-letter string finds the first run of that length
    first = F.instr(marked, F.repeat(F.lit("Y"), run))
    return F.when(run > 0, first - 1).otherwise(F.lit(0))


def branch_point(seq: Column) -> Column:
    """Best branch-point candidate as struct(score, position, distance), or null.

    The adenosine is mandatory and must lie 18-44 nt before the exon; the highest
    score wins and ties go to the candidate nearest the exon (the larger index).
    """
    upper = F.upper(seq)
    n = F.length(seq)

    def candidate(i: Column) -> Column:
        def base(k: int) -> Column:
            return F.substring(upper, i + (k + 1), F.lit(1))

        hits = [
            base(0).isin("C", "T"), base(2).isin("C", "T"), base(3) == "T",
            base(4).isin("A", "G"), base(6).isin("C", "T"),
        ]
        score = sum((h.cast("int") for h in hits), F.lit(2))
        return F.struct(
            score.alias("score"),
            i.alias("position"),
            (n + PPT_OFFSET_TO_EXON - (i + BRANCH_A_INDEX)).alias("distance"),
        )

    starts = F.filter(
        F.sequence(F.lit(0), n - 7),
        lambda i: (F.substring(upper, i + (BRANCH_A_INDEX + 1), F.lit(1)) == "A")
        & (n + PPT_OFFSET_TO_EXON - (i + BRANCH_A_INDEX)).between(
            BRANCH_MIN_DISTANCE, BRANCH_MAX_DISTANCE
        ),
    )
    return F.when(n >= 7, F.array_max(F.transform(starts, candidate)))


def _base_sets(pattern: str) -> list[str]:
    """Accepted bases per position: `CC[AT]` -> C, C, AT."""
    sets, rest = [], pattern
    while rest:
        stop = rest.index("]") if rest[0] == "[" else 0
        sets.append(rest[1:stop] if stop else rest[0])
        rest = rest[stop + 1:]
    return sets


def motif_counter(patterns: list[str]):
    """Arrow UDF: sequence -> struct m0, m1, ... of overlapping hits per pattern.

    A batch becomes one byte vector with separators; a pattern is a conjunction of
    shifted letter masks, summed per sequence.  This is about ten times faster than
    19 lookahead regular expressions per sequence on the JVM.
    """
    all_sets = [_base_sets(p) for p in patterns]

    fields = [StructField(f"m{i}", IntegerType()) for i in range(len(patterns))]

    @F.pandas_udf(StructType(fields))
    def count(seqs: pd.Series) -> pd.DataFrame:
        texts = [t or "" for t in seqs]
        blob = np.frombuffer(("\n".join(texts) + "\n").encode("ascii", "replace"), dtype=np.uint8)
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        starts = np.cumsum(lengths) - lengths
        masks: dict[str, np.ndarray] = {}
        for letters in {x for sets in all_sets for x in sets}:
            accepted = np.zeros(256, dtype=bool)
            accepted[list(letters.encode())] = True
            masks[letters] = accepted[blob]
        columns = {}
        for i, sets in enumerate(all_sets):
            span = len(blob) - len(sets) + 1
            hit = np.zeros(len(blob), dtype=np.int32)
            if span > 0:
                match = masks[sets[0]][:span].copy()
                for k, letters in enumerate(sets[1:], start=1):
                    match &= masks[letters][k:k + span]
                hit[:span] = match
            columns[f"m{i}"] = np.add.reduceat(hit, starts)
        return pd.DataFrame(columns)

    return count


def hits_in_rows(patterns: list[str], texts: list[bytes], code: np.ndarray, start: np.ndarray,
                 end: np.ndarray, minus: np.ndarray) -> list[np.ndarray]:
    """Overlapping hits per pattern in the ranges [start, end) of texts[code], read along the
    other strand where `minus` is set.

    Running counts of the hits along a text serve all ranges in it; the part of a text that
    no range of a strand reaches is left out.
    """
    table = bytes.maketrans(COMPLEMENT_FROM.encode(), COMPLEMENT_TO.encode())
    out = [np.zeros(len(code), np.int32) for _ in patterns]
    for strand in (False, True):
        chosen = np.flatnonzero((minus == strand) & (end > start))
        if not len(chosen):
            continue
        of, lo, hi = code[chosen], start[chosen], end[chosen]
        first, last = np.full(len(texts), np.iinfo(np.int64).max), np.zeros(len(texts), np.int64)
        np.minimum.at(first, of, lo)
        np.maximum.at(last, of, hi)
        used = np.flatnonzero(last > 0)
        parts = [texts[i][first[i]:last[i]] for i in used]
        joined = b"\n".join([*parts, b""])
        blob = np.frombuffer(joined.translate(table) if strand else joined, np.uint8)
        size = last[used] - first[used] + 1
        base = np.zeros(len(texts), np.int64)
        base[used] = np.cumsum(size) - size - first[used]
        lo, hi = lo + base[of], hi + base[of]
        masks: dict[str, np.ndarray] = {}
        for i, pattern in enumerate(patterns):
            sets = _base_sets(pattern)
            sets = sets[::-1] if strand else sets
            span = len(blob) - len(sets) + 1
            if span <= 0:
                continue
            match = np.ones(span, bool)
            for k, letters in enumerate(sets):
                if letters not in masks:
                    accepted = np.zeros(256, bool)
                    accepted[list(letters.encode())] = True
                    masks[letters] = accepted[blob]
                match &= masks[letters][k:k + span]
            total = np.zeros(span + 1, np.int32)
            np.cumsum(match, out=total[1:])
            stop = np.minimum(np.maximum(hi - len(sets) + 1, lo), span)
            out[i][chosen] = total[stop] - total[np.minimum(lo, span)]
    return out
