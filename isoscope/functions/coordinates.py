"""Interval arithmetic around an exon: splice windows, scan regions, sizes.

Coordinates are 0-based half-open.  `upstream_*` is the lower genomic side on
both strands; a null strand counts as plus.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from isoscope.functions.catalogue import (
    ACCEPTOR_EXCLUDED_NT,
    DONOR_EXCLUDED_NT,
    FLANK_NT,
    REGIONS,
)

WINDOWS = ["donor", "acceptor", "ppt", "upstream_donor", "downstream_acceptor"]


def is_plus(strand: Column) -> Column:
    return F.coalesce(strand, F.lit("+")) == "+"


Interval = tuple[Column, Column]


def exon_size() -> Column:
    return F.col("exon_end") - F.col("exon_start")


def intron_sizes() -> tuple[Column, Column]:
    """(upstream, downstream) intron lengths in transcript order; negative -> null."""
    low = F.col("exon_start") - F.col("upstream_ee")
    high = F.col("downstream_es") - F.col("exon_end")
    low, high = F.when(low >= 0, low), F.when(high >= 0, high)
    plus = is_plus(F.col("strand"))
    return F.when(plus, low).otherwise(high), F.when(plus, high).otherwise(low)


def splice_windows(start: Column, end: Column) -> dict[str, Interval]:
    """The five signal windows of an exon [start, end) as genomic (start, end); a
    window at an unknown flank has null ends."""
    plus = is_plus(F.col("strand"))
    low_flank, high_flank = F.col("upstream_ee"), F.col("downstream_es")

    def pick(on_plus: tuple, on_minus: tuple) -> Interval:
        (p, p_lo, p_hi), (m, m_lo, m_hi) = on_plus, on_minus
        return (
            F.when(plus, p + p_lo).otherwise(m + m_lo),
            F.when(plus, p + p_hi).otherwise(m + m_hi),
        )

    return {
        "donor": pick((end, -3, 6), (start, -6, 3)),
        "acceptor": pick((start, -20, 3), (end, -3, 20)),
        "ppt": pick((start, -50, -3), (end, 3, 50)),
        "upstream_donor": pick((low_flank, -3, 6), (high_flank, -6, 3)),
        "downstream_acceptor": pick((high_flank, -20, 3), (low_flank, -3, 20)),
    }


def scan_regions() -> dict[str, Interval]:
    """The seven motif-scan regions in transcript order.  A region without its
    coordinates has a null end, one consumed by the exclusions has end <= start."""
    plus = is_plus(F.col("strand"))
    start, end = F.col("exon_start"), F.col("exon_end")
    up_es, up_ee = F.col("upstream_es"), F.col("upstream_ee")
    dn_es, dn_ee = F.col("downstream_es"), F.col("downstream_ee")

    # flanking exons: at most FLANK_NT next to the intron (`least` would skip a null)
    low_nt = F.when(up_ee - up_es > FLANK_NT, FLANK_NT).otherwise(up_ee - up_es)
    high_nt = F.when(dn_ee - dn_es > FLANK_NT, FLANK_NT).otherwise(dn_ee - dn_es)
    low_exon, high_exon = (up_ee - low_nt, up_ee), (dn_es, dn_es + high_nt)

    # the donor end of an intron loses fewer bases than its acceptor end
    at_low = F.when(plus, DONOR_EXCLUDED_NT).otherwise(ACCEPTOR_EXCLUDED_NT)
    at_high = F.when(plus, ACCEPTOR_EXCLUDED_NT).otherwise(DONOR_EXCLUDED_NT)

    def intron_sides(lo: Column, hi: Column) -> tuple[Interval, Interval]:
        """(low-side window, high-side window) of the intron body."""
        body_lo, body_hi = lo + at_low, hi - at_high
        wide = body_hi - body_lo > FLANK_NT
        low = body_lo, F.when(wide, body_lo + FLANK_NT).otherwise(body_hi)
        high = F.when(wide, body_hi - FLANK_NT).otherwise(body_lo), body_hi
        return low, high

    intron_a, intron_b = intron_sides(up_ee, start), intron_sides(end, dn_es)
    ascending = [low_exon, *intron_a, (start, end), *intron_b, high_exon]
    # on the minus strand transcript order runs from high to low coordinates
    return {
        name: tuple(F.when(plus, p).otherwise(m) for p, m in zip(up, down, strict=True))
        for name, up, down in zip(REGIONS, ascending, reversed(ascending), strict=True)
    }


def as_long(intervals: dict[str, Interval]) -> Column:
    """array<struct<slot, start, end>>, to be inlined and then filtered by `KNOWN`."""
    return F.array(*[
        F.struct(F.lit(name).alias("slot"), start.cast("bigint").alias("start"),
                 end.cast("bigint").alias("end"))
        for name, (start, end) in intervals.items()
    ])


KNOWN = "end > start"
