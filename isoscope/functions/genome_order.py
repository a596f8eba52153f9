"""Natural chromosome order and plot coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN_RANK = 100


def bare_name(chrom: Column) -> Column:
    """Upper-case name without its `chr` prefix."""
    return F.upper(F.regexp_replace(F.trim(F.coalesce(chrom, F.lit(""))), "^[cC][hH][rR]", ""))


def chromosome_key(chrom: Column) -> tuple[Column, Column]:
    """(rank, name): 1..22, X, Y, M first, then other contigs by name."""
    name = bare_name(chrom)
    number = name.try_cast("int")
    # the round trip rejects spellings such as "01" or " 7"
    numbered = (number.cast("string") == name) & number.between(1, 22)
    rank = (
        F.when(numbered, number)
        .when(name == "X", 23)
        .when(name == "Y", 24)
        .when(name.isin("M", "MT"), 25)
        .otherwise(UNKNOWN_RANK)
    )
    return rank, F.when(rank == UNKNOWN_RANK, name).otherwise(F.lit(""))


def display_rank(chrom: Column) -> Column:
    """Order used by event cards: as above, without MT, unknown last (99)."""
    rank, _ = chromosome_key(chrom)
    known = (rank < UNKNOWN_RANK) & (bare_name(chrom) != "MT")
    return F.when(known, rank).otherwise(99)
