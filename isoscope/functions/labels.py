"""Small categorical rules used by reports and exports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _half(flag: Column, text: str) -> Column:
    return F.when(flag, text).when(~flag, "!" + text).otherwise("?")


def site_label(donor_is_gt: Column, acceptor_is_ag: Column) -> Column:
    """`GT/AG`, `!GT/AG`, `?/AG`, ... with `?` for an unreadable window."""
    return F.concat_ws("/", _half(donor_is_gt, "GT"), _half(acceptor_is_ag, "AG"))


def min_q(presence_q: Column, density_q: Column) -> Column:
    """Smaller of two q-values, ignoring a missing one (`least` skips nulls)."""
    return F.least(presence_q, density_q)


def confidence_rank(label: Column) -> Column:
    return (
        F.when(label == "green", 0).when(label == "amber", 1).when(label == "red", 2).otherwise(3)
    )
