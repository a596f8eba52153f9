"""The greedy suppression against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from isoscope.operators import dedup

SCHEMA = ("event_id bigint, event_type string, gene_id string, chr string, strand string, "
          "exon_start bigint, exon_end bigint, upstream_es bigint, upstream_ee bigint, "
          "downstream_es bigint, downstream_ee bigint, second_exon_start bigint, "
          "second_exon_end bigint, long_exon_start bigint, long_exon_end bigint, short_es bigint, "
          "short_ee bigint, flanking_es bigint, flanking_ee bigint, fdr double, "
          "inc_level_difference double")


def row(i, kind, start, end, second=None, fdr=0.01, gene="G", effect=0.2):
    s2, e2 = second or (None, None)
    return (i, kind, gene, "chr1", "+", start, end, None, None, None, None, s2, e2,
            *[None] * 6, fdr, effect)


def near(kind, a, b):
    close = lambda i: a[i] is not None and b[i] is not None and abs(a[i] - b[i]) <= 50
    if kind == "SE":
        return close(5) or close(6)
    return all(close(i) for i in ((5, 6) if kind == "RI" else (5, 6, 11, 12)))


def brute(rows):
    order = sorted(rows, key=lambda r: (r[19] is None, r[19] or 0, r[20] is None,
                                        -abs(r[20] or 0), r[0]))
    kept = []
    for r in order:
        if not any(k[1] == r[1] and k[2] == r[2] and near(r[1], k, r) for k in kept):
            kept.append(r)
    return {r[0] for r in kept}


def random_rows(n, seed, genes=3, span=3000):
    rng, out = random.Random(seed), []
    for i in range(n):
        kind = rng.choice(["SE", "RI", "MXE"])
        start = rng.choice([None] + [rng.randrange(span)] * 30)
        end = rng.choice([None] + [(start or 0) + rng.randrange(60, 200)] * 30)
        base = 5000 + rng.randrange(120)
        second = (base, base + rng.randrange(80)) if kind == "MXE" else None
        out.append(row(i, kind, start, end, second, rng.choice([None, 0.01, 0.02, 0.03]),
                       rng.choice([None, "A", "B"][:genes]), rng.choice([None, 0.1, -0.3])))
    return out


@pytest.mark.parametrize("span", [3000, 60_000])
@pytest.mark.parametrize("batch", [7, 10_000])
def test_equals_plain_loop(spark, span, batch):
    """Crowded and sparse groups; islands that end inside, at and beyond a batch."""
    rows = random_rows(400, 7, span=span)
    df = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = [r[0] for r in dedup.deduplicate(df).select("event_id").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got) == sorted(brute(rows))


def test_rows_with_one_id(spark):
    """Of a repeated comparable row one stays, of incomparable ones all."""
    rows = [row(1, "SE", 100, 200)] * 2 + [row(2, "SE", None, None)] * 2
    kept = dedup.deduplicate(spark.createDataFrame(rows, SCHEMA)).select("event_id").collect()
    assert sorted(r[0] for r in kept) == [1, 2, 2]


def test_long_chain_in_one_hot_gene(spark):
    """100 000 rows of falling priority, each near the next: one island, one pass."""
    n = 100_000
    i = F.col("id")
    df = spark.range(n).select(
        i.alias("event_id"), F.lit("SE").alias("event_type"), F.lit("G").alias("gene_id"),
        F.lit("chr1").alias("chr"), F.lit("+").alias("strand"),
        (1000 + 40 * i).alias("exon_start"), (10_000_000 + 1000 * i).alias("exon_end"),
        *[F.lit(None).cast("bigint").alias(c) for c in (
            "upstream_es", "upstream_ee", "downstream_es", "downstream_ee", "second_exon_start",
            "second_exon_end", "long_exon_start", "long_exon_end", "short_es", "short_ee",
            "flanking_es", "flanking_ee")],
        (i / n).alias("fdr"), F.lit(0.2).alias("inc_level_difference"))
    kept = dedup.deduplicate(df).select("event_id")
    assert kept.count() == n // 2 and kept.where(F.col("event_id") % 2 == 1).isEmpty()


def test_chain_of_monotone_priorities(spark):
    """Suppressed rows do not suppress: every second row of a chain survives."""
    rows = [row(i, "SE", 1000 + 40 * i, 50_000 + 1000 * i, fdr=0.001 * (i + 1)) for i in range(12)]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = dedup.deduplicate(df).select("event_id").collect()
    assert sorted(r[0] for r in kept) == [0, 2, 4, 6, 8, 10]


def test_shared_first_exon_of_exclusive_exons_is_kept(spark):
    rows = [row(1, "MXE", 100, 200, (300, 400)), row(2, "MXE", 100, 200, (900, 1000), 0.02),
            row(3, "MXE", 110, 210, (310, 390), 0.03)]
    kept = dedup.deduplicate(spark.createDataFrame(rows, SCHEMA)).select("event_id").collect()
    assert sorted(r[0] for r in kept) == [1, 2]


def test_retained_introns_sharing_one_boundary_are_kept(spark):
    rows = [row(1, "RI", 100, 900), row(2, "RI", 100, 1200, fdr=0.02), row(3, "RI", 130, 930, fdr=0.03)]
    kept = dedup.deduplicate(spark.createDataFrame(rows, SCHEMA)).select("event_id").collect()
    assert sorted(r[0] for r in kept) == [1, 2]


def test_alternative_sites_a_few_bases_apart_are_kept(spark):
    base = spark.createDataFrame([row(i, "A3SS", None, None, fdr=0.01 * (i + 1)) for i in range(3)], SCHEMA)
    df = base.withColumns({"long_exon_start": F.lit(10), "short_es": F.when(F.col("event_id") == 1, 13).otherwise(16)})
    kept = dedup.deduplicate(df).select("event_id").collect()
    assert sorted(r[0] for r in kept) == [0, 1]
