"""The motif scan: tags meet events, not sequences; one row per region, not per motif."""

import random

from pyspark.sql import functions as F

from isoscope.functions.sequence import oriented
from isoscope.operators import motifs as mo
from isoscope.registry import exons
from isoscope.registry import fixtures as fx
from isoscope.sources import genome as gn

CONTIG = "".join(random.Random(5).choice("ACGT") for _ in range(2500))


def _genome(spark):
    rows = [("chr1", i, CONTIG[i * 32:i * 32 + 32]) for i in range((len(CONTIG) + 31) // 32)]
    chunks = spark.createDataFrame(rows, "contig string, chunk_id bigint, seq string")
    return gn.padded(chunks, 32, 1024, 256)


def test_regions_are_read_along_their_strand(spark):
    genome = _genome(spark)
    places = [(-20, 30), (0, 256), (900, 1100), (1020, 1030), (2400, 2600), (2490, 2495), (2600, 2700), (50, 50)]
    rows = [(i, "chr1", s, a, b) for i, ((a, b), s) in enumerate(
        (p, s) for p in places for s in ("+", "-", None))]
    regions = spark.createDataFrame(
        rows, 'id bigint, contig string, strand string, start bigint, end bigint')
    got = {r["id"]: r["seq"] for r in gn.short_regions(regions, genome, strand=F.col("strand")).collect()}
    turned = gn.short_regions(regions, genome).withColumn("seq", oriented(F.col("seq"), F.col("strand")))
    assert got == {r["id"]: r["seq"] for r in turned.collect()}
    assert got[0] == CONTIG[:30] and len(got[13]) == 100


def _events(spark, rows):
    return spark.createDataFrame(
        [("SE", i, "chr1", s, a, b, a - 300, a - 200, b + 200, b + 300) for i, s, a, b in rows],
        "event_type string, event_id bigint, chr string, strand string, exon_start bigint, exon_end bigint, "
        "upstream_es bigint, upstream_ee bigint, downstream_es bigint, downstream_ee bigint")


def test_no_sequence_travels_to_its_tag(spark):
    genome = _genome(spark)
    # the second exon is longer than the padding of the genome; one event repeats, one has no tag
    events = _events(spark, [(1, "+", 800, 900), (2, "-", 700, 1400), (3, "-", 1000, 1090), (3, "-", 1000, 1090),
                             (4, "+", 600, 650)])
    tags = spark.createDataFrame([(1, True), (2, False), (3, True)], "event_id bigint, is_significant boolean")
    texts = mo.tagged_texts(events, tags, genome)
    late = mo.region_text(events, genome).join(
        tags.select("event_id", F.col("is_significant").alias("in_a")), "event_id")
    rows = lambda df: sorted(tuple(r) for r in df.select("event_id", "region", "in_a", "seq").collect())
    assert rows(texts) == rows(late)
    assert {r[0] for r in rows(texts)} == {1, 2, 3}
    # in the branch of short regions the join with the tags lies below the lookup
    plan = texts._jdf.queryExecution().optimizedPlan().toString()
    first = plan[:plan.index("Aggregate [event_id")] if "Aggregate [event_id" in plan else plan
    joins = [line for line in first.splitlines() if "Join" in line]
    lookup = next(i for i, line in enumerate(joins) if "wide_id" in line)
    assert not any("event_id" in line for line in joins[:lookup])


def test_a_region_stays_one_row(spark, tmp_path):
    keys = [1, 4, 5, 14, 15, 15, 27]
    spark.createDataFrame([(k, k * 3) for k in keys], "o_orderkey bigint, o_custkey bigint").write.parquet(
        f"{tmp_path}/orders.parquet")
    sf = str(tmp_path)
    flat = mo.motif_hits(mo.region_text(fx.events(spark, sf), fx.genome(spark, sf))).select(
        "event_id", "region", "motif_name", F.col("hits").cast("string").alias("v")).collect()
    place = {n: i for i, (n, _, _) in enumerate(mo.MOTIFS)}
    expected = {}
    for r in flat:
        expected.setdefault((r["event_id"], r["region"]), []).append((place[r["motif_name"]], r["v"]))
    found = exons.e18(spark, sf)
    assert {(r["event_id"], r["region"]): r["per_motif"] for r in found.collect()} == {
        k: ",".join(v for _, v in sorted(x)) for k, x in expected.items()}
    # one generator makes regions of events; none makes rows of motifs to be gathered again
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "motif_name" not in plan


def test_hits_of_regions_equal_those_of_their_sequences(spark, monkeypatch):
    genome = _genome(spark)
    places = [(800 + 7 * i, 800 + 7 * i + n) for i, n in enumerate((1, 2, 3, 7, 60, 90, 230, 700))]
    events = _events(spark, [(i, s, a, b) for i, (s, (a, b)) in enumerate(
        (s, p) for s in ("+", "-", None) for p in [*places, *places, (100, 160), (2450, 2600)])])
    tags = spark.range(40).selectExpr("id AS event_id", "CASE WHEN id % 5 > 0 THEN id % 2 = 0 END AS in_a")
    names = {n: i for i, (n, _, _) in enumerate(mo.MOTIFS)}
    late = sorted((r["event_id"], r["region"], str(r["in_a"]), names[r["motif_name"]], r["hits"]) for r in mo.motif_hits(
        mo.region_text(events, genome, tags)).collect())
    for rows in (200_000, 3):  # counted all together and a few at a time
        monkeypatch.setattr(mo, "SCAN_ROWS", rows)
        got = sorted((r["event_id"], r["region"], str(r["in_a"]), i, r["hits"][i]) for r in mo.region_hits(
            events, genome, tags).collect() for i in names.values())
        assert got == late and any(h for *_, h in got)


def test_short_regions_are_counted_in_the_genome_row(spark):
    genome = _genome(spark)
    events = _events(spark, [(1, "+", 800, 900), (2, "-", 800, 900)])
    plan = mo.region_hits(events, genome)._jdf.queryExecution().optimizedPlan().toString()
    # only the exons longer than the padding have a sequence of their own
    assert plan.count("MapInArrow") == 1 and plan.count("ArrowEvalPython") == 1
    # and no row of the genome is turned around
    assert "translate(_wide" not in plan
