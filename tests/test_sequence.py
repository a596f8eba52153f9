"""Genome lookup, sequence functions and file readers on small inputs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from isoscope.functions import sequence as sq
from isoscope.functions.catalogue import MOTIFS
from isoscope.operators import features as ft
from isoscope.operators import ingest
from isoscope.operators.motifs import motif_hits
from isoscope.sources import event_tables as et
from isoscope.sources import genome as gn
from isoscope.sources import transcripts as tx

RNG = random.Random(11)
CONTIG = "".join(RNG.choice("ACGT") for _ in range(3333))


@pytest.fixture(scope="module")
def small_genome(spark):
    rows = [("chr1", i, CONTIG[i * 16:(i + 1) * 16].lower()) for i in range(0, 209)]
    return gn.padded(spark.createDataFrame(rows, "contig string, chunk_id long, seq string"), 16, 64, 32)


def test_regions_of_any_length(spark, small_genome):
    cuts = [(RNG.randrange(-20, 3340), RNG.randrange(-20, 3400)) for _ in range(300)]
    rows = [(i, "chr1" if i % 9 else "chrU", a, b) for i, (a, b) in enumerate(cuts)]
    df = spark.createDataFrame(rows, "id int, contig string, start long, end long")
    got = {r["id"]: r["seq"] for r in gn.region_sequences(df, small_genome, ["id"]).collect()}
    for i, c, a, b in rows:
        assert got[i] == (CONTIG[max(a, 0):b] if c == "chr1" and b > max(a, 0) else "")


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "s string").select(column(F.col("s"))).first()[0]


def test_reverse_complement_is_an_involution(spark):
    assert one(spark, sq.reverse_complement, "ACGTRYKMBDHVNacgtn?") == "?nacgtNBDHVKMRYACGT"
    assert one(spark, lambda c: sq.reverse_complement(sq.reverse_complement(c)), CONTIG) == CONTIG
    assert one(spark, sq.reverse_complement, "AU") == "AT"


def test_planted_branch_point(spark):
    b = one(spark, sq.branch_point, "C" * 20 + "TACTAAC" + "C" * 20)
    assert (b["score"], b["position"], b["distance"]) == (7, 20, 25)
    assert one(spark, sq.branch_point, "C" * 33 + "TACTAAC" + "C" * 7) is None  # too close
    assert one(spark, sq.branch_point, "CTCT") is None
    tie = one(spark, sq.branch_point, "G" * 10 + "TACTAAC" + "G" * 3 + "TACTAAC" + "G" * 20)
    assert tie["position"] == 20  # the one nearer the exon


def test_short_windows_are_unknown(spark):
    assert one(spark, sq.donor_is_gt, "AAGG") is None and one(spark, sq.donor_is_gt, "AAGGT") is True
    assert one(spark, sq.acceptor_is_ag, "A" * 19) is None
    assert one(spark, sq.longest_pyrimidine_run_start, "AACTCAACTC") == 2
    assert one(spark, sq.longest_pyrimidine_run, "AAA") == 0


def test_motif_counts_equal_overlapping_search(spark):
    texts = ["GGGGG", "CCATACC", "A", "", "CACACAC", *[CONTIG[i:i + 250] for i in range(0, 3000, 250)]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, seq string")
    got = {(r["id"], r["motif_name"]): (r["hits"], r["density"]) for r in motif_hits(df.where("seq <> ''")).collect()}
    for i, t in enumerate(texts):
        for name, _, pattern in MOTIFS:
            if t:
                assert got[i, name][0] == len(re.findall(f"(?={pattern})", t)), (t, name)
    assert got[0, "GGG"][1] == 1.0


def test_merged_intervals_and_frames(spark):
    schema = ("exon_start long, exon_end long, tx struct<transcript_id:string,strand:string,"
              "exons:array<struct<start:long,end:long>>,cds:array<struct<start:long,end:long>>>")
    cds = [(100, 200), (150, 220), (220, 230), (300, 400), (50, 50)]
    rows = [(180, 330, ("T", "+", [], cds)), (100, 130, ("T", "-", [], cds)), (10, 90, ("T", "-", [], cds)),
            (10, 90, ("T", "+", [], [])), (10, 90, None)]
    df = spark.createDataFrame(rows, schema)
    segs = df.select(ft.frame_annotation("segments").alias("f")).select("f.*").collect()
    assert [tuple(r) for r in segs] == [
        ("partial", "frameshift", 80), ("CDS", "in_frame", 30), ("UTR3", "non_coding", None),
        ("non_coding", "non_coding", None), ("unknown", "unknown", None)]
    span = df.select(ft.frame_annotation().alias("f")).select("f.*").first()
    assert tuple(span) == ("CDS", "in_frame", 150)
    merged = df.select(ft.merged_intervals(F.col("tx.cds")).alias("m")).first()["m"]
    assert [(m["start"], m["end"]) for m in merged] == [(100, 230), (300, 400)]


HEADER = "ID\tGeneID\tgeneSymbol\tchr\tstrand\texonStart_0base\texonEnd\tupstreamES\tupstreamEE\tdownstreamES\tdownstreamEE\tID\tIJC_SAMPLE_1\tSJC_SAMPLE_1\tIJC_SAMPLE_2\tSJC_SAMPLE_2\tIncFormLen\tSkipFormLen\tPValue\tFDR\tIncLevel1\tIncLevel2\tIncLevelDifference"


def line(i, start, ijc="20,20", fdr="0.01", diff="0.5"):
    coords = [start, start + 100, start - 500, start - 400, start + 500, start + 600] if start else ["NA"] * 6
    return "\t".join(map(str, [i, '"ENSG1.4"', '"ABC"', "chr1", "+", *coords, 99, ijc, "5,5", "20,20", "5,5",
                               100, 50, "0,002", fdr, "0.9,NA", "0.1", diff]))


def test_ingest_of_landed_files(spark, tmp_path):
    jc = [line(1, 1000), line(2, 1020, fdr="0,03"), line(3, 5000, ijc="0,NA"), line(4, None), line(5, 9000, ijc="NA")]
    jcec = [line(1, 1000, fdr="0.005", diff="-0,25"), line(6, 20000, diff="NA")]
    (tmp_path / "SE.MATS.JC.txt").write_bytes(("﻿" + HEADER + "\r\n" + "\r\n".join(jc) + "\r\n").encode())
    (tmp_path / "SE.MATS.JCEC.txt").write_text(HEADER + "\n" + "\n".join(jcec))
    (tmp_path / "RI.MATS.JC.txt").write_text("")
    (tmp_path / "MXE.MATS.JC.txt").write_text(HEADER + "\n")
    (tmp_path / "notes.txt").write_text("hello\nworld\n")
    done = ingest.ingest_files(spark, [str(tmp_path)], "AN")
    got = done.events.orderBy("exon_start").collect()
    assert [(r["caller_id"], r["counting_mode"], r["exon_start"]) for r in got] == [(1, "JCEC", 1000), (6, "JCEC", 20000)]
    assert got[0]["gene_id"] == "ENSG1.4" and got[0]["inc_level_difference"] == -0.25 and got[0]["p_value"] == 0.002
    assert got[1]["inc_level_difference"] is None
    assert done.ledger.first().asDict() == {
        "n_parsed": 6, "n_missing_counts": 1, "n_low_coverage": 1, "n_collapsed": 2, "n_stored": 2}
    notes = {r["name"]: r["warning"] for r in ingest.warnings(spark, [str(tmp_path)], done.events).collect()}
    assert notes == {"RI.MATS.JC.txt": "empty file", "MXE.MATS.JC.txt": "no event in file",
                     "notes.txt": "unrecognised file", "SE.MATS.JC.txt": "no event in file"}


def test_coverage_filter_needs_the_count_columns(spark, tmp_path):
    keep = [c for c in HEADER.split("\t") if "SAMPLE" not in c]
    (tmp_path / "fromGTF.SE.txt").write_text("\t".join(keep) + "\n" + "\t".join(
        ["7", "ENSG9", "X", "chr2", "-", "10", "20", "1", "5", "30", "40", "7"]))
    done = ingest.ingest_files(spark, [str(tmp_path)], "AN")
    assert done.events.count() == 1 and not et.has_count_columns(spark, [str(tmp_path)])


def test_attributes_last_key_wins(spark):
    got = one(spark, tx._attributes, "ID=a; x ;tag=one=two;ID=b;")
    assert got == {"ID": "b", "tag": "one=two"}
