"""Landed files: layouts, odd files, and the plan of the scan."""

import gzip

import pytest

from isoscope.functions import catalogue as cat
from isoscope.operators import ingest
from isoscope.sources import event_tables as et

SE = ["ID", "GeneID", "geneSymbol", "chr", "strand", "exonStart_0base", "exonEnd", "upstreamES", "upstreamEE",
      "downstreamES", "downstreamEE"]
COUNTS = ["IJC_SAMPLE_1", "SJC_SAMPLE_1", "IJC_SAMPLE_2", "SJC_SAMPLE_2"]


def row(i, start, *more):
    return "\t".join([str(i), f'"G{i % 3}"', "SYM", "chr1", "+", str(start), str(start + 50), "1", "2", "900", "950", *more])


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def landed(tmp_path):
    """Two headers under one name, a compressed file, a byte-order mark, odd names, and files
    that hold nothing to read."""
    for folder in ("a", "b c+d%20e"):
        (tmp_path / folder).mkdir()
    one, two = tmp_path / "a", tmp_path / "b c+d%20e"
    (one / "SE.MATS.JC.txt").write_bytes(
        b"\xef\xbb\xbf" + "\t".join(SE + COUNTS).encode() + b"\r\n" + row(1, 100, "9,9", "9,9", "9,9", "9,9").encode() + b"\r\n\n")
    turned = ["chr", *[c for c in SE if c != "chr"], "FDR", "ID"]
    (two / "SE.MATS.JC.txt").write_text(
        "\t".join(turned) + "\n" + "\t".join(["chr2", "2", "g2", "NA", "-", "300", "350", "1", "2", "900", "950", "0,5", "x"]) + "\n")
    with gzip.open(two / "SE.MATS.JCEC.txt.gz", "wt") as f:
        f.write("\t".join(SE + COUNTS) + "\n" + row(3, 500, "1", "1", "1", "1") + "\n" + row(4, 700, "20", "1", "20", "1"))
    (one / "empty SE.MATS.JC.txt").write_text("")
    (one / "notes.txt").write_text("nothing\tknown\n")
    (one / "RI.MATS.JC.txt").write_text("\t".join(["ID", "riExonStart_0base", "riExonEnd"]))
    return str(tmp_path)


def test_layouts(spark, landed):
    found = et.layouts(spark, [landed])
    assert [(x.name, x.event_type, x.counting_mode, len(x.paths)) for x in found] == [
        ("RI.MATS.JC.txt", "RI", "JC", 1), ("SE.MATS.JC.txt", "SE", "JC", 1), ("SE.MATS.JC.txt", "SE", "JC", 1),
        ("SE.MATS.JCEC.txt.gz", "SE", "JCEC", 1)]
    assert found[1].header == SE + COUNTS  # neither mark nor carriage return
    assert et.has_count_columns(spark, [landed]) and not et.has_count_columns(spark, [landed], found[:1])


def test_rows_of_every_layout(spark, landed):
    rows = {r["caller_id"]: r for r in et.read_events(spark, [landed], "A").collect()}
    assert sorted(rows) == [1, 2, 3, 4]
    assert (rows[1]["gene_id"], rows[1]["exon_start"], rows[1]["ijc_sample_1"]) == ("G1", 100, "9,9")
    assert (rows[2]["chr"], rows[2]["gene_symbol"], rows[2]["fdr"], rows[2]["ijc_sample_1"]) == ("chr2", None, 0.5, None)
    assert {r["counting_mode"] for r in rows.values()} == {"JC", "JCEC"}
    assert rows[3]["name"] == "SE.MATS.JCEC.txt.gz"


def test_cell_arrays_and_columns_agree(spark, landed):
    wide = et.renamed(et.raw_cells(spark, [landed])).collect()
    assert sorted(map(str, wide)) == sorted(map(str, et.text_columns(spark, [landed]).collect())) and len(wide) == 4


def test_one_pruned_scan_per_layout_and_no_shuffle(spark, landed):
    events = et.read_events(spark, [landed], "A")
    plan = plan_of(events.select("caller_id", "exon_start"))
    assert "Exchange" not in plan and "Join" not in plan and plan.count("FileScan csv") == 4
    # two asked columns and those that locate a row
    assert "IJC_SAMPLE_1" not in plan and "c14:string" not in plan
    assert "Exchange" not in plan_of(events)


def test_warnings(spark, landed):
    done = ingest.ingest_files(spark, [landed], "A", min_coverage=5)
    found = {(r["name"], r["warning"]) for r in ingest.warnings(
        spark, [landed], et.read_events(spark, [landed], "A")).collect()}
    assert found == {("empty SE.MATS.JC.txt", "empty file"), ("notes.txt", "unrecognised file"),
                     ("RI.MATS.JC.txt", "no event in file")}
    (entry,) = done.ledger.collect()
    assert (entry["n_parsed"], entry["n_missing_counts"], entry["n_low_coverage"], entry["n_stored"]) == (4, 1, 1, 2)


def test_no_recognised_file(spark, tmp_path):
    (tmp_path / "notes.txt").write_text("a\tb\n")
    assert et.layouts(spark, [str(tmp_path)]) == []
    assert et.read_events(spark, [str(tmp_path)], "A").count() == 0
    assert set(cat.RAW_HEADERS) <= set(et.text_columns(spark, [str(tmp_path)]).columns)
