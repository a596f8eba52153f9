"""Cells and tables of the readers and of maintenance, on planted rows."""

from pyspark.sql import functions as F

from isoscope.functions import catalogue as cat
from isoscope.operators import maintenance, ranking
from isoscope.plans import lineage
from isoscope.sources import event_tables as et


def test_null_tokens_and_fractions(spark, tmp_path):
    head = ["ID", "GeneID", "geneSymbol", "chr", "strand", "exonStart_0base", "exonEnd"]
    cells = [["1", "g", token, "chr1", "+", "10", "20"] for token in cat.NULL_TOKENS]
    cells += [["2", "g", "S", "chr1", "+", start, "20"] for start in ("12.0", "12.5", "x", "1e1")]
    (tmp_path / "SE.MATS.JC.txt").write_text("\n".join("\t".join(c) for c in [head, *cells]) + "\n")
    rows = et.coerced(et.renamed(et.raw_cells(spark, [str(tmp_path)]))).collect()
    assert [r["gene_symbol"] for r in rows if r["caller_id"] == 1] == [None] * len(cat.NULL_TOKENS)
    assert sorted((r["exon_start"] for r in rows if r["caller_id"] == 2), key=str) == [10, 12, None, None]


def test_deleting_keeps_rows_without_analysis(spark):
    events = spark.createDataFrame([("a", 1), (None, 2)], "analysis_id string, event_id long")
    deep = spark.createDataFrame([("d", "a"), ("e", None)], "deep_analysis_id string, analysis_id string")
    tags = spark.createDataFrame([("d", 1), (None, 2)], "deep_analysis_id string, event_id long")
    left = maintenance.without_analysis("a", events, events.select("event_id"), deep, tags)
    assert [r["event_id"] for r in left["events"].collect()] == [2]
    assert [r["deep_analysis_id"] for r in left["deep_analyses"].collect()] == ["e"]
    assert maintenance.without_deep_analysis("d", deep, tags)["tags"].count() == 1


def test_plot_set_is_in_genome_order(spark):
    rows = [(i, "SE", "g", f"chr{c}", s, 0.9, 0.1) for i, (c, s) in enumerate(
        [("10", 5), ("2", 9), ("X", 1), ("2", 3)])]
    ev = spark.createDataFrame(
        rows, "event_id long, event_type string, gene_symbol string, chr string, exon_start long, "
              "fdr double, inc_level_difference double")
    assert [r["event_id"] for r in ranking.plot_set(ev).collect()] == [3, 1, 0, 2]


def test_intermediate_tables_are_deleted(spark):
    lineage.cleanup(spark)
    one, two = (lineage.materialize(spark.range(3).select(F.col("id")), "t") for _ in range(2))
    lineage.discard(one)
    assert two.count() == 3 and lineage.cleanup(spark) == 1 and lineage.cleanup(spark) == 0
