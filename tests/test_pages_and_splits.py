"""Pages by borders, splits of PSI values with many digits, sets of blank genes."""

import itertools
import random

from pyspark.sql import functions as F

from isoscope.operators import permutation, ranking
from isoscope.sources import transcripts as tx


def test_pages_behind_borders_equal_pages_by_offset(spark):
    pick = random.Random(1)
    rows = [(i, pick.choice([None, 0.01, 0.02, 0.5, -0.2]), pick.random()) for i in range(137)]
    ev = spark.createDataFrame(rows, "event_id long, inc_level_difference double, fdr double").withColumn(
        "fdr", F.when(F.col("event_id") % 3 == 0, F.round("fdr", 1)))
    for by, down in itertools.product(("fdr", "abs_inc_level_diff"), (False, True)):
        borders = {r["page"]: r.asDict() for r in ranking.page_borders(ev, by, down, 20).collect()}
        assert sorted(borders) == list(range(2, 8))
        for page in range(1, 9):
            want = [r["event_id"] for r in ranking.page_of(ev, by, down, page, 20).collect()]
            if page == 8:
                assert want == []
                continue
            got = ranking.page_after(ev, borders.get(page), by, down, 20)
            assert [r["event_id"] for r in got.collect()] == want


def test_a_page_is_sought_in_the_scan(spark, tmp_path):
    spark.range(1000).select(F.col("id").alias("event_id"), (F.col("id") / 10).alias("fdr")).write.parquet(str(tmp_path / "e"))
    page = ranking.page_after(spark.read.parquet(str(tmp_path / "e")), {"value": 50.0, "event_id": 500})
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(Or(GreaterThan(fdr,50.0)" in plan and "Offset" not in plan
    assert [r["event_id"] for r in page.collect()] == list(range(501, 551))


def test_nine_digits_decide(spark):
    """Splits that differ in the ninth digit only are no ties."""
    one, two = [0.100000001, 0.3, 0.2], [0.1, 0.2, 0.3]
    cells = lambda v: ",".join(f"{x:.9f}" for x in v)
    ev = spark.createDataFrame([(1, "SE", "g", None, cells(one), cells(two))],
                               "event_id long, event_type string, gene_symbol string, "
                               "inc_level_difference double, inc_level_1 string, inc_level_2 string")
    (row,) = permutation.event_permutations(ev).collect()
    whole = [round(x * 10 ** 9) for x in one + two]
    nulls = [2 * sum(whole[i] for i in c) - sum(whole) for c in itertools.combinations(range(6), 3)]
    want = sum(abs(d) >= abs(2 * sum(whole[:3]) - sum(whole)) for d in nulls) / len(nulls)
    assert row["empirical_p_value"] == round(want, 4) and row["tested_delta_psi"] > 0


def test_sets_of_blank_genes(spark, tmp_path):
    (tmp_path / "lib.gmt").write_text("full\tabout\tA\t \tB\nblank\tabout\t \t\nshort\tabout\n\tx\tC\n")
    lines = tx.gene_set_lines(spark, [str(tmp_path)])
    assert sorted(map(tuple, tx.gene_set_sizes(lines).collect())) == [("lib", "blank", 0), ("lib", "full", 2)]
    rows = tx.gene_sets(spark, [str(tmp_path)])
    assert sorted(map(tuple, rows.collect())) == [("lib", "full", "A"), ("lib", "full", "B")]
