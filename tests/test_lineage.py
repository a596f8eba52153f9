"""Written tables leave no shuffle files behind."""

from pyspark.sql import functions as F

from isoscope.plans import lineage


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_shuffle_files_go_when_a_table_is_written(spark):
    before, setting = _shuffle_files(spark), spark.conf.get(lineage.FREED, "false")
    counts = spark.range(100_000).groupBy((F.col("id") % 1000).alias("k")).agg(F.sum("id").alias("s"))
    table = lineage.materialize(counts, "counts")
    assert not _shuffle_files(spark) - before
    assert table.count() == 1000 and counts.count() == 1000
    assert spark.conf.get(lineage.FREED, "false") == setting
    lineage.discard(table)
