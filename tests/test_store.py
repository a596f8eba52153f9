"""Stored tables: counted inserts, upserts and deletes on planted rows."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from isoscope.functions.catalogue import IDENTITY_COLUMNS
from isoscope.operators import store as st
from isoscope.plans.prefix import medians
from isoscope.sources import genome as gn

LONGS = [c for c in IDENTITY_COLUMNS if c not in ("event_type", "gene_id", "chr", "strand")]
DDL = ("analysis_id string, event_id string, event_type string, gene_id string, chr string, strand string, "
       + ", ".join(f"{c} long" for c in LONGS) + ", fdr double, inc_level_difference double")


def event(i, analysis="007", kind="SE", gene="g", start=10, fdr=0.5):
    place = [start if c == "exon_start" else None for c in LONGS]
    return (analysis, str(i), kind, gene, "chr1", "+", *place, fdr, 0.1)


@pytest.fixture
def store(spark, tmp_path):
    return st.Store(spark, str(tmp_path / "a b%20c"))


def files(store, table):
    return {str(p.relative_to(store.root)) for p in Path(store.path(table)).rglob("*.parquet")}


def ids(store, table="events", key="event_id"):
    return sorted(r[key] for r in store.read(table).collect())


def test_loading_twice_adds_nothing(spark, store):
    first = spark.createDataFrame([event(1), event(2, start=20), event(3, kind="RI"), event(4, gene=None)], DDL)
    assert store.read("events") is None
    assert st.insert_events(store, first) == 4
    before = files(store, "events")
    assert st.insert_events(store, first.withColumn("event_id", F.lit("new"))) == 0
    assert files(store, "events") == before and ids(store) == ["1", "2", "3", "4"]
    # nulls are equal, another analysis is another identity, the best of equal new rows is added
    more = spark.createDataFrame([event(5, gene=None), event(6, "7"), event(7, start=30), event(8, start=30, fdr=0.1)], DDL)
    assert st.insert_events(store, more) == 2
    assert ids(store) == ["1", "2", "3", "4", "6", "8"]
    assert {r["analysis_id"] for r in store.read("events").collect()} == {"007", "7"}
    assert st.insert_events(store, first.limit(0)) == 0


def test_upsert_rewrites_only_its_partition(spark, store):
    rows = spark.createDataFrame([("a", "1", 5), ("a", "2", 6), ("b", "1", 7), (None, "9", 8)],
                                 "analysis_id string, event_id string, size int")
    key = ["analysis_id", "event_id"]
    assert st.insert(store, "features", rows, key) == 4 and st.insert(store, "features", rows, key) == 0
    before = files(store, "features")
    # the table itself is an input
    new = store.read("features").where("analysis_id = 'a' AND event_id = '2'").withColumn("size", F.lit(60))
    assert st.upsert(store, "features", new.unionByName(
        spark.createDataFrame([("a", "3", 70), ("c", "1", 1)], "analysis_id string, event_id string, size int")
        .select(new.columns)), key) == 3
    got = sorted((r["analysis_id"] or "", r["event_id"], r["size"]) for r in store.read("features").collect())
    assert got == [("", "9", 8), ("a", "1", 5), ("a", "2", 60), ("a", "3", 70), ("b", "1", 7), ("c", "1", 1)]
    untouched = {f for f in before if "analysis_id=a" not in f}
    assert len(untouched) == 2 and untouched <= files(store, "features")


def test_cascade_delete(spark, store):
    st.insert_events(store, spark.createDataFrame([event(1, "x/1"), event(2, "x/2")], DDL))
    two = spark.createDataFrame([("x/1", "d 1", 1), ("x/2", "d 2", 1)], "analysis_id string, deep_analysis_id string, n int")
    st.insert(store, "deep_analyses", two, ["deep_analysis_id"])
    st.insert(store, "tags", spark.createDataFrame([("d 1", "1"), ("d 2", "2"), (None, "3")],
                                                   "deep_analysis_id string, event_id string"), ["event_id"])
    for table in ("analyses", "sample_groups", "features"):
        st.insert(store, table, two.select("analysis_id", "n"), ["analysis_id"])
    gone = st.delete_analysis(store, "x/1")
    assert gone == dict.fromkeys(st.LAYOUT, 1)
    assert ids(store) == ["2"] and ids(store, "tags") == ["2", "3"]
    for table in ("deep_analyses", "analyses", "sample_groups", "features"):
        assert ids(store, table, "analysis_id") == ["x/2"]
    assert st.delete_analysis(store, "x/1") == dict.fromkeys(st.LAYOUT, 0)
    st.delete_deep_analysis(store, "d 2")
    assert ids(store, "tags") == ["3"]


def test_medians_by_definition(spark):
    rows = [("a", 1, 5), ("a", 2, None), ("a", 10, 200_000), ("a", 3, 70_000), ("b", 7, None), (None, 4, 1),
            (None, -70_000, 1), ("c", None, None)] + [("d", 65_536 * (i % 3), i) for i in range(101)]
    df = spark.createDataFrame(rows, "g string, x int, y long")
    got = {r["g"]: (r["x_median"], r["y_median"]) for r in medians(df, ["g"], ["x", "y"]).collect()}
    assert got == {"a": (2.5, 70_000.0), "b": (7.0, None), None: (-34_998.0, 1.0), "d": (65_536.0, 50.0)}
    (whole,) = medians(df, [], ["x"]).collect()
    (want,) = df.agg(F.median("x").alias("m")).collect()
    assert whole["x_median"] == want["m"]


def test_stored_genome(spark, tmp_path):
    text = {"chr1": "ACGT" * 200, "chr2": "TTGCA" * 90}
    chunks = spark.createDataFrame(
        [(c, i // 16, t[i:i + 16]) for c, t in text.items() for i in range(0, len(t), 16)],
        "contig string, chunk_id long, seq string")
    made = gn.store_genome(gn.padded(chunks, 16, 64, 32), "small_genome", str(tmp_path / "g"))
    try:
        held = gn.load_genome(spark, "small_genome")
        assert (held.width, held.pad) == (64, 32) and made.table.count() == held.table.count()
        assert sorted(r["contig"] for r in gn.known_contigs(held).collect()) == ["chr1", "chr2"]
        regions = spark.createDataFrame(
            [(i, c, s, s + n) for i, (c, s, n) in enumerate(
                [("chr1", -5, 20), ("chr1", 60, 30), ("chr2", 430, 40), ("chr2", 3, 200), ("chr9", 1, 5), ("chr1", 9, 0)])],
            "id int, contig string, start long, end long")
        got = {r["id"]: r["seq"] for r in gn.region_sequences(regions, held, ["id"]).collect()}
        want = {r["id"]: text.get(r["contig"], "")[max(r["start"], 0):max(r["end"], 0)] for r in regions.collect()}
        assert got == want
        # the regions are shuffled to the buckets, the genome is scanned where it lies
        old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            plan = gn.short_regions(regions, held)._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
            spark.conf.set("spark.sql.adaptive.enabled", "true")
        assert plan.count("Exchange") == 1 and plan.count("FileScan parquet") == 1 and "Bucketed: true" in plan
    finally:
        gn.drop_genome(spark, "small_genome")
    with pytest.raises(Exception):
        gn.load_genome(spark, "small_genome")
