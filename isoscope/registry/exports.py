"""Registered queries: stored tables, exports and report sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from isoscope.functions.catalogue import EVENT_TYPES
from isoscope.functions.coordinates import exon_size
from isoscope.operators import annotation as an
from isoscope.operators import export as ex
from isoscope.operators import features as ft
from isoscope.operators import maintenance as mt
from isoscope.operators import store as st
from isoscope.plans.lineage import scratch_path
from isoscope.registry import fixtures as fx
from isoscope.registry.annotation import ANNOT
from isoscope.registry.fixtures import EFFECT, FDR, SIG

R = fx.Registry()
query = R.query


def _owned(spark, sf):
    return fx.events(spark, sf).withColumn(
        "analysis_id", F.concat(F.lit("AN"), (F.col("event_id") % 3).cast("string")))


@query("l1_store_events", "SELECT event_id, 'AN' || (event_id % 3) AS analysis_id, event_type, CASE WHEN event_id % 3 = 1 AND event_type = 'SE' THEN 0.5 ELSE fdr END AS fdr FROM splice_events WHERE NOT (event_id % 3 = 1 AND event_type = 'SE' AND event_id % 2 = 0)")
def l1(spark, sf):
    """Write all, rewrite one partition, read back: the others are untouched."""
    path = scratch_path(spark, "events")
    ev = _owned(spark, sf)
    mt.store_events(ev, path)
    again = ev.where("analysis_id = 'AN1' AND event_type = 'SE' AND event_id % 2 <> 0")
    mt.store_events(again.withColumn("fdr", F.lit(0.5)), path)
    return mt.load_events(spark, path).select("event_id", "analysis_id", "event_type", "fdr")


@query("l2_feature_upsert", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN exon_size + 1000 ELSE exon_size END AS exon_size FROM sizes WHERE event_id % 4 <> 1 OR event_id % 3 = 0")
def l2(spark, sf):
    rows = fx.skipped(spark, sf).select("event_id", exon_size().alias("exon_size"))
    new = rows.where("event_id % 3 = 0").withColumn("exon_size", F.col("exon_size") + 1000)
    return mt.upserted(rows.where("event_id % 4 <> 1"), new)


_STAMP = "CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN TIMESTAMP '2026-01-01 00:00:00' ELSE TIMESTAMP '2026-01-02 11:00:00' END"


@query("l3_reannotate_stale", f""", st AS (SELECT event_id, {_STAMP} AS computed_at, f.transcript_id AS found, f.frame_class AS fresh, event_id % 5 = 0 AS had FROM features f),
due AS (SELECT *, NOT had AND (computed_at IS NULL OR computed_at < TIMESTAMP '2026-01-01 12:00:00') AS is_due FROM st)
SELECT event_id, CASE WHEN had THEN 'old' WHEN is_due THEN found END AS transcript_id, CASE WHEN NOT had AND is_due AND found IS NOT NULL THEN fresh ELSE 'unknown' END AS frame_class,
  CASE WHEN is_due THEN TIMESTAMP '2026-01-02 12:00:00' ELSE computed_at END AS computed_at FROM due""")
def l3(spark, sf):
    ev = fx.events(spark, sf)
    stored = ev.where("event_type = 'SE'").select(
        "event_id", F.expr("CASE WHEN event_id % 5 = 0 THEN 'old' END").alias("transcript_id"),
        F.lit(None).cast("int").alias("exon_rank"), F.lit("unknown").alias("frame_region"),
        F.lit("unknown").alias("frame_class"), F.lit(None).cast("bigint").alias("cds_exon_length"),
        F.expr(_STAMP.replace("TIMESTAMP", "TIMESTAMP_NTZ")).alias("computed_at"))
    now = F.expr("TIMESTAMP_NTZ '2026-01-02 12:00:00'")
    return mt.reannotated(stored, ev, fx.models(spark, sf), now).select(
        "event_id", "transcript_id", "frame_class", "computed_at")


_EXPORT = ", ".join(f"f.{c}" for c in ex.FEATURE_EXPORT)


@query("l4_significant_export", ANNOT + f"""SELECT {', '.join('e.' + c for c in ex.EVENT_EXPORT)}, abs(e.inc_level_difference) AS abs_inc_level_diff, {_EXPORT}, coalesce(panel_confidence, '') AS panel_confidence, coalesce(panel_names, '') AS panel_names,
  coalesce(go_bp, '') AS go_bp, coalesce(go_mf, '') AS go_mf, coalesce(go_cc, '') AS go_cc FROM splice_events e LEFT JOIN features f USING (event_id) LEFT JOIN ptop ON ptop.symbol = gene_symbol LEFT JOIN gtop ON gtop.symbol = gene_symbol WHERE {SIG}""")
def l4(spark, sf):
    # features of the exported events; rows of one event_id keep theirs together
    events = fx.events(spark, sf)
    wanted = events.where(fx.significant()).select("event_id")
    features = ft.compute_features(
        events.join(wanted, "event_id", "left_semi"), fx.models(spark, sf), fx.genome(spark, sf))
    return ex.significant_export(
        events, features, fx.significant(),
        {"panels": an.panel_summary(fx.panels(spark, sf)), "go": an.go_summary(fx.go(spark, sf))})


_ITEMS = "('Deep Analysis', 'deep'), ('FDR threshold', '0.05'), ('p-value maximum', 'not applied'), ('|ΔΨ| minimum', '0.1')"


@query("l5_export_summary", f""", c AS (SELECT event_type, count(*) AS n FROM splice_events WHERE {SIG} GROUP BY event_type), fixed_items(item, value) AS (VALUES {_ITEMS})
SELECT item, value FROM fixed_items UNION ALL SELECT 'Significant events', cast(sum(n) AS varchar) FROM c UNION ALL SELECT event_type, cast(n AS varchar) FROM c""")
def l5(spark, sf):
    return ex.export_summary(
        fx.events(spark, sf), fx.significant(), "deep", FDR, EFFECT, None).drop("ord")


@query("l6_report_sections", f"""SELECT 'a' AS section, 'type_counts' AS table_name, {len(EVENT_TYPES)} AS n UNION ALL SELECT 'a', 'summary', 1 UNION ALL SELECT 'b', 'feature_table', 1
  UNION ALL SELECT 'c', 'group_statistics', 2 UNION ALL SELECT 'top_events', 'top', least(20, count(*)) FROM se WHERE sig
  UNION ALL SELECT 'top_events', 'flank_corrected', least(30, count(*)) FROM joined WHERE model_exon_source = 'flanking'""")
def l6(spark, sf):
    """Rows per table of the chosen sections."""
    tables = ex.report_tables(
        fx.events(spark, sf), ft.events_with_features(fx.events(spark, sf), fx.features(spark, sf)),
        fx.significant(), ex.parse_sections("a, B,c,top_events,zz"))
    out = None
    for (section, name), df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(section).alias("section"), F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("l8_delete_deep_analysis", "SELECT 'deep_' || m AS deep_analysis_id, count(*) AS n_tags FROM splice_events CROSS JOIN (SELECT unnest([1, 3]) AS m) x WHERE event_id % m = 0 GROUP BY 1")
def l8(spark, sf):
    base = fx.events(spark, sf).select(
        "event_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("m")).where("event_id % m = 0")
    tags = base.select(F.concat(F.lit("deep_"), F.col("m")).alias("deep_analysis_id"), "event_id")
    left = mt.without_deep_analysis("deep_2", tags.select("deep_analysis_id").distinct(), tags)
    return left["tags"].join(left["deep_analyses"], "deep_analysis_id").groupBy("deep_analysis_id").agg(
        F.count(F.lit(1)).alias("n_tags"))


# -- the store: written, changed and read back ------------------------------------------------
def _filled(spark, sf) -> st.Store:
    """Four analyses with two sample groups and one deep analysis each."""
    store = st.Store(spark, scratch_path(spark, "store"))
    ev = fx.events(spark, sf).withColumn(
        "analysis_id", F.concat(F.lit("AN/0"), (F.col("event_id") % 4).cast("string")))
    st.insert_events(store, ev)
    st.insert(store, "features", ev.where("event_type = 'SE'").select(
        "analysis_id", "event_id", exon_size().alias("exon_size")), ["analysis_id", "event_id"])
    ids = ev.select("analysis_id").distinct()
    deep = F.concat(F.lit("D "), "analysis_id").alias("deep_analysis_id")
    st.insert(store, "analyses", ids.select("analysis_id", F.lit("done").alias("status")), ["analysis_id"])
    st.insert(store, "sample_groups", ids.select(
        "analysis_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("group_index")), ["analysis_id", "group_index"])
    st.insert(store, "deep_analyses", ids.select("analysis_id", deep, F.lit(FDR).alias("fdr_threshold")), ["analysis_id", "deep_analysis_id"])
    st.insert(store, "tags", ev.select(deep, "event_id"), ["deep_analysis_id", "event_id"])
    return store


@query("d14_delete_analysis", """, stored AS (SELECT *, 'AN/0' || (event_id % 4) AS analysis_id FROM splice_events), kept AS (SELECT * FROM stored WHERE analysis_id <> 'AN/01')
SELECT 'features' AS table_name, analysis_id AS id, cast(sum(exon_end - exon_start) AS bigint) AS n FROM kept WHERE event_type = 'SE' GROUP BY 2
UNION ALL SELECT 'tags', 'D ' || analysis_id, cast(sum(event_id) AS bigint) FROM kept GROUP BY 2
UNION ALL SELECT DISTINCT 'deep_analyses', 'D ' || analysis_id, 1 FROM kept
UNION ALL SELECT DISTINCT 'sample_groups', analysis_id, 3 FROM kept
UNION ALL SELECT DISTINCT 'analyses', analysis_id, 1 FROM kept""")
def d14_stored(spark, sf):
    """What is left in the stored tables after one analysis is deleted (events: see l1)."""
    store = _filled(spark, sf)
    st.delete_analysis(store, "AN/01")
    one, total = F.lit(1).cast("bigint"), lambda c: F.sum(c).cast("bigint")
    parts = {
        "features": ("analysis_id", total("exon_size")), "tags": ("deep_analysis_id", total("event_id")),
        "deep_analyses": ("deep_analysis_id", total(one)), "sample_groups": ("analysis_id", total("group_index")),
        "analyses": ("analysis_id", total(one)),
    }
    out = None
    for table, (key, value) in parts.items():
        rows = store.read(table).groupBy(F.col(key).alias("id")).agg(value.alias("n")).select(
            F.lit(table).alias("table_name"), "id", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("l2_upsert_stored", "SELECT event_id, 'AN/0' || (event_id % 4) AS analysis_id, CASE WHEN event_id % 4 = 2 AND event_id % 3 = 0 THEN exon_end - exon_start + 1000 ELSE exon_end - exon_start END AS exon_size FROM se")
def l2_stored(spark, sf):
    """Features of one analysis replaced from the table itself; the others are not rewritten."""
    store = _filled(spark, sf)
    again = store.read("features").where("analysis_id = 'AN/02' AND event_id % 3 = 0").withColumn(
        "exon_size", F.col("exon_size") + 1000)
    st.upsert(store, "features", again, ["analysis_id", "event_id"])
    return store.read("features").select("event_id", "analysis_id", "exon_size")


@query("l8_delete_stored", "SELECT 'D AN/0' || (event_id % 4) AS deep_analysis_id, count(*) AS n_tags FROM splice_events WHERE event_id % 4 <> 3 GROUP BY 1")
def l8_stored(spark, sf):
    store = _filled(spark, sf)
    st.delete_deep_analysis(store, "D AN/03")
    return store.read("tags").join(store.read("deep_analyses"), "deep_analysis_id").groupBy("deep_analysis_id").agg(
        F.count(F.lit(1)).alias("n_tags"))


@query("l1_insert_counted", f""", keyed AS (SELECT 'A' AS analysis_id, *, row_number() OVER (PARTITION BY {', '.join(st.IDENTITY_COLUMNS)} ORDER BY event_id) AS rn, event_id % 2 AS half FROM splice_events),
halves AS (SELECT *, min(half) OVER (PARTITION BY {', '.join(st.IDENTITY_COLUMNS)}) AS first_half FROM keyed)
SELECT 'even rows' AS load, 1 AS ord, count(DISTINCT CASE WHEN first_half = 0 THEN md5(concat_ws('|', {', '.join(f"coalesce(cast({c} AS varchar), '-')" for c in st.IDENTITY_COLUMNS)})) END) AS n_inserted FROM halves
UNION ALL SELECT 'even rows again', 2, 0
UNION ALL SELECT 'all rows', 3, count(DISTINCT CASE WHEN first_half = 1 THEN md5(concat_ws('|', {', '.join(f"coalesce(cast({c} AS varchar), '-')" for c in st.IDENTITY_COLUMNS)})) END) FROM halves""")
def l1_counted(spark, sf):
    """Rows that each of three loads adds: half of the events, the same again, all."""
    store = st.Store(spark, scratch_path(spark, "store"))
    ev = fx.events(spark, sf).withColumn("analysis_id", F.lit("A"))
    even = ev.where("event_id % 2 = 0")
    loads = [("even rows", even), ("even rows again", even), ("all rows", ev)]
    counts = [(name, i, st.insert_events(store, rows)) for i, (name, rows) in enumerate(loads, 1)]
    total = store.read("events").count()
    assert total == sum(n for _, _, n in counts)
    return spark.createDataFrame(counts, "load string, ord int, n_inserted bigint")
