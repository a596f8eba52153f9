"""Registered queries: file readers.  The files are written by Spark from the given
tables into the shared folder and read back through the library's readers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from isoscope.functions.catalogue import ALT_SITE_COORDS, GENERIC_COORDS
from isoscope.operators import ingest
from isoscope.plans.lineage import scratch_path, still_there
from isoscope.registry import fixtures as fx
from isoscope.registry.filters import COVERED, MXE_NEAR, RI_NEAR, SE_NEAR, _alt, _greedy
from isoscope.sources import event_tables as et
from isoscope.sources import genome as gn
from isoscope.sources import transcripts as tx

R = fx.Registry()
query = R.query

# -- detection by name -----------------------------------------------------------------
# (name, header, expected type, expected mode), hand-derived
_NAMES = [
    ("PRIMARY_SE.MATS.JC.txt", "", "SE", "JC"), ("MYSERIES_RI_MATS_JCEC (1).txt", "", "RI", "JCEC"),
    ("a3ss-mats-jc.txt.gz", "", "A3SS", "JC"), ("fromGTF.novelSpliceSite.MXE.txt", "", "MXE", None),
    ("x_fromGTF_A5SS.txt", "", "A5SS", None), ("table.txt", "ID riExonEnd", "RI", None),
    ("SE_table.JC.txt", "1stExonEnd", "MXE", "JC"), ("A5SS_then_A3SS.txt", "shortES", "A3SS", None),
    ("SE_alt.txt", "flankingEE", None, None), ("plain.JCEC.txt", "exonStart", "SE", "JCEC"),
    ("RI_SE_results.JC_JCEC", "other", "SE", "JCEC"), ("PRIMARY.txt", "", None, None),
    ("SERIES.MATS.JC.txt", "", None, "JC"), ("SE.MATS.JCX.txt", "", "SE", None),
]


def _named(spark, sf):
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(h).alias("header")) for n, h, _, _ in _NAMES])
    pick = F.element_at(rows, (F.col("event_id") % len(_NAMES) + 1).cast("int"))
    return fx.events(spark, sf).select("event_id", pick.alias("x")).select(
        "event_id", F.concat("event_id", F.lit("/"), "x.name").alias("name"),
        F.split("x.header", " ").alias("header"))


def _expected(i: int) -> str:
    return f"CASE event_id % {len(_NAMES)} " + " ".join(
        f"WHEN {k} THEN '{row[i]}'" for k, row in enumerate(_NAMES) if row[i]) + " END"


@query("a1_event_type", f"SELECT event_id, {_expected(2)} AS event_type FROM splice_events")
def a1(spark, sf):
    return _named(spark, sf).select("event_id", et.event_type(F.col("name"), F.col("header")).alias("event_type"))


@query("a2_counting_mode", f"SELECT event_id, {_expected(3)} AS counting_mode FROM splice_events")
def a2(spark, sf):
    return _named(spark, sf).select("event_id", et.counting_mode(F.col("name")).alias("counting_mode"))


# -- event tables ---------------------------------------------------------------------------
_SHARED = {"upstreamES": "upstream_es", "upstreamEE": "upstream_ee",
           "downstreamES": "downstream_es", "downstreamEE": "downstream_ee"}
_ALT = {"longExonStart_0base": "long_exon_start", "longExonEnd": "long_exon_end", "shortES": "short_es",
        "shortEE": "short_ee", "flankingES": "flanking_es", "flankingEE": "flanking_ee"}
_LAYOUT = {
    "SE": {"exonStart_0base": "exon_start", "exonEnd": "exon_end", **_SHARED},
    "RI": {"riExonStart_0base": "exon_start", "riExonEnd": "exon_end", **_SHARED},
    "MXE": {"1stExonStart_0base": "exon_start", "1stExonEnd": "exon_end",
            "2ndExonStart_0base": "second_exon_start", "2ndExonEnd": "second_exon_end", **_SHARED},
    "A3SS": _ALT, "A5SS": _ALT,
}
LOST = "event_id % 71 = 0"  # rows written without any coordinate


_landed: dict[tuple[str, str], str] = {}


def write_tables(spark, sf) -> str:
    """One folder per type and mode, named like the caller's files; written once a session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _landed or not still_there(spark, _landed[key]):
        _landed[key] = _write_tables(spark, sf)
    return _landed[key]


def _write_tables(spark, sf) -> str:
    root = scratch_path(spark, "tsv")
    ev = fx.events(spark, sf).withColumn(
        "name", F.concat("event_type", F.lit(".MATS."), "counting_mode", F.lit(".txt")))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("NA"))
    digits = F.lpad((F.col("event_id") * 7907 % 1000).cast("string"), 4, "0")
    point = F.when(F.col("event_id") % 53 == 0, "0,").otherwise("0.")
    for kind, columns in _LAYOUT.items():
        coords = [F.when(F.expr(LOST), "NA").otherwise(text(c)).alias(raw) for raw, c in columns.items()]
        ev.where(F.col("event_type") == kind).select(
            F.col("event_id").alias("ID"), F.concat(F.lit('"'), "gene_id", F.lit('"')).alias("GeneID"),
            F.col("gene_symbol").alias("geneSymbol"), F.lit("no").alias("InPanel"), "chr", "strand", *coords,
            *[text(c).alias(c.upper()) for c in ("ijc_sample_1", "sjc_sample_1", "ijc_sample_2", "sjc_sample_2")],
            F.lit(100).alias("IncFormLen"), F.lit(50).alias("SkipFormLen"), text("p_value").alias("PValue"),
            F.when(F.col("fdr").isNull(), "NA").otherwise(F.concat(point, digits)).alias("FDR"),
            text("inc_level_1").alias("IncLevel1"), text("inc_level_2").alias("IncLevel2"),
            text("inc_level_difference").alias("IncLevelDifference"), "name",
        ).write.option("sep", "\t").option("header", True).option("quote", "").partitionBy("name").mode(
            "append").csv(root)
    return root


@query("a3_header_read", "SELECT DISTINCT 'name=' || event_type || '.MATS.' || counting_mode || '.txt' AS name, event_type, counting_mode, cast(CASE event_type WHEN 'MXE' THEN 25 ELSE 23 END AS bigint) AS n_columns FROM splice_events")
def a3(spark, sf):
    h = et.headers(spark, [write_tables(spark, sf)])
    return h.select("name", "event_type", "counting_mode", F.size("header").cast("bigint").alias("n_columns")).distinct()


@query("a4_tsv_scan", "SELECT event_type, cast(event_id AS varchar) AS id, gene_id AS gene, cast(CASE event_type WHEN 'MXE' THEN 25 ELSE 23 END AS bigint) AS n_cells FROM splice_events")
def a4(spark, sf):
    cells = et.raw_cells(spark, [write_tables(spark, sf)])
    return cells.select("event_type", F.col("cells")[0].alias("id"), F.col("cells")[1].alias("gene"),
                        F.size("cells").cast("bigint").alias("n_cells"))


@query("a5_renamed_columns", f"SELECT cast(event_id AS varchar) AS caller_id, gene_symbol, CASE WHEN {LOST} OR event_type IN ('A3SS', 'A5SS') THEN NULL ELSE cast(exon_start AS varchar) END AS exon_start, CASE WHEN {LOST} THEN NULL ELSE cast(second_exon_end AS varchar) END AS second_exon_end, inc_level_1 FROM splice_events")
def a5(spark, sf):
    return et.text_columns(spark, [write_tables(spark, sf)]).select(
        "caller_id", "gene_symbol", "exon_start", "second_exon_end", "inc_level_1")


@query("a6_coerced_types", f"SELECT event_id AS caller_id, CASE WHEN {LOST} THEN NULL ELSE flanking_ee END AS flanking_ee, round(fdr, 6) AS fdr, round(p_value, 9) AS p_value, inc_level_difference, cast(100 AS integer) AS inc_form_len FROM splice_events")
def a6(spark, sf):
    return et.coerced(et.text_columns(spark, [write_tables(spark, sf)])).select(
        "caller_id", "flanking_ee", F.round("fdr", 6).alias("fdr"), F.round("p_value", 9).alias("p_value"),
        "inc_level_difference", "inc_form_len")


@query("a7_located_rows", f"SELECT event_type, count(*) AS n FROM splice_events WHERE NOT ({LOST}) GROUP BY event_type")
def a7(spark, sf):
    rows = et.located(et.coerced(et.text_columns(spark, [write_tables(spark, sf)])))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("a8_generic_alt_sites", """SELECT event_id, long_exon_start AS exon_start, long_exon_end AS exon_end, CASE WHEN low THEN f1 END AS upstream_es, CASE WHEN low THEN f2 END AS upstream_ee, CASE WHEN NOT low THEN f1 END AS downstream_es, CASE WHEN NOT low THEN f2 END AS downstream_ee
  FROM (SELECT *, f2 <= long_exon_start AS low FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN long_exon_end + 90 ELSE flanking_es END AS f1, CASE WHEN event_id % 3 = 0 THEN long_exon_end + 190 WHEN event_id % 7 = 0 THEN NULL ELSE flanking_ee END AS f2
    FROM splice_events WHERE event_type IN ('A3SS', 'A5SS')) x) y""")
def a8(spark, sf):
    alt = fx.events(spark, sf).where("event_type IN ('A3SS', 'A5SS')").withColumns({
        "flanking_es": F.expr("CASE WHEN event_id % 3 = 0 THEN long_exon_end + 90 ELSE flanking_es END"),
        "flanking_ee": F.expr("CASE WHEN event_id % 3 = 0 THEN long_exon_end + 190 WHEN event_id % 7 = 0 THEN NULL ELSE flanking_ee END")})
    return et.with_generic_alt_site(alt).select("event_id", *GENERIC_COORDS)


@query("a9_provenance", f"SELECT event_id AS caller_id, 'AN1' AS analysis_id, event_type, counting_mode, abs(inc_level_difference) AS abs_inc_level_diff FROM splice_events WHERE NOT ({LOST})")
def a9(spark, sf):
    return et.read_events(spark, [write_tables(spark, sf)], "AN1").select(
        "caller_id", "analysis_id", "event_type", "counting_mode", "abs_inc_level_diff")


_SIDES = "CASE WHEN event_type IN ('A3SS', 'A5SS') THEN {1} ELSE {0} END AS {0}"


@query("a10_j1_read_all_files", "SELECT event_id AS caller_id, event_type, gene_id, chr, strand, exon_start, exon_end, "
       + ", ".join(_SIDES.format(a, b) for a, b in (("upstream_es", "flanking_es"), ("upstream_ee", "flanking_ee"), ("downstream_es", "NULL"), ("downstream_ee", "NULL")))
       + f", second_exon_start, second_exon_end, {', '.join(ALT_SITE_COORDS)}, ijc_sample_1, sjc_sample_2, round(fdr, 6) AS fdr, inc_level_2 FROM splice_events WHERE NOT ({LOST})")
def a10(spark, sf):
    return et.read_events(spark, [write_tables(spark, sf)], "AN1").select(
        "caller_id", "event_type", "gene_id", "chr", "strand", *GENERIC_COORDS, "second_exon_start",
        "second_exon_end", *ALT_SITE_COORDS, "ijc_sample_1", "sjc_sample_2", F.round("fdr", 6).alias("fdr"), "inc_level_2")


_FROM_FILES = COVERED + f", landed AS (SELECT * FROM covered WHERE NOT ({LOST}))\n" + "".join(
    _greedy(k, n, "landed") for k, n in (("SE", SE_NEAR), ("RI", RI_NEAR), ("MXE", MXE_NEAR))) + _alt("landed")


@query("c8_ingest_files", _FROM_FILES + "SELECT event_type, count(*) AS n_stored FROM splice_events JOIN (SELECT event_id FROM se_kept UNION ALL SELECT event_id FROM ri_kept UNION ALL SELECT event_id FROM mxe_kept UNION ALL SELECT event_id FROM alt_kept) k USING (event_id) GROUP BY event_type")
def c8_files(spark, sf):
    """Files to stored events in one go."""
    stored = ingest.ingest_files(spark, [write_tables(spark, sf)], "AN1").events
    return stored.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_stored"))


# -- genome, transcripts, gene sets ----------------------------------------------------------
@query("a11_fasta_chunks", "SELECT contig, cast(i AS bigint) AS chunk_id, substr(t, i * 1000 + 1, 1000) AS seq FROM contig_text CROSS JOIN (SELECT unnest(range(0, 21)) AS i) x")
def a11(spark, sf):
    root = scratch_path(spark, "fasta")
    whole = fx.chunks(spark, sf).groupBy("contig").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("chunk_id", "seq")))["seq"], "").alias("t"))
    lines = F.transform(F.sequence(F.lit(0), F.floor((F.length("t") - 1) / 60).cast("int")),
                        lambda i: F.substring("t", i * 60 + 1, F.lit(60)))
    text = F.concat(F.lit(">"), "contig", F.lit("\n"), F.array_join(lines, "\n"))
    records = whole.select("contig", F.length("t").alias("length"), text.alias("value"))
    records.coalesce(1).sortWithinPartitions("contig").select("value").write.text(f"{root}/fa")
    before = Window.orderBy("contig").rowsBetween(Window.unboundedPreceding, -1)  # one row per contig
    offset = F.coalesce(F.sum(F.length("value") + 1).over(before), F.lit(0)) + F.length("contig") + 2
    records.select("contig", "length", offset.alias("offset"), F.lit(60).alias("bases"), F.lit(61).alias("bytes")
                   ).write.option("sep", "\t").csv(f"{root}/fai")
    fasta = spark.read.format("binaryFile").load(f"{root}/fa").select("path").first()["path"]
    return gn.read_fasta(spark, fasta, f"{root}/fai", 1000)


@query("a11_stored_genome", "SELECT contig, cast(i AS bigint) AS wide_id, substr(t, i * 1024 + 1, 1280) AS seq FROM contig_text CROSS JOIN (SELECT unnest(range(0, 20)) AS i) x")
def a11_stored(spark, sf):
    """Rows of the genome as the catalogue has them."""
    return fx.genome(spark, sf).table


# a clinical transcript first, then the selected one; every third gene has no tag
_GFF_SQL = """, tx2 AS (SELECT g, n, 'ENST' || lpad(cast(g AS varchar), 9, '0') || n AS transcript_id, 'ENSG' || lpad(cast(g AS varchar), 11, '0') AS gene_id,
    CASE WHEN g % 3 = 0 THEN '' WHEN n = 1 THEN 'MANE_Plus_Clinical' ELSE 'basic,MANE_Select' END AS tag FROM genes CROSS JOIN (SELECT unnest([1, 2]) AS n) x)
"""


def _gff(spark, sf) -> str:
    root = scratch_path(spark, "gff")
    base = fx.genes(spark, sf).withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))
    rows = base.select("g", "n", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("j"))
    tag = "CASE WHEN g % 3 = 0 THEN '' WHEN n = 1 THEN ';tag=MANE_Plus_Clinical' ELSE ';tag=basic,MANE_Select' END"
    tid = "concat('ENST', lpad(cast(g AS string), 9, '0'), n)"
    attrs = (f"CASE WHEN j = 0 THEN concat('ID=transcript:', {tid}, '.3;gene_id=ENSG', lpad(cast(g AS string), 11, '0'), '.7;transcript_id=', {tid}, '.3', {tag}) "
             f"WHEN j % 2 = 1 THEN concat('ID=exon', j, ';Parent=transcript:', {tid}, '.3') ELSE concat('Parent=', {tid}, '.9') END")
    line = (f"concat_ws('\\t', cast(g % 22 + 1 AS string), 'src', CASE WHEN j = 0 THEN 'transcript' WHEN j IN (3, 6) THEN 'CDS' ELSE 'exon' END, "
            f"cast(1001 + (7 - j) * 500 + g AS string), cast(1100 + (7 - j) * 500 + g + n AS string), '.', CASE WHEN g % 2 = 0 THEN '+' ELSE '-' END, '.', {attrs})")
    rows.selectExpr("g", "n", "j", f"{line} AS value").coalesce(1).sortWithinPartitions("g", "n", "j").selectExpr(
        "CASE WHEN g % 50 = 0 AND n = 1 AND j = 0 THEN concat('# comment\\n', value) ELSE value END AS value"
    ).write.option("compression", "gzip").text(root)
    return root


@query("a13_gff3_features", _GFF_SQL + "SELECT 'chr' || (g % 22 + 1) AS chr, CASE WHEN j = 0 THEN 'transcript' WHEN j IN (3, 6) THEN 'CDS' ELSE 'exon' END AS feature, 1000 + (7 - j) * 500 + g AS \"start\", 1100 + (7 - j) * 500 + g + n AS \"end\", CASE WHEN g % 2 = 0 THEN '+' ELSE '-' END AS strand FROM tx2 CROSS JOIN (SELECT unnest(range(0, 7)) AS j) y")
def a13(spark, sf):
    return tx.read_gff3(spark, _gff(spark, sf)).select("chr", "feature", "start", "end", "strand")


@query("a14_assembled_transcripts", _GFF_SQL + """SELECT transcript_id, gene_id, tag LIKE '%MANE_Select' AS is_select, tag = 'MANE_Plus_Clinical' AS is_plus_clinical,
  array_to_string(list_transform([5, 4, 2, 1], lambda j: (1000 + (7 - j) * 500 + g) || '-' || (1100 + (7 - j) * 500 + g + n)), ',') AS exons,
  array_to_string(list_transform([6, 3], lambda j: (1000 + (7 - j) * 500 + g) || '-' || (1100 + (7 - j) * 500 + g + n)), ',') AS cds FROM tx2""")
def a14(spark, sf):
    spans = lambda c: F.array_join(F.transform(c, lambda e: F.concat(e["start"], F.lit("-"), e["end"])), ",")
    return tx.assembled(tx.read_gff3(spark, _gff(spark, sf))).select(
        "transcript_id", "gene_id", "is_select", "is_plus_clinical", spans("exons").alias("exons"), spans("cds").alias("cds"))


@query("a15_representative_transcript", _GFF_SQL + "SELECT gene_id, transcript_id FROM tx2 WHERE n = CASE WHEN g % 3 = 0 THEN 1 ELSE 2 END")
def a15(spark, sf):
    return tx.representative(tx.assembled(tx.read_gff3(spark, _gff(spark, sf)))).select("gene_id", "transcript_id")


@query("a16_gene_set_sizes", """, sets AS (SELECT 'LIB' || (t % 3) AS library, 'TERM' || t AS term, 'GENE' || g AS gene FROM genes CROSS JOIN (SELECT unnest(range(0, 40)) AS t) x WHERE (g * (t + 3)) % 7 = t % 7)
SELECT 'library=' || library AS library, term, count(*) AS size FROM sets GROUP BY ALL""")
def a16(spark, sf):
    root = scratch_path(spark, "gmt")
    fx.gene_set_rows(spark, sf).groupBy("library", "term").agg(F.array_join(F.collect_list("gene"), "\t\t").alias("members")).select(
        F.concat("term", F.lit("\tabout\t"), "members", F.lit("\t ")).alias("value"), "library"
    ).write.partitionBy("library").text(root)
    return tx.gene_set_sizes(tx.gene_sets(spark, [root]))


@query("a16_blank_gene_sets", """, sets AS (SELECT 'LIB' || (t % 3) AS library, 'TERM' || t AS term, 'GENE' || g AS gene, t FROM genes CROSS JOIN (SELECT unnest(range(0, 40)) AS t) x WHERE (g * (t + 3)) % 7 = t % 7)
SELECT 'library=' || library AS library, term, cast(sum(CASE WHEN t % 4 = 0 THEN 0 ELSE 1 END) AS bigint) AS size FROM sets GROUP BY library, term""")
def a16_blank(spark, sf):
    """Every fourth term has blank genes only: it is listed with size 0."""
    root = scratch_path(spark, "gmt")
    blank = F.expr("cast(substring(term, 5) AS int) % 4 = 0")
    gene = F.when(blank, " ").otherwise(F.col("gene"))
    fx.gene_set_rows(spark, sf).groupBy("library", "term").agg(F.array_join(F.collect_list(gene), "\t").alias("members")).select(
        F.concat("term", F.lit("\tabout\t"), "members").alias("value"), "library").write.partitionBy("library").text(root)
    return tx.gene_set_sizes(tx.gene_set_lines(spark, [root]))
