"""Registered queries: joins with genome and transcripts, scalar sequence functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from isoscope.functions import coordinates as co
from isoscope.functions import genome_order as go
from isoscope.functions import labels, numeric
from isoscope.functions import sequence as sq
from isoscope.functions.catalogue import CONTIG_ALIAS, MOTIFS, literal_map, motif_width
from isoscope.operators import annotation as an
from isoscope.operators import features as ft
from isoscope.operators import maintenance, motifs, permutation, significance
from isoscope.registry import fixtures as fx
from isoscope.registry.fixtures import DEEP, SIG
from isoscope.sources import genome as gn

R = fx.Registry()
query = R.query

FEATURE_SQL = ", ".join(f"f.{c}" for c in ft.FEATURE_COLUMNS if c not in (
    "event_id", "sequence_source", "window_truncated"))


# -- joins ---------------------------------------------------------------------------
@query("d1_events_with_features", f"SELECT e.event_id, e.gene_symbol, e.fdr, f.event_id IS NOT NULL AS has_features, {FEATURE_SQL} FROM se e LEFT JOIN (SELECT * FROM features WHERE event_id % 5 <> 0) f USING (event_id)")
def d1(spark, sf):
    some = fx.features(spark, sf).where("event_id % 5 <> 0")
    out = ft.events_with_features(fx.events(spark, sf), some)
    return out.select("event_id", "gene_symbol", "fdr", "has_features", *[
        c for c in ft.FEATURE_COLUMNS if c not in ("event_id", "sequence_source", "window_truncated")])


@query("d2_deep_analysis_events", f"SELECT event_id, event_type, true AS is_significant FROM splice_events WHERE {SIG}")
def d2(spark, sf):
    return significance.deep_analysis_events(
        fx.events(spark, sf), fx.tags(spark, sf), DEEP, True
    ).select("event_id", "event_type", "is_significant")


@query("d3_events_tags_features", "SELECT event_id, sig AS is_significant, exon_size, frame_class, donor_is_gt FROM joined")
def d3(spark, sf):
    tagged = significance.deep_analysis_events(fx.events(spark, sf), fx.tags(spark, sf), DEEP)
    return ft.events_with_features(tagged, fx.features(spark, sf)).select(
        "event_id", "is_significant", "exon_size", "frame_class", "donor_is_gt")


_REGIONS = """, probes AS (SELECT event_id, CASE WHEN event_id % 41 = 0 THEN 'chrUn' ELSE chr END AS chr,
    CASE WHEN event_id % 7 = 0 THEN exon_start % 40 - 30 WHEN event_id % 11 = 0 THEN 20480 - event_id % 90 ELSE exon_start - 1500 END AS a,
    CASE WHEN event_id % 7 = 0 THEN exon_start % 40 - 20 + event_id % 30 WHEN event_id % 11 = 0 THEN 20480 + event_id % 13 ELSE exon_start - 1500 + event_id % 1400 END AS b
  FROM splice_events)
"""


@query("d4_region_sequence", _REGIONS + """SELECT event_id, CASE WHEN t IS NOT NULL AND b > greatest(a, 0) THEN substr(t, cast(greatest(a, 0) + 1 AS bigint), cast(b - greatest(a, 0) AS bigint)) ELSE '' END AS seq
  FROM probes LEFT JOIN contig_text ON chr = contig""")
def d4(spark, sf):
    probes = fx.events(spark, sf).selectExpr(
        "event_id", "CASE WHEN event_id % 41 = 0 THEN 'chrUn' ELSE chr END AS chr",
        "CASE WHEN event_id % 7 = 0 THEN exon_start % 40 - 30 WHEN event_id % 11 = 0 THEN 20480 - event_id % 90 ELSE exon_start - 1500 END AS start",
        "CASE WHEN event_id % 7 = 0 THEN exon_start % 40 - 20 + event_id % 30 WHEN event_id % 11 = 0 THEN 20480 + event_id % 13 ELSE exon_start - 1500 + event_id % 1400 END AS end")
    genome = fx.genome(spark, sf)
    named = gn.resolved_contig(probes, gn.known_contigs(genome))
    return gn.region_sequences(named, genome, ["event_id"]).select("event_id", "seq")


def _modelled(spark, sf):
    return ft.with_model(fx.skipped(spark, sf), fx.models(spark, sf))


@query("d5_transcript_of_gene", "SELECT event_id, transcript_id, n_exons FROM se LEFT JOIN tx_span USING (gene_id)")
def d5(spark, sf):
    return _modelled(spark, sf).select(
        "event_id", F.col("tx.transcript_id").alias("transcript_id"),
        F.size("tx.exons").cast("bigint").alias("n_exons"))


@query("d6_exon_rank", "SELECT event_id, exon_rank FROM frames")
def d6(spark, sf):
    return _modelled(spark, sf).select("event_id", ft.exon_rank().alias("exon_rank"))


@query("d7_overlap_correction", "SELECT event_id, ms AS model_start, me AS model_end FROM fixed WHERE msource = 'overlap'")
def d7(spark, sf):
    fix = _modelled(spark, sf).select("event_id", ft.corrected_boundaries().alias("x"))
    return fix.where("x.source = 'overlap'").select(
        "event_id", F.col("x.start").alias("model_start"), F.col("x.end").alias("model_end"))


@query("d8_flanking_correction", "SELECT event_id, ms AS model_start, me AS model_end, msource AS source FROM fixed")
def d8(spark, sf):
    fix = _modelled(spark, sf).select("event_id", ft.corrected_boundaries().alias("x"))
    return fix.select("event_id", F.col("x.start").alias("model_start"),
                      F.col("x.end").alias("model_end"), F.col("x.source").alias("source"))


@query("d9_transcript_by_position", """, spans AS (SELECT chr, transcript_id, min(exon_start) AS a, max(exon_end) AS b FROM transcript_exons GROUP BY ALL),
lost AS (SELECT * FROM splice_events WHERE gene_id NOT IN (SELECT gene_id FROM transcript_exons))
SELECT event_id, transcript_id FROM (SELECT event_id, transcript_id, row_number() OVER (PARTITION BY event_id ORDER BY a, transcript_id) AS rn
  FROM lost JOIN spans USING (chr) WHERE exon_start < b AND a < exon_end) x WHERE rn = 1""")
def d9(spark, sf):
    exons = fx.transcript_exons(spark, sf)
    place = exons.select("gene_id", "chr").distinct()
    return ft.model_by_position(
        fx.events(spark, sf), fx.models(spark, sf).join(place, "gene_id")
    ).select("event_id", "transcript_id")


@query("d10_exon_in_coding_span", "SELECT event_id, frame_region, cds_exon_length FROM frames WHERE frame_region IN ('CDS', 'partial')")
def d10(spark, sf):
    frame = _modelled(spark, sf).select("event_id", ft.frame_annotation().alias("x"))
    return frame.select("event_id", "x.frame_region", "x.cds_exon_length").where(
        "frame_region IN ('CDS', 'partial')")


_PAIRS = """, cand AS (SELECT unnest(['GENE3', 'gene50', 'GENE121']) AS candidate),
pairs AS (SELECT least(upper(gene_symbol), upper(candidate)) AS lo, greatest(upper(gene_symbol), upper(candidate)) AS hi,
    min(gene_symbol || '|' || candidate) AS best
  FROM (SELECT DISTINCT gene_symbol FROM splice_events) s CROSS JOIN cand WHERE upper(gene_symbol) <> upper(candidate) GROUP BY 1, 2)
"""


@query("d11_candidate_pairs", _PAIRS + "SELECT lo AS pair_lo, hi AS pair_hi FROM pairs")
def d11(spark, sf):
    symbols = fx.events(spark, sf).select("gene_symbol").distinct()
    return an.candidate_pairs(symbols, fx.CANDIDATES).select("pair_lo", "pair_hi")


@query("d12_significant_results", f"SELECT event_id, round(coalesce(inc_level_difference, 0), 4) AS observed_delta_psi FROM se WHERE {SIG}")
def d12(spark, sf):
    ev = fx.events(spark, sf)
    results = permutation.event_inputs(ev).select(
        "event_id", F.round("delta", 4).alias("observed_delta_psi"))
    return permutation.significant_view(results, ev, fx.significant())


@query("d13_features_of_tagged", "SELECT f.event_id, f.exon_size, f.frame_class FROM features f JOIN se USING (event_id) WHERE sig")
def d13(spark, sf):
    wanted = fx.tags(spark, sf).where("is_significant").select("event_id")
    return fx.features(spark, sf).join(wanted, "event_id", "left_semi").select(
        "event_id", "exon_size", "frame_class")


_ANALYSES = "'AN' || cast(event_id % 4 AS varchar)"


@query("d14_cascade_delete", f"""SELECT 'events' AS table_name, count(*) AS n FROM splice_events WHERE {_ANALYSES} <> 'AN1'
UNION ALL SELECT 'features', count(*) FROM se WHERE {_ANALYSES} <> 'AN1'
UNION ALL SELECT 'tags', count(*) FROM splice_events WHERE {_ANALYSES} <> 'AN1'
UNION ALL SELECT 'deep_analyses', count(DISTINCT event_id % 4) FROM splice_events WHERE {_ANALYSES} <> 'AN1'""")
def d14(spark, sf):
    ev = fx.events(spark, sf).withColumn(
        "analysis_id", F.concat(F.lit("AN"), (F.col("event_id") % 4).cast("string")))
    deep = ev.select("analysis_id", F.concat(F.lit("D"), "analysis_id").alias("deep_analysis_id")).distinct()
    tags = ev.select(F.concat(F.lit("D"), "analysis_id").alias("deep_analysis_id"), "event_id")
    features = ev.where("event_type = 'SE'").select("event_id")
    left = maintenance.without_analysis("AN1", ev, features, deep, tags)
    parts = [df.groupBy(F.lit(name).alias("table_name")).agg(F.count(F.lit(1)).alias("n"))
             for name, df in left.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# -- scalar functions --------------------------------------------------------------------
_WINDOW_TEXT = "coalesce(donor_seq, '') || 'nRyU' || coalesce(ppt_seq, '')"


def _texts(spark, sf):
    ev = ft.annotated(fx.skipped(spark, sf), fx.models(spark, sf))
    return ft.splice_window_sequences(ev, fx.genome(spark, sf))


@query("e1_reverse_complement", "SELECT event_id, reverse(translate(" + _WINDOW_TEXT + ", 'ACGTnRyU', 'TGCAnYrA')) AS rc FROM texts")
def e1(spark, sf):
    text = F.concat(F.coalesce("donor_seq", F.lit("")), F.lit("nRyU"), F.coalesce("ppt_seq", F.lit("")))
    return _texts(spark, sf).select("event_id", sq.reverse_complement(text).alias("rc"))


@query("e2_window_coordinates", "SELECT event_id, w.slot AS slot, w.a AS \"start\", w.b AS \"end\" FROM win WHERE w.a IS NOT NULL AND w.b IS NOT NULL")
def e2(spark, sf):
    ev = ft.annotated(fx.skipped(spark, sf), fx.models(spark, sf))
    start, end = F.coalesce("model_start", "exon_start"), F.coalesce("model_end", "exon_end")
    return ev.select("event_id", F.inline(co.as_long(co.splice_windows(start, end)))
    ).where(co.KNOWN)


@query("e3_window_sequences", "SELECT event_id, donor_seq, acceptor_seq, ppt_seq, upstream_donor_seq, downstream_acceptor_seq FROM texts")
def e3(spark, sf):
    return _texts(spark, sf).drop("window_truncated")


@query("e4_window_boundaries", "SELECT event_id, coalesce(ms, exon_start) AS window_start, coalesce(me, exon_end) AS window_end FROM se JOIN fixed USING (event_id)")
def e4(spark, sf):
    ev = ft.annotated(fx.skipped(spark, sf), fx.models(spark, sf))
    return ev.select("event_id", F.coalesce("model_start", "exon_start").alias("window_start"),
                     F.coalesce("model_end", "exon_end").alias("window_end"))


SCAN_SQL = """, base AS (SELECT event_id, chr, strand, exon_start AS s, exon_end AS e, upstream_es AS ues, upstream_ee AS u, downstream_es AS d, downstream_ee AS dee FROM se),
introns AS (SELECT *, CASE WHEN strand = '+' THEN u + 6 ELSE u + 20 END AS alo, CASE WHEN strand = '+' THEN s - 20 ELSE s - 6 END AS ahi,
    CASE WHEN strand = '+' THEN e + 6 ELSE e + 20 END AS blo, CASE WHEN strand = '+' THEN d - 20 ELSE d - 6 END AS bhi FROM base),
scan_raw AS (SELECT event_id, chr, strand, unnest(CASE WHEN strand = '+' THEN [
      {'region': 'upstream_exon', 'a': greatest(ues, u - 250), 'b': u},
      {'region': 'upstream_intron_5ss', 'a': alo, 'b': least(alo + 250, ahi)}, {'region': 'upstream_intron_3ss', 'a': greatest(ahi - 250, alo), 'b': ahi},
      {'region': 'skipped_exon', 'a': s, 'b': e},
      {'region': 'downstream_intron_5ss', 'a': blo, 'b': least(blo + 250, bhi)}, {'region': 'downstream_intron_3ss', 'a': greatest(bhi - 250, blo), 'b': bhi},
      {'region': 'downstream_exon', 'a': d, 'b': least(dee, d + 250)}]
    ELSE [
      {'region': 'upstream_exon', 'a': d, 'b': least(dee, d + 250)},
      {'region': 'upstream_intron_5ss', 'a': greatest(bhi - 250, blo), 'b': bhi}, {'region': 'upstream_intron_3ss', 'a': blo, 'b': least(blo + 250, bhi)},
      {'region': 'skipped_exon', 'a': s, 'b': e},
      {'region': 'downstream_intron_5ss', 'a': greatest(ahi - 250, alo), 'b': ahi}, {'region': 'downstream_intron_3ss', 'a': alo, 'b': least(alo + 250, ahi)},
      {'region': 'downstream_exon', 'a': greatest(ues, u - 250), 'b': u}] END) AS r FROM introns),
scan AS (SELECT event_id, chr, strand, r.region AS region, r.a AS a, r.b AS b FROM scan_raw
  WHERE r.b > r.a AND NOT (d_missing(event_id) AND false)),
"""
# the flank at the high side is unknown for every 89th event: least/greatest of DuckDB
# skip nulls, so those regions are removed by name
SCAN_SQL = SCAN_SQL.replace(
    " AND NOT (d_missing(event_id) AND false)),\n",
    """ AND NOT (event_id % 89 = 0 AND ((strand = '+' AND r.region IN ('downstream_intron_5ss', 'downstream_intron_3ss', 'downstream_exon'))
    OR (strand = '-' AND r.region IN ('upstream_intron_5ss', 'upstream_intron_3ss', 'upstream_exon'))))),
scan_text AS (SELECT event_id, region, CASE WHEN strand = '-' THEN reverse(translate(raw, 'ACGT', 'TGCA')) ELSE raw END AS seq FROM (
    SELECT event_id, strand, region, substr(t, cast(greatest(a, 0) + 1 AS bigint), cast(b - greatest(a, 0) AS bigint)) AS raw FROM scan JOIN contig_text ON chr = contig) x)
""")


@query("e5_scan_regions", SCAN_SQL + "SELECT event_id, region, a AS \"start\", b AS \"end\" FROM scan")
def e5(spark, sf):
    return motifs.region_table(fx.events(spark, sf)).select("event_id", "region", "start", "end")


@query("e5_region_sequences", SCAN_SQL + "SELECT event_id, region, seq FROM scan_text")
def e5_text(spark, sf):
    return motifs.region_text(fx.events(spark, sf), fx.genome(spark, sf))


@query("e6_region_diagnostics", """SELECT count(*) AS n_events, cast(0 AS bigint) AS n_missing_coords,
  count(*) FILTER (WHERE strand = '-' AND downstream_es IS NULL) AS n_null_upstream,
  count(*) FILTER (WHERE strand = '+' AND downstream_es IS NULL) AS n_null_downstream,
  count(*) FILTER (WHERE CASE WHEN strand = '+' THEN exon_start - upstream_ee ELSE downstream_es - exon_end END <= 26) AS n_short_upstream,
  count(*) FILTER (WHERE CASE WHEN strand = '+' THEN downstream_es - exon_end ELSE exon_start - upstream_ee END <= 26) AS n_short_downstream FROM se""")
def e6(spark, sf):
    return motifs.region_diagnostics(fx.events(spark, sf))


def _feature_query(name: str, columns: list[str]) -> None:
    @query(name, f"SELECT event_id, {', '.join(columns)} FROM features")
    def run(spark, sf):
        return ft.with_signals(_texts(spark, sf)).select("event_id", *columns)


_feature_query("e7_donor_gt", ["donor_seq", "donor_is_gt"])
_feature_query("e8_acceptor_ag", ["acceptor_seq", "acceptor_is_ag"])
_feature_query("e9_flanking_sites", ["upstream_donor_is_gt", "downstream_acceptor_is_ag"])
_feature_query("e10_ppt_score", ["ppt_score"])
_feature_query("e14_branch_point_call", ["bp_motif_found", "bp_score", "bp_distance", "bp_position", "bp_motif"])


@query("e11_tract_content", """SELECT event_id, round(length(regexp_replace(ppt_seq, '[^T]', '', 'g')) / cast(length(ppt_seq) AS double), 6) AS t_content,
  round(length(regexp_replace(ppt_seq, '[^C]', '', 'g')) / cast(length(ppt_seq) AS double), 6) AS c_content FROM texts""")
def e11(spark, sf):
    return _texts(spark, sf).select(
        "event_id", F.round(sq.base_fraction(F.col("ppt_seq"), "T"), 6).alias("t_content"),
        F.round(sq.base_fraction(F.col("ppt_seq"), "C"), 6).alias("c_content"))


@query("e12_longest_run", """, runs AS (SELECT event_id, i, length(regexp_extract(substr(ppt_seq, i + 1), '^[CT]*')) AS n
  FROM (SELECT event_id, ppt_seq, unnest(range(0, length(ppt_seq))) AS i FROM texts) x)
SELECT event_id, n AS run_length, CASE WHEN n = 0 THEN 0 ELSE i END AS run_start FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY n DESC, i) AS rn FROM runs) y WHERE rn = 1""")
def e12(spark, sf):
    seq = F.col("ppt_seq")
    return _texts(spark, sf).where("ppt_seq IS NOT NULL").select(
        "event_id", sq.longest_pyrimidine_run(seq).alias("run_length"),
        sq.longest_pyrimidine_run_start(seq).alias("run_start"))


@query("e13_branch_point_search", "SELECT event_id, score, i AS position, dist AS distance FROM bp")
def e13(spark, sf):
    found = _texts(spark, sf).select("event_id", sq.branch_point(F.col("ppt_seq")).alias("b"))
    return found.where("b IS NOT NULL").select("event_id", "b.score", "b.position", "b.distance")


@query("e15_frame_class", "SELECT event_id, frame_region, frame_class, cds_exon_length FROM frames")
def e15(spark, sf):
    frame = _modelled(spark, sf).select("event_id", ft.frame_annotation().alias("x"))
    return frame.select("event_id", "x.frame_region", "x.frame_class", "x.cds_exon_length")


@query("e16_segment_coding_length", """, seg AS (SELECT gene_id, least(exon_start, exon_start) AS a, exon_end + exon_ord % 3 * 900 AS b FROM transcript_exons),
marked AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY gene_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM seg),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY gene_id ORDER BY a, b) AS grp FROM marked),
merged AS (SELECT gene_id, min(a) AS a, max(b) AS b FROM numbered GROUP BY gene_id, grp)
SELECT event_id, cast(sum(greatest(0, least(exon_end, b) - greatest(exon_start, a))) AS bigint) AS coding_nt FROM se JOIN merged USING (gene_id) GROUP BY event_id""")
def e16(spark, sf):
    longer = fx.transcript_exons(spark, sf).withColumn(
        "end", F.col("exon_end") + F.col("exon_ord") % 3 * 900)
    models = longer.groupBy("gene_id").agg(F.collect_list(F.struct(
        F.col("exon_start").alias("start"), "end")).alias("cds"))
    joined = fx.skipped(spark, sf).join(models, "gene_id").withColumn(
        "merged", ft.merged_intervals(F.col("cds")))
    shared = lambda c: F.greatest(F.lit(0).cast("bigint"), F.least("exon_end", c["end"])
                                  - F.greatest("exon_start", c["start"]))
    return joined.select("event_id", F.aggregate(
        "merged", F.lit(0).cast("bigint"), lambda acc, c: acc + shared(c)).alias("coding_nt"))


_MOTIF_ROWS = ", ".join(f"('{n}', '{p}')" for n, _, p in MOTIFS)


@query("e17_motif_width", f""", m(name, pattern) AS (VALUES {_MOTIF_ROWS})
SELECT region, name AS motif_name, length(regexp_replace(pattern, '\\[[A-Z]+\\]', 'x', 'g')) AS width, count(*) AS n_regions
  FROM (SELECT event_id, 'skipped_exon' AS region FROM se) s CROSS JOIN m GROUP BY ALL""")
def e17(spark, sf):
    rows = F.array(*[F.struct(F.lit(n).alias("motif_name"), F.lit(motif_width(p)).alias("width"))
                     for n, _, p in MOTIFS])
    regions = motifs.region_table(fx.events(spark, sf)).where("region = 'skipped_exon'")
    return regions.select("region", F.inline(rows)).groupBy("region", "motif_name", "width").agg(
        F.count(F.lit(1)).alias("n_regions"))


def _starts_here(pattern: str) -> str:
    return (f"regexp_matches(k7, '^{pattern}')" if "[" in pattern
            else f"starts_with(k7, '{pattern}')")


# overlapping counts: every start of every text is looked at through its next 7 bases
HIT_SQL = f""", m(i, motif_name, protein, width) AS (VALUES {', '.join(f"({i}, '{n}', '{f}', {motif_width(p)})" for i, (n, f, p) in enumerate(MOTIFS, 1))}),
starts AS (SELECT event_id, region, length(seq) AS nt, substr(seq, i, 7) AS k7 FROM (SELECT event_id, region, seq, unnest(range(1, length(seq) + 1)) AS i FROM scan_text) x),
wide AS (SELECT event_id, region, nt, [{', '.join(f"count(*) FILTER (WHERE {_starts_here(p)})" for _, _, p in MOTIFS)}] AS c FROM starts GROUP BY event_id, region, nt),
hits AS (SELECT event_id, region, nt, motif_name, protein, width, c[i] AS hits FROM wide CROSS JOIN m)
"""


def _by_motif(spark, sf, value):
    """One row per region with the value of all motifs in catalogue order."""
    line = F.concat_ws(",", *[
        value(F.col(f"hits.m{i}"), F.lit(motif_width(pattern))).cast("string")
        for i, (_, _, pattern) in enumerate(MOTIFS)])
    rows = motifs.region_hits(fx.events(spark, sf), fx.genome(spark, sf)).select(
        "event_id", "region", line.alias("line"))
    # rows of one event_id are listed together, motif by motif
    lists = F.transform("lines", lambda v: F.split(v, ","))
    together = F.array_join(F.flatten(F.transform(
        F.sequence(F.lit(0), F.lit(len(MOTIFS) - 1)),
        lambda i: F.array_sort(F.transform(lists, lambda v: F.get(v, i))))), ",")
    return rows.groupBy("event_id", "region").agg(F.collect_list("line").alias("lines")).select(
        "event_id", "region",
        F.when(F.size("lines") == 1, F.element_at("lines", 1)).otherwise(together).alias("per_motif"))


@query("e18_overlapping_motif_hits", SCAN_SQL + HIT_SQL + "SELECT event_id, region, array_to_string(c, ',') AS per_motif FROM wide")
def e18(spark, sf):
    return _by_motif(spark, sf, lambda hits, width: hits)


@query("e19_motif_density", SCAN_SQL + HIT_SQL + "SELECT event_id, region, string_agg(cast(cast(round(least(1.0, hits * width / cast(nt AS double)) * 1000000) AS bigint) AS varchar), ',' ORDER BY m.i) AS per_motif FROM hits JOIN (SELECT i, motif_name FROM m) m USING (motif_name) GROUP BY event_id, region")
def e19(spark, sf):
    # at least 0 and far below 2^52, where this is round() without decimals in between
    return _by_motif(spark, sf, lambda hits, width: F.floor(
        motifs.density(hits, width) * 1000000 + 0.5))


_CHR_SQL = "CASE event_id % 9 WHEN 0 THEN 'chrUn_' || cast(event_id % 3 AS varchar) WHEN 1 THEN 'CHRMT' WHEN 2 THEN substr(chr, 4) WHEN 3 THEN NULL WHEN 4 THEN 'chr01' ELSE chr END"


def _odd_names(spark, sf):
    return fx.events(spark, sf).select("event_id", "exon_start", F.expr(
        "CASE event_id % 9 WHEN 0 THEN concat('chrUn_', cast(event_id % 3 AS string)) WHEN 1 THEN 'CHRMT' "
        "WHEN 2 THEN substr(chr, 4) WHEN 3 THEN NULL WHEN 4 THEN 'chr01' ELSE chr END").alias("chr"))


_RANKS = "CASE WHEN regexp_full_match(n, '[1-9]|1[0-9]|2[0-2]') THEN cast(n AS integer) WHEN n = 'X' THEN 23 WHEN n = 'Y' THEN 24 WHEN n IN ('M', 'MT') THEN 25 ELSE {0} END"


@query("e20_chromosome_key", f", named AS (SELECT event_id, upper(regexp_replace(trim(coalesce(c, '')), '^[cC][hH][rR]', '')) AS n FROM (SELECT event_id, {_CHR_SQL} AS c FROM splice_events) x)\n"
       f"SELECT event_id, {_RANKS.format(100)} AS chr_rank, CASE WHEN {_RANKS.format(100)} = 100 THEN n ELSE '' END AS chr_name FROM named")
def e20(spark, sf):
    rank, name = go.chromosome_key(F.col("chr"))
    return _odd_names(spark, sf).select("event_id", rank.alias("chr_rank"), name.alias("chr_name"))


@query("e21_display_rank", f", named AS (SELECT event_id, upper(regexp_replace(trim(coalesce(c, '')), '^[cC][hH][rR]', '')) AS n FROM (SELECT event_id, {_CHR_SQL} AS c FROM splice_events) x)\n"
       f"SELECT event_id, CASE WHEN n = 'MT' THEN 99 ELSE {_RANKS.format(99)} END AS display_rank FROM named")
def e21(spark, sf):
    return _odd_names(spark, sf).select("event_id", go.display_rank(F.col("chr")).alias("display_rank"))


# normal and t tails by Simpson sums, as the oracle engine has no error function
SIMPSON = 400


@query("e23_normal_cdf", f""", x AS (SELECT DISTINCT inc_level_difference * 4 AS z FROM splice_events WHERE inc_level_difference IS NOT NULL),
g AS (SELECT z, unnest(range(0, {SIMPSON} + 1)) AS i FROM x)
SELECT round(z, 6) AS z, round(0.5 + sum(CASE WHEN i IN (0, {SIMPSON}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-(z * i / {SIMPSON}) * (z * i / {SIMPSON}) / 2)) * z / {SIMPSON} / 3 / sqrt(2 * pi()), 6) AS cdf FROM g GROUP BY z""")
def e23(spark, sf):
    z = fx.events(spark, sf).where("inc_level_difference IS NOT NULL").select(
        (F.col("inc_level_difference") * 4).alias("z")).distinct()
    return z.select(F.round("z", 6).alias("z"), F.round(numeric.normal_cdf("z"), 6).alias("cdf"))


@query("e24_student_t_tail", f""", x AS (SELECT DISTINCT inc_level_difference * 3 AS t, cast(3 + event_id % 40 AS double) AS df FROM splice_events WHERE inc_level_difference IS NOT NULL),
g AS (SELECT t, df, unnest(range(0, {SIMPSON} + 1)) AS i FROM x)
SELECT round(t, 6) AS t, df, round(abs(1 - 2 * sum(CASE WHEN i IN (0, {SIMPSON}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(1 + (t * i / {SIMPSON}) * (t * i / {SIMPSON}) / df, -(df + 1) / 2))
  * abs(t) / {SIMPSON} / 3 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi())), 6) AS p FROM g GROUP BY t, df""")
def e24(spark, sf):
    t = fx.events(spark, sf).where("inc_level_difference IS NOT NULL").select(
        (F.col("inc_level_difference") * 3).alias("t"),
        (3 + F.col("event_id") % 40).cast("double").alias("df")).distinct()
    return t.select(F.round("t", 6).alias("t"), "df",
                    F.round(numeric.student_t_two_sided("t", "df"), 6).alias("p"))


@query("e25_histogram_bin", """SELECT event_id, cast(least(greatest(floor((v + 1.0) / 0.05), 0), 39) AS integer) AS bin FROM (
  SELECT event_id, inc_level_difference * 1.2 + 0.0013 AS v FROM splice_events WHERE inc_level_difference IS NOT NULL) x""")
def e25(spark, sf):
    v = F.col("inc_level_difference") * 1.2 + F.lit(0.0013)
    return fx.events(spark, sf).where("inc_level_difference IS NOT NULL").select(
        "event_id", numeric.histogram_bin(v, 40, -1.0, 1.0).alias("bin"))


@query("e26_size_bucket", "SELECT event_id, least(500, (exon_size * 4) // 25 * 25) AS bucket FROM sizes")
def e26(spark, sf):
    return fx.skipped(spark, sf).select(
        "event_id", numeric.size_bucket(F.col("exon_end") * 4 - F.col("exon_start") * 4).alias("bucket"))


@query("e27_dpsi_bucket", "SELECT event_id, round(floor(inc_level_difference / cast(0.1 AS double)) * cast(0.1 AS double), 2) AS bucket FROM splice_events WHERE inc_level_difference IS NOT NULL")
def e27(spark, sf):
    return fx.events(spark, sf).where("inc_level_difference IS NOT NULL").select(
        "event_id", numeric.dpsi_bucket(F.col("inc_level_difference")).alias("bucket"))


@query("e28_binomial", """, x AS (SELECT DISTINCT cast(2 + event_id % 17 AS integer) AS n, cast(event_id % (3 + event_id % 17) AS integer) AS k FROM splice_events)
SELECT n, k, cast(factorial(n) / (factorial(k) * factorial(n - k)) AS double) AS splits FROM x WHERE k <= n""")
def e28(spark, sf):
    x = fx.events(spark, sf).selectExpr(
        "cast(2 + event_id % 17 AS int) AS n", "cast(event_id % (3 + event_id % 17) AS int) AS k"
    ).distinct().where("k <= n")
    return x.select("n", "k", numeric.binomial(F.col("n"), F.col("k")).alias("splits"))


@query("e29_site_label", """SELECT event_id, CASE WHEN event_id % 13 = 0 OR donor_is_gt IS NULL THEN '?' WHEN donor_is_gt THEN 'GT' ELSE '!GT' END || '/' ||
  CASE WHEN acceptor_is_ag IS NULL THEN '?' WHEN acceptor_is_ag THEN 'AG' ELSE '!AG' END AS site_label FROM features""")
def e29(spark, sf):
    f = ft.with_signals(_texts(spark, sf))
    donor = F.when(F.col("event_id") % 13 != 0, F.col("donor_is_gt"))
    return f.select("event_id", labels.site_label(donor, F.col("acceptor_is_ag")).alias("site_label"))


@query("e30_smaller_q", """SELECT event_id, least(fdr, q) AS min_q, coalesce(fdr < 0.05, false) OR coalesce(q < 0.05, false) AS is_significant
  FROM (SELECT *, CASE WHEN event_id % 5 <> 0 THEN p_value * 2 END AS q FROM splice_events) x""")
def e30(spark, sf):
    ev = fx.events(spark, sf).withColumn("q", F.when(F.col("event_id") % 5 != 0, F.col("p_value") * 2))
    called = F.coalesce(F.col("fdr") < 0.05, F.lit(False)) | F.coalesce(F.col("q") < 0.05, F.lit(False))
    return ev.select("event_id", labels.min_q(F.col("fdr"), F.col("q")).alias("min_q"),
                     called.alias("is_significant"))


_LABELS = "CASE event_id % 4 WHEN 0 THEN 'green' WHEN 1 THEN 'amber' WHEN 2 THEN 'red' ELSE 'unknown' END"


@query("e31_confidence_rank", f"SELECT gene_symbol, min(event_id % 4) AS best_rank, arg_min({_LABELS}, event_id % 4) AS best_label FROM splice_events GROUP BY gene_symbol")
def e31(spark, sf):
    ev = fx.events(spark, sf).select("gene_symbol", F.expr(_LABELS).alias("label"))
    rank = labels.confidence_rank(F.col("label"))
    return ev.groupBy("gene_symbol").agg(
        F.min(rank).cast("bigint").alias("best_rank"), F.min_by("label", rank).alias("best_label"))


_ALIAS_ROWS = ", ".join(f"('{u}', '{r}')" for u, r in CONTIG_ALIAS.items())


@query("a12_contig_alias", f""", alias(ucsc, refseq) AS (VALUES {_ALIAS_ROWS}),
known AS (SELECT DISTINCT CASE WHEN contig IN ('chr2', 'chrX', 'chrM') THEN refseq ELSE contig END AS contig FROM genome LEFT JOIN alias ON contig = ucsc WHERE contig <> 'chr5')
SELECT event_id, coalesce(k1.contig, k2.contig) AS contig FROM splice_events e LEFT JOIN alias ON chr = ucsc LEFT JOIN known k1 ON k1.contig = chr LEFT JOIN known k2 ON k2.contig = refseq""")
def a12(spark, sf):
    renamed = F.when(F.col("contig").isin("chr2", "chrX", "chrM"), F.try_element_at(
        literal_map(CONTIG_ALIAS), F.col("contig"))).otherwise(F.col("contig"))
    known = gn.contigs(fx.chunks(spark, sf)).where("contig <> 'chr5'").select(renamed.alias("contig"))
    ev = fx.events(spark, sf).select("event_id", "chr")
    return gn.resolved_contig(ev, known).select("event_id", "contig")


@query("a17_transcript_lookup", "SELECT event_id, transcript_id FROM splice_events LEFT JOIN tx_span USING (gene_id)")
def a17(spark, sf):
    from isoscope.sources.transcripts import transcript_of_gene

    versioned = fx.events(spark, sf).withColumn(
        "gene_id", F.concat("gene_id", F.lit("."), F.col("event_id") % 9))
    return transcript_of_gene(versioned, fx.models(spark, sf)).select("event_id", "transcript_id")


@query("a18_transcript_exons", """SELECT gene_id, transcript_id, exon_start AS "start", exon_end AS "end", exon_end - exon_start AS size,
  CASE WHEN strand = '-' THEN 10 - exon_ord ELSE exon_ord + 1 END AS exon_rank FROM transcript_exons""")
def a18(spark, sf):
    from isoscope.sources.transcripts import exon_list

    return exon_list(fx.models(spark, sf)).drop("genomic_rank", "strand")


