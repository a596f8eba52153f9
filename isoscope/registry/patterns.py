"""Registered queries: aggregates over events and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from isoscope.operators import patterns as pt
from isoscope.operators import ranking
from isoscope.registry import fixtures as fx
from isoscope.registry.fixtures import SIG

R = fx.Registry()
query = R.query

_TYPES = "(VALUES ('SE'), ('RI'), ('A3SS'), ('A5SS'), ('MXE')) t(event_type)"
_SITES = (("donor", 9, "substr(donor_seq, 1, 9)"), ("acceptor", 23, "right(acceptor_seq, 23)"),
          ("upstream_donor", 9, "substr(upstream_donor_seq, 1, 9)"),
          ("downstream_acceptor", 23, "right(downstream_acceptor_seq, 23)"))
_FLAG = {"donor": "donor_is_gt", "acceptor": "acceptor_is_ag",
         "upstream_donor": "upstream_donor_is_gt", "downstream_acceptor": "downstream_acceptor_is_ag"}
SITE_SQL = ", site_rows AS (" + " UNION ALL ".join(
    f"SELECT event_id, sig, '{s}' AS site, {cut} AS seq, {_FLAG[s]} AS flag FROM joined WHERE donor_seq IS NOT NULL AND length({s}_seq) >= {w}"
    for s, w, cut in _SITES) + ")\n"
_LETTERS = """, letters AS (SELECT {keys} i - 1 AS pos, substr(seq, i, 1) AS base FROM (SELECT {keys} seq, unnest(range(1, length(seq) + 1)) AS i FROM site_rows) x),
base_counts AS (SELECT {keys} pos, count(*) FILTER (WHERE base = 'A') AS a, count(*) FILTER (WHERE base = 'C') AS c,
  count(*) FILTER (WHERE base = 'G') AS g, count(*) FILTER (WHERE base = 'T') AS t, count(*) AS n FROM letters GROUP BY ALL)
"""
_CODE = """CASE CASE WHEN a * 1.0 / n >= 0.4 THEN 'A' ELSE '' END || CASE WHEN c * 1.0 / n >= 0.4 THEN 'C' ELSE '' END || CASE WHEN g * 1.0 / n >= 0.4 THEN 'G' ELSE '' END || CASE WHEN t * 1.0 / n >= 0.4 THEN 'T' ELSE '' END
  WHEN 'A' THEN 'A' WHEN 'C' THEN 'C' WHEN 'G' THEN 'G' WHEN 'T' THEN 'T' WHEN 'AG' THEN 'R' WHEN 'CT' THEN 'Y' WHEN 'AC' THEN 'M' WHEN 'GT' THEN 'K' WHEN 'CG' THEN 'S' WHEN 'AT' THEN 'W' ELSE 'N' END"""


@query("f1_type_counts", f"SELECT t.event_type, count(e.event_id) AS n_events, round(count(e.event_id) / cast(greatest((SELECT count(*) FROM splice_events WHERE event_type <> 'MXE'), 1) AS double) * 100, 1) AS pct_of_total FROM {_TYPES} LEFT JOIN (SELECT * FROM splice_events WHERE event_type <> 'MXE') e USING (event_type) GROUP BY t.event_type")
def f1(spark, sf):
    return pt.type_counts(fx.events(spark, sf).where("event_type <> 'MXE'"))


_STATS = "round(avg({0}), 1) AS {0}_mean, round(median({0}), 1) AS {0}_median"


@query("f2_f4_size_summary", f"SELECT {_STATS.format('exon_size')}, min(exon_size) AS exon_size_min, max(exon_size) AS exon_size_max, {_STATS.format('upstream_intron_size')}, {_STATS.format('downstream_intron_size')} FROM sizes")
def f2(spark, sf):
    return pt.size_summary(_sizes(spark, sf))


def _sizes(spark, sf):
    from isoscope.functions.coordinates import exon_size, intron_sizes

    up, down = intron_sizes()
    return fx.skipped(spark, sf).select(
        "event_id", exon_size().alias("exon_size"), up.alias("upstream_intron_size"),
        down.alias("downstream_intron_size"))


@query("f3_size_distribution", "SELECT least(500, exon_size // 25 * 25) AS bin, count(*) AS n FROM sizes GROUP BY 1")
def f3(spark, sf):
    return pt.size_distribution(_sizes(spark, sf))


@query("f5_effect_means", f"SELECT round(avg(inc_level_difference), 3) AS mean_delta_psi, round(avg(inc_level_difference) FILTER (WHERE {SIG}), 3) AS mean_delta_psi_significant FROM se")
def f5(spark, sf):
    return pt.effect_means(fx.skipped(spark, sf), fx.significant())


_F6 = ", ".join(
    f"count(*) FILTER (WHERE site = '{s}') AS {s}_n, count(flag) FILTER (WHERE site = '{s}') AS {s}_known, count(*) FILTER (WHERE site = '{s}' AND flag) AS {s}_canonical"
    for s, _, _ in _SITES)


@query("f6_canonical_counts", SITE_SQL + f"SELECT {_F6} FROM site_rows")
def f6(spark, sf):
    return fx.joined(spark, sf).agg(*pt.canonical_counts())


@query("f6_known_flag_counts", "SELECT " + ", ".join(
    f"count({f}) AS {s}_known, count(*) FILTER (WHERE {f}) AS {s}_canonical" for s, f in _FLAG.items()) + " FROM joined")
def f6_known(spark, sf):
    return fx.joined(spark, sf).agg(*pt.known_flag_counts())


@query("f7_site_statistics", SITE_SQL + _LETTERS.format(keys="site,") + f""", cons AS (SELECT site, string_agg(code, '' ORDER BY pos) AS consensus FROM (SELECT site, pos, {_CODE} AS code FROM base_counts) x GROUP BY site),
shown AS (SELECT site, string_agg(seq, ',' ORDER BY event_id) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY event_id) AS rn FROM site_rows) y WHERE rn <= 8 GROUP BY site)
SELECT site, count(*) AS n_sequences, count(*) FILTER (WHERE flag) AS n_canonical, round(count(*) FILTER (WHERE flag) / cast(count(flag) AS double) * 100, 1) AS pct_canonical, any_value(consensus) AS consensus, any_value(examples) AS examples
FROM site_rows JOIN cons USING (site) JOIN shown USING (site) GROUP BY site""")
def f7(spark, sf):
    return pt.site_statistics(fx.joined(spark, sf))


@query("f8_tract_summary", "SELECT round(avg(ppt_score), 3) AS ppt_mean_score, round(avg(ppt_longest_run), 1) AS ppt_mean_longest_run FROM joined WHERE donor_seq IS NOT NULL")
def f8(spark, sf):
    return fx.joined(spark, sf).agg(*pt.ppt_columns())


@query("f8_first_tract_scores", "SELECT event_id, ppt_score FROM joined WHERE donor_seq IS NOT NULL AND ppt_score IS NOT NULL ORDER BY event_id LIMIT 100")
def f8_first(spark, sf):
    return pt.first_ppt_scores(fx.joined(spark, sf))


_KNOWN_FRAMES = ", ".join(f"count(*) FILTER (WHERE coalesce(frame_class, 'unknown') = '{k}') AS frame_{k}"
                          for k in ("in_frame", "frameshift", "non_coding"))
_FRAMES = _KNOWN_FRAMES + ", count(*) FILTER (WHERE coalesce(frame_class, 'unknown') = 'unknown') AS frame_unknown"
_BP = "round(count(*) FILTER (WHERE bp_motif_found AND ppt_seq IS NOT NULL) / cast(count(ppt_seq) AS double) * 100, 1) AS bp_found_pct"


@query("f9_frames_and_branch_points", f"SELECT {_FRAMES}, {_BP} FROM joined")
def f9(spark, sf):
    return fx.joined(spark, sf).agg(*pt.frame_columns(F.col("has_features")), pt.branch_point_pct())


@query("f10_position_weights", SITE_SQL + _LETTERS.format(keys="site,") + "SELECT site, pos, round(a / cast(a + c + g + t AS double), 4) AS A_, round(c / cast(a + c + g + t AS double), 4) AS C_, round(g / cast(a + c + g + t AS double), 4) AS G_, round(t / cast(a + c + g + t AS double), 4) AS T_ FROM base_counts")
def f10(spark, sf):
    w = pt.position_weights(pt.base_counts(pt.site_sequences(fx.joined(spark, sf), []), ["site"]))
    return w.withColumnsRenamed({b: f"{b}_" for b in "ACGT"})


@query("f11_consensus", SITE_SQL + _LETTERS.format(keys="site, sig,") + f"SELECT site, sig AS is_significant, string_agg(code, '' ORDER BY pos) AS consensus FROM (SELECT site, sig, pos, {_CODE} AS code FROM base_counts) x GROUP BY ALL")
def f11(spark, sf):
    return pt.group_consensus(fx.joined(spark, sf))


@query("f12_information_content", SITE_SQL + _LETTERS.format(keys="site,") + """, w AS (SELECT site, pos, n, unnest([round(a / cast(n AS double), 4), round(c / cast(n AS double), 4), round(g / cast(n AS double), 4), round(t / cast(n AS double), 4)]) AS p FROM base_counts)
SELECT site, pos, round(greatest(0, 2 - sum(CASE WHEN p > 0 THEN -p * log2(p) ELSE 0 END) - 3 / (2 * ln(2) * any_value(n))), 6) AS bits FROM w GROUP BY site, pos""")
def f12(spark, sf):
    seqs = pt.site_sequences(fx.joined(spark, sf), [])
    sizes = seqs.groupBy("site").agg(F.count(F.lit(1)).alias("n_seq"))
    weights = pt.position_weights(pt.base_counts(seqs, ["site"]))
    bits = pt.information_content(weights, sizes, ["site"])
    return bits.select("site", "pos", F.round("bits", 6).alias("bits"))


_PCT = "round(count(*) FILTER (WHERE {1} AND length({0}_seq) >= {2} AND donor_seq IS NOT NULL) / cast(count({1}) FILTER (WHERE length({0}_seq) >= {2} AND donor_seq IS NOT NULL) AS double) * 100, 1) AS {3}"
_CONTENT = "round(avg(length(regexp_replace(ppt_seq, '[^{0}]', '', 'g')) / cast(length(ppt_seq) AS double)) FILTER (WHERE donor_seq IS NOT NULL), 3) AS ppt_mean_{1}_content"
GROUP_SQL = f"""count(*) AS n_events, count(*) AS n_se_with_features, {_STATS.format('exon_size')},
  round(avg(ppt_score) FILTER (WHERE donor_seq IS NOT NULL), 3) AS ppt_mean_score, {_CONTENT.format('T', 't')}, {_CONTENT.format('C', 'c')},
  {_KNOWN_FRAMES}, {_BP}, round(avg(inc_level_difference), 3) AS mean_delta_psi, {_STATS.format('upstream_intron_size')}, {_STATS.format('downstream_intron_size')},
  {_PCT.format('donor', 'donor_is_gt', 9, 'pct_canonical_gt')}, {_PCT.format('acceptor', 'acceptor_is_ag', 23, 'pct_canonical_ag')},
  {_PCT.format('upstream_donor', 'upstream_donor_is_gt', 9, 'pct_upstream_gt')}, {_PCT.format('downstream_acceptor', 'downstream_acceptor_is_ag', 23, 'pct_downstream_ag')}"""


@query("f13_group_statistics", f"SELECT sig AS is_significant, {GROUP_SQL} FROM joined GROUP BY sig")
def f13(spark, sf):
    return pt.group_statistics(fx.joined(spark, sf))


@query("f13_group_matrices", SITE_SQL + _LETTERS.format(keys="site, sig,") + "SELECT site, sig AS is_significant, pos, round(a / cast(a + c + g + t AS double), 4) AS A_, round(c / cast(a + c + g + t AS double), 4) AS C_, round(g / cast(a + c + g + t AS double), 4) AS G_, round(t / cast(a + c + g + t AS double), 4) AS T_ FROM base_counts")
def f13_matrices(spark, sf):
    return pt.group_matrices(fx.joined(spark, sf)).withColumnsRenamed({b: f"{b}_" for b in "ACGT"})


_GUARDED = ", ".join(
    f"count(*) FILTER (WHERE donor_seq IS NOT NULL AND length({s}_seq) >= {w}) AS {s}_n, count({_FLAG[s]}) FILTER (WHERE donor_seq IS NOT NULL AND length({s}_seq) >= {w}) AS {s}_known, "
    f"count(*) FILTER (WHERE donor_seq IS NOT NULL AND length({s}_seq) >= {w} AND {_FLAG[s]}) AS {s}_canonical" for s, w, _ in _SITES)


@query("f14_pattern_report", f"""SELECT count(*) AS n_se_events, count(donor_seq) AS n_analyzed, count(*) FILTER (WHERE sig) AS n_significant, count(*) FILTER (WHERE NOT sig) AS n_not_significant,
  {_STATS.format('exon_size')}, min(exon_size) AS exon_size_min, max(exon_size) AS exon_size_max, {_STATS.format('upstream_intron_size')}, {_STATS.format('downstream_intron_size')},
  round(avg(inc_level_difference), 3) AS mean_delta_psi, round(avg(inc_level_difference) FILTER (WHERE sig), 3) AS mean_delta_psi_significant, {_GUARDED},
  round(avg(ppt_score) FILTER (WHERE donor_seq IS NOT NULL), 3) AS ppt_mean_score, round(avg(ppt_longest_run) FILTER (WHERE donor_seq IS NOT NULL), 1) AS ppt_mean_longest_run, {_FRAMES}, {_BP}, count(donor_seq) > 0 AS fasta_available FROM joined""")
def f14(spark, sf):
    return pt.pattern_report(fx.joined(spark, sf), F.col("is_significant"))


@query("f16_report_summary", """SELECT (SELECT count(*) FROM splice_events) AS n_events, count(*) AS n_se, count(donor_seq) AS n_with_sequence,
  count(donor_is_gt) AS n_gt_known, count(*) FILTER (WHERE donor_is_gt) AS n_gt, count(acceptor_is_ag) AS n_ag_known, count(*) FILTER (WHERE acceptor_is_ag) AS n_ag,
  round(count(*) FILTER (WHERE donor_is_gt) / cast(count(donor_is_gt) AS double) * 100, 1) AS pct_gt, round(count(*) FILTER (WHERE acceptor_is_ag) / cast(count(acceptor_is_ag) AS double) * 100, 1) AS pct_ag FROM joined""")
def f16(spark, sf):
    return pt.report_summary(fx.events(spark, sf), fx.features(spark, sf))


@query("f17_report_feature_table", """SELECT count(*) AS n_features, count(*) FILTER (WHERE donor_is_gt) AS n_gt, count(donor_is_gt) AS n_gt_known, count(*) FILTER (WHERE acceptor_is_ag) AS n_ag, count(acceptor_is_ag) AS n_ag_known,
  count(*) FILTER (WHERE upstream_donor_is_gt) AS n_upstream_gt, count(upstream_donor_is_gt) FILTER (WHERE length(upstream_donor_seq) >= 9) AS n_upstream_known,
  count(*) FILTER (WHERE downstream_acceptor_is_ag) AS n_downstream_ag, count(downstream_acceptor_is_ag) FILTER (WHERE length(downstream_acceptor_seq) >= 23) AS n_downstream_known,
  count(*) FILTER (WHERE frame_class = 'in_frame') AS n_in_frame, count(*) FILTER (WHERE frame_class = 'frameshift') AS n_frameshift, count(*) FILTER (WHERE frame_class = 'non_coding') AS n_non_coding,
  count(*) FILTER (WHERE frame_class = 'unknown') AS n_frame_unknown, count(*) FILTER (WHERE bp_motif_found) AS n_branch_point, count(ppt_seq) AS n_with_ppt,
  round(avg(exon_size), 0) AS exon_size_mean, round(median(exon_size), 0) AS exon_size_median, round(avg(ppt_score) * 100, 1) AS ppt_pct,
  round(avg(length(regexp_replace(ppt_seq, '[^T]', '', 'g')) / cast(length(ppt_seq) AS double)) * 100, 1) AS ppt_t_pct, round(avg(length(regexp_replace(ppt_seq, '[^C]', '', 'g')) / cast(length(ppt_seq) AS double)) * 100, 1) AS ppt_c_pct FROM features""")
def f17(spark, sf):
    return pt.report_feature_table(fx.features(spark, sf))


@query("f18_dpsi_histogram", "SELECT round(floor(inc_level_difference / cast(0.1 AS double)) * cast(0.1 AS double), 2) AS bin, count(*) AS n FROM splice_events WHERE inc_level_difference IS NOT NULL GROUP BY 1")
def f18(spark, sf):
    return pt.dpsi_histogram(fx.events(spark, sf))


@query("f18_size_histogram", """, m AS (SELECT cast(least(ceil(max(exon_size) / 25.0) + 1, 40) AS bigint) AS n_bins FROM sizes),
h AS (SELECT least(exon_size // 25, n_bins - 1) AS bin, count(*) AS n FROM sizes CROSS JOIN m GROUP BY 1)
SELECT b.bin, coalesce(h.n, 0) AS n FROM (SELECT unnest(range(0, (SELECT n_bins FROM m))) AS bin) b LEFT JOIN h USING (bin)""")
def f18_sizes(spark, sf):
    return pt.report_size_histogram(_sizes(spark, sf))


@query("f19_significant_symbols", f"SELECT DISTINCT gene_symbol FROM splice_events WHERE {SIG} AND trim(gene_symbol) <> ''")
def f19(spark, sf):
    return pt.significant_symbols(fx.events(spark, sf), fx.significant())


@query("f21_gene_markers", """, c AS (SELECT upper(gene_symbol) AS symbol, substr(chr, 4) AS chrom, exon_start AS pos FROM splice_events WHERE upper(gene_symbol) IN ('GENE3', 'GENE50', 'GENE121')),
n AS (SELECT symbol, chrom, count(*) AS n_events FROM c GROUP BY ALL), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY n_events DESC, chrom) AS rn FROM n) x WHERE rn = 1)
SELECT symbol, chrom, n_events, pos AS position FROM (SELECT c.*, n_events, row_number() OVER (PARTITION BY c.symbol, c.chrom ORDER BY pos) - 1 AS i FROM c JOIN b ON c.symbol = b.symbol AND c.chrom = b.chrom) y WHERE i = n_events // 2""")
def f21(spark, sf):
    return ranking.gene_markers(fx.events(spark, sf), fx.CANDIDATES)


@query("j4_significant_and_complement", f"SELECT {SIG} AS is_significant, event_type, count(*) AS n FROM splice_events GROUP BY ALL")
def j4(spark, sf):
    ev = fx.events(spark, sf)
    side = lambda flag, rows: rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(flag).alias("is_significant"), "event_type", "n")
    return side(True, ev.where(fx.significant())).unionByName(side(False, ev.where(~fx.significant())))
