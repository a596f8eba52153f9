"""Registered queries: gene annotation from snapshot tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from isoscope.operators import annotation as an
from isoscope.registry import fixtures as fx
from isoscope.registry.fixtures import SIG

R = fx.Registry()
query = R.query

_SNAP = """, panels AS (SELECT CASE WHEN g % 5 = 0 THEN 1 ELSE j % 2 END AS source_rank, 'GENE' || g AS symbol, 'Panel ' || ((g + j * 7) % 4) AS panel, cast((g + j) % 5 AS varchar) AS confidence, g, j AS ord
    FROM genes CROSS JOIN (SELECT unnest(range(0, 6)) AS j) x WHERE g % 4 <> 3),
psrc AS (SELECT * FROM panels JOIN (SELECT symbol, min(source_rank) AS source_rank FROM panels GROUP BY symbol) m USING (symbol, source_rank)),
gene_panels AS (SELECT symbol, panel, cast(confidence AS integer) AS confidence_level, CASE confidence WHEN '3' THEN 'green' WHEN '2' THEN 'amber' WHEN '1' THEN 'red' ELSE 'unknown' END AS confidence_label, g
    FROM (SELECT *, row_number() OVER (PARTITION BY symbol, panel ORDER BY ord) AS rn FROM psrc) x WHERE rn = 1),
go AS (SELECT 'GENE' || g AS symbol, CASE j % 3 WHEN 0 THEN 'BP' WHEN 1 THEN 'MF' ELSE 'CC' END AS aspect, CASE WHEN (g + j) % 11 = 0 THEN '' ELSE 'GO:' || lpad(cast((g * 31 + j) % 5000 AS varchar), 7, '0') END AS go_id,
    'term ' || ((g * 31 + j) % 5000) AS term, j AS ord FROM genes CROSS JOIN (SELECT unnest(range(0, 30)) AS j) x WHERE g % 6 <> 5),
gene_go AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, aspect ORDER BY ord) AS rn FROM go) x WHERE rn <= 8 AND go_id <> ''),
gene_protein AS (SELECT 'GENE' || g AS symbol, 'P' || lpad(cast(g * 2 AS varchar), 5, '0') AS accession, 'Protein ' || g AS protein_name, 'Function ' || g AS function FROM genes WHERE g % 3 <> 0),
links AS (SELECT g, c, (g * 13 + c) % 1000 / cast(1000 AS double) AS score FROM genes CROSS JOIN (SELECT unnest([3, 50, 121]) AS c) x WHERE (g + c) % 3 <> 0 AND g <> c),
link_pairs AS (SELECT least('GENE' || g, 'GENE' || c) AS lo, greatest('GENE' || g, 'GENE' || c) AS hi, max(score) AS score FROM links GROUP BY ALL),
pair_list AS (SELECT DISTINCT least(gene_symbol, c) AS lo, greatest(gene_symbol, c) AS hi FROM (SELECT DISTINCT gene_symbol FROM splice_events) s CROSS JOIN (SELECT unnest(['GENE3', 'GENE50', 'GENE121']) AS c) x WHERE gene_symbol <> c)
"""


def _symbols(spark, sf):
    return fx.events(spark, sf).select("gene_symbol").distinct()


@query("k1_disease_panels", _SNAP + "SELECT symbol, panel, confidence_level, confidence_label, array_to_string(list_transform(range(1, 6), lambda d: 'D' || (d * (g + 1))), ',') AS disorders FROM gene_panels")
def k1(spark, sf):
    return an.panels_of_genes(fx.panels(spark, sf)).withColumn(
        "disorders", F.array_join("disorders", ","))


@query("k2_go_terms", _SNAP + "SELECT symbol, aspect, go_id, term FROM gene_go")
def k2(spark, sf):
    return an.go_of_genes(fx.go(spark, sf)).select("symbol", "aspect", "go_id", "term")


@query("k3_protein_function", _SNAP + "SELECT * FROM gene_protein")
def k3(spark, sf):
    return an.protein_of_genes(fx.proteins(spark, sf)).drop("ord")


@query("k4_pair_interactions", _SNAP + "SELECT pair_list.lo AS pair_lo, pair_list.hi AS pair_hi, l.score IS NOT NULL AS has_interaction, coalesce(round(l.score, 3), 0) AS combined_score FROM pair_list LEFT JOIN link_pairs l USING (lo, hi)")
def k4(spark, sf):
    pairs = an.candidate_pairs(_symbols(spark, sf), fx.CANDIDATES)
    found = an.interactions(pairs, fx.links(spark, sf))
    a, b = F.upper("gene_symbol"), F.upper("candidate")
    return found.select(F.least(a, b).alias("pair_lo"), F.greatest(a, b).alias("pair_hi"),
                        "has_interaction", "combined_score")


_CH = " || ".join(
    f"CASE WHEN (g * {n + 3} + c) % 4 > 0 THEN ',{name}=' || printf('%.3f', (g * {n + 3} + c) % 4 / cast(8 AS double)) ELSE '' END"
    for n, name in enumerate(["nscore", "fscore", "pscore", "ascore", "escore", "dscore", "tscore"]))


@query("k4_pair_channels", _SNAP + f"SELECT lo AS pair_lo, hi AS pair_hi, max(substr({_CH}, 2)) AS channels FROM (SELECT *, least('GENE' || g, 'GENE' || c) AS lo, greatest('GENE' || g, 'GENE' || c) AS hi FROM links WHERE g NOT IN (3, 50, 121)) x GROUP BY ALL")
def k4_channels(spark, sf):
    pairs = an.candidate_pairs(
        _symbols(spark, sf).where("gene_symbol NOT IN ('GENE3', 'GENE50', 'GENE121')"), fx.CANDIDATES)
    found = an.interactions(pairs, fx.links(spark, sf)).where("has_interaction")
    a, b = F.upper("gene_symbol"), F.upper("candidate")
    return found.select(F.least(a, b).alias("pair_lo"), F.greatest(a, b).alias("pair_hi"), "channels")


@query("f20_best_pair_score", _SNAP + "SELECT gene_symbol, max(round(score, 3)) AS pair_score FROM (SELECT DISTINCT gene_symbol FROM splice_events WHERE gene_symbol NOT IN ('GENE3', 'GENE50', 'GENE121')) s CROSS JOIN (SELECT unnest(['GENE3', 'GENE50', 'GENE121']) AS c) x LEFT JOIN link_pairs ON lo = least(gene_symbol, c) AND hi = greatest(gene_symbol, c) GROUP BY gene_symbol")
def f20(spark, sf):
    symbols = _symbols(spark, sf).where("gene_symbol NOT IN ('GENE3', 'GENE50', 'GENE121')")
    pairs = an.candidate_pairs(symbols, fx.CANDIDATES)
    return an.best_pair_score(an.interactions(pairs, fx.links(spark, sf)))


def _gene_table(spark, sf):
    return fx.genes(spark, sf).selectExpr(
        "concat('Gene', cast(g AS string)) AS symbol",
        "CASE WHEN g % 4 = 1 THEN concat('LRG_', cast(g AS string)) ELSE concat('ENSG', lpad(cast(g - g % 2 AS string), 11, '0')) END AS ensembl_id",
        "g AS ord")


@query("k5_gene_search", """, t AS (SELECT 'Gene' || g AS symbol, 'ENSG' || lpad(cast(g - g % 2 AS varchar), 11, '0') AS ensembl_id, g FROM genes WHERE g % 4 <> 1 AND starts_with('GENE' || g, 'GENE1'))
SELECT symbol, ensembl_id FROM (SELECT *, row_number() OVER (PARTITION BY ensembl_id ORDER BY g) AS rn FROM t) x WHERE rn = 1 ORDER BY g LIMIT 10""")
def k5(spark, sf):
    return an.search_genes(_gene_table(spark, sf), " gene1 ")


@query("k5_gene_lookup", "SELECT 'Gene' || g AS symbol, 'ENSG' || lpad(cast(g - g % 2 AS varchar), 11, '0') AS ensembl_id FROM genes WHERE g = 50")
def k5_lookup(spark, sf):
    return an.lookup_gene(_gene_table(spark, sf), "gene50")


@query("k6_gene_cards", _SNAP + """SELECT s.gene_symbol, coalesce(p.n, 0) AS n_panels, coalesce(q.n, 0) AS n_terms, function FROM (SELECT DISTINCT gene_symbol FROM splice_events) s
  LEFT JOIN (SELECT symbol, count(*) AS n FROM gene_panels GROUP BY symbol) p ON p.symbol = gene_symbol LEFT JOIN (SELECT symbol, count(*) AS n FROM gene_go GROUP BY symbol) q ON q.symbol = gene_symbol LEFT JOIN gene_protein f ON f.symbol = gene_symbol""")
def k6(spark, sf):
    cards = an.gene_cards(_symbols(spark, sf), fx.panels(spark, sf), fx.go(spark, sf), fx.proteins(spark, sf))
    return cards.select("gene_symbol", F.size("panels").cast("bigint").alias("n_panels"),
                        F.size("go_terms").cast("bigint").alias("n_terms"), "function")


SETS = """, sets AS (SELECT 'LIB' || (t % 3) AS library, 'TERM' || t AS term, 'GENE' || g AS gene FROM genes CROSS JOIN (SELECT unnest(range(0, 40)) AS t) x WHERE (g * (t + 3)) % 7 = t % 7)
"""
_ORA = SETS + f""", picked AS (SELECT gene_symbol AS gene, count(*) AS n FROM splice_events WHERE {SIG} GROUP BY 1 HAVING count(*) % 3 = 0),
ss AS (SELECT library, term, count(*) AS set_size FROM sets GROUP BY ALL), hh AS (SELECT library, term, count(*) AS overlap, string_agg(gene, ',' ORDER BY gene) AS gene_list FROM sets JOIN picked USING (gene) GROUP BY ALL),
tt AS (SELECT *, (SELECT count(*) FROM picked) AS n_submitted FROM hh JOIN ss USING (library, term)),
lf AS (SELECT n, lgamma(n + 1) AS f FROM (SELECT unnest(range(0, 1001)) AS n) z),
pp AS (SELECT library, term, overlap, set_size, n_submitted, gene_list, least(1.0, sum(exp(a.f - b.f - c.f + d.f - e.f - h.f - (o.f - p.f - q.f)))) AS p_value
  FROM (SELECT *, unnest(range(overlap, least(set_size, n_submitted) + 1)) AS i FROM tt) x
  JOIN lf a ON a.n = set_size JOIN lf b ON b.n = i JOIN lf c ON c.n = set_size - i JOIN lf d ON d.n = 1000 - set_size JOIN lf e ON e.n = n_submitted - i JOIN lf h ON h.n = 1000 - set_size - (n_submitted - i)
  JOIN lf o ON o.n = 1000 JOIN lf p ON p.n = n_submitted JOIN lf q ON q.n = 1000 - n_submitted GROUP BY ALL),
qq AS (SELECT *, count(*) OVER (PARTITION BY library) AS m, row_number() OVER (PARTITION BY library ORDER BY p_value, term) AS i FROM pp),
adj AS (SELECT *, least(1.0, min(p_value * m / i) OVER (PARTITION BY library ORDER BY i DESC)) AS q FROM qq)
"""


def _picked(spark, sf):
    n = fx.events(spark, sf).where(fx.significant()).groupBy("gene_symbol").agg(F.count(F.lit(1)).alias("n"))
    return n.where("n % 3 = 0").select("gene_symbol")


@query("k7_over_representation", _ORA + "SELECT library, term, overlap, set_size, n_submitted, round(p_value, 6) AS p_value, round(q, 6) AS adjusted_p_value, gene_list AS genes FROM adj")
def k7(spark, sf):
    rows = an.over_representation(_picked(spark, sf), fx.gene_set_rows(spark, sf), 1000, top=None)
    return rows.select("library", "term", "overlap", "set_size", "n_submitted", F.round("p_value", 6).alias("p_value"),
                       F.round("adjusted_p_value", 6).alias("adjusted_p_value"), "genes")


@query("i13_top_terms", _ORA + "SELECT library, count(*) AS n, round(max(q), 6) AS worst_q FROM (SELECT *, row_number() OVER (PARTITION BY library ORDER BY q, p_value, term) AS rn FROM adj) x WHERE rn <= 10 GROUP BY library")
def i13(spark, sf):
    rows = an.over_representation(_picked(spark, sf), fx.gene_set_rows(spark, sf), 1000)
    return rows.groupBy("library").agg(F.count(F.lit(1)).alias("n"),
                                       F.round(F.max("adjusted_p_value"), 6).alias("worst_q"))


_CONF = "CASE confidence_label WHEN 'green' THEN 0 WHEN 'amber' THEN 1 WHEN 'red' THEN 2 ELSE 3 END"
ANNOT = _SNAP + f""", ptop AS (SELECT symbol, max(confidence_label) FILTER (WHERE rn = 1) AS panel_confidence, string_agg(panel, ', ' ORDER BY rn) AS panel_names
    FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY {_CONF}, panel) AS rn FROM gene_panels) x WHERE rn <= 3 GROUP BY symbol),
gtop AS (SELECT symbol, coalesce(string_agg(term, '; ' ORDER BY ord) FILTER (WHERE aspect = 'BP'), '') AS go_bp, coalesce(string_agg(term, '; ' ORDER BY ord) FILTER (WHERE aspect = 'MF'), '') AS go_mf,
    coalesce(string_agg(term, '; ' ORDER BY ord) FILTER (WHERE aspect = 'CC'), '') AS go_cc FROM (SELECT *, row_number() OVER (PARTITION BY symbol, aspect ORDER BY ord) AS r2 FROM gene_go) x WHERE r2 <= 3 GROUP BY symbol)
"""


@query("i14_panel_summary", ANNOT + "SELECT * FROM ptop")
def i14_panels(spark, sf):
    return an.panel_summary(fx.panels(spark, sf))


@query("i14_go_summary", ANNOT + "SELECT * FROM gtop")
def i14_go(spark, sf):
    return an.go_summary(fx.go(spark, sf))


@query("d16_annotated_symbols", ANNOT + "SELECT gene_symbol, coalesce(panel_names, '') AS panel_names, coalesce(go_bp, '') AS go_bp FROM (SELECT DISTINCT gene_symbol FROM splice_events) s LEFT JOIN ptop ON ptop.symbol = gene_symbol LEFT JOIN gtop ON gtop.symbol = gene_symbol")
def d16(spark, sf):
    out = _symbols(spark, sf)
    for table in (an.panel_summary(fx.panels(spark, sf)), an.go_summary(fx.go(spark, sf))):
        out = out.join(table, F.upper("gene_symbol") == F.col("symbol"), "left").drop("symbol")
    return out.na.fill("", ["panel_names", "go_bp"]).select("gene_symbol", "panel_names", "go_bp")
