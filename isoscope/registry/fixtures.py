"""Splicing tables derived from the given star-schema tables.

Events, genome and transcripts are deterministic projections of `orders`; the same
text serves Spark and the oracle, up to the spelling of row generation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoscope.operators import features as ft
from isoscope.operators.significance import is_significant, tag_events
from isoscope.plans.lineage import scratch_path, still_there
from isoscope.sources import genome as gn
from isoscope.sources.transcripts import from_exon_rows

FDR, EFFECT, P_MAX = 0.05, 0.1, 0.02
DEEP = "deep-1"
CHUNK_NT = 32

_KEYS = """o_orderkey AS k, o_custkey % 200 AS g,
    CASE o_orderkey % 10 WHEN 0 THEN 'RI' WHEN 1 THEN 'MXE' WHEN 2 THEN 'A3SS' WHEN 3 THEN 'A5SS' ELSE 'SE' END AS event_type,
    2000 + (o_orderkey * 7919) % 16000 AS es,
    2000 + (o_orderkey * 7919) % 16000 + 30 + (o_orderkey * 31) % 200 AS ee"""

_EVENT_COLUMNS = """k AS event_id, event_type,
  concat('ENSG', lpad(cast(g AS string), 11, '0')) AS gene_id,
  concat('GENE', cast(g AS string)) AS gene_symbol,
  concat('chr', CASE g % 25 WHEN 22 THEN 'X' WHEN 23 THEN 'Y' WHEN 24 THEN 'M' ELSE cast(g % 25 + 1 AS string) END) AS chr,
  CASE WHEN g % 2 = 0 THEN '+' ELSE '-' END AS strand,
  es AS exon_start, ee AS exon_end,
  es - 60 - (k * 17) % 700 - 50 - (k * 13) % 300 AS upstream_es,
  es - 60 - (k * 17) % 700 AS upstream_ee,
  CASE WHEN k % 89 = 0 THEN NULL ELSE ee + 20 + (k * 23) % 700 END AS downstream_es,
  CASE WHEN k % 89 = 0 THEN NULL ELSE ee + 20 + (k * 23) % 700 + 50 + (k * 19) % 300 END AS downstream_ee,
  CASE WHEN event_type = 'MXE' THEN ee + 10 + (k * 3) % 60 END AS second_exon_start,
  CASE WHEN event_type = 'MXE' THEN ee + 80 + (k * 3) % 60 END AS second_exon_end,
  CASE WHEN event_type IN ('A3SS', 'A5SS') THEN es END AS long_exon_start,
  CASE WHEN event_type IN ('A3SS', 'A5SS') THEN ee END AS long_exon_end,
  CASE WHEN event_type IN ('A3SS', 'A5SS') THEN es + 3 + k % 9 END AS short_es,
  CASE WHEN event_type IN ('A3SS', 'A5SS') THEN ee END AS short_ee,
  CASE WHEN event_type IN ('A3SS', 'A5SS') THEN es - 500 END AS flanking_es,
  CASE WHEN event_type IN ('A3SS', 'A5SS') THEN es - 400 END AS flanking_ee,
  CASE WHEN k % 103 = 0 THEN 'NA,NA,NA' ELSE concat(cast(k % 40 AS string), ',', cast((k * 3) % 40 AS string), ',', CASE WHEN k % 97 = 0 THEN 'NA' ELSE cast((k * 7) % 40 AS string) END) END AS ijc_sample_1,
  concat(cast((k * 5) % 30 AS string), ',', cast((k * 11) % 30 AS string), ',', cast((k * 13) % 30 AS string)) AS sjc_sample_1,
  concat(cast((k * 9) % 40 AS string), ',', cast((k * 21) % 40 AS string), ',', cast((k * 27) % 40 AS string)) AS ijc_sample_2,
  concat(cast((k * 17) % 30 AS string), ',', cast((k * 19) % 30 AS string), CASE WHEN k % 101 = 0 THEN '' ELSE concat(',', cast((k * 23) % 30 AS string)) END) AS sjc_sample_2,
  CASE WHEN k % 83 = 0 THEN NULL ELSE cast((k * 7907) % 1000 AS double) / 10000 END AS fdr,
  cast((k * 7907) % 1000 AS double) / 25000 AS p_value,
  concat('0.', lpad(cast((k * 101) % 1000 AS string), 3, '0'), ',0.', lpad(cast((k * 131) % 1000 AS string), 3, '0'), ',', CASE WHEN k % 97 = 0 THEN 'NA' ELSE concat('0.', lpad(cast((k * 211) % 1000 AS string), 3, '0')) END) AS inc_level_1,
  concat('0.', lpad(cast((k * 307) % 1000 AS string), 3, '0'), ',0.', lpad(cast((k * 401) % 1000 AS string), 3, '0'), ',0.', lpad(cast((k * 503) % 1000 AS string), 3, '0')) AS inc_level_2,
  CASE WHEN k % 79 = 0 THEN NULL ELSE cast((k * 617) % 1801 - 900 AS double) / 1000 END AS inc_level_difference,
  CASE WHEN k % 2 = 0 THEN 'JC' ELSE 'JCEC' END AS counting_mode"""

_CHUNK_COLUMNS = """concat('chr', CASE c WHEN 23 THEN 'X' WHEN 24 THEN 'Y' WHEN 25 THEN 'M' ELSE cast(c AS string) END) AS contig, i AS chunk_id,
  translate(md5(concat(cast(c AS string), ':', cast(i AS string))), '0123456789abcdef', 'ACGTACGTACGTACGT') AS seq"""

_TRANSCRIPT_COLUMNS = """concat('ENSG', lpad(cast(g AS string), 11, '0')) AS gene_id, concat('ENST', lpad(cast(g AS string), 11, '0')) AS transcript_id,
  concat('chr', CASE g % 25 WHEN 22 THEN 'X' WHEN 23 THEN 'Y' WHEN 24 THEN 'M' ELSE cast(g % 25 + 1 AS string) END) AS chr,
  CASE WHEN g % 2 = 0 THEN '+' ELSE '-' END AS strand, x AS exon_ord,
  2000 + x * 1600 + (g * 37) % 300 AS exon_start,
  2000 + x * 1600 + (g * 37) % 300 + 60 + (g * 11 + x * 29) % 180 AS exon_end,
  CASE WHEN g % 10 = 9 THEN NULL ELSE 3600 + (g * 37) % 300 + 30 END AS cds_start,
  CASE WHEN g % 10 = 9 THEN NULL ELSE 14800 + (g * 37) % 300 + 20 END AS cds_end"""


def _split(select: str) -> list[str]:
    """Top-level commas of a select list, for selectExpr."""
    out, depth, quoted, start = [], 0, False, 0
    for i, ch in enumerate(select):
        if ch == "'":
            quoted = not quoted
        elif not quoted and ch in "()":
            depth += 1 if ch == "(" else -1
        elif not quoted and depth == 0 and ch == ",":
            out.append(select[start:i])
            start = i + 1
    return [*out, select[start:]]


def orders(spark: SparkSession, sf: str) -> DataFrame:
    """The given table is a single input split, from which all events are derived: two
    narrow columns are dealt to all cores first."""
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey").repartition(
        spark.sparkContext.defaultParallelism, "o_orderkey")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return orders(spark, sf).selectExpr(*_split(_KEYS)).selectExpr(*_split(_EVENT_COLUMNS))


def skipped(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).where("event_type = 'SE'")


def genes(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct gene numbers of the data."""
    return orders(spark, sf).selectExpr("o_custkey % 200 AS g").distinct()


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    contig = genes(spark, sf).selectExpr("g % 25 + 1 AS c").distinct()
    return contig.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(639)))).selectExpr(
        *_split(_CHUNK_COLUMNS))


_genomes: dict[tuple[str, str], tuple[str, gn.Genome]] = {}


def genome(spark: SparkSession, sf: str) -> gn.Genome:
    """The stored genome, converted once a session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _genomes or not still_there(spark, _genomes[key][0]):
        path = scratch_path(spark, "genome")
        wide = gn.padded(chunks(spark, sf), CHUNK_NT, 1024, 256)
        _genomes[key] = path, gn.store_genome(wide, f"isoscope_genome_{path[-32:]}", path)
    return _genomes[key][1]


def transcript_exons(spark: SparkSession, sf: str) -> DataFrame:
    return (
        genes(spark, sf).where("g % 20 <> 19")
        .withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(9))))
        .selectExpr(*_split(_TRANSCRIPT_COLUMNS))
    )


def models(spark: SparkSession, sf: str) -> DataFrame:
    return from_exon_rows(transcript_exons(spark, sf))


def features(spark: SparkSession, sf: str) -> DataFrame:
    return ft.compute_features(events(spark, sf), models(spark, sf), genome(spark, sf))


def significant():
    return is_significant(FDR, EFFECT)


def tags(spark: SparkSession, sf: str) -> DataFrame:
    return tag_events(events(spark, sf), DEEP, FDR, EFFECT)


def joined(spark: SparkSession, sf: str) -> DataFrame:
    """Skipped-exon events with features and tag."""
    return ft.events_with_features(events(spark, sf), features(spark, sf)).withColumn(
        "is_significant", significant())


def gene_set_rows(spark: SparkSession, sf: str) -> DataFrame:
    return (
        genes(spark, sf).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(39))))
        .where("(g * (t + 3)) % 7 = t % 7")
        .selectExpr("concat('LIB', cast(t % 3 AS string)) AS library",
                    "concat('TERM', cast(t AS string)) AS term",
                    "concat('GENE', cast(g AS string)) AS gene")
    )


CANDIDATES = ["GENE3", "gene50", "GENE121"]


def panels(spark: SparkSession, sf: str) -> DataFrame:
    return (
        genes(spark, sf).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(5))))
        .where("g % 4 <> 3")
        .selectExpr(
            "CASE WHEN g % 5 = 0 THEN 1 ELSE j % 2 END AS source_rank",
            "concat('GENE', cast(g AS string)) AS symbol",
            "concat('Panel ', cast((g + j * 7) % 4 AS string)) AS panel",
            "cast((g + j) % 5 AS string) AS confidence",
            "transform(sequence(1, 7), d -> concat('D', cast(d * (g + 1) AS string))) AS disorders",
            "j AS ord")
    )


def go(spark: SparkSession, sf: str) -> DataFrame:
    return (
        genes(spark, sf).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(29))))
        .where("g % 6 <> 5")
        .selectExpr(
            "concat('GENE', cast(g AS string)) AS symbol",
            "CASE j % 3 WHEN 0 THEN 'BP' WHEN 1 THEN 'MF' ELSE 'CC' END AS aspect",
            "CASE WHEN (g + j) % 11 = 0 THEN '' ELSE concat('GO:', lpad(cast((g * 31 + j) % 5000 AS string), 7, '0')) END AS go_id",
            "concat('term ', cast((g * 31 + j) % 5000 AS string)) AS term",
            "'IEA' AS evidence", "j AS ord")
    )


def proteins(spark: SparkSession, sf: str) -> DataFrame:
    return (
        genes(spark, sf).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(1))))
        .selectExpr(
            "concat('GENE', cast(g AS string)) AS symbol",
            "concat('P', lpad(cast(g * 2 + j AS string), 5, '0')) AS accession",
            "concat('Protein ', cast(g AS string)) AS protein_name",
            "CASE WHEN (g + j) % 3 = 0 THEN NULL ELSE concat('Function ', cast(g AS string)) END AS function",
            "j AS ord")
    )


def links(spark: SparkSession, sf: str) -> DataFrame:
    return (
        genes(spark, sf).withColumn("c", F.explode(F.array(F.lit(3), F.lit(50), F.lit(121))))
        .where("(g + c) % 3 <> 0 AND g <> c")
        .selectExpr(
            "CASE WHEN g % 2 = 0 THEN concat('GENE', cast(g AS string)) ELSE concat('GENE', cast(c AS string)) END AS symbol_a",
            "CASE WHEN g % 2 = 0 THEN concat('Gene', cast(c AS string)) ELSE concat('GENE', cast(g AS string)) END AS symbol_b",
            *[f"cast((g * {n + 3} + c) % 4 AS double) / 8 AS {name}" for n, name in enumerate(
                ["nscore", "fscore", "pscore", "ascore", "escore", "dscore", "tscore"])],
            "cast((g * 13 + c) % 1000 AS double) / 1000 AS score")
    )


# -- oracle text -------------------------------------------------------------------
_SIG = f"coalesce(fdr <= {FDR} AND abs(inc_level_difference) >= {EFFECT}, false)"


def _duck_json_structs() -> str:
    cases = {
        "donor": ("e - 3", "e + 6", "s - 6", "s + 3"),
        "acceptor": ("s - 20", "s + 3", "e - 3", "e + 20"),
        "ppt": ("s - 50", "s - 3", "e + 3", "e + 50"),
        "upstream_donor": ("u - 3", "u + 6", "d - 6", "d + 3"),
        "downstream_acceptor": ("d - 20", "d + 3", "u - 3", "u + 20"),
    }
    return ", ".join(
        f"{{'slot': '{n}', 'a': CASE WHEN strand = '+' THEN {a} ELSE {c} END, "
        f"'b': CASE WHEN strand = '+' THEN {b} ELSE {d} END}}"
        for n, (a, b, c, d) in cases.items()
    )


PREFIX = f"""WITH splice_events AS (SELECT {_EVENT_COLUMNS} FROM (SELECT {_KEYS} FROM orders) o),
genes AS (SELECT DISTINCT o_custkey % 200 AS g FROM orders),
genome AS (SELECT {_CHUNK_COLUMNS} FROM (SELECT DISTINCT g % 25 + 1 AS c FROM genes) b CROSS JOIN (SELECT unnest(range(0, 640)) AS i) a),
contig_text AS (SELECT contig, string_agg(seq, '' ORDER BY chunk_id) AS t FROM genome GROUP BY contig),
transcript_exons AS (SELECT {_TRANSCRIPT_COLUMNS} FROM genes CROSS JOIN (SELECT unnest(range(0, 10)) AS x) b WHERE g % 20 <> 19),
se AS (SELECT *, {_SIG} AS sig FROM splice_events WHERE event_type = 'SE'),
ov AS (SELECT e.event_id, t.exon_ord, t.exon_start AS ts, t.exon_end AS te, t.strand AS tstrand,
         greatest(0, least(e.exon_end, t.exon_end) - greatest(e.exon_start, t.exon_start)) AS o,
         e.exon_start AS s0, e.exon_end AS e0, e.upstream_ee AS u, e.downstream_es AS d
       FROM se e JOIN transcript_exons t USING (gene_id)),
best_ov AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY o DESC, ts) AS rn FROM ov) x WHERE rn = 1 AND o > 0),
by_flank AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY abs((te - ts) - (e0 - s0)), ts) AS rn FROM ov WHERE ts >= u AND te <= d) x WHERE rn = 1),
fixed AS (SELECT se.event_id,
    CASE WHEN b.ok THEN b.ts ELSE f.ts END AS ms, CASE WHEN b.ok THEN b.te ELSE f.te END AS me,
    CASE WHEN b.ok THEN 'overlap' WHEN f.event_id IS NOT NULL THEN 'flanking' END AS msource
  FROM se LEFT JOIN (SELECT *, (o * 2 >= e0 - s0 AND o * 2 >= te - ts) AS ok FROM best_ov) b USING (event_id)
  LEFT JOIN by_flank f USING (event_id)),
win AS (SELECT event_id, chr, strand, unnest([{_duck_json_structs()}]) AS w FROM (
    SELECT se.event_id, chr, strand, coalesce(ms, exon_start) AS s, coalesce(me, exon_end) AS e, upstream_ee AS u, downstream_es AS d
    FROM se JOIN fixed USING (event_id)) x),
win_text AS (SELECT event_id, w.slot AS slot, CASE WHEN strand = '-' THEN reverse(translate(raw, 'ACGT', 'TGCA')) ELSE raw END AS seq FROM (
    SELECT event_id, strand, w, CASE WHEN w.b > greatest(w.a, 0) THEN substr(t, cast(greatest(w.a, 0) + 1 AS bigint), cast(w.b - greatest(w.a, 0) AS bigint)) ELSE '' END AS raw
    FROM win JOIN contig_text ON chr = contig) x),
texts AS (SELECT event_id,
    max(CASE WHEN slot = 'donor' AND seq <> '' THEN seq END) AS donor_seq,
    max(CASE WHEN slot = 'acceptor' AND seq <> '' THEN seq END) AS acceptor_seq,
    max(CASE WHEN slot = 'ppt' AND seq <> '' THEN seq END) AS ppt_seq,
    max(CASE WHEN slot = 'upstream_donor' AND seq <> '' THEN seq END) AS upstream_donor_seq,
    max(CASE WHEN slot = 'downstream_acceptor' AND seq <> '' THEN seq END) AS downstream_acceptor_seq
  FROM win_text GROUP BY event_id),
bp_all AS (SELECT event_id, i, length(ppt_seq) + 3 - (i + 5) AS dist,
    2 + cast(substr(ppt_seq, i + 1, 1) IN ('C', 'T') AS bigint) + cast(substr(ppt_seq, i + 3, 1) IN ('C', 'T') AS bigint)
      + cast(substr(ppt_seq, i + 4, 1) = 'T' AS bigint) + cast(substr(ppt_seq, i + 5, 1) IN ('A', 'G') AS bigint)
      + cast(substr(ppt_seq, i + 7, 1) IN ('C', 'T') AS bigint) AS score
  FROM (SELECT event_id, ppt_seq, unnest(range(0, length(ppt_seq) - 6)) AS i FROM texts WHERE ppt_seq IS NOT NULL) x
  WHERE substr(ppt_seq, i + 6, 1) = 'A' AND length(ppt_seq) + 3 - (i + 5) BETWEEN 18 AND 44),
bp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, i DESC) AS rn FROM bp_all) x WHERE rn = 1),
tx_span AS (SELECT gene_id, transcript_id, max(cds_start) AS c0, max(cds_end) AS c1, count(*) AS n_exons FROM transcript_exons GROUP BY ALL),
frames AS (SELECT se.event_id, t.transcript_id,
    CASE WHEN b.event_id IS NULL THEN NULL WHEN se.strand = '-' THEN n_exons - b.exon_ord ELSE b.exon_ord + 1 END AS exon_rank,
    CASE WHEN t.transcript_id IS NULL THEN 'unknown' WHEN c0 IS NULL THEN 'non_coding'
      WHEN least(exon_end, c1) <= greatest(exon_start, c0) THEN CASE WHEN (exon_end <= c0) = (se.strand = '+') THEN 'UTR5' ELSE 'UTR3' END
      WHEN exon_start >= c0 AND exon_end <= c1 THEN 'CDS' ELSE 'partial' END AS frame_region,
    CASE WHEN t.transcript_id IS NULL THEN 'unknown' WHEN c0 IS NULL OR least(exon_end, c1) <= greatest(exon_start, c0) THEN 'non_coding'
      WHEN (least(exon_end, c1) - greatest(exon_start, c0)) % 3 = 0 THEN 'in_frame' ELSE 'frameshift' END AS frame_class,
    CASE WHEN c0 IS NOT NULL AND least(exon_end, c1) > greatest(exon_start, c0) THEN least(exon_end, c1) - greatest(exon_start, c0) END AS cds_exon_length
  FROM se LEFT JOIN tx_span t USING (gene_id) LEFT JOIN best_ov b USING (event_id)),
sizes AS (SELECT event_id, exon_end - exon_start AS exon_size,
    CASE WHEN strand = '+' THEN lo ELSE hi END AS upstream_intron_size, CASE WHEN strand = '+' THEN hi ELSE lo END AS downstream_intron_size
  FROM (SELECT *, CASE WHEN exon_start >= upstream_ee THEN exon_start - upstream_ee END AS lo, CASE WHEN downstream_es >= exon_end THEN downstream_es - exon_end END AS hi FROM se) x),
features AS (SELECT se.event_id, exon_size, upstream_intron_size, downstream_intron_size,
    donor_seq, acceptor_seq, ppt_seq, upstream_donor_seq, downstream_acceptor_seq,
    CASE WHEN length(donor_seq) >= 5 THEN substr(donor_seq, 4, 2) = 'GT' END AS donor_is_gt,
    CASE WHEN length(acceptor_seq) >= 20 THEN substr(acceptor_seq, 19, 2) = 'AG' END AS acceptor_is_ag,
    CASE WHEN length(upstream_donor_seq) >= 5 THEN substr(upstream_donor_seq, 4, 2) = 'GT' END AS upstream_donor_is_gt,
    CASE WHEN length(downstream_acceptor_seq) >= 20 THEN substr(downstream_acceptor_seq, 19, 2) = 'AG' END AS downstream_acceptor_is_ag,
    round(length(regexp_replace(ppt_seq, '[^CT]', '', 'g')) / cast(length(ppt_seq) AS double), 4) AS ppt_score,
    list_max(list_transform(string_split_regex(ppt_seq, '[^CT]+'), lambda r: length(r))) AS ppt_longest_run,
    coalesce(bp.score >= 5, false) AS bp_motif_found,
    CASE WHEN bp.score >= 5 THEN bp.dist END AS bp_distance,
    CASE WHEN ppt_seq IS NOT NULL THEN coalesce(bp.score, 0) END AS bp_score,
    CASE WHEN bp.score >= 5 THEN bp.i END AS bp_position,
    CASE WHEN bp.score >= 5 THEN substr(ppt_seq, bp.i + 1, 7) END AS bp_motif,
    transcript_id, exon_rank, frame_region, frame_class, cds_exon_length, msource AS model_exon_source
  FROM se JOIN sizes USING (event_id) JOIN frames USING (event_id) JOIN fixed USING (event_id)
  LEFT JOIN texts USING (event_id) LEFT JOIN bp USING (event_id)),
joined AS (SELECT se.*, f.* EXCLUDE (event_id) FROM se LEFT JOIN features f USING (event_id))
"""


class Registry:
    """Queries of one family next to their oracle text."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, oracle: str | None = None, prefix: bool = True):
        def register(fn):
            self.queries[name] = fn
            if oracle is not None:
                self.oracles[name] = (PREFIX if prefix else "") + oracle
            return fn

        return register


SIG = _SIG
