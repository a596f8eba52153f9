"""Motif-by-region enrichment of one event group over another."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoscope.functions.catalogue import (
    ACCEPTOR_EXCLUDED_NT,
    DONOR_EXCLUDED_NT,
    FLANK_NT,
    MOTIFS,
    REGIONS,
    literal_map,
    motif_width,
    regulatory_effects,
)
from isoscope.functions.coordinates import KNOWN, as_long, is_plus, scan_regions
from isoscope.functions.labels import min_q
from isoscope.functions.sequence import hits_in_rows, motif_counter, oriented
from isoscope.operators.hypothesis import benjamini_hochberg, mann_whitney, with_proportion_test
from isoscope.plans.lineage import materialize
from isoscope.sources.genome import (
    Genome,
    known_contigs,
    long_regions,
    longer_than_pad,
    resolved_contig,
    short_regions,
    with_rows,
)


def _placed(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type") == "SE").where(
        "chr IS NOT NULL AND exon_start IS NOT NULL AND exon_end IS NOT NULL")


def _regions(placed: DataFrame, wanted: list[str], *carried: str) -> DataFrame:
    """Long regions; caller coordinates, never the corrected ones."""
    chosen = {k: v for k, v in scan_regions().items() if k in wanted}
    return placed.select(
        "event_id", *carried, F.coalesce("strand", F.lit("+")).alias("strand"),
        F.inline(as_long(chosen)),
    ).where(KNOWN).withColumnRenamed("slot", "region")


def region_table(events: DataFrame) -> DataFrame:
    """Long (event_id, chr, strand, region, start, end) of the available regions."""
    return _regions(_placed(events), REGIONS, "chr")


def _short_and_glued(events: DataFrame, genome: Genome, tags: DataFrame | None
                     ) -> tuple[DataFrame, DataFrame]:
    """Regions (…, contig, strand, start, end) that lie in one row of the genome, and the
    sequences of the others in transcript orientation."""
    slim = _placed(events).select(
        "event_id", "chr", "strand", "exon_start", "exon_end", "upstream_es", "upstream_ee",
        "downstream_es", "downstream_ee")
    named = resolved_contig(slim, known_contigs(genome))
    extra = [] if tags is None else [c for c in tags.columns if c != "event_id"]
    tagged = named if tags is None else named.join(tags, "event_id")
    within = _regions(tagged, REGIONS, "contig", *extra).where(~longer_than_pad(genome))
    # pieces are glued by event and region, and only then tagged
    may_be_long = ["skipped_exon"] if genome.pad >= FLANK_NT else REGIONS
    glued = long_regions(_regions(named, may_be_long, "contig").where(longer_than_pad(genome)),
                         genome, ["event_id", "region"])
    if tags is not None:
        glued = glued.join(tags, "event_id")
    turned = glued.withColumn("seq", oriented(F.col("seq"), F.col("strand")))
    return within, turned.select("event_id", "region", *extra, "seq")


def region_text(events: DataFrame, genome: Genome, tags: DataFrame | None = None) -> DataFrame:
    """Non-empty region sequences in transcript orientation, with the other columns of
    `tags` (event_id, …) where it is given; events without a tag then drop out.

    Flank and intron windows are bounded and need one lookup each; only the skipped
    exon itself can be longer than the genome table's padding.  Tags meet the events and
    travel with the regions, so no sequence is shuffled to its tag."""
    within, glued = _short_and_glued(events, genome, tags)
    texts = short_regions(within, genome, strand=F.col("strand"))
    return texts.select(glued.columns).unionByName(glued).where(F.col("seq") != "")


HITS = "struct<" + ",".join(f"m{i}:int" for i in range(len(MOTIFS))) + ">"
SCAN_ROWS, SCAN_BYTES = 200_000, 1 << 22  # regions and genome text that are counted together


def region_hits(events: DataFrame, genome: Genome, tags: DataFrame | None = None) -> DataFrame:
    """(event_id, region, …, nt, hits): length of each region of `region_text` and its hits
    of all motifs as a struct m0, m1, …

    Regions of one genome row overlap, so a motif is looked for once in the row, not in
    each region: hits are differences of running counts."""
    within, glued = _short_and_glued(events, genome, tags)
    kept = [c for c in glued.columns if c != "seq"]
    rows = with_rows(within, genome).select(*kept, (F.col("strand") == "-").alias("_minus"),
                                            "_wide", "_offset", "_size")
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, codes, size, n = [], {}, 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            code, lo, count, minus = (np.concatenate([h[i] for h in held]) for i in range(1, 5))
            texts = list(codes)
            hi = np.minimum(lo + count, np.array([len(t) for t in texts])[code])
            counts = hits_in_rows([p for _, _, p in MOTIFS], texts, code, np.minimum(lo, hi), hi, minus)
            at = 0
            for h in held:
                part = slice(at, at + len(h[1]))
                at = part.stop
                some = pa.array((hi - lo)[part] > 0)
                hits = pa.StructArray.from_arrays(
                    [pa.array(c[part]) for c in counts], [f"m{i}" for i in range(len(counts))])
                yield pa.RecordBatch.from_arrays(
                    [*h[0], pa.array((hi - lo)[part].astype(np.int32)), hits],
                    [*kept, "nt", "hits"]).filter(some)

        for batch in batches:
            if not batch.num_rows:
                continue
            wide = batch.column("_wide").dictionary_encode()
            to = []
            for text in wide.dictionary.to_pylist():
                text = text.encode("ascii", "replace")
                if text not in codes:
                    codes[text] = len(codes)
                    size += len(text)
                to.append(codes[text])
            number = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
            held.append(([batch.column(c) for c in kept],
                         np.array(to)[wide.indices.to_numpy(zero_copy_only=False)],
                         number("_offset"), number("_size"),
                         batch.column("_minus").to_numpy(zero_copy_only=False)))
            n += batch.num_rows
            if n >= SCAN_ROWS or size >= SCAN_BYTES:
                yield from flush()
                held, codes, size, n = [], {}, 0, 0
        if held:
            yield from flush()

    short = rows.mapInArrow(run, f"{schema}, nt int, hits {HITS}")
    return short.unionByName(_counted(glued.where(F.col("seq") != "")))


def _counted(texts: DataFrame) -> DataFrame:
    """The 19 counts of a sequence come from one vectorised pass."""
    rest = [c for c in texts.columns if c != "seq"]
    return texts.withColumn("hits", motif_counter([p for _, _, p in MOTIFS])("seq")).select(
        *rest, F.length("seq").alias("nt"), "hits")


def region_diagnostics(events: DataFrame) -> DataFrame:
    """One row: events without coordinates, without a flank, or with an intron that
    the exclusion zones consume."""
    shortest = DONOR_EXCLUDED_NT + ACCEPTOR_EXCLUDED_NT
    low = F.col("exon_start") - F.col("upstream_ee")
    high = F.col("downstream_es") - F.col("exon_end")
    plus = is_plus(F.col("strand"))
    up, down = F.when(plus, low).otherwise(high), F.when(plus, high).otherwise(low)
    placed = F.coalesce(F.col("chr"), F.lit("")) != ""
    placed = placed & F.col("exon_start").isNotNull() & F.col("exon_end").isNotNull()
    return events.where(F.col("event_type") == "SE").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(~placed).alias("n_missing_coords"),
        F.count_if(placed & up.isNull()).alias("n_null_upstream"),
        F.count_if(placed & down.isNull()).alias("n_null_downstream"),
        F.count_if(placed & (up <= shortest)).alias("n_short_upstream"),
        F.count_if(placed & (down <= shortest)).alias("n_short_downstream"),
    )


def motif_hits(texts: DataFrame) -> DataFrame:
    """Adds one row per motif: (…, motif_name, protein, hits, density)."""
    rest = [c for c in texts.columns if c != "seq"]
    # a row per motif gets its density afterwards: arrays of finished rows cost more
    long = _counted(texts).withColumnRenamed("hits", "_hits").select(*rest, "nt", F.inline(F.array(*[
        F.struct(F.lit(name).alias("motif_name"), F.lit(protein).alias("protein"),
                 F.col(f"_hits.m{i}").alias("hits"), F.lit(motif_width(pattern)).alias("width"))
        for i, (name, protein, pattern) in enumerate(MOTIFS)])))
    return long.withColumn("density", density(F.col("hits"), F.col("width"))).drop("nt", "width")


def density(hits: Column, width: Column) -> Column:
    """Covered share of a region of `nt` bases."""
    return F.least(F.lit(1.0), hits * width / F.col("nt"))


CELL = ["motif_name", "protein", "region"]


def density_table(counted: DataFrame) -> DataFrame:
    """Counts per (motif, region, density) and group: the only thing the tests need.  Rows
    of `region_hits` are counted by whole numbers, names and densities come afterwards."""
    each = F.posexplode(F.array(*[f"hits.m{i}" for i in range(len(MOTIFS))])).alias("_motif", "_n")
    cells = counted.select("region", "in_a", "nt", each).groupBy("region", "nt", "_motif", "_n").agg(
        F.count_if("in_a").alias("n_a"), F.count_if(~F.col("in_a")).alias("n_b"))
    motif = F.get(F.array(*[
        F.struct(F.lit(name).alias("motif_name"), F.lit(protein).alias("protein"),
                 F.lit(motif_width(pattern)).alias("width"))
        for name, protein, pattern in MOTIFS]), F.col("_motif"))
    return cells.withColumn("_m", motif).select(
        "_m.motif_name", "_m.protein", "region", density(F.col("_n"), F.col("_m.width")).alias("value"),
        "n_a", "n_b",
    ).groupBy(*CELL, "value").agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"))


def scan_summary(densities: DataFrame) -> DataFrame:
    """Per motif, region and group: events with a hit, events scanned, mean density."""
    sides = F.array(
        F.struct(F.lit(True).alias("in_a"), F.col("n_a").alias("n")),
        F.struct(F.lit(False).alias("in_a"), F.col("n_b").alias("n")),
    )
    long = densities.select(*CELL, "value", F.inline(sides))
    return long.groupBy(*CELL, "in_a").agg(
        F.sum(F.when(F.col("value") > 0, F.col("n")).otherwise(0)).alias("hit_count"),
        F.sum("n").alias("total"),
        F.coalesce(F.try_divide(F.sum(F.col("value") * F.col("n")), F.sum("n")), F.lit(0.0))
        .alias("mean_density"),
    )


def tagged_texts(events: DataFrame, tags: DataFrame, genome: Genome) -> DataFrame:
    """Region sequences with `in_a` = significant."""
    marked = tags.select("event_id", F.col("is_significant").alias("in_a"))
    return region_text(events, genome, marked)


def tagged_hits(events: DataFrame, tags: DataFrame, genome: Genome) -> DataFrame:
    """Hits of the regions with `in_a` = significant."""
    marked = tags.select("event_id", F.col("is_significant").alias("in_a"))
    return region_hits(events, genome, marked)


def compare_groups(densities: DataFrame) -> DataFrame:
    """All 133 (motif, region) rows: presence z-test and density rank test, each
    adjusted as its own family on unrounded p-values and rounded afterwards."""
    v = F.col("value")
    totals = densities.groupBy(*CELL).agg(
        F.sum(F.when(v > 0, F.col("n_a")).otherwise(0)).alias("k1"), F.sum("n_a").alias("n1"),
        F.sum(F.when(v > 0, F.col("n_b")).otherwise(0)).alias("k2"), F.sum("n_b").alias("n2"),
        F.try_divide(F.sum(v * F.col("n_a")), F.sum("n_a")).alias("d1"),
        F.try_divide(F.sum(v * F.col("n_b")), F.sum("n_b")).alias("d2"),
    )
    ranks = mann_whitney(densities, CELL).select(*CELL, "u", F.col("p").alias("pu"))
    grid = densities.sparkSession.createDataFrame(
        [(m, p, r) for m, p, _ in MOTIFS for r in REGIONS],
        "motif_name string, protein string, region string",
    )
    zero = {c: 0 for c in ("k1", "n1", "k2", "n2")} | {"d1": 0.0, "d2": 0.0}
    rows = with_proportion_test(grid.join(totals, CELL, "left").na.fill(zero))
    rows = rows.join(ranks, CELL, "left").withColumn("_f", F.lit(1))
    for p, q in (("p", "q"), ("pu", "qu")):
        rows = benjamini_hochberg(rows, ["_f"], p, q, ["motif_name", "region"])
    below = lambda q: F.coalesce(F.col(q) < 0.05, F.lit(False))
    return rows.select(
        *CELL,
        F.col("k1").alias("sig_hit_count"), F.col("n1").alias("sig_total"),
        F.col("k2").alias("bg_hit_count"), F.col("n2").alias("bg_total"),
        F.round("d1", 6).alias("sig_density"), F.round("d2", 6).alias("bg_density"),
        F.round("z", 4).alias("z_stat"), F.round("p", 6).alias("p_value"),
        F.round("q", 6).alias("p_adjusted"), below("q").alias("significant"),
        F.round("u", 4).alias("density_u_stat"), F.round("pu", 6).alias("density_p_value"),
        F.round("qu", 6).alias("density_p_adjusted"), below("qu").alias("density_significant"),
    )


def with_regulatory_effect(rows: DataFrame) -> DataFrame:
    effects = {f"{p}|{r}": e for p, r, e in regulatory_effects() if e is not None}
    return rows.withColumn(
        "regulatory_effect",
        F.try_element_at(literal_map(effects), F.concat_ws("|", "protein", "region")),
    )


def motif_enrichment(events: DataFrame, tags: DataFrame, genome: Genome) -> DataFrame:
    """The whole screen: regions -> counts -> tests -> annotation."""
    densities = materialize(density_table(tagged_hits(events, tags, genome)), "densities")
    return with_regulatory_effect(compare_groups(densities))


def group_sizes(events: DataFrame, tags: DataFrame) -> DataFrame:
    """Skipped-exon events per side."""
    se = events.where(F.col("event_type") == "SE").select("event_id")
    return se.join(tags, "event_id").agg(
        F.count_if("is_significant").alias("n_sig_events"),
        F.count_if(~F.col("is_significant")).alias("n_bg_events"),
    )


# -- report views -------------------------------------------------------------------
def significant_rows(rows: DataFrame, either: bool = True, top: int | None = None) -> DataFrame:
    """Rows called by at least one test (or the complement), best q first."""
    called = F.col("significant") | F.col("density_significant")
    q = F.coalesce(min_q(F.col("p_adjusted"), F.col("density_p_adjusted")), F.lit(1.0))
    ordered = rows.where(called if either else ~called).withColumn("min_q", q).orderBy(
        "min_q", "region", "motif_name")
    return ordered if top is None else ordered.limit(top)


def filtered_rows(
    rows: DataFrame, *, show_all: bool = False, protein: str | None = None,
    region: str | None = None,
) -> DataFrame:
    """Interactive view: filter, then smaller q first with missing q last."""
    if not show_all:
        rows = rows.where(F.col("significant") | F.col("density_significant"))
    if protein:
        rows = rows.where(F.col("protein") == protein)
    if region:
        rows = rows.where(F.col("region") == region)
    q = min_q(F.col("p_adjusted"), F.col("density_p_adjusted"))
    return rows.withColumn("min_q", q).orderBy(
        F.asc_nulls_last("min_q"), "motif_name", "region")


def best_motif_matrix(rows: DataFrame) -> DataFrame:
    """Protein x region: the motif with the smallest q (catalogue order on ties)."""
    order = literal_map({name: i for i, (name, _, _) in enumerate(MOTIFS)})
    q = min_q(F.col("p_adjusted"), F.col("density_p_adjusted"))
    ranked = rows.withColumn("min_q", q).where("min_q IS NOT NULL").withColumn(
        "_n", F.row_number().over(
            Window.partitionBy("protein", "region")
            .orderBy("min_q", F.try_element_at(order, F.col("motif_name")))))
    best = ranked.where("_n = 1")
    return best.groupBy("protein").pivot("region", REGIONS).agg(F.first("motif_name"))
