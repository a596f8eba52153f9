"""Aggregates over events and their splice features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoscope.functions.catalogue import CONSENSUS_SHARE, EVENT_TYPES, IUPAC_CODE, literal_map
from isoscope.functions.numeric import dpsi_bucket, size_bucket
from isoscope.functions.sequence import base_fraction
from isoscope.plans.prefix import medians

# site -> (sequence column, known-flag column, minimal length, kept bases)
SITES = {
    "donor": ("donor_seq", "donor_is_gt", 9),
    "acceptor": ("acceptor_seq", "acceptor_is_ag", 23),
    "upstream_donor": ("upstream_donor_seq", "upstream_donor_is_gt", 9),
    "downstream_acceptor": ("downstream_acceptor_seq", "downstream_acceptor_is_ag", 23),
}


def _filled(name: str) -> Column:
    """A non-empty sequence is present."""
    return F.coalesce(F.length(name) > 0, F.lit(False))


def _pct(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.when(whole > 0, F.round(part / whole * 100, digits))


def type_counts(events: DataFrame) -> DataFrame:
    """Events per type with their share, zero rows included."""
    counted = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    all_types = events.sparkSession.createDataFrame([(t,) for t in EVENT_TYPES], "event_type string")
    total = counted.agg(F.sum("n").alias("total")).withColumn("_one", F.lit(1))
    known = all_types.join(counted, "event_type", "left").withColumn("_one", F.lit(1))
    n = F.coalesce("n", F.lit(0))
    return known.join(total, "_one").select(
        "event_type", n.alias("n_events"),
        F.round(n / F.greatest(F.coalesce("total", F.lit(0)), F.lit(1)) * 100, 1)
        .alias("pct_of_total"),
    )


def _in_site(site: str) -> Column:
    """Window long enough and the event's own sequence known."""
    seq, _, width = SITES[site]
    return _filled("donor_seq") & F.coalesce(F.length(seq) >= width, F.lit(False))


def canonical_counts() -> list[Column]:
    """Guarded canonical counts per site: n sequences, n known, n canonical."""
    out = []
    for site, (_, flag, _) in SITES.items():
        known = _in_site(site) & F.col(flag).isNotNull()
        out += [
            F.count_if(_in_site(site)).alias(f"{site}_n"),
            F.count_if(known).alias(f"{site}_known"),
            F.count_if(known & F.col(flag)).alias(f"{site}_canonical"),
        ]
    return out


def known_flag_counts() -> list[Column]:
    """Unguarded variant: every known flag counts (tests and report summary)."""
    return [
        c for site, (_, flag, _) in SITES.items() for c in (
            F.count(flag).alias(f"{site}_known"), F.count_if(flag).alias(f"{site}_canonical"))
    ]


# -- sequence matrices -------------------------------------------------------------
def base_counts(seqs: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Per key and position: counts of A, C, G, T and of all characters, cut to the
    shortest sequence of the key."""
    used = seqs.where(F.length(seq) > 0)
    letters = used.select(*keys, F.posexplode(F.split(F.upper(seq), "")).alias("pos", "base"))
    counted = letters.where("base <> ''").groupBy(*keys, "pos").agg(
        *[F.count_if(F.col("base") == b).alias(b) for b in "ACGT"],
        F.count(F.lit(1)).alias("n"),
    )
    shortest = used.groupBy(*keys).agg(F.min(F.length(seq)).alias("_len"))
    return counted.join(shortest, keys).where(F.col("pos") < F.col("_len")).drop("_len")


def position_weights(counts: DataFrame) -> DataFrame:
    """Base frequencies; the denominator counts A, C, G and T only."""
    total = F.greatest(sum((F.col(b) for b in "ACGT"), F.lit(0)), F.lit(1))
    keys = [c for c in counts.columns if c not in ("A", "C", "G", "T", "n")]
    return counts.select(*keys, *[F.round(F.col(b) / total, 4).alias(b) for b in "ACGT"])


def consensus(counts: DataFrame, keys: list[str], share: float = CONSENSUS_SHARE) -> DataFrame:
    """IUPAC string per key; a base counts from `share` of ALL characters on."""
    present = F.concat(*[
        F.when(F.col(b) / F.col("n") >= share, b).otherwise("") for b in "ACGT"
    ])
    code = F.coalesce(F.try_element_at(literal_map(IUPAC_CODE), present), F.lit("N"))
    return counts.select(*keys, "pos", code.alias("code")).groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("pos", "code")))["code"], "")
        .alias("consensus")
    )


def information_content(weights: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """Bits per position, corrected for the number of sequences (`n_seq` in sizes)."""
    entropy = sum(
        (F.when(F.col(b) > 0, -F.col(b) * F.log2(F.col(b))).otherwise(0.0) for b in "ACGT"),
        F.lit(0.0),
    )
    correction = F.when(F.col("n_seq") > 0, 3 / (2 * F.log(F.lit(2.0)) * F.col("n_seq"))).otherwise(0.0)
    return weights.join(sizes, keys).select(
        *keys, "pos", F.greatest(F.lit(0.0), 2 - entropy - correction).alias("bits")
    )


def site_sequences(joined: DataFrame, keys: list[str]) -> DataFrame:
    """Long (keys, site, event_id, seq): 9-nt donors and the last 23 nt of acceptors."""
    rows = []
    for site, (seq, _, width) in SITES.items():
        cut = F.substring(seq, 1, 9) if width == 9 else F.right(F.col(seq), F.lit(23))
        rows.append(F.struct(F.lit(site).alias("site"), F.when(_in_site(site), cut).alias("seq")))
    return (
        joined.select(*keys, "event_id", F.inline(F.array(*rows)))
        .where(F.col("seq").isNotNull())
    )


def site_statistics(joined: DataFrame, examples: int = 8) -> DataFrame:
    """One row per site: counts, canonical share, consensus and example sequences."""
    seqs = site_sequences(joined, [])
    counts = base_counts(seqs, ["site"])
    wide = joined.agg(*canonical_counts())
    stats = wide.select(F.inline(F.array(*[
        F.struct(
            F.lit(s).alias("site"), F.col(f"{s}_n").alias("n_sequences"),
            F.col(f"{s}_canonical").alias("n_canonical"),
            F.coalesce(_pct(F.col(f"{s}_canonical"), F.col(f"{s}_known")), F.lit(0.0))
            .alias("pct_canonical"),
        ) for s in SITES
    ])))
    shown = first_per_key(seqs, ["site"], "event_id", examples).groupBy("site").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("event_id", "seq")))["seq"], ",")
        .alias("examples"))
    return stats.join(consensus(counts, ["site"]), "site", "left").join(shown, "site", "left")


def first_per_key(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """First n rows per key (Spark prunes to n per key before the shuffle)."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


# -- numeric summaries --------------------------------------------------------------
SIZES = ["exon_size", "upstream_intron_size", "downstream_intron_size"]


def _mean(name: str) -> Column:
    return F.round(F.avg(name), 1).alias(f"{name}_mean")


def _with_medians(base: DataFrame, rows: DataFrame, by: list[str], columns: list[str],
                  digits: int = 1) -> DataFrame:
    """The groups of `base` with the medians of these columns of `rows`, each behind its mean."""
    found = medians(rows, by, columns)
    names = [f"{c}_median" for c in columns]
    if by:
        renamed = found.withColumnsRenamed({c: f"_m_{c}" for c in by})
        both = base.join(renamed, [base[c].eqNullSafe(renamed[f"_m_{c}"]) for c in by], "left")
    else:  # two single rows
        both = base.withColumn("_one", F.lit(1)).join(found.withColumn("_one", F.lit(1)), "_one", "left")
    order = []
    for c in base.columns:
        order.append(c)
        if c.removesuffix("_mean") in columns and c.endswith("_mean"):
            order.append(f"{c.removesuffix('_mean')}_median")
    return both.withColumns({n: F.round(n, digits) for n in names}).select(*order)


def size_summary(features: DataFrame) -> DataFrame:
    """Exon sizes (mean, median, min, max) and both intron sizes (mean, median)."""
    base = features.agg(
        _mean("exon_size"),
        F.min("exon_size").alias("exon_size_min"), F.max("exon_size").alias("exon_size_max"),
        _mean("upstream_intron_size"), _mean("downstream_intron_size"),
    )
    return _with_medians(base, features, [], SIZES)


def size_distribution(features: DataFrame) -> DataFrame:
    return (
        features.where("exon_size IS NOT NULL")
        .groupBy(size_bucket(F.col("exon_size")).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n")).orderBy("bin")
    )


def report_size_histogram(features: DataFrame) -> DataFrame:
    """25-nt bins, at most 40, the last one open."""
    # one row per distinct size before anything is joined to the single limit row
    sized = features.where("exon_size IS NOT NULL").groupBy("exon_size").agg(
        F.count(F.lit(1)).alias("n")).withColumn("_one", F.lit(1))
    limit = sized.groupBy("_one").agg(
        F.least(F.ceil(F.max("exon_size") / 25) + 1, F.lit(40)).alias("n_bins"))
    slot = F.least(F.floor(F.col("exon_size") / 25), F.col("n_bins") - 1)
    filled = sized.join(limit, "_one").groupBy(slot.alias("bin")).agg(F.sum("n").alias("n"))
    every = limit.select(
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_bins") - 1)).alias("bin"))
    return every.join(filled, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def dpsi_histogram(events: DataFrame) -> DataFrame:
    """0.1-wide bins of the effect; empty below three values."""
    binned = (
        events.where("inc_level_difference IS NOT NULL")
        .groupBy(dpsi_bucket(F.col("inc_level_difference")).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    enough = binned.agg(F.sum("n").alias("_all")).where("_all >= 3").select(F.lit(1).alias("_one"))
    return binned.withColumn("_one", F.lit(1)).join(enough, "_one", "left_semi").drop("_one")


def effect_means(events: DataFrame, significant: Column) -> DataFrame:
    effect = F.col("inc_level_difference")
    return events.agg(
        F.round(F.avg(effect), 3).alias("mean_delta_psi"),
        F.round(F.avg(F.when(significant, effect)), 3).alias("mean_delta_psi_significant"),
    )


def ppt_columns() -> list[Column]:
    seen = _filled("donor_seq")
    return [
        F.round(F.avg(F.when(seen, F.col("ppt_score"))), 3).alias("ppt_mean_score"),
        F.round(F.avg(F.when(seen, F.col("ppt_longest_run"))), 1).alias("ppt_mean_longest_run"),
    ]


def first_ppt_scores(joined: DataFrame, n: int = 100) -> DataFrame:
    """The first n tract scores in event order."""
    return (
        joined.where(_filled("donor_seq") & F.col("ppt_score").isNotNull())
        .select("event_id", "ppt_score").orderBy("event_id").limit(n)
    )


def frame_columns(present: Column) -> list[Column]:
    frame = F.coalesce("frame_class", F.lit("unknown"))
    return [
        F.count_if(present & (frame == k)).alias(f"frame_{k}")
        for k in ("in_frame", "frameshift", "non_coding", "unknown")
    ]


def branch_point_pct() -> Column:
    seen = _filled("ppt_seq")
    return _pct(F.count_if(seen & F.col("bp_motif_found")), F.count_if(seen)).alias("bp_found_pct")


# -- group statistics and whole reports ------------------------------------------------
def group_statistics(joined: DataFrame, by: str = "is_significant") -> DataFrame:
    """Scalar statistics of every group in one pass over events with features."""
    seen = _filled("donor_seq")
    content = lambda b: F.round(
        F.avg(F.when(seen & _filled("ppt_seq"), base_fraction(F.col("ppt_seq"), b))), 3)
    has = F.col("has_features")
    base = joined.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(has).alias("n_se_with_features"),
        _mean("exon_size"),
        *canonical_counts(),
        F.round(F.avg(F.when(seen, F.col("ppt_score"))), 3).alias("ppt_mean_score"),
        content("T").alias("ppt_mean_t_content"),
        content("C").alias("ppt_mean_c_content"),
        *frame_columns(has),
        branch_point_pct(),
        F.round(F.avg("inc_level_difference"), 3).alias("mean_delta_psi"),
        _mean("upstream_intron_size"), _mean("downstream_intron_size"),
    )
    rates = {
        "pct_canonical_gt": "donor", "pct_canonical_ag": "acceptor",
        "pct_upstream_gt": "upstream_donor", "pct_downstream_ag": "downstream_acceptor",
    }
    helper = [f"{s}_{k}" for s in SITES for k in ("n", "known", "canonical")]
    return _with_medians(base, joined, [by], SIZES).withColumns({
        out: _pct(F.col(f"{s}_canonical"), F.col(f"{s}_known")) for out, s in rates.items()
    }).drop(*helper, "frame_unknown")


def group_matrices(joined: DataFrame, by: str = "is_significant") -> DataFrame:
    """Base frequencies per group, site and position."""
    return position_weights(base_counts(site_sequences(joined, [by]), [by, "site"]))


def group_consensus(joined: DataFrame, by: str = "is_significant") -> DataFrame:
    return consensus(base_counts(site_sequences(joined, [by]), [by, "site"]), [by, "site"])


def pattern_report(joined: DataFrame, significant: Column) -> DataFrame:
    """The scalar part of the whole-analysis pattern report, in one pass."""
    effect = F.col("inc_level_difference")
    has = F.col("has_features")
    base = joined.agg(
        F.count(F.lit(1)).alias("n_se_events"),
        F.count_if(_filled("donor_seq")).alias("n_analyzed"),
        F.count_if(significant).alias("n_significant"),
        F.count_if(~significant).alias("n_not_significant"),
        _mean("exon_size"),
        F.min("exon_size").alias("exon_size_min"), F.max("exon_size").alias("exon_size_max"),
        _mean("upstream_intron_size"), _mean("downstream_intron_size"),
        F.round(F.avg(effect), 3).alias("mean_delta_psi"),
        F.round(F.avg(F.when(significant, effect)), 3).alias("mean_delta_psi_significant"),
        *canonical_counts(), *ppt_columns(), *frame_columns(has), branch_point_pct(),
    )
    return _with_medians(base, joined, [], SIZES).withColumn("fasta_available", F.col("n_analyzed") > 0)


def report_summary(events: DataFrame, features: DataFrame) -> DataFrame:
    """Title-page numbers: canonical rates over every known flag."""
    ev = events.agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(F.col("event_type") == "SE").alias("n_se"),
    ).withColumn("_one", F.lit(1))
    ft = features.agg(
        F.count_if(_filled("donor_seq")).alias("n_with_sequence"),
        F.count("donor_is_gt").alias("n_gt_known"), F.count_if("donor_is_gt").alias("n_gt"),
        F.count("acceptor_is_ag").alias("n_ag_known"), F.count_if("acceptor_is_ag").alias("n_ag"),
    ).withColumn("_one", F.lit(1))
    return ev.join(ft, "_one").drop("_one").withColumns({
        "pct_gt": _pct(F.col("n_gt"), F.col("n_gt_known")),
        "pct_ag": _pct(F.col("n_ag"), F.col("n_ag_known")),
    })


def report_feature_table(features: DataFrame) -> DataFrame:
    """Feature statistics with the report's own denominators."""
    guarded = lambda s: F.col(SITES[s][1]).isNotNull() & F.coalesce(
        F.length(SITES[s][0]) >= SITES[s][2], F.lit(False))
    frame = F.col("frame_class")
    content = lambda b: F.round(F.avg(F.when(
        _filled("ppt_seq"), base_fraction(F.col("ppt_seq"), b))) * 100, 1)
    base = features.agg(
        F.count(F.lit(1)).alias("n_features"),
        F.count_if("donor_is_gt").alias("n_gt"), F.count("donor_is_gt").alias("n_gt_known"),
        F.count_if("acceptor_is_ag").alias("n_ag"), F.count("acceptor_is_ag").alias("n_ag_known"),
        F.count_if("upstream_donor_is_gt").alias("n_upstream_gt"),
        F.count_if(guarded("upstream_donor")).alias("n_upstream_known"),
        F.count_if("downstream_acceptor_is_ag").alias("n_downstream_ag"),
        F.count_if(guarded("downstream_acceptor")).alias("n_downstream_known"),
        *[F.count_if(frame == k).alias(f"n_{k}") for k in ("in_frame", "frameshift", "non_coding")],
        F.count_if(F.col("bp_motif_found")).alias("n_branch_point"),
        F.count_if(_filled("ppt_seq")).alias("n_with_ppt"),
        F.round(F.avg("exon_size"), 0).alias("exon_size_mean"),
        F.round(F.avg("ppt_score") * 100, 1).alias("ppt_pct"),
        content("T").alias("ppt_t_pct"), content("C").alias("ppt_c_pct"),
    )
    return _with_medians(base, features, [], ["exon_size"], 0).withColumn(
        "n_frame_unknown",
        F.col("n_features") - F.col("n_in_frame") - F.col("n_frameshift") - F.col("n_non_coding"),
    )


def significant_symbols(events: DataFrame, significant: Column) -> DataFrame:
    """Distinct non-blank gene symbols of significant events of every type."""
    return (
        events.where(significant & (F.trim("gene_symbol") != ""))
        .select("gene_symbol").distinct()
    )
