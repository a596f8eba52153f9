"""Transcript annotation: GFF3 lines -> transcripts -> one model per gene."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# fixed values: tags of the annotation release
SELECT_TAG = "MANE_Select"
PLUS_TAG = "MANE_Plus_Clinical"


def unversioned(identifier: Column) -> Column:
    return F.split(identifier, r"\.")[0]


def _attributes(text: Column) -> Column:
    """map of `key=value` pairs; parts without `=` are ignored, the last key wins."""
    pairs = F.filter(
        F.transform(F.split(text, ";"), lambda p: F.trim(p)), lambda p: F.instr(p, "=") > 0
    )
    entries = F.transform(
        pairs,
        lambda p: F.struct(
            F.substring_index(p, "=", 1).alias("k"),
            F.substring(p, F.instr(p, "=") + 1, F.length(p)).alias("v"),
        ),
    )
    # keep the last entry of a repeated key, so that map_from_entries is defined
    n = F.size(entries)
    last = F.filter(
        entries,
        lambda e, i: ~F.exists(
            F.slice(entries, i + 2, F.greatest(n - i - 1, F.lit(0))), lambda f: f["k"] == e["k"]
        ),
    )
    return F.map_from_entries(last)


def read_gff3(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Feature lines with 0-based starts, `chr`-prefixed names, parsed attributes
    and `line_no`, which grows in file order inside one file."""
    lines = spark.read.text(paths).select(
        F.monotonically_increasing_id().alias("line_no"), F.split("value", "\t").alias("f"),
        "value",
    )
    rows = lines.where(~F.col("value").startswith("#") & (F.size("f") >= 9))
    seqid = F.get("f", F.lit(0))
    return rows.select(
        "line_no",
        F.when(seqid.startswith("chr"), seqid).otherwise(F.concat(F.lit("chr"), seqid)).alias("chr"),
        F.get("f", F.lit(2)).alias("feature"),
        (F.get("f", F.lit(3)).cast("bigint") - 1).alias("start"),
        F.get("f", F.lit(4)).cast("bigint").alias("end"),
        F.get("f", F.lit(6)).alias("strand"),
        _attributes(F.get("f", F.lit(8))).alias("attrs"),
    )


def _attr(key: str) -> Column:
    return F.coalesce(F.try_element_at("attrs", F.lit(key)), F.lit(""))


def transcript_lines(features: DataFrame) -> DataFrame:
    """One row per transcript id (the last line of a repeated id wins, in the place
    of the first), with gene, tags and order of appearance."""
    raw = F.when(_attr("transcript_id") != "", _attr("transcript_id")).otherwise(_attr("ID"))
    raw = F.when(raw.startswith("ENST"), raw).otherwise(
        F.coalesce(F.try_element_at("attrs", F.lit("Name")), raw))
    gene = F.when(_attr("gene_id").startswith("ENSG"), _attr("gene_id")).otherwise(
        F.when(_attr("Parent").startswith("ENSG"), _attr("Parent")).otherwise(
            F.coalesce(F.try_element_at("attrs", F.lit("gene_id")), _attr("ID"))))
    tags = F.transform(F.split(F.regexp_replace(_attr("tag"), "%2C", ","), ","), lambda t: F.trim(t))
    found = (
        features.where(F.col("feature").isin("mRNA", "transcript"))
        .select(
            "line_no", "chr", "strand",
            unversioned(raw).alias("transcript_id"),
            F.coalesce(F.try_element_at("attrs", F.lit("ID")), raw).alias("feature_id"),
            unversioned(gene).alias("gene_id"),
            F.array_contains(tags, SELECT_TAG).alias("is_select"),
            F.array_contains(tags, PLUS_TAG).alias("is_plus_clinical"),
        )
        .where((F.col("transcript_id") != "") & (F.col("gene_id") != ""))
    )
    return found.groupBy("transcript_id").agg(
        F.min("line_no").alias("line_no"),
        F.max(F.struct("line_no", "chr", "strand", "feature_id", "gene_id", "is_select",
                       "is_plus_clinical")).alias("t"),
    ).select("transcript_id", "line_no", "t.chr", "t.strand", "t.feature_id", "t.gene_id",
             "t.is_select", "t.is_plus_clinical")


def assembled(features: DataFrame) -> DataFrame:
    """Transcripts with their exon and coding segments, sorted by start.

    A segment names its transcript by feature id or by (possibly versioned)
    transcript id; both spellings are tried, the feature id first.
    """
    tx = transcript_lines(features)
    names = (
        tx.select("transcript_id", F.explode(F.array(
            F.struct(F.lit(0).alias("rank"), F.col("feature_id").alias("name")),
            F.struct(F.lit(1).alias("rank"), F.col("transcript_id").alias("name")),
        )).alias("n"))
        .groupBy("n.name").agg(F.min(F.struct("n.rank", "transcript_id")).alias("m"))
        .select("name", "m.rank", "m.transcript_id")
    )
    parts = features.where(F.col("feature").isin("exon", "CDS")).select(
        "line_no", "feature", "start", "end", _attr("Parent").alias("parent"))
    tries = parts.withColumn("name", F.explode(F.array_distinct(F.array(
        F.col("parent"), unversioned(F.col("parent"))))))
    owned = (
        tries.join(names, "name")
        # the full spelling may match anything, the shortened one a transcript id
        .withColumn("_pref", F.struct((F.col("name") != F.col("parent")).cast("int"), "rank"))
        .groupBy("line_no", "feature", "start", "end")
        .agg(F.min(F.struct("_pref", "transcript_id"))["transcript_id"].alias("transcript_id"))
    )
    segment = F.struct("start", "end")
    grouped = owned.groupBy("transcript_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("feature") == "exon", segment))).alias("exons"),
        F.array_sort(F.collect_list(F.when(F.col("feature") == "CDS", segment))).alias("cds"),
    )
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return tx.join(grouped, "transcript_id", "left").withColumns(
        {c: F.coalesce(c, empty) for c in ("exons", "cds")}
    )


def representative(transcripts: DataFrame) -> DataFrame:
    """One transcript per gene: the first selected one, else the first seen."""
    w = Window.partitionBy("gene_id").orderBy(F.desc("is_select"), "line_no")
    ranked = transcripts.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return ranked.drop("_n")


def transcript_of_gene(rows: DataFrame, models: DataFrame, gene: str = "gene_id") -> DataFrame:
    """Left lookup of the gene's transcript id; version suffixes do not matter."""
    keyed = models.select(F.col("gene_id").alias("_g"), "transcript_id")
    return rows.join(keyed, unversioned(F.col(gene)) == F.col("_g"), "left").drop("_g")


def by_transcript(rows: DataFrame, transcripts: DataFrame, column: str) -> DataFrame:
    """Left lookup of any transcript (also non-representative ones) by id."""
    keyed = transcripts.withColumnRenamed("transcript_id", "_t")
    return rows.join(keyed, unversioned(F.col(column)) == F.col("_t"), "left").drop("_t")


def exon_list(transcripts: DataFrame) -> DataFrame:
    """Exons in genomic order with their size and their rank along the transcript."""
    n = F.size("exons")
    return transcripts.select(
        "gene_id", "transcript_id", "strand", n.alias("_n"), F.posexplode("exons").alias("_i", "e")
    ).select(
        "gene_id", "transcript_id", "strand",
        (F.col("_i") + 1).alias("genomic_rank"),
        F.when(F.col("strand") == "-", F.col("_n") - F.col("_i"))
        .otherwise(F.col("_i") + 1).alias("exon_rank"),
        F.col("e.start").alias("start"), F.col("e.end").alias("end"),
        (F.col("e.end") - F.col("e.start")).alias("size"),
    )


def from_exon_rows(exon_rows: DataFrame) -> DataFrame:
    """Model table from one row per exon with the coding span repeated
    (gene_id, transcript_id, strand, exon_start, exon_end, cds_start, cds_end)."""
    span = F.struct(F.col("cds_start").alias("start"), F.col("cds_end").alias("end"))
    exon = F.struct(F.col("exon_start").alias("start"), F.col("exon_end").alias("end"))
    return exon_rows.groupBy("gene_id", "transcript_id", "strand").agg(
        F.array_sort(F.collect_list(exon)).alias("exons"),
        F.collect_set(F.when(F.col("cds_start").isNotNull(), span)).alias("cds"),
    )


def gene_set_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """GMT lines (term, description, genes...) as (library, term, genes): the library is the
    file name, the genes are the line's non-blank ones, perhaps none."""
    from isoscope.sources.event_tables import logical_name

    fields = F.split("value", "\t")
    genes = F.transform(F.expr("slice(f, 3, size(f))"), lambda g: F.trim(g))
    return (
        spark.read.option("recursiveFileLookup", "true").text(paths)
        .select(logical_name(F.col("_metadata.file_path")).alias("file"), fields.alias("f"))
        .where((F.size("f") > 2) & (F.trim(F.col("f")[0]) != ""))
        .select(
            F.regexp_replace("file", r"\.(gmt|txt)(\.gz)?$", "").alias("library"),
            F.trim(F.col("f")[0]).alias("term"),
            F.filter(genes, lambda g: g != "").alias("genes"),
        )
    )


def gene_sets(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows (library, term, gene).  Blank genes are dropped."""
    return gene_set_lines(spark, paths).select("library", "term", F.explode("genes").alias("gene"))


def gene_set_sizes(sets: DataFrame) -> DataFrame:
    """Number of non-blank genes per term, of `gene_sets` rows or of `gene_set_lines`; only the
    lines know terms whose genes are all blank, which have size 0."""
    size = F.sum(F.size("genes")) if "genes" in sets.columns else F.count(F.lit(1))
    return sets.groupBy("library", "term").agg(size.cast("bigint").alias("size"))
