"""Genome as a chunk table, and interval -> sequence lookup by equi-join.

`chunks` holds (contig, chunk_id, seq): consecutive pieces of equal length.
`padded` regroups them into wider pieces that repeat the first `pad` bases of
what follows, so any region up to `pad` long lies inside ONE row and is a single
equi-join plus a substring; longer regions are cut into pieces and glued again.
`store_genome` keeps that table bucketed on the join key under a name of the catalogue, so
that a lookup shuffles its regions to the buckets and never the genome.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isoscope.functions.catalogue import CONTIG_ALIAS, literal_map
from isoscope.functions.sequence import reverse_complement


class Genome(NamedTuple):
    """Padded chunk table: (contig, wide_id, seq).  `names` has one row per contig; without it
    the names are found in the table."""

    table: DataFrame
    width: int
    pad: int
    names: DataFrame | None = None


def padded(chunks: DataFrame, chunk_nt: int, width: int = 4096, pad: int = 1024) -> Genome:
    if width % chunk_nt or pad > width:
        raise ValueError("width must be a multiple of the chunk length and at least pad")
    start = F.col("chunk_id") * chunk_nt
    home = F.floor(start / width)
    # a chunk also belongs to the previous wide row while inside its padding
    owners = F.when(
        (home > 0) & (start < home * width + pad), F.array(home - 1, home)
    ).otherwise(F.array(home))
    table = (
        chunks.select("contig", "chunk_id", "seq", F.explode(owners).alias("wide_id"))
        .groupBy("contig", "wide_id")
        .agg(F.array_sort(F.collect_list(F.struct("chunk_id", "seq"))).alias("parts"))
        .select(
            "contig", "wide_id",
            F.substring(F.upper(F.array_join(F.col("parts.seq"), "")), 1, width + pad).alias("seq"),
        )
    )
    return Genome(table, width, pad)


# -- a stored genome -----------------------------------------------------------------
_PROPERTIES = ("width", "pad")


def store_genome(genome: Genome, name: str, path: str | None = None, buckets: int | None = None) -> Genome:
    """Write the padded table under a catalogue name, bucketed and sorted on (contig, wide_id),
    one file per bucket, with a small table of its contigs (`name`_contigs).  Replaces a
    genome of that name.  Returns it as `load_genome` does.

    `path`: a folder that all executors share; by default the warehouse's.  `buckets`: by
    default spark.sql.shuffle.partitions, so that regions shuffled for another join fit.
    """
    spark = genome.table.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = ["contig", "wide_id"]

    def save(df: DataFrame, table: str, folder: str, keys: list[str], n: int) -> None:
        writer = df.repartition(n, *keys).sortWithinPartitions(*keys).write.mode("overwrite").bucketBy(
            n, *keys).sortBy(*keys)
        (writer.option("path", f"{path}/{folder}") if path else writer).saveAsTable(table)

    save(genome.table.select(*key, "seq"), name, "sequence", key, buckets)
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ("
              + ", ".join(f"'isoscope.{p}'='{getattr(genome, p)}'" for p in _PROPERTIES) + ")")
    save(contigs(spark.table(name)), f"{name}_contigs", "contigs", ["contig"], 1)
    return load_genome(spark, name)


def load_genome(spark: SparkSession, name: str) -> Genome:
    """A genome stored under a catalogue name; an error where there is none."""
    known = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
    if not all(f"isoscope.{p}" in known for p in _PROPERTIES):
        raise ValueError(f"{name} is not a stored genome")
    width, pad = (int(known[f"isoscope.{p}"]) for p in _PROPERTIES)
    return Genome(spark.table(name), width, pad, spark.table(f"{name}_contigs"))


def drop_genome(spark: SparkSession, name: str) -> None:
    """Forget a stored genome; files under a path of one's own stay."""
    for table in (name, f"{name}_contigs"):
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def known_contigs(genome: Genome) -> DataFrame:
    """One row per contig."""
    return contigs(genome.table) if genome.names is None else genome.names


def _piece(
    genome: Genome, regions: DataFrame, start: Column, end: Column, strand: Column | None = None
) -> DataFrame:
    """Adds `_text`: the sequence of [start, end), at most `pad` long; with `strand`, in its
    orientation.  Rows of the genome are complemented, not each region."""
    located = regions.withColumn("_s", start).withColumn("_e", end).withColumn(
        "wide_id", F.floor(F.col("_s") / genome.width)
    )
    table = genome.table.withColumnRenamed("seq", "_wide")
    if strand is not None:
        table = table.withColumn("_minus", reverse_complement(F.col("_wide")))
    joined = located.join(table, ["contig", "wide_id"], "left")
    offset = (F.col("_s") - F.col("wide_id") * genome.width).cast("int")
    size = (F.col("_e") - F.col("_s")).cast("int")
    text = F.substring(F.col("_wide"), offset + 1, size)
    if strand is not None:
        # behind the end of a contig there is nothing to read from the other side
        held = F.greatest(F.least(size, F.length("_wide") - offset), F.lit(0))
        text = F.when(strand == "-", F.substring(
            F.col("_minus"), F.length("_wide") - offset - held + 1, held)).otherwise(text)
    return joined.withColumn("_text", F.coalesce(text, F.lit(""))).drop(
        "_wide", "_minus", "_s", "_e", "wide_id"
    )


def short_regions(
    regions: DataFrame, genome: Genome, name: str = "seq", strand: Column | None = None
) -> DataFrame:
    """Sequence of regions (contig, start, end) known to be at most `pad` long, read along
    `strand` where it is given.

    A negative start is clamped, the contig end truncates, and an empty interval
    or unknown contig gives an empty string.
    """
    start = F.greatest(F.col("start"), F.lit(0))
    out = _piece(genome, regions, start, F.col("end"), strand)
    return out.withColumnRenamed("_text", name)


def with_rows(regions: DataFrame, genome: Genome) -> DataFrame:
    """Regions (contig, start, end) known to be at most `pad` long, with the genome row `_wide`
    that holds them and their place `_offset` and `_size` in it; unknown contigs drop out."""
    begin = F.greatest(F.col("start"), F.lit(0))
    located = regions.withColumn("wide_id", F.floor(begin / genome.width))
    joined = located.join(genome.table.withColumnRenamed("seq", "_wide"), ["contig", "wide_id"])
    return joined.withColumn("_offset", (begin - F.col("wide_id") * genome.width).cast("int")).withColumn(
        "_size", (F.col("end") - begin).cast("int")).drop("wide_id")


def longer_than_pad(genome: Genome) -> Column:
    """Whether a region (start, end) needs several rows of the genome."""
    length = F.col("end") - F.greatest(F.col("start"), F.lit(0))
    return F.coalesce(length > genome.pad, F.lit(False))


def long_regions(
    regions: DataFrame, genome: Genome, keys: list[str], name: str = "seq"
) -> DataFrame:
    """Sequence of regions longer than `pad`, glued from pieces; `keys` identify a region."""
    start = F.greatest(F.col("start"), F.lit(0))
    length = F.col("end") - start
    cut = regions.withColumn(
        "_piece", F.explode(F.sequence(F.lit(0), F.floor((length - 1) / genome.pad).cast("int")))
    )
    first = start + F.col("_piece") * genome.pad
    pieces = _piece(genome, cut, first, F.least(first + genome.pad, F.col("end")))
    rest = [c for c in regions.columns if c not in keys]
    return pieces.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in rest],
        F.array_sort(F.collect_list(F.struct("_piece", "_text"))).alias("_parts"),
    ).withColumn(name, F.array_join(F.col("_parts._text"), "")).drop("_parts")


def region_sequences(
    regions: DataFrame, genome: Genome, keys: list[str], name: str = "seq"
) -> DataFrame:
    """Sequence of regions of any length; `keys` identify a region.  Only the
    regions longer than `pad` pay the shuffle that glues their pieces."""
    short = short_regions(regions.where(~longer_than_pad(genome)), genome, name)
    glued = long_regions(regions.where(longer_than_pad(genome)), genome, keys, name)
    return short.unionByName(glued.select(short.columns))


def contigs(chunks: DataFrame) -> DataFrame:
    return chunks.select("contig").distinct()


def resolved_contig(regions: DataFrame, known: DataFrame, chrom: str = "chr") -> DataFrame:
    """Adds `contig`: the name as it is in the genome, else its accession alias,
    else null.  `known` has one row per contig of the genome."""
    aliases = F.array_compact(F.array(F.col(chrom), F.try_element_at(
        literal_map(CONTIG_ALIAS), F.col(chrom))))
    # resolve each distinct name once: a few dozen names, not one per region
    names = regions.select(chrom).where(F.col(chrom).isNotNull()).distinct()
    found = (
        names.select(chrom, F.posexplode(aliases).alias("_pos", "contig"))
        .join(known, "contig")
        .groupBy(chrom).agg(F.min(F.struct("_pos", "contig"))["contig"].alias("contig"))
    )
    # no larger than the genome's own list of contigs and their aliases
    return regions.join(F.broadcast(found), chrom, "left")


# -- one-off conversion of an indexed FASTA -----------------------------------------
def read_fai(spark: SparkSession, fai: str) -> DataFrame:
    """The index: contig, length, byte offset, bases and bytes per line."""
    return spark.read.csv(
        fai, sep="\t",
        schema="contig string, length bigint, offset bigint, bases int, bytes int",
    )


def read_fasta(spark: SparkSession, fasta: str, fai: str, chunk_nt: int = 4096) -> DataFrame:
    """Chunk table of an indexed FASTA.  Every task seeks to its own byte ranges, so
    a contig is never held whole.  `fasta` is a path or URI that every executor can
    open (local mount, hdfs://, s3://)."""
    index = read_fai(spark, fai)
    starts = index.withColumn(
        "chunk_id",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("length") - 1) / chunk_nt))),
    ).repartition("contig", F.floor(F.col("chunk_id") / 1024))

    def seek_read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, path = FileSystem.from_uri(re.sub("^file:/+", "/", fasta))
        with files.open_input_file(path) as handle:
            for batch in batches:
                out = []
                for row in batch.itertuples(index=False):
                    lo = row.chunk_id * chunk_nt
                    hi = min(lo + chunk_nt, row.length)
                    begin = row.offset + lo // row.bases * row.bytes + lo % row.bases
                    stop = row.offset + (hi - 1) // row.bases * row.bytes + (hi - 1) % row.bases
                    handle.seek(begin)
                    text = handle.read(stop - begin + 1).decode("ascii")
                    out.append("".join(text.split()).upper())
                yield pd.DataFrame(
                    {"contig": batch["contig"], "chunk_id": batch["chunk_id"], "seq": out}
                )

    return starts.mapInPandas(seek_read, "contig string, chunk_id bigint, seq string")
