"""Reading the caller's per-type TSV tables into the fixed event schema.

A small job reads the first line of every file, one task per file.  Files with the same
logical name and header are one layout and get one reader with a fixed schema of text
cells, so type, mode and column positions are constants of its plan; the event table is the
union of these scans: no join on the path, no shuffle, and only mapped columns are parsed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isoscope.functions import catalogue as cat


# -- names and headers --------------------------------------------------------
def counting_mode(name: Column) -> Column:
    strict = F.regexp_extract(name, cat.MATS_NAME, 2)
    loose = F.try_element_at(F.regexp_extract_all(name, F.lit(cat.MODE_TOKEN), F.lit(1)), F.lit(-1))
    return F.upper(F.when(strict != "", strict).otherwise(loose))


def event_type(name: Column, header: Column) -> Column:
    """Type from an unambiguous file name, else from the header family, else from
    the last loose token of the name.  A null header skips the header rule."""
    mats = F.regexp_extract(name, cat.MATS_NAME, 1)
    gtf = F.regexp_extract(name, cat.FROM_GTF_NAME, 1)
    tokens = F.transform(
        F.regexp_extract_all(name, F.lit(cat.TYPE_TOKEN), F.lit(1)), lambda t: F.upper(t)
    )
    alt_tokens = F.filter(tokens, lambda t: t.isin("A3SS", "A5SS"))
    family = lambda key: F.coalesce(
        F.arrays_overlap(header, F.array(*[F.lit(c) for c in cat.HEADER_FAMILY[key]])),
        F.lit(False),
    )
    last = lambda arr: F.try_element_at(arr, F.lit(-1))
    return (
        F.when(mats != "", F.upper(mats))
        .when(gtf != "", F.upper(gtf))
        .when(family("RI"), "RI")
        .when(family("MXE"), "MXE")
        .when(family("ALT"), last(alt_tokens))
        .when(family("SE"), "SE")
        .otherwise(last(tokens))
    )


def header_fields(line: Column) -> Column:
    """Trimmed tab-separated names of a header line, byte-order mark removed."""
    clean = F.regexp_replace(line, "^﻿+|\r+$", "")
    return F.transform(F.split(clean, "\t"), lambda c: F.trim(F.regexp_replace(c, '"', "")))


def logical_name(path: Column) -> Column:
    """File name; for a table written by Spark, the name of its folder."""
    plain = F.url_decode(F.regexp_replace(path, r"\+", "%2B"))
    parts = F.split(plain, "/")
    last = F.element_at(parts, -1)
    return F.when(last.startswith("part-"), F.try_element_at(parts, F.lit(-2))).otherwise(last)


# -- files and layouts ------------------------------------------------------------
HEAD_BYTES = 1 << 16  # read at a time while looking for the end of a first line


def first_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, header_line) of every file; null for an empty one.

    Each file is opened by one task and read up to its first line end (compressed ones
    too).  Every executor must be able to open the paths (mount, hdfs://, s3://, gs://).
    """
    # without its content column this source only lists the files
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column("path").to_pylist():
                system, name = FileSystem.from_uri(re.sub("^file:/+", "/", path))
                with system.open_input_stream(name, compression="detect") as stream:
                    head = b""
                    while b"\n" not in head and (more := stream.read(HEAD_BYTES)):
                        head += more
                line = head.split(b"\n")[0].removesuffix(b"\r").decode("utf-8-sig", "replace")
                found.append(line if head else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("path"), pa.array(found, pa.string())], ["path", "header_line"])

    return files.select("path").mapInArrow(read, "path string, header_line string")


def headers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per non-empty file: name, header fields, detected type and mode."""
    first = first_lines(spark, paths).where(F.col("header_line").isNotNull())
    return first.select(
        "path", "header_line", logical_name(F.regexp_replace("path", "%", "%25")).alias("name"),
        header_fields(F.col("header_line")).alias("header"),
    ).select(
        "*",
        event_type(F.col("name"), F.col("header")).alias("event_type"),
        counting_mode(F.col("name")).alias("counting_mode"),
    )


class Layout(NamedTuple):
    """Files of one logical name and one header."""

    name: str
    header: list[str]
    event_type: str
    counting_mode: str | None
    paths: list[str]


def layouts(spark: SparkSession, paths: list[str]) -> list[Layout]:
    """The layouts of the recognised files, by name.  A reader is given its files by name,
    so their list is here, as it is in any file reader; never a line of their data."""
    known = headers(spark, paths).where(F.col("event_type").isNotNull())
    grouped = known.groupBy("name", "header", "event_type", "counting_mode").agg(
        F.sort_array(F.collect_list("path")).alias("paths"))
    return [Layout(*row) for row in sorted(grouped.collect(), key=lambda r: (r["name"], r["header"]))]


def _union(spark: SparkSession, layouts_: list[Layout], columns, ddl: str) -> DataFrame:
    """One scan per layout, projected by `columns(layout)` (SQL expressions over c0, c1 …)."""
    text = lambda v: "CAST(NULL AS STRING)" if v is None else "'" + re.sub(r"(['\\])", r"\\\1", v) + "'"
    whole = None
    for layout in layouts_:
        schema = ", ".join(f"c{i} string" for i in range(len(layout.header)))
        lines = spark.read.schema(schema).csv(layout.paths, sep="\t", header=True, quote="", escape="")
        scan = lines.selectExpr(
            "_metadata.file_path AS path", f"{text(layout.name)} AS name",
            f"{text(layout.event_type)} AS event_type", f"{text(layout.counting_mode)} AS counting_mode",
            *columns(layout))
        whole = scan if whole is None else whole.unionByName(scan)
    return spark.createDataFrame([], ddl) if whole is None else whole


def _cell(raw: Column) -> Column:
    """A cell without quotes; null tokens are null."""
    bare = F.btrim(raw, F.lit('"'))
    return F.when(~bare.isin(*cat.NULL_TOKENS), bare)


FILE = "path string, name string, event_type string, counting_mode string"


def raw_cells(spark: SparkSession, paths: list[str], found: list[Layout] | None = None) -> DataFrame:
    """Data rows of recognised files as `cells` (array) next to the `slots` of their layout.

    Nothing is inferred: every cell is text, quotes are stripped and the null
    tokens become null.  Files without data rows simply contribute none.
    """
    def columns(layout: Layout) -> list[str]:
        slots = ", ".join(str(s) if s is not None else "CAST(NULL AS INT)" for s in _slots(layout.header))
        cells = ", ".join(f"c{i}" for i in range(len(layout.header)))
        return [f"array({slots}) AS slots", f"array({cells}) AS cells"]

    rows = _union(spark, layouts(spark, paths) if found is None else found, columns,
                  f"{FILE}, slots array<int>, cells array<string>")
    return rows.withColumn("cells", F.transform("cells", _cell))


# -- projection -------------------------------------------------------------------
def _slots(header: list[str]) -> list[int | None]:
    """Per internal name the 0-based position of the first header (in header order) that
    maps to it."""
    return [next((i for i, raw in enumerate(header) if raw in accepted), None)
            for accepted in cat.RAW_HEADERS.values()]


def renamed(cells: DataFrame) -> DataFrame:
    """Internal text columns of cell arrays; unknown columns and the second `ID` disappear."""
    return cells.select(
        "path", "name", "event_type", "counting_mode",
        *[F.get("cells", F.get("slots", F.lit(i))).alias(c)
          for i, c in enumerate(cat.RAW_HEADERS)],
    )


def text_columns(spark: SparkSession, paths: list[str], found: list[Layout] | None = None) -> DataFrame:
    """What `renamed` makes of `raw_cells`, straight from the scans: only the mapped cells that
    a query needs are parsed."""
    columns = lambda layout: [
        f"{'CAST(NULL AS STRING)' if slot is None else f'c{slot}'} AS {c}"
        for c, slot in zip(cat.RAW_HEADERS, _slots(layout.header), strict=True)]
    rows = _union(spark, layouts(spark, paths) if found is None else found, columns,
                  ", ".join([FILE, *[f"{c} string" for c in cat.RAW_HEADERS]]))
    return rows.withColumns({c: _cell(F.col(c)) for c in cat.RAW_HEADERS})


def as_integer(cell: Column, kind: str) -> Column:
    """Whole numbers; `12.0` counts as 12, a fraction or anything else as null."""
    number = cell.try_cast("double")
    whole = F.when(number == F.floor(number), number)
    return F.when(cell.rlike(r"^\s*[+-]?\d+\s*$"), cell.try_cast(kind)).otherwise(
        whole.try_cast(kind))


def as_double(cell: Column) -> Column:
    """Doubles with a decimal point or comma; NaN is a missing value."""
    value = F.regexp_replace(cell, ",", ".").try_cast("double")
    return F.when(~F.isnan(value), value)


def coerced(text: DataFrame) -> DataFrame:
    return text.withColumns(
        {c: as_integer(F.col(c), "bigint") for c in cat.LONG_COLUMNS}
        | {c: as_integer(F.col(c), "int") for c in cat.INT_COLUMNS}
        | {c: as_double(F.col(c)) for c in cat.DOUBLE_COLUMNS}
    )


def located(events: DataFrame) -> DataFrame:
    """Drop rows whose type-specific coordinates are all null."""
    any_known = F.lit(True)
    for kind, names in cat.REQUIRED_COORDS.items():
        known = F.coalesce(*[F.col(n) for n in names]).isNotNull()
        any_known = F.when(F.col("event_type") == kind, known).otherwise(any_known)
    return events.where(any_known)


def with_generic_alt_site(events: DataFrame) -> DataFrame:
    """For A3SS/A5SS: exon = long exon; the flanking exon goes to the low or high
    side by position."""
    alt = F.col("event_type").isin("A3SS", "A5SS")
    low = F.col("flanking_ee") <= F.col("long_exon_start")
    fill = {
        "exon_start": F.col("long_exon_start"),
        "exon_end": F.col("long_exon_end"),
        "upstream_es": F.when(low, F.col("flanking_es")),
        "upstream_ee": F.when(low, F.col("flanking_ee")),
        "downstream_es": F.when(~low, F.col("flanking_es")),
        "downstream_ee": F.when(~low, F.col("flanking_ee")),
    }
    return events.withColumns(
        {c: F.when(alt, v).otherwise(F.col(c)) for c, v in fill.items()}
    )


def stamped(events: DataFrame, analysis_id: str) -> DataFrame:
    """Provenance: analysis, absolute effect, and a key that is the same on every
    run (identity + counting mode + caller id) instead of a random one."""
    return events.withColumns({
        "analysis_id": F.lit(analysis_id),
        "abs_inc_level_diff": F.abs("inc_level_difference"),
        "event_id": F.sha2(
            F.to_json(F.struct(
                F.lit(analysis_id).alias("a"), *cat.IDENTITY_COLUMNS, "counting_mode", "caller_id",
                "name",
            )),
            256,
        ),
    })


def read_events(
    spark: SparkSession, paths: list[str], analysis_id: str, found: list[Layout] | None = None
) -> DataFrame:
    """All recognised files as one event table (the columns a file lacks are null)."""
    typed = coerced(text_columns(spark, paths, found))
    return stamped(with_generic_alt_site(located(typed)), analysis_id)


def has_count_columns(
    spark: SparkSession, paths: list[str], found: list[Layout] | None = None
) -> bool:
    """Whether the combined input carries the four count columns at all."""
    known = layouts(spark, paths) if found is None else found
    present = {c for layout in known for c in layout.header}
    return {"IJC_SAMPLE_1", "SJC_SAMPLE_1", "IJC_SAMPLE_2", "SJC_SAMPLE_2"} <= present
