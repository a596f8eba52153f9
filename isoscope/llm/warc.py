"""WARC archives: writing with segments and revisits, reading with reassembly.

Spark writes and reads the files, so any store it reaches will do.  A response carries
an HTTP message in chunked transfer framing; a block above the segment size continues
in `continuation` records.  Equal payloads are stored once: the others are `revisit`
records that refer to it.  The reader cuts records by their Content-Length, groups the
segments of an origin, orders them, verifies the total length and decodes the chunks.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoscope.plans.lineage import materialize, scratch_path

SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4_096
BLOCK_BYTES = 4 << 20  # records are handed to the writer in blocks of about this size
BLOCKS_PER_FILE = 4
END = b"\r\n\r\n"
DATE = "2026-01-01T00:00:00Z"


# -- writing -------------------------------------------------------------------------
def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [payload[i:i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def record(kind: str, fields: dict[str, object], block: bytes) -> bytes:
    head = {"WARC-Type": kind, **fields, "Content-Length": len(block)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block


def records_of(uid: int, page_id, url, payload: bytes, refers_to, segment: int) -> list[bytes]:
    """The record of one page, or its segments; without the closing empty lines."""
    name = "" if page_id is None else page_id
    common = {
        "WARC-Record-ID": f"<urn:page:{name}:{uid}>", "WARC-Date": DATE,
        "WARC-Target-URI": None if url is None else "".join(url.split()),
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "Content-Type": "application/http; msgtype=response",
    }
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        block = http + b"Content-Length: %d\r\n\r\n" % len(payload)
        return [record("revisit", common | {
            "WARC-Profile":
                "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            "WARC-Refers-To": f"<urn:page:{refers_to}>"}, block)]
    block = http + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment:
        return [record("response", common, block)]
    parts = [block[i:i + segment] for i in range(0, len(block), segment)]
    out = [record("response", common | {"WARC-Segment-Number": 1}, parts[0])]
    for n, part in enumerate(parts[1:], 2):
        out.append(record("continuation", {
            "WARC-Record-ID": f"<urn:page:{name}:{uid}:{n}>", "WARC-Date": DATE,
            "WARC-Segment-Origin-ID": common["WARC-Record-ID"], "WARC-Segment-Number": n,
            "WARC-Segment-Total-Length": len(block) if n == len(parts) else None}, part))
    return out


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to): of equal payloads of at least `least_bytes`
    bytes the one with the largest page_id is kept and the others refer to it.

    Only repeated digests are joined back; that table is written first, so Spark knows
    its size and broadcasts it only when it is small.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = pages.select("page_id", "url", payload.alias("payload"))
    repeated = materialize(
        pages.select("page_id", F.sha1(payload).alias("sha"), F.octet_length(payload).alias("n"))
        .where(F.col("n") >= least_bytes)
        .groupBy("sha").agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1 AND kept IS NOT NULL").select("sha", "kept"), "repeated-payloads")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept"))
    return own.withColumn("sha", F.sha1("payload")).join(repeated, "sha", "left").select(
        "page_id", "url", "payload", refers.alias("refers_to"))


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT_BYTES,
                   least_bytes: int = 0) -> None:
    """One or more gzip-compressed WARC files per task under `path`.

    Null html is an empty payload.  Repeated page_ids get records of their own."""
    rows = with_revisits(pages, least_bytes).withColumn("uid", F.monotonically_increasing_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c, i=i: batch.column(c)[i].as_py()  # noqa: E731, B023
                made = records_of(get("uid"), get("page_id"), get("url"), get("payload"),
                                  get("refers_to"), segment)
                held += made
                size += sum(map(len, made))
                if size >= BLOCK_BYTES:
                    yield pa.record_batch([pa.array([END.join(held)], pa.binary())], ["value"])
                    held, size = [], 0
        if held:
            yield pa.record_batch([pa.array([END.join(held)], pa.binary())], ["value"])

    # the text writer passes the bytes of a string on as they are
    blocks = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    (blocks.write.option("lineSep", END.decode()).option("compression", "gzip")
     .option("maxRecordsPerFile", BLOCKS_PER_FILE).text(path))


# -- reading -------------------------------------------------------------------------
RECORDS = ("kind string, record_id string, origin string, segment int, total bigint, "
           "refers_to string, digest string, block binary")


def parse(data: bytes) -> Iterator[tuple]:
    """Records of one archive, cut by Content-Length."""
    if data[:2] == b"\x1f\x8b":
        out = []
        while data[:2] == b"\x1f\x8b":  # one member for the file, or one per record
            member = zlib.decompressobj(31)
            out.append(member.decompress(data))
            data = member.unused_data
        data = b"".join(out)
    at = data.find(b"WARC/")
    while at >= 0:
        stop = data.index(END, at)
        head = {}
        for line in data[at:stop].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            head[name.strip().lower()] = value.strip().decode()
        start, size = stop + 4, int(head[b"content-length"])
        block = data[start:start + size]
        if len(block) != size:
            raise ValueError("truncated WARC record")
        segment, total = head.get(b"warc-segment-number"), head.get(b"warc-segment-total-length")
        yield (head[b"warc-type"], head[b"warc-record-id"],
               head.get(b"warc-segment-origin-id", head[b"warc-record-id"]),
               int(segment) if segment else None, int(total) if total else None,
               head.get(b"warc-refers-to"), head.get(b"warc-payload-digest"), block)
        at = data.find(b"WARC/", start + size)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(),
             pa.string(), pa.binary()]
    names = [f.split()[0] for f in RECORDS.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for row in parse(content.as_py()):
                    rows.append(row)
                    size += len(row[-1])
                    if size > BLOCK_BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, RECORDS)


def unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        stop = body.index(b"\r\n", at)
        size = int(body[at:stop].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[stop + 2:stop + 2 + size])
        if len(out[-1]) != size or body[stop + 2 + size:stop + 4 + size] != b"\r\n":
            raise ValueError("broken chunk")
        at = stop + 4 + size


def http_payload(block: bytes) -> tuple[bytes, int | None]:
    """Decoded body, and the Content-Length header where there is one."""
    head, _, body = block.partition(END)
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower()] = value.strip().lower()
    if fields.get(b"transfer-encoding") == b"chunked":
        body = unchunked(body)
    size = fields.get(b"content-length")
    return body, int(size) if size else None


PAGES = ("page_id bigint, payload binary, payload_bytes bigint, payload_digest string, "
         "record_type string, refers_to bigint")


def reassembled(records: DataFrame) -> DataFrame:
    """(record_id, kind, refers_to, digest, block): continuations joined to their origin.

    Only segmented records are shuffled, by origin.  Missing or surplus segments and a
    wrong total length stop the job."""
    whole = records.where("segment IS NULL").select(
        "record_id", "kind", "refers_to", "digest", "block")
    part = F.struct("segment", "block", "total", "kind", "record_id", "digest")
    parts = records.where("segment IS NOT NULL").groupBy("origin").agg(
        F.array_sort(F.collect_list(part)).alias("parts"))
    first, last = F.col("parts")[0], F.element_at("parts", -1)
    n = F.size("parts")
    # binary has no array_join; concatenation goes through a fold
    block = F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["block"]))
    good = ((first["segment"] == 1) & (last["segment"] == n)
            & last["total"].eqNullSafe(F.octet_length(block).cast("bigint")))
    joined = parts.select(
        first["record_id"].alias("record_id"), first["kind"].alias("kind"),
        F.lit(None).cast("string").alias("refers_to"), first["digest"].alias("digest"),
        F.when(good, block).otherwise(
            F.raise_error(F.concat(F.lit("incomplete WARC record "), "origin")).cast("binary"))
        .alias("block"))
    return whole.unionByName(joined)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of the archives under `path`; a revisit has a null payload, its length comes
    from its HTTP header and its digest from the record header."""

    def number(name: str | None) -> int | None:
        page = name.strip("<>").split(":")[2] if name else ""
        return int(page) if page else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                payload, size = http_payload(r["block"])
                stated = (r["digest"] or "").removeprefix("sha1:")
                if r["kind"] == "revisit":
                    rows.append((number(r["record_id"]), None, size, stated, "revisit",
                                 number(r["refers_to"])))
                else:
                    if stated and digest(payload) != stated:
                        raise ValueError(f"payload digest of {r['record_id']} differs")
                    rows.append((number(r["record_id"]), payload, len(payload), digest(payload),
                                 r["kind"], None))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            types = [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                [f.split()[0] for f in PAGES.split(", ")])

    return reassembled(read_records(spark, path)).mapInArrow(run, PAGES)


def round_trip(pages: DataFrame, segment: int = SEGMENT_BYTES) -> DataFrame:
    """Write archives into the shared folder and read every page back."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, segment)
    return read_pages(pages.sparkSession, path).drop("payload")
