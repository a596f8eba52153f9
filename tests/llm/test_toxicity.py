"""The toxicity classifier: features and ratios by definition, held-out accuracy."""

import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from isoscope.llm import queries, toxicity
from isoscope.llm.arrays import blocks

SF = "/root/testdata/sf0.1"
MASK = (1 << 64) - 1


def plain_slots(text):
    """Slots of the distinct 3-, 4- and 5-grams, one n-gram at a time."""
    points = [ord(c) + 32 if "A" <= c <= "Z" else ord(c) for c in text]
    out = set()
    for size in toxicity.SIZES:
        for i in range(len(points) - size + 1):
            total = size * 0xE7037ED1A0B428DB
            total += sum(p * m for p, m in zip(points[i:i + size], toxicity.MULTIPLIERS))
            total &= MASK
            total ^= total >> 29
            out.add((total * toxicity.MULTIPLIERS[0] & MASK) >> (64 - toxicity.BITS))
    return sorted(out)


def slots(texts):
    return [s for b in blocks(pa.array(texts, pa.string())) for s in toxicity.slots_of(b)]


def test_slots_by_definition():
    texts = ["", "ab", "Hello hello", "ÀÉ straße 中文字 \U0001f600\U0001f600x", None, "a" * 50]
    assert [s.tolist() for s in slots(texts)] == [plain_slots(t or "") for t in texts]


def test_ratios_by_definition():
    docs = [[1, 2, 3], [1, 2], [2, 9], [3, 9, 1]]
    y = np.array([1, 1, 0, 0])
    flat, row = np.concatenate(docs), np.repeat(np.arange(4), [3, 2, 2, 3])
    got = toxicity.log_count_ratios(flat, row, y)
    for s in range(12):
        p, q = (1 + sum(s in d for d, c in zip(docs, y) if c == k) for k in (1, 0))
        ratio = math.log((p / (5 + (1 << toxicity.BITS))) / (q / (5 + (1 << toxicity.BITS))))
        used = p + q > 3 and abs(ratio) >= toxicity.WEAK
        assert math.isclose(got[s], ratio if used else 0.0, abs_tol=1e-12)


@pytest.fixture(scope="module")
def scores(spark):
    return {r["doc_id"]: r for r in queries.op11_toxicity(spark, SF).collect()}


def test_held_out_accuracy(spark, scores):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("toxic is not null").collect()
    held = [r for r in labels if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert all(scores[r["doc_id"]]["held_out"] for r in held)
    toxic = [scores[r["doc_id"]] for r in held if r["toxic"] == 1]
    clean = [scores[r["doc_id"]] for r in held if r["toxic"] == 0]
    assert len(toxic) > 50 and len(clean) > 500
    # half of the toxic texts of this table use no word that the 300 toxic ones learnt from repeat
    above = np.array([[t["score"] > c["score"] for c in clean] for t in toxic])
    assert above.mean() >= 0.92
    assert sum(r["predicted"] for r in toxic) >= 0.5 * len(toxic)
    assert sum(r["predicted"] for r in clean) <= 0.005 * len(clean)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in scores.values())


def test_every_document_once(spark, scores):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert docs.count() == len(scores)
    empty = {r["doc_id"] for r in docs.where("coalesce(text, '') = ''").collect()}
    assert len({scores[i]["score"] for i in empty}) <= 1


def test_labels_of_the_held_out_fold_and_other_columns_are_never_read(spark):
    small = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    turned = labels.withColumn(
        "toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    renamed = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("yy")})
    want = sorted(map(tuple, toxicity.classified(docs, labels).collect()))
    assert sorted(map(tuple, toxicity.classified(renamed, turned.repartition(5)).collect())) == want
    assert [r[1] for r in want] == [zlib.crc32(str(r[0]).encode()) % 3 == 1 for r in want]


def test_odd_tables(spark, odd, empty):
    labels = spark.createDataFrame(
        [(1, 0, "x"), (1, 1, "x"), (2, 0, "x"), (3, 0, None), (4, 1, "x"), (5, 0, "x"), (6, 0, "x"),
         (7, 1, "x"), (8, 0, "x"), (None, 1, "x"), (9, None, "x"), (77, 1, "x")],
        "doc_id bigint, toxic int, text string")
    rows = toxicity.classified(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.classified(empty, labels).count() == 0
    sample = toxicity.labelled_sample(odd, labels).collect()
    assert len({r["doc_id"] for r in sample}) == len(sample)
    assert {r["toxic"] for r in sample if r["doc_id"] == 1} <= {1}
    none = toxicity.classified(odd, labels.limit(0)).collect()
    assert {(r["score"], r["predicted"]) for r in none} == {(0.0, 0)}
    wide = odd.withColumn("score", F.lit("mine"))
    model = toxicity.fit(odd, labels)
    assert dict(toxicity.scored(wide, model).dtypes)["score"] == "double"


def test_the_sample_is_bounded(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = toxicity.labelled_sample(docs, labels, 20)
    assert got.groupBy("toxic").count().where("count > 20").count() == 0
    assert got.count() == 40
