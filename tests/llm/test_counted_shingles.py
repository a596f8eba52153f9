"""The order from rare to common counts every text."""

import re

import numpy as np
from pyspark.sql import functions as F

from isoscope.llm import darts, passages
from isoscope.llm.arrays import U, blocks, shingles
from isoscope.llm.packed import slot_counts


def _docs(spark, n=300):
    """Texts of 40 words of their own; those that a sample by hash leaves out also hold ten equal ones."""
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 10**6, 40))) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    left_out = F.pmod(F.xxhash64("doc_id"), F.lit(8)) != 0
    same = " ".join(f"same{j}" for j in range(10))
    return docs.withColumn("text", F.when(left_out, F.concat_ws(" ", "text", F.lit(same))).otherwise(F.col("text"))), same


def _hashes(texts):
    import pyarrow as pa
    return np.concatenate([shingles(b)[0] for b in blocks(pa.array(texts))])


def test_passages_count_the_shingles_of_every_text(spark):
    docs, same = _docs(spark)
    classes = passages.commonness(docs)
    own = classes[(_hashes([same]) & U(passages.SLOTS - 1)).astype(np.int64)]
    every = classes[(_hashes([r["text"] for r in docs.collect()]) & U(passages.SLOTS - 1)).astype(np.int64)]
    assert len(own) == 6 and own.min() > np.median(every)


def test_near_dedup_counts_the_shingles_of_every_text(spark):
    docs, _ = _docs(spark)
    counts = darts.shingle_counts(docs.select("doc_id"), docs)
    assert counts.sum() == len(_hashes([r["text"] for r in docs.collect()]))


def test_counters_are_summed_over_tasks(spark):
    docs, _ = _docs(spark, 40)
    hashes = _hashes([r["text"] for r in docs.collect()])
    for n in (1, 3):
        got = slot_counts(docs.repartition(n).select("text"), lambda c: (shingles(b)[0] for b in blocks(c)), 1 << 10)
        assert (got == np.bincount((hashes & U(1023)).astype(np.int64), minlength=1 << 10)).all()
    assert slot_counts(docs.limit(0), lambda c: (shingles(b)[0] for b in blocks(c)), 1 << 10).sum() == 0
