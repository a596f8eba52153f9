"""Links of crowded buckets do not rest on the choice of pivots."""

import numpy as np
from pyspark.sql import functions as F

from isoscope.llm import darts


def _rows(texts):
    return [(i, " ".join(w)) for i, w in enumerate(texts)]


def test_no_link_of_a_crowded_bucket_rests_on_its_pivots(spark, monkeypatch):
    """40 variants below the threshold, every tenth with a near copy; the rounds tie nothing."""
    rng = np.random.default_rng(3)
    base, texts = [f"w{x}" for x in rng.integers(0, 5000, 240)], []
    for _ in range(40):
        own = list(base)
        for at in rng.choice(240, 9, replace=False):
            own[at] = f"v{rng.integers(0, 50_000)}"
        texts.append(own)
    for i in range(5, 40, 10):
        own = list(texts[i])
        for at in rng.choice(240, 2, replace=False):
            own[at] = f"x{rng.integers(0, 50_000)}"
        texts.append(own)
    rule = darts.meeting_pairs
    monkeypatch.setattr(darts, "CROWD", 1)  # every bucket is a crowded one
    monkeypatch.setattr(darts, "meeting_pairs", lambda rows, crowd=darts.CROWD, salt=0: rule(
        rows.where(F.lit(False)), crowd, salt))
    # no tie to the ends of a bucket either
    monkeypatch.setattr(darts, "bucket_links", lambda shared: shared.sparkSession.createDataFrame(
        [], "a bigint, b bigint"))
    docs = spark.createDataFrame(_rows(texts), "doc_id bigint, text string")
    got = {r["doc_id"]: r["class_id"] for r in darts.classes(docs).collect()}
    assert got == {i: i for i in range(40)} | {40 + k: 5 + 10 * k for k in range(4)}


def test_remaining_pairs_are_all_pairs_between_classes(spark, monkeypatch):
    monkeypatch.setattr(darts, "PART", 3)
    buckets = {1: range(30), 2: [3, 4, 40], 3: [7, 10]}
    of = lambda d: d % 3 if d < 20 else d
    rows = spark.createDataFrame([(k, d, of(d), len(ds)) for k, ds in buckets.items() for d in ds],
                                 "key bigint, doc_id bigint, class bigint, n bigint")
    got = [tuple(r) for r in darts.remaining_pairs(rows).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(a, b) for ds in buckets.values() for a in ds for b in ds if a > b and of(a) != of(b)}


def _content(spark, texts, counts=None):
    docs = spark.createDataFrame(_rows(texts), "doc_id bigint, text string")
    own = spark.createDataFrame([(i, i) for i in range(len(texts))], "doc_id bigint, class bigint")
    return darts.content_buckets(own, docs, counts=counts)


def _similar(texts):
    of = lambda w: np.array([hash(tuple(w[i:i + 5])) for i in range(len(w) - 4)])
    found = [of(w) for w in texts]
    return {(a, b) for a in range(len(texts)) for b in range(a)
            if darts.weighted_jaccard(found[a], found[b]) >= darts.SIMILARITY}


def test_a_common_passage_alone_makes_no_pairs(spark):
    """200 texts that share 120 of their 300 words and nothing else: all pairs are 19900."""
    rng = np.random.default_rng(5)
    passage = [f"p{x}" for x in range(120)]
    texts = [passage + [f"w{x}" for x in rng.integers(0, 50_000, 180)] for _ in range(200)]
    texts.append([*texts[7][:-3], "x1", "x2", "x3"])
    content = _content(spark, texts)
    assert {tuple(r) for r in darts.remaining_pairs(content).collect()} == {(200, 7)} == _similar(texts)


def test_no_order_of_shingles_loses_a_similar_pair(spark):
    """Texts of several lengths with repeats, cut and edited; good, bad and no counters."""
    rng = np.random.default_rng(6)
    texts = []
    for n in (30, 60, 200, 400):
        base = [f"w{x}" for x in rng.integers(0, 40, n)] + ["again"] * 12
        for _ in range(12):
            own = base[:len(base) - int(rng.integers(0, n // 6))]
            for at in rng.choice(len(own), int(rng.integers(0, 3 + n // 60)), replace=False):
                own[at] = f"v{rng.integers(0, 9)}"
            texts.append(own)
    want = _similar(texts)
    assert 50 < len(want) < 1000
    drawn = rng.integers(0, 50, darts.SLOTS).astype(np.int32)
    for counts in (None, np.zeros(darts.SLOTS, np.int32), drawn):
        got = {tuple(r) for r in darts.remaining_pairs(_content(spark, texts, counts)).collect()}
        assert want <= got
