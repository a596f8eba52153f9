"""Sharding, licenses, WARC, passages and near-duplicates against plain Python."""

import base64
import gzip
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from isoscope.llm import darts, graphs, licenses, passages, sharding, warc


SF = "/root/testdata/sf0.001"


def plain(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


# -- sharding --------------------------------------------------------------------------
def draw(key, tree):
    def share(name):
        return (int(hashlib.md5(f"{key}:{name}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52

    def win(level, weights):
        return min((-math.log(share(f"{level}:{n}")) / w, n) for n, w in sorted(weights.items()))[1]

    def totals(leaves, at):
        out = defaultdict(float)
        for x in leaves:
            out[str(x[at])] += x.weight
        return out

    region = win("region", totals(tree, 0))
    inside = [x for x in tree if x.region == region]
    rack = win("rack", totals(inside, 1))
    return int(win("shard", totals([x for x in inside if x.rack == rack], 2)))


@pytest.mark.parametrize("table", ["documents", "odd"])
def test_shards_against_plain_python(request, table):
    df = request.getfixturevalue(table)
    got = sharding.sharded(df).collect()
    tree = sharding.uniform_tree()
    want = Counter()
    for i, t in plain(df):
        key = "" if i is None else i
        want[(i, len(t.encode()) + 16, zlib.crc32(t.encode()), "key", draw(key, tree),
              draw(key, sharding.grown(tree)))] += 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"])
                   for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_movement_is_confined(spark):
    keys = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    tree = sharding.uniform_tree()
    heavier = [x._replace(weight=3.0) if x.shard == 7 else x for x in tree]
    at = sharding.assign(sharding.assign(sharding.assign(
        keys, tree, F.col("k"), "a"), sharding.grown(tree), F.col("k"), "b"), heavier, F.col("k"), "c")
    rows = at.collect()
    assert all(r["a"] == r["b"] or r["b"] == 40 for r in rows)
    assert abs(sum(r["b"] == 40 for r in rows) / 20_000 - 1 / 41) < 0.005
    counts = Counter(r["a"] for r in rows)
    assert len(counts) == 40 and max(counts.values()) < 1.25 * 500 and min(counts.values()) > 0.75 * 500
    # moves stay out of subtrees whose weights did not change, except into the changed region
    assert all(r["a"] == r["c"] or r["c"] < 20 for r in rows)
    assert all(r["a"] == r["c"] or not (r["a"] < 20 and r["a"] // 5 != 1 and r["c"] // 5 != 1) for r in rows)


# -- licenses --------------------------------------------------------------------------
def base_places(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    found = [(i, label) for phrase, label in licenses.BASE
             for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
    return words, found


def kept_labels(words):
    norm = " " + " ".join(words) + " "
    found = [(m.start(), m.end(), r) for r in licenses.rules() if r.keyword in norm
             for m in re.finditer(r.pattern, norm)]
    rank = lambda d: (d[2].priority, d[1] - d[0], -d[2].order)
    kept = [a for a in found if not any(
        b[0] <= a[0] and b[1] >= a[1] and rank(b) > rank(a) for b in found)]
    return {k[2].label for k in kept}, max((k[2].confidence for k in kept), default=0.0)


@pytest.mark.parametrize("table", ["documents", "odd", "texts"])
def test_licenses_against_plain_python(request, table, spark):
    df = spark.createDataFrame([
        (1, "Licensed under the Apache License, Version 2.0. Also MIT License, mit-license!"),
        (2, "Released under the terms of the GNU General Public License v3 or later."),
        (3, "SPDX-License-Identifier: BSD-3-Clause\nCopyright (c) 2020, all rights reserved"),
        (4, "Licensed under CC BY-NC 4.0. The MIT License. the mit license"),
        (5, "the general public likes a license"), (6, None),
    ], "doc_id bigint, text string") if table == "texts" else request.getfixturevalue(table)
    got = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"],
                   r["base_labels"], r["labels"], r["score"]) for r in licenses.scanned(df).collect()), key=str)
    want = []
    for i, t in plain(df):
        words, found = base_places(t)
        at, base = [p for p, _ in found], {x for _, x in found}
        own, score = kept_labels(words) if any(g in t.lower() for g in licenses.GATE) else (set(), 0.0)
        want.append((i, len(words), len(found), min(at, default=None), max(at, default=None),
                     ",".join(sorted(base)), ",".join(sorted(base | own)), score))
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("table", ["documents", "texts"])
def test_no_rule_is_lost_at_the_gate(request, table, spark):
    texts = ["all rights\nreserved", "all-rights-reserved", "given into the public-domain", "Released under MIT",
             "released under\nthe Apache 2.0", "distributed\tunder GPL v3", "subject to the MPL 2.0",
             "Available under: Boost", "under the\nterms of the ISC", "without\nwarranty of any kind",
             "proprietary\nand confidential", "permission is hereby\ngranted free of charge",
             "copyright 2020", "SPDX license\nidentifier X11", "spdx licence", "MIT-licence", "under the table",
             "subject to change", "domain rights", "provided under WTFPL", "published under python",
             "the expat license"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string") \
        if table == "texts" else request.getfixturevalue(table)
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scanned(df).collect()}
    for i, t in plain(df):
        words, found = base_places(t)
        own, score = kept_labels(words)
        assert got[i] == (",".join(sorted(own | {x for _, x in found})), score), t[:80]
    assert table != "texts" or sum(score > 0 for _, score in got.values()) == 18


def test_rules_and_suppression(empty):
    assert len(licenses.rules()) > 200
    labels, score = kept_labels("released under the mit license".split())
    assert labels == {"mit"} and score == 0.95
    assert kept_labels("licensed under the apache license version 2 0".split())[0] == {"apache-2.0"}
    assert licenses.scanned(empty).count() == 0


# -- WARC ------------------------------------------------------------------------------
def expected_pages(rows):
    groups = defaultdict(list)
    for page, html in rows:
        groups[(html or "").encode()].append(page)
    out = []
    for payload, pages in groups.items():
        largest = max((p for p in pages if p is not None), default=None)
        for p in pages:
            revisit = len(pages) > 1 and largest is not None and p != largest
            out.append((p, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(),
                        "revisit" if revisit else "response", largest if revisit else None))
    return sorted(out, key=str)


def test_round_trip_of_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = sorted((tuple(r) for r in warc.round_trip(pages).collect()), key=str)
    assert got == expected_pages([(r["page_id"], r["html"]) for r in pages.collect()])


def test_awkward_pages(spark):
    tricky = "a\r\n\r\nWARC/1.1\r\nWARC-Type: x\r\n\r\n0\r\n\r\n" + "é" * 30_000
    rows = [(1, "u 1", tricky), (2, None, tricky), (3, "u", None), (4, "u", ""), (5, "u", "x"),
            (6, "u", "x" * 100_000), (7, "u", "x"), (7, "u", "x"), (None, "u", "x"), (8, "u", "\r\n")]
    pages = spark.createDataFrame([(*r, "z") for r in rows],
                                  "page_id bigint, url string, html string, payload string")
    got = sorted((tuple(r) for r in warc.round_trip(pages, segment=1000).collect()), key=str)
    assert got == expected_pages([(p, h) for p, _, h in rows])
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_reassembly_refuses_gaps(spark, tmp_path):
    records = warc.records_of(0, 1, "u", b"x" * 5000, None, 1000)
    whole = b"\r\n\r\n".join([*records[::-1], b""])
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.warc").write_bytes(b"".join(gzip.compress(r + b"\r\n\r\n") for r in records[::-1]))
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.warc").write_bytes(whole.replace(records[2] + b"\r\n\r\n", b""))
    (row,) = warc.read_pages(spark, str(tmp_path / "a")).collect()
    assert bytes(row["payload"]) == b"x" * 5000
    with pytest.raises(Exception, match="incomplete WARC record"):
        warc.read_pages(spark, str(tmp_path / "b")).collect()


# -- passages --------------------------------------------------------------------------
def words_of(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def exact_repeats(rows, size=50):
    """Documents that share `size` words in a row with another one, and their words."""
    seen = defaultdict(set)
    for i, text in rows:
        words = words_of(text)
        for a in range(len(words) - size + 1):
            seen[tuple(words[a:a + size])].add((i, a))
    out = defaultdict(set)
    for places in seen.values():
        if len({i for i, _ in places}) > 1:
            for i, a in places:
                out[i].update(range(a, a + size))
    return out


def covered(result):
    out = defaultdict(set)
    for r in result:
        out[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    return out


def test_passages_cover_all_exact_repeats(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = covered(passages.repeated_passages(docs).collect())
    want = exact_repeats(plain(docs))
    assert set(want) <= set(got)
    # a text that repeats itself is reported, if not always to its last period
    periodic = set()
    for i, t in plain(docs):
        words = words_of(t)
        tens = [tuple(words[a:a + 10]) for a in range(len(words) - 9)]
        if len(set(tens)) < 0.7 * len(tens):
            periodic.add(i)
    missing = {i: len(w - got[i]) for i, w in want.items() if w - got[i] and i not in periodic}
    assert not missing, missing
    # what is reported besides is similar text, not noise
    extra = sum(len(w - want.get(i, set())) for i, w in got.items())
    assert extra < 0.5 * sum(map(len, want.values()))


def assert_every_exact_repeat(docs):
    rows = [r for r in plain(docs) if r[0] is not None]
    result = passages.repeated_passages(docs).collect()
    got, repeated = covered(result), covered(r for r in result if r["repeated"])
    want = exact_repeats(rows)
    assert want and not {i: len(w - got[i]) for i, w in want.items() if w - got[i]}
    least = defaultdict(dict)  # of every exact passage the documents after the first
    for i, text in sorted(rows):
        words = words_of(text)
        for a in range(len(words) - 49):
            if least[tuple(words[a:a + 50])].setdefault("doc", i) != i:
                assert repeated[i] >= set(range(a, a + 50)), (i, a)


def test_every_exact_repeat_even_in_texts_that_repeat_themselves(spark):
    assert_every_exact_repeat(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_second_occurrence_and_copies_among_weak_variants(spark, monkeypatch):
    rng = np.random.default_rng(8)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10_000, n)]
    shared, template = word(60), word(50)
    rows = [(1, shared + word(40)), (2, shared + word(440) + shared + word(30)), (3, word(9) + shared + word(9))]
    for i in range(60):  # each far below 0.8 of the others
        variant = list(template)
        variant[15 + i % 5::9] = [f"v{i}x{n}" for n in range(len(variant[15 + i % 5::9]))]
        rows.append((10 + i, word(20) + variant + word(20)))
    rows += [(100, word(20) + template + word(20)), (101, word(33) + template + word(3))]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id bigint, text string")
    for one_task in (docs.coalesce(1), docs.repartitionByRange(8, F.col("doc_id").desc())):
        assert_every_exact_repeat(one_task)


def test_all_runs_of_the_first_document_travel_by_key():
    rng = np.random.default_rng(8)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10_000, n)]
    shared = word(60)
    texts = [shared + word(440) + shared + word(30), word(9) + shared + word(9)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([2, 3]), pa.array([" ".join(t) for t in texts])], ["doc_id", "text"])
    rows = [r for b in passages._emit(iter([batch])) for r in b.to_pylist()]
    runs = Counter(r["key"] for r in rows if r["ref"] is None and r["doc"] == 2)
    both = {r["key"] for r in rows if r["ref"] == 2}
    assert both and any(runs[k] == 2 for k in both)


def test_near_passages_and_cutting(spark):
    rng = np.random.default_rng(5)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10_000, n)]
    shared = word(150)
    changed = list(shared)
    changed[70] = "other"
    rows = [(5, " ".join(word(80) + shared + word(80))), (9, " ".join(word(30) + changed + word(40))),
            (12, " ".join(word(300))), (3, None), (None, " ".join(shared)), (20, " ".join(shared[:49])),
            (21, "")]
    docs = spark.createDataFrame([(i, t, "en", len(t or ""), 1, "x") for i, t in rows],
                                 "doc_id bigint, text string, lang string, n_chars bigint, start int, link string")
    got = {(r["doc_id"], r["repeated"]): r for r in passages.repeated_passages(docs).collect()}
    assert set(got) == {(5, False), (9, True)}
    assert (got[9, True]["start_word"], got[9, True]["end_word"]) == (30, 180)
    assert (got[5, False]["start_word"], got[5, False]["end_word"]) == (80, 230)
    cut = {r["doc_id"]: r for r in passages.without_repeats(docs).collect()}
    assert len(cut[9]["text"].split()) == 70 and cut[9]["n_chars"] == len(cut[9]["text"])
    assert cut[5]["text"] == rows[0][1] and cut[3]["text"] is None and cut[None]["link"] == "x"
    assert passages.repeated_passages(docs.limit(0)).count() == 0


def near_windows(rows):
    """(document, start, has an earlier one) of the windows of 46 shingles that share 41, the
    first and the last among them, with a window of another document."""
    shingled = {i: [tuple(t[a:a + 5]) for a in range(len(t) - 4)] for i, t in rows}
    for i, own in shingled.items():
        for j, other in shingled.items():
            held = set(other)
            shared = np.array([s in held for s in own])
            for a in range(len(own) - 45):
                if i != j and shared[a] and shared[a + 45] and shared[a:a + 46].sum() >= 41:
                    part = set(own[a:a + 46])
                    if any(sum(s in part for s in other[b:b + 46]) >= 41 for b in range(len(other) - 45)):
                        yield i, a, j < i


def test_near_passages_in_families_of_variants(spark):
    rng = np.random.default_rng(1)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10_000, n)]
    template, rows = word(50), []
    for i in range(60):  # pairs alike; each far below 0.8 of the other pairs
        variant = list(template)
        for at in (7 + i // 2 % 5 * 2, 25 + i // 2 % 7, 40 + i // 2 % 3):
            variant[at] = f"x{i // 2}y{at}"
        if i % 2:
            variant[20 + i // 2 % 4] = f"z{i}"
        rows.append((i, word(20) + variant + word(20)))
    want = list(near_windows(rows))
    assert {i for i, _, _ in want} == set(range(60))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id bigint, text string")
    for dealt in (docs.coalesce(1), docs.repartitionByRange(8, F.col("doc_id").desc())):
        result = passages.repeated_passages(dealt).collect()
        got, repeated = covered(result), covered(r for r in result if r["repeated"])
        for i, a, earlier in want:
            assert (repeated if earlier else got)[i] >= set(range(a, a + 50)), (i, a)


def test_windows_that_share_enough_share_a_least_shingle():
    rng = np.random.default_rng(4)
    classes = rng.integers(0, 4, passages.SLOTS).astype(np.uint8)
    for _ in range(200):
        own, other = (rng.integers(0, 2**63, 60 + rng.integers(0, 40)).astype(np.uint64) for _ in range(2))
        a, b = rng.integers(0, len(own) - 45), rng.integers(0, len(other) - 45)
        window = own[a:a + 46].copy()
        window[rng.choice(46, 5, replace=False)] = rng.integers(0, 2**63, 5).astype(np.uint64)
        other[b:b + 46] = rng.permutation(window)
        found = []
        for hashes, start in ((own, a), (other, b)):
            at, first, last = passages.least_shingles(hashes, np.array([0, len(hashes)]), classes)
            assert (first <= at).all() and (at <= last + 45).all() and (last <= len(hashes) - 46).all()
            inside = (at >= start) & (at < start + 46) & (first <= start) & (last >= start)
            found.append(set(hashes[at[inside]].tolist()))
        assert found[0] & found[1]


def test_compact_windows_by_definition():
    rng = np.random.default_rng(2)
    order = rng.integers(0, 50, 120).astype(np.uint64) << np.uint64(40)
    start = np.repeat([0, 70], [70, 50])
    end = np.repeat([70, 120], [70, 50])
    got = passages.compact_windows(order, start, end, 8)
    want = []
    for c in range(120):
        left = right = c
        while left > start[c] and order[left - 1] > order[c]:
            left -= 1
        while right + 1 < end[c] and order[right + 1] >= order[c]:
            right += 1
        if right - left + 1 >= 8:
            want.append((left, c, right))
    assert list(zip(got.left.tolist(), got.center.tolist(), got.right.tolist())) == want


# -- near-duplicates -------------------------------------------------------------------
def shingle_counts(text):
    w = words_of(text)
    n = min(5, len(w))
    return Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if w else Counter()


def brute_classes(rows):
    rows = [(i, t) for i, t in rows if i is not None]
    sets = [shingle_counts(t) for _, t in rows]
    label = {i: i for i, _ in rows}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    holders = defaultdict(list)
    for n, s in enumerate(sets):
        for x in s:
            holders[x].append(n)
    pairs = {(a, b) for h in holders.values() for a in h for b in h if a < b}
    pairs |= {(a, b) for a in range(len(rows)) for b in range(a) if rows[a][1] == rows[b][1]}
    for a, b in pairs:
        shared = sum((sets[a] & sets[b]).values())
        union = sum((sets[a] | sets[b]).values())
        if rows[a][1] == rows[b][1] or (union and shared >= 0.8 * union):
            x, y = sorted((root(rows[a][0]), root(rows[b][0])))
            label[y] = x
    return {i: root(i) for i in label}


def test_near_classes_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r["class_id"] for r in darts.classes(docs).collect()}
    assert got == brute_classes(plain(docs))


def test_families_of_variants_near_the_threshold(spark):
    """Variants of a few texts whose similarities spread around the threshold: many meet
    in buckets whose least and largest document are in other classes."""
    rng, rows = np.random.default_rng(5), []
    for _ in range(4):
        base = [f"w{x}" for x in rng.integers(0, 5000, 240)]
        for _ in range(40):
            words = list(base)
            for at in rng.choice(240, rng.integers(2, 9), replace=False):
                words[at] = f"v{rng.integers(0, 5000)}"
            rows.append((len(rows), " ".join(words)))
    docs = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))],
                                 "doc_id bigint, text string")
    want = brute_classes(rows)
    assert 4 < len(set(want.values())) < len(rows)
    assert {r["doc_id"]: r["class_id"] for r in darts.classes(docs).collect()} == want


def test_open_pairs_are_all_pairs_between_classes_of_a_bucket(spark):
    label = {1: 1, 2: 1, 4: 4, 5: 4, 7: 1}  # 3 and 6 have no link yet
    buckets = {10: [1, 2, 3, 4, 5], 11: [1, 2, 7], 12: [3, 6], 13: [2, 3]}
    shared = spark.createDataFrame(
        [(k, d, min(ds), max(ds)) for k, ds in buckets.items() for d in ds],
        "key bigint, doc_id bigint, lo bigint, hi bigint")
    found = darts.open_pairs(shared, spark.createDataFrame(list(label.items()), "id bigint, label bigint"))
    got = sorted(tuple(r) for r in found.select("a", "b").collect())
    of = lambda d: label.get(d, d)
    assert got == sorted({(a, b) for ds in buckets.values() for a in ds for b in ds
                          if a > b and of(a) != of(b)})


def family(rng, n, least, most, words=240):
    """Variants of one text with `least` to `most` - 1 changed words each."""
    base, out = [f"w{x}" for x in rng.integers(0, 5000, words)], []
    for _ in range(n):
        own = list(base)
        for at in rng.choice(words, rng.integers(least, most), replace=False):
            own[at] = f"v{rng.integers(0, 50_000)}"
        out.append(own)
    return out


def pairs_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(" ".join(w) for w in texts)), "doc_id bigint, text string")
    sketch = darts.sketches(docs)
    shared = darts.shared_buckets(sketch)
    rows = darts.open_buckets(shared, spark.createDataFrame([], "id bigint, label bigint"))
    crowded = rows.where(f"n > {darts.CROWD}").select("doc_id", "class").distinct()
    content = darts.content_buckets(crowded, docs)
    return darts.meeting_pairs(rows).unionByName(darts.meeting_pairs(content)).distinct().count()


def test_pairs_of_a_family_below_the_threshold_grow_with_its_size(spark):
    """Variants that are alike (about 0.6 to 0.75) but no near duplicates."""
    rng = np.random.default_rng(11)
    made = {n: pairs_of(spark, family(rng, n, 8, 13)) for n in (240, 480, 960)}
    # twice to three times the pairs of half the family (all pairs: four times); a bucket of
    # a shingle or band gives at most (CROWD - 1) / 2 pairs or three ties a row
    assert made[480] < 3 * made[240] and made[960] < 3 * made[480], made
    assert made[960] < 0.1 * 960 * 959 / 2, made


def test_links_inside_a_large_family_are_found(spark):
    """480 variants below the threshold of each other; every twelfth has near copies of its
    own, two of them or twelve, which no end of a bucket ties."""
    rng = np.random.default_rng(12)
    texts = family(rng, 480, 8, 13)
    for i in range(0, 480, 12):
        for _ in range(12 if i % 48 == 0 else 1):
            own = list(texts[i])
            for at in rng.choice(240, 2, replace=False):
                own[at] = f"x{rng.integers(0, 50_000)}"
            texts.append(own)
    order = rng.permutation(len(texts))
    rows = [(int(d), " ".join(w)) for d, w in zip(order, texts, strict=True)]
    want = brute_classes(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["class_id"] for r in darts.classes(docs).collect()}
    assert len(set(want.values())) > 300
    assert got == want


def test_near_classes_on_odd_rows(odd, empty):
    got = darts.classes(odd).collect()
    assert len(got) == odd.count()
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add(r["class_id"])
    assert by[None] == {None} and by[5] == {4} and by[1] == {1} and 2 in by[3] and 2 in by[9]
    kept = darts.one_per_class(odd)
    assert kept.columns == odd.columns and kept.where("doc_id IS NULL").count() == 1
    assert darts.classes(empty).count() == 0 and darts.one_per_class(empty).count() == 0


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    for n in (3, 40, 3000):
        pool = rng.integers(1, 2 ** 63, 2 * n, dtype=np.uint64)
        wa, wb = rng.integers(0, 4, 2 * n), rng.integers(0, 4, 2 * n)
        wb[: n] = wa[: n]
        sig = lambda w: darts.signature(pool[w > 0], w[w > 0])
        true = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
        assert abs((sig(wa) == sig(wb)).mean() - true) < 5 * math.sqrt(0.25 / darts.COORDINATES)


def test_components(spark):
    chain = [(i + 1, i) for i in range(60)] + [(200, 100), (300, 200), (300, 150)]
    got = {r["id"]: r["label"] for r in graphs.components(
        spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in (100, 150, 200, 300))


# -- pipeline --------------------------------------------------------------------------
def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for _, stage in p.STAGES[:-1]:
        before = kept.count()
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns and 0 < kept.count() <= before
    out = p.run(spark, SF)
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in kept.collect()}
    assert "isoscope" in p.near_dedup.__globals__["darts"].__name__
