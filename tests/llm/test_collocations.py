"""Phrase collocations against counting every phrase, one by one."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from isoscope.llm import collocations, queries

SF = "/root/testdata/sf0.01"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def pieces_of(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text))]


def plain_counts(rows, longest):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for words in pieces_of(text):
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    return f, n


def plain(rows, longest=3, least=10, top=2000, percent=50):
    counts, n = plain_counts(rows, longest)
    out = []
    for lang, f in counts.items():
        found = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            score, _, l, r = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]])
                                 for k in range(1, len(p)))
            found.append((p, a, l, r, score))
        covered = set()
        for q, b, *_ in found:
            for k in range(2, len(q)):
                for i in range(len(q) - k + 1):
                    if 100 * b >= percent * f[q[i:i + k]]:
                        covered.add(q[i:i + k])
        kept = sorted((-s, -a, " ".join(p).encode(), l, r) for p, a, l, r, s in found if p not in covered)
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s)
                for i, (s, a, p, l, r) in enumerate(kept[:top], 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string")


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_query_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text").collect()
    got = found(queries.op13_phrase_collocations(spark, SF))
    assert got == plain(map(tuple, docs)) and len(got) > 500


def random_rows(seed, n=300):
    pick = random.Random(seed)
    unit = [["a b c d e f g", "straße é 中 文 x", "A B, c d"], ["the cat sat", "x y"]]
    rows = []
    for _ in range(n):
        words = [pick.choice(["a", "b", "c", "d", "the", "é", "X1", "中"]) for _ in range(pick.randrange(12))]
        lang = pick.choice(["en", "de", None, "und", "a%09\tb\n"])
        text = " ".join(words) + pick.choice([". ", "\t", "\n", "!?", " "]) + pick.choice(unit[pick.randrange(2)])
        rows.append((lang, text * pick.randrange(1, 3)))
    return rows


@pytest.mark.parametrize("longest", [2, 3, 4])
@pytest.mark.parametrize("least", [1, 4])
def test_other_lengths_and_thresholds(spark, longest, least):
    rows = random_rows(longest)
    got = found(collocations.collocations(table(spark, rows).repartition(3), longest, least, top=50))
    assert got == plain(rows, longest, least, 50)


@pytest.mark.parametrize("limit", [1, 40, 1 << 20])
def test_chunks_of_any_size_count_the_same(limit):
    texts = [t for _, t in random_rows(9)] + [None, "", "x" * 500, "one " * 300 + ". two"]
    total = Counter()
    for data, cuts, rows in collocations.chunks(pa.array(texts), limit):
        pieces = collocations.Pieces(data, cuts, np.zeros(len(rows), np.int64))
        at, last, n = collocations._edges(pieces, 3)
        for a, b, c in zip(at, last, n, strict=True):
            total[tuple(pieces.words[int(pieces.ids[i])].as_py() for i in (a, a + 1, b))] += int(c)
    want, _ = plain_counts([("en", t) for t in texts], 3)
    assert total == Counter({p: c for p, c in want["en"].items() if len(p) == 3})


def test_a_hot_node_is_dealt_and_added_up(spark):
    pick = random.Random(2)
    rows = [("en", "of the " + " ".join(f"w{pick.randrange(400)} of the w{pick.randrange(400)}" for _ in range(20)))
            for _ in range(600)]
    rows += [("de", "of the " + f"w{i % 7}") for i in range(200)]
    df = table(spark, rows).repartition(6)
    hot, n = collocations.hot_nodes(df, 3, 1 / 16)
    assert hot == ["en\tof the"] and n > 1000
    packed = collocations.edges(df, 64, 3, hot).collect()
    parts = {k for r in packed for k in r["node"].split("\n") if k.startswith("en\tof the")}
    assert len(parts) > 32  # the node itself still carries the pieces that end in it
    assert found(collocations.collocations(df)) == plain(rows)


def test_unary_paths(spark):
    rows = [("en", f"{x} alpha beta gamma delta epsilon {y}") for x in "abc" for y in "pqrs"]
    rows += [("en", "one two three four. five")] * 5 + [("de", "one two three")] * 3
    rows += [("en", "r1 r2 r3 r1 r2 r3 r1 r2 r3")] * 2
    counts = collocations.graph(table(spark, rows), 3, 1)
    got = {(r["lang"], r["phrase"]): (r["words"], r["f"]) for r in collocations.paths(counts).collect()}
    assert got[("en", "alpha beta gamma delta epsilon")] == (5, 12)
    assert got[("en", "one two three four")] == (4, 5) and got[("de", "one two three")] == (3, 3)
    assert got[("en", "a alpha beta")] == (3, 4) and got[("en", "delta epsilon p")] == (3, 3)
    # places of all edges are kept, whatever the paths
    assert sum((w - 2) * f for w, f in got.values()) == sum(
        len(p) - 2 for _, t in rows for p in pieces_of(t) if len(p) > 2)


def test_a_ring_stays_edges(spark):
    ring = [("a b c", 5), ("b c a", 5), ("c a b", 5), ("x y z", 2), ("y z w", 2)]
    nodes = [("a b", 5), ("b c", 5), ("c a", 5), ("x y", 2), ("y z", 2), ("z w", 2)]
    counts = spark.createDataFrame(
        [("en", p, 3, f) for p, f in ring] + [("en", p, 2, f) for p, f in nodes],
        "lang string, phrase string, words int, f bigint")
    got = sorted((r["phrase"], r["f"]) for r in collocations.paths(counts).collect())
    assert got == [("a b c", 5), ("b c a", 5), ("c a b", 5), ("x y z w", 2)]


def test_odd_tables(spark, odd, empty):
    rows = [(r["lang"], r["text"]) for r in odd.collect()]
    assert found(collocations.collocations(odd, min_count=2)) == plain(rows, least=2)
    assert collocations.collocations(empty).count() == 0
    blank = table(spark, [(None, None), ("en", ""), ("de", ".,;\n \t")])
    assert collocations.collocations(blank, min_count=1).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    f = {"x y": 3_000_000_000_007, "x": 9_000_000_000_011, "y": 5_000_000_000_003}
    counts = spark.createDataFrame(
        [("en", p, len(p.split()), n) for p, n in f.items()], "lang string, phrase string, words int, f bigint")
    (row,) = collocations.scored(counts).collect()
    assert row["score"] == 1_000_000 * f["x y"] ** 2 // (f["x"] * f["y"])


def test_null_and_clashing_columns(spark):
    df = table(spark, random_rows(5)).withColumns({"phrase": F.lit("p"), "n": F.lit(1), "words": F.lit("w")})
    assert found(collocations.collocations(df)) == plain(random_rows(5))
