"""Periodic runs against their definition."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from isoscope.llm import periodic, queries
from isoscope.llm.arrays import blocks

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words):
    """Every period, every maximal stretch, directly."""
    n, best = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                best.setdefault((i, j - i + q), q)  # ascending q: the smallest stays
            i = j
    return sorted((s, n, q) for (s, n), q in best.items())


def planted(doc_id, words):
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, text):
    words = planted(doc_id, WORD.findall(text or ""))
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None,
            digest("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
            digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


FIELDS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
          "collapsed_sha256")


def found(df):
    return sorted((tuple(r[f] for f in FIELDS) for r in df.collect()), key=str)


@pytest.mark.parametrize("modulus, cover", [periodic.SMALL_COVER, periodic.LARGE_COVER])
def test_covers_bring_any_two_positions_together(modulus, cover):
    shift = periodic.cover_shifts(modulus, cover, periodic.FEW)
    assert shift.min() >= periodic.FEW and shift.max() < periodic.FEW + modulus
    for a in range(modulus):
        for b in range(modulus):
            assert {(a + shift[a, b]) % modulus, (b + shift[a, b]) % modulus} <= set(cover)


@pytest.mark.parametrize("cover", [periodic.SMALL_COVER, periodic.LARGE_COVER])
def test_extensions_against_plain_comparison(monkeypatch, cover):
    monkeypatch.setattr(periodic, "SMALL_COVER", cover)
    pick = random.Random(3)
    for letters in (1, 2, 5):
        ids = np.array([pick.randrange(letters) for _ in range(700)] + [90])
        ids[300:500] = ids[50:250]
        extend = periodic.Extender(ids, np.array([0, len(ids)]))
        i = np.array([pick.randrange(699) for _ in range(400)])
        j = np.array([pick.randrange(x + 1, 700) for x in i])
        want = [next(k for k in range(800) if y + k >= 701 or ids[x + k] != ids[y + k])
                for x, y in zip(i, j, strict=True)]
        assert extend(i, j).tolist() == want
        assert extend(j, i).tolist() == want


@pytest.mark.parametrize("pairs", [periodic.MAX_PAIRS, 7])
def test_runs_of_random_texts(monkeypatch, pairs):
    monkeypatch.setattr(periodic, "MAX_PAIRS", pairs)
    pick = random.Random(7)
    texts = []
    for _ in range(400):
        unit = [pick.choice("abc") for _ in range(pick.randrange(1, 9))]
        middle = (unit * 12)[:pick.randrange(0, 60)]
        words = [pick.choice("abcd"[:pick.randrange(1, 5)]) for _ in range(pick.randrange(0, 25))]
        texts.append(" ".join(words + middle * pick.randrange(1, 3) + words[:5]))
    texts += ["", "a", "a " * 5, "a " * 6, "a b " * 3 + "a", "a b " * 4, "x\ty\x0bx y x y x y"]
    (block,) = blocks(pa.array(texts))
    words = periodic.find_words(block, periodic.NOT_SPACE)
    got = periodic.find_runs(periodic.word_numbers(block, words), words.counts)
    rows = list(zip(*(x.tolist() for x in got), strict=True))
    want = [(t, *r) for t, text in enumerate(texts) for r in plain_runs(WORD.findall(text))]
    assert rows == want and len(want) > 300


def test_query_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = found(queries.op12_periodic_runs(spark, SF))
    assert got == sorted((expected(r["doc_id"], r["text"]) for r in docs), key=str)
    assert sum(r[1] > 0 for r in got) >= 5


def test_odd_tables(odd, empty):
    got = found(periodic.with_runs(odd.select("doc_id", "text"), reorder=periodic.planted_order))
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    short = [r for r in rows if len(r[1] or "") < 10_000]
    assert [g for g in got if g[0] not in (4, 5)] == sorted((expected(*r) for r in short), key=str)
    assert len(got) == len(rows)
    assert periodic.with_runs(empty).count() == 0


def test_clashing_names_and_real_outputs(spark):
    df = spark.createDataFrame(
        [(1, "go on go on go on go on stop", 5, "kept"), (2, None, 6, "kept")],
        "doc_id bigint, text string, length int, other string")
    one, two = sorted(periodic.with_runs(df).collect(), key=lambda r: r["doc_id"])
    assert (one["runs"], one["collapsed"], one["length"], one["other"]) == ([(0, 8, 2)], "go on stop", 8, "kept")
    assert (two["n_runs"], two["length"], two["collapsed"]) == (0, None, "")


@pytest.mark.parametrize("n", [40_000, 300_000])
def test_long_texts(spark, n):
    """A long text with a planted long period, both covers."""
    pick = random.Random(n)
    unit = [f"w{pick.randrange(5000)}" for _ in range(n // 9)]
    words = [f"h{k}" for k in range(500)] + (unit * 9)[:5 * len(unit) + 77] + ["z"] * 1000
    df = spark.createDataFrame([(1, " ".join(words))], "doc_id bigint, text string")
    (row,) = periodic.with_runs(df).collect()
    want = sorted([(500, 5 * len(unit) + 77, len(unit)), (len(words) - 1000, 1000, 1)])
    assert [tuple(r) for r in row["runs"] if r["length"] > 50] == want
    assert row["exponent_milli"] == 1000 * want[0][1] // len(unit)
