"""Fingerprints, quality rules, BPE, packing and secrets against plain Python."""

import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import urllib.parse
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from isoscope.llm import bpe, packing, quality, secrets, syncmers


SF = "/root/testdata/sf0.001"


def rows_by(df, key):
    return {r[key]: r for r in df.collect()}


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def plain(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


# -- fingerprints ----------------------------------------------------------------------
def test_closed_syncmers_by_definition():
    text = "the quick brown fox jumps over the lazy dog " * 3 + "éè and more text at the end"
    data = text.encode()
    order = syncmers.mix(np.array(
        [int.from_bytes(data[i:i + 8], "little") for i in range(len(data) - 7)], np.uint64))
    inner = syncmers.K - syncmers.S
    want = [i for i in range(len(data) - syncmers.K + 1)
            if min(order[i:i + inner + 1]) in (order[i], order[i + inner])]
    ((at, value),) = syncmers.anchors_of([text])
    assert at.tolist() == want and len(want) > 5
    # context-free: the same anchors after a shift
    ((moved, again),) = syncmers.anchors_of(["x" * 40 + text])
    tail = moved >= 40
    assert (moved[tail] - 40).tolist() == want and (again[tail] == value).all()
    assert syncmers.aligned((at, value), (moved, again))[0] == 40


def test_short_texts_against_plain_overlap():
    pick = random.Random(4)
    texts = ["".join(pick.choices("abcdefgh ", k=n)) for n in range(32, 55) for _ in range(20)]
    near = [t[1:] + "x" if len(t) % 2 else t + "x" for t in texts]
    for t, u, v in zip(texts, near, texts[1:], strict=False):
        if len(u) > 54:
            continue
        (_, a), (_, b), (_, c) = syncmers.anchors_of([t, u, v])
        mers = [Counter(x[i:i + 32] for i in range(len(x) - 31)) for x in (t, u, v)]
        for one, other, p, q in ((a, b, 0, 1), (a, c, 0, 2), (b, c, 1, 2)):
            want = 2 * (mers[p] & mers[q]).total() / (mers[p].total() + mers[q].total())
            assert len(one) and syncmers.likeness(one, other) == pytest.approx(want)
    # from 55 bytes on the chosen ones are enough
    assert all(len(value) for _, value in syncmers.anchors_of(
        ["".join(pick.choices("abcdefgh ", k=55)) for _ in range(2000)]))


@pytest.mark.parametrize("table", ["documents", "odd"])
def test_edits_against_plain_python(request, table):
    df = request.getfixturevalue(table)
    rows = sorted(plain(df), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_next"] == 1.0)
                  for r in syncmers.edit_robustness(df).collect()), key=str)
    want = []
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        e = syncmers.edited(t, u)
        same = syncmers.anchors_of([t, u])
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(),
                     syncmers.likeness(same[0][1], same[1][1]) == 1.0))
    assert got == sorted(want, key=str)


def test_likeness_and_equal_texts(documents):
    a, b = np.array([1, 1, 2, 9], np.uint32), np.array([1, 2, 3], np.uint32)
    assert syncmers.likeness(a, b) == pytest.approx(2 * 2 / 7)
    rows = syncmers.edit_robustness(documents).join(documents, "doc_id").collect()
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r["text"], r["fingerprint"]) == r["fingerprint"]
    long = [r for r in rows if r["n_chars"] > 400 and r["near_next"] < 0.9]
    assert all(r["near_edited"] > r["near_next"] for r in long)
    assert np.mean([r["near_edited"] for r in long]) == pytest.approx(0.5, abs=0.1)


def test_fingerprint_column_and_empty(odd, empty):
    got = rows_by(syncmers.fingerprints(odd).where("doc_id in (3, 7)"), "doc_id")
    assert got[3]["fingerprint"] == "" and len(got[7]["fingerprint"]) == 8 and got[7]["label"] == "y"
    assert syncmers.edit_robustness(empty).count() == 0
    one = syncmers.edit_robustness(odd.where("doc_id = 8")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


# -- quality ---------------------------------------------------------------------------
def base_rule(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    hit = {i + k for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed)


@pytest.mark.parametrize("table", ["documents", "odd"])
def test_base_rule_against_plain_python(request, table):
    df = request.getfixturevalue(table)
    got = quality.judged(df, None)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    have = sorted(((r["doc_id"], *[r[n] for n in names]) for r in got.collect()), key=str)
    assert have == sorted(((i, *base_rule(t)) for i, t in plain(df)), key=str)
    assert got.where("kept = base_failed").count() == 0


def test_classifier_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = quality.fit(docs, labels)
    seen = {r["doc_id"] for r in quality.labelled_sample(docs, labels).select("doc_id").collect()}
    rows = quality.judged(docs.select("doc_id", "text"), model).join(labels, "doc_id").where(
        "NOT base_failed").collect()
    rows = [r for r in rows if r["doc_id"] not in seen]
    right = np.mean([r["kept"] == (r["quality"] == 1) for r in rows])
    good = [r["kept"] for r in rows if r["quality"] == 1]
    assert len(rows) > 500 and right > 0.97 and np.mean(good) > 0.98
    # calibration: mean probability near the share of good rows
    assert np.mean([r["p_quality"] for r in rows]) == pytest.approx(
        np.mean([r["quality"] for r in rows]), abs=0.05)


def test_quality_without_classes(empty, odd, spark):
    one_class = spark.createDataFrame([(1, 1), (8, 1), (None, 0)], "doc_id bigint, quality int")
    assert quality.fit(odd, one_class) is None
    assert quality.judged(empty, None).count() == 0


# -- BPE -------------------------------------------------------------------------------
def awkward(n=1500):
    pick = random.Random(7)
    pieces = [" ", "\n", "'s", "'LL", "<|endoftext|>", "a", "B", "Σ", "İ", "\x1c", "\x85", "́", "½"]
    draw = lambda: pick.choice(
        [pick.choice(pieces), chr(pick.randrange(0x250)), chr(pick.randrange(0x370, 0xD7FF)),
         chr(pick.randrange(0x10000, 0x1FFFF))])
    return ["".join(draw() for _ in range(pick.randrange(60))) for _ in range(n)]


def test_encoder_and_decoder_against_the_library(documents, library):
    own = bpe.Codec()
    texts = [t for _, t in plain(documents)] + awkward() + ["", "a" * 4000, "ab" * 2000 + "!" * 2000]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_bpe_tables(odd, empty, library):
    tokens = bpe.encoded(odd)
    back = bpe.decoded(tokens)
    digests = sorted((tuple(r) for r in bpe.round_trip_digests(odd).collect()), key=str)
    want = []
    for i, t in plain(odd):
        ids = library.encode(t, add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(text.encode()).hexdigest()))
    assert digests == sorted(want, key=str)
    assert "label" in back.columns and back.count() == odd.count()
    assert bpe.round_trip_digests(empty).count() == 0


# -- packing ---------------------------------------------------------------------------
@pytest.mark.parametrize("table", ["documents", "odd"])
@pytest.mark.parametrize("group", [100_000, 12])
def test_packing(request, table, group, library):
    df = request.getfixturevalue(table)
    got = packing.packed(df, group_pieces=group).collect()
    tokens = [(i, library.encode(t, add_special_tokens=False).ids + [0]) for i, t in plain(df)]
    want = Counter((i, n, a, len(ids[a:a + 2048]), zlib.crc32(np.array(ids[a:a + 2048], "<u4").tobytes()))
                   for i, ids in tokens for n, a in enumerate(range(0, len(ids), 2048)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        parts.sort()
        assert parts[0][0] == 0 and sum(n for _, n in parts) <= 2048
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
    if group > 12:
        bound = packing.lower_bound(np.array([r["length"] for r in got]))
        assert bound <= len(bins) <= 1.03 * bound + 1


def test_lower_bounds_and_best_fit():
    rng = np.random.default_rng(3)
    for _ in range(200):
        sizes = rng.integers(1, 101, rng.integers(1, 40))
        where, offset, fills = packing.best_fit_decreasing(sizes, 100)
        assert packing.lower_bound(sizes, 100) <= len(fills)
        assert fills.max() <= 100 and fills.sum() == sizes.sum()
        # plain best fit
        bins = []
        for s in sorted(sizes.tolist(), reverse=True):
            fit = [b for b in bins if b + s <= 100]
            if fit:
                bins.remove(max(fit))
                bins.append(max(fit) + s)
            else:
                bins.append(s)
        assert sorted(fills.tolist()) == sorted(bins)
    assert packing.lower_bound(np.array([60] * 7), 100) == 7
    assert packing.lower_bound(np.array([34] * 7), 100) == 4


def test_certified_groups_are_final_and_others_exchange(spark):
    """Pieces of 700 need half a bin each, which the bounds see; random pieces leave gaps
    in small groups, and an exchange never needs more bins than the groups alone."""
    halves = spark.range(600).select(F.col("id").alias("pid"), F.lit(700).cast("bigint").alias("length"))
    got = packing.pack(halves, group_pieces=100).collect()
    assert len(got) == 600 and 300 <= len({r["sequence_id"] for r in got}) <= 306
    rng = np.random.default_rng(5)
    sizes = rng.integers(300, 1400, 900).tolist()
    mixed = spark.createDataFrame(list(enumerate(sizes)), "pid bigint, length bigint")
    got = packing.pack(mixed, group_pieces=60).collect()
    assert sorted(r["pid"] for r in got) == list(range(900))
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], sizes[r["pid"]]))
    for parts in bins.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) <= 2048
    groups = mixed.withColumn("grp", F.pmod(F.xxhash64("pid", F.lit(0)), F.lit(15)))
    alone = groups.groupBy("grp").applyInPandas(packing._pack_group(2048, 0), packing.PLACED)
    bounds = packing.group_bounds(alone).collect()
    assert len(bounds) == 15 and all(r["bound"] <= r["bins"] for r in bounds)
    assert packing.lower_bound(np.array(sizes)) <= len(bins) <= sum(r["bins"] for r in bounds)


def test_packing_empty(empty):
    assert packing.packed(empty).count() == 0


# -- secrets ---------------------------------------------------------------------------
def plain_base(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
    out = [("assign", *m.span()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    kinds = ["assign", "access", "hex"]
    return sorted(out, key=lambda s: (s[1], kinds.index(s[0])))


@pytest.mark.parametrize("table", ["documents", "odd"])
def test_base_spans(request, table):
    df = request.getfixturevalue(table)
    got = sorted(((r["doc_id"], r["n_assign"], r["base_sha256"]) for r in secrets.scanned(df).collect()), key=str)
    want = []
    for i, t in plain(df):
        spans = plain_base(t)
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want.append((i, sum(k == "assign" for k, _, _ in spans), hashlib.sha256(line.encode()).hexdigest()))
    assert got == sorted(want, key=str)


SECRET = "password = hunter2hunter2"


@pytest.mark.parametrize("wrap", [
    lambda s: base64.b64encode(s.encode()).decode(),
    lambda s: urllib.parse.quote(s, safe=""),
    lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
    lambda s: base64.b64encode(gzip.compress(s.encode())).decode(),
    lambda s: base64.b64encode(base64.b64encode(base64.b64encode(s.encode()))).decode(),
    lambda s: urllib.parse.quote(base64.urlsafe_b64encode(zlib.compress(s.encode())).decode(), safe=""),
])
def test_nested_layers_map_to_the_source(wrap):
    hidden = wrap(SECRET)
    text = f"héllo {hidden} wörld"
    base, found = secrets.all_spans(text)
    spans = [s for s in found if s.kind == "assign"]
    assert not base and spans
    assert all(6 <= s.start < s.end <= 6 + len(hidden) for s in spans)
    assert SECRET[11:] not in secrets.masked(text) and "wörld" in secrets.masked(text)


def test_exact_mapping_and_fixpoint():
    inner = "xx " + SECRET + " yy"
    text = urllib.parse.quote(inner, safe=" ")
    (span,) = [s for s in secrets.all_spans(text)[1] if s.kind == "assign"]
    assert urllib.parse.unquote(text[span.start:span.end]) == SECRET.replace(" ", " ")
    # repeated and self-like layers end
    again = base64.b64encode(b"A" * 400).decode()
    assert secrets.all_spans(" ".join([again] * 5))[0] == []


def test_redaction_keeps_columns(odd, empty):
    marked = odd.withColumn("text", F.concat("text", F.lit(" token: abcdefghij")))
    got = secrets.redacted(marked)
    assert got.columns == odd.columns and got.where("text LIKE '%abcdefghij%'").count() == 0
    assert got.where("text IS NULL").count() == 2
    assert secrets.scanned(empty).count() == 0


def test_oversize_layers_are_reported(monkeypatch):
    monkeypatch.setattr(secrets, "LAYER_LIMIT", 1000)
    bomb = base64.b64encode(gzip.compress(b"0" * 100_000)).decode()
    assert [s.kind for s in secrets.all_spans(f"x {bomb}")[1]] == ["oversize"]


NOISE = "".join(random.Random(3).choices("ghijklmnopqrstuvwxyz ", k=3000))


@pytest.mark.parametrize("pack", [
    lambda d: gzip.compress(gzip.compress(d)),
    lambda d: lzma.compress(gzip.compress(bz2.compress(d))),
    lambda d: gzip.compress(b"first member ") + gzip.compress(d),
    lambda d: bz2.compress(b"first member ") + bz2.compress(d),
    lambda d: lzma.compress(b"first member ") + bytes(4) + lzma.compress(d),
])
@pytest.mark.parametrize("line", [10_000_000, 76, 64])
def test_nested_and_wrapped_streams(pack, line):
    data = base64.b64encode(pack((NOISE + SECRET).encode())).decode()
    lines = [data[i:i + line] for i in range(0, len(data), line)]
    for end in ("\n", "\r\n"):
        body = end.join(lines)
        text = f"-----BEGIN CERTIFICATE-----{end}{body}{end}-----END CERTIFICATE-----"
        a = text.index(body)
        assert ("assign", a, a + len(body)) in secrets.all_spans(text)[1]
        assert data[:16] not in secrets.masked(text)


@pytest.mark.parametrize("lead", range(34, 57, 7))
def test_secret_across_a_line_end(lead):
    data = base64.encodebytes((NOISE[:lead] + SECRET + NOISE[:90]).encode()).decode()
    text = "mail\n\n" + data
    (span,) = [s for s in secrets.all_spans(text)[1] if s.kind == "assign" and "\n" in text[s.start:s.end]]
    # three bytes stand behind four characters and 57 behind a line
    source = lambda i: 6 + i // 57 * 77 + i % 57 // 3 * 4 + i % 3
    assert span.start == source(lead) and span.end >= source(lead + len(SECRET) - 1)


def test_xz_of_every_preset_and_refused_streams(monkeypatch):
    for preset in (0, 6, 9, 9 | lzma.PRESET_EXTREME):
        data = base64.b64encode(lzma.compress(SECRET.encode(), preset=preset)).decode()
        assert ("assign", 2, 2 + len(data)) in secrets.all_spans(f"x {data}")[1]
    huge = [{"id": lzma.FILTER_LZMA2, "preset": 0, "dict_size": 3 << 26}]
    stream = lzma.LZMACompressor(filters=huge)
    data = base64.b64encode(stream.compress(SECRET.encode()) + stream.flush()).decode()
    assert [tuple(s) for s in secrets.all_spans(f"x {data}")[1]] == [("oversize", 2, 2 + len(data))]
    # the limit counts bytes: a layer cut off in the middle is not taken for a whole one
    monkeypatch.setattr(secrets, "LAYER_LIMIT", 1000)
    data = base64.b64encode(gzip.compress(("é" * 600 + SECRET).encode())).decode()
    assert [s.kind for s in secrets.all_spans(f"x {data}")[1]] == ["oversize"]


def test_self_like_streams_end(monkeypatch):
    monkeypatch.setattr(secrets, "_unpacked", lambda data: b"\xff" + data[:0])
    assert secrets.all_spans(base64.b64encode(b"\xff" * 30).decode())[1] == []


def test_arrays_accept_sliced_batches():
    from isoscope.llm.arrays import blocks

    column = pa.array(["aa", None, "bb cc", ""]).slice(1)
    (block,) = blocks(column)
    assert block.offsets.tolist() == [0, 0, 5, 5]


def test_sf(spark):
    assert spark.read.parquet(f"{SF}/documents.parquet").count() == 200
