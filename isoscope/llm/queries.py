"""One query per operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoscope.llm import (
    bpe,
    collocations,
    darts,
    licenses,
    packing,
    passages,
    periodic,
    quality,
    secrets,
    sharding,
    syncmers,
    toxicity,
    warc,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed-syncmer fingerprints of every text and of its edited text."""
    return syncmers.edit_robustness(_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rule and calibrated n-gram classifier on every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.judged(docs, model).drop("text")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return packing.packed(_table(spark, sf_dir, "documents"))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return bpe.round_trip_digests(_table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 40 shards of a weighted hash tree, and of 41."""
    return sharding.sharded(_table(spark, sf_dir, "documents"))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, encoded ones included."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.scanned(docs).drop("text", "base_spans")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of at least 50 words that several documents share."""
    return passages.repeated_passages(_table(spark, sf_dir, "documents"))


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and rules on every document."""
    return licenses.scanned(_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    found = darts.classes(_table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("class_id").isNull() | (F.col("class_id") == F.col("doc_id")))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from labels outside the held-out fold."""
    return toxicity.classified(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document, a tenth of them with a run planted."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic.with_runs(docs, reorder=periodic.planted_order).drop("text", "runs", "collapsed")


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2000 phrases of two or three words."""
    return collocations.collocations(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_document_fingerprints, op2_quality_rules, op3_best_fit_packing, op4_bpe_round_trip,
        op5_sharding, op6_secret_scans, op7_substring_dedup, op8_license_scans, op9_warc,
        op10_minhash_near_dedup, op11_toxicity, op12_periodic_runs, op13_phrase_collocations)
}

ORACLES: dict[str, str] = {
    # phrases counted one by one, without the graph
    "op13_phrase_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
places AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM worded, (VALUES (1), (2), (3)) AS size(k) WHERE len(w) >= k),
counted AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM places GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
  SELECT c.lang, c.phrase, c.k, c.f AS a, cut,
    array_to_string(string_split(c.phrase, ' ')[1:cut], ' ') AS head,
    array_to_string(string_split(c.phrase, ' ')[cut + 1:], ' ') AS tail
  FROM counted c, (VALUES (1), (2)) AS sides(cut) WHERE cut < c.k),
scores AS (
  SELECT cuts.lang, cuts.phrase, cuts.k, a, x.f AS l, y.f AS r, cut,
    1000000::HUGEINT * a * a // (x.f * y.f) AS score
  FROM cuts JOIN counted x ON x.lang = cuts.lang AND x.phrase = head
    JOIN counted y ON y.lang = cuts.lang AND y.phrase = tail),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
longer AS (
  SELECT lang, inside AS phrase, max(f) AS f FROM (
    SELECT lang, f, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '),
                            array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS inside
    FROM counted WHERE k = 3) GROUP BY ALL),
ranked AS (
  SELECT best.*, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, best.phrase) AS rank
  FROM best LEFT JOIN longer USING (lang, phrase)
  WHERE longer.f IS NULL OR 100 * longer.f < 50 * a)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n,
  score::BIGINT AS score
FROM ranked JOIN total USING (lang) WHERE rank <= 2000""",
}
