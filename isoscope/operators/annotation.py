"""Gene annotation by joining snapshot tables of the public providers.

Every provider is a table keyed by gene symbol, loaded once; nothing is fetched
per gene.  Shapes:

* panels(source_rank, symbol, panel, confidence, disorders array, ord)
* go(symbol, aspect, go_id, term, evidence, ord)
* proteins(symbol, accession, protein_name, function, ord)
* links(symbol_a, symbol_b, nscore ... tscore, score)
* genes(symbol, ensembl_id, ord)
* sets(library, term, gene)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoscope.functions.catalogue import GO_ASPECTS, LINK_CHANNELS, PANEL_LABEL, literal_map
from isoscope.functions.labels import confidence_rank
from isoscope.functions.numeric import hypergeometric_tail
from isoscope.operators.hypothesis import benjamini_hochberg


def panels_of_genes(panels: DataFrame) -> DataFrame:
    """Panels per gene from the first source that has any; the first entry of a
    panel name counts; at most five disorders."""
    named = panels.where(F.coalesce("panel", F.lit("")) != "").withColumn(
        "symbol", F.upper("symbol"))
    source = named.groupBy("symbol").agg(F.min("source_rank").alias("source_rank"))
    w = Window.partitionBy("symbol", "panel").orderBy("ord")
    first = (
        named.join(source, ["symbol", "source_rank"])
        .withColumn("_n", F.row_number().over(w)).where("_n = 1")
    )
    level = F.trim(F.col("confidence").cast("string"))
    label = F.coalesce(F.try_element_at(literal_map(PANEL_LABEL), level), F.lit("unknown"))
    return first.select(
        "symbol", "panel",
        F.coalesce(F.when(level.rlike("^[0-9]+$"), level.try_cast("int")), F.lit(0))
        .alias("confidence_level"),
        label.alias("confidence_label"),
        F.slice("disorders", 1, 5).alias("disorders"),
    )


def panel_order() -> list[Column]:
    return [confidence_rank(F.col("confidence_label")), F.col("panel")]


def go_of_genes(go: DataFrame, per_aspect: int = 8) -> DataFrame:
    """The first terms of each aspect; of those, the ones with id and label."""
    w = Window.partitionBy("symbol", "aspect").orderBy("ord")
    kept = (
        go.where(F.col("aspect").isin(*GO_ASPECTS))
        .withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_aspect)
    )
    return kept.where((F.col("go_id") != "") & (F.col("term") != "")).drop("_n")


def protein_of_genes(proteins: DataFrame) -> DataFrame:
    """The first reviewed entry per gene, dropped when it has no function text."""
    w = Window.partitionBy(F.upper("symbol")).orderBy("ord")
    first = proteins.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return first.where(F.coalesce("function", F.lit("")) != "").withColumn(
        "symbol", F.upper("symbol"))


# -- pairs ----------------------------------------------------------------------------
def _pair(a: Column, b: Column) -> list[Column]:
    a, b = F.upper(a), F.upper(b)
    return [F.least(a, b).alias("pair_lo"), F.greatest(a, b).alias("pair_hi")]


def candidate_pairs(symbols: DataFrame, candidates: list[str]) -> DataFrame:
    """Distinct unordered case-insensitive (gene, candidate) pairs without self pairs.
    The candidate list is a handful of names, exploded as a literal."""
    paired = symbols.select(
        "gene_symbol", F.explode(F.array(*[F.lit(c) for c in candidates])).alias("candidate"))
    apart = paired.where(F.upper("gene_symbol") != F.upper("candidate"))
    keyed = apart.select("gene_symbol", "candidate", *_pair(F.col("gene_symbol"), F.col("candidate")))
    # of equal pairs keep the alphabetically first spelling
    return keyed.groupBy("pair_lo", "pair_hi").agg(
        F.min(F.struct("gene_symbol", "candidate")).alias("p")
    ).select("pair_lo", "pair_hi", "p.gene_symbol", "p.candidate")


def interactions(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """The link of exactly the queried pair in either orientation; active channels
    as `name=score` text, rounded to three digits."""
    keyed = links.select(
        *_pair(F.col("symbol_a"), F.col("symbol_b")), *LINK_CHANNELS, "score"
    )
    active = F.array_compact(F.array(*[
        F.when(F.col(c) > 0, F.concat(F.lit(f"{c}="), F.format_number(F.col(c), 3)))
        for c in LINK_CHANNELS]))
    found = keyed.groupBy("pair_lo", "pair_hi").agg(
        F.max(F.struct("score", *LINK_CHANNELS)).alias("l")
    ).select("pair_lo", "pair_hi", "l.*").withColumn("channels", F.array_join(active, ","))
    return pairs.join(found.withColumn("_hit", F.lit(True)), ["pair_lo", "pair_hi"], "left").select(
        "gene_symbol", "candidate",
        F.coalesce("_hit", F.lit(False)).alias("has_interaction"),
        F.coalesce(F.round("score", 3), F.lit(0.0)).alias("combined_score"),
        F.coalesce("channels", F.lit("")).alias("channels"),
    )


def best_pair_score(found: DataFrame) -> DataFrame:
    """Highest score per gene; null when no pair of the gene has a record."""
    return found.groupBy("gene_symbol").agg(
        F.max(F.when(F.col("has_interaction"), F.col("combined_score"))).alias("pair_score"))


# -- lookups and cards --------------------------------------------------------------------
def search_genes(genes: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Prefix search on symbols; only stable gene ids, each once."""
    text = (query or "").strip().upper()
    if len(text) < 2:
        return genes.limit(0).select("symbol", "ensembl_id")
    hits = genes.where(
        F.upper("symbol").startswith(text) & F.col("ensembl_id").startswith("ENSG"))
    w = Window.partitionBy("ensembl_id").orderBy("ord", "symbol")
    once = hits.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return once.orderBy("ord", "symbol").limit(limit).select("symbol", "ensembl_id")


def lookup_gene(genes: DataFrame, symbol: str) -> DataFrame:
    """Exact symbol, first stable id."""
    exact = genes.where(
        (F.upper("symbol") == symbol.strip().upper()) & F.col("ensembl_id").startswith("ENSG"))
    return exact.orderBy("ord").limit(1).select("symbol", "ensembl_id")


def gene_cards(
    symbols: DataFrame, panels: DataFrame, go: DataFrame, proteins: DataFrame
) -> DataFrame:
    """Everything known per gene; missing parts are empty."""
    p = panels_of_genes(panels).groupBy("symbol").agg(F.array_sort(F.collect_list(
        F.struct(confidence_rank(F.col("confidence_label")).alias("rank"), "panel",
                 "confidence_label", "disorders"))).alias("panels"))
    g = go_of_genes(go).groupBy("symbol").agg(F.array_sort(F.collect_list(
        F.struct("aspect", "ord", "go_id", "term", "evidence"))).alias("go_terms"))
    f = protein_of_genes(proteins).select("symbol", "accession", "protein_name", "function")
    out = symbols.withColumn("symbol", F.upper("gene_symbol"))
    for part in (p, g, f):
        out = out.join(part, "symbol", "left")
    none = lambda df, c: F.array().cast(df.schema[c].dataType)
    return out.withColumns({
        "panels": F.coalesce("panels", none(p, "panels")),
        "go_terms": F.coalesce("go_terms", none(g, "go_terms")),
    })


def panel_summary(panels: DataFrame, shown: int = 3) -> DataFrame:
    """Per gene: best confidence, and the first panel names as one text."""
    w = Window.partitionBy("symbol").orderBy(*panel_order())
    ranked = panels_of_genes(panels).withColumn("_n", F.row_number().over(w)).where(
        F.col("_n") <= shown)
    return ranked.groupBy("symbol").agg(
        F.max(F.when(F.col("_n") == 1, F.col("confidence_label"))).alias("panel_confidence"),
        F.array_join(F.array_sort(F.collect_list(F.struct("_n", "panel")))["panel"], ", ")
        .alias("panel_names"),
    )


def panel_levels(panels: DataFrame) -> DataFrame:
    """Highest confidence level per gene."""
    return panels_of_genes(panels).groupBy("symbol").agg(
        F.max("confidence_level").alias("panel_level"))


def go_summary(go: DataFrame, shown: int = 3) -> DataFrame:
    """Per gene and aspect: the first terms as one text, one column per aspect."""
    w = Window.partitionBy("symbol", "aspect").orderBy("ord")
    ranked = go_of_genes(go).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= shown)
    return ranked.groupBy("symbol").agg(*[
        F.array_join(F.array_sort(F.collect_list(
            F.when(F.col("aspect") == a, F.struct("_n", "term"))))["term"], "; ")
        .alias(f"go_{a.lower()}")
        for a in GO_ASPECTS
    ])


# -- over-representation --------------------------------------------------------------------
def over_representation(
    symbols: DataFrame, sets: DataFrame, background: int, top: int | None = 10
) -> DataFrame:
    """Gene sets hit by the given genes: overlap k of set size n, hypergeometric upper
    tail against `background` genes, adjusted per library, best `top` terms each."""
    submitted = symbols.select(F.upper("gene_symbol").alias("gene")).distinct()
    members = sets.where(F.trim("gene") != "").select(
        "library", "term", F.upper("gene").alias("gene")).distinct()
    sizes = members.groupBy("library", "term").agg(F.count(F.lit(1)).alias("set_size"))
    hits = members.join(submitted, "gene").groupBy("library", "term").agg(
        F.count(F.lit(1)).alias("overlap"),
        F.array_join(F.array_sort(F.collect_list("gene")), ",").alias("genes"))
    drawn = submitted.agg(F.count(F.lit(1)).alias("n_submitted")).withColumn("_one", F.lit(1))
    rows = hits.join(sizes, ["library", "term"]).withColumn("_one", F.lit(1)).join(
        drawn, "_one").drop("_one")
    tested = rows.withColumn("p_value", hypergeometric_tail(
        F.lit(background).cast("bigint"), "set_size", "n_submitted", "overlap"))
    adjusted = benjamini_hochberg(tested, ["library"], "p_value", "adjusted_p_value", ["term"])
    w = Window.partitionBy("library").orderBy("adjusted_p_value", "p_value", "term")
    ranked = adjusted.withColumn("rank", F.row_number().over(w))
    return ranked if top is None else ranked.where(F.col("rank") <= top)
