"""Fixed values of the domain, kept together so that no operator hard-codes them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: event types, in report order -----------------------------
EVENT_TYPES = ["SE", "RI", "A3SS", "A5SS", "MXE"]

# --- fixed values: file-name and header rules -------------------------------
MATS_NAME = r"(?i)(?:^|[^A-Za-z0-9])(SE|MXE|A3SS|A5SS|RI)[._-]MATS[._-](JC|JCEC)(?![A-Za-z0-9])"
FROM_GTF_NAME = (
    r"(?i)(?:^|[^A-Za-z0-9])fromGTF[._](?:(?:novelJunction|novelSpliceSite|novelEvents)[._])?"
    r"(SE|MXE|A3SS|A5SS|RI)(?![A-Za-z0-9])"
)
TYPE_TOKEN = r"(?i)(?:^|[^A-Za-z0-9])(SE|MXE|A3SS|A5SS|RI)(?![A-Za-z0-9])"
MODE_TOKEN = r"(?i)(?:^|[^A-Za-z0-9])(JC|JCEC)(?![A-Za-z0-9])"

HEADER_FAMILY = {
    "RI": ["riExonStart_0base", "riExonStart", "riExonEnd"],
    "MXE": [
        "1stExonStart_0base", "1stExonStart", "1stExonEnd",
        "2ndExonStart_0base", "2ndExonStart", "2ndExonEnd",
    ],
    "ALT": [
        "longExonStart_0base", "longExonStart", "longExonEnd",
        "shortES", "shortEE", "flankingES", "flankingEE",
    ],
    "SE": ["exonStart_0base", "exonStart", "exonEnd"],
}

# --- fixed values: internal column <- accepted raw headers ------------------
RAW_HEADERS = {
    "caller_id": ["ID"],
    "gene_id": ["GeneID"],
    "gene_symbol": ["geneSymbol"],
    "chr": ["chr"],
    "strand": ["strand"],
    "exon_start": [
        "exonStart_0base", "exonStart", "1stExonStart_0base", "1stExonStart",
        "riExonStart_0base", "riExonStart",
    ],
    "exon_end": ["exonEnd", "1stExonEnd", "riExonEnd"],
    "upstream_es": ["upstreamES"],
    "upstream_ee": ["upstreamEE"],
    "downstream_es": ["downstreamES"],
    "downstream_ee": ["downstreamEE"],
    "second_exon_start": ["2ndExonStart_0base", "2ndExonStart"],
    "second_exon_end": ["2ndExonEnd"],
    "long_exon_start": ["longExonStart_0base", "longExonStart"],
    "long_exon_end": ["longExonEnd"],
    "short_es": ["shortES"],
    "short_ee": ["shortEE"],
    "flanking_es": ["flankingES"],
    "flanking_ee": ["flankingEE"],
    "ijc_sample_1": ["IJC_SAMPLE_1"],
    "sjc_sample_1": ["SJC_SAMPLE_1"],
    "ijc_sample_2": ["IJC_SAMPLE_2"],
    "sjc_sample_2": ["SJC_SAMPLE_2"],
    "inc_form_len": ["IncFormLen"],
    "skip_form_len": ["SkipFormLen"],
    "p_value": ["PValue"],
    "fdr": ["FDR"],
    "inc_level_1": ["IncLevel1"],
    "inc_level_2": ["IncLevel2"],
    "inc_level_difference": ["IncLevelDifference"],
}
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

LONG_COLUMNS = [
    "exon_start", "exon_end", "upstream_es", "upstream_ee", "downstream_es", "downstream_ee",
    "second_exon_start", "second_exon_end", "long_exon_start", "long_exon_end",
    "short_es", "short_ee", "flanking_es", "flanking_ee", "caller_id",
]
INT_COLUMNS = ["inc_form_len", "skip_form_len"]
DOUBLE_COLUMNS = ["p_value", "fdr", "inc_level_difference"]

GENERIC_COORDS = [
    "exon_start", "exon_end", "upstream_es", "upstream_ee", "downstream_es", "downstream_ee",
]
ALT_SITE_COORDS = [
    "long_exon_start", "long_exon_end", "short_es", "short_ee", "flanking_es", "flanking_ee",
]
REQUIRED_COORDS = {
    "SE": GENERIC_COORDS,
    "RI": GENERIC_COORDS,
    "MXE": GENERIC_COORDS + ["second_exon_start", "second_exon_end"],
    "A3SS": ALT_SITE_COORDS,
    "A5SS": ALT_SITE_COORDS,
}
IDENTITY_COLUMNS = [
    "event_type", "gene_id", "chr", "strand", *GENERIC_COORDS,
    "second_exon_start", "second_exon_end",
    "long_exon_start", "long_exon_end", "short_es", "short_ee",
]

# --- fixed values: thresholds ----------------------------------------------
MIN_COVERAGE = 10
NEAR_BP = 50
MIN_GROUP_N = 5
EXACT_MAX_SPLITS = 5000

# --- fixed values: complement over the IUPAC alphabet ------------------------
COMPLEMENT_FROM = "ACGTURYSWKMBDHVNacgturyswkmbdhvn"
COMPLEMENT_TO = "TGCAAYRSWMKVHDBNtgcaayrswmkvhdbn"

# --- fixed values: consensus code per sorted base set -------------------------
IUPAC_CODE = {
    "A": "A", "C": "C", "G": "G", "T": "T",
    "AG": "R", "CT": "Y", "AC": "M", "GT": "K", "CG": "S", "AT": "W",
    "ACG": "V", "ACT": "H", "AGT": "D", "CGT": "B", "ACGT": "N",
}
CONSENSUS_SHARE = 0.40

# --- fixed values: motif catalogue (name, protein family, pattern) ----------
MOTIFS = [
    ("TAGG", "hnRNP A1/A2", "TAGG"),
    ("TAGGG", "hnRNP A1/A2", "TAGGG"),
    ("TAGGGA", "hnRNP A1/A2", "TAGGGA"),
    ("AGG", "hnRNP A1/A2", "AGG"),
    ("CCWWHCC", "hnRNP E1 (PCBP1)", "CC[AT][AT][ACT]CC"),
    ("CCYYCCH", "hnRNP E2 (PCBP2)", "CC[CT][CT]CC[ACT]"),
    ("GGGG", "hnRNP F/H", "GGGG"),
    ("GGG", "hnRNP F/H", "GGG"),
    ("CCCC", "hnRNP K", "CCCC"),
    ("TCCC", "hnRNP K", "TCCC"),
    ("TTTTT", "hnRNP C", "TTTTT"),
    ("TTTT", "hnRNP C", "TTTT"),
    ("CACA", "hnRNP L", "CACA"),
    ("ACAC", "hnRNP L", "ACAC"),
    ("TGTG", "hnRNP M", "TGTG"),
    ("GTGT", "hnRNP M", "GTGT"),
    ("TCTT", "PTB (hnRNP I)", "TCTT"),
    ("TCTCT", "PTB (hnRNP I)", "TCTCT"),
    ("CTCT", "PTB (hnRNP I)", "CTCT"),
]
REGIONS = [
    "upstream_exon", "upstream_intron_5ss", "upstream_intron_3ss", "skipped_exon",
    "downstream_intron_5ss", "downstream_intron_3ss", "downstream_exon",
]
# effect of a protein family per zone: upstream exon, upstream intron, skipped
# exon, downstream intron, downstream exon
ZONE_EFFECTS = {
    "hnRNP A1/A2": ("ESS", "ISS", "ESS", "ISS", "ESS"),
    "hnRNP E1 (PCBP1)": (None, None, None, None, None),
    "hnRNP E2 (PCBP2)": (None, None, None, None, None),
    "hnRNP F/H": ("ESS", None, "ESS", "ISE", "ESS"),
    "hnRNP K": (None, None, None, None, None),
    "hnRNP C": (None, "ISE", "ESS", None, None),
    "hnRNP L": (None, None, "ESS", None, None),
    "hnRNP M": (None, None, "ESS", "ISS", None),
    "PTB (hnRNP I)": (None, "ISS", "ESS", "ISS", None),
}
ZONE_OF_REGION = {
    "upstream_exon": 0, "upstream_intron_5ss": 1, "upstream_intron_3ss": 1, "skipped_exon": 2,
    "downstream_intron_5ss": 3, "downstream_intron_3ss": 3, "downstream_exon": 4,
}
FLANK_NT = 250
DONOR_EXCLUDED_NT = 6
ACCEPTOR_EXCLUDED_NT = 20

# --- fixed values: contig aliases (genome release GRCh38) ---------------------
CONTIG_ALIAS = {
    "chr1": "NC_000001.11", "chr2": "NC_000002.12", "chr3": "NC_000003.12",
    "chr4": "NC_000004.12", "chr5": "NC_000005.10", "chr6": "NC_000006.12",
    "chr7": "NC_000007.14", "chr8": "NC_000008.11", "chr9": "NC_000009.12",
    "chr10": "NC_000010.11", "chr11": "NC_000011.10", "chr12": "NC_000012.12",
    "chr13": "NC_000013.11", "chr14": "NC_000014.9", "chr15": "NC_000015.10",
    "chr16": "NC_000016.10", "chr17": "NC_000017.11", "chr18": "NC_000018.10",
    "chr19": "NC_000019.10", "chr20": "NC_000020.11", "chr21": "NC_000021.9",
    "chr22": "NC_000022.11", "chrX": "NC_000023.11", "chrY": "NC_000024.10",
    "chrM": "NC_012920.1", "chrMT": "NC_012920.1",
}

# --- fixed values: chromosome lengths in Mb (plot layout) ---------------------
CHROMOSOME_MB = {
    "1": 249, "2": 242, "3": 198, "4": 190, "5": 182, "6": 171, "7": 159, "8": 145,
    "9": 138, "10": 134, "11": 135, "12": 133, "13": 114, "14": 107, "15": 102, "16": 90,
    "17": 83, "18": 80, "19": 59, "20": 64, "21": 47, "22": 51, "X": 156, "Y": 57,
}
PLOT_GAP = 4

# --- fixed values: annotation vocabularies -----------------------------------
PANEL_LABEL = {"3": "green", "2": "amber", "1": "red"}
PANEL_RANK = {"green": 0, "amber": 1, "red": 2}
GO_ASPECTS = ["BP", "MF", "CC"]
LINK_CHANNELS = ["nscore", "fscore", "pscore", "ascore", "escore", "dscore", "tscore"]


def motif_width(pattern: str) -> int:
    """Nucleotides consumed by one match: a bracket group counts once."""
    width, rest = 0, pattern
    while rest:
        rest = rest[rest.index("]") + 1:] if rest[0] == "[" else rest[1:]
        width += 1
    return width


def regulatory_effects() -> list[tuple[str, str, str | None]]:
    """(protein, region, effect) rows: 9 families x 7 regions."""
    return [
        (protein, region, zones[ZONE_OF_REGION[region]])
        for protein, zones in ZONE_EFFECTS.items()
        for region in REGIONS
    ]


def literal_map(mapping: dict) -> Column:
    """A Spark map literal of a fixed dictionary."""
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
