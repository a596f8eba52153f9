"""License scans by ordered signature rules, in DataFrame functions only.

Texts are reduced to lower-case words set apart by single spaces.  A rule is a keyword,
a regular expression over that form, a label, a priority and a confidence.  A text that
holds none of the gate words is not searched at all, and a rule runs only where its own
keyword occurs.  A detection whose interval lies inside one of higher priority (or of
equal priority and greater length, or an equal one of an earlier rule) is suppressed.

The rules are hand-written names and phrases: every family has its name patterns, every
phrase says how a licence is granted or mentioned, and a rule is a phrase with a name.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # capitals included: lower-cased later
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# phrases whose every occurrence counts, with their labels
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# families: label, keyword of the prefilter, names as written (words only)
FAMILIES = [
    ("mit", "t", r"mit|expat"),
    ("mit-0", "mit", r"mit 0|mit no attribution"),
    ("apache-1.1", "apache", r"apache (?:software )?(?:license )?(?:version |v)?1 1"),
    ("apache-2.0", "apache", r"apache (?:software )?(?:license )?(?:version |v)?2(?: 0)?"),
    ("apache", "apache", r"apache(?: software)?"),
    ("gpl-1.0", "g", r"(?:gnu )?(?:gpl|general public license) ?(?:version |v)?1(?: 0)?"),
    ("gpl-2.0", "g", r"(?:gnu )?(?:gpl|general public license) ?(?:version |v)?2(?: 0)?"),
    ("gpl-3.0", "g", r"(?:gnu )?(?:gpl|general public license) ?(?:version |v)?3(?: 0)?"),
    ("gpl", "g", r"(?:gnu )?(?:gpl|general public license)"),
    ("lgpl-2.0", "l", r"(?:gnu )?(?:lgpl|(?:lesser|library) general public license) ?(?:version |v)?2 0"),
    ("lgpl-2.1", "l", r"(?:gnu )?(?:lgpl|lesser general public license) ?(?:version |v)?2 1"),
    ("lgpl-3.0", "l", r"(?:gnu )?(?:lgpl|lesser general public license) ?(?:version |v)?3(?: 0)?"),
    ("lgpl", "l", r"(?:gnu )?(?:lgpl|(?:lesser|library) general public license)"),
    ("agpl-3.0", "a", r"(?:gnu )?(?:agpl|affero general public license) ?(?:version |v)?3(?: 0)?"),
    ("agpl", "a", r"(?:gnu )?(?:agpl|affero general public license)"),
    ("gfdl", "free doc", r"(?:gnu )?free documentation license"),
    ("bsd-2-clause", "bsd", r"(?:simplified|freebsd|2 clause|two clause) bsd|bsd (?:2|two) clause"),
    ("bsd-3-clause", "bsd",
     r"(?:new|revised|modified|3 clause|three clause) bsd|bsd (?:3|three) clause"),
    ("bsd-4-clause", "bsd", r"(?:original|4 clause|four clause) bsd|bsd (?:4|four) clause"),
    ("0bsd", "bsd", r"0bsd|zero clause bsd"),
    ("bsd", "bsd", r"bsd"),
    ("mpl-1.1", "m", r"(?:mozilla public license|mpl) ?(?:version |v)?1 1"),
    ("mpl-2.0", "m", r"(?:mozilla public license|mpl) ?(?:version |v)?2(?: 0)?"),
    ("mpl", "m", r"mozilla public license|mpl"),
    ("epl-1.0", "e", r"(?:eclipse public license|epl) ?(?:version |v)?1(?: 0)?"),
    ("epl-2.0", "e", r"(?:eclipse public license|epl) ?(?:version |v)?2(?: 0)?"),
    ("eupl", "e", r"european union public licen[cs]e|eupl"),
    ("cddl", "c", r"common development and distribution license|cddl"),
    ("cc0-1.0", "c", r"cc0(?: 1 0)?|cc zero|creative commons zero"),
    ("cc-by-nc-nd", "c", r"(?:cc|creative commons) (?:by|attribution) (?:nc|noncommercial|non commercial)"
                         r" (?:nd|noderivatives|no derivatives)(?: [234] [05])?"),
    ("cc-by-nc-sa", "c", r"(?:cc|creative commons) (?:by|attribution) (?:nc|noncommercial|non commercial)"
                         r" (?:sa|sharealike|share alike)(?: [234] [05])?"),
    ("cc-by-nc", "c", r"(?:cc|creative commons) (?:by|attribution) (?:nc|noncommercial|non commercial)"
                      r"(?: [234] [05])?"),
    ("cc-by-sa", "c", r"(?:cc|creative commons) (?:by|attribution) (?:sa|sharealike|share alike)"
                      r"(?: [234] [05])?"),
    ("cc-by-nd", "c", r"(?:cc|creative commons) (?:by|attribution) (?:nd|noderivatives|no derivatives)"
                      r"(?: [234] [05])?"),
    ("cc-by", "c", r"(?:cc|creative commons) (?:by|attribution)(?: [234] [05])?"),
    ("isc", "isc", r"isc"),
    ("zlib", "zlib", r"zlib(?: libpng)?"),
    ("boost", "boost", r"boost(?: software)?(?: license)?(?: 1 0)?"),
    ("artistic-2.0", "artistic", r"artistic(?: license)? 2(?: 0)?"),
    ("artistic", "artistic", r"artistic"),
    ("python", "p", r"python(?: software foundation)?|psf"),
    ("openssl", "openssl", r"openssl"),
    ("wtfpl", "w", r"wtfpl|do what the fuck you want to public license"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("ofl", "o", r"(?:sil )?open font license(?: 1 1)?|ofl"),
    ("odbl", "o", r"open (?:database|data commons open database) license|odbl"),
    ("sspl", "s", r"server side public license|sspl"),
    ("busl", "bus", r"business source license|busl"),
    ("x11", "x11", r"x11"),
]

# phrases: pattern around the name, priority, confidence
PHRASES = [
    (r"(?:dual |re)?licensed under (?:the |a )?(?:terms of the )?(?:{0})(?: licen[cs]e)?", 90, 0.95),
    (r"(?:released|distributed|available|published|provided) under (?:the |a )?"
     r"(?:terms of the )?(?:{0})(?: licen[cs]e)?", 85, 0.95),
    (r"subject to (?:the )?(?:terms (?:and conditions )?of the )?(?:{0})(?: licen[cs]e)?", 80, 0.9),
    (r"under the terms of the (?:{0})(?: licen[cs]e)?", 75, 0.9),
    (r"spdx license identifier (?:{0})(?: only| or later)?", 95, 1.0),
    (r"(?:the )?(?:{0}) licen[cs]e", 60, 0.8),
    (r"licen[cs]e (?:is |the )*(?:{0})", 50, 0.7),
]
# mentions that need no family
PLAIN = [
    ("all-rights-reserved", "all rights reserved", r"all rights reserved", 40, 0.5),
    ("copyright", "copyright", r"copyright(?: c)? (?:19|20)[0-9]{2}", 30, 0.4),
    ("public-domain", "public domain", r"(?:in|into|to) the public domain", 45, 0.6),
    ("proprietary", "proprietary", r"proprietary and confidential", 45, 0.6),
    ("no-warranty", "warrant", r"without warrant(?:y|ies) of any kind", 20, 0.3),
    ("permissive-grant", "permission", r"permission is hereby granted free of charge", 55, 0.8),
]
# Single words, so that neither line ends nor hyphens between words matter.  Every rule needs
# one of them, and with it one of the words of COMPANIONS where it has an entry.
GATE = ["licen", "under", "subject", "copyright", "rights", "domain", "proprietary", "warrant",
        "permission"]
COMPANIONS = {
    "under": ["released", "distributed", "available", "published", "provided", "terms"],
    "rights": ["reserved"], "domain": ["public"], "proprietary": ["confidential"],
    "warrant": ["without"], "permission": ["granted"],
}


class Rule(NamedTuple):
    order: int
    label: str
    keyword: str
    pattern: str
    priority: int
    confidence: float


def rules() -> list[Rule]:
    """Every phrase with every family, then the plain mentions; more precise families
    (they come with a version) gain one point of priority per word of their label."""
    out = [
        (label, keyword, f" {phrase.format(name)}(?= )", priority + label.count("-"), confidence)
        for phrase, priority, confidence in PHRASES for label, keyword, name in FAMILIES
    ] + [(label, keyword, f" {pattern}(?= )", priority, confidence)
         for label, keyword, pattern, priority, confidence in PLAIN]
    return [Rule(i, *r) for i, r in enumerate(out)]


def _let(value: Column, body) -> Column:
    """Bind a value once for use in `body`."""
    return F.transform(F.array(value), body)[0]


def _rule_table(table: list[Rule]) -> Column:
    return F.array(*[
        F.struct(F.lit(r.order).alias("order"), F.lit(r.label).alias("label"),
                 F.lit(r.keyword).alias("keyword"), F.lit(r.pattern).alias("pattern"),
                 F.lit(r.priority).alias("priority"), F.lit(r.confidence).alias("confidence"))
        for r in table])


def _detections(norm: Column, rule: Column) -> Column:
    """All matches of one rule with their character interval; the gaps between the
    matches come from a split by the same pattern."""

    def placed(hits: Column, gaps: Column) -> Column:
        return F.transform(hits, lambda hit, i: F.struct(
            (F.length(F.array_join(F.slice(gaps, 1, i + 1), ""))
             + F.length(F.array_join(F.slice(hits, F.lit(1), i), ""))).alias("start"),
            (F.length(F.array_join(F.slice(gaps, 1, i + 1), ""))
             + F.length(F.array_join(F.slice(hits, F.lit(1), i), "")) + F.length(hit)).alias("end"),
            rule["order"].alias("order"), rule["label"].alias("label"),
            rule["priority"].alias("priority"), rule["confidence"].alias("confidence")))

    return _let(F.regexp_extract_all(norm, rule["pattern"], F.lit(0)), lambda hits: F.when(
        F.size(hits) > 0, _let(F.split(norm, rule["pattern"], -1), lambda gaps: placed(hits, gaps))
    ).otherwise(F.array().cast(
        "array<struct<start:int,end:int,order:int,label:string,priority:int,confidence:double>>")))


def _kept(found: Column) -> Column:
    """Containment suppression by priority, then length, then rule order."""
    rank = lambda d: F.struct(
        d["priority"].alias("p"), (d["end"] - d["start"]).alias("n"), (-d["order"]).alias("o"))
    return F.filter(found, lambda a: ~F.exists(found, lambda b: (
        (b["start"] <= a["start"]) & (b["end"] >= a["end"]) & (rank(b) > rank(a)))))


def _places(words: Column, phrase: str) -> Column:
    """Word indices where the phrase's words stand consecutively."""
    parts = phrase.split(" ")
    last = F.size(words) - len(parts)
    here = lambda i: F.lit(True)
    for k, part in enumerate(parts):
        here = (lambda prior, k, part: lambda i: prior(i) & (F.get(words, i + k) == part))(
            here, k, part)
    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), here)).otherwise(
        F.array().cast("array<int>"))


def _labelled(places: Column, label: str) -> Column:
    return F.transform(places, lambda i: F.struct(
        i.cast("int").alias("i"), F.lit(label).alias("label")))


def detected(docs: DataFrame, text: str = "text", out: str = "licenses") -> DataFrame:
    """All columns plus `out` (replaced if present): base places by word index, and the
    kept detections with character intervals in the reduced form.  Null where no gate
    word occurs; null text counts as empty."""
    body = F.coalesce(F.col(text), F.lit(""))
    lowered = F.lower(body)
    gate = F.lit(False)
    for word in GATE:
        beside = [lowered.contains(w) for w in COMPANIONS.get(word, [])]
        has = lowered.contains(word)
        gate = gate | (has & reduce(Column.__or__, beside) if beside else has)
    table = _rule_table(rules())

    def searched(words: Column) -> Column:
        norm = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
        places = F.concat(*[_labelled(_places(words, phrase), label) for phrase, label in BASE])
        kept = _let(norm, lambda n: _let(
            F.flatten(F.transform(
                F.filter(table, lambda r: n.contains(r["keyword"])),
                lambda r: _detections(n, r))), _kept))
        return F.struct(places.alias("places"), kept.alias("kept"))

    words = F.regexp_extract_all(
        F.translate(body, UPPER, LOWER), F.lit(WORD), F.lit(0))
    return docs.drop(out).withColumn(out, F.when(gate, _let(words, searched)))


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    Rows stand for themselves: repeated ones get equal results.  No base place: null
    words and an empty label list.  The score is the highest confidence kept, or 0.
    """
    found = detected(docs.select("doc_id", "text"))
    places, kept = F.col("licenses.places"), F.col("licenses.kept")
    empty = F.array().cast("array<string>")
    base = F.coalesce(F.array_distinct(F.transform(places, lambda p: p["label"])), empty)
    own = F.coalesce(F.transform(kept, lambda d: d["label"]), empty)
    at = F.transform(places, lambda p: p["i"])
    # the pattern without capitals excluded counts the same words as the lowered text
    return found.select(
        "doc_id",
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("bigint").alias("n_words"),
        F.coalesce(F.size(places).cast("bigint"), F.lit(0).cast("bigint")).alias("n_base"),
        F.array_min(at).cast("bigint").alias("first_word"),
        F.array_max(at).cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, own))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform(kept, lambda d: d["confidence"])), F.lit(0.0))
        .alias("score"),
    )
