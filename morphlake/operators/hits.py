"""Hits and witnesses for display and review: tags against parts of speech, grouping, triage, marked headwords, weeding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The dictionary's parts of speech that agree with each universal tag.
POS_COMPATIBILITY = {
    "ADJ": ("ADJ",),
    "ADP": ("PREP", "ADP"),
    "ADV": ("ADV",),
    "AUX": ("VERB", "AUX"),
    "CCONJ": ("CONJ", "CCONJ"),
    "INTJ": ("INTERJ", "INTJ"),
    "NOUN": ("NOUN",),
    "NUM": ("NUM", "ADJ"),
    "PART": ("PART", "ADV"),
    "PRON": ("PRON",),
    "PROPN": ("NOUN", "PROPN"),
    "SCONJ": ("CONJ", "SCONJ"),
    "VERB": ("VERB",),
}
# Other names of parts of speech.
POS_ALIASES = {"N": "NOUN", "S": "NOUN", "SUBST": "NOUN", "V": "VERB", "A": "ADJ", "PREPOSITION": "PREP", "CONJUNCTION": "CONJ"}

# What a witness flag makes of a review's priority.
HIGH_RISK = ("independent_quantity_conflict", "multiple_entries_in_independent_family")
MEDIUM_RISK = (
    "derived_quantity_conflict", "derived_quantity_disagreement", "inferred_part_of_speech_witness", "reference_only_witness", "structure_not_cross_validated",
)

# Words of glosses that an index leaves out.
WEEDED = (
    "DECL", "DAT", "ACC", "ABL", "ADJ", "AD", "BC", "COMP", "SUPER", "DEMONST", "INDEF", "INF", "KLUDGE", "NE", "NW", "SE", "SW", "NT", "OT", "PASS", "L+S", "St",
    "a", "an", "the", "The", "no", "ad", "de", "bi", "di", "re", "ex", "abb", "st", "nd", "rd", "th",
)

# Weights of how frequent a lexeme and a rule are.
LEXICAL_WEIGHTS = {
    "very_frequent": 11.0, "frequent": 10.0, "common": 9.0, "lesser": 8.0, "uncommon": 7.0, "very_rare": 6.0, "inscription": 5.0, "graffiti": 4.0, "pliny": 5.0,
}
RULE_WEIGHTS = {
    "most_frequent": 5.5, "sometimes": 5.0, "uncommon": 4.5, "infrequent": 4.0, "rare": 3.5, "very_rare": 3.0, "inscription": 2.5, "reserved_m": 0.0, "reserved_n": 0.0,
}
NO_RULE, FINITE = 5.5, 2.0


def _lookup(values: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def pos_assessment(upos: Column, dictionary_pos: Column) -> Column:
    """compatible or conflict; unknown without a part of speech or for a tag that is none."""
    name = F.nullif(F.upper(F.trim(dictionary_pos)), F.lit(""))
    name = F.coalesce(_lookup(POS_ALIASES, name), name)
    agrees = reduce(lambda x, kv: x.when(upos == kv[0], name.isin(*kv[1])), POS_COMPATIBILITY.items(), F.when(F.lit(False), F.lit(False)))
    return F.when(name.isNull() | agrees.isNull(), "unknown").when(agrees, "compatible").otherwise("conflict")


def pos_overall(assessments: Column) -> list[Column]:
    """Of all hits of a word, as an aggregate: compatible if one is; conflict if all are; mixed_or_unknown if some are."""
    any_of = lambda x: F.coalesce(F.bool_or(assessments == x), F.lit(False))
    return F.when(any_of("compatible"), "compatible").when(any_of("conflict") & ~any_of("unknown"), "conflict").when(any_of("conflict"), "mixed_or_unknown").otherwise("unknown")


def group_hits(hits: DataFrame, by: str, place: str, lexeme: str) -> DataFrame:
    """(by, group_no, lexeme, places): hits of one lexeme together, groups in the order of their first hits; a hit without a lexeme is a
    group of its own."""
    alone = F.when(F.col(lexeme).isNull(), F.col(place))
    groups = hits.groupBy(by, lexeme, alone.alias("__alone")).agg(F.array_sort(F.collect_list(place)).alias("places")).drop("__alone")
    return groups.withColumn("group_no", F.row_number().over(Window.partitionBy(by).orderBy(F.col("places")[0])).cast("long"))


def triage(witnesses: DataFrame, by: str, given: Column) -> DataFrame:
    """witnesses (by, family, entry, independent, reference_only, inferred, flags) to (by, families, flags, priority).

    families lists each with its number of distinct entries; `given` is an array of flags from before. Entries are counted before
    anything is gathered; what is gathered is a row a family, or one of the flags above.
    """
    entries = witnesses.groupBy(by, "family", "entry").agg(F.bool_or("independent").alias("i"), F.bool_or("reference_only").alias("r"), F.bool_or("inferred").alias("p"), F.flatten(F.collect_set(given)).alias("f"))
    entries = entries.withColumn("f", F.array_distinct("f"))
    families = entries.groupBy(by, "family").agg(F.bool_or("i").alias("i"), F.bool_or("r").alias("r"), F.bool_or("p").alias("p"), F.count("*").alias("n"), F.array_distinct(F.flatten(F.collect_set("f"))).alias("f"))
    many = F.bool_or(F.col("i") & (F.col("n") > 1))
    name = lambda c, x: F.when(c, F.lit(x))
    text = F.concat_ws(":", "family", F.col("n").cast("string"), F.when(F.col("i"), "independent").otherwise("derived"))
    said = F.array_compact(F.array(name(F.bool_or("r"), "reference_only_witness"), name(F.bool_or("p"), "inferred_part_of_speech_witness"), name(many, "multiple_entries_in_independent_family")))
    out = families.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(text)), ",").alias("families"), F.array_sort(F.array_union(said, F.flatten(F.collect_set("f")))).alias("f"))
    risk = lambda x: F.arrays_overlap("f", F.array(*map(F.lit, x)))
    priority = F.when(risk(HIGH_RISK), "high").when(risk(MEDIUM_RISK), "medium").otherwise("normal")
    return out.select(by, "families", F.array_join("f", ",").alias("flags"), priority.alias("priority"))


def sense_kind(text: Column, fallback: Column) -> Column:
    """crossref_only where a sense only points elsewhere, else entry_fallback or sense."""
    points = text.rlike(r"^(?i:cf|see|v|vide|voir|veja|vgl)(?:$|[^\p{L}\p{N}_])")
    return F.when(points, "crossref_only").when(fallback, "entry_fallback").otherwise("sense")


MACRON, BREVE = "̄", "̆"
#: Vowels with a mark as one character, and as two.
COMPOSED = [(c, b + m) for m, row in ((MACRON, "āēīōūȳ"), (BREVE, "ăĕĭŏŭ")) for c, b in zip(row, "aeiouy", strict=False)]


def marked_headword(lemma: Column, require_quantity: bool = True) -> dict[str, Column]:
    """letters, marks (L long, S short, . none; a character a letter) and capital of a lemma's first word. All are null where it goes on
    after an editorial mark or as a second word, where a letter is not a to z or has another mark, or none is marked though one must be."""
    word = F.regexp_extract(lemma, r"\p{L}[\p{L}\p{Mn}]*", 0)
    open_ = lemma.rlike(r"^\P{L}*\p{L}[\p{L}\p{Mn}]*(?:[\^_-]|[ \t\n\r\f]+)\p{L}")
    spelt = reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), COMPOSED, F.lower(word))
    good = ~open_ & spelt.rlike(f"^(?:[a-z][{MACRON}{BREVE}]?)+$")
    if require_quantity:
        good = good & spelt.rlike(f"[{MACRON}{BREVE}]")
    marks = F.regexp_replace(F.regexp_replace(F.regexp_replace(spelt, f"[a-z]{MACRON}", "L"), f"[a-z]{BREVE}", "S"), "[a-z]", ".")
    start = F.substring(word, 1, 1)
    return {"letters": F.when(good, F.regexp_replace(spelt, f"[{MACRON}{BREVE}]", "")), "marks": F.when(good, marks), "capital": F.when(good, start != F.lower(start))}


def is_weeded(word: Column) -> Column:
    """Words of one character, abbreviations, areas and the words that say nothing."""
    return (F.length(word) <= 1) | word.isin(*WEEDED) | word.endswith(".") | word.endswith(":")


def candidate_score(lexical: Column, rule: Column, has_rule: Column, finite: Column) -> tuple[Column, Column]:
    """The score of a candidate and the ids of what it is made of. A form without a rule counts as an ordinary one."""
    first = _lookup(LEXICAL_WEIGHTS, lexical)
    second = F.when(rule.isNotNull(), F.coalesce(_lookup(RULE_WEIGHTS, rule), F.lit(0.0))).when(~has_rule, NO_RULE)
    third = F.when(finite, FINITE)
    parts = [(F.when(lexical.isNotNull(), F.coalesce(first, F.lit(0.0))), "S001"), (second, "S002"), (third, "S012")]
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c, _ in parts]), F.concat_ws(",", *[F.when(c.isNotNull(), F.lit(n)) for c, n in parts])


def sample_summary(samples: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, count, least, median, p95, most, mean): percentiles are the sample at floor((n - 1) f). Equal values are counted first, so that the
    window over a key has a row a value."""
    counts = samples.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy(value)
    upto = counts.withColumns({"upto": F.sum("n").over(w), "all": F.sum("n").over(Window.partitionBy(*by))})
    at = lambda f: F.min(F.when(F.col("upto") > F.floor((F.col("all") - 1) * f), F.col(value)))
    return upto.groupBy(*by).agg(
        F.sum("n").alias("count"), F.min(value).alias("least"), at(0.5).alias("median"), at(0.95).alias("p95"), F.max(value).alias("most"), (F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias("mean")
    )
