"""Candidate evidence: rollups over ambiguous forms, corroboration, masks, templates, readiness, attachment scores."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def candidate_stats(matches: DataFrame, form: str, key: str, occurrences: str, top: int = 20) -> DataFrame:
    """(key, upper_bound, exclusive, ambiguous, top_forms, priority) from one row a form and key: occurrences of all its forms,
    of those no other key has, and of the others; its most frequent forms; and its place, exclusive ones first."""
    keys = matches.groupBy(form).agg(F.count("*").alias("n"))
    m = matches.join(keys, form).withColumn("own", F.col("n") == 1)
    sums = m.groupBy(key).agg(
        F.sum(occurrences).alias("upper_bound"), F.sum(F.when(F.col("own"), F.col(occurrences)).otherwise(0)).alias("exclusive"), F.sum(F.when(~F.col("own"), F.col(occurrences)).otherwise(0)).alias("ambiguous")
    )
    # the best forms are found by a window, so that only they are gathered
    w = Window.partitionBy(key).orderBy(F.desc(occurrences), form)
    best = m.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= top)
    text = F.concat_ws(":", form, F.col(occurrences), F.when(F.col("own"), "own").otherwise("shared"))
    lists = best.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rn", text.alias("t")))).alias("top"))
    out = sums.join(lists, key, "left").withColumn("top_forms", F.array_join(F.col("top.t"), ","))
    order = Window.orderBy(F.desc("exclusive"), F.desc("upper_bound"), key)  # a row a key
    return out.select(key, "upper_bound", "exclusive", "ambiguous", "top_forms", F.row_number().over(order).cast("long").alias("priority"))


def corroborated(marks: DataFrame, candidate: list[str], spot: list[str], mark: str, family: str, least: int = 2) -> DataFrame:
    """The candidates all of whose marks `least` families give, and no family contradicts."""
    votes = marks.groupBy(*spot, mark).agg(F.countDistinct(family).alias("families"))
    kinds = votes.groupBy(*spot).agg(F.count("*").alias("kinds"))
    judged = marks.join(votes, [*spot, mark]).join(kinds, spot).withColumn("good", (F.col("families") >= least) & (F.col("kinds") == 1))
    return judged.groupBy(*candidate).agg(F.bool_and("good").alias("good"), F.count("*").alias("marks")).where("good").drop("good")


def longest_consensus(rows: DataFrame, by: list[str], size: str, known: str, long: str) -> DataFrame:
    """What the rows of the longest size say together: known bits without those in conflict, and which of them are long."""
    longest = rows.groupBy(*by).agg(F.max(size).alias(size))
    m = rows.join(longest, [*by, size]).groupBy(*by).agg(F.bit_or(known).alias("k"), F.bit_or(long).alias("l"), F.bit_or(F.col(known).bitwiseAND(F.bitwise_not(F.col(long)))).alias("s"), F.count("*").alias("slots"))
    conflict = F.col("l").bitwiseAND(F.col("s"))
    sure = F.col("k").bitwiseAND(F.bitwise_not(conflict))
    return m.select(*by, "slots", sure.alias("known"), F.col("l").bitwiseAND(sure).alias("long"))


def stem_template(slots: DataFrame, external: DataFrame, by: list[str]) -> DataFrame:
    """slots (by, slot, spelling), external (by, number, spelling): which number each slot is, for what has exactly
    one number for every slot."""
    numbers = external.groupBy(*by, "spelling").agg(F.count("*").alias("n"), F.min("number").alias("number"))
    met = slots.join(numbers, [*by, "spelling"], "left")
    pair = F.struct("slot", "number", F.concat_ws(":", "slot", "number").alias("t"))
    found = met.groupBy(*by).agg(F.bool_and(F.coalesce(F.col("n") == 1, F.lit(False))).alias("ok"), F.array_sort(F.collect_list(pair)).alias("p")).where("ok")
    return found.select(*by, F.array_join(F.col("p.t"), ",").alias("template"))


def draft_readiness(strict: Column, structure: Column, gender: Column, form_status: Column) -> Column:
    """not_ready unless all hold and the forms are attested or unknown; cross_validated where they are attested."""
    ready = strict & structure & gender & form_status.isin("all_slots_attested", "unavailable")
    return F.when(~F.coalesce(ready, F.lit(False)), "not_ready").when(form_status == "all_slots_attested", "cross_validated").otherwise("empirical_structure")


def ranking_score(score: Column, agreements: Column, overlap: Column, same_gender: Column, conflict: Column, cosine: Column | None = None) -> Column:
    """A base score with small bonuses and a penalty; a supported cosine is the least it can be."""
    out = score + F.least(F.lit(0.08), agreements * 0.02) + F.when(overlap, 0.05).otherwise(0.0) + F.when(same_gender, 0.02).otherwise(0.0) - F.when(conflict, 0.15).otherwise(0.0)
    return out if cosine is None else F.greatest(out, F.coalesce(cosine, out))


def attachment_scores(found: DataFrame, gold: DataFrame, by: list[str]) -> DataFrame:
    """found (by, dependent, head, label), gold (by, alternative, dependent, head, label): the best unlabelled and labelled share
    over the alternatives, and whether the root (head null) is that of any."""
    f = found.select(*by, "dependent", F.col("head").alias("h"), F.col("label").alias("l"), F.lit(True).alias("has"))
    same = F.col("has") & F.col("head").eqNullSafe(F.col("h"))
    each = gold.join(f, [*by, "dependent"], "left").groupBy(*by, "alternative").agg(
        F.avg(F.coalesce(same, F.lit(False)).cast("int")).alias("uas"), F.avg(F.coalesce(same & F.col("label").eqNullSafe(F.col("l")), F.lit(False)).cast("int")).alias("las"),
        F.bool_or(F.coalesce(same & F.col("head").isNull(), F.lit(False))).alias("root"),
    )
    return each.groupBy(*by).agg(F.max("uas").alias("uas"), F.max("las").alias("las"), F.bool_or("root").alias("root_correct"))


def factor_counts(events: DataFrame, event: str, contexts: list[Column]) -> DataFrame:
    """(level, context, event, n): how often an event follows each context, from none to the longest."""
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), c.alias("context")) for k, c in enumerate([F.lit(""), *contexts])])).alias("x")
    return events.select(F.col(event).alias("event"), levels).select("x.level", "x.context", "event").groupBy("level", "context", "event").agg(F.count("*").alias("n"))


# text of dictionaries


def normal_meaning(meaning: Column) -> Column:
    """Without control characters and spaces at the ends, nor a bar in front."""
    t = F.regexp_replace(meaning, r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    return F.regexp_replace(t, r"^\|[\x00-\x20]*", "")


def short_meaning(meaning: Column) -> Column:
    """The first two clauses of a gloss, up to a bracket or a line end."""
    t = F.substring_index(F.regexp_extract(normal_meaning(meaning), r"^[^\[\n\r]*", 0), ";", 2)
    return F.regexp_replace(F.regexp_replace(t, " +$", ""), ";+$", "")


#: Letters below U+0250 that decompose to an ASCII letter, and what they decompose to.
_COMPOSED = [(chr(c), d[0]) for c in range(0xC0, 0x250) if (d := unicodedata.normalize("NFKD", chr(c)).lower())[0].isascii() and d[0].isalpha() and all(unicodedata.combining(x) for x in d[1:])]
MARKED, PLAIN = "āēīōūȳăĕĭŏŭ", "aeiouyaeiou"


def ascii_lookup(text: Column) -> Column:
    """The letters a to z of a word, lower-cased and without marks; null where others are left."""
    t = F.lower(text)
    for a, b in (("æ", "ae"), ("œ", "oe"), ("ß", "ss")):
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.regexp_replace(F.translate(t, "".join(a for a, _ in _COMPOSED), "".join(b for _, b in _COMPOSED)), r"\p{Mn}", "")
    return F.when(t.rlike("^[a-z]+$"), t)


def strip_quantity_marks(text: Column) -> Column:
    """Without macrons and breves, composed or not."""
    return F.regexp_replace(F.translate(text, MARKED + MARKED.upper(), PLAIN + PLAIN.upper()), "[̄̆]", "")


def prompt(instruction: str, language: Column, text: Column) -> Column:
    return F.format_string("Instruct: %s\nQuery: [language=%s]\n%s", F.lit(instruction), F.coalesce(language, F.lit("")), F.coalesce(text, F.lit("")))


def abbreviation_conflict(form: Column, period: Column, has_noun_abbreviation: Column) -> Column:
    """One capital that is a Roman numeral too, before a period, with a reading as an abbreviated noun: the numeral is in doubt."""
    return period & form.isin(*"ACDLM") & has_noun_abbreviation
