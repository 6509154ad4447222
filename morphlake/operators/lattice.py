"""Sentences as lattices of readings: edges between them, limits on their number, checks of assignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .selection import classify, compatibility

#: Columns of a candidate: sentence, token, cand, kind, case, number, gender, person, mood, governs, enclitic.
CANDIDATE = "sentence long, token int, cand int, kind string, case string, number string, gender string, person int, mood string, governs string, enclitic string"
NOMINAL = ["N", "PRON", "ADJ", "NUM", "VPAR"]
COORDINATING = "que"


def _sides(candidates: DataFrame, governor: Column, dependent: Column) -> DataFrame:
    names = [c for c in candidates.columns if c != "sentence"]
    g = candidates.where(governor).select("sentence", *[F.col(c).alias(f"g_{c}") for c in names])
    d = candidates.where(dependent).select("sentence", *[F.col(c).alias(f"d_{c}") for c in names])
    return g.join(d, "sentence")


def _edges(pairs: DataFrame, kind: str, compatible: Column) -> DataFrame:
    return pairs.select("sentence", F.lit(kind).alias("relation"), F.col("g_token").alias("gov_token"), F.col("g_cand").alias("gov_cand"), F.col("d_token").alias("dep_token"), F.col("d_cand").alias("dep_cand"), compatible.alias("compatible"))


def agreement(*columns: str) -> Column:
    """True if all agree, false if one disagrees, null if what is known agrees but not all is known."""
    parts = [compatibility(F.col(f"g_{c}"), F.col(f"d_{c}")) for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def relation_edges(candidates: DataFrame) -> DataFrame:
    """Typed edges between candidates of a sentence, with a three-valued compatibility: a preposition and a
    later nominal by case; a finite verb and any nominal by number and case; a modifier and a nominal by
    case, number and gender; an enclitic -que and an earlier word of its kind and case."""
    kind = F.col("kind")
    nominal = kind.isin(NOMINAL)
    finite = (kind == "V") & F.col("mood").isin("IND", "SUB", "IMP")
    preposition = _sides(candidates, kind == "PREP", nominal).where("d_token > g_token")
    subject = _sides(candidates, finite, nominal & (F.col("case") == "NOM")).where("d_token <> g_token")
    modifier = _sides(candidates, kind.isin("N", "PRON"), kind.isin("ADJ", "VPAR", "NUM")).where("d_token <> g_token")
    coordinate = _sides(candidates, nominal | (kind == "V"), F.col("enclitic") == COORDINATING).where("d_token > g_token")
    return (
        _edges(preposition, "complement", compatibility(F.col("g_governs"), F.col("d_case")))
        .unionByName(_edges(subject, "subject", agreement("number")))
        .unionByName(_edges(modifier, "modifier", agreement("case", "number", "gender")))
        .unionByName(_edges(coordinate, "coordination", agreement("kind") & F.coalesce(compatibility(F.col("g_case"), F.col("d_case")), F.lit(True))))
    )


def domain_products(candidates: DataFrame) -> DataFrame:
    """sentence and the logarithm of the number of assignments: what tells exact search from a beam."""
    sizes = candidates.groupBy("sentence", "token").agg(F.count("*").alias("n"))
    return sizes.groupBy("sentence").agg(F.count("*").alias("tokens"), F.sum(F.log("n")).alias("log_product"))


def assignments(candidates: DataFrame, most: int) -> DataFrame:
    """Every choice of one candidate a token, for sentences of at most `most` assignments: (sentence,
    assignment, token, cand). An assignment is a number in mixed radix over the tokens: it is counted
    out, not joined. Sentences beyond the limit have no row; a beam serves them."""
    from pyspark.sql import Window

    small = domain_products(candidates).where(F.col("log_product") <= F.log(F.lit(float(most))) + 1e-9)
    sizes = candidates.groupBy("sentence", "token").agg(F.array_sort(F.collect_list("cand")).alias("cands"))  # a token's readings
    w = Window.partitionBy("sentence").orderBy("token")
    log_before = F.coalesce(F.sum(F.log(F.size("cands"))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    placed = sizes.join(small, "sentence").withColumn("before", F.round(F.exp(log_before)).cast("long"))
    total = F.round(F.exp("log_product")).cast("long")
    spread = placed.select("sentence", "token", "cands", "before", F.explode(F.sequence(F.lit(0).cast("long"), total - 1)).alias("assignment"))
    pick = F.get("cands", (F.floor(F.col("assignment") / F.col("before")) % F.size("cands")).cast("int"))
    return spread.select("sentence", "assignment", "token", pick.alias("cand"))


def violations(chosen: DataFrame, candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """(sentence, assignment, violation): the first hard rule that an assignment breaks, null if none:
    H002 no finite verb; H003 a single nominative that disagrees in number with all third-person verbs;
    H005 a preposition without a later nominal that can be in its case; H007 -que without an earlier match."""
    full = chosen.join(candidates, ["sentence", "token", "cand"])
    finite = (F.col("kind") == "V") & F.col("mood").isin("IND", "SUB", "IMP")
    held = edges.where("compatible is null or compatible").select("sentence", "relation", "gov_token", "gov_cand", "dep_token", "dep_cand")
    g = chosen.select("sentence", "assignment", F.col("token").alias("gov_token"), F.col("cand").alias("gov_cand"))
    d = chosen.select("sentence", "assignment", F.col("token").alias("dep_token"), F.col("cand").alias("dep_cand"))
    met = held.join(g, ["sentence", "gov_token", "gov_cand"]).join(d, ["sentence", "assignment", "dep_token", "dep_cand"])
    complement = met.where("relation = 'complement'").select("sentence", "assignment", F.col("gov_token").alias("token"), F.lit(True).alias("has_complement")).distinct()
    pair = met.where("relation = 'coordination'").select("sentence", "assignment", F.col("dep_token").alias("token"), F.lit(True).alias("has_pair")).distinct()
    full = full.join(complement, ["sentence", "assignment", "token"], "left").join(pair, ["sentence", "assignment", "token"], "left")
    subject = (F.col("case") == "NOM") & F.col("kind").isin("N", "PRON")
    third = finite & (F.col("person") == 3)
    facts = full.groupBy("sentence", "assignment").agg(
        F.bool_or(finite).alias("finite"), F.sum(subject.cast("int")).alias("subjects"), F.max(F.when(subject, F.col("number"))).alias("subject_number"),
        F.sum(third.cast("int")).alias("thirds"), F.collect_set(F.when(third, F.col("number"))).alias("numbers"),
        F.bool_or((F.col("kind") == "PREP") & F.col("has_complement").isNull()).alias("lone_preposition"), F.bool_or((F.col("enclitic") == COORDINATING) & F.col("has_pair").isNull()).alias("lone_que"),
    )
    disagree = (F.col("subjects") == 1) & (F.col("thirds") > 0) & ~F.array_contains("numbers", F.col("subject_number"))
    rule = classify([("H002", ~F.col("finite")), ("H003", disagree), ("H005", F.col("lone_preposition")), ("H007", F.col("lone_que"))], "")
    return facts.select("sentence", "assignment", F.nullif(rule, F.lit("")).alias("violation"))


def survivor_digest(checked: DataFrame) -> DataFrame:
    """sentence, survivors and a digest of their numbers: equal for equal sets, whatever found them."""
    ok = checked.where("violation is null")
    return ok.groupBy("sentence").agg(F.count("*").alias("survivors"), F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("assignment")).cast("array<string>")), 256).alias("digest"))
