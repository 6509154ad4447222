"""The lexicon as a dictionary: principal parts, gloss index and reverse lookup, neighbours, sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lines import CITATION, citation_lemma
from .precedence import first_of_equals
from .rulebook import RuleBook

#: Genitive of nouns and the other genders of adjectives, by paradigm, on the second stem.
GENITIVE = {(1, 1): "ae", (2, 1): "i", (2, 2): "i", (2, 3): "i", (3, 1): "is", (3, 2): "is", (4, 1): "us", (5, 1): "ei"}
GENDERS = {(1, 1): ("a", "um"), (3, 2): ("is", "e")}
INFINITIVE = {(1, 1): "are", (2, 1): "ere", (3, 1): "ere", (3, 4): "ire", (5, 1): "se"}
PASSIVE_INFINITIVE = {(1, 1): "ari", (2, 1): "eri", (3, 1): "i", (3, 4): "iri"}
#: Words that a gloss is not looked up by.
WEEDED = ["a", "an", "the", "of", "to", "in", "or", "be", "with", "and"]
FREQUENCY = {"A": 1, "B": 2, "C": 3, "D": 4, "E": 5, "F": 6}


def _by_paradigm(table: dict, pick=lambda x: x) -> Column:
    return F.coalesce(*[F.when((F.col("decl") == d) & (F.col("var") == v), pick(e)) for (d, v), e in table.items()], F.lit(""))


def dictionary_form(book: RuleBook) -> DataFrame:
    """lexeme_id and form: what a dictionary prints at the head of an entry."""
    parts = book.stems.groupBy("lexeme_id").agg(*[F.max(F.when(F.col("slot") == k, F.col("stem"))).alias(f"s{k}") for k in range(1, 5)])
    joined = book.lexemes.join(parts, "lexeme_id", "left").join(citation_lemma(book), "lexeme_id", "left")
    second = F.coalesce("s2", "s1")
    noun = F.concat_ws(", ", "lemma", F.concat(second, _by_paradigm(GENITIVE)))
    adjective = F.concat_ws(", ", "lemma", F.concat(second, _by_paradigm(GENDERS, lambda x: x[0])), F.concat(second, _by_paradigm(GENDERS, lambda x: x[1])))
    deponent = F.col("verb_kind") == "DEP"
    infinitive = F.concat(second, F.when(deponent, _by_paradigm(PASSIVE_INFINITIVE)).otherwise(_by_paradigm(INFINITIVE)))
    perfect = F.when(deponent, F.concat("s4", F.lit("us sum"))).otherwise(F.concat("s3", F.lit("i")))
    verb = F.concat_ws(", ", "lemma", infinitive, perfect, F.when(~deponent, F.concat("s4", F.lit("us"))))
    form = F.when(F.col("pos") == "N", F.concat_ws(" ", noun, F.lower("gender"))).when(F.col("pos") == "ADJ", adjective).when(F.col("pos") == "V", verb).otherwise(F.col("lemma"))
    return joined.select("lexeme_id", "pos", form.alias("form"))


def gloss_index(book: RuleBook) -> DataFrame:
    """word, lexeme_id, rank, semicolon: each content word of a gloss; the rank falls with the frequency
    class and with the gloss part (between semicolons) it stands in, and rises if it is the whole part."""
    part = F.posexplode(F.split("meaning", ";")).alias("semicolon", "part")
    words = book.lexemes.select("lexeme_id", "pos", "freq", part).select("*", F.posexplode(F.regexp_extract_all(F.lower("part"), F.lit("[a-z]+"), F.lit(0))).alias("place", "word"), F.trim(F.lower("part")).alias("whole"))
    kept = words.where(~F.col("word").isin(WEEDED) & (F.length("word") > 1))
    level = F.coalesce(*[F.when(F.col("freq") == k, v) for k, v in FREQUENCY.items()], F.lit(6))
    rank = 80 - level * 10 + F.when(F.col("word") == F.col("whole"), 25).otherwise(0) - F.least("semicolon", F.lit(5))
    return first_of_equals(kept.select("word", "lexeme_id", "pos", rank.alias("rank"), level.alias("level"), "semicolon"), ["word", "lexeme_id"], ["semicolon", "rank"])


def reverse_lookup(index: DataFrame, asked: DataFrame, best: int = 6) -> DataFrame:
    """For asked (word, part; part X is any) the best entries by rank, frequency and place."""
    hits = index.join(asked.select(F.lower("word").alias("word"), "part"), "word").where((F.col("part") == "X") | (F.col("part") == F.col("pos")))
    n = F.row_number().over(Window.partitionBy("word", "part").orderBy(F.desc("rank"), "level", "semicolon", "lexeme_id"))
    return hits.withColumn("n", n).where(F.col("n") <= best)


def neighbours(book: RuleBook, unknown: DataFrame, each: int = 3) -> DataFrame:
    """The stems before and after each unknown form, `each` on a side, among those with its first two letters."""
    bucket = F.left(F.col("stem"), F.lit(2))
    stems = book.stems.select("stem", bucket.alias("b")).distinct()
    near = unknown.select("form", F.left(F.col("form"), F.lit(2)).alias("b")).join(stems, "b")
    after = F.col("stem") >= F.col("form")
    rank = F.row_number().over(Window.partitionBy("form", after).orderBy(F.when(after, F.col("stem")), F.desc("stem")))
    return near.withColumn("n", rank).where(F.col("n") <= each).select("form", "stem", after.alias("after"))


def swept(readings: DataFrame, query: list[str], rare: list[str], ages: list[str]) -> DataFrame:
    """Without rare and out-of-age readings of questions that also have others. readings has freq and age."""
    odd = F.col("freq").isin(rare) | F.col("age").isin(ages)
    plain = F.max(F.when(odd, 0).otherwise(1)).over(Window.partitionBy(*query))
    return readings.withColumn("__plain", plain).where((F.col("__plain") == 0) | ~odd).drop("__plain")


def paper_order(entries: DataFrame, headword: str) -> DataFrame:
    return entries.orderBy(F.lower(headword), headword)


def citation_endings() -> dict:
    return dict(CITATION)
