"""The word pipeline around the core: numerals, respelling, contraction, splits, assessment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.roman import roman_is_strict, roman_value
from ..sources.shared import materialize
from .analyze import ADDONS, Core, Options, union_all
from .precedence import first_success
from .rulebook import RuleBook

VOWEL, CONSONANT = "[aeiouy]", "[^aeiouy]"
#: What a question is: the marked spelling, plain letters, lookup key, marked vowels.
QUESTION = ["normalized", "orthography", "lookup", "known", "long"]
REWRITES = ["rewrites", "stem", "ending"]
#: Whole left parts that are prefixes rather than words, in two-word splits.
COMMON_PREFIXES = ["dis", "ex", "in", "per", "prae", "pro", "re", "si", "sub", "super", "trans"]
#: Short imperatives that stand without an ending.
SHORT_IMPERATIVES = ["dic", "duc", "fac", "fer"]
AUXILIARY = {"esse": "esse", "fuisse": "fuisse", "iri": "iri"}


def rewrite_attempts(words: DataFrame, rules: DataFrame) -> DataFrame:
    """Every rewriting of a word: word, rewrite_id, priority, position, removed, replacement, rewritten and
    attempt (what orders the attempts of one priority).

    Literal rules meet the word's substrings of their length by equality. A slur turns the last letter of
    an initial text into the consonant after it, and back. A lone consonant between vowels is doubled.
    """
    size = F.length("word")
    sizes = sorted(r["n"] for r in rules.where("operation = 'LITERAL'").select(F.length("before").alias("n")).distinct().collect())

    def spots_of(n: int) -> Column:  # a function of one parameter: a second one would be the index
        return F.transform(F.sequence(F.lit(0), size - n), lambda p: F.struct(p.alias("position"), F.lit(n).alias("removed")))

    spots = [F.when(size >= n, spots_of(n)) for n in sizes]
    columns = ["word", "rewrite_id", "priority", "reverse", "position", "removed", "replacement"]
    made = []
    if sizes:
        at = words.select("word", F.explode(F.flatten(F.array_compact(F.array(*spots)))).alias("s")).select("word", "s.*")
        at = at.withColumn("before", F.expr("substr(word, position + 1, removed)"))
        met = at.join(rules.where("operation = 'LITERAL'"), "before").where("position >= min_before and position + removed + min_after <= length(word)")
        scope = (F.col("scope") == "INTERNAL") | ((F.col("scope") == "INITIAL") & (F.col("position") == 0)) | ((F.col("scope") == "FINAL") & (F.col("position") + F.col("removed") == size))
        made.append(met.where(scope).withColumn("replacement", F.col("after")).select(*columns))
    slurs = rules.where("operation = 'SLUR' and length(before) >= 2").withColumn("head", F.expr("left(before, length(before) - 1)"))
    longest = slurs.agg(F.max(F.length("before"))).first()[0]
    if longest:
        heads = words.select("word", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest - 1), size - 3))).alias("k")) if longest > 1 else words.limit(0)
        met = heads.where("length(word) > 3").withColumn("head", F.expr("left(word, k)")).join(slurs, "head").where("length(word) >= length(before) + 2")
        after = F.expr("substr(word, length(before) + 1, 1)")
        last = F.expr("substr(word, length(before), 1)")
        whole = F.col("word").startswith(F.col("before"))
        out = F.when(whole, F.concat("head", after, after)).when(last == after, F.concat("before", after))
        met = met.where(after.rlike(CONSONANT)).withColumns({"replacement": out, "position": F.lit(0), "removed": F.length("before") + 1})
        made.append(met.where("replacement is not null").select(*columns))
    doubles = rules.where("operation = 'DOUBLE_CONSONANT'")
    at = words.where("length(word) > 2").select("word", F.explode(F.sequence(F.lit(1), size - 2)).alias("position"))
    at = at.where(F.expr(f"substr(word, position + 1, 1) rlike '{CONSONANT}' and substr(word, position, 1) rlike '{VOWEL}' and substr(word, position + 2, 1) rlike '{VOWEL}'"))
    letter = F.expr("substr(word, position + 1, 1)")
    at = at.withColumns({"operation": F.lit("DOUBLE_CONSONANT"), "removed": F.lit(1), "replacement": F.concat(letter, letter)})
    made.append(at.join(doubles, "operation").select(*columns))
    out = union_all(made).withColumn("rewritten", F.expr("concat(left(word, position), replacement, substr(word, position + removed + 1))"))
    order = F.struct(F.when(F.col("reverse"), 0).otherwise(1).alias("r"), F.when(F.col("reverse"), -F.col("position")).otherwise(F.col("position")).alias("p"), F.col("rewrite_id").alias("i"))
    return out.withColumn("attempt", order)


def rewrite_accepts() -> Column:
    """Whether a row of a rewritten word has what its rule asks for."""
    key = (F.col("required_key") == 0) | (F.col("stem_key") == F.col("required_key"))
    part = (F.col("required_pos") == "X") | (F.col("required_pos").isin("V", "ADJ") & (F.col("kind") == F.col("required_pos")))
    eo = (F.col("kind") == "V") & (F.col("declension") == 6) & (F.col("variant") == 1)
    iis = (F.col("kind") == "ADJ") & (F.col("declension") == 1) & (F.col("variant") == 1) & F.col("case").isin("DAT", "ABL") & (F.col("number") == "P")
    held = F.when(F.col("constraint") == "EO_VERB", eo).when(F.col("constraint") == "ADJECTIVE_IIS", iis).otherwise(True)
    return key & part & held


def no_addon() -> Column:
    return F.coalesce(*[F.col(c) for c in ADDONS]).isNull()


def plain_or_tackon() -> Column:
    return F.col("prefix_id").isNull() & F.col("suffix_id").isNull()


class Analyzer:
    """Analyses of distinct words. Each stage is one core run over the distinct spellings it makes."""

    def __init__(self, book: RuleBook, options: Options = Options()):  # noqa: B008
        self.book, self.options, self.core = book, options, Core(book, options)

    def lexical(self, spellings: DataFrame) -> DataFrame:
        """Core rows of distinct plain spellings (column word), with no marked vowels."""
        forms = spellings.select("word", F.translate("word", "jv", "iu").alias("form")).distinct()
        zero = F.lit(0).cast("long")
        rows = self.core.analyze(forms.select("form", zero.alias("known"), zero.alias("long")).distinct())
        return forms.join(rows.drop("known", "long", "quantity_match"), "form").drop("form").withColumn("rewrites", F.array().cast("array<int>"))

    def rewritten(self, words: DataFrame, kind: str, stage: str, syncope_too: bool) -> DataFrame | None:
        """Rows of the first rewriting of each word that gives any its rule accepts; None if no word can be
        rewritten at all, which spares the core run."""
        rules = self.book.rewrites.where((F.col("kind") == kind) & (F.col("stage") == stage)).withColumnRenamed("kind", "rewrite_kind")
        if kind == "ORTHOGRAPHIC" and self.options.orthography == "classical":
            rules = rules.where("not medieval")
        attempts = materialize(rewrite_attempts(words.select("word").distinct(), rules), "attempts")
        if not attempts.take(1):
            return None
        spellings = attempts.select(F.col("rewritten").alias("word")).distinct()
        rows = self.lexical(spellings)
        inner = self.rewritten(spellings.withColumn("word", F.translate("word", "jv", "iu")).distinct(), "SYNCOPE", "MAIN", False) if syncope_too and self.options.syncope else None
        if inner is not None:
            inner = materialize(inner, "inner")
            inner = spellings.select("word", F.translate("word", "jv", "iu").alias("u")).join(inner.withColumnRenamed("word", "u"), "u").drop("u")
            # a contraction that holds beats readings that all need an affix
            only = rows.groupBy("word").agg(F.bool_and(~no_addon()).alias("weak")).where("weak").join(inner.select("word").distinct(), "word", "left_semi").select("word")
            rows = rows.join(only, "word", "left_anti").unionByName(inner)
        met = attempts.join(rows.withColumnRenamed("word", "rewritten"), "rewritten").join(rules.select("rewrite_id", "required_pos", "required_key", "constraint"), "rewrite_id")
        fits = met.where(rewrite_accepts() & (plain_or_tackon() if kind == "SYNCOPE" else no_addon()))
        best = first_success(fits, ["word"], ["priority", "attempt"])
        best = best.withColumn("rewrites", F.concat(F.array("rewrite_id"), "rewrites"))
        return best.drop("rewritten", "rewrite_id", "priority", "attempt", "reverse", "position", "removed", "replacement", "required_pos", "required_key", "constraint")

    def _answers(self, questions: DataFrame, rows: DataFrame, key: str, stage: str) -> DataFrame:
        match = F.when(F.col("known") == 0, "unspecified").otherwise("unknown")
        return questions.join(rows.withColumnRenamed("word", key), key).withColumns({"stage": F.lit(stage), "quantity_match": match})

    def analyze(self, questions: DataFrame) -> DataFrame:
        """All readings of distinct QUESTION rows; questions without one have no row."""
        o = self.options
        questions = materialize(questions.select(*QUESTION).distinct(), "questions")
        forms = questions.select(F.col("lookup").alias("form"), "known", "long").distinct()
        core = self.core.analyze(forms).withColumnRenamed("form", "lookup").withColumn("rewrites", F.array().cast("array<int>"))
        rows = materialize(questions.join(core, ["lookup", "known", "long"]), "lexical")
        numerals = questions.where(roman_is_strict(F.col("normalized"))).select(*QUESTION).withColumn("roman", roman_value(F.col("normalized")))
        names = rows.columns
        q = QUESTION
        without = lambda done: questions.join(done.select(*q).distinct(), q, "left_anti")
        if o.orthography != "disabled":
            plain = rows.where(F.size("rewrites") == 0)
            early = without(plain.select(*q).unionByName(numerals.select(*q)))
            found = self.rewritten(early.select(F.col("orthography").alias("word")), "ORTHOGRAPHIC", "EARLY", True)
            if found is not None:
                rows = materialize(rows.unionByName(self._answers(early, found, "orthography", "orthography").select(*names)), "early")
        if o.syncope:
            sum_verb = rows.join(self.book.lexemes.where("verb_kind = 'TO_BE'").select("lexeme_id"), "lexeme_id", "left_semi").where("kind = 'V'")
            single = rows.groupBy(*q).agg(F.count("*").alias("n"), F.bool_and(F.col("tackon_id").isNotNull() & plain_or_tackon()).alias("t")).where("n = 1 and t")
            open_ = without(sum_verb.select(*q).unionByName(single.select(*q)))
            found = self.rewritten(open_.select(F.col("lookup").alias("word")), "SYNCOPE", "MAIN", False)
            if found is not None:
                found = materialize(self._answers(open_, found, "lookup", "syncope").select(*names), "syncope")
                weak = rows.groupBy(*q).agg(F.bool_and(~no_addon()).alias("w")).where("w").join(found.select(*q).distinct(), q, "left_semi").select(*q)
                rows = materialize(rows.join(weak, q, "left_anti").unionByName(found), "contracted")
        if o.tackons and o.orthography != "disabled":
            strong = (F.size("rewrites") > 0) | no_addon() | F.col("suffix_id").isNotNull() | (F.col("tackon_id").isNotNull() & F.col("prefix_id").isNull())
            open_ = without(rows.where(strong).select(*q).unionByName(numerals.select(*q)))
            found = self._enclitic_respelled(open_)
            if found is not None:
                found = materialize(found.select(*names), "respelled")
                rows = materialize(rows.join(found.select(*q).distinct(), q, "left_anti").unionByName(found), "enclitics")
        if o.orthography != "disabled":
            left = without(rows.select(*q).unionByName(numerals.select(*q)))
            found = self.rewritten(left.select(F.col("orthography").alias("word")), "ORTHOGRAPHIC", "FALLBACK", True)
            if found is not None:
                rows = rows.unionByName(self._answers(left, found, "orthography", "orthography").select(*names))
        numeral = numerals.withColumns({c: F.lit(None).cast(rows.schema[c].dataType) for c in names if c not in q}).withColumns({"stage": F.lit("roman"), "kind": F.lit("NUM")})
        out = rows.withColumn("roman", F.lit(None).cast("long")).unionByName(numeral)
        return materialize(self.assess(out), "readings")

    def _enclitic_respelled(self, questions: DataFrame) -> DataFrame | None:
        """Without an enclitic the base is a known word spelled otherwise: the first enclitic that helps."""
        rules = self.book.tackons.where("enclitic and not packon")
        longest = self.core.longest["tackons"]
        k = F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("lookup") - 1))).alias("k")
        cut = questions.where("length(lookup) > 1").select("*", k).withColumn("fix", F.expr("right(lookup, k)")).join(rules.select("fix", F.col("addon_id").alias("tack")), "fix")
        cut = materialize(cut.withColumn("word", F.expr("left(orthography, length(orthography) - k)")), "bases")
        rows = self.rewritten(cut.select("word").distinct(), "ORTHOGRAPHIC", "EARLY", True)
        if rows is None:
            return None
        met = cut.join(rows, "word").withColumns({"tackon_id": F.col("tack"), "stage": F.lit("orthography_tackon"), "quantity_match": F.when(F.col("known") == 0, "unspecified").otherwise("unknown")})
        return first_success(met, QUESTION, ["tack"])

    def assess(self, rows: DataFrame) -> DataFrame:
        """Adds trim (why a strict dictionary would leave a reading out) and notices."""
        joined = rows.join(self.book.lexemes.select("lexeme_id", "verb_kind"), "lexeme_id", "left")
        v = lambda **x: (F.col("kind") == "V") & _all(*[F.col(c) == value for c, value in x.items()])
        finite = F.col("mood").isin("IND", "SUB", "IMP")
        imperative = v(mood="IMP")
        short = v(declension=3, variant=1, tense="PRES", voice="ACTIVE", mood="IMP", person=2, number="S") & (F.col("ending") == "") & ~F.right(F.col("stem"), F.lit(3)).isin(SHORT_IMPERATIVES)
        good = (v(tense="PRES", person=2)) | ((F.col("tense") == "FUT") & (F.col("person") != 1))
        kind = F.col("verb_kind")
        system = F.col("tense").isin("PRES", "IMPF", "FUT")
        perfect = F.col("tense").isin("PERF", "PLUP", "FUTP")
        deponent = v(voice="ACTIVE") & F.col("mood").isin("IND", "SUB", "IMP", "INF") & ~((F.col("mood") == "INF") & (F.col("tense") == "FUT"))
        reasons = {
            "unsupported_short_imperative": short, "invalid_imperative_person": imperative & ~good, "impersonal_non_third_person": (kind == "IMPERS") & v() & (F.col("person") != 3),
            "deponent_active_form": (kind == "DEP") & deponent, "semideponent_passive_present_system": (kind == "SEMIDEP") & v(voice="PASSIVE") & finite & system,
            "semideponent_active_perfect_system": (kind == "SEMIDEP") & v(voice="ACTIVE") & finite & perfect,
        }
        found = joined.withColumn("trim", F.array_compact(F.array(*[F.when(c, name) for name, c in reasons.items()])))
        own = F.when((kind == "IMPERS") & v(number="P") & finite, F.array(F.lit("source_disagreement"))).otherwise(F.array().cast("array<string>"))
        notices = self.book.notices.groupBy("lexeme_id").agg(F.collect_list(F.struct("trigger", "notice")).alias("stored"))
        found = found.join(notices, "lexeme_id", "left")
        stored = F.transform(F.filter(F.coalesce("stored", F.expr("cast(array() as array<struct<trigger:string,notice:string>>)")), lambda x: F.array_contains("trim", x["trigger"])), lambda x: x["notice"])
        return found.withColumn("notices", F.array_distinct(F.concat(own, stored))).drop("verb_kind", "stored")

    def two_words(self, questions: DataFrame, readings: DataFrame) -> DataFrame:
        """For words without a reading: the first cut into two that the core knows, the right of three
        letters or more, the left not a common prefix; title-cased words are left alone (column titled)."""
        unknown = questions.join(readings.select(*QUESTION).distinct(), QUESTION, "left_anti").where("not titled and length(lookup) >= 5")
        cut = unknown.select(*QUESTION, F.explode(F.sequence(F.lit(2), F.length("lookup") - 3)).alias("cut"))
        cut = cut.withColumns({"left_part": F.expr("left(lookup, cut)"), "right_part": F.expr("substr(lookup, cut + 1)")}).where(~F.col("left_part").isin(COMMON_PREFIXES))
        cut = materialize(cut, "cuts")
        zero = F.lit(0).cast("long")
        parts = cut.select(F.explode(F.array("left_part", "right_part")).alias("form")).distinct()
        rows = self.core.analyze(parts.select("form", zero.alias("known"), zero.alias("long")))
        known = rows.groupBy("form").agg(F.bool_or(F.col("kind") == "NUM").alias("num"))
        left, right = known.select(F.col("form").alias("left_part"), F.col("num").alias("ln")), known.select(F.col("form").alias("right_part"), F.col("num").alias("rn"))
        best = first_success(cut.join(left, "left_part").join(right, "right_part"), QUESTION, ["cut"])
        return best.withColumn("classification", F.when(F.col("ln") & F.col("rn"), "number-pair").otherwise("two-words")).drop("ln", "rn")


def _all(*conditions: Column) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def trimmed(rows: DataFrame, reasons: list[str]) -> DataFrame:
    """Without readings that have any of the reasons."""
    return rows.where(~F.arrays_overlap("trim", F.array(*[F.lit(r) for r in reasons]))) if reasons else rows
