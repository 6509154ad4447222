"""The lexical core: which lexemes and rules give a form, directly or by affixes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialize
from .precedence import first_of_equals, first_success
from .rulebook import RuleBook

#: What tells a question to the core: the form, its marked vowels, and whether it is a whole word (w) or
#: what an enclitic leaves (b), which the core treats a little differently.
KEY = ["form", "known", "long", "role"]
MORPHOLOGY = ["kind", "declension", "variant", "case", "number", "gender", "degree", "numeral_type", "tense", "voice", "mood", "person", "governs"]
ADDONS = ["prefix_id", "suffix_id", "tackon_id"]
ROW = [*KEY, "stage", "lexeme_id", "rule_id", "stem_key", "slot", "stem_begin", "stem", "ending", *ADDONS, *MORPHOLOGY, "quantity_match"]
INDECLINABLE = 9
#: Stem key to degree and to kind of numeral, where the lexeme leaves them open.
DEGREE_OF_KEY = {0: "POS", 1: "POS", 2: "POS", 3: "COMP", 4: "SUPER"}
NUMERAL_OF_KEY = {1: "CARD", 2: "ORD", 3: "DIST", 4: "ADVERB"}


@dataclass(frozen=True)
class Options:
    """Switches: a plan has no branch for what is off."""

    prefixes: bool = True
    suffixes: bool = True
    productive: bool = True
    tackons: bool = True
    packons: bool = True
    tickons: bool = True
    syncope: bool = True
    compounds: bool = True
    #: disabled, classical or medieval (both)
    orthography: str = "medieval"
    two_words: bool = False


def gender_fits(a: Column, b: Column) -> Column:
    """Unknown fits any; common fits masculine and feminine."""
    return (a == "X") | (b == "X") | (a == b) | ((a == "C") & b.isin("M", "F")) | ((b == "C") & a.isin("M", "F"))


def degree_fits(a: Column, b: Column) -> Column:
    return (a == "X") | (b == "X") | (a == b)


def paradigm_fits(decl: str, var: str) -> Column:
    """A rule of no paradigm fits all but the indeclinable; another its declension, its variant 0 any."""
    rule_decl, rule_var = F.col("rule_decl"), F.col("rule_var")
    general = (rule_decl == 0) & (rule_var == 0)
    same = (rule_decl == F.col(decl)) & ((rule_var == 0) | (rule_var == F.col(var)))
    return F.when(general, F.col(decl) != INDECLINABLE).otherwise(same)


def shown_paradigm(decl: str, var: str, kind: Column) -> list[Column]:
    """Verbs of the fourth conjugation are stored as (3, 4)."""
    fourth = (kind == "V") & (F.col(decl) == 3) & (F.col(var) == 4)
    return [F.when(fourth, 4).otherwise(F.col(decl)).alias("declension"), F.when(fourth, 1).otherwise(F.col(var)).alias("variant")]


def _map(column: Column, values: dict) -> Column:
    return F.coalesce(*[F.when(column == k, v) for k, v in values.items()], F.lit("X"))


def _no(column: str) -> Column:
    return F.lit(None).cast("int").alias(column)


def regular_match() -> Column:
    """Residual conditions of a stem with a rule, the cheap ones first."""
    pos, rule = F.col("pos"), F.col("rule_pos")
    parts = (pos == rule) | ((pos == "V") & rule.isin("VPAR", "SUPINE"))
    keys = (F.col("stem_key") == F.col("rule_key")) | ((F.col("stem_key") == 0) & F.col("rule_key").isin(1, 2))
    own = (
        F.when(pos == "N", gender_fits(F.col("gender"), F.col("rule_gender")))
        .when(pos.isin("ADJ", "ADV"), degree_fits(F.col("degree"), F.col("rule_degree")))
        .when(pos == "PRON", F.col("decl") != 1)
        .when(pos == "PREP", F.col("governs") == F.col("case"))
        .otherwise(pos != "PACK")
    )
    return parts & keys & paradigm_fits("decl", "var") & own


def regular_morphology() -> list[Column]:
    pos, kind = F.col("pos"), F.col("rule_pos")
    only = lambda c, *kinds: F.when(kind.isin(*kinds), F.col(c))
    nominal = ("N", "ADJ", "PRON", "NUM", "VPAR", "SUPINE")
    degree = F.when(F.col("degree") != "X", F.col("degree")).otherwise(_map(F.col("rule_key"), DEGREE_OF_KEY))
    numeral = F.when(F.coalesce(F.col("numeral_type"), F.lit("X")) != "X", F.col("numeral_type")).otherwise(_map(F.col("rule_key"), NUMERAL_OF_KEY))
    gender = F.when(pos == "N", F.col("gender")).when(kind.isin(*nominal), F.col("rule_gender"))
    return [
        kind.alias("kind"), *shown_paradigm("decl", "var", kind), only("case", *nominal).alias("case"), only("number", *nominal, "V").alias("number"), gender.alias("gender"),
        F.when(kind.isin("ADJ", "ADV"), degree).alias("degree"), F.when(kind == "NUM", numeral).alias("numeral_type"), only("tense", "V", "VPAR").alias("tense"),
        only("voice", "V", "VPAR").alias("voice"), only("mood", "V").alias("mood"), only("person", "V").alias("person"), F.when(kind == "PREP", F.col("case")).alias("governs"),
    ]


def suffix_morphology() -> list[Column]:
    kind = F.col("rule_pos")
    only = lambda c, *kinds: F.when(kind.isin(*kinds), F.col(c))
    nominal = ("N", "ADJ", "NUM", "VPAR", "SUPINE")
    degree = F.when(F.col("target_degree") != "X", F.col("target_degree")).otherwise(_map(F.col("target_key"), DEGREE_OF_KEY))
    return [
        kind.alias("kind"), *shown_paradigm("target_decl", "target_var", kind), only("case", *nominal).alias("case"), only("number", *nominal, "V").alias("number"),
        F.when(kind == "N", F.col("target_gender")).when(kind.isin(*nominal), F.col("rule_gender")).alias("gender"), F.when(kind.isin("ADJ", "ADV"), degree).alias("degree"),
        F.when(kind == "NUM", _map(F.col("target_key"), NUMERAL_OF_KEY)).alias("numeral_type"), only("tense", "V", "VPAR").alias("tense"), only("voice", "V", "VPAR").alias("voice"),
        only("mood", "V").alias("mood"), only("person", "V").alias("person"), F.lit(None).cast("string").alias("governs"),
    ]


def _observed(what: str, begin: str, size: str) -> Column:
    return F.expr(f"shiftright({what}, {begin}) & (shiftleft(1L, {size}) - 1L)")


def summed_masks(book: RuleBook) -> DataFrame:
    """One row of masks (k, l) a subject; of inflections and suffixes whatever the slot."""
    slot = F.when(F.col("subject") == "STEM", F.col("slot")).alias("slot")
    return book.quantities.groupBy("subject", "subject_id", slot).agg(F.bit_or("known").alias("k"), F.bit_or("long").alias("l"))


def with_quantity(rows: DataFrame, quantities: DataFrame, suffix: bool = False) -> DataFrame:
    """Drops rows whose stored vowel lengths contradict marked ones; adds quantity_match: unspecified
    without marks, exact if every mark is confirmed, else unknown. Stored masks are sparse: none is zero.

    rows has stem_begin, stem_size (without the suffix), suffix_size and ending_size. quantities is of `summed_masks`.
    """
    masks = lambda subject, key: quantities.where(F.col("subject") == subject).select(*key, "k", "l")
    stem = masks("STEM", ["subject_id", "slot"]).select(F.col("subject_id").alias("lexeme_id"), "slot", F.col("k").alias("sk"), F.col("l").alias("sl"))
    rule = masks("INFLECTION", ["subject_id"]).select(F.col("subject_id").alias("rule_id"), F.col("k").alias("rk"), F.col("l").alias("rl"))
    out = rows.join(stem, ["lexeme_id", "slot"], "left").join(rule, "rule_id", "left")
    parts = [("sk", "sl", "stem_begin", "stem_size"), ("rk", "rl", "stem_begin + stem_size + suffix_size", "ending_size")]
    if suffix:
        fix = masks("SUFFIX", ["subject_id"]).select(F.col("subject_id").alias("suffix_id"), F.col("k").alias("fk"), F.col("l").alias("fl"))
        out = out.join(fix, "suffix_id", "left")
        parts.append(("fk", "fl", "stem_begin + stem_size", "suffix_size"))
    wrong, confirmed = F.lit(False), F.lit(0).cast("long")
    for k, l, begin, size in parts:  # noqa: E741
        stored_known, stored_long = F.coalesce(F.col(k), F.lit(0).cast("long")), F.coalesce(F.col(l), F.lit(0).cast("long"))
        seen = _observed("known", begin, size).bitwiseAND(stored_known)
        wrong = wrong | (_observed("long", begin, size).bitwiseXOR(stored_long).bitwiseAND(seen) != 0)
        confirmed = confirmed + F.bit_count(seen)
    match = F.when(F.col("known") == 0, "unspecified").when(confirmed == F.bit_count("known"), "exact").otherwise("unknown")
    return out.where(~wrong).withColumn("quantity_match", match)


class Core:
    """The lookups over one rule book. Each method takes distinct questions and returns rows of ROW.

    Every lookup writes its rows before the next one is planned: the driver holds what a plan sends out, and its
    compiled code, of one lookup at a time.
    """

    def __init__(self, book: RuleBook, options: Options = Options()):  # noqa: B008
        self.book, self.options = book, options
        self.entries = materialize(book.stems.join(book.lexemes, "lexeme_id"), "entries")
        self.quantities = materialize(summed_masks(book).coalesce(1), "masks")
        self.longest = {t: book.longest(t, "fix") for t in ("prefixes", "suffixes", "tackons")}
        self.longest["rules"] = book.longest("rules", "ending")

    def candidates(self, questions: DataFrame) -> DataFrame:
        """Every way to cut a form into a stem and the ending of a rule."""
        n = F.explode(F.sequence(F.lit(0), F.least(F.lit(self.longest["rules"]), F.length("form")))).alias("ending_size")
        cut = questions.select(*KEY, n).withColumns({"ending": F.expr("right(form, ending_size)"), "rest": F.expr("left(form, length(form) - ending_size)")})
        return cut.join(self.book.rules, "ending")

    def _rows(self, df: DataFrame, stage: str, morphology: list[Column], quantity: bool = True, suffix: bool = False) -> DataFrame:
        """ROW from joined columns; those that are missing are null or zero."""
        have = set(df.columns)
        for c in (*ADDONS, "rule_id"):
            if c not in have:
                df = df.withColumn(c, F.lit(None).cast("int"))
        for c in ("stem_begin", "suffix_size"):
            if c not in have:
                df = df.withColumn(c, F.lit(0))
        df = df.withColumn("stem_size", F.length("stem"))
        if quantity:
            df = with_quantity(df, self.quantities, suffix)
        else:
            df = df.withColumn("quantity_match", F.when(F.col("known") == 0, "unspecified").otherwise("unknown"))
        shown = F.concat("stem", F.col("fix")) if suffix else F.col("stem")
        keep = [*KEY, F.lit(stage).alias("stage"), "lexeme_id", "rule_id", F.col("rule_key").alias("stem_key"), "slot", "stem_begin", shown.alias("stem"), "ending", *ADDONS]
        return df.select(*keep, *morphology, "quantity_match")

    def uniques(self, questions: DataFrame) -> DataFrame:
        """Whole words stored as they are; the ending is empty and there is no rule."""
        found = questions.join(self.book.uniques.withColumnRenamed("surface", "form"), "form").withColumns({"stem": F.col("form"), "ending": F.lit(""), "rule_key": F.lit(0), "slot": F.lit(0), "ending_size": F.lit(0)})
        variant = F.when((F.col("kind") == "PRON") & (F.col("declension") == 1), 0).otherwise(F.col("variant")).alias("variant")
        none = F.lit(None).cast("string")
        morphology = ["kind", "declension", variant, "case", "number", "gender", "degree", none.alias("numeral_type"), "tense", "voice", "mood", "person", none.alias("governs")]
        return self._rows(found, "unique", morphology, quantity=False)

    def qu_pronouns(self, candidates: DataFrame) -> DataFrame:
        """Pronouns whose stem begins qu- or cu-: what a form begins with says which stem it must have."""
        form = F.col("form")
        short, ali = F.length("form") >= 3, F.length("form") >= 6
        qu = (short & form.startswith("qu")) | (ali & form.startswith("aliqu"))
        cu = (short & form.startswith("cu")) | (ali & form.startswith("alicu"))
        cut = candidates.where("rule_pos = 'PRON'").where((qu & (F.col("rule_key") == 1)) | (~qu & cu & (F.col("rule_key") == 2)))
        entries = self.entries.where("pos = 'PRON' and decl = 1").withColumnRenamed("stem", "rest")
        found = cut.join(entries, "rest").where("decl = rule_decl and var = rule_var").withColumn("stem", F.col("rest"))
        return self._rows(found, "qu_pronoun", self._pronoun(), quantity=False)

    def _pronoun(self) -> list[Column]:
        none = lambda c, t="string": F.lit(None).cast(t).alias(c)
        return [F.lit("PRON").alias("kind"), F.col("rule_decl").alias("declension"), F.lit(0).alias("variant"), "case", "number", F.col("rule_gender").alias("gender"),
                none("degree"), none("numeral_type"), none("tense"), none("voice"), none("mood"), none("person", "int"), none("governs")]

    def packons(self, questions: DataFrame) -> DataFrame:
        """A form of qui, quis before an ending that the lexeme asks for."""
        base = self._strip(questions, self.book.tackons.where("packon"), "tackon_id").where("length(base) >= 3").where(F.col("base").rlike("^[qc]u"))
        cut = self.candidates(base.select(F.col("base").alias("form"), "known", "long", "role").distinct()).where("rule_pos = 'PRON'")
        entries = self.entries.where("pos = 'PACK'").withColumnRenamed("stem", "rest")
        found = cut.join(entries, "rest").where("decl = rule_decl and var = rule_var").withColumnRenamed("form", "base")
        rule = (F.col("base_decl").isin(0) | (F.col("base_decl") == F.col("rule_decl"))) & (F.col("base_var").isin(0) | (F.col("base_var") == F.col("rule_var")))
        met = base.join(found, ["base", "known", "long", "role"]).where(rule & (F.col("required_packon") == F.col("tackon_id"))).withColumn("stem", F.col("rest"))
        return self._rows(met, "packon", self._pronoun(), quantity=False)

    def _strip(self, questions: DataFrame, tackons: DataFrame, name: str) -> DataFrame:
        k = F.explode(F.sequence(F.lit(1), F.least(F.lit(self.longest["tackons"]), F.length("form") - 1))).alias("k")
        ends = questions.where("length(form) > 1").select(*KEY, k).withColumns({"fix": F.expr("right(form, k)"), "base": F.expr("left(form, length(form) - k)")})
        return ends.join(tackons.withColumnRenamed("addon_id", name), "fix").drop("k")

    def tickons(self, questions: DataFrame) -> DataFrame:
        """A prefix of the pack class before a qu- or cu- form; the first that gives rows."""
        k = F.explode(F.sequence(F.lit(1), F.least(F.lit(self.longest["prefixes"]), F.length("form") - 1))).alias("k")
        cut = questions.where("length(form) > 1").select(*KEY, k).withColumn("fix", F.expr("left(form, k)"))
        hit = cut.join(self.book.prefixes.where("tickon"), "fix").withColumn("base", F.expr("substr(form, k + 1)")).where(self._connects("base"))
        hit = hit.where("length(base) >= 3").where(F.col("base").rlike("^[qc]u")).select(*KEY, F.col("addon_id").alias("prefix_id"), "base", "k")
        bases = hit.select(F.col("base").alias("form"), F.lit(0).cast("long").alias("known"), F.lit(0).cast("long").alias("long"), "role").distinct()
        bases = materialize(bases, "tickon_bases")
        rows = self.qu_pronouns(self.candidates(bases))
        if self.options.packons:
            rows = rows.unionByName(self.packons(bases))
        rows = materialize(rows, "tickon_rows").drop("known", "long", "prefix_id", "stem_begin", "stage").withColumnRenamed("form", "base")
        met = hit.join(rows, ["base", "role"]).withColumns({"stage": F.lit("tickon"), "stem_begin": F.col("k")})
        met = met.withColumn("quantity_match", F.when(F.col("known") == 0, "unspecified").otherwise("unknown"))
        return first_success(met, KEY, ["prefix_id"]).select(*ROW)

    @staticmethod
    def _connects(rest: str) -> Column:
        return (F.col("connector") == "") | (F.left(F.col(rest), F.lit(1)) == F.col("connector"))

    def regular(self, candidates: DataFrame) -> DataFrame:
        entries = self.entries.withColumnRenamed("stem", "rest")
        found = candidates.join(entries, "rest").where(regular_match()).withColumn("stem", F.col("rest"))
        return self._rows(found, "regular", regular_morphology())

    def _prefixed(self, cut: DataFrame, rest: str) -> DataFrame:
        """Adds prefix_id, root and base for every prefix a column of stems begins with."""
        k = F.explode(F.sequence(F.lit(1), F.least(F.lit(self.longest["prefixes"]), F.length(rest) - 1))).alias("k")
        starts = cut.where(F.length(rest) > 1).select("*", k).withColumn("fix_p", F.expr(f"left({rest}, k)"))
        rules = self.book.prefixes.where("not tickon").select(F.col("fix").alias("fix_p"), F.col("addon_id").alias("prefix_id"), "connector", F.col("root_pos").alias("prefix_root"))
        return starts.join(rules, "fix_p").withColumn("base", F.expr(f"substr({rest}, k + 1)")).where(self._connects("base")).drop("connector")

    @staticmethod
    def _prefix_root(part: str) -> Column:
        return (F.col("prefix_root") == F.col(part)) | ((F.col("prefix_root") == "X") & F.col(part).isin("N", "ADJ", "ADV", "V"))

    def prefixes(self, candidates: DataFrame) -> DataFrame:
        """The first prefix, by id, after which a regular analysis stands."""
        hit = self._prefixed(candidates, "rest").drop("rest")
        found = hit.join(self.entries.withColumnRenamed("stem", "base"), "base").where(self._prefix_root("pos") & regular_match())
        rows = self._rows(found.withColumns({"stem": F.col("base"), "stem_begin": F.col("k")}), "prefix", regular_morphology())
        return first_success(rows, KEY, ["prefix_id"])

    def suffixes(self, candidates: DataFrame, with_regular: DataFrame) -> DataFrame:
        """Derived stems: a suffix makes another part of speech of a stem. Of questions that have regular
        rows only suffixes that may coexist; others also try, for a suffix whose base is no stem, the
        first prefix that helps."""
        k = F.explode(F.sequence(F.lit(1), F.least(F.lit(self.longest["suffixes"]), F.length("rest") - 1))).alias("k")
        marked = candidates.join(with_regular.select(*KEY, F.lit(True).alias("has_regular")), KEY, "left").withColumn("has_regular", F.coalesce("has_regular", F.lit(False)))
        ends = marked.where("length(rest) > 1").select("*", k).withColumn("fix", F.expr("right(rest, k)"))
        hit = ends.join(self.book.suffixes.withColumnRenamed("addon_id", "suffix_id").drop("addon_meaning"), "fix").withColumn("base", F.expr("left(rest, length(rest) - k)"))
        hit = hit.where((F.col("connector") == "") | (F.right(F.col("base"), F.lit(1)) == F.col("connector"))).where("coexists or not has_regular").drop("connector")
        hit = materialize(hit.withColumn("suffix_size", F.col("k")).drop("k", "rest"), "suffix_cuts")
        known = self.entries.select(F.col("stem").alias("base")).distinct()
        stemmed = hit.join(known, "base", "left_semi").select(*KEY, "suffix_id").distinct()
        entries = self.entries.withColumnRenamed("stem", "base").withColumnRenamed("gender", "lex_gender").withColumnRenamed("degree", "lex_degree")
        plain = hit.join(entries, "base").where(self._suffix_match())
        rows = materialize(self._rows(plain.withColumn("stem", F.col("base")), "suffix", suffix_morphology(), suffix=True), "suffixed")
        if not (self.options.prefixes and self.options.productive):
            return rows
        left = hit.where("not has_regular").join(stemmed, [*KEY, "suffix_id"], "left_anti")
        both = self._prefixed(left.withColumnRenamed("base", "inner"), "inner").drop("inner").where(self._prefix_root("target_pos"))
        found = both.join(entries, "base").where(self._suffix_match()).withColumns({"stem": F.col("base"), "stem_begin": F.col("k")})
        more = materialize(self._rows(found, "prefix_suffix", suffix_morphology(), suffix=True), "both")
        return rows.unionByName(first_success(more, [*KEY, "suffix_id"], ["prefix_id"]))

    @staticmethod
    def _suffix_match() -> Column:
        """Residual conditions of a rule with a suffix's target, and of a stem with its root."""
        pos, rule, target = F.col("pos"), F.col("rule_pos"), F.col("target_pos")
        parts = (target == rule) | ((target == "V") & rule.isin("VPAR", "SUPINE"))
        keys = (F.col("target_key") == F.col("rule_key")) | ((F.col("target_key") == 0) & F.col("rule_key").isin(1, 2))
        own = F.when(target == "N", gender_fits(F.col("target_gender"), F.col("rule_gender"))).when(target.isin("ADJ", "ADV"), degree_fits(F.col("target_degree"), F.col("rule_degree"))).otherwise(True)
        root = (F.col("root_pos") == "X") | (F.col("root_pos") == pos) | ((pos == "PACK") & (F.col("root_pos") == "PRON"))
        root_key = (F.col("root_key") == 0) | (F.col("root_key") == F.col("stem_key")) | ((F.col("stem_key") == 0) & pos.isin("N", "ADJ", "V") & F.col("root_key").isin(1, 2))
        root_paradigm = ((F.col("root_decl") == 0) | (F.col("root_decl") == F.col("decl"))) & ((F.col("root_var") == 0) | (F.col("root_var") == F.col("var")))
        return parts & keys & paradigm_fits("target_decl", "target_var") & own & root & root_key & root_paradigm

    def words(self, questions: DataFrame) -> DataFrame:
        """Uniques, tickons, pronouns, regular rows, and prefixes and suffixes where these allow them."""
        o = self.options
        cut = materialize(self.candidates(questions), "candidates")
        direct = self.uniques(questions).unionByName(self.qu_pronouns(cut))
        if o.tickons:
            direct = direct.unionByName(materialize(self.tickons(questions.where("role = 'w'")), "tickons"))
        regular = materialize(self.regular(cut), "regular")
        rows = materialize(direct.unionByName(regular), "direct")
        if not o.productive:
            return rows
        has_direct = rows.where("stage <> 'regular'").select(*KEY).distinct()
        has_regular = rows.where("stage = 'regular'").select(*KEY).distinct()
        open_ = cut.join(has_direct, KEY, "left_anti")
        if o.prefixes:
            prefixed = materialize(self.prefixes(open_.join(has_regular, KEY, "left_anti")), "prefixed")
            rows = rows.unionByName(prefixed)
            open_ = open_.join(prefixed.select(*KEY).distinct(), KEY, "left_anti")
        if o.suffixes:
            adverb = rows.where("stage = 'regular' and kind = 'ADV'").select(*KEY).distinct()
            open_ = materialize(open_.join(adverb, KEY, "left_anti"), "open")
            rows = rows.unionByName(self.suffixes(open_, has_regular))
        return rows

    def _tackons(self, questions: DataFrame, bases: DataFrame, enclitic: bool, stage: str) -> DataFrame:
        """The first enclitic, by id, whose base has rows it accepts; with direct_hit only -que."""
        rules = self.book.tackons.where(~F.col("packon") & (F.col("enclitic") == enclitic))
        cut = self._strip(questions, rules, "tack")
        if enclitic:
            cut = cut.join(questions.select(*KEY, "direct_hit"), KEY).where("not direct_hit or fix = 'que'")
        # the base has the marks of its own letters
        size = "length(base)"
        cut = cut.withColumns({"bk": F.expr(f"known & (shiftleft(1L, {size}) - 1L)"), "bl": F.expr(f"long & (shiftleft(1L, {size}) - 1L)")})
        renamed = bases.drop("role", "tackon_id").withColumnsRenamed({"form": "base", "known": "bk", "long": "bl", "stage": "base_stage"})
        decl = ((F.col("base_decl") == 0) | (F.col("base_decl") == F.col("declension"))) & ((F.col("base_var") == 0) | (F.col("base_var") == F.col("variant")))
        accepts = (F.col("base_pos") == "X") | (F.col("base_pos").isin("N", "PRON", "ADJ") & (F.col("base_pos") == F.col("kind")) & decl)
        met = cut.join(renamed, ["base", "bk", "bl"]).where(accepts).withColumns({"stage": F.lit(stage), "tackon_id": F.col("tack")})
        return first_success(met, KEY, ["tack"]).select(*ROW)

    def bases(self, questions: DataFrame) -> DataFrame:
        """What every enclitic leaves of the questions' forms."""
        cut = self._strip(questions, self.book.tackons.where("not packon"), "tack")
        mask = lambda c: F.expr(f"{c} & (shiftleft(1L, length(base)) - 1L)").alias(c)
        return cut.select(F.col("base").alias("form"), mask("known"), mask("long"), F.lit("b").alias("role")).distinct()

    def analyze(self, forms: DataFrame) -> DataFrame:
        """All rows of distinct (form, known, long), sorted out and without duplicates."""
        o = self.options
        questions = forms.select("form", "known", "long", F.lit("w").alias("role")).distinct()
        questions = materialize(questions, "asked")
        asked = materialize(questions.unionByName(self.bases(questions)), "asked_bases") if o.tackons else questions
        found = materialize(self.words(asked), "words")
        rows = found.where("role = 'w'")
        if o.packons:
            rows = rows.unionByName(materialize(self.packons(questions), "packons"))
        if o.tackons:
            strength = materialize(rows.groupBy(*KEY).agg(F.bool_or(F.col("suffix_id").isNull()).alias("direct_hit")), "strength")
            marked = questions.join(strength, KEY, "left").withColumn("direct_hit", F.coalesce("direct_hit", F.lit(False)))
            base_rows = found.where("role = 'b'")
            enclitic = materialize(self._tackons(marked, base_rows, True, "tackon"), "enclitics")
            # an enclitic on a base beats rows that all come by suffixes
            weak = strength.where("not direct_hit").join(enclitic.select(*KEY).distinct(), KEY, "left_semi").select(*KEY)
            rows = materialize(rows.join(weak, KEY, "left_anti").unionByName(enclitic), "rows")
            empty = questions.join(rows.select(*KEY).distinct(), KEY, "left_anti")
            rows = rows.unionByName(materialize(self._tackons(empty, base_rows, False, "other_tackon"), "others"))
        return materialize(sort_out(rows), "analyses")


def sort_out(rows: DataFrame) -> DataFrame:
    """One row of those that differ in the rule only: that of the least rule."""
    same = [c for c in ROW if c not in ("rule_id", "stage", "quantity_match", "slot")]
    return first_of_equals(rows, same, ["rule_id", "stage", "slot"]).drop("role")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
