"""The rule tables of the morphological analyzer: schemas, loading, validation."""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import materialize

#: Columns of each table. Grammatical values are short upper-case names; X is unknown or any. Keys, endings
#: and fixes are lower case with j as i and v as u.
SCHEMAS = {
    "lexemes": "lexeme_id int, pos string, decl int, var int, gender string, degree string, numeral_type string, verb_kind string, governs string, required_packon int, age string, freq string, source string, meaning string",
    "stems": "lexeme_id int, slot int, stem_key int, stem string",
    "rules": "rule_id int, rule_pos string, rule_decl int, rule_var int, case string, number string, rule_gender string, rule_degree string, tense string, voice string, mood string, person int, rule_key int, ending string, rule_age string, rule_freq string",
    "prefixes": "addon_id int, fix string, connector string, root_pos string, tickon boolean, addon_meaning string",
    "suffixes": "addon_id int, fix string, connector string, root_pos string, root_key int, root_decl int, root_var int, target_pos string, target_decl int, target_var int, target_gender string, target_degree string, target_key int, coexists boolean, addon_meaning string",
    "tackons": "addon_id int, fix string, base_pos string, base_decl int, base_var int, enclitic boolean, packon boolean, addon_meaning string",
    "rewrites": "rewrite_id int, kind string, priority int, stage string, operation string, scope string, reverse boolean, before string, after string, required_pos string, required_key int, min_before int, min_after int, constraint string, medieval boolean, name string",
    "uniques": "surface string, lexeme_id int, kind string, declension int, variant int, case string, number string, gender string, degree string, tense string, voice string, mood string, person int",
    "quantities": "subject string, subject_id int, slot int, known long, long long",
    "notices": "lexeme_id int, trigger string, notice string",
}
#: Values each column may have.
DOMAINS = {
    ("lexemes", "pos"): "N ADJ ADV V PRON NUM PREP CONJ INTERJ PACK", ("lexemes", "gender"): "M F N C X", ("lexemes", "degree"): "POS COMP SUPER X",
    ("lexemes", "verb_kind"): "X TO_BE TRANS INTRANS DEP SEMIDEP IMPERS PERFDEF", ("rules", "rule_pos"): "N ADJ ADV V PRON NUM PREP CONJ INTERJ VPAR SUPINE",
    ("rules", "case"): "NOM VOC GEN LOC DAT ABL ACC X", ("rules", "number"): "S P X", ("rules", "rule_gender"): "M F N C X",
    ("rewrites", "kind"): "SYNCOPE ORTHOGRAPHIC", ("rewrites", "stage"): "MAIN EARLY FALLBACK", ("rewrites", "operation"): "LITERAL SLUR DOUBLE_CONSONANT",
    ("rewrites", "scope"): "INITIAL INTERNAL FINAL", ("quantities", "subject"): "STEM INFLECTION SUFFIX",
}


@dataclass(frozen=True)
class RuleBook:
    lexemes: DataFrame
    stems: DataFrame
    rules: DataFrame
    prefixes: DataFrame
    suffixes: DataFrame
    tackons: DataFrame
    rewrites: DataFrame
    uniques: DataFrame
    quantities: DataFrame
    notices: DataFrame

    @classmethod
    def of_rows(cls, spark: SparkSession, rows: dict[str, list[tuple]]) -> RuleBook:
        return cls(**{name: spark.createDataFrame(rows.get(name, []), schema) for name, schema in SCHEMAS.items()})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> RuleBook:
        """From Parquet written by save(); the schema is given, not inferred."""
        return cls(**{name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in SCHEMAS.items()})

    def save(self, path: str) -> None:
        """Stems in the order of their text, so that a lookup reads few row groups."""
        for f in fields(self):
            df = getattr(self, f.name)
            df = df.sort("stem", "lexeme_id", "slot") if f.name == "stems" else df
            df.write.mode("overwrite").parquet(f"{path}/{f.name}")

    def kept(self) -> RuleBook:
        """The same tables in the shared folder: plans then know how small they are, and send them out without a shuffle."""
        return RuleBook(**{f.name: materialize(getattr(self, f.name).coalesce(1), f.name) for f in fields(self)})

    def longest(self, table: str, column: str) -> int:
        """Length of the longest text of a column: what a plan explodes to."""
        return getattr(self, table).agg(F.max(F.length(column))).first()[0] or 0


def _count(df: DataFrame, check: str) -> DataFrame:
    return df.agg(F.count("*").alias("violations")).select(F.lit(check).alias("check"), "violations")


def validate(book: RuleBook) -> DataFrame:
    """A row for each integrity check with its violations: domains, keys, references, density, spelling."""
    checks = []
    for (table, column), values in DOMAINS.items():
        checks.append(_count(getattr(book, table).where(F.col(column).isNull() | ~F.col(column).isin(values.split())), f"domain {table}.{column}"))
    for table, key in (("lexemes", "lexeme_id"), ("rules", "rule_id"), ("rewrites", "rewrite_id")):
        df = getattr(book, table)
        checks.append(_count(df.groupBy(key).count().where("count > 1"), f"unique {table}.{key}"))
    addons = reduce(DataFrame.unionByName, [t.select("addon_id") for t in (book.prefixes, book.suffixes, book.tackons)])
    checks.append(_count(addons.groupBy("addon_id").count().where("count > 1"), "unique addon_id"))
    for df, name in ((addons, "addon_id"), (book.rules, "rule_id")):
        key = df.columns[0] if name == "addon_id" else "rule_id"
        dense = df.agg((F.coalesce(F.max(key), F.lit(-1)) + 1 != F.count_distinct(key)).alias("gap")).where("gap")
        checks.append(_count(dense, f"dense {name}"))
    for df, name in ((book.stems, "stems"), (book.uniques, "uniques"), (book.notices, "notices")):
        checks.append(_count(df.join(book.lexemes, "lexeme_id", "left_anti"), f"reference {name}.lexeme_id"))
    packons = book.tackons.where("packon").select(F.col("addon_id").alias("required_packon"))
    checks.append(_count(book.lexemes.where("pos = 'PACK' and required_packon is not null").join(packons, "required_packon", "left_anti"), "reference lexemes.required_packon"))
    for df, column in ((book.stems, "stem"), (book.rules, "ending"), (book.prefixes, "fix"), (book.suffixes, "fix"), (book.tackons, "fix")):
        checks.append(_count(df.where(F.col(column).rlike("[^a-z]|[jv]")), f"spelling {column}"))
    checks.append(_count(book.quantities.where("long & ~known <> 0"), "quantity long without known"))
    return reduce(DataFrame.unionByName, checks)
