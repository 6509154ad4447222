"""Lookups of the analyzer over the small rule book, each beside SQL over the same rule tables.

The words asked for are a list of forms of the rule book's lexemes, and every word of the benchmark items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.analyze import Core, Options
from ..operators.rulebook import SCHEMAS, RuleBook
from ..sources import grammar
from ..sources.tables import table
from .registry import Catalog

catalog = Catalog()

FORMS = (
    "puella puellae puellam puellarum puellis rosa rosis rosam poeta poetarum dominus domine domini bella bellorum templo templa puer pueri pueros rex regis regibus urbs urbem urbium militem milites corpora corporis "
    "manus manibus res rerum civis cives bonus bona bonorum melior meliores optimus maximi magnus altior altissima fortis forte fortium fortior fortissimus amo amas amat amabat amabo amavi amaverunt amatus amata amaturus "
    "amare amari amans amantem amandi amavisse portabant portatur vocatis vocabimus hortor hortatus sum es est sunt esse fui fuerat eram erit erunt moneo monet monuit moniti implet implevisti audeo ausus duco ducit duxit "
    "ductus duc duci regit rexit rectum mittunt misit missum pluit pluere audio audit audiunt audivi audiens audientibus audire saepe non in ad et heu qui quae quod quem cuius cui quibus aliquis aliquem alicuius quicumque "
    "quidam cuiusdam quaecumque quemdam ecquis necquem deamat reduco perfortis adduxit permitto redamabat readduco amator ductor rectoris bone alte magne rosula puellula regulae redamator puellaque amatne rosave regemque bonusne quamve meque"
).split()
#: Forms with marked vowels: which letters are marked, and which of these are long, as bits.
MARKED = [("rosa", 0, 0), ("rosa", 8, 0), ("rosa", 8, 8), ("rosa", 2, 0), ("rosa", 2, 2), ("rosa", 10, 8), ("puella", 32, 32), ("puella", 32, 0), ("puella", 2, 0), ("rosam", 2, 2), ("amat", 4, 4)]


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words as the core asks for them: folded, without marks."""
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    found = table(spark, sf_dir, "benchmark").select(word.alias("w")).select(F.translate("w", "jv", "iu").alias("form"))
    forms = spark.createDataFrame([(grammar._fold(f),) for f in FORMS], "form string").union(found).distinct()
    none = F.lit(0).cast("long")
    return forms.select("form", none.alias("known"), none.alias("long"), F.lit("w").alias("role"))


def core(spark: SparkSession, **options: bool) -> Core:
    return Core(RuleBook.of_rows(spark, grammar.rows()), Options(**options))


# the rule tables as SQL


def _value(x) -> str:
    return "null" if x is None else str(x).lower() if isinstance(x, bool) else repr(x)


def _table(name: str, columns: str, where=lambda r: True) -> str:
    """A rule table, or some of its columns and rows, as a common table expression."""
    names = [c.split()[0] for c in SCHEMAS[name].split(", ")]
    at = [names.index(c) for c in columns.split()]
    rows = [r for r in grammar.rows()[name] if where(dict(zip(names, r, strict=True)))]
    listed = ", ".join('"' + c + '"' for c in columns.split())
    return f"{name}({listed}) as (values " + ", ".join("(" + ", ".join(_value(r[k]) for k in at) + ")" for r in rows) + ")"


Q = "q as (select unnest([" + ", ".join(repr(grammar._fold(f)) for f in FORMS) + """]) as form union
select replace(replace(w, 'j', 'i'), 'v', 'u') from (select unnest(regexp_extract_all(lower(text), '[a-z]+')) as w from benchmark))"""
RULES = _table("rules", "rule_id rule_pos rule_decl rule_var case number rule_gender rule_degree tense voice mood person rule_key ending")
ENTRIES = _table("lexemes", "lexeme_id pos decl var gender degree numeral_type governs required_packon") + ", " + _table("stems", "lexeme_id slot stem_key stem") + ", e as (select * from stems join lexemes using (lexeme_id))"
CUT = "cut as (select form, left(form, length(form) - length(ending)) as rest, rules.* from q join rules on length(ending) <= length(form) and right(form, length(ending)) = ending)"
FITS = lambda a, b: f"({a} = 'X' or {b} = 'X' or {a} = {b} or ({a} = 'C' and {b} in ('M', 'F')) or ({b} = 'C' and {a} in ('M', 'F')))"
PARADIGM = lambda decl, var: f"case when rule_decl = 0 and rule_var = 0 then {decl} <> 9 else rule_decl = {decl} and (rule_var = 0 or rule_var = {var}) end"
MATCH = f"""(pos = rule_pos or (pos = 'V' and rule_pos in ('VPAR', 'SUPINE'))) and (stem_key = rule_key or (stem_key = 0 and rule_key in (1, 2))) and {PARADIGM('decl', 'var')}
and case when pos = 'N' then {FITS('gender', 'rule_gender')} when pos in ('ADJ', 'ADV') then degree = 'X' or rule_degree = 'X' or degree = rule_degree
  when pos = 'PRON' then decl <> 1 when pos = 'PREP' then governs = "case" else pos <> 'PACK' end"""
NOMINAL = "('N', 'ADJ', 'PRON', 'NUM', 'VPAR', 'SUPINE')"
DEGREES = "case when {0} <> 'X' then {0} when {1} <= 2 then 'POS' when {1} = 3 then 'COMP' when {1} = 4 then 'SUPER' else 'X' end"


def _morphology(pos: str, decl: str, var: str, gender: str, degree: str, key: str) -> str:
    return f"""rule_pos as kind, case when rule_pos = 'V' and {decl} = 3 and {var} = 4 then 4 else {decl} end as declension, case when rule_pos = 'V' and {decl} = 3 and {var} = 4 then 1 else {var} end as variant,
case when rule_pos in {NOMINAL} then "case" end as "case", case when rule_pos in {NOMINAL} or rule_pos = 'V' then number end as number, case when {pos} = 'N' then {gender} when rule_pos in {NOMINAL} then rule_gender end as gender,
case when rule_pos in ('ADJ', 'ADV') then {DEGREES.format(degree, key)} end as degree, case when rule_pos in ('V', 'VPAR') then tense end as tense, case when rule_pos in ('V', 'VPAR') then voice end as voice,
case when rule_pos = 'V' then mood end as mood, case when rule_pos = 'V' then person end as person"""


SHOWN = ["kind", "declension", "variant", "case", "number", "gender", "degree", "tense", "voice", "mood", "person"]
REGULAR = f"""{Q}, {RULES}, {ENTRIES}, {CUT}, regular as (select form, lexeme_id, rule_id, rest as stem, ending, {_morphology('pos', 'decl', 'var', 'gender', 'degree', 'rule_key')},
case when rule_pos = 'PREP' then "case" end as governs from cut join e on e.stem = cut.rest where {MATCH})"""


@catalog.add(f"with {Q}, {RULES}, {CUT} select form, rest, rule_id from cut")
def ending_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ending of a rule that a word has, and what stands before it."""
    return core(spark).candidates(questions(spark, sf_dir)).select("form", "rest", "rule_id")


@catalog.add(f"with {REGULAR} select * from regular")
def regular_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stem and ending of one lexeme, by part of speech, paradigm, stem, gender, degree and government."""
    c = core(spark)
    return c.regular(c.candidates(questions(spark, sf_dir))).select("form", "lexeme_id", "rule_id", "stem", "ending", *SHOWN, "governs")


@catalog.add(f"""with {Q}, {_table('uniques', 'surface lexeme_id kind declension variant case number gender degree tense voice mood person')}
select form, uniques.* exclude (surface) from q join uniques on form = surface""")
def unique_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core(spark).uniques(questions(spark, sf_dir)).select("form", "lexeme_id", *SHOWN)


@catalog.add(f"""with {Q}, {RULES}, {ENTRIES}, {CUT},
p as (select *, (length(form) >= 3 and starts_with(form, 'qu')) or (length(form) >= 6 and starts_with(form, 'aliqu')) as qu, (length(form) >= 3 and starts_with(form, 'cu')) or (length(form) >= 6 and starts_with(form, 'alicu')) as cu
  from cut where rule_pos = 'PRON')
select form, lexeme_id, rule_id, rest as stem, ending, rule_decl as declension, "case", number, rule_gender as gender from p join e on e.stem = p.rest and pos = 'PRON' and decl = 1 and decl = rule_decl and var = rule_var
where (qu and rule_key = 1) or (not qu and cu and rule_key = 2)""")
def qu_pronoun_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = core(spark)
    return c.qu_pronouns(c.candidates(questions(spark, sf_dir))).select("form", "lexeme_id", "rule_id", "stem", "ending", "declension", "case", "number", "gender")


@catalog.add(f"""with {Q}, {RULES}, {ENTRIES}, {CUT}, {_table('prefixes', 'addon_id fix connector root_pos', lambda r: not r['tickon'])},
b as (select cut.*, addon_id as prefix_id, root_pos, substr(rest, length(fix) + 1) as base, connector from cut join prefixes on length(fix) < length(rest) and left(rest, length(fix)) = fix),
m as (select form, prefix_id, lexeme_id, rule_id, base as stem, ending, {_morphology('pos', 'decl', 'var', 'gender', 'degree', 'rule_key')} from b join e on e.stem = base
  where (connector = '' or left(base, 1) = connector) and (root_pos = pos or (root_pos = 'X' and pos in ('N', 'ADJ', 'ADV', 'V'))) and {MATCH})
select * from m qualify prefix_id = min(prefix_id) over (partition by form)""")
def prefix_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first prefix after which a regular reading stands."""
    c = core(spark)
    return c.prefixes(c.candidates(questions(spark, sf_dir))).select("form", "prefix_id", "lexeme_id", "rule_id", "stem", "ending", *SHOWN)


@catalog.add(f"""with {REGULAR}, {_table('suffixes', 'addon_id fix connector root_pos root_key root_decl root_var target_pos target_decl target_var target_gender target_degree target_key coexists')},
b as (select cut.*, s.* exclude (connector), left(rest, length(rest) - length(fix)) as base from cut join suffixes s on length(fix) < length(rest) and right(rest, length(fix)) = fix
  where (connector = '' or left(right(rest, length(fix) + 1), 1) = connector) and (coexists or form not in (select form from regular)))
select form, addon_id as suffix_id, lexeme_id, rule_id, base || fix as stem, ending, {_morphology('target_pos', 'target_decl', 'target_var', 'target_gender', 'target_degree', 'target_key')} from b join e on e.stem = base
where (target_pos = rule_pos or (target_pos = 'V' and rule_pos in ('VPAR', 'SUPINE'))) and (target_key = rule_key or (target_key = 0 and rule_key in (1, 2))) and {PARADIGM('target_decl', 'target_var')}
and case when target_pos = 'N' then {FITS('target_gender', 'rule_gender')} when target_pos in ('ADJ', 'ADV') then target_degree = 'X' or rule_degree = 'X' or target_degree = rule_degree else true end
and (root_pos = 'X' or root_pos = pos or (pos = 'PACK' and root_pos = 'PRON')) and (root_key = 0 or root_key = stem_key or (stem_key = 0 and pos in ('N', 'ADJ', 'V') and root_key in (1, 2)))
and (root_decl = 0 or root_decl = decl) and (root_var = 0 or root_var = var)""")
def suffix_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words derived of stems by a suffix; where a word has regular readings, only by suffixes that may stand beside them."""
    c = core(spark, prefixes=False)
    cut = c.candidates(questions(spark, sf_dir))
    return c.suffixes(cut, c.regular(cut).select("form", "known", "long", "role").distinct()).select("form", "suffix_id", "lexeme_id", "rule_id", "stem", "ending", *SHOWN)


@catalog.add(f"""with {Q}, {RULES}, {ENTRIES}, {_table('tackons', 'addon_id fix', lambda r: r['packon'])},
b as (select form, addon_id as tackon_id, left(form, length(form) - length(fix)) as base from q join tackons on length(fix) < length(form) and right(form, length(fix)) = fix),
c as (select b.*, left(base, length(base) - length(ending)) as rest, rules.* from b join rules on rule_pos = 'PRON' and length(ending) <= length(base) and right(base, length(ending)) = ending where length(base) >= 3 and substr(base, 1, 2) in ('qu', 'cu'))
select form, tackon_id, lexeme_id, rule_id, rest as stem, ending, "case", number, rule_gender as gender from c join e on e.stem = c.rest and pos = 'PACK' and decl = rule_decl and var = rule_var and required_packon = tackon_id""")
def packon_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms of qui, quis before the ending that the lexeme asks for."""
    return core(spark).packons(questions(spark, sf_dir)).select("form", "tackon_id", "lexeme_id", "rule_id", "stem", "ending", "case", "number", "gender")


@catalog.add(f"""with {REGULAR}, {_table('tackons', 'addon_id fix enclitic', lambda r: not r['packon'])}
select distinct left(form, length(form) - length(fix)) as form from q join tackons on length(fix) < length(form) and right(form, length(fix)) = fix""")
def enclitic_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the enclitics leave of the words."""
    return core(spark).bases(questions(spark, sf_dir)).select("form")


@catalog.add("with q(form, known, long) as (values " + ", ".join(map(str, MARKED)) + f"""), {RULES}, {ENTRIES}, {_table('quantities', 'subject subject_id slot known long')},
cut as (select form, known, long, left(form, length(form) - length(ending)) as rest, rules.* from q join rules on length(ending) <= length(form) and right(form, length(ending)) = ending),
r as (select form, cut.known, cut.long, lexeme_id, rule_id, (1 << length(rest)) - 1 as sm, length(rest) as n, (1 << length(ending)) - 1 as em, coalesce(s.known, 0) as sk, coalesce(s.long, 0) as sl, coalesce(i.known, 0) as rk, coalesce(i.long, 0) as rl
  from cut join e on e.stem = cut.rest left join quantities s on s.subject = 'STEM' and s.subject_id = lexeme_id and s.slot = e.slot left join quantities i on i.subject = 'INFLECTION' and i.subject_id = rule_id where {MATCH})
select form, known, long, lexeme_id, rule_id, case when known = 0 then 'unspecified' when bit_count(known & sm & sk) + bit_count((known >> n) & em & rk) = bit_count(known) then 'exact' else 'unknown' end as quantity_match
from r where xor(long & sm, sl) & (known & sm & sk) = 0 and xor((long >> n) & em, rl) & ((known >> n) & em & rk) = 0""")
def quantity_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regular readings of words with marked vowels: stored lengths must not contradict the marks."""
    c = core(spark)
    asked = spark.createDataFrame([(*m, "w") for m in MARKED], "form string, known long, long long, role string")
    return c.regular(c.candidates(asked)).select("form", "known", "long", "lexeme_id", "rule_id", "quantity_match")


QUERIES, ORACLE_SQL = catalog.queries, catalog.oracles
