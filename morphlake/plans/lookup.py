"""Rule lookups over words: affixes of any length, first success, stages, rewrites, splits, numerals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.precedence import fallback, first_success, override
from .corpus import DUCK_WORDS, words
from .registry import Catalog, run_sql

catalog = Catalog()

SUFFIXES = [(1, "ingly"), (2, "tion"), (3, "ing"), (4, "ed"), (5, "er"), (6, "en"), (7, "e"), (8, "s")]
PREFIXES = [(1, "inter"), (2, "con"), (3, "ver"), (4, "re"), (5, "in"), (6, "en"), (7, "th")]
REWRITES = [(1, "th", "t"), (2, "ou", "u"), (3, "sh", "s"), (4, "é", "e"), (5, "ü", "u")]


def _values(rows, columns: str) -> str:
    return "(values " + ", ".join("(" + ", ".join(repr(x) for x in r) + ")" for r in rows) + f") as r({columns})"


def rule_frame(spark: SparkSession, rows, columns: str) -> DataFrame:
    return spark.createDataFrame(rows, columns)


def distinct_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words are looked up once however often they occur."""
    return words(spark, sf_dir).groupBy(F.lower("word").alias("form")).agg(F.count("*").alias("n"))


FORMS = f"f as (select lower(w) as form, count(*) as n from (select {DUCK_WORDS} as w from documents) group by 1)"


def match_suffixes(forms: DataFrame, rules: DataFrame, longest: int) -> DataFrame:
    """Every rule whose ending the form has, by equality on the last 1 to `longest` letters; a stem is left."""
    k = F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("form") - 1))).alias("k")
    ends = forms.where(F.length("form") > 1).select("*", k).withColumn("ending", F.expr("right(form, k)"))
    return ends.join(F.broadcast(rules), "ending")  # a few rules


def match_prefixes(forms: DataFrame, rules: DataFrame, longest: int) -> DataFrame:
    k = F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("form") - 1))).alias("k")
    starts = forms.where(F.length("form") > 1).select("*", k).withColumn("fix", F.expr("left(form, k)"))
    return starts.join(F.broadcast(rules), "fix")


def suffix_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = rule_frame(spark, SUFFIXES, "rule int, ending string")
    return match_suffixes(distinct_forms(spark, sf_dir), rules, max(len(e) for _, e in SUFFIXES))


def prefix_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = rule_frame(spark, PREFIXES, "rule int, fix string")
    return match_prefixes(distinct_forms(spark, sf_dir), rules, max(len(e) for _, e in PREFIXES))


DUCK_SUFFIX = f"with {FORMS}, s as (select form, n, rule, ending from f join {_values(SUFFIXES, 'rule, ending')} on length(form) > length(ending) and right(form, length(ending)) = ending)"
DUCK_PREFIX = f"p as (select form, n, rule, fix from f join {_values(PREFIXES, 'rule, fix')} on length(form) > length(fix) and left(form, length(fix)) = fix)"


@catalog.add(DUCK_SUFFIX + " select rule, ending, count(*) as forms, cast(sum(n) as bigint) as occurrences from s group by 1, 2")
def variable_suffix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_hits(spark, sf_dir).groupBy("rule", "ending").agg(F.count("*").alias("forms"), F.sum("n").alias("occurrences"))


@catalog.add(f"with {FORMS}, {DUCK_PREFIX} select rule, fix, count(*) as forms, cast(sum(n) as bigint) as occurrences from p group by 1, 2")
def variable_prefix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_hits(spark, sf_dir).groupBy("rule", "fix").agg(F.count("*").alias("forms"), F.sum("n").alias("occurrences"))


@catalog.add(DUCK_SUFFIX + " select form, rule, ending, left(form, length(form) - length(ending)) as stem from s qualify rule = min(rule) over (partition by form)")
def affix_first_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that fits each form."""
    best = first_success(suffix_hits(spark, sf_dir), ["form"], ["rule"])
    return best.select("form", "rule", "ending", F.expr("left(form, length(form) - length(ending))").alias("stem"))


@catalog.add(DUCK_SUFFIX + f""", {DUCK_PREFIX}, l as (select distinct lower(w) as form from (select {DUCK_WORDS} as w from benchmark))
select form, 'lexicon' as stage, 0 as rule from f where form in (select form from l)
union all select form, 'suffix', rule from s where form not in (select form from l)
union all select form, 'prefix', rule from p where form not in (select form from l) and form not in (select form from s)""")
def stage_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known forms; else those a suffix explains; else those a prefix does."""
    lexicon = words(spark, sf_dir, "benchmark", "item_id").select(F.lower("word").alias("form")).distinct()
    known = distinct_forms(spark, sf_dir).join(lexicon, "form", "left_semi").select("form", F.lit("lexicon").alias("stage"), F.lit(0).alias("rule"))
    suffix = suffix_hits(spark, sf_dir).select("form", F.lit("suffix").alias("stage"), "rule")
    prefix = prefix_hits(spark, sf_dir).select("form", F.lit("prefix").alias("stage"), "rule")
    return fallback([known, suffix, prefix], ["form"])


@catalog.add(DUCK_SUFFIX + f""", {DUCK_PREFIX}, m as (select form, rule, min(rule) over (partition by form) as low from s),
late as (select form, rule from p where rule <= 4), has_late as (select distinct form from late), strong as (select distinct form from s where rule <= 3)
select m.form, 'suffix' as stage, m.rule from m left join has_late h on m.form = h.form where h.form is null or m.low <= 3
union all select l.form, 'prefix', l.rule from late l left join strong t on l.form = t.form where t.form is null""")
def stage_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong prefixes replace suffix readings, unless one of these is strong."""
    early = suffix_hits(spark, sf_dir).select("form", F.lit("suffix").alias("stage"), "rule")
    late = prefix_hits(spark, sf_dir).where("rule <= 4").select("form", F.lit("prefix").alias("stage"), "rule")
    return override(early, late, ["form"], weak=F.col("rule") > 3)


RESIDUAL = [(1, "F", "*", 0, 20), (2, "O", "1-URGENT", 0, 50), (3, "P", "*", 10, 30), (4, "*", "5-LOW", 30, 50)]


@catalog.add(f"""
select rule, l_returnflag, count(*) as n, round(sum(l_extendedprice), 2) as total from lineitem join orders on l_orderkey = o_orderkey
join {_values(RESIDUAL, 'rule, status, priority, low, high')} on (status = '*' or status = o_orderstatus) and (priority = '*' or priority = o_orderpriority) and l_quantity between low and high
group by 1, 2""")
def rule_residual_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules with wildcards: every order has four keys, either value or a wildcard for it, and meets the rules by
    equality; what remains of a rule is a condition on the joined rows."""
    rules = rule_frame(spark, RESIDUAL, "rule int, status string, priority string, low int, high int")
    return run_sql(spark, sf_dir, "lineitem orders", """
with keyed as (select o_orderkey, status, priority from orders lateral view explode(array(o_orderstatus, '*')) as status lateral view explode(array(o_orderpriority, '*')) as priority),
hit as (select /*+ broadcast(rules) */ o_orderkey, rule, low, high from keyed join rules using (status, priority))
select rule, l_returnflag, count(*) as n, round(sum(l_extendedprice), 2) as total from lineitem join hit on l_orderkey = o_orderkey where l_quantity between low and high group by 1, 2""", rules=rules)


def rewrite_attempts(forms: DataFrame, rules: DataFrame, longest: int) -> DataFrame:
    """Every place where a rule's text stands in a form: position from 1, and the rewritten form. Forms meet the
    rules by equality on their substrings of up to `longest` letters."""
    at = forms.select("*", F.explode(F.sequence(F.lit(1), F.length("form"))).alias("pos"))
    spots = at.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.expr("length(form) - pos + 1")))).alias("k"))
    hits = spots.withColumn("before", F.expr("substr(form, pos, k)")).join(F.broadcast(rules), "before")  # a few rules
    return hits.drop("k").withColumn("rewritten", F.expr("overlay(form placing after from pos for length(before))"))


LONGEST = max(len(b) for _, b, _ in REWRITES)
DUCK_REWRITE = f"""with {FORMS}, a as (select form, n, rule, before, after, pos, left(form, cast(pos - 1 as bigint)) || after || substr(form, pos + length(before)) as rewritten
from f join {_values(REWRITES, 'rule, before, after')} on contains(form, before), lateral (select unnest(range(1, length(form) + 1)) as pos) where substr(form, pos, length(before)) = before)"""


@catalog.add(DUCK_REWRITE + " select rule, before, count(distinct form) as forms, count(*) as places from a group by 1, 2")
def rewrite_contains_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = rewrite_attempts(distinct_forms(spark, sf_dir), rule_frame(spark, REWRITES, "rule int, before string, after string"), LONGEST)
    by_form = a.groupBy("rule", "before", "form").agg(F.count("*").alias("n"))
    return by_form.groupBy("rule", "before").agg(F.count("*").alias("forms"), F.sum("n").alias("places"))


@catalog.add(DUCK_REWRITE + " select form, rule, pos, rewritten from a where rewritten in (select form from f) qualify row_number() over (partition by form order by rule, pos) = 1")
def rewrite_literal_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rewrite, by rule and position, whose result is itself an attested form."""
    forms = distinct_forms(spark, sf_dir)
    a = rewrite_attempts(forms, rule_frame(spark, REWRITES, "rule int, before string, after string"), LONGEST)
    good = a.join(forms.select(F.col("form").alias("rewritten")), "rewritten", "left_semi")
    return first_success(good, ["form"], ["rule", "pos"]).select("form", "rule", F.col("pos").cast("long").alias("pos"), "rewritten")


@catalog.add(f"""with {FORMS}, a as (select form, pos, left(form, cast(pos as bigint)) || substr(form, pos, 1) || substr(form, pos + 1) as doubled
from f, lateral (select unnest(range(2, length(form))) as pos)
where substr(form, pos, 1) in ('b','c','d','f','g','l','m','n','p','r','s','t') and substr(form, pos - 1, 1) in ('a','e','i','o','u','y') and substr(form, pos + 1, 1) in ('a','e','i','o','u','y'))
select form, pos, doubled from a where doubled in (select form from f)""")
def rewrite_double_consonant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A consonant between vowels doubled, where that gives an attested form."""
    forms = distinct_forms(spark, sf_dir).select("form")
    at = forms.where("length(form) > 2").select("form", F.explode(F.sequence(F.lit(2), F.length("form") - 1)).alias("pos"))
    at = at.where("substr(form, pos, 1) rlike '[bcdfglmnprst]' and substr(form, pos - 1, 1) rlike '[aeiouy]' and substr(form, pos + 1, 1) rlike '[aeiouy]'")
    made = at.select("form", F.col("pos").cast("long").alias("pos"), F.expr("concat(left(form, pos), substr(form, pos, 1), substr(form, pos + 1))").alias("doubled"))
    return made.join(forms.select(F.col("form").alias("doubled")), "doubled", "left_semi").select("form", "pos", "doubled")


@catalog.add(f"""with {FORMS}, l as (select distinct lower(w) as form from (select {DUCK_WORDS} as w from benchmark)),
s as (select form, cut, left(form, cast(cut as bigint)) as l_part, substr(form, cut + 1) as r_part from f, lateral (select unnest(range(2, length(form) - 2)) as cut) where form not in (select form from l))
select form, min(cut) as cut, arg_min(l_part, cut) as l_part, arg_min(r_part, cut) as r_part from s where l_part in (select form from l) and r_part in (select form from l) group by form""")
def two_segment_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first split of an unknown form into two known ones, the right of three letters or more."""
    lexicon = words(spark, sf_dir, "benchmark", "item_id").select(F.lower("word").alias("form")).distinct()
    unknown = distinct_forms(spark, sf_dir).join(lexicon, "form", "left_anti").where("length(form) >= 5")
    cuts = unknown.select("form", F.explode(F.sequence(F.lit(2), F.length("form") - 3)).alias("cut"))
    parts = cuts.selectExpr("form", "cast(cut as bigint) as cut", "left(form, cut) as l_part", "substr(form, cut + 1) as r_part")
    parts = parts.join(lexicon.withColumnRenamed("form", "l_part"), "l_part", "left_semi").join(lexicon.withColumnRenamed("form", "r_part"), "r_part", "left_semi")
    return first_success(parts, ["form"], ["cut"]).select("form", "cut", "l_part", "r_part")


@catalog.add(f"""with {FORMS} select replace(replace(form, 'j', 'i'), 'v', 'u') as folded, count(*) as spellings, string_agg(form, ',' order by form) as forms
from f group by 1 having count(*) > 1""")
def fold_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings that fall together when j is i and v is u."""
    folded = distinct_forms(spark, sf_dir).groupBy(F.translate("form", "jv", "iu").alias("folded"))
    return folded.agg(F.count("*").alias("spellings"), F.array_join(F.array_sort(F.collect_list("form")), ",").alias("forms")).where("spellings > 1")


ROMAN = [("m", 1000), ("cm", 900), ("d", 500), ("cd", 400), ("c", 100), ("xc", 90), ("l", 50), ("xl", 40), ("x", 10), ("ix", 9), ("v", 5), ("iv", 4), ("i", 1)]


@catalog.add("""
with recursive k as (select distinct o_custkey % 3999 + 1 as n from orders), g as (
  select n, n as left_, '' as numeral from k
  union all
  select n, left_ - v, numeral || s from (select n, left_, numeral,
    case when left_ >= 1000 then 1000 when left_ >= 900 then 900 when left_ >= 500 then 500 when left_ >= 400 then 400 when left_ >= 100 then 100 when left_ >= 90 then 90
      when left_ >= 50 then 50 when left_ >= 40 then 40 when left_ >= 10 then 10 when left_ >= 9 then 9 when left_ >= 5 then 5 when left_ >= 4 then 4 else 1 end as v,
    case when left_ >= 1000 then 'm' when left_ >= 900 then 'cm' when left_ >= 500 then 'd' when left_ >= 400 then 'cd' when left_ >= 100 then 'c' when left_ >= 90 then 'xc'
      when left_ >= 50 then 'l' when left_ >= 40 then 'xl' when left_ >= 10 then 'x' when left_ >= 9 then 'ix' when left_ >= 5 then 'v' when left_ >= 4 then 'iv' else 'i' end as s
    from g where left_ > 0))
select numeral, n as value, true as strict from g where left_ = 0""")
def roman_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numerals of numbers, and their values read back by the subtractive sum."""
    from ..functions.roman import roman_is_strict, roman_numeral, roman_value as value_of

    n = run_sql(spark, sf_dir, "orders", "select distinct o_custkey % 3999 + 1 as n from orders")
    made = n.select(roman_numeral(F.col("n")).alias("numeral"))
    return made.select("numeral", value_of(F.col("numeral")).alias("value"), roman_is_strict(F.col("numeral")).alias("strict"))


@catalog.add(f"""with {FORMS}, r as (select * from {_values([(1, "e"), (1, "en"), (2, "er"), (2, "ed"), (3, "ing")], "model, ending")}),
g as (select f.form as stem, model, ending, f.form || ending as made from f, r where length(f.form) between 3 and 6),
a as (select stem, model, made, made in (select form from f) as attested from g)
select stem, model, bool_and(attested) as complete, count(*) as slots, cast(sum(case when attested then 1 else 0 end) as bigint) as attested from a group by 1, 2 having sum(case when attested then 1 else 0 end) > 0""")
def generated_form_attestation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms a stem would have in each model, and whether the corpus has them all."""
    forms = distinct_forms(spark, sf_dir).select("form")
    rules = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(e).alias("ending")) for m, e in [(1, "e"), (1, "en"), (2, "er"), (2, "ed"), (3, "ing")]])
    stems = forms.where("length(form) between 3 and 6").select(F.col("form").alias("stem"), F.explode(rules).alias("r"))
    made = stems.select("stem", "r.model", F.concat("stem", "r.ending").alias("made"))
    seen = made.join(forms.select(F.col("form").alias("made"), F.lit(True).alias("hit")), "made", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return seen.groupBy("stem", "model").agg(F.bool_and("hit").alias("complete"), F.count("*").alias("slots"), F.sum(F.col("hit").cast("long")).alias("attested")).where("attested > 0")


@catalog.add(f"""with t as (select doc_id, lower(w) as word, count(*) as n from (select doc_id, {DUCK_WORDS} as w from documents) group by 1, 2),
q as (select distinct lower(w) as word from (select {DUCK_WORDS} as w from benchmark)),
r as (select word, doc_id, 80 - least(n, 6) * 10 as rank_, n from t where word in (select word from q))
select word, rn, doc_id, rank_ as rank, n from (select *, row_number() over (partition by word order by rank_ desc, n, doc_id) as rn from r) where rn <= 6""")
def gloss_index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inverted index of words, looked up by the words of all queries: the first six of each by rank."""
    from ..operators.ranking import top_n
    from ..sources.tables import table

    index = words(spark, sf_dir).groupBy("doc_id", F.lower("word").alias("word")).agg(F.count("*").alias("n"))
    asked = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+(?:['’]\p{L}+)*"), F.lit(0))).alias("w")).select(F.lower("w").alias("word")).distinct()
    hits = index.join(asked, "word", "left_semi").withColumn("rank", 80 - F.least("n", F.lit(6)) * 10)
    return top_n(hits, ["word"], [F.desc("rank"), F.asc("n"), F.asc("doc_id")], 6).select("word", "rn", "doc_id", "rank", "n")


QUERIES, ORACLE_SQL = catalog.queries, catalog.oracles
