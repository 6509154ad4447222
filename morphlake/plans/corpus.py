"""Corpus statistics: word forms, casing, document frequency, overlap, coverage, queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import top_n
from ..operators.resolve import overlap_score
from ..sources.tables import table
from .registry import Catalog, run_sql

catalog = Catalog()
LETTERS = r"\p{L}+(?:['’]\p{L}+)*"
DUCK_WORDS = r"unnest(regexp_extract_all(text, '\p{L}+(?:[''’]\p{L}+)*'))"


def words(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    rows = table(spark, sf_dir, name).select(key, F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0))).alias("word"))
    return rows


def form_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    upper, initial = F.upper("word") == F.col("word"), F.upper(F.substring("word", 1, 1)) == F.substring("word", 1, 1)
    return words(spark, sf_dir).groupBy(F.lower("word").alias("form")).agg(
        F.count("*").alias("occurrences"), F.sum(initial.cast("long")).alias("initial_upper"), F.sum(upper.cast("long")).alias("all_upper")
    )


@catalog.add(rf"""
with w as (select doc_id, {DUCK_WORDS} as word from documents),
d as (select lower(word) as form, doc_id, count(*) as n,
        sum(case when upper(substr(word, 1, 1)) = substr(word, 1, 1) then 1 else 0 end) as i,
        sum(case when upper(word) = word then 1 else 0 end) as u from w group by 1, 2)
select form, cast(sum(n) as bigint) as occurrences, count(doc_id) as documents,
  cast(sum(i) as bigint) as initial_upper, cast(sum(u) as bigint) as all_upper from d group by form""")
def word_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences, documents and casing of each form. Counted by document first: the distinct count
    is then a plain count, and a frequent form is a row a document at most."""
    w = words(spark, sf_dir).withColumn("form", F.lower("word"))
    upper = F.upper("word") == F.col("word")
    initial = F.upper(F.substring("word", 1, 1)) == F.substring("word", 1, 1)
    by_doc = w.groupBy("form", "doc_id").agg(
        F.count("*").alias("n"), F.sum(initial.cast("long")).alias("i"), F.sum(upper.cast("long")).alias("u")
    )
    return by_doc.groupBy("form").agg(
        F.sum("n").alias("occurrences"), F.count("doc_id").alias("documents"),
        F.sum("i").alias("initial_upper"), F.sum("u").alias("all_upper"),
    )


@catalog.add(rf"""
with w as (select {DUCK_WORDS} as word from documents),
c as (select lower(word) as form, word, count(*) as n from w group by 1, 2)
select form, cast(sum(n) as bigint) as occurrences, count(*) as n_variants,
  string_agg(word || ':' || n, ',' order by n desc, word) as variants from c group by form""")
def word_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = words(spark, sf_dir).groupBy("word").agg(F.count("*").alias("n"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "word")))  # the casings of one form
    return counts.groupBy(F.lower("word").alias("form")).agg(F.sum("n").alias("occurrences"), F.count("*").alias("n_variants"), listed.alias("v")).select(
        "form", "occurrences", "n_variants", F.array_join(F.transform("v", lambda x: F.concat_ws(":", x["word"], -x["k"])), ",").alias("variants")
    )


@catalog.add(rf"""
with w as (select {DUCK_WORDS} as word from documents),
c as (select lower(word) as form, count(*) as n, sum(case when upper(substr(word, 1, 1)) = substr(word, 1, 1) then 1 else 0 end) as i,
        sum(case when upper(word) = word then 1 else 0 end) as u from w group by 1)
select case when u = n then 'always_upper' when i >= 0.8 * n then 'mostly_initial' when i > 0 then 'mixed' else 'lower' end as profile,
  count(*) as forms, cast(sum(n) as bigint) as occurrences from c group by 1""")
def capitalization_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, i = F.col("occurrences"), F.col("initial_upper")
    profile = F.when(F.col("all_upper") == n, "always_upper").when(i >= 0.8 * n, "mostly_initial").when(i > 0, "mixed").otherwise("lower")
    return form_counts(spark, sf_dir).groupBy(profile.alias("profile")).agg(F.count("*").alias("forms"), F.sum("occurrences").alias("occurrences"))


QUEUES = """case when length(form) <= 2 or (length(form) <= 4 and dotted >= 0.25 * n) or upper_n = n then 'abbreviation'
  when initial >= 0.8 * n then 'proper_name' when dotted >= 0.25 * n then 'sentence_end' else 'common' end"""


@catalog.add(rf"""
with w as (select unnest(regexp_extract_all(text, '\p{{L}}+(?:[''’]\p{{L}}+)*\.?')) as token from documents),
s as (select rtrim(token, '.') as word, case when token like '%.' then 1 else 0 end as dot from w),
c as (select lower(word) as form, count(*) as n, sum(dot) as dotted, sum(case when upper(word) = word then 1 else 0 end) as upper_n,
        sum(case when upper(substr(word, 1, 1)) = substr(word, 1, 1) then 1 else 0 end) as initial from s group by 1)
select form, n as occurrences, cast(dotted as bigint) as dotted, {QUEUES} as queue from c""")
def period_ratio_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue a form belongs to, by length, casing and how often a period follows it."""
    return run_sql(spark, sf_dir, "documents", rf"""
with w as (select explode(regexp_extract_all(text, r"\p{{L}}+(?:['’]\p{{L}}+)*\.?", 0)) as token from documents),
s as (select rtrim('.', token) as word, case when token like '%.' then 1 else 0 end as dot from w),
c as (select lower(word) as form, count(*) as n, sum(dot) as dotted, sum(case when upper(word) = word then 1 else 0 end) as upper_n,
        sum(case when upper(substr(word, 1, 1)) = substr(word, 1, 1) then 1 else 0 end) as initial from s group by 1)
select form, n as occurrences, dotted, {QUEUES} as queue from c""")


@catalog.add(rf"""
with t as (select distinct doc_id, lang, lower({DUCK_WORDS}) as token from documents),
n as (select lang, count(distinct doc_id) as n from t group by lang),
d as (select lang, token, count(*) as df from t group by 1, 2)
select d.lang, token, df, round(ln((n + 1) / (df + 1)) + 1, 9) as idf from d join n on d.lang is not distinct from n.lang""")
def doc_frequency_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0)), F.lower))
    t = docs.select("doc_id", "lang", found.alias("tokens")).where("size(tokens) > 0")
    n = t.groupBy("lang").agg(F.count("*").alias("n"))  # a row a language
    df = t.select("lang", F.explode("tokens").alias("token")).groupBy("lang", "token").agg(F.count("*").alias("df"))
    joined = df.join(F.broadcast(n), df["lang"].eqNullSafe(n["lang"])).drop(n["lang"])
    return joined.select("lang", "token", "df", F.round(F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1, 9).alias("idf"))


OVERLAP = """
with {tokens},
size_n as (select count(*) as n from (select distinct doc_id from d)),
df as (select token, count(*) as df from d group by token),
idf as (select token, df, ln((n + 1) / (df + 1)) + 1 as idf from df cross join size_n),
dw as (select doc_id, sum(idf) as w from d join idf using (token) group by doc_id),
bw as (select item_id, sum(idf) as w from b join idf using (token) group by item_id),
both_ as (select d.doc_id, b.item_id, d.token, idf from d join b on b.token = d.token join idf on idf.token = d.token)
"""
DUCK_OVERLAP = OVERLAP.format(tokens=rf"""d as (select distinct doc_id, lower({DUCK_WORDS}) as token from documents),
b as (select distinct item_id, lower({DUCK_WORDS}) as token from benchmark)""")


def shared_tokens(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, item_id, token, idf) of every token that a document shares with a benchmark item, and the
    weights of all tokens: (doc_id, dw) and (item_id, bw)."""
    found = F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0)), F.lower))).alias("token")
    d, b = table(spark, sf_dir, "documents").select("doc_id", found), table(spark, sf_dir, "benchmark").select("item_id", found)
    n = table(spark, sf_dir, "documents").where(F.col("text").rlike(LETTERS)).agg(F.countDistinct("doc_id").alias("n"))
    df = d.groupBy("token").agg(F.count("*").alias("df"))
    idf = df.join(F.broadcast(n)).select("token", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    weighed = d.join(idf, "token").repartition("doc_id")  # where the items are sent out, their pairs need no other exchange
    items = b.join(idf, "token")
    dw, bw = weighed.groupBy("doc_id").agg(F.sum("idf").alias("dw")), items.groupBy("item_id").agg(F.sum("idf").alias("bw"))
    return weighed.join(b, "token"), dw, bw


WEIGHTED = """select doc_id, item_id, count(*) as shared_tokens,
  round(0.75 * sum(idf) / least(any_value(dw.w), any_value(bw.w)) + 0.25 * sum(idf) / (any_value(dw.w) + any_value(bw.w) - sum(idf)), 6) as score
from both_ join dw using (doc_id) join bw using (item_id) group by doc_id, item_id"""


@catalog.add(DUCK_OVERLAP + WEIGHTED)
def weighted_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverse-document-frequency overlap of documents with benchmark items: containment and Jaccard, of
    every pair that shares a token."""
    both, dw, bw = shared_tokens(spark, sf_dir)
    pairs = both.groupBy("doc_id", "item_id").agg(F.count("*").alias("shared_tokens"), F.sum("idf").alias("s")).join(dw, "doc_id").join(bw, "item_id")
    return pairs.select("doc_id", "item_id", "shared_tokens", F.round(overlap_score("s", "dw", "bw"), 6).alias("score"))


TERMS = """select doc_id, item_id, rn, token from
  (select doc_id, item_id, token, row_number() over (partition by doc_id, item_id order by round(idf, 9) desc, token) as rn from both_) t where rn <= 12"""


@catalog.add(DUCK_OVERLAP + TERMS)
def top_shared_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = shared_tokens(spark, sf_dir)[0]
    return top_n(both, ["doc_id", "item_id"], [F.desc(F.round("idf", 9)), F.asc("token")], 12).select("doc_id", "item_id", "rn", "token")


@catalog.add(rf"""
with f as (select lang, lower({DUCK_WORDS}) as form from documents), c as (select lang, form, count(*) as n from f group by 1, 2),
l as (select distinct lower({DUCK_WORDS}) as form from benchmark)
select lang, case when l.form is not null then 'covered' else 'missing' end as status, count(*) as forms, cast(sum(n) as bigint) as occurrences
from c left join l on c.form = l.form group by 1, 2""")
def corpus_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms and occurrences by language that a lexicon has or misses; forms are counted before the join."""
    docs = table(spark, sf_dir, "documents").select("lang", F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0))).alias("word"))
    counts = docs.groupBy("lang", F.lower("word").alias("form")).agg(F.count("*").alias("n"))
    lexicon = words(spark, sf_dir, "benchmark", "item_id").select(F.lower("word").alias("form")).distinct().withColumn("known", F.lit(True))
    status = F.when(F.col("known"), "covered").otherwise("missing").alias("status")
    return counts.join(lexicon, "form", "left").groupBy("lang", status).agg(F.count("*").alias("forms"), F.sum("n").alias("occurrences"))


@catalog.add(rf"""
with w as (select {DUCK_WORDS} as word from documents),
c as (select lower(word) as form, count(*) as n, sum(case when upper(substr(word, 1, 1)) = substr(word, 1, 1) then 1 else 0 end) as i from w group by 1),
l as (select distinct lower({DUCK_WORDS}) as form from benchmark),
q as (select form, n, case when length(form) <= 2 then 'short' when i >= 0.8 * n then 'name' else 'common' end as queue from c where form not in (select form from l))
select queue, form, n as occurrences, rn from (select *, row_number() over (partition by queue order by n desc, form) as rn from q) where rn <= 20""")
def unknown_topn_per_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = words(spark, sf_dir, "benchmark", "item_id").select(F.lower("word").alias("form")).distinct()
    n, i = F.col("occurrences"), F.col("initial_upper")
    queue = F.when(F.length("form") <= 2, "short").when(i >= 0.8 * n, "name").otherwise("common")
    unknown = form_counts(spark, sf_dir).join(lexicon, "form", "left_anti").withColumn("queue", queue)
    return top_n(unknown, ["queue"], [F.desc("occurrences"), F.asc("form")], 20).select("queue", "form", "occurrences", "rn")


@catalog.add(r"""
with l as (select unnest(string_split(text, chr(10))) as line from documents)
select line, count(*) as n from l where trim(line) <> '' group by line having count(*) > 1""")
def run_length_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.where("trim(line) <> ''").groupBy("line").agg(F.count("*").alias("n")).where("n > 1")


@catalog.add("""
select prefix, count(*) as n, min(doc_id) as first_id, max(doc_id) as last_id from
(select doc_id, substr(text, 1, 60) as prefix from documents where text is not null) group by prefix having count(*) > 1""")
def duplicate_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.substring("text", 1, 60).alias("prefix"))
    return docs.groupBy("prefix").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("n > 1")


@catalog.add(rf"""
with w as (select source, lower({DUCK_WORDS}) as form from documents),
a as (select distinct form from w where source = 'src0'), b as (select distinct form from w where source = 'src1')
select (select count(*) from a) as left_n, (select count(*) from b) as right_n, (select count(*) from (select * from a intersect select * from b)) as both_n,
  case when (select count(*) from (select * from a except select * from b)) = 0 and (select count(*) from (select * from b except select * from a)) = 0 then 'same'
       when (select count(*) from (select * from a except select * from b)) = 0 then 'subset'
       when (select count(*) from (select * from b except select * from a)) = 0 then 'superset'
       when (select count(*) from (select * from a intersect select * from b)) > 0 then 'overlap' else 'disjoint' end as relation""")
def set_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the forms of two sources relate as sets; one pass over the distinct forms."""
    docs = table(spark, sf_dir, "documents").where("source in ('src0', 'src1')")
    forms = docs.select("source", F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0))).alias("word"))
    sides = forms.groupBy(F.lower("word").alias("form")).agg(F.bool_or(F.col("source") == "src0").alias("l"), F.bool_or(F.col("source") == "src1").alias("r"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    counts = sides.agg(n(F.col("l")).alias("left_n"), n(F.col("r")).alias("right_n"), n(F.col("l") & F.col("r")).alias("both_n"))
    counts = counts.select(*[F.coalesce(c, F.lit(0)).alias(c) for c in counts.columns])
    relation = (
        F.when((F.col("both_n") == F.col("left_n")) & (F.col("both_n") == F.col("right_n")), "same").when(F.col("both_n") == F.col("left_n"), "subset")
        .when(F.col("both_n") == F.col("right_n"), "superset").when(F.col("both_n") > 0, "overlap").otherwise("disjoint")
    )
    return counts.withColumn("relation", relation)


QUERIES, ORACLE_SQL = catalog.queries, catalog.oracles
