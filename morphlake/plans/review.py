"""Evidence and review queries: candidates and their support, revisions, masks, dictionary text, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bits, text
from ..operators import evidence
from ..sources import sinks
from ..sources.tables import table
from .corpus import DUCK_WORDS, LETTERS
from .registry import Catalog

catalog = Catalog()


def doc_words(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*columns, F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0))).alias("word")).withColumn("form", F.lower("word"))


@catalog.add(f"""
with w as (select source, lower({DUCK_WORDS}) as form from documents), n as (select form, count(*) as occ from w group by 1), m as (select distinct w.source, w.form, occ from w join n using (form) where source is not null),
k as (select m.*, count(*) over (partition by form) as keys from m), s as (select source, cast(sum(occ) as bigint) as upper_bound, cast(sum(case when keys = 1 then occ else 0 end) as bigint) as exclusive, cast(sum(case when keys > 1 then occ else 0 end) as bigint) as ambiguous from k group by 1),
t as (select source, string_agg(form || ':' || occ || ':' || case when keys = 1 then 'own' else 'shared' end, ',' order by occ desc, form) as top_forms from (select * from k qualify row_number() over (partition by source order by occ desc, form) <= 20) group by 1)
select source, upper_bound, exclusive, ambiguous, top_forms, row_number() over (order by exclusive desc, upper_bound desc, source) as priority from s join t using (source)""")
def candidate_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as candidates of the forms they have: what only one of them explains, and in which order to review."""
    w = doc_words(spark, sf_dir, "source").groupBy("source", "form").agg(F.count("*").alias("n"))
    occ = w.groupBy("form").agg(F.sum("n").alias("occ"))
    return evidence.candidate_stats(w.where("source is not null").join(occ, "form").select("source", "form", "occ"), "form", "source", "occ")


@catalog.add(f"""with w as (select doc_id, lang, lower({DUCK_WORDS}) as form from documents)
select form, left(form, 4) as lemma, lang, count(*) as tokens, count(distinct doc_id) as documents from w group by 1, 2, 3""")
def pair_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and documents by form, lemma and tag; counted by document first, so that no distinct set is gathered."""
    by_doc = doc_words(spark, sf_dir, "doc_id", "lang").groupBy("form", "lang", "doc_id").agg(F.count("*").alias("n"))
    return by_doc.groupBy("form", F.expr("left(form, 4)").alias("lemma"), "lang").agg(F.sum("n").alias("tokens"), F.count("doc_id").alias("documents"))


@catalog.add(f"""with w as (select doc_id, lang, lower({DUCK_WORDS}) as form from documents), a as (select form, count(distinct coalesce(lang, '')) > 1 as ambiguous from w group by 1)
select left(form, 4) as lemma, lang, count(distinct form) as forms, count(distinct doc_id) as documents, count(*) as tokens, count(distinct case when ambiguous then form end) as ambiguous from w join a using (form) group by 1, 2""")
def lemma_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms, documents and tokens of each lemma and tag, and how many of its forms have other tags too."""
    f = doc_words(spark, sf_dir, "doc_id", "lang").groupBy("form", "lang", "doc_id").agg(F.count("*").alias("n")).withColumn("lemma", F.expr("left(form, 4)"))
    by_form = f.groupBy("lemma", "lang", "form").agg(F.sum("n").alias("n"))
    tags = by_form.groupBy("form").agg(F.count("*").alias("tags"))
    forms = by_form.join(tags, "form").groupBy("lemma", "lang").agg(F.count("*").alias("forms"), F.sum("n").alias("tokens"), F.sum((F.col("tags") > 1).cast("long")).alias("ambiguous"))
    docs = f.select("lemma", "lang", "doc_id").distinct().groupBy("lemma", "lang").agg(F.count("doc_id").alias("documents"))
    same = (forms["lemma"] == docs["lemma"]) & forms["lang"].eqNullSafe(docs["lang"])
    return forms.join(docs, same).select(forms["lemma"], forms["lang"], "forms", "documents", "tokens", "ambiguous")


@catalog.add("""with v as (select l_partkey, l_linenumber, l_returnflag, count(distinct l_suppkey) as families from lineitem group by 1, 2, 3), k as (select *, count(*) over (partition by l_partkey, l_linenumber) as kinds from v)
select l_partkey, l_orderkey, count(*) as marks from lineitem join k using (l_partkey, l_linenumber, l_returnflag) group by 1, 2 having bool_and(families >= 2 and kinds = 1)""")
def corroborated_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates whose every mark two families give and none contradicts."""
    m = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_returnflag", "l_suppkey")
    return evidence.corroborated(m, ["l_partkey", "l_orderkey"], ["l_partkey", "l_linenumber"], "l_returnflag", "l_suppkey")


@catalog.add("""with m as (select l_orderkey, l_linenumber % 3 as size, cast(l_partkey & 255 as bigint) as known, cast(l_suppkey & l_partkey & 255 as bigint) as long_ from lineitem), t as (select * from m qualify size = max(size) over (partition by l_orderkey)),
g as (select l_orderkey, count(*) as slots, bit_or(known) as k, bit_or(long_) as l, bit_or(known & ~long_) as s from t group by 1)
select l_orderkey, slots, k & ~(l & s) as known, l & (k & ~(l & s)) as long from g""")
def stem_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of the longest slots together, without what they contradict each other in."""
    m = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber % 3 as size", "cast(l_partkey & 255 as bigint) as known", "cast(l_suppkey & l_partkey & 255 as bigint) as long")
    return evidence.longest_consensus(m, ["l_orderkey"], "size", "known", "long")


@catalog.add("""with e as (select l_orderkey, l_returnflag || l_linestatus as spelling, count(*) as n, min(l_linenumber) as number from lineitem where l_quantity > 10 group by 1, 2)
select l_orderkey, string_agg(l_linenumber || ':' || number, ',' order by l_linenumber, number) as template from lineitem l left join e using (l_orderkey) where e.spelling is null or e.spelling = l.l_returnflag || l.l_linestatus
group by 1 having bool_and(coalesce(n = 1, false)) and count(*) = (select count(*) from lineitem x where x.l_orderkey = l.l_orderkey)""")
def stem_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which radical each slot is, where every spelling has exactly one."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("spelling"), "l_quantity")
    return evidence.stem_template(rows.select("l_orderkey", F.col("l_linenumber").alias("slot"), "spelling"), rows.where("l_quantity > 10").select("l_orderkey", F.col("l_linenumber").alias("number"), "spelling"), ["l_orderkey"])


@catalog.add("""with g as (select l_orderkey, bool_or(l_returnflag = 'R') as proper, count(distinct l_suppkey) as families, count(*) as lines, count(distinct l_linestatus) as genders, bool_and(l_linestatus = 'F') as all_f, bool_and(l_linestatus = 'O') as all_o from lineitem group by 1),
r as (select l_orderkey, not proper and families >= 2 and lines >= 3 and (o_orderpriority <> '1-URGENT' or genders = 1) and (all_f or all_o) as ready, all_f from g join orders on o_orderkey = l_orderkey)
select l_orderkey, case when not ready then 'not_ready' when all_f then 'cross_validated' else 'empirical_structure' end as status from r""")
def draft_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.bool_or(F.col("l_returnflag") == "R").alias("proper"), F.countDistinct("l_suppkey").alias("families"), F.count("*").alias("lines"), F.min("l_linestatus").alias("lo"), F.max("l_linestatus").alias("hi")
    )
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    forms = F.when(F.col("lo") != F.col("hi"), "partial").when(F.col("lo") == "F", "all_slots_attested").otherwise("unavailable")
    status = evidence.draft_readiness(~F.col("proper") & (F.col("families") >= 2), F.col("lines") >= 3, (F.col("o_orderpriority") != "1-URGENT") | (F.col("lo") == F.col("hi")), forms)
    return g.join(o, "l_orderkey").select("l_orderkey", status.alias("status"))


@catalog.add("""select l_orderkey, l_linenumber, round(greatest(l_discount + least(0.08, l_linenumber * 0.02) + case when l_returnflag = 'A' then 0.05 else 0 end + case when l_linestatus = 'F' then 0.02 else 0 end - case when l_returnflag = 'R' then 0.15 else 0 end, l_tax), 6) as ranking from lineitem""")
def ranking_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    score = evidence.ranking_score(c("l_discount").cast("double"), c("l_linenumber"), c("l_returnflag") == "A", c("l_linestatus") == "F", c("l_returnflag") == "R", c("l_tax").cast("double"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(score, 6).alias("ranking"))


TURNS = "t as (select conv_id, turn, min(role) as role from conversations where turn is not null and conv_id is not null group by 1, 2), n as (select *, lag(turn) over (partition by conv_id order by turn) as before, lag(turn, 2) over (partition by conv_id order by turn) as before2, first_value(turn) over (partition by conv_id order by turn) as first from t)"


@catalog.add(f"""with {TURNS}, g as (select conv_id, turn, role, before, 1 as alt, case when turn <> first then first end as head from n union all select conv_id, turn, role, before, 2, coalesce(before2, before) from n),
e as (select conv_id, alt, avg(case when head is not distinct from before then 1.0 else 0 end) as uas, avg(case when head is not distinct from before and coalesce(role, '') = 'user' then 1.0 else 0 end) as las, bool_or(head is null and before is null) as root from g group by 1, 2)
select conv_id, round(max(uas), 6) as uas, round(max(las), 6) as las, bool_or(root) as root_correct from e group by 1""")
def attachment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of turns held against two other trees: shares of right heads and labels, the better of the two."""
    t = table(spark, sf_dir, "conversations").where("turn is not null and conv_id is not null").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    n = t.withColumns({"before": F.lag("turn").over(w), "before2": F.lag("turn", 2).over(w), "first": F.first("turn").over(w)})
    found = n.select("conv_id", F.col("turn").alias("dependent"), F.col("before").alias("head"), F.coalesce("role", F.lit("")).alias("label"))
    alternatives = F.explode(F.array(F.struct(F.lit(1).alias("a"), F.when(F.col("turn") != F.col("first"), F.col("first")).alias("h")), F.struct(F.lit(2).alias("a"), F.coalesce("before2", "before").alias("h")))).alias("x")
    gold = n.select("conv_id", F.col("turn").alias("dependent"), alternatives).select("conv_id", "dependent", F.col("x.a").alias("alternative"), F.col("x.h").alias("head"), F.lit("user").alias("label"))
    out = evidence.attachment_scores(found, gold, ["conv_id"])
    return out.select("conv_id", F.round("uas", 6).alias("uas"), F.round("las", 6).alias("las"), "root_correct")


@catalog.add(f"""with {TURNS} select conv_id, count(before) as arcs, round(sum(cast(0.05 as double) * abs(turn - before)), 6) as penalty from n group by 1""")
def distance_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the arcs of each conversation lose for their length."""
    t = table(spark, sf_dir, "conversations").where("turn is not null and conv_id is not null").select("conv_id", "turn").distinct()
    n = t.withColumn("before", F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn")))
    return n.groupBy("conv_id").agg(F.count("before").alias("arcs"), F.round(F.sum(0.05 * F.abs(F.col("turn") - F.col("before"))), 6).alias("penalty"))


@catalog.add("""with s as (select event_type as event, lag(event_type) over w as a, lag(event_type, 2) over w as b from events window w as (partition by user_id order by ts, event_id)),
x as (select event, 0 as level, '' as context from s union all select event, 1, coalesce(a, '^') from s union all select event, 2, coalesce(b, '^') || ' ' || coalesce(a, '^') from s)
select level, context, event, count(*) as n from x group by 1, 2, 3""")
def factor_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("event_type", F.coalesce(F.lag("event_type").over(w), F.lit("^")).alias("a"), F.coalesce(F.lag("event_type", 2).over(w), F.lit("^")).alias("b"))
    return evidence.factor_counts(e, "event_type", [F.col("a"), F.concat_ws(" ", "b", "a")])


@catalog.add(r"""with m as (select doc_id, ' | ' || replace(text, '.', ';') || ' [x' as raw from documents where text is not null), c as (select doc_id, regexp_replace(regexp_replace(raw, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'), '^\|[\x00-\x20]*', '') as meaning from m)
select doc_id, md5(meaning) as meaning, rtrim(rtrim(array_to_string(string_split(regexp_extract(meaning, '^[^\[\n\r]*'), ';')[1:2], ';'), ' '), ';') as short from c""")
def gloss_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as glosses: cleaned whole, and their first clauses."""
    m = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.concat(F.lit(" | "), F.replace("text", F.lit("."), F.lit(";")), F.lit(" [x")).alias("raw"))
    return m.select("doc_id", F.md5(evidence.normal_meaning(F.col("raw")).cast("binary")).alias("meaning"), evidence.short_meaning(F.col("raw")).alias("short"))


@catalog.add(f"""with f as (select distinct lower({DUCK_WORDS}) as form from documents), a as (select form, strip_accents(replace(replace(replace(form, 'æ', 'ae'), 'œ', 'oe'), 'ß', 'ss')) as a from f)
select form, case when regexp_full_match(a, '[a-z]+') then a end as ascii from a""")
def ascii_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each form is looked up by."""
    return doc_words(spark, sf_dir).select("form").distinct().select("form", evidence.ascii_lookup(F.col("form")).alias("ascii"))


@catalog.add(f"""with f as (select distinct lower({DUCK_WORDS}) as form from benchmark) select form, translate(translate(form, 'aeo', 'āĕō'), 'āēīōūȳăĕĭŏŭ', 'aeiouyaeiou') as plain from f""")
def quantity_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0))).alias("w")).select(F.lower("w").alias("form")).distinct()
    return w.select("form", evidence.strip_quantity_marks(F.translate("form", "aeo", "āĕō")).alias("plain"))


@catalog.add("select doc_id, md5('Instruct: ' || 'Find the same word' || chr(10) || 'Query: [language=' || coalesce(lang, '') || ']' || chr(10) || coalesce(text, '')) as prompt from documents")
def prompt_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(evidence.prompt("Find the same word", F.col("lang"), F.col("text")).cast("binary")).alias("prompt"))


@catalog.add(r"""with t as (select unnest(regexp_extract_all(text, '[A-Za-z]+\.?')) as token from documents), s as (select rtrim(token, '.') as form, token like '%.' as period from t), a(form, declension, variant) as (values ('A', 9, 8), ('C', 9, 8), ('D', 9, 8), ('M', 9, 8), ('P', 9, 8))
select s.form, period, a.form is not null as noun, period and s.form in ('A', 'C', 'D', 'L', 'M') and a.form is not null as in_doubt, count(*) as n from s left join a on a.form = s.form where length(s.form) = 1 group by all""")
def abbreviation_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single letters before a period that are a numeral and an abbreviated name; counted before the join."""
    t = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z]+\.?"), F.lit(0))).alias("token"))
    s = t.select(F.rtrim("token", F.lit(".")).alias("form"), F.col("token").endswith(".").alias("period")).where("length(form) = 1").groupBy("form", "period").agg(F.count("*").alias("n"))
    nouns = spark.createDataFrame([(x, 9, 8) for x in "ACDMP"], "form string, declension int, variant int")
    known = nouns.where("declension = 9 and variant = 8").select("form", F.lit(True).alias("noun"))
    out = s.join(known, "form", "left").withColumn("noun", F.coalesce("noun", F.lit(False)))
    return out.select("form", "period", "noun", evidence.abbreviation_conflict(F.col("form"), F.col("period"), F.col("noun")).alias("in_doubt"), "n")


@catalog.add("""with w as (select conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')) as x, role from conversations where turn is not null and conv_id is not null and text is not null qualify row_number() over (partition by conv_id, turn order by role, text) = 1),
p as (select *, lag(x) over (partition by conv_id order by turn) as y from w)
select conv_id, turn, array_to_string(list_sort(list_filter(list_intersect(x, y), lambda e: e <> coalesce(role, ''))), ' ') as shared, len(list_filter(x, lambda e: not list_contains(y, e))) as fresh from p where y is not null""")
def gloss_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words a turn shares with the one before, its role's name taken out, and how many are its own."""
    x = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)))
    c = table(spark, sf_dir, "conversations").where("turn is not null and conv_id is not null and text is not null")
    once = c.withColumn("rn", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))).where("rn = 1")
    p = once.select("conv_id", "turn", "role", x.alias("x")).withColumn("y", F.lag("x").over(Window.partitionBy("conv_id").orderBy("turn"))).where("y is not null")
    shared = F.array_except(F.array_intersect("x", "y"), F.array(F.coalesce("role", F.lit(""))))
    return p.select("conv_id", "turn", F.array_join(F.array_sort(shared), " ").alias("shared"), F.size(F.array_except("x", "y")).cast("long").alias("fresh"))


@catalog.add("""with r as (select doc_id, n_chars + case when lang = 'en' then 0 else 1 end as revision from documents)
select l.doc_id, l.quality, case when r.doc_id is null then 'no_review' when d.n_chars <> r.revision then 'stale' else 'reviewed' end as status from labels l left join documents d on d.doc_id = l.doc_id left join r on r.doc_id = l.doc_id""")
def decision_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions by the review of their key: there is none, it is of another revision, or it holds."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", (F.col("n_chars") + F.when(F.col("lang") == "en", 0).otherwise(1)).alias("revision"), F.lit(True).alias("has"))
    status = F.when(F.col("has").isNull(), "no_review").when(F.col("n_chars") != F.col("revision"), "stale").otherwise("reviewed")
    return table(spark, sf_dir, "labels").select("doc_id", "quality").join(d, "doc_id", "left").select("doc_id", "quality", status.alias("status"))


@catalog.add("""with r as (select user_id, event_id, ts, value, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events where value > 50), n as (select user_id, count(*) as runs from events group by 1)
select user_id, event_id, ts, runs from r join n using (user_id) where rn = 1""")
def latest_complete_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last complete run of each user with its metadata: an aggregate, no sort."""
    e = table(spark, sf_dir, "events")
    last = F.max(F.when(F.col("value") > 50, F.struct("ts", "event_id"))).alias("m")
    return e.groupBy("user_id").agg(last, F.count("*").alias("runs")).where("m is not null").select("user_id", "m.event_id", "m.ts", "runs")


@catalog.add("""with l as (select conv_id, count(*) as units, cast(sum(len(regexp_extract_all(coalesce(text, ''), '\\S+'))) as bigint) as tokens, cast(sum(octet_length(encode(coalesce(text, '')))) as bigint) as bytes from conversations group by 1)
select conv_id, units, tokens, bytes, cast(units * 31 + tokens * 7 + bytes as bigint) as checksum from l""")
def result_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", F.coalesce("text", F.lit("")).alias("text"))
    n = c.groupBy("conv_id").agg(F.count("*").alias("units"), F.sum(F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)))).alias("tokens"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    return n.withColumn("checksum", F.col("units") * 31 + F.col("tokens") * 7 + F.col("bytes"))


@catalog.add("""with a as (select conv_id, turn, row_number() over (partition by conv_id order by turn) as k from conversations where role = 'user' and turn is not null and conv_id is not null qualify row_number() over (partition by conv_id, turn order by text) = 1),
b as (select conv_id, turn, row_number() over (partition by conv_id order by turn) as k from conversations where role = 'assistant' and turn is not null and conv_id is not null qualify row_number() over (partition by conv_id, turn order by text) = 1)
select conv_id, k, a.turn as asked, b.turn as answered from a full join b using (conv_id, k)""")
def side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions and answers paired by their number."""
    c = table(spark, sf_dir, "conversations").where("turn is not null and conv_id is not null").select("conv_id", "turn", "role").distinct()
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long").alias("k")
    side = lambda role, name: c.where(F.col("role") == role).select("conv_id", F.col("turn").alias(name), "turn", k).drop("turn")
    return side("user", "asked").join(side("assistant", "answered"), ["conv_id", "k"], "full")


# functions with a row of their own

FNV = "list_reduce(list_prepend(14695981039346656037::hugeint, list_transform(range(1, strlen(p_brand) + 1), lambda k: ord(substr(p_brand, k, 1))::hugeint)), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616)"


@catalog.add(f"select p_brand, cast(case when {FNV} >= 9223372036854775808 then {FNV} - 18446744073709551616 else {FNV} end as bigint) as hash from (select distinct p_brand from part)")
def fnv_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_brand").distinct().select("p_brand", bits.fnv1a(F.col("p_brand")).alias("hash"))


@catalog.add("""select o_orderkey, sha256('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}') as revision from orders""")
def content_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", bits.revision(F.col("o_orderkey"), F.col("o_orderstatus")).alias("revision"))


@catalog.add("""with f as (select distinct regexp_extract(lower(p_name), '[a-z]*') as stem from part)
select stem, case when length(stem) = 0 then 0 when length(stem) = 1 then (ascii(stem) - 96) * 27 - 26 else (ascii(stem) - 96) * 27 - 26 + ascii(substr(stem, 2, 1)) - 96 end as bucket from f""")
def stem_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "part").select(F.regexp_extract(F.lower("p_name"), "[a-z]*", 0).alias("stem")).distinct()
    return f.select("stem", bits.stem_bucket(F.col("stem")).alias("bucket"))


@catalog.add("select l_orderkey, l_linenumber, cast((l_linenumber & 7) | ((l_suppkey & 255) << 3) | ((l_partkey & 1023) << 11) as bigint) as packed, l_linenumber & 7 as a, l_suppkey & 255 as b, l_partkey & 1023 as c from lineitem")
def packed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "cast(l_linenumber & 7 as int) as x", "cast(l_suppkey & 255 as int) as y", "cast(l_partkey & 1023 as int) as z")  # noqa: E741
    packed = l.withColumn("packed", bits.pack_fields([(F.col("x"), 3), (F.col("y"), 8), (F.col("z"), 10)]))
    return packed.select("l_orderkey", "l_linenumber", "packed", *[c.alias(n) for c, n in zip(bits.unpack_fields(F.col("packed"), [3, 8, 10]), "abc", strict=True)])


@catalog.add(r"""select doc_id, md5(regexp_replace(coalesce(text, ''), '[\x00-\x1F\x7F]+', ' ', 'g')) as safe, md5(replace(replace(coalesce(text, ''), 'æ', 'ae'), 'œ', 'oe')) as expanded,
case when length(w) > 180 then left(w, 179) || '…' else w end as witness from (select *, trim(regexp_replace(coalesce(text, ''), '[ \t\n\r\f\v]+', ' ', 'g')) as w from documents)""")
def witness_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts for tables: without control characters, ligatures spelled out, and cut to a bound."""
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.safe_text(t).cast("binary")).alias("safe"), F.md5(text.expand_ligatures(t).cast("binary")).alias("expanded"), text.bounded_witness(t).alias("witness"))


UPDATES = "u as (select o_orderkey, 'X' as o_orderstatus from orders where o_orderkey % 3 = 0 union all select -o_orderkey, 'N' from orders where o_orderkey % 5 = 0)"


@catalog.add(f"with {UPDATES} select o_orderkey, o_orderstatus from orders where o_orderkey not in (select o_orderkey from u) union all select * from u")
def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return sinks.merged(o, updates(o), ["o_orderkey"])


@catalog.add(f"with {UPDATES} select o_orderkey, o_orderstatus from orders union all select * from u where o_orderkey not in (select o_orderkey from orders)")
def inserted_or_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return sinks.inserted(o, updates(o), ["o_orderkey"])


def updates(orders: DataFrame) -> DataFrame:
    changed = orders.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"))
    return changed.union(orders.where("o_orderkey % 5 = 0").select(-F.col("o_orderkey"), F.lit("N")))


QUERIES, ORACLE_SQL = catalog.queries, catalog.oracles
