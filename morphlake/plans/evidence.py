"""Similarity ranks, calibration, votes, rollups, budgets and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import blocks, ranking, votes
from ..sources.tables import table
from .registry import Catalog, run_sql

catalog = Catalog()

DUCK_PAIRS = """
v as (select vec_id, label, cast(embedding as double[]) as x from embeddings where label is not null),
u as (select vec_id, label, list_transform(x, lambda e: e / sqrt(list_sum(list_transform(x, lambda f: f * f)))) as x from v),
p as (select a.vec_id as l, b.vec_id as r, round(greatest(-1, least(1, list_dot_product(a.x, b.x))), 6) as score from u a join u b on a.label = b.label and a.vec_id <> b.vec_id)"""


def cosine_pairs(spark: SparkSession, sf_dir: str, **limits) -> DataFrame:
    """Pairs of all vectors of a label with the cosine: those of at least a score, or the best of each vector."""
    return blocks.cosine_pairs(table(spark, sf_dir, "embeddings"), "label", **limits)


@catalog.add(f"with {DUCK_PAIRS} select l as left_id, r as right_id, score from p where l < r and score >= 0.3")
def blocked_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosine_pairs(spark, sf_dir, least=0.3).select(F.col("l").alias("left_id"), F.col("r").alias("right_id"), "score")


DUCK_RANKED = DUCK_PAIRS + """,
k as (select l, r, score, rank() over (partition by l order by score desc) as competition_rank, row_number() over (partition by l order by score desc, r) as rn,
  lead(score) over (partition by l order by score desc, r) as next_score, max(score) over (partition by l) as best from p),
m as (select l, r, score, competition_rank, rn, round(case when rn = 1 then score - coalesce(next_score, 0) when competition_rank = 1 then score else score - best end, 6) as margin from k)"""


@catalog.add(f"with {DUCK_RANKED} select l as left_id, r as right_id, score, competition_rank, margin from m where competition_rank <= 5")
def cosine_rank_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best partners of each vector by competition rank, with margins."""
    ranked = ranking.rank_with_margin(cosine_pairs(spark, sf_dir, top=5), ["l"], "score", "r").where("competition_rank <= 5")
    return ranked.select(F.col("l").alias("left_id"), F.col("r").alias("right_id"), "score", F.col("competition_rank").cast("long").alias("competition_rank"), F.round("margin", 6).alias("margin"))


@catalog.add(f"""with {DUCK_RANKED}, b as (select * from m where competition_rank = 1 and margin > 0)
select a.l as left_id, a.r as right_id, a.score, a.margin, c.margin as back_margin from b a join b c on a.l = c.r and a.r = c.l where a.l < a.r""")
def mutual_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = ranking.mutual_best(cosine_pairs(spark, sf_dir, top=2), "l", "r", "score")
    return best.select(F.col("l").alias("left_id"), F.col("r").alias("right_id"), "score", F.round("margin", 6).alias("margin"), F.round("back_margin", 6).alias("back_margin"))


@catalog.add(f"""with {DUCK_RANKED} select l as vec_id, max(score) as best, round(avg(score), 7) as top3_mean, arg_min(r, rn) as best_id from m where rn <= 3 group by l""")
def top3_mean_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = ranking.top_n(cosine_pairs(spark, sf_dir, top=3, ties=False), ["l"], [F.desc("score"), F.asc("r")], 3)
    return top.groupBy(F.col("l").alias("vec_id")).agg(F.max("score").alias("best"), F.round(F.avg("score"), 7).alias("top3_mean"), F.min_by("r", "rn").alias("best_id"))


DUCK_BUCKET = "cast(('0x' || substr(sha256('42:' || doc_id), 1, 8)) as bigint) % 100"


def split_bucket(column) -> F.Column:
    """0 to 99 from the first 32 bits of the SHA-256 of seed and group: stable wherever it is computed."""
    return (F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit("42"), column.cast("string")), 256), 1, 8), 16, 10).cast("long") % 100).alias("bucket")


@catalog.add(f"select case when {DUCK_BUCKET} < 70 then 'dev' else 'test' end as side, quality, count(*) as n, min(doc_id) as first_id from labels group by 1, 2")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", split_bucket(F.col("doc_id")))
    side = F.when(F.col("bucket") < 70, "dev").otherwise("test").alias("side")
    return labels.groupBy(side, "quality").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@catalog.add("""
with s as (select doc_id, case when toxic = 1 then 'toxic' when quality = 0 then 'poor' else 'plain' end as stratum from labels),
k as (select *, row_number() over (partition by stratum order by doc_id) - 1 as k, count(*) over (partition by stratum) as n from s)
select stratum, doc_id from k where exists (select 1 from range(20) t(i) where k = case when n <= 20 then i else cast(floor(i * (n - 1) / 19.0 + 0.5) as bigint) end)""")
def stratified_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty rows of each stratum at even steps; a row is in the first stratum it fits."""
    stratum = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").otherwise("plain").alias("stratum")
    rows = table(spark, sf_dir, "labels").select(stratum, "doc_id")
    return ranking.spread_sample(rows, "stratum", "doc_id", 20).select("stratum", "doc_id")


SCORED = """s as (select l.doc_id, quality, cast(len(regexp_extract_all(text, '[.!?]')) as double) as dots, least(1.0, cast(length(text) as double) / 4000) as score
  from labels l join documents d on l.doc_id = d.doc_id)"""
GRID = """, g as (select t / 20.0 as threshold, m / 10.0 as margin from range(0, 21) a(t), range(0, 3) b(m)),
e as (select threshold, margin, sum(case when score >= threshold + margin and quality = 1 then 1 else 0 end) as tp, sum(case when score >= threshold + margin and quality = 0 then 1 else 0 end) as fp,
  sum(case when quality = 1 then 1 else 0 end) as pos from s, g group by 1, 2)
"""


@catalog.add(f"with {SCORED}{GRID} select round(threshold, 2) as threshold, round(margin, 2) as margin, cast(tp as bigint) as tp, cast(fp as bigint) as fp, round(tp / pos, 6) as recall from e")
def threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True and false positives at every threshold and margin. The scores are counted by the steps they
    pass; the grid sums counts, so no row meets the whole grid."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.least(F.lit(1.0), F.length("text").cast("double") / 4000).alias("score"))
    s = table(spark, sf_dir, "labels").join(docs, "doc_id").groupBy("score", "quality").agg(F.count("*").alias("n"))
    return s_grid(spark, s)


def s_grid(spark: SparkSession, s: DataFrame) -> DataFrame:
    steps = spark.range(21).select((F.col("id") / 20.0).alias("threshold")).crossJoin(spark.range(3).select((F.col("id") / 10.0).alias("margin")))
    # a score's place among the 41 twentieths that threshold + margin can be, then 63 cells over 42 places
    level = spark.range(21).crossJoin(spark.range(3).withColumnRenamed("id", "m")).select(((F.col("id") / 20.0) + (F.col("m") / 10.0)).alias("cut")).distinct()
    cuts = [r["cut"] for r in level.orderBy("cut").collect()]
    place = sum((F.col("score") >= c).cast("int") for c in cuts)
    binned = s.groupBy(place.alias("place"), "quality").agg(F.sum("n").alias("n"))
    order = F.array_position(F.array(*[F.lit(c) for c in cuts]), F.col("threshold") + F.col("margin"))
    cell = steps.withColumn("need", order)
    n = lambda q: F.sum(F.when((F.col("quality") == q) & (F.col("place") >= F.col("need")), F.col("n")).otherwise(0))
    e = cell.join(binned).groupBy("threshold", "margin").agg(n(1).alias("tp"), n(0).alias("fp"), F.sum(F.when(F.col("quality") == 1, F.col("n")).otherwise(0)).alias("pos"))
    return e.select(F.round("threshold", 2).alias("threshold"), F.round("margin", 2).alias("margin"), "tp", "fp", F.round(F.col("tp") / F.col("pos"), 6).alias("recall"))


@catalog.add(f"""with {SCORED}, k as (select s.*, source, row_number() over (partition by source order by score desc, s.doc_id) as rn from s join documents d on d.doc_id = s.doc_id),
f as (select source, min(case when quality = 1 then rn end) as first_hit from k group by source)
select (select count(*) from k where score >= 0.5) as selected, (select count(*) from k where score >= 0.5 and quality = 1) as hits,
 (select round(avg(cast(quality as double)), 6) from k where score >= 0.5) as precision_, (select round(sum(case when score >= 0.5 then 1.0 else 0 end) / count(*), 6) from k where quality = 1) as recall,
 (select round(avg(coalesce(1.0 / first_hit, 0)), 6) from f) as mrr""")
def precision_recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.least(F.lit(1.0), F.length("text").cast("double") / 4000).alias("score"))
    k = table(spark, sf_dir, "labels").join(docs, "doc_id")
    best, picked = F.col("quality") == 1, F.col("score") >= 0.5
    totals = k.agg(
        F.sum(picked.cast("long")).alias("selected"), F.sum((picked & best).cast("long")).alias("hits"), F.round(F.avg(F.when(picked, F.col("quality").cast("double"))), 6).alias("precision_"),
        F.round(F.sum((picked & best).cast("double")) / F.sum(best.cast("double")), 6).alias("recall"),
    )
    rn = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "doc_id"))
    first = k.withColumn("rn", rn).groupBy("source").agg(F.min(F.when(best, F.col("rn"))).alias("f"))
    return totals.join(first.agg(F.round(F.avg(F.coalesce(1 / F.col("f"), F.lit(0.0))), 6).alias("mrr")))


VOTE = """
with v as (select l_orderkey, l_returnflag as v, count(*) as n from lineitem group by 1, 2),
c as (select l_orderkey, sum(case when n >= 2 then 1 else 0 end) as e, count(v) as n_values, arg_max(v, n) as b, max(v) as o from v group by 1)
"""


@catalog.add(VOTE + """select l_orderkey, n_values, case when e = 1 then 'majority' when n_values = 1 then 'agreement' when n_values > 1 then 'conflict' else 'unknown' end as status,
case when e = 1 then b when n_values = 1 then o end as winner from c""")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.majority(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag"), ["l_orderkey"], "l_returnflag").select("l_orderkey", "n_values", "status", "winner")


@catalog.add("""
with f as (select l_partkey, l_suppkey as fam, min(l_returnflag) as lo, max(l_returnflag) as hi from lineitem group by 1, 2), s as (select l_partkey, lo as v from f where lo = hi),
v as (select l_partkey, v, count(*) as n from s group by 1, 2), c as (select l_partkey, sum(case when n >= 2 then 1 else 0 end) as e, count(v) as n_values, arg_max(v, n) as b, max(v) as o, cast(sum(n) as bigint) as n_families from v group by 1)
select l_partkey, n_families, n_values, case when e = 1 then 'majority' when n_values = 1 then 'agreement' when n_values > 1 then 'conflict' else 'unknown' end as status,
case when e = 1 then b when n_values = 1 then o end as winner from c""")
def family_vote_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vote a supplier that agrees with itself, then the majority by part."""
    v = votes.family_vote(table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag"), ["l_partkey"], "l_suppkey", "l_returnflag")
    return v.select("l_partkey", "n_families", "n_values", "status", "winner")


@catalog.add("""
with m as (select l_orderkey, 1 << (l_linenumber - 1) as known, case when l_returnflag = 'A' then 1 << (l_linenumber - 1) else 0 end as long_ from lineitem)
select l_orderkey, cast(bit_or(known) as bigint) as known, cast(bit_or(long_) as bigint) as long_, cast(bit_or(long_) & bit_or(known & ~long_) as bigint) as conflict from m group by 1""")
def bitmask_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks as bit masks: what is known, what is long, and where marks contradict."""
    bit = F.expr("shiftleft(1L, l_linenumber - 1)")
    m = table(spark, sf_dir, "lineitem").select("l_orderkey", bit.alias("k"), F.when(F.col("l_returnflag") == "A", bit).otherwise(0).alias("l"))
    return votes.promote_masks(m, ["l_orderkey"], "k", "l").select("l_orderkey", "known", F.col("long").alias("long_"), "conflict")


@catalog.add("select p_name, min(p_type) as p_type, count(*) as support from part group by p_name having count(distinct p_type) = 1 and count(*) >= 3 union all select p_brand || '/' || p_size, min(p_type), count(*) from part group by 1 having count(distinct p_type) = 1 and count(*) >= 3")
def crosswalk_min_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    keys = part.select(F.explode(F.array("p_name", F.concat_ws("/", "p_brand", "p_size"))).alias("p_name"), "p_type")
    return votes.crosswalk(keys, "p_name", "p_type").select("p_name", "p_type", "support")


@catalog.add("select event_type, count(distinct user_id) as n_users, string_agg(distinct user_id, ',' order by user_id) as users from events where value > 90 group by 1")
def rule_witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which users witness each event type. Pairs are made distinct before they are gathered."""
    w = table(spark, sf_dir, "events").where("value > 90").select("event_type", "user_id").distinct()
    users = F.array_sort(F.collect_list("user_id")).cast("array<string>")
    return w.groupBy("event_type").agg(F.count("*").alias("n_users"), F.array_join(users, ",").alias("users"))


ROLLUP = "select {lang} as lang, {source} as source, count(*) as n, cast(sum(n_chars) as bigint) as chars, cast(grouping(lang) * 2 + grouping(source) as bigint) as level from documents group by grouping sets ((lang, source), (lang), (source), ())"


@catalog.add(ROLLUP.format(lang="lang", source="source"))
def multi_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, "documents", ROLLUP.format(lang="lang", source="source"))


@catalog.add("""
select l_returnflag, l_linestatus, count(*) as n, quantile_disc(l_extendedprice, 0.5) as p50, quantile_disc(l_extendedprice, 0.95) as p95, round(median(l_quantity), 4) as median_quantity from lineitem group by 1, 2""")
def percentile_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles by group."""
    return run_sql(spark, sf_dir, "lineitem", """select l_returnflag, l_linestatus, count(*) as n, percentile_disc(0.5) within group (order by l_extendedprice) as p50,
percentile_disc(0.95) within group (order by l_extendedprice) as p95, round(median(l_quantity), 4) as median_quantity from lineitem group by 1, 2""")


@catalog.add("""
with f as (select l_orderkey, bool_or(l_returnflag = 'A') as a, bool_or(l_returnflag = 'R') as r, bool_or(l_returnflag = 'N') as n, count(distinct l_linestatus) as s, min(l_linestatus) as st, count(*) as lines from lineitem group by 1)
select l_orderkey, case when a and not r and not n then 'direct' when r and not a and not n then 'artificial' when n and not a and not r then 'repaired' else 'mixed' end as coverage, case when s = 1 then st end as shared_status, lines from f""")
def method_set_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The set of methods of each group as a class, and what all its rows share, if anything."""
    has = lambda x: F.array_contains("m", x) & (F.size("m") == 1)
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("m"), F.min("l_linestatus").alias("lo"), F.max("l_linestatus").alias("hi"), F.count("*").alias("lines"))
    cover = F.when(has("A"), "direct").when(has("R"), "artificial").when(has("N"), "repaired").otherwise("mixed")
    return g.select("l_orderkey", cover.alias("coverage"), F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("shared_status"), "lines")


@catalog.add("""
select o_orderpriority, o_orderkey, rn from (select o_orderpriority, o_orderkey, row_number() over w as rn, sum(o_custkey) over (w rows unbounded preceding) as spent from orders window w as (partition by o_orderpriority order by o_totalprice desc, o_orderkey)) where spent <= 100000""")
def budget_prefix_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By priority, the most valuable orders as long as what they cost together stays in the budget."""
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    spent = F.sum("o_custkey").over(w.rowsBetween(Window.unboundedPreceding, 0))
    cut = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", F.row_number().over(w).cast("long").alias("rn"), spent.alias("spent"))
    return cut.where("spent <= 100000").drop("spent")


@catalog.add("select time_bucket(interval '1 hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


@catalog.add("""
with o as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval '6 hours' then 0 else 1 end as opens from events),
s as (select user_id, ts, sum(opens) over (partition by user_id order by ts rows unbounded preceding) as k from o)
select user_id, min(ts) as session_start, max(ts) as last_event, count(*) as n from s group by user_id, k""")
def events_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.min("ts").alias("session_start"), F.max("ts").alias("last_event"), F.count("*").alias("n"))
    return s.select("user_id", "session_start", "last_event", "n")


SUITE = """select o_orderkey, o_orderpriority, ntile(4) over w as quartile, round(percent_rank() over w, 9) as pct, round(cume_dist() over w, 9) as cume,
  nth_value(o_orderkey, 2) over (w rows between unbounded preceding and unbounded following) as second_key, round(avg(o_totalprice) over (w rows between 2 preceding and current row), 4) as moving
from orders window w as (partition by o_orderpriority order by o_totalprice, o_orderkey)"""


@catalog.add(SUITE)
def ranking_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = SUITE.replace("(w rows", "(partition by o_orderpriority order by o_totalprice, o_orderkey rows")
    out = run_sql(spark, sf_dir, "orders", sql)
    return out.withColumn("quartile", F.col("quartile").cast("long"))


QUERIES, ORACLE_SQL = catalog.queries, catalog.oracles
