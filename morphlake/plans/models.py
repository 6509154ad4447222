"""Sequence models, graphs, fixed points and beams over the shared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph, markov
from ..sources.tables import table
from .registry import Catalog, run_sql

catalog = Catalog()

DUCK_STEPS = """
o as (select user_id, event_type as next, coalesce(lag(event_type) over w, '<s>') as c1, coalesce(lag(event_type, 2) over w, '<s>') as c2, lead(event_type) over w is null as last from events window w as (partition by user_id order by ts, event_id)),
x as (select user_id, c1, c2, next from o union all select user_id, next, c1, '</s>' from o where last)"""


def steps(spark: SparkSession, sf_dir: str, depth: int = 2) -> DataFrame:
    return markov.with_contexts(table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"], depth)


@catalog.add(f"with {DUCK_STEPS} select c2, c1, next, count(*) as n, cast(sum(count(*)) over (partition by c2, c1) as bigint) as total from x group by 1, 2, 3")
def markov_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = markov.transition_counts(steps(spark, sf_dir), ["c2", "c1"])
    return counts.select("c2", "c1", "next", "n", F.sum("n").over(Window.partitionBy("c2", "c1")).alias("total"))


@catalog.add(f"""with {DUCK_STEPS}, n as (select c1, next, count(*) as n from x group by 1, 2), t as (select c1, sum(n) as t from n group by 1), v as (select count(distinct next) as v from x)
select user_id, count(*) as steps, round(sum(ln((n + 0.5) / (t + 0.5 * v))), 6) as log_p from x join n using (c1, next) join t using (c1) cross join v group by 1""")
def markov_logprob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of each user's sequence, end included, with additive smoothing."""
    x = steps(spark, sf_dir)
    counts = markov.transition_counts(x, ["c1"])
    totals = counts.groupBy("c1").agg(F.sum("n").alias("t"))
    v = x.select("next").distinct().agg(F.count("*").alias("v"))  # one row
    p = F.log(markov.smoothed(F.col("n"), F.col("t"), F.col("v"), 0.5))
    model = counts.join(totals, "c1").crossJoin(F.broadcast(v)).select("c1", "next", p.alias("lp"))
    return x.join(model, ["c1", "next"]).groupBy("user_id").agg(F.count("*").alias("steps"), F.round(F.sum("lp"), 6).alias("log_p"))


@catalog.add(f"""with {DUCK_STEPS}, u as (select next, count(*) as n from x group by 1), p0 as (select next, (n + 0.5) / ((select sum(n) from u) + 0.5 * (select count(*) from u)) as p from u),
n1 as (select c1, next, count(*) as n from x group by 1, 2), p1 as (select c1, next, (n + 2.0 * p) / (sum(n) over (partition by c1) + 2.0) as p from n1 join p0 using (next)),
n2 as (select c1, c2, next, count(*) as n from x group by 1, 2, 3)
select c2, c1, next, round((n + 2.0 * p) / (sum(n) over (partition by c1, c2) + 2.0), 9) as p from n2 join p1 using (c1, next)""")
def markov_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markov.backoff_probability(steps(spark, sf_dir), 2, 2.0, 0.5).select("c2", "c1", "next", F.round("p", 9).alias("p"))


@catalog.add(f"""with {DUCK_STEPS}, own as (select user_id, c1, next, count(*) as n from x group by 1, 2, 3), al as (select c1, next, sum(n) as a from own group by 1, 2),
ot as (select user_id, c1, sum(n) as t from own group by 1, 2), tot as (select c1, sum(a) as t from al group by 1), s as (select next, count(*) as s from x group by 1),
lost as (select user_id, count(*) as l from (select user_id, next, count(*) as n from x group by 1, 2) join s using (next) where n = s group by 1)
select user_id, cast(sum(n) as bigint) as steps, round(sum(n * ln((a - n + 0.5) / (tot.t - ot.t + 0.5 * ((select count(*) from s) - coalesce(l, 0))))), 6) as log_p
from own join al using (c1, next) join ot using (user_id, c1) join tot using (c1) left join lost using (user_id) group by user_id""")
def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user under the model of all others, in one pass: total counts less the user's own."""
    out = markov.leave_one_out(steps(spark, sf_dir), "user_id", 0.5)
    return out.select("user_id", "steps", F.round("log_p", 6).alias("log_p"))


@catalog.add(r"""
with recursive l as (select doc_id, md5(string_split(text, chr(10))[1]) as k from documents where text is not null union select doc_id, md5(string_split(text, chr(10))[-1]) from documents where text is not null),
e as (select a.doc_id as u, m.v from l a join (select k, min(doc_id) as v from l group by k) m using (k)),
b as (select u, v from e union select v, u from e), r as (select u, u as c from b union select b.u, r.c from r join b on b.v = r.u and r.c < b.u)
select u as doc_id, min(c) as component_id from r group by u""")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share a first or last line, directly or over others: the smallest id reachable.

    Each line links its documents to the first of them: as many edges as documents, however common the line."""
    lines = F.split("text", "\n")
    l = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.explode(F.array_distinct(F.array(F.md5(lines[0]), F.md5(F.element_at(lines, -1))))).alias("k"))  # noqa: E741
    first = l.groupBy("k").agg(F.min("doc_id").alias("v"))
    edges = l.join(first, "k").select(F.col("doc_id").alias("u"), "v")
    found = graph.components(edges)
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id")
    return docs.join(found, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("component", "doc_id").alias("component_id")).distinct()


@catalog.add("""
with recursive e as (select distinct l_partkey * 2 as p, l_suppkey * 2 + 1 as s from lineitem where l_quantity >= 48), b as (select p as u, s as v from e union select s, p from e),
r as (select s_suppkey * 2 + 1 as u from supplier where s_nationkey = 0 union select b.v from r join b using (u))
select case when u % 2 = 0 then 'part' else 'supplier' end as kind, u // 2 as id from r""")
def fixpoint_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers with support, found to a fixed point from the suppliers of one nation."""
    e = table(spark, sf_dir, "lineitem").where("l_quantity >= 48").selectExpr("l_partkey * 2 as p", "l_suppkey * 2 + 1 as s").distinct()
    both = e.select(F.col("p").alias("u"), F.col("s").alias("v")).unionByName(e.select(F.col("s").alias("u"), F.col("p").alias("v")))
    seeds = table(spark, sf_dir, "supplier").where("s_nationkey = 0").selectExpr("s_suppkey * 2 + 1 as u")
    kind = F.when(F.col("u") % 2 == 0, "part").otherwise("supplier")
    return graph.closure(seeds, both).select(kind.alias("kind"), F.floor(F.col("u") / 2).alias("id"))


LATTICE = [(p, c, s) for p, row in enumerate([(5, 3, 4, 1), (2, 6, 1, 3), (4, 4, 2, 5), (1, 2, 6, 3)], 1) for c, s in enumerate(row)]
WIDTH = 3


def _duck_beam() -> str:
    cells = "(values " + ", ".join(map(str, LATTICE)) + ") as x(pos, cand, score)"
    out = f"with c as (select * from {cells}), b1 as (select cast(cand as varchar) as path, cand, score as total from c where pos = 1 qualify row_number() over (order by score desc, path) <= {WIDTH})"
    for p in range(2, 5):
        out += f""", b{p} as (select b.path || '-' || c.cand as path, c.cand, total + c.score + case when (b.cand + c.cand) % 2 = 0 then 2 else 0 end as total from b{p - 1} b join c on c.pos = {p}
qualify row_number() over (order by total + c.score + case when (b.cand + c.cand) % 2 = 0 then 2 else 0 end desc, b.path || '-' || c.cand) <= {WIDTH})"""
    return out + " select path, cast(total as bigint) as total from b4"


@catalog.add(_duck_beam())
def beam_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best paths through a lattice, a few kept at each step."""
    from ..operators.search import beam

    cells = spark.createDataFrame(LATTICE, "pos int, cand int, score int")
    bonus = F.when((F.col("prev") + F.col("cand")) % 2 == 0, 2).otherwise(0)
    return beam(cells, 4, WIDTH, bonus).select("path", F.col("total").cast("long").alias("total"))


@catalog.add("""
with a as (select conv_id, turn as d, turn - (length(text) % 3 + 1) as h from conversations), k as (select conv_id, least(d, h) as l, greatest(d, h) as r from a where h >= 0)
select x.conv_id, count(*) as arcs, count(*) filter (where exists (select 1 from k y where y.conv_id = x.conv_id and x.l < y.l and y.l < x.r and x.r < y.r)) as crossed from k x group by x.conv_id""")
def projective_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arcs of each conversation, and those another arc crosses: begins inside and ends outside."""
    return run_sql(spark, sf_dir, "conversations", """
with a as (select conv_id, turn as d, turn - (length(text) % 3 + 1) as h from conversations), k as (select conv_id, least(d, h) as l, greatest(d, h) as r from a where h >= 0),
c as (select distinct x.conv_id, x.l, x.r from k x join k y on y.conv_id = x.conv_id and y.l between x.l + 1 and x.r - 1 and x.r < y.r)
select k.conv_id, count(*) as arcs, count(c.l) as crossed from k left join c on k.conv_id = c.conv_id and k.l = c.l and k.r = c.r group by k.conv_id""")


QUERIES, ORACLE_SQL = catalog.queries, catalog.oracles
