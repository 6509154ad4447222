"""Joins, sets, nested documents, checks and text shapes over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.votes import unambiguous
from ..sources.tables import table
from .registry import Catalog, run_sql

catalog = Catalog()


@catalog.add("""
with n as (select *, lead(turn) over w as next_turn, lead(role) over w as next_role, lead(text) over w as next_text from conversations window w as (partition by conv_id order by turn))
select conv_id, turn, next_turn, length(text) as n, length(next_text) as next_n from n
where role = 'user' and next_role = 'assistant' and next_turn = turn + 1 and not regexp_matches(text, '[,;:]$')""")
def adjacent_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn with the one after it, where both fit and no punctuation blocks them."""
    return run_sql(spark, sf_dir, "conversations", """
with n as (select *, lead(turn) over w as next_turn, lead(role) over w as next_role, lead(text) over w as next_text from conversations window w as (partition by conv_id order by turn))
select conv_id, turn, next_turn, cast(length(text) as bigint) as n, cast(length(next_text) as bigint) as next_n from n
where role = 'user' and next_role = 'assistant' and next_turn = turn + 1 and not text rlike '[,;:]$'""")


GREEDY = """
with o as (select event_id, user_id, event_type, ts, row_number() over (partition by user_id order by ts, event_id) as k,
  lead(event_type) over (partition by user_id order by ts, event_id) as next_type, lead(event_id) over (partition by user_id order by ts, event_id) as next_id from events),
m as (select *, case when event_type in ('view', 'click') and next_type in ('click', 'view', 'purchase') then 1 else 0 end as hit from o),
g as (select *, k - row_number() over (partition by user_id, hit order by k) as run from m where hit = 1),
p as (select *, row_number() over (partition by user_id, run order by k) as place from g)
select user_id, event_id as first_id, next_id as second_id, event_type as first_type, next_type as second_type from p where place % 2 = 1"""


@catalog.add(GREEDY)
def greedy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-overlapping neighbour pairs from the left: in a run of matches the odd ones."""
    return run_sql(spark, sf_dir, "events", GREEDY)


@catalog.add(r"""
select page_id, length(t) as n_chars, md5(t) as text_md5 from (select page_id,
  trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gs'), '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'g'),
    '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '[ \t\n\r]+', ' ', 'g')) as t from pages)""")
def html_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All text of a page: scripts, comments and tags to spaces, entities decoded, spaces squeezed."""
    from ..functions.text import strip_html

    t = table(spark, sf_dir, "pages").select("page_id", strip_html(F.col("html")).alias("t"))
    return t.select("page_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("text_md5"))


@catalog.add("""
with c as (select doc_id, text, unnest(range(0, greatest(1, cast(ceil((length(text) - 100) / 900.0) as bigint)))) as chunk from documents where text is not null and length(text) > 0)
select doc_id, chunk, length(substr(text, chunk * 900 + 1, 1000)) as n_chars, md5(substr(text, chunk * 900 + 1, 1000)) as chunk_md5 from c""")
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 1,000 characters that overlap by 100."""
    from ..functions.text import overlapping_chunks

    docs = table(spark, sf_dir, "documents").where("length(text) > 0")
    c = docs.select("doc_id", F.posexplode(overlapping_chunks(F.col("text"), 1000, 100)).alias("chunk", "part"))
    return c.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.length("part").cast("long").alias("n_chars"), F.md5("part").alias("chunk_md5"))


@catalog.add(r"""
with t as (select item_id, lower(unnest(regexp_extract_all(text, '\p{L}+'))) as w from benchmark),
s as (select item_id, case when length(w) > 5 and right(w, 3) = 'ing' then left(w, length(w) - 3) when length(w) > 4 and right(w, 2) in ('ed', 'es', 'er') then left(w, length(w) - 2) when length(w) > 3 and right(w, 1) = 's' then left(w, length(w) - 1) else w end as token from t
  where w not in ('the', 'of', 'and', 'to', 'in', 'a', 'is', 'that', 'for', 'it'))
select item_id, count(distinct token) as n_tokens, string_agg(distinct token, ' ' order by token) as tokens from s where length(token) >= 3 group by item_id""")
def semantic_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content tokens of an item: lower-cased, without stop words, stripped of endings, three letters or more."""
    from ..functions.text import semantic_token_set

    t = table(spark, sf_dir, "benchmark").select("item_id", F.array_sort(semantic_token_set(F.col("text"))).alias("t"))
    return t.where("size(t) > 0").select("item_id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@catalog.add("""
select event_type, cast(json_extract_string(props, '$.k') as bigint) // 10 as bucket, count(*) as n, round(sum(value), 4) as total from events group by 1, 2""")
def json_field_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field parsed under an explicit schema."""
    e = table(spark, sf_dir, "events").select("event_type", "value", F.from_json("props", "k long")["k"].alias("k"))
    return e.groupBy("event_type", F.floor(F.col("k") / 10).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@catalog.add("""
select o_orderkey, '{"order":' || o_orderkey || ',"lines":[' || string_agg('{"line":' || l_linenumber || ',"part":' || l_partkey || ',"flag":"' || l_returnflag || '"}', ',' order by l_linenumber, l_partkey, l_suppkey, l_returnflag) || ']}' as document
from orders join lineitem on l_orderkey = o_orderkey group by o_orderkey""")
def json_document_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document for each order with its lines in order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").alias("x"))
    kept = F.transform(F.array_sort(F.collect_list("x")), lambda x: F.struct(x["l_linenumber"].alias("line"), x["l_partkey"].alias("part"), x["l_returnflag"].alias("flag")))
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey").agg(kept.alias("lines"))
    return joined.select("o_orderkey", F.to_json(F.struct(F.col("o_orderkey").alias("order"), "lines")).alias("document"))


@catalog.add("""
select l_orderkey, count(*) as n, string_agg(l_linenumber || '/' || l_partkey || '/' || l_returnflag, ';' order by l_linenumber, l_partkey, l_returnflag) as ordered from lineitem group by l_orderkey""")
def nested_order_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.struct("l_linenumber", "l_partkey", "l_returnflag")
    nested = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(x)).alias("x"))
    text = F.array_join(F.transform("x", lambda v: F.concat_ws("/", v["l_linenumber"], v["l_partkey"], v["l_returnflag"])), ";")
    return nested.select("l_orderkey", "n", text.alias("ordered"))


@catalog.add("select l_orderkey, l_linenumber, l_quantity from lineitem where l_shipdate >= timestamp '1998-01-01' and l_quantity > 45")
def projection_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three columns; the filters reach the scan."""
    lines = table(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp_ntz '1998-01-01' and l_quantity > 45")
    return lines.select("l_orderkey", "l_linenumber", "l_quantity")


@catalog.add("""
select coalesce(d.name, 'unknown') as status, count(*) as n, round(sum(o_totalprice), 2) as total from orders left join (values ('O', 'open'), ('F', 'filled')) as d(code, name) on code = o_orderstatus group by 1""")
def enum_dimension_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = spark.createDataFrame([("O", "open"), ("F", "filled")], "code string, name string")
    joined = table(spark, sf_dir, "orders").join(F.broadcast(dim), F.col("code") == F.col("o_orderstatus"), "left")
    return joined.groupBy(F.coalesce("name", F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@catalog.add("select d.doc_id, coalesce(quality, -1) as quality, coalesce(toxic, 0) as toxic, l.doc_id is not null as labelled from documents d left join labels l on d.doc_id = l.doc_id")
def left_sparse_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sparse side table with defaults for rows it lacks."""
    labels = table(spark, sf_dir, "labels").withColumn("labelled", F.lit(True))
    joined = table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left")
    return joined.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"), F.coalesce("labelled", F.lit(False)).alias("labelled"))


@catalog.add("select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')")
def semi_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(urgent, "c_custkey", "left_semi")


@catalog.add("select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)")
def anti_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(large, "c_custkey", "left_anti")


THREE = "select r_name, n_name, c_mktsegment, count(*) as customers, round(sum(c_acctbal), 2) as balance from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey group by 1, 2, 3"


@catalog.add(THREE)
def three_way_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, "customer nation region", THREE)


RANGE = """select a.conv_id, a.turn as first_turn, b.turn as later_turn from conversations a join conversations b on a.conv_id = b.conv_id and a.turn < b.turn and b.turn - a.turn <= 3
where a.role = 'user' and b.role = 'user'"""


@catalog.add(RANGE)
def range_pair_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier and later turns of a conversation within three turns."""
    return run_sql(spark, sf_dir, "conversations", RANGE)


@catalog.add("""select a.conv_id, a.turn as context, b.turn as governor, c.turn as marker, d.turn as dependent from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1
join conversations c on c.conv_id = b.conv_id and c.turn > b.turn and c.turn <= b.turn + 2 join conversations d on d.conv_id = c.conv_id and d.turn > c.turn and d.turn <= c.turn + 2
where a.role = 'user' and b.role = 'assistant' and c.role = 'user' and d.role = 'assistant'""")
def four_way_ordered_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four turns in order, each near the one before: equality on the offset, not a range join."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    step = lambda name, role: t.where(F.col("role") == role).select("conv_id", F.col("turn").alias(name))
    near = lambda f, low, high: F.explode(F.sequence(F.col(f) + low, F.col(f) + high))
    ab = step("context", "user").select("*", (F.col("context") + 1).alias("governor")).join(step("governor", "assistant"), ["conv_id", "governor"])
    abc = ab.select("*", near("governor", 1, 2).alias("marker")).join(step("marker", "user"), ["conv_id", "marker"])
    out = abc.select("*", near("marker", 1, 2).alias("dependent")).join(step("dependent", "assistant"), ["conv_id", "dependent"])
    return out.select("conv_id", "context", "governor", "marker", "dependent")


@catalog.add("select p_name, min(p_brand) as p_brand from part group by p_name having count(distinct p_brand) = 1")
def unambiguous_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unambiguous(table(spark, sf_dir, "part").select("p_name", "p_brand"), "p_name", "p_brand")


@catalog.add("""
with a as (select o_orderkey, o_orderstatus as s from orders where o_orderkey % 3 <> 0), b as (select o_orderkey, case when o_totalprice > 300000 then 'P' else o_orderstatus end as s from orders where o_orderkey % 5 <> 0)
select case when a.o_orderkey is null then 'added' when b.o_orderkey is null then 'removed' when a.s <> b.s then 'changed' else 'same' end as diff, count(*) as n from a full outer join b on a.o_orderkey = b.o_orderkey group by 1""")
def full_outer_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a table side by side: what was added, removed, changed."""
    orders = table(spark, sf_dir, "orders")
    a = orders.where("o_orderkey % 3 <> 0").select("o_orderkey", F.col("o_orderstatus").alias("s"), F.lit(True).alias("old"))
    b = orders.where("o_orderkey % 5 <> 0").select("o_orderkey", F.when(F.col("o_totalprice") > 300000, "P").otherwise(F.col("o_orderstatus")).alias("t"), F.lit(True).alias("new"))
    diff = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("s") != F.col("t"), "changed").otherwise("same")
    return a.join(b, "o_orderkey", "full_outer").groupBy(diff.alias("diff")).agg(F.count("*").alias("n"))


CHECKS = [
    ("nation_region", "nation", "n_regionkey", "region", "r_regionkey"), ("customer_nation", "customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier_nation", "supplier", "s_nationkey", "nation", "n_nationkey"), ("orders_customer", "orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem_orders", "lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem_part", "lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem_supplier", "lineitem", "l_suppkey", "supplier", "s_suppkey"), ("labels_documents", "labels", "doc_id", "documents", "doc_id"),
]


@catalog.add(" union all ".join(f"select '{name}' as rule, count(*) as violations from {child} c where c.{fk} is not null and not exists (select 1 from {parent} p where p.{pk} = c.{fk})" for name, child, fk, parent, pk in CHECKS))
def fk_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each child table whose key the parent lacks."""
    from functools import reduce

    def one(name, child, fk, parent, pk):
        keys = table(spark, sf_dir, parent).select(F.col(pk).alias("k"))
        rows = table(spark, sf_dir, child).where(F.col(fk).isNotNull()).select(F.col(fk).alias("k"))
        return rows.join(keys, "k", "left_anti").agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations")

    return reduce(DataFrame.unionByName, [one(*c) for c in CHECKS])


HOMOGRAPH = """
with w as (select p_name, p_type, p_brand, p_size % 4 as mark from part),
h as (select distinct a.p_name, a.p_type as target, a.mark from w a join w b on a.p_name = b.p_name and a.p_brand <> b.p_brand and a.p_type <> b.p_type and a.mark <> b.mark)
"""


@catalog.add(HOMOGRAPH + "select p_name, target, count(*) as n_marks, string_agg(mark, ',' order by mark) as marks from h group by 1, 2")
def homograph_opposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks that a target has in opposition to another of its name, by another witness.

    Names are first reduced to distinct (name, brand, type, mark): the pairs of a name are pairs of these."""
    w = table(spark, sf_dir, "part").select("p_name", "p_type", "p_brand", (F.col("p_size") % 4).alias("mark")).distinct()
    b = w.select("p_name", F.col("p_type").alias("t2"), F.col("p_brand").alias("b2"), F.col("mark").alias("m2"))
    h = w.join(b, "p_name").where("p_brand <> b2 and p_type <> t2 and mark <> m2").groupBy("p_name", F.col("p_type").alias("target")).agg(F.array_sort(F.collect_set("mark")).alias("m"))
    return h.select("p_name", "target", F.size("m").cast("long").alias("n_marks"), F.array_join(F.col("m").cast("array<string>"), ",").alias("marks"))


@catalog.add("""
with known as (select distinct o_custkey, o_orderpriority from orders where o_orderdate < timestamp '1996-01-01'), any_ as (select distinct o_custkey from orders where o_orderstatus = 'P' and o_totalprice > 450000),
r as (select o_orderkey, o_custkey, o_orderpriority from orders o where not exists (select 1 from known k where k.o_custkey = o.o_custkey and k.o_orderpriority = o.o_orderpriority) and o_custkey not in (select o_custkey from any_))
select o_orderkey, o_custkey, o_orderpriority, count(*) over (partition by o_custkey) as alternatives from r""")
def known_evidence_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without those already known, by both keys or by one; the alternatives left are counted anew."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders")
    known = o.where("o_orderdate < timestamp_ntz '1996-01-01'").select("o_custkey", "o_orderpriority").distinct()
    wild = o.where("o_orderstatus = 'P' and o_totalprice > 450000").select("o_custkey").distinct()
    rest = o.select("o_orderkey", "o_custkey", "o_orderpriority").join(known, ["o_custkey", "o_orderpriority"], "left_anti").join(wild, "o_custkey", "left_anti")
    return rest.select("o_orderkey", "o_custkey", "o_orderpriority", F.count("*").over(Window.partitionBy("o_custkey")).alias("alternatives"))


QUERIES, ORACLE_SQL = catalog.queries, catalog.oracles
