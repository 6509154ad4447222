"""Recognizers, structural models, hits and their review over the shared tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import hits, recognize, structure
from ..sources.tables import table
from .registry import Catalog

catalog = Catalog()

LINE = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"
DUCK_LINES = f"t as (select *, row_number() over (partition by l_orderkey order by {LINE}) as token from lineitem)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their place in the order."""
    w = Window.partitionBy("l_orderkey").orderBy(*LINE.split(", "))
    return table(spark, sf_dir, "lineitem").withColumn("token", F.row_number().over(w))


FLAGS = ("A", "N", "R")
GRAMMARS = {
    "clause": recognize.clause_grammar(FLAGS, "R"),
    "fragment": recognize.clause_grammar(FLAGS, "R", fragment=True),
    "mirror": [("M", (f, "M", f)) for f in FLAGS] + [("M", (f,)) for f in FLAGS] + [("M", ())],
}


@catalog.add(f"""with {DUCK_LINES}, s as (select l_orderkey, string_agg(l_returnflag, '' order by token) as s from t group by 1), g as (select *, contains(s, 'R') as clause, s = reverse(s) as mirror from s)
select l_orderkey, s as flags, clause as clause_earley, clause as clause_glr, true as fragment_earley, true as fragment_glr, mirror as mirror_earley, mirror as mirror_glr from g""")
def recognized_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which grammars derive the flags of each order, by a chart and by a graph of stacks: a clause, a fragment, a mirrored sequence."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("token", "l_returnflag"))), lambda x: x["l_returnflag"])
    s = lines(spark, sf_dir).groupBy("l_orderkey").agg(listed.alias("symbols"))
    return recognize.recognized(s, "symbols", GRAMMARS).withColumn("flags", F.array_join("symbols", "")).drop("symbols")


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a tree: a line's head is the line at half its place."""
    head = F.when(F.col("token") > 1, F.floor(F.col("token") / 2).cast("int"))
    return lines(spark, sf_dir).select("l_orderkey", "token", head.alias("head"), F.col("l_linestatus").alias("label"), F.col("l_returnflag").alias("state"))


def _duck_factors(of: str, name: str) -> str:
    return f"""{name} as (
select l_orderkey, 'root' as kind, null as c1, null as c2, state as event from {of} where head is null
union all select d.l_orderkey, 'arc', h.state, coalesce(g.state, '<ROOT>') || '|' || case when h.head is null then 'root' else h.label end || '|' || h.state, d.label || ':' || d.state
  from {of} d join {of} h on d.l_orderkey = h.l_orderkey and d.head = h.token left join {of} g on h.l_orderkey = g.l_orderkey and h.head = g.token
union all select h.l_orderkey, 'profile', h.state, null, coalesce(e, '') from {of} h left join (select l_orderkey, head, string_agg(label || ':' || state, ',' order by label || ':' || state) as e from {of} where head is not null group by 1, 2) x on x.l_orderkey = h.l_orderkey and x.head = h.token where h.state = 'R')"""


def _duck_scores(of: str, name: str) -> str:
    return f"""{name} as (select l_orderkey, count(*) as factors, sum(ln(case when t2 is null then p1 else (coalesce(n2, 0) + p1) / (t2 + 1.0) end)) as s from (
select f.*, n2.n as n2, t2.t as t2, case when t1.t is null then p0 else (coalesce(n1.n, 0) + p0) / (t1.t + 1.0) end as p1 from (
select f.*, (coalesce(n0.n, 0) + 0.1) / (t0.t + 0.1 * t0.v) as p0 from {of} f left join n0 using (kind, event) join t0 using (kind)) f
left join n1 on f.kind = n1.kind and f.c1 = n1.c1 and f.event = n1.event left join t1 on f.kind = t1.kind and f.c1 = t1.c1
left join n2 on f.kind = n2.kind and f.c2 = n2.c2 and f.event = n2.event left join t2 on f.kind = t2.kind and f.c2 = t2.c2) group by 1)"""


DUCK_TREES = f"""{DUCK_LINES}, tr as (select l_orderkey, token, case when token > 1 then token // 2 end as head, l_linestatus as label, l_returnflag as state from t)"""
DUCK_COUNTS = """n0 as (select kind, event, count(*) as n from f group by 1, 2), t0 as (select kind, sum(n) as t, count(*) + 1 as v from n0 group by 1),
n1 as (select kind, c1, event, count(*) as n from f where c1 is not null group by 1, 2, 3), t1 as (select kind, c1, sum(n) as t from n1 group by 1, 2),
n2 as (select kind, c2, event, count(*) as n from f where c2 is not null group by 1, 2, 3), t2 as (select kind, c2, sum(n) as t from n2 group by 1, 2)"""


@catalog.add(f"with {DUCK_TREES}, {_duck_factors('tr', 'f')} select kind, c1, c2, event, count(*) as n from f group by 1, 2, 3, 4")
def structural_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factors of all trees, counted: roots, arcs after their heads and the heads' heads, and what hangs on a predicate."""
    f = structure.factors(trees(spark, sf_dir), "l_orderkey", F.col("state") == "R")
    return f.groupBy("kind", "c1", "c2", "event").agg(F.count("*").alias("n"))


@catalog.add(f"""with {DUCK_TREES}, {_duck_factors('tr', 'f')}, {DUCK_COUNTS},
a as (select *, row_number() over (partition by l_orderkey order by token) as p, row_number() over (partition by l_orderkey order by md5(l_orderkey || ':' || token || ':control')) as p2 from tr),
sh as (select a.l_orderkey, a.token, a.head, a.label, b.state from a join a b on a.l_orderkey = b.l_orderkey and a.p = b.p2), {_duck_factors('sh', 'fs')}, {_duck_scores('f', 's1')}, {_duck_scores('fs', 's2')}
select l_orderkey, s1.factors, round(s1.s, 6) as log_score, round(s2.s, 6) as control_score from s1 join s2 using (l_orderkey)""")
def structural_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tree under the structural model of all, beside a negative control with its states dealt anew."""
    t = trees(spark, sf_dir)
    is_predicate = F.col("state") == "R"
    f = structure.factors(t, "l_orderkey", is_predicate)
    control = structure.factors(structure.shuffled(t, "l_orderkey", "control"), "l_orderkey", is_predicate)
    own = structure.scores(f, f, "l_orderkey").select("l_orderkey", "factors", F.round("log_score", 6).alias("log_score"))
    return own.join(structure.scores(control, f, "l_orderkey").select("l_orderkey", F.round("log_score", 6).alias("control_score")), "l_orderkey")


TAGS = ("NOUN", "VERB", "ADJ", "NUM", "PROPN", "PRON", "X")


def _duck_pos() -> str:
    agrees = " ".join(f"when '{u}' then name in ({', '.join(repr(p) for p in ps)})" for u, ps in hits.POS_COMPATIBILITY.items())
    alias = " ".join(f"when '{a}' then '{b}'" for a, b in hits.POS_ALIASES.items())
    tags = "[" + ", ".join(repr(t) for t in TAGS) + "]"
    return f"""with h as (select l_partkey, {tags}[l_linenumber % 7 + 1] as upos, case when l_linestatus = 'O' then l_returnflag end as pos from lineitem), n as (select l_partkey, upos, case pos {alias} else pos end as name from h),
a as (select *, case upos {agrees} end as agrees from n), s as (select l_partkey, upos, case when name is null or agrees is null then 'unknown' when agrees then 'compatible' else 'conflict' end as said from a)
select l_partkey, upos, count(*) as hits, case when bool_or(said = 'compatible') then 'compatible' when bool_and(said = 'conflict') then 'conflict' when bool_or(said = 'conflict') then 'mixed_or_unknown' else 'unknown' end as verdict from s group by 1, 2"""


@catalog.add(_duck_pos())
def pos_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tagger's tags against the dictionary's parts of speech, over all hits of a word."""
    upos = F.array(*map(F.lit, TAGS))[F.col("l_linenumber") % 7]
    h = table(spark, sf_dir, "lineitem").select("l_partkey", upos.alias("upos"), F.when(F.col("l_linestatus") == "O", F.col("l_returnflag")).alias("pos"))
    said = h.withColumn("said", hits.pos_assessment(F.col("upos"), F.col("pos")))
    return said.groupBy("l_partkey", "upos").agg(F.count("*").alias("hits"), hits.pos_overall(F.col("said")).alias("verdict"))


@catalog.add("select l_orderkey, l_linenumber, l_partkey from lineitem where l_returnflag = 'N' and l_linestatus = 'O'")
def selected_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units that a decision includes and that are canonical."""
    return table(spark, sf_dir, "lineitem").where("l_returnflag = 'N' and l_linestatus = 'O'").select("l_orderkey", "l_linenumber", "l_partkey")


@catalog.add(f"""with {DUCK_LINES}, k as (select *, case when l_linestatus = 'O' then l_partkey % 3 end as lexeme from t), g as (select l_orderkey, lexeme, min(token) as f, string_agg(token, ',' order by token) as places from k group by 1, 2, case when lexeme is null then token end)
select l_orderkey, lexeme, places, row_number() over (partition by l_orderkey order by f) as group_no from g""")
def grouped_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of one lexeme shown together, artificial ones each alone."""
    k = lines(spark, sf_dir).select("l_orderkey", "token", F.when(F.col("l_linestatus") == "O", F.col("l_partkey") % 3).alias("lexeme"))
    return hits.group_hits(k, "l_orderkey", "token", "lexeme").select("l_orderkey", "lexeme", F.array_join("places", ",").alias("places"), "group_no")


@catalog.add("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, case l_returnflag when 'A' then 'artificial' when 'N' then 'lexical' else 'compound' end as kind, case when l_returnflag <> 'A' then l_partkey end as lexeme_id,
case when l_returnflag = 'A' then l_quantity end as value, case when l_returnflag = 'N' then l_linestatus = 'O' end as quantity_match, case when l_returnflag = 'R' then l_suppkey end as auxiliary from lineitem""")
def flat_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of three kinds in one layout: what a kind does not have is null."""
    flag = F.col("l_returnflag")
    only = lambda f, c: F.when(flag == f, c)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(flag == "A", "artificial").when(flag == "N", "lexical").otherwise("compound").alias("kind"), F.when(flag != "A", F.col("l_partkey")).alias("lexeme_id"),
        only("A", F.col("l_quantity")).alias("value"), only("N", F.col("l_linestatus") == "O").alias("quantity_match"), only("R", F.col("l_suppkey")).alias("auxiliary"),
    )


FLAGGED = {"N": "derived_quantity_disagreement", "R": "independent_quantity_conflict"}


@catalog.add("""with w as (select l_partkey, l_suppkey % 5 as family, l_orderkey as entry, l_linestatus = 'O' as i, l_discount = 0 as r, l_tax = 0 as p, case when l_quantity < 2 then case l_returnflag when 'N' then 'derived_quantity_disagreement' when 'R' then 'independent_quantity_conflict' end end as f from lineitem),
m as (select l_partkey, family, count(distinct entry) as n, bool_or(i) as i, bool_or(r) as r, bool_or(p) as p from w group by 1, 2),
g as (select l_partkey, string_agg(family || ':' || n || ':' || case when i then 'independent' else 'derived' end, ',' order by family) as families from m group by 1),
x as (select l_partkey, 'reference_only_witness' as f from m where r union select l_partkey, 'inferred_part_of_speech_witness' from m where p union select l_partkey, 'multiple_entries_in_independent_family' from m where i and n > 1 union select l_partkey, f from w where f is not null),
y as (select l_partkey, string_agg(f, ',' order by f) as flags, bool_or(f in ('independent_quantity_conflict', 'multiple_entries_in_independent_family')) as high from x group by 1)
select l_partkey, families, coalesce(flags, '') as flags, case when high then 'high' when flags is not null then 'medium' else 'normal' end as priority from g left join y using (l_partkey)""")
def family_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries a family of witnesses, the flags they raise, and how urgent a review is."""
    w = table(spark, sf_dir, "lineitem").selectExpr("l_partkey", "l_suppkey % 5 as family", "l_orderkey as entry", "l_linestatus = 'O' as independent", "l_discount = 0 as reference_only", "l_tax = 0 as inferred", "l_quantity", "l_returnflag")
    given = F.array_compact(F.array(*[F.when((F.col("l_quantity") < 2) & (F.col("l_returnflag") == k), F.lit(v)) for k, v in FLAGGED.items()]))
    return hits.triage(w, "l_partkey", given)


@catalog.add("""with l as (select doc_id, lang is null as fallback, unnest(string_split(text, chr(10))) as line from documents where text is not null)
select doc_id, case when regexp_matches(line, '^(?i:cf|see|v|vide|voir|veja|vgl)(?:$|[^\\p{L}\\p{N}_])') then 'crossref_only' when fallback then 'entry_fallback' else 'sense' end as quality, count(*) as n from l group by 1, 2""".replace("\\\\", "\\"))
def sense_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that only point elsewhere, told from senses."""
    l = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.col("lang").isNull().alias("fallback"), F.explode(F.split("text", "\n")).alias("line"))  # noqa: E741
    return l.groupBy("doc_id", hits.sense_kind(F.col("line"), F.col("fallback")).alias("quality")).agg(F.count("*").alias("n"))


MARKED_TEXT = ("aeioO", "āĕīŏŌ")


def _duck_headword() -> str:
    spelt = "lower(word)"
    for one, two in hits.COMPOSED:
        spelt = f"replace({spelt}, '{one}', '{two}')"
    both = hits.MACRON + hits.BREVE
    return rf"""with b as (select item_id, translate(unnest(string_split(text, chr(10))), '{MARKED_TEXT[0]}', '{MARKED_TEXT[1]}') as whole from benchmark where text is not null),
l as (select item_id, k, case k when 1 then regexp_extract(whole, '^[^,. ]*') when 2 then '3 ' || regexp_extract(whole, '^[^ ]*') || ', x' when 3 then whole else regexp_extract(whole, '^[^ ]*') || '^na' end as lemma from b, unnest([1, 2, 3, 4]) as u(k)),
w as (select *, regexp_extract(lemma, '\p{{L}}[\p{{L}}\p{{Mn}}]*') as word, regexp_matches(lemma, '^\P{{L}}*\p{{L}}[\p{{L}}\p{{Mn}}]*(?:[\^_-]|[ \t\n\r\f]+)\p{{L}}') as open_ from l), s as (select *, {spelt} as spelt from w),
g as (select *, not open_ and regexp_matches(spelt, '^(?:[a-z][{both}]?)+$') and regexp_matches(spelt, '[{both}]') as good from s)
select item_id, k, lemma, case when good then regexp_replace(spelt, '[{both}]', '', 'g') end as letters, case when good then regexp_replace(regexp_replace(regexp_replace(spelt, '[a-z]{hits.MACRON}', 'L', 'g'), '[a-z]{hits.BREVE}', 'S', 'g'), '[a-z]', '.', 'g') end as marks,
case when good then substr(word, 1, 1) <> lower(substr(word, 1, 1)) end as capital from g"""


@catalog.add(_duck_headword())
def marked_headwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first word of a lemma with the length of its vowels, as dictionaries print it: alone, after a number, in a phrase, cut by a mark."""
    b = table(spark, sf_dir, "benchmark").where("text is not null").select("item_id", F.explode(F.split(F.translate("text", *MARKED_TEXT), "\n")).alias("whole"))
    first = F.regexp_extract("whole", "^[^ ]*", 0)
    lemmas = [F.regexp_extract("whole", "^[^,. ]*", 0), F.concat(F.lit("3 "), first, F.lit(", x")), F.col("whole"), F.concat(first, F.lit("^na"))]
    l = b.select("item_id", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), x.alias("lemma")) for k, x in enumerate(lemmas, 1)])).alias("x")).select("item_id", "x.k", "x.lemma")  # noqa: E741
    return l.select("*", *[c.alias(n) for n, c in hits.marked_headword(F.col("lemma")).items()])


RUN = r"[^\x20\x09-\x0D]+"


@catalog.add(f"""with w as (select unnest(regexp_extract_all(text, '{RUN}')) as word from documents), c as (select word, count(*) as n from w group by 1)
select word, n from c where length(word) > 1 and word not in ({', '.join(repr(x) for x in hits.WEEDED)}) and not ends_with(word, '.') and not ends_with(word, ':')""")
def weeded_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words an index of glosses keeps, with their counts; counted first, weeded once each."""
    w = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("n")).where(~hits.is_weeded(F.col("word")))


def _one_of(values: list, place: Column) -> Column:
    return F.array(*[F.lit(v) for v in values])[place.cast("int")]


LEXICAL, RULES = [*hits.LEXICAL_WEIGHTS, None, "other"], [*hits.RULE_WEIGHTS, None]


def _duck_candidates() -> str:
    listed = lambda x: "[" + ", ".join("null" if v is None else repr(v) for v in x) + "]"
    case = lambda c, x: f"case {c} " + " ".join(f"when '{k}' then {v}" for k, v in x.items()) + " else 0.0 end"
    return f"""with c as (select p_partkey, {listed(LEXICAL)}[p_size % {len(LEXICAL)} + 1] as lexical, {listed(RULES)}[p_partkey % {len(RULES)} + 1] as rule, p_partkey % 3 > 0 as has_rule, p_partkey % 2 = 0 as finite from part),
s as (select p_partkey, case when lexical is not null then {case('lexical', hits.LEXICAL_WEIGHTS)} end as a, case when rule is not null then {case('rule', hits.RULE_WEIGHTS)} when not has_rule then {hits.NO_RULE} end as b, case when finite then {hits.FINITE} end as c from c)
select p_partkey, cast(coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) as double) as score, concat_ws(',', case when a is not null then 'S001' end, case when b is not null then 'S002' end, case when c is not null then 'S012' end) as reasons from s"""


@catalog.add(_duck_candidates())
def candidate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by how frequent their lexeme and rule are, and whether a clause can hang on them; with the reasons."""
    key = F.col("p_partkey")
    c = table(spark, sf_dir, "part").select("p_partkey", _one_of(LEXICAL, F.col("p_size") % len(LEXICAL)).alias("lexical"), _one_of(RULES, key % len(RULES)).alias("rule"), (key % 3 > 0).alias("has_rule"), (key % 2 == 0).alias("finite"))
    score, reasons = hits.candidate_score(*map(F.col, ("lexical", "rule", "has_rule", "finite")))
    return c.select("p_partkey", score.alias("score"), reasons.alias("reasons"))


@catalog.add("select l_returnflag as kind, count(*) as edges, count(*) filter (where l_linestatus = 'O') as supported, count(*) filter (where l_linestatus = 'F') as conflicting from lineitem group by 1")
def edge_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by kind, and how many of them agree."""
    of = lambda s: F.count_if(F.col("l_linestatus") == s)
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("kind")).agg(F.count("*").alias("edges"), of("O").alias("supported"), of("F").alias("conflicting"))


@catalog.add("""with e as (select event_type, case when user_id % 2 = 0 then 'before' else 'after' end as side, value from events where value is not null), r as (select *, row_number() over (partition by event_type, side order by value) - 1 as k, count(*) over (partition by event_type, side) as n from e),
s as (select event_type, side, max(n) as n, min(value) as least, max(case when k = floor((n - 1) * 0.5) then value end) as median, max(case when k = floor((n - 1) * 0.95) then value end) as p95, max(value) as most, avg(value) as mean from r group by 1, 2)
select a.event_type, b.n as n_before, a.n as n_after, b.least as least_before, a.most as most_after, b.median as median_before, a.median as median_after, b.p95 as p95_before, a.p95 as p95_after, round((a.mean - b.mean) / b.mean * 100, 6) as mean_change from s a join s b on a.event_type = b.event_type and a.side = 'after' and b.side = 'before'""")
def sample_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples before and after, summed up, and the change in per cent."""
    e = table(spark, sf_dir, "events").select("event_type", F.when(F.col("user_id") % 2 == 0, "before").otherwise("after").alias("side"), "value")
    s = hits.sample_summary(e, ["event_type", "side"], "value")
    side = lambda x: s.where(F.col("side") == x).select("event_type", *[F.col(c).alias(f"{c}_{x}") for c in ("count", "least", "median", "p95", "most", "mean")])
    change = F.round((F.col("mean_after") - F.col("mean_before")) / F.col("mean_before") * 100, 6).alias("mean_change")
    return side("after").join(side("before"), "event_type").select(
        "event_type", F.col("count_before").alias("n_before"), F.col("count_after").alias("n_after"), "least_before", "most_after", "median_before", "median_after", "p95_before", "p95_after", change
    )


@catalog.add("""with p as (select distinct l_suppkey as s, l_partkey as p from lineitem), n as (select s, count(*) as n from p group by 1), b as (select a.s, count(*) as shared from p a join p c on a.p = c.p and c.s = a.s + 1 group by 1)
select a.s as left_id, c.s as right_id, coalesce(shared, 0) as shared, a.n - coalesce(shared, 0) as only_left, c.n - coalesce(shared, 0) as only_right from n a join n c on c.s = a.s + 1 left join b on a.s = b.s""")
def shared_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two neighbours share and what only one of them has, by joins of distinct members in place of arrays."""
    p = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).distinct()
    n = p.groupBy("s").agg(F.count("*").alias("n"))
    both = p.join(p.select((F.col("s") - 1).alias("s"), "p"), ["s", "p"]).groupBy("s").agg(F.count("*").alias("shared"))
    pairs = n.join(n.select((F.col("s") - 1).alias("s"), F.col("n").alias("n2")), "s").join(both, "s", "left")
    shared = F.coalesce("shared", F.lit(0))
    return pairs.select(F.col("s").alias("left_id"), (F.col("s") + 1).alias("right_id"), shared.alias("shared"), (F.col("n") - shared).alias("only_left"), (F.col("n2") - shared).alias("only_right"))


@catalog.add("""with r as (select l_suppkey, l_returnflag, l_partkey, l_orderkey, round(l_discount * 100 - l_tax * 50, 6) as score, row_number() over (partition by l_suppkey order by round(l_discount * 100 - l_tax * 50, 6) desc, l_returnflag, l_partkey, l_orderkey) as rn from lineitem)
select l_suppkey, max(score) as best_score, string_agg(l_returnflag || ':' || l_partkey || ':' || l_orderkey, ',' order by rn) filter (where rn <= 5) as best from r group by 1""")
def best_section_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best matches of each entry, by score and then by their references; the rest is never gathered."""
    score = F.round(F.col("l_discount") * 100 - F.col("l_tax") * 50, 6)
    r = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_partkey", "l_orderkey", score.alias("score"))
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("score"), "l_returnflag", "l_partkey", "l_orderkey")
    top = r.withColumn("rn", F.row_number().over(w)).where("rn <= 5")
    text = F.concat_ws(":", "l_returnflag", "l_partkey", "l_orderkey")
    best = F.transform(F.array_sort(F.collect_list(F.struct("rn", text.alias("t")))), lambda x: x["t"])
    return top.groupBy("l_suppkey").agg(F.max("score").alias("best_score"), F.array_join(best, ",").alias("best"))


QUERIES, ORACLE_SQL = catalog.queries, catalog.oracles
