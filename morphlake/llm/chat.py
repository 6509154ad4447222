"""Quotation linking and reply order of conversations (operator 1)."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches, table

MARKS = re.compile(r"[ \t]*((?:>[ \t]?)+)(.*)\Z", re.S)
#: The line that says who is quoted; it stands before a quotation and belongs to it.
ATTRIBUTION = re.compile(r"(?:on|am|le|el)\b.{0,200}\b(?:wrote|schrieb|a écrit|escribió)\b.{0,80}:\s*\Z", re.I)


def normalise(text: str) -> str:
    """Lower case, white space as one space, none at the ends."""
    return " ".join(text.lower().split())


def digest(text: str) -> str:
    return hashlib.md5(text.encode("utf-8", "replace"), usedforsecurity=False).hexdigest()


def parse_quotes(text: str) -> tuple[str, list[tuple[int, str]]]:
    """A message's own text, and its quoted passages as (level, text) in their order.

    A line's level is the number of `>` it begins with; a passage is the longest run of lines of one
    level above zero. Lines that say who wrote what follows are dropped with the quotation. Own lines keep their
    order; blank lines at the ends go, and several in a row become one.
    """
    own: list[str] = []
    quotes: list[tuple[int, list[str]]] = []
    level = 0
    for line in text.split("\n"):
        line = line.rstrip("\r")
        m = MARKS.match(line)
        if m:
            depth = m[1].count(">")
            if depth == level:
                quotes[-1][1].append(m[2])
            else:
                if level == 0 and own:
                    k = next((k for k in range(len(own) - 1, -1, -1) if own[k].strip()), None)
                    if k is not None and ATTRIBUTION.match(own[k].strip()):
                        del own[k:]
                quotes.append((depth, [m[2]]))
            level = depth
        else:
            level = 0
            if line.strip() or own and own[-1].strip():
                own.append(line)
    while own and not own[-1].strip():
        own.pop()
    return "\n".join(own), [(d, "\n".join(x).strip("\n")) for d, x in quotes if normalise("".join(x))]


def segments(text: str) -> list[str]:
    """What a text can be quoted by, normalised: whole, each paragraph, each line; distinct, in this order."""
    found = [text, *re.split(r"\n\s*\n", text), *text.split("\n")]
    return [x for x in dict.fromkeys(map(normalise, found)) if x]


def link_quotations(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, body (no quotations), formatted, n_quotes, max_level,
    n_linked, quoted_turn, quoted_conv, parent_turn, position.

    A quoted passage is hashed normalised, whole and by paragraph and line. Its original is the first
    message of the conversation before the quoting one with own text of an equal hash, for the
    earliest of these that has one; else the first message of another conversation (quoted_conv). quoted_turn is that of
    the message's first linked passage of the lowest level. The parent is the quoted message of the same conversation,
    else the message before. position counts a conversation's messages in reply order: a message whose
    parent is not the one before opens a branch; a branch stands after all that follows its parent without branching, branches
    of later parents first, of one parent by turn.

    Null texts and roles are empty, very long texts are parsed whole; rows with a null conv_id are one conversation; a null turn
    stands first. Rows of one turn stand in the order of their text, and are quoted as the first of them. Repeated rows are messages of their own. An
    empty table gives an empty one. Other columns are ignored. Hot keys: originals are one row per hash and
    conversation before any join, and messages are never paired with each other.
    """
    small_batches(messages.sparkSession, 1000)
    kinds = {c: messages.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}

    def parse(batches):
        for b in batches:
            bodies, levels, quotes, own = [], [], [], []
            for t in b.column(4).to_pylist():
                body, found = parse_quotes(t or "")
                bodies.append(body)
                levels.append(max((d for d, _ in found), default=0))
                quotes.append([[digest(x) for x in segments(q)] for _, q in sorted(found, key=lambda f: f[0])])
                own.append([digest(x) for x in segments(body)])
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(bodies, pa.string()), pa.array(levels, pa.int32()), pa.array(quotes, pa.list_(pa.list_(pa.string()))), pa.array(own, pa.list_(pa.string()))], names=["conv_id", "turn", "role", "o", "body", "max_level", "quotes", "own"])

    text = F.coalesce("text", F.lit(""))
    read = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.xxhash64("role", "text").alias("o"), text.alias("text"))
    parsed = read.mapInArrow(parse, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, o long, body string, max_level int, quotes array<array<string>>, own array<string>")
    parsed = parsed.withColumns({
        "c": F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("~")), "t": F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 62))), "id": F.monotonically_increasing_id(),
    })
    m = materialize(parsed, "messages")

    first = m.select("c", "t", F.explode("own").alias("key")).groupBy("key", "c").agg(F.min("t").alias("t0"))
    asked = m.where("size(quotes) > 0").select("id", "c", "t", F.posexplode("quotes").alias("q", "keys")).select("id", "c", "t", "q", F.posexplode("keys").alias("k", "key"))
    here = asked.join(first, ["key", "c"], "left").withColumn("t0", F.when(F.col("t0") < F.col("t"), F.col("t0")))
    anywhere = first.groupBy("key").agg(F.min(F.struct("c", "t0")).alias("w"), F.max(F.struct("c", "t0")).alias("w2"))
    # another conversation than one's own: the first, or if that is one's own, any other
    wide = here.join(anywhere, "key", "left").withColumn("other", F.when(F.col("w.c") != F.col("c"), F.col("w")).when(F.col("w2.c") != F.col("c"), F.col("w2")))
    best = wide.groupBy("id", "q").agg(
        F.min(F.when(F.col("t0").isNotNull(), F.struct("k", "t0"))).alias("same"), F.min(F.when(F.col("other").isNotNull(), F.struct("k", "other"))).alias("far")
    )
    linked = best.groupBy("id").agg(
        F.count(F.coalesce(F.col("same.t0"), F.col("far.other.t0"))).alias("n_linked"),
        F.min(F.when(F.col("same").isNotNull(), F.struct("q", "same.t0"))).alias("s"), F.min(F.when(F.col("far").isNotNull(), F.struct("q", "far.other"))).alias("f"),
    ).select("id", "n_linked", F.col("s.t0").alias("same_t"), F.when(F.col("s").isNull(), F.col("f.other")).alias("far"))

    w = Window.partitionBy("c").orderBy("t", "o", "id")
    slim = m.select("id", "c", "t", "o").withColumns({"before": F.lag("t").over(w), "n": F.row_number().over(w)})
    slim = slim.join(linked, "id", "left").withColumn("parent", F.coalesce("same_t", "before"))
    opens = (F.col("n") == 1) | (F.col("same_t").isNotNull() & (F.col("same_t") != F.col("before")))
    slim = materialize(slim.withColumns({"branch": F.max(F.when(opens, F.col("n"))).over(w), "opens": opens}), "slim")
    path = _paths(slim)
    ordered = slim.join(path, ["c", "branch"], "left")
    root = F.expr("array(named_struct('back', -9223372036854775807L, 'start', 1L))")
    spot = F.row_number().over(Window.partitionBy("c").orderBy(F.coalesce("path", root), "n"))
    ordered = ordered.select("id", "n_linked", "same_t", "far", "parent", spot.alias("position"))
    low = F.lit(-(1 << 62))
    turn = lambda x: F.when(x != low, x).cast(kinds["turn"])
    return m.join(ordered, "id").select(
        "conv_id", "turn", "role", "body", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "body", F.lit("\n<|end|>\n")).alias("formatted"),
        F.size("quotes").alias("n_quotes"), "max_level", F.coalesce("n_linked", F.lit(0)).cast("int").alias("n_linked"),
        turn(F.coalesce("same_t", F.col("far.t0"))).alias("quoted_turn"), F.when(F.col("far").isNotNull() & (F.col("far.c") != "~"), F.expr("substr(far.c, 2)")).cast(kinds["conv_id"]).alias("quoted_conv"),
        turn(F.col("parent")).alias("parent_turn"), F.col("position").cast("long").alias("position"),
    )


def _paths(slim: DataFrame) -> DataFrame:
    """(c, branch) to the path of branches from the conversation's first message, by pointer doubling:
    as many rounds as the logarithm of how deep branches nest. First branches have no row."""
    spots = slim.groupBy("c", "t").agg(F.min(F.struct("n", "branch")).alias("p"))
    heads = slim.where("opens and n > 1").select("c", F.col("n").cast("long").alias("branch"), F.col("same_t").alias("t"))
    step = F.array(F.struct((-F.col("p.n")).cast("long").alias("back"), F.col("branch").alias("start")))
    path = heads.join(spots, ["c", "t"]).select("c", "branch", F.col("p.branch").cast("long").alias("up"), step.alias("path"))
    path = materialize(path, "paths")
    while path.where("up > 1").limit(1).count():
        above = path.select("c", F.col("branch").alias("up"), F.col("up").alias("up2"), F.col("path").alias("path2"))
        longer = path.join(above, ["c", "up"], "left")
        path = materialize(longer.select("c", "branch", F.coalesce("up2", F.lit(1)).cast("long").alias("up"), F.concat(F.coalesce("path2", F.expr("cast(array() as array<struct<back:bigint,start:bigint>>)")), "path").alias("path")), "paths")
    return path.select("c", F.col("branch").cast("int").alias("branch"), "path")


def op1_chat_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotations(table(spark, sf_dir, "conversations"))
