"""Readers of rule tables and corpora kept as text: each with an explicit schema, loud on bad records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Part-of-speech words of the files and the short ones of the tables.
PARTS = {"N": "N", "ADJ": "ADJ", "ADV": "ADV", "V": "V", "VPAR": "VPAR", "SUPINE": "SUPINE", "PRON": "PRON", "PACK": "PACK", "NUM": "NUM", "PREP": "PREP", "CONJ": "CONJ", "INTERJ": "INTERJ", "X": "X"}
#: Fields after the part of speech of an inflection line.
INFLECTION_FIELDS = {
    "N": "decl var case number gender", "ADJ": "decl var case number gender degree", "PRON": "decl var case number gender", "NUM": "decl var case number gender numeral_type",
    "ADV": "degree", "V": "decl var tense voice mood person number", "VPAR": "decl var case number gender tense voice mood", "SUPINE": "decl var case number gender", "PREP": "case", "CONJ": "", "INTERJ": "",
}


def fold(text: Column) -> Column:
    return F.translate(F.lower(text), "jv", "iu")


def numbered_lines(spark: SparkSession, path: str, comment: str = "--") -> DataFrame:
    """line_no (in file order) and text of the lines that are not blank and no comment. A rule file is
    read whole, as one record: its lines keep their order, and it is small."""
    whole = spark.read.option("wholetext", True).text(path)
    lines = whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "text"))
    lines = lines.withColumn("text", F.trim(F.regexp_replace("text", rf"\s*{comment}.*$", "")))
    kept = lines.where("text <> ''")
    return kept.withColumn("line_no", F.row_number().over(Window.orderBy("line_no")) - 1)


def records(spark: SparkSession, path: str, size: int) -> DataFrame:
    """Groups of `size` lines: record, l0, l1, ..."""
    lines = numbered_lines(spark, path).withColumns({"record": F.floor(F.col("line_no") / size), "part": F.col("line_no") % size})
    out = lines.groupBy("record").agg(*[F.max(F.when(F.col("part") == k, F.col("text"))).alias(f"l{k}") for k in range(size)])
    return out.withColumn("record", F.when(F.col(f"l{size - 1}").isNull(), F.raise_error(F.lit(f"{path}: an incomplete record at the end"))).otherwise(F.col("record")))


def field(column: str, k: int) -> Column:
    return F.get(F.split(column, r"\s+"), F.lit(k))


def number(column: Column) -> Column:
    return F.coalesce(column.try_cast("int"), F.lit(0))


def read_addons(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(prefixes, suffixes, tackons) of records of three lines: kind, fix and connector; root and target;
    gloss. Ids count through the file. A prefix from PACK to PACK is a tickon; a PACKON line a packon."""
    r = records(spark, path, 3).withColumns({"kind": field("l0", 0), "fix": fold(field("l0", 1)), "connector": F.coalesce(fold(field("l0", 2)), F.lit("")), "addon_id": F.col("record").cast("int")})
    bad = ~F.col("kind").isin("PREFIX", "SUFFIX", "TACKON", "PACKON")
    r = r.withColumn("kind", F.when(bad, F.raise_error(F.concat(F.lit("unknown addon: "), "l0"))).otherwise(F.col("kind")))
    prefixes = r.where("kind = 'PREFIX'").select("addon_id", "fix", "connector", field("l1", 0).alias("root_pos"), (field("l1", 0) == "PACK").alias("tickon"), F.col("l2").alias("addon_meaning"))
    target = field("l1", 2)
    paradigm = target.isin("N", "ADJ", "V", "PRON", "NUM")
    parts = F.split("l1", r"\s+")
    key = number(F.element_at(parts, -1))
    suffixes = r.where("kind = 'SUFFIX'").select(
        "addon_id", "fix", "connector", field("l1", 0).alias("root_pos"), number(field("l1", 1)).alias("root_key"), F.lit(0).alias("root_decl"), F.lit(0).alias("root_var"), target.alias("target_pos"),
        F.when(paradigm, number(field("l1", 3))).otherwise(0).alias("target_decl"), F.when(paradigm, number(field("l1", 4))).otherwise(0).alias("target_var"),
        F.when(target == "N", F.coalesce(field("l1", 5), F.lit("X"))).otherwise("X").alias("target_gender"), F.when(target == "ADJ", F.coalesce(field("l1", 5), F.lit("X"))).when(target == "ADV", F.coalesce(field("l1", 3), F.lit("X"))).otherwise("X").alias("target_degree"),
        key.alias("target_key"), F.lit(False).alias("coexists"), F.col("l2").alias("addon_meaning"),
    )
    tackons = r.where("kind in ('TACKON', 'PACKON')").select(
        "addon_id", "fix", F.coalesce(field("l1", 0), F.lit("X")).alias("base_pos"), number(field("l1", 1)).alias("base_decl"), number(field("l1", 2)).alias("base_var"),
        ((F.col("kind") == "TACKON") & (field("l1", 0) == "X")).alias("enclitic"), (F.col("kind") == "PACKON").alias("packon"), F.col("l2").alias("addon_meaning"),
    )
    return prefixes, suffixes, tackons


def read_uniques(spark: SparkSession, path: str) -> DataFrame:
    """Records of three lines: surface; morphology and flags; gloss."""
    r = records(spark, path, 3)
    f = lambda k: field("l1", k)
    verb, noun = f(0) == "V", f(0).isin("N", "PRON", "ADJ")
    return r.select(
        fold(F.col("l0")).alias("surface"), F.col("record").cast("int").alias("unique_id"), f(0).alias("kind"), number(f(1)).alias("declension"), number(f(2)).alias("variant"),
        F.when(noun, f(3)).alias("case"), F.when(verb, f(7)).when(noun, f(4)).alias("number"), F.when(noun, f(5)).alias("gender"), F.when(f(0) == "ADJ", f(6)).alias("degree"),
        F.when(verb, f(3)).alias("tense"), F.when(verb, f(4)).alias("voice"), F.when(verb, f(5)).alias("mood"), F.when(verb, number(f(6))).alias("person"), F.col("l2").alias("meaning"),
    )


def read_rewrites(spark: SparkSession, path: str) -> DataFrame:
    """A line of fifteen fields and a gloss line each; `-` is an empty text."""
    r = records(spark, path, 2)
    f = lambda k: field("l0", k)
    text = lambda k: F.when(f(k).isin("-", "_"), "").otherwise(F.lower(f(k)))
    ok = F.size(F.split("l0", r"\s+")) == 15
    checked = r.withColumn("l0", F.when(ok, F.col("l0")).otherwise(F.raise_error(F.concat(F.lit("not fifteen fields: "), "l0"))))
    return checked.select(
        F.col("record").cast("int").alias("rewrite_id"), f(0).alias("kind"), number(f(1)).alias("priority"), f(2).alias("stage"), f(3).alias("operation"), f(4).alias("scope"), (f(5) == "REVERSE").alias("reverse"),
        text(6).alias("before"), text(7).alias("after"), f(8).alias("required_pos"), number(f(9)).alias("required_key"), number(f(10)).alias("min_before"), number(f(11)).alias("min_after"), f(12).alias("constraint"), (f(13) == "MEDIEVAL").alias("medieval"), f(14).alias("name"),
    )


def read_quantities(spark: SparkSession, path: str) -> DataFrame:
    """Tagged lines: INFLECTION id known long; STEM entry slot known long (counted from one); SUFFIX id known long."""
    lines = numbered_lines(spark, path)
    f = lambda k: field("text", k)
    stem = f(0) == "STEM"
    shift = F.when(stem, 1).otherwise(0)
    last = lambda k: F.when(stem, f(k + 1)).otherwise(f(k)).cast("long")
    return lines.select(f(0).alias("subject"), (f(1).cast("int") - shift).alias("subject_id"), F.when(stem, f(2).cast("int")).otherwise(0).alias("slot"), last(2).alias("known"), last(3).alias("long"))


def read_inflections(spark: SparkSession, path: str) -> DataFrame:
    """Lines `part decl var features key size ending age frequency`: the features differ by part."""
    lines = numbered_lines(spark, path).withColumn("p", F.split("text", r"\s+"))
    part = F.get("p", F.lit(0))

    def pick(name: str, default: str) -> Column:
        out = F.lit(default)
        for pos, names in INFLECTION_FIELDS.items():
            if name in names.split():
                out = F.when(part == pos, F.get("p", F.lit(1 + names.split().index(name)))).otherwise(out)
        return out

    head = F.coalesce(*[F.when(part == pos, F.lit(len(names.split()) + 1)) for pos, names in INFLECTION_FIELDS.items()])
    size = number(F.get("p", head + 1))
    ending = F.when(size > 0, fold(F.get("p", head + 2))).otherwise("")
    after = head + F.when(size > 0, 3).otherwise(2)
    return lines.where(part.isin(list(INFLECTION_FIELDS))).select(
        F.col("line_no").cast("int").alias("rule_id"), part.alias("rule_pos"), number(pick("decl", "0")).alias("rule_decl"), number(pick("var", "0")).alias("rule_var"), pick("case", "X").alias("case"), pick("number", "X").alias("number"),
        pick("gender", "X").alias("rule_gender"), pick("degree", "X").alias("rule_degree"), pick("tense", "X").alias("tense"), pick("voice", "X").alias("voice"), pick("mood", "X").alias("mood"), number(pick("person", "0")).alias("person"),
        number(F.get("p", head)).alias("rule_key"), ending.alias("ending"), F.coalesce(F.get("p", after), F.lit("X")).alias("rule_age"), F.coalesce(F.get("p", after + 1), F.lit("A")).alias("rule_freq"),
    )


def read_notices(spark: SparkSession, path: str) -> DataFrame:
    """Lines `entry TRIGGER NOTICE`, entries counted from one."""
    return numbered_lines(spark, path).select((field("text", 0).cast("int") - 1).alias("lexeme_id"), F.lower(field("text", 1)).alias("trigger"), F.lower(field("text", 2)).alias("notice"))


def read_packon_requirements(spark: SparkSession, path: str) -> DataFrame:
    """Lines `entry fix`, entries counted from one."""
    return numbered_lines(spark, path).select((field("text", 0).cast("int") - 1).alias("lexeme_id"), fold(field("text", 1)).alias("fix"))


def read_fixed_width(spark: SparkSession, path: str, width: int, fields: dict[str, tuple[int, int]]) -> DataFrame:
    """Binary records of `width` bytes: record number and the trimmed Latin-1 text of each field (start, size)."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            rows = []
            for data in b.column(0).to_pylist():
                if len(data) % width:
                    raise ValueError(f"{path}: {len(data)} bytes are no multiple of {width}")
                for k in range(len(data) // width):
                    one = data[k * width : (k + 1) * width]
                    rows.append((k, *(one[a : a + n].decode("latin-1").strip(" \0") for a, n in fields.values())))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * (1 + len(fields))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.string()) for c in cols[1:])], names=["record", *fields])

    data = spark.read.format("binaryFile").load(path).select("content")
    return data.mapInArrow(run, "record long, " + ", ".join(f"`{f}` string" for f in fields))


def read_tagged_json(spark: SparkSession, path: str, schema: str, tag: str) -> DataFrame:
    """JSON lines (gzip too) under a schema that has `schema`; another tag or a broken line fails."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    wrong = F.raise_error(F.concat(F.lit("another schema: "), F.coalesce(F.col("schema"), F.lit("none"))))
    return rows.withColumn("schema", F.when(F.col("schema") == tag, F.col("schema")).otherwise(wrong))


def read_table(spark: SparkSession, path: str, schema: str, key: list[str]) -> DataFrame:
    """Tab-separated values (gzip too) with a header that must be the schema's; a repeated key fails."""
    rows = spark.read.schema(schema).options(sep="\t", header=True, enforceSchema=False, mode="FAILFAST").csv(path)
    twice = rows.groupBy(*key).count().where("count > 1").limit(1).count()
    if twice:
        raise ValueError(f"{path}: a key is there twice")
    return rows


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_id and text of the non-empty lines of files, `\\r` stripped."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_id"), F.regexp_replace("value", r"\r$", "").alias("text"))
    return lines.where("text <> ''")
