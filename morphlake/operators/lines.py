"""Lines of text to readings: tokens, compounds of two tokens, projections."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.surface import BLOCKING, lex, tokenize
from .analyze import MORPHOLOGY, Options
from .recover import QUESTION, Analyzer
from .rulebook import RuleBook

TOKENS = "line_id long, pos int, text string, byte_begin int, byte_end int, boundary int, status string, normalized string, orthography string, lookup string, known long, long long, titled boolean"
#: Spellings that a task remembers at once.
REMEMBERED = 200_000


def tokens(lines: DataFrame) -> DataFrame:
    """line_id and text to one row a token with its surface; offsets are in bytes, pos counts from 0.
    A null line has no tokens."""

    def run(batches):
        for b in batches:
            rows = []
            for line, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for k, t in enumerate(tokenize((text or "").rstrip("\r\n"))):
                    s = lex(t.text)
                    titled = t.text[:1].isupper() and t.text[1:2].islower()
                    rows.append((line, k, t.text, t.begin, t.end, t.boundary, s.status, s.normalized, s.orthography, s.lookup, s.known, s.long, titled))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)

    i32, i64, s = pa.int32(), pa.int64(), pa.string()
    kinds = [i64, i32, s, i32, i32, i32, s, s, s, s, i64, i64, pa.bool_()]
    schema = pa.schema([pa.field(c.split()[0], t) for c, t in zip(TOKENS.split(", "), kinds, strict=True)])
    return lines.select(F.col("line_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, TOKENS)


def forms(lines: DataFrame) -> DataFrame:
    """Distinct (form, known, long) of the tokens of all lines that can be looked up; each task works out a
    spelling once, and hands on each form once."""

    def run(batches):
        seen, given = set(), set()
        for b in batches:
            rows = []
            for text in b.column(0).to_pylist():
                for t in tokenize((text or "").rstrip("\r\n")):
                    if t.text in seen:
                        continue
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                        given.clear()
                    seen.add(t.text)
                    s = lex(t.text)
                    if s.status == "ok" and (row := (s.lookup, s.known, s.long)) not in given:
                        given.add(row)
                        rows.append(row)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["form", "known", "long"])

    return lines.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "form string, known long, long long").distinct()


def analyze_lines(lines: DataFrame, book: RuleBook, options: Options = Options()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """(tokens, readings): readings are of the distinct words, to be joined on QUESTION."""
    found = tokens(lines)
    words = found.where("status = 'ok'").select(*QUESTION).distinct()
    return found, Analyzer(book, options).analyze(words)


def compounds(found: DataFrame, readings: DataFrame, book: RuleBook) -> DataFrame:
    """Participle or supine and auxiliary in neighbouring tokens, as one verb; greedy from the left.

    Each token is paired with the next by its place; separators that end a clause block. A pair takes
    both tokens, so that of a run of pairs that overlap every other one stays.
    """
    w = Window.partitionBy("line_id").orderBy("pos")
    nxt = [F.lead(c).over(w).alias(f"next_{c}") for c in QUESTION]
    pairs = found.select("line_id", "pos", "boundary", "status", *QUESTION, *nxt).where((F.col("status") == "ok") & F.col("next_lookup").isNotNull() & (F.col("boundary").bitwiseAND(BLOCKING) == 0))
    to_be = book.lexemes.where("verb_kind = 'TO_BE'").select("lexeme_id")
    finite = readings.where("kind = 'V' and mood in ('IND', 'SUB') and declension = 5 and variant = 1").join(to_be, "lexeme_id", "left_semi")
    order = F.struct("mood", _rank("tense", ["PRES", "IMPF", "FUT", "PERF", "PLUP", "FUTP"]).alias("t"), F.col("number"), "person", "tense")
    sums = finite.groupBy(*QUESTION).agg(F.min(order).alias("a"))
    next_key = [F.col(f"next_{c}") == F.col(f"a_{c}") for c in QUESTION]
    paired = pairs.join(sums.select(*[F.col(c).alias(f"a_{c}") for c in QUESTION], "a"), next_key, "left")
    kind = F.when(F.col("next_lookup") == "esse", "esse").when(F.col("next_lookup") == "fuisse", "fuisse").when(F.col("next_lookup") == "iri", "iri").when(F.col("a").isNotNull(), "finite_sum")
    paired = paired.withColumn("compound", kind).where("compound is not null")
    source = readings.where("kind in ('VPAR', 'SUPINE')").select(*QUESTION, "lexeme_id", "rule_id", F.col("kind").alias("source_kind"), F.col("tense").alias("source_tense"), F.col("voice").alias("source_voice"), F.col("case").alias("source_case"), F.col("number").alias("source_number"), "declension", "variant")
    met = paired.join(source, QUESTION)
    part = (F.col("source_kind") == "VPAR") & (((F.col("source_tense") == "PERF") & (F.col("source_voice") == "PASSIVE")) | (F.col("source_tense") == "FUT"))
    agrees = (F.col("source_case") == "NOM") & (F.col("source_number") == F.col("a.number"))
    fits = (
        F.when(F.col("compound") == "finite_sum", part & agrees).when(F.col("compound") == "esse", part).when(F.col("compound") == "fuisse", part & (F.col("source_tense") == "FUT"))
        .otherwise((F.col("source_kind") == "SUPINE") & (F.col("source_case") == "ACC"))
    )
    shifted = F.when(F.col("a.tense").isin("PRES", "PERF"), "PERF").when(F.col("a.tense").isin("IMPF", "PLUP"), "PLUP").when(F.col("a.tense") == "FUT", "FUTP").otherwise("X")
    perfect = F.col("source_tense") == "PERF"
    tense = (
        F.when(F.col("compound") == "finite_sum", F.when(perfect, shifted).otherwise(F.col("a.tense"))).when(F.col("compound") == "iri", "FUT")
        .when(perfect, "PERF").when(F.col("compound") == "fuisse", "PERF").otherwise(F.when(F.col("source_voice") == "ACTIVE", "FUT").otherwise("PRES"))
    )
    verb = F.col("compound") == "finite_sum"
    voice = F.when(verb | (F.col("compound") == "iri"), "PASSIVE").otherwise(F.col("source_voice"))
    out = met.where(fits).select(
        "line_id", "pos", "compound", "lexeme_id", "rule_id", "source_tense", "source_voice", F.col("next_lookup").alias("auxiliary"), "declension", "variant", tense.alias("tense"), voice.alias("voice"),
        F.when(verb, F.col("a.mood")).otherwise("INF").alias("mood"), F.when(verb, F.col("a.person")).alias("person"), F.when(verb, F.col("a.number")).alias("number"),
    ).distinct()
    spots = out.select("line_id", "pos").distinct()
    run = F.col("pos") - F.row_number().over(Window.partitionBy("line_id").orderBy("pos"))
    place = F.row_number().over(Window.partitionBy("line_id", "run").orderBy("pos"))
    kept = spots.withColumn("run", run).withColumn("place", place).where("place % 2 = 1").select("line_id", "pos")
    return out.join(kept, ["line_id", "pos"])


def _rank(column: str, order: list[str]) -> Column:
    return F.coalesce(*[F.when(F.col(column) == x, k) for k, x in enumerate(order)], F.lit(len(order)))


#: Endings of the citation form by part of speech, declension and variant; the stem is the first.
CITATION = {
    ("N", 1, 1): "a", ("N", 2, 1): "us", ("N", 2, 2): "um", ("N", 2, 3): "", ("N", 3, 1): "", ("N", 3, 2): "", ("N", 3, 3): "", ("N", 4, 1): "us", ("N", 4, 2): "u", ("N", 5, 1): "es",
    ("ADJ", 1, 1): "us", ("ADJ", 1, 2): "", ("ADJ", 3, 1): "", ("ADJ", 3, 2): "is", ("ADJ", 3, 3): "", ("V", 1, 1): "o", ("V", 2, 1): "eo", ("V", 3, 1): "o", ("V", 3, 4): "io", ("V", 5, 1): "um", ("V", 6, 1): "eo",
}


def citation_lemma(book: RuleBook) -> DataFrame:
    """lexeme_id and lemma: the first stem with the ending of its paradigm; deponents with the passive
    one; the stem alone for words that do not change."""
    first = book.stems.where("slot = 1").select("lexeme_id", "stem")
    joined = book.lexemes.join(first, "lexeme_id", "left")
    ending = F.coalesce(*[F.when((F.col("pos") == p) & (F.col("decl") == d) & (F.col("var") == v), e) for (p, d, v), e in CITATION.items()], F.lit(""))
    passive = F.when(F.col("verb_kind") == "DEP", F.concat(ending, F.lit("r"))).otherwise(ending)
    return joined.select("lexeme_id", F.concat("stem", passive).alias("lemma"))


def order_key() -> list[Column]:
    """What readings are presented by: marked forms confirmed first, then kind, entry and features bytewise."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in MORPHOLOGY]
    return [F.when(F.col("quantity_match") == "exact", 0).otherwise(1), F.coalesce("lemma", F.lit("")), *text, F.coalesce("rule_id", F.lit(-1)), F.coalesce("stem", F.lit("")), F.coalesce("ending", F.lit(""))]


def documents(found: DataFrame, readings: DataFrame, book: RuleBook) -> DataFrame:
    """One JSON document a token, in order: query, status, analyses with lemma, meaning and derivation."""
    full = readings.join(citation_lemma(book), "lexeme_id", "left").join(book.lexemes.select("lexeme_id", "meaning"), "lexeme_id", "left")
    body = F.struct("lemma", "meaning", "stage", "lexeme_id", "rule_id", "stem", "ending", *MORPHOLOGY, "prefix_id", "suffix_id", "tackon_id", "rewrites", "quantity_match", "trim", "notices", "roman")
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*[c.alias(f"k{k}") for k, c in enumerate(order_key())]).alias("k"), body.alias("body")))), lambda x: x["body"])
    grouped = full.groupBy(*QUESTION).agg(listed.alias("analyses"))
    joined = found.join(grouped, QUESTION, "left")
    status = F.when(F.col("status") != "ok", F.col("status")).when(F.col("analyses").isNull(), "unknown").otherwise("analyzed")
    doc = F.struct(F.struct("text", "normalized", "byte_begin", "byte_end").alias("query"), status.alias("status"), F.coalesce("analyses", F.array().cast(grouped.schema["analyses"].dataType)).alias("analyses"))
    return joined.select("line_id", "pos", F.to_json(doc, {"ignoreNullFields": "true"}).alias("document"))


def hits(readings: DataFrame) -> DataFrame:
    """The slim projection: ids only, distinct."""
    addons = F.array_compact(F.array("prefix_id", "suffix_id", "tackon_id"))
    return readings.select(*QUESTION, "lexeme_id", "rule_id", addons.alias("addon_ids"), "rewrites", "quantity_match").distinct()


def compact_rows(found: DataFrame, readings: DataFrame, book: RuleBook) -> DataFrame:
    """Twelve columns for tab-separated output, without control characters."""
    from ..functions.text import safe_text

    full = found.join(readings, QUESTION, "left").join(citation_lemma(book), "lexeme_id", "left").join(book.lexemes.select("lexeme_id", "meaning"), "lexeme_id", "left")
    features = F.concat_ws(" ", *[F.col(c).cast("string") for c in MORPHOLOGY[1:]])
    n = F.row_number().over(Window.partitionBy("line_id", "pos").orderBy(*order_key()))
    note = F.concat_ws(",", F.col("trim"), F.col("notices"))
    status = F.when(F.col("status") != "ok", F.col("status")).when(F.col("kind").isNull(), "unknown").otherwise("analyzed")
    display = F.concat_ws("", "stem", "ending")
    return full.select(
        F.col("line_id").alias("result"), F.concat(F.lit("token:"), "pos").alias("unit"), n.alias("reading"), status.alias("status"), safe_text(F.col("text")).alias("input"), display.alias("display"),
        "quantity_match", "lemma", F.col("kind").alias("part"), features.alias("features"), safe_text(F.col("meaning")).alias("meaning"), note.alias("note"),
    )
