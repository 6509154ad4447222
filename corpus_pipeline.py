"""The training-data pipeline: five stages over documents, each on all that the one before kept."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from morphlake.llm.common import fold, lean, materialize, small_batches, table
from morphlake.sources.shared import release
from morphlake.llm.langid import learn, predict
from morphlake.llm.mixing import mix
from morphlake.llm.packing import pack_documents, tokenizer_path
from morphlake.llm.quality import score_quality
from morphlake.llm.simhash import simhash_components

#: A text in another language than its `lang` says goes if the prediction is as sure as this.
SURE = 0.9
#: Words of the mix an output shard gets, about.
SHARD_WORDS = 4_000_000
#: Rows of a batch: they carry all columns through Python.
ROWS = 300


def keyed(rows: DataFrame) -> DataFrame:
    """`packed` rows with two hashes of id and text, which no null makes null: together the key of a row."""
    return rows.withColumns({"__k1": F.xxhash64("doc_id", "text"), "__k2": F.xxhash64(F.lit(1), "text", "doc_id")})


KEY = ["__k1", "__k2"]


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns in one struct, so that their names can clash with nothing."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*(others or [F.lit(0)])).alias("__row"))


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"__row.`{c}`") for c in columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter, and those surely in another language than `lang` says. Rows with
    a null lang stay. Null and empty texts go. Where no row can be learned from, all stay. Very long texts are
    parsed whole; repeated rows are judged each; an empty table stays empty; other columns pass, whatever their names."""
    small_batches(spark, ROWS)
    model = learn(docs.where(fold(F.col("doc_id"), 3) != 1).select("doc_id", "text", "lang"))
    found = predict(packed(docs), model, ("text", "__row"))
    said = F.col("__row.lang")
    wrong = F.coalesce((said != F.col("lang_pred")) & (F.col("score") >= SURE), F.lit(False))
    kept = found.where((F.col("lang_pred") != "und") & ~wrong) if model else found
    return unpacked(kept, docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that the quality classifier predicts label 0 for; it learns from `labels`. Null texts are judged as
    empty ones, very long texts whole, repeated rows each; without labels all rows stay; an empty table stays empty; other columns
    pass, whatever their names."""
    small_batches(spark, ROWS)
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    found = score_quality(packed(docs), labels, fold(F.col("doc_id"), 5) == 0, ("text", "__row"))
    return unpacked(found.where("predicted = 1"), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of linked fingerprints one document, of the smallest id; null ids come last, and of equal ids
    the smallest hash. Null and empty texts are one group. Repeated rows are copies; an empty table stays empty; other columns pass,
    whatever their names."""
    rows = keyed(packed(docs))
    groups = simhash_components(rows.select("doc_id", "text", *KEY), keep=tuple(KEY), root=True)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *KEY)).alias("k")
    kept = groups.groupBy("root").agg(first).select(*[F.col(f"k.{c}") for c in KEY])
    small_batches(spark, ROWS)
    return unpacked(rows.join(kept, KEY, "left_semi").dropDuplicates(KEY), docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, dealt into shards and ordered within: one row for each run of words taken of a
    document. A text taken whole is unchanged; of a cut one the row has the run, and n_chars is its length. Null and empty
    texts have no words and are never taken; a null source is a source; rows of equal id and text count once; an empty table
    stays empty; other columns pass, whatever their names."""
    words = docs.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shards = max(16, -(-words // 6 // SHARD_WORDS))
    rows = keyed(packed(docs)).dropDuplicates(KEY)
    mixed, pieces = mix(rows.select("doc_id", F.col("__row.source").alias("source"), "text", *KEY), keep=tuple(KEY), shards=shards)
    spans = F.sort_array(F.collect_list(F.struct("pass", "start", "words", "shard", "place"))).alias("__spans")  # a few a block of the text
    plan = mixed.select("row", *KEY).join(pieces, "row").groupBy(*KEY).agg(spans)
    met = rows.join(plan, KEY).select("doc_id", "__row", "text", "__spans")
    small_batches(spark, ROWS)

    def cut(batches):
        for b in batches:
            rows, texts, shard, place = [], [], [], []
            for k, (text, spans) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                for run in runs(text, spans):
                    rows.append(k)
                    texts.append(run[0])
                    shard.append(run[1])
                    place.append(run[2])
            cols = [c.take(pa.array(rows, pa.int64())) for c in b.columns[:2]]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(shard, pa.int32()), pa.array(place, pa.int64())], names=names)

    names = ["doc_id", "__row", "text", "__chars", "__shard", "__place"]
    kinds = [met.schema["doc_id"].dataType, met.schema["__row"].dataType, T.StringType(), T.LongType(), T.IntegerType(), T.LongType()]
    out = met.mapInArrow(lean(cut), T.StructType([T.StructField(c, k) for c, k in zip(names, kinds, strict=True)]))
    if "n_chars" in docs.columns:
        chars = F.col("__chars").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("__row", F.struct(*[(chars if c == "n_chars" else F.col(f"__row.`{c}`")).alias(c) for c in docs.columns if c not in ("doc_id", "text")]))
    return unpacked(out.repartition("__shard").sortWithinPartitions("__shard", "__place"), docs.columns)


def runs(text: str, spans: list[dict]) -> list[tuple[str, int, int]]:
    """(text, shard, place) of each run of words that a pass takes without a gap into one shard."""
    raw = text.encode()
    found: list[list] = []
    for s in spans:
        end = s["start"] + s["words"]
        if found and found[-1][0] == s["pass"] and found[-1][2] == s["start"] and found[-1][3] == s["shard"]:
            found[-1][2] = end
        else:
            found.append([s["pass"], s["start"], end, s["shard"], s["place"]])
    # byte offsets of the words: their ends by walking the split
    ends, at = [], 0
    for w in raw.split():
        at = raw.index(w, at) + len(w)
        ends.append((at - len(w), at))
    out = []
    for _, start, end, shard, place in found:
        whole = start == 0 and end == len(ends)
        out.append((text if whole else raw[ends[start][0] : ends[end - 1][1]].decode(), shard, place))
    return out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all texts into sequences; one row per piece. Null and empty texts are the end id alone; repeated rows are
    packed each; an empty table gives an empty one; columns other than doc_id and text end here."""
    small_batches(spark, ROWS)
    return pack_documents(docs.select("doc_id", "text"), tokenizer_path())


STAGES = [("language_id", language_id), ("quality", quality), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: No SQL expresses the stages. Tests hold the near duplicates, the mix and the packing against brute force, the two
#: learned stages against what their operators say of every row.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; a stage's table goes when the next one's is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        done, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        release(done)
    return STAGES[-1][1](spark, docs, sf_dir)
