"""The corpus pipeline: stages that each apply one training-data operator to all documents that the last one kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm import bpe, common, decontaminate, langid, linededup, minhash

#: What documents has, and each stage but the last returns.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text whose nearest language is no nearer than this is in none of those learned.
LEAST_SCORE = 0.2
#: Rows of a decision table that are broadcast; above that it is shuffled with the documents.
BROADCAST = 500_000


def _columns(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """The columns of documents, with another text and its length if one is given; others are dropped."""
    return docs.select(*COLUMNS) if text is None else docs.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def _row(docs: DataFrame) -> Column:
    """What stands for a row by its content, so that rows without an id or with a repeated one are judged by themselves. Of n
    different rows about n * n / 2**65 pairs are taken for one."""
    return F.xxhash64("doc_id", "text")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts in one of the languages learned from labelled rows.

    Those that are null, empty or without a letter go, and those too far from all languages, equal rows alike. Ties between
    languages go to the first name; lang, source and doc_id don't matter. Texts are judged whole. Without a labelled row, or
    of an empty table, nothing stays.
    """
    common.importable(spark)
    profiles = langid.learn(docs.where(~langid.held_out(F.col("doc_id"))))
    found = langid.identify(docs.select(*COLUMNS), profiles)
    return _columns(found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later repeats of runs of lines; a document that has no word left by that goes.

    The first of equal runs is by (doc_id, text, line), a null id first. Null and empty texts, which have no lines, stay
    as they are; equal rows come out alike, as one document. An empty table stays empty.
    """
    out = linededup.line_dedup(docs.select(*COLUMNS))
    return _columns(out.where("n_deleted < n_lines OR n_deleted = 0"), F.col("text"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies.

    That is the row of the smallest id, a null id last, then by content; of equal rows one stays. Rows are linked by their
    texts alone, so rows that share an id, or have none, are judged each by its text. Null and empty texts are linked with
    nothing; of equal rows of them one stays too. An empty table stays empty.
    """
    common.importable(spark)
    rows = docs.select(*COLUMNS).withColumn("_row", _row(docs))
    found = minhash.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"))
    # One row for each content: its group, and how often it is there. Equal rows are added up in each task.
    each = found.groupBy(F.col("doc_id").alias("key"), F.col("component_id").alias("group")).agg(F.count("*").alias("n"))
    ids = rows.select("doc_id", "_row").distinct()
    each = common.cut(each.join(ids, F.col("key") == F.col("_row")).select("key", "group", "n", "doc_id"))
    first = each.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("x")).select(F.col("x.key").alias("stays"))
    gone = common.cut(each.join(first, F.col("key") == F.col("stays"), "left_anti").select("key"))
    rows = rows.join(common.broadcast_if_small(gone, BROADCAST), F.col("_row") == F.col("key"), "left_anti")
    twice = common.broadcast_if_small(common.cut(each.where("n > 1").select("key")), BROADCAST)
    once = rows.join(twice, F.col("_row") == F.col("key"), "left_anti")
    again = rows.join(twice, F.col("_row") == F.col("key"), "left_semi").groupBy("_row").agg(F.min(F.struct(*COLUMNS)).alias("x"))
    return _columns(once).unionByName(again.select("x.*"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps rows that share no window of ten words, or no whole shorter item, with the benchmark.

    Rows are judged each by its own text, whatever their ids; equal rows alike. Null and empty texts share nothing and
    stay; items without a word match nothing. An empty table on either side is fine.
    """
    docs = docs.select(*COLUMNS).withColumn("_row", _row(docs))
    found = decontaminate.decontaminate(docs.select(F.col("_row").alias("doc_id"), "text"), common.table(spark, sf_dir, "benchmark"))
    gone = common.cut(found.where("contaminated").select(F.col("doc_id").alias("key")).distinct())
    return _columns(docs.join(common.broadcast_if_small(gone, BROADCAST), F.col("_row") == F.col("key"), "left_anti"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, their number and digest, the digest of what they decode to, and that text.

    A null or empty text has no ids and an empty text; equal rows come out alike; an empty table stays empty.
    """
    import public_tokenizers

    common.importable(spark)
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        out = bpe.encode_decode(docs, f.read(), public_tokenizers.PATTERN, keep=True)
    return out.select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256", F.col("decoded").alias("text"))


STAGES = [("language", language), ("line_dedup", lines), ("near_dedup", near), ("decontaminate", benchmark), ("bpe", encode)]
#: Learning, linking and encoding are beyond SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, writing each result to the shared folder and reading it again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = common.scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
