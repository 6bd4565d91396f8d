"""A corpus pipeline: quality rules, near-duplicate removal, secret masking, source mixing, packing.

Each stage takes (spark, docs, sf_dir), docs being what the stage before it kept, and returns documents (doc_id,
text, lang, source, n_chars), but for the last, which returns packed pieces. Other columns are dropped, whatever
their names. Null and empty texts are rejected by the first stage, so later ones see none in a whole run; each stage
handles them all the same, as its operator says. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlens.llm import common, mixing, neardup, packing, quality, secrets, tokens

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame, text) -> DataFrame:
    return docs.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove failing lines; documents that the rules reject go. Repeated rows are judged alike; null and empty texts fail."""
    judged = quality.clean_lines(docs.select(*COLUMNS))
    # a filter would compute every line's verdict a second time
    return _documents(judged.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("kept").cast("int")))), F.col("clean_text"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates (shingles of five words, similarity 0.8) the smallest doc_id stays.

    Rows that repeat a doc_id are one document: the row whose text has the least hash stays. Rows without a doc_id
    are one document for each text, after all those with one.
    """
    named = F.coalesce("doc_id", F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("text"), 3))
    rows = docs.select(*COLUMNS, named.alias("_id"))
    found = neardup.near_duplicates(rows.select(F.col("_id").alias("doc_id"), "text"))
    # documents with one row that stays are most; texts of the others alone, and of those that share a hash bucket with them, are shuffled
    others = common.materialize(found.groupBy(F.col("doc_id").alias("_id")).agg(F.count_if("kept").alias("_rows")).where("_rows <> 1"), "others")
    surely, maybe = common.parted(rows, "_id", others, "_id")
    mine = maybe.join(others, "_id", "left")
    several = mine.where("_rows > 1").groupBy("_id").agg(F.min_by(F.struct(*COLUMNS), F.xxhash64("text", *COLUMNS)).alias("row"))
    return surely.select(*COLUMNS).unionByName(mine.where("_rows is null").select(*COLUMNS)).unionByName(several.select("row.*"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask every secret in the texts; all documents stay, repeated rows too. Null texts become empty."""
    found = secrets.scan_ledger(docs.select(*COLUMNS), secrets.fresh_ledger(spark))
    masked = secrets.redact(found)
    return _documents(masked, F.col("text"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit rates that keep the clean domain's tokens and bring the others' to none; documents whose rate is not nothing stay, once.

    Rows are rated one by one, so repeated rows stay or go together. Texts without a word have the prior's rate;
    without any labelled row all stay.
    """
    labels = mixing.quality_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rated = mixing.mix(docs.select(*COLUMNS), labels, lambda have: {d: n if d == "clean" else 0.0 for d, n in have.items()})
    return rated.where(mixing.admitted(F.col("rate"))).select(*COLUMNS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into windows of 4096 tokens in the sources' proportions.

    Each row is a document of its own, also where rows repeat; a null or empty text has its end id alone.
    """
    return packing.packed_digests(packing.pack(docs, tokens.vocabulary()))


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("mixing", source_mixing),
    ("packing", pack_windows),
]

#: Sketches, posteriors and token ids are beyond SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.materialize(docs, f"stage{i}")
    return docs
