"""A substring index for keyword search: trigrams of what a memory is searched by, posted by block of memories.

A search keeps a memory if each of its terms stands in what the memory says or in what its meeting is about. A term that
does has all its trigrams there. The index says which blocks hold each trigram; the blocks that have all trigrams of all
terms are read, nothing else, and retrieve() looks at their texts as it does without an index. Terms of one or two
characters have no trigram and rule out no block.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import retrieval

GRAM = 3
POSTINGS = "block int, gram string, bucket int"


def grams(text: Column) -> Column:
    """The distinct trigrams of a text; none of one that is shorter."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(text) - (GRAM - 1), F.lit(0)), F.lit(1)), lambda i: F.substring(text, i, F.lit(GRAM))))


def grams_of(term: str) -> list[str]:
    return sorted({term[i : i + GRAM] for i in range(len(term) - GRAM + 1)})


@dataclass(frozen=True)
class Index:
    """A folder with `rows` (memories by block), `meetings`, `postings` (gram, block) by bucket of the gram, and `shape`."""

    spark: SparkSession
    path: str

    def shape(self) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/shape").first()[0])

    def blocks_for(self, terms: Sequence[str]) -> list[int] | None:
        """The blocks that hold every trigram of every term; None if the terms have none, so that all blocks may do."""
        wanted = sorted({g for t in terms for g in grams_of(t)})
        if not wanted:
            return None
        buckets = self.shape()["buckets"]
        keyed = self.spark.createDataFrame([(g,) for g in wanted], "gram string").select("gram", F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int").alias("bucket"))
        places = sorted({r["bucket"] for r in keyed.collect()})  # no more than the query has trigrams
        posted = self.spark.read.schema(POSTINGS).parquet(f"{self.path}/postings").where(F.col("bucket").isin(places) & F.col("gram").isin(wanted))
        full = posted.groupBy("block").agg(F.countDistinct("gram").alias("n")).where(F.col("n") == len(wanted))
        return sorted(r["block"] for r in full.select("block").collect())  # block numbers, as many as the index has at most

    def memories(self, blocks: Sequence[int] | None = None) -> DataFrame:
        """The memories of these blocks, or all; no other block's files are opened or listed."""
        schema = T.StructType.fromJson(self.shape()["schema"])
        folders = [f"{self.path}/rows"] if blocks is None else [f"{self.path}/rows/block={b}" for b in blocks]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def meetings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/meetings")

    def search(self, query: retrieval.Query, **how) -> tuple[DataFrame, int, int]:
        """(retrieve()'s results, blocks read, blocks there are)."""
        words = re.findall("[a-z0-9]+", query.text.lower())
        names = self._names(words)
        terms = retrieval.plan(query, *names).terms
        blocks = self.blocks_for(terms)
        there = self.shape()["blocks"]
        found = retrieval.retrieve(self.memories(blocks), self.meetings(), query, names=names, **how)
        return found, there if blocks is None else len(blocks), there

    def _names(self, words: Sequence[str]) -> tuple[list[str], list[str]]:
        """Names among the words, from the tables of all speakers and participants that the index keeps."""
        few = [w.lower() for w in words]
        named = self.spark.read.parquet(f"{self.path}/names").where(F.lower("name").isin(few)).collect() if few else []
        return sorted(r["name"] for r in named if r["speaks"]), sorted(r["name"] for r in named if r["attends"])


def build(memories: DataFrame, meetings: DataFrame, path: str, block_rows: int = 2048, buckets: int = 64) -> Index:
    """Index memories in blocks of about block_rows rows, in order of meeting, so that what is said together lies together.

    Postings are distinct (gram, block) pairs: their number grows with blocks and the trigrams of each, not with
    rows. A gram's postings lie in one of `buckets` folders, sorted, so a search reads its own grams' folders and, by
    the files' statistics, little of them.
    """
    spark = memories.sparkSession
    count = memories.count()
    n = max(1, -(-count // block_rows))
    dealt = memories.repartitionByRange(n, "meeting_id", "memory_id").withColumn("block", F.spark_partition_id())
    dealt.write.partitionBy("block").parquet(f"{path}/rows")
    meetings.write.parquet(f"{path}/meetings")
    rows = spark.read.schema(T.StructType([*memories.schema.fields, T.StructField("block", T.IntegerType())])).parquet(f"{path}/rows")
    side = meetings.select("meeting_id", retrieval._joined(F.coalesce("title", F.lit("")), F.array_join("participants", " ")).alias("_about"))
    own = retrieval._joined(F.col("text"), F.coalesce("speaker", F.lit("")), retrieval._metadata())
    said = rows.select("block", "meeting_id", F.explode(grams(own)).alias("gram")).select("block", "gram").distinct()
    about = rows.select("block", "meeting_id").distinct().join(side, "meeting_id").select("block", F.explode(grams(F.col("_about"))).alias("gram"))
    posted = said.unionByName(about).distinct().withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int"))
    posted.repartition(buckets, "bucket").sortWithinPartitions("bucket", "gram", "block").write.partitionBy("bucket").parquet(f"{path}/postings")
    speaks = memories.select(F.col("speaker").alias("name"), F.lit(True).alias("speaks"), F.lit(False).alias("attends"))
    attends = meetings.select(F.explode("participants").alias("name"), F.lit(False).alias("speaks"), F.lit(True).alias("attends"))
    speaks.unionByName(attends).where("name is not null").groupBy("name").agg(F.max("speaks").alias("speaks"), F.max("attends").alias("attends")).write.parquet(f"{path}/names")
    shape = {"blocks": rows.select("block").distinct().count(), "rows": count, "buckets": buckets, "schema": memories.schema.jsonValue()}
    spark.createDataFrame([(json.dumps(shape),)], "value string").coalesce(1).write.text(f"{path}/shape")
    return Index(spark, path)
