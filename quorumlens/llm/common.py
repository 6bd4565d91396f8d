"""Helpers that the training-data operators share: shared-folder tables and distributed running sums."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What a word is in every contract: a run of anything but space, tab, LF, VT, FF and CR.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or the checkpoint folder that the session has.

    Only where neither is set (a local session, as in tests) a temporary folder is made and set.
    """
    if path := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors see")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quorumlens-"))
    return spark.sparkContext.getCheckpointDir()


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, where naming it again would compute it again."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def prefix_totals(blocks: DataFrame, block: str, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """For one row a block (and key in by): the sum of values over the blocks before it, as before_<value>.

    The input has a row a block, not a row a document, so the window is small even where one key is hot.
    """
    w = Window.partitionBy(*by).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select(*by, block, *[F.coalesce(F.sum(v).over(w), F.lit(0)).cast("long").alias(f"before_{v}") for v in values])


def ordered_blocks(df: DataFrame, order: Sequence[str], name: str = "ordered") -> DataFrame:
    """df range-partitioned and sorted by order, with its block number as _block, as a table in the shared folder.

    order should end in columns that tell most rows apart, so that no block gets all ties.
    """
    n = partitions(df.sparkSession)
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_block", F.spark_partition_id())
    return materialize(dealt, name)


def row_numbers(blocks: DataFrame, order: Sequence[str], out: str = "position") -> DataFrame:
    """Gapless numbers from 0 in the order of ordered_blocks(): a count a block, then a window inside each block."""
    counts = blocks.groupBy("_block").agg(F.count("*").alias("n"))
    before = materialize(prefix_totals(counts, "_block", ["n"]), "block_counts")
    inside = F.row_number().over(Window.partitionBy("_block").orderBy(*order)) - 1
    return blocks.withColumn("_inside", inside).join(before, "_block").withColumn(out, F.col("_inside") + F.col("before_n")).drop("_inside", "before_n", "_block")


def sifted(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str, buckets: int = 1 << 20) -> DataFrame:
    """The rows whose key may be among wanted's, before a join that would shuffle all rows for the few that meet."""
    return parted(rows, key, wanted, wanted_key, buckets)[1]


def parted(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str, buckets: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """The rows whose key is surely not among wanted's, and those whose key may be; neither is shuffled.

    What is broadcast is the hash buckets that wanted has, `buckets` numbers at most, whatever the data; where wanted has
    so many keys that all buckets are hit, all rows may be. Nulls count as one key.
    """
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets))
    hit = F.broadcast(materialize(wanted.select(bucket(wanted_key).alias("_bucket")).distinct(), "buckets"))
    dealt = rows.withColumn("_bucket", bucket(key))
    surely, maybe = (dealt.join(hit, "_bucket", how).drop("_bucket") for how in ("left_anti", "left_semi"))
    return surely, maybe
