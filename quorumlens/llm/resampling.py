"""Importance resampling towards a target text set: n-gram features by position tables, hashed gains, a keyed Gumbel draw.

A position table has a row a word of a document: its place and the word. lead() over a document's places puts the
words behind a place beside it, and joining 1, 2, ... of them gives the features that begin there.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ordered_blocks, partitions, row_numbers, text_or_empty

#: A word is a run of ASCII digits, ASCII letters and everything beyond ASCII, A-Z in lower case.
FEATURE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(FEATURE_WORD), F.lit(0))


def bucket_of(feature: Column, buckets: int) -> Column:
    return (F.crc32(F.encode(feature, "utf-8")) % F.lit(buckets)).cast("int")


def position_table(texts: DataFrame, orders: int = 1, row: str = "_row", text: str = "text") -> DataFrame:
    """(row, _feature): a row for each run of 1 to `orders` words of a text, repeats included; a text without words gives one null.

    Words behind a place come from lead() in the text's window. So that this window, a sum of what a text has, and
    nothing else, is what shuffles, texts are dealt by row before they are cut into words; with orders = 1 no word
    is looked up behind another, and nothing shuffles.
    """
    if orders < 1:
        raise ValueError("orders must be 1 or more")
    rows = texts.select(row, text_or_empty(text).alias("_text"))
    if orders > 1:
        rows = rows.repartition(partitions(texts.sparkSession), row)
    placed = rows.select(row, F.posexplode_outer(words_of(F.col("_text"))).alias("_pos", "_word"))
    if orders == 1:
        return placed.select(row, F.col("_word").alias("_feature"))
    w = Window.partitionBy(row).orderBy("_pos")
    ahead = placed.withColumns({f"_next{k}": F.lead("_word", k).over(w) for k in range(1, orders)})
    # a run that would go on behind the last word is null, and so left out; a text without words keeps its one null
    runs = [F.when(F.col(f"_next{k}").isNotNull() if k else F.lit(True), F.concat_ws(" ", "_word", *[f"_next{i}" for i in range(1, k + 1)])) for k in range(orders)]
    whole = F.filter(F.array(*runs), lambda f: f.isNotNull())
    return ahead.select(row, F.explode_outer(F.when(F.col("_word").isNotNull(), whole)).alias("_feature"))


def bucket_counts(texts: DataFrame, orders: int = 1, buckets: int = 10_000, text: str = "text") -> DataFrame:
    """(bucket, n): the features of all texts by bucket; counted in each task before the shuffle, so one hot word is one row a task."""
    named = texts.withColumn("_row", F.monotonically_increasing_id())
    found = position_table(named, orders, text=text).where("_feature is not null")
    return found.groupBy(bucket_of(F.col("_feature"), buckets).alias("bucket")).agg(F.count("*").alias("n"))


def gains(texts: DataFrame, target: DataFrame, orders: int = 1, buckets: int = 10_000, text: str = "text", target_text: str = "text") -> DataFrame:
    """(bucket, gain), a row for each bucket: floor(1000 * ln of how much likelier it is in the target), one added to every count."""
    spark = texts.sparkSession
    have = bucket_counts(texts, orders, buckets, text).withColumnRenamed("n", "s")
    want = bucket_counts(target, orders, buckets, target_text).withColumnRenamed("n", "t")
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    counted = materialize(every.join(have, "bucket", "left").join(want, "bucket", "left").fillna(0, ["s", "t"]), "bucket_counts")
    total = counted.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))  # one row
    ratio = (F.col("t") + 1) * (F.col("all_s") + buckets).cast("double") / ((F.col("s") + 1) * (F.col("all_t") + buckets).cast("double"))
    return counted.join(F.broadcast(total)).select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u in (0, 1) being the first 32 bits of sha256("<seed>:<doc_id>"); a null doc_id counts as ""."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, orders: int = 1, buckets: int = 10_000, least_words: int = 20, seed: int = 2024, text: str = "text", target_text: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank), a row a row of docs: draw `percent` of docs without replacement by importance.

    weight is the sum of the gains of a document's features, score adds a Gumbel draw keyed by doc_id, and the
    floor(percent * N / 100) highest scores among the N documents of at least least_words words are drawn, of equals
    the smaller doc_id; rank counts from 1 in that order and is null for the rest. Null, empty and wordless texts
    have weight 0 and are never drawn while least_words is 1 or more. Rows that repeat a doc_id are documents of
    their own with the same draw; a null doc_id comes after all others of its score. Other columns of docs are not
    read, whatever their names. An empty table gives no rows; an empty target makes all gains follow docs alone.

    Gains are a row a bucket, whose number is a parameter, so they are joined by broadcast. Features are summed by
    row in the task that cuts the text, and only these sums are shuffled.
    """
    if not 0 <= percent <= 100:
        raise ValueError("percent must lie between 0 and 100")
    gain = F.broadcast(materialize(gains(docs, target, orders, buckets, text, target_text), "gains"))  # `buckets` rows
    rows = docs.select(F.col("doc_id"), F.col(text).alias("_text")).withColumn("_row", F.struct("doc_id", F.monotonically_increasing_id().alias("_n")))
    features = position_table(rows, orders, text="_text")
    joined = features.withColumn("bucket", bucket_of(F.col("_feature"), buckets)).join(gain, "bucket", "left")
    sums = joined.groupBy("_row").agg(F.count("_feature").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).cast("long").alias("weight"))
    # of `orders` runs that begin at each of w words, the last ones are short: w + (w - 1) + ... + (w - orders + 1)
    least = sum(max(least_words - k, 0) for k in range(orders))
    scored = sums.select("_row.doc_id", "n_features", "weight", (F.col("weight") + gumbel(F.col("_row.doc_id"), seed)).alias("score"))
    scored = materialize(scored, "scored")
    fit = F.col("n_features") >= least
    order = ["_down", "_no_id", "doc_id", "weight", "n_features"]
    ready = scored.where(fit).withColumns({"_down": -F.col("score"), "_no_id": F.col("doc_id").isNull()})
    drawn = math.floor(percent * ready.count() / 100) if percent < 100 else ready.count()
    place = row_numbers(ordered_blocks(ready, order, "by_score"), order).withColumn("rank", (F.col("position") + 1).cast("long"))
    cols = ("doc_id", "n_features", "weight", "score")
    ranked = place.select(*cols, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return ranked.unionByName(scored.where(~fit).select(*cols, F.lit(None).cast("long").alias("rank")))


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return resample(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))


#: DuckDB has no crc32, so it is folded over the bytes of each distinct word, by a table made from its polynomial.
OP11_SQL = r"""
WITH RECURSIVE step AS (SELECT i, i AS c, 0 AS k FROM (SELECT unnest(range(256)) AS i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM step WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(ws) AS w FROM d) GROUP BY 1, 2),
q AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark) GROUP BY 1),
hexed AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM w UNION SELECT w FROM q)),
coded AS (SELECT w, CAST(xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: (strpos('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2 * i + 2]) - 1)),
  lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) % 10000 AS INT) AS bucket FROM hexed, crc_table),
s AS (SELECT bucket, CAST(sum(n) AS BIGINT) AS s FROM w JOIN coded USING (w) GROUP BY 1),
t AS (SELECT bucket, CAST(sum(n) AS BIGINT) AS t FROM q JOIN coded USING (w) GROUP BY 1),
total AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) + 10000 AS su, (SELECT coalesce(sum(t), 0) FROM t) + 10000 AS tu),
gain AS (SELECT bucket, CAST(floor(1000.0::DOUBLE * ln((coalesce(t, 0) + 1) * CAST(su AS DOUBLE) / ((coalesce(s, 0) + 1) * CAST(tu AS DOUBLE)))) AS BIGINT) AS gain FROM s FULL JOIN t USING (bucket), total),
sums AS (SELECT r, sum(n) AS n, sum(n * gain) AS weight FROM w JOIN coded USING (w) JOIN gain USING (bucket) GROUP BY 1),
scored AS (SELECT r, doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, CAST(coalesce(weight, 0) + floor(-1000.0::DOUBLE * ln(-ln(
  (CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN sums USING (r)),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, weight, n_features) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= floor(10 * n / 100) THEN place END AS rank FROM scored LEFT JOIN ranked USING (r)
"""
