"""Near-dedup leaves the texts that surely stay in their tasks."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from quorumlens.llm import common


def test_texts_that_surely_stay_are_not_shuffled(spark, tmp_path):
    r = random.Random(3)
    text = lambda: " ".join(str(r.randrange(10**9)) for _ in range(30))
    plain = {i: text() for i in range(300)}
    copies = [(1000 + i, plain[i]) for i in range(20)]
    twice = [(500, text()), (500, text())]  # rows of one document, both kept
    null = text()
    rows = [*plain.items(), *copies, *twice, (None, null), (None, null)]
    path = f"{tmp_path}/texts"
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path)
    docs = spark.read.parquet(path)
    had = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        kept = corpus_pipeline.near_dedup(spark, docs, "")
        plan = str(kept._jdf.queryExecution().executedPlan())
        out = kept.collect()
    finally:
        for k, v in had.items():
            spark.conf.set(k, v)
    parts = plan[plan.index("Union") :].split("FileScan parquet")
    assert "/texts" in parts[1] and "hashpartitioning" not in parts[0]  # the first part of the union reads the texts without a shuffle
    got = sorted(((x["doc_id"], x["text"]) for x in out if x["doc_id"] != 500), key=str)
    assert got == sorted([*plain.items(), (None, null)], key=str)
    assert [x["text"] for x in out if x["doc_id"] == 500] in ([twice[0][1]], [twice[1][1]])


def test_parted_by_what_is_wanted(spark):
    rows, wanted = spark.range(1000), spark.createDataFrame([(3,), (700,), (5000,)], "k long")
    surely, maybe = common.parted(rows, "id", wanted, "k")
    assert surely.count() + maybe.count() == 1000 and maybe.count() < 20
    assert maybe.where("id in (3, 700)").count() == 2 and surely.where(F.col("id").isin(3, 700)).count() == 0
