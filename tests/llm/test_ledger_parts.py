"""The ledger's parts: a small batch reads and writes its own; versions are kept once; masks of very many spans."""

import random

from pyspark.sql import functions as F

from quorumlens.llm import secrets

KEY = "password = hunter2hunter2"


def test_a_batch_reads_its_own_parts(spark, tmp_path):
    ledger = f"{tmp_path}/ledger"
    many = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit(f"{KEY} "), F.col("id").cast("string")).alias("text"))
    secrets.scan_ledger(many, ledger)
    parts = {r[0] for r in spark.read.parquet(f"{ledger}/scanned").select(F.col("prefix").cast("string")).distinct().collect()}
    assert len(parts) > 200
    few = many.limit(2).unionByName(spark.createDataFrame([(9999, f"new {KEY}")], "doc_id long, text string"))
    out = secrets.scan_ledger(few, ledger)
    assert all(len(r["spans"]) == 1 for r in out.collect()) and out.count() == 3
    scanned = spark.read.schema("blob string, rule string, version int, prefix string").parquet(f"{ledger}/scanned")
    assert scanned.count() == 601 * len(secrets.RULES)
    wrong = scanned.where(F.col("prefix") != F.substring("blob", 1, secrets.PREFIX)).count()
    assert wrong == 0
    # the parts that a batch asks for are pruned by their folders' names
    plan = scanned.where(F.col("prefix").isin("00", "1e"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [prefix" in plan


def test_versions_are_kept_once(spark, tmp_path):
    ledger = f"{tmp_path}/ledger"
    frame = lambda rows: spark.createDataFrame(rows, "path string, text string")
    rows = [("a", KEY), (None, KEY), ("b", None), ("b", None)]
    for _ in range(3):
        secrets.scan_ledger(frame(rows), ledger, path="path", version="v1")
    secrets.scan_ledger(frame(rows[:1]), ledger, path="path", version="")
    secrets.scan_ledger(frame([("a", "changed in the same version")]), ledger, path="path", version="v1")
    kept = spark.read.parquet(f"{ledger}/versions").drop("part")
    assert kept.count() == 5 and kept.where("path is null").count() == 1
    found = sorted((r["path"] or "", r["version"]) for r in secrets.findings_by_path(spark, ledger).collect())
    assert found == [("", "v1"), ("a", ""), ("a", "v1")]


def masked(text, spans):
    out, at = [], 0
    for start, stop in spans:
        if start >= at:
            out += [text[at:start], "[secret]"]
        at = max(at, stop)
    return "".join(out) + text[at:]


def test_masks(spark):
    r = random.Random(3)
    rows = []
    for i in range(30):
        text = "".join(r.choice("ab é😀\n") for _ in range(r.choice([0, 40, 4000])))
        spans = sorted((a, min(len(text), a + r.randint(1, 30))) for a in (r.randrange(len(text)) for _ in range(r.choice([0, 3, 1200]) if text else 0)))
        rows.append((i, text, [("k", a, b) for a, b in spans]))
    d = spark.createDataFrame(rows, f"doc_id long, text string, spans {secrets.SPANS}")
    got = {x["doc_id"]: x["text"] for x in secrets.redact(d).collect()}
    assert all(got[i] == masked(text, [(a, b) for _, a, b in spans]) for i, text, spans in rows)
