"""The blob ledger over several versions of a corpus, and spans of texts with very many secrets."""

from pyspark.sql import functions as F

from quorumlens.llm import secrets

KEY = "password = hunter2hunter2"


def test_versions_and_paths(spark, tmp_path):
    ledger = f"{tmp_path}/ledger"
    frame = lambda rows: spark.createDataFrame(rows, "path string, text string")
    secrets.scan_ledger(frame([("a", KEY), ("b", "plain"), ("c", KEY)]), ledger, path="path", version="v1").collect()
    n = spark.read.parquet(f"{ledger}/scanned").count()
    assert n == 2 * len(secrets.RULES)
    secrets.scan_ledger(frame([("a", "cleaned"), ("b", "plain"), ("c", KEY), ("d", KEY)]), ledger, path="path", version="v2").collect()
    assert spark.read.parquet(f"{ledger}/scanned").count() == n + len(secrets.RULES)  # only "cleaned" was new
    found = sorted((r["path"], r["version"], r["kind"], r["start"], r["stop"]) for r in secrets.findings_by_path(spark, ledger).collect())
    assert found == [(p, v, "assign", 0, len(KEY)) for p, v in (("a", "v1"), ("c", "v1"), ("c", "v2"), ("d", "v2"))]


def test_known_texts_stay_where_they_are(spark, tmp_path):
    """A second run finds no blob to read."""
    d = spark.createDataFrame([(i, f"{KEY} {i}") for i in range(5)], "doc_id long, text string")
    first = secrets.scan_ledger(d, f"{tmp_path}/ledger").collect()
    again = secrets.scan_ledger(d, f"{tmp_path}/ledger")
    assert sorted(first) == sorted(again.collect()) and spark.read.parquet(f"{tmp_path}/ledger/scanned").count() == 5 * len(secrets.RULES)


def test_running_totals(spark):
    rows = [(list(range(n)),) for n in (0, 1, 499, 500, 501, 1700)]
    got = [r[0] for r in spark.createDataFrame(rows, "x array<int>").select(secrets.running_totals(F.col("x"))).collect()]
    assert got == [[sum(range(i)) for i in range(len(x))] for (x,) in rows]


def test_very_many_secrets_in_a_text(spark, tmp_path):
    text = "é\n".join(f"token={i:06d}" for i in range(3000))
    spans = secrets.scan_ledger(spark.createDataFrame([(1, text)], "doc_id long, text string"), f"{tmp_path}/ledger").first()["spans"]
    assert len(spans) == 3000 and all(text[s["start"] : s["stop"]] == f"token={i:06d}" for i, s in enumerate(spans))
