"""Where a document is kept or not, no draw decides; copies meet the rate on average."""

from pyspark.sql import functions as F

from quorumlens.llm import mixing


def test_clean_documents_stay_once(spark):
    p = {"clean": 0.93, "low": 0.05, "toxic": 0.02}
    rows = [(i, p, 0.72) for i in range(200)] + [(200, p, 2.4), (201, {"clean": 0.4, "low": 0.6}, 0.3), (202, {}, 1.0), (203, {"low": 1.0}, 0.0)]
    d = spark.createDataFrame(rows, "doc_id long, domains map<string,double>, rate double")
    got = {r[0]: r[1] for r in d.select("doc_id", mixing.kept_whole("clean", F.col("domains"), F.col("rate"))).collect()}
    assert [i for i, keep in got.items() if not keep] == [201, 203]


def test_copies_are_the_rate_on_average(spark):
    d = spark.range(20_000).select(*[F.avg(mixing.copies(F.lit(x), F.col("id"))).alias(f"r{i}") for i, x in enumerate((0.07, 0.93, 1.08, 1.0, 0.0))]).first()
    assert all(abs(a - b) < 0.01 for a, b in zip(d, (0.07, 0.93, 1.08, 1.0, 0.0))) and d[3] == 1.0 and d[4] == 0.0


def test_the_stage_asks_for_no_draw(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    rows = [(i, "some words", "en", "s", 10) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rated = lambda d, *_: d.withColumns({"rate": F.lit(0.72), "domains": F.create_map(F.lit("clean"), F.lit(0.93), F.lit("low"), F.lit(0.07))})
    monkeypatch.setattr(mixing, "mix", rated)
    assert corpus_pipeline.source_mixing(spark, docs, str(tmp_path)).count() == 100
