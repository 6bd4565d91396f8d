"""Copies that follow the rates' running sum, and rows that a mixture admits."""

import random

import pytest
from pyspark.sql import functions as F

from quorumlens.llm import mixing

SCHEMA = "doc_id long, n_tokens long, domains map<string,double>, rate double, row string, copies string, _block int"


def rated(spark, rows):
    return spark.createDataFrame([(*r, "mine", "old", 7) for r in rows], SCHEMA).repartition(7)


def test_tokens_meet_the_rates_within_one_document(spark):
    r = random.Random(1)
    rows = []
    for i in range(3000):
        p = r.choice([0.999, 0.98, 0.02, 0.001])
        rows.append((i if i % 50 else None, r.choice([5, 17, 300, r.randint(1, 4000)]), {"bad": 1 - p, "good": p}, r.choice([0.0, 0.3, 1.0, 1.7, r.random()])))
    out = mixing.systematic_copies(rated(spark, rows)).collect()
    assert len(out) == 3000 and set(out[0].asDict()) == {"doc_id", "n_tokens", "domains", "rate", "row", "_block", "copies"}
    assert all(x["copies"] in (int(x["rate"]), int(x["rate"]) + 1) for x in out)
    longest = max(x["n_tokens"] for x in out)
    for name in ("bad", "good"):
        off = sum((x["copies"] - x["rate"]) * x["n_tokens"] * x["domains"][name] for x in out)
        assert abs(off) <= longest
    assert abs(sum(x["copies"] - x["rate"] for x in out)) <= 1


def test_equal_rows_share_their_copies(spark):
    """A third of all rows alike: their copies come to their rates but for one, wherever the blocks are cut."""
    out = mixing.systematic_copies(rated(spark, [(1, 10, {"good": 1.0}, 0.37)] * 1000 + [(i, i, {"good": 1.0}, 1.0) for i in range(2, 200)])).collect()
    assert abs(sum(x["copies"] for x in out if x["doc_id"] == 1) - 370) <= 1 and all(x["copies"] == 1 for x in out if x["doc_id"] != 1)


def test_empty_and_unknown(spark):
    assert mixing.systematic_copies(rated(spark, [(1, 1, {}, 1.0)]).limit(0)).count() == 0
    assert [x["copies"] for x in mixing.systematic_copies(rated(spark, [(1, 1, {}, 1.0), (2, 0, {}, 1.0)])).collect()] == [1, 1]


@pytest.mark.parametrize("rate, stays", [(0.0, False), (1e-9, False), (0.01, True), (0.4, True), (3.0, True)])
def test_admitted(spark, rate, stays):
    assert spark.range(1).select(mixing.admitted(F.lit(rate))).first()[0] is stays


def test_pipeline_keeps_by_the_rates(spark, tmp_path):
    """Clean and unlabelled clean-looking texts stay, whole; bad ones go."""
    import corpus_pipeline

    r = random.Random(4)
    prose = lambda: " ".join("".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8))) for _ in range(40))
    rows = [(i, prose() + (" vile scum idiots" if i % 4 == 0 else ""), "xx", "s", 1) for i in range(600)]
    docs = spark.createDataFrame([*rows, rows[1], (None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long").withColumn("rate", F.lit("mine"))
    spark.createDataFrame([(i, int(i % 4 != 0), int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.source_mixing(spark, docs, str(tmp_path))
    assert out.columns == list(corpus_pipeline.COLUMNS)
    kept = [x["doc_id"] for x in out.collect() if x["doc_id"] is not None]
    assert sorted(kept) == sorted([i for i in range(600) if i % 4] + [1])
