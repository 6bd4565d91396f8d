"""Texts are searched once a meeting, streams are read by several tasks, and imports cut files into turns once."""

import glob

from pyspark.sql import Window
from pyspark.sql import functions as F

from quorumlens.operators import extraction
from quorumlens.operators.store import Store
from quorumlens.sources import transcripts
from quorumlens.streaming import ingest

NOW = "2026-01-01T00:00:00+00:00"


def test_a_text_that_a_meeting_repeats_is_searched_once(spark):
    said = ["I will set up kafka by Friday.", "I will set up KAFKA by Friday!", "There is a risk of delay.", "Hm.", None]
    who = ["Ann", "", None, "Bo", "Ann"]
    rows = [(f"m{i % 2}", 40 - i, who[i % 5], said[(i * 7) % 5 if i % 3 else 0]) for i in range(40)]
    u = spark.createDataFrame(rows, "meeting_id string, utterance_index int, speaker string, text string")
    got = extraction.extract(u)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_first" in plan[plan.index("Generate") :]  # below the rules, not above
    w = Window.partitionBy("meeting_id", "content_hash").orderBy(F.desc("confidence"), "utterance_index")
    every = extraction.extract(u, deduplicate=False).withColumn("n", F.row_number().over(w)).where("n = 1").select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, every.collect())) and got.count() == 4
    by_speaker = lambda text, speaker: F.filter(F.array(F.struct(F.lit("fact").alias("memory_type"), F.when(speaker == "Bo", 0.9).otherwise(0.1).alias("base"), F.lit(0).alias("start"), F.lit("").alias("trigger"), F.lit(False).alias("marked"))), lambda x: x["base"] > 0.5)
    bo = extraction.extract(u, types=(), extra=[by_speaker]).select("speaker").collect()
    assert bo and {r["speaker"] for r in bo} == {"Bo"}  # an extractor of one's own sees every speaker of a text


def test_batches_of_several_files(spark):
    rows = spark.range(400).withColumn("r", F.xxhash64("id"))
    folder = ingest.stream_folder(rows, "several", 2, "r", 3)
    assert len(glob.glob(folder.removeprefix("file:") + "/*.parquet")) == 6
    sizes = []
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 3).parquet(folder)
    stream.writeStream.foreachBatch(lambda b, _: sizes.append((len(b.inputFiles()), b.count()))).trigger(availableNow=True).start().awaitTermination(240)
    assert len(sizes) == 2 and sum(n for _, n in sizes) == 400


def test_turns_are_cut_once_for_both(spark):
    content = {"/a.txt": "Ann: We decided to use kafka.\nBo: Hm.", "/b.txt": "prose\nAnn: Hi", "/c.txt": "---\ntitle: x\n", "/d.md": "# Notes\nprose\n- **Ann**: A risk.", "/e.csv": "Owner,Action\nAnn,do it", "/f.json": "nope", "/g.xyz": "?"}
    files = transcripts._described(spark.createDataFrame(list(content.items()), "path string, content string"))
    for given in (files, files.withColumn("problem", F.when(F.col("path") == "/e.csv", "the member is broken"))):
        said, wrong = transcripts.parse_and_problems(given)
        assert sorted(map(str, said.collect())) == sorted(map(str, transcripts.parse(given).collect()))
        assert sorted(wrong.collect()) == sorted(transcripts.problems(given).collect())
        assert {r["path"] for r in wrong.collect()} >= {"/b.txt", "/c.txt", "/f.json", "/g.xyz"}


def test_a_log_entry_is_read_once_and_new_ones_are_seen(spark, tmp_path):
    mine, other = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    row = lambda i: spark.createDataFrame([(f"m{i}", "x")], "meeting_id string, title string")
    mine.append("meetings", row(1), "meeting_id")
    assert other.read("meetings").count() == 1 and len(other._entries) == 1
    mine.append("meetings", row(2), "meeting_id")
    assert other.read("meetings").count() == 2 and len(other._entries) == 2
    other.compact()
    assert len(mine.log()) == 1 and mine.read("meetings").count() == 2
