"""The store's commit log, imports that collide, are deleted and come again, and a stream of shuffled utterances."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from quorumlens.operators import store
from quorumlens.operators.extraction import extract
from quorumlens.sources import transcripts
from quorumlens.streaming import ingest

NOW = "2026-02-01T00:00:00+00:00"


@pytest.fixture
def s(spark, tmp_path):
    return store.Store(spark, f"{tmp_path}/store")


def files(spark, **said):
    rows = [(f"/in/{name.replace('__', '/')}.txt", text) for name, text in said.items()]
    return transcripts._described(spark.createDataFrame(rows, "path string, content string"))


def outcome(df):
    return {r["path"].removeprefix("/in/").removesuffix(".txt"): (r["status"], r["meeting_id"]) for r in df.collect()}


def stored(s):
    return {r["meeting_id"]: r["participants"] for r in s.meetings().collect()}, sorted((r["memory_id"], r["speaker"]) for r in s.memories().collect())


def test_two_transcripts_are_not_merged(spark, s):
    ingest.import_files(files(spark, upload="Ana: We decided to use kafka."), s, NOW)
    got = ingest.import_files(files(spark, other__upload="Bo: hello there.\nBo: We decided to use redis instead."), s, NOW)
    row = got.first()
    assert (row["status"], row["detail"], row["memories"]) == ("failure", "meeting upload is stored with other content", None)
    assert stored(s) == ({"upload": ["Ana"]}, [("upload:decision:0", "Ana")])


def test_what_hangs_on_other_files(spark, s):
    """In order of paths: b has a's content, so c gets meeting m; e has m's place taken, so f's content is still new."""
    batch = files(spark, a__k="Ana: one.", b__m="Ana: one.", c__m="Ana: two.", d__m="Ana: three.", e__m="Ana: four.", f__n="Ana: four.", g__n="Ana: five.", h__o="", i__p="no turn here")
    want = {"a/k": ("success", "k"), "b/m": ("skipped", "k"), "c/m": ("success", "m"), "d/m": ("failure", "m"), "e/m": ("failure", "m"), "f/n": ("success", "n"), "g/n": ("failure", "n"), "h/o": ("failure", None), "i/p": ("failure", None)}
    assert outcome(ingest.import_files(batch, s, NOW, dry_run=True)) == {k: ("dry_run" if v[0] == "success" else v[0], v[1]) for k, v in want.items()}
    assert not s._there("meetings")
    assert outcome(ingest.import_files(batch, s, NOW)) == want
    assert set(stored(s)[0]) == {"k", "m", "n"}
    again = ingest.import_files(batch, s, NOW)
    assert {v[0] for k, v in outcome(again).items() if k in ("a/k", "b/m", "c/m", "e/m", "f/n")} == {"skipped"}
    assert tuple(ingest.import_status(again).first()) == ("partial", 0, 5, 4)


def test_dry_run_counts(spark, s):
    got = ingest.import_files(files(spark, x="Ana: We decided to use kafka.\nBo: There is a risk of delay.\nBo: Hm."), s, NOW, dry_run=True)
    assert [(r["status"], r["memories"]) for r in got.collect()] == [("dry_run", 2)]
    assert ingest.import_status(got).first()["status"] == "dry_run" and ingest.import_status(got.limit(0)).first()["status"] == "success"


def test_deleted_meetings_and_memories_come_back(spark, s):
    text = {"m1": "Ana: We decided to use kafka.", "m2": "Bo: There is a risk of delay."}
    one = lambda **v: spark.createDataFrame([tuple(v.values())], ", ".join(f"{k} string" for k in v))
    ingest.import_files(files(spark, **text), s, NOW)
    s.archive(one(memory_id="m1:decision:0"), 1, "t1")
    s.delete_meetings(one(meeting_id="m1"))
    assert set(stored(s)[0]) == {"m2"} and len(stored(s)[1]) == 1
    assert outcome(ingest.import_files(files(spark, **text), s, NOW)) == {"m1": ("success", "m1"), "m2": ("skipped", "m2")}
    assert set(stored(s)[0]) == {"m1", "m2"} and len(stored(s)[1]) == 2
    assert s.memories().where("memory_id = 'm1:decision:0'").first()["status"] == "active"  # it began anew
    row = s.memories().where("memory_id = 'm2:risk:0'").collect()
    s.update(spark.createDataFrame(row, s.memories().schema).withColumn("text", F.lit("changed")), 1)
    assert s.memories().where("memory_id = 'm2:risk:0'").first()["text"] == "changed"
    s.delete(one(memory_id="m2:risk:0"), 2)
    assert s.memories().where("memory_id = 'm2:risk:0'").count() == 0
    assert s.append("memories", spark.createDataFrame(row, s.memories().schema), "memory_id") == 1
    assert s.memories().where("memory_id = 'm2:risk:0'").first()["text"] == "There is a risk of delay."
    s.resolve(one(memory_id="m2:risk:0"), 3, "t3")
    before = sorted(map(str, s.memories().collect()))
    s.compact()
    assert len(s.log()) == 1 and sorted(map(str, s.memories().collect())) == before and set(stored(s)[0]) == {"m1", "m2"}
    s.delete_meetings(one(meeting_id="m2"))
    assert set(stored(s)[0]) == {"m1"}


def test_a_lost_job_leaves_nothing(spark, s, monkeypatch):
    ingest.import_files(files(spark, m1="Ana: We decided to use kafka."), s, NOW)
    before = stored(s)

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:  # both tables are written, the log's entry is not
        m.setattr(store, "json", SimpleNamespace(dumps=lost))
        with pytest.raises(RuntimeError, match="lost"):
            ingest.import_files(files(spark, m2="Bo: There is a risk of delay."), s, NOW)
    assert stored(s) == before
    assert outcome(ingest.import_files(files(spark, m2="Bo: There is a risk of delay."), s, NOW)) == {"m2": ("success", "m2")}
    assert len(stored(s)[0]) == 2
    with pytest.raises(ValueError, match="own columns"):
        s.commit({"x": spark.range(1).withColumn("_batch", F.lit(1))})


def test_a_stream_of_shuffled_utterances(spark, s, tmp_path):
    said = ["We decided to use kafka.", "we decided to use KAFKA!", "There is a risk of delay.", "I think we decided to use kafka.", "Hm."]
    rows = [(m, i, f"P{i % 3}", said[(i * 7 + len(m)) % 5], f"2026-01-0{1 + len(m) % 3}") for m in ("m", "mm", "mmm") for i in range(12)]
    u = spark.createDataFrame(rows, "meeting_id string, utterance_index int, speaker string, text string, day string").withColumn("at", F.to_timestamp("day")).drop("day")
    folder = ingest.stream_folder(u.withColumn("r", F.xxhash64("meeting_id", "utterance_index") % 1000), "shuffled", 5, "r")
    read = lambda: spark.readStream.schema("meeting_id string, utterance_index int, speaker string, text string, at timestamp, r long").option("maxFilesPerTrigger", 1).parquet(folder).drop("r")
    ingest.import_stream(read(), s, f"{tmp_path}/check", NOW).awaitTermination(240)
    assert sum("memories" in t for _, _, t in s.log()) > 2
    columns = ["meeting_id", "memory_type", "utterance_index", "speaker", "text", "confidence", "content_hash"]
    want = extract(u).select(*columns)
    got = s.memories().select(*columns)
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() > 5
    n = len(s.log())
    ingest.import_stream(read(), s, f"{tmp_path}/check", NOW).awaitTermination(240)  # nothing new
    assert len(s.log()) == n
    ingest.import_stream(read(), s, f"{tmp_path}/check2", NOW).awaitTermination(240)  # all of it once more
    assert sorted(s.memories().select(*columns).collect()) == sorted(want.collect())
