import pytest

from quorumlens.operators.recovery import export_snapshot, read_snapshot
from quorumlens.operators.replay import Session, select_meetings

MEMORY = "memory_id string, meeting_id string, memory_type string, text string, speaker string"
MEETING = "meeting_id string, title string, date string, participants array<string>"


@pytest.fixture(scope="module")
def tables(spark):
    memories = spark.createDataFrame([("a", "m1", "risk", "Atlas may slip", "Ana"), ("b", "m2", "fact", "x", None), ("c", "m2", "risk", "y", "Ben")], MEMORY)
    return memories, spark.createDataFrame([("m1", "One", "2026-01-01", ["Ana"]), ("m2", None, "2026-02-01", ["Cy"]), ("m3", "On Atlas", None, [])], MEETING)


def test_replay(tables):
    ids = lambda **kw: sorted(r.meeting_id for r in select_meetings(*tables, **kw).collect())
    assert ids(project="atlas") == ["m1", "m3"] and ids(person="BEN") == ["m2"] and ids(date_from="2026-01-15") == ["m2"] and ids(date="2026-01-01") == ["m1"]
    s = Session(*tables)
    assert [s.step().meeting_id, s.step().total] == ["m3", 1] and s.step().total == 3 and s.step() is None
    s.seek(1)
    assert [r.meeting_id for r in s.run()] == ["m1", "m2"]
    s.reset()
    assert s.step().position == 1


def test_snapshot(spark, tables, tmp_path):
    path = f"{tmp_path}/snap"
    export_snapshot({"memories": tables[0], "meetings": tables[1]}, path)
    schemas = {"memories": MEMORY, "meetings": MEETING}
    back = read_snapshot(spark, path, schemas)
    assert sorted(back["memories"].collect(), key=str) == sorted(tables[0].collect(), key=str) and back["meetings"].count() == 3
    tables[0].limit(1).write.mode("append").json(f"{path}/memories")
    with pytest.raises(ValueError, match="manifest"):
        read_snapshot(spark, path, schemas)
