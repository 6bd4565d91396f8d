"""The meeting operators on hand-made rows and files."""

import zipfile

import pytest
from pyspark.sql import functions as F

from quorumlens.functions import text as T
from quorumlens.operators import exports, extraction, graph, retrieval, store
from quorumlens.operators import intelligence as insight
from quorumlens.sources import transcripts
from quorumlens.streaming.ingest import import_files, watch

NOTES = """---
Title: Project Atlas Weekly
date: 2026-02-03
team: Core
---
[00:00:05] Ana: We decided to build Atlas on postgres.
[00:00:20] **Ben**: I will write the runbook by Friday.
  and share it.

Ana (00:01:00): There is a risk that Project Atlas might delay.
Ben: Should we hire at 10:30?
"""


def one(spark, expr, **kw):
    return spark.createDataFrame([tuple(kw.values())], list(kw)).select(expr).first()[0]


@pytest.mark.parametrize(("raw", "seconds"), [("00:01:23", 83.0), ("1:02", 62.0), ("[00:00:05]", 5.0), ("7", 7.0), ("0:00:01.5", 1.5), ("x", None), ("1:75", None)])
def test_timestamps(spark, raw, seconds):
    assert one(spark, T.timestamp_seconds(F.col("x")), x=raw) == seconds


def test_text_functions(spark):
    row = spark.createDataFrame([(" Café--Ünit_1,  OK! now ", "Ana  Lee: ", "2026-01-01", "2026-01-31", "junk")], "a string, s string, d string, e string, j string").select(
        T.normalize_text(F.col("a")).alias("n"), T.slugify(F.col("a")).alias("slug"), T.normalize_speaker(F.lit("**Ana Lee**:")).alias("who"), T.days_between(F.col("d"), F.col("e")).alias("days"),
        T.days_between(F.col("j"), F.col("e")).alias("none"), T.timestamp_label(F.lit(3661.5)).alias("label"), T.slugify(F.lit("!!")).alias("unknown"), T.derive_meeting_id(F.lit("/x/a.b.txt"), F.lit("t")).alias("id"),
    ).first()
    assert (row.n, row.who, row.days, row.none, row.label, row.unknown, row.id) == ("café ünit_1 ok now", "Ana Lee", 30, 0, "01:01:01.500", "unknown", "a.b")
    levels = spark.createDataFrame([(v,) for v in (0, 2, 4, 6)], "v int").select(T.severity(F.col("v"), 2, 4, 6)).collect()
    assert [r[0] for r in levels] == ["low", "medium", "high", "critical"]


def test_extraction(spark):
    said = ["We decided to ship.", "I'll send it by Friday.", "It is assigned to Dana Roe before next meeting", "This might fail.", "😀 there is a risk", "Can we go?", "Revenue grew 12%.", "nothing", None, "we decided to ship!"]
    u = spark.createDataFrame([("m", i, "Ana", t) for i, t in enumerate(said)], "meeting_id string, utterance_index int, speaker string, text string")
    got = {r.memory_id: r for r in extraction.extract(u).collect()}
    assert got["m:decision:0"].confidence == 0.95 and "m:decision:9" not in got
    c = got["m:commitment:1"]
    assert (c.owner, c.due, c.confidence, c.trigger) == ("Ana", "by Friday", 0.95, "I'll")
    assert (got["m:commitment:2"].owner, got["m:commitment:2"].due) == ("Dana Roe", "before next meeting")
    assert got["m:risk:3"].confidence == 0.65
    assert (got["m:risk:4"].evidence_start, got["m:risk:4"].evidence_end) == (13, 17)
    assert got["m:question:5"].confidence == 0.95 and got["m:question:5"].evidence_end == 10
    assert got["m:fact:6"].confidence == 0.75
    assert extraction.extract(u, types=["risk"]).count() == 2 and extraction.extract(u, min_confidence=0.9).count() == 4
    checked = extraction.problems(extraction.extract(u).withColumn("confidence", F.when(F.col("memory_type") == "risk", 2.0).otherwise(F.col("confidence"))), u)
    assert checked.where("problem is not null").count() == 2


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("transcripts")
    (d / "weekly.txt").write_text(NOTES)
    (d / "notes.md").write_text("# Head\n\n- **Ana**: We agreed on kafka.\nJust prose without a turn\n* Ben: ok\n")
    (d / "items.csv").write_text('Owner,Action\nAna,"send, then ""wait"""\n,skip\nBen,call\n')
    (d / "talk.json").write_text('{"title": "T", "date": "2026-03-01", "utterances": [{"name": "Ana", "content": "hi", "time": 61}, {"speaker": "Ben", "text": "yes"}]}')
    (d / "list.json").write_text('[{"speaker": "Cy", "message": "bare"}]')
    (d / "early.txt").write_text("prose first\nAna: hi\n")
    (d / "bad.json").write_text("{")
    (d / "x.pdf").write_text("?")
    return d


def test_readers(spark, files):
    read = transcripts.read_files(spark, str(files))
    rows = transcripts.parse(read).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.meeting_id, r.utterance_index)):
        by.setdefault(r.meeting_id, []).append((r.speaker, r.timestamp, r.text))
    assert by["weekly"] == [("Ana", 5.0, "We decided to build Atlas on postgres."), ("Ben", 20.0, "I will write the runbook by Friday. and share it."), ("Ana", 60.0, "There is a risk that Project Atlas might delay."), ("Ben", None, "Should we hire at 10:30?")]
    assert by["notes"] == [("Ana", None, "We agreed on kafka."), ("Ben", None, "ok")]
    assert by["items"] == [("Ana", None, 'send, then "wait"'), ("Ben", None, "call")]
    assert by["talk"] == [("Ana", 61.0, "hi"), ("Ben", None, "yes")] and by["list"] == [("Cy", None, "bare")]
    head = next(r for r in rows if r.meeting_id == "weekly")
    assert (head.title, head.meeting_date, head.extra) == ("Project Atlas Weekly", "2026-02-03", {"team": "Core"})
    assert {(r.path.rsplit("/", 1)[-1], r.problem) for r in transcripts.problems(read).collect()} == {("early.txt", "a line stands before any turn"), ("bad.json", "not JSON"), ("x.pdf", "unknown format")}
    m = {r.meeting_id: r for r in transcripts.meetings_of(transcripts.parse(read)).collect()}
    assert m["weekly"].duration_seconds == 55.0 and m["talk"].duration_seconds == 0.0 and m["notes"].duration_seconds is None


def test_zip(spark, files, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.write(files / "weekly.txt", "deep/weekly.txt")
        z.write(files / "talk.json", "talk.json")
    read = transcripts.read_zip(spark, str(tmp_path / "a.zip"))
    assert {r.path for r in read.collect()} == {"a.zip:deep/weekly.txt", "a.zip:talk.json"}
    assert {r.meeting_id for r in transcripts.parse(read).collect()} == {"weekly", "a.zip:talk"}


def test_import_is_incremental(spark, files, tmp_path):
    s = store.Store(spark, f"{tmp_path}/store")
    read = transcripts.read_files(spark, str(files), pattern="*.txt")
    import_files(read, s, "2026-03-01T00:00:00+00:00")
    n, m = s.memories().count(), s.meetings().count()
    import_files(transcripts.read_files(spark, str(files)), s, "2026-03-02T00:00:00+00:00")
    assert m == 1 and s.meetings().count() == 5 and s.memories().count() > n
    assert s.memories().where("created_at like '2026-03-01%'").count() == n
    watch(spark, str(files), store.Store(spark, f"{tmp_path}/stream"), f"{tmp_path}/check", "2026-03-01T00:00:00+00:00").awaitTermination(120)
    assert store.Store(spark, f"{tmp_path}/stream").meetings().count() == 5
    change = spark.createDataFrame([("weekly:decision:0", 1, "archived", None, "t1"), ("weekly:decision:0", 2, "resolved", "x", "t2")], "memory_id string, seq int, status string, superseded_by string, at string")
    s.set_status(change)
    r = s.memories().where("memory_id = 'weekly:decision:0'").first()
    assert (r.status, r.superseded_by, r.updated_at) == ("resolved", None, "t2")


@pytest.fixture(scope="module")
def small(spark):
    cols = "memory_id string, meeting_id string, memory_type string, text string, speaker string, confidence double, utterance_index int, status string, created_at string, updated_at string, content_hash string, owner string, due string, superseded_by string, metadata map<string,string>"
    at = "2026-01-02T09:00:00+00:00"

    def row(i, meeting, kind, text, who="Ana", conf=0.8, status="active", owner=None, due=None, by=None):
        return (i, meeting, kind, text, who, conf, 1, status, at, "2026-01-05T09:00:00+00:00", text, owner, due, by, {"trigger": "x"})

    rows = [
        row("d1", "m1", "decision", "Project Atlas on postgres", conf=0.95, status="superseded", by="d2"), row("d2", "m2", "decision", "Project Atlas on redis", status="superseded", by="d3"), row("d3", "m3", "decision", "Project Atlas on kafka"),
        row("r1", "m1", "risk", "risk of delay for Project Atlas", "Ben", 0.6), row("r2", "m3", "risk", "risk of delay for Project Atlas", "Ben", 0.6), row("q1", "m1", "question", "Should Project Atlas wait?"),
        row("c1", "m2", "commitment", "I will fix Project Atlas", owner="Ben", due="2026-01-10"), row("c2", "m1", "commitment", "old thing", status="deleted"), row("o1", "m3", "open_loop", "Project Atlas pending"),
    ]
    meet = [("m1", "Atlas start", "2026-01-02", ["Ana", "Ben"], at), ("m2", "Mid", "2026-02-10", ["Ana"], at), ("m3", "End", "2026-03-20", ["Ben", "Cy"], at)]
    return spark.createDataFrame(rows, cols).cache(), spark.createDataFrame(meet, "meeting_id string, title string, date string, participants array<string>, created_at string").cache()


def test_store_queries(small):
    mem, meet = small
    ids = lambda **kw: [r.memory_id for r in store.select(mem, meet, store.MemoryQuery(**kw)).collect()]
    assert ids(memory_types=["decision"], order_by="confidence", descending=True) == ["d1", "d2", "d3"]
    assert ids(date_from="2026-02-01", date_to="2026-02-28") == ["c1", "d2"] and ids(limit=2, offset=1) == ["c2", "d1"]
    with pytest.raises(ValueError, match="order"):
        ids(order_by="colour")
    risks = mem.where("memory_type = 'risk'")  # one content in two meetings, which are not compared
    assert store.deduplicate(risks).count() == 2 and store.deduplicate(risks.withColumn("meeting_id", F.lit("m1"))).count() == 1
    close = risks.withColumn("meeting_id", F.lit("m1")).withColumn("confidence", F.when(F.col("memory_id") == "r2", 0.9).otherwise(0.6))
    assert store.deduplicate(close, 0.1).count() == 2 and store.deduplicate(close, 0.5).count() == 1


def test_retrieval(small):
    mem, meet = small
    p = retrieval.plan(retrieval.Query("Open loops and risks that Ana raised in January about postgres"), ["Ana"], ["Ben"])
    assert (p.memory_types, p.speakers, p.months, p.terms) == ({"open_loop", "risk"}, {"Ana"}, {1}, ("raised", "postgres"))
    top = retrieval.retrieve(mem, meet, retrieval.Query("decisions postgres"), explain=True).first()
    assert top.memory_id == "d1" and [r.kind for r in top.reasons] == ["type", "keyword"]
    assert top.score == pytest.approx(0.3 + 0.15 + 0.2 * 0.95 + 0.15 + 0.1 * 0.3)
    assert [r.memory_id for r in retrieval.timeline(mem, meet, retrieval.Query("risk", participants=["Cy"])).collect()] == ["r2"]
    assert [r.memory_id for r in retrieval.latest(mem, meet, 1).collect()] == ["d3"]


def test_graph(small):
    mem, meet = small
    e = graph.edges(mem, meet).cache()
    have = {(r.source_id, r.relationship, r.target_id) for r in e.collect()}
    assert {("question:q1", "relates_to", "decision:d1"), ("risk:r1", "blocks", "project:atlas"), ("commitment:c1", "resolves", "risk:r1"), ("decision:d2", "supersedes", "decision:d1"), ("risk:r2", "connected_to", "risk:r1"), ("person:ana", "connected_to", "person:ben"), ("memory:o1", "discussed_in", "meeting:m3"), ("project:atlas", "depends_on", "technology:kafka")} <= have
    assert ("commitment:c1", "resolves", "risk:r2") not in have
    assert {r.memory_id: r.n for r in graph.resolves_counts(mem, meet).collect()} == {"c1": 1}
    assert graph.find_path(e, "question:q1", "risk:r2") == ["question:q1", "decision:d1", "project:atlas", "risk:r2"] or len(graph.find_path(e, "question:q1", "risk:r2")) == 3
    near = {r.node_id: r.distance for r in graph.neighbors(e, ["decision:d1"], 1, ["supersedes"]).collect()}
    assert near == {"decision:d1": 0, "decision:d2": 1}
    assert [r.ids for r in graph.chains(mem.where("memory_type = 'decision'")).collect()] == [["d1", "d2", "d3"]]
    assert graph.lineage(e, "decision:d1") == ["decision:d1", "decision:d2", "decision:d3"]
    drawn = {r.line for r in exports.mermaid_lines(graph.nodes(mem, meet), e).collect()}
    assert "graph TD" in drawn and any("supersedes" in x for x in drawn)


def test_intelligence(small):
    mem, meet = small
    c = insight.context(mem, meet)
    assert c.memories.count() == 8
    projects = insight.project_metrics(mem, meet)
    p = projects.where("project_id = 'project:atlas'").first()
    assert (p.risk_count, p.blocker_count, p.decision_count) == (4, 2, 6)
    k = insight.commitment_metrics(c).first()
    assert (k.total, k.open, k.overdue, k.top_owner) == (1, 1, 1, "Ben")
    found = insight.insights(c, projects).cache()
    kinds = {r.type: r for r in found.collect()}
    assert {"repeatedly_superseded_decision", "long_running_decision", "recurring_risk", "long_lived_risk", "overdue_commitment", "unresolved_risk", "risk_hotspot", "project_blocker"} <= set(kinds)
    assert kinds["overdue_commitment"].metric == 69.0 and kinds["overdue_commitment"].severity == "critical"
    assert insight.evidence(c, found).where("insight_id like 'risk-recurring%'").count() == 2
    assert insight.recommendations(c, found).where("priority = 'urgent'").count() >= 1
    assert 0 <= insight.health(c, projects).first().overall <= 1
    data = exports.report(found, insight.health(c, projects), insight.recommendations(c, found))
    assert exports.report_markdown(data).startswith("# Report") and '"health"' in exports.report_json(data)
    assert [r.total for r in insight.replay(mem, meet).orderBy("position").collect()] == [4, 6, 9]
