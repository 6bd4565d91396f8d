"""Store changes, deduplication across meetings, long and odd files, traversal options, lineages and report forms."""

import pytest
from pyspark.sql import functions as F

from quorumlens.operators import exports, graph, intelligence, recovery, retrieval, store
from quorumlens.sources import transcripts
from quorumlens.streaming.ingest import import_files, import_results, import_status

MEMORY = "memory_id string, meeting_id string, memory_type string, text string, confidence double, status string, superseded_by string, content_hash string, created_at string, updated_at string"


def mem(spark, rows):
    return spark.createDataFrame([(i, m, "risk", t, c, "active", None, t, "2026-01-01", "2026-01-01") for i, m, t, c in rows], MEMORY)


def test_points_recur_across_meetings(spark):
    rows = mem(spark, [("a", "m1", "x", 0.8), ("b", "m1", "x", 0.8), ("c", "m2", "x", 0.8), ("d", "m2", "y", 0.5)])
    ids = lambda df: sorted(r["memory_id"] for r in df.collect())
    assert ids(store.deduplicate(rows)) == ["a", "c", "d"]
    assert ids(store.deduplicate(rows, stored=mem(spark, [("z", "m2", "y", 0.5), ("q", "m9", "x", 0.8)]))) == ["a", "c"]
    assert ids(store.deduplicate(rows, 0.1, stored=mem(spark, [("z", "m2", "y", 0.9)]))) == ["a", "c", "d"]


def test_a_risk_of_two_meetings_survives_import(spark, tmp_path):
    for i in (1, 2):
        (tmp_path / f"w{i}.txt").write_text(f"---\ndate: 2026-01-0{i}\n---\nAna: There is a risk of delay.\nBen: There is a risk of delay.\n")
    s = store.Store(spark, f"{tmp_path}/store")
    import_files(transcripts.read_files(spark, str(tmp_path), pattern="*.txt"), s, "2026-02-01T00:00:00+00:00")
    assert sorted(r["memory_id"] for r in s.memories().collect()) == ["w1:risk:0", "w2:risk:0"]
    c = intelligence.context(s.memories().withColumn("due", F.lit(None).cast("string")), s.meetings())
    assert [(r["meetings"], r["n"]) for r in intelligence.recurring(c.of("risk")).collect()] == [(2, 2)]


def test_changes_of_a_store(spark, tmp_path):
    s = store.Store(spark, f"{tmp_path}/store")
    assert s.append("memories", mem(spark, [("a", "m1", "x", 0.8), ("b", "m1", "y", 0.8), ("c", "m2", "z", 0.8), ("c", "m2", "z", 0.8)]), "memory_id") == 3
    assert s.append("memories", mem(spark, [("a", "m1", "later", 0.8)]), "memory_id") == 0
    one = lambda *ids: spark.createDataFrame([(i,) for i in ids], "memory_id string")
    seen = lambda: {r["memory_id"]: (r["text"], r["status"], r["superseded_by"]) for r in s.memories().collect()}
    s.archive(one("a"), 1, "t1")
    s.supersede(spark.createDataFrame([("b", "c")], "memory_id string, superseded_by string"), 1, "t1")
    assert seen() == {"a": ("x", "archived", None), "b": ("y", "superseded", "c"), "c": ("z", "active", None)}
    s.restore(one("a"), 2, "t2")
    s.resolve(one("b"), 2, "t2")
    s.mark_deleted(one("c"), 2, "t2")
    assert seen() == {"a": ("x", "active", None), "b": ("y", "resolved", None), "c": ("z", "deleted", None)}
    s.update(mem(spark, [("a", "m1", "new", 0.9)]), 3)
    s.delete(one("b"), 3)
    assert seen() == {"a": ("new", "active", None), "c": ("z", "deleted", None)}
    s.delete_meetings(spark.createDataFrame([("m2",)], "meeting_id string"))
    assert set(seen()) == {"a"}
    with pytest.raises(ValueError, match="unknown status"):
        store.transitions(one("a"), "lost", 1, "t")


def test_graph_is_stored_once(spark, tmp_path):
    s = store.Store(spark, f"{tmp_path}/store")
    nodes = lambda *rows: spark.createDataFrame(rows, "node_id string, label string")
    edges = spark.createDataFrame([("e1", "a", "b")], "edge_id string, source_id string, target_id string")
    assert s.save_graph(nodes(("a", "first"), ("b", "x")), edges) == (2, 1)
    assert s.save_graph(nodes(("a", "second"), ("c", "y")), edges) == (1, 0)
    assert {r["node_id"]: r["label"] for r in s.graph()[0].collect()} == {"a": "first", "b": "x", "c": "y"}


def test_long_csv_files(spark):
    """Records and cells are cut in one go: a hundred thousand quoted rows, and quotes that never end."""
    body = "\n".join(f'Ana,"item {i}, with ""quotes""\nand lines"' for i in range(100_000))
    rows = transcripts.parse(transcripts.from_text(spark, f"Owner,Action\n{body}", "csv"))
    assert rows.count() == 100_000
    last = rows.where("utterance_index = 99999").first()
    assert last["text"] == 'item 99999, with "quotes" and lines' and last["speaker"] == "Ana"
    odd = transcripts.parse(transcripts.from_text(spark, 'name,task,extra\nBen,"open, and on\nto the end', "csv")).collect()
    assert [(r["speaker"], r["text"]) for r in odd] == [("Ben", "open, and on to the end")]


def test_odd_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"Ana: caf\xe9\n")
    (tmp_path / "b.json").write_text('[{"speaker": "A", "text": "x", "time": true}]')
    (tmp_path / "c.txt").write_text("**Ana**: hi\nAna : ho\n")
    (tmp_path / "d.note").write_text("Zoe says something")
    read = transcripts.read_files(spark, str(tmp_path))
    wrong = transcripts.problems(read)
    assert {(r["path"].rsplit("/", 1)[1], r["problem"]) for r in wrong.collect()} == {("a.txt", "not UTF-8"), ("b.json", "a timestamp is a truth value"), ("d.note", "unknown format")}
    assert [(r["speaker"], r["aliases"]) for r in transcripts.aliases(read.where("path like '%c.txt'")).collect()] == [("Ana", ["**Ana**", "Ana"])]
    results = import_results(read, store.Store(spark, f"{tmp_path}/none"), wrong)
    assert {(r["path"].rsplit("/", 1)[1], r["status"]) for r in results.collect()} == {("a.txt", "failure"), ("b.json", "failure"), ("c.txt", "success"), ("d.note", "failure")}
    assert tuple(import_status(results).first()) == ("partial", 1, 0, 3)
    assert import_status(results.where("status = 'failure'")).first()["status"] == "failure"


def test_readers_can_be_added(spark):
    def notes(files):
        whole = files.select(F.lit("n").alias("meeting_id"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("meeting_date"), F.create_map().cast("map<string,string>").alias("extra"), F.lit("Zoe").alias("speaker"), F.lit(0).alias("utterance_index"), F.lit(None).cast("double").alias("timestamp"), F.col("content").alias("text"), "path", "transcript_hash")
        return whole

    transcripts.register(".note", "note", notes)
    try:
        assert [r["text"] for r in transcripts.parse(transcripts.from_text(spark, "anything", "note")).collect()] == ["anything"]
    finally:
        del transcripts.READERS["note"], transcripts.FORMATS["note"]


def test_traversal_options(spark):
    e = spark.createDataFrame([("meeting:m1", "person:a"), ("meeting:m1", "project:x"), ("risk:r", "project:x"), ("risk:r", "person:b")], "source_id string, target_id string").withColumns({"relationship": F.lit("mentions"), "edge_id": F.lit("")})
    ids = lambda df: [r["node_id"] for r in df.orderBy("node_id").collect()]
    assert ids(graph.neighbors(e, ["project:x"], 2, node_types=["person"])) == ["person:a", "person:b"]
    assert ids(graph.neighbors(e, ["project:x"], 2, limit=2)) == ["meeting:m1", "person:a"]
    assert ids(graph.related(e, "project:x", graph.MEMORY_NODES)) == ["risk:r"] and ids(graph.related(e, "project:x", limit=1)) == ["meeting:m1"]


def test_long_and_ringed_lineages(spark):
    line = [(f"d{i + 1:03d}", f"d{i:03d}") for i in range(300)]
    ring = [("r1", "r2"), ("r2", "r3"), ("r3", "r1")]
    fork = [("f3", "f1"), ("f3", "f2")]
    e = spark.createDataFrame([*line, *ring, *fork], "source_id string, target_id string").withColumn("relationship", F.lit("supersedes"))
    got = {}
    for r in graph.lineages(e).collect():
        got.setdefault(r["component"], {})[r["position"]] = r["node_id"]
    order = {k: [v[i] for i in range(len(v))] for k, v in got.items()}
    assert order == {"d000": [f"d{i:03d}" for i in range(300, -1, -1)], "r1": ["r1", "r2", "r3"], "f1": ["f3", "f1"]}
    assert graph.decision_lineage(e, "f2") == ["f1", "f3"] and graph.lineage(e, "alone") == ["alone"]


def test_weights_of_a_search(spark):
    m = mem(spark, [("a", "m1", "red risk", 0.1), ("b", "m1", "red", 0.9)]).withColumns({"speaker": F.lit("Ana"), "utterance_index": F.lit(0), "metadata": F.lit(None).cast("map<string,string>")})
    meet = spark.createDataFrame([("m1", "T", "2026-01-01", ["Ana"])], "meeting_id string, title string, date string, participants array<string>")
    only = lambda part: {k: float(k == part) for k in ("text", "phrase", "confidence", "recency", "status", "meeting")}
    first = lambda part: retrieval.retrieve(m, meet, retrieval.Query("red sky"), weights=only(part), names=((), ())).count()
    assert first("confidence") == 0  # every term must be there
    rows = retrieval.retrieve(m, meet, retrieval.Query("red"), weights=only("confidence"), names=((), ())).collect()
    assert [(r["memory_id"], r["score"]) for r in rows] == [("b", 0.9), ("a", 0.1)]
    u = spark.createDataFrame([("m1", i, "Ana", f"u{i}") for i in range(3)], "meeting_id string, utterance_index int, speaker string, text string")
    one = retrieval.explain(m, meet, u, "a").first()
    assert one["score"] == pytest.approx(0.3 + 0.15 + 0.02 + 0.15 + 0.1 + 0.1) and [x["text"] for x in one["after"]] == ["u1", "u2"]
    assert [r["kind"] for r in one["reasons"]] == ["speaker", "type", "status"] and retrieval.explain(m, meet, u, "none").count() == 0


def test_reports():
    data = {"health": {"overall": 0.5}, "insights": [{"severity": "high", "title": "A <b>", "detail": "d", "category": "risk"}, {"severity": "low", "title": "P", "detail": "d", "category": "person"}], "recommendations": [], "projects": [{"project_id": "p", "name": "Atlas", "risk_count": 2}], "people": [{"name": "Ana", "open_commitments": 1}]}
    assert "Atlas: risk count 2" in exports.report_markdown(data) and "Ana: open commitments 1" in exports.report_text(data)
    page = exports.report_html(data)
    assert "A &lt;b&gt;" in page and "P: d" not in page and "P: d" in exports.report_text(data)


def test_snapshot_into_a_store(spark, tmp_path):
    rows = mem(spark, [("a", "m1", "x", 0.8), ("b", "m1", "y", 0.8)])
    recovery.export_snapshot({"memories": rows}, f"{tmp_path}/snap")
    s = store.Store(spark, f"{tmp_path}/store")
    load = lambda: recovery.restore_snapshot(spark, f"{tmp_path}/snap", {"memories": MEMORY}, s, {"memories": "memory_id"})
    assert load() == {"memories": 2} and load() == {"memories": 0} and s.memories().count() == 2


def test_parts_stand_in_every_match():
    """The strings that rules are tried for are parts of what their patterns match."""
    from quorumlens.functions import rules as R

    said = {
        "decision": ["we've decided", "we agreed", "the decision is", "final call", "lets go with", "approved", "we will use", "we'll go with"],
        "commitment": ["assigned to", "I will", "please take", "please follow up", "we will", "can you", "by friday", "before next meeting"],
        "open_loop": ["needs to be decided", "to be determined", "unresolved", "TBD", "open question", "still open", "follow-up", "circle back", "pending"],
        "risk": ["blocker", "could fail", "risky", "concerned", "dependencies", "delaying", "bottleneck"],
        "assumption": ["based on the assumption", "we're assuming", "assumes", "if this holds", "presumably"],
        "question": ["question is", "can we", "should we", "do we", "what about"],
        "fact": ["clients", "must have", "capped", "milestone", "ARR", "versions"],
    }
    import re

    for kind, rules in R.RULES.items():
        assert len(rules) == len(R.PARTS[kind]) == len(said[kind])
        for (pattern, _), parts, text in zip(rules, R.PARTS[kind], said[kind]):
            assert re.search(pattern, text, re.I) and any(p in text.lower() for p in parts), (kind, text)
