"""Queries over stores that they build themselves from the sample tables: imports, growth of the graph, streams, deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import quote
from ..operators import graph, growth, index, retrieval
from ..operators import intelligence as insight
from ..operators import store as S
from ..operators.extraction import extract
from ..shared import fresh_dir, materialize
from ..sources.transcripts import _described
from ..streaming import ingest
from . import sample
from .registry import _ALL, _EDGE, _MEETING, _MORE, _NEAR, _RECURRING, _SYM, _search_sql, query
from .sample import GRAPH_SQL

NOW = "2024-03-01T00:00:00+00:00"


def new_store(spark: SparkSession) -> S.Store:
    return S.Store(spark, fresh_dir(spark, "stores"))


# ---- imports


def _talks(spark: SparkSession, sf_dir: str, which, folder: str = "talks", extra: str = "") -> DataFrame:
    """Conversations for which `which` holds as text files of a folder, with `extra` said at their ends."""
    files = sample.conversation_files(spark, sf_dir, formats=("txt",)).where(which)
    said = F.concat("content", F.lit(extra)) if extra else F.col("content")
    named = F.concat(F.lit(f"/{folder}/conv"), F.col("conv_id").cast("string"), F.lit(".txt"))
    return _described(files.select(named.alias("path"), said.alias("content")))


_IMPORTS: dict[tuple[str, str], tuple[S.Store, DataFrame]] = {}


def _imports(spark: SparkSession, sf_dir: str) -> tuple[S.Store, DataFrame]:
    """A store after five imports, and what each file came to in each; kept once a session and folder.

    1: conversations whose number is even. 2: all of them (the even ones are known), with copies of those divisible by 6
    under other names, and other texts for those divisible by 10 in another folder, whose meetings are taken; every
    seventh file begins with prose. 3: a dry run of the same. Then the meetings divisible by 4 are deleted, and those
    divisible by 3 lose their first utterance's memories. 4: those divisible by 4, with more text. 5: all of them again.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _IMPORTS:
        return _IMPORTS[key]
    store, k, done = new_store(spark), F.col("conv_id"), []

    def run(step: int, files: DataFrame, dry_run: bool = False) -> None:
        found = ingest.import_files(_described(files.select("path", "content")), store, NOW, dry_run=dry_run)
        done.append(materialize(found, "outcomes").select(F.lit(step).alias("step"), "path", "meeting_id", "status", "detail"))

    everyone = _talks(spark, sf_dir, F.lit(True))
    prose = F.when(F.regexp_extract("path", r"(\d+)", 1).cast("int") % 7 == 1, F.concat(F.lit("prose first\n"), "content")).otherwise(F.col("content"))
    copies = _talks(spark, sf_dir, k % 6 == 0).withColumn("path", F.concat(F.lit("/talks/late"), F.regexp_extract("path", r"(\d+)", 1), F.lit(".txt")))
    other = _talks(spark, sf_dir, k % 10 == 0, "zother", "\nuser: We decided to use kafka.")
    mixed = materialize(everyone.withColumn("content", prose).unionByName(copies).unionByName(other).select("path", "content"), "files")
    run(1, _talks(spark, sf_dir, k % 2 == 0))
    run(2, mixed)
    run(3, mixed, dry_run=True)
    number = F.regexp_extract("meeting_id", r"(\d+)", 1).cast("int")
    store.delete_meetings(store.meetings().where(number % 4 == 0).select("meeting_id"))
    store.delete(store.memories().where((number % 3 == 0) & (F.col("utterance_index") == 0)).select("memory_id"), 1)
    run(4, _talks(spark, sf_dir, k % 4 == 0, extra="\nuser: We decided to use redis."))
    run(5, everyone)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    _IMPORTS[key] = store, out
    return _IMPORTS[key]


# prose at the head of a front matter makes its fence a line of prose, so such a file has no turns before it
_OUTCOMES = """c AS (SELECT DISTINCT conv_id AS k FROM conversations), bad AS (SELECT k, k % 7 = 1 AS b FROM c),
o AS (SELECT 1 AS step, '/talks/conv' || k || '.txt' AS path, 'conv' || k AS meeting_id, 'success' AS status, NULL AS detail FROM c WHERE k % 2 = 0
UNION ALL SELECT 2, '/talks/conv' || k || '.txt', CASE WHEN b THEN NULL ELSE 'conv' || k END, CASE WHEN b THEN 'failure' WHEN k % 2 = 0 THEN 'skipped' ELSE 'success' END, CASE WHEN b THEN 'a line stands before any turn' END FROM bad
UNION ALL SELECT 2, '/talks/late' || k || '.txt', 'conv' || k, 'skipped', NULL FROM c WHERE k % 6 = 0
UNION ALL SELECT 2, '/zother/conv' || k || '.txt', 'conv' || k, 'failure', 'meeting conv' || k || ' is stored with other content' FROM c WHERE k % 10 = 0
UNION ALL SELECT 3, '/talks/conv' || k || '.txt', CASE WHEN b THEN NULL ELSE 'conv' || k END, CASE WHEN b THEN 'failure' ELSE 'skipped' END, CASE WHEN b THEN 'a line stands before any turn' END FROM bad
UNION ALL SELECT 3, '/talks/late' || k || '.txt', 'conv' || k, 'skipped', NULL FROM c WHERE k % 6 = 0
UNION ALL SELECT 3, '/zother/conv' || k || '.txt', 'conv' || k, 'failure', 'meeting conv' || k || ' is stored with other content' FROM c WHERE k % 10 = 0
UNION ALL SELECT 4, '/talks/conv' || k || '.txt', 'conv' || k, 'success', NULL FROM c WHERE k % 4 = 0
UNION ALL SELECT 5, '/talks/conv' || k || '.txt', 'conv' || k, CASE WHEN k % 4 = 0 THEN 'failure' WHEN k % 2 = 0 OR k % 7 <> 1 THEN 'skipped' ELSE 'success' END, CASE WHEN k % 4 = 0 THEN 'meeting conv' || k || ' is stored with other content' END FROM c)"""


@query("import_outcomes", f"WITH {_OUTCOMES} SELECT step, path, meeting_id, status, detail FROM o", base=False)
def import_outcomes(spark, sf_dir):
    return _imports(spark, sf_dir)[1]


@query("import_statuses", f"""WITH {_OUTCOMES} SELECT step, CASE WHEN failure > 0 AND n > failure THEN 'partial' WHEN failure > 0 THEN 'failure' ELSE 'success' END AS status, success, skipped, failure FROM (SELECT step, count(*) AS n,
  count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'failure') AS failure FROM o GROUP BY 1)""", base=False)
def import_statuses(spark, sf_dir):
    rows = _imports(spark, sf_dir)[1]
    out = None
    for step in range(1, 6):
        row = ingest.import_status(rows.where(F.col("step") == step)).select(F.lit(step).alias("step"), "*")
        out = row if out is None else out.unionByName(row)
    return out


@query("meetings_after_imports", """WITH f AS (SELECT conv_id AS k, role, min(turn) AS t, max(turn) AS u FROM conversations GROUP BY 1, 2),
  m AS (SELECT k, 7.0::DOUBLE * (max(u) - min(t)) AS duration_seconds, string_agg(role, ',' ORDER BY t) AS participants FROM f GROUP BY 1)
  SELECT 'conv' || k AS meeting_id, 'Talk ' || k AS title, '2024-02-03' AS date, duration_seconds, participants || CASE WHEN k % 4 = 0 AND NOT contains(',' || participants || ',', ',user,') THEN ',user' ELSE '' END AS participants FROM m""", base=False)
def meetings_after_imports(spark, sf_dir):
    """Each conversation once, those divisible by 4 as they came after their deletion."""
    meetings = _imports(spark, sf_dir)[0].meetings()
    return meetings.select("meeting_id", "title", "date", "duration_seconds", F.array_join("participants", ",").alias("participants"))


# ---- the graph grown by batches

_GRAPHS: dict[tuple[str, str], tuple[S.Store, list[int]]] = {}


def _grown(spark: SparkSession, sf_dir: str) -> tuple[S.Store, list[int]]:
    """A store whose graph was grown in three batches of meetings that lie between each other, kept once a session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _GRAPHS:
        _, mem, meet = sample.store(spark, sf_dir)
        store, commits = new_store(spark), []
        for k in range(3):
            mine = meet.where(F.substring("date", 9, 2).cast("int") % 3 == k)
            growth.grow(store, mem.join(mine.select("meeting_id"), "meeting_id", "left_semi"), mine)
            commits.append(store.log()[-1][0])
        _GRAPHS[key] = store, commits
    return _GRAPHS[key]


def _alle_of(k: int) -> str:
    """All edges of the meetings of the first k + 1 batches, built at once."""
    day = "CAST(substr({0}, 9, 2) AS INT) % 3 <= {1}"
    return f"(WITH mem AS (SELECT * FROM mem0 WHERE {day.format('meeting_date', k)}), meet AS (SELECT * FROM meet0 WHERE {day.format('date', k)}), {GRAPH_SQL}, {_ALL} SELECT {_EDGE} FROM alle)"


_GROWN = f"mem0 AS (SELECT * FROM mem), meet0 AS (SELECT * FROM meet), a0 AS {_alle_of(0)}, a1 AS {_alle_of(1)}, a2 AS {_alle_of(2)}"
_IDS = "sha1(concat_ws(chr(31), source_id, relationship, target_id, discriminator)) AS edge_id"


@query("graph_growth", f"""SELECT b AS batch, relationship, CAST(sum(added) AS BIGINT) AS added, CAST(sum(removed) AS BIGINT) AS removed FROM (SELECT 0 AS b, relationship, 1 AS added, 0 AS removed FROM a0
  UNION ALL SELECT 1, relationship, 1, 0 FROM (SELECT * FROM a1 EXCEPT SELECT * FROM a0) UNION ALL SELECT 1, relationship, 0, 1 FROM (SELECT * FROM a0 EXCEPT SELECT * FROM a1)
  UNION ALL SELECT 2, relationship, 1, 0 FROM (SELECT * FROM a2 EXCEPT SELECT * FROM a1) UNION ALL SELECT 2, relationship, 0, 1 FROM (SELECT * FROM a1 EXCEPT SELECT * FROM a2)) GROUP BY 1, 2""", more=_GROWN)
def graph_growth(spark, sf_dir):
    """How many edges of each kind each batch added and took back."""
    store, commits = _grown(spark, sf_dir)
    out = None
    for k, commit in enumerate(commits):
        part = growth.changes(store, commit).select(F.lit(k).alias("batch"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@query("edge_ids_all", f"SELECT {_IDS}, relationship FROM alle", more=f"{GRAPH_SQL}, {_ALL}")
def edge_ids_all(spark, sf_dir):
    """The edges of the graph that was grown by batches are those of one that is built at once."""
    return _grown(spark, sf_dir)[0].graph()[1].select("edge_id", "relationship")


@query("edge_summary_all", "SELECT relationship, count(*) AS n FROM alle GROUP BY 1", more=f"{GRAPH_SQL}, {_ALL}")
def edge_summary_all(spark, sf_dir):
    """Edges by kind of the graph that was grown by batches."""
    return _grown(spark, sf_dir)[0].graph()[1].groupBy("relationship").agg(F.count("*").alias("n"))


@query("neighbors_depth2_all", "SELECT node_id, distance FROM near", more=f"{GRAPH_SQL}, {_ALL}, {_SYM.format('alle')}, {_NEAR.format('technology:postgres')}")
def neighbors_depth2_all(spark, sf_dir):
    """Neighbours by the stored edges, pairs of resolves among them."""
    return graph.neighbors(_grown(spark, sf_dir)[0].graph()[1], ["technology:postgres"], 2)


# ---- streams


def _tasks(spark: SparkSession) -> int:
    """Files of a batch: as many as a shuffle has partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@query("stream_import", "SELECT meeting_id, memory_type, utterance_index, speaker, confidence, content_hash FROM c4")
def stream_import(spark, sf_dir):
    """Utterances in four shuffled batches, imported as a stream, come to the memories of one batch job."""
    u, _, _ = sample.store(spark, sf_dir)
    rows = u.withColumns({"at": F.to_timestamp("meeting_date"), "deal": F.xxhash64("meeting_id", "utterance_index")})
    files = _tasks(spark)
    folder = ingest.stream_folder(rows, "utterances", 4, "deal", files)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder).drop("deal")
    store = new_store(spark)
    ingest.import_stream(stream, store, f"{store.path}/checkpoint", NOW, late="400 days").awaitTermination()
    return store.memories().select("meeting_id", "memory_type", "utterance_index", "speaker", "confidence", "content_hash")


@query("stream_type_counts", "SELECT meeting_date AS day, memory_type, count(*) AS n FROM c2 GROUP BY 1, 2")
def stream_type_counts(spark, sf_dir):
    """Memories by day and type, counted over a stream of three shuffled batches; the last count of each stands."""
    u, _, _ = sample.store(spark, sf_dir)
    rows = u.withColumns({"ts": F.to_timestamp("meeting_date"), "deal": F.xxhash64("utterance_index", "meeting_id")})
    files = _tasks(spark)
    folder = ingest.stream_folder(rows, "utterances", 3, "deal", files)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder).drop("deal")
    out = fresh_dir(spark, "counts")

    def keep(batch: DataFrame, number: int) -> None:
        batch.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "memory_type", "n", F.lit(number).alias("batch")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    counts = ingest.type_counts(stream, late="400 days")
    counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{fresh_dir(spark, 'checkpoints')}").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("day", "memory_type").agg(F.max_by("n", "batch").alias("n"))


# ---- what the sample meetings have no row for


def _reworked_context(spark: SparkSession, sf_dir: str) -> insight.Context:
    """The context with each decision superseded by the next one of its content, months apart: each day counts as nine."""
    _, mem, meet = sample.store(spark, sf_dir)
    far = lambda c: F.date_add(F.lit("2020-01-01").cast("date"), (F.datediff(F.to_date(c), F.lit("2024-01-01").cast("date")) * 9).cast("int")).cast("string")
    w = Window.partitionBy("content_hash").orderBy("meeting_date", "meeting_id", "memory_id")
    by = F.when(F.col("memory_type") == "decision", F.lead("memory_id").over(w))
    return insight.context(mem.withColumn("superseded_by", by).withColumn("status", F.lit("active")), meet.withColumn("date", far(F.col("date"))))


_FAR = "datediff('day', DATE '2024-01-01', CAST({0} AS DATE)) * 9"


@query("long_running_decisions", f"""SELECT 'decision-longrunning-' || trim(regexp_replace(lower(tip), '[^a-z0-9]+', '-', 'g'), '-') AS insight_id, 'long_running_decision' AS type, CASE WHEN span >= 180 THEN 'critical' WHEN span >= 90 THEN 'high' ELSE 'medium' END AS severity, CAST(span AS DOUBLE) AS metric FROM (
  SELECT content_hash, arg_max(memory_id, (meeting_date, meeting_id, memory_id)) AS tip, max({_FAR.format('meeting_date')}) - min({_FAR.format('meeting_date')}) AS span, count(*) AS n FROM mem WHERE memory_type = 'decision' GROUP BY 1) WHERE span >= 30 AND n > 1""")
def long_running_decisions(spark, sf_dir):
    return insight.decision_insights(_reworked_context(spark, sf_dir))[1].select("insight_id", "type", "severity", "metric")


@query("cadence_recommendation", f"""SELECT 'rec-meeting-cadence' AS recommendation_id, 'medium' AS priority, 'Meeting cadence appears ineffective' AS title, 'Across ' || total_meetings || ' meetings only ' || format('{{:.2f}}', productivity)
  || ' decisions/commitments were produced per meeting; consider tightening agendas or cadence.' AS detail FROM (SELECT {_MEETING.replace(' FROM ctx', " FROM (SELECT * FROM ctx WHERE memory_type IN ('risk', 'question'))").replace('(SELECT count(*) FROM rec)', '0')}) WHERE total_meetings >= 3 AND productivity < 0.5""", more=_RECURRING)
def cadence_recommendation(spark, sf_dir):
    """An analysis of risks and questions alone, in which meetings decide nothing."""
    _, mem, meet = sample.store(spark, sf_dir)
    c = insight.context(mem, meet, memory_types=["risk", "question"])
    found = insight.recommendations(c, insight.risk_insights(c, insight.project_metrics(mem, meet))[0])
    return found.where("recommendation_id = 'rec-meeting-cadence'").select("recommendation_id", "priority", "title", "detail")


@query("long_quotes", "SELECT memory_id, '“' || CASE WHEN length(t) > 80 THEN rtrim(t[:79]) || '…' ELSE t END || '”' AS quoted FROM (SELECT memory_id, trim(regexp_replace(text || '  ' || text, '\\s+', ' ', 'g')) AS t FROM mem)")
def long_quotes(spark, sf_dir):
    _, mem, _ = sample.store(spark, sf_dir)
    return mem.select("memory_id", quote(F.concat_ws("  ", "text", "text")).alias("quoted"))


# ---- deduplication by confidence, and search by an index


def _varied(rows: DataFrame) -> DataFrame:
    """Memories before deduplication, with confidences that differ between equal ones of a meeting, as a store's rows."""
    less = F.col("utterance_index") % 40 / F.lit(1000.0)
    rows = rows.withColumn("confidence", F.round(F.col("confidence") - less, 3))
    return rows.select("memory_id", "meeting_id", "content_hash", "confidence", F.lit(NOW).alias("created_at"))


@query("dedup_within_threshold", "SELECT memory_id FROM vkept", more="""v AS (SELECT meeting_id, content_hash, memory_id, round(confidence - utterance_index % 40 / 1000.0::DOUBLE, 3) AS c, row_number() OVER (PARTITION BY meeting_id, content_hash ORDER BY memory_id) AS i
  FROM (SELECT meeting_id, meeting_id || ':' || memory_type || ':' || utterance_index AS memory_id, sha256(memory_type || chr(10) || norm) AS content_hash, confidence, utterance_index FROM c2)),
fold(meeting_id, content_hash, i, kept, ids) AS (SELECT meeting_id, content_hash, CAST(1 AS BIGINT), [c], [memory_id] FROM v WHERE i = 1
  UNION ALL SELECT v.meeting_id, v.content_hash, v.i, CASE WHEN len(list_filter(f.kept, lambda k: abs(k - v.c) <= 0.01)) > 0 THEN f.kept ELSE list_append(f.kept, v.c) END, CASE WHEN len(list_filter(f.kept, lambda k: abs(k - v.c) <= 0.01)) > 0 THEN f.ids ELSE list_append(f.ids, v.memory_id) END
  FROM fold f JOIN v ON v.meeting_id = f.meeting_id AND v.content_hash = f.content_hash AND v.i = f.i + 1),
vkept AS (SELECT meeting_id, content_hash, unnest(ids) AS memory_id FROM (SELECT meeting_id, content_hash, arg_max(ids, i) AS ids FROM fold GROUP BY 1, 2))""", recursive=True)
def dedup_within_threshold(spark, sf_dir):
    """Of equal memories of a meeting, those more than a hundredth from all kept before them."""
    rows = _varied(extract(sample.event_utterances(spark, sf_dir), deduplicate=False))
    return S.deduplicate(rows, 0.01).select("memory_id")


def _indexed(name: str, q: retrieval.Query, terms: list[str], where: str) -> None:
    @query(name, "SELECT memory_id, score FROM found", more=_search_sql(terms, where))
    def search(spark, sf_dir):
        """A search that reads the blocks that the trigram index names."""
        _, mem, meet = sample.store(spark, sf_dir)
        built = index.build(mem, meet, fresh_dir(spark, "indexes"), block_rows=256)
        return built.search(q)[0].select("memory_id", F.round("score", 6).alias("score"))


_indexed("search_indexed", retrieval.Query("risk dependency atlas"), ["dependency", "atlas"], "memory_type = 'risk'")
_indexed("search_indexed_customer", retrieval.Query("acme5 usage"), ["acme5", "usage"], "true")


# ---- providers and exporters by registry


@query("provided_insights", "SELECT CASE category WHEN 'project' THEN 'risk' ELSE category END AS provider, insight_id FROM ins WHERE category IN ('risk', 'project') UNION ALL SELECT 'meetings', 'meetings-' || count(*) FROM meet", more=_MORE, recursive=True)
def provided_insights(spark, sf_dir):
    """An analysis of risks alone: the providers for commitments and decisions decline it, and one registered for it takes part."""
    _, mem, meet = sample.store(spark, sf_dir)
    c = insight.context(mem, meet, memory_types=["risk"])
    count = c.meetings.agg(F.count("*").alias("n"))
    own = insight.Provider(lambda c, p: insight._insight(count, "meetings", "meeting", F.lit("low"), F.lit("Meetings"), F.lit(""), F.col("n"), F.lit(None).cast("string"), F.lit("meetings"), F.col("n").cast("string")), lambda f: f.meetings > 0)
    insight.register("insights", "meetings", own, replace=True)
    try:
        tables = insight.provided("insights", c, insight.project_metrics(mem, meet), insight.facts(c))
    finally:
        insight.unregister("insights", "meetings")
    out = None
    for name, parts in tables.items():
        for part in parts:
            row = part.select(F.lit(name).alias("provider"), "insight_id")
            out = row if out is None else out.unionByName(row)
    return out


@query("activity_report", """SELECT 'activity' AS part, memory_type AS place, '- ' || replace(memory_type, '_', ' ') || ': ' || count(*) || ', ' || count(*) FILTER (status = 'active') || ' active, in ' || count(DISTINCT meeting_id) || ' meetings' AS line FROM ctx GROUP BY memory_type""")
def activity_report(spark, sf_dir):
    _, mem, meet = sample.store(spark, sf_dir)
    c = insight.context(mem, meet)
    return insight.report_lines(c, mem, insight.facts(c))


@query("export_by_ending", """SELECT 'memories.csv' AS path, 'memory_id,meeting_id,memory_type,status,speaker,confidence,text' AS line UNION ALL SELECT 'memories.csv', concat_ws(',', memory_id, meeting_id, memory_type, status, speaker, printf('%.4f', confidence), text) FROM mem
  UNION ALL SELECT 'graph.gv', line FROM (SELECT unnest(['digraph memory_graph {', '  rankdir=LR;', '}']) AS line UNION ALL SELECT '  "' || node_id || '" [label="meeting: ' || label || '"];' FROM (SELECT 'meeting:' || meeting_id AS node_id, coalesce(title, meeting_id) AS label FROM meet))""")
def export_by_ending(spark, sf_dir):
    """Lines of two exports, chosen by their paths' endings: all memories, and a drawing of the meetings alone."""
    from ..operators import exports

    _, mem, meet = sample.store(spark, sf_dir)
    nodes = meet.select(F.concat(F.lit("meeting:"), "meeting_id").alias("node_id"), F.lit("meeting").alias("node_type"), F.coalesce("title", "meeting_id").alias("label"))
    edges = graph.collaboration_edges(meet).limit(0)
    tables = {"memories": mem, "meetings": meet, "nodes": nodes, "edges": edges}
    lines = lambda path: exports.exporter_for(path).lines(tables).select(F.lit(path).alias("path"), "line")
    return lines("memories.csv").unionByName(lines("graph.gv"))
