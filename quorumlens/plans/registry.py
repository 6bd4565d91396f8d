"""Queries over the sample meetings, each with the DuckDB SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.text import content_hash, normalize_text, severity, word_count
from ..operators import extraction, graph, retrieval, store
from ..operators.exports import LABEL
from ..operators import intelligence as insight
from ..sources.utterances import conversation_utterances
from . import sample
from .sample import BASE_SQL, GRAPH_SQL, _SLUG

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str = "", base: bool = True, more: str = "", recursive: bool = False):
    """Register a query; sql selects from the CTEs of BASE_SQL (and of `more`) where base is set."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = f"WITH {'RECURSIVE ' * recursive}{BASE_SQL}{', ' + more if more else ''} {sql}" if base else sql
        return f

    return keep


# ---- utterances


@query("conversation_statistics", "SELECT CAST(conv_id AS VARCHAR) AS meeting_id, count(*) AS utterances, count(DISTINCT role) AS speakers, CAST(sum(len(regexp_extract_all(text, '\\S+'))) AS BIGINT) AS words FROM conversations GROUP BY 1", base=False)
def conversation_statistics(spark, sf_dir):
    u = conversation_utterances(spark, sf_dir)
    return u.groupBy("meeting_id").agg(F.count("*").alias("utterances"), F.countDistinct("speaker").alias("speakers"), F.sum(word_count(F.col("text"))).cast("long").alias("words"))


@query("speaker_word_counts", "SELECT role AS speaker, count(*) AS turns, CAST(sum(len(regexp_extract_all(text, '\\S+'))) AS BIGINT) AS words FROM conversations GROUP BY 1", base=False)
def speaker_word_counts(spark, sf_dir):
    u = conversation_utterances(spark, sf_dir)
    return u.groupBy("speaker").agg(F.count("*").alias("turns"), F.sum(word_count(F.col("text"))).cast("long").alias("words"))


@query("normalize_text", "SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS normal FROM conversations", base=False)
def normalized(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.select("conv_id", "turn", normalize_text(F.col("text")).alias("normal"))


@query("speaker_order", "SELECT CAST(conv_id AS VARCHAR) AS meeting_id, string_agg(role, ',' ORDER BY t) AS speakers FROM (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY 1, 2) GROUP BY 1", base=False)
def speaker_order(spark, sf_dir):
    u = conversation_utterances(spark, sf_dir)
    first = u.groupBy("meeting_id", "speaker").agg(F.min("utterance_index").alias("t"))
    names = F.transform(F.array_sort(F.collect_list(F.struct("t", "speaker"))), lambda x: x["speaker"])
    return first.groupBy("meeting_id").agg(F.array_join(names, ",").alias("speakers"))


@query("content_hash", "SELECT meeting_id, utterance_index, sha256('fact' || chr(10) || trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))) AS h FROM u")
def hashes(spark, sf_dir):
    u, _, _ = sample.store(spark, sf_dir)
    return u.select("meeting_id", "utterance_index", content_hash(F.lit("fact"), F.col("text")).alias("h"))


@query("line_split_utterances", "SELECT conv_id, turn, i AS line_no, ls[i] AS line FROM (SELECT conv_id, turn, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS ls FROM conversations)) WHERE trim(ls[i]) <> ''", base=False)
def lines(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = c.select("conv_id", "turn", F.posexplode(F.split("text", "\n", -1)).alias("p", "line")).where(F.trim("line") != "")
    return rows.select("conv_id", "turn", (F.col("p") + 1).cast("long").alias("line_no"), "line")


# ---- extraction

_MEMORY = ("memory_id", "text", "speaker", "confidence", "trigger", "evidence_start", "evidence_end", "owner", "due")

for _kind in R.TYPES:

    @query(f"extract_{_kind}", f"SELECT {', '.join(_MEMORY)} FROM mem WHERE memory_type = '{_kind}'")
    def _extract(spark, sf_dir, kind=_kind):
        return sample.store(spark, sf_dir)[1].where(F.col("memory_type") == kind).select(*_MEMORY)


@query("extraction_counts", "SELECT memory_type, count(*) AS n FROM c2 GROUP BY 1")
def extraction_counts(spark, sf_dir):
    return extraction.extract(sample.event_utterances(spark, sf_dir), deduplicate=False).groupBy("memory_type").agg(F.count("*").alias("n"))


@query("extraction_dedup", "SELECT meeting_id, memory_type, count(*) AS n, max(confidence) AS best FROM c3 GROUP BY 1, 2")
def extraction_dedup(spark, sf_dir):
    return extraction.extract(sample.event_utterances(spark, sf_dir)).groupBy("meeting_id", "memory_type").agg(F.count("*").alias("n"), F.max("confidence").alias("best"))


# ---- store


@query("memory_filter", "SELECT memory_id, confidence FROM mem WHERE memory_type IN ('risk', 'decision') AND status IN ('active', 'superseded') AND speaker IN ('Person1', 'Person2', 'Person3') AND confidence >= 0.5")
def memory_filter(spark, sf_dir):
    _, mem, meet = sample.store(spark, sf_dir)
    q = store.MemoryQuery(memory_types=["risk", "decision"], statuses=["active", "superseded"], speakers=["Person1", "Person2", "Person3"], min_confidence=0.5)
    return store.select(mem, meet, q, ordered=False).select("memory_id", "confidence")


@query("memory_date_range", "SELECT memory_id FROM mem WHERE meeting_date BETWEEN '2024-01-10' AND '2024-01-12'")
def memory_date_range(spark, sf_dir):
    _, mem, meet = sample.store(spark, sf_dir)
    return store.select(mem, meet, store.MemoryQuery(date_from="2024-01-10", date_to="2024-01-12"), ordered=False).select("memory_id")


@query("memory_page", "SELECT memory_id, confidence FROM mem ORDER BY confidence DESC, memory_id LIMIT 25 OFFSET 50")
def memory_page(spark, sf_dir):
    _, mem, meet = sample.store(spark, sf_dir)
    return store.select(mem, meet, store.MemoryQuery(order_by="confidence", descending=True, limit=25, offset=50)).select("memory_id", "confidence")


@query("store_stats", f"SELECT 'type' AS kind, t AS name, count(memory_id) AS n FROM (SELECT unnest({list(R.TYPES)}) AS t) LEFT JOIN mem ON memory_type = t GROUP BY 2 UNION ALL SELECT 'status', s, count(memory_id) FROM (SELECT unnest({list(R.STATUSES)}) AS s) LEFT JOIN mem ON status = s GROUP BY 2 UNION ALL SELECT 'total', 'memories', count(*) FROM mem UNION ALL SELECT 'total', 'meetings', count(*) FROM meet")
def store_stats(spark, sf_dir):
    _, mem, meet = sample.store(spark, sf_dir)
    return store.stats(mem, meet)


@query("storage_dedup", "SELECT memory_id, content_hash FROM mem QUALIFY row_number() OVER (PARTITION BY meeting_id, content_hash ORDER BY created_at, memory_id) = 1")
def storage_dedup(spark, sf_dir):
    return store.deduplicate(sample.store(spark, sf_dir)[1]).select("memory_id", "content_hash")


@query("latest_status", "SELECT memory_id, CASE WHEN utterance_index % 4 = 0 THEN 'archived' WHEN utterance_index % 2 = 0 THEN 'resolved' ELSE status END AS status, CASE WHEN utterance_index % 2 = 1 THEN superseded_by END AS superseded_by FROM mem")
def latest_status(spark, sf_dir):
    mem = sample.store(spark, sf_dir)[1]
    entry = lambda every, seq, status: mem.where(F.col("utterance_index") % every == 0).select("memory_id", F.lit(seq).alias("seq"), F.lit(status).alias("status"), F.lit(None).cast("string").alias("superseded_by"), F.lit("2024-03-01").alias("at"))
    return store.apply_status(mem, entry(2, 1, "resolved").unionByName(entry(4, 2, "archived"))).select("memory_id", "status", "superseded_by")


# ---- retrieval: the score's parts in SQL, for queries with terms


def _search_sql(terms: list[str], where: str = "true", dated: str = "") -> str:
    share = lambda body: " + ".join(f"CAST(contains({body}, '{t}') AS INT)" for t in terms)
    text = f"({share('own')}) / {len(terms)}.0" if terms else "1.0"
    about = f"({share('about')}) / {len(terms)}.0" if terms else "1.0"
    hit = " AND ".join(f"(contains(own, '{t}') OR contains(about, '{t}'))" for t in terms) or "true"
    phrase = f"CASE WHEN contains(lower(text), '{' '.join(terms)}') THEN 1.0 ELSE 0.0 END" if len(terms) > 1 else "1.0"
    weight = "CASE status WHEN 'active' THEN 1.0 WHEN 'resolved' THEN 0.7 WHEN 'archived' THEN 0.5 WHEN 'superseded' THEN 0.3 ELSE 0.1 END"
    return f"""bodies AS (SELECT m.*, lower(concat_ws(' ', m.text, coalesce(m.speaker, ''), concat_ws(' ', m.due, m.owner, m.trigger))) AS own,
  lower(concat_ws(' ', coalesce(meet.title, ''), array_to_string(meet.participants, ' '))) AS about FROM mem m JOIN meet USING (meeting_id) WHERE {where}),
hits AS (SELECT * FROM bodies WHERE {hit}{' AND ' + dated if dated else ''}),
days AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS place, count(*) OVER () AS days FROM (SELECT DISTINCT meeting_date AS d FROM hits)),
found AS (SELECT hits.*, round(0.3 * ({text}) + 0.15 * ({phrase}) + 0.2 * confidence + 0.15 * CASE WHEN days <= 1 THEN 1.0 ELSE place / (days - 1.0) END + 0.1 * ({weight}) + 0.1 * ({about}), 6) AS score
  FROM hits JOIN days ON d = meeting_date)"""


def _search(name: str, q: retrieval.Query, terms: list[str], where: str = "true", dated: str = "", order: str = "", columns: str = "memory_id, score"):
    @query(name, f"SELECT {columns} FROM found {order}", more=_search_sql(terms, where, dated))
    def search(spark, sf_dir):
        _, mem, meet = sample.store(spark, sf_dir)
        return retrieval.retrieve(mem, meet, q).withColumn("score", F.round("score", 6)).select(*columns.split(", "))


_search("search_ranked", retrieval.Query("risk dependency atlas"), ["dependency", "atlas"], "memory_type = 'risk'")
_search("search_and_filter", retrieval.Query("decisions postgres", statuses=["active"], min_confidence=0.6), ["postgres"], "memory_type = 'decision' AND status = 'active' AND confidence >= 0.6")
_search("search_month", retrieval.Query("kafka in january"), ["kafka"], dated="CAST(substr(meeting_date, 6, 2) AS INT) = 1")
_search("search_speaker", retrieval.Query("which redis decisions were those of person3"), ["redis"], "speaker = 'Person3' AND memory_type = 'decision'")
_search("search_participants", retrieval.Query("risk", participants=["Person3", "Person8"]), [], "memory_type = 'risk' AND list_contains(meet.participants, 'Person3') AND list_contains(meet.participants, 'Person8')")
_search("search_phrase", retrieval.Query("open loops item pending"), ["item", "pending"], "memory_type = 'open_loop'")
_search("timeline", retrieval.Query("open loops", order="chronological"), [], "memory_type = 'open_loop'")
_search("latest_n", retrieval.Query(limit=10, order="reverse_chronological"), [], order="ORDER BY meeting_date DESC, created_at DESC, memory_id LIMIT 10", columns="memory_id")


@query("context_window", "SELECT m.memory_id, coalesce(string_agg(u.text, '|' ORDER BY u.utterance_index) FILTER (u.utterance_index < m.utterance_index), '') AS before, coalesce(string_agg(u.text, '|' ORDER BY u.utterance_index) FILTER (u.utterance_index > m.utterance_index), '') AS after FROM mem m JOIN u ON u.meeting_id = m.meeting_id AND u.utterance_index BETWEEN m.utterance_index - 2 AND m.utterance_index + 2 WHERE m.memory_type = 'decision' GROUP BY 1")
def context_window(spark, sf_dir):
    u, mem, _ = sample.store(spark, sf_dir)
    out = retrieval.context(mem.where("memory_type = 'decision'"), u)
    side = lambda c: F.coalesce(F.array_join(F.transform(c, lambda x: x["text"]), "|"), F.lit("")).alias(c)
    return out.select("memory_id", side("before"), side("after"))


@query("explain_reasons", """SELECT memory_id, 'type:memory type risk' || CASE WHEN contains(own || ' ' || about, 'atlas') THEN ';keyword:keyword "atlas"' ELSE '' END || CASE WHEN status = 'active' THEN ';status:status active' ELSE '' END AS why FROM found""", more=_search_sql(["atlas"], "memory_type = 'risk' AND status = 'active'"))
def explain_reasons(spark, sf_dir):
    _, mem, meet = sample.store(spark, sf_dir)
    out = retrieval.retrieve(mem, meet, retrieval.Query("active risks atlas"), explain=True)
    return out.select("memory_id", F.array_join(F.transform("reasons", lambda r: F.concat_ws(":", r["kind"], r["detail"])), ";").alias("why"))


# ---- graph

_EDGE = "source_id, relationship, target_id, discriminator"


@query("graph_nodes", f"""SELECT node_id, min(node_type) AS node_type, min(label) AS label FROM (
  SELECT 'meeting:' || meeting_id AS node_id, 'meeting' AS node_type, coalesce(title, meeting_id) AS label FROM meet
  UNION ALL SELECT 'person:' || {_SLUG('name')}, 'person', name FROM (SELECT name FROM part UNION ALL SELECT speaker FROM mem UNION ALL SELECT owner FROM mem) WHERE name <> ''
  UNION ALL SELECT mt || ':' || memory_id, mt, text FROM mem
  UNION ALL SELECT entity_id, kind, name FROM ment UNION ALL SELECT entity_id, kind, name FROM tment) GROUP BY 1""", more=GRAPH_SQL)
def graph_nodes(spark, sf_dir):
    _, mem, meet = sample.store(spark, sf_dir)
    return graph.nodes(mem, meet).drop("ref_id")


@query("edges_structural", f"SELECT {_EDGE} FROM edge", more=GRAPH_SQL)
def edges_structural(spark, sf_dir):
    _, mem, meet = sample.store(spark, sf_dir)
    return graph.structural_edges(mem, meet)


_SEMANTIC = """SELECT DISTINCT a.mt || ':' || a.memory_id AS source_id, CASE a.memory_type WHEN 'question' THEN 'relates_to' ELSE 'supports' END AS relationship,
  'decision:' || d.memory_id AS target_id, '' AS discriminator FROM ment a JOIN ment d ON a.meeting_id = d.meeting_id AND a.entity_id = d.entity_id WHERE a.memory_type IN ('question', 'assumption') AND d.memory_type = 'decision'"""


@query("edges_semantic", _SEMANTIC, more=GRAPH_SQL)
def edges_semantic(spark, sf_dir):
    return graph.semantic_edges(sample.store(spark, sf_dir)[1])


_REPEATED = """SELECT mt || ':' || memory_id AS source_id, 'connected_to' AS relationship, b AS target_id, 'repeated_content' AS discriminator FROM (SELECT *,
  lag(mt || ':' || memory_id) OVER w AS b, lag(meeting_id) OVER w AS bm FROM mem WINDOW w AS (PARTITION BY content_hash ORDER BY meeting_date, meeting_id, memory_id)) WHERE bm <> meeting_id"""


@query("edges_repeated_content", _REPEATED)
def edges_repeated_content(spark, sf_dir):
    _, mem, meet = sample.store(spark, sf_dir)
    return graph.repeated_content_edges(mem, meet)


_RESOLVES = """SELECT DISTINCT c.memory_id, i.mt || ':' || i.memory_id AS issue FROM (SELECT * FROM ment JOIN meet USING (meeting_id)) c
  JOIN (SELECT * FROM ment JOIN meet USING (meeting_id)) i ON c.entity_id = i.entity_id AND c.date >= i.date WHERE c.memory_type = 'commitment' AND i.memory_type IN ('risk', 'open_loop')"""


@query("edges_resolves", f"SELECT 'commitment:' || memory_id AS source_id, 'resolves' AS relationship, issue AS target_id, '' AS discriminator FROM ({_RESOLVES})", more=GRAPH_SQL)
def edges_resolves(spark, sf_dir):
    _, mem, meet = sample.store(spark, sf_dir)
    return graph.resolves_edges(mem, meet)


@query("resolves_counts", f"SELECT memory_id, count(issue) AS n FROM (SELECT DISTINCT memory_id FROM ment WHERE memory_type = 'commitment') LEFT JOIN ({_RESOLVES}) USING (memory_id) GROUP BY 1", more=GRAPH_SQL)
def resolves_counts(spark, sf_dir):
    _, mem, meet = sample.store(spark, sf_dir)
    return graph.resolves_counts(mem, meet)


_COLLABORATION = f"SELECT 'person:' || {_SLUG('a.name')} AS source_id, 'connected_to' AS relationship, 'person:' || {_SLUG('b.name')} AS target_id, a.meeting_id AS discriminator FROM part a JOIN part b ON a.meeting_id = b.meeting_id AND a.name < b.name"


@query("edges_collaboration", _COLLABORATION, more=GRAPH_SQL)
def edges_collaboration(spark, sf_dir):
    return graph.collaboration_edges(sample.store(spark, sf_dir)[2])


_ALL = f"""res AS ({_RESOLVES}), alle AS (SELECT {_EDGE} FROM edge UNION {_SEMANTIC} UNION {_REPEATED} UNION {_COLLABORATION}
  UNION SELECT 'decision:' || n.memory_id, 'supersedes', 'decision:' || o.memory_id, '' FROM mem o JOIN mem n ON n.memory_id = o.superseded_by
  UNION SELECT 'commitment:' || memory_id, 'resolves', issue, '' FROM res)"""
_SYM = "sym AS (SELECT DISTINCT source_id AS a, target_id AS b FROM {0} UNION SELECT target_id, source_id FROM {0})"
_NEAR = "near1 AS (SELECT DISTINCT b FROM sym WHERE a = '{0}'), near2 AS (SELECT DISTINCT b FROM sym WHERE a IN (SELECT b FROM near1)), near AS (SELECT node_id, min(d) AS distance FROM (SELECT '{0}' AS node_id, 0 AS d UNION ALL SELECT b, 1 FROM near1 UNION ALL SELECT b, 2 FROM near2) GROUP BY 1)"


@query("edge_summary", "SELECT relationship, count(*) AS n FROM alle GROUP BY 1", more=f"{GRAPH_SQL}, {_ALL}")
def edge_summary(spark, sf_dir):
    """Edges by kind; those of `resolves` are counted without being made."""
    _, mem, meet = sample.store(spark, sf_dir)
    total = graph.resolves_counts(mem, meet).agg(F.lit("resolves").alias("relationship"), F.sum("n").alias("n")).where("n > 0")
    return graph.edges(mem, meet, resolves=False).groupBy("relationship").agg(F.count("*").alias("n")).unionByName(total)


@query("node_summary", f"SELECT node_type, count(*) AS n FROM (SELECT DISTINCT node_id, node_type FROM (SELECT 'meeting:' || meeting_id AS node_id, 'meeting' AS node_type FROM meet UNION ALL SELECT 'person:' || {_SLUG('name')}, 'person' FROM (SELECT name FROM part UNION ALL SELECT speaker FROM mem UNION ALL SELECT owner FROM mem) WHERE name <> '' UNION ALL SELECT mt || ':' || memory_id, mt FROM mem UNION ALL SELECT entity_id, kind FROM ment UNION ALL SELECT entity_id, kind FROM tment)) GROUP BY 1", more=GRAPH_SQL)
def node_summary(spark, sf_dir):
    _, mem, meet = sample.store(spark, sf_dir)
    return graph.nodes(mem, meet).groupBy("node_type").agg(F.count("*").alias("n"))


@query("edge_ids", "SELECT sha1(concat_ws(chr(31), source_id, relationship, target_id, discriminator)) AS edge_id, relationship FROM alle", more=f"{GRAPH_SQL}, {_ALL}")
def edge_ids(spark, sf_dir):
    _, mem, meet = sample.store(spark, sf_dir)
    return graph.edges(mem, meet).select("edge_id", "relationship")


@query("neighbors_depth2", "SELECT node_id, distance FROM near", more=f"{GRAPH_SQL}, {_ALL}, {_SYM.format('alle')}, {_NEAR.format('technology:postgres')}")
def neighbors_depth2(spark, sf_dir):
    _, mem, meet = sample.store(spark, sf_dir)
    return graph.neighbors_of_all(mem, meet, ["technology:postgres"], 2)


@query("related_people", "SELECT node_id, distance FROM near WHERE distance > 0 AND starts_with(node_id, 'person:')", more=f"{GRAPH_SQL}, {_ALL}, {_SYM.format('alle')}, {_NEAR.format('customer:acme5')}")
def related_people(spark, sf_dir):
    _, mem, meet = sample.store(spark, sf_dir)
    return graph.related_of_all(mem, meet, "customer:acme5", ("person",))


@query("related_memories", "SELECT node_id, distance FROM near WHERE distance > 0 AND split_part(node_id, ':', 1) IN ('decision', 'commitment', 'memory', 'risk', 'assumption', 'question', 'fact') ORDER BY node_id LIMIT 40", more=f"{GRAPH_SQL}, {_ALL}, {_SYM.format('alle')}, {_NEAR.format('technology:kafka')}")
def related_memories(spark, sf_dir):
    """The first 40 by id, as the limit of related() has it."""
    _, mem, meet = sample.store(spark, sf_dir)
    return graph.related_of_all(mem, meet, "technology:kafka", graph.MEMORY_NODES, limit=40)


_LAST = lambda kind: f"(SELECT '{kind}:' || max(memory_id) FROM mem WHERE memory_type = '{kind}')"


def _last_node(mem: DataFrame, kind: str) -> str:
    return f"{kind}:{mem.where(F.col('memory_type') == kind).agg(F.max('memory_id')).first()[0]}"


@query("outgoing_edges", f"SELECT {_EDGE} FROM alle WHERE source_id IN ('project:atlas', {_LAST('commitment')})", more=f"{GRAPH_SQL}, {_ALL}")
def outgoing_edges(spark, sf_dir):
    """Of a project, and of a commitment with what it resolves."""
    _, mem, meet = sample.store(spark, sf_dir)
    ask = lambda node: graph.outgoing(graph.edges_of(mem, meet, node), node).drop("edge_id")
    return ask("project:atlas").unionByName(ask(_last_node(mem, "commitment")))


@query("incoming_edges", f"SELECT {_EDGE} FROM alle WHERE target_id IN ('project:atlas', {_LAST('risk')})", more=f"{GRAPH_SQL}, {_ALL}")
def incoming_edges(spark, sf_dir):
    """Of a project, and of a risk with what resolves it."""
    _, mem, meet = sample.store(spark, sf_dir)
    ask = lambda node: graph.incoming(graph.edges_of(mem, meet, node), node).drop("edge_id")
    return ask("project:atlas").unionByName(ask(_last_node(mem, "risk")))


@query("shortest_path", "SELECT unnest(range(0, 3)) AS place, unnest(p) AS node_id FROM (SELECT min([s.a, s.b, t.b]) AS p FROM sym s JOIN sym t ON t.a = s.b WHERE s.a = 'person:person1' AND t.b = 'project:borealis')", more=f"{GRAPH_SQL}, {_ALL}, {_SYM.format('alle')}")
def shortest_path(spark, sf_dir):
    _, mem, meet = sample.store(spark, sf_dir)
    path = graph.find_path_of_all(mem, meet, "person:person1", "project:borealis") or []
    return spark.createDataFrame(list(enumerate(path)), "place long, node_id string")


@query("path_by_resolution", f"""SELECT unnest(range(0, 2)) AS place, unnest([a, b]) AS node_id FROM (SELECT min(b) AS b, any_value(a) AS a FROM sym WHERE a = {_LAST('commitment')} AND starts_with(b, 'risk:'))""", more=f"{GRAPH_SQL}, {_ALL}, {_SYM.format('alle')}")
def path_by_resolution(spark, sf_dir):
    """From the last commitment to the first risk that it resolves: one step that only a resolves edge makes."""
    _, mem, meet = sample.store(spark, sf_dir)
    source = _last_node(mem, "commitment")
    risk = graph.edges_of(mem, meet, source).where("source_id = '%s' and target_id like 'risk:%%'" % source.replace("'", "''")).agg(F.min("target_id")).first()[0]
    path = (graph.find_path_of_all(mem, meet, source, risk) or []) if risk else []
    return spark.createDataFrame(list(enumerate(path)), "place long, node_id string")


@query("subgraph_edges", """SELECT DISTINCT source_id, relationship, target_id, discriminator FROM alle WHERE source_id IN (SELECT node_id FROM near WHERE distance < 2) OR target_id IN (SELECT node_id FROM near WHERE distance < 2)""", more=f"{GRAPH_SQL}, {_ALL}, {_SYM.format('alle')}, {_NEAR.format('customer:acme5')}")
def subgraph_edges(spark, sf_dir):
    """The edges that lead to everything within two steps of a customer."""
    _, mem, meet = sample.store(spark, sf_dir)
    return graph.subgraph(graph.edges(mem, meet), ["customer:acme5"], 2)[1].drop("edge_id")


@query("supersession_lineages", "SELECT min(n) OVER (PARTITION BY start) AS component, n AS node_id, max(k) OVER (PARTITION BY start) - k AS position FROM (SELECT start, 'decision:' || tip AS n, k FROM wl)", more="""md AS (SELECT memory_id, superseded_by FROM mem WHERE memory_type = 'decision'),
wl AS (SELECT memory_id AS start, memory_id AS tip, superseded_by AS nxt, CAST(1 AS BIGINT) AS k FROM md WHERE superseded_by IS NOT NULL AND memory_id NOT IN (SELECT superseded_by FROM md WHERE superseded_by IS NOT NULL)
  UNION ALL SELECT w.start, d.memory_id, d.superseded_by, w.k + 1 FROM wl w JOIN md d ON d.memory_id = w.nxt)""", recursive=True)
def supersession_lineages(spark, sf_dir):
    return graph.lineages(graph.supersedes_edges(sample.store(spark, sf_dir)[1]))


@query("connected_components", """SELECT content_hash, count(DISTINCT c) AS parts, count(*) AS n FROM (SELECT content_hash, sum(fresh) OVER (PARTITION BY content_hash ORDER BY meeting_date, meeting_id, memory_id) AS c
  FROM (SELECT *, CASE WHEN lag(meeting_id) OVER (PARTITION BY content_hash ORDER BY meeting_date, meeting_id, memory_id) <> meeting_id THEN 0 ELSE 1 END AS fresh FROM mem)) GROUP BY 1""")
def connected_components(spark, sf_dir):
    _, mem, meet = sample.store(spark, sf_dir)
    node = mem.select(graph.memory_node().alias("node_id"), "content_hash")
    e = graph.repeated_content_edges(mem, meet).withColumn("edge_id", F.lit(""))
    found = graph.connected_components(node.select("node_id"), e)
    return node.join(found, "node_id").groupBy("content_hash").agg(F.countDistinct("component").alias("parts"), F.count("*").alias("n"))


@query("connected_components_all", """SELECT node_id, component FROM cc""", more=f"""{GRAPH_SQL}, {_ALL}, {_SYM.format('alle')}, gnode AS (SELECT 'meeting:' || meeting_id AS node_id FROM meet UNION SELECT mt || ':' || memory_id FROM mem
  UNION SELECT 'person:' || {_SLUG('name')} FROM (SELECT name FROM part UNION ALL SELECT speaker FROM mem UNION ALL SELECT owner FROM mem) WHERE name <> '' UNION SELECT entity_id FROM ment UNION SELECT entity_id FROM tment),
cc(node_id, component) USING KEY (node_id) AS (SELECT node_id, node_id FROM gnode
  UNION (SELECT s.a, min(c.component) FROM cc c JOIN sym s ON s.b = c.node_id JOIN recurring.cc AS had ON had.node_id = s.a WHERE c.component < had.component GROUP BY s.a))""", recursive=True)
def connected_components_all(spark, sf_dir):
    _, mem, meet = sample.store(spark, sf_dir)
    # what a resolves edge joins is joined by the entity that both its ends mention
    return graph.connected_components(graph.nodes(mem, meet).select("node_id"), graph.edges(mem, meet, resolves=False))


_CHAINS = """dec AS (SELECT * FROM ctx WHERE memory_type = 'decision'),
walk AS (SELECT memory_id AS start, memory_id AS tip, superseded_by AS nxt, 1 AS k FROM dec WHERE superseded_by IS NOT NULL AND memory_id NOT IN (SELECT superseded_by FROM dec WHERE superseded_by IS NOT NULL)
  UNION ALL SELECT w.start, d.memory_id, d.superseded_by, w.k + 1 FROM walk w JOIN dec d ON d.memory_id = w.nxt)"""


@query("decision_lineage", "SELECT start, max_by(tip, k) AS latest, max(k) AS length FROM walk GROUP BY 1 HAVING max(k) > 1", more=_CHAINS, recursive=True)
def decision_lineage(spark, sf_dir):
    _, mem, meet = sample.store(spark, sf_dir)
    c = insight.context(mem, meet)
    members = graph.chain_members(c.of("decision")).groupBy("start").agg(F.max_by("memory_id", "position").alias("latest"), F.count("*").cast("int").alias("length"))
    return members.where("length > 1")


# ---- intelligence

_RECURRING = """rec AS (SELECT memory_type, content_hash, count(DISTINCT meeting_id) AS meetings, count(*) AS n, min(date) AS first, max(date) AS last, count(*) FILTER (status = 'active') AS active,
  arg_min(text, created_at || memory_id) AS text FROM ctx GROUP BY 1, 2 HAVING count(DISTINCT meeting_id) > 1)"""
_DAYS = lambda a, b: f"datediff('day', CAST({a} AS DATE), CAST({b} AS DATE))"
_SEV = lambda v, a, b, c: f"CASE WHEN {v} >= {c} THEN 'critical' WHEN {v} >= {b} THEN 'high' WHEN {v} >= {a} THEN 'medium' ELSE 'low' END"


def _context(spark, sf_dir):
    _, mem, meet = sample.store(spark, sf_dir)
    return insight.context(mem, meet), mem, meet


@query("recurring_risks", f"SELECT content_hash, meetings, n, first, last, {_DAYS('first', 'last')} AS span_days, {_SEV('meetings', 2, 4, 6)} AS severity FROM rec WHERE memory_type = 'risk'", more=_RECURRING)
def recurring_risks(spark, sf_dir):
    c, _, _ = _context(spark, sf_dir)
    return insight.recurring(c.of("risk")).select("content_hash", "meetings", "n", "first", "last", F.col("span_days").cast("long").alias("span_days"), severity(F.col("meetings"), 2, 4, 6).alias("severity"))


_TOP = lambda col, where: f"(SELECT {col} FROM ctx WHERE {where} AND {col} <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@query("decision_metrics", f"""SELECT count(*) AS total, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'superseded') AS superseded, CAST((SELECT coalesce(sum(n), 0) FROM rec WHERE memory_type = 'decision') AS BIGINT) AS revisited,
  round_even(count(*) FILTER (status = 'active') / count(*), 4) AS stability, round_even(count(*) / (SELECT n_meetings FROM ref), 4) AS density, round_even(count(*) / ((SELECT greatest(span_days, 7) FROM ref) / 7.0), 4) AS velocity_per_week,
  count(DISTINCT nullif(speaker, '')) AS distinct_owners, {_TOP('speaker', "memory_type = 'decision'")} AS top_owner FROM ctx WHERE memory_type = 'decision'""", more=_RECURRING)
def decision_metrics(spark, sf_dir):
    return insight.decision_metrics(_context(spark, sf_dir)[0])


@query("commitment_metrics", f"""SELECT count(*) AS total, count(*) FILTER (status = 'active') AS open, count(*) FILTER (status = 'resolved') AS resolved, count(*) FILTER (status = 'active' AND due IS NOT NULL AND regexp_full_match(due, '\\d{{4}}-\\d{{2}}-\\d{{2}}') AND {_DAYS('TRY_CAST(due AS DATE)', '(SELECT reference_date FROM ref)')} > 0) AS overdue, round_even(count(*) FILTER (status = 'resolved') / count(*), 4) AS resolution_rate,
  round_even(avg({_DAYS('date', '(SELECT reference_date FROM ref)')}) FILTER (status = 'active'), 2) AS avg_open_age_days, {_TOP('responsible', "memory_type = 'commitment' AND status = 'active'")} AS top_owner,
  (SELECT max(n) FROM (SELECT count(*) AS n FROM ctx WHERE memory_type = 'commitment' AND status = 'active' AND responsible <> '' GROUP BY responsible)) AS top_owner_open FROM ctx WHERE memory_type = 'commitment'""")
def commitment_metrics(spark, sf_dir):
    return insight.commitment_metrics(_context(spark, sf_dir)[0])


@query("risk_metrics", """SELECT count(*) AS total, count(*) FILTER (status = 'active') AS open, count(*) FILTER (status IN ('resolved', 'archived')) AS resolved, round_even(count(*) FILTER (status IN ('resolved', 'archived')) / count(*), 4) AS resolution_rate,
  (SELECT count(*) FROM rec WHERE memory_type = 'risk') AS recurring, (SELECT coalesce(max(meetings), 0) FROM rec WHERE memory_type = 'risk') AS max_recurrence, round_even(count(*) / (SELECT n_meetings FROM ref), 4) AS density,
  (SELECT name FROM pmet WHERE risk_count > 0 ORDER BY risk_count DESC, project_id LIMIT 1) AS hotspot_project FROM ctx WHERE memory_type = 'risk'""", more=f"{_RECURRING}, {GRAPH_SQL}")
def risk_metrics(spark, sf_dir):
    c, mem, meet = _context(spark, sf_dir)
    return insight.risk_metrics(c, insight.project_metrics(mem, meet))


_MEETING = """(SELECT n_meetings FROM ref) AS total_meetings, count(*) AS total_memories, round_even(count(*) / (SELECT n_meetings FROM ref), 4) AS avg_memories_per_meeting,
  round_even(count(*) FILTER (memory_type IN ('decision', 'commitment')) / (SELECT n_meetings FROM ref), 4) AS productivity, round_even((SELECT count(*) FROM rec) / count(DISTINCT content_hash), 4) AS repeated_discussion_rate, CAST((SELECT span_days FROM ref) AS INT) AS span_days FROM ctx"""


@query("meeting_metrics", f"SELECT {_MEETING}", more=_RECURRING)
def meeting_metrics(spark, sf_dir):
    return insight.meeting_metrics(_context(spark, sf_dir)[0])


@query("person_metrics", """SELECT name, CAST(sum(o) AS BIGINT) AS open_commitments, CAST(sum(t) AS BIGINT) AS total_commitments, CAST(sum(d) AS BIGINT) AS decisions_owned, CAST(sum(a) AS BIGINT) AS meetings_attended FROM (
  SELECT responsible AS name, CAST(status = 'active' AS INT) AS o, 1 AS t, 0 AS d, 0 AS a FROM ctx WHERE memory_type = 'commitment' AND responsible <> ''
  UNION ALL SELECT speaker, 0, 0, 1, 0 FROM ctx WHERE memory_type = 'decision' AND speaker <> '' UNION ALL SELECT unnest(participants), 0, 0, 0, 1 FROM meet) GROUP BY 1""")
def person_metrics(spark, sf_dir):
    return insight.person_metrics(_context(spark, sf_dir)[0])


@query("project_metrics", "SELECT * FROM pmet", more=GRAPH_SQL)
def project_metrics(spark, sf_dir):
    _, mem, meet = sample.store(spark, sf_dir)
    return insight.project_metrics(mem, meet)


@query("health_scores", f"""SELECT *, round_even((decision_stability + commitment_completion + risk_resolution + meeting_productivity + knowledge_reuse + cross_team_collaboration) / 6, 4) AS overall FROM (SELECT
  round_even(count(*) FILTER (memory_type = 'decision' AND status = 'active') / count(*) FILTER (memory_type = 'decision'), 4) AS decision_stability,
  round_even(count(*) FILTER (memory_type = 'commitment' AND status = 'resolved') / count(*) FILTER (memory_type = 'commitment'), 4) AS commitment_completion,
  round_even(count(*) FILTER (memory_type = 'risk' AND status IN ('resolved', 'archived')) / count(*) FILTER (memory_type = 'risk'), 4) AS risk_resolution,
  round_even(least(1.0, round_even(count(*) FILTER (memory_type IN ('decision', 'commitment')) / (SELECT n_meetings FROM ref), 4) / 3.0), 4) AS meeting_productivity,
  round_even((SELECT sum(n) FROM (SELECT count(*) AS n FROM ctx GROUP BY content_hash HAVING count(DISTINCT meeting_id) > 1)) / count(*), 4) AS knowledge_reuse,
  (SELECT round_even(count(*) FILTER (w) / count(*), 4) FROM (SELECT name, bool_or(len(participants) > 1) AS w FROM (SELECT unnest(participants) AS name, participants FROM meet) GROUP BY 1)) AS cross_team_collaboration,
  round_even((SELECT count(*) FROM (SELECT 1 FROM ctx GROUP BY content_hash HAVING count(DISTINCT meeting_id) > 1)) / count(DISTINCT content_hash), 4) AS repeated_discussion_rate,
  round_even(count(*) FILTER (memory_type = 'risk') / (SELECT n_meetings FROM ref), 4) AS risk_density,
  round_even(avg({_DAYS('substr(created_at, 1, 10)', 'substr(updated_at, 1, 10)')}) FILTER (status IN ('resolved', 'archived')), 2) AS avg_resolution_days FROM ctx)""")
def health_scores(spark, sf_dir):
    c, mem, meet = _context(spark, sf_dir)
    return insight.health(c, insight.project_metrics(mem, meet))


_QUOTED = "'“' || trim(regexp_replace(text, '\\s+', ' ', 'g')) || '”'"
_OLD = _DAYS("date", "(SELECT reference_date FROM ref)")
_INSIGHTS = f"""ins AS (
  SELECT 'risk-recurring-' || content_hash AS insight_id, 'recurring_risk' AS type, 'risk' AS category, {_SEV('meetings', 2, 4, 6)} AS severity, 'Risk recurred in ' || meetings || ' meetings' AS title,
    {_QUOTED} || ' has appeared in ' || meetings || ' meetings' || CASE WHEN active = n THEN ' and is still unresolved.' ELSE '.' END AS detail, CAST(meetings AS DOUBLE) AS metric, content_hash AS subject FROM rec WHERE memory_type = 'risk'
  UNION ALL SELECT 'decision-revisited-' || content_hash, 'revisited_decision', 'decision', {_SEV('meetings', 2, 4, 6)}, 'Decision revisited across ' || meetings || ' meetings',
    {_QUOTED} || ' was discussed in ' || meetings || ' separate meetings without a durable resolution.', meetings, content_hash FROM rec WHERE memory_type = 'decision'
  UNION ALL SELECT 'commitment-overload-' || {_SLUG('responsible')}, 'open_commitment_overload', 'person', {_SEV('count(*)', 3, 5, 8)}, responsible || ' owns ' || count(*) || ' open commitments',
    responsible || ' is responsible for ' || count(*) || ' unresolved commitments, indicating a possible workload bottleneck.', count(*), responsible FROM ctx WHERE memory_type = 'commitment' AND status = 'active' GROUP BY responsible HAVING count(*) >= 3
  UNION ALL SELECT 'decision-superseded-' || {_SLUG('tip')}, 'repeatedly_superseded_decision', 'decision', {_SEV('k - 1', 2, 3, 5)}, 'Decision changed ' || (k - 1) || ' times', {_QUOTED} || ' has been superseded ' || (k - 1) || ' times, suggesting an unsettled decision.', k - 1, tip
    FROM (SELECT start, max_by(tip, k) AS tip, max(k) AS k FROM walk GROUP BY 1) JOIN dec ON memory_id = tip WHERE k > 2
  UNION ALL SELECT 'decision-unstable', 'unstable_decisions', 'decision', 'medium', 'Decision stability is low (' || CAST(round_even(100 * a / n, 0) AS INT) || '%)', 'Only ' || a || ' of ' || n || ' decisions remain active; the rest were superseded or archived.', round_even(a / n, 4), NULL
    FROM (SELECT count(*) AS n, count(*) FILTER (status = 'active') AS a FROM dec) WHERE n >= 4 AND a / n < 0.5
  UNION ALL SELECT 'commitment-resolution', 'low_commitment_resolution', 'commitment', CASE WHEN r / n < 0.2 THEN 'high' ELSE 'medium' END, 'Commitment resolution rate is low (' || CAST(round_even(100 * r / n, 0) AS INT) || '%)', 'Only ' || r || ' of ' || n || ' commitments have been resolved across the analysed meetings.', round_even(r / n, 4), NULL
    FROM (SELECT count(*) AS n, count(*) FILTER (status = 'resolved') AS r FROM ctx WHERE memory_type = 'commitment') WHERE n >= 4 AND r / n < 0.4
  UNION ALL SELECT 'commitment-aging-' || {_SLUG('memory_id')}, 'aging_commitment', 'commitment', {_SEV(_OLD, 30, 90, 180)}, 'Commitment open for ' || {_OLD} || ' days', {_QUOTED} || ' (owner: ' || coalesce(responsible, 'unassigned') || ') has been open for ' || {_OLD} || ' days without resolution.', {_OLD}, memory_id FROM ctx WHERE memory_type = 'commitment' AND status = 'active' AND {_OLD} >= 30
  UNION ALL SELECT 'risk-unresolved-' || {_SLUG('memory_id')}, 'unresolved_risk', 'risk', {_SEV(_OLD, 30, 90, 180)}, 'Risk unresolved for ' || {_OLD} || ' days', {_QUOTED} || ' has remained open for ' || {_OLD} || ' days.', {_OLD}, memory_id FROM ctx WHERE memory_type = 'risk' AND status = 'active' AND {_OLD} >= 30
  UNION ALL SELECT 'risk-longlived-' || content_hash, 'long_lived_risk', 'risk', {_SEV(_DAYS('first', 'last'), 60, 120, 240)}, 'Risk persisted for ' || {_DAYS('first', 'last')} || ' days', {_QUOTED} || ' has been raised over a ' || {_DAYS('first', 'last')} || '-day span.', {_DAYS('first', 'last')}, content_hash FROM rec WHERE memory_type = 'risk' AND {_DAYS('first', 'last')} >= 60
  UNION ALL SELECT 'risk-hotspot-' || {_SLUG('project_id')}, 'risk_hotspot', 'project', {_SEV('risk_count', 3, 5, 8)}, name || ' is a risk hotspot', name || ' is linked to ' || risk_count || ' risks across the analysed meetings.', risk_count, project_id FROM pmet WHERE risk_count >= 3
  UNION ALL SELECT 'project-blocker-' || {_SLUG('project_id')}, 'project_blocker', 'project', {_SEV('blocker_count', 2, 4, 6)}, name || ' has recurring blockers', name || ' is blocked by ' || blocker_count || ' risks, indicating a recurring bottleneck.', blocker_count, project_id FROM pmet WHERE blocker_count >= 2)"""
_MORE = f"{_RECURRING}, {GRAPH_SQL}, {_CHAINS}, {_INSIGHTS}"


def _insights(spark, sf_dir):
    c, mem, meet = _context(spark, sf_dir)
    return c, insight.insights(c, insight.project_metrics(mem, meet))


@query("insights", "SELECT insight_id, type, category, severity, title, detail, metric, subject FROM ins", more=_MORE, recursive=True)
def insights(spark, sf_dir):
    return _insights(spark, sf_dir)[1]


@query("insight_counts", "SELECT type, severity, count(*) AS n FROM ins GROUP BY 1, 2", more=_MORE, recursive=True)
def insight_counts(spark, sf_dir):
    return _insights(spark, sf_dir)[1].groupBy("type", "severity").agg(F.count("*").alias("n"))


_ACTION = " ".join(f"WHEN '{k}' THEN '{t.replace(chr(39), chr(39) * 2)}'" for k, (t, _) in R.ACTIONS.items())
_ADVICE = " ".join(f"WHEN '{k}' THEN '{a.replace(chr(39), chr(39) * 2)}'" for k, (_, a) in R.ACTIONS.items())


@query("recommendations", f"""SELECT 'rec-' || insight_id AS recommendation_id, CASE severity WHEN 'critical' THEN 'urgent' ELSE severity END AS priority, category, severity, CASE type {_ACTION} END AS title, CASE type {_ADVICE} END || ' ' || detail AS detail FROM ins
  UNION ALL SELECT 'rec-meeting-cadence', 'medium', 'meeting', 'medium', 'Meeting cadence appears ineffective', 'Across ' || total_meetings || ' meetings only ' || format('{{:.2f}}', productivity) || ' decisions/commitments were produced per meeting; consider tightening agendas or cadence.' FROM (SELECT {_MEETING}) WHERE total_meetings >= 3 AND productivity < 0.5""", more=_MORE, recursive=True)
def recommendations(spark, sf_dir):
    c, found = _insights(spark, sf_dir)
    return insight.recommendations(c, found)


# ---- replay and exports

_TOTALS = ", ".join(f"CAST(sum(count(memory_id) FILTER (memory_type = '{t}')) OVER w AS BIGINT) AS total_{t}" for t in R.TYPES)


@query("replay_running_totals", f"SELECT meeting_id, date, meet.title, row_number() OVER w AS position, count(memory_id) AS n, CAST(sum(count(memory_id)) OVER w AS BIGINT) AS total, {_TOTALS} FROM meet LEFT JOIN (SELECT meeting_id, memory_id, memory_type FROM mem) m USING (meeting_id) GROUP BY meeting_id, date, meet.title WINDOW w AS (ORDER BY date, meeting_id)")
def replay_running_totals(spark, sf_dir):
    _, mem, meet = sample.store(spark, sf_dir)
    return insight.replay(mem, meet)


@query("memories_csv", "SELECT memory_id, meeting_id, memory_type, status, speaker, printf('%.4f', confidence) AS confidence, text FROM mem")
def memories_csv(spark, sf_dir):
    from ..operators.exports import csv_rows

    return csv_rows(sample.store(spark, sf_dir)[1])


_NODES = ORACLE_SQL["graph_nodes"].split(f"{GRAPH_SQL} ", 1)[1]
_DOT = lambda x: f"""replace(replace({x}, '\\', '\\\\'), '"', '\\"')"""


@query("graph_export_lines", f"""SELECT part, line FROM (SELECT 0 AS part, unnest(['digraph memory_graph {{', '  rankdir=LR;']) AS line UNION ALL SELECT 3, '}}'
  UNION ALL SELECT 1, '  "' || {_DOT('node_id')} || '" [label="' || {_DOT(f"node_type || ': ' || CASE WHEN length(label) > {LABEL} THEN rtrim(label[:{LABEL - 1}]) || '…' ELSE label END")} || '"];' FROM ({_NODES})
  UNION ALL SELECT 2, '  "' || source_id || '" -> "' || target_id || '" [label="' || replace(relationship, '_', ' ') || '"];' FROM alle)""", more=f"{GRAPH_SQL}, {_ALL}")
def graph_export_lines(spark, sf_dir):
    """The whole drawing: head, nodes, edges of every kind, foot."""
    from ..operators.exports import dot_lines

    _, mem, meet = sample.store(spark, sf_dir)
    return dot_lines(graph.nodes(mem, meet), graph.edges(mem, meet))


# ---- analysis over a part, evidence, checks and summaries


@query("analysis_of_a_part", "SELECT memory_type, count(*) AS n FROM ctx WHERE responsible = 'Person1' AND memory_id IN (SELECT memory_id FROM ment WHERE entity_id = 'project:borealis') GROUP BY 1", more=GRAPH_SQL)
def analysis_of_a_part(spark, sf_dir):
    _, mem, meet = sample.store(spark, sf_dir)
    return insight.context(mem, meet, person="Person1", project="Borealis").memories.groupBy("memory_type").agg(F.count("*").alias("n"))


@query("replay_of_a_part", "SELECT meeting_id FROM meet WHERE date BETWEEN '2024-01-05' AND '2024-01-20' AND (contains(lower(title), 'cobalt') OR meeting_id IN (SELECT meeting_id FROM mem WHERE contains(lower(text), 'cobalt'))) AND (list_contains(participants, 'Person2') OR meeting_id IN (SELECT meeting_id FROM mem WHERE lower(speaker) = 'person2'))")
def replay_of_a_part(spark, sf_dir):
    from ..operators.replay import select_meetings

    _, mem, meet = sample.store(spark, sf_dir)
    return select_meetings(mem, meet, date_from="2024-01-05", date_to="2024-01-20", project="Cobalt", person="person2").select("meeting_id")


@query("evidence", """SELECT insight_id, memory_id, meeting_id FROM ins JOIN ctx ON subject = memory_id WHERE type IN ('aging_commitment', 'overdue_commitment', 'unresolved_risk')
  UNION ALL SELECT insight_id, memory_id, meeting_id FROM ins JOIN ctx ON subject = content_hash AND category = memory_type
  UNION ALL SELECT insight_id, memory_id, meeting_id FROM ins JOIN ctx ON subject = responsible WHERE type = 'open_commitment_overload' AND memory_type = 'commitment' AND status = 'active'
  UNION ALL SELECT insight_id, w.tip, d.meeting_id FROM ins JOIN (SELECT start, max_by(tip, k) AS latest FROM walk GROUP BY 1) c ON c.latest = ins.subject JOIN walk w ON w.start = c.start JOIN dec d ON d.memory_id = w.tip
    WHERE type IN ('repeatedly_superseded_decision', 'long_running_decision')""", more=_MORE, recursive=True)
def evidence(spark, sf_dir):
    c, found = _insights(spark, sf_dir)
    return insight.evidence(c, found)


_DATED = "CASE WHEN memory_type = 'commitment' AND utterance_index % 4 = 0 THEN date ELSE due END"


def _dated_context(spark, sf_dir):
    """The context with some commitments due on their meeting's date; due phrases as extracted are no dates."""
    _, mem, meet = sample.store(spark, sf_dir)
    due = F.when((F.col("memory_type") == "commitment") & (F.col("utterance_index") % 4 == 0), F.col("meeting_date")).otherwise(F.col("due"))
    return insight.context(mem.withColumn("due", due), meet)


@query("overdue_commitments", f"""SELECT 'commitment-overdue-' || {_SLUG('memory_id')} AS insight_id, {_SEV('late', 1, 14, 45)} AS severity, CAST(late AS DOUBLE) AS metric FROM (
  SELECT memory_id, {_DAYS('date', '(SELECT reference_date FROM ref)')} AS late FROM ctx WHERE memory_type = 'commitment' AND status = 'active' AND utterance_index % 4 = 0) WHERE late > 0""")
def overdue_commitments(spark, sf_dir):
    found = insight.commitment_insights(_dated_context(spark, sf_dir))[1]
    return found.select("insight_id", "severity", "metric")


@query("overdue_counts", f"SELECT count(*) AS total, count(*) FILTER (status = 'active' AND utterance_index % 4 = 0 AND {_OLD} > 0) AS overdue FROM ctx WHERE memory_type = 'commitment'")
def overdue_counts(spark, sf_dir):
    return insight.commitment_metrics(_dated_context(spark, sf_dir)).select("total", "overdue")


@query("memory_problems", """SELECT memory_id, CASE WHEN utterance_index % 11 = 0 THEN 'unknown memory type' WHEN memory_type = 'risk' THEN 'confidence is outside 0..1' WHEN utterance_index % 7 = 0 THEN 'text is empty'
  WHEN utterance_index % 5 = 0 THEN 'utterance index is out of range' END AS problem FROM mem""")
def memory_problems(spark, sf_dir):
    u, mem, _ = sample.store(spark, sf_dir)
    k = F.col("utterance_index")
    broken = mem.select(
        "memory_id", "meeting_id", F.when(k % 11 == 0, "rumour").otherwise(F.col("memory_type")).alias("memory_type"), F.when(F.col("memory_type") == "risk", 1.5).otherwise(F.col("confidence")).alias("confidence"),
        F.when(k % 7 == 0, "  ").otherwise(F.col("text")).alias("text"), F.when(k % 5 == 0, -1).otherwise(k).alias("utterance_index"),
    )
    return extraction.problems(broken, u).select("memory_id", "problem")


@query("meeting_problems", "SELECT DISTINCT CAST(conv_id AS VARCHAR) AS meeting_id, p AS problem FROM (SELECT conv_id, 'speaker has no name' AS p FROM conversations WHERE turn % 5 = 3 UNION ALL SELECT conv_id, 'timestamp is repeated' FROM conversations GROUP BY conv_id, turn // 2 HAVING count(*) > 1)", base=False)
def meeting_problems(spark, sf_dir):
    u = conversation_utterances(spark, sf_dir)
    k = F.col("utterance_index")
    return extraction.meeting_problems(u.withColumns({"speaker": F.when(k % 5 == 3, " ").otherwise(F.col("speaker")), "timestamp": F.floor(k / 2)}))


@query("explain_memory", """SELECT memory_id, round(score, 6) AS score, before, after FROM (SELECT m.memory_id, 0.3 + 0.15 + 0.2 * confidence + 0.15 + 0.1 * CASE status WHEN 'active' THEN 1.0 WHEN 'resolved' THEN 0.7 WHEN 'archived' THEN 0.5 WHEN 'superseded' THEN 0.3 ELSE 0.1 END + 0.1 AS score,
  (SELECT string_agg(u.text, '|' ORDER BY u.utterance_index) FROM u WHERE u.meeting_id = m.meeting_id AND u.utterance_index BETWEEN m.utterance_index - 2 AND m.utterance_index - 1) AS before,
  (SELECT string_agg(u.text, '|' ORDER BY u.utterance_index) FROM u WHERE u.meeting_id = m.meeting_id AND u.utterance_index BETWEEN m.utterance_index + 1 AND m.utterance_index + 2) AS after FROM mem m WHERE memory_id = (SELECT max(memory_id) FROM mem WHERE memory_type = 'decision'))""")
def explain_memory(spark, sf_dir):
    u, mem, meet = sample.store(spark, sf_dir)
    last = mem.where("memory_type = 'decision'").agg(F.max("memory_id")).first()[0]
    side = lambda c: F.nullif(F.array_join(F.transform(c, lambda x: x["text"]), "|"), F.lit("")).alias(c)
    return retrieval.explain(mem, meet, u, last or "").select("memory_id", F.round("score", 6).alias("score"), side("before"), side("after"))


@query("meeting_summaries", """SELECT meeting_id, line FROM (SELECT meeting_id, unnest(['## ' || coalesce(title, '(untitled)') || ' (' || meeting_id || ')', '- date: ' || coalesce(date, 'n/a'), '- participants: ' || coalesce(nullif(array_to_string(participants, ', '), ''), 'n/a'), '- memories: ' || CAST(n AS VARCHAR)]) AS line
  FROM meet LEFT JOIN (SELECT meeting_id, count(*) AS n FROM mem GROUP BY 1) USING (meeting_id)) UNION ALL SELECT meeting_id, '  - [' || memory_type || '] ' || coalesce(speaker, '?') || ': ' || text FROM mem""")
def meeting_summaries(spark, sf_dir):
    from ..operators.exports import meeting_summaries

    _, mem, meet = sample.store(spark, sf_dir)
    return meeting_summaries(mem, meet).select("meeting_id", "line")


# ---- transcript files of four formats, made from conversations

FORMATS = ("txt", "json", "csv", "md")
_PARSED = """f AS (SELECT conv_id, turn, role, trim(regexp_replace(replace(replace(text, ':', ' '), '"', ' '), '\\s+', ' ', 'g')) AS t, conv_id % 4 AS k FROM conversations),
p AS (SELECT 'conv' || CAST(conv_id AS VARCHAR) AS meeting_id, CASE WHEN k <> 2 THEN 'Talk ' || CAST(conv_id AS VARCHAR) END AS title, CASE WHEN k <> 2 THEN '2024-02-03' END AS meeting_date,
  CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS utterance_index, role AS speaker, CASE WHEN k <> 2 THEN CAST(turn * 7 AS DOUBLE) END AS timestamp, t AS text FROM f)"""


@query("parsed_transcripts", f"WITH {_PARSED} SELECT * FROM p", base=False)
def parsed_transcripts(spark, sf_dir):
    from ..sources.transcripts import parse

    return parse(sample.conversation_files(spark, sf_dir, FORMATS)).select("meeting_id", "title", "meeting_date", "utterance_index", "speaker", "timestamp", "text")


@query("meeting_durations", f"WITH {_PARSED} SELECT meeting_id, max(timestamp) - min(timestamp) AS duration_seconds, '[' || (SELECT string_agg(speaker, ', ' ORDER BY first) FROM (SELECT speaker, min(utterance_index) AS first FROM p q WHERE q.meeting_id = p.meeting_id GROUP BY 1)) || ']' AS participants FROM p GROUP BY 1", base=False)
def meeting_durations(spark, sf_dir):
    from ..sources.transcripts import meetings_of, parse

    m = meetings_of(parse(sample.conversation_files(spark, sf_dir, FORMATS)))
    return m.select("meeting_id", "duration_seconds", F.concat(F.lit("["), F.array_join("participants", ", "), F.lit("]")).alias("participants"))


from . import stored  # noqa: E402, F401 - registers its queries
