"""The sample store: memories and meetings of the templated utterances, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators.extraction import extract
from ..sources.utterances import UTTERANCES_SQL, event_utterances, read_events


def meetings(utterances: DataFrame) -> DataFrame:
    """One row a meeting of (meeting_id, meeting_date, title, speaker) utterances."""
    rows = utterances.groupBy("meeting_id").agg(F.min("title").alias("title"), F.min("meeting_date").alias("date"), F.array_sort(F.collect_set("speaker")).alias("participants"))
    return rows.withColumn("created_at", F.concat("date", F.lit("T09:00:00+00:00")))


def with_lifecycle(memories: DataFrame) -> DataFrame:
    """Statuses by place, so that every status and chains of superseded decisions occur."""
    k = F.col("utterance_index") % 10
    status = F.when((F.col("memory_type") == "decision") & (F.col("utterance_index") % 3 == 0), "superseded").when(k < 6, "active").when(k == 6, "resolved").when(k == 7, "archived").when(k == 8, "superseded").otherwise("deleted")
    w = Window.partitionBy("meeting_id", "memory_type").orderBy("utterance_index")
    rows = memories.withColumns({"status": status, "created_at": F.concat("meeting_date", F.lit("T09:00:00+00:00"))})
    later = F.when((F.col("status") == "superseded") & (F.col("memory_type") == "decision"), F.lead("memory_id").over(w))
    updated = F.concat(F.date_add(F.to_date("meeting_date"), F.col("utterance_index") % 5 + 1).cast("string"), F.lit("T09:00:00+00:00"))
    meta = F.map_filter(F.create_map(F.lit("due"), "due", F.lit("owner"), "owner", F.lit("trigger"), "trigger"), lambda k, v: v.isNotNull())
    return rows.withColumns({"superseded_by": later, "updated_at": updated, "metadata": meta})


_STORES: dict[tuple[str, str], tuple[DataFrame, DataFrame, DataFrame]] = {}


def store(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(utterances, memories, meetings).

    Queries read the store several times, and one session asks many of them, so it is kept once a session and folder,
    and kept again where the session's cache was cleared meanwhile. forget() lets go of it.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        u = event_utterances(spark, sf_dir)
        # meetings are brought down to their few rows before they are dealt
        _STORES[key] = u, with_lifecycle(extract(u)), meetings(read_events(spark, sf_dir))
    for table in _STORES[key][1:]:
        if not table.storageLevel.useMemory:
            table.persist(StorageLevel.MEMORY_AND_DISK)
    return _STORES[key]


def forget(spark: SparkSession) -> None:
    """Drop what store() keeps for a session."""
    for key in [k for k in _STORES if k[0] == spark.sparkContext.applicationId]:
        for table in _STORES.pop(key)[1:]:
            table.unpersist()


def conversation_files(spark: SparkSession, sf_dir: str, formats: tuple[str, ...] = ("txt", "json", "csv")) -> DataFrame:
    """A transcript file (path, content, transcript_hash, format, conv_id) for each conversation, in turn of each format.

    Colons and quotes in what is said become blanks, as a colon in a continuation line may begin a turn.
    """
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("said", F.translate("text", ':"', "  "))
    turn = F.struct("turn", "role", "said")
    per = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    title = F.concat(F.lit("Talk "), F.col("conv_id").cast("string"))
    stamp = lambda x: F.format_string("[%02d:%02d:%02d]", F.floor(x["turn"] * 7 / 3600), F.floor(x["turn"] * 7 / 60) % 60, x["turn"] * 7 % 60)
    lines = F.array_join(F.transform("turns", lambda x: F.concat(stamp(x), F.lit(" "), x["role"], F.lit(": "), x["said"])), "\n")
    text = F.concat(F.lit("---\nTitle: "), title, F.lit("\ndate: 2024-02-03\n---\n"), lines)
    heard = F.transform("turns", lambda x: F.struct(x["role"].alias("name"), x["said"].alias("content"), (x["turn"] * 7).alias("time")))
    js = F.to_json(F.struct(title.alias("title"), F.lit("2024-02-03").alias("date"), heard.alias("utterances")))
    cells = F.concat(F.lit("Owner,Action\n"), F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit(',"'), x["said"], F.lit('"'))), "\n"))
    kind = F.array(*map(F.lit, formats))[(F.col("conv_id") % len(formats)).cast("int")]
    notes = F.concat(F.lit("---\nTitle: "), title, F.lit("\ndate: 2024-02-03\n---\n# Notes\nwritten by hand\n\n"), F.array_join(F.transform("turns", lambda x: F.concat(F.lit("- **"), stamp(x), F.lit(" "), x["role"], F.lit("**: "), F.translate(x["said"], "\n", " "))), "\n"))
    content = F.when(kind == "txt", text).when(kind == "json", js).when(kind == "md", notes).otherwise(cells)
    named = per.select("conv_id", F.concat(F.lit("/talks/conv"), F.col("conv_id").cast("string"), F.lit("."), kind).alias("path"), content.alias("content"), kind.alias("_kind"))
    known = F.create_map(*[x for k, v in {"txt": "text", "json": "json", "csv": "csv", "md": "markdown"}.items() for x in (F.lit(k), F.lit(v))])
    return named.select("path", "content", F.sha2("content", 256).alias("transcript_hash"), known[F.col("_kind")].alias("format"), "conv_id")


def _hits(kind: str) -> str:
    """DuckDB: the matches of a type's rules as a list, strongest first."""
    q = lambda p: p.replace("'", "''")
    parts = [
        f"CASE WHEN regexp_matches(text, '(?i){q(p)}') THEN {{'base': {b}, 'neg_start': -length(regexp_extract(text, '(?is)^(.*?)(?:{q(p)})', 1)), 'neg_rule': -{i}, 'trig': regexp_extract(text, '(?i){q(p)}')}} END"
        for i, (p, b) in enumerate(R.RULES[kind])
    ]
    return f"list_reverse_sort(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL))[1]"


def _kind_sql(kind: str) -> str:
    ask = "regexp_matches(text, '\\?\\s*$')"
    hit = f"SELECT u.*, '{kind}' AS memory_type, {_hits(kind)} AS h, false AS marked FROM u"
    if kind == "question":
        return f"SELECT * FROM ({hit} WHERE NOT {ask}) WHERE h IS NOT NULL UNION ALL SELECT u.*, 'question', {{'base': 0.95, 'neg_start': 0, 'neg_rule': 0, 'trig': '?'}}, true FROM u WHERE {ask}"
    return f"SELECT * FROM ({hit}{f' WHERE NOT {ask}' if kind == 'fact' else ''}) WHERE h IS NOT NULL"


_Q = lambda p: p.replace("'", "''")

UTTERANCES = UTTERANCES_SQL.replace("{events}", "events")

#: CTEs u (utterances), meet (meetings) and mem (memories) for DuckDB.
BASE_SQL = f"""u AS ({UTTERANCES}),
meet AS (SELECT meeting_id, min(title) AS title, min(meeting_date) AS date, list_sort(list(DISTINCT speaker)) AS participants FROM u GROUP BY meeting_id),
cand AS ({" UNION ALL ".join(_kind_sql(k) for k in R.TYPES)}),
c1 AS (SELECT *, CASE WHEN memory_type = 'commitment' THEN CASE WHEN regexp_matches(text, '{_Q(R.ASSIGNEE)}') THEN regexp_extract(text, '{_Q(R.ASSIGNEE)}', 1)
    WHEN regexp_matches(text, '{_Q(R.FIRST_PERSON)}') THEN speaker END END AS owner,
  CASE WHEN memory_type = 'commitment' THEN nullif(regexp_extract(text, '(?i){_Q(R.DUE)}'), '') END AS due FROM cand),
c2 AS (SELECT *, CASE WHEN marked THEN 0.95 ELSE round_even(greatest(0.0, least(1.0, CAST(h.base AS DOUBLE)
    + CASE WHEN owner IS NOT NULL AND due IS NOT NULL THEN 0.1 WHEN memory_type = 'fact' AND regexp_matches(text, '{_Q(R.QUANTITY)}') THEN 0.15 ELSE 0.0 END
    - CASE WHEN regexp_matches(text, '(?i){_Q(R.HEDGES)}') THEN 0.2 ELSE 0.0 END)), 3) END AS confidence,
  trim(regexp_replace(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS norm FROM c1),
c3 AS (SELECT * FROM c2 QUALIFY row_number() OVER (PARTITION BY meeting_id, memory_type, norm ORDER BY confidence DESC, utterance_index) = 1),
c4 AS (SELECT meeting_id, meeting_date, title, speaker, utterance_index, text, memory_type, CAST(confidence AS DOUBLE) AS confidence, owner, due, h.trig AS trigger,
    CAST(-h.neg_start AS INT) AS evidence_start, CAST(CASE WHEN marked THEN length(text) ELSE -h.neg_start + length(h.trig) END AS INT) AS evidence_end,
    meeting_id || ':' || memory_type || ':' || CAST(utterance_index AS VARCHAR) AS memory_id, sha256(memory_type || chr(10) || norm) AS content_hash,
    CASE WHEN memory_type = 'decision' AND utterance_index % 3 = 0 THEN 'superseded' WHEN utterance_index % 10 < 6 THEN 'active' WHEN utterance_index % 10 = 6 THEN 'resolved'
      WHEN utterance_index % 10 = 7 THEN 'archived' WHEN utterance_index % 10 = 8 THEN 'superseded' ELSE 'deleted' END AS status FROM c3),
mem AS (SELECT *, CASE memory_type WHEN 'open_loop' THEN 'memory' ELSE memory_type END AS mt, meeting_date || 'T09:00:00+00:00' AS created_at,
    CASE WHEN status = 'superseded' AND memory_type = 'decision' THEN lead(memory_id) OVER (PARTITION BY meeting_id, memory_type ORDER BY utterance_index) END AS superseded_by,
    CAST(CAST(CAST(meeting_date AS DATE) + CAST(utterance_index % 5 + 1 AS INT) AS DATE) AS VARCHAR) || 'T09:00:00+00:00' AS updated_at FROM c4),
ctx AS (SELECT *, meeting_date AS date, coalesce(nullif(owner, ''), nullif(speaker, '')) AS responsible FROM mem WHERE status <> 'deleted'),
ref AS (SELECT max(date) AS reference_date, datediff('day', CAST(min(date) AS DATE), CAST(max(date) AS DATE)) AS span_days, count(*) AS n_meetings FROM meet)"""

_SLUG = lambda x: f"coalesce(nullif(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unknown')"


def _found(text: str, kind: str, pattern: str, lower: bool = False) -> str:
    return f"list_transform(regexp_extract_all({f'lower({text})' if lower else text}, '{_Q(pattern)}', 1), lambda n: {{'kind': '{kind}', 'name': n}})"


def entities_sql(text: str) -> str:
    parts = [
        _found(text, "project", R.PROJECT), _found(text, "customer", R.CUSTOMER), _found(text, "vendor", R.VENDOR), _found(text, "document", R.DOCUMENT_FILE),
        _found(text, "technology", rf"\b({'|'.join(sorted(R.TECHNOLOGIES, key=lambda t: (-len(t), t)))})\b", True), _found(text, "document", rf"\b({'|'.join(R.DOCUMENT_WORDS)})\b", True),
    ]
    return f"list_distinct(flatten([{', '.join(parts)}]))"


#: CTEs ment (what memories mention) and edge (structural edges).
GRAPH_SQL = f"""ment AS (SELECT memory_id, meeting_id, memory_type, mt, e.kind AS kind, e.name AS name, e.kind || ':' || {_SLUG('e.name')} AS entity_id
  FROM (SELECT memory_id, meeting_id, memory_type, mt, unnest({entities_sql('text')}) AS e FROM mem)),
tment AS (SELECT meeting_id, e.kind AS kind, e.name AS name, e.kind || ':' || {_SLUG('e.name')} AS entity_id FROM (SELECT meeting_id, unnest({entities_sql('title')}) AS e FROM meet)),
part AS (SELECT meeting_id, unnest(participants) AS name FROM meet),
edge AS (SELECT DISTINCT * FROM (
  SELECT 'meeting:' || meeting_id AS source_id, 'mentions' AS relationship, 'person:' || {_SLUG('name')} AS target_id, '' AS discriminator FROM part
  UNION ALL SELECT 'meeting:' || meeting_id, 'mentions', entity_id, '' FROM tment
  UNION ALL SELECT 'meeting:' || meeting_id, 'mentions', entity_id, '' FROM ment
  UNION ALL SELECT mt || ':' || memory_id, 'discussed_in', 'meeting:' || meeting_id, '' FROM mem
  UNION ALL SELECT mt || ':' || memory_id, 'owned_by', 'person:' || {_SLUG('speaker')}, '' FROM mem WHERE speaker <> ''
  UNION ALL SELECT mt || ':' || memory_id, 'assigned_to', 'person:' || {_SLUG("coalesce(nullif(owner, ''), speaker)")}, '' FROM mem WHERE memory_type = 'commitment' AND coalesce(nullif(owner, ''), speaker) <> ''
  UNION ALL SELECT mt || ':' || memory_id, 'mentions', entity_id, '' FROM ment
  UNION ALL SELECT mt || ':' || memory_id, 'relates_to', entity_id, '' FROM ment WHERE memory_type = 'decision' AND kind = 'project'
  UNION ALL SELECT mt || ':' || memory_id, 'blocks', entity_id, '' FROM ment WHERE memory_type = 'risk' AND kind = 'project'
  UNION ALL SELECT mt || ':' || memory_id, 'references', entity_id, '' FROM ment WHERE memory_type = 'fact' AND kind = 'customer'
  UNION ALL SELECT a.entity_id, 'depends_on', b.entity_id, '' FROM ment a JOIN ment b USING (memory_id) WHERE a.kind = 'project' AND b.kind = 'technology')),
proj AS (SELECT 'project:' || {_SLUG('name')} AS project_id, min(name) AS name FROM (SELECT kind, name FROM ment UNION ALL SELECT kind, name FROM tment) WHERE kind = 'project' GROUP BY 1),
pmet AS (SELECT project_id, name, count(*) FILTER (source_id LIKE 'risk:%') AS risk_count, count(*) FILTER (source_id LIKE 'decision:%') AS decision_count,
  count(*) FILTER (source_id LIKE 'meeting:%') AS meeting_count, count(*) FILTER (relationship = 'blocks') AS blocker_count FROM proj LEFT JOIN edge ON target_id = project_id GROUP BY ALL)"""
