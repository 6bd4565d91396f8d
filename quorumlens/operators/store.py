"""The memory store: Parquet tables, filters, deduplication and a status log."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules as R

ORDERS = {"created_at": "created_at", "confidence": "confidence", "meeting": "meeting_id", "utterance": "utterance_index"}


@dataclass(frozen=True)
class MemoryQuery:
    """Filters that all must hold; an empty one holds always."""

    memory_types: Sequence[str] = ()
    speakers: Sequence[str] = ()
    meeting_ids: Sequence[str] = ()
    statuses: Sequence[str] = ()
    min_confidence: float | None = None
    max_confidence: float | None = None
    date: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    order_by: str = "created_at"
    descending: bool = False
    limit: int | None = None
    offset: int = 0

    def where(self) -> Column:
        out = F.lit(True)
        for name, values in (("memory_type", self.memory_types), ("speaker", self.speakers), ("meeting_id", self.meeting_ids), ("status", self.statuses)):
            if values:
                out = out & F.col(name).isin(*values)
        if self.min_confidence is not None:
            out = out & (F.col("confidence") >= self.min_confidence)
        if self.max_confidence is not None:
            out = out & (F.col("confidence") <= self.max_confidence)
        return out

    def where_meeting(self) -> Column | None:
        tests = [F.col("date") == self.date] * (self.date is not None) + [F.col("date") >= self.date_from] * (self.date_from is not None) + [F.col("date") <= self.date_to] * (self.date_to is not None)
        out = None
        for t in tests:
            out = t if out is None else out & t
        return out


def select(memories: DataFrame, meetings: DataFrame, q: MemoryQuery, ordered: bool = True) -> DataFrame:
    """The memories that q asks for; meetings are joined only for a date."""
    out = memories.where(q.where())
    if (dates := q.where_meeting()) is not None:
        out = out.join(meetings.where(dates).select("meeting_id"), "meeting_id", "left_semi")
    if ordered:
        if q.order_by not in ORDERS:
            raise ValueError(f"unknown order {q.order_by!r}; one of {', '.join(ORDERS)}")
        key = F.col(ORDERS[q.order_by])
        out = out.orderBy(key.desc() if q.descending else key.asc(), "memory_id")
        if q.offset:
            out = out.offset(q.offset)
        if q.limit is not None:
            out = out.limit(q.limit)
    return out


def list_meetings(meetings: DataFrame) -> DataFrame:
    return meetings.orderBy(F.col("date").asc_nulls_last(), "created_at", "meeting_id")


def deduplicate(memories: DataFrame, threshold: float = 1.0, stored: DataFrame | None = None) -> DataFrame:
    """Of a meeting's memories with one content hash, the first and those whose confidence is over threshold from all kept so far.

    The same point may come up again in another meeting, so meetings are never compared. stored: memories that are
    kept already (meeting_id, content_hash, created_at, memory_id, confidence); they come before all others and are
    not in the result. At 1 or more one memory stays, which is a window inside a meeting. Below that the outcome
    depends on the order. Memories are brought down to the first of each confidence before the shuffle, and those are
    folded in order: confidences have three decimals, so a hash has 1,001 of them at most, however many rows.
    """
    key = ["meeting_id", "content_hash"]
    rows = memories.withColumn("_new", F.lit(True))
    if stored is not None:
        known = stored.select(*key, "created_at", "memory_id", "confidence", F.lit(False).alias("_new"))
        rows = rows.unionByName(known.join(memories.select("meeting_id").distinct(), "meeting_id", "left_semi"), allowMissingColumns=True)
    if threshold >= 1:
        w = Window.partitionBy(*key).orderBy("_new", "created_at", "memory_id")
        return rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1 and _new").drop("_rank", "_new")
    # of equal confidences only the first can be kept: what keeps it out, or it itself, keeps out the rest
    first = rows.groupBy(*key, "confidence").agg(F.min(F.struct("_new", "created_at", "memory_id")).alias("at"))
    item = F.struct(F.col("at._new").alias("_new"), F.col("at.created_at").alias("created_at"), F.col("at.memory_id").alias("memory_id"), "confidence")
    start = F.struct(F.array().cast("array<double>").alias("kept"), F.array().cast("array<string>").alias("ids"))

    def step(a: Column, x: Column) -> Column:
        near = F.exists(a["kept"], lambda k: F.abs(k - x["confidence"]) <= threshold)
        kept = F.struct(F.concat(a["kept"], F.array(x["confidence"])).alias("kept"), F.when(x["_new"], F.concat(a["ids"], F.array(x["memory_id"]))).otherwise(a["ids"]).alias("ids"))
        return F.when(x["_new"] & near, a).otherwise(kept)

    folded = first.groupBy(*key).agg(F.aggregate(F.array_sort(F.collect_list(item)), start, step)["ids"].alias("ids"))
    return memories.join(folded.select(F.explode("ids").alias("memory_id")), "memory_id", "left_semi")


def latest_status(log: DataFrame) -> DataFrame:
    """The last entry of each memory in a log of (memory_id, seq, status, superseded_by, at)."""
    return log.groupBy("memory_id").agg(F.max_by(F.struct("status", "superseded_by", F.col("at").alias("updated_at")), "seq").alias("x")).select("memory_id", "x.*")


def apply_status(memories: DataFrame, log: DataFrame) -> DataFrame:
    """memories with the log's last entries in place of their own; superseded_by is cleared by any other status."""
    new = latest_status(log).select("memory_id", F.col("status").alias("_s"), F.when(F.col("status") == "superseded", F.col("superseded_by")).alias("_b"), F.col("updated_at").alias("_u"))
    hit = F.col("_s").isNotNull()
    joined = memories.join(new, "memory_id", "left")
    return joined.withColumns({"status": F.coalesce("_s", "status"), "superseded_by": F.when(hit, F.col("_b")).otherwise(F.col("superseded_by")), "updated_at": F.coalesce("_u", "updated_at")}).drop("_s", "_b", "_u")


def stats(memories: DataFrame, meetings: DataFrame) -> DataFrame:
    """(kind, name, n): counts by type and by status, zeros included, and totals, from one scan of memories."""
    sets = memories.groupingSets([["memory_type"], ["status"], []], "memory_type", "status").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    named = sets.select(F.when(F.col("g") == 1, "type").when(F.col("g") == 2, "status").otherwise("total").alias("kind"), F.coalesce("memory_type", "status", F.lit("memories")).alias("name"), "n")
    spark = memories.sparkSession
    names = spark.createDataFrame([("type", t) for t in R.TYPES] + [("status", s) for s in R.STATUSES] + [("total", "memories")], "kind string, name string")
    total = meetings.agg(F.count("*").alias("n")).select(F.lit("total").alias("kind"), F.lit("meetings").alias("name"), "n")
    return names.join(named, ["kind", "name"], "left").select("kind", "name", F.coalesce("n", F.lit(0)).cast("long").alias("n")).unionByName(total)


def transitions(ids: DataFrame, status: str, seq: int, at: str, superseded_by: Column | str | None = None) -> DataFrame:
    """Status log entries for memories (memory_id): `active` restores, `superseded` may name what supersedes (a column of ids)."""
    if status not in R.STATUSES:
        raise ValueError(f"unknown status {status!r}; one of {', '.join(R.STATUSES)}")
    by = F.lit(None) if superseded_by is None else superseded_by if isinstance(superseded_by, Column) else F.col(superseded_by)
    return ids.select("memory_id", F.lit(seq).alias("seq"), F.lit(status).alias("status"), by.cast("string").alias("superseded_by"), F.lit(at).alias("at"))


class Store:
    """Tables in a folder, written in batches that a log makes visible.

    A batch is a folder `<table>/_batch=<id>` of each table that it writes to; the log's entry `log/<number>.json`,
    which is written last, names the batch and its tables. Rows of a batch without an entry do not exist, so a job that is
    lost leaves nothing to be seen, and what one entry names appears at once. Tables: `meetings`, `memories`,
    `status_log`, `changes` (whole rows in place of a memory's, and deletions), `gone_meetings` and the graph's. Entries are
    numbered in order, and a deletion or change holds for what earlier entries stored: an id that was deleted can be stored
    again, by the same entry or a later one, and begins anew. Any number of readers and one writer at a time may use a folder. The log is read by
    the driver and has a line a commit; compact() brings it down to one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._entries, self._schemas = {}, {}  # log entries never change, nor do the files of a batch

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def log(self) -> list[tuple[int, str, list[str]]]:
        """(number, batch, tables) of each commit that counts, in order."""
        folder, fs = self._fs(f"{self.path}/log")
        if not fs.exists(folder):
            return []
        names = sorted(x for x in (f.getPath().getName() for f in fs.listStatus(folder)) if x.endswith(".json"))
        if new := [f"{self.path}/log/{x}" for x in names if x not in self._entries]:
            rows = self.spark.read.schema("number long, batch string, tables array<string>, replaces boolean").json(new).collect()
            self._entries |= {f"{r['number']:012d}.json": r for r in rows}
        rows = [self._entries[x] for x in names]
        first = max((i for i, r in enumerate(rows) if r["replaces"]), default=0)
        return [(r["number"], r["batch"], r["tables"]) for r in rows[first:]]

    def commit(self, tables: Mapping[str, DataFrame], replaces: bool = False) -> int:
        """Write rows to tables and make all of them visible at once; the commit's number."""
        if unknown := [name for name, df in tables.items() if "_batch" in df.columns or "_commit" in df.columns]:
            raise ValueError(f"_batch and _commit are the store's own columns, in {', '.join(unknown)}")
        batch = f"b{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{self.path}/{name}/_batch={batch}")
        number = max((n for n, _, _ in self.log()), default=-1) + 1
        line = json.dumps({"number": number, "batch": batch, "tables": sorted(tables), "replaces": replaces}) + "\n"
        target, fs = self._fs(f"{self.path}/log/{number:012d}.json")
        draft, _ = self._fs(f"{self.path}/log/.{batch}")
        out = fs.create(draft, False)
        out.write(bytearray(line.encode()))
        out.close()
        if fs.exists(target) or not fs.rename(draft, target):
            raise RuntimeError(f"another writer has made commit {number}")
        return number

    def _there(self, table: str) -> bool:
        return any(table in tables for _, _, tables in self.log())

    def raw(self, table: str) -> DataFrame | None:
        """All rows of a table that commits have made visible, with the number of theirs as _commit; None if there are none."""
        batches = [(batch, number) for number, batch, tables in self.log() if table in tables]
        if not batches:
            return None
        reader, key = self.spark.read.option("basePath", f"{self.path}/{table}"), (table, *[b for b, _ in batches])
        if key in self._schemas:
            reader = reader.schema(self._schemas[key])
        rows = reader.parquet(*[f"{self.path}/{table}/_batch={b}" for b, _ in batches])
        self._schemas[key] = rows.schema
        numbers = self.spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{b}', {n}L)" for b, n in batches) + " AS t(_batch, _number)")  # a row a commit
        return rows.join(numbers, "_batch").drop("_batch").withColumnRenamed("_number", "_commit")

    def read(self, table: str) -> DataFrame | None:
        """The rows of a table that stand now; None if nothing was ever stored in it."""
        if not self._there(table):
            return None
        if table in ("memories", "meetings"):
            return getattr(self, table)()
        return self.graph()[1] if table == "graph_edges" else self.raw(table).drop("_commit")

    def new_rows(self, table: str, rows: DataFrame, key: str) -> DataFrame:
        """The rows whose key does not stand in a table, the first of rows with one key."""
        rows = rows.dropDuplicates([key])
        old = self.read(table)
        return rows if old is None else rows.join(old.select(key), key, "left_anti")

    def append(self, table: str, rows: DataFrame, key: str) -> int:
        """Append the rows whose key the table does not hold; how many there were."""
        return self.append_all({table: (rows, key)})[table]

    def append_all(self, tables: Mapping[str, tuple[DataFrame, str]], also: Mapping[str, DataFrame] | None = None) -> dict[str, int]:
        """append() to several tables in one commit, and all rows of `also` with them; how many rows of each were new."""
        number = self.commit({name: self.new_rows(name, rows, key) for name, (rows, key) in tables.items()} | dict(also or {}))
        return {name: self.raw(name).where(F.col("_commit") == number).count() for name in tables}

    def set_status(self, changes: DataFrame) -> None:
        """changes: memory_id, seq, status, superseded_by, at; commits come in order, and seq orders what is in one."""
        self.commit({"status_log": changes})

    def archive(self, ids: DataFrame, seq: int, at: str) -> None:
        self.set_status(transitions(ids, "archived", seq, at))

    def resolve(self, ids: DataFrame, seq: int, at: str) -> None:
        self.set_status(transitions(ids, "resolved", seq, at))

    def mark_deleted(self, ids: DataFrame, seq: int, at: str) -> None:
        self.set_status(transitions(ids, "deleted", seq, at))

    def restore(self, ids: DataFrame, seq: int, at: str) -> None:
        self.set_status(transitions(ids, "active", seq, at))

    def supersede(self, pairs: DataFrame, seq: int, at: str) -> None:
        """pairs: memory_id and superseded_by."""
        self.set_status(transitions(pairs, "superseded", seq, at, "superseded_by"))

    def _memory_columns(self) -> list[str]:
        return [c for c in self.raw("memories").columns if c != "_commit"]

    def update(self, rows: DataFrame, seq: int) -> None:
        """rows: whole memories that take the place of those with their memory_id; unknown ones change nothing."""
        self.commit({"changes": rows.select("memory_id", F.lit(seq).alias("seq"), F.lit(False).alias("gone"), F.struct(*self._memory_columns()).alias("row"))})

    def _gone(self, ids: DataFrame, seq: int) -> DataFrame:
        row = F.lit(None).cast(self.raw("memories").select(F.struct(*self._memory_columns()).alias("row")).schema["row"].dataType)
        return ids.select("memory_id", F.lit(seq).alias("seq"), F.lit(True).alias("gone"), row.alias("row"))

    def delete(self, ids: DataFrame, seq: int) -> None:
        """Drop memories (memory_id); what is stored under their ids later is not touched."""
        self.commit({"changes": self._gone(ids, seq)})

    def replace(self, rows: DataFrame, seq: int) -> None:
        """Store whole memories anew, those that stand under their ids being dropped by the same commit."""
        rows = rows.dropDuplicates(["memory_id"])
        old = self.read("memories")
        self.commit({"memories": rows} if old is None else {"memories": rows, "changes": self._gone(rows.join(old.select("memory_id"), "memory_id", "left_semi"), seq)})

    def delete_meetings(self, ids: DataFrame) -> None:
        """Drop meetings (meeting_id) and all their memories; a meeting that is stored again later is not touched."""
        self.commit({"gone_meetings": ids.select("meeting_id")})

    def _left(self, rows: DataFrame) -> DataFrame:
        """rows without those of meetings that were dropped after the rows were stored."""
        gone = self.raw("gone_meetings")
        if gone is None:
            return rows
        last = gone.groupBy("meeting_id").agg(F.max("_commit").alias("_gone"))
        return rows.join(last, "meeting_id", "left").where("_gone is null or _commit >= _gone").select(*rows.columns)

    def meetings(self) -> DataFrame:
        return self._left(self.raw("meetings")).drop("_commit")

    def memories(self) -> DataFrame:
        rows = self._left(self.raw("memories"))
        columns = [c for c in rows.columns if c != "_commit"]
        if (changes := self.raw("changes")) is not None:
            # of what was said of an id after it was stored, the last counts
            after = changes.join(rows.select("memory_id", F.col("_commit").alias("_at")), "memory_id").where("_commit > _at")
            last = after.groupBy("memory_id", "_at").agg(F.max_by(F.struct("gone", "row", F.col("_commit").alias("c")), F.struct("_commit", "seq")).alias("x")).withColumnRenamed("_at", "_commit")
            whole = rows.select("memory_id", "_commit", F.struct(*columns).alias("_old")).join(last, ["memory_id", "_commit"], "left").where("x is null or not x.gone")
            # a row that was changed is still the one that was stored, for what the status log says of it
            # fields by name, as batches may order their columns differently
            rows = whole.select(*[F.when(F.col("x.row").isNotNull(), F.col(f"x.row.{c}")).otherwise(F.col(f"_old.{c}")).alias(c) for c in columns], "_commit")
        if (log := self.raw("status_log")) is not None:
            said = log.join(rows.select("memory_id", F.col("_commit").alias("_at")), "memory_id").where("_commit > _at")
            rows = apply_status(rows, said.select("memory_id", F.struct("_commit", "seq").alias("seq"), "status", "superseded_by", "at"))
        return rows.select(*columns)

    def compact(self) -> None:
        """Bring all batches into one: what stands now becomes one commit that takes the place of all before it."""
        names = sorted({t for _, _, tables in self.log() for t in tables} - {"changes", "status_log", "gone_meetings", "gone_edges"})
        if names:
            self.commit({name: self.read(name) for name in names}, replaces=True)

    def save_graph(self, nodes: DataFrame, edges: DataFrame) -> tuple[int, int]:
        """Append the nodes and edges that are new, and say how many were; what is there stays as it was first written."""
        added = self.append_all({"graph_nodes": (nodes, "node_id"), "graph_edges": (edges, "edge_id")})
        return added["graph_nodes"], added["graph_edges"]

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """Nodes, and edges without those that a later commit has taken back."""
        edges = self.raw("graph_edges")
        if (gone := self.raw("gone_edges")) is not None:
            last = gone.groupBy("edge_id").agg(F.max("_commit").alias("_gone"))
            columns = edges.columns
            edges = edges.join(last, "edge_id", "left").where("_gone is null or _commit >= _gone").select(*columns)
        return self.read("graph_nodes"), edges.drop("_commit")
