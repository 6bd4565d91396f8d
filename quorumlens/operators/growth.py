"""The graph grown by batches of meetings: what a batch adds, and takes back, without building the rest again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import materialize
from . import graph as G
from .store import Store

#: What is kept of each memory for the batches to come.
SEEN = ("memory_id", "meeting_id", "memory_type", "content_hash", "date", "superseded_by")


def _supersedes(pointers: DataFrame, known: DataFrame) -> DataFrame:
    """Edges of pointers (memory_id, memory_type, superseded_by) to memories in known."""
    newer = known.select(F.col("memory_id").alias("superseded_by"), F.col("memory_type").alias("_new"))
    return G._edge(pointers.where("superseded_by <> ''").join(newer, "superseded_by"), G.memory_node(F.col("_new"), F.col("superseded_by")), "supersedes", G.memory_node())


def delta_edges(memories: DataFrame, meetings: DataFrame, seen: DataFrame | None, mentioned: DataFrame | None, vocabulary: G.Vocabulary = G.Vocabulary()) -> tuple[DataFrame, DataFrame | None, DataFrame, DataFrame]:
    """(added, removed, seen, mentioned) of a batch of whole meetings that the graph does not have yet.

    seen (SEEN) and mentioned (graph.dated_mentions) are of the meetings before; those returned are of the batch. Edges
    inside a meeting come from the batch alone. Commitments and issues of the batch meet each other's stored side, and so
    do pointers to what supersedes. A memory that gets between two of its content parts them: their edge is removed.
    The chains of contents that the batch has are sorted anew, no others.
    """
    at = meetings.select("meeting_id", F.coalesce("date", F.lit("")).alias("date"))
    mine = materialize(memories.select(*[c for c in SEEN if c != "date"]).join(at, "meeting_id").select(*SEEN), "batch_memories")
    said = materialize(G.dated_mentions(memories, meetings, vocabulary), "batch_mentions")
    both = lambda old, new: new if old is None else old.select(*new.columns).unionByName(new)
    commits, issues = (lambda t: t.where("memory_type = 'commitment'")), (lambda t: t.where(F.col("memory_type").isin(*G.ISSUES)))
    parts = [G.structural_edges(memories, meetings, vocabulary), G.semantic_edges(memories, vocabulary), G.collaboration_edges(meetings)]
    parts.append(G._resolves(commits(said), issues(both(mentioned, said))))
    parts.append(_supersedes(mine, both(seen, mine)))
    if seen is not None:
        parts += [G._resolves(commits(mentioned), issues(said)), _supersedes(seen, mine)]
        old = seen.join(mine.select("content_hash").distinct(), "content_hash", "left_semi").select(*SEEN)
        before = materialize(G.with_edge_id(G._repeated(old)), "chains_before")
        after = materialize(G.with_edge_id(G._repeated(old.unionByName(mine))), "chains_after")
        parts.append(after.join(before, "edge_id", "left_anti").drop("edge_id"))
        removed = before.join(after, "edge_id", "left_anti")
    else:
        parts.append(G._repeated(mine))
        removed = None
    return G.with_edge_id(G._union(parts)), removed, mine, said


def grow(store: Store, memories: DataFrame, meetings: DataFrame, vocabulary: G.Vocabulary = G.Vocabulary()) -> DataFrame:
    """Add meetings and their memories to a store's graph in one commit; (relationship, added, removed) of what that did.

    Meetings that the graph has are left alone. After any number of batches, in any order, the edges are those of
    graph.edges() over all meetings at once. Nodes stay as they were first written, as in save_graph().
    """
    if (nodes := store.read("graph_nodes")) is not None:
        had = nodes.where("node_type = 'meeting'").select(F.col("ref_id").alias("meeting_id"))
        meetings = meetings.join(had, "meeting_id", "left_anti")
        memories = memories.join(meetings.select("meeting_id"), "meeting_id", "left_semi")
    meetings, memories = materialize(meetings, "new_meetings"), materialize(memories, "new_memories")
    added, removed, seen, said = delta_edges(memories, meetings, store.read("graph_memories"), store.read("graph_mentions"), vocabulary)
    also = {"graph_memories": seen, "graph_mentions": said}
    if removed is not None:
        also["gone_edges"] = removed.select("edge_id", "relationship")
    store.append_all({"graph_nodes": (G.nodes(memories, meetings, vocabulary), "node_id"), "graph_edges": (added, "edge_id")}, also)
    return changes(store, store.log()[-1][0])


def changes(store: Store, commit: int) -> DataFrame:
    """(relationship, added, removed): the edges that a commit has added and taken back."""
    count = lambda table, name: table.where(F.col("_commit") == commit).groupBy("relationship").agg(F.count("*").alias(name))
    added, gone = count(store.raw("graph_edges"), "added"), store.raw("gone_edges")
    if gone is None:
        return added.withColumn("removed", F.lit(0).cast("long"))
    return added.join(count(gone, "removed"), "relationship", "full").fillna(0, ["added", "removed"]).select("relationship", "added", "removed")
