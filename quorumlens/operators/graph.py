"""The memory graph: nodes, twelve kinds of edges, traversal, components and lineage."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.text import edge_id, node_id, slugify
from ..shared import materialize, shared_dir


@dataclass(frozen=True)
class Vocabulary:
    projects: Sequence[str] = ()
    technologies: Sequence[str] = tuple(R.TECHNOLOGIES)
    customers: Sequence[str] = ()
    teams: Sequence[str] = ()
    vendors: Sequence[str] = ()
    documents: Sequence[str] = ()


def memory_node(kind: Column | None = None, ref: Column | None = None) -> Column:
    """A memory's node: open loops have no kind of their own and are `memory`."""
    kind = F.col("memory_type") if kind is None else kind
    return node_id(F.when(kind == "open_loop", "memory").otherwise(kind), F.col("memory_id") if ref is None else ref)


def _words(text: Column, kind: str, terms: Sequence[str]) -> Column:
    """The terms that stand in the text as whole words."""
    none = F.array().cast("array<struct<kind:string,name:string>>")
    if not terms:
        return none
    lower = F.lower(text)
    quoted = lambda t: "".join(c if c.isalnum() or c in "_ " else "\\" + c for c in t.lower())
    if all(t.isalnum() and t == t.lower() for t in terms):  # single words cannot overlap
        hits = F.regexp_extract_all(lower, F.lit(rf"\b({'|'.join(sorted(terms, key=lambda t: (-len(t), t)))})\b"), F.lit(1))
    else:
        hits = F.filter(F.array(*[F.when(lower.rlike(rf"\b{quoted(t)}\b"), F.lit(t)) for t in terms]), lambda x: x.isNotNull())
    return F.transform(hits, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))


def entities(text: Column, vocabulary: Vocabulary = Vocabulary()) -> Column:
    """The distinct (kind, name) that a text mentions, by vocabulary and by pattern."""
    named = [("project", R.PROJECT), ("customer", R.CUSTOMER), ("vendor", R.VENDOR), ("document", R.DOCUMENT_FILE.replace(r"[\w-]", r"[\p{L}\p{N}_-]"))]
    parts = [_named(text, k, p) for k, p in named]
    listed = [("project", vocabulary.projects), ("technology", vocabulary.technologies), ("customer", vocabulary.customers), ("team", vocabulary.teams), ("vendor", vocabulary.vendors), ("document", [*vocabulary.documents, *R.DOCUMENT_WORDS])]
    return F.array_sort(F.array_distinct(F.concat(*parts, *[_words(text, k, t) for k, t in listed])))


def _named(text: Column, kind: str, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))


def mentions(memories: DataFrame, vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """(memory_id, meeting_id, memory_type, entity_id, kind, name): what each memory mentions."""
    x = memories.select("memory_id", "meeting_id", "memory_type", F.explode(entities(F.col("text"), vocabulary)).alias("e"))
    return x.select("memory_id", "meeting_id", "memory_type", node_id(F.col("e.kind"), slugify(F.col("e.name"))).alias("entity_id"), "e.kind", "e.name")


def _entity_ids(text: Column, vocabulary: Vocabulary) -> Column:
    return F.transform(entities(text, vocabulary), lambda e: F.struct(e["kind"].alias("kind"), e["name"].alias("name"), slugify(e["name"]).alias("slug"), node_id(e["kind"], slugify(e["name"])).alias("id")))


def _if(test: Column, *items: Column) -> Column:
    """An array of items if test holds, else an empty one."""
    full = F.array(*items)
    return F.when(test, full).otherwise(F.slice(full, 1, 0))


def nodes(memories: DataFrame, meetings: DataFrame, vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """(node_id, node_type, label, ref_id), one row a node; of several labels the least stands. Each table is read once."""
    node = lambda ident, kind, label, ref: F.struct(ident.alias("node_id"), kind.alias("node_type"), label.alias("label"), ref.alias("ref_id"))
    person = lambda name: node(node_id("person", slugify(name)), F.lit("person"), name, slugify(name))
    things = F.transform("_e", lambda e: node(e["id"], e["kind"], e["name"], e["slug"]))
    named = lambda names: F.transform(F.filter(names, lambda n: n != ""), person)
    kind = F.when(F.col("memory_type") == "open_loop", "memory").otherwise(F.col("memory_type"))
    mem = memories.select("memory_id", "memory_type", "text", "speaker", "owner", _entity_ids(F.col("text"), vocabulary).alias("_e"))
    of_mem = mem.select(F.explode(F.concat(F.array(node(memory_node(), kind, F.col("text"), F.col("memory_id"))), named(F.array("speaker", "owner")), things)).alias("n"))
    met = meetings.select("meeting_id", "title", "participants", _entity_ids(F.coalesce("title", F.lit("")), vocabulary).alias("_e"))
    head = node(node_id("meeting", F.col("meeting_id")), F.lit("meeting"), F.coalesce("title", "meeting_id"), F.col("meeting_id"))
    of_met = met.select(F.explode(F.concat(F.array(head), F.coalesce(named("participants"), F.array().cast("array<struct<node_id:string,node_type:string,label:string,ref_id:string>>")), things)).alias("n"))
    every = of_mem.select("n.*").unionByName(of_met.select("n.*"))
    return every.groupBy("node_id").agg(F.min("node_type").alias("node_type"), F.min("label").alias("label"), F.min("ref_id").alias("ref_id"))


def _edge(df: DataFrame, src: Column, relationship: str, dst: Column, discriminator: Column | None = None) -> DataFrame:
    disc = F.lit("") if discriminator is None else discriminator
    return df.select(src.alias("source_id"), F.lit(relationship).alias("relationship"), dst.alias("target_id"), disc.alias("discriminator"))


def structural_edges(memories: DataFrame, meetings: DataFrame, vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """Edges that one memory or one meeting gives by itself: a projection to an array of edges of each row of the two tables."""
    meeting, memory = node_id("meeting", F.col("meeting_id")), memory_node()
    edge = lambda a, relationship, b: F.struct(a.alias("source_id"), F.lit(relationship).alias("relationship"), b.alias("target_id"), F.lit("").alias("discriminator"))
    person = lambda name: node_id("person", slugify(name))
    of_kind = lambda k: F.filter("_e", lambda e: e["kind"] == k)
    to = lambda found, a, relationship: F.transform(found, lambda e: edge(a, relationship, e["id"]))
    is_ = lambda kind: F.col("memory_type") == kind
    some = lambda kind, found: F.when(is_(kind), found).otherwise(F.slice(found, 1, 0))
    owner = F.coalesce(F.nullif("owner", F.lit("")), "speaker")
    depends = F.flatten(F.transform(of_kind("project"), lambda p: F.transform(of_kind("technology"), lambda t: edge(p["id"], "depends_on", t["id"]))))
    mem = memories.select("memory_id", "meeting_id", "memory_type", "speaker", "owner", _entity_ids(F.col("text"), vocabulary).alias("_e"))
    given = F.concat(
        F.array(edge(memory, "discussed_in", meeting)), _if(F.col("speaker") != "", edge(memory, "owned_by", person(F.col("speaker")))),
        _if(is_("commitment") & (owner != ""), edge(memory, "assigned_to", person(owner))), to(F.col("_e"), meeting, "mentions"), to(F.col("_e"), memory, "mentions"),
        some("decision", to(of_kind("project"), memory, "relates_to")), some("risk", to(of_kind("project"), memory, "blocks")), some("fact", to(of_kind("customer"), memory, "references")), depends,
    )
    met = meetings.select("meeting_id", F.coalesce("participants", F.array().cast("array<string>")).alias("_p"), _entity_ids(F.coalesce("title", F.lit("")), vocabulary).alias("_e"))
    heard = F.concat(F.transform("_p", lambda name: edge(meeting, "mentions", person(name))), to(F.col("_e"), meeting, "mentions"))
    return _union([mem.select(F.explode(given).alias("x")).select("x.*"), met.select(F.explode(heard).alias("x")).select("x.*")])


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def semantic_edges(memories: DataFrame, vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """Questions relate to, and assumptions support, decisions of their meeting that share an entity."""
    found = mentions(memories, vocabulary).select("memory_id", "meeting_id", "memory_type", "entity_id").distinct()
    decisions = found.where("memory_type = 'decision'").select("meeting_id", "entity_id", F.col("memory_id").alias("decision_id"))
    pairs = found.where("memory_type in ('question', 'assumption')").join(decisions, ["meeting_id", "entity_id"])
    rel = F.when(F.col("memory_type") == "question", "relates_to").otherwise("supports")
    return pairs.select(memory_node().alias("source_id"), rel.alias("relationship"), node_id("decision", F.col("decision_id")).alias("target_id"), F.lit("").alias("discriminator")).distinct()


def supersedes_edges(memories: DataFrame) -> DataFrame:
    new = memories.select(F.col("memory_id").alias("superseded_by"), F.col("memory_type").alias("_new"))
    both = memories.where("superseded_by <> ''").join(new, "superseded_by")
    return _edge(both, memory_node(F.col("_new"), F.col("superseded_by")), "supersedes", memory_node())


def placed(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """df sorted by order over all tasks, with its place (run << 33 | place in the run) as _place, as a table in the shared folder.

    A run is what one task of the sort had; a key that very many rows have lies in several runs. order should end in
    columns that tell rows apart.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), name)


def with_predecessor(df: DataFrame, key: str, order: Sequence[str], what: Sequence[str]) -> DataFrame:
    """df with `before`: a struct of `what` of the row before it among those of its key, null for the first.

    Rows are sorted in runs and joined to the row one place before. Places are unique, so the join is as even for a key
    that nearly all rows have as for any other. The first row of a run has the last row of the run before it, which is a
    row a run.
    """
    rows = placed(df, [key, *order], "runs")
    run = F.shiftright("_place", 33)
    value = F.struct(*what)
    ends = rows.groupBy(run.alias("run")).agg(F.max("_place").alias("_last"))
    last = rows.join(ends, F.col("_place") == F.col("_last"), "left_semi").select(run.alias("run"), F.col(key).alias("_key"), value.alias("before"))
    ahead = Window.orderBy("run")  # a row a run
    borders = last.select(F.shiftleft(F.lead("run").over(ahead), 33).alias("_place"), "_key", "before").where("_place is not null")
    behind = rows.select((F.col("_place") + 1).alias("_place"), F.col(key).alias("_key"), value.alias("before")).unionByName(borders)
    return rows.join(behind, (rows["_place"] == behind["_place"]) & (rows[key] == behind["_key"]), "left").select(*df.columns, "before")


def repeated_content_edges(memories: DataFrame, meetings: DataFrame) -> DataFrame:
    """Each memory to the one before it with the same content, if that is of another meeting."""
    rows = memories.select("content_hash", "meeting_id", "memory_id", "memory_type")
    return _repeated(rows.join(meetings.select("meeting_id", F.coalesce("date", F.lit("")).alias("date")), "meeting_id"))


def _repeated(dated: DataFrame) -> DataFrame:
    chained = with_predecessor(dated, "content_hash", ["date", "meeting_id", "memory_id"], ["memory_type", "memory_id", "meeting_id"])
    hit = chained.where("before is not null and before.meeting_id <> meeting_id")
    return _edge(hit, memory_node(), "connected_to", memory_node(F.col("before.memory_type"), F.col("before.memory_id")), F.lit("repeated_content"))


def dated_mentions(memories: DataFrame, meetings: DataFrame, vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """(memory_id, meeting_id, memory_type, entity_id, date), a row for each memory and thing that it mentions."""
    found = mentions(memories, vocabulary).select("memory_id", "meeting_id", "memory_type", "entity_id").distinct()
    return found.join(meetings.select("meeting_id", F.coalesce("date", F.lit("")).alias("date")), "meeting_id").select("memory_id", "meeting_id", "memory_type", "entity_id", "date")


ISSUES = ("risk", "open_loop")


def _resolving(memories: DataFrame, meetings: DataFrame, vocabulary: Vocabulary) -> tuple[DataFrame, DataFrame]:
    dated = dated_mentions(memories, meetings, vocabulary)
    return dated.where("memory_type = 'commitment'"), dated.where(F.col("memory_type").isin(*ISSUES))


def not_later(commitments: DataFrame, issues: DataFrame, block: int = 1024) -> DataFrame:
    """(memory_id, issue_id, issue_type): commitments with the issues of the same entity whose date is not later.

    An inequality join by ranges. Both sides are sorted by entity and date, of a date issues first, so a commitment's
    issues are those of its entity at smaller places. Places are cut into blocks of `block` rows, and blocks of an entity
    are paired with it and with the blocks before. Each pair of blocks is a key of its own, of at most block x block
    pairs, so an entity that very many memories mention is spread over all tasks; only where a block meets itself are
    places compared.
    """
    side = lambda df, late: df.select("entity_id", "date", F.lit(late).alias("late"), "memory_id", "memory_type")
    rows = placed(side(commitments, True).unionByName(side(issues, False)), ["entity_id", "date", "late", "memory_id"], "resolving")
    rows = rows.withColumn("block", F.floor(F.col("_place") / block).cast("long"))
    has = rows.groupBy("entity_id", "block").agg(F.max("late").alias("commits"), F.min("late").alias("only"))
    mine = has.where("commits").select("entity_id", F.col("block").alias("c"))
    theirs = has.where("not only").select("entity_id", F.col("block").alias("i"))
    pairs = materialize(mine.join(theirs, "entity_id").where("i <= c"), "block_pairs")
    left = rows.where("late").select("entity_id", F.col("block").alias("c"), "memory_id", "_place").join(pairs, ["entity_id", "c"])
    right = rows.where("not late").select("entity_id", F.col("block").alias("i"), F.col("memory_id").alias("issue_id"), F.col("memory_type").alias("issue_type"), F.col("_place").alias("_issue")).join(pairs, ["entity_id", "i"])
    return left.join(right, ["entity_id", "c", "i"]).where("i < c or _issue < _place").select("memory_id", "issue_id", "issue_type")


def _resolves(commitments: DataFrame, issues: DataFrame) -> DataFrame:
    return _edge(not_later(commitments, issues), node_id("commitment", F.col("memory_id")), "resolves", memory_node(F.col("issue_type"), F.col("issue_id"))).distinct()


def resolves_edges(memories: DataFrame, meetings: DataFrame, vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """Commitments to all risks and open loops that share an entity and are no later; every such pair is an edge.

    The pairs are the result, so it grows with the square of what one entity gathers; resolves_counts() tells
    how many each commitment has without making them.
    """
    return _resolves(*_resolving(memories, meetings, vocabulary))


def resolves_counts(memories: DataFrame, meetings: DataFrame, vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """(memory_id, n): how many resolves edges each commitment has.

    Issues are counted by (set of entities, date) first. Sets that share an entity are paired, then counts of no
    later dates are summed; the work grows with sets and dates, not with memories.
    """
    commitments, issues = _resolving(memories, meetings, vocabulary)
    sets = lambda d: d.groupBy("memory_id", "date").agg(F.array_sort(F.collect_set("entity_id")).alias("s"))
    by_set = sets(issues).groupBy("s", "date").agg(F.count("*").alias("n"))
    c = sets(commitments)
    mine = c.select("s").distinct().withColumn("e", F.explode("s"))
    theirs = by_set.select(F.col("s").alias("t")).distinct().withColumn("e", F.explode("t"))
    meet = mine.join(theirs, "e").select("s", "t").distinct()
    days = c.select("s", F.col("date").alias("d")).distinct().join(meet, "s")
    n = days.join(by_set.select(F.col("s").alias("t"), "date", "n"), "t").where("date <= d").groupBy("s", "d").agg(F.sum("n").alias("n"))
    return c.join(n, (c["s"] == n["s"]) & (c["date"] == n["d"]), "left").select("memory_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def collaboration_edges(meetings: DataFrame) -> DataFrame:
    """An edge for each pair of people and meeting they share."""
    people = meetings.select("meeting_id", F.array_sort(F.array_distinct("participants")).alias("p"))
    pairs = people.select("meeting_id", "p", F.posexplode("p").alias("i", "a")).select("meeting_id", "a", F.explode(F.slice("p", F.col("i") + 2, F.size("p"))).alias("b"))
    return _edge(pairs, node_id("person", slugify(F.col("a"))), "connected_to", node_id("person", slugify(F.col("b"))), F.col("meeting_id"))


def with_edge_id(found: DataFrame) -> DataFrame:
    return found.withColumn("edge_id", edge_id(F.col("source_id"), F.col("relationship"), F.col("target_id"), F.col("discriminator")))


def edges(memories: DataFrame, meetings: DataFrame, vocabulary: Vocabulary = Vocabulary(), resolves: bool = True) -> DataFrame:
    """All edges with their edge_id."""
    parts = [structural_edges(memories, meetings, vocabulary), semantic_edges(memories, vocabulary), supersedes_edges(memories), repeated_content_edges(memories, meetings), collaboration_edges(meetings)]
    if resolves:
        parts.append(resolves_edges(memories, meetings, vocabulary))
    return with_edge_id(_union(parts))


def outgoing(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("source_id") == node).orderBy("source_id", "relationship", "target_id", "edge_id")


def incoming(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("target_id") == node).orderBy("source_id", "relationship", "target_id", "edge_id")


def _cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the session's folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def _steps(edges: DataFrame, direction: str, relationships: Sequence[str]) -> DataFrame:
    e = edges.where(F.col("relationship").isin(*relationships)) if relationships else edges
    out = e.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), "edge_id")
    back = e.select(F.col("target_id").alias("a"), F.col("source_id").alias("b"), "edge_id")
    return {"out": out, "in": back}.get(direction, out.unionByName(back))


def neighbors(edges: DataFrame, start: Sequence[str], depth: int = 1, relationships: Sequence[str] = (), direction: str = "both", node_types: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """(node_id, distance) of all nodes within depth steps of start; start itself has distance 0.

    node_types choose among what was found (the part of node_id before the colon), not where the search goes. limit
    keeps the first nodes in order of node_id.
    """
    steps = _steps(edges, direction, relationships).select("a", "b")
    seen = edges.sparkSession.createDataFrame([(s, 0) for s in start], "node_id string, distance int")
    front = seen
    for d in range(1, depth + 1):
        near = front.join(steps, front["node_id"] == steps["a"]).select(F.col("b").alias("node_id")).distinct()
        front = _cut(near.join(seen, "node_id", "left_anti").withColumn("distance", F.lit(d)))
        seen = seen.unionByName(front)
    if node_types:
        seen = seen.where(F.substring_index("node_id", ":", 1).isin(*node_types))
    return seen if limit is None else seen.orderBy("node_id").limit(limit)


#: Node types of what related() looks for.
MEMORY_NODES = ("decision", "commitment", "memory", "risk", "assumption", "question", "fact")


def related(edges: DataFrame, node: str, node_types: Sequence[str] = (), depth: int = 2, limit: int | None = None) -> DataFrame:
    """(node_id, distance): the neighbours of a node without itself; all memories by MEMORY_NODES, else ("meeting",), ("person",) or ("project",)."""
    found = neighbors(edges, [node], depth, node_types=node_types).where(F.col("distance") > 0)
    return found if limit is None else found.orderBy("node_id").limit(limit)


def neighbors_of_all(memories: DataFrame, meetings: DataFrame, start: Sequence[str], depth: int = 1, vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """neighbors() over edges of every kind in both directions, without making the pairs of resolves_edges().

    A front's commitments reach the issues of an entity up to the latest of their dates, and its issues the
    commitments from the earliest of theirs on, so one date an entity stands for the front.
    """
    steps = _cut(_steps(edges(memories, meetings, vocabulary, resolves=False), "both", ()).select("a", "b").distinct())
    commitments, issues = (_cut(x.select(memory_node().alias("node_id"), "entity_id", "date")) for x in _resolving(memories, meetings, vocabulary))
    seen = memories.sparkSession.createDataFrame([(s, 0) for s in start], "node_id string, distance int")
    front = seen
    for d in range(1, depth + 1):
        latest = commitments.join(front, "node_id").groupBy("entity_id").agg(F.max("date").alias("d"))
        earliest = issues.join(front, "node_id").groupBy("entity_id").agg(F.min("date").alias("d"))
        near = front.join(steps, front["node_id"] == steps["a"]).select(F.col("b").alias("node_id"))
        near = near.unionByName(issues.join(latest, "entity_id").where("date <= d").select("node_id"))
        near = near.unionByName(commitments.join(earliest, "entity_id").where("date >= d").select("node_id")).distinct()
        front = _cut(near.join(seen, "node_id", "left_anti").withColumn("distance", F.lit(d)))
        seen = seen.unionByName(front)
    return seen


def related_of_all(memories: DataFrame, meetings: DataFrame, node: str, node_types: Sequence[str] = (), depth: int = 2, limit: int | None = None, vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """related() over edges of every kind."""
    found = neighbors_of_all(memories, meetings, [node], depth, vocabulary).where(F.col("distance") > 0)
    if node_types:
        found = found.where(F.substring_index("node_id", ":", 1).isin(*node_types))
    return found if limit is None else found.orderBy("node_id").limit(limit)


def edges_of(memories: DataFrame, meetings: DataFrame, node: str, vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """The edges of every kind that a node is an end of; of resolves edges no others are made."""
    rest = edges(memories, meetings, vocabulary, resolves=False).where((F.col("source_id") == node) | (F.col("target_id") == node))
    own = memory_node() == node
    commitments, issues = _resolving(memories, meetings, vocabulary)
    if node.startswith("commitment:"):
        return rest.unionByName(with_edge_id(_resolves(commitments.where(own), issues)))
    if node.split(":")[0] in ("risk", "memory"):
        return rest.unionByName(with_edge_id(_resolves(commitments, issues.where(own))))
    return rest


def subgraph(edges: DataFrame, start: Sequence[str], depth: int = 1, relationships: Sequence[str] = (), direction: str = "both") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around start: neighbors(), and the edges that the search went along, which are those that meet a
    node it went on from."""
    e = edges.where(F.col("relationship").isin(*relationships)) if relationships else edges
    found = _cut(neighbors(e, start, depth, direction=direction))
    inner = found.where(F.col("distance") < depth).select("node_id")
    out = e.join(inner.withColumnRenamed("node_id", "source_id"), "source_id", "left_semi")
    back = e.join(inner.withColumnRenamed("node_id", "target_id"), "target_id", "left_semi")
    mine = {"out": out, "in": back}.get(direction, out.unionByName(back)).dropDuplicates(["edge_id"])
    return found, mine.select(*edges.columns)


def find_path(edges: DataFrame, source: str, target: str, max_depth: int = 6) -> list[str] | None:
    """The first shortest path that a search in order of (node, edge) finds, as nodes; edges count both ways.

    A node's discovery order is its parent's order, then the node, so it is carried as the path itself.
    """
    steps = _steps(edges, "both", ()).select("a", "b")
    return _search(edges.sparkSession, lambda front: front.join(steps, front["node_id"] == steps["a"]).select("b", "path"), source, target, max_depth)


def _search(spark, step, source: str, target: str, max_depth: int) -> list[str] | None:
    """step(front: node_id, path) gives (b, path): where edges lead from the front, with the path to where they begin."""
    if source == target:
        return [source]
    front = spark.createDataFrame([(source, [source])], "node_id string, path array<string>")
    seen = front.select("node_id")
    for _ in range(max_depth):
        near = step(front).withColumnRenamed("b", "node_id")
        fresh = near.join(seen, "node_id", "left_anti").groupBy("node_id").agg(F.min("path").alias("path"))
        front = _cut(fresh.select("node_id", F.concat("path", F.array("node_id")).alias("path")))
        if hit := front.where(F.col("node_id") == target).first():
            return hit["path"]
        if not front.limit(1).count():
            return None
        seen = seen.unionByName(front.select("node_id"))
    return None


def find_path_of_all(memories: DataFrame, meetings: DataFrame, source: str, target: str, max_depth: int = 6, vocabulary: Vocabulary = Vocabulary()) -> list[str] | None:
    """find_path() over edges of every kind; of resolves edges only those are made that meet the search's front."""
    steps = _cut(_steps(edges(memories, meetings, vocabulary, resolves=False), "both", ()).select("a", "b").distinct())
    commitments, issues = (_cut(x) for x in _resolving(memories, meetings, vocabulary))

    def step(front: DataFrame) -> DataFrame:
        mine = lambda rows: rows.join(front.select("node_id"), memory_node() == F.col("node_id"), "left_semi")
        solved = _resolves(mine(commitments), issues).unionByName(_resolves(commitments, mine(issues)))
        met = steps.unionByName(_steps(solved.withColumn("edge_id", F.lit("")), "both", ()).select("a", "b"))
        return front.join(met, front["node_id"] == met["a"]).select("b", "path")

    return _search(memories.sparkSession, step, source, target, max_depth)


def connected_components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node_id, component): the least node that each node reaches; nodes without edges are their own."""
    e = _cut(_steps(edges, "both", ()).select("a", "b").distinct())
    label = nodes.select("node_id", F.col("node_id").alias("component"))
    for _ in range(most_rounds):
        near = e.join(label.withColumnRenamed("node_id", "b"), "b").groupBy(F.col("a").alias("node_id")).agg(F.min("component").alias("m"))
        lower = label.join(near, "node_id", "left").select("node_id", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        lower = _cut(lower)
        onward = lower.select(F.col("node_id").alias("component"), F.col("component").alias("next"))
        jumped = _cut(lower.join(onward, "component", "left").select("node_id", "old", F.coalesce("next", "component").alias("component")))
        label = jumped.select("node_id", "component")
        if not jumped.where("component <> old").limit(1).count():
            return label
    raise RuntimeError("the components did not settle")


def _walked(members: DataFrame, jump: DataFrame) -> DataFrame:
    """(start, memory_id, position): members and all that their pointers (memory_id, next) lead to.

    A round doubles how far all pointers reach, so a chain of n takes about log2(n) rounds. A round that adds
    nothing is the last: positions of a chain have no gaps. A chain that leads back into itself ends there.
    """
    members, jump = _cut(members), _cut(jump)
    have, reach = members.count(), 1
    while True:
        ahead = members.join(jump, "memory_id").select("start", F.col("next").alias("memory_id"), (F.col("position") + reach).alias("position"))
        # a chain that leads back into itself meets its memories again, later
        members = _cut(members.unionByName(ahead).groupBy("start", "memory_id").agg(F.min("position").alias("position")))
        found = members.count()
        if found == have:
            return members
        onward = jump.select(F.col("memory_id").alias("next"), F.col("next").alias("further"))
        jump = _cut(jump.join(onward, "next").select("memory_id", F.col("further").alias("next")))
        have, reach = found, reach * 2


def chain_members(memories: DataFrame) -> DataFrame:
    """(start, memory_id, position): the memories of each supersession chain, the oldest at position 0.

    Chains begin at memories that supersede none and end where a pointer leads out of the table or back into the
    chain.
    """
    link = _cut(memories.where("superseded_by <> ''").select("memory_id", "superseded_by"))
    starts = link.join(link.select(F.col("superseded_by").alias("memory_id")).distinct(), "memory_id", "left_anti")
    known = memories.select(F.col("memory_id").alias("superseded_by"))
    jump = link.join(known, "superseded_by", "left_semi").select("memory_id", F.col("superseded_by").alias("next"))
    return _walked(starts.select(F.col("memory_id").alias("start"), "memory_id", F.lit(0).cast("long").alias("position")), jump)


def chains(memories: DataFrame) -> DataFrame:
    """(start, latest, ids): supersession chains from the oldest memory on, at least two long."""
    placed = chain_members(memories).groupBy("start").agg(F.array_sort(F.collect_list(F.struct("position", "memory_id"))).alias("m")).where(F.size("m") > 1)
    return placed.select("start", F.element_at("m", -1)["memory_id"].alias("latest"), F.col("m.memory_id").alias("ids"))


def lineages(edges: DataFrame, relationship: str = "supersedes") -> DataFrame:
    """(component, node_id, position): the lineage of each component of edges from newer to older, the newest at position 0.

    It begins at the least node that nothing is newer than (in a ring, at the least newer one) and goes on to the
    least older node each time, until there is none or it was there before.
    """
    every = _cut(edges.where(F.col("relationship") == relationship).select("source_id", "target_id").distinct())
    ends = every.select(F.col("source_id").alias("node_id")).unionByName(every.select(F.col("target_id").alias("node_id"))).distinct()
    label = _cut(connected_components(ends, every.withColumn("edge_id", F.lit(""))))
    newer = every.select(F.col("source_id").alias("node_id")).distinct()
    top = newer.join(every.select(F.col("target_id").alias("node_id"), F.lit(False).alias("top")).distinct(), "node_id", "left").withColumn("top", F.coalesce("top", F.lit(True)))
    heads = top.join(label, "node_id").groupBy("component").agg(F.min_by("node_id", F.struct(~F.col("top"), "node_id")).alias("memory_id"))
    jump = every.groupBy(F.col("source_id").alias("memory_id")).agg(F.min("target_id").alias("next"))
    walked = _walked(heads.select(F.col("component").alias("start"), "memory_id", F.lit(0).cast("long").alias("position")), jump)
    return walked.select(F.col("start").alias("component"), F.col("memory_id").alias("node_id"), "position")


def lineage(edges: DataFrame, node: str, relationship: str = "supersedes", depth: int = 256) -> list[str]:
    """The lineage of the component that a node stands in, oldest first; the node alone if no such edge meets it.

    As a search from the node goes depth steps, nodes further than that up or one step more down are left out;
    lineages() has the whole of each. Only this one lineage comes to the driver.
    """
    every = edges.where(F.col("relationship") == relationship).select("source_id", "target_id")
    ends = every.select(F.col("source_id").alias("node_id")).unionByName(every.select(F.col("target_id").alias("node_id"))).distinct()
    label = _cut(connected_components(ends, every.withColumn("edge_id", F.lit(""))))
    mine = label.join(label.where(F.col("node_id") == node).select("component"), "component", "left_semi").select(F.col("node_id").alias("source_id"))
    one = lineages(every.join(mine, "source_id", "left_semi").withColumn("relationship", F.lit(relationship)), relationship)
    if place := one.where(F.col("node_id") == node).first():
        one = one.where(F.col("position").between(place["position"] - depth, place["position"] + depth + 1))
    return [r["node_id"] for r in one.orderBy(F.desc("position")).collect()] or [node]


def decision_lineage(edges: DataFrame, node: str) -> list[str]:
    return lineage(edges, node, "supersedes")


def risk_lineage(edges: DataFrame, node: str) -> list[str]:
    return lineage(edges, node, "connected_to")
