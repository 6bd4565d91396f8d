"""The graph grown by batches, and the two joins that a hot key must not slow down, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from quorumlens.operators import graph, growth, store
from quorumlens.plans import sample

MEMORY = "memory_id string, meeting_id string, memory_type string, text string, speaker string, owner string, content_hash string, superseded_by string"
MEETING = "meeting_id string, title string, date string, participants array<string>"
TEXTS = ["We use kafka for Project Atlas", "Customer Acme needs redis", "Project Borealis on postgres", "nothing here", "kafka and redis for Project Atlas"]


def meetings_and_memories(spark, n, seed):
    r = random.Random(seed)
    meet, mem = [], []
    for m in range(n):
        people = r.sample(["Ana", "Bo", "Cy", "Di"], r.randint(0, 3))
        meet.append((f"m{m}", r.choice([None, "Project Atlas Sync", "Retro"]), r.choice([None, f"2026-01-{r.randint(1, 9):02d}"]), people))
        for i in range(r.randint(0, 6)):
            kind, text = r.choice(["decision", "commitment", "risk", "open_loop", "question", "assumption", "fact"]), r.choice(TEXTS)
            mem.append([f"m{m}:{kind}:{i}", f"m{m}", kind, text, r.choice([None, "", "Ana", "Bo"]), r.choice([None, "Cy"]), f"{kind[:1]}{TEXTS.index(text)}", None])
    for x in r.sample(mem, len(mem) // 4):
        x[7] = r.choice(mem)[0]
    return spark.createDataFrame(mem, MEMORY), spark.createDataFrame(meet, MEETING)


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_come_to_the_whole_graph(spark, tmp_path, seed):
    """Batches in random order, with pointers and contents across them; a batch that comes twice changes nothing."""
    mem, meet = meetings_and_memories(spark, 24, seed)
    s = store.Store(spark, f"{tmp_path}/store")
    dealt = meet.withColumn("b", F.xxhash64("meeting_id", F.lit(seed)) % 3)
    total, removed = 0, 0
    for k in (-2, -1, 0, 1, 2):
        mine = dealt.where(F.col("b") == k).drop("b")
        if not mine.count():
            continue
        batch = mem.join(mine.select("meeting_id"), "meeting_id", "left_semi")
        for r in growth.grow(s, batch, mine).collect():
            total, removed = total + r["added"] - r["removed"], removed + r["removed"]
    want = {r["edge_id"]: r for r in graph.edges(mem, meet).collect()}
    got = {r["edge_id"]: r for r in s.graph()[1].collect()}
    assert set(got) == set(want) and total == len(want) and removed > 0
    assert {r["node_id"] for r in s.graph()[0].collect()} == {r["node_id"] for r in graph.nodes(mem, meet).collect()}
    again = growth.grow(s, mem, meet)
    assert again.count() == 0 and s.graph()[1].count() == len(want)
    s.compact()
    assert {r["edge_id"] for r in s.graph()[1].collect()} == set(want)


def test_structural_edges_read_each_table_once(spark):
    mem, meet = sample.store(spark, "/root/testdata/sf0.001")[1:]
    for df in (graph.structural_edges(mem, meet), graph.nodes(mem, meet)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("InMemoryRelation") <= 2


def test_predecessors_of_a_hot_key(spark):
    """One key has 90 % of all rows: each row gets the one before it, and no task much more than the others."""
    r = random.Random(3)
    rows = [("hot" if r.random() < 0.9 else f"k{r.randint(0, 50)}", r.randint(0, 400), i) for i in range(20_000)]
    df = spark.createDataFrame(rows, "k string, day int, ident int").repartition(8)
    got = {x["ident"]: x["before"]["ident"] if x["before"] else None for x in graph.with_predecessor(df, "k", ["day", "ident"], ["ident"]).collect()}
    want, last = {}, {}
    for k, day, ident in sorted(rows):
        want[ident], last[k] = last.get(k), ident
    assert got == want
    sizes = [x["count"] for x in graph.placed(df, ["k", "day", "ident"], "runs").groupBy(F.shiftright("_place", 33)).count().collect()]
    assert max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_inequality_join(spark, block):
    r = random.Random(block)
    entity = lambda: "hot" if r.random() < 0.7 else f"e{r.randint(0, 9)}"
    c = [(entity(), f"2026-{r.randint(1, 12):02d}", f"c{i}") for i in range(150)]
    i_ = [(entity(), f"2026-{r.randint(1, 12):02d}", f"r{i}", r.choice(["risk", "open_loop"])) for i in range(200)]
    commitments = spark.createDataFrame(c, "entity_id string, date string, memory_id string").withColumn("memory_type", F.lit("commitment"))
    issues = spark.createDataFrame(i_, "entity_id string, date string, memory_id string, memory_type string")
    got = sorted((x["memory_id"], x["issue_id"]) for x in graph.not_later(commitments, issues, block).collect())
    assert got == sorted((m, i) for e, d, m in c for e2, d2, i, _ in i_ if e == e2 and d >= d2)
    assert graph.not_later(commitments.limit(0), issues).count() == 0 and graph.not_later(commitments, issues.limit(0)).count() == 0


def test_the_sample_store_survives_a_cleared_cache(spark):
    assert sample.store(spark, "/root/testdata/sf0.001")[1].storageLevel.useMemory
    spark.catalog.clearCache()
    assert sample.store(spark, "/root/testdata/sf0.001")[1].storageLevel.useMemory
    sample.forget(spark)
    assert not any(k[0] == spark.sparkContext.applicationId for k in sample._STORES)


def test_subgraph_and_paths(spark):
    mem, meet = meetings_and_memories(spark, 6, 5)
    every = graph.edges(mem, meet).cache()
    rows = every.collect()
    near, walked = graph.subgraph(every, ["person:ana"], 2)
    inner = {x["node_id"] for x in near.collect() if x["distance"] < 2}
    assert {x["edge_id"] for x in walked.collect()} == {x["edge_id"] for x in rows if x["source_id"] in inner or x["target_id"] in inner}
    some = next(x for x in rows if x["relationship"] == "resolves")
    assert {x["edge_id"] for x in graph.edges_of(mem, meet, some["source_id"]).collect()} == {x["edge_id"] for x in rows if some["source_id"] in (x["source_id"], x["target_id"])}
    assert {x["edge_id"] for x in graph.edges_of(mem, meet, some["target_id"]).collect()} == {x["edge_id"] for x in rows if some["target_id"] in (x["source_id"], x["target_id"])}
    assert graph.find_path_of_all(mem, meet, some["source_id"], some["target_id"]) == graph.find_path(every, some["source_id"], some["target_id"]) == [some["source_id"], some["target_id"]]
    assert graph.find_path_of_all(mem, meet, "person:ana", "person:nobody") is None
