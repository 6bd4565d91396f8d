"""The queries over edges of every kind against the graph with all its pairs."""

from pyspark.sql import functions as F

from quorumlens.operators import graph
from quorumlens.plans import registry, sample

DATA = "/root/testdata/sf0.001"


def test_queries_hold_resolves_edges(spark):
    _, mem, meet = sample.store(spark, DATA)
    every = graph.edges(mem, meet).cache()
    ask = lambda name: registry.QUERIES[name](spark, DATA)
    want = {r[0]: r[1] for r in every.groupBy("relationship").agg(F.count("*")).collect()}
    assert want["resolves"] > 0 and {r["relationship"]: r["n"] for r in ask("edge_summary_all").collect()} == want
    assert {r["edge_id"] for r in ask("edge_ids_all").collect()} == {r["edge_id"] for r in every.collect()}
    near = {tuple(r) for r in graph.neighbors(every, ["technology:postgres"], 2).collect()}
    assert near == {tuple(r) for r in ask("neighbors_depth2_all").collect()}
    parts = {tuple(r) for r in graph.connected_components(graph.nodes(mem, meet).select("node_id"), every).collect()}
    assert parts == {tuple(r) for r in ask("connected_components_all").collect()}
