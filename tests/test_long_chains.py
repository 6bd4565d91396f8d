"""Supersession chains of any length come out whole."""

import pytest

from quorumlens.operators import graph


def memories(spark, pointers):
    return spark.createDataFrame(list(pointers.items()), "memory_id string, superseded_by string").coalesce(2)


def test_chains_longer_than_a_hundred(spark):
    line = [f"a{i:03}" for i in range(300)]
    pointers = dict(zip(line, [*line[1:], None]))
    pointers |= {"b0": "a250", "c0": "gone", "d0": "d1", "d1": "d2", "d2": "d3", "d3": "d1", "e0": "e1", "e1": "e0", "f0": "f0", "g0": "", "h0": "h1", "h1": "gone"}
    got = {r["start"]: (r["latest"], r["ids"]) for r in graph.chains(memories(spark, pointers)).collect()}
    assert got == {
        "a000": ("a299", line), "b0": ("a299", ["b0", *line[250:]]), "d0": ("d3", ["d0", "d1", "d2", "d3"]), "h0": ("h1", ["h0", "h1"]),
    }
    assert graph.chains(memories(spark, pointers).limit(0)).count() == 0


@pytest.mark.parametrize(("length", "want"), [(200, 200), (600, 600)])
def test_lineage_of_a_long_chain(spark, length, want):
    edges = spark.createDataFrame([(f"n{i:03}", "supersedes", f"n{i - 1:03}") for i in range(1, length)], "source_id string, relationship string, target_id string")
    middle = f"n{length // 2:03}"
    reach = range(max(0, length // 2 - 257), min(length, length // 2 + 257))
    assert graph.lineage(edges, middle) == [f"n{i:03}" for i in reach][-want:]
