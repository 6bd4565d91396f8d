"""Providers that decline a context, and exporters by ending."""

import pytest
from pyspark.sql import functions as F

from quorumlens.operators import exports, intelligence
from quorumlens.plans import sample

DATA = "/root/testdata/sf0.001"


def test_providers(spark):
    _, mem, meet = sample.store(spark, DATA)
    c = intelligence.context(mem, meet, memory_types=["commitment"])
    found = intelligence.facts(c)
    assert found.any("commitment") and not found.any("decision", "risk") and found.meetings == meet.count()
    projects = intelligence.project_metrics(mem, meet)
    assert sorted(intelligence.provided("insights", c, projects, found)) == ["commitment", "risk"]
    assert sorted(intelligence.provided("insights", c, projects)) == ["commitment", "decision", "risk"]
    never = intelligence.Provider(lambda c, p: 1 / 0, lambda f: False)
    intelligence.register("insights", "never", never)
    try:
        assert {r["category"] for r in intelligence.insights(c, projects, found=found).select("category").distinct().collect()} <= {"commitment", "person", "project"}
        with pytest.raises(ValueError, match="already has"):
            intelligence.register("insights", "never", never)
    finally:
        intelligence.unregister("insights", "never")
    with pytest.raises(ValueError, match="unknown kind"):
        intelligence.register("charts", "x", never)
    with pytest.raises(ValueError, match="no provider"):
        intelligence.provided("reports", c, projects, names=["none"])
    empty = intelligence.context(mem.limit(0), meet.limit(0))
    assert intelligence.report_lines(empty, projects, intelligence.facts(empty)) is None
    assert intelligence.insights(empty, projects.limit(0), found=intelligence.facts(empty)).count() == 0


def test_exporters(spark, tmp_path):
    _, mem, meet = sample.store(spark, DATA)
    tables = {"memories": mem, "meetings": meet}
    exports.export(tables, f"{tmp_path}/all.CSV")
    lines = [r[0] for r in spark.read.text(f"{tmp_path}/all.CSV").collect()]
    assert len(lines) == mem.count() + 1
    exports.export(tables, f"{tmp_path}/notes.md")
    assert spark.read.text(f"{tmp_path}/notes.md").where("value like '## %'").count() == meet.count()
    count = exports.Exporter((".count",), lambda t: t["memories"].agg(F.count("*").cast("string").alias("line")), ("line",))
    exports.register_exporter("count", count)
    try:
        exports.export(tables, f"{tmp_path}/n.count")
        assert spark.read.text(f"{tmp_path}/n.count").first()[0] == str(mem.count())
        for name, other in (("count", count), ("again", count), ("x", exports.Exporter((".md",), count.lines, ()))):
            with pytest.raises(ValueError):
                exports.register_exporter(name, other)
    finally:
        del exports.EXPORTERS["count"]
    with pytest.raises(ValueError, match="no exporter"):
        exports.export(tables, f"{tmp_path}/x.pdf")
