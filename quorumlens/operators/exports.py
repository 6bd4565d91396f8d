"""Exports as tables of lines, and their writers."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_whitespace

#: Fixed value: the length of a node's label in drawings.
LABEL = 48


def csv_rows(memories: DataFrame) -> DataFrame:
    return memories.select("memory_id", "meeting_id", "memory_type", "status", F.coalesce("speaker", F.lit("")).alias("speaker"), F.format_string("%.4f", "confidence").alias("confidence"), "text")


def write_csv(memories: DataFrame, path: str) -> None:
    """Sorted by memory_id across files; the header stands in each."""
    csv_rows(memories).orderBy("memory_id").write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def _label(nodes: DataFrame) -> Column:
    text = normalize_whitespace(F.col("label"))
    short = F.when(F.char_length(text) > LABEL, F.concat(F.rtrim(F.substring(text, 1, LABEL - 1)), F.lit("…"))).otherwise(text)
    return F.concat_ws(": ", "node_type", short)


def _escaped(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def dot_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.concat(F.lit('  "'), _escaped(F.col("source_id")), F.lit('" -> "'), _escaped(F.col("target_id")), F.lit('" [label="'), F.replace("relationship", F.lit("_"), F.lit(" ")), F.lit('"];')).alias("line"))


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, line): a DOT drawing once sorted by both."""
    head = nodes.sparkSession.createDataFrame([(0, "digraph memory_graph {"), (0, "  rankdir=LR;"), (3, "}")], "part int, line string")
    body = nodes.select(F.lit(1).alias("part"), F.concat(F.lit('  "'), _escaped(F.col("node_id")), F.lit('" [label="'), _escaped(_label(nodes)), F.lit('"];')).alias("line"))
    return head.unionByName(body).unionByName(dot_edges(edges).select(F.lit(2).alias("part"), "line"))


def mermaid_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, place, line) of a Mermaid drawing; edges without both ends are left out.

    Nodes are named by their ids' hashes, so that no task needs to number them all.
    """
    named = nodes.withColumn("_n", F.concat(F.lit("n"), F.substring(F.sha1("node_id"), 1, 16)))
    alias = lambda c, name: named.select(F.col("node_id").alias(c), F.col("_n").alias(name))
    box = named.select(F.lit(1).alias("part"), F.col("node_id").alias("place"), F.concat(F.lit("    "), F.col("_n"), F.lit('["'), F.replace(_label(nodes), F.lit('"'), F.lit("'")), F.lit('"]')).alias("line"))
    both = edges.join(alias("source_id", "_a"), "source_id").join(alias("target_id", "_b"), "target_id")
    arrow = both.select(F.lit(2).alias("part"), F.concat_ws("\u001f", "source_id", "relationship", "target_id", "discriminator").alias("place"), F.concat(F.lit("    "), F.col("_a"), F.lit(" -->|"), F.replace("relationship", F.lit("_"), F.lit(" ")), F.lit("| "), F.col("_b")).alias("line"))
    return nodes.sparkSession.createDataFrame([(0, "", "graph TD")], "part int, place string, line string").unionByName(box).unionByName(arrow)


def json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("line"))


def meeting_summaries(memories: DataFrame, meetings: DataFrame) -> DataFrame:
    """(meeting_id, part, place, line): a Markdown section for each meeting once sorted, a row a line."""
    per = memories.groupBy("meeting_id").agg(F.count("*").alias("n"))
    m = meetings.join(per, "meeting_id", "left")
    people = F.coalesce(F.nullif(F.array_join("participants", ", "), F.lit("")), F.lit("n/a"))
    heads = m.select("meeting_id", F.lit(0).alias("part"), F.posexplode(F.array(
        F.concat(F.lit("## "), F.coalesce("title", F.lit("(untitled)")), F.lit(" ("), F.col("meeting_id"), F.lit(")")),
        F.concat(F.lit("- date: "), F.coalesce("date", F.lit("n/a"))), F.concat(F.lit("- participants: "), people), F.concat(F.lit("- memories: "), F.coalesce("n", F.lit(0)).cast("string")),
    )).alias("p", "line")).select("meeting_id", "part", F.col("p").cast("string").alias("place"), "line")
    rows = memories.select("meeting_id", F.lit(1).alias("part"), F.concat_ws(":", "memory_type", "memory_id").alias("place"), F.concat(F.lit("  - ["), F.col("memory_type"), F.lit("] "), F.coalesce("speaker", F.lit("?")), F.lit(": "), F.col("text")).alias("line"))
    return heads.unionByName(rows)


def report(insights: DataFrame, health: DataFrame, recommendations: DataFrame, most: int = 50, projects: DataFrame | None = None, people: DataFrame | None = None) -> dict:
    """The head of a report as plain values: the scores, and the `most` gravest insights and recommendations and first projects and people."""
    from .intelligence import ordered, ordered_recommendations

    rows = lambda df, order: [r.asDict() for r in (df.orderBy(*order) if order else df).limit(most).collect()]
    out = {"health": health.first().asDict(), "insights": rows(ordered(insights), ()), "recommendations": rows(ordered_recommendations(recommendations), ())}
    if projects is not None:
        out["projects"] = rows(projects, ("name", "project_id"))
    if people is not None:
        out["people"] = rows(people, ("name",))
    return out


def _sections(data: dict) -> list[tuple[str, list[str]]]:
    """(heading, lines) of a report."""
    out = [("Health", [f"{k.replace('_', ' ')}: {v}" for k, v in data["health"].items()])]
    out += [(name.title(), [f"{x['severity']} - {x['title']}: {x['detail']}" for x in data[name]]) for name in ("insights", "recommendations")]
    numbers = lambda x: ", ".join(f"{k.replace('_', ' ')} {v}" for k, v in x.items() if k not in ("name", "project_id"))
    return out + [(name.title(), [f"{x['name']}: {numbers(x)}" for x in data[name]]) for name in ("projects", "people") if name in data]


def report_markdown(data: dict) -> str:
    return "\n".join(["# Report", *(line for head, lines in _sections(data) for line in ("", f"## {head}", "", *(f"- {x}" for x in lines)))]) + "\n"


def report_text(data: dict) -> str:
    return "\n".join(["REPORT", *(line for head, lines in _sections(data) for line in ("", head.upper(), *(f"  {x}" for x in lines)))]) + "\n"


def report_html(data: dict) -> str:
    """One page; its insights are those on decisions, commitments and risks."""
    import html

    chosen = {**data, "insights": [x for x in data["insights"] if x["category"] in ("decision", "commitment", "risk")]}
    body = "".join(f"<h2>{html.escape(head)}</h2><ul>{''.join(f'<li>{html.escape(x)}</li>' for x in lines)}</ul>" for head, lines in _sections(chosen))
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>Report</title></head><body><h1>Report</h1>{body}</body></html>'


def report_json(data: dict) -> str:
    return json.dumps(data, sort_keys=True, ensure_ascii=False, indent=2)


@dataclass(frozen=True)
class Exporter:
    """lines makes (order columns, line) from tables by name (memories, meetings, nodes, edges); files with these endings are its."""

    endings: Sequence[str]
    lines: Callable[[Mapping[str, DataFrame]], DataFrame]
    order: Sequence[str]


def _csv_lines(tables: Mapping[str, DataFrame]) -> DataFrame:
    rows = csv_rows(tables["memories"])
    head = rows.sparkSession.createDataFrame([(0, "", ",".join(rows.columns))], "part int, place string, line string")
    cell = F.to_csv(F.struct(*rows.columns), {"quote": '"', "escape": '"', "emptyValue": ""})
    return head.unionByName(rows.select(F.lit(1).alias("part"), F.col("memory_id").alias("place"), cell.alias("line")))


#: Exporters by name. register_exporter() adds one's own.
EXPORTERS: dict[str, Exporter] = {
    "csv": Exporter((".csv",), _csv_lines, ("part", "place")),
    "dot": Exporter((".dot", ".gv"), lambda t: dot_lines(t["nodes"], t["edges"]), ("part", "line")),
    "json": Exporter((".json", ".jsonl"), lambda t: json_lines(t["memories"]), ("line",)),
    "markdown": Exporter((".md", ".markdown"), lambda t: meeting_summaries(t["memories"], t["meetings"]), ("meeting_id", "part", "place")),
    "mermaid": Exporter((".mmd",), lambda t: mermaid_lines(t["nodes"], t["edges"]), ("part", "place")),
}


def register_exporter(name: str, exporter: Exporter) -> None:
    """Add an exporter; a name or an ending that is taken is an error."""
    taken = {e: n for n, x in EXPORTERS.items() for e in x.endings}
    if name in EXPORTERS:
        raise ValueError(f"there is an exporter {name!r}")
    if clash := [e for e in exporter.endings if e in taken]:
        raise ValueError(f"{clash[0]} is {taken[clash[0]]}'s")
    EXPORTERS[name] = exporter


def exporter_for(path: str) -> Exporter:
    found = [x for x in EXPORTERS.values() if any(path.lower().endswith(e) for e in x.endings)]
    if not found:
        raise ValueError(f"no exporter writes {path!r}; endings are {', '.join(sorted(e for x in EXPORTERS.values() for e in x.endings))}")
    return found[0]


def export(tables: Mapping[str, DataFrame], path: str) -> None:
    """Write what the path's ending asks for, as a folder of text files whose lines are in order across files."""
    exporter = exporter_for(path)
    exporter.lines(tables).orderBy(*exporter.order).select("line").write.text(path)
