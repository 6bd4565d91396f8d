"""Metrics, insights, health and recommendations across meetings.

Every function takes a Context. Evidence is a table of its own, a row a memory, so that a finding that rests on
very many memories is never one row with a long array.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.text import days_between, node_id, quote, round_half_even, severity, slugify
from . import graph as G

INSIGHT = ("insight_id", "type", "category", "severity", "title", "detail", "metric", "subject")


@dataclass(frozen=True)
class Context:
    """memories without deleted ones, with `date` (of the meeting, '' if none) and `responsible`; their meetings; edges."""

    memories: DataFrame
    meetings: DataFrame
    reference: DataFrame  # one row: reference_date, span_days, n_meetings

    def of(self, *types: str) -> DataFrame:
        return self.memories.where(F.col("memory_type").isin(*types))


def responsible() -> Column:
    return F.coalesce(F.nullif("owner", F.lit("")), F.nullif("speaker", F.lit("")))


def context(memories: DataFrame, meetings: DataFrame, meeting_ids: Sequence[str] = (), memory_types: Sequence[str] = (), person: str | None = None, project: str | None = None, reference_date: str | None = None) -> Context:
    """The filtered view that analyses work on; the reference date is the latest meeting's."""
    if meeting_ids:
        meetings = meetings.where(F.col("meeting_id").isin(*meeting_ids))
    rows = memories.where("status <> 'deleted'").withColumn("responsible", responsible())
    if memory_types:
        rows = rows.where(F.col("memory_type").isin(*memory_types))
    if person:
        rows = rows.where(F.col("responsible") == person)
    if project:
        linked = G.mentions(memories).where(F.col("entity_id") == node_id("project", slugify(F.lit(project)))).select("memory_id").distinct()
        rows = rows.join(linked, "memory_id", "left_semi")
    rows = rows.join(meetings.select("meeting_id", F.coalesce("date", F.lit("")).alias("date")), "meeting_id")
    found = meetings.agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("n_meetings"))
    last = F.lit(reference_date) if reference_date else F.coalesce("last", F.lit(""))
    return Context(rows, meetings, found.select(last.alias("reference_date"), days_between(F.col("first"), F.col("last")).alias("span_days"), "n_meetings"))


def _with_reference(rows: DataFrame, c: Context) -> DataFrame:
    return rows.join(F.broadcast(c.reference))  # one row


def _count(test: Column | str) -> Column:
    return F.count_if(F.expr(test) if isinstance(test, str) else test)


def _share(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.when(whole > 0, round_half_even(part / whole, digits)).otherwise(0.0)


def groups(rows: DataFrame) -> DataFrame:
    """(content_hash, meetings, n, first, last, active, text): one row a content, text being the oldest's."""
    return rows.groupBy("content_hash").agg(
        F.countDistinct("meeting_id").alias("meetings"), F.count("*").alias("n"), F.min(F.nullif("date", F.lit(""))).alias("first"), F.max(F.nullif("date", F.lit(""))).alias("last"),
        _count("status = 'active'").alias("active"), F.min_by("text", F.struct("created_at", "memory_id")).alias("text"),
    )


def recurring(rows: DataFrame) -> DataFrame:
    span = F.when(F.col("first").isNotNull(), days_between(F.col("first"), F.col("last"))).otherwise(0)
    return groups(rows).where("meetings > 1").withColumn("span_days", span)


def top(rows: DataFrame, name: str) -> DataFrame:
    """One row (name, n): the value that comes most often, of equals the first by name; nulls if there is none."""
    n = rows.where(F.col(name) != "").groupBy(name).agg(F.count("*").alias("n"))
    return n.agg(F.min_by(F.col(name), F.struct(-F.col("n"), F.col(name))).alias("name"), F.coalesce(F.max("n"), F.lit(0)).alias("n"), F.count("*").alias("distinct"))


def decision_metrics(c: Context) -> DataFrame:
    d = c.of("decision")
    base = d.agg(F.count("*").alias("total"), _count("status = 'active'").alias("active"), _count("status = 'superseded'").alias("superseded"))
    again = recurring(d).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("revisited"))
    who = top(d, "speaker").select(F.col("name").alias("top_owner"), F.col("distinct").alias("distinct_owners"))
    row = base.join(again).join(who).join(c.reference)  # one row each
    return row.select("total", "active", "superseded", "revisited", _share(F.col("active"), F.col("total")).alias("stability"), round_half_even(F.col("total") / F.greatest("n_meetings", F.lit(1)), 4).alias("density"),
                      round_half_even(F.col("total") / (F.greatest("span_days", F.lit(7)) / 7.0), 4).alias("velocity_per_week"), "distinct_owners", "top_owner")


def overdue_days(due: Column, status: Column, reference: Column) -> Column:
    iso = due.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(due, "yyyy-MM-dd").isNotNull()
    return F.when(iso & (status == "active"), F.greatest(days_between(due, reference), F.lit(0))).otherwise(0)


def commitment_metrics(c: Context) -> DataFrame:
    d = _with_reference(c.of("commitment"), c)
    is_open = F.col("status") == "active"
    age = F.when(is_open & (F.col("date") != ""), days_between(F.col("date"), F.col("reference_date")))
    base = d.agg(F.count("*").alias("total"), _count(is_open).alias("open"), _count("status = 'resolved'").alias("resolved"),
                 _count(overdue_days(F.col("due"), F.col("status"), F.col("reference_date")) > 0).alias("overdue"), F.coalesce(round_half_even(F.avg(age), 2), F.lit(0.0)).alias("avg_open_age_days"))
    who = top(c.of("commitment").where("status = 'active'"), "responsible").select(F.col("name").alias("top_owner"), F.col("n").alias("top_owner_open"))
    return base.join(who).select("total", "open", "resolved", "overdue", _share(F.col("resolved"), F.col("total")).alias("resolution_rate"), "avg_open_age_days", "top_owner", "top_owner_open")


def project_metrics(memories: DataFrame, meetings: DataFrame) -> DataFrame:
    """Per project: edges that come in from risks, decisions and meetings, and blocks; analysis filters do not count.

    A risk that mentions a project has two edges to it (mentions, blocks), as a decision has (mentions, relates_to). Each
    table is read once: rows are (project, what mentions it), and a meeting counts once whether its title or a memory does.
    """
    of_project = lambda text: F.filter(G.entities(text), lambda e: e["kind"] == "project")
    kind = F.when(F.col("memory_type").isin("risk", "decision"), F.col("memory_type"))
    said = memories.select("meeting_id", "memory_id", kind.alias("kind"), F.explode(of_project(F.col("text"))).alias("e"))
    titled = meetings.select("meeting_id", F.lit(None).cast("string").alias("memory_id"), F.lit(None).cast("string").alias("kind"), F.explode(of_project(F.coalesce("title", F.lit("")))).alias("e"))
    ident = node_id("project", slugify(F.col("e.name")))
    rows = said.unionByName(titled).groupBy(ident.alias("project_id"), "meeting_id", "memory_id", "kind").agg(F.min("e.name").alias("name"))
    per = rows.groupBy("project_id", "meeting_id").agg(F.min("name").alias("name"), _count("kind = 'risk'").alias("risks"), _count("kind = 'decision'").alias("decisions"))
    return per.groupBy("project_id").agg(F.min("name").alias("name"), (F.sum("risks") * 2).alias("risk_count"), (F.sum("decisions") * 2).alias("decision_count"), F.count("*").alias("meeting_count"), F.sum("risks").alias("blocker_count"))


def person_metrics(c: Context) -> DataFrame:
    keyed = lambda rows, name, what: rows.where(F.col(name) != "").select(F.col(name).alias("name"), *[F.lit(int(w == what)).alias(w) for w in ("open_commitments", "total_commitments", "decisions_owned", "meetings_attended")])
    work = c.of("commitment")
    rows = keyed(work, "responsible", "total_commitments").unionByName(keyed(work.where("status = 'active'"), "responsible", "open_commitments")).unionByName(keyed(c.of("decision"), "speaker", "decisions_owned"))
    there = c.meetings.select(F.explode(F.array_distinct("participants")).alias("p"))
    rows = rows.unionByName(keyed(there, "p", "meetings_attended"))
    return rows.groupBy("name").agg(*[F.sum(w).alias(w) for w in rows.columns[1:]])


def risk_metrics(c: Context, projects: DataFrame) -> DataFrame:
    d = c.of("risk")
    base = d.agg(F.count("*").alias("total"), _count("status = 'active'").alias("open"), _count("status in ('resolved', 'archived')").alias("resolved"))
    again = recurring(d).agg(F.count("*").alias("recurring"), F.coalesce(F.max("meetings"), F.lit(0)).alias("max_recurrence"))
    hot = projects.where("risk_count > 0").agg(F.min_by("name", F.struct(-F.col("risk_count"), F.col("project_id"))).alias("hotspot_project"))
    row = base.join(again).join(hot).join(c.reference)
    return row.select("total", "open", "resolved", _share(F.col("resolved"), F.col("total")).alias("resolution_rate"), "recurring", "max_recurrence", round_half_even(F.col("total") / F.greatest("n_meetings", F.lit(1)), 4).alias("density"), "hotspot_project")


def _reuse(c: Context) -> DataFrame:
    return groups(c.memories).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_memories"), F.count("*").alias("contents"), _count("meetings > 1").alias("repeated"), F.coalesce(F.sum(F.when(F.col("meetings") > 1, F.col("n"))), F.lit(0)).alias("reused"))


def meeting_metrics(c: Context) -> DataFrame:
    made = c.of("decision", "commitment").agg(F.count("*").alias("made"))
    row = _reuse(c).join(made).join(c.reference)
    return row.select(F.col("n_meetings").alias("total_meetings"), "total_memories", _share(F.col("total_memories"), F.col("n_meetings")).alias("avg_memories_per_meeting"), _share(F.col("made"), F.col("n_meetings")).alias("productivity"), _share(F.col("repeated"), F.col("contents")).alias("repeated_discussion_rate"), "span_days")


def health(c: Context, projects: DataFrame | None = None, productivity_target: float = 3.0) -> DataFrame:
    """One row of nine scores and their overall, the mean of the first six that rate (without rates of trouble).

    Memories are read once: counts by content, then their sums. projects is not needed, and taken for providers' sake.
    """
    is_ = lambda kind, *statuses: (F.col("memory_type") == kind) & (F.col("status").isin(*statuses) if statuses else F.lit(True))
    took = (F.unix_timestamp(F.try_to_timestamp("updated_at")) - F.unix_timestamp(F.try_to_timestamp("created_at"))) / 86400.0
    done = F.when(F.col("status").isin("resolved", "archived"), took)
    counts = {
        "n": F.lit(True), "decisions": is_("decision"), "stable": is_("decision", "active"), "commitments": is_("commitment"), "kept": is_("commitment", "resolved"),
        "risks": is_("risk"), "calmed": is_("risk", "resolved", "archived"),
    }
    by_content = c.memories.groupBy("content_hash").agg(F.countDistinct("meeting_id").alias("meetings"), F.sum(done).alias("took"), F.count(done).alias("timed"), *[_count(v).alias(k) for k, v in counts.items()])
    again = F.col("meetings") > 1
    base = by_content.agg(F.count("*").alias("contents"), _count(again).alias("repeated"), F.coalesce(F.sum(F.when(again, F.col("n"))), F.lit(0)).alias("reused"), *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in (*counts, "timed")], F.sum("took").alias("took"))
    people = c.meetings.select(F.array_distinct("participants").alias("p")).select(F.explode("p").alias("name"), (F.size("p") > 1).alias("with_others")).groupBy("name").agg(F.max("with_others").alias("w"))
    together = people.agg(_share(_count("w"), F.count("*")).alias("cross_team_collaboration"))
    x = F.col
    productivity = _share(x("decisions") + x("commitments"), x("n_meetings"))
    scores = {
        "decision_stability": _share(x("stable"), x("decisions")), "commitment_completion": _share(x("kept"), x("commitments")), "risk_resolution": _share(x("calmed"), x("risks")),
        "meeting_productivity": round_half_even(F.least(F.lit(1.0), productivity / productivity_target), 4), "knowledge_reuse": _share(x("reused"), x("n")), "cross_team_collaboration": x("cross_team_collaboration"),
        "repeated_discussion_rate": _share(x("repeated"), x("contents")), "risk_density": round_half_even(x("risks") / F.greatest("n_meetings", F.lit(1)), 4),
        "avg_resolution_days": F.coalesce(round_half_even(x("took") / F.nullif("timed", F.lit(0)), 2), F.lit(0.0)),
    }
    row = base.join(together).join(c.reference).select(*[v.alias(k) for k, v in scores.items()])  # one row each
    six = list(scores)[:6]
    return row.withColumn("overall", round_half_even(sum((x(k) for k in six[1:]), x(six[0])) / len(six), 4))


def _insight(rows: DataFrame, kind: str, category: str, level: Column, title: Column, detail: Column, metric: Column, subject: Column, *parts: Column) -> DataFrame:
    ident = F.concat_ws("-", *[slugify(p) for p in parts])
    return rows.select(ident.alias("insight_id"), F.lit(kind).alias("type"), F.lit(category).alias("category"), level.alias("severity"), title.alias("title"), detail.alias("detail"), metric.cast("double").alias("metric"), subject.alias("subject"))


def _text(form: str, *args: Column) -> Column:
    return F.format_string(form, *args)


def _percent(share: Column) -> Column:
    return round_half_even(share * 100, 0).cast("int")


def decision_insights(c: Context) -> list[DataFrame]:
    d = c.of("decision")
    at = c.memories.select(F.col("memory_id").alias("m"), F.nullif("date", F.lit("")).alias("md"))
    spans = G.chains(d)
    dates = spans.select("start", F.explode("ids").alias("m")).join(at, "m").groupBy("start").agg(F.min("md").alias("first"), F.max("md").alias("last"))
    text = d.select(F.col("memory_id").alias("latest"), "text")
    spans = spans.join(dates, "start").join(text, "latest").withColumns({"k": F.size("ids") - 1, "span": days_between(F.col("first"), F.col("last"))})
    q, k, s = quote(F.col("text")), F.col("k"), F.col("span")
    often = _insight(spans.where("k >= 2"), "repeatedly_superseded_decision", "decision", severity(k, 2, 3, 5), _text("Decision changed %s times", k), _text("%s has been superseded %s times, suggesting an unsettled decision.", q, k), k, F.col("latest"), F.lit("decision"), F.lit("superseded"), F.col("latest"))
    long = _insight(spans.where("span >= 30"), "long_running_decision", "decision", severity(s, 30, 90, 180), _text("Decision lineage spans %s days", s), _text("%s has been reworked over %s days without settling.", q, s), s, F.col("latest"), F.lit("decision"), F.lit("longrunning"), F.col("latest"))
    g, n = recurring(d), F.col("meetings")
    again = _insight(g, "revisited_decision", "decision", severity(n, 2, 4, 6), _text("Decision revisited across %s meetings", n), _text("%s was discussed in %s separate meetings without a durable resolution.", q, n), n, F.col("content_hash"), F.lit("decision"), F.lit("revisited"), F.col("content_hash"))
    one = d.agg(F.count("*").alias("n"), _count("status = 'active'").alias("a")).withColumn("s", F.col("a") / F.col("n")).where("n >= 4 and s < 0.5")
    loose = _insight(one, "unstable_decisions", "decision", F.lit("medium"), _text("Decision stability is low (%d%%)", _percent(F.col("s"))), _text("Only %s of %s decisions remain active; the rest were superseded or archived.", F.col("a"), F.col("n")), round_half_even(F.col("s"), 4), F.lit(None).cast("string"), F.lit("decision"), F.lit("unstable"))
    return [often, long, again, loose]


def commitment_insights(c: Context) -> list[DataFrame]:
    d = _with_reference(c.of("commitment"), c)
    live = d.where("status = 'active'").withColumns({"late": overdue_days(F.col("due"), F.col("status"), F.col("reference_date")), "age": F.when(F.col("date") != "", days_between(F.col("date"), F.col("reference_date"))), "who": F.coalesce("responsible", F.lit("unassigned"))})
    loads, n, who = live.where("responsible is not null").groupBy("responsible").agg(F.count("*").alias("n")).where("n >= 3"), F.col("n"), F.col("responsible")
    over = _insight(loads, "open_commitment_overload", "person", severity(n, 3, 5, 8), _text("%s owns %s open commitments", who, n), _text("%s is responsible for %s unresolved commitments, indicating a possible workload bottleneck.", who, n), n, who, F.lit("commitment"), F.lit("overload"), who)
    q, late, age, mid = quote(F.col("text")), F.col("late"), F.col("age"), F.col("memory_id")
    due = _insight(live.where("late > 0"), "overdue_commitment", "commitment", severity(late, 1, 14, 45), _text("Commitment overdue by %s days", late), _text("%s (owner: %s) was due %s and is %s days overdue.", q, F.col("who"), F.col("due"), late), late, mid, F.lit("commitment"), F.lit("overdue"), mid)
    old = _insight(live.where("age >= 30 and late = 0"), "aging_commitment", "commitment", severity(age, 30, 90, 180), _text("Commitment open for %s days", age), _text("%s (owner: %s) has been open for %s days without resolution.", q, F.col("who"), age), age, mid, F.lit("commitment"), F.lit("aging"), mid)
    one = d.agg(F.count("*").alias("n"), _count("status = 'resolved'").alias("r")).withColumn("rate", F.col("r") / F.col("n")).where("n >= 4 and rate < 0.4")
    low = _insight(one, "low_commitment_resolution", "commitment", F.when(F.col("rate") < 0.2, "high").otherwise("medium"), _text("Commitment resolution rate is low (%d%%)", _percent(F.col("rate"))), _text("Only %s of %s commitments have been resolved across the analysed meetings.", F.col("r"), n), round_half_even(F.col("rate"), 4), F.lit(None).cast("string"), F.lit("commitment"), F.lit("resolution"))
    return [over, due, old, low]


def risk_insights(c: Context, projects: DataFrame) -> list[DataFrame]:
    d = c.of("risk")
    g, n, s, q, h = recurring(d), F.col("meetings"), F.col("span_days"), quote(F.col("text")), F.col("content_hash")
    still = F.when(F.col("active") == F.col("n"), " and is still unresolved.").otherwise(".")
    again = _insight(g, "recurring_risk", "risk", severity(n, 2, 4, 6), _text("Risk recurred in %s meetings", n), F.concat(_text("%s has appeared in %s meetings", q, n), still), n, h, F.lit("risk"), F.lit("recurring"), h)
    long = _insight(g.where("span_days >= 60"), "long_lived_risk", "risk", severity(s, 60, 120, 240), _text("Risk persisted for %s days", s), _text("%s has been raised over a %s-day span.", q, s), s, h, F.lit("risk"), F.lit("longlived"), h)
    live = _with_reference(d, c).where("status = 'active' and date <> ''").withColumn("age", days_between(F.col("date"), F.col("reference_date"))).where("age >= 30")
    age, mid = F.col("age"), F.col("memory_id")
    old = _insight(live, "unresolved_risk", "risk", severity(age, 30, 90, 180), _text("Risk unresolved for %s days", age), _text("%s has remained open for %s days.", q, age), age, mid, F.lit("risk"), F.lit("unresolved"), mid)
    name, r, b, p = F.col("name"), F.col("risk_count"), F.col("blocker_count"), F.col("project_id")
    hot = _insight(projects.where("risk_count >= 3"), "risk_hotspot", "project", severity(r, 3, 5, 8), _text("%s is a risk hotspot", name), _text("%s is linked to %s risks across the analysed meetings.", name, r), r, p, F.lit("risk"), F.lit("hotspot"), p)
    stuck = _insight(projects.where("blocker_count >= 2"), "project_blocker", "project", severity(b, 2, 4, 6), _text("%s has recurring blockers", name), _text("%s is blocked by %s risks, indicating a recurring bottleneck.", name, b), b, p, F.lit("project"), F.lit("blocker"), p)
    return [again, long, old, hot, stuck]


@dataclass(frozen=True)
class Facts:
    """What a provider may ask of a context before it is called: its meetings, and its memories by type."""

    meetings: int
    memories: Mapping[str, int]

    def any(self, *types: str) -> bool:
        return any(self.memories.get(t, 0) for t in types)


def facts(c: Context) -> Facts:
    """Seven counts and one: a single job, however many providers there are."""
    n = c.memories.groupBy("memory_type").agg(F.count("*").alias("n")).collect()  # a row a type
    return Facts(c.reference.first()["n_meetings"], {r["memory_type"]: r["n"] for r in n})


@dataclass(frozen=True)
class Provider:
    """make builds tables from a context and what goes with it; supports says from the facts whether it has anything to say."""

    make: Callable[..., DataFrame | list[DataFrame]]
    supports: Callable[[Facts], bool] = lambda found: True


#: Providers by kind and name. An insight provider makes tables of INSIGHT from (context, projects), a metric provider one table
#: from the same, an adviser recommendations from (context, insights), and a report provider (part, place, line) from (context, projects).
REGISTRY: dict[str, dict[str, Provider]] = {
    "insights": {
        "commitment": Provider(lambda c, p: commitment_insights(c), lambda f: f.any("commitment")),
        "decision": Provider(lambda c, p: decision_insights(c), lambda f: f.any("decision")),
        "risk": Provider(lambda c, p: risk_insights(c, p)),
    },
    "metrics": {
        "commitment": Provider(lambda c, p: commitment_metrics(c)), "decision": Provider(lambda c, p: decision_metrics(c)), "health": Provider(lambda c, p: health(c, p)),
        "meeting": Provider(lambda c, p: meeting_metrics(c)), "person": Provider(lambda c, p: person_metrics(c)), "project": Provider(lambda c, p: p), "risk": Provider(lambda c, p: risk_metrics(c, p)),
    },
    "advice": {"actions": Provider(lambda c, found: recommendations(c, found))},
    "reports": {"activity": Provider(lambda c, p: activity_report(c), lambda f: bool(f.memories))},
}


def register(kind: str, name: str, provider: Provider, replace: bool = False) -> None:
    """Add a provider of a kind; a name that is taken is an error, unless it is to be replaced."""
    if kind not in REGISTRY:
        raise ValueError(f"unknown kind {kind!r}; one of {', '.join(sorted(REGISTRY))}")
    if name in REGISTRY[kind] and not replace:
        raise ValueError(f"{kind} already has a provider {name!r}")
    REGISTRY[kind][name] = provider


def unregister(kind: str, name: str) -> None:
    del REGISTRY[kind][name]


def provided(kind: str, c: Context, given: DataFrame, found: Facts | None = None, names: Sequence[str] = ()) -> dict[str, list[DataFrame]]:
    """The tables of a kind's providers (or of those named) that support the context, in order of their names.

    found: the context's facts, where they are known; without them no provider is asked whether it supports it.
    """
    if unknown := [n for n in names if n not in REGISTRY[kind]]:
        raise ValueError(f"{kind} has no provider {unknown[0]!r}")
    out = {}
    for name in sorted(names or REGISTRY[kind]):
        provider = REGISTRY[kind][name]
        if found is None or provider.supports(found):
            made = provider.make(c, given)
            out[name] = made if isinstance(made, list) else [made]
    return out


def _all_of(tables: Mapping[str, list[DataFrame]]) -> DataFrame | None:
    out = None
    for part in (t for many in tables.values() for t in many):
        out = part if out is None else out.unionByName(part)
    return out


def advice(c: Context, found: DataFrame) -> DataFrame:
    """The recommendations of all providers, in order of their names."""
    return _all_of(provided("advice", c, found))


def insights(c: Context, projects: DataFrame, types: Sequence[str] = (), found: Facts | None = None) -> DataFrame:
    """The insights of all providers; with the context's facts, of those that support it."""
    out = _all_of(provided("insights", c, projects, found))
    if out is None:
        out = _insight(c.memories.limit(0), "", "", F.lit(""), F.lit(""), F.lit(""), F.lit(0.0), F.lit(""), F.lit(""))
    return out.where(F.col("type").isin(*types)) if types else out


def activity_report(c: Context) -> DataFrame:
    """(part, place, line): how many memories of each type there are, how many active, and in how many meetings."""
    per = c.memories.groupBy("memory_type").agg(F.count("*").alias("n"), _count("status = 'active'").alias("active"), F.countDistinct("meeting_id").alias("meetings"))
    line = F.format_string("- %s: %s, %s active, in %s meetings", F.replace("memory_type", F.lit("_"), F.lit(" ")), "n", "active", "meetings")
    return per.select(F.lit("activity").alias("part"), F.col("memory_type").alias("place"), line.alias("line"))


def report_lines(c: Context, projects: DataFrame, found: Facts | None = None) -> DataFrame | None:
    """The lines of all report providers that support the context; in order of part and place they are the report."""
    return _all_of(provided("reports", c, projects, found))


def _rank(of: dict[str, int], name: str) -> Column:
    return F.create_map(*[x for k, v in of.items() for x in (F.lit(k), F.lit(v))])[F.col(name)]


def ordered(found: DataFrame) -> DataFrame:
    return found.orderBy(_rank(R.SEVERITIES, "severity").desc(), "category", "type", "insight_id")


def ordered_recommendations(found: DataFrame) -> DataFrame:
    return found.orderBy(_rank({"low": 0, "medium": 1, "high": 2, "urgent": 3}, "priority").desc(), _rank(R.SEVERITIES, "severity").desc(), "category", "recommendation_id")


def evidence(c: Context, found: DataFrame) -> DataFrame:
    """(insight_id, memory_id, meeting_id): the memories behind insights whose subject is a memory, content or owner."""
    m = c.memories.select("memory_id", "meeting_id", "content_hash", "memory_type", "status", "responsible")
    by_memory = found.join(m, F.col("subject") == F.col("memory_id")).where("type in ('aging_commitment', 'overdue_commitment', 'unresolved_risk')")
    by_content = found.join(m, F.col("subject") == F.col("content_hash")).where("category = memory_type")
    by_owner = found.where("type = 'open_commitment_overload'").join(m.where("memory_type = 'commitment' and status = 'active'"), F.col("subject") == F.col("responsible"))
    chain = G.chains(c.of("decision")).select("latest", F.explode("ids").alias("memory_id")).join(c.memories.select("memory_id", "meeting_id"), "memory_id")
    by_chain = found.where("type in ('repeatedly_superseded_decision', 'long_running_decision')").join(chain, F.col("subject") == F.col("latest"))
    cols = ("insight_id", "memory_id", "meeting_id")
    return by_memory.select(*cols).unionByName(by_content.select(*cols)).unionByName(by_owner.select(*cols)).unionByName(by_chain.select(*cols))


def recommendations(c: Context, found: DataFrame) -> DataFrame:
    """A recommendation for each insight, and one on the cadence of meetings that decide little."""
    spark = found.sparkSession
    actions = spark.createDataFrame([(k, t, a) for k, (t, a) in R.ACTIONS.items()], "type string, action string, advice string")
    level = F.create_map(*[x for k, v in R.PRIORITIES.items() for x in (F.lit(k), F.lit(v))])
    per = found.join(F.broadcast(actions), "type").select(F.concat(F.lit("rec-"), F.col("insight_id")).alias("recommendation_id"), level[F.col("severity")].alias("priority"), "category", "severity", F.col("action").alias("title"), F.concat_ws(" ", "advice", "detail").alias("detail"))
    weak = meeting_metrics(c).where("total_meetings >= 3 and productivity < 0.5")
    detail = F.format_string("Across %s meetings only %.2f decisions/commitments were produced per meeting; consider tightening agendas or cadence.", "total_meetings", "productivity")
    cadence = weak.select(F.lit("rec-meeting-cadence").alias("recommendation_id"), F.lit("medium").alias("priority"), F.lit("meeting").alias("category"), F.lit("medium").alias("severity"), F.lit("Meeting cadence appears ineffective").alias("title"), detail.alias("detail"))
    return per.unionByName(cadence)


def replay(memories: DataFrame, meetings: DataFrame) -> DataFrame:
    """Meetings in order of date (undated first) and id, with memories so far, in all and by type.

    Running sums are over one row a meeting, in blocks of meetings.
    """
    per = memories.groupBy("meeting_id").agg(F.count("*").alias("n"), *[_count(F.col("memory_type") == t).alias(f"n_{t}") for t in R.TYPES])
    rows = meetings.select("meeting_id", F.coalesce("date", F.lit("")).alias("date"), "title").join(per, "meeting_id", "left").fillna(0)
    # blocks of meetings in order, then running sums in each: no task sees all meetings
    n = int(memories.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = G._cut(rows.repartitionByRange(n, "date", "meeting_id").withColumn("_block", F.spark_partition_id()))
    counts = {"position": F.lit(1), "total": F.col("n"), **{f"total_{t}": F.col(f"n_{t}") for t in R.TYPES}}
    ahead = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    sums = blocks.groupBy("_block").agg(*[F.sum(v).alias(k) for k, v in counts.items()])
    before = sums.select("_block", *[F.coalesce(F.sum(k).over(ahead), F.lit(0)).alias(f"_{k}") for k in counts])
    w = Window.partitionBy("_block").orderBy("date", "meeting_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = blocks.withColumns({f"_in_{k}": F.sum(v).over(w) for k, v in counts.items()}).join(before, "_block")
    place = (F.col("_in_position") + F.col("_position")).cast("int").alias("position")
    return placed.select("meeting_id", "date", "title", place, "n", *[(F.col(f"_in_{k}") + F.col(f"_{k}")).alias(k) for k in counts if k != "position"])
