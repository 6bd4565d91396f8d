"""Free-text retrieval: a driver-side planner and one plan that filters, scores, orders and explains."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from .store import MemoryQuery

_TYPE_WORDS = {w: t for t in ("decision", "commitment", "risk", "assumption", "question", "fact") for w in (t, t + "s")}
_MONTH_WORDS = {w: i for i, m in enumerate(R.MONTHS, 1) for w in (m, m[:3])} | {"sept": 9}


@dataclass(frozen=True)
class Query:
    text: str = ""
    memory_types: Sequence[str] = ()
    speakers: Sequence[str] = ()
    meeting_ids: Sequence[str] = ()
    participants: Sequence[str] = ()
    statuses: Sequence[str] = ()
    months: Sequence[int] = ()
    min_confidence: float | None = None
    max_confidence: float | None = None
    date_from: str | None = None
    date_to: str | None = None
    order: str = "relevance"
    limit: int | None = None
    offset: int = 0


@dataclass(frozen=True)
class Plan:
    """A query whose free text has been resolved; terms are what is left of it."""

    query: Query
    terms: tuple[str, ...] = ()
    memory_types: frozenset[str] = frozenset()
    statuses: frozenset[str] = frozenset()
    speakers: frozenset[str] = frozenset()
    participants: frozenset[str] = frozenset()
    months: frozenset[int] = frozenset()
    weights: Mapping[str, float] = field(default_factory=lambda: R.RANKING)

    @property
    def phrase(self) -> str | None:
        return " ".join(self.terms) if len(self.terms) > 1 else None


def plan(query: Query, speakers: Sequence[str] = (), participants: Sequence[str] = ()) -> Plan:
    """Resolve the words of query.text, in this order: `open loop`, types, statuses, months, names, stop words."""
    found: dict[str, set] = {"memory_types": {*query.memory_types}, "statuses": {*query.statuses}, "speakers": {*query.speakers}, "participants": {*query.participants}, "months": {*query.months}}
    lexicons = [("memory_types", _TYPE_WORDS), ("statuses", {s: s for s in R.STATUSES}), ("months", _MONTH_WORDS), ("speakers", {s.lower(): s for s in speakers}), ("participants", {p.lower(): p for p in participants})]
    terms: list[str] = []
    words = re.findall("[a-z0-9]+", query.text.lower())
    skip = False
    for word, after in zip(words, [*words[1:], ""]):
        if skip:
            skip = False
        elif word == "open" and after in ("loop", "loops"):
            found["memory_types"].add("open_loop")
            skip = True
        else:
            for name, lexicon in lexicons:
                if word in lexicon:
                    found[name].add(lexicon[word])
                    break
            else:
                if word not in R.STOPWORDS:
                    terms.append(word)
    return Plan(query, tuple(terms), **{k: frozenset(v) for k, v in found.items()})


def vocabulary(memories: DataFrame, meetings: DataFrame, words: Sequence[str]) -> tuple[list[str], list[str]]:
    """The speakers and participants whose lower-cased name is one of words: no more rows than the query has words."""
    few = [w.lower() for w in words]
    speakers = memories.where(F.lower("speaker").isin(few)).select("speaker").distinct()
    people = meetings.select(F.explode("participants").alias("p")).where(F.lower("p").isin(few)).distinct()
    return sorted(r[0] for r in speakers.collect()), sorted(r[0] for r in people.collect())


def _joined(*parts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *parts))


def _metadata() -> Column:
    m = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: e["value"]), " ")


def _share(body: Column, terms: Sequence[str]) -> Column:
    if not terms:
        return F.lit(1.0)
    hits = F.lit(0)
    for t in terms:
        hits = hits + body.contains(t).cast("int")
    return hits / F.lit(len(terms))


def scored(memories: DataFrame, meetings: DataFrame, p: Plan) -> DataFrame:
    """The candidates of a plan with the parts of their score and the score.

    memories need memory_id, meeting_id, memory_type, text, speaker, confidence, utterance_index, status,
    created_at and metadata; meetings need meeting_id, title, date, participants.
    """
    q = p.query
    structured = MemoryQuery(memory_types=sorted(p.memory_types), speakers=sorted(p.speakers), meeting_ids=q.meeting_ids, statuses=sorted(p.statuses), min_confidence=q.min_confidence, max_confidence=q.max_confidence, date_from=q.date_from, date_to=q.date_to)
    side = meetings.select("meeting_id", F.col("title").alias("_title"), F.col("date").alias("_date"), F.col("participants").alias("_people"), F.lit(True).alias("_known"))
    rows = memories.where(structured.where()).join(side, "meeting_id", "left")
    for bound, test in ((q.date_from, F.col("_date") >= q.date_from), (q.date_to, F.col("_date") <= q.date_to)):
        if bound is not None:
            rows = rows.where(test)
    own = _joined(F.col("text"), F.coalesce("speaker", F.lit("")), _metadata())
    about = F.when(F.col("_known"), _joined(F.coalesce("_title", F.lit("")), F.array_join("_people", " ")))
    rows = rows.withColumns({"_own": own, "_about": about})
    for t in p.terms:
        rows = rows.where(F.col("_own").contains(t) | F.coalesce(F.col("_about").contains(t), F.lit(False)))
    if p.participants:
        rows = rows.where(F.coalesce(F.size(F.array_except(F.array(*map(F.lit, sorted(p.participants))), "_people")) == 0, F.lit(False)))
    if p.months:
        rows = rows.where(F.substring("_date", 6, 2).try_cast("int").isin(*sorted(p.months)))
    rows = _with_recency(rows)
    status = F.coalesce(F.create_map(*[x for s, w in R.STATUS_WEIGHTS.items() for x in (F.lit(s), F.lit(w))])[F.col("status")], F.lit(0.1))
    bound = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    phrase = F.when(F.lower("text").contains(p.phrase), 1.0).otherwise(0.0) if p.phrase else F.lit(1.0)
    parts = {"text": _share(F.col("_own"), p.terms), "phrase": phrase, "confidence": bound(F.col("confidence")), "recency": F.col("_recency"), "status": status, "meeting": F.coalesce(_share(F.col("_about"), p.terms), F.lit(0.0))}
    rows = rows.withColumns({f"{k}_score": v for k, v in parts.items()})
    total = F.lit(0.0)
    for k in ("text", "phrase", "confidence", "recency", "status", "meeting"):
        total = total + p.weights[k] * F.col(f"{k}_score")
    return rows.withColumn("score", bound(total))


def _with_recency(rows: DataFrame) -> DataFrame:
    """The place of the meeting's date among the candidates' dates, from 0 to 1; neutral if there is one date at most."""
    dates = rows.where("_date <> ''").groupBy("_date").agg(F.lit(1).alias("one"))
    places = dates.select("_date", (F.row_number().over(Window.orderBy("_date")) - 1).alias("_place"))  # as many rows as days
    out = rows.join(places, "_date", "left")
    one = dates.agg(F.sum("one").alias("_all"))
    out = out.join(F.broadcast(one), how="left")  # one row
    return out.withColumn("_recency", F.when(F.coalesce("_all", F.lit(0)) <= 1, 1.0).otherwise(F.coalesce(F.col("_place") / (F.col("_all") - 1), F.lit(0.0)))).drop("_place", "_all")


def order_columns(order: str) -> list[Column]:
    date = F.coalesce("_date", F.lit(""))
    if order == "chronological":
        return [date, F.col("utterance_index"), F.col("memory_id")]
    recent = [date.desc(), F.col("created_at").desc(), F.col("memory_id")]
    return recent if order == "reverse_chronological" else [F.col("score").desc(), *recent]


def retrieve(memories: DataFrame, meetings: DataFrame, query: Query, explain: bool = False, weights: Mapping[str, float] = R.RANKING, names: tuple[Sequence[str], Sequence[str]] | None = None) -> DataFrame:
    """One page of results, best first.

    Names in the text are looked up among the tables' speakers and participants, or in `names` (of both) if given.
    weights: how much each part of the score counts.
    """
    words = re.findall("[a-z0-9]+", query.text.lower())
    if names is None:
        names = vocabulary(memories, meetings, words) if words else ((), ())
    p = replace(plan(query, *names), weights=weights)
    rows = scored(memories, meetings, p).orderBy(*order_columns(query.order))
    if query.offset:
        rows = rows.offset(query.offset)
    if query.limit is not None:
        rows = rows.limit(query.limit)
    return rows.withColumn("reasons", reasons(p)) if explain else rows


def before(memories, meetings, date: str, base: Query = Query()) -> DataFrame:
    return retrieve(memories, meetings, replace(base, date_to=date, order="chronological"))


def after(memories, meetings, date: str, base: Query = Query()) -> DataFrame:
    return retrieve(memories, meetings, replace(base, date_from=date, order="chronological"))


def between(memories, meetings, start: str, end: str, base: Query = Query()) -> DataFrame:
    return retrieve(memories, meetings, replace(base, date_from=start, date_to=end, order="chronological"))


def latest(memories, meetings, limit: int = 10, base: Query = Query()) -> DataFrame:
    return retrieve(memories, meetings, replace(base, limit=limit, order="reverse_chronological"))


def oldest(memories, meetings, limit: int = 10, base: Query = Query()) -> DataFrame:
    return retrieve(memories, meetings, replace(base, limit=limit, order="chronological"))


def timeline(memories, meetings, base: Query = Query()) -> DataFrame:
    return retrieve(memories, meetings, replace(base, order="chronological"))


def reasons(p: Plan) -> Column:
    """An array of (kind, detail, contribution) that says why a scored row is a result."""
    part = lambda k: F.lit(p.weights[k]) * F.col(f"{k}_score")
    q = p.query
    out: list[Column] = []

    def add(test: Column, kind: str, detail: Column | str, contribution: Column | None = None) -> None:
        x = F.struct(F.lit(kind).alias("kind"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"), (F.lit(0.0) if contribution is None else contribution).alias("contribution"))
        out.append(F.when(test, x))

    for s in sorted(p.speakers):
        add(F.col("speaker") == s, "speaker", f"speaker {s}")
    for t in sorted(p.memory_types):
        add(F.col("memory_type") == t, "type", f"memory type {t}")
    body = F.concat_ws(" ", "_own", "_about")
    for t in p.terms:
        add(body.contains(t), "keyword", f'keyword "{t}"', part("text"))
    if p.phrase:
        add(F.lower("text").contains(p.phrase), "phrase", f'exact phrase "{p.phrase}"', part("phrase"))
    if q.min_confidence is not None:
        add(F.lit(True), "confidence", f"confidence ≥ {q.min_confidence:.2f}", part("confidence"))
    for s in sorted(p.statuses):
        add(F.col("status") == s, "status", f"status {s}", part("status"))
    dated = F.coalesce("_date", F.lit("")) != ""
    if q.date_from or q.date_to:
        add(dated, "date", f"within date range {q.date_from or '...'}..{q.date_to or '...'}", part("recency"))
    if p.months:
        month = F.substring("_date", 6, 2)
        add(dated & month.try_cast("int").isin(*sorted(p.months)), "date", F.concat(F.lit("meeting month "), month), part("recency"))
    if q.meeting_ids:
        add(F.col("meeting_id").isin(*q.meeting_ids), "meeting", F.concat(F.lit("meeting "), F.col("meeting_id")), part("meeting"))
    for name in sorted(p.participants):
        add(F.array_contains("_people", name), "participant", f"participant {name}", part("meeting"))
    fallback = F.array(F.struct(F.lit("confidence").alias("kind"), F.format_string("confidence %.2f", "confidence").alias("detail"), part("confidence").alias("contribution")))
    if not out:
        return fallback
    found = F.filter(F.array(*out), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(fallback)


def explain(memories: DataFrame, meetings: DataFrame, utterances: DataFrame, memory_id: str, size: int = 2, weights: Mapping[str, float] = R.RANKING) -> DataFrame:
    """One memory (no row if there is none) with its score, the reasons for its own type, status and speaker, and its context.

    It is compared with no others, so its recency is 1.
    """
    mine = memories.where(F.col("memory_id") == memory_id)
    row = mine.select("memory_type", "status", "speaker").first()  # one memory
    if row is None:
        return context(scored(mine, meetings, Plan(Query())).withColumn("reasons", reasons(Plan(Query()))), utterances, size)
    p = Plan(Query(), memory_types=frozenset([row["memory_type"]]), statuses=frozenset([row["status"]]), speakers=frozenset([row["speaker"]] if row["speaker"] else []), weights=weights)
    return context(scored(mine, meetings, p).withColumn("reasons", reasons(p)), utterances, size)


def context(results: DataFrame, utterances: DataFrame, size: int = 2) -> DataFrame:
    """results with `before` and `after`: up to `size` utterances on either side of each, from its meeting.

    A result's neighbours are 2 * size + 1 known places, so this is an equi-join on meeting and place.
    """
    places = results.select("memory_id", "meeting_id", F.explode(F.sequence(F.col("utterance_index") - size, F.col("utterance_index") + size)).alias("_at"), "utterance_index")
    found = places.join(utterances.select("meeting_id", F.col("utterance_index").alias("_at"), F.struct(F.col("utterance_index").alias("index"), "speaker", "text").alias("u")), ["meeting_id", "_at"])
    sides = found.groupBy("memory_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("_at") < F.col("utterance_index"), F.col("u")))).alias("before"),
        F.array_sort(F.collect_list(F.when(F.col("_at") > F.col("utterance_index"), F.col("u")))).alias("after"),
    )
    return results.join(sides, "memory_id", "left")
