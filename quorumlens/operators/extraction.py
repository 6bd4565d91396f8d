"""Memories from utterances: one rule table, one pass, no shuffle until deduplication."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.text import confidence, content_hash, normalize_text

CANDIDATE = "struct<memory_type:string,base:double,start:int,trigger:string,marked:boolean>"


def _java(pattern: str) -> str:
    """Java's \\w covers ASCII alone."""
    return pattern.replace(r"[\w.'-]", r"[\p{L}\p{N}_.'-]").replace(r"[\w-]", r"[\p{L}\p{N}_-]").replace(r"\w", r"[\p{L}\p{N}_]")


def is_question(text: Column) -> Column:
    return text.contains("?") & text.rlike(r"(?U)\?\s*$")


def _holds(lower: Column, parts: Sequence[str]) -> Column:
    out = lower.contains(parts[0])
    for p in parts[1:]:
        out = out | lower.contains(p)
    return out


def matches(text: Column, rules: Sequence[tuple[str, float]], lower: Column, parts: Sequence[Sequence[str]] | None) -> Column:
    """The rules that match, each as (base, neg_start, neg_rule, trigger); their greatest is the best.

    That is the strongest, then the earliest match, then the first rule. parts: for each rule the strings one of
    which stands in every match in lower case; a rule is tried only on texts with one of them.
    """
    found = []
    for i, (pattern, base) in enumerate(rules):
        p = _java(pattern)
        before = F.char_length(F.regexp_extract(text, f"(?is)^(.*?)(?:{p})", 1))
        hit = F.struct(F.lit(base).alias("base"), (-before).alias("neg_start"), F.lit(-i).alias("neg_rule"), F.regexp_extract(text, f"(?i){p}", 0).alias("trigger"))
        test = text.rlike(f"(?i){p}")
        found.append(F.when(_holds(lower, parts[i]) & test if parts else test, hit))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def candidates(text: Column, kind: str, rules: Sequence[tuple[str, float]], lower: Column | None = None, asks: Column | None = None) -> Column:
    """An array with the type's CANDIDATE for a text, or empty. lower and asks: the text in lower case, and is_question(), if known."""
    none = F.array().cast(f"array<{CANDIDATE}>")
    lower, asks = F.lower(text) if lower is None else lower, is_question(text) if asks is None else asks
    parts = R.PARTS[kind] if rules is R.RULES.get(kind) else None
    best = F.filter(F.transform(F.array(matches(text, rules, lower, parts)), lambda m: F.array_max(m)), lambda x: x.isNotNull())
    hit = F.transform(best, lambda b: F.struct(F.lit(kind).alias("memory_type"), b["base"].alias("base"), (-b["neg_start"]).alias("start"), b["trigger"].alias("trigger"), F.lit(False).alias("marked")))
    if parts:
        hit = F.when(_holds(lower, sorted({x for p in parts for x in p})), hit).otherwise(none)
    if kind == "question":
        mark = F.struct(F.lit(kind).alias("memory_type"), F.lit(R.VERY_HIGH).alias("base"), F.lit(0).alias("start"), F.lit("?").alias("trigger"), F.lit(True).alias("marked"))
        return F.when(asks, F.array(mark)).otherwise(hit)
    return F.when(asks, none).otherwise(hit) if kind == "fact" else hit


def owner_of_text(text: Column, speaker: Column) -> Column:
    assignee = F.trim(F.regexp_extract(text, _java(R.ASSIGNEE), 1))
    return F.coalesce(F.nullif(assignee, F.lit("")), F.when(text.rlike(R.FIRST_PERSON), F.nullif(speaker, F.lit(""))))


def due_of_text(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, "(?i)" + _java(R.DUE), 0), F.lit(""))


#: Extractors beyond the built-in ones: a name and a function from (text, speaker) to an array of CANDIDATE.
Extractor = Callable[[Column, Column], Column]


def first_said(utterances: DataFrame, by: Sequence[Column]) -> DataFrame:
    """Of the utterances of a meeting with one text and the same `by`, the earliest."""
    w = Window.partitionBy("meeting_id", "text", *by).orderBy("utterance_index")
    return utterances.withColumn("_first", F.row_number().over(w)).where("_first = 1").drop("_first")


def extract(utterances: DataFrame, types: Sequence[str] = R.TYPES, min_confidence: float = 0.0, deduplicate: bool = True, rules: Mapping[str, Sequence[tuple[str, float]]] = R.RULES, extra: Sequence[Extractor] = ()) -> DataFrame:
    """A row a memory, at most one a type and utterance.

    utterances: meeting_id, utterance_index, speaker, text. Within a meeting, memories of one type and normalised
    text fall together; the most confident stays, of equals the earliest. Confidence is checked after that. What a rule
    finds hangs on the text, and on whether there is a speaker, so of a text that a meeting repeats only the first is searched.
    """
    text, speaker = F.col("text"), F.col("speaker")
    if deduplicate:
        utterances = first_said(utterances, [speaker if extra else F.coalesce(speaker, F.lit("")) == ""])
    each = [candidates(text, t, rules[t], F.col("_lower"), F.col("_asks")) for t in R.TYPES if t in types] + [x(text, speaker) for x in extra]
    known = utterances.where("text is not null").withColumns({"_lower": F.lower(text), "_asks": is_question(text)})
    rows = known.withColumn("_c", F.explode(F.concat(F.array().cast(f"array<{CANDIDATE}>"), *each))).drop("_lower", "_asks").withColumns({
        "memory_type": F.col("_c.memory_type"), "trigger": F.col("_c.trigger"), "evidence_start": F.col("_c.start"),
    })
    commits = F.col("memory_type") == "commitment"
    rows = rows.withColumns({"owner": F.when(commits, owner_of_text(text, speaker)), "due": F.when(commits, due_of_text(text))})
    boost = F.when(commits & F.col("owner").isNotNull() & F.col("due").isNotNull(), R.OWNER_DEADLINE_BOOST).when((F.col("memory_type") == "fact") & text.rlike(R.QUANTITY), R.QUANTITY_BOOST).otherwise(0.0)
    marked = F.col("_c.marked")
    rows = rows.withColumns({
        "confidence": F.when(marked, F.lit(R.VERY_HIGH)).otherwise(confidence(F.col("_c.base"), text, boost)),
        "evidence_end": F.when(marked, F.char_length(text)).otherwise(F.col("evidence_start") + F.char_length("trigger")),
        "memory_id": F.concat_ws(":", "meeting_id", "memory_type", F.col("utterance_index").cast("string")),
        "content_hash": content_hash(F.col("memory_type"), text),
        "speaker": F.nullif(speaker, F.lit("")),
    })
    if deduplicate:
        w = Window.partitionBy("meeting_id", "memory_type", normalize_text(F.col("text"))).orderBy(F.desc("confidence"), "utterance_index")
        rows = rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")
    rows = rows.drop("_c")
    return rows.where(F.col("confidence") >= min_confidence) if min_confidence > 0 else rows


def ordered(memories: DataFrame) -> DataFrame:
    """Memories of each meeting in order of utterance, then of the types' canonical order."""
    return memories.orderBy("meeting_id", "utterance_index", F.array_position(F.array(*map(F.lit, R.TYPES)), F.col("memory_type")))


def problems(memories: DataFrame, utterances: DataFrame) -> DataFrame:
    """memories with `problem`: what is wrong with each, null if it is valid."""
    sizes = utterances.groupBy("meeting_id").agg(F.count("*").alias("_n"))
    problem = (
        F.when(F.coalesce(F.trim("memory_id"), F.lit("")) == "", "memory_id is empty")
        .when(~F.col("memory_type").isin(*R.TYPES), "unknown memory type")
        .when(~F.col("confidence").between(0.0, 1.0), "confidence is outside 0..1")
        .when(F.coalesce(F.trim("meeting_id"), F.lit("")) == "", "meeting_id is empty")
        .when(F.coalesce(F.trim("text"), F.lit("")) == "", "text is empty")
        .when((F.col("utterance_index") < 0) | (F.col("utterance_index") >= F.coalesce("_n", F.lit(0))), "utterance index is out of range")
    )
    return memories.join(sizes, "meeting_id", "left").withColumn("problem", problem).drop("_n")


def meeting_problems(utterances: DataFrame, unique_timestamps: bool = True) -> DataFrame:
    """(meeting_id, problem) for speakers without a name and, if asked for, repeated timestamps."""
    unnamed = utterances.where(F.coalesce(F.trim("speaker"), F.lit("")) == "").select("meeting_id", F.lit("speaker has no name").alias("problem")).distinct()
    if not unique_timestamps or "timestamp" not in utterances.columns:
        return unnamed
    again = utterances.where("timestamp is not null").groupBy("meeting_id", "timestamp").count().where("count > 1")
    return unnamed.unionByName(again.select("meeting_id", F.lit("timestamp is repeated").alias("problem")).distinct())
