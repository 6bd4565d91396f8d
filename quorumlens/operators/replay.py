"""Replay of meetings in order: which ones, and a cursor over their timeline."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..shared import materialize
from .intelligence import replay


def select_meetings(memories: DataFrame, meetings: DataFrame, date: str | None = None, date_from: str | None = None, date_to: str | None = None, project: str | None = None, person: str | None = None) -> DataFrame:
    """Meetings of a date or range, that name a project (in the title or a memory) and a person (there, or speaking).

    Names are compared without regard to case; a project may be part of a word. Undated meetings fall out of any
    range.
    """
    out = meetings
    for bound, test in ((date, F.col("date") == date), (date_from, F.col("date") >= date_from), (date_to, F.col("date") <= date_to)):
        if bound is not None:
            out = out.where(test)
    if project:
        said = memories.where(F.lower("text").contains(project.lower())).select("meeting_id").distinct().withColumn("_said", F.lit(True))
        out = out.join(said, "meeting_id", "left").where(F.lower(F.coalesce("title", F.lit(""))).contains(project.lower()) | F.coalesce("_said", F.lit(False))).drop("_said")
    if person:
        spoke = memories.where(F.lower("speaker") == person.lower()).select("meeting_id").distinct().withColumn("_spoke", F.lit(True))
        there = F.exists("participants", lambda p: F.lower(p) == person.lower())
        out = out.join(spoke, "meeting_id", "left").where(F.coalesce(there, F.lit(False)) | F.coalesce("_spoke", F.lit(False))).drop("_spoke")
    return out


class Session:
    """A cursor over a timeline; rows come one by one from the cluster."""

    def __init__(self, memories: DataFrame, meetings: DataFrame, **filters: str | None):
        chosen = select_meetings(memories, meetings, **filters)
        # written once, as each step asks it again
        self.timeline = materialize(replay(memories.join(chosen.select("meeting_id"), "meeting_id", "left_semi"), chosen).orderBy("position"), "timeline")
        self.place = 0

    def step(self) -> Row | None:
        """The next meeting with its running totals, or None at the end."""
        row = self.timeline.where(F.col("position") == self.place + 1).first()
        self.place += row is not None
        return row

    def seek(self, place: int) -> None:
        self.place = max(0, min(place, self.timeline.count()))

    def reset(self) -> None:
        self.place = 0

    def run(self) -> Iterator[Row]:
        for row in self.timeline.where(F.col("position") > self.place).orderBy("position").toLocalIterator():
            self.place = row["position"]
            yield row
