"""Import of transcripts: new ones are parsed, mined and stored; known ones are left alone, and others do not get in their place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.extraction import extract
from ..operators.store import Store, deduplicate
from ..shared import fresh_dir, materialize
from ..sources.transcripts import _described, meetings_of, parse, parse_and_problems, problems

PLAN = ("path", "transcript_hash", "meeting_id", "status", "detail")


def plan_import(files: DataFrame, store: Store, utterances: DataFrame, wrong: DataFrame | None = None) -> DataFrame:
    """(path, transcript_hash, meeting_id, status, detail): what an import of these files in order of their paths comes to.

    skipped: the store, or a file before, has the same content. failure: the file is in `wrong`, has no utterances, or
    its meeting is there with other content, in the store or by a file before. success: all others. A file that fails
    leaves its meeting and content free for the files behind it, so what a file comes to may hang on others that
    hang on others; each round settles those that are the first undecided ones of both their meeting and their content.
    """
    heads = utterances.groupBy("path").agg(F.min("meeting_id").alias("meeting_id"))
    wrong = problems(files) if wrong is None else wrong
    bad = wrong.groupBy("path").agg(F.min("problem").alias("problem"))
    rows = files.select("path", "transcript_hash").dropDuplicates(["path"]).join(heads, "path", "left").join(bad, "path", "left")
    meetings = store.read("meetings")
    known = None if meetings is None else meetings.select("transcript_hash", "meeting_id")
    if known is None:
        rows = rows.withColumns({"_known": F.lit(None).cast("string"), "_taken": F.lit(False)})
    else:
        rows = rows.join(known.groupBy("transcript_hash").agg(F.min("meeting_id").alias("_known")), "transcript_hash", "left")
        rows = rows.join(known.select("meeting_id", F.lit(True).alias("_taken")).distinct(), "meeting_id", "left")
    taken = F.concat(F.lit("meeting "), F.col("meeting_id"), F.lit(" is stored with other content"))
    status = F.when(F.col("_known").isNotNull(), "skipped").when(F.col("problem").isNotNull() | F.col("meeting_id").isNull() | F.col("_taken"), "failure")
    detail = F.when(F.col("_known").isNotNull(), F.lit(None)).when(F.col("problem").isNotNull(), F.col("problem")).when(F.col("meeting_id").isNull(), "the meeting has no utterances").when(F.col("_taken"), taken)
    rows = materialize(rows.select("path", "transcript_hash", F.coalesce("_known", "meeting_id").alias("meeting_id"), status.alias("status"), detail.alias("detail")), "import_plan")
    while rows.where("status is null").limit(1).count():
        undecided = rows.where("status is null")
        first = lambda key: undecided.groupBy(key).agg(F.min("path").alias("path"))  # noqa: E731, B023
        winners = undecided.join(first("meeting_id"), ["meeting_id", "path"], "left_semi").join(first("transcript_hash"), ["transcript_hash", "path"], "left_semi")
        contents = winners.select("transcript_hash", F.col("path").alias("_content"), F.col("meeting_id").alias("_as"))
        places = winners.select("meeting_id", F.col("path").alias("_place"))
        met = rows.join(contents, "transcript_hash", "left").join(places, "meeting_id", "left")
        won = F.col("_content") == F.col("path")
        new = F.when(won, "success").when(F.col("_content").isNotNull(), "skipped").when(F.col("_place").isNotNull(), "failure")
        why = F.when(F.col("_content").isNull() & F.col("_place").isNotNull(), taken)
        fresh = F.col("status").isNull()
        rows = materialize(met.select(
            "path", "transcript_hash", F.when(fresh & F.col("_content").isNotNull(), F.col("_as")).otherwise(F.col("meeting_id")).alias("meeting_id"),
            F.coalesce("status", new).alias("status"), F.when(fresh, why).otherwise(F.col("detail")).alias("detail"),
        ), "import_plan")
    return rows.select(*PLAN)


def _mined(utterances: DataFrame, now: str, min_confidence: float, dedup: bool) -> DataFrame:
    stamp = F.lit(now)
    found = extract(utterances, min_confidence=min_confidence, deduplicate=dedup)
    return found.withColumns({"status": F.lit("active"), "created_at": stamp, "updated_at": stamp, "superseded_by": F.lit(None).cast("string")}).drop("extra")


def import_files(files: DataFrame, store: Store, now: str, min_confidence: float = 0.0, dedup: bool = True, dry_run: bool = False) -> DataFrame:
    """Store the meetings and memories of files that plan_import() lets in, in one commit; its rows, with `memories`.

    memories: how many each file has stored, or in a dry run would have had extracted, null unless it got in. A dry run
    says dry_run in place of success and stores nothing. A job that is lost leaves nothing behind, as no commit names
    what it wrote.
    """
    files = materialize(files, "import_files")
    utterances, wrong = parse_and_problems(files)
    utterances = materialize(utterances, "import_utterances")
    plan = plan_import(files, store, utterances, wrong)
    mine = utterances.join(plan.where("status = 'success'").select("path"), "path", "left_semi")
    found = _mined(mine, now, min_confidence, dedup)
    if not dry_run:
        if dedup:
            found = deduplicate(found, stored=store.read("memories"))
        found = materialize(found, "import_memories")
        store.append_all({"memories": (found.drop("path", "transcript_hash"), "memory_id"), "meetings": (meetings_of(mine).withColumn("created_at", F.lit(now)), "meeting_id")})
    counts = found.groupBy("path").agg(F.count("*").alias("memories"))
    status = F.when((F.col("status") == "success") & F.lit(dry_run), "dry_run").otherwise(F.col("status"))
    return plan.join(counts, "path", "left").select(*[status.alias(c) if c == "status" else F.col(c) for c in PLAN], F.when(F.col("status") == "success", F.coalesce("memories", F.lit(0))).alias("memories"))


def import_results(files: DataFrame, store: Store, wrong: DataFrame) -> DataFrame:
    """plan_import() of files that are not parsed yet."""
    return plan_import(files, store, parse(files), wrong)


def import_status(results: DataFrame) -> DataFrame:
    """One row (status, success, skipped, failure): partial if some files failed, failure if all did, dry_run if nothing was stored by intent."""
    n = results.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("success", "skipped", "failure", "dry_run")])
    good = F.col("success") + F.col("skipped") + F.col("dry_run")
    name = F.when((F.col("failure") > 0) & (good > 0), "partial").when(F.col("failure") > 0, "failure").when(F.col("dry_run") > 0, "dry_run").otherwise("success")
    return n.select(name.alias("status"), (F.col("success") + F.col("dry_run")).alias("success"), "skipped", "failure")


def watch(spark: SparkSession, folder: str, store: Store, checkpoint: str, now: str) -> StreamingQuery:
    """Import what is new in a folder, then stop; run again for what came since."""
    lines = spark.readStream.format("text").option("wholetext", True).load(folder)
    files = _described(lines.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")))
    return files.writeStream.foreachBatch(lambda batch, _: import_files(batch, store, now) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def type_counts(utterances: DataFrame, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Running counts of memories by day and type over a stream of utterances; late ones count up to the watermark."""
    found = extract(utterances.withWatermark(ts, late), deduplicate=False)
    return found.groupBy(F.window(ts, "1 day"), "memory_type").agg(F.count("*").alias("n"))


# ---- a stream of utterances


def best_memories(utterances: DataFrame, at: str = "at", late: str = "30 days", min_confidence: float = 0.0) -> DataFrame:
    """A stream's memories, one for each meeting and content, as the best of what has come so far.

    utterances: a stream of (meeting_id, utterance_index, speaker, text) and `at`, the time of the meeting, the same for all
    its utterances. They may come in any order and more than once. The state has a row for each meeting and content, the
    memory of the greatest confidence, of equals the earliest; it is kept until the watermark, `late` behind the latest
    meeting, has passed the meeting, and what comes after that is dropped. In update mode each batch gives the rows that changed.
    """
    found = extract(utterances.withWatermark(at, late), min_confidence=min_confidence, deduplicate=False)
    keys = [at, "meeting_id", "content_hash"]
    rest = [c for c in found.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct("confidence", -F.col("utterance_index")))
    return found.groupBy(*keys).agg(best.alias("best")).select(*keys, "best.*")


def import_stream(utterances: DataFrame, store: Store, checkpoint: str, now: str, at: str = "at", late: str = "30 days") -> StreamingQuery:
    """Keep a store's memories equal to best_memories() of all that a stream has brought, a commit a batch.

    A memory's id is made from its meeting and content, as the utterance that stands for it may change. What changed is
    replaced by one commit; a batch that is run again after a loss finds that it has stored all of its rows. Available
    input is read, then the stream stops; start it again for more.
    """

    def keep(batch: DataFrame, number: int) -> None:
        stamp = F.lit(now)
        ident = F.concat_ws(":", "meeting_id", F.substring("content_hash", 1, 16))
        rows = batch.withColumns({"memory_id": ident, "status": F.lit("active"), "created_at": stamp, "updated_at": stamp, "superseded_by": F.lit(None).cast("string")})
        rows = materialize(rows, "stream_batch")
        if (old := store.read("memories")) is not None:
            rows = rows.join(old.select("memory_id", "confidence", "utterance_index"), ["memory_id", "confidence", "utterance_index"], "left_anti")
        store.replace(materialize(rows, "stream_changes"), number)

    best = best_memories(utterances, at, late)
    return best.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_folder(df: DataFrame, name: str, parts: int, key, files: int = 1) -> str:
    """df in a fresh shared folder, dealt by key, for `parts` batches of so many files each; a stream reads them by maxFilesPerTrigger.

    A batch of several files is read by several tasks, so no task need hold a whole batch.
    """
    folder = fresh_dir(df.sparkSession, name)
    df.repartition(parts * files, key).write.parquet(folder)
    return folder
