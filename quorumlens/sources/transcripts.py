"""Transcript files as utterances: text, Markdown, JSON, CSV and zip archives of them.

Readers give one row a file (path, content, transcript_hash); parsers turn these into utterances (meeting_id,
title, meeting_date, extra, speaker, utterance_index, timestamp, text, path, transcript_hash). A file that cannot be
parsed gives one row in problems(), not a failed job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import derive_meeting_id, normalize_newlines, normalize_speaker, normalize_whitespace, timestamp_seconds
from ..shared import materialize

_TS = r"\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d+)?"
LEADING = rf"^\s*(?:\[\s*({_TS})\s*\]|\(\s*({_TS})\s*\)|({_TS}))\s+(.*)$"
TRAILING = rf"^(.*?)\s*(?:\[\s*({_TS})\s*\]|\(\s*({_TS})\s*\)|({_TS}))\s*$"
#: The first colon that does not stand between two digits parts speaker and text.
DELIMITER = r"^((?:[^:]|(?<=\d):(?=\d))*+):(.*)$"
SPEAKER_WORDS, SPEAKER_CHARS = 6, 50
SPEAKER_KEYS = ("speaker", "name", "speaker_name")
TEXT_KEYS = ("text", "utterance", "content", "message")
TIME_KEYS = ("timestamp", "time", "start")
OWNER_COLUMNS = ("speaker", "owner", "name", "assignee")
BODY_COLUMNS = ("text", "action", "item", "task", "note", "description", "summary")
FORMATS = {"txt": "text", "text": "text", "md": "markdown", "markdown": "markdown", "json": "json", "csv": "csv"}


def read_files(spark: SparkSession, paths: str | Sequence[str], pattern: str | None = None, recursive: bool = False, limit: int | None = None) -> DataFrame:
    """(path, content, transcript_hash, format); limit keeps the first files in order of their paths."""
    reader = spark.read.option("recursiveFileLookup", recursive)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    rows = _described(reader.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")))
    return rows.orderBy("path").limit(limit) if limit is not None else rows


def _described(rows: DataFrame) -> DataFrame:
    known = F.create_map(*[x for k, v in FORMATS.items() for x in (F.lit(k), F.lit(v))])
    ending = F.lower(F.regexp_extract("path", r"\.([^./\\:]+)$", 1))
    return rows.withColumns({"transcript_hash": F.sha2("content", 256), "format": known[ending]})


def read_zip(spark: SparkSession, path: str) -> DataFrame:
    """Members of zip archives, path being `archive.zip:member`, with `problem`: why a member, or a whole archive, could not be read.

    Spark reads the archives, so they may lie in any store that it knows. A task cuts an archive into its members as
    they are, compressed; these are dealt to all tasks, which unpack, check and decode them, so one archive of very many
    members is no single task's work. An archive is one value, which Spark limits to 2 GB. Of members of one name the last
    counts, as everywhere; problems() and imports report rows with a problem, parse() leaves them out.
    """
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "content")
    members = files.mapInArrow(_members, "path string, method int, flags int, crc long, packed binary, problem string")
    dealt = members.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return _described(dealt.mapInArrow(_unpacked, "path string, content string, problem string"))


def _members(parts: Iterator) -> Iterator:
    """Each archive's members, still compressed."""
    import io
    import zipfile

    import pyarrow as pa

    names = ["path", "method", "flags", "crc", "packed", "problem"]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.string()]
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
    for part in parts:
        for i in range(part.num_rows):
            name, content = part.column(0)[i].as_py(), part.column(1)[i].as_buffer()
            view, rows, held = memoryview(content), [], 0
            try:
                with zipfile.ZipFile(io.BytesIO(view)) as z:
                    found = {m.filename: m for m in z.infolist() if not m.is_dir()}
            except (zipfile.BadZipFile, ValueError, NotImplementedError):
                yield batch([(name, 0, 0, 0, None, "not a zip archive")])
                continue
            for m in found.values():
                at = m.header_offset
                head = bytes(view[at : at + 30])
                if len(head) < 30 or head[:4] != b"PK\x03\x04":
                    rows.append((f"{name}:{m.filename}", 0, 0, 0, None, "the member is not where the archive says"))
                else:
                    begin = at + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")
                    rows.append((f"{name}:{m.filename}", m.compress_type, m.flag_bits, m.CRC, bytes(view[begin : begin + m.compress_size]), None))
                    held += m.compress_size
                if held > 8_000_000 or len(rows) >= 1000:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)


def _unpacked(parts: Iterator) -> Iterator:
    import zlib

    import pyarrow as pa

    def text_of(method: int, flags: int, crc: int, packed: bytes) -> tuple[str | None, str | None]:
        if flags & 1:
            return None, "the member is encrypted"
        if method not in (0, 8):
            return None, f"compression method {method} is not read"
        try:
            data = packed if method == 0 else zlib.decompress(packed, -15)
        except zlib.error:
            return None, "the member is broken"
        if zlib.crc32(data) != crc:
            return None, "the member's checksum is wrong"
        try:
            return data.decode("utf-8"), None
        except UnicodeDecodeError:
            return None, "not UTF-8"

    for part in parts:
        for i in range(part.num_rows):  # a member at a time
            path, method, flags, crc, packed, problem = (c[i].as_py() for c in part.columns)
            content, wrong = (None, problem) if problem else text_of(method, flags, crc, packed)
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([content], pa.string()), pa.array([wrong], pa.string())], ["path", "content", "problem"])


def from_text(spark: SparkSession, content: str, ending: str = "txt") -> DataFrame:
    """One transcript given as a string, named `upload`."""
    return _described(spark.createDataFrame([(f"upload.{ending}", content)], "path string, content string"))


def _looks_like_speaker(head: Column) -> Column:
    return (head != "") & (F.char_length(head) <= SPEAKER_CHARS) & (F.size(F.split(head, r"(?U)\s+")) <= SPEAKER_WORDS)


def _front_matter(files: DataFrame) -> DataFrame:
    """Add fields (map) and body (array of lines); a block without end, or a line in it without colon, is a problem."""
    lines = F.split(normalize_newlines(F.regexp_replace("content", "^﻿", "")), "\n", -1)
    rows = files.withColumn("_lines", lines)
    rows = rows.withColumn("_has", F.trim(F.element_at("_lines", 1)) == "---")
    rest = F.slice("_lines", 2, F.greatest(F.size("_lines"), F.lit(1)))
    rows = rows.withColumn("_close", F.array_position(F.transform(rest, lambda x: F.trim(x)), "---"))
    block = F.filter(F.slice("_lines", 2, F.greatest(F.col("_close") - 1, F.lit(0)).cast("int")), lambda x: F.trim(x) != "")
    rows = rows.withColumn("_block", F.when(F.col("_has") & (F.col("_close") > 0), block).otherwise(F.array().cast("array<string>")))
    pair = lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("key"), F.trim(F.regexp_extract(x, "(?s)^[^:]*:(.*)$", 1)).alias("value"))
    good = F.filter("_block", lambda x: x.contains(":"))
    keyed = F.transform(good, lambda x, i: F.struct(pair(x).alias("p"), i.alias("i")))
    last = F.filter(keyed, lambda e: ~F.exists(keyed, lambda o: (o["p"]["key"] == e["p"]["key"]) & (o["i"] > e["i"])))
    rows = rows.withColumn("fields", F.map_from_entries(F.transform(last, lambda e: e["p"])))
    body = F.when(F.col("_has") & (F.col("_close") > 0), F.slice("_lines", (F.col("_close") + 2).cast("int"), F.size("_lines"))).otherwise(F.col("_lines"))
    problem = F.when(F.col("_has") & (F.col("_close") == 0), "front matter has no end").when(F.exists("_block", lambda x: ~x.contains(":")), "front matter has a line without colon")
    return rows.withColumns({"body": body, "problem": problem}).drop("_lines", "_has", "_close", "_block")


def _turn_lines(files: DataFrame) -> DataFrame:
    """One row a line that is not blank, with speaker, timestamp and rest where it starts a turn."""
    rows = files.where("problem is null").select("path", "transcript_hash", "format", "fields", F.posexplode("body").alias("pos", "line")).where(F.trim("line") != "")
    lead = F.coalesce(*[F.nullif(F.regexp_extract("line", LEADING, i), F.lit("")) for i in (1, 2, 3)])
    rows = rows.withColumn("_lead", lead).withColumn("_rest", F.when(F.col("_lead").isNotNull(), F.regexp_extract("line", LEADING, 4)).otherwise(F.col("line")))
    rows = rows.withColumns({"_cut": F.col("_rest").rlike(DELIMITER), "_head": F.regexp_extract("_rest", DELIMITER, 1), "said": F.regexp_extract("_rest", DELIMITER, 2)})
    trail = F.coalesce(*[F.nullif(F.regexp_extract("_head", TRAILING, i), F.lit("")) for i in (2, 3, 4)])
    rows = rows.withColumn("_trail", F.when(F.col("_lead").isNull(), trail))
    head = F.trim(F.when(F.col("_trail").isNotNull(), F.regexp_extract("_head", TRAILING, 1)).otherwise(F.col("_head")))
    rows = rows.withColumn("who", head)
    return rows.withColumns({"is_turn": F.col("_cut") & _looks_like_speaker(F.col("who")), "stamp": F.coalesce("_lead", "_trail")})


def _folded(lines: DataFrame) -> DataFrame:
    """Turns with their continuation lines joined; turn 0 is text before any turn."""
    w = Window.partitionBy("path").orderBy("pos")
    marked = lines.withColumn("turn", F.sum(F.col("is_turn").cast("int")).over(w))
    part = F.struct("pos", F.when(F.col("is_turn"), F.col("said")).otherwise(F.col("line")).alias("s"))
    text = normalize_whitespace(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["s"]), " "))
    return marked.groupBy("path", "turn").agg(F.first("transcript_hash").alias("transcript_hash"), F.first("format").alias("format"), F.first("fields").alias("fields"), F.max(F.when(F.col("is_turn"), F.col("who"))).alias("who"), F.max(F.when(F.col("is_turn"), F.col("stamp"))).alias("stamp"), text.alias("text"))


def _finished(turns: DataFrame) -> DataFrame:
    title = F.nullif(F.col("fields")["title"], F.lit(""))
    date = F.col("fields")["date"]
    return turns.select(
        derive_meeting_id(F.col("path"), title).alias("meeting_id"), title.alias("title"), F.when(F.try_to_date(date, "yyyy-MM-dd").isNotNull(), date).alias("meeting_date"),
        F.map_filter("fields", lambda k, v: ~k.isin("title", "date")).alias("extra"), normalize_speaker(F.col("who")).alias("speaker"), (F.col("turn") - 1).cast("int").alias("utterance_index"),
        timestamp_seconds(F.col("stamp")).alias("timestamp"), "text", "path", "transcript_hash",
    )


def _markdown(files: DataFrame) -> DataFrame:
    """Markdown notes as transcripts: list marks and emphasis go, so do headings and prose that is no turn."""
    bare = lambda x: F.trim(F.replace(F.replace(F.regexp_replace(F.trim(x), r"^[-*+]\s+", ""), F.lit("**"), F.lit("")), F.lit("__"), F.lit("")))
    keep = lambda x: ~F.trim(x).startswith("#") & x.contains(":") & _looks_like_speaker(F.trim(F.substring_index(bare(x), ":", 1)))
    return files.withColumn("body", F.transform(F.filter("body", keep), bare))


def _turns(files: DataFrame) -> DataFrame:
    """The turns of text and Markdown files."""
    framed = _front_matter(files.where("format in ('text', 'markdown')"))
    return _folded(_turn_lines(framed.where("format = 'text'").unionByName(_markdown(framed.where("format = 'markdown'")))))


def parse(files: DataFrame) -> DataFrame:
    """Utterances of text, Markdown, JSON and CSV files, by the format of each; files that could not be read have none."""
    files = _readable(files)
    return _parsed(files, _turns(files))


def problems(files: DataFrame) -> DataFrame:
    """(path, problem) of files that give no utterances because something is wrong with them."""
    return _problems(files, _turns(_readable(files)))


def parse_and_problems(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """parse() and problems() of files whose lines are cut into turns once, for both."""
    turns = materialize(_turns(_readable(files)), "turns")
    return _parsed(_readable(files), turns), _problems(files, turns)


def _readable(files: DataFrame) -> DataFrame:
    return files.where("problem is null").drop("problem") if "problem" in files.columns else files


def _parsed(files: DataFrame, turns: DataFrame) -> DataFrame:
    bad = turns.where("turn = 0").select("path")
    out = _finished(turns.join(bad, "path", "left_anti")).unionByName(_json(files.where("format = 'json'"))).unionByName(_csv(files.where("format = 'csv'")))
    for name, reader in READERS.items():
        out = out.unionByName(reader(files.where(F.col("format") == name)).select(*out.columns))
    return out


def _problems(files: DataFrame, turns: DataFrame) -> DataFrame:
    if "problem" in files.columns:
        return files.where("problem is not null").select("path", "problem").unionByName(_problems(_readable(files), turns))
    framed = _front_matter(files.where("format in ('text', 'markdown')"))
    early = turns.where("turn = 0 and format = 'text'").select("path", F.lit("a line stands before any turn").alias("problem"))
    unread = files.where("format = 'json'").where(F.try_parse_json("content").isNull()).select("path", F.lit("not JSON").alias("problem"))
    date = F.col("fields")["date"]
    dates = framed.where(date.isNotNull() & F.try_to_date(date, "yyyy-MM-dd").isNull()).select("path", F.lit("date is not YYYY-MM-DD").alias("problem"))
    unknown = files.where("format is null").select("path", F.lit("unknown format").alias("problem"))
    unread = unread.unionByName(files.where(~F.is_valid_utf8("content")).select("path", F.lit("not UTF-8").alias("problem")))
    stamps = files.where("format = 'json'").where(F.col("content").rlike(r'"(?:' + "|".join(TIME_KEYS) + r')"\s*:\s*(?:true|false)\b')).select("path", F.lit("a timestamp is a truth value").alias("problem"))
    unread = unread.unionByName(stamps)
    return framed.where("problem is not null").select("path", "problem").unionByName(early).unionByName(unread).unionByName(dates).unionByName(unknown)


def _json(files: DataFrame) -> DataFrame:
    """An object with `utterances`, or a bare array of them; of several names of a field the first not null counts."""
    item = ", ".join(f"{k}: string" for k in (*SPEAKER_KEYS, *TEXT_KEYS, *TIME_KEYS))
    whole = F.when(F.ltrim("content").startswith("["), F.concat(F.lit('{"utterances":'), F.col("content"), F.lit("}"))).otherwise(F.col("content"))
    rows = files.withColumn("_j", F.from_json(whole, f"title string, date string, metadata map<string,string>, utterances array<struct<{item}>>"))
    fields = F.coalesce("_j.metadata", F.create_map().cast("map<string,string>"))
    each = rows.select("path", "transcript_hash", fields.alias("_extra"), F.col("_j.title").alias("_title"), F.col("_j.date").alias("_date"), F.posexplode("_j.utterances").alias("p", "u"))
    pick = lambda keys: F.coalesce(*[F.col(f"u.{k}") for k in keys])
    title, date = F.coalesce("_title", F.col("_extra")["title"]), F.coalesce("_date", F.col("_extra")["date"])
    return each.select(
        derive_meeting_id(F.col("path"), title).alias("meeting_id"), title.alias("title"), F.when(F.try_to_date(date, "yyyy-MM-dd").isNotNull(), date).alias("meeting_date"),
        F.map_filter("_extra", lambda k, v: ~k.isin("title", "date")).alias("extra"), normalize_speaker(pick(SPEAKER_KEYS)).alias("speaker"), F.col("p").cast("int").alias("utterance_index"),
        timestamp_seconds(pick(TIME_KEYS)).alias("timestamp"), normalize_whitespace(pick(TEXT_KEYS)).alias("text"), "path", "transcript_hash",
    )


#: A CSV record, and a cell with the comma behind it. Possessive, so that they are read in one go whatever their length.
RECORD = r'[^"\n]*+(?:"[^"]*+(?:"|\z)[^"\n]*+)*+(?:\n|\z)'
CELL = r'[^",]*+(?:"[^"]*+(?:"|\z)[^",]*+)*+(?:,|\z)'


def _csv(files: DataFrame) -> DataFrame:
    """Rows `owner, text` under a header whose names are looked up without regard to case; a quoted field may hold
    commas and newlines."""
    records = F.regexp_extract_all(normalize_newlines(F.col("content")), F.lit(RECORD), F.lit(0))
    bare = lambda c: F.trim(F.replace(F.regexp_replace(F.trim(F.regexp_replace(c, r",\z", "")), '^"|"$', ""), F.lit('""'), F.lit('"')))
    cells = lambda x: F.transform(F.regexp_extract_all(F.regexp_replace(x, r"\n\z", ""), F.lit(CELL), F.lit(0)), bare)
    rows = files.select("path", "transcript_hash", F.posexplode(records).alias("p", "r"))
    heads = files.select("path", F.transform(cells(F.regexp_extract(normalize_newlines(F.col("content")), RECORD, 0)), lambda c: F.lower(c)).alias("h"))
    rows = rows.where("p > 0").join(heads, "path")
    rows = rows.withColumn("c", cells(F.col("r")))
    pick = lambda names: F.coalesce(*[F.nullif(F.when(F.array_position("h", n) > 0, F.get("c", (F.array_position("h", n) - 1).cast("int"))), F.lit("")) for n in names])
    rows = rows.withColumns({"who": pick(OWNER_COLUMNS), "said": pick(BODY_COLUMNS)}).where("who is not null and said is not null")
    place = F.row_number().over(Window.partitionBy("path").orderBy("p")) - 1
    none = F.lit(None).cast("string")
    return rows.select(derive_meeting_id(F.col("path"), none).alias("meeting_id"), none.alias("title"), none.alias("meeting_date"), F.create_map().cast("map<string,string>").alias("extra"), normalize_speaker(F.col("who")).alias("speaker"), place.cast("int").alias("utterance_index"), F.lit(None).cast("double").alias("timestamp"), normalize_whitespace(F.col("said")).alias("text"), "path", "transcript_hash")


def aliases(files: DataFrame) -> DataFrame:
    """(path, speaker, aliases): the labels as written that stand for each speaker of text and Markdown files."""
    framed = _front_matter(files.where("format in ('text', 'markdown')"))
    text = framed.where("format = 'text'").unionByName(_markdown(framed.where("format = 'markdown'")))
    said = _turn_lines(text).where("is_turn").select("path", normalize_speaker(F.col("who")).alias("speaker"), "who")
    return said.groupBy("path", "speaker").agg(F.array_sort(F.collect_set("who")).alias("aliases"))


#: Parsers by format, each a function from files (path, content, transcript_hash, format) to utterances. Add one's own here.
READERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register(ending: str, name: str, reader: Callable[[DataFrame], DataFrame]) -> None:
    """Files with this ending are read by this parser from now on."""
    FORMATS[ending.lower().lstrip(".")] = name
    READERS[name] = reader


def meetings_of(utterances: DataFrame) -> DataFrame:
    """A row a meeting: its head, its length in seconds (0 for one timestamp, null for none) and its participants as they first spoke.

    Utterances are brought down to a row for each meeting and speaker before they leave their tasks; what is sorted is a
    meeting's speakers alone. An utterance without a speaker adds no participant.
    """
    first = utterances.groupBy("meeting_id", "speaker").agg(
        F.min("utterance_index").alias("at"), F.min("title").alias("title"), F.min("meeting_date").alias("date"), F.min("path").alias("source"), F.min("transcript_hash").alias("transcript_hash"),
        F.max("timestamp").alias("last"), F.min("timestamp").alias("begin"),
    )
    spoke = F.array_sort(F.collect_list(F.when(F.col("speaker").isNotNull(), F.struct("at", "speaker"))))
    return first.groupBy("meeting_id").agg(
        F.min("title").alias("title"), F.min("date").alias("date"), F.min("source").alias("source"), F.min("transcript_hash").alias("transcript_hash"),
        (F.max("last") - F.min("begin")).alias("duration_seconds"), F.transform(spoke, lambda x: x["speaker"]).alias("participants"),
    )
