"""Line-first cleaning: rules on each line, then a verdict on what is left of the document."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, let, text_or_empty

SYMBOLS = r"[#*$%&|<>]"
#: Marks that make a line a table, a menu or noise when they are a tenth of it.
NOISE = r"[#*$%&|<>{}\[\]_=~^+\\]|!!+|\?\?+"
#: Notices that sites and licences put on a line of their own.
BOILERPLATE = (
    r"(?i)all rights reserved|licensed under|released under the .{0,40}licen[cs]e|general public license"
    r"|accept (all )?cookies|cookie policy|privacy policy|terms of (use|service)|subscribe to our|sign up for our|click here to"
)
#: Parts of the notices above, one of which stands in every match.
NOTICE_PARTS = ("rights reserved", "licen", "cookie", "privacy policy", "terms of ", "subscribe to our", "sign up for our", "click here to")
SENTENCE_END = r"[.!?:;…\"'”’)\]]\s*$"


def may_hold_notice(text: Column) -> Column:
    """False only where no line of text matches BOILERPLATE: plain substring searches, far cheaper than the pattern."""
    return let(F.lower(text), lambda t: F.array_contains(F.array(*[F.contains(t, F.lit(part)) for part in NOTICE_PARTS]), True))


def line_fails(line: Column, menu_words: int = 3, noise_percent: int = 10, notices: Column | None = None) -> Column:
    """True for a line of noise marks, a menu entry (few words and no end of sentence) or a standing notice.

    notices: may_hold_notice() of the text that the line is from, if known.
    """
    size = F.char_length(line)
    noise = F.char_length(F.array_join(F.regexp_extract_all(line, F.lit(NOISE), F.lit(0)), ""))
    few = line.rlike(rf"^{SPACE}*({WORD}({SPACE}+|\z)){{0,{menu_words}}}\z")
    notice = line.rlike(BOILERPLATE) if notices is None else notices & line.rlike(BOILERPLATE)
    return (noise * 100 > size * noise_percent) | (few & ~line.rlike(SENTENCE_END)) | notice


def _joined(ahead: int, runs: Column) -> Column:
    """Each run's hash with that of the run `ahead` places on; runs that reach over the end are of no use."""
    return F.transform(runs, lambda h, i: F.xxhash64(h, F.get(runs, i + ahead)))


def clean_lines(docs: DataFrame, text: str = "text", max_lost_percent: int = 50, min_words: int = 20, max_repeat_percent: int = 30, window: int = 8) -> DataFrame:
    """Add the line verdicts and document verdicts to docs; all its own columns stay.

    Added: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (words inside windows of `window` words
    that the text has twice or more), base_failed, n_failed_lines, lost_chars, clean_text and kept. A line is
    removed if line_fails() says so or if it equals an earlier line; blank lines stay, and a text of which no line is
    removed stays as it is. A document is rejected
    if the base rules fail it, or if the removed lines hold more than max_lost_percent of its characters in lines.

    Null and empty texts have zero counts, an empty clean_text and fail the base rule on words. Rows are judged
    one by one: repeated rows and ties change nothing. The added names win over columns of the same name.
    Everything is one narrow projection: no shuffle, and nothing depends on other rows.
    """
    body = text_or_empty(text)
    split = {
        "_words": F.array_remove(F.split(body, SPACE + "+"), ""),
        "_all_lines": F.split(body, "\n", -1),
        "_lines": F.filter(F.split(body, "\n", -1), lambda x: x.rlike(WORD)),
        "_notices": may_hold_notice(body),
    }
    words, lines = F.col("_words"), F.col("_lines")

    def repeated(hashes: Column) -> Column:
        """Words covered by windows whose hash comes twice; hashes: one for each window, by place."""
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(placed, lambda s: F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])))
        starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
        covered = let(starts, lambda s: F.aggregate(F.transform(s, lambda x, k: F.least(F.coalesce(F.get(s, k + 1) - x, F.lit(window)), F.lit(window))), F.lit(0).cast("long"), lambda a, x: a + x))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), covered).otherwise(F.lit(0).cast("long"))

    def windows(hashed: Column) -> Column:
        """Hashes of all windows: each pass hashes two overlapping or adjoining shorter runs into a longer one."""
        covered, runs = 1, hashed
        while covered < window:
            ahead = min(covered, window - covered)
            runs = let(runs, partial(_joined, ahead))
            covered += ahead
        last = F.size(hashed) - window + 1
        return F.when(last >= 2, F.slice(runs, 1, last)).otherwise(F.array().cast("array<bigint>"))

    hashed = let(F.transform(words, lambda w: F.xxhash64(w)), windows)
    judged = F.transform(lines, lambda x: F.struct(x.alias("line"), line_fails(x, notices=F.col("_notices")).alias("fails")))
    added = {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.char_length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.regexp_count(body, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": let(hashed, repeated),
        # equal lines fail alike, so the distinct ones that pass are each line's first occurrence
        "_kept_lines": F.transform(F.filter("_judged", lambda x: ~x["fails"]), lambda x: x["line"]),
        "_line_chars": F.char_length(F.array_join(lines, "")).cast("long"),
        "_n_lines": F.size(lines).cast("long"),
    }
    out = docs.withColumns(split).withColumn("_judged", F.array_distinct(judged)).withColumns(added)
    kept_chars = F.char_length(F.array_join("_kept_lines", ""))
    out = out.withColumns({
        "base_failed": (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent),
        "n_failed_lines": F.col("_n_lines") - F.size("_kept_lines"),
        "lost_chars": F.col("_line_chars") - kept_chars,
    })
    # blank lines get their place as a mark, so that each stays; no line holds a line feed, so marks are no lines
    marked = F.transform("_all_lines", lambda x, i: F.when(x.rlike(WORD), x).otherwise(F.concat(F.lit("\n"), i.cast("string"), F.lit("\n"), x)))
    left = F.array_except(marked, F.transform(F.filter("_judged", lambda x: x["fails"]), lambda x: x["line"]))
    whole = F.array_join(F.transform(left, lambda x: F.substring_index(x, "\n", -1)), "\n")
    no_blanks = F.size("_all_lines") == F.size("_lines")
    out = out.withColumn("clean_text", F.when(F.col("n_failed_lines") == 0, body).when(no_blanks, F.array_join("_kept_lines", "\n")).otherwise(whole))
    kept = ~F.col("base_failed") & (F.col("lost_chars") * 100 <= F.col("_line_chars") * max_lost_percent)
    return out.withColumn("kept", kept).drop(*split, "_judged", "_kept_lines", "_line_chars", "_n_lines")


def op9_line_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return clean_lines(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_failed_lines", "lost_chars")


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
pos AS (SELECT rid, unnest(range(1, len(ws) - 6)) AS i, ws FROM w WHERE len(ws) >= 8),
win AS (SELECT rid, i, array_to_string(ws[i:i+7], ' ') AS g FROM pos),
twice AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) >= 2),
cover AS (SELECT rid, least(8, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 8)) AS n FROM twice),
rep AS (SELECT rid, CAST(sum(n) AS BIGINT) AS n_repeat_words FROM cover GROUP BY rid),
parts AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
ln AS (SELECT rid, line, count(*) AS n FROM parts WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid, line),
lj AS (SELECT rid, line, n,
    (length(line) - length(regexp_replace(line, '[#*$%&|<>{}\[\]_=~^+\\]|!!+|\?\?+', '', 'g'))) * 100 > length(line) * 10
    OR (len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) <= 3 AND NOT regexp_matches(line, '[.!?:;…"''”’)\]]\s*$'))
    OR regexp_matches(line, '(?i)all rights reserved|licensed under|released under the .{0,40}licen[cs]e|general public license|accept (all )?cookies|cookie policy|privacy policy|terms of (use|service)|subscribe to our|sign up for our|click here to') AS fails
  FROM ln),
lt AS (SELECT rid, sum(n) AS n_lines, sum(n * length(line)) AS line_chars, sum(n - 1) AS dups,
    count(*) FILTER (NOT fails) AS kept_lines, coalesce(sum(length(line)) FILTER (NOT fails), 0) AS kept_chars FROM lj GROUP BY rid),
j AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dups, 0) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    len(ws) < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * len(ws) AS base_failed,
    CAST(coalesce(n_lines - kept_lines, 0) AS BIGINT) AS n_failed_lines,
    CAST(coalesce(line_chars - kept_chars, 0) AS BIGINT) AS lost_chars, coalesce(line_chars, 0) AS line_chars
  FROM d JOIN w USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN lt USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND lost_chars * 100 <= line_chars * 50 AS kept, n_failed_lines, lost_chars FROM j
"""
