"""Text, time and identity functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import HEDGES

SPACES = r"(?U)\s+"


def normalize_newlines(x: Column) -> Column:
    return F.regexp_replace(x, "\r\n?", "\n")


def normalize_whitespace(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, SPACES, " "))


def normalize_transcript(x: Column) -> Column:
    """Unix newlines, no white space at line ends, no empty lines at either end."""
    return F.regexp_replace(F.regexp_replace(normalize_newlines(x), r"(?m)[^\S\n]+$", ""), r"^\n+|\n+$", "")


def normalize_speaker(x: Column) -> Column:
    """A speaker label without wrapping marks and closing colon."""
    bare = F.regexp_replace(normalize_whitespace(x), r"\s*:+$", "")
    return F.regexp_replace(bare, "^[\\s*_\"'`]+|[\\s*_\"'`]+$", "")


def normalize_text(x: Column) -> Column:
    """The form that content hashes compare: lower case, words parted by single spaces."""
    return normalize_whitespace(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}_\s]", " "))


def content_hash(kind: Column, text: Column) -> Column:
    return F.sha2(F.concat(kind, F.lit("\n"), normalize_text(text)), 256)


def slugify(x: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("unknown"))


def derive_meeting_id(path: Column, title: Column) -> Column:
    """The file's stem, else the title as a slug of word characters, else `meeting`."""
    name = F.regexp_extract(path, r"([^/\\]+)$", 1)
    stem = F.nullif(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.lit(""))
    slug = F.nullif(F.regexp_replace(F.regexp_replace(F.lower(F.trim(title)), r"[^\p{L}\p{N}_]+", "-"), "^-+|-+$", ""), F.lit(""))
    return F.coalesce(stem, slug, F.lit("meeting"))


def node_id(kind: Column | str, ref: Column) -> Column:
    return F.concat(F.lit(kind) if isinstance(kind, str) else kind, F.lit(":"), ref)


def edge_id(src: Column, relationship: Column, dst: Column, discriminator: Column) -> Column:
    return F.sha1(F.concat_ws("\u001f", src, relationship, dst, discriminator))


def timestamp_seconds(x: Column) -> Column:
    """Seconds of [HH:]MM:SS[.fff] or SS, in brackets or not; null for anything else."""
    form = r"^\s*[\[(]?\s*(?:(?:(\d+):)?([0-5]?\d):)?(\d+(?:[.,]\d+)?)\s*[\])]?\s*$"
    part = lambda i: F.regexp_extract(x, form, i)
    whole = lambda c: F.coalesce(F.expr("try_cast(NULL as double)"), F.nullif(c, F.lit("")).try_cast("double"))
    seconds = F.regexp_replace(part(3), ",", ".").try_cast("double")
    value = F.coalesce(whole(part(1)), F.lit(0.0)) * 3600 + F.coalesce(whole(part(2)), F.lit(0.0)) * 60 + seconds
    return F.when(x.rlike(form) & ((part(2) == "") | (seconds < 60)), value)


def timestamp_label(seconds: Column) -> Column:
    whole = F.floor(seconds).cast("long")
    millis = F.round((seconds - whole) * 1000).cast("long")
    label = F.format_string("%02d:%02d:%02d", F.floor(whole / 3600).cast("long"), (F.floor(whole / 60) % 60).cast("long"), whole % 60)
    return F.when(millis > 0, F.concat(label, F.format_string(".%03d", millis))).otherwise(label)


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def round_half_even(x: Column, digits: int) -> Column:
    """x rounded to digits places by its exact binary value; of two equally near, the one whose last digit is even.

    The product with 10**digits and what it misses of the exact product (Dekker's two-product) tell on which side of
    the middle x lies, or that it lies in it. Quotients of whole numbers are then the nearest doubles. Values too large
    to have that many places stay as they are, and so do null, NaN and infinities.
    """
    scale = float(10**digits)
    high = lambda a: (a * 134217729.0) - ((a * 134217729.0) - a)
    big = 134217729.0 * scale - (134217729.0 * scale - scale)
    small = scale - big

    def rounded(s: Column) -> Column:
        a, p, h = s["a"], s["p"], s["h"]
        lost = ((h * big - p) + h * small + (a - h) * big) + (a - h) * small
        return _let(F.struct(a.alias("a"), F.floor(p).cast("double").alias("f"), (p - F.floor(p)).alias("d"), lost.alias("lost")), nearest)

    def nearest(s: Column) -> Column:
        up = (s["d"] > 0.5) | ((s["d"] == 0.5) & ((s["lost"] > 0) | ((s["lost"] == 0) & (F.pmod(s["f"], F.lit(2.0)) == 1))))
        return (s["f"] + F.when(up, 1.0).otherwise(0.0)) / F.lit(scale)

    sign = F.when((x < 0) | ((x == 0) & (x.cast("string") == "-0.0")), -1.0).otherwise(1.0)
    exact = _let(F.abs(x.cast("double")), lambda a: _let(F.struct(a.alias("a"), (a * F.lit(scale)).alias("p"), high(a).alias("h")), rounded))
    return F.when(F.isnan(x) | (F.abs(x) * F.lit(scale) >= 2.0**52), x.cast("double")).otherwise(exact * sign)


def has_hedge(x: Column) -> Column:
    return x.rlike("(?i)" + HEDGES)


def confidence(base: Column, text: Column, boost: Column) -> Column:
    raw = base + boost - F.when(has_hedge(text), F.lit(0.2)).otherwise(F.lit(0.0))
    return round_half_even(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 3)


def word_count(x: Column) -> Column:
    return F.size(F.filter(F.split(x, SPACES), lambda w: w != ""))


def days_between(start: Column, end: Column) -> Column:
    day = lambda c: F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))
    return F.coalesce(F.date_diff(day(end), day(start)), F.lit(0))


def severity(value: Column, medium: int, high: int, critical: int) -> Column:
    return F.when(value >= critical, "critical").when(value >= high, "high").when(value >= medium, "medium").otherwise("low")


def quote(x: Column, limit: int = 80) -> Column:
    flat = normalize_whitespace(x)
    cut = F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("…"))
    return F.concat(F.lit("“"), F.when(F.char_length(flat) > limit, cut).otherwise(flat), F.lit("”"))
