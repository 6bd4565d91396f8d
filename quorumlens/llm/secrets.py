"""Incremental blob ledger: secrets are searched once for each content and rule version, then joined to every path."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, materialize, partitions, shared_dir, text_or_empty

SPANS = "array<struct<kind:string,start:int,stop:int>>"
#: Hexadecimal digits of a blob that the ledger's tables are parted by.
PREFIX = 2


@dataclass(frozen=True)
class Rule:
    """pattern: Java regex, searched leftmost and without overlap; a match counts if group `group` has least characters."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = True


#: A private key runs from its BEGIN line to its END line. Without one it is the key's header lines and the base64
#: that follow: runs of 16 or more signs, or whole lines. Line breaks may be escaped, as in JSON.
_GAP = r"(?:[\r\n\t\x20]|\\+[rn])"
_BREAK = r"(?:[\t\x20]*+(?:[\r\n]|\\+[rn]))"
PEM = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:[^-]|-(?!----))*+-----END [A-Z ]*PRIVATE KEY-----"
    rf"|(?:{_GAP}*+(?:Proc-Type|DEK-Info):[^\r\n\\]*+)*+"
    rf"(?:{_GAP}*+[A-Za-z0-9+/=]{{16,}}+|{_BREAK}++[\t\x20]*+[A-Za-z0-9+/=]++(?=[\t\x20]*+(?:[\r\n\\\"']|\z)))*+)"
)

#: The order is the order of kinds that start at the same place.
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
    Rule("pem", 2, PEM, base=False),
    Rule("bearer", 1, r"(?i)bearer\x20+([A-Za-z0-9+/_.=-]{20,})", 1, 20, base=False),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", base=False),
)


def running_totals(sizes: Column, chunk: int = 500, combine=lambda a, x: a + x) -> Column:
    """For an array of whole numbers, none below 0, the sum before each place, or what combine makes of those before.

    A fold that appends copies its array each time, so sums run inside chunks and over the chunks' totals.
    """
    none = F.array().cast("array<bigint>")

    def prefixes(xs: Column, start: Column) -> Column:
        step = lambda a, x: F.struct(combine(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        return F.aggregate(xs, F.struct(start.alias("at"), none.alias("out")), step, lambda a: a["out"])

    def over(xs: Column) -> Column:
        count = F.ceil(F.size(xs) / chunk).cast("int")
        chunks = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(xs, i * chunk + 1, chunk))).otherwise(F.array().cast("array<array<bigint>>"))

        def placed(cs: Column) -> Column:
            totals = F.transform(cs, lambda c: F.aggregate(c, F.lit(0).cast("bigint"), combine))
            return F.flatten(F.zip_with(cs, prefixes(totals, F.lit(0).cast("bigint")), prefixes))

        return let(chunks, placed)

    return let(F.transform(sizes, lambda x: x.cast("bigint")), over)


def spans_of(text: Column, rule: Rule) -> Column:
    """The rule's spans in code points, end exclusive.

    The pieces between matches and the matches themselves alternate, so lengths summed up give the places.
    """

    def places(m: Column) -> Column:
        gaps = F.transform(F.split(text, rule.pattern, -1), lambda p: F.char_length(p))
        both = F.zip_with(gaps, F.transform(m, lambda x: F.char_length(x)), lambda p, x: F.struct(p.alias("gap"), x.alias("size")))
        matched = F.filter(both, lambda x: x["size"].isNotNull())
        spans = lambda xs: F.zip_with(running_totals(F.transform(xs, lambda x: x["gap"] + x["size"])), xs, lambda at, x: F.struct((at + x["gap"]).cast("int").alias("start"), (at + x["gap"] + x["size"]).cast("int").alias("stop")))
        return let(matched, spans)

    found = let(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), places)
    if rule.group:
        keys = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
        found = let(keys, lambda k: F.filter(found, lambda x, i: F.char_length(k[i]) >= rule.least))
    named = F.transform(found, lambda x: F.struct(F.lit(rule.kind).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop")))
    return F.when(text.rlike(rule.pattern), named).otherwise(F.array().cast(SPANS))


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at path, or an empty one where nothing was written yet."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def scan_ledger(docs: DataFrame, ledger: str, text: str = "text", rules: Sequence[Rule] = RULES, path: str | None = None, version: str = "") -> DataFrame:
    """Add `blob` (SHA-256 of the text) and `spans` (array of kind, start, stop) to docs, scanning only what is new.

    ledger is a folder that every executor sees, with three tables: `scanned` (blob, rule, version), `findings`
    (blob, rule, version, spans) and, where `path` names a column, `versions` (path, version, blob): the content that
    each path had in each version of the corpus. A blob whose (rule, version) pairs are all in `scanned` is not read
    again: its text does not leave its task. So a later version of a corpus costs what changed in it, and a raised
    rule version costs one search by that rule. `scanned` and `findings` are parted by the first two digits of blob, and a
    batch reads the parts of its own blobs alone. A path's content is kept once a version. Findings are appended before scanned pairs; a job lost between the
    two repeats its scan and the repeated findings, being equal, fall together on reading.

    A null text counts as empty and has no spans. Equal texts share a blob and get equal spans, each row its own.
    docs' own columns stay, but for `blob` and `spans`, which are overwritten. Spans of one blob are ordered by
    start, then by the order of rules.
    """
    spark = docs.sparkSession
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    docs = docs.drop("blob", "spans").withColumn("blob", F.sha2(F.encode(text_or_empty(text), "utf-8"), 256))
    asked = materialize(docs.select("blob").distinct(), "asked")
    prefixes = sorted(r[0] for r in asked.select(_prefix()).distinct().collect())  # 256 at most
    scanned = _stored(spark, f"{ledger}/scanned", "blob string, rule string, version int, prefix string").where(F.col("prefix").isin(prefixes))
    known = scanned.join(asked, "blob", "left_semi").groupBy("blob").agg(F.collect_set(F.struct("rule", "version")).alias("done"))
    want = [F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version")) for r in rules]
    todo = F.array_except(F.array(*want), F.coalesce(F.col("done"), F.array().cast("array<struct<rule:string,version:int>>")))
    fresh = materialize(asked.join(known, "blob", "left").select("blob", todo.alias("todo")).where(F.size("todo") > 0), "fresh")
    blobs = docs.select("blob", text_or_empty(text).alias("_text")).join(fresh.select("blob"), "blob", "left_semi").dropDuplicates(["blob"]).join(fresh, "blob")
    each = [F.when(F.array_contains("todo", w), F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"), spans_of(F.col("_text"), r).alias("spans"))) for r, w in zip(rules, want)]
    results = blobs.select("blob", F.filter(F.array(*each), lambda x: x.isNotNull()).alias("results"))
    new = f"{ledger}/batches/{uuid.uuid4().hex}"
    results.select("blob", F.transform("results", lambda x: F.struct(x["rule"], x["version"])).alias("pairs"), F.filter("results", lambda x: F.size(x["spans"]) > 0).alias("found")).write.option("compression", "zstd").parquet(new)
    batch = spark.read.parquet(new)
    keep = lambda rows, table: rows.withColumn("prefix", _prefix()).repartition(partitions(spark), "prefix").write.mode("append").option("compression", "zstd").partitionBy("prefix").parquet(f"{ledger}/{table}")
    keep(batch.select("blob", F.explode("found").alias("x")).select("blob", "x.rule", "x.version", "x.spans"), "findings")
    keep(batch.select("blob", F.explode("pairs").alias("x")).select("blob", "x.*"), "scanned")
    if path is not None:
        _keep_versions(docs.select(F.col(path).cast("string").alias("path"), F.lit(version).alias("version"), "blob"), ledger, version)

    findings = _findings(spark, ledger, rules).where(F.col("prefix").isin(prefixes)).join(asked, "blob", "left_semi")
    by_blob = findings.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("spans"))).alias("spans"))
    keyed = F.transform("spans", lambda x: F.struct(x["start"].alias("start"), order[x["kind"]].alias("k"), x["stop"].alias("stop"), x["kind"].alias("kind")))
    ordered = F.transform(F.array_sort(keyed), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop")))
    # a table of known size: the join broadcasts it only if it is small
    return docs.join(materialize(by_blob.select("blob", ordered.alias("spans")), "spans"), "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(SPANS)))


def _findings(spark: SparkSession, ledger: str, rules: Sequence[Rule]) -> DataFrame:
    live = " or ".join(f"(rule = '{r.kind}' and version = {r.version})" for r in rules) or "false"
    return _stored(spark, f"{ledger}/findings", f"blob string, rule string, version int, spans {SPANS}, prefix string").where(live)


def _prefix() -> Column:
    """What the ledger's tables are parted by: a batch reads and writes the parts of its blobs alone."""
    return F.substring("blob", 1, PREFIX).alias("prefix")


def _keep_versions(rows: DataFrame, ledger: str, version: str) -> None:
    """Append the contents of a version's paths that the ledger does not have yet."""
    spark = rows.sparkSession
    part = hashlib.sha256(version.encode()).hexdigest()[:16]
    old = _stored(spark, f"{ledger}/versions", "path string, version string, blob string, part string").where(F.col("part") == part)
    had = old.select(F.col("path").alias("_path"), F.col("blob").alias("_blob"))
    new = rows.distinct().join(had, F.col("path").eqNullSafe(F.col("_path")) & (F.col("blob") == F.col("_blob")), "left_anti")
    new.withColumn("part", F.lit(part)).write.mode("append").option("compression", "zstd").partitionBy("part").parquet(f"{ledger}/versions")


def findings_by_path(spark: SparkSession, ledger: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(path, version, blob, kind, start, stop): every finding of every version that any path ever had.

    A path that was scanned twice with one content in one version counts once.
    """
    versions = _stored(spark, f"{ledger}/versions", "path string, version string, blob string, part string").drop("part").distinct()
    found = _findings(spark, ledger, rules).select("blob", F.explode("spans").alias("s")).select("blob", "s.*").distinct()
    return versions.join(materialize(found, "findings"), "blob").select("path", "version", "blob", "kind", "start", "stop")


def fresh_ledger(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/ledgers/{uuid.uuid4().hex}"


def redact(docs: DataFrame, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """Replace every span of the `spans` column in the text by mask; overlapping spans are replaced as one."""
    spans, body = F.col("spans"), F.col(text)
    # a span that begins before an earlier one has ended is part of it
    before = running_totals(F.transform(spans, lambda x: x["stop"]), combine=lambda a, x: F.greatest(a, x))
    gap = lambda x, at: F.when(x["start"] >= at, F.concat(F.substring(body, (at + 1).cast("int"), (x["start"] - at).cast("int")), F.lit(mask))).otherwise("")
    last = F.array_max(F.transform(spans, lambda x: x["stop"]))
    masked = F.concat(F.array_join(F.zip_with(spans, before, gap), ""), F.substring(body, last + 1, F.lit(2**31 - 1)))
    return docs.withColumn(text, F.when(F.size("spans") > 0, masked).otherwise(body))


def _digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def op2_secret_ledger(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_ledger(docs, fresh_ledger(spark), path="doc_id").drop("text")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"].isin(*[r.kind for r in RULES if r.base]))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(F.encode(_digest(base), "utf-8"), 256).alias("base_sha256"), _digest(F.col("spans")).alias("spans"))


#: Pieces and matches of a text alternate, so summed lengths give each match's place. A private key without an END line
#: spans its BEGIN line alone here, as DuckDB's patterns cannot look ahead.
OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
r(k, kind, base, pat, grp, least) AS (VALUES
  (0, 'assign', true, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', true, 6),
  (1, 'access', true, 'AKIA[A-Z0-9]{16,}', false, 20), (2, 'hex', true, '[0-9a-f]{24,}', false, 24),
  (3, 'pem', false, '-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:[^-]|-[^-]|--[^-]|---[^-]|----[^-])*-----END [A-Z ]*PRIVATE KEY-----)?', false, 1), (4, 'bearer', false, '(?i)bearer\x20+([A-Za-z0-9+/_.=-]{20,})', false, 1),
  (5, 'github', false, 'gh[pousr]_[A-Za-z0-9]{36,}', false, 1)),
m AS (
  SELECT rid, 0 AS k, t, regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS ms,
    regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS ks FROM d
  UNION ALL SELECT rid, 1, t, regexp_extract_all(t, 'AKIA[A-Z0-9]{16,}') AS ms, ms FROM d
  UNION ALL SELECT rid, 2, t, regexp_extract_all(t, '[0-9a-f]{24,}') AS ms, ms FROM d
  UNION ALL SELECT rid, 3, t, regexp_extract_all(t, '-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:[^-]|-[^-]|--[^-]|---[^-]|----[^-])*-----END [A-Z ]*PRIVATE KEY-----)?') AS ms, ms FROM d
  UNION ALL SELECT rid, 4, t, regexp_extract_all(t, '(?i)bearer\x20+[A-Za-z0-9+/_.=-]{20,}') AS ms, ms FROM d
  UNION ALL SELECT rid, 5, t, regexp_extract_all(t, 'gh[pousr]_[A-Za-z0-9]{36,}') AS ms, ms FROM d),
p AS (SELECT rid, m.k, ms, ks, least, kind, base, CASE m.k
    WHEN 0 THEN regexp_split_to_array(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)')
    WHEN 1 THEN regexp_split_to_array(t, 'AKIA[A-Z0-9]{16,}') WHEN 2 THEN regexp_split_to_array(t, '[0-9a-f]{24,}')
    WHEN 3 THEN regexp_split_to_array(t, '-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:[^-]|-[^-]|--[^-]|---[^-]|----[^-])*-----END [A-Z ]*PRIVATE KEY-----)?') WHEN 4 THEN regexp_split_to_array(t, '(?i)bearer\x20+[A-Za-z0-9+/_.=-]{20,}')
    ELSE regexp_split_to_array(t, 'gh[pousr]_[A-Za-z0-9]{36,}') END AS ps FROM m JOIN r ON r.k = m.k WHERE len(ms) > 0),
u AS (SELECT rid, k, kind, base, least, unnest(range(1, len(ms) + 1)) AS i, ms, ks, ps FROM p),
s AS (SELECT rid, k, kind, base, length(ks[i]) >= least AS good, length(ms[i]) AS size,
    sum(length(ps[i])) OVER w + coalesce(sum(length(ms[i])) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM u WINDOW w AS (PARTITION BY rid, k ORDER BY i)),
g AS (SELECT rid, k, kind, base, start, kind || ':' || CAST(start AS VARCHAR) || ':' || CAST(start + size AS VARCHAR) AS span FROM s WHERE good),
a AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    coalesce(string_agg(span, ',' ORDER BY start, k) FILTER (base), '') AS b, string_agg(span, ',' ORDER BY start, k) AS spans FROM g GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (rid)
"""
