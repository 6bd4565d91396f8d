"""The substring index, deduplication within a threshold, exact rounding, and archives of many members."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quorumlens.functions.text import round_half_even
from quorumlens.operators import index, retrieval, store
from quorumlens.sources import transcripts

MEMORY = "memory_id string, meeting_id string, memory_type string, text string, speaker string, confidence double, utterance_index int, status string, created_at string, metadata map<string,string>"


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    r = random.Random(1)
    words = ["kafka", "redis", "delay", "budget", "é中文字", "pilot", "of", "a"]
    rows = []
    for i in range(4000):
        text = " ".join(r.choice(words) for _ in range(r.randint(1, 6))) + (" Zeppelin!" if i == 1234 else "")
        rows.append((f"x{i}", f"m{i // 40:03d}", "fact", text, r.choice([None, "Ana", "Bo"]), 0.5, i % 40, "active", "t", {"due": "friday"} if i % 9 == 0 else None))
    meetings = spark.createDataFrame([(f"m{m:03d}", "Yearly quorum" if m == 77 else None, f"2026-01-{m % 28 + 1:02d}", ["Ana", "Zoë"]) for m in range(100)], "meeting_id string, title string, date string, participants array<string>")
    memories = spark.createDataFrame(rows, MEMORY)
    return memories, meetings, index.build(memories, meetings, str(tmp_path_factory.mktemp("index") / "i"), block_rows=100, buckets=8)


@pytest.mark.parametrize("text, most", [("zeppelin", 1), ("quorum kafka", 2), ("zeppelin kafka", 1), ("kafka", 40), ("friday redis", 40), ("of", 40), ("nowhere", 0), ("", 40), ("ana pilot", 40), ("eppeli", 1)])
def test_search_by_index(indexed, text, most):
    """The same rows and scores as without an index; a rare term reads a block or two of forty."""
    memories, meetings, built = indexed
    q = retrieval.Query(text)
    key = lambda df: sorted((r["memory_id"], round(r["score"], 9)) for r in df.select("memory_id", "score").collect())
    found, read, there = built.search(q)
    assert key(found) == key(retrieval.retrieve(memories, meetings, q))
    assert 35 <= there <= 45 and read <= max(most, 0 if most < 40 else there)
    if most < 40:
        assert 10 * read < there and len(found.inputFiles()) <= 2 * max(read, 1) + len(meetings.inputFiles()) + 8


def test_no_memories_to_index(spark, indexed, tmp_path):
    memories, meetings, _ = indexed
    built = index.build(memories.limit(0), meetings, f"{tmp_path}/empty")
    assert built.search(retrieval.Query("kafka"))[0].count() == 0


def fold(rows, threshold):
    kept = {}
    for new, at, ident, meeting, content, confidence in sorted(rows):
        mine = kept.setdefault((meeting, content), [])
        if not new or all(abs(c - confidence) > threshold for c, _, _ in mine):
            mine.append((confidence, ident, new))
    return sorted(i for v in kept.values() for _, i, new in v if new)


@pytest.mark.parametrize("threshold", [0.0, 0.05, 0.3])
def test_deduplication_within_a_threshold(spark, threshold):
    r = random.Random(int(threshold * 100))
    make = lambda new, n: [(new, r.choice(["t1", "t2"]), f"{'n' if new else 's'}{i:04d}", r.choice("mn"), r.choice("xyz"), round(r.random(), r.choice([1, 3]))) for i in range(n)]
    stored, fresh = make(False, 30), make(True, 600)
    table = lambda rows: spark.createDataFrame([x[1:] for x in rows], "created_at string, memory_id string, meeting_id string, content_hash string, confidence double")
    got = store.deduplicate(table(fresh), threshold, stored=table(stored))
    assert sorted(x["memory_id"] for x in got.collect()) == fold(stored + fresh, threshold)


def test_a_million_rows_of_one_content(spark):
    rows = spark.range(1_000_000).select(F.format_string("i%07d", "id").alias("memory_id"), F.lit("m").alias("meeting_id"), F.lit("h").alias("content_hash"), F.lit("t").alias("created_at"), (F.pmod(F.xxhash64("id"), F.lit(1001)) / 1000.0).alias("confidence"))
    kept = [x["confidence"] for x in store.deduplicate(rows, 0.05).collect()]
    assert len(kept) > 10 and all(abs(a - b) > 0.05 for i, a in enumerate(kept) for b in kept[:i])


def test_rounding_is_that_of_exact_values(spark):
    r = random.Random(2)
    xs = [r.choice([r.random(), r.uniform(-1e4, 1e4), r.uniform(0, 1e9), r.random() * 10 ** r.randint(-9, 2)]) for _ in range(100_000)]
    xs += [1 / 32, 3 / 32, 0.5, 1.5, 2.5, -0.5, -2.5, 0.125, 0.375, 2.675, 1.005, 0.00005, 1e300, -1e16, 0.0, -0.0, float("inf"), 5e-324, 0.1 + 0.2] + [k / 64 for k in range(-200, 200)] + [k / 1000 + 0.0005 for k in range(1000)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    for digits in (0, 2, 3, 4, 6):
        got = {row["i"]: row["y"] for row in df.select("i", round_half_even(F.col("x"), digits).alias("y")).collect()}
        wrong = [(x, got[i], round(x, digits)) for i, x in enumerate(xs) if got[i] != round(x, digits)] if digits else [(x, got[i]) for i, x in enumerate(xs) if abs(x) < 1e15 and got[i] != round(x)]
        assert not wrong, wrong[:5]
    assert spark.range(1).select(round_half_even(F.lit(None).cast("double"), 3).alias("n"), F.isnan(round_half_even(F.lit(float("nan")), 3)).alias("x")).first() == (None, True)


def test_an_archive_of_many_members(spark, tmp_path):
    """Its members are unpacked by all tasks; those that cannot be read say why."""
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(2000):
            z.writestr(f"d/m{i}.txt", f"Ana: We decided on item {i}.")
        z.writestr("stored.txt", "Bo: hi", zipfile.ZIP_STORED)
        z.writestr("packed.txt", "Bo: hi", zipfile.ZIP_BZIP2)
        z.writestr("latin.txt", b"Bo: caf\xe9")
        z.writestr("twice.txt", "Bo: first")
        z.writestr("twice.txt", "Bo: last")
    data = bytearray(body.getvalue())
    with zipfile.ZipFile(body) as z:
        m = z.getinfo("d/m7.txt")
        begin = m.header_offset + 30 + len(m.filename)
        data[begin + 2] ^= 0xFF
        data[z.getinfo("d/m9.txt").header_offset] = 0
    (tmp_path / "a.zip").write_bytes(bytes(data))
    (tmp_path / "b.zip").write_bytes(b"no archive")
    read = transcripts.read_zip(spark, str(tmp_path)).cache()
    wrong = {r["path"]: r["problem"] for r in transcripts.problems(read).collect()}
    assert wrong.pop("a.zip:d/m7.txt") in ("the member is broken", "the member's checksum is wrong", "not UTF-8")
    assert wrong == {"a.zip:d/m9.txt": "the member is not where the archive says", "a.zip:packed.txt": "compression method 12 is not read", "a.zip:latin.txt": "not UTF-8", "b.zip": "not a zip archive"}
    texts = {r["path"]: r["text"] for r in transcripts.parse(read).collect()}
    assert len(texts) == 2000 and texts["a.zip:twice.txt"] == "last" and texts["a.zip:stored.txt"] == "hi" and texts["a.zip:d/m1999.txt"] == "We decided on item 1999."
    sizes = [r["count"] for r in read.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and min(sizes) > 200
