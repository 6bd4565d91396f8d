"""op5 against its own brute force, and what pruning by ranges saves."""

import random
import zlib

from quorumlens.llm import sharding


def make(n=480):
    r = random.Random(8)
    rows = [(i, None if i % 97 == 0 else "w " * int(2 ** r.uniform(0, 12)), r.choice(["de", "en", "fr", None]), f"site{min(int(r.expovariate(0.2)), 30):02d}") for i in range(n)]
    return [*rows, rows[5], rows[5]]


def brute_curve(cell, bits):
    """Skilling's transform, on plain numbers."""
    x, n, q = list(cell), len(cell), 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[-1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    return sum((x[i] >> b & 1) << (b * n + n - 1 - i) for b in range(bits) for i in range(n))


def test_query_against_brute_force(spark, tmp_path):
    rows = make()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((x["shard"], x["slot"]), x["doc_id"], x["size"], x["text_crc32"], x["curve"], x["law"], x["grown_shard"]) for x in sharding.op5_hilbert_shards(spark, str(tmp_path)).collect())
    key = lambda v: (v is not None, v or "")
    cell = lambda v, i: sum(key(x[i]) < key(v) for x in rows) * 64 // len(rows)
    log = lambda n: min(63, next(k for k in range(200) if (1 + n) ** 4 < 2 ** (k + 1)))
    want = []
    for d, t, lang, source in rows:
        raw = (t or "").encode()
        want.append((brute_curve([cell(lang, 2), cell(source, 3), log(len(raw))], 6), d, zlib.crc32(raw), len(raw) + 8))
    want.sort()
    small, extra = divmod(len(rows), 24)
    places = [(s, k) for s in range(24) for k in range(small + (s < extra))]
    assert got == [(p, d, size, crc, curve, "rows", None) for p, (curve, d, crc, size) in zip(places, want)]


def test_ranges_prune(spark, tmp_path):
    """A question on three dimensions reads few shards, and a reader of these files finds all rows it asks for."""
    d = spark.createDataFrame(make(2400), "doc_id long, text string, lang string, source string")
    table = sharding.metadata_shards(d)
    ranges = sharding.shard_ranges(table, sharding.DIMS)
    wanted = {"lang": ("fr", "fr"), "source": ("site00", "site02"), "size": (9, 200)}
    few = {r["shard"] for r in sharding.shards_that_may_hold(ranges, wanted).collect()}
    hit = table.where("lang = 'fr' and source between 'site00' and 'site02' and size between 9 and 200")
    assert {r["shard"] for r in hit.collect()} <= few and len(few) <= 8
    sharding.write_shards(table, f"{tmp_path}/shards")
    read = spark.read.parquet(f"{tmp_path}/shards")
    assert read.count() == table.count() and read.where(read["shard"].isin(*few)).where("lang = 'fr' and source <= 'site02' and size between 9 and 200").count() == hit.count()


def test_empty_and_null(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert sharding.metadata_shards(empty).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None)] * 3, "doc_id long, text string, lang string, source string")
    assert sorted((r["shard"], r["slot"], r["size"]) for r in sharding.metadata_shards(nulls, 2).collect()) == [(0, 0, 8), (0, 1, 8), (1, 0, 8)]
