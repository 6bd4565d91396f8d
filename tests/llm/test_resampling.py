"""op11 against its contract in plain Python, for orders 1 to 3, hard texts, ties and repeated rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from quorumlens.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
LONG = " ".join(f"w{i % 97}" for i in range(30_000))
TEXTS = [None, "", " .,;", "One", "two Words", LONG, "é É 中文 x1", "a b c " * 10, "a b c " * 10, "The cat sat on " * 8, "\x00a\x7fb\x01" * 12, "ÀÀ ss ß" * 9]


def features(text, orders):
    words = WORD.findall((text or "").translate(LOWER))
    return [" ".join(words[i : i + k]) for k in range(1, orders + 1) for i in range(len(words) - k + 1)]


def expected(rows, target, orders=1, buckets=10_000, percent=10, least=20, seed=2024):
    code = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(map(code, features(x, orders)))
    for x in target:
        t.update(map(code, features(x, orders)))
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000.0 * math.log((t[b] + 1) * float(S + buckets) / ((s[b] + 1) * float(T + buckets))))
    out = []
    for i, x in rows:
        f = features(x, orders)
        weight = sum(gain(code(y)) for y in f)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000.0 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(WORD.findall((x or "").translate(LOWER)))])
    ready = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    for k, r in enumerate(ready[: percent * len(ready) // 100]):
        r[4] = k + 1
    return sorted(tuple(r[:5]) for r in out if r[0] is not None), sorted(tuple(r[1:5]) for r in out if r[0] is None)


def got(df):
    rows = [tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()]
    return sorted(r for r in rows if r[0] is not None), sorted(r[1:] for r in rows if r[0] is None)


def key(pair):
    return [[tuple(-1 if v is None else v for v in r) for r in part] for part in pair]


@pytest.mark.parametrize("orders", [1, 2, 3])
def test_draw(spark, orders):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, f"cat {i} " * (10 + i)) for i in range(40)] + [(7, TEXTS[7]), (9, "other text " * 11), (None, "no id here " * 9)]
    target = ["the cat sat", "cat 3 on é", None, ""]
    docs = spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in rows], "doc_id long, text string, bucket string, n int, _row int, rank int").repartition(5)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    out = resampling.resample(docs, goal, percent=40, orders=orders)
    assert key(got(out)) == key(expected(rows, target, orders, percent=40))


def test_nothing_to_draw(spark):
    goal = spark.createDataFrame([("a b",)], "text string")
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, goal).count() == 0
    docs = spark.createDataFrame([(1, "short text"), (2, None)], "doc_id long, text string")
    assert got(resampling.resample(docs, goal.limit(0))) == expected([(1, "short text"), (2, None)], [])
    everyone = got(resampling.resample(docs, goal, percent=100, least_words=0))[0]
    assert sorted(r[4] for r in everyone) == [1, 2]
    with pytest.raises(ValueError):
        resampling.resample(docs, goal, percent=101)
    with pytest.raises(ValueError):
        resampling.position_table(docs, orders=0, row="doc_id")
