"""Links between components by rare shingles, against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorumlens.llm import neardup

SCHEMA = "node long, label long, shingles binary"


def some_sets(seed, n=160):
    """Families that share passages, near copies inside them, and sets made of little but a passage that many have."""
    r = np.random.default_rng(seed)
    draw = lambda m: r.integers(0, 2**64, m, dtype=np.uint64)
    passages, bases = [draw(60) for _ in range(3)], [draw(80) for _ in range(6)]
    sets = []
    for _ in range(n):
        base = bases[r.integers(6)].copy()
        base[r.random(len(base)) < r.choice([0.02, 0.08, 0.12, 0.3])] = draw(1)[0]
        parts = [base] + [passages[i] for i in range(3) if r.random() < 0.5]
        if r.random() < 0.2:
            parts = [passages[0], draw(r.integers(1, 25))]
        if r.random() < 0.05:
            parts = [draw(r.integers(1, 4))]
        sets.append(np.unique(np.concatenate(parts)))
    return sets, r.integers(0, 12, n)


@pytest.mark.parametrize("seed, percent, chunk", [(1, 80, 1024), (2, 85, 3), (3, 60, 10), (4, 100, 1024), (5, 95, 7)])
def test_every_link_between_labels_is_found(spark, seed, percent, chunk):
    sets, labels = some_sets(seed)
    sets += [sets[0], sets[1]]
    labels = [*labels.tolist(), 99, 98]
    rows = spark.createDataFrame([(i, int(x), bytearray(s.tobytes())) for i, (s, x) in enumerate(zip(sets, labels))], SCHEMA).repartition(5)
    got = {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in neardup.cross_links(rows, percent, chunk).collect()}
    want = set()
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if labels[i] != labels[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                want.add((j, i))
    assert got == want and len(want) > 1
    assert neardup.cross_links(rows.limit(0), percent).count() == 0


def test_no_shingle_is_compared_where_labels_agree(spark):
    """A large group of one label gives no pairs; a passage that all have is not among anybody's rare shingles."""
    r = np.random.default_rng(7)
    passage = r.integers(0, 2**64, 50, dtype=np.uint64)
    rows = [(i, i % 2 if i < 10 else 5, bytearray(np.unique(np.concatenate([passage, r.integers(0, 2**64, 60, dtype=np.uint64)])).tobytes())) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    shared = neardup.rare_shingles(df, 80).where(F.col("h").isin([int(x) for x in passage.view(np.int64)]))
    assert shared.count() == 0 and neardup.cross_links(df, 80).count() == 0


@pytest.mark.parametrize("chunk", [4, 16])
def test_components_in_small_chunks(spark, chunk):
    """A group of many chunks has the components that all pairs give."""
    r = np.random.default_rng(chunk)
    word = lambda: f"w{r.integers(0, 100000)}"
    passage = [word() for _ in range(40)]
    bases = [[word() for _ in range(40)] for _ in range(5)]
    texts = []
    for _ in range(120):
        base = list(bases[r.integers(5)])
        for _ in range(r.integers(0, 3)):
            base[r.integers(40)] = word()
        texts.append(" ".join(passage + base))
    out = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), k=3, percent=80, rows=3, chunk=chunk, anchors=1)
    got = {x["doc_id"]: x["component_id"] for x in out.collect()}
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in map(str.split, texts)]
    label = list(range(120))
    for i in range(120):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * len(sets[i] | sets[j]) and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label] if label[j] < label[i] else [label[i] if x == label[j] else x for x in label]
    assert [got[i] for i in range(120)] == label and len(set(label)) > 1
