"""Language profiles: held-out accuracy of the query, and bundling against its definition."""

import os
import zlib

import numpy as np
import pytest

from quorumlens.llm import language

DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the sample tables")
def test_held_out_accuracy(spark):
    out = {r["doc_id"]: r for r in language.op8_language_profiles(spark, DATA).collect()}
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert set(out) == set(docs)
    held = [i for i in docs if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(out[i]["held_out"] == (i in set(held)) for i in docs) and all(0 <= r["score"] <= 1 for r in out.values())
    known = [i for i in held if docs[i]["lang"] and docs[i]["text"] and any(map(str.isalpha, docs[i]["text"]))]
    assert len(known) > 100 and sum(out[i]["lang_pred"] == docs[i]["lang"] for i in known) >= 0.97 * len(known)


def test_bundles_by_definition():
    """Each trigram's letters, rotated by place and multiplied, added up."""
    p = language.Profiler(dims=64)
    letters = p.rotated[2]  # not rotated: the last place
    vector = lambda c: letters[1 + ord(c) % 4095 if c.isalpha() else 0].astype(int)
    for text in ("Ab c", "aß-日 x", "q", "a  b\n\nc" * 50):
        plain = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
        want = sum(np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c) for a, b, c in zip(plain, plain[1:], plain[2:]))
        assert np.array_equal(p.bundle(*p.grams(text)).astype(int), want), text


def test_very_long_texts(spark):
    rows = [(1, "lorem ipsum dolor " * 100_000, "one"), (2, "zwölf xylophone " * 100_000, "two"), (3, None, "one"), (1, "lorem", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = language.identify(d, language.train_profiles(d)).collect()
    assert sorted((r["doc_id"], r["lang_pred"]) for r in out) == [(1, "one"), (1, "one"), (2, "two"), (3, "und")]
