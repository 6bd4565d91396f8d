"""The queries op3, op4 and op7 and the rates of op10 on a small folder, against plain Python; long texts and clashing names."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from quorumlens.llm import idstore, media, mixing, packing, tokens


def texts():
    r = random.Random(6)
    word = lambda: "".join(r.choice("etaoinshr") for _ in range(r.randint(1, 9)))
    prose = lambda n: " ".join(word().capitalize() if r.random() < 0.1 else word() + r.choice(["", "", ".", ",", "###", "'s"]) for _ in range(n))
    odd = "Ελλάς ΣΑΣ. ﬁne Ⅷ x̄ Å क़ İstanbul's 10:30 a\tb c\r\nd  e don't [\"q\"]! <|endoftext|> " * 3
    return [None, "", " \n\t ", "same text", "same text", odd, prose(30_000), *(prose(r.randint(1, 300)) for _ in range(40)), "x" * 3000, "日本 語。" * 2000]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("contract")
    rows = [(7 * i % 101, t, f"s{i % 3}" if i % 5 else None) for i, t in enumerate(texts())]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path), dict((d, t) for d, t, _ in rows)


def ids_of(t):
    return [*tokens.encoder(tokens.vocabulary()).tokenizer.encode(t or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing_query(spark, folder):
    whole = {d: ids_of(t) for d, t in folder[1].items()}
    seen, windows = {d: 0 for d in whole}, {}
    rows = packing.op3_mixture_packing(spark, folder[0]).collect()
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        part = whole[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == seen[r["doc_id"]] and len(part) == r["length"] > 0 and crc(part) == r["ids_crc32"] and r["doc_tokens"] == len(whole[r["doc_id"]])
        seen[r["doc_id"]] += r["length"]
    assert seen == {d: len(x) for d, x in whole.items()}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == windows.get(r["sequence_id"], 0)
        windows[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n == 4096 for w, n in windows.items() if w < max(windows)) and max(windows.values()) <= 4096


def test_tempered_targets_hold_until_a_source_runs_out():
    totals = {"a": 100_000, "b": 10_000, packing.POOL: 0}
    shares = packing.tempered(0.7)(totals)
    s = packing.Schedule(packing.phases(list(totals.values()), [shares.get(k, 0) / sum(shares.values()) for k in totals]), 100)
    want = shares["b"] / sum(shares.values()) * 100
    for w in range(int(10_000 / want)):
        assert abs(s.given_by(1, w) - w * want) < 2  # a token by the window, one by the phase
    assert s.given_by(1, 1100) == 10_000 and s.given_by(0, 1100) == 100_000


def test_id_store_query(spark, folder):
    out = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in idstore.op7_id_store(spark, folder[0]).collect()}
    want, at = {}, 0
    for d in sorted(folder[1]):
        ids = ids_of(folder[1][d])
        want[d] = (at, len(ids), crc(ids))
        at += len(ids)
    assert out == want


def test_media_query(spark, folder):
    out = {r["doc_id"]: r for r in media.op4_progressive_jpeg(spark, folder[0]).collect()}
    assert set(out) == set(folder[1])
    for d, t in folder[1].items():
        raw = (t or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 576)) * 576, b"\xff")
        r = out[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    same = [d for d, t in folder[1].items() if t == "same text"]
    assert len({tuple(out[d][c] for c in ("media_sha256", "media_bytes", "feature")) for d in same}) == 1


def test_wide_vocabularies_are_not_cut(monkeypatch):
    monkeypatch.setattr(tokens.encoder(tokens.vocabulary()), "largest", 70_000)
    assert tokens.id_width(tokens.vocabulary()) == 4


def test_posteriors_against_brute_force(spark):
    """Bernoulli naive Bayes by its definition, over the vocabulary that was chosen."""
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(["red", "blue", "sun", "rain", "$$$", "win"] if i % 3 == 0 else ["red", "blue", "sun", "rain", "tree"]) for _ in range(12))) for i in range(240)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, "spam" if i % 3 == 0 else "ham") for i in range(200)], "doc_id long, domain string")
    out = mixing.mix(d.withColumnRenamed("doc_id", "p").withColumnsRenamed({"p": "doc_id"}).selectExpr("*", "1 as p", "2 as row", "3 as n"), labels, {})
    got = {x["doc_id"]: x["domains"] for x in out.collect()}
    assert {"p", "row", "n"} <= set(out.columns)
    model = mixing.train_domains(d, labels)
    assert {"win", "$$$"} <= set(model.weights)
    bags = {i: set(t.split()) & set(model.weights) for i, t in rows}
    for i in (0, 1, 2, 3, 230):
        odds = {}
        for name in ("ham", "spam"):
            mine = [k for k in range(200) if (k % 3 == 0) == (name == "spam")]
            odds[name] = len(mine) / 200
            for w in model.weights:
                p = (sum(w in bags[k] for k in mine) + 0.5) / (len(mine) + 1)
                odds[name] *= p if w in bags[i] else 1 - p
        assert all(abs(got[i][k] - v / sum(odds.values())) < 1e-9 for k, v in odds.items())


def test_mixture_meets_its_targets(spark):
    """Copies, not only rates, come to the targets, and the error is reported."""
    r = random.Random(2)
    rows = [(i, " ".join(r.choice("abcdefgh") * 3 for _ in range(20)) + (" vile ###" if i % 4 == 0 else "")) for i in range(4000)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, "bad" if i % 4 == 0 else "good") for i in range(1000)], "doc_id long, domain string")
    total = sum(len(t.split()) for _, t in rows)
    out = mixing.mix(d, labels, {"good": 0.9 * total, "bad": 0.05 * total})
    assert out.mixing_error < 1e-3
    kept = out.withColumn("copies", mixing.copies(out["rate"], out["doc_id"])).collect()
    for name, share in (("good", 0.9), ("bad", 0.05)):
        assert abs(sum(x["copies"] * x["n_tokens"] * x["domains"][name] for x in kept) - share * total) < 0.01 * total


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_dedup_stage_without_ids(spark):
    import corpus_pipeline

    a, b = " ".join(f"a{i}" for i in range(99)), " ".join(f"b{i}" for i in range(99))
    rows = [(1, a, "en", "s", 1), (1, a, "en", "s", 1), (None, a + " z", "en", "s", 1), (None, b, "en", "s", 1), (None, b, "en", "s", 1), (2, "other words", None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, d, "").collect()), key=str) == sorted([(1, a), (None, b), (2, "other words")], key=str)
