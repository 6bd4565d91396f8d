"""What a wrapper induces, and what a language profile predicts, against their definitions in plain Python."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from quorumlens.llm import extraction, language

PARSED = f"_row long, _host string, _group string, _page long, _blocks {extraction.BLOCKS}"
REGIONED = f"_host string, _group string, _regions {extraction.REGIONS}"


def wrappers(parsed, regions, share, least):
    """(constant blocks, region) of each (host, group), counted over its different pages."""
    out = {}
    for key, trees in regions.items():
        pages = {page: blocks for host, group, page, blocks in parsed if (host, group) == key}
        counts = Counter(b for blocks in pages.values() for b in {(at, h, listed, len(t) if t is not None else None) for at, h, listed, _, t in blocks})
        constant = {b for b, n in counts.items() if n >= least and n >= len(pages) * share}
        varying = defaultdict(int)
        for (at, h, listed, chars), n in counts.items():
            if (at, h, listed, chars) not in constant and not listed:
                varying[at] += n * chars
        sums = {r: sum(c for at, c in varying.items() if r[0] <= at < r[1]) for r in trees}
        whole = next((v for r, v in sums.items() if r[0] == 0), None)
        best = [r for r, v in sums.items() if whole and 2 * v > whole]
        chosen = max(best, key=lambda r: (r[2], r[0])) if best else None
        out[key] = ({(at, h) for at, h, _, _ in constant}, None if chosen is None or chosen[3] else chosen[:2])
    return out


@pytest.mark.parametrize("seed, share, least", [(1, 0.8, 2), (2, 0.5, 3), (3, 1.0, 1)])
def test_induced_by_definition(spark, seed, share, least):
    r = random.Random(seed)
    regions = {(h, g): [(0, 12, 0, True), (1, 6, 1, False), (2, 5, 2, False), (6, 12, 1, False), (7, 9, 2, False)] for h in ("a", "b", "c") for g in ("x", "y")}
    parsed = []
    for key in regions:
        heavy = r.choice([3, 8, 10])
        for page in range(r.choice([1, 2, 5, 9])):
            blocks = []
            for at in range(12):
                for _ in range(r.randint(0, 2)):
                    listed = r.random() < 0.2
                    h = r.choice([at, at + 100, r.randint(1000, 10**6)])
                    blocks.append((at, h, listed, False, None if listed else "t" * (h % 7 + (60 if at == heavy else 1))))
            parsed += [(*key, page, blocks)] * r.choice([1, 1, 3])  # copies of a page count once
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(parsed)], PARSED).repartition(3)
    table = spark.createDataFrame([(*k, v) for k, v in regions.items()], REGIONED)
    got = {}
    for x in extraction.induced(df, table, share, least).collect():
        got[x["_host"], x["_group"]] = ({(b["at"], b["hash"]) for b in x["_constant"] or []}, tuple(x["_region"]) if x["_region"] else None)
    assert got == wrappers(parsed, regions, share, least)
    assert any(v[0] for v in got.values()) and any(v[1] for v in got.values())


def letters_of(text, codes):
    """Codes of letters in lower case, one blank for each run of anything else, one before and one behind."""
    out = [0]
    for c in text.lower():
        code = 1 + ord(c) % (codes - 1) if c.isalpha() else 0
        if code or out[-1]:
            out.append(code)
    return out if out[-1] == 0 else [*out, 0]


def vector_of(p, text):
    x = letters_of(text, p.codes)
    if not any(x):
        return None
    v = np.zeros(p.dims)
    for i in range(len(x) - p.n + 1):
        v += np.prod([p.rotated[k][x[i + k]].astype(int) for k in range(p.n)], axis=0)
    return v


def test_profiles_by_definition(spark):
    r = random.Random(6)
    sounds = {"aa": ["la", "mi", "to"], "bb": ["sch", "ung", "ße"], "cc": ["дом", "не", "ка"]}
    say = lambda lang: " ".join("".join(r.choice(sounds[lang]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(3, 30)))
    learn = [(say(x), x) for x in sounds for _ in range(8)] + [(None, "aa"), ("123", "bb"), ("words", None)]
    texts = [say(r.choice(list(sounds))) for _ in range(25)] + [say("aa") + " " + say("bb"), "x", "", None, "12 !", "lami " * 4000]
    p = language.profiler(256, 3, 7)
    prototypes = {}
    for x in sounds:
        units = [v / np.linalg.norm(v) for t, lang in learn if lang == x and t and (v := vector_of(p, t)) is not None]
        prototypes[x] = np.sum(units, axis=0)
    found = language.train_profiles(spark.createDataFrame(learn, "text string, lang string").repartition(4), dims=256)
    assert sorted(found) == sorted(prototypes) and all(np.abs(found[x] - prototypes[x]).max() < 1e-4 for x in found)
    docs = spark.createDataFrame([(None if i == 3 else i, t, "mine", 9.0) for i, t in enumerate(texts)], "doc_id long, text string, lang_pred string, score double")
    out = language.identify(docs, found, dims=256).collect()
    assert len(out) == len(texts)
    by_text = {row["text"]: row for row in out}
    for t in texts:
        v = vector_of(p, t) if t else None
        if v is None:
            assert (by_text[t]["lang_pred"], by_text[t]["score"]) == ("und", 0.0)
            continue
        near = {x: float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)) for x, w in prototypes.items()}
        best = max(near, key=near.get)
        assert by_text[t]["lang_pred"] == best and abs(by_text[t]["score"] - max(0.0, near[best])) < 1e-4
