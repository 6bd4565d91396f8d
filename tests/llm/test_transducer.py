"""op12 against the tokenizers library, and its two machines against their definitions."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from quorumlens.llm import tokens, transducer

PATH = tokens.vocabulary("byte_bpe_50k.json")
HARD = ["", "a", " it's we're they'll 'tis '' ''s '''re  x'", "a<|endoftext|>b<|endoftext|>", "<|endoftext|>", "  <|endoftext|>  x", "<|endoftext", "<|ENDOFTEXT|>", "\n\n x\t\ty 　z  ", "don't'S I'M 'll'll", " 's", "'", " '", "'s", "'r", "a'", "'r<|endoftext|>e", "x 12³½٣", "a" * 5000, " " * 5000, "ab" * 3000, "é" * 3000, "\x00\x01", "😀" * 70]


@pytest.fixture(scope="module")
def counter():
    return transducer.Counter(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def some_texts(n):
    r = random.Random(3)
    near = " \n\t' 　sretvlmdaABC012!.,;é中文字ßıİ😀́٣½"
    wide = lambda: chr(r.choice([r.randrange(0x20, 0x250), r.randrange(0x20, 0x80), r.randrange(0x300, 0x3000), r.randrange(0xE000, 0x1F700), r.randrange(0x40000, 0x110000)]))
    return [r.choice(["", "<|endoftext|>"]).join(["".join(r.choice(near) if r.random() < 0.7 else wide() for _ in range(r.randint(0, 150))) for _ in range(2)]) for _ in range(n)]


def test_counts_are_the_librarys(counter, library):
    texts = HARD + some_texts(8000)
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert counter.count(pa.array(texts)).tolist() == want
    assert [counter.count(pa.array([t]))[0] for t in HARD] == want[: len(HARD)]
    assert counter.count(pa.array([], pa.string())).tolist() == []


def test_classes_of_all_code_points():
    """Each code point goes on a word of its class in the library's splitter; planes 4 to 16 hold marks alone."""
    split, classes = ByteLevel(add_prefix_space=False, use_regex=True), transducer.unpacked(transducer.class_table())
    assert len(classes) == 0x110000
    for p in [*range(0x40000, 0x110000, 37), *range(0xE0000, 0xE0200), *range(0x20, 0x3000)]:
        one = lambda probe: len(split.pre_tokenize_str(probe + chr(p))) == 1  # noqa: E731, B023
        want = transducer.LETTER if one("a") else transducer.NUMBER if one("1") else transducer.MARK if one("!") else transducer.SPACES
        assert classes[p] == want, hex(p)


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 64, 1000])
def test_borders_do_not_depend_on_chunks(chunk):
    """The prefix scan over state maps gives the states that reading each text from its start gives."""
    r = np.random.default_rng(chunk)
    sizes = r.integers(1, 400, 30)
    symbol = r.integers(0, 8, sizes.sum()).astype(np.uint8)
    starts = np.cumsum(sizes) - sizes
    want = []
    for s, n in zip(starts, sizes):
        state = transducer.FRESH
        for x in symbol[s : s + n]:
            want.append(bool(transducer.BEGINS[x, state]))
            state = transducer.STEP[x, state]
    assert transducer.word_starts(symbol, starts, chunk).tolist() == want


def test_merger_follows_the_merges(counter):
    r = random.Random(9)
    pieces = [b"the", b"ing", b" ", b"  ", b"tion", b"a", b"aa", b"\xc3", b"\xa9", b"xyz", b"0", b"00"]
    for _ in range(3000):
        word = b"".join(r.choice(pieces) for _ in range(r.randint(1, 12)))
        assert counter.merger.count(word) == len(counter.merger.merged(word)), word


def test_bounded_tables_change_nothing(library):
    small = transducer.Counter(PATH, keep_words=5, keep_bytes=50)
    small.merger.keep = 20
    texts = some_texts(200)
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [int(n) for t in texts for n in small.count(pa.array([t]))] == want


def test_other_vocabularies_are_refused(tmp_path):
    with pytest.raises(ValueError, match="byte-level"):
        transducer.Counter(tokens.vocabulary())
    spec = json.load(open(PATH))
    spec["added_tokens"][0]["lstrip"] = True
    (tmp_path / "v.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="neighbours"):
        transducer.Counter(str(tmp_path / "v.json"))


def test_documents(spark, library):
    texts = [None, *HARD, "x y " * 300, HARD[2], HARD[2]]
    rows = [(None if i == 3 else i % 20, t, "mine", -5, i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, over_limit string, n_bytes int, place int").repartition(3)
    out = {r["place"]: r for r in transducer.token_counts(docs, PATH).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (out[i]["doc_id"], out[i]["n_bytes"], out[i]["n_tokens"], out[i]["over_limit"]) == (rows[i][0], len((t or "").encode()), n, n > 512)
    assert transducer.token_counts(docs.limit(0), PATH).count() == 0
