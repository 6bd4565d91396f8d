"""Token ids of op3 and op7 against the tokenizer itself, over many scripts, marks and added tokens in any case."""

import json
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from quorumlens.llm import tokens

SCRIPTS = [range(0x41, 0x5B), range(0x61, 0x7B), range(0xC0, 0x250), range(0x370, 0x400), range(0x400, 0x530), range(0x5D0, 0x5EB), range(0x620, 0x64B), range(0x900, 0x980), range(0x1100, 0x1200), range(0x1E00, 0x2000), range(0x3040, 0x3100), range(0x4E00, 0x4E80), range(0xAC00, 0xAC80), range(0xFB00, 0xFB50), range(0x10400, 0x10450)]
MARKS = [*range(0x300, 0x345), *range(0x5B0, 0x5BD), 0x307, 0x307, 0x200D, 0x338, 0x93C]
HARD = ["YENİ, bir", "x <|ENDOFTEXT|> y", "İ́, x", "Ị̇́.", "יִ, x", "a<|endoftext|>,", "A<|StartOfText|>.", "ΣΑΣ, ΣΑΣ", "ǅ!", "é, É.", "가, 각.", "K;", "5, ٣.", " ̸= x", "≠ y", "", None]


def some_texts(n):
    r = random.Random(5)

    def word():
        if r.random() < 0.08:
            return "".join(c.upper() if r.random() < 0.3 else c for c in r.choice(["<|endoftext|>", "<|startoftext|>", "<|endoftext"]))
        script, out = r.choice(SCRIPTS), ""
        for _ in range(r.randint(1, 7)):
            out += chr(r.choice(script)) + (chr(r.choice(MARKS)) if r.random() < 0.12 else "") + (r.choice("İIiſK'0٣½") if r.random() < 0.05 else "")
        return out + "".join(r.choice(".,;:!?)]}\"-_=+~^/'#*<|>s") for _ in range(r.randint(0, 3)))

    return [r.choice([" ", "", "\n", " \t"]).join(word() for _ in range(r.randint(1, 5))) for _ in range(n)]


def test_ids_are_the_tokenizers():
    path = tokens.vocabulary()
    whole = Tokenizer.from_file(path)
    texts = [*HARD, *some_texts(100_000)]
    ids, sizes = tokens.Encoder(path).encode(texts)
    want = [e.ids for e in whole.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert sizes.tolist() == [len(w) + 1 for w in want]
    assert ids.tolist() == [i for w in want for i in [*w, tokens.END_ID]]


def test_other_vocabularies_are_refused(tmp_path):
    with pytest.raises(ValueError, match="part texts at spaces"):
        tokens.Encoder(tokens.vocabulary("byte_bpe_50k.json"))
    spec = json.load(open(tokens.vocabulary()))
    assert tokens.parts_at_spaces(spec)
    spec["added_tokens"][0]["lstrip"] = True
    assert not tokens.parts_at_spaces(spec)


def test_forgetting_changes_nothing():
    path = tokens.vocabulary()
    small, large = tokens.Encoder(path, keep=10, keep_bytes=100), tokens.Encoder(path)
    texts = some_texts(300)
    for s in range(0, 300, 50):
        assert np.array_equal(small.encode(texts[s : s + 50])[0], large.encode(texts[s : s + 50])[0])
