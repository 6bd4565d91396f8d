"""What a worker holds while it encodes and packs is bounded by the slice, whatever the vocabulary and the batch."""

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quorumlens.llm import packing, tokens


def test_known_chunks_are_bounded():
    """Chunks that come once are forgotten early, words are kept longer; ids stay the tokenizer's."""
    encoder, whole = tokens.Encoder(tokens.vocabulary()), Tokenizer.from_file(tokens.vocabulary())
    for b in range(6):
        texts = [" ".join(f"{'abcdefghij'[i % 10]}{chr(97 + i // 10 % 26)}{chr(97 + i // 260 % 26)}{'.' * (b + 1)}{i // 6760}" for i in range(s, s + 100)) for s in range(0, 60_000, 100)]
        ids, sizes = encoder.encode(texts)
        assert len(encoder.chunks.strings) < 200_000
    want = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert sizes.tolist() == [len(w) + 1 for w in want] and ids.tolist() == [i for w in want for i in [*w, tokens.END_ID]]


@pytest.mark.parametrize("step", [0, -1])
def test_batches_of_packing_are_slices(spark, monkeypatch, step):
    """Neither the token table nor the cut makes one batch of all rows that Spark hands it."""
    docs = spark.createDataFrame([(i, "some words here " * 12_500, "s") for i in range(30)], "doc_id long, text string, source string").coalesce(1)
    steps, plain = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, *a, **b: steps.append((self, f)) or plain(self, f, *a, **b))
    pieces = packing.pack(docs, tokens.vocabulary(), window=64)
    rows, run = steps[step]
    monkeypatch.undo()

    def measure(parts):
        for batch in run(parts):
            yield pa.RecordBatch.from_pydict({"size": pa.array([batch.nbytes], pa.int64())})

    sizes = [r["size"] for r in rows.mapInArrow(measure, "size long").collect()]
    assert len(sizes) > 1 and max(sizes) < 4 * tokens.SLICE
    got = sorted((r["doc_id"], r["start"], r["length"]) for r in pieces.collect())
    for d in range(30):
        mine = [(s, n) for i, s, n in got if i == d]
        assert [s for s, _ in mine] == np.cumsum([0, *(n for _, n in mine)])[:-1].tolist()
