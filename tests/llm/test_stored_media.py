"""op4 writes its JPEGs and its tensors, and reads them back."""

import glob
import hashlib

import pyarrow.parquet as pq

from quorumlens.llm import common, media


def test_jpegs_and_tensors_are_tables(spark, tmp_path):
    texts = [None, "", "a" * 575, "some words " * 4000]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    d.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    tables = lambda: set(glob.glob(f"{common.shared_dir(spark).removeprefix('file:')}/tables/*/*"))
    before = tables()
    out = {r["doc_id"]: r for r in media.op4_progressive_jpeg(spark, str(tmp_path)).collect()}
    new = {path.rsplit("/", 1)[1]: path for path in tables() - before}
    assert set(new) == {"media", "tensors"}
    kept = {r["doc_id"]: r["media"] for r in pq.read_table(new["media"]).to_pylist()}
    shown = {r["doc_id"]: r["rgb"] for r in pq.read_table(new["tensors"]).to_pylist()}
    assert set(out) == set(kept) == set(shown) == {0, 1, 2, 3}
    for i, r in out.items():
        assert hashlib.sha256(kept[i]).hexdigest() == r["media_sha256"] and len(kept[i]) == r["media_bytes"]
        assert hashlib.sha256(shown[i]).hexdigest() == r["rgb_sha256"] and len(shown[i]) == r["height"] * r["width"] * 3


def test_tensors_in_bands(spark):
    d = spark.createDataFrame([(1, "some words " * 4000), (2, None)], "doc_id long, text string").coalesce(1)
    stored = media.store_media(d)
    whole = {r["doc_id"]: r for r in media.read_media(stored).collect()}
    missing = spark.createDataFrame([(3, 0, None)], stored.schema)
    bands = media.store_tensors(stored.unionByName(missing), band_bytes=10_000).orderBy("doc_id", "band").collect()
    for i in (1, 2):
        mine = [b for b in bands if b["doc_id"] == i]
        assert b"".join(b["rgb"] for b in mine) == whole[i]["rgb"] and [b["band"] for b in mine] == list(range(len(mine)))
        assert all((b["feature"], b["payload_sha256"], b["height"]) == (whole[i]["feature"], whole[i]["payload_sha256"], whole[i]["height"]) for b in mine)
        assert max(len(b["rgb"]) for b in mine) <= max(10_000, 3 * whole[i]["width"])
    assert sum(b["doc_id"] == 1 for b in bands) > 1
    assert [(b["band"], b["rgb"]) for b in bands if b["doc_id"] == 3] == [(None, None)]
