"""Token ids in zstandard frames, one a document, that share a trained dictionary.

A store is a folder with two Parquet tables. `dictionary` has one row: its SHA-256 and its bytes. `blocks` has a
row for each run of documents in ascending doc_id order: block number, first and last doc_id, the documents' ids,
token counts and the end of each frame in the payload, the dictionary's hash, the width of an id, and the payload.
A reader of one document finds its block by the first and last ids, which Parquet keeps as statistics, and
decompresses that one frame.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, prefix_totals, shared_dir, text_or_empty
from .tokens import SLICE, encoder, id_width, slices, vocabulary

BLOCKS = "block long, first_id long, last_id long, doc_ids array<long>, n_tokens array<int>, ends array<int>, dict_sha256 string, width int, payload binary"
DOCS = "doc_id long, block long, place int, local_start long, ids binary"


def _frames(dictionary: bytes):
    import zstandard

    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=3, dict_data=shared, write_content_size=True, write_checksum=False, write_dict_id=False), zstandard.ZstdDecompressor(dict_data=shared)


def id_arrays(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """A table in the shared folder of doc_id, n (its number of ids) and ids, in as many bytes an id as needed."""
    rows, width = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text).alias("t")), id_width(path)

    def encode(parts: Iterator) -> Iterator:
        import pyarrow as pa

        for part in parts:
            texts = part.column(1)
            for s in slices(texts, SLICE):
                ids, sizes = encoder(path).encode(texts[s])
                raw, ends = ids.astype(f"<u{width}").tobytes(), np.cumsum(sizes) * width
                frames = [raw[e - width * n : e] for e, n in zip(ends.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays([part.column(0)[s], pa.array(sizes, pa.int64()), pa.array(frames, pa.binary())], names=["doc_id", "n", "ids"])

    return materialize(rows.mapInArrow(encode, "doc_id long, n long, ids binary"), "id_arrays")


def train_dictionary(arrays: DataFrame, samples: int = 2000, most_ids: int = 1024, size: int = 65536) -> bytes:
    """A dictionary trained on at most `samples` serialized id arrays (n, ids) of at most most_ids ids.

    Arrays are chosen by their hash, so equal tables give equal dictionaries. Where they are too few to train on,
    the dictionary is these arrays as they are; without any it is empty and frames stand alone.
    """
    import zstandard

    short = arrays.where(F.col("n").between(2, most_ids)).select(F.xxhash64("ids").alias("h"), "ids")
    n = short.count()
    few = short.where(F.pmod(F.shiftrightunsigned("h", 8), F.lit(1 << 20)) < F.lit(min(1 << 20, int((1 << 20) * 2 * samples / n) + 1))) if n else short
    parts = [bytes(r["ids"]) for r in few.dropDuplicates(["h"]).orderBy("h").limit(samples).collect()]
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(parts)[:size]


def write_ids(docs: DataFrame, folder: str, path: str, text: str = "text", block_bytes: int = 1 << 20) -> None:
    """Encode docs (doc_id and text) and write them to folder, in ascending doc_id order.

    Texts are encoded where they lie; only their ids are range-partitioned and sorted. Null texts have the end id
    alone. Rows with the same doc_id are kept apart, in the order of their ids' hashes; a null doc_id comes first.
    An empty table gives an empty store. Other columns are not read.
    """
    spark, width = docs.sparkSession, id_width(path)
    arrays = id_arrays(docs, path, text)
    dictionary = train_dictionary(arrays)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, bytearray(dictionary))], "sha256 string, bytes binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    shared = spark.sparkContext.broadcast(dictionary)  # at most `size` bytes

    def compress(parts: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("block", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("dict_sha256", pa.string()), ("width", pa.int32()), ("payload", pa.binary())])
        pack, _ = _frames(shared.value)
        block = TaskContext.get().partitionId() << 32
        names: list = []
        counts: list[int] = []
        ends: list[int] = []
        payload = bytearray()

        def flush():
            nonlocal block, names, counts, ends, payload
            row = {"block": block, "first_id": names[0], "last_id": names[-1], "doc_ids": names, "n_tokens": counts, "ends": ends, "dict_sha256": digest, "width": width, "payload": bytes(payload)}
            block, names, counts, ends, payload = block + 1, [], [], [], bytearray()
            return pa.RecordBatch.from_pylist([row], schema)

        for part in parts:
            for name, n, raw in zip(*(c.to_pylist() for c in part.columns)):
                payload += pack.compress(raw)
                names.append(name)
                counts.append(n)
                ends.append(len(payload))
                if len(payload) >= block_bytes:
                    yield flush()
        if names:
            yield flush()

    order = ["doc_id", "h"]
    dealt = arrays.withColumn("h", F.xxhash64("ids")).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    dealt.select("doc_id", "n", "ids").mapInArrow(compress, BLOCKS).write.option("compression", "none").parquet(f"{folder}/blocks")


def _dictionary(spark: SparkSession, folder: str) -> bytes:
    row = spark.read.parquet(f"{folder}/dictionary").first()
    if hashlib.sha256(row["bytes"]).hexdigest() != row["sha256"]:
        raise ValueError("the dictionary does not have the hash that the store names")
    return bytes(row["bytes"])


def read_ids(spark: SparkSession, folder: str, doc_id: int | None = None) -> DataFrame:
    """All documents of a store, or those with one doc_id: doc_id, block, place, local_start, ids (unsigned 32-bit, little-endian).

    local_start counts the ids before the document in its block. A block that names another dictionary fails.
    """
    dictionary = _dictionary(spark, folder)
    digest = hashlib.sha256(dictionary).hexdigest()
    shared = spark.sparkContext.broadcast(dictionary)
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    if doc_id is not None:
        blocks = blocks.where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))

    def decode(parts: Iterator) -> Iterator:
        import pyarrow as pa

        _, unpack = _frames(shared.value)
        schema = pa.schema([("doc_id", pa.int64()), ("block", pa.int64()), ("place", pa.int32()), ("local_start", pa.int64()), ("ids", pa.binary())])
        for part in parts:
            for row in part.to_pylist():
                if row["dict_sha256"] != digest:
                    raise ValueError(f"block {row['block']} was written with another dictionary")
                out, begin, start = [], 0, 0
                for place, (name, n, end) in enumerate(zip(row["doc_ids"], row["n_tokens"], row["ends"])):
                    if doc_id is None or name == doc_id:
                        ids = np.frombuffer(unpack.decompress(row["payload"][begin:end]), f"<u{row['width']}")
                        if len(ids) != n:
                            raise ValueError(f"document {name} has {len(ids)} ids, not {n}")
                        out.append({"doc_id": name, "block": row["block"], "place": place, "local_start": start, "ids": ids.astype("<u4").tobytes()})
                    begin, start = end, start + n
                yield pa.RecordBatch.from_pylist(out, schema)

    return blocks.mapInArrow(decode, DOCS)


def block_starts(spark: SparkSession, folder: str) -> DataFrame:
    """(block, before): the ids before each block, by totals of the parts that blocks were written in, then inside each part."""
    totals = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks").select("block", F.shiftright("block", 32).alias("part"), F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    parts = prefix_totals(totals.groupBy("part").agg(F.sum("n").alias("n")), "part", ["n"])
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = totals.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(parts, "part")
    return materialize(placed.select("block", (F.col("before_n") + F.col("inside")).alias("before")), "block_starts")


def op7_id_store(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark).rstrip('/')}/idstores/{uuid.uuid4().hex}"
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), folder, vocabulary())
    docs = read_ids(spark, folder).select("doc_id", "block", "local_start", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    return docs.join(block_starts(spark, folder), "block").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
