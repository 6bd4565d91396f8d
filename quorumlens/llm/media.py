"""Media columns: bytes kept as progressive JPEG, read back as coefficients and full-resolution RGB tensors."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import jpeg
from .common import materialize

UNIT = 576
#: Rows in a batch that goes back to Spark, so that tensors of many rows are not held at once.
ROWS = 256
#: Bytes of a tensor in one row of a table of tensors, and in a batch that goes back to Spark, as near as whole pixel rows allow.
BAND = 16 << 20


def _extended(df: DataFrame, fields: list[T.StructField]) -> T.StructType:
    return T.StructType([*df.schema.fields, *fields])


def store_media(docs: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """Replace the text column by `n_bytes` (its UTF-8 size) and a JPEG that carries it.

    The payload is the text's UTF-8 with bytes 255 up to a positive multiple of 576; null counts as empty. Equal
    texts give equal JPEGs. Rows are taken one by one; n_bytes and out overwrite columns of these names.
    """
    kept = [c for c in docs.columns if c not in (text, out, "n_bytes")]
    rows = docs.select(*kept, F.col(text).alias("_text"))

    def encode(parts: Iterator) -> Iterator:
        import pyarrow as pa

        for part in parts:
            for s in range(0, part.num_rows, ROWS):
                piece = part.slice(s, ROWS)
                raw = [(t or "").encode() for t in piece.column(len(kept)).to_pylist()]
                media = [jpeg.encode_bytes(b.ljust(max(1, -(-len(b) // UNIT)) * UNIT, b"\xff")) for b in raw]
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array([len(b) for b in raw], pa.int64()), pa.array(media, pa.binary())], names=[*kept, "n_bytes", out])

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField(out, T.BinaryType())]
    return rows.mapInArrow(encode, _extended(rows.drop("_text"), fields))


def feature(rgb: np.ndarray) -> str:
    """Mean and deviation of each channel in thousandths, and a 64-bit average hash of the brightness."""
    flat = rgb.reshape(-1, 3).astype(np.int64)
    n = len(flat)
    mean = flat.sum(0) * 1000 // n
    spread = np.sqrt(np.maximum((flat * flat).sum(0) / n - (flat.sum(0) / n) ** 2, 0))
    light = rgb.sum(axis=2, dtype=np.int64)
    rows, cols = (np.linspace(0, k, 9).astype(int)[:-1] for k in light.shape)
    cells = np.add.reduceat(np.add.reduceat(light, rows, axis=0), cols, axis=1)
    bits = np.packbits((cells * cells.size > cells.sum()).ravel())
    return ",".join([*map(str, mean), *(str(int(x * 1000)) for x in spread), bits.tobytes().hex()])


def read_media(stored: DataFrame, media: str = "media", tensors: bool = True) -> DataFrame:
    """Decode a column of progressive JPEGs that store_media() wrote.

    A tensor is one value, so a picture has at most 2 GB of it; store_tensors() has no such limit.

    Adds payload_bytes, payload_sha256 and tail_crc32 (of its last 32 bytes) of the bytes read back, height, width
    and feature of the picture and, with tensors, rgb (height x width x 3 bytes). A null media gives nulls. A
    column with one of these names is overwritten; a file that is no such JPEG fails the job.
    """
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "height", "width", "feature", *["rgb"] * tensors]
    kinds = [T.LongType(), T.StringType(), T.LongType(), T.IntegerType(), T.IntegerType(), T.StringType(), *[T.BinaryType()] * tensors]
    src = stored.select(*[c for c in stored.columns if c not in names])
    at = src.columns.index(media)
    columns = src.columns

    def decode(parts: Iterator) -> Iterator:
        import pyarrow as pa

        arrow = (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), *[pa.binary()] * tensors)
        for part in parts:
            begin, out, held = 0, [], 0
            for i, data in enumerate(part.column(at)):
                if (data := data.as_py()) is None:
                    out.append((None,) * len(names))
                else:
                    image = jpeg.decode(data)
                    payload, rgb = jpeg.payload_of(image), image.rgb()
                    out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), image.height, image.width, feature(rgb), *[rgb.tobytes()] * tensors))
                    held += rgb.nbytes * tensors
                if len(out) >= ROWS or held >= BAND or i + 1 == part.num_rows:
                    yield pa.RecordBatch.from_arrays([*part.slice(begin, len(out)).columns, *[pa.array(c, t) for c, t in zip(zip(*out), arrow)]], names=[*columns, *names])
                    begin, out, held = i + 1, [], 0

    return src.mapInArrow(decode, _extended(src, [T.StructField(n, k) for n, k in zip(names, kinds)]))


def store_tensors(stored: DataFrame, media: str = "media", band_bytes: int = BAND) -> DataFrame:
    """Decode a column of progressive JPEGs and keep the pictures as a table in the shared folder, which is returned.

    A picture is one row or more: `band` counts from 0, and rgb holds a band of whole pixel rows of at most band_bytes
    (one pixel row at least). Bands in order are the tensor (height x width x 3 bytes), rgb_sha256 is its hash. Each
    band has the columns of read_media() and stored's own, but for media. A null media gives one row of nulls.
    """
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "height", "width", "feature", "rgb_sha256", "band", "rgb"]
    kinds = [T.LongType(), T.StringType(), T.LongType(), T.IntegerType(), T.IntegerType(), T.StringType(), T.StringType(), T.IntegerType(), T.BinaryType()]
    kept = [c for c in stored.columns if c not in (*names, media)]
    src = stored.select(*kept, media)

    def decode(parts: Iterator) -> Iterator:
        import pyarrow as pa

        arrow = (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.binary())
        for part in parts:
            own = part.select(kept)
            rows, out, held = [], [], 0

            def batch():
                taken = own.take(pa.array(rows, pa.int64()))
                return pa.RecordBatch.from_arrays([*taken.columns, *[pa.array(c, t) for c, t in zip(zip(*out), arrow)]], names=[*kept, *names])

            for i, data in enumerate(part.column(len(kept))):
                data = data.as_py()
                if data is None:
                    rows.append(i)
                    out.append((None,) * len(names))
                else:
                    image = jpeg.decode(data)
                    payload, rgb = jpeg.payload_of(image), np.ascontiguousarray(image.rgb())
                    digests = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), image.height, image.width, feature(rgb), hashlib.sha256(rgb).hexdigest())
                    lines = max(1, band_bytes // (3 * image.width))
                    for band, y in enumerate(range(0, image.height, lines)):
                        piece = rgb[y : y + lines].tobytes()
                        rows.append(i)
                        out.append((*digests, band, piece))
                        held += len(piece)
                        if held >= band_bytes:
                            yield batch()
                            rows, out, held = [], [], 0
                if len(rows) >= ROWS:
                    yield batch()
                    rows, out, held = [], [], 0
            if rows:
                yield batch()

    return materialize(src.mapInArrow(decode, _extended(stored.select(*kept), [T.StructField(n, k) for n, k in zip(names, kinds)])), "tensors")


def op4_progressive_jpeg(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    stored = materialize(store_media(docs), "media")
    hashed = stored.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    return store_tensors(hashed).where("band = 0").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "height", "width", "rgb_sha256")
