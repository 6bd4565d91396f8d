"""Language identification by hyperdimensional letter n-gram profiles."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"


class Profiler:
    """Bundles of n-gram vectors.

    Each letter has a random vector of +1 and -1, drawn by its code point. An n-gram binds (multiplies) its
    letters' vectors, each permuted (rotated) by its place; a text bundles (adds) its n-grams. Letters are
    lower-cased; everything else parts words and counts as one blank. There are `codes` - 1 vectors, which letters
    from that code point on share by their remainder: scripts beyond 4095 (as Han) are told from others, but some of
    their letters look alike.
    """

    def __init__(self, dims: int = 1024, n: int = 3, seed: int = 7, codes: int = 4096):
        self.dims, self.n, self.codes = dims, n, codes
        letters = np.random.default_rng(seed).integers(0, 2, (codes, dims), np.int8) * 2 - 1
        self.rotated = [np.roll(letters, n - 1 - k, axis=1).astype(np.int8) for k in range(n)]

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The text's distinct n-grams, as a number that holds its letters' codes, and their counts."""
        code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        known = np.unique(code)
        letter = np.fromiter((chr(c).isalpha() for c in known), bool, len(known))
        if not letter.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        small = np.where(letter, 1 + known % (self.codes - 1), 0).astype(np.int64)
        x = small[np.searchsorted(known, code)]
        x = x[(x != 0) | (np.append(x[1:], 0) != 0)]  # runs of blanks become one
        x = np.concatenate([[0], x[np.argmax(x != 0) :], [0]])
        packed = np.zeros(len(x) - self.n + 1, np.int64) if len(x) >= self.n else np.zeros(0, np.int64)
        for k in range(self.n):
            packed = packed * self.codes + x[k : len(x) - self.n + 1 + k] if len(packed) else packed
        return np.unique(packed, return_counts=True)

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = np.zeros(self.dims, np.float32)
        for s in range(0, len(grams), 4096):  # bounds the memory of very long texts
            g = grams[s : s + 4096]
            bound = self.rotated[self.n - 1][g % self.codes]
            for k in range(self.n - 2, -1, -1):
                g = g // self.codes
                bound = bound * self.rotated[k][g % self.codes]
            out += counts[s : s + 4096].astype(np.float32) @ bound.astype(np.float32)
        return out


_PROFILERS: dict[tuple, Profiler] = {}


def profiler(dims: int, n: int, seed: int) -> Profiler:
    if (dims, n, seed) not in _PROFILERS:
        _PROFILERS[dims, n, seed] = Profiler(dims, n, seed)
    return _PROFILERS[dims, n, seed]


def train_profiles(labelled: DataFrame, text: str = "text", label: str = "lang", most_rows: int = 20_000, dims: int = 1024, n: int = 3, seed: int = 7) -> dict[str, np.ndarray]:
    """One prototype for each label of labelled rows: the bundle of its texts' unit vectors.

    At most about most_rows rows are used, drawn by the hash of their text. Rows without label or text are not
    used. Only labels times dims sums a partition leave the executors, and only their totals reach the driver.
    """
    rows = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).cast("string").alias("label"), F.col(text).alias("t"))
    total = rows.count()
    if total > most_rows:
        rows = rows.where(F.pmod(F.xxhash64("t"), F.lit(1 << 20)) < F.lit(int((1 << 20) * most_rows / total)))

    def bundle(parts: Iterator) -> Iterator:
        import pyarrow as pa

        p, sums = profiler(dims, n, seed), {}
        for part in parts:
            for name, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                v = p.bundle(*p.grams(t))
                if norm := np.linalg.norm(v):
                    sums[name] = sums.get(name, 0) + v / norm
        for name, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * dims), pa.array(range(dims), pa.int32()), pa.array(v.astype(np.float64))], names=["label", "dim", "value"])

    sums = rows.mapInArrow(bundle, "label string, dim int, value double").groupBy("label", "dim").agg(F.sum("value").alias("value"))
    out: dict[str, np.ndarray] = {}
    for r in sums.collect():  # labels x dims
        out.setdefault(r["label"], np.zeros(dims))[r["dim"]] = r["value"]
    return dict(sorted(out.items()))


def identify(docs: DataFrame, profiles: Mapping[str, np.ndarray], text: str = "text", dims: int = 1024, n: int = 3, seed: int = 7) -> DataFrame:
    """Add lang_pred and score to docs: the nearest prototype by cosine, and that cosine (negative ones as 0).

    Ties go to the label that sorts first. A null text, one without letters, and any text where there are no
    profiles get `und` and 0. Only the text is looked at; columns named lang_pred or score are overwritten.
    """
    names = sorted(profiles)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    table = np.array([profiles[x] / (np.linalg.norm(profiles[x]) or 1) for x in names], np.float32).reshape(len(names), dims)
    at = kept.index(text)

    def compare(parts: Iterator) -> Iterator:
        import pyarrow as pa

        p = profiler(dims, n, seed)
        for part in parts:
            found, scores = [], []
            for t in part.column(at).to_pylist():
                v = p.bundle(*p.grams(t)) if t and names else None
                if v is None or not (norm := float(np.linalg.norm(v))):
                    found.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                near = table @ v / norm
                best = int(near.argmax())
                found.append(names[best])
                scores.append(min(1.0, max(0.0, float(near[best]))))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=[*kept, "lang_pred", "score"])

    from pyspark.sql import types as T

    src = docs.select(*kept)
    return src.mapInArrow(compare, T.StructType([*src.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def op8_language_profiles(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 4 == 2
    profiles = train_profiles(docs.where(~held))
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), profiles).drop("text")
