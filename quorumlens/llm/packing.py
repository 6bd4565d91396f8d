"""Mixture-controlled packing: windows of tokens filled from source queues in target proportions.

Deficit round-robin gives queue k a quantum of window * share_k tokens a window and carries what it could not
give (a fraction of a token, as documents may be cut) to the next window. After w windows a queue has thus given
its share of w * window tokens, rounded so that all queues together fill each window exactly. That count is known
for every w from the queues' totals alone, so each document finds its windows by itself: deficits carry across
windows and partitions without any task reading more than its own rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator, Mapping, Sequence
from fractions import Fraction

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, prefix_totals, text_or_empty
from .tokens import SLICE, encoder, id_width, slices, vocabulary

#: The queue of all sources that are too small to have a token in every window.
POOL = "\x00pool"
NO_SOURCE = "\x00null"


def phases(totals: Sequence[int], targets: Sequence[float] | None) -> list[list[int]]:
    """What each queue gives in each phase. A phase ends as a queue with a target runs out; the rest share on.

    Without targets all queues run out together, in one phase. Queues without a target come last.
    """
    if targets is None:
        return [list(totals)] if sum(totals) else []
    left, out = list(totals), []
    share = [Fraction(t).limit_denominator(10**9) for t in targets]
    while any(n and s for n, s in zip(left, share)):
        live = [k for k, n in enumerate(left) if n and share[k] > 0]
        rounds = min(Fraction(left[k]) / share[k] for k in live)
        gives = [min(left[k], int(share[k] * rounds)) if k in live else 0 for k in range(len(left))]
        if not sum(gives):
            gives[min(live, key=lambda k: Fraction(left[k]) / share[k])] = 1
        out.append(gives)
        left = [a - b for a, b in zip(left, gives)]
    return out + ([left] if sum(left) else [])


class Schedule:
    """Which window and offset a queue's token goes to."""

    def __init__(self, gives: Sequence[Sequence[int]], window: int):
        self.window, self.total = window, sum(map(sum, gives))
        self.ends, self.sums, self.given = [0], [], []
        so_far = [0] * (len(gives[0]) if gives else 0)
        for g in gives:
            cum = [0]
            for x in g:
                cum.append(cum[-1] + x)
            self.given.append(list(so_far))
            self.sums.append(cum)
            self.ends.append(self.ends[-1] + cum[-1])
            so_far = [a + b for a, b in zip(so_far, g)]
        self.given_cum = []
        for g in self.given:
            cum = [0]
            for x in g:
                cum.append(cum[-1] + x)
            self.given_cum.append(cum)

    def through(self, queues: int, w: int) -> int:
        """Tokens that the first `queues` queues have given after w windows."""
        g = min(w * self.window, self.total)
        i = min(bisect_right(self.ends, g) - 1, len(self.sums) - 1)
        return self.given_cum[i][queues] + (g - self.ends[i]) * self.sums[i][queues] // self.sums[i][-1]

    def given_by(self, k: int, w: int) -> int:
        return self.through(k + 1, w) - self.through(k, w)

    def pieces(self, k: int, begin: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(start in the run, length, window, offset) for tokens begin to begin + n of queue k."""
        low, high = 0, -(-self.total // self.window)
        while high - low > 1:  # the last window whose tokens of k begin at or before `begin`
            mid = (low + high) // 2
            low, high = (mid, high) if self.given_by(k, mid) <= begin else (low, mid)
        w, at = low, begin
        first = self.given_by(k, w)
        while at < begin + n:
            after = self.given_by(k, w + 1)
            if (stop := min(after, begin + n)) > at:
                yield at - begin, stop - at, w, self.through(k, w + 1) - self.through(k, w) + at - first
                at = stop
            w, first = w + 1, after


def token_table(docs: DataFrame, path: str, text: str = "text", source: str = "source") -> DataFrame:
    """docs' ids as a table in the shared folder: doc_id, source, block, local_start, doc_tokens, ids.

    Ids have as many bytes as the vocabulary needs. A block is one input partition; local_start counts the ids of
    the same source before the document in it.
    """
    rows = docs.select("doc_id", F.coalesce(F.col(source).cast("string"), F.lit(NO_SOURCE)).alias("source"), text_or_empty(text).alias("t"))
    width = id_width(path)

    def encode(parts: Iterator) -> Iterator:
        import pyarrow as pa

        block, given = TaskContext.get().partitionId(), {}
        for part in parts:
            texts, sources = part.column(2), part.column(1).to_pylist()
            for s in slices(texts, SLICE):
                ids, sizes = encoder(path).encode(texts[s])
                raw = ids.astype(f"<u{width}").tobytes()
                ends = (np.cumsum(sizes) * width).tolist()
                starts = []
                for name, n in zip(sources[s], sizes.tolist()):
                    starts.append(given.get(name, 0))
                    given[name] = starts[-1] + n
                frames = [raw[e - width * n : e] for e, n in zip(ends, sizes.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0)[s], part.column(1)[s], pa.array([block] * len(frames), pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(frames, pa.binary())],
                    names=["doc_id", "source", "block", "local_start", "doc_tokens", "ids"],
                )

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, source string, block long, local_start long, doc_tokens long, ids binary"
    return materialize(rows.mapInArrow(encode, schema), "tokens")


def tempered(power: float) -> Callable[[Mapping[str, int]], dict[str, float]]:
    """Targets in proportion to a power of each source's tokens: under 1, small sources get more than their share."""
    return lambda totals: {s: float(n) ** power for s, n in totals.items() if n}


def pack(docs: DataFrame, path: str, window: int = 4096, targets: Mapping[str, float] | Callable[[Mapping[str, int]], Mapping[str, float]] | None = None, text: str = "text", source: str = "source") -> DataFrame:
    """Cut docs into pieces that fill windows of `window` tokens; only the last window is short.

    Returns a row a piece: doc_id, source, start (the document's ids before the piece), length, ids (binary,
    unsigned 32-bit little-endian), doc_tokens, sequence_id (the window) and offset (place in it, gapless).

    targets maps sources to weights, or is a function that makes such a map from the sources' token totals (the
    shared queue being the source POOL). Windows hold these proportions until a source runs out, then those left
    share the windows; sources without a target come last. Without targets the proportions are those of the corpus,
    so all windows hold them. Sources with under two tokens a window share one queue, unless targets is a map that
    names them; that keeps the queues at window / 2. A null source is a source of its own; a null or empty text is
    one end id; repeated rows are packed each; an empty table gives no rows.
    """
    tokens, width = token_table(docs, path, text, source), id_width(path)
    sums = materialize(tokens.groupBy("source", "block").agg(F.sum("doc_tokens").alias("n")), "source_blocks")
    total = sums.agg(F.sum("n")).first()[0] or 0
    by_source = sums.groupBy("source").agg(F.sum("n").alias("n"))
    if targets is None or callable(targets):  # at most window / 2 rows
        large = sorted((r["source"], r["n"]) for r in by_source.where(F.col("n") * window >= 2 * total).collect())
    else:  # as many as the caller names
        large = sorted((r["source"], r["n"]) for r in by_source.where(F.col("source").isin(*targets)).collect())
    names = [s for s, _ in large]
    totals = dict(large) | {POOL: total - sum(n for _, n in large)}
    wanted = targets(totals) if callable(targets) else targets
    weights = None if wanted is None else [wanted.get(s, 0.0) / sum(wanted.values()) for s in totals] if wanted else [0.0] * len(totals)
    schedule = Schedule(phases(list(totals.values()), weights), window)
    place = {s: k for k, s in enumerate(names)}

    # a queue's tokens are in order of block, then source: a window over blocks and one inside each block
    queue = F.when(F.col("source").isin(*names), F.col("source")).otherwise(F.lit(POOL)) if names else F.lit(POOL)
    queued = sums.withColumn("queue", queue)
    before = prefix_totals(queued.groupBy("queue", "block").agg(F.sum("n").alias("n")), "block", ["n"], ["queue"])
    inside = Window.partitionBy("queue", "block").orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
    starts = queued.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(before, ["queue", "block"])
    starts = starts.select("source", "block", "queue", (F.col("before_n") + F.col("inside")).alias("before"))
    placed = tokens.join(materialize(starts, "queue_starts"), ["source", "block"])
    k_pool = len(names)

    def cut(parts: Iterator) -> Iterator:
        import pyarrow as pa

        for part, s in ((p, s) for p in parts for s in slices(p.column(4), SLICE)):
            part = part.slice(s.start, s.stop - s.start)
            rows = zip(*[part.column(i).to_pylist() for i in (1, 2, 3, 4)])
            take, out = [], []
            for i, (queue, begin, n, raw) in enumerate(rows):
                ids = np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes()
                for start, length, window_no, offset in schedule.pieces(place.get(queue, k_pool), begin, n):
                    take.append(i)
                    out.append((start, length, ids[4 * start : 4 * (start + length)], n, window_no, offset))
            cols = list(zip(*out)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            index = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(index), part.column(5).take(index), *[pa.array(c, t) for c, t in zip(cols, kinds)]],
                names=["doc_id", "source", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    narrow = placed.select("doc_id", "queue", (F.col("before") + F.col("local_start")).alias("begin"), "doc_tokens", "ids", "source")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(cut, f"doc_id {kind}, source string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def packed_digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", F.when(F.col("source") != NO_SOURCE, F.col("source")).alias("source"))


def op3_mixture_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return packed_digests(pack(docs, vocabulary(), targets=tempered(0.7)))
