"""Near-duplicate components: fast similarity sketches, banding, and exact verification on full shingle sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, ordered_blocks, partitions, row_numbers, sifted, text_or_empty
from .graphs import components
from .tokens import slices

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Odd multipliers of a 64-bit finaliser.
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Each text's distinct shingles of k words as sorted 64-bit hashes; a text of fewer words has one shingle.

    A-Z are lower-cased; words are parted by ASCII white space.
    """
    if len(_WORDS) > 50_000:
        _WORDS.clear()
    out = []
    with np.errstate(over="ignore"):
        for t in texts:
            words = t.encode("utf-8", "replace").lower().split() if t else []
            n = len(words)
            h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, n)
            m = min(k, n)
            acc = np.full(n - m + 1 if n else 0, m, np.uint64)
            for i in range(m):
                acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[i : n - m + 1 + i])
            out.append(np.unique(acc))
    return out


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """Fast similarity sketches of non-empty sets: a row of t coordinates each.

    In each of the first t rounds every element is thrown into one bin by the round's hash and a bin keeps its
    least (round, hash); rounds end as all bins of a set are full. Rounds t to 2t - 1 throw every element into
    the bin of their own number, so that no bin stays empty. Equal coordinates of two sketches estimate the
    Jaccard similarity with the concentration of sampling with replacement or better.
    """
    out = np.full((len(sets), t), _EMPTY)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    x = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    flat = out.reshape(-1)
    low = np.uint64((1 << 40) - 1)
    with np.errstate(over="ignore"):
        for i in range(2 * t):
            if not len(x):
                break
            h = _mix(x + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            bins = ((h >> np.uint64(40)) * np.uint64(t) >> np.uint64(24)).astype(np.int64) if i < t else np.full(len(x), i - t)
            np.minimum.at(flat, doc * t + bins, np.uint64(i << 40) | (h & low))
            open_ = (out == _EMPTY).any(axis=1)
            if not open_.all():
                stay = open_[doc]
                x, doc = x[stay], doc[stay]
    return out


def _digests(sets: list[np.ndarray]) -> np.ndarray:
    """A 128-bit digest of each set, as two numbers."""
    import xxhash

    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in sets), np.int64).reshape(-1, 2)


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    bands = sketch.reshape(len(sketch), sketch.shape[1] // rows, rows)
    with np.errstate(over="ignore"):
        acc = np.broadcast_to(np.arange(bands.shape[1], dtype=np.uint64), bands.shape[:2]).copy()
        for j in range(rows):
            acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, j])
    return acc.view(np.int64)


def bands_for(percent: int, rows: int, miss: float = 1e-8) -> int:
    """How many bands of `rows` coordinates find a pair of similarity percent but for a chance of `miss`."""
    return math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** rows)))


def fingerprints(docs: DataFrame, k: int, percent: int, rows: int, text: str = "text") -> DataFrame:
    """A table with a row a document: doc_id, n_shingles, a 128-bit digest of its set (d0, d1), and its band keys."""
    t = rows * bands_for(percent, rows)

    def make(parts: Iterator) -> Iterator:
        import pyarrow as pa

        for part in parts:
            ids, texts = part.column(0), part.column(1)
            for s in slices(texts, 500_000):
                sets = shingle_sets(texts.slice(s.start, s.stop - s.start).to_pylist(), k)
                full = [x for x in sets if len(x)]
                keys = iter(band_keys(sketches(full, t), rows))
                digests = _digests(sets)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(s.start, s.stop - s.start), pa.array([len(x) for x in sets], pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array([next(keys) if len(x) else [] for x in sets], pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "d0", "d1", "bands"],
                )

    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text).alias("t"))
    return materialize(rows_in.mapInArrow(make, "doc_id long, n_shingles long, d0 long, d1 long, bands array<long>"), "fingerprints")


def _groups(parts: Iterator, keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal first `keys` columns, from sorted Arrow batches."""
    now, rows = None, []
    for part in parts:
        for row in zip(*[c.to_pylist() for c in part.columns]):
            if row[:keys] != now:
                if rows:
                    yield now, rows
                now, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield now, rows


def linked(sets: list[np.ndarray], percent: int, most_cells: int = 4_000_000) -> np.ndarray:
    """For each set the lowest place reachable by links with 100 * intersection >= percent * union."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    doc = np.repeat(np.arange(m), size)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.bincount(column) >= 2  # the rest meets nothing
    number = np.cumsum(shared) - 1
    pick = shared[column]
    doc, column = doc[pick], number[column[pick]]
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    both = np.zeros((m, m), np.float64)
    step = max(1, most_cells // m)
    total = int(number[-1]) + 1 if len(number) else 0
    for s in range(0, total, step):
        a, b = np.searchsorted(column, [s, s + step])
        block = np.zeros((m, min(step, total - s)), np.float32)
        block[doc[a:b], column[a:b] - s] = 1
        both += block @ block.T
    links = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    label = np.arange(m)
    for i in range(m):
        if label[i] != i:
            continue
        found = np.zeros(m, bool)
        found[i] = True
        edge = found.copy()
        while edge.any():
            edge = links[edge].any(axis=0) & ~found
            found |= edge
        label[found] = i
    return label


def _verified(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Edges (a, b) of a spanning star for each component inside each group of keys; rows: keys, node, shingles."""

    def link(parts: Iterator) -> Iterator:
        import pyarrow as pa

        for _, group in _groups(parts, len(keys)):
            found = dict(group)
            if len(found) < 2:
                continue
            nodes = sorted(found)
            label = linked([np.frombuffer(found[n], np.uint64) for n in nodes], percent)
            pairs = [(nodes[j], nodes[i]) for i, j in enumerate(label.tolist()) if i != j]
            if pairs:
                a, b = zip(*pairs)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    n = partitions(rows.sparkSession)
    dealt = rows.select(*keys, "node", "shingles").repartition(n, *keys).sortWithinPartitions(*keys)
    return materialize(dealt.mapInArrow(link, "a long, b long"), "links")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, rows: int = 6, text: str = "text", chunk: int = 256, chunk_shingles: int = 400_000, anchors: int = 8, chunk_pairs: int = 256) -> DataFrame:
    """A row a document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links) and kept.

    Two documents are linked if 100 * intersection >= percent * union of their sets of k-word shingles.

    1. Fingerprints. Documents with equal sets (128-bit digest) fall together as one node, so copies cost nothing
       later. Nodes are numbered in order of their least doc_id. Band keys miss a pair at the threshold with a
       chance of 1e-8, and fewer the more alike it is.
    2. Candidates. Nodes that share a band key, directly or through others, form a group. A group is found by
       linking each node with the least node of each of its bands, so a band of n nodes gives n rows; these heads
       hang on the least of them, so most of a group's edges are one a node.
    3. Verification. Full sets are made again from the texts of nodes in groups. A group is dealt into chunks of
       about `chunk` nodes and chunk_shingles shingles, a few nodes (anchors) standing in all chunks; a chunk
       computes all its intersections and returns a spanning star for each component.
    4. Groups of several chunks that are not one component yet are searched for links between their components by
       the rarest shingles of each node (cross_links), which finds all of them without comparing chunks.

    A null or empty text, or one of white space, has no shingles and is linked with nothing. Rows with the same
    doc_id stand for one document: links of either hold for both. A null doc_id is no document's name: such rows
    are linked by their texts alone, come after all others, and where a component has no other row its component_id
    is null and all its rows are kept. Only doc_id and the text are read.
    """
    prints = fingerprints(docs, k, percent, rows, text)
    narrow = prints.select("doc_id", "n_shingles", "d0", "d1")
    different = narrow.where("n_shingles > 0").groupBy("d0", "d1").agg(F.min("doc_id").alias("first"), F.max("n_shingles").alias("n_shingles"))
    placed = different.withColumn("place", F.coalesce("first", F.lit(2**63 - 1)))
    order = ["place", "d0", "d1"]
    nodes = materialize(row_numbers(ordered_blocks(placed, order, "numbered"), order, "node").select("node", "first", "n_shingles", "d0", "d1"), "nodes")
    # half of a set's digest names it here: were two sets to share it, their groups would be one group
    keyed = prints.select(F.col("d0").alias("node"), F.explode("bands").alias("key"))
    heads = materialize(keyed.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head < last").select("key", "head"), "heads")
    # a node and all its heads hang on the least of them, so a group has few edges besides one a node
    hung = keyed.join(heads, "key").groupBy("node").agg(F.min("head").alias("a"), F.collect_set("head").alias("heads"))  # a head a band at most
    near = hung.select("a", F.explode(F.array_union("heads", F.array("node"))).alias("b")).where("a <> b").distinct()
    groups = components(materialize(near, "candidates"))

    # tables of known size: joins broadcast them only if they are small
    sized = materialize(nodes.join(groups.select(F.col("node").alias("d0"), F.col("label").alias("group")), "d0"), "grouped")
    stats = materialize(sized.groupBy("group").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s")), "group_sizes")
    parts = F.greatest(F.ceil(F.col("n") / chunk), F.ceil(F.col("s") / chunk_shingles)).cast("long")
    members = materialize(sized.join(stats, "group").withColumn("parts", parts), "members")
    own = F.pmod(F.xxhash64("node"), F.col("parts"))
    everywhere = (F.col("parts") > 1) & (F.pmod(F.xxhash64("node", F.lit(1)), F.ceil(F.col("n") / anchors).cast("long")) == 0)
    chunks = F.when(everywhere, F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array(own))
    sets = _sets(docs, members.select("node", "first", "d0", "d1", "group", chunks.alias("chunks")), k, text)
    links = _verified(sets.select("node", "group", F.explode("chunks").alias("chunk"), "shingles"), ["group", "chunk"], percent)
    links = materialize(links.unionByName(_same_document(narrow, nodes)), "all_links")
    labels = components(links)

    state = members.where("parts > 1").join(labels, "node", "left").select("node", "group", F.coalesce("label", "node").alias("label"))
    state = materialize(state, "state")
    split = state.groupBy("group").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("group")
    apart = materialize(state.join(split, "group", "left_semi").select("node", "label").join(sets.select("node", "shingles"), "node"), "apart")
    if apart.limit(1).count():
        labels = components(links.unionByName(cross_links(apart, percent, chunk_pairs)))

    # the least doc_id of a component is its least node's
    final = nodes.select("node", "d0", "d1").join(labels, "node", "left").select("d0", "d1", F.coalesce("label", "node").alias("head"))
    named = final.join(nodes.select(F.col("node").alias("head"), F.col("first").alias("component_id")), "head").select("d0", "d1", "component_id")
    out = narrow.join(named, ["d0", "d1"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


#: Buckets that shingles are counted in to tell rare ones; their counts are all that goes through the driver.
BUCKETS = 1 << 18


def _frequencies(rows: DataFrame) -> np.ndarray:
    """How many sets of rows (shingles: binary) hold a shingle of each bucket, repeats in a set included."""

    def count(parts: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(BUCKETS, np.int64)
        for part in parts:
            for s in slices(part.column(0), 4_000_000):
                some = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in part.column(0).slice(s.start, s.stop - s.start)])
                total += np.bincount(_mix(some) % np.uint64(BUCKETS), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    found = rows.select("shingles").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # BUCKETS rows at most
    out = np.zeros(BUCKETS, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def _least_shared(size, percent: int):
    """How many elements a set of this size shares at least with any set that it is linked with."""
    return -(-percent * size // 100)


def rare_shingles(rows: DataFrame, percent: int) -> DataFrame:
    """(h, node, label, size, place): the shingles of each set up to the last that may be the first of a link's shared ones.

    Shingles are put in one order for all sets, rare ones first. Of two linked sets, the first of the shared shingles in
    that order stands, in both, before all but as many as a link must share. A shingle that no other set has is left out.
    """
    seen = rows.sparkSession.sparkContext.broadcast(_frequencies(rows))  # 2 MB, whatever the data

    def cut(parts: Iterator) -> Iterator:
        import pyarrow as pa

        frequency = seen.value
        for part in parts:
            nodes, labels = (part.column(i).to_numpy() for i in range(2))
            for s in slices(part.column(2), 2_000_000):
                sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in part.column(2).slice(s.start, s.stop - s.start)]
                size = np.array([len(x) for x in sets], np.int64)
                every = np.concatenate(sets)
                of = np.repeat(np.arange(len(sets)), size)
                often = frequency[_mix(every) % np.uint64(BUCKETS)]
                order = np.lexsort((every, often, of))
                place = np.arange(len(every)) - np.repeat(np.cumsum(size) - size, size)
                keep = (place < (size - _least_shared(size, percent) + 1)[of]) & (often[order] > 1)
                h, n = every[order][keep], of[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(nodes[s][n]), pa.array(labels[s][n]), pa.array(size[n]), pa.array(place[keep])],
                    names=["h", "node", "label", "size", "place"],
                )

    return rows.select("node", "label", "shingles").mapInArrow(cut, "h long, node long, label long, size long, place long")


def _may_link(parts: Iterator, percent: int) -> Iterator:
    """Pairs (a, b) of nodes of one shingle and different labels, whose sizes and places leave room for a link."""
    import pyarrow as pa

    for _, group in _groups(parts, 3):
        node, label, size, place = (np.array(c, np.int64) for c in zip(*group))
        need = -(-percent * (size[:, None] + size[None, :]) // (100 + percent))
        room = 1 + np.minimum((size - place - 1)[:, None], (size - place - 1)[None, :])
        i, j = np.nonzero((label[:, None] < label[None, :]) & (room >= need) & (need <= np.minimum(size[:, None], size[None, :])))
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[j])], names=["a", "b"])


def cross_links(rows: DataFrame, percent: int, chunk: int = 256) -> DataFrame:
    """Edges (a, b): all links between sets of different labels; rows: node, label, shingles (binary, sorted).

    Two linked sets share one of their rare shingles. Shingles whose sets have one label are dropped as a whole, and of
    the others' pairs those whose sizes, and the shingle's places in both sets, rule a link out. What is left is compared
    by its full sets. A shingle of more than `chunk` sets is dealt into chunks that meet in pairs, a few numbers a set.
    """
    spark = rows.sparkSession
    rare = materialize(rare_shingles(rows, percent), "rare_shingles")
    sizes = rare.groupBy("h").agg(F.count("*").alias("n"), F.min("label").alias("least"), F.max("label").alias("most")).where("least < most")
    sizes = materialize(sizes.select("h", F.ceil(F.col("n") / chunk).cast("long").alias("parts")), "shared_shingles")
    own = F.pmod(F.xxhash64("node"), F.col("parts"))
    met = rare.join(sizes, "h").withColumn("own", own).select("h", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"), "own", "node", "label", "size", "place")
    dealt = met.select("h", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "node", "label", "size", "place")
    dealt = dealt.repartition(partitions(spark), "h", "one", "two").sortWithinPartitions("h", "one", "two")
    pairs = materialize(dealt.mapInArrow(lambda parts: _may_link(parts, percent), "a long, b long").distinct(), "pairs_to_compare")
    mine = rows.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    theirs = rows.select(F.col("node").alias("b"), F.col("shingles").alias("y"))

    def compare(parts: Iterator) -> Iterator:
        import pyarrow as pa

        for part in parts:
            a, b = part.column(0).to_numpy(), part.column(1).to_numpy()
            keep = np.zeros(len(a), bool)
            for i, (x, y) in enumerate(zip(part.column(2), part.column(3))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    both = pairs.join(mine, "a").join(theirs, "b").select("a", "b", "x", "y")
    return materialize(both.mapInArrow(compare, "a long, b long"), "cross_links")


def _same_document(narrow: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (a, b) between the nodes of each doc_id that has rows with different sets."""
    rows = narrow.where("n_shingles > 0 and doc_id is not null")
    several = rows.groupBy("doc_id").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("d0", "d1") for f in (F.min, F.max)]).where("min_d0 <> max_d0 or min_d1 <> max_d1")
    named = rows.join(materialize(several.select("doc_id"), "several_texts"), "doc_id", "left_semi").join(nodes.select("d0", "d1", "node"), ["d0", "d1"])
    return named.groupBy("doc_id").agg(F.min("node").alias("a"), F.collect_set("node").alias("bs")).select("a", F.explode("bs").alias("b")).where("a <> b")


def _sets(docs: DataFrame, wanted: DataFrame, k: int, text: str) -> DataFrame:
    """node, group, chunks and shingles (binary) of the wanted nodes (node, first, d0, d1, group, chunks), from the texts of documents `first`."""

    def make(parts: Iterator) -> Iterator:
        import pyarrow as pa

        seen: set[int] = set()  # repeated rows of a document give its set once
        for part in parts:
            node, d0, d1 = (part.column(i).to_numpy() for i in range(3))
            texts = part.column(5)
            for s in slices(texts, 500_000):
                sets = shingle_sets(texts.slice(s.start, s.stop - s.start).to_pylist(), k)
                good = ((_digests(sets) == np.stack([d0[s], d1[s]], axis=1)).all(axis=1)).tolist()
                keep = [i for i, (n, g) in enumerate(zip(node[s].tolist(), good)) if g and n not in seen and not seen.add(n)]
                at = pa.array([s.start + i for i in keep], pa.int64())
                yield pa.RecordBatch.from_arrays([*[part.column(i).take(at) for i in (0, 3, 4)], pa.array([sets[i].tobytes() for i in keep], pa.binary())], names=["node", "group", "chunks", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), text_or_empty(text).alias("t"))
    rows = sifted(texts, "_id", wanted, "first").join(wanted, F.col("_id").eqNullSafe(F.col("first"))).select("node", "d0", "d1", "group", "chunks", "t")
    return materialize(rows.mapInArrow(make, "node long, group long, chunks array<long>, shingles binary"), "shingles")


def op6_similarity_sketch(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, k=3, percent=85, rows=7)


OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS p FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(ws) < 3 THEN ws ELSE ws[p:p+2] END, ' ') AS g FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(c.b, w.doc_id)) AS component_id,
  least(w.doc_id, coalesce(c.b, w.doc_id)) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.a = w.doc_id
"""
