"""Hilbert-curve ordering: rows sorted along a space-filling curve over their metadata and cut into even runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, materialize, ordered_blocks, row_numbers, text_or_empty


def hilbert_index(dims: Sequence[Column], bits: int) -> Column:
    """The place on the Hilbert curve of a cell whose coordinates are whole numbers from 0 to 2**bits - 1.

    One fold over the bit levels, from the highest down. Each level inverts or swaps the lower bits of the
    coordinates, then the coordinates are Gray-coded and their bits interleaved.
    """
    n = len(dims)
    if not 1 <= n * bits <= 62:
        raise ValueError("dimensions times bits must lie between 1 and 62")
    x = F.array(*[d.cast("long") for d in dims])

    def fold(i: int, q: Column, state: Column) -> Column:
        low = q - 1
        swap = F.get(state, F.lit(0)).bitwiseXOR(F.get(state, F.lit(i))).bitwiseAND(low)

        def turned(t: Column) -> Column:
            set_ = F.get(state, F.lit(i)).bitwiseAND(q) != 0
            first = F.get(state, F.lit(0)).bitwiseXOR(F.when(set_, low).otherwise(t))
            own = F.get(state, F.lit(i)).bitwiseXOR(F.when(set_, F.lit(0).cast("long")).otherwise(t))
            return F.array(*[first if j == 0 else own if j == i else F.get(state, F.lit(j)) for j in range(n)])

        return let(swap, turned)

    def level(state: Column, q: Column) -> Column:
        for i in range(n):
            state = let(state, partial(fold, i, q))
        return state

    levels = F.transform(F.sequence(F.lit(bits - 1), F.lit(1), F.lit(-1)), lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b)) if bits > 1 else F.array().cast("array<bigint>")
    turned = F.aggregate(levels, x, level)
    gray = let(turned, lambda s: F.array(*[F.get(s, F.lit(i)) if i == 0 else _xor([F.get(s, F.lit(j)) for j in range(i + 1)]) for i in range(n)]))

    def fixed(s: Column) -> Column:
        last = F.get(s, F.lit(n - 1))
        flips = F.aggregate(levels, F.lit(0).cast("long"), lambda t, q: F.when(last.bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
        return let(flips, lambda t: F.transform(s, lambda v: v.bitwiseXOR(t)))

    def woven(s: Column) -> Column:
        places = [(b, i) for b in range(bits - 1, -1, -1) for i in range(n)]
        out = F.lit(0).cast("long")
        for k, (b, i) in enumerate(places):
            bit = F.shiftright(F.get(s, F.lit(i)), b).bitwiseAND(F.lit(1).cast("long"))
            out = out.bitwiseOR(F.shiftleft(bit, len(places) - 1 - k))
        return out

    return let(let(gray, fixed), woven)


def _xor(xs: Sequence[Column]) -> Column:
    out = xs[0]
    for x in xs[1:]:
        out = out.bitwiseXOR(x)
    return out


def quantise_log(value: Column, bits: int) -> Column:
    """log2 of 1 + value in steps of a quarter, capped to the last cell; null and negative values go to cell 0."""
    cell = F.floor(F.log2(F.greatest(F.coalesce(value, F.lit(0)), F.lit(0)) + 1.0) * 4)
    return F.least(cell, F.lit(2**bits - 1)).cast("long")


def rank_cells(docs: DataFrame, column: str, bits: int) -> DataFrame:
    """(value, cell) for each value of a column: the share of rows with smaller values, in 2**bits steps.

    Cells follow the order of values, so a range of values is a range of cells, and each cell holds about as many
    rows unless one value has more. Null comes first. A value is one row, however many rows have it.
    """
    counts = materialize(docs.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")), "values")
    total = counts.agg(F.sum("n")).first()[0] or 1
    blocks = ordered_blocks(counts, ["value"], "ordered_values")
    sums = blocks.groupBy("_block").agg(F.sum("n").alias("rows"))
    ahead = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    before = materialize(sums.select("_block", F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("before")), "value_blocks")
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("_block").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = blocks.withColumn("_inside", inside).join(before, "_block")
    return materialize(placed.select("value", F.floor((F.col("_inside") + F.col("before")) * 2**bits / total).cast("long").alias("cell")), "cells")


def with_cells(docs: DataFrame, column: str, bits: int, out: str) -> DataFrame:
    """docs with the cell of a column; the table of cells is of known size, so it is broadcast only if it is small."""
    cells = rank_cells(docs, column, bits).select(F.col("value").alias("_value"), F.col("cell").alias(out))
    return docs.join(cells, F.col(column).eqNullSafe(F.col("_value")), "left").drop("_value")


def hilbert_shards(docs: DataFrame, dims: Sequence[Column], shards: int, bits: int = 6, ties: Sequence[str] = ("doc_id",), keep: Sequence[str] | None = None) -> DataFrame:
    """Deal docs into runs of the Hilbert order with row counts at most one apart.

    dims are coordinates from 0 to 2**bits - 1. Adds curve (long), shard (int, from 0 to shards - 1) and slot
    (long, gapless from 0 in each shard); columns of these names are overwritten. keep names the columns of docs that
    go along (default: all). Give keep where rows are wide, as rows are range-partitioned by curve and ties. Rows
    equal in curve and ties are dealt in any order. Rows are told apart by nothing but their values, so repeated rows
    each get their own slot. An empty table gives no rows; more shards than rows leave the last ones empty by the
    same law.
    """
    cols = [c for c in (docs.columns if keep is None else keep) if c not in ("curve", "shard", "slot")]
    order = ["curve", *[f"_tie{i}" for i in range(len(ties))]]
    placed = docs.select(F.struct(*cols).alias("_row"), *[F.col(t).alias(f"_tie{i}") for i, t in enumerate(ties)], hilbert_index(dims, bits).alias("curve"))
    numbered = row_numbers(ordered_blocks(placed, order, "hilbert"), order)
    n = placed.count()
    # the first (rows mod shards) shards get one row more
    small, extra = n // shards, n % shards
    edge = extra * (small + 1)
    position = F.col("position")
    shard = F.when(position < edge, F.floor(position / (small + 1))).otherwise(extra + F.floor((position - edge) / max(small, 1))).cast("int")
    begin = F.when(F.col("shard") < extra, F.col("shard") * (small + 1)).otherwise(edge + (F.col("shard") - extra) * small)
    return numbered.withColumn("shard", shard).select("_row.*", "curve", "shard", (position - begin).cast("long").alias("slot"))


def shard_ranges(sharded: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row a shard: its rows and the least and greatest value of each column, as low_<column> and high_<column>."""
    ends = [f(c).alias(f"{name}_{c}") for c in columns for f, name in ((F.min, "low"), (F.max, "high"))]
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), *ends)


def shards_that_may_hold(ranges: DataFrame, wanted: Mapping[str, tuple]) -> DataFrame:
    """The shards whose ranges meet every wanted (low, high); a shard with nulls alone in a column meets nothing."""
    out = ranges
    for column, (low, high) in wanted.items():
        out = out.where((F.col(f"low_{column}") <= high) & (F.col(f"high_{column}") >= low))
    return out.select("shard")


def write_shards(sharded: DataFrame, folder: str) -> None:
    """A folder of files a shard. Rows lie in blocks of the curve's order, so each task writes to a shard or two."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)


DIMS = ("lang", "source", "size")


def metadata_shards(docs: DataFrame, shards: int = 24, bits: int = 6) -> DataFrame:
    """doc_id, lang, source, size and text_crc32 of docs in Hilbert order of lang, source and size, as a table in the shared folder."""
    body = F.encode(text_or_empty(), "utf-8")
    narrow = docs.select("doc_id", "lang", "source", (F.octet_length(body) + F.lit(8)).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    narrow = materialize(narrow, "metadata")
    celled = with_cells(with_cells(narrow, "lang", bits, "_lang"), "source", bits, "_source")
    dims = [F.col("_lang"), F.col("_source"), quantise_log(F.col("size") - 8, bits)]
    return materialize(hilbert_shards(celled, dims, shards, bits, ("doc_id", "text_crc32"), narrow.columns), "shards")


def op5_hilbert_shards(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    out = metadata_shards(docs)
    ranges = shard_ranges(out, DIMS).drop("rows")  # 24 rows
    return out.join(F.broadcast(ranges), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve", *[f"{e}_{c}" for c in DIMS for e in ("low", "high")]
    )


def _hilbert_sql(bits: int, dims: int) -> str:
    """CTEs h0, h1, ... that turn x0, x1, ... of cells into their place on the curve, one CTE a step of hilbert_index()."""
    steps, at = ["h0 AS (SELECT * FROM cells)"], 0
    others = lambda i: [f"x{j}" for j in range(dims) if j not in (0, i)]
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(dims):
            swap = f"xor(x0, x{i}) & {q - 1}"
            new = [f"xor(x0, CASE WHEN x{i} & {q} <> 0 THEN {q - 1} ELSE {swap} END) AS x0", *([f"xor(x{i}, CASE WHEN x{i} & {q} <> 0 THEN 0 ELSE {swap} END) AS x{i}"] if i else [])]
            steps.append(f"h{at + 1} AS (SELECT * EXCLUDE ({', '.join(f'x{j}' for j in range(dims))}), {', '.join([*new, *others(i)])} FROM h{at})")
            at += 1
    gray = ["x0"]
    for i in range(1, dims):
        gray.append(f"xor({gray[-1]}, x{i})")
    flips = "0"
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        flips = f"xor({flips}, CASE WHEN last & {q} <> 0 THEN {q - 1} ELSE 0 END)"
    woven = " + ".join(f"(((xor(g{i}, flip) >> {b}) & 1) << {b * dims + dims - 1 - i})" for b in range(bits) for i in range(dims))
    steps.append(f"gray AS (SELECT *, {', '.join(f'{g} AS g{i}' for i, g in enumerate(gray))}, {gray[-1]} AS last FROM h{at})")
    steps.append(f"flipped AS (SELECT *, {flips} AS flip FROM gray)")
    steps.append(f"curved AS (SELECT doc_id, lang, source, size, text_crc32, CAST({woven} AS BIGINT) AS curve FROM flipped)")
    return ",\n".join(steps)


#: DuckDB has no crc32, so it is folded over the bytes of each text, by a table made from its polynomial.
OP5_SQL = f"""
WITH RECURSIVE step AS (SELECT i, i AS c, 0 AS k FROM (SELECT unnest(range(256)) AS i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM step WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
hexed AS (SELECT doc_id, lang, source, hex(encode(coalesce(text, ''))) AS h FROM documents),
narrow AS (SELECT doc_id, lang, source, CAST(length(h) // 2 + 8 AS BIGINT) AS size, CAST(xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2),
  lambda i: (strpos('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2 * i + 2]) - 1)), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) AS BIGINT) AS text_crc32 FROM hexed, crc_table),
langs AS (SELECT lang, CAST(floor(coalesce(sum(n) OVER (ORDER BY lang NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 64 / sum(n) OVER ()) AS BIGINT) AS x0 FROM (SELECT lang, count(*) AS n FROM narrow GROUP BY 1)),
sources AS (SELECT source, CAST(floor(coalesce(sum(n) OVER (ORDER BY source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 64 / sum(n) OVER ()) AS BIGINT) AS x1 FROM (SELECT source, count(*) AS n FROM narrow GROUP BY 1)),
cells AS (SELECT d.*, l.x0, s.x1, CAST(least(floor(ln(d.size - 8 + 1.0) / ln(2.0) * 4), 63) AS BIGINT) AS x2 FROM narrow d
  JOIN langs l ON d.lang IS NOT DISTINCT FROM l.lang JOIN sources s ON d.source IS NOT DISTINCT FROM s.source),
{_hilbert_sql(6, 3)},
dealt AS (SELECT *, row_number() OVER (ORDER BY curve, doc_id NULLS FIRST, text_crc32) - 1 AS place, count(*) OVER () // 24 AS small, count(*) OVER () % 24 AS extra FROM curved),
placed AS (SELECT *, CASE WHEN place < extra * (small + 1) THEN place // (small + 1) ELSE extra + (place - extra * (small + 1)) // greatest(small, 1) END AS shard,
  CASE WHEN place < extra * (small + 1) THEN place % (small + 1) ELSE (place - extra * (small + 1)) % greatest(small, 1) END AS slot FROM dealt)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(shard AS INT) AS shard, CAST(slot AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard, curve,
  {', '.join(f'{f}({c}) OVER (PARTITION BY shard) AS {e}_{c}' for c in DIMS for f, e in (('min', 'low'), ('max', 'high')))} FROM placed
"""
