"""Main text of HTML pages by wrapper induction over the pages of each host."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import dom
from .common import materialize

#: Elements that tell layouts apart.
LAYOUT = r"(?i)<(article|main|nav|aside|section|footer|header|form|table)\b"
BLOCKS = "array<struct<at:int,hash:bigint,listed:boolean,main:boolean,text:string>>"
REGIONS = "array<struct<slot:int,end:int,depth:int,whole:boolean>>"


def host_of(url: str = "url"):
    """The lower-cased host of a URL; anything without one, and null, is the host ''."""
    return F.lower(F.coalesce(F.nullif(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1), F.lit("")), F.lit("")))


def layout_of(html):
    """The structural elements that a page uses, in order of first use."""
    return F.lower(F.array_join(F.array_distinct(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(LAYOUT), F.lit(1))), ">"))


def templates(rows: DataFrame) -> DataFrame:
    """A table (_host, _layout, _group, _template, _regions) for all hosts and layouts of rows (_host, _layout, _html).

    The reference of a layout is its least page by hash. A layout that has one different page only takes the template
    of the host's most frequent layout, of equals the last by name; _group names that layout.
    """
    hashed = rows.select("_host", "_layout", "_html", F.xxhash64("_html").alias("_hash"))
    found = hashed.groupBy("_host", "_layout").agg(F.count("*").alias("n"), (F.min("_hash") < F.max("_hash")).alias("_several"), F.min_by("_html", "_hash").alias("_html"))
    found = materialize(found, "references")
    most = found.groupBy("_host").agg(F.max_by("_layout", F.struct("_several", "n", "_layout")).alias("_most"))
    groups = found.join(most, "_host").select("_host", "_layout", F.when(F.col("_several"), F.col("_layout")).otherwise(F.col("_most")).alias("_group"))

    def induce(parts: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = pa.struct([("slot", pa.int32()), ("end", pa.int32()), ("depth", pa.int32()), ("whole", pa.bool_())])
        for part in parts:
            made = [dom.Template.of(dom.parse(x)) for x in part.column(2).to_pylist()]
            regions = [[dict(zip(("slot", "end", "depth", "whole"), r)) for r in t.regions()] for t in made]
            text = [json.dumps([t.labels, t.children]) for t in made]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array(regions, pa.list_(kinds))], names=["_host", "_group", "_template", "_regions"])

    made = found.select("_host", "_layout", "_html").mapInArrow(induce, f"_host string, _group string, _template string, _regions {REGIONS}")
    return materialize(materialize(groups, "layouts").join(materialize(made, "induced"), ["_host", "_group"]), "page_templates")


def aligned_blocks(rows: DataFrame, induced_from: DataFrame) -> DataFrame:
    """A table of rows (_row, _host, _layout, _html) and templates() with _row, _host, _group, _page (a hash of the page's
    blocks) and _blocks: all of them, aligned.

    at: the slot of the block's element, or of the nearest one above it that was matched; listed: it stands in a
    menu, advert or the like, by element, class, id, role and hiding, and has no text here; main: in an article or main
    element.
    """
    # the templates are a table of known size: the join broadcasts them only if they are small
    joined = rows.join(induced_from.drop("_regions"), ["_host", "_layout"], "left").select("_row", "_host", "_group", "_html", "_template")
    fields = [joined.schema["_row"], T.StructField("_host", T.StringType()), T.StructField("_group", T.StringType()), T.StructField("_page", T.LongType())]
    schema = T.StructType([*fields, T.StructField("_blocks", T.StructType.fromDDL(f"b {BLOCKS}")["b"].dataType)])

    def parse(parts: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        signed = lambda x: xxhash.xxh3_64_intdigest(x) - (1 << 63)
        block = pa.list_(pa.struct([("at", pa.int32()), ("hash", pa.int64()), ("listed", pa.bool_()), ("main", pa.bool_()), ("text", pa.string())]))
        known: dict[str, dom.Template] = {}
        for part in parts:
            for s in range(0, part.num_rows, 500):
                piece = part.slice(s, 500)
                ids, found = [], []
                for html_, template in zip(piece.column(3).to_pylist(), piece.column(4).to_pylist()):
                    if template not in known:
                        if len(known) >= 512:
                            known.clear()
                        known[template] = dom.Template(*json.loads(template))
                    page = dom.parse(html_)
                    known[template].align(page)
                    blocks = [{"at": n.at(), "hash": signed(t.encode("utf-8", "replace")), "listed": n.outside or (n.header and n.tag not in dom.HEADINGS), "main": n.main, "text": t} for n, t in page.blocks]
                    for b in blocks:  # what is listed is never content
                        b["text"] = None if b["listed"] else b["text"]
                    found.append(blocks)
                    ids.append(signed(b",".join(b["hash"].to_bytes(8, "little", signed=True) for b in blocks)))
                yield pa.RecordBatch.from_arrays([*piece.columns[:3], pa.array(ids, pa.int64()), pa.array(found, block)], names=["_row", "_host", "_group", "_page", "_blocks"])

    return materialize(joined.mapInArrow(parse, schema), "blocks")


def induced(parsed: DataFrame, regions: DataFrame, share: float = 0.8, least_pages: int = 2) -> DataFrame:
    """What a wrapper says of each (_host, _group): _constant, its template blocks (at, hash), and _region, its content slots.

    A block is constant if its text stands in the same slot on `share` of the group's different pages and on
    least_pages of them. The region is the deepest container that holds more than half of the varying text, with
    first and last slot; listed blocks do not count for it, and where it is the whole body it is null.
    """
    # 128 bits instead of two names in every counted row
    key, names = ["_key0", "_key1"], {f"_key{i}": F.xxhash64(F.lit(i), "_host", "_group") for i in (0, 1)}
    parsed, regions = parsed.withColumns(names), regions.withColumns(names)
    different = parsed.select(*key, "_page").distinct().groupBy(*key).agg(F.count("*").alias("pages"))
    each = F.transform("_blocks", lambda b: F.struct(b["at"].alias("at"), b["hash"].alias("hash"), b["listed"].alias("listed"), F.char_length(b["text"]).alias("chars")))
    seen = parsed.select(*key, "_page", F.explode(F.array_distinct(each)).alias("b")).distinct()  # copies of a page count once
    often = materialize(seen.groupBy(*key, "b").agg(F.count("*").alias("n")), "slots")
    counted = often.join(materialize(different, "group_pages"), key)
    constant = (F.col("n") >= least_pages) & (F.col("n") >= F.col("pages") * share)
    fixed = counted.where(constant).groupBy(*key).agg(F.collect_set(F.struct("b.at", "b.hash")).alias("_constant"))  # under 1 / share blocks a slot
    varying = counted.where(~constant & ~F.col("b.listed")).groupBy(*key, F.col("b.at").alias("at")).agg(F.sum(F.col("n") * F.col("b.chars")).alias("chars"))
    held = varying.join(regions.select(*key, "_regions"), key).select(*key, "chars", F.explode(F.filter("_regions", lambda r: (r["slot"] <= F.col("at")) & (F.col("at") < r["end"]))).alias("r"))
    sums = held.groupBy(*key, "r").agg(F.sum("chars").alias("chars"))
    whole = sums.where("r.slot = 0").select(*key, F.col("chars").alias("all"))
    best = sums.join(whole, key).where("chars * 2 > all").groupBy(*key).agg(F.max_by("r", F.struct("r.depth", "r.slot")).alias("_region"))
    region = best.select(*key, F.when(~F.col("_region.whole"), F.struct("_region.slot", "_region.end")).alias("_region"))
    return materialize(regions.select("_host", "_group", *key).join(fixed, key, "left").join(region, key, "left").drop(*key), "wrappers")


def content_of(blocks, constant, region):
    """The blocks that are content, of an array of them, by the wrapper of their group."""
    varies = lambda b: ~F.coalesce(F.array_contains(constant, F.struct(b["at"].alias("at"), b["hash"].alias("hash"))), F.lit(False))
    inside = F.filter(blocks, lambda b: (b["at"] >= region["slot"]) & (b["at"] < region["end"]))
    main = F.filter(blocks, lambda b: b["main"] & ~b["listed"])
    place = F.when(region.isNotNull() & (F.size(inside) > 0), inside).when(F.size(main) > 0, main).otherwise(blocks)
    return F.filter(place, lambda b: ~b["listed"] & varies(b))


def extract_text(pages: DataFrame, html: str = "html", url: str = "url", share: float = 0.8, least_pages: int = 2) -> DataFrame:
    """Add text and n_chars to pages, by a wrapper that is induced for each host and layout; html itself is dropped.

    1. Every page is aligned with a reference page of its host and layout by simple tree matching of their trees of
       block elements, runs of one label being one node. Matched nodes share a slot.
    2. A block whose text stands in the same slot on at least `share` of the different pages (and on least_pages of
       them) is template; copies of a page count once, so copied articles stay content.
    3. The region of the content is the deepest slot of a container that holds more than half of the varying text
       of all these pages. Blocks in other slots are no content.
    4. What alignment cannot tell, names do: elements in the region that are menus, adverts, notices, forms, reader
       comments and so on are left out by element, class, id, role and hiding. Where no region stands out, or a page
       has nothing in it, an article or main element is the region, or without one the page.

    References are decoded, white space inside a block becomes one space, blocks are joined in page order by one
    newline. A null or empty html, and one without content, gives an empty text. Pages are rows: repeated rows
    each give a row. A null url belongs to the host ''. Columns named text or n_chars are overwritten; all other
    names may be used.

    Counting covers all pages: each sends the hashes of its aligned blocks, and equal ones are combined before
    the shuffle, so that a host with a third of all pages costs no single task.
    """
    kept = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    rows = pages.select(F.struct(*kept).alias("_row"), host_of(url).alias("_host"), layout_of(F.col(html)).alias("_layout"), F.col(html).alias("_html"))
    made = templates(rows)
    parsed = aligned_blocks(rows, made)
    wrappers = induced(parsed, made.where("_group = _layout").select("_host", "_group", "_regions"), share, least_pages)
    text = F.array_join(F.transform(content_of(F.col("_blocks"), F.col("_constant"), F.col("_region")), lambda b: b["text"]), "\n")
    out = parsed.join(wrappers, ["_host", "_group"], "left").select("_row.*", text.alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def op1_wrapper_induction(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
