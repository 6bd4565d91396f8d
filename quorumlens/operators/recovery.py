"""Snapshots of a store: JSON lines with a manifest of counts and checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1
MANIFEST = "table string, rows long, checksum string, version int"


def _line(df: DataFrame) -> Column:
    return F.to_json(F.struct(*sorted(df.columns)))


def checksum(df: DataFrame) -> DataFrame:
    """(rows, checksum) of a table whatever its order: sums of the halves of each row's hash."""
    h = df.select(F.sha2(_line(df), 256).alias("h"))
    part = lambda at: F.sum(F.conv(F.substring("h", at, 12), 16, 10).cast("decimal(38,0)"))
    return h.agg(F.count("*").alias("rows"), F.concat_ws("-", part(1).cast("string"), part(13).cast("string")).alias("checksum"))


def export_snapshot(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Write each table under path as JSON lines, and the manifest last: a snapshot without one is not whole."""
    manifest = None
    for name in sorted(tables):
        tables[name].write.mode("errorifexists").json(f"{path}/{name}")
        row = checksum(tables[name]).select(F.lit(name).alias("table"), "rows", "checksum", F.lit(VERSION).alias("version"))
        manifest = row if manifest is None else manifest.unionByName(row)
    manifest.coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")
    return manifest


def read_snapshot(spark: SparkSession, path: str, schemas: dict[str, str], verify: bool = True) -> dict[str, DataFrame]:
    """The tables of a snapshot; with verify a table that differs from the manifest raises an error."""
    said = {r["table"]: r for r in spark.read.schema(MANIFEST).json(f"{path}/manifest").collect()}  # a row a table
    out = {}
    for name, schema in schemas.items():
        if name not in said or said[name]["version"] > VERSION:
            raise ValueError(f"the snapshot has no readable table {name}")
        out[name] = spark.read.schema(schema).json(f"{path}/{name}")
        if verify:
            found = checksum(out[name]).first()
            if (found["rows"], found["checksum"]) != (said[name]["rows"], said[name]["checksum"]):
                raise ValueError(f"table {name} is not what the manifest says")
    return out


def restore_snapshot(spark: SparkSession, path: str, schemas: dict[str, str], store, keys: dict[str, str], verify: bool = True) -> dict[str, int]:
    """Append a snapshot's tables to a store, and say how many rows of each were new; rows with a known key stay as they are."""
    return {name: store.append(name, table, keys[name]) for name, table in read_snapshot(spark, path, schemas, verify).items()}
