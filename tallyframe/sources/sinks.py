"""Writers: CSV, Parquet bundles with a manifest, JSON lines, a local database file."""

from __future__ import annotations

import json
import sqlite3

from pyspark.sql import DataFrame, SparkSession

from ..operators.merges import insert_replace


def write_csv(df: DataFrame, path: str, order: list | None = None, single: bool = False) -> int:
    """CSV with a header, in an order if one is given, as part files in that order; `single` gives one file, which one task writes.  Returns the row count."""
    out = df.orderBy(*order) if order else df
    (out.coalesce(1) if single else out).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return df.sparkSession.read.csv(path, header=True, schema=", ".join(f"`{c}` string" for c in df.columns), escape='"', multiLine=True).count()


def write_bundle(tables: dict[str, DataFrame], path: str) -> dict[str, int]:
    """Each table as Parquet, and a manifest of row counts and schemas, written last."""
    counts = {}
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "snappy").parquet(f"{path}/{name}")
        counts[name] = df.sparkSession.read.parquet(f"{path}/{name}").count()
    if tables:
        spark = next(iter(tables.values())).sparkSession
        rows = [(n, counts[n], json.dumps(json.loads(df.schema.json()))) for n, df in tables.items()]
        spark.createDataFrame(rows, "name string, rows bigint, columns string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return counts


def read_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of a bundle; a row count that isn't the manifest's is an error."""
    out = {}
    for r in spark.read.schema("name string, rows bigint, columns string").json(f"{path}/manifest").collect():
        df = spark.read.parquet(f"{path}/{r.name}")
        if df.count() != r.rows:
            raise ValueError(f"{r.name} has {df.count()} rows, the manifest {r.rows}")
        out[r.name] = df
    return out


def import_bundle(current: dict[str, DataFrame], bundle: dict[str, DataFrame], keys: dict[str, list[str]], replace: bool = False) -> dict[str, DataFrame]:
    """Tables after an import: replaced, or merged by key with the bundle's rows winning."""
    return {n: df if replace or n not in current else insert_replace(current[n], df, keys[n]) for n, df in bundle.items()} | {n: df for n, df in current.items() if n not in bundle}


def compact(spark: SparkSession, path: str, target: str, files: int) -> int:
    """A table of many small files written anew as about `files` ones to a new folder, checked by row count; the old folder stays until the caller moves a pointer."""
    before = spark.read.parquet(path)
    before.repartition(files).write.mode("overwrite").option("compression", "zstd").parquet(target)
    rows, now = before.count(), spark.read.parquet(target).count()
    if rows != now:
        raise ValueError(f"{target} has {now} rows, {path} {rows}")
    return now


def write_staged(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_sqlite(df: DataFrame, path: str, table: str, batch: int = 10_000) -> int:
    """A local database file on the driver's disk, streamed partition by partition: for exports that one machine is to hold, as the format is one file."""
    names = ", ".join(f'"{c}"' for c in df.columns)
    with sqlite3.connect(path) as con:
        con.execute(f'DROP TABLE IF EXISTS "{table}"')
        con.execute(f'CREATE TABLE "{table}" ({names})')
        insert = f'INSERT INTO "{table}" VALUES ({", ".join("?" * len(df.columns))})'
        held, n = [], 0
        for row in df.toLocalIterator():
            held.append(tuple(v if isinstance(v, (int, float, str, bytes, type(None))) else str(v) for v in row))
            if len(held) >= batch:
                con.executemany(insert, held)
                n, held = n + len(held), []
        con.executemany(insert, held)
    return n + len(held)
