"""Readers: CSV with rejects and preambles, staged JSON lines, archives, sheets, bands, identifier lists."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codes import listed_number
from ..session import ship

CORRUPT = "_corrupt_record"
STAGED_RESPONSE = "entity_type string, entity_id string, fetched_at timestamp, http_status bigint, raw_json string"


def text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_csv(spark: SparkSession, paths: str | list[str], columns: list[str]) -> DataFrame:
    """All columns as text; rows with too few or too many fields have their line in the corrupt column."""
    schema = text_schema(columns).add(CORRUPT, T.StringType())
    # without pruning, or lines are only checked as far as the columns that a query reads
    return spark.read.option("columnPruning", False).csv(paths, schema=schema, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, escape='"', enforceSchema=False)


def good_rows(raw: DataFrame) -> DataFrame:
    return raw.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def rejected_rows(raw: DataFrame) -> DataFrame:
    """One row: how many lines were malformed.  Spark has no query of the corrupt column alone, so another one is looked at."""
    read = F.length(F.coalesce(F.col(raw.columns[0]), F.lit(""))) >= 0
    return raw.agg(F.count_if(F.col(CORRUPT).isNotNull() & read).alias("rejected"))


def snapshot_date(name_column):
    """Date in a file name such as Data-2024-05-01-part1_7.csv."""
    return F.regexp_extract(name_column, r"(\d{4}-\d{2}-\d{2})", 1).try_cast("date")


def one_month(paths: list[str]) -> str:
    """The date that all file names share; several dates are an error."""
    dates = {m[1] for p in paths if (m := re.search(r"(\d{4}-\d{2}-\d{2})", p))}
    if len(dates) != 1:
        raise ValueError(f"files of one date are needed, not {sorted(dates)}")
    return dates.pop()


def read_csv_after(spark: SparkSession, path: str, columns: list[str], skip: int, key: str) -> DataFrame:
    """CSV with `skip` lines before its header; rows without a key go.  One file of reference size, parsed whole, so that quoted line breaks stay."""
    ship(spark)
    schema = text_schema(columns)

    def parse(batches):
        import pandas as pd

        for batch in batches:
            for raw in batch["content"]:
                lines = io.StringIO(bytes(raw).decode("utf-8-sig"), newline="")
                for _ in range(skip):
                    lines.readline()
                rows = [(r + [None] * len(columns))[: len(columns)] for r in csv.reader(lines)][1:]
                yield pd.DataFrame(rows, columns=columns, dtype=object)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(parse, schema).where(F.trim(F.coalesce(F.col(key), F.lit(""))) != "")


def read_staged(spark: SparkSession, path: str, schema: str = STAGED_RESPONSE) -> DataFrame:
    """Staged JSON lines under a fixed schema; columns that older files lack are null."""
    return spark.read.schema(schema).json(path)


def torn_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, bad, last_bad): malformed lines a file, and whether its last line is one, which a writer that died leaves; others are corruption.

    Lines are read split by split; a line's place is that of its split in the file, then its place in the split.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).where("trim(value) <> ''")
    marked = lines.select("file", F.struct("block", F.monotonically_increasing_id().alias("at")).alias("place"), F.try_parse_json("value").isNull().alias("broken"))
    return marked.groupBy("file").agg(F.count_if("broken").cast("int").alias("bad"), F.max_by("broken", "place").alias("last_bad"))


def repaired(spark: SparkSession, path: str, schema: str = STAGED_RESPONSE) -> DataFrame:
    """Staged rows without a torn last line; corruption elsewhere is an error."""
    worse = torn_lines(spark, path).where((F.col("bad") > 1) | ((F.col("bad") == 1) & ~F.col("last_bad")))
    broken = worse.limit(5).collect()
    if broken:
        raise ValueError(f"malformed lines inside {[r.file for r in broken]}")
    whole = spark.read.text(path).where(F.try_parse_json("value").isNotNull())
    return whole.select(F.from_json("value", schema).alias("row")).select("row.*")


def read_inferred(spark: SparkSession, path: str, wanted: str | None = None) -> DataFrame:
    """JSON lines whose columns are found from the lines themselves; with `wanted`, columns that no line has come as typed nulls."""
    found = spark.read.json(path)
    return with_columns(found, wanted) if wanted else found


def zip_members(files: DataFrame, folder: str = "accounts/", endings: tuple[str, ...] = (".xhtml", ".html")) -> DataFrame:
    """(path, member, content): the first member in a folder with one of the endings, of each archive in a binaryFile frame."""
    ship(files.sparkSession)

    def unpack(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for path, raw in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(bytes(raw))) as z:
                    name = next((n for n in z.namelist() if n.startswith(folder) and n.lower().endswith(endings)), None)
                    if name:
                        out.append((path, name, z.read(name)))
            yield pd.DataFrame(out, columns=["path", "member", "content"])

    return files.select("path", "content").mapInPandas(unpack, "path string, member string, content binary")


def _sheet_rows_ods(raw: bytes, sheet: str) -> Iterator[list[str]]:
    table, office, text = ("{urn:oasis:names:tc:opendocument:xmlns:%s:1.0}" % n for n in ("table", "office", "text"))
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ElementTree.fromstring(z.read("content.xml"))
    for own in root.iter(f"{table}table"):
        if own.get(f"{table}name") == sheet:
            for row in own.iter(f"{table}table-row"):
                cells: list[str] = []
                for cell in row:
                    if cell.tag in (f"{table}table-cell", f"{table}covered-table-cell"):
                        value = "\n".join("".join(p.itertext()) for p in cell.iter(f"{text}p")) or cell.get(f"{office}value") or ""
                        cells += [value] * min(int(cell.get(f"{table}number-columns-repeated", "1")), 1024)
                while cells and not cells[-1]:
                    cells.pop()
                if cells:
                    yield cells


def _sheet_rows_xlsx(raw: bytes) -> Iterator[list[str]]:
    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{main}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{main}si")]
        first = min((n for n in z.namelist() if n.startswith("xl/worksheets/sheet")), key=lambda n: (len(n), n))
        root = ElementTree.fromstring(z.read(first))
    for row in root.iter(f"{main}row"):
        cells: dict[int, str] = {}
        for k, cell in enumerate(row.iter(f"{main}c")):
            letters = re.match(r"[A-Z]+", cell.get("r", ""))
            at = k
            if letters:
                at = 0
                for ch in letters[0]:
                    at = at * 26 + ord(ch) - 64
                at -= 1
            value = cell.find(f"{main}v")
            text = "".join(t.text or "" for t in cell.iter(f"{main}t")) if cell.get("t") == "inlineStr" else (value.text or "") if value is not None else ""
            cells[at] = shared[int(text)] if cell.get("t") == "s" and text else text
        if cells:
            yield [cells.get(k, "") for k in range(max(cells) + 1)]


def read_sheet(spark: SparkSession, path: str, columns: list[str], sheet: str | None = None, header: bool = True) -> DataFrame:
    """A worksheet as text columns by header: .ods (by sheet name), .xlsx (first sheet) or .csv, from any path that Spark reads; 'NA' stays text."""
    ship(spark)
    kind = path.rpartition(".")[2].lower()

    def parse(batches):
        import pandas as pd

        for batch in batches:
            for raw in map(bytes, batch["content"]):
                rows = list(_sheet_rows_ods(raw, sheet or "")) if kind == "ods" else list(_sheet_rows_xlsx(raw)) if kind == "xlsx" else list(csv.reader(io.StringIO(raw.decode("utf-8-sig"), newline="")))
                names = rows[0] if header and rows else columns
                body = rows[1:] if header else rows
                at = [names.index(c) if c in names else None for c in columns]
                yield pd.DataFrame([[r[k] if k is not None and k < len(r) else None for k in at] for r in body], columns=columns, dtype=object)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, text_schema(columns))


def parse_bands(text: str) -> list[tuple[int, int | None, float, float, float]]:
    """Checked rows of the band table: ascending, apart, whole and non-negative; a blank upper end is open."""
    names = ["min_employees", "max_employees", "low_gbp", "high_gbp", "midpoint_gbp"]
    reader = csv.DictReader(io.StringIO(text))
    if not set(names) <= set(reader.fieldnames or []):
        raise ValueError(f"bands need the columns {names}")
    rows = []
    for r in reader:
        try:
            low = int(r["min_employees"])
            high = int(r["max_employees"]) if (r["max_employees"] or "").strip() else None
            money = [float(r[c]) for c in names[2:]]
        except (TypeError, ValueError) as e:
            raise ValueError(f"band {r} isn't numeric") from e
        if low < 0 or min(money) < 0 or (high is not None and high < low) or money[0] > money[1]:
            raise ValueError(f"band {r} is negative or inverted")
        rows.append((low, high, *money))
    if not rows:
        raise ValueError("no bands")
    for a, b in zip(rows, rows[1:]):
        if a[1] is None or b[0] <= a[1]:
            raise ValueError(f"bands {a} and {b} overlap")
    return rows


def bands_frame(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(parse_bands(text), "min_employees int, max_employees int, low_gbp double, high_gbp double, midpoint_gbp double")


def number_column(rows: list[list[str]], valid, keys: tuple[str, ...] = ("company number", "company_number", "companynumber", "registration number", "number")) -> tuple[int, int] | None:
    """(column, first data row) of an uploaded sheet: by a header in the first ten rows, else the column with half or more valid numbers."""
    for k, row in enumerate(rows[:10]):
        for j, cell in enumerate(row):
            if str(cell or "").strip().lower() in keys:
                return j, k + 1
    width = max(map(len, rows), default=0)
    shares = [(sum(bool(valid(r[j])) for r in rows if j < len(r)) / max(1, len(rows)), -j) for j in range(width)]
    best = max(shares, default=(0, 0))
    return (-best[1], 0) if best[0] >= 0.5 else None


def listed_numbers(df: DataFrame, column: str) -> DataFrame:
    """Distinct normal forms of a list's numbers, with what was written."""
    return df.select(F.col(column).alias("written"), listed_number(column).alias("company_number"))


def empty_table(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def table_or_empty(spark: SparkSession, name: str, schema: str) -> DataFrame:
    """A catalog table, or an empty one of its schema where it doesn't exist yet."""
    return spark.table(name) if spark.catalog.tableExists(name) else empty_table(spark, schema)


def table_columns(spark: SparkSession, name: str) -> list[tuple[str, str]]:
    """Columns and types of a catalog table, none where it doesn't exist."""
    return spark.table(name).dtypes if spark.catalog.tableExists(name) else []


def from_header(spark: SparkSession, path: str, kinds: dict[str, str] | None = None) -> DataFrame:
    """An empty table with the columns of a file that has only a header; text unless `kinds` says otherwise."""
    names = spark.read.csv(path, header=True).columns
    return empty_table(spark, ", ".join(f"`{n}` {(kinds or {}).get(n, 'string')}" for n in names))


def migrated(df: DataFrame, renames: dict[str, str], schema: str, references: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """A table of an older shape in the present one: columns renamed where only the old name is there, missing ones added as typed nulls.

    `references` (column to a frame and its key) sets values that name no row of the other table to null.
    """
    for old, new in renames.items():
        if old in df.columns:
            df = df.withColumnRenamed(old, new) if new not in df.columns else df.withColumn(new, F.coalesce(new, old)).drop(old)
    df = with_columns(df, schema)
    for column, (other, key) in (references or {}).items():
        known = other.select(F.col(key).alias("_known")).where("_known is not null").distinct()
        df = df.join(known, F.col(column) == F.col("_known"), "left").withColumn(column, F.col("_known")).drop("_known")
    return df


def with_columns(df: DataFrame, schema: str) -> DataFrame:
    """Additive migration: missing columns come as typed nulls, after those that are there."""
    wanted = T._parse_datatype_string(schema)
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in wanted if f.name not in df.columns}) if any(f.name not in df.columns for f in wanted) else df
