"""Tables as CSV, Parquet or JSON; the format follows the file name unless given."""

from __future__ import annotations

import os.path
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuespark.functions.vectors import feature_columns, pack

FORMATS = ("csv", "parquet", "json")

# CSV cells read as missing.
MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

_CSV = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def format_of(path: str, fmt: str | None = None) -> str:
    chosen = (fmt or os.path.splitext(path.rstrip("/"))[1].lstrip(".")).lower()
    if chosen not in FORMATS:
        raise ValueError(f"Unsupported file format: {chosen or path!r}; use one of {FORMATS}")
    return chosen


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    schema: T.StructType | None = None,
    multiline: bool = True,
) -> DataFrame:
    """Read a table; FileNotFoundError if there is none.

    CSV: without a schema every column is a string, with one cells are cast by column name.
    Quoted line feeds need `multiline`, which makes every file one task: turn it off for big
    files without them, and keep large tables as Parquet.
    """
    chosen = format_of(path, fmt)
    try:
        if chosen == "csv":
            return _read_csv(spark, path, schema, multiline)
        reader = spark.read if schema is None else spark.read.schema(schema)
        return getattr(reader, chosen)(path)
    except Exception as problem:
        if "PATH_NOT_FOUND" in str(problem):
            raise FileNotFoundError(f"File not found: {path}") from problem
        raise


def _read_csv(spark, path: str, schema: T.StructType | None, multiline: bool) -> DataFrame:
    raw = spark.read.options(multiLine=str(multiline).lower(), **_CSV).csv(path)

    def cell(name: str) -> Column:
        value = F.col(f"`{name}`")
        return F.when(~value.isin(MISSING), value)

    if schema is None:
        return raw.select(*[cell(c).alias(c) for c in raw.columns])
    lost = [f.name for f in schema if f.name not in raw.columns]
    if lost:
        raise ValueError(f"Columns {lost} not found; available columns: {raw.columns}")
    return raw.select(*[cell(f.name).cast(f.dataType).alias(f.name) for f in schema])


def write_table(
    df: DataFrame,
    path: str,
    fmt: str | None = None,
    mode: str = "overwrite",
    partition_by: list[str] | None = None,
) -> None:
    """Write a table, without index column, creating parent folders."""
    chosen = format_of(path, fmt)
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if chosen == "csv":
        writer = writer.options(**_CSV)
    getattr(writer, chosen)(path)


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a small report table as one JSON file; NULL fields are kept.

    The rows are shuffled into one task; what makes them keeps its own tasks.
    """
    df.repartition(1).write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_report(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    pretty: bool = False,
) -> DataFrame:
    """Read a JSON report: one object per line as written here, or a `pretty`-printed file."""
    reader = spark.read.option("multiLine", str(pretty).lower())
    try:
        return (reader if schema is None else reader.schema(schema)).json(path)
    except Exception as problem:
        if "PATH_NOT_FOUND" in str(problem):
            raise FileNotFoundError(f"File not found: {path}") from problem
        raise


def import_wide_embeddings(
    spark: SparkSession, folder: str, pattern: str = "*.csv", multiline: bool = True
) -> tuple[DataFrame, dict[str, str]]:
    """All wide embedding files of a folder as one table with `method` and `embedding`.

    One file, or one folder that Spark has written, is one method, named by its stem.  Unusable files
    are skipped and returned with the reason; a cell that is no number is NULL in its vector (see
    `lost_cells`).  Without `multiline` large files are cut into tasks (see `read_table`).
    """
    options = {"pathGlobFilter": pattern, "recursiveFileLookup": "true"}
    listing = spark.read.format("binaryFile").options(**options).load(folder)
    root = os.path.basename(folder.rstrip("/"))
    below = F.substring_index("path", f"/{root}/", -1)
    named = listing.select(F.substring_index(below, "/", 1).alias("name")).distinct()
    tables, skipped = [], {}
    for name in sorted(r["name"] for r in named.collect()):  # one row per method
        method = os.path.splitext(name)[0]
        try:
            wide = read_table(spark, f"{folder.rstrip('/')}/{name}", "csv", multiline=multiline)
            numbers = feature_columns(wide)
            packed = pack(wide, numbers)
            cells = F.transform("embedding", lambda x: x.try_cast("float"))
            usable = packed.filter(F.exists(cells, lambda x: x.isNotNull()))
            if usable.isEmpty():
                raise ValueError("no cell of its embedding columns is a number")
            tables.append(packed.withColumns({"embedding": cells, "method": F.lit(method)}))
        except Exception as problem:
            skipped[method] = str(problem).splitlines()[0]
    if not tables:
        raise ValueError(f"no usable embedding files in {folder}: {skipped}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables), skipped


def lost_cells(df: DataFrame) -> DataFrame:
    """(method, lost_cells): cells of an imported table that are missing or were no number."""
    lost = F.size(F.filter("embedding", lambda x: x.isNull()))
    return df.groupBy("method").agg(F.sum(lost).cast("bigint").alias("lost_cells"))


def write_embeddings(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One Parquet folder per method, so that a method is read without the others."""
    df.write.mode(mode).partitionBy("method").parquet(path)


def method_catalog(df: DataFrame) -> DataFrame:
    """Methods of an embedding table with their size and dimension."""
    return df.groupBy("method").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.size("embedding")).cast("bigint").alias("min_dimension"),
        F.max(F.size("embedding")).cast("bigint").alias("max_dimension"),
    )
