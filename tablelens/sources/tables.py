"""Reading tables: text files as strings, columnar files as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.config.domains import supported_domains
from tablelens.errors import ProfileError
from tablelens.functions.text import null_if_missing, quoted

FORMATS = ("csv", "parquet", "orc", "json")


def read_csv(spark: SparkSession, path, sep: str = ",", encoding: str = "UTF-8", multiLine: bool = False,
             check_breaks: bool = True, **options) -> DataFrame:
    """A CSV with header; every column a string, missing tokens null.

    Files are split over many tasks.  With ``multiLine`` values may hold line
    breaks, and each file is read by one task.  Without it such a value would
    make two rows, so files that hold one are refused; the check reads the lines
    once more and ends at the first such line.  ``check_breaks=False`` spares it
    where they are known not to occur.
    """
    if check_breaks and not multiLine and encoding.upper() in _QUOTES_AS_ASCII:
        refuse_broken_rows(spark, path)
    df = spark.read.csv(path, header=True, inferSchema=False, sep=sep, encoding=encoding, quote='"', escape='"',
                        multiLine=multiLine, **options)
    return missing_to_null(df)


# Encodings that write a quote as ASCII does, so that lines can be checked as they are.
_QUOTES_AS_ASCII = ["UTF-8", "UTF8", "US-ASCII", "ASCII", "ISO-8859-1", "LATIN1", "WINDOWS-1252", "CP1252"]


def refuse_broken_rows(spark: SparkSession, path) -> None:
    """Refuse text files in which a quoted value runs on to the next line: a line with an odd number of quotes."""
    value = F.col("value")
    quotes = F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))
    broken = spark.read.text(path).where(quotes % 2 == 1).limit(1).collect()
    if broken:
        raise ProfileError("QUOTED_LINE_BREAK", "a quoted value holds a line break; read the file with multiLine=True",
                           {"path": str(path), "line": broken[0]["value"][:200]})


def missing_to_null(df: DataFrame) -> DataFrame:
    """Null for every spelling of a missing value in the string columns."""
    return df.select([
        null_if_missing(F.col(quoted(f.name))).alias(f.name) if isinstance(f.dataType, T.StringType)
        else F.col(quoted(f.name))
        for f in df.schema.fields
    ])


def read_table(spark: SparkSession, path: str, format: str | None = None, max_mb: float | None = None, **options) -> DataFrame:
    """Any supported format by name or file extension; with ``max_mb`` no file may be empty or larger."""
    chosen = format or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if chosen == "table":
        return spark.table(path)
    if chosen not in FORMATS:
        raise ProfileError("UNSUPPORTED_FILE_TYPE", f"cannot read {chosen!r}", {"allowed": list(FORMATS) + ["table"]})
    if max_mb is not None:
        check_file_sizes(spark, path, max_mb)
    if chosen == "csv":
        return read_csv(spark, path, **options)
    return spark.read.format(chosen).options(**options).load(path)


def check_file_sizes(spark: SparkSession, path: str, max_mb: float | None = None) -> None:
    """Refuse empty files, and files over a limit where one is set; reads file listings only."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    worst = files.agg(F.min("length").alias("smallest"), F.max("length").alias("largest")).first()
    if not worst["smallest"]:
        raise ProfileError("EMPTY_FILE", "a file is empty", {"path": path})
    if max_mb is not None and worst["largest"] > max_mb * 1024 * 1024:
        raise ProfileError("FILE_SIZE_EXCEEDED", "a file is larger than the limit",
                           {"actual_bytes": worst["largest"], "maximum_bytes": int(max_mb * 1024 * 1024)})


def check_table(df: DataFrame, max_rows: int | None = None, max_columns: int | None = None) -> DataFrame:
    """Refuse empty tables, and tables over a limit where one is set."""
    if not df.columns:
        raise ProfileError("EMPTY_DATASET", "the table has no columns")
    if max_columns is not None and len(df.columns) > max_columns:
        raise ProfileError("DATASET_COLUMN_LIMIT_EXCEEDED", "the table has too many columns",
                           {"actual_columns": len(df.columns), "maximum_columns": max_columns})
    if df.isEmpty():
        raise ProfileError("NO_DATA_ROWS", "the table has columns but no rows", {"columns": len(df.columns)})
    # a limit is an int; beyond it there is nothing to save by stopping early
    if max_rows is not None and (df.limit(max_rows + 1) if max_rows < 2**31 - 1 else df).count() > max_rows:
        raise ProfileError("DATASET_ROW_LIMIT_EXCEEDED", "the table has too many rows", {"maximum_rows": max_rows})
    return df


def check_domain(domain: str) -> str:
    if domain not in supported_domains():
        raise ProfileError("UNSUPPORTED_DOMAIN", f"domain {domain!r} is not supported",
                           {"domain": domain, "supported": supported_domains()})
    return domain
