"""Readers for raw tables and written snapshots."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from parcelsight.sources.quoted_csv import read_quoted_csv
from parcelsight.sources.schemas import RAW_SCHEMAS
from parcelsight.sources.tables import RawTables


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is a missing marker in the raw files; keep only NULL."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if not floats:
        return df
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def _csv_text(spark: SparkSession, path: str, name: str) -> DataFrame:
    """All columns of a CSV file as text, named by its header.

    Quoted review texts contain line breaks; such files are cut into records range by range.
    """
    if name == "reviews":
        return read_quoted_csv(spark, path)
    return spark.read.option("header", True).option("escape", '"').csv(path)


def read_raw(spark: SparkSession, directory: str, name: str, fmt: str = "csv",
             file_name: str | None = None, malformed: str = "fail") -> DataFrame:
    """One raw table with its declared schema, from CSV (with header) or Parquet.

    CSV columns are found by the names in the header, in any order; more columns than declared are not
    read. A value that is not of its column's type stops the job, or is NULL with ``malformed="null"``
    (``malformed_counts`` says how many there are).
    """
    schema = RAW_SCHEMAS[name]
    path = f"{directory.rstrip('/')}/{file_name or f'{name}.{fmt}'}"
    if fmt == "csv":
        if malformed not in ("fail", "null"):
            raise ValueError(f"unknown treatment of malformed values: {malformed}")
        text = _csv_text(spark, path, name)
        convert = (lambda c, kind: F.col(c).try_cast(kind)) if malformed == "null" else (
            lambda c, kind: F.col(c).cast(kind))
        return nan_to_null(text.select(*[convert(f.name, f.dataType).alias(f.name) for f in schema]))
    if fmt == "parquet":
        return nan_to_null(spark.read.schema(schema).parquet(path))
    raise ValueError(f"unsupported raw format: {fmt}")


def malformed_counts(spark: SparkSession, directory: str, name: str,
                     file_name: str | None = None) -> DataFrame:
    """How many values of each CSV column are not of its declared type."""
    text = _csv_text(spark, f"{directory.rstrip('/')}/{file_name or f'{name}.csv'}", name)
    odd = [F.count_if(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull())
           .alias(f.name) for f in RAW_SCHEMAS[name]]
    return text.agg(*odd).unpivot([], [f.name for f in RAW_SCHEMAS[name]], "column", "malformed")


def convert_to_parquet(spark: SparkSession, directory: str, target: str, name: str, **options) -> DataFrame:
    """A CSV table written as Parquet, which any number of tasks can read, and read back."""
    path = f"{target.rstrip('/')}/{name}.parquet"
    read_raw(spark, directory, name, **options).write.mode("overwrite").parquet(path)
    return read_raw(spark, target, name, "parquet")


def read_all_raw(spark: SparkSession, directory: str, fmt: str = "csv",
                 file_names: dict[str, str] | None = None) -> RawTables:
    names = file_names or {}
    return RawTables(**{
        name: read_raw(spark, directory, name, fmt, names.get(name)) for name in RAW_SCHEMAS
    })


def read_snapshot(spark: SparkSession, path: str, produced_by: str) -> DataFrame:
    """A processed snapshot; say which step writes it when it is missing."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as err:
        if "PATH_NOT_FOUND" in str(err):
            raise FileNotFoundError(
                f"{path} does not exist: run {produced_by} first to write it"
            ) from err
        raise
