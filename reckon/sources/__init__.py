"""Sources of settlement rows: CSV and TSV, JSON, XLSX, staged pages."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession

from . import files, xlsx


def read_rows(spark: SparkSession, path: str, start_row: int = 1, sheet: str | int = 0) -> DataFrame:
    """row (physical, from 1), ordinal (of kept rows, from ``start_row``) and cells of a file, by its suffix."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix in (".csv", ".tsv"):
        return files.read_delimited(spark, path, "\t" if suffix == ".tsv" else ",", start_row)
    if suffix == ".json":
        return files.read_json(spark, path)
    if suffix in (".xlsx", ".xlsm"):
        return xlsx.read_workbook(spark, path, sheet, start_row)
    raise ValueError(f"no reader for {suffix or 'a file without suffix'}")


def raw_rows(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """file, row and cells of all rows of a file, by its suffix, before any of them is left out."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix in (".csv", ".tsv"):
        return files.delimited(spark, path, "\t" if suffix == ".tsv" else ",")
    if suffix in (".xlsx", ".xlsm"):
        return xlsx.workbook(spark, path, sheet)
    return read_rows(spark, path)
