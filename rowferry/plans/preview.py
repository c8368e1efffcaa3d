"""Preview and export of a job's parameterised query."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from rowferry.functions.names import export_path
from rowferry.model import JobSpec
from rowferry.operators.paging import PreviewPage, preview
from rowferry.plans.jobs import query_rows
from rowferry.session import shared_dir
from rowferry.sources import files

EXPORT_FORMATS = ("csv", "excel")


def eligible(spec: JobSpec) -> bool:
    """Only SQL imports whose target is a file, or not set, can be previewed."""
    return spec.kind == "sql_import" and spec.target.kind.lower() in ("csv", "excel", "")


def preview_job(spark: SparkSession, spec: JobSpec, runtime: Mapping[str, str] | None = None, page: int = 1, page_size: int = 0, order_by: Sequence[str] = (), largest: int | None = None) -> PreviewPage:
    """A page of the job's query: in the order named, else in the query's own, else in that of all its columns."""
    _require(spec)
    return preview(query_rows(spark, spec, runtime), page, page_size, order_by, largest)


def export_job(spark: SparkSession, spec: JobSpec, runtime: Mapping[str, str] | None = None, fmt: str = "csv", now: datetime | None = None) -> str:
    """Write the whole result as a CSV folder ``<job>-preview-<time>``; returns its path.

    Both formats the reports offer are accepted; the output is CSV for either,
    as a workbook cannot hold a result of any size.
    """
    _require(spec)
    if fmt.strip().lower() not in EXPORT_FORMATS:
        raise ValueError(f"unsupported export format: {fmt}")
    rows = query_rows(spark, spec, runtime)
    path = export_path(spec.target.path or shared_dir(spark), f"{spec.name}-preview", now or datetime.now(timezone.utc))
    return files.write_csv(rows, path, rows.columns)


def _require(spec: JobSpec) -> None:
    if not eligible(spec):
        raise ValueError("only a SQL import with a file target has a result page")
