"""Identifier quoting, export names and high-water text."""

from __future__ import annotations

import os
import re
import tempfile
from datetime import datetime

from pyspark.sql import Column, functions as F

# Fixed value: everything but ASCII letters and digits and the two common CJK blocks.
_UNSAFE = re.compile("[^a-zA-Z0-9一-鿿㐀-䶿]+")


def quote_name(name: str, dialect: str) -> str:
    """Quote one identifier; quote characters inside it are doubled."""
    dialect = dialect.lower()
    if dialect in ("mysql", "doris"):
        return "`" + name.replace("`", "``") + "`"
    if dialect == "postgresql":
        return '"' + name.replace('"', '""') + '"'
    if dialect == "oracle":
        return '"' + name.upper().replace('"', '""') + '"'
    return name


def quote_column(name: Column, dialect: str) -> Column:
    """``quote_name`` over a column of names."""
    dialect = dialect.lower()
    if dialect in ("mysql", "doris"):
        return F.concat(F.lit("`"), F.replace(name, F.lit("`"), F.lit("``")), F.lit("`"))
    if dialect == "postgresql":
        return F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))
    if dialect == "oracle":
        return F.concat(F.lit('"'), F.replace(F.upper(name), F.lit('"'), F.lit('""')), F.lit('"'))
    return name


def safe_name(name: str) -> str:
    return _UNSAFE.sub("-", name).strip("-") or "export"


def export_path(base: str, job: str, now: datetime) -> str:
    """``<dir>/<safe job name>-<yyyymmdd-hhmmss>.csv``.

    A base with a file extension stands for its parent directory; a blank base
    falls back to the machine's temp directory, which only suits a local run,
    so cluster jobs name a shared directory.
    """
    folder = os.path.dirname(base) if os.path.splitext(base)[1] else base
    return os.path.join(folder or tempfile.gettempdir(), f"{safe_name(job)}-{now:%Y%m%d-%H%M%S}.csv")


def high_water_text(value) -> str:
    """UTC timestamp or whole number as text; timestamps keep their fraction."""
    if isinstance(value, datetime):
        return value.isoformat(timespec="microseconds") + "Z"
    return "" if value is None else str(value)
