"""Tolerant equality of two column values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

TOLERANCE = 1e-4


def values_match(a: Column, b: Column, a_type: T.DataType, b_type: T.DataType, tolerance: float = TOLERANCE) -> Column:
    """True when both values are null, equal, or numbers closer than ``tolerance``.

    Values of one exact type compare natively, so the hot path needs no text
    form. Everything else compares as text first and as whole-value numbers
    second: ``12abc`` is no number, so it never matches ``12xyz``.
    """
    exact = (T.IntegralType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)
    if a_type == b_type and isinstance(a_type, exact):
        return a.eqNullSafe(b)
    whole = (T.IntegralType, T.DecimalType)
    if isinstance(a_type, whole) and isinstance(b_type, whole):
        # Exact types are subtracted exactly; a difference that no decimal holds is no near one.
        wide = [c.cast("decimal(20,0)") if isinstance(t, T.IntegralType) else c for c, t in ((a, a_type), (b, b_type))]
        near = F.abs(F.try_subtract(*wide)) < F.lit(tolerance).cast("decimal(18,12)")
        return a.eqNullSafe(b) | F.coalesce(near, F.lit(False))
    if isinstance(a_type, T.NumericType) and isinstance(b_type, T.NumericType):
        near = F.abs(a.cast("double") - b.cast("double")) < F.lit(tolerance)
        return a.eqNullSafe(b) | F.coalesce(near, F.lit(False))
    ta, tb = a.cast("string"), b.cast("string")
    near = F.abs(ta.try_cast("double") - tb.try_cast("double")) < F.lit(tolerance)
    return ta.eqNullSafe(tb) | F.coalesce(near, F.lit(False))
