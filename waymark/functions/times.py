"""Time columns as numbers in the same order, whatever the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T


def micros(column: Column, kind: T.DataType) -> Column:
    """Microseconds of a TIMESTAMP, or of the wall clock of a TIMESTAMP_NTZ."""
    if isinstance(kind, T.TimestampNTZType):
        seconds = F.hour(column) * 3600 + F.minute(column) * 60
        fraction = (F.extract(F.lit("SECOND"), column) * 1_000_000).cast("bigint")
        return (F.unix_date(column.cast("date")).cast("bigint") * 86_400 + seconds) * 1_000_000 + fraction
    return F.unix_micros(column)
