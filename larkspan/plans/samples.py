"""Texts dealt to rows by a number, as a column and as SQL, for queries of rules that the driver's tables don't exercise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(value) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def dealt(key: str, options: list, every: int = 1) -> Column:
    """options[(key div every) mod their number]."""
    kind = "string" if any(isinstance(o, str) for o in options) else "double" if any(isinstance(o, float) for o in options) else "int"
    place = F.floor(F.col(key) / every) % len(options) + 1
    return F.element_at(F.array(*[F.lit(o).cast(kind) for o in options]), place.cast("int"))


def dealt_sql(key: str, options: list, every: int = 1) -> str:
    return f"[{', '.join(quoted(o) for o in options)}][({key} // {every}) % {len(options)} + 1]"


def joined(parts: list[str]) -> str:
    """SQL of a list's filled entries, joined by semicolons."""
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL), '; ')"
