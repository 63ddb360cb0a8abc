"""Column builders: stable texts and keys, windows of months, guarded ratios, tolerant columns."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL_TEXT = "__null__"
#: Several entries, so that a key's parts can't run into one another.
SEPARATOR = "||"


def stable_text(c: Column | str) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(NULL_TEXT))


def stable_time(c: Column | str) -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(NULL_TEXT))


def stable_number(c: Column | str, decimals: int) -> Column:
    """Fixed decimals; a null gives the null text, not a formatted one.

    Ordinary numbers go through a decimal, which rounds the same digits the same way (half up) at less than half the
    cost; the formatter takes those that a decimal can't hold or would strip of their sign."""
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    ordinary = F.abs(c).between(10.0**-decimals, 1e12)
    plain = c.cast(f"decimal({decimals + 14},{decimals})").cast("string")
    return F.when(c.isNull(), NULL_TEXT).when(ordinary, plain).otherwise(F.format_string(f"%.{decimals}f", c))


def stable_key(*texts: Column) -> Column:
    return F.sha2(F.concat_ws(SEPARATOR, *texts), 256)


def month_bounds(year: int | None, month: int | None) -> tuple[date, date] | None:
    """First days of the month and of the next; None without a window; one of the two alone is an error."""
    if year is None and month is None:
        return None
    if year is None or month is None:
        raise ValueError("year and month go together")
    return date(year, month, 1), date(year + month // 12, month % 12 + 1, 1)


def in_month(c: str, year: int | None, month: int | None, kind: str = "date") -> Column:
    """A half-open range of literals, which reaches the scan."""
    bounds = month_bounds(year, month)
    if bounds is None:
        return F.lit(True)
    first, after = (F.lit(d).cast(kind) for d in bounds)
    return (F.col(c) >= first) & (F.col(c) < after)


def guarded_ratio(a: Column, b: Column, kind: str = "decimal(18,2)") -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b).cast(kind)


def clean_id(c: str) -> Column:
    """Trimmed text; an empty one is null."""
    return F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))


def safe_col(df: DataFrame, name: str, default: float = 0.0) -> Column:
    """A number column, or the default where the column or its value is missing."""
    return F.coalesce(F.col(name).try_cast("double"), F.lit(float(default))) if name in df.columns else F.lit(float(default))


def date_key(c: str) -> Column:
    return F.date_format(c, "yyyyMMdd").cast("int")


def require(df: DataFrame, columns: Iterable[str], where: str = "input") -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"Missing required columns in {where}: {missing}")


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """All keys equal, nulls to nulls."""
    found = F.lit(True)
    for k in keys:
        found &= left[k].eqNullSafe(right[k])
    return found


def count_where(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))
