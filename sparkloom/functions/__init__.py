"""Column functions that Spark lacks or names differently."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def array_sum(c: Column | str) -> Column:
    """Sum of an array's values as double; nulls are left out, an empty array gives 0."""
    return F.aggregate(F.filter(_col(c), lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + x)


def array_mean(c: Column | str) -> Column:
    """Mean of an array's values that aren't null; null without any."""
    some = F.filter(_col(c), lambda x: x.isNotNull())
    return F.when(F.size(some) > 0, array_sum(some) / F.size(some))


def map_filter_value_gt(c: Column | str, limit: float) -> Column:
    """Entries whose value is over a limit."""
    return F.map_filter(_col(c), lambda k, v: v > limit)


def zip_with_coalesce(a: Column | str, b: Column | str) -> Column:
    """The first of two arrays' values that isn't null, place by place."""
    return F.zip_with(_col(a), _col(b), lambda x, y: F.coalesce(x, y))


def map_zip_with_coalesce(a: Column | str, b: Column | str) -> Column:
    """All keys of two maps; the first map's value wins unless null."""
    return F.map_zip_with(_col(a), _col(b), lambda k, x, y: F.coalesce(x, y))


def map_get(c: Column | str, key) -> Column:
    """A map's value for a key, null without one in any mode."""
    return F.try_element_at(_col(c), F.lit(key))


def timestamp_add(unit: str, n: int, c: Column | str) -> Column:
    """A timestamp moved by calendar-aware units."""
    return F.timestamp_add(unit.upper(), F.lit(n), _col(c))


def replace_many(c: Column | str, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements, one after the other."""
    out = _col(c)
    for old, new in pairs:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def days(n: Column | int) -> Column:
    """A day interval."""
    return F.make_dt_interval(n if isinstance(n, Column) else F.lit(n))


def months(n: Column | int) -> Column:
    """A month interval."""
    return F.make_ym_interval(F.lit(0), n if isinstance(n, Column) else F.lit(n))


def bitwise(a: Column | str, op: str, b: Column | str) -> Column:
    """Row-wise and, or, xor of two columns."""
    a, b = _col(a), _col(b)
    return {"and": a.bitwiseAND, "or": a.bitwiseOR, "xor": a.bitwiseXOR}[op](b)
