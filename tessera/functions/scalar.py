"""Scalar functions, all of them built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[\s\p{Z}\x{85}]+"


def upper(c: Column) -> Column:
    return F.upper(c)


def lower(c: Column) -> Column:
    return F.lower(c)


def length(c: Column) -> Column:
    """Bytes of UTF-8; char_length counts characters."""
    return F.octet_length(c)


def char_length(c: Column) -> Column:
    return F.char_length(c)


def substring(c: Column, start: int, size: int | None = None) -> Column:
    """Characters from start, the first being 1."""
    return F.substring(c, start, 2**31 - 1 if size is None else size)


def concat(*cs: Column) -> Column:
    return F.concat(*cs)


def ltrim(c: Column) -> Column:
    return F.regexp_replace(c, "^" + _SPACE, "")


def rtrim(c: Column) -> Column:
    return F.regexp_replace(c, _SPACE + "$", "")


def trim(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return rtrim(ltrim(c))


def absolute(c: Column) -> Column:
    return F.abs(c)


def rounded(c: Column, digits: int = 0) -> Column:
    """Half away from zero, by scaling."""
    return F.round(c.cast("double") * 10.0**digits) / 10.0**digits


def ceil(c: Column) -> Column:
    return F.ceil(c).cast("double")


def floor(c: Column) -> Column:
    return F.floor(c).cast("double")


def power(c: Column, e: float) -> Column:
    return F.pow(c, F.lit(float(e)))


def sqrt(c: Column) -> Column:
    return F.sqrt(c.cast("double"))


def now() -> Column:
    return F.current_timestamp()


def date(c: Column) -> Column:
    return F.to_date(c)


def date_parts(c: Column) -> dict[str, Column]:
    return {"year": F.year(c).cast("long"), "month": F.month(c).cast("long"), "day": F.dayofmonth(c).cast("long")}


def date_add(c: Column, n: int, unit: str) -> Column:
    months = {"MONTH": n, "YEAR": 12 * n}
    if unit.upper() == "DAY":
        return F.date_add(F.to_date(c), n)
    return F.add_months(F.to_date(c), months[unit.upper()])


def date_diff(a: Column, b: Column) -> Column:
    return F.datediff(a, b).cast("long")


def cast(c: Column, to: str) -> Column:
    kinds = {"INTEGER": "bigint", "INT": "bigint", "FLOAT": "double", "DOUBLE": "double", "VARCHAR": "string", "TEXT": "string"}
    if to.upper() in ("BOOLEAN", "BOOL"):
        return truth(c)
    if kinds[to.upper()] in ("bigint", "double"):
        return c.try_cast(kinds[to.upper()])
    return c.cast(kinds[to.upper()])


def truth(c: Column) -> Column:
    """Numbers are true unless they are 0; texts if they say true, 1 or yes, in any case."""
    number = c.cast("string").try_cast("double")
    said = F.lower(c.cast("string"))
    return F.when(F.typeof(c) == "string", said.isin("true", "1", "yes")).otherwise(F.when(F.typeof(c) == "boolean", said == "true").otherwise(number != 0))


def json_path(c: Column, path: str) -> Column:
    return F.get_json_object(c, "$." + path)


def json_exists(c: Column, path: str) -> Column:
    return json_path(c, path).isNotNull()


def array_has(c: Column, value: object) -> Column:
    return F.array_contains(c, value)


def array_meets(c: Column, values: list[object]) -> Column:
    """Whether the array holds any of the values."""
    return F.arrays_overlap(c, F.array(*map(F.lit, values)))


def array_distinct(c: Column) -> Column:
    return F.array_distinct(c)


def array_sorted(c: Column) -> Column:
    return F.array_sort(c)


def array_joined(c: Column, by: str) -> Column:
    return F.array_join(c, by)


def array_size(c: Column) -> Column:
    return F.array_size(c)


def map_keys(c: Column) -> Column:
    return F.map_keys(c)


def map_values(c: Column) -> Column:
    return F.map_values(c)


def map_get(c: Column, key: object) -> Column:
    return F.try_element_at(c, F.lit(key))
