"""Row checks as columns: each builder returns a boolean column that is true where a row fails.

A NULL value passes a check unless the check itself is about NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.common import as_ts
from tallyframe.functions import validators as V


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _sure(cond: Column) -> Column:
    """Unknown counts as not failed."""
    return F.coalesce(cond, F.lit(False))


# ---- null and empty ----

def is_not_null(column):
    return _c(column).isNull()


def is_null(column):
    return _c(column).isNotNull()


def is_not_empty(column):
    return _sure(_c(column).cast("string") == "")


def is_empty(column):
    return _sure(_c(column).cast("string") != "")


def is_not_null_and_not_empty(column):
    c = _c(column)
    return c.isNull() | (c.cast("string") == "")


def is_null_or_empty(column):
    return _sure(_c(column).cast("string") != "")


def is_not_null_and_not_empty_array(column):
    c = _c(column)
    return c.isNull() | (F.size(c) <= 0)


# ---- values ----

def is_in_list(column, allowed: Sequence):
    return _sure(~_c(column).isin(list(allowed)))


def is_not_in_list(column, not_allowed: Sequence):
    return _sure(_c(column).isin(list(not_allowed)))


def is_not_null_and_is_in_list(column, allowed: Sequence):
    c = _c(column)
    return c.isNull() | ~c.isin(list(allowed))


def is_equal_to(column, value):
    return _sure(_c(column) != F.lit(value))


def is_not_equal_to(column, value):
    return _sure(_c(column) == F.lit(value))


# ---- ranges ----

def is_in_range(column, min_limit, max_limit):
    return _sure(~_c(column).between(min_limit, max_limit))


def is_not_in_range(column, min_limit, max_limit):
    return _sure(_c(column).between(min_limit, max_limit))


def is_not_less_than(column, limit):
    return _sure(_c(column) < limit)


def is_not_greater_than(column, limit):
    return _sure(_c(column) > limit)


# ---- formats ----

def regex_match(column, pattern: str, negate: bool = False):
    hit = _c(column).rlike(pattern)
    return _sure(hit if negate else ~hit)


def _parsed(column, kind: str, fmt: str | None) -> Column:
    c = _c(column)
    return F.try_to_timestamp(c, F.lit(fmt)) if fmt else c.try_cast(kind)


def is_valid_date(column, date_format: str | None = None):
    return _c(column).isNotNull() & _parsed(column, "date", date_format).isNull()


def is_valid_timestamp(column, timestamp_format: str | None = None):
    return _c(column).isNotNull() & _parsed(column, "timestamp", timestamp_format).isNull()


def is_valid_json(column):
    c = _c(column)
    return c.isNotNull() & F.try_parse_json(c).isNull()


def has_json_keys(column, keys: Sequence[str], require_all: bool = True):
    c = _c(column)
    have = F.json_object_keys(c)
    want = F.array(*[F.lit(k) for k in keys])
    ok = F.size(F.array_except(want, have)) == 0 if require_all else F.arrays_overlap(want, have)
    return c.isNotNull() & ~F.coalesce(ok, F.lit(False))


def has_valid_json_schema(column, schema: str):
    """The value must parse with the given schema (DDL text); fields of another type fail."""
    c = _c(column)
    parsed = F.from_json(c, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return c.isNotNull() & (parsed.isNull() | parsed.getField("_bad").isNotNull())


def is_valid_ipv4_address(column):
    return _c(column).isNotNull() & ~_sure(V.ipv4(_c(column)))


def is_valid_ipv6_address(column):
    return _c(column).isNotNull() & ~_sure(V.ipv6(_c(column)))


def is_ipv4_address_in_cidr(column, cidr: str):
    return _c(column).isNotNull() & ~_sure(V.ipv4_in_cidr(_c(column), cidr))


def is_ipv6_address_in_cidr(column, cidr: str):
    return _c(column).isNotNull() & ~_sure(V.ipv6_in_cidr(_c(column), cidr))


# ---- time ----

def is_not_in_future(column, as_of, offset_seconds: int = 0):
    return _sure(_c(column).cast("timestamp_ntz") > as_ts(as_of) + F.make_dt_interval(secs=F.lit(offset_seconds)))


def is_not_in_near_future(column, as_of, offset_seconds: int):
    c, now = _c(column).cast("timestamp_ntz"), as_ts(as_of)
    return _sure((c > now) & (c < now + F.make_dt_interval(secs=F.lit(offset_seconds))))


def is_older_than_n_days(column, days: int, as_of):
    return _sure(F.datediff(as_ts(as_of), _c(column)) <= days)


def is_older_than_col2_for_n_days(column, column2, days: int):
    return _sure(F.datediff(_c(column2), _c(column)) < days)


def is_data_fresh(column, max_age_minutes: int, as_of):
    return _sure(_c(column).cast("timestamp_ntz") < as_ts(as_of) - F.make_dt_interval(mins=F.lit(max_age_minutes)))


# ---- privacy ----

def does_not_contain_pii(column, types: Sequence[str] | None = None):
    from tallyframe.functions.pii import TEXT_PATTERNS, text_spans

    found = F.lit(0)
    for t in types or TEXT_PATTERNS:
        found = found + text_spans(_c(column), t)
    return _sure(found > 0)


# ---- free expressions ----

def sql_expression(expression: str, negate: bool = False):
    """A condition that must hold (or, negated, must not); unknown passes."""
    e = F.expr(expression)
    return _sure(e if negate else ~e)


# ---- places ----

def is_latitude(column):
    return _sure(~_c(column).cast("double").between(-90.0, 90.0))


def is_longitude(column):
    return _sure(~_c(column).cast("double").between(-180.0, 180.0))


def is_not_null_island(lat, lon):
    return _sure((_c(lat) == 0) & (_c(lon) == 0))


_NUM = r"[-+]?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?"
_POS = rf"{_NUM}( +{_NUM}){{1,3}}"
_LIST = rf"\( *{_POS}( *, *{_POS})* *\)"
_DIM = r"( +(Z|M|ZM))? *"
_WKT = {
    "POINT": rf"POINT{_DIM}(EMPTY|\( *{_POS} *\))",
    "LINESTRING": rf"LINESTRING{_DIM}(EMPTY|{_LIST})",
    "POLYGON": rf"POLYGON{_DIM}(EMPTY|\( *{_LIST}( *, *{_LIST})* *\))",
    "MULTIPOINT": rf"MULTIPOINT{_DIM}(EMPTY|{_LIST}|\( *\( *{_POS} *\)( *, *\( *{_POS} *\))* *\))",
    "MULTILINESTRING": rf"MULTILINESTRING{_DIM}(EMPTY|\( *{_LIST}( *, *{_LIST})* *\))",
    "MULTIPOLYGON": rf"MULTIPOLYGON{_DIM}(EMPTY|\( *\( *{_LIST}( *, *{_LIST})* *\)( *, *\( *{_LIST}( *, *{_LIST})* *\))* *\))",
}


def _wkt(column, kinds: Sequence[str]) -> Column:
    body = "|".join(_WKT[k] for k in kinds)
    return F.upper(F.trim(_c(column))).rlike(f"^({body})$")


def is_point(column):
    return _sure(~_wkt(column, ["POINT"]))


def is_linestring(column):
    return _sure(~_wkt(column, ["LINESTRING"]))


def is_polygon(column):
    return _sure(~_wkt(column, ["POLYGON"]))


def is_geometry(column):
    return _sure(~_wkt(column, list(_WKT)))


def is_geography(column):
    """Geometry text whose coordinates all are degrees of longitude and latitude."""
    c = _c(column)
    first_two = rf"({_NUM}) +({_NUM})(?: +{_NUM})*"
    lon = F.regexp_extract_all(c, F.lit(first_two), 1)
    lat = F.regexp_extract_all(c, F.lit(first_two), 4)
    inside = F.forall(lon, lambda x: F.abs(x.cast("double")) <= 180) & F.forall(lat, lambda x: F.abs(x.cast("double")) <= 90)
    return _sure(~_wkt(column, list(_WKT)) | ~inside)


def is_non_empty_geometry(column):
    return _sure(~_wkt(column, list(_WKT)) | F.upper(_c(column)).contains("EMPTY"))


ROW_CHECKS = {
    f.__name__: f for f in (
        is_not_null, is_null, is_not_empty, is_empty, is_not_null_and_not_empty, is_null_or_empty,
        is_not_null_and_not_empty_array, is_in_list, is_not_in_list, is_not_null_and_is_in_list, is_equal_to,
        is_not_equal_to, is_in_range, is_not_in_range, is_not_less_than, is_not_greater_than, regex_match, is_valid_date,
        is_valid_timestamp, is_valid_json, has_json_keys, has_valid_json_schema, is_valid_ipv4_address,
        is_valid_ipv6_address, is_ipv4_address_in_cidr, is_ipv6_address_in_cidr, is_not_in_future, is_not_in_near_future,
        is_older_than_n_days, is_older_than_col2_for_n_days, is_data_fresh, does_not_contain_pii, sql_expression,
        is_latitude, is_longitude, is_not_null_island, is_point, is_linestring, is_polygon, is_geometry, is_geography,
        is_non_empty_geometry)
}
