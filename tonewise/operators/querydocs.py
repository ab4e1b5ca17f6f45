"""Query documents, as a document store takes them, as one column expression.

A document is a mapping: field names (dotted for nested fields) to a value or to a mapping of operators, and the
connectives $and, $or, $nor. All tests of a document must hold. The expression is made of plain comparisons, so it is
pushed to the scan as far as the source can take it. A missing field is a null one. As in a document store, a
comparison with a null field never holds, $ne and $nin hold for it, and a test of an array field holds if it
holds for one of its elements.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_COMPARE: dict[str, Callable[[Column, object], Column]] = {
    "$gt": lambda c, v: c > F.lit(v),
    "$gte": lambda c, v: c >= F.lit(v),
    "$lt": lambda c, v: c < F.lit(v),
    "$lte": lambda c, v: c <= F.lit(v),
    "$eq": lambda c, v: c == F.lit(v),
}


def _sure(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def _one_of(column: Column, values: Sequence[object]) -> Column:
    some = [v for v in values if v is not None]
    test = column.isin(some) if some else F.lit(False)
    return test | column.isNull() if len(some) < len(values) else test


def _operator(column: Column, kind: T.DataType, name: str, value: object) -> Column:
    if name == "$not":
        if not isinstance(value, Mapping):
            raise ValueError("$not takes a mapping of operators")
        return ~_sure(_tests(column, kind, value))
    if name == "$ne":
        return ~_sure(_operator(column, kind, "$eq", value))
    if name == "$nin":
        return ~_sure(_operator(column, kind, "$in", value))
    if name == "$exists":
        return column.isNotNull() if value else column.isNull()
    if name == "$in":
        if isinstance(value, str) or not isinstance(value, Sequence):
            raise ValueError("$in and $nin take a list")
        if isinstance(kind, T.ArrayType):
            return F.exists(column, lambda x: _sure(_one_of(x, value)))
        return _one_of(column, value)
    if name not in _COMPARE:
        raise ValueError(f"unknown operator {name!r}")
    if value is None:
        if name != "$eq":
            raise ValueError(f"{name} does not take null")
        return column.isNull()
    if isinstance(kind, T.ArrayType):
        return F.exists(column, lambda x: _sure(_COMPARE[name](x, value)))
    return _COMPARE[name](column, value)


def _tests(column: Column, kind: T.DataType, tests: Mapping[str, object]) -> Column:
    return reduce(Column.__and__, [_operator(column, kind, name, value) for name, value in tests.items()], F.lit(True))


def _type_of(schema: T.StructType, path: str) -> T.DataType:
    kind: T.DataType = schema
    for part in path.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.names:
            raise ValueError(f"no field {path!r}")
        kind = kind[part].dataType
    return kind


def condition(document: Mapping[str, object], schema: T.StructType) -> Column:
    """The test that a query document stands for; unknown fields and operators are refused."""
    tests = []
    for name, value in document.items():
        if name in ("$and", "$or", "$nor"):
            if isinstance(value, Mapping) or not isinstance(value, Sequence) or not value:
                raise ValueError(f"{name} takes a list of documents")
            parts = [condition(part, schema) for part in value]
            joined = reduce(Column.__and__ if name == "$and" else Column.__or__, parts)
            tests.append(~_sure(joined) if name == "$nor" else joined)
            continue
        if name.startswith("$"):
            raise ValueError(f"unknown operator {name!r}")
        column = F.col(".".join(f"`{part}`" for part in name.split(".")))
        kind = _type_of(schema, name)
        operators = isinstance(value, Mapping) and any(k.startswith("$") for k in value)
        tests.append(_tests(column, kind, value) if operators else _operator(column, kind, "$eq", value))
    return reduce(Column.__and__, tests) if tests else F.lit(True)


def find(df: DataFrame, document: Mapping[str, object], sort: Sequence[tuple[str, int]] = (), limit: int | None = None) -> DataFrame:
    """The matching rows; ``sort`` takes (field, 1 or -1), and a limit needs one."""
    found = df.where(condition(document, df.schema))
    if limit is not None and not sort:
        raise ValueError("a limit needs an order")
    if sort:
        found = found.orderBy(*[F.asc(c) if way > 0 else F.desc(c) for c, way in sort])
    return found if limit is None else found.limit(limit)
