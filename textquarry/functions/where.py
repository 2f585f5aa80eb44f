"""Nested filters as columns: ``{"$and": [...]}``, ``{"$or": [...]}``, ``{field: {"$gte": 3, "$lte": 9}}``, ``{field: value}``.

A filter is read into a small tree that is checked against a schema: unknown fields and operators, and values of a wrong kind, are refused
before anything runs. The tree gives a Column of comparisons, which Spark pushes to the files and to the partitions.
An array field meets $eq if it has the value, and $in if it has one of them. Null values never meet a test.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPERATORS = {"$eq", "$in", "$gte", "$lte"}
#: Kinds of values that a field of a type takes; times and dates come as text.
KINDS = {T.StringType: str, T.BooleanType: bool, T.DateType: str, T.TimestampType: str, T.TimestampNTZType: str}


@dataclass(frozen=True)
class Test:
    field: str
    operator: str
    value: object
    type: T.DataType

    def column(self) -> Column:
        """The test; values are literals of the field's own type, so that no field is cast."""
        of = self.type.elementType if isinstance(self.type, T.ArrayType) else self.type
        lit = lambda v: F.lit(v) if isinstance(of, (T.StringType, T.BooleanType)) else F.lit(v).cast(of)
        c = F.col(f"`{self.field}`")
        if isinstance(self.type, T.ArrayType):
            values = self.value if self.operator == "$in" else [self.value]
            return F.arrays_overlap(c, F.array(*map(lit, values))) if values else F.lit(False)
        if self.operator == "$in":
            return c.isin(*map(lit, self.value)) if self.value else F.lit(False)
        return {"$eq": c == lit(self.value), "$gte": c >= lit(self.value), "$lte": c <= lit(self.value)}[self.operator]


@dataclass(frozen=True)
class All:
    parts: tuple

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, [p.column() for p in self.parts], F.lit(True)) if len(self.parts) != 1 else self.parts[0].column()


@dataclass(frozen=True)
class Any:
    parts: tuple

    def column(self) -> Column:
        return reduce(lambda a, b: a | b, [p.column() for p in self.parts])


def parsed(filters: Mapping, schema: T.StructType) -> All | Any | Test:
    """The tree of a filter. Several entries of one mapping all have to hold; an empty one holds for every row."""
    if not isinstance(filters, Mapping):
        raise ValueError(f"a filter is a mapping, not {filters!r}")
    parts = []
    for key, value in filters.items():
        if key in ("$and", "$or"):
            if not isinstance(value, (list, tuple)) or not value:
                raise ValueError(f"{key} takes a list of filters")
            parts.append((All if key == "$and" else Any)(tuple(parsed(v, schema) for v in value)))
        elif not isinstance(key, str) or key.startswith("$"):
            raise ValueError(f"no operator {key!r}")
        else:
            if key not in schema.names:
                raise ValueError(f"no field {key!r}")
            tests = value if isinstance(value, Mapping) else {"$eq": value}
            parts += [_test(key, op, v, schema[key].dataType) for op, v in tests.items()]
    return parts[0] if len(parts) == 1 else All(tuple(parts))


def _test(field: str, operator: str, value: object, kind: T.DataType) -> Test:
    if operator not in OPERATORS:
        raise ValueError(f"no operator {operator!r}")
    if isinstance(kind, T.ArrayType) and operator in ("$gte", "$lte"):
        raise ValueError(f"{operator} does not apply to the array {field!r}")
    if (operator == "$in") != isinstance(value, (list, tuple)):
        raise ValueError(f"{operator} of {field!r} takes {'a list' if operator == '$in' else 'one value'}")
    of = kind.elementType if isinstance(kind, T.ArrayType) else kind
    wanted = KINDS.get(type(of), (int, float) if isinstance(of, T.NumericType) else None)
    for v in value if operator == "$in" else [value]:
        if wanted is None or not isinstance(v, wanted) or (isinstance(v, bool) and wanted is not bool):
            raise ValueError(f"{v!r} is no value for {field!r}")
    return Test(field, operator, value, kind)


def filtered(df: DataFrame, filters: Mapping) -> DataFrame:
    """The rows that meet a filter."""
    return df.where(parsed(filters, df.schema).column())


def of_search(after: str | None = None, before: str | None = None, authors: list[str] | None = None, **fields) -> dict:
    """The filter of a search form: published between two days, one of some authors, other fields equal. The names are those of papers."""
    tests = [{"published": {"$gte": after}}] if after else []
    tests += [{"published": {"$lte": before}}] if before else []
    tests += [{"authors": {"$in": authors}}] if authors else []
    tests += [{k: {"$eq": v}} for k, v in fields.items() if v is not None]
    return {"$and": tests} if len(tests) > 1 else (tests[0] if tests else {})
