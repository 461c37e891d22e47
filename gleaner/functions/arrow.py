"""User functions of rows on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType


def row_udf(schema: str, fn: Callable):
    """A function of a row's values, with a result of a type in DDL (structs as dicts, arrays as lists), run batch by batch."""
    kind = DataType.fromDDL(schema)
    arrow = to_arrow_type(kind)

    def run(*columns: pa.Array) -> pa.Array:
        return pa.array([fn(*row) for row in zip(*(c.to_pylist() for c in columns), strict=True)], arrow)

    run.__annotations__ = {"columns": pa.Array, "return": pa.Array}  # real types: the eager kind is asked for
    return F.arrow_udf(run, kind)
