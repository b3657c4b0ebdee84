"""JSON that loses nothing a reader could take for something else: NaN and infinities are null, -0 is 0, null fields stay."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameflow.functions.numeric import finite_or_null

OPTIONS = {"ignoreNullFields": "false"}


def lossless(value: Column, kind: T.DataType) -> Column:
    """A value of any nested kind with its numbers as JSON can hold them, times and decimals as text."""
    if isinstance(kind, T.DoubleType | T.FloatType):
        return finite_or_null(value.cast("double"))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: lossless(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: lossless(x, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(lossless(value[f.name], f.dataType).alias(f.name) for f in kind)))
    if isinstance(kind, T.BinaryType):
        return F.base64(value)
    if isinstance(kind, T.DecimalType | T.DateType | T.TimestampType | T.TimestampNTZType):
        return value.cast("string")
    return value


def json_of(fields: dict[str, tuple[Column, T.DataType]], pretty: bool = False) -> Column:
    """A JSON object of fields, each a column and its kind."""
    return F.to_json(F.struct(*(lossless(c, kind).alias(name) for name, (c, kind) in fields.items())), OPTIONS | ({"pretty": "true"} if pretty else {}))
