"""Rows as values: a hash of all columns."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType


def _has_map(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return _has_map(kind.elementType)
    if isinstance(kind, StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, MapType)


def row_hash(rows: DataFrame) -> Column:
    """64-bit hash of a row. Maps count by their JSON form, so equal maps whose entries are
    written in other orders make different rows."""
    return F.xxhash64(
        *[
            F.to_json(F.struct(F.col(f"`{f.name}`"))) if _has_map(f.dataType) else F.col(f"`{f.name}`")
            for f in rows.schema.fields
        ]
    )
