"""Writers: Parquet, CSV by split, and JSON without NaN or infinities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def finite(frame: DataFrame) -> DataFrame:
    """NaN and infinite numbers as null, in all columns, and in structs, arrays and maps at any depth."""
    return frame.select(*[_finite(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in frame.schema])


def _finite(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~(F.isnan(value) | (F.abs(value) == float("inf"))), value)
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[_finite(value[f.name], f.dataType).alias(f.name) for f in kind]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _finite(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: _finite(x, kind.valueType))
    return value


def write_parquet(frame: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Parquet, in folders by the columns of ``by`` where given."""
    writer = frame.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_csv(frame: DataFrame, path: str) -> None:
    """Headed CSV files."""
    frame.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_split_csv(frame: DataFrame, path: str, split: str, order: str) -> None:
    """Headed CSV files, a folder for each split, each file sorted; no global sort is needed."""
    frame.sortWithinPartitions(split, order).write.mode("overwrite").option("header", True).partitionBy(split).csv(path)


def write_json(frame: DataFrame, path: str) -> None:
    """JSON lines; numbers that JSON lacks become null."""
    finite(frame).write.mode("overwrite").json(path)
