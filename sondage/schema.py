"""What a table's schema says: column families, and the cleaning of NaN to null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

_DATETIME = (T.DateType, T.TimestampType, T.TimestampNTZType)


def family(dtype: T.DataType) -> str:
    """``numeric``, ``string``, ``datetime``, ``boolean`` or ``other``."""
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, T.StringType):
        return "string"
    if isinstance(dtype, _DATETIME):
        return "datetime"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    return "other"


def columns_of(df: DataFrame, *families: str) -> list[str]:
    """Column names of the given families, in schema order."""
    return [f.name for f in df.schema.fields if family(f.dataType) in families]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of(df, "numeric")


def string_columns(df: DataFrame) -> list[str]:
    return columns_of(df, "string")


def quoted(name: str) -> Column:
    """The column of that exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN read as null, so both count as missing."""
    column = quoted(name)
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(column), column)
    return column


def nan_to_null(df: DataFrame) -> DataFrame:
    """One table in which null is the only kind of missing value."""
    return df.select(*[present(df, c).alias(c) for c in df.columns])


def select_numeric(df: DataFrame) -> DataFrame:
    return df.select(*[quoted(c) for c in numeric_columns(df)])


def select_categorical(df: DataFrame) -> DataFrame:
    return df.select(*[quoted(c) for c in string_columns(df)])


def schema_table(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, family."""
    rows = [(i, f.name, f.dataType.simpleString(), family(f.dataType)) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, dtype string, family string")


def split_features_target(df: DataFrame, target: str | None = None) -> tuple[list[str], str]:
    """Numeric feature columns and the target (the last column unless named)."""
    target = target or df.columns[-1]
    features = [c for c in numeric_columns(df) if c != target]
    if not features:
        raise ValueError("no numeric feature column to model with")
    return features, target
