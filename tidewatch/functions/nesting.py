"""Nested structs from dotted paths, and back."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nest(leaves: Mapping[str, Column]) -> list[Column]:
    """One column per first path step, with structs below it."""
    tree: dict = {}
    for path, column in leaves.items():
        *parents, last = path.split(".")
        node = tree
        for step in parents:
            node = node.setdefault(step, {})
        node[last] = column

    def build(node) -> Column:
        if isinstance(node, Column):
            return node
        return F.struct(*(build(child).alias(name) for name, child in node.items()))

    return [build(child).alias(name) for name, child in tree.items()]


def leaf_paths(schema: T.StructType, parent: str = "") -> dict[str, T.DataType]:
    """Dotted path of every non-struct leaf with its type."""
    found: dict[str, T.DataType] = {}
    for field in schema:
        path = f"{parent}{field.name}"
        if isinstance(field.dataType, T.StructType):
            found.update(leaf_paths(field.dataType, f"{path}."))
        else:
            found[path] = field.dataType
    return found


def column_at(path: str) -> Column:
    """The column at a dotted path, each step quoted."""
    return F.col(".".join(f"`{step}`" for step in path.split(".")))


def field_or_null(df: DataFrame, path: str, type_: str) -> Column:
    """The field at ``path`` cast to ``type_``, or a typed null where it is not there."""
    if path in leaf_paths(df.schema):
        return column_at(path).try_cast(type_)
    return F.lit(None).cast(type_)


def flatten(df: DataFrame, separator: str = "_") -> DataFrame:
    """Plain columns: structs spread out, times as epoch microseconds, arrays as text."""
    columns = []
    for path, type_ in leaf_paths(df.schema).items():
        column = column_at(path)
        if isinstance(type_, T.TimestampType):
            column = F.unix_micros(column)
        elif isinstance(type_, T.ArrayType):
            column = F.array_join(column, ",")
        columns.append(column.alias(path.replace("@", "").replace(".", separator)))
    return df.select(*columns)
