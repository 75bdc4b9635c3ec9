"""Resolving payload keys to columns of whatever form the table has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def physical(key: str) -> str:
    """The stored path of a declared key: codegraph signals lie one level deeper."""
    for level in ("file", "chunk"):
        if key.startswith(f"codegraph.{level}."):
            return key.replace(f"codegraph.{level}.", f"codegraph.symbols.{level}.", 1)
    return key


class Payload:
    """Columns by payload key.

    A key is looked up as a flat column, as a flat column with underscores, nested as
    stored, and nested as declared; a key the table lacks is null.
    """

    def __init__(self, df: DataFrame):
        self.schema, self.names = df.schema, set(df.columns)

    def _nested(self, path: str) -> bool:
        now: T.DataType = self.schema
        for part in path.split("."):
            if not isinstance(now, T.StructType) or part not in now.fieldNames():
                return False
            now = now[part].dataType
        return True

    def has(self, key: str) -> bool:
        return key in self.names or key.replace(".", "_") in self.names or self._nested(physical(key)) or self._nested(key)

    def __getitem__(self, key: str) -> Column:
        if key in self.names:
            return F.col(f"`{key}`")
        if key.replace(".", "_") in self.names:
            return F.col(key.replace(".", "_"))
        for path in (physical(key), key):
            if self._nested(path):
                return F.col(path)
        return F.lit(None)
