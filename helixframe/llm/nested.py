"""Rows of any table beside an operator's own columns: nothing the caller's columns are called can clash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

ROW = "row"


def nested(docs: DataFrame) -> DataFrame:
    """``docs`` as one struct column; operators add their columns beside it."""
    return docs.select(F.struct(*[F.col(_quoted(c)) for c in docs.columns]).alias(ROW))


def own(column: str) -> Column:
    """A column of the caller's row."""
    return F.col(f"{ROW}.{_quoted(column)}")


def unnested(rows: DataFrame, columns: list[str], changed: dict[str, Column] | None = None, more: Sequence[Column] = ()) -> DataFrame:
    """The caller's ``columns`` again, some ``changed``, and ``more`` after them."""
    changed = changed or {}
    return rows.select(*[(changed[c] if c in changed else own(c)).alias(c) for c in columns], *more)


def _quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def identifier(docs: DataFrame, ident: str) -> tuple[str, object]:
    """Spark and Arrow type of the identifier: operators carry identifiers as they are, whatever their type."""
    kind = docs.schema[ident].dataType
    return kind.simpleString(), to_arrow_type(kind)
