"""Connected components of link tables: the library's own."""

from helixframe.operators.components import connected_components

__all__ = ["connected_components"]
