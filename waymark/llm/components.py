"""Connected components of a table of links (a, b: long), as (node, component)."""

from __future__ import annotations

from waymark.operators.graphs import linked_nodes as components

__all__ = ["components"]
