"""Connected components of a table of links: the library's star rounds, under the names that the corpus operators use."""

from __future__ import annotations

from loomstead.operators.graph import links as components

__all__ = ["components"]
