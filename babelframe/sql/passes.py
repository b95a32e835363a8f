"""Rewrites of the tree before binding: (tree, semantics) -> tree."""

from __future__ import annotations

from ..config import SemanticConfig
from .tree import Binary, Query, rebuild


def fold_constants(tree: Query, semantics: SemanticConfig) -> Query:
    """An example of a pass that leaves meaning alone: boolean conditions with a literal side."""
    from .tree import Lit

    def change(n):
        if isinstance(n, Binary) and n.op in ("and", "or"):
            for a, b in ((n.left, n.right), (n.right, n.left)):
                if isinstance(a, Lit) and a.kind == "BOOL":
                    return b if a.value == (n.op == "and") else a
        return n

    return rebuild(tree, change)


def limit_with_ties(tree: Query, semantics: SemanticConfig) -> Query:
    """Gives every LIMIT with an ORDER BY the meaning of WITH TIES."""
    from dataclasses import replace

    return rebuild(tree, lambda n: replace(n, ties=True) if isinstance(n, Query) and n.limit is not None and n.order and not n.offset else n)


__all__ = ["fold_constants", "limit_with_ties"]
