"""Intermediate tables of the corpus operators: those of the library."""

from ..store import children, clear, exists, mark, materialize, new_path, remove, scope, shared_dir

__all__ = ["children", "clear", "exists", "mark", "materialize", "new_path", "remove", "scope", "shared_dir"]
