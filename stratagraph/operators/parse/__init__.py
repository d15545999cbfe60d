"""File parsers: each turns a file into nodes, edges, text rows and warnings.

A parser is a function (path, content) -> Parsed. The registry says which parsers take a file; all that do
run, and an exception in one becomes a warning. parse_files() runs them over a DataFrame of files in one narrow
pass and gives tagged rows, from which relations() selects typed tables.
"""

from __future__ import annotations

from .registry import PARSERS, parse_files, parse_one, relations

__all__ = ["PARSERS", "parse_files", "parse_one", "relations"]
