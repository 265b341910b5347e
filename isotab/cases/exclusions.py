"""Columns left out of a comparison, from a CSV file of (table, column) shared by many cases."""

from __future__ import annotations

import csv
import os
from collections.abc import Mapping
from typing import Any

from isotab.errors import ExclusionError


def load_exclusions(path: str, table: str) -> list[str]:
    """The file's columns for one table, in its order. Headers and table names match without regard to case."""
    try:
        with open(path, encoding="utf-8-sig", newline="") as f:
            rows = [[c.strip() for c in r] for r in csv.reader(f) if any(c.strip() for c in r)]
    except OSError as e:
        raise ExclusionError(f"can't read exclusion file {path}: {e}") from e
    head = [h.lower() for h in rows[0]] if rows else []
    if lacking := [h for h in ("table", "column") if h not in head]:
        raise ExclusionError(f"{path}: header lacks {lacking}; found {head}")
    t, c = head.index("table"), head.index("column")
    by_table: dict[str, list[str]] = {}
    for n, row in enumerate(rows[1:], 2):
        if len(row) <= max(t, c) or not row[t] or not row[c]:
            raise ExclusionError(f"{path}: row {n} needs a table and a column: {row}")
        by_table.setdefault(row[t].lower(), []).append(row[c])
    if table.lower() not in by_table:
        raise ExclusionError(f"{path} has no row for table {table!r}; it has {sorted(by_table)}")
    return list(dict.fromkeys(by_table[table.lower()]))


def merge_ignored(spec: Mapping[str, Any], base_dir: str) -> list[str]:
    """ignore_columns with those of ignore_columns_file for ignore_columns_table."""
    inline, path, table = list(spec.get("ignore_columns") or []), spec.get("ignore_columns_file"), spec.get("ignore_columns_table")
    if bool(path) != bool(table):
        raise ExclusionError("ignore_columns_file and ignore_columns_table go together")
    extra = load_exclusions(path if os.path.isabs(path) else os.path.join(base_dir, path), str(table)) if path else []
    return list(dict.fromkeys([*inline, *extra]))
