"""What a comparison found: counts, findings on the two schemas, and differing rows, each an object of its own."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any, NamedTuple


class Counts(NamedTuple):
    """Rows of each side, and rows (multisets) or keys that differ."""

    expected_rows: int = 0
    actual_rows: int = 0
    missing: int = 0
    added: int = 0
    changed: int = 0
    repeats_expected: int = 0
    repeats_actual: int = 0

    @property
    def differing(self) -> int:
        return self.missing + self.added + self.changed


@dataclass(frozen=True)
class SchemaFindings:
    """Both schemas as name -> type name, which columns were compared, and which of them have two types."""

    expected: Mapping[str, str] = field(default_factory=dict)
    actual: Mapping[str, str] = field(default_factory=dict)
    compared: tuple[str, ...] = ()
    retyped: tuple[tuple[str, str, str], ...] = ()
    only_expected: tuple[str, ...] = ()
    only_actual: tuple[str, ...] = ()

    @property
    def drifted(self) -> bool:
        return bool(self.only_expected or self.only_actual or self.retyped)

    def retyped_dicts(self) -> list[dict[str, str]]:
        return [dict(zip(("column", "expected", "actual"), t, strict=True)) for t in self.retyped]


class Difference(NamedTuple):
    """A row that one side lacks (its other half is None) or that has changed in `columns`; `spelling` are those of them
    that only spell absence in another way."""

    key: tuple | None
    before: Mapping[str, Any] | None
    after: Mapping[str, Any] | None
    columns: tuple[str, ...] = ()
    spelling: frozenset = frozenset()

    @property
    def kind(self) -> str:
        return "missing" if self.after is None else "added" if self.before is None else "changed"

    def cells(self) -> Iterable[tuple[str, Any, Any]]:
        """(column, expected, actual) of what has changed."""
        return ((c, self.before[c], self.after[c]) for c in self.columns)


class Pattern(NamedTuple):
    """Changed rows that differ in the same columns, and one of them."""

    columns: tuple[str, ...]
    rows: int
    example: Difference | None = None


@dataclass
class Outcome:
    """The result of a case. schema_only: no row was read. patterns: most rows first."""

    schema: SchemaFindings
    counts: Counts = Counts()
    keys: tuple[str, ...] = ()
    examples: list[Difference] = field(default_factory=list)
    patterns: list[Pattern] = field(default_factory=list)
    changed_by_column: dict[str, int] = field(default_factory=dict)
    respelled_by_column: dict[str, int] = field(default_factory=dict)
    schema_only: bool = False
    #: Does drift of the schemas count as a difference?
    strict: bool = False
    #: The verdict of a check that has rules of its own.
    passed: bool | None = None

    @property
    def equivalent(self) -> bool:
        if self.passed is not None:
            return self.passed
        return not self.counts.differing and not (self.strict and self.schema.drifted)

    def summary(self) -> str:
        n, s = self.counts, self.schema
        if self.schema_only:
            what = f"schema-only | columns: {len(s.compared)} compared, {len(s.only_expected)} only in expected, {len(s.only_actual)} only in actual, {len(s.retyped)} type mismatch(es)"
        else:
            how = f"keyed on {list(self.keys)}" if self.keys else "keyless (multiset)"
            what = f"{how} | expected={n.expected_rows} actual={n.actual_rows} | missing={n.missing} added={n.added} changed={n.changed}"
        return f"[{'EQUIVALENT' if self.equivalent else 'DIFFERENT'}] {what}"
