"""Options of a comparison."""

from __future__ import annotations

from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class CanonOptions:
    """What the canonical form of a value depends on."""

    float_tolerance: float = 0.0
    coerce_numeric_to_float: bool = False
    trim_strings: bool = False
    case_insensitive: bool = False
    unordered_list_columns: frozenset = frozenset()
    exact_casefold: bool = False


@dataclass
class CompareConfig:
    """keys: None or empty compares multisets of rows. select: None or empty compares all shared columns."""

    keys: list[str] | None = None
    select: list[str] | None = None
    ignore_columns: list[str] = field(default_factory=list)
    float_tolerance: float = 0.0
    coerce_numeric_to_float: bool = False
    trim_strings: bool = False
    case_insensitive: bool = False
    unordered_list_columns: list[str] = field(default_factory=list)
    null_equivalence: bool = False
    strict_columns: bool = False
    max_examples: int = 20
    vectorized: bool = False  # accepted for old case files: expressions here always run vectorised
    exact_casefold: bool = False  # full Unicode folding through an Arrow UDF instead of lower()

    def canon(self) -> CanonOptions:
        return CanonOptions(self.float_tolerance, self.coerce_numeric_to_float, self.trim_strings, self.case_insensitive, frozenset(self.unordered_list_columns), self.exact_casefold)

    @classmethod
    def option_names(cls) -> set[str]:
        return {f.name for f in fields(cls)}
