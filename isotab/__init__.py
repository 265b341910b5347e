"""Table parity on Spark: are two relations the same multiset of canonical rows, and if not, how do they differ?"""

from isotab.config import CanonOptions, CompareConfig
from isotab.functions.fingerprint import canon_row, canon_value, hash_sample, row_digest
from isotab.operators.compare import compare_tables
from isotab.result import Counts, Difference, Outcome, Pattern, SchemaFindings

__all__ = ["CanonOptions", "CompareConfig", "Counts", "Difference", "Outcome", "Pattern", "SchemaFindings", "assert_case", "canon_row", "canon_value", "compare_tables", "discover_cases", "hash_sample", "load_cases", "row_digest"]
__version__ = "0.1.0"


def __getattr__(name: str):
    if name in ("assert_case", "load_cases"):
        from isotab.cases import runner

        return getattr(runner, name)
    if name == "discover_cases":
        from isotab.cases.loader import discover_cases

        return discover_cases
    raise AttributeError(name)
