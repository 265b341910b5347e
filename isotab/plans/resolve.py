"""Which columns are compared, decided on the two schemas alone."""

from __future__ import annotations

from pyspark.sql import DataFrame

from isotab.config import CompareConfig
from isotab.functions.fingerprint import fields_of
from isotab.result import SchemaFindings
from isotab.types import same_type, type_name


def resolve(expected: DataFrame, actual: DataFrame, cfg: CompareConfig) -> SchemaFindings:
    """Shared columns in expected's order, or cfg.select, less cfg.ignore_columns; unknown names are passed over.

    The one-sided columns don't depend on select or ignore_columns; two types are reported of compared columns only.
    """
    e, a = fields_of(expected), fields_of(actual)
    wanted = dict.fromkeys(cfg.select or e)
    columns = tuple(c for c in wanted if c in e.keys() & a.keys() and c not in cfg.ignore_columns)
    named = [{c: type_name(t) for c, t in side.items()} for side in (e, a)]
    retyped = tuple((c, named[0][c], named[1][c]) for c in columns if not same_type(e[c], a[c]))
    return SchemaFindings(*named, columns, retyped, tuple(c for c in e if c not in a), tuple(c for c in a if c not in e))
