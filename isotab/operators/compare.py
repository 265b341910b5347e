"""Row comparison of two DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotab.config import CompareConfig
from isotab.errors import ParityError
from isotab.functions.canon import register_casefold, register_variant
from isotab.functions.fingerprint import fields_of
from isotab.plans.keyed import KeyedPlan
from isotab.plans.keyless import KeylessPlan
from isotab.plans.resolve import resolve
from isotab.result import Counts, Difference, Outcome, Pattern, SchemaFindings

#: Sets of columns, those of most rows first, that reach the driver; KeyedPlan.signatures() has all of them.
MOST_PATTERNS = 1000


class MissingKeyError(ParityError, ValueError):
    pass


def plan_for(expected: DataFrame, actual: DataFrame, cfg: CompareConfig) -> tuple[KeyedPlan | KeylessPlan, SchemaFindings]:
    """The lazy plan of a comparison; nothing runs before one of its DataFrames is used."""
    if cfg.exact_casefold:
        register_casefold(expected.sparkSession)
    if any("variant" in t.simpleString() for df in (expected, actual) for t in fields_of(df).values()):
        register_variant(expected.sparkSession)
    found = resolve(expected, actual, cfg)
    columns = list(found.compared)
    if not cfg.keys:
        return KeylessPlan(expected, actual, columns, cfg), found
    for side, df in (("expected", expected), ("actual", actual)):
        if lacking := [k for k in cfg.keys if k not in fields_of(df)]:
            raise MissingKeyError(f"key column(s) {lacking} missing in {side}; it has {df.columns}")
    return KeyedPlan(expected, actual, columns, cfg), found


def compare_tables(expected: DataFrame, actual: DataFrame, config: CompareConfig | None = None) -> Outcome:
    """Compare as multisets of canonical rows, or by key. At most config.max_examples rows and MOST_PATTERNS sets of columns
    (with a row each) reach the driver, besides counts by column."""
    cfg = config or CompareConfig()
    plan, found = plan_for(expected, actual, cfg)
    out = Outcome(found, keys=tuple(cfg.keys or ()), strict=cfg.strict_columns)
    totals = plan.summary().collect()[0].asDict()
    suspects = totals.pop("suspects", 0)
    out.counts = Counts(**totals)
    if suspects:
        _explain(plan, out)
    if out.counts.differing:
        examples = _keyed_examples(plan, out) if out.keys else _multiset_examples(plan)
        out.examples = [d for d, _ in zip(examples, range(max(0, cfg.max_examples)), strict=False)] if cfg.max_examples > 0 else []
    return out


def _explain(plan: KeyedPlan, out: Outcome) -> None:
    """Counts of what has changed, by set of columns and by column; the keys that differ are looked up once."""
    from collections import Counter

    groups = plan.signatures().orderBy(F.desc("n"), "sig").limit(MOST_PATTERNS + 1).collect()
    if not groups:
        return
    if len(groups) <= MOST_PATTERNS:
        by_column: Counter = Counter()
        for g in groups:
            by_column.update(dict.fromkeys(g["sig"], g["n"]))
        changed = sum(g["n"] for g in groups)
    else:
        by_column = {r["column"]: r["diff_rows"] for r in plan.diff_counts().collect()}
        changed = plan.pairs.count()
    out.counts, out.changed_by_column = out.counts._replace(changed=changed), dict(by_column)
    shown = {g["key"]: g for g in groups[:MOST_PATTERNS]}
    rows = {r["key"]: _changed(plan, r) for r in plan.changed_for([*shown]).collect()} if plan.cfg.max_examples > 0 else {}
    out.patterns = [Pattern(tuple(g["sig"]), g["n"], rows.get(k)) for k, g in shown.items()]
    if plan.cfg.null_equivalence:
        out.respelled_by_column = {r["column"]: r["equivalent_rows"] for r in plan.column_counts().collect() if r["equivalent_rows"]}


def _multiset_examples(plan: KeylessPlan) -> Iterator[Difference]:
    for kind, _, row in plan.examples(plan.cfg.max_examples):
        values = row.asDict(recursive=True) if plan.columns else {}
        yield Difference(None, values, None) if kind == "missing" else Difference(None, None, values)


def _keyed_examples(plan: KeyedPlan, out: Outcome) -> Iterator[Difference]:
    """Missing rows by key, then added ones, then changed ones; a kind is read only if those before it leave room."""
    n = plan.cfg.max_examples
    for expected, count in ((True, out.counts.missing), (False, out.counts.added)):
        for r in plan.one_sided(expected).orderBy("key").limit(n).collect() if count else ():
            row = r["row"].asDict(recursive=True)
            key = tuple(row[k] for k in plan.keys)
            yield Difference(key, row, None) if expected else Difference(key, None, row)
    for r in plan.changed.orderBy("key").limit(n).collect() if out.counts.changed else ():
        yield _changed(plan, r)


def _changed(plan: KeyedPlan, r) -> Difference:
    before, after = r["e"].asDict(recursive=True), r["a"].asDict(recursive=True)
    return Difference(tuple(before[k] for k in plan.keys), before, after, tuple(r["sig"]), frozenset(r["equiv"]))
