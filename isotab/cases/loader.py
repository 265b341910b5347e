"""Case files in YAML: a single case, or a list under `cases:` with shared `defaults:`, `vars:` and `param_queries:`."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from isotab.cases.exclusions import merge_ignored
from isotab.cases.params import names_in, resolve_param_queries, resolve_variables, substitute_spec
from isotab.config import CompareConfig
from isotab.errors import CaseError, ConceptCheckError, CoverageError, SchemaCheckError
from isotab.operators.compare import compare_tables
from isotab.operators.schema import Coverage, check_concepts, check_coverage, check_schemas, load_schema_file, load_usage
from isotab.result import Outcome
from isotab.sources.registry import describe_source, load_source

#: Names of engines that case files may hold; all of them are Spark here.
ENGINES = {None, "default", "spark", "duckdb", "snowflake", "trino"}
_FILE_KEYS = {"ignore_columns_file", "ignore_columns_table"}
_SCHEMA_KEYS = {"expected", "actual", "ignore_columns", *_FILE_KEYS}


@dataclass
class BaseCase:
    name: str
    description: str = ""
    tags: list[str] = field(default_factory=list)
    source_file: str = ""
    variables: dict[str, str] = field(default_factory=dict)

    @property
    def base_dir(self) -> str:
        return os.path.dirname(self.source_file) or "."

    def _run(self, base_dir: str) -> Any:
        raise NotImplementedError

    def run(self, base_dir: str | None = None, sink=None, result_sink=None) -> Any:
        result = self._run(base_dir or self.base_dir)
        if result_sink is not None:
            result_sink.write(self.name, self.tags, result)
        return result


@dataclass
class Case(BaseCase):
    expected: dict[str, Any] = field(default_factory=dict)
    actual: dict[str, Any] = field(default_factory=dict)
    compare: dict[str, Any] = field(default_factory=dict)
    engine: str | None = None

    def config(self, base_dir: str | None = None) -> CompareConfig:
        if unknown := set(self.compare) - CompareConfig.option_names() - _FILE_KEYS:
            raise CaseError(f"case '{self.name}': unknown compare option(s) {sorted(unknown)}; known: {sorted(CompareConfig.option_names() | _FILE_KEYS)}")
        options = {k: v for k, v in self.compare.items() if k not in _FILE_KEYS and v is not None}
        return CompareConfig(**{**options, "ignore_columns": merge_ignored(self.compare, base_dir or self.base_dir)})

    def _run(self, base_dir: str) -> Outcome:
        return self.run_frames(base_dir)

    def run_frames(self, base_dir: str, sink=None) -> Outcome:
        cfg = self.config(base_dir)
        expected, actual = (load_source(s, base_dir, self.variables) for s in (self.expected, self.actual))
        if sink is not None:
            for side, df in (("expected", expected), ("actual", actual)):
                sink.write(self.name, side, df, cfg)
        return compare_tables(expected, actual, cfg)

    def run(self, base_dir: str | None = None, sink=None, result_sink=None) -> Outcome:
        result = self.run_frames(base_dir or self.base_dir, sink)
        if result_sink is not None:
            result_sink.write(self.name, self.tags, result)
        return result


@dataclass
class SchemaCheckCase(BaseCase):
    spec: dict[str, Any] = field(default_factory=dict)

    def _run(self, base_dir: str) -> Outcome:
        e, a = (describe_source(self.spec[s], base_dir, self.variables) for s in ("expected", "actual"))
        return check_schemas(e, a, merge_ignored(self.spec, base_dir))


@dataclass
class ConceptCheckCase(BaseCase):
    spec: dict[str, Any] = field(default_factory=dict)

    def _run(self, base_dir: str) -> Outcome:
        sources = self.spec["sources"]
        named = sources.items() if isinstance(sources, Mapping) else [(s.get("name") or s.get("table") or f"source{i}", s.get("source", s)) for i, s in enumerate(sources, 1)]
        schemas = {n: describe_source(s, base_dir, self.variables) for n, s in named}
        target = describe_source(self.spec["target"], base_dir, self.variables)
        return check_concepts(schemas, target, self.spec.get("concept_map") or [], bool(self.spec.get("strict_unmapped_target", False)))


@dataclass
class CoverageCase(BaseCase):
    spec: dict[str, Any] = field(default_factory=dict)

    def _run(self, base_dir: str) -> Coverage:
        source = self.spec["source"]
        override = load_schema_file(os.path.join(base_dir, self.spec["schema_file"])) if self.spec.get("schema_file") else None
        return check_coverage(load_usage(self.spec, base_dir), describe_source(source, base_dir, self.variables), override, str(source.get("table") or source.get("query") or source.get("path") or source.get("type")))


def merge_defaults(case: Mapping[str, Any], defaults: Mapping[str, Any]) -> dict[str, Any]:
    """The case over the defaults; of nested mappings only `compare` is merged."""
    out = {**defaults, **case}
    if isinstance(case.get("compare"), Mapping) and isinstance(defaults.get("compare"), Mapping):
        out["compare"] = {**defaults["compare"], **case["compare"]}
    return out


def build_case(raw: Mapping[str, Any], source_file: str = "", file_vars: Mapping | None = None, cli: Mapping | None = None, queried: Mapping[str, str] | None = None, deferred: frozenset[str] = frozenset()) -> BaseCase:
    """deferred: names whose queries were not run (`list`); they may stand unresolved in the case."""
    if "name" not in raw:
        raise CaseError(f"{source_file}: a case needs 'name': {raw!r}")
    where = f"{source_file}: case '{raw['name']}'"
    body = {k: v for k, v in raw.items() if k not in ("vars", "param_queries")}
    variables = {**(queried or {}), **resolve_variables(file_vars, raw.get("vars"), cli)}
    body = substitute_spec(body, variables | {n: f"${{{n}}}" for n in deferred - set(variables)}, where)
    common = {"name": body["name"], "description": body.get("description") or "", "tags": list(body.get("tags") or []), "source_file": source_file, "variables": variables}
    for key, kind, required, error in (("schema_check", SchemaCheckCase, ("expected", "actual"), SchemaCheckError), ("concept_check", ConceptCheckCase, ("sources", "target"), ConceptCheckError), ("coverage_check", CoverageCase, ("source",), CoverageError)):
        if key in body:
            spec = dict(body[key] or {})
            if lacking := [r for r in required if not spec.get(r)]:
                raise error(f"{where}: {key} lacks {lacking}")
            if key == "schema_check" and (unknown := set(spec) - _SCHEMA_KEYS):
                raise error(f"{where}: {key} has unknown field(s) {sorted(unknown)}; known: {sorted(_SCHEMA_KEYS)}")
            return kind(**common, spec=spec)
    if lacking := [r for r in ("expected", "actual") if r not in body]:
        raise CaseError(f"{where} lacks {lacking}")
    if body.get("engine") not in ENGINES:
        raise CaseError(f"{where}: unknown engine {body['engine']!r}; known: {sorted(e for e in ENGINES if e)}")
    return Case(**common, expected=body["expected"], actual=body["actual"], compare=dict(body.get("compare") or {}), engine=body.get("engine"))


def load_cases_from_file(path: str, cli: Mapping | None = None, resolve_queries: bool = True) -> list[BaseCase]:
    import yaml

    with open(path, encoding="utf-8") as f:
        doc = yaml.safe_load(f) or {}
    if not isinstance(doc, Mapping):
        raise CaseError(f"{path}: the top level must be a mapping")
    many = "cases" in doc
    file_vars, queries = (doc.get("vars") if many else None) or {}, doc.get("param_queries") or {}
    queried, deferred = {}, frozenset()
    if queries and resolve_queries:
        # Once for the file: all of its cases see the same value.
        known = resolve_variables(file_vars, None if many else doc.get("vars"), cli)
        pinned = resolve_variables(None, None, cli)
        queried = resolve_param_queries(queries, {**known, **pinned}, os.path.dirname(path) or ".")
    elif queries:
        deferred = frozenset(str(q).lower() for q in queries)
    raw = doc["cases"] or [] if many else [doc]
    return [build_case(merge_defaults(r, doc.get("defaults") or {}), path, file_vars, cli, queried, deferred) for r in raw]


def case_files(path: str) -> list[str]:
    p = Path(path)
    if p.is_file():
        return [str(p)]
    if not p.is_dir():
        raise CaseError(f"no case file or folder at {path}")
    return sorted(str(f) for ext in ("*.yml", "*.yaml") for f in p.rglob(ext))


def discover_cases(path: str, cli: Mapping | None = None, resolve_queries: bool = True, coverage: bool = False) -> list[BaseCase]:
    """The cases of a file or, recursively, of a folder. Coverage cases have a command of their own: all or none of the result."""
    found = [c for f in case_files(path) for c in load_cases_from_file(f, cli, resolve_queries)]
    return [c for c in found if isinstance(c, CoverageCase) == coverage]


__all__ = ["BaseCase", "Case", "ConceptCheckCase", "CoverageCase", "SchemaCheckCase", "build_case", "case_files", "discover_cases", "load_cases_from_file", "merge_defaults", "names_in"]
