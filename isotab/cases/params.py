"""${name} placeholders: file vars < case vars < environment < command line, names without regard to case."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Mapping
from typing import Any

from isotab.errors import ParamError

ENV_PREFIX = "ISOTAB_VAR_"
_NAME = re.compile(r"\$\{([A-Za-z_]\w*)\}", re.ASCII)


def parse_cli_params(items: Iterable[str] | None) -> dict[str, str]:
    out = {}
    for item in items or ():
        name, eq, value = item.partition("=")
        if not eq or not name.strip():
            raise ParamError(f"--param takes NAME=VALUE, got {item!r}")
        out[name.strip()] = value
    return out


def resolve_variables(file_vars: Mapping | None = None, case_vars: Mapping | None = None, cli: Mapping | None = None, environ: Mapping[str, str] | None = None) -> dict[str, str]:
    env = os.environ if environ is None else environ
    layers = (file_vars or {}, case_vars or {}, {k[len(ENV_PREFIX) :]: v for k, v in env.items() if k.startswith(ENV_PREFIX) and len(k) > len(ENV_PREFIX)}, cli or {})
    return {str(k).lower(): "" if v is None else str(v) for layer in layers for k, v in layer.items()}


def names_in(node: Any) -> set[str]:
    if isinstance(node, str):
        return {m.lower() for m in _NAME.findall(node)}
    if isinstance(node, Mapping):
        return set().union(*map(names_in, [*node.keys(), *node.values()]), set())
    return set().union(*map(names_in, node), set()) if isinstance(node, (list, tuple)) else set()


def substitute_text(text: str, variables: Mapping[str, str], where: str = "") -> str:
    return substitute_spec(text, variables, where)


def substitute_spec(node: Any, variables: Mapping[str, str], where: str = "") -> Any:
    """Replace all placeholders in a nested spec; the error for unknown ones names them all."""
    if lacking := names_in(node) - set(variables):
        raise ParamError(f"{where or 'spec'}: unresolved parameter(s) {sorted(lacking)}; set them with vars:, {ENV_PREFIX}<NAME> or --param; known: {sorted(variables)}")
    return _filled(node, variables)


def _filled(node: Any, variables: Mapping[str, str]) -> Any:
    if isinstance(node, str):
        return _NAME.sub(lambda m: variables[m[1].lower()], node)
    if isinstance(node, Mapping):
        return {k: _filled(v, variables) for k, v in node.items()}
    return [_filled(v, variables) for v in node] if isinstance(node, (list, tuple)) else node


def resolve_param_queries(queries: Mapping[str, Any] | None, resolved: Mapping[str, str], base_dir: str = ".") -> dict[str, str]:
    """Values of the names that `resolved` lacks, each from a query whose result is exactly one value."""
    from isotab.sources.registry import load_source

    out: dict[str, str] = {}
    for name, spec in (queries or {}).items():
        if str(name).lower() in resolved:
            continue
        where = f"param_queries['{name}']"
        if not isinstance(spec, Mapping) or "type" not in spec:
            raise ParamError(f"{where} must be a source spec with 'type', got {spec!r}")
        df = load_source(substitute_spec(spec, resolved, where), base_dir, resolved)
        if len(df.columns) != 1:
            raise ParamError(f"{where} must select one column, got {df.columns}")
        rows = df.limit(2).collect()
        if len(rows) != 1:
            raise ParamError(f"{where} must return one row, got {'none' if not rows else 'several'}; pass --param {name}=... to pin it")
        if rows[0][0] is None:
            raise ParamError(f"{where} returned NULL; pass --param {name}=... to pin it")
        out[str(name).lower()] = str(rows[0][0])
    return out
