"""Column coverage: python -m isotab.coverage_cli coverage | list PATH. Exit codes: 0 covered, 1 gaps, 2 wrong use."""

from __future__ import annotations

import argparse
import csv
import json
import sys
from collections.abc import Iterator

from isotab.cases.loader import discover_cases
from isotab.errors import ParityError
from isotab.operators.schema import Coverage


def rows(r: Coverage) -> Iterator[tuple[str, str, str, str, str]]:
    """(status, usage column, source column, type, description): hits, gaps, then columns that are not used."""
    for name, hit in r.hits.items():
        yield "MAPPED", name, *hit
    for name in r.gaps:
        yield "UNMAPPED", name, "", "", ""
    for name in r.unused:
        yield "UNREFERENCED", "", name, "", ""


def render(r: Coverage, name: str) -> str:
    marks = {"MAPPED": "=", "UNMAPPED": "!", "UNREFERENCED": "."}
    lines = [f"Coverage '{name}': [{'FULL COVERAGE' if r.equivalent else 'GAPS FOUND'}]  source={r.source}  usage={len(r.hits) + len(r.gaps)}  mapped={len(r.hits)}  unmapped={len(r.gaps)}"]
    for status, used, column, kind, text in rows(r):
        lines.append(f"  {marks[status]} " + (f"{used} -> {column} {kind}" + (f'  "{text}"' if text else "") if status == "MAPPED" else f"{used} is not in the source" if used else f"{column} is not used"))
    return "\n".join(lines)


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="isotab-coverage", description="Which columns that a consumer uses does a table have?")
    top.add_argument("command", choices=("coverage", "list"))
    top.add_argument("path")
    top.add_argument("--json")
    top.add_argument("--csv")
    args = top.parse_args(argv)
    try:
        cases = discover_cases(args.path, coverage=True)
    except (ParityError, OSError) as e:
        cases = print(e, file=sys.stderr)
    if not cases:
        print(f"no coverage_check case at {args.path}", file=sys.stderr)
        return 2
    if args.command == "list":
        for c in cases:
            print(f"{c.name}  source={c.spec['source'].get('table') or c.spec['source'].get('type')}  ({c.source_file})")
        return 0
    found, broken = {}, False
    for c in cases:
        try:
            found[c.name] = c.run()
            print(render(found[c.name], c.name))
        except Exception as e:
            print(f"{c.name}: [ERROR] {e}")
            broken = True
    if args.json:
        with open(args.json, "w", encoding="utf-8") as f:
            json.dump([{"case": n, "covered": r.equivalent, **r._asdict()} for n, r in found.items()], f, indent=2)
    if args.csv:
        with open(args.csv, "w", encoding="utf-8", newline="") as f:
            w = csv.writer(f)
            w.writerow(["case", "status", "usage_column", "source_column", "source_type", "description"])
            w.writerows((n, *row) for n, r in found.items() for row in rows(r))
    return int(broken or not all(r.equivalent for r in found.values()))


if __name__ == "__main__":
    raise SystemExit(main())
