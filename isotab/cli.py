"""isotab run | list | report. Exit codes: 0 all as expected, 1 a difference or a failed case, 2 wrong use."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from isotab.cases.loader import BaseCase, discover_cases
from isotab.cases.params import parse_cli_params
from isotab.errors import ParityError
from isotab.report.render import Reports, render_console
from isotab.result import Outcome
from isotab.sources.sinks import make_result_sink

AS_EXPECTED, DIFFERENT, WRONG_USE = 0, 1, 2


class Usage(Exception):
    """Something on the command line that can't work."""


@dataclass
class Attempt:
    """A case that was run: its result, or why there is none."""

    case: BaseCase
    result: Outcome | None = None
    error: Exception | None = None

    @property
    def surprising(self) -> bool:
        """A case tagged xfail is expected to differ."""
        return self.result is None or self.result.equivalent == ("xfail" in self.case.tags)

    def __str__(self) -> str:
        if self.result is None:
            return f"{self.case.name}: [ERROR] {type(self.error).__name__}: {self.error}"
        note = f"\n  {self.case.name} is tagged xfail and is equivalent" if self.surprising and self.result.equivalent else ""
        return render_console(self.result, self.case.name) + note


def attempts(cases: Iterable[BaseCase], sink=None) -> Iterator[Attempt]:
    """Runs the cases one by one; a broken one doesn't stop the others."""
    for case in cases:
        try:
            yield Attempt(case, case.run(result_sink=sink))
        except Exception as e:
            yield Attempt(case, error=e)


def _cases(args, **options) -> list[BaseCase]:
    found = discover_cases(args.path, parse_cli_params(args.param), **options)
    wanted = getattr(args, "select", None)
    found = [c for c in found if not wanted or c.name in wanted]
    if not found:
        raise Usage(f"no cases at {args.path}" + (f" named {wanted}" if wanted else ""))
    return found


def run(args) -> int:
    cases = _cases(args)
    sink = make_result_sink(args.result_sink, prefix=args.result_sink_prefix) if args.result_sink else None
    reports, surprises = Reports(args.json, args.md, args.csv), 0
    for attempt in attempts(cases, sink):
        print(attempt)
        surprises += attempt.surprising
        if attempt.result is not None:
            reports.add(attempt.case.name, attempt.result)
    reports.close()
    print(f"{len(cases) - surprises}/{len(cases)} as expected")
    return DIFFERENT if surprises else AS_EXPECTED


def show(args) -> int:
    for c in _cases(args, resolve_queries=False):
        tags = f"  [{', '.join(c.tags)}]" if c.tags else ""
        print(f"{c.name}{tags}  ({c.source_file})", *([c.description.strip()] if c.description else ()), sep="\n  ")
    return AS_EXPECTED


def report(args) -> int:
    from isotab.report.html import render_history

    try:
        page = render_history(args.result_sink, args.result_sink_prefix, args.days)
    except Exception as e:
        raise Usage(f"report failed: {e}") from e
    with open(args.html, "w", encoding="utf-8") as f:
        f.write(page)
    return AS_EXPECTED


#: Command -> what it does, its help, and its options as (flag, settings).
_PARAM = ("--param", {"action": "append", "metavar": "NAME=VALUE", "help": "a ${name} placeholder; repeatable"})
_PREFIX = ("--result-sink-prefix", {"default": "isotab"})
_SINK = {"metavar": "BACKEND:TARGET"}
COMMANDS: dict[str, tuple[Callable, str, list[tuple[str, dict]]]] = {
    "run": (run, "run cases; exit 1 on any difference", [("path", {}), ("--select", {"nargs": "*", "help": "only these cases"}), ("--json", {}), ("--md", {}), ("--csv", {"metavar": "DIR", "help": "one file per case, a row per column"}), _PARAM, ("--result-sink", _SINK), _PREFIX]),
    "list": (show, "list cases; runs no query", [("path", {}), _PARAM]),
    "report": (report, "an HTML page of the run history", [("--days", {"type": int, "default": 21}), ("--html", {"required": True}), ("--result-sink", {**_SINK, "required": True}), _PREFIX]),
}


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="isotab", description="Are two tables the same?")
    commands = top.add_subparsers(dest="command", required=True)
    for name, (_, text, options) in COMMANDS.items():
        p = commands.add_parser(name, help=text)
        for flag, settings in options:
            p.add_argument(flag, **settings)
    args = top.parse_args(argv)
    try:
        return COMMANDS[args.command][0](args)
    except (Usage, ParityError, OSError) as e:
        print(e, file=sys.stderr)
        return WRONG_USE


if __name__ == "__main__":
    raise SystemExit(main())
