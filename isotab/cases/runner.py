"""For pytest: cases as parameters, and a failure that shows the whole difference."""

from __future__ import annotations

from isotab.cases.loader import BaseCase, discover_cases
from isotab.report.render import render_console
from isotab.result import Outcome


def load_cases(path: str, params: dict | None = None) -> list[BaseCase]:
    return discover_cases(path, params)


def assert_case(case: BaseCase, **kwargs) -> Outcome:
    """Fails where the case is not equivalent. Tags such as xfail don't matter here; they are the command line's."""
    result = case.run(**kwargs)
    if not result.equivalent:
        raise AssertionError("\n" + render_console(result, case.name))
    return result
