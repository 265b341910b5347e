"""The driver's contract, also without the llm subpackage."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_llm(tmp_path):
    for p in ("isotab", "__spark_entry__.py"):
        (tmp_path / p).symlink_to(REPO / p)
    code = "import sys; sys.modules['isotab.llm'] = None; import __spark_entry__ as e; assert 'keyed_summary_orders' in e.queries() and not any(q.startswith('op') for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
