import pathlib
import re
import sys

import __spark_entry__ as entry


def test_queries_have_their_sql():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry.__doc__


def test_nothing_outside_llm_imports_it():
    root = pathlib.Path(entry.__file__).parent
    for f in (root / "quirespark").rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"\bllm\b", f.read_text()), f
    assert sys.modules


def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0
