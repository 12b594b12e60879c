from __future__ import annotations

import re

import __spark_entry__ as entry


def test_all_operators_are_registered():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 11))
    assert "pipeline" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_this_subpackage():
    from pathlib import Path

    root = Path(entry.__file__).parent
    for p in (root / "tidelog").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p
