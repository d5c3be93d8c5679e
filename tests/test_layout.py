"""The optional package stays optional, and every query has a callable."""

import re
from pathlib import Path

import __spark_entry__ as entry

PACKAGE = Path(entry.__file__).parent / "shutterstack"


def test_nothing_else_imports_the_optional_package():
    for path in PACKAGE.rglob("*.py"):
        if path.relative_to(PACKAGE).parts[0] != "llm":
            assert not re.search(r"shutterstack\.llm|from \.+llm|import llm", path.read_text()), path


def test_queries_and_sql():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and all(map(callable, queries.values()))
    assert {"p1_found", "p5_found", "p6_found"} <= set(queries)


def test_entry(spark, sample):
    rows = entry.entry(spark).collect()
    assert len(rows) == 20 and rows[0]["distance"] == 0


def test_no_local_checkpoint():
    assert not any("localCheckpoint" in path.read_text() for path in PACKAGE.rglob("*.py"))
