"""The registration contract (SQL equality of the queries is in tests/test_oracles.py)."""

import os
import re

import __spark_entry__ as entry


def test_one_query_per_operator():
    numbers = [int(m[1]) for n in entry.queries() if (m := re.match(r"op(\d+)_", n))]
    assert sorted(numbers) == list(range(1, 14))
    assert "pipeline" in entry.queries()


def test_nothing_outside_imports_the_subpackage():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for folder, _, files in os.walk(os.path.join(root, "gleaner")):
        if os.path.basename(folder) != "llm":
            for f in (f for f in files if f.endswith(".py")):
                with open(os.path.join(folder, f)) as text:
                    assert "gleaner.llm" not in text.read(), f
