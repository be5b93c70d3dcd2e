"""The driver's entry works without the corpus operators and without their packages."""

import os
import subprocess
import sys

import pytest

from lexmere.queries import QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("absent", ["zstandard", "public_tokenizers", "lexmere.llm", "corpus_pipeline"])
def test_core_queries_stand_alone(absent):
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name == {absent!r}:
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as entry
print(len(entry.queries()), len(entry.oracle_sql()))
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == [str(len(QUERIES))] * 2, out.stderr
