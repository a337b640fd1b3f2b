from __future__ import annotations

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry

REPO = os.path.dirname(os.path.abspath(entry.__file__))

WITHOUT = """
import sys
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name == "echolake.llm" or name == "corpus_pipeline":
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as e
assert len(e.queries()) > 60 and set(e.oracle_sql()) <= set(e.queries())
assert not any(k.startswith("op") or k == "pipeline" for k in e.queries())
"""


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_the_optional_part():
    subprocess.run([sys.executable, "-c", WITHOUT], cwd=REPO, check=True)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() == 14 and "recall" in df.columns
