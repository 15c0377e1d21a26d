"""The driver's module with and without what the corpus operators need."""

import subprocess
import sys

import pytest

BLOCK = """
import sys

class Block:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] == {0!r} or name == {0!r}:
            raise ImportError(name)

sys.meta_path.insert(0, Block())
import __spark_entry__ as e
print(len(e.queries()), len(e.oracle_sql()), sum(q.startswith("op") or q == "pipeline" for q in e.queries()))
"""


@pytest.mark.parametrize("missing", ["ahocorasick", "gridmill.llm", "corpus_pipeline"])
def test_other_queries_stand(missing):
    out = subprocess.run([sys.executable, "-c", BLOCK.format(missing)], capture_output=True, text=True, check=True).stdout.split()
    n, sql, _ = map(int, out[-3:])
    assert n > 200 and sql > 180
