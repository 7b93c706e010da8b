"""The entry without the corpus operators, or without a library that they need."""

import subprocess
import sys

import pytest

BLOCK = """
import sys
class Blocked:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r} or name.startswith({name!r} + "."):
            raise ImportError(name)
sys.meta_path.insert(0, Blocked())
import __spark_entry__ as e
q, s = e.queries(), e.oracle_sql()
assert "dense_kis" in q and set(s) <= set(q)
print(sorted(k for k in q if k.startswith("op") and k[2].isdigit() or k == "pipeline"))
"""


@pytest.mark.parametrize("name", ["keyloom.llm", "corpus_pipeline", "xxhash", "tiktoken"])
def test_entry_without(name):
    done = subprocess.run([sys.executable, "-c", BLOCK.format(name=name)], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    if name in ("keyloom.llm", "xxhash"):
        assert done.stdout.strip() == "[]"
