"""The entry module with and without the optional parts."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
WITHOUT = """
import importlib.abc, sys
gone = set(sys.argv[1].split(","))
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name in gone:
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
sys.path.insert(0, sys.argv[2])
import __spark_entry__ as entry
names = set(entry.queries())
assert set(entry.oracle_sql()) <= names and "limit_crossings" in names
print(sum(n == "pipeline" or n.startswith("op") for n in names))
"""


def optional_queries(*gone: str) -> int:
    run = subprocess.run([sys.executable, "-c", WITHOUT, ",".join(gone), str(ROOT)],
                         capture_output=True, text=True, check=True)
    return int(run.stdout)


def test_core_stands_without_the_optional_parts():
    assert optional_queries("gaugebook.llm") == 0
    assert optional_queries("gaugebook.llm", "corpus_pipeline") == 0
