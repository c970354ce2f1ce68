"""The entry file without its optional part."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent
BLOCKED = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r} or name.startswith({name!r} + "."):
            raise ImportError(name)
sys.meta_path.insert(0, Block())
sys.path.insert(0, {repo!r})
import __spark_entry__ as entry
from meterstone.plans import REGISTRY
names = set(entry.queries())
assert set(REGISTRY) <= names and set(entry.oracle_sql()) <= names
print(len(names) - len(REGISTRY))
"""


def left_over(name):
    done = subprocess.run([sys.executable, "-c", BLOCKED.format(name=name, repo=str(REPO))], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return int(done.stdout)


def test_the_rest_works_without_the_optional_package_or_its_libraries():
    assert left_over("meterstone.llm") == 0
    assert left_over("pandas") == 0
    assert left_over("zstandard") <= 1  # only some operators need it
