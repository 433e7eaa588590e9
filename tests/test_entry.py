"""The entry without its optional parts."""

import os
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
WITHOUT = """
import sys

class Blocked:
    def find_spec(self, name, path=None, target=None):
        for gone in {gone!r}:
            if name == gone or name.startswith(gone + "."):
                raise ModuleNotFoundError("No module named " + repr(name), name=name)

sys.meta_path.insert(0, Blocked())
import __spark_entry__ as entry
names = entry.queries()
assert len(names) > 150 and "feat_area_dataset" in names and "pipeline" not in names
assert set(entry.oracle_sql()) <= set(names)
assert any(n.startswith("op1_") for n in names) == {operators}
"""


@pytest.mark.parametrize(
    "gone, operators", [(("forecastlab.llm",), False), (("forecastlab.llm", "corpus_pipeline"), False)]
)
def test_entry_imports_without_the_training_data_operators(gone, operators):
    script = WITHOUT.format(gone=gone, operators=operators)
    done = subprocess.run([sys.executable, "-c", script], cwd=REPO, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
