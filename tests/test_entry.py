"""The driver's module works with and without the training-data package."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
BLOCKED = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in {names!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
print(len(e.queries()), sorted(n for n in e.queries() if n.startswith("op") and n[2].isdigit() or n == "pipeline"))
"""


def run(*names):
    return subprocess.run([sys.executable, "-c", BLOCKED.format(names=set(names))], cwd=ROOT, capture_output=True, text=True, check=False)


def test_imports_without_the_package():
    for names in (("corpus_pipeline", "quire.llm"), ("corpus_pipeline",), ("quire.llm",)):
        out = run(*names)
        assert out.returncode == 0, out.stderr
        count, found = out.stdout.split(" ", 1)
        assert int(count) > 150 and found.strip() == "[]"


def test_other_missing_modules_are_not_hidden():
    out = run("numpy")
    assert out.returncode != 0 and "numpy" in out.stderr
