import importlib
import subprocess
import sys

from .conftest import ROOT


def test_entry(spark):
    import __spark_entry__ as e

    out = e.entry(spark)
    assert out.count() >= 1 and "real_accuracy" in out.columns
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_optional_subpackage():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("pairlens.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = e.queries()
assert "c13_classification_metrics" in names and "pipeline" not in names and not any(n.startswith("op1_") for n in names)
assert set(e.oracle_sql()) <= set(names)
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_the_optional_subpackage():
    import pathlib

    for path in pathlib.Path(ROOT, "pairlens").rglob("*.py"):
        if "llm" not in path.parts:
            assert "pairlens.llm" not in path.read_text(), path
    importlib.import_module("pairlens.plans.registry")
