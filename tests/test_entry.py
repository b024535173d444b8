import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_the_rest_works_without_the_pipeline_operators(tmp_path):
    """With the operators and the pipeline out of reach, the entry point and all other queries stay."""
    code = "import sys\nclass No:\n    def find_spec(self, name, *a):\n        if name.startswith('citegrain.llm') or name == 'corpus_pipeline': raise ModuleNotFoundError(name, name=name)\nsys.meta_path.insert(0, No())\nimport __spark_entry__ as e\nassert len(e.queries()) > 100 and not any(n.startswith('op') or n == 'pipeline' for n in e.queries())\nassert not any(m.startswith('citegrain.llm') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_no_other_module_imports_the_operators():
    for p in (ROOT / "citegrain").rglob("*.py"):
        if "llm" not in p.parts:
            assert "citegrain.llm" not in p.read_text(), p
