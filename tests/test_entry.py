import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_names_agree():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 70


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_core_does_not_import_training_package():
    hits = [p for p in ROOT.glob("factloom/**/*.py") if "llm" not in p.relative_to(ROOT).parts and "factloom.llm" in p.read_text()]
    assert hits == []


def test_entry_without_training_package():
    code = "import sys; sys.modules['factloom.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p3_found' in q and 'p1_found' not in q, sorted(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
