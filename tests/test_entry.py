"""The rest works without the corpus operators."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

CODE = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.split('.')[:2] == ['quantspark', 'llm'] or name == 'corpus_pipeline':
            raise ModuleNotFoundError(f'No module named {name!r}', name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert e.queries().keys() == e.PLANS.keys() and e.oracle_sql()
assert not any(m.startswith('quantspark.llm') for m in sys.modules)
"""


def test_imports_without_corpus_operators():
    subprocess.run([sys.executable, "-c", CODE], cwd=Path(__file__).resolve().parents[1], check=True, timeout=120)


WITHOUT = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.split('.')[0] in ('xxhash', 'public_tokenizers'):
            raise ModuleNotFoundError(f'No module named {name!r}', name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert e.PLANS.keys() <= e.queries().keys() and 'op8_setsketch' not in e.queries()
"""


def test_imports_without_what_corpus_operators_need():
    subprocess.run([sys.executable, "-c", WITHOUT], cwd=Path(__file__).resolve().parents[1], check=True, timeout=120)


def test_nothing_else_imports_corpus_operators():
    package = Path(__file__).resolve().parents[1] / "quantspark"
    for p in package.rglob("*.py"):
        if "llm" not in p.relative_to(package).parts:
            assert "quantspark.llm" not in p.read_text(), p
