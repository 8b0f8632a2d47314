"""The driver's contract: names, schemas, and imports without the language-model subpackage."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns and df.count() > 0


def test_oracles_have_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_rest_stands_alone():
    code = "import sys; sys.modules['orrery.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op') or n == 'pipeline' for n in q if n[2:3].isdigit())"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=False).returncode == 0
