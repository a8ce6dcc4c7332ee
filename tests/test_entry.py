"""The driver contract, with and without the text operators."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
WITHOUT = """
import sys
sys.modules["corpus_pipeline"] = sys.modules["tallymill.llm"] = None
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert len(q) > 90 and "leaderboard" in q and "pipeline" not in q and not any(k.startswith("op") and k[2].isdigit() for k in q)
assert set(o) <= set(q)
"""


def test_imports_without_the_text_operators():
    subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, check=True)


def test_entry_runs(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert rows and {"rank", "run_id", "score"} <= set(rows[0].asDict())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
