import subprocess
import sys
from pathlib import Path

import __spark_entry__ as e

ROOT = Path(__file__).resolve().parent.parent


def test_every_oracle_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_else_needs_the_training_subpackage(tmp_path):
    for p in ROOT.glob("*.py"):
        if p.name != "corpus_pipeline.py":
            (tmp_path / p.name).symlink_to(p)
    pkg = tmp_path / "tidemark"
    pkg.mkdir()
    for p in (ROOT / "tidemark").iterdir():
        if p.name != "llm":
            (pkg / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}).returncode == 0
