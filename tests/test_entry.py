import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_every_sql_has_its_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert len(rows) == 8 and all(r.tp >= 0 and r.fp >= 0 and r.fn >= 0 for r in rows)


def test_entry_without_the_optional_subpackage(tmp_path):
    """Copied without it, the entry point still imports and has its own queries."""
    code = "import __spark_entry__ as e; q = e.queries(); assert 'iou_pairs' in q and not any(n.startswith('op') or n == 'pipeline' for n in q), sorted(q); assert set(e.oracle_sql()) <= set(q)"
    import shutil

    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
