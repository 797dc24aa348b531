import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_core_queries_need_no_training_data_operators(tmp_path, gone):
    for part in ("flowlens", "checks"):
        shutil.copytree(ROOT / part, tmp_path / part, ignore=shutil.ignore_patterns("__pycache__", *gone))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in gone and (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), sum(k.startswith('op') for k in q), 'pipeline' in q)"
    found = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert found.returncode == 0, found.stderr
    total, operators, pipeline = found.stdout.split()
    assert pipeline == "False"
    assert int(total) - int(operators) >= 196
    assert operators == "0" or "llm" not in gone
