import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent
DATA = "/root/testdata/sf0.001"


def test_entries():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 90 and all(callable(f) for f in q.values())


def test_without_the_subpackage(tmp_path):
    """The rest imports, and has its queries, where the subpackage is absent; something missing in it is an error."""
    shutil.copytree(ROOT / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import json, __spark_entry__ as e; print(json.dumps(sorted(e.queries())))"
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120, check=True)
    names = json.loads(out.stdout.splitlines()[-1])
    assert {"p1_found", "p5_found", "byte_statistics"} <= set(names) and "p2_found" not in names
    (tmp_path / "tessera" / "llm").mkdir()
    (tmp_path / "tessera" / "llm" / "__init__.py").write_text("")
    (tmp_path / "tessera" / "llm" / "queries.py").write_text("import surely_missing_module")
    broken = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120, check=False)
    assert broken.returncode and "surely_missing_module" in broken.stderr


def test_checkpoint_folder(spark, monkeypatch):
    from tessera import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
    assert session.ensure_checkpoint_dir(spark)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "n_bytes", "alphabet", "entropy"] and df.count() > 0
