"""The entry without the training-data part, or without the pipeline alone."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("gone", [("newsloom/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",), ("newsloom/llm/*.py", "corpus_pipeline.py")])
def test_without(tmp_path, gone):
    shutil.copytree(ROOT / "newsloom", tmp_path / "newsloom", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    for pattern in gone:
        for path in tmp_path.glob(pattern):
            shutil.rmtree(path) if path.is_dir() else path.unlink()
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 90 and set(o) <= set(q) and 'pipeline' not in q; print(any(n.startswith('op1_') for n in q))"
    ran = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": f"{tmp_path}:/opt/tokenizers"}, capture_output=True, text=True)
    assert ran.returncode == 0, ran.stderr
    if (ROOT / "newsloom/llm/queries.py").exists():
        assert ran.stdout.strip() == str(gone == ("corpus_pipeline.py",))


def test_shared_folder_is_needed_on_clusters(spark):
    from newsloom import session

    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Conf:
        def get(self, name, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
