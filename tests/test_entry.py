import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_llm_folders(tmp_path):
    """The rest of the repository imports when the subpackage and corpus_pipeline.py are gone."""
    root = Path(entry.__file__).parent
    shutil.copytree(root / "inkwell", tmp_path / "inkwell", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(x.startswith('op') and x[2].isdigit() for x in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
