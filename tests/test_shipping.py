"""Operators with Python workers run from a folder that does not hold the package."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from folioscope.session import build_session
spark = build_session("elsewhere", "local[2]", **{{
    "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2", "spark.checkpoint.dir": {folder!r}}})
for name in ("cosine_pairs", "convex_hull", "vocab_stem_job"):
    print(name, entry.queries()[name](spark, "/root/testdata/sf0.001").count())
"""


def test_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(root=ROOT, folder=str(tmp_path / "shared"))],
        cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600,
    )
    assert run.returncode == 0, run.stderr[-2000:]
    assert run.stdout.count("\n") >= 3
