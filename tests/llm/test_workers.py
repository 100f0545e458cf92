"""Queries must run where the package is on the driver's path only."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
CODE = """
import sys; sys.path.insert(0, {root!r})
import __spark_entry__ as e
from stemma.session import get_session
spark, q = get_session(2, 2), e.queries()
for name in "p3_found p4_found p5_found p6_found p7_found p7_segments p8_ids p9_found p10_found".split():
    q[name](spark, {sf!r}).collect()
print("all ran")
"""


def test_workers_without_the_package(sf, tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYTHONSTARTUP")}
    r = subprocess.run([sys.executable, "-c", CODE.format(root=str(ROOT), sf=sf)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=500)
    assert r.returncode == 0 and "all ran" in r.stdout, r.stderr[-2000:]
