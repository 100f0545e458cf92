"""The entry module must load without a session, and from a pyspark that is a zip file."""

import os
import subprocess
import sys
from pathlib import Path

import pyspark
import pytest

ROOT = Path(__file__).resolve().parent.parent
ZIP = Path(pyspark.__file__).parent / "python/lib/pyspark.zip"


@pytest.mark.parametrize("zipped", [False, True])
def test_import_in_a_fresh_process(zipped, tmp_path):
    if zipped and not ZIP.exists():
        pytest.skip("no zipped pyspark")
    path = [str(ROOT), *([str(ZIP)] if zipped else [])]
    code = "import sys; sys.path[:0] = %r; import __spark_entry__ as e, pyspark; print(len(e.queries()), pyspark.__file__)" % path[::-1]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    r = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert r.returncode == 0, r.stderr
    n, where = r.stdout.split(maxsplit=1)
    assert int(n) > 80 and (".zip" in where) == zipped


def test_english_stop_words_are_sparks(spark):
    from pyspark.ml.feature import StopWordsRemover

    from stemma.operators import topics

    assert topics.ENGLISH_STOP == StopWordsRemover.loadDefaultStopWords("english")
