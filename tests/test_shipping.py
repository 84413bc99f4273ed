"""Workers get the package with the job, whatever folder they start in."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

_SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from ranklake.session import spark_session
spark = spark_session("local[2]", spark__ui__enabled="false", spark__sql__shuffle__partitions="2")
import __spark_entry__ as entry
for name in {names!r}:
    assert entry.queries()[name](spark, {sf_dir!r}).count() > 0, name
{more}
spark.stop()
"""


def run_elsewhere(folder, names, sf_dir, more=""):
    """The queries in a process whose workers find only what was shipped."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = _SCRIPT.format(repo=REPO, names=names, sf_dir=sf_dir, more=more)
    done = subprocess.run([sys.executable, "-c", script], cwd=folder, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]


def test_batch_functions_run_elsewhere(tmp_path):
    run_elsewhere(tmp_path, ["embed_documents", "dense_search"], os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
