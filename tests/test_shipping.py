"""The package reaches Python workers that could not import it by themselves."""

import os
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
sys.path.insert(0, {here!r})
from stratalog.session import build_session
spark = build_session("ship", "local[1]", **{{"spark.ui.showConsoleProgress": "false"}})
def run(batches):
    import stratalog.functions.fixed
    yield from batches
print("rows", spark.range(5).mapInPandas(run, "id long").count())
"""


def test_workers_get_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(here=HERE)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "rows 5" in done.stdout, done.stderr[-1500:]
