"""Every registered query against its SQL at the smallest scale, and the driver contract."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry_points

FOLDER = "/root/testdata/sf0.001"
here = os.path.dirname(os.path.abspath(__file__))

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


def test_flagship(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["hole", "call", "depth_from_m", "depth_to_m", "n"] and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_all_queries_equal_their_sql():
    done = subprocess.run([sys.executable, os.path.join(here, "check_oracle.py"), FOLDER], capture_output=True, text=True, timeout=1500)
    bad = [line for line in done.stdout.splitlines() if line.startswith(("DIFF", "FAIL"))]
    assert done.returncode == 0 and not bad, "\n".join(bad) or done.stderr[-2000:]
